"""MinHash of sketches: weighted sets of grid cells instead of areas."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rejection_points(spark: SparkSession, cells: int, tables: int = 2, attempts: int = 4096, seeds: list[int] | None = None) -> DataFrame:
    """(table_id, attempt, cell_id, u): shared draws of a cell and a height in [0, 1), bounded by the parameters. ``seeds``: one for each table."""
    rows = []
    for h, seed in enumerate(seeds or range(100, 100 + tables)):
        rng = np.random.RandomState(seed)
        rows += [(h, n, c, u) for n, (c, u) in enumerate(zip(rng.randint(0, cells, attempts).tolist(), rng.random_sample(attempts).tolist(), strict=True), 1)]
    return spark.createDataFrame(rows, "table_id int, attempt bigint, cell_id bigint, u double")


def rejection_hashes(sketch_cells: DataFrame, points: DataFrame) -> DataFrame:
    """(id, table_id, hash): the first draw that falls below the fill ratio of its cell.

    Two sketches share it with the probability of their weighted Jaccard similarity. Draws
    and cells meet by an equal cell; a sketch that no draw hits has no row. Only a draw that is lower than all before it
    in its cell can be the first; these are sent to every task, and the cells stay where they are.
    """
    before = F.min("u").over(W.partitionBy("table_id", "cell_id").orderBy("attempt").rowsBetween(W.unboundedPreceding, -1))
    lower = points.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("u") < F.col("_before"))).drop("_before")
    return sketch_cells.join(F.broadcast(lower), "cell_id").filter("u < fill").groupBy("id", "table_id").agg(F.min("attempt").alias("hash"))


def consistent_parameters(spark: SparkSession, cells: int, tables: int = 2, seed: int = 100) -> DataFrame:
    """(table_id, cell_id, r, c, beta) of improved consistent weighted sampling: two gamma(2, 1) and one uniform value for each table and cell."""
    rng = np.random.RandomState(seed)
    r, c, beta = rng.gamma(2, 1, (tables, cells)), rng.gamma(2, 1, (tables, cells)), rng.random_sample((tables, cells))
    rows = [(h, i, float(r[h, i]), float(c[h, i]), float(beta[h, i])) for h in range(tables) for i in range(cells)]
    return spark.createDataFrame(rows, "table_id int, cell_id bigint, r double, c double, beta double")


def consistent_hashes(sketch_cells: DataFrame, parameters: DataFrame) -> DataFrame:
    """(id, table_id, cell_id, t): the sampled cell and quantised weight; exact for any weights, without rejection. The parameters are sent to every task."""
    met = sketch_cells.join(F.broadcast(parameters), "cell_id").withColumn("t", F.floor(F.ln("fill") / F.col("r") + F.col("beta")))
    least = F.ln("c") - F.col("r") * (F.col("t") - F.col("beta")) - F.col("r")
    return met.groupBy("id", "table_id").agg(F.min(F.struct(least.alias("a"), "cell_id", "t")).alias("m")).select("id", "table_id", "m.cell_id", "m.t")
