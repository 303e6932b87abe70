"""The whole run: read, centre, search both ways, compare, write.

    python -m tessera.plans.comparison DATA QUERIES K OUT
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import evaluate, search, sinks
from tessera.operators.minhash import Darts, signature_stats
from tessera.session import cleanup, stored
from tessera.sources.polygons import read_wkt_with_id


@dataclass
class Comparison:
    approx: DataFrame
    exact: DataFrame
    pruning: DataFrame
    top1: DataFrame
    by_query: DataFrame
    overall: DataFrame
    stats: DataFrame
    excluded: DataFrame


def _rounded(found: DataFrame) -> DataFrame:
    digits = found.withColumn("distance", sinks.six_digits(F.col("distance")).cast("double"))
    order = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return digits.withColumn("rank", F.row_number().over(order).cast("bigint"))


def compare(data: DataFrame, queries: DataFrame, k: int = 10, darts: Darts = Darts(), ring: str = "exterior", count_empty: bool = False, text_roundtrip: bool = False) -> Comparison:
    """Both searches over polygons (id, rings, n_parts), and how they differ.

    ``count_empty``: queries without approximate neighbours count as zeros in the averages.
    ``text_roundtrip``: distances have the six digits of result files before they are ranked.
    Polygons and the results of both searches are kept in the shared folder: each is worked
    out once, whatever is read of the comparison.
    """
    d, q = stored(search.centred(data), "data"), stored(search.centred(queries), "queries")
    index = search.LshIndex.fit(d, darts, ring)
    approx, exact = index.knn(q, k), search.exact_knn(q, d, k)
    if text_roundtrip:
        approx, exact = _rounded(approx), _rounded(exact)
    approx, exact = stored(approx, "approx"), stored(exact, "exact")
    by_query = stored(evaluate.per_query(approx, exact), "by-query")
    return Comparison(approx, exact, index.pruning(q), evaluate.top1_stats(approx), by_query, evaluate.overall(by_query, exact if count_empty else None), signature_stats(d, index.buckets(), index.box), index.excluded(q))


def main(args: list[str]) -> None:
    data_path, query_path, k, out = args
    spark = SparkSession.builder.appName("polygon comparison").getOrCreate()
    data, _ = read_wkt_with_id(spark, data_path)
    queries, _ = read_wkt_with_id(spark, query_path)
    done = compare(data, queries, int(k))
    sinks.write_results(done.approx, f"{out}/lsh")
    sinks.write_results(done.exact, f"{out}/exact")
    sinks.write_evaluation(done.by_query, f"{out}/comparison")
    sinks.write_signature_stats(done.stats, f"{out}/signatures")
    for name in ("pruning", "top1", "overall", "excluded"):
        getattr(done, name).write.json(f"{out}/{name}")
    cleanup(spark)


if __name__ == "__main__":
    main(sys.argv[1:])
