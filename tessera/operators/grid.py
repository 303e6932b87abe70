"""Bounding boxes, the grid over them, and sketches of polygons on the grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.kernels import Edges, overlap_pairs

# Fixed value: cells along a side.
GRID = 25
#: A fill ratio of no more is what rounding leaves of none.
LEAST_FILL = 1e-12


def global_mbr(polygons: DataFrame) -> DataFrame:
    """One row (xmin, ymin, xmax, ymax) around all polygons; zeros if there are none."""
    return bounds(polygons, g.mbr(F.col("rings")))


def bounds(rows: DataFrame, box: Column) -> DataFrame:
    """One row (xmin, ymin, xmax, ymax) around the boxes of all rows; zeros if there are none."""
    boxes = rows.select(box.alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return boxes.agg(zero(F.min("b.xmin")).alias("xmin"), zero(F.min("b.ymin")).alias("ymin"), zero(F.max("b.xmax")).alias("xmax"), zero(F.max("b.ymax")).alias("ymax"))


def _cell_box(r: Column, c: Column, box: Row, size: int) -> Column:
    sx, sy = (box["xmax"] - box["xmin"]) / size, (box["ymax"] - box["ymin"]) / size
    x, y = F.lit(box["xmin"]) + c * F.lit(sx), F.lit(box["ymin"]) + r * F.lit(sy)
    return F.struct(x.alias("xmin"), y.alias("ymin"), (x + F.lit(sx)).alias("xmax"), (y + F.lit(sy)).alias("ymax"))


def grid_cells(spark: SparkSession, box: Row, size: int = GRID) -> DataFrame:
    """(cell_id, r, c, xmin, ymin, xmax, ymax), row by row from the lower left corner."""
    cells = spark.range(size * size).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / size).alias("r"), (F.col("id") % size).alias("c"))
    return cells.withColumn("b", _cell_box(F.col("r"), F.col("c"), box, size)).select("cell_id", "r", "c", "b.*")


def _box_edges(b: Column) -> Column:
    edge = lambda y, s: F.struct(b["xmin"].alias("l"), y.alias("yl"), b["xmax"].alias("r"), y.alias("yr"), F.lit(s).alias("s"))
    return F.array(edge(b["ymin"], -1.0), edge(b["ymax"], 1.0))


def fill_ratio(edges: Column, box: Column) -> Column:
    """Part of the box's area that the polygon covers; null if the box has none."""
    return F.try_divide(g.overlap_area(edges, _box_edges(box)), g.box_area(box))


def sketch_cells(polygons: DataFrame, box: Row, size: int = GRID) -> DataFrame:
    """(id, cell_id, fill) of the cells that each polygon covers in part or whole.

    A polygon meets only the cells that its own box touches, found by arithmetic: no join with
    the grid, and no row for a cell that stays empty. Overlaps are worked out for many pairs at once.
    """
    kind = polygons.schema["id"].dataType.simpleString()
    x0, y0 = box["xmin"], box["ymin"]
    sx, sy = (box["xmax"] - x0) / size, (box["ymax"] - y0) / size
    if not sx > 0 or not sy > 0:
        return polygons.select("id", F.lit(0).cast("bigint").alias("cell_id"), F.lit(0.0).alias("fill")).limit(0)
    rows = polygons.select("id", g.edges(F.col("rings")).alias("edges"), g.mbr(F.col("rings")).alias("box"))

    def cover(b: pa.RecordBatch) -> pa.RecordBatch:
        edges, own = Edges.of(b.column("edges")), b.column("box")
        at = lambda name, low, step: np.clip(np.nan_to_num(np.floor((own.field(name).to_numpy(zero_copy_only=False) - low) / step)), 0, size - 1).astype(int)
        c0, c1, r0, r1 = at("xmin", x0, sx), at("xmax", x0, sx), at("ymin", y0, sy), at("ymax", y0, sy)
        wide = c1 - c0 + 1
        n = wide * (r1 - r0 + 1)
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        r, c = r0[which] + k // wide[which], c0[which] + k % wide[which]
        left, low = x0 + c * sx, y0 + r * sy
        fill = overlap_pairs(edges.take(which), Edges.of_boxes(left, low, left + sx, low + sy)) / ((left + sx - left) * (low + sy - low))
        keep = fill > LEAST_FILL
        return pa.RecordBatch.from_arrays([b.column("id").take(pa.array(which[keep])), pa.array((r * size + c)[keep], pa.int64()), pa.array(fill[keep])], names=["id", "cell_id", "fill"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from (cover(b.slice(i, 256)) for i in range(0, b.num_rows, 256))

    return rows.mapInArrow(run, f"id {kind}, cell_id bigint, fill double")


def sketches(polygons: DataFrame, box: Row, size: int = GRID) -> DataFrame:
    """(id, sketch): the fill ratios of all cells in order, zero where nothing is covered."""
    by_id = sketch_cells(polygons, box, size).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "fill"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(size * size - 1).cast("bigint")), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    none = F.array_repeat(F.lit(0.0), size * size)
    return polygons.select("id").join(by_id, "id", "left").select("id", F.when(F.col("m").isNull(), none).otherwise(dense).alias("sketch"))


def occupied_cells(polygons: DataFrame, box: Row, size: int = GRID) -> DataFrame:
    """(id, cells): the numbers of the cells with a fill ratio above zero, ascending."""
    return sketch_cells(polygons, box, size).groupBy("id").agg(F.sort_array(F.collect_list("cell_id")).alias("cells"))
