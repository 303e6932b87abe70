"""Polygons worked out from the keys of a table, with arithmetic that is exact in binary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geometry as g


def octagon(key: Column, centred: bool = False, hole: bool = False) -> Column:
    """An octagon with half width 1 to 4, half height 1 to 5 and cut corners; ``hole``: with a square one of half side 0.25."""
    a, b, c = 1 + (key * 7 % 13) / 4, 1 + (key * 11 % 17) / 4, 0.25 + (key * 5 % 3) / 4
    cx, cy = (F.lit(0.0), F.lit(0.0)) if centred else ((key * 3 % 101).cast("double"), (key % 97).cast("double"))
    corners = [(a - c, -b), (a, -(b - c)), (a, b - c), (a - c, b), (-(a - c), b), (-a, b - c), (-a, -(b - c)), (-(a - c), -b)]
    closed = lambda pts: F.array(*[g.point(x + cx, y + cy) for x, y in [*pts, pts[0]]])
    rings = [g.ring(closed(corners))]
    if hole:
        q = F.lit(0.25)
        rings.append(g.ring(closed([(-q, -q), (-q, q), (q, q), (q, -q)]), hole=True))
    return g.polygon(*rings)


def ell(key: Column) -> Column:
    """An L of width 2w and height 2h, the arms half as wide."""
    w, h = 1 + (key * 7 % 13) / 4, 1 + (key * 11 % 17) / 4
    zero = F.lit(0.0)
    pts = [(zero, zero), (2 * w, zero), (2 * w, h), (w, h), (w, 2 * h), (zero, 2 * h)]
    return g.polygon(g.ring(F.array(*[g.point(x, y) for x, y in [*pts, pts[0]]])))


def irregular(key: Column) -> Column:
    """By the key modulo 4 an L, a rectangle with a hole, two rectangles, or an arrowhead; no two keys below 10**8 give equal ones."""
    w, h = 6 + (key * 7919 % 10007) / 1024, 6 + (key * 104729 % 10009) / 1024
    t = 0.25 + (key * 31 % 7) / 16
    zero = F.lit(0.0)
    closed = lambda *pts: F.array(*[g.point(x, y) for x, y in [*pts, pts[0]]])
    box = lambda x0, y0, x1, y1: closed((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    ell_ = closed((zero, zero), (w, zero), (w, h * t), (w * t, h * t), (w * t, h), (zero, h))
    head = closed((zero, zero), (w / 2, h * t), (w, zero), (w / 2, h))
    holed = g.polygon(g.ring(box(zero, zero, w, h)), g.ring(box(w / 4, h / 4, w / 2, h / 2), hole=True))
    two = g.polygon(g.ring(box(zero, zero, w, h)), g.ring(box(w + 1, zero, w + 1 + w * t, h * t), part=1))
    kind = key % 4
    return F.when(kind == 0, g.polygon(g.ring(ell_))).when(kind == 1, holed).when(kind == 2, two).otherwise(g.polygon(g.ring(head)))


def polygons(table: DataFrame, id_col: str, key: Column | None = None, shape=octagon) -> DataFrame:
    """(id, rings, n_parts) of a table's rows; the key defaults to the id."""
    key = F.col(id_col) if key is None else key
    return table.select(F.col(id_col).cast("string").alias("id"), shape(key).alias("rings"), (F.when(key % 4 == 2, 2).otherwise(1) if shape is irregular else F.lit(1)).alias("n_parts"))
