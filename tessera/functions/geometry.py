"""Column functions over polygons.

A polygon is ``rings``: an array of rings (part, is_hole, pts), each a closed list of points.
``edges`` turns it into its non-vertical edges from left to right, with the sign that the
edge has in a sum of areas under edges; overlap areas are sums over pairs of edges.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<struct<part:int,is_hole:boolean,pts:array<struct<x:double,y:double>>>>"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
EDGES = "array<struct<l:double,yl:double,r:double,yr:double,s:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def ring(points: Column, hole: bool = False, part: int = 0) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(hole).alias("is_hole"), points.alias("pts"))


def polygon(*rings: Column) -> Column:
    return F.array(*rings).cast(RINGS)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _steps(pts: Column, f) -> Column:
    """``f`` of each point and the next one, summed along the closed ring."""
    return _sum(F.transform(F.sequence(F.lit(0), F.size(pts) - 2), lambda i: f(F.get(pts, i), F.get(pts, i + 1))))


def _cross(p: Column, q: Column) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def _ring_area2(r: Column) -> Column:
    """Twice the signed area: positive if the ring runs counter-clockwise."""
    return F.when(F.size(r["pts"]) < 4, F.lit(0.0)).otherwise(_steps(r["pts"], _cross))


def _role(r: Column) -> Column:
    """1 if the ring runs as its role asks (shells counter-clockwise, holes clockwise), else -1; 0 without area."""
    return F.signum(_ring_area2(r)) * F.when(r["is_hole"], F.lit(-1.0)).otherwise(F.lit(1.0))


def area(rings: Column) -> Column:
    """Area of shells less that of holes."""
    return _sum(F.transform(rings, lambda r: _role(r) * _ring_area2(r))) / 2


def centroid(rings: Column) -> Column:
    """Point (x, y); null without area."""
    along = lambda axis: _sum(F.transform(rings, lambda r: _role(r) * F.when(F.size(r["pts"]) < 4, F.lit(0.0)).otherwise(_steps(r["pts"], lambda p, q: (p[axis] + q[axis]) * _cross(p, q)))))
    whole = _sum(F.transform(rings, lambda r: _role(r) * _ring_area2(r))) * 3
    return F.when(whole != 0, F.struct(F.try_divide(along("x"), whole).alias("x"), F.try_divide(along("y"), whole).alias("y")))


def translate(rings: Column, dx: Column, dy: Column) -> Column:
    moved = lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))
    return F.transform(rings, lambda r: F.struct(r["part"].alias("part"), r["is_hole"].alias("is_hole"), F.transform(r["pts"], moved).alias("pts")))


def _bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def center(rings: Column) -> Column:
    """The polygon moved so that its centroid is the origin; as it is without area."""
    return _bound(centroid(rings), lambda c: F.when(c.isNull(), rings).otherwise(translate(rings, -c["x"], -c["y"])))


def mbr(rings: Column) -> Column:
    """Bounding box (xmin, ymin, xmax, ymax)."""
    all_ = lambda axis: F.flatten(F.transform(rings, lambda r: F.transform(r["pts"], lambda p: p[axis])))
    return F.struct(F.array_min(all_("x")).alias("xmin"), F.array_min(all_("y")).alias("ymin"), F.array_max(all_("x")).alias("xmax"), F.array_max(all_("y")).alias("ymax"))


def box_polygon(box: Column) -> Column:
    """The box as a polygon."""
    corners = [(box["xmin"], box["ymin"]), (box["xmax"], box["ymin"]), (box["xmax"], box["ymax"]), (box["xmin"], box["ymax"]), (box["xmin"], box["ymin"])]
    return polygon(ring(F.array(*[point(x, y) for x, y in corners])))


def box_area(box: Column) -> Column:
    return (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"])


def exterior(rings: Column) -> Column:
    """Points of the first shell."""
    return F.get(F.filter(rings, lambda r: ~r["is_hole"]), F.lit(0))["pts"]


def n_parts(rings: Column) -> Column:
    return F.size(F.array_distinct(F.transform(rings, lambda r: r["part"])))


def edges(rings: Column) -> Column:
    """Non-vertical edges (l, yl, r, yr, s): from left to right, s 1 where the inside lies below, else -1."""

    def edge(role, p, q):
        forth = p["x"] < q["x"]
        left, right = F.when(forth, p).otherwise(q), F.when(forth, q).otherwise(p)
        return F.struct(left["x"].alias("l"), left["y"].alias("yl"), right["x"].alias("r"), right["y"].alias("yr"), (role * F.signum(p["x"] - q["x"])).alias("s"))

    def of_ring(r):
        pairs = F.transform(F.sequence(F.lit(0), F.size(r["pts"]) - 2), lambda i: F.struct(F.get(r["pts"], i).alias("p"), F.get(r["pts"], i + 1).alias("q")))
        return _bound(_role(r), lambda role: F.transform(F.filter(pairs, lambda e: e["p"]["x"] != e["q"]["x"]), lambda e: edge(role, e["p"], e["q"])))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r["pts"]) >= 4), of_ring))


def _under_both(a: Column, b: Column) -> Column:
    """Signed area under the lower of two edges over the range that both span."""
    at = lambda e, x: e["yl"] + (e["yr"] - e["yl"]) / (e["r"] - e["l"]) * (x - e["l"])
    lo, hi = F.greatest(a["l"], b["l"]), F.least(a["r"], b["r"])

    def value(v):
        w, a0, a1, b0, b1 = v["w"], v["a0"], v["a1"], v["b0"], v["b1"]
        d0, d1 = a0 - b0, a1 - b1
        over = F.when((d0 >= 0) & (d1 >= 0), w * (d0 + d1) / 2).when((d0 <= 0) & (d1 <= 0), F.lit(0.0)).otherwise(w * F.greatest(d0, d1) * F.greatest(d0, d1) / (2 * (F.abs(d0) + F.abs(d1))))
        return a["s"] * b["s"] * (w * (a0 + a1) / 2 - over)

    heights = F.struct((hi - lo).alias("w"), at(a, lo).alias("a0"), at(a, hi).alias("a1"), at(b, lo).alias("b0"), at(b, hi).alias("b1"))
    return F.when(lo < hi, _bound(heights, value)).otherwise(F.lit(0.0))


def overlap_area(edges_a: Column, edges_b: Column) -> Column:
    """Area of the intersection of two polygons, given by their ``edges``."""
    return F.aggregate(edges_a, F.lit(0.0), lambda acc, a: acc + F.aggregate(edges_b, F.lit(0.0), lambda t, b: t + _under_both(a, b)))


def jaccard_distance(overlap: Column, area_a: Column, area_b: Column) -> Column:
    """1 - overlap / union; null if the union has no area."""
    return F.lit(1.0) - F.try_divide(overlap, area_a + area_b - overlap)


def contains(pts: Column, x: Column, y: Column) -> Column:
    """Whether the closed ring's inside holds the point, by the parity of edges that a ray to the right crosses."""
    crosses = lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], F.lit(1.0)).otherwise(q["y"] - p["y"]) + p["x"])
    hits = F.filter(F.sequence(F.lit(0), F.size(pts) - 2), lambda i: crosses(F.get(pts, i), F.get(pts, i + 1)))
    return F.size(hits) % 2 == 1


def sketch_jaccard(a: Column, b: Column) -> Column:
    """Distance of two fill ratio arrays: 1 - sum of minima / sum of maxima; 1 if nothing is filled."""
    low, high = _sum(F.zip_with(a, b, lambda x, y: F.least(x, y))), _sum(F.zip_with(a, b, lambda x, y: F.greatest(x, y)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("sketches differ in length")).cast("double")).when(high == 0, F.lit(1.0)).otherwise(1 - F.try_divide(low, high))


def sketch_join_distance(a: Column, b: Column) -> Column:
    """1 - I / U with I the sum of products and U the sum of both less I; 1 if U is 0."""
    both, either = _sum(F.zip_with(a, b, lambda x, y: x * y)), _sum(F.zip_with(a, b, lambda x, y: x + y))
    union = either - both
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("sketches differ in length")).cast("double")).when(union == 0, F.lit(1.0)).otherwise(1 - F.try_divide(both, union))


def hash_bits(signature: Column) -> Column:
    """Bits that the values of a signature take: ceil(log2(v + 1)), 1 for 0."""
    bits = lambda v: F.when(v > 0, F.ceil(F.log2(v + 1))).otherwise(F.lit(1)).cast("bigint")
    return F.aggregate(F.transform(signature, bits), F.lit(0).cast("bigint"), lambda a, x: a + x)


def to_wkt(rings: Column) -> Column:
    """POLYGON text, or MULTIPOLYGON if there are several parts; shortest round-trip numbers."""
    number = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    body = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r["pts"], lambda p: F.concat(number(p["x"]), F.lit(" "), number(p["y"]))), ", "), F.lit(")"))
    parts = F.array_sort(F.array_distinct(F.transform(rings, lambda r: r["part"])))
    one = lambda part: F.concat(F.lit("("), F.array_join(F.transform(F.filter(rings, lambda r: r["part"] == part), body), ", "), F.lit(")"))
    return F.when(F.size(rings) == 0, F.lit("POLYGON EMPTY")).when(F.size(parts) == 1, F.concat(F.lit("POLYGON "), one(F.get(parts, F.lit(0))))).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(parts, one), ", "), F.lit(")")))
