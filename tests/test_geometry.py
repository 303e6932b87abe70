"""Kernels and columns against closed forms."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions import kernels
from tessera.functions.repair import is_valid, make_valid, signed_area
from tessera.functions.wkt import BadGeometry, as_rings, parse, parse_geojson


def square(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


A, B = [[square(0, 0, 2, 2)]], [[square(1, 0.5, 3, 2.5)]]
HOLED = [[square(0, 0, 2, 2), square(0.5, 0.5, 1.5, 1.5)]]
ELL = [[[(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2), (0, 0)]]]
FAR = [[square(10, 10, 11, 11)]]
TWO = [[square(0, 0, 1, 1)], [square(5, 0, 6, 2)]]


def frame(spark, *shapes):
    return spark.createDataFrame([(str(i), as_rings(s), len(s)) for i, s in enumerate(shapes)], f"id string, rings {g.RINGS}, n_parts int")


def test_scalars(spark):
    rings = F.col("rings")
    rows = frame(spark, A, HOLED, ELL, TWO, [[A[0][0][::-1]]]).select("id", g.area(rings).alias("area"), g.centroid(rings).alias("c"), g.mbr(rings).alias("b"), g.n_parts(rings).alias("n"), F.size(g.exterior(rings)).alias("pts")).orderBy("id").collect()
    assert [r["area"] for r in rows] == [4, 3, 3, 3, 4]
    assert [tuple(r["c"]) for r in rows[:2]] == [(1, 1), (1, 1)] and rows[2]["c"]["x"] == pytest.approx(5 / 6)
    assert tuple(rows[3]["b"]) == (0, 0, 6, 2) and rows[3]["n"] == 2 and rows[2]["pts"] == 7


PAIRS = [(A, B, 1.5), (A, A, 4), (A, FAR, 0), (HOLED, HOLED, 3), (A, HOLED, 3), (ELL, B, 0.5), (TWO, [[square(0.5, 0, 5.5, 1)]], 1)]


def test_overlaps_both_ways(spark):
    rings = lambda s: F.expr("a" if s else "b")
    rows = spark.createDataFrame([(i, as_rings(a), as_rings(b)) for i, (a, b, _) in enumerate(PAIRS)], f"i int, a {g.RINGS}, b {g.RINGS}")
    edged = rows.select("i", g.edges(rings(True)).alias("a"), g.edges(rings(False)).alias("b"))
    native = [r["o"] for r in edged.select("i", g.overlap_area(F.col("a"), F.col("b")).alias("o")).orderBy("i").collect()]
    table = edged.orderBy("i").toArrow()
    ea, eb = kernels.Edges.of(table.column("a")), kernels.Edges.of(table.column("b"))
    assert native == pytest.approx([o for *_, o in PAIRS])
    assert kernels.overlap_pairs(ea, eb) == pytest.approx([o for *_, o in PAIRS])
    assert np.diag(kernels.overlap_matrix(ea, eb)) == pytest.approx([o for *_, o in PAIRS])
    assert ea.areas() == pytest.approx([4, 4, 4, 3, 4, 3, 3])


def test_overlap_of_stars_by_counting():
    rng = np.random.default_rng(4)

    def star():
        t = np.sort(rng.random(9)) * 2 * math.pi
        r = 0.3 + rng.random(9)
        pts = [*zip((r * np.cos(t)).tolist(), (r * np.sin(t)).tolist(), strict=True)]
        return [*pts, pts[0]]

    def edges(ring):
        out = [dict(l=min(p, q)[0], yl=min(p, q)[1], r=max(p, q)[0], yr=max(p, q)[1], s=float(np.sign(p[0] - q[0]))) for p, q in zip(ring, ring[1:], strict=False)]
        return kernels.Edges.of(pa.array([out]))

    points = rng.uniform(-1.3, 1.3, (200_000, 2))

    def inside(ring):
        odd = np.zeros(len(points), bool)
        for (x0, y0), (x1, y1) in zip(ring, ring[1:], strict=False):
            odd ^= ((y0 > points[:, 1]) != (y1 > points[:, 1])) & (points[:, 0] < (x1 - x0) * (points[:, 1] - y0) / (y1 - y0) + x0)
        return odd

    for _ in range(4):
        a, b = star(), star()
        assert kernels.overlap_pairs(edges(a), edges(b))[0] == pytest.approx((inside(a) & inside(b)).mean() * 2.6**2, abs=0.03)


def test_distances(spark):
    rows = frame(spark, A, B, FAR, [[square(0.5, 0.5, 1.5, 1.5)]])
    a = rows.alias("a").crossJoin(rows.alias("b"))
    d = a.select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), g.jaccard_distance(g.overlap_area(g.edges(F.col("a.rings")), g.edges(F.col("b.rings"))), g.area(F.col("a.rings")), g.area(F.col("b.rings"))).alias("d")).collect()
    d = {(r["i"], r["j"]): r["d"] for r in d}
    assert d["0", "1"] == 1 - 1.5 / 6.5 and d["0", "0"] == 0 and d["0", "2"] == 1 and d["0", "3"] == 0.75
    assert all(d[i, j] == d[j, i] and 0 <= d[i, j] <= 1 for i, j in d)


def test_sketches_and_bits(spark):
    one = spark.range(1)
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = one.select(g.sketch_jaccard(arr(1, 0.5), arr(0.5, 0.5)).alias("a"), g.sketch_join_distance(arr(1, 0.5), arr(0.5, 0.5)).alias("b"), g.sketch_jaccard(arr(0, 0), arr(0, 0)).alias("c"), g.sketch_join_distance(arr(0, 0), arr(0, 0)).alias("d")).first()
    assert (got["a"], got["b"], got["c"], got["d"]) == (pytest.approx(1 - 1 / 1.5), pytest.approx(1 - 0.75 / 1.75), 1, 1)
    bits = [one.select(g.hash_bits(F.array(F.lit(v).cast("bigint"))).alias("b")).first()["b"] for v in (0, 1, 3, 7, 8)]
    assert bits == [1, 1, 2, 3, 4]
    with pytest.raises(Exception, match="differ in length"):
        one.select(g.sketch_jaccard(arr(1), arr(1, 2))).collect()


def test_centring_and_points(spark):
    rows = frame(spark, ELL, TWO).select("id", g.center(F.col("rings")).alias("rings"))
    assert all(abs(r["c"]["x"]) < 1e-12 and abs(r["c"]["y"]) < 1e-12 for r in rows.select(g.centroid(F.col("rings")).alias("c")).collect())
    inside = frame(spark, ELL).select(*[g.contains(g.exterior(F.col("rings")), F.lit(x), F.lit(y)).alias(f"p{i}") for i, (x, y) in enumerate([(0.5, 0.5), (1.5, 1.5), (0.5, 1.5), (-1.0, 0.5)])]).first()
    assert tuple(inside) == (True, False, True, False)


def test_wkt_texts(spark):
    assert parse("POLYGON ((0 0, 1 0, 1 1, 0 0))")[1] == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]
    assert parse(" polygon((0 0 5,1e1 -0.5 5,.5 1 5,0 0 5)) ")[1][0][0][1] == (10, -0.5)
    assert parse("POINT (1 2)") == ("POINT", []) and parse("POLYGON EMPTY") == ("POLYGON", [])
    assert len(parse("MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5), (5.5 5.2, 5.7 5.2, 5.7 5.4, 5.5 5.2)))")[1]) == 2
    for bad in ("", "POLYGON", "POLYGON ((0 0, 1 0, 1 1))", "POLYGON ((0 0, 1 0, 0 0))", "CIRCLE (1)", "POLYGON ((0 0, 1 0, 1 1, 0 0)) x", "POLYGON ((0 0, 1, 1 1, 0 0))", "@"):
        with pytest.raises(BadGeometry):
            parse(bad)
    assert parse_geojson('{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}')[1] == [[[(0, 0), (1, 0), (1, 1), (0, 0)]]]
    texts = [r["t"] for r in frame(spark, HOLED, TWO).select("id", g.to_wkt(F.col("rings")).alias("t")).orderBy("id").collect()]
    assert parse(texts[0])[1] == HOLED and parse(texts[1]) == ("MULTIPOLYGON", TWO)


def total(parts):
    return sum(abs(signed_area(p[0])) - sum(abs(signed_area(h)) for h in p[1:]) for p in parts)


def test_validity_and_repair():
    for good in (A, HOLED, ELL, TWO):
        assert is_valid(good)
    bow = [[[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]]]
    fixed = make_valid(bow)
    assert not is_valid(bow) and len(fixed) == 2 and total(fixed) == 2 and is_valid(fixed)
    crossing_hole = [[square(0, 0, 4, 4), square(3, 1, 5, 2)]]
    assert not is_valid(crossing_hole) and total(make_valid(crossing_hole)) == 16 - 1 + 1
    outside_hole = [[square(0, 0, 1, 1), square(3, 3, 4, 4)]]
    assert not is_valid(outside_hole) and total(make_valid(outside_hole)) == 2
    flat = [[[(0, 0), (1, 1), (2, 2), (0, 0)]]]
    assert not is_valid(flat) and make_valid(flat) == []
    spike = [[[(0, 0), (2, 0), (2, 2), (2, 3), (2, 2), (0, 2), (0, 0)]]]
    assert not is_valid(spike) and total(make_valid(spike)) == 4
    pentagram = [[[(math.sin(4 * math.pi * i / 5), math.cos(4 * math.pi * i / 5)) for i in range(5)]]]
    pentagram[0][0].append(pentagram[0][0][0])
    star = make_valid(pentagram)
    assert len(star) == 5 and is_valid([star[0]])
    ring_in_ring = [[square(0, 0, 9, 9), square(1, 1, 8, 8)], [square(2, 2, 3, 3)]]
    assert is_valid(ring_in_ring)
