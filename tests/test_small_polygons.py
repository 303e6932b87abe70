"""Signatures of polygons that cover little of the box."""

import numpy as np
from pyspark.sql import Row

from tessera.operators import minhash, search

BOX = Row(xmin=0.0, ymin=0.0, xmax=1000.0, ymax=1000.0)
POLYGONS = "id string, rings array<struct<part int, is_hole boolean, pts array<struct<x double, y double>>>>, n_parts int"


def square(x, y, a, b=None):
    b = a if b is None else b
    return [(0, False, [(x, y), (x + a, y), (x + a, y + b), (x, y + b), (x, y)])]


def rows(spark, shapes):
    return spark.createDataFrame([(n, r, 1) for n, r in shapes.items()], POLYGONS)


def test_drawing_goes_on(spark):
    shapes = {"large": square(0.0, 0.0, 1000.0), "small": square(300.0, 400.0, 5.0), "flat": square(10.0, 10.0, 5.0, 0.0), "outside": square(2000.0, 0.0, 5.0), "beside": square(1000.0, 0.0, 5.0), "sliver": [(0, False, [(0.0, 0.0), (0.1, 0.3), (0.2, 0.6), (0.0, 0.0)])]}
    darts = minhash.Darts(attempts=64)
    key = lambda df: {(r["id"], r["table_id"]): r["hash"][0] for r in df.collect()}
    got = key(minhash.signatures(rows(spark, shapes), BOX, darts))
    want = {}
    for h in range(2):
        u, v = (1000 * w for w in minhash.Darts(attempts=1 << 19).unit(h, 0))
        want["large", h] = 1
        want["small", h] = int(np.flatnonzero((u > 300) & (u < 305) & (v > 400) & (v < 405))[0]) + 1
    assert got == want and min(want["small", h] for h in range(2)) > 64
    assert key(minhash.signatures_by_cells(rows(spark, shapes), BOX, darts)) == want


def test_small_polygons_have_neighbours_and_the_rest_are_counted(spark):
    shapes = {"large": square(-500.0, -500.0, 1000.0)} | {f"s{i}": square(-2.5, -2.5, 5.0 + i / 100) for i in range(3)} | {"flat": square(0.0, 0.0, 5.0, 0.0)}
    data = rows(spark, shapes)
    index = search.LshIndex.fit(data, minhash.Darts(attempts=64))
    found = {(r["query_id"], r["neighbor_id"]) for r in index.knn(data, 3).collect()}
    assert all((f"s{i}", f"s{i}") in found for i in range(3))
    assert index.excluded(data).first().asDict() == {"data": 1, "queries": 1}


def test_hits_by_cells_are_those_of_all_points():
    rng = np.random.RandomState(5)
    xs, ys, first, per = [], [], [0], []
    for n in range(400):
        # polygons in and about the box, some with two rings, one with none
        rings = n % 3 if n < 6 else 1 + (n % 7 == 0)
        per.append(rings)
        for _ in range(rings):
            m = rng.randint(3, 9)
            x, y = rng.uniform(-200, 1200, 2)[:, None] + rng.choice([5, 50, 400]) * rng.randn(2, m)
            xs += [*x, x[0]]
            ys += [*y, y[0]]
            first.append(len(xs))
    xs, ys, first, per = (np.array(v) for v in (xs, ys, first, per))
    x, y = minhash.Darts(attempts=3000).scaled(0, 0, BOX)
    want = minhash._hits(xs, ys, first, per, x, y)
    assert 0 < np.count_nonzero(want) < len(want)
    for size, step in ((25, 1 << 20), (1, 100), (7, 1000)):
        assert minhash._hits_by_cells(xs, ys, first, per, x, y, BOX, size, step=step).tolist() == want.tolist()


def test_no_join_of_cells_and_points(spark):
    data = rows(spark, {"a": square(0.0, 0.0, 1000.0)})
    plan = minhash.signatures_by_cells(data, BOX)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
