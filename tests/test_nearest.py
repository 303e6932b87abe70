"""The comparison that leaves polygons out by the areas of cells, against all pairs."""

import numpy as np
import pytest

from tessera.functions import kernels

FRAME = (-6.0, -6.0, 12.0, 12.0)


def ells(n, seed):
    """L shapes around their corner's surroundings."""
    rng = np.random.RandomState(seed)
    rows = []
    for w, h, t in zip(6 + 10 * rng.rand(n), 6 + 10 * rng.rand(n), 0.25 + rng.randint(0, 7, n) / 16, strict=True):
        x, y = 0.4 * w, 0.4 * h
        rows += [(-x, -y, w - x, -y, -1.0), (w * t - x, h * t - y, w - x, h * t - y, 1.0), (-x, h - y, w * t - x, h - y, 1.0)]
    return kernels.Edges(np.array(rows).T.copy(), 3 * np.arange(n + 1))


def boxes(*each):
    """Polygons of rectangles, each (x0, y0, x1, y1)."""
    rows = [r for polygon in each for x0, y0, x1, y1 in polygon for r in ((x0, y0, x1, y0, -1.0), (x0, y1, x1, y1, 1.0))]
    return kernels.Edges(np.array(rows).T.copy(), 2 * np.concatenate([[0], np.cumsum([*map(len, each)])]))


def plain(a, b, k):
    found = []
    for i, row in enumerate(kernels.distances(kernels.overlap_matrix(a, b), a.areas()[:, None], b.areas()[None, :])):
        known = np.flatnonzero(~np.isnan(row))
        if len(known):
            worst = np.sort(row[known])[min(k, len(known)) - 1]
            found += [(i, j) for j in known if row[j] <= worst + 1e-12]
    return found


def test_few_pairs_are_compared(monkeypatch):
    a, b = ells(200, 1), ells(6000, 2)
    want = plain(a, b, 10)
    cells = [kernels.cell_areas(x, FRAME, 6) for x in (a, b)]
    compared, before = [], kernels.overlap_pairs
    monkeypatch.setattr(kernels, "overlap_pairs", lambda x, y: compared.append(len(x)) or before(x, y))
    i, j, d = kernels.nearest(a, cells[0], b, cells[1], 10)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(want)
    assert sum(compared) < len(a) * len(b) / 20
    limit = np.full(len(a), np.median(d))
    near = [*zip(i[d <= limit[i]].tolist(), j[d <= limit[i]].tolist(), strict=True)]
    assert sorted(near) == sorted(zip(*(x.tolist() for x in kernels.nearest(a, cells[0], b, cells[1], 10, limit)[:2]), strict=True))


@pytest.mark.parametrize("k", [1, 3, 50])
def test_overlapping_parts_ties_and_no_area(k):
    twice = [(-1.0, -1.0, 1.0, 1.0), (-1.0, -1.0, 1.0, 1.0)]
    squares = [[(-s, -s, s, s)] for s in (1.0, 1.0, 1.5, 2.0, 2.5)] * 20
    a, b = boxes(twice, [(-1.0, -1.0, 1.0, 1.0)], [(0.0, 0.0, 1.0, 0.0)], [(30.0, 30.0, 31.0, 31.0)]), boxes(*squares, twice, [(0.0, 0.0, 1.0, 0.0)])
    cells = [kernels.cell_areas(x, FRAME, 6) for x in (a, b)]
    assert np.isnan(cells[0]).any(1).tolist() == [True, False, False, False] and np.isnan(cells[1]).any(1).sum() == 1
    i, j, _ = kernels.nearest(a, cells[0], b, cells[1], k)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(plain(a, b, k))


def test_search_with_overlapping_parts(spark):
    """Doubled squares have the distance that the formula gives, in whatever block they are."""
    from tessera.functions import geometry as g
    from tessera.operators import search

    ring = lambda s, part=0: (part, False, [(-s, -s), (s, -s), (s, s), (-s, s), (-s, -s)])
    rows = [(f"s{n:03}", [ring(1 + n / 64)], 1) for n in range(100)] + [(f"t{n}", [ring(1 + n / 8), ring(1 + n / 8, 1)], 2) for n in range(4)]
    data = spark.createDataFrame(rows, f"id string, rings {g.RINGS}, n_parts int")
    e = with_edges(data)
    ea, names = kernels.Edges.of(e.column("edges")), e.column("id").to_pylist()
    dist = kernels.distances(kernels.overlap_matrix(ea, ea), ea.areas()[:, None], ea.areas()[None, :])
    want = {(names[i], rank + 1, n) for i, row in enumerate(dist) for rank, (_, n) in enumerate(sorted((v, n) for v, n in zip(row.round(12), names, strict=True) if v == v)[:5])}
    got = {(r["query_id"], r["rank"], r["neighbor_id"]) for r in search.exact_knn(data, data, 5, 10).collect()}
    assert got == want


def test_buckets_compare_few_pairs(monkeypatch):
    import pyarrow as pa

    from tessera.operators import search

    a, b = ells(150, 3), ells(6000, 4)
    ka, kb = np.arange(150) % 3, np.arange(6000) % 4
    side = lambda x, key: pa.table({"key": key, "edges": pa.array([[dict(zip(("l", "yl", "r", "yr", "s"), v)) for v in zip(*(w[i:j].tolist() for w in (x.l, x.yl, x.r, x.yr, x.s)), strict=True)] for i, j in zip(x.first, x.first[1:])]), "cells": [*kernels.cell_areas(x, FRAME, 6)]})
    compared, before = [], kernels.overlap_pairs
    sides = side(a, ka), side(b, kb)
    monkeypatch.setattr(kernels, "overlap_pairs", lambda x, y: compared.append(len(x)) or before(x, y))
    found = [(i, j) for x, y, _ in search.near_in_buckets(*sides, 10) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
    want = []
    for key in range(3):
        i, j = np.flatnonzero(ka == key), np.flatnonzero(kb == key)
        want += [(i[x], j[y]) for x, y in plain(a.take(i), b.take(j), 10)]
    assert sorted(found) == sorted(want) and sum(compared) < 150 * 1500 / 10


def with_edges(data):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from tessera.functions import geometry as g

    rows = data.select("id", g.edges(F.col("rings")).alias("edges")).collect()
    return pa.table({"id": [r["id"] for r in rows], "edges": pa.array([[x.asDict() for x in r["edges"]] for r in rows], pa.list_(pa.struct([(n, pa.float64()) for n in ("l", "yl", "r", "yr", "s")])))})
