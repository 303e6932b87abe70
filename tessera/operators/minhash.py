"""Area MinHash: the number of the first shared random point that falls into a polygon.

Two polygons share a value with the probability of their Jaccard similarity, because the
first point in their union is in their intersection with that probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.functions.kernels import first_hits


# Tables, values of a signature, and the seeds of table h and place i.
TABLES = 2
LENGTH = 1
SEED = 100
SEED_PER_TABLE = 123
SEED_PER_PLACE = 17


@dataclass(frozen=True)
class Darts:
    """``tables`` signatures of ``length`` values each; ``attempts``: points in the first block, after which drawing goes on for polygons not hit yet.

    The seed of table h, place i is ``base`` + SEED_PER_TABLE h + SEED_PER_PLACE i.
    """

    tables: int = TABLES
    length: int = LENGTH
    attempts: int = 4096
    base: int = SEED

    def blocks(self, table: int, place: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Points in the unit square without end: 64-bit fractions from pairs of 32-bit Mersenne Twister words, x before y. The first block has ``attempts``."""
        bits = np.random.MT19937()
        bits._legacy_seeding(self.base + SEED_PER_TABLE * table + SEED_PER_PLACE * place)
        n = self.attempts
        for more in count(16):
            words = bits.random_raw(4 * n).astype(np.float64).reshape(-1, 2, 2)
            u = np.minimum((words[:, :, 0] + words[:, :, 1] * 2.0**32) / 2.0**64, np.nextafter(1.0, 0.0))
            yield u[:, 0], u[:, 1]
            n = 1 << min(more, 20)

    def unit(self, table: int, place: int) -> tuple[np.ndarray, np.ndarray]:
        """The first block of points."""
        return next(self.blocks(table, place))

    def scaled(self, table: int, place: int, box: Row) -> tuple[np.ndarray, np.ndarray]:
        return _in_box(*self.unit(table, place), box)


def _in_box(u: np.ndarray, v: np.ndarray, box) -> tuple[np.ndarray, np.ndarray]:
    return u * (box["xmax"] - box["xmin"]) + box["xmin"], v * (box["ymax"] - box["ymin"]) + box["ymin"]


def darts_table(spark: SparkSession, box: Row, darts: Darts) -> DataFrame:
    """(table_id, pos, attempt, x, y): the first block's points, bounded by the parameters."""
    rows = []
    for h in range(darts.tables):
        for i in range(darts.length):
            rows += [(h, i, n + 1, float(x), float(y)) for n, (x, y) in enumerate(zip(*darts.scaled(h, i, box), strict=True))]
    return spark.createDataFrame(rows, "table_id int, pos int, attempt bigint, x double, y double")


def signatures(polygons: DataFrame, box: Row, darts: Darts = Darts(), ring: str = "exterior") -> DataFrame:
    """(id, table_id, hash) of polygons of one part that have area in the box; ``ring``: exterior, or full to respect holes.

    The points are drawn on each executor from the seeds; the search for the first hit
    stops at it, however many points that takes: about the box's area over the polygon's. Polygons
    without area in the box beyond rounding have no row; ``LshIndex.excluded`` counts them.
    """
    return _signed(polygons, box, darts, ring, lambda x, y, _: lambda *polygons: _hits(*polygons, x, y))


def _signed(polygons: DataFrame, box: Row, darts: Darts, ring: str, search) -> DataFrame:
    """``signatures``; ``search``: what finds the first hits of polygons among the points (x, y) of the first block in the box."""
    shells = F.filter("rings", lambda r: ~r["is_hole"]) if ring == "exterior" else F.col("rings")
    flat = polygons.filter(F.col("n_parts") == 1).select("id", F.transform(shells, lambda r: r["pts"]).alias("pts"))
    kind = polygons.schema["id"].dataType.simpleString()
    bounds = box.asDict() if isinstance(box, Row) else dict(box)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {(h, i): search(*darts.scaled(h, i, bounds), bounds) for h in range(darts.tables) for i in range(darts.length)}
        for b in batches:
            rings = b.column("pts")
            per = np.diff(rings.offsets.to_numpy())
            inner = rings.flatten()
            xy = inner.flatten()
            xs, ys = (xy.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            first = np.concatenate([[0], np.cumsum(np.diff(inner.offsets.to_numpy()))])
            # rings of one polygon follow each other; the step from one to the next is no edge
            hits = {k: find(xs, ys, first, per) for k, find in searches.items()}
            _draw_on(hits, xs, ys, first, per, bounds, darts)
            for h in range(darts.tables):
                values = np.stack([hits[h, i] for i in range(darts.length)], 1)
                found = (values > 0).all(1)
                ids = b.column("id").filter(pa.array(found))
                flat_values = values[found]
                offsets = np.arange(len(flat_values) + 1, dtype=np.int32) * darts.length
                yield pa.RecordBatch.from_arrays([ids, pa.array([h] * len(ids), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_values.ravel(), pa.int64()))], names=["id", "table_id", "hash"])

    return flat.mapInArrow(run, f"id {kind}, table_id int, hash array<bigint>")


def _hits(xs, ys, first, per, px, py) -> np.ndarray:
    """First hits of polygons with one ring each, or by the parity over all rings of each."""
    if (per == 1).all():
        return first_hits(xs, ys, first, px, py)
    out = np.zeros(len(per), np.int64)
    ends = np.concatenate([[0], np.cumsum(per)])
    for n in range(len(per)):
        inside = np.zeros(len(px), bool)
        for r in range(ends[n], ends[n + 1]):
            x0, y0 = xs[first[r] : first[r + 1] - 1, None], ys[first[r] : first[r + 1] - 1, None]
            x1, y1 = xs[first[r] + 1 : first[r + 1], None], ys[first[r] + 1 : first[r + 1], None]
            level = y1 == y0
            inside ^= ((((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / np.where(level, 1.0, y1 - y0) + x0)).sum(0) % 2).astype(bool)
        out[n] = inside.argmax() + 1 if inside.any() else 0
    return out


def _draw_on(hits: dict, xs, ys, first, per, box, darts: Darts) -> None:
    """Sets the hits that are 0 of polygons with area in the box, from the blocks after the first."""
    ends = np.concatenate([[0], np.cumsum(per)])
    edges: dict[int, tuple] = {}
    for n in np.flatnonzero(np.any([v == 0 for v in hits.values()], axis=0)):
        at = np.concatenate([np.arange(first[r], first[r + 1] - 1) for r in range(ends[n], ends[n + 1])] or [[]]).astype(int)
        e = xs[at], ys[at], xs[at + 1], ys[at + 1]
        if _has_area(*e, box):
            edges[n] = *e, min(e[0]), max(e[0]), min(e[1]), max(e[1])
    for (h, i), values in hits.items():
        left = [n for n in edges if values[n] == 0]
        drawn = 0
        for u, v in darts.blocks(h, i):
            if not left:
                break
            if drawn:
                x, y = _in_box(u, v, box)
                order = np.argsort(x)
                ordered = x[order]
                for n in left:
                    x0, y0, x1, y1, low, high, bottom, top = edges[n]
                    near = order[np.searchsorted(ordered, low) : np.searchsorted(ordered, high, "right")]
                    near = np.sort(near[(y[near] >= bottom) & (y[near] <= top)])
                    for k in range(0, len(near), 4096):
                        inside = near[k : k + 4096][_inside(x0, y0, x1, y1, x[near[k : k + 4096]], y[near[k : k + 4096]])]
                        if len(inside):
                            values[n] = drawn + inside[0] + 1
                            break
                left = [n for n in left if values[n] == 0]
            drawn += len(u)


def _inside(x0, y0, x1, y1, px, py) -> np.ndarray:
    """Whether points are inside by the parity of edges to their right."""
    x0, y0, x1, y1 = x0[:, None], y0[:, None], x1[:, None], y1[:, None]
    return ((((y0 > py) != (y1 > py)) & (px < (x1 - x0) * (py - y0) / np.where(y1 == y0, 1.0, y1 - y0) + x0)).sum(0) % 2).astype(bool)


def _has_area(x0, y0, x1, y1, box) -> bool:
    """Whether the inside by parity has area in the box: a level line between two of the vertices' heights, or those where edges cross the box's sides, runs through it there."""
    left, right, bottom, top = (box[c] for c in ("xmin", "xmax", "ymin", "ymax"))
    if not len(x0) or not (left < right and bottom < top) or not np.isfinite([x0, y0]).all():
        return False
    least = 16 * np.finfo(float).eps * max(np.abs([x0, y0]).max(), abs(left), abs(right), abs(bottom), abs(top))
    rising = np.where(x1 == x0, 1.0, x1 - x0)
    sides = [y0 + (y1 - y0) * (s - x0) / rising for s in (left, right)]
    across = [v[((x0 < s) != (x1 < s))] for v, s in zip(sides, (left, right), strict=True)]
    levels = np.unique(np.clip(np.concatenate([y0, *across, [bottom, top]]), bottom, top))
    for a, b in pairwise(levels):
        if b - a <= least:
            continue
        for y in (0.75 * a + 0.25 * b, 0.5 * a + 0.5 * b, 0.25 * a + 0.75 * b):
            met = (y0 > y) != (y1 > y)
            x = np.clip(np.sort((x1[met] - x0[met]) * (y - y0[met]) / (y1[met] - y0[met]) + x0[met]), left, right)
            if (x[1::2] - x[::2] > least).any():
                return True
    return False


def signatures_by_cells(polygons: DataFrame, box: Row, darts: Darts = Darts(), size: int = 25) -> DataFrame:
    """As ``signatures`` with exterior rings: points of the first block and polygons meet in grid cells, and the least number remains. For what that block misses drawing goes on.

    No row is made for a cell or a point: each task deals the points to cells, which lie row by row, so that a polygon takes one run of them for each row that its box touches.
    """
    return _signed(polygons, box, darts, "exterior", lambda x, y, bounds: lambda *polygons: _hits_by_cells(*polygons, x, y, bounds, size))


def _hits_by_cells(xs, ys, first, per, px, py, box, size: int, few: int = 32, step: int = 1 << 20) -> np.ndarray:
    """First hits as ``_hits`` gives, from points in the cells that each polygon's box touches: ``few`` points first, then four times as many for polygons not hit yet, and so on."""
    hit = np.zeros(len(per), np.int64)
    ends = np.concatenate([[0], np.cumsum(per)])
    # a step from one ring to the next is no edge
    start = np.ones(len(xs), bool)
    start[first[1:][np.diff(first) > 0] - 1] = False
    edge = np.flatnonzero(start)
    edges_at = np.searchsorted(edge, first[ends])
    whole = first[ends]
    own = np.flatnonzero(np.diff(whole))
    if not len(own):
        return hit
    low_x, low_y = (np.minimum.reduceat(v, whole[own]) for v in (xs, ys))
    high_x, high_y = (np.maximum.reduceat(v, whole[own]) for v in (xs, ys))
    sides = ((box["xmin"], (box["xmax"] - box["xmin"]) / size), (box["ymin"], (box["ymax"] - box["ymin"]) / size))
    cell = lambda v, low, width: np.clip(np.nan_to_num(np.floor((v - low) / width)), 0, size - 1).astype(int) if width > 0 else np.zeros(len(v), int)
    c0, c1, r0, r1 = cell(low_x, *sides[0]), cell(high_x, *sides[0]), cell(low_y, *sides[1]), cell(high_y, *sides[1])
    left = np.arange(len(own))
    at = 0
    while at < len(px) and len(left):
        x, y = px[at : at + few], py[at : at + few]
        cells = cell(y, *sides[1]) * size + cell(x, *sides[0])
        order = np.argsort(cells, kind="stable")
        runs = np.searchsorted(cells[order], np.arange(size * size + 1))
        rows = r1[left] - r0[left] + 1
        which = np.repeat(left, rows)
        r = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows) + r0[which]
        lo, hi = runs[r * size + c0[which]], runs[r * size + c1[which] + 1]
        n = hi - lo
        polygon = np.repeat(which, n)
        point = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        near = (x[point] >= low_x[polygon]) & (x[point] <= high_x[polygon]) & (y[point] >= low_y[polygon]) & (y[point] <= high_y[polygon])
        polygon, point = polygon[near], point[near]
        m = (edges_at[1:] - edges_at[:-1])[own[polygon]]
        polygon, point, m = polygon[m > 0], point[m > 0], m[m > 0]
        upto = np.cumsum(m)
        best = np.full(len(own), len(px) + 1)
        i = 0
        while i < len(polygon):
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + step, "right")))
            k = m[i:j]
            begin = np.cumsum(k) - k
            e = edge[np.arange(k.sum()) - np.repeat(begin, k) + np.repeat(edges_at[own[polygon[i:j]]], k)]
            u, v = np.repeat(x[point[i:j]], k), np.repeat(y[point[i:j]], k)
            x0, y0, x1, y1 = xs[e], ys[e], xs[e + 1], ys[e + 1]
            crossing = ((y0 > v) != (y1 > v)) & (u < (x1 - x0) * (v - y0) / np.where(y1 == y0, 1.0, y1 - y0) + x0)
            inside = np.add.reduceat(crossing.astype(np.int64), begin) % 2 == 1
            np.minimum.at(best, polygon[i:j][inside], at + point[i:j][inside] + 1)
            i = j
        found = best[left] <= len(px)
        hit[own[left[found]]] = best[left[found]]
        left = left[~found]
        at += few
        few *= 4
    return hit


def signature_stats(polygons: DataFrame, signed: DataFrame, box: Row) -> DataFrame:
    """(id, table_id, sparsity, total_bits): a polygon's part of the box, and the bits of its signature's values."""
    whole = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"])
    part = polygons.select("id", F.try_divide(g.area(F.col("rings")), F.lit(float(whole))).alias("sparsity"))
    return signed.join(part, "id").select("id", "table_id", "sparsity", g.hash_bits(F.col("hash")).alias("total_bits"))
