"""The same geometry on NumPy arrays, many polygons at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Pairs of edges that one step works on.
STEP = 1 << 20


class Edges:
    """Edges of several polygons: arrays l, yl, r, yr, s, and ``first``, where each polygon's begin (one more than polygons)."""

    def __init__(self, values: np.ndarray, first: np.ndarray):
        self.l, self.yl, self.r, self.yr, self.s = values
        self.first = first

    @classmethod
    def of(cls, column: pa.Array) -> "Edges":
        """From an Arrow list column of edge structs; null lists have none."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        sizes = np.array([len(x) if x.is_valid else 0 for x in column], np.int64) if column.null_count else np.diff(column.offsets.to_numpy())
        flat = column.flatten()
        return cls(np.array([flat.field(n).to_numpy(zero_copy_only=False) for n in ("l", "yl", "r", "yr", "s")]).reshape(5, -1), np.concatenate([[0], np.cumsum(sizes)]))

    def take(self, which: np.ndarray) -> "Edges":
        """The polygons at these places, in this order, repeats allowed."""
        size = np.diff(self.first)[which]
        ends = np.cumsum(size)
        i = np.repeat(self.first[which] - ends + size, size) + np.arange(size.sum())
        return Edges(np.array([x[i] for x in (self.l, self.yl, self.r, self.yr, self.s)]).reshape(5, -1), np.concatenate([[0], ends]))

    @classmethod
    def of_boxes(cls, xmin: np.ndarray, ymin: np.ndarray, xmax: np.ndarray, ymax: np.ndarray) -> "Edges":
        """Lower and upper edges of rectangles."""
        pair = lambda a, b: np.stack([a, b], 1).ravel()
        y = pair(ymin, ymax)
        return cls(np.array([pair(xmin, xmin), y, pair(xmax, xmax), y, np.tile([-1.0, 1.0], len(xmin))]), 2 * np.arange(len(xmin) + 1))

    def __len__(self) -> int:
        return len(self.first) - 1

    def areas(self) -> np.ndarray:
        return _by_polygon(self.s * (self.r - self.l) * (self.yl + self.yr) / 2, self.first)


def _by_polygon(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(values.shape[:-1] + (len(first) - 1,))
    sums = np.add.reduceat(np.concatenate([values, np.zeros(values.shape[:-1] + (1,))], -1), first[:-1], axis=-1)
    return np.where(np.diff(first) > 0, sums, 0.0)


def _under_both(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Signed area under the lower of two edges; arrays l, yl, r, yr, s that broadcast."""
    (al, ayl, ar, ayr, s), (bl, byl, br, byr, t) = a, b
    lo, hi = np.maximum(al, bl), np.minimum(ar, br)
    w = np.maximum(hi - lo, 0.0)
    ma, mb = (ayr - ayl) / (ar - al), (byr - byl) / (br - bl)
    a0, a1, b0, b1 = ayl + ma * (lo - al), ayl + ma * (hi - al), byl + mb * (lo - bl), byl + mb * (hi - bl)
    d0, d1 = a0 - b0, a1 - b1
    top = np.maximum(d0, d1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = w * top * top / (2 * (np.abs(d0) + np.abs(d1)))
    over = np.where((d0 >= 0) & (d1 >= 0), w * (d0 + d1) / 2, np.where((d0 <= 0) & (d1 <= 0), 0.0, mixed))
    return s * t * np.where(w > 0, w * (a0 + a1) / 2 - over, 0.0)


def overlap_matrix(a: Edges, b: Edges) -> np.ndarray:
    """Overlap areas of every polygon of ``a`` with every one of ``b``."""
    out = np.zeros((len(a), len(b)))
    wide = max(1, STEP // max(1, len(b.l)))
    right = [x[None, :] for x in (b.l, b.yl, b.r, b.yr, b.s)]
    start = 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(a.first, a.first[start] + wide, "right")) - 1)
        cut = slice(a.first[start], a.first[end])
        by_edge = _by_polygon(_under_both([x[cut, None] for x in (a.l, a.yl, a.r, a.yr, a.s)], right), b.first)
        out[start:end] = _by_polygon(by_edge.T, a.first[start : end + 1] - a.first[start]).T
        start = end
    return out


def overlap_pairs(a: Edges, b: Edges) -> np.ndarray:
    """Overlap areas of the polygons of ``a`` and ``b`` that have the same place."""
    na, nb = np.diff(a.first), np.diff(b.first)
    out = np.zeros(len(a))
    ends = np.concatenate([[0], np.cumsum(na * nb)])
    start = 0
    while start < len(a):
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + STEP, "right")) - 1)
        n = (na * nb)[start:end]
        which = np.repeat(np.arange(start, end), n)
        k = np.arange(n.sum()) - np.repeat(ends[start:end] - ends[start], n)
        i, j = a.first[which] + k // np.maximum(nb[which], 1), b.first[which] + k % np.maximum(nb[which], 1)
        parts = _under_both([x[i] for x in (a.l, a.yl, a.r, a.yr, a.s)], [x[j] for x in (b.l, b.yl, b.r, b.yr, b.s)])
        out[start:end] = _by_polygon(parts, ends[start : end + 1] - ends[start])
        start = end
    return out


def cell_areas(a: Edges, frame: tuple[float, float, float, float], size: int) -> np.ndarray:
    """Areas of each polygon in the ``size`` x ``size`` cells of the frame (xmin, ymin, xmax, ymax), and outside of it, a row each.

    A polygon whose parts or holes overlap, so that places count twice or less than nothing, has NaN: its areas bound no overlap.
    """
    x0, y0, x1, y1 = frame
    c, r = np.tile(np.arange(size), size), np.repeat(np.arange(size), size)
    xs, ys = x0 + (x1 - x0) * np.arange(size + 1) / size, y0 + (y1 - y0) * np.arange(size + 1) / size
    n, m = len(a), size * size
    boxes = Edges.of_boxes(*(np.tile(v, n) for v in (xs[c], ys[r], xs[c + 1], ys[r + 1])))
    inside = overlap_pairs(a.take(np.repeat(np.arange(n), m)), boxes).reshape(n, m)
    area = a.areas()
    with np.errstate(invalid="ignore"):
        plain = np.abs(overlap_pairs(a, a) - area) <= 1e-9 * np.abs(area)
    return np.where(plain[:, None], np.concatenate([inside, (area - inside.sum(1))[:, None]], 1), np.nan)


def leaves(points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points, and where its groups begin (one more than groups): halves along the widest side until none has more than ``size``."""
    todo, done = [np.arange(len(points))], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        x = points[part]
        axis = int(np.argmax(x.max(0) - x.min(0)))
        half = len(part) // 2
        part = part[np.argpartition(x[:, axis], half)]
        todo += [part[:half], part[half:]]
    return np.concatenate(done), np.cumsum([0, *map(len, done)])


def nearest(a: Edges, cells_a: np.ndarray, b: Edges, cells_b: np.ndarray, k: int, limit: np.ndarray | None = None, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) and distances of the ``k`` polygons of ``b`` nearest to each of ``a``, with all that tie with the k-th; none beyond ``limit``, one for each of ``a``.

    ``cells_a``, ``cells_b``: as ``cell_areas`` gives, with one frame. What two polygons don't share is at least what their cells differ by, so a group of
    ``b`` whose cells all differ by more than the k-th best allows, and then each such polygon, is left out: exact, whatever the cells are. Polygons with NaN meet all.
    """
    limit = np.full(len(a), np.inf) if limit is None else limit
    area_a, area_b = a.areas(), b.areas()
    # what rounding may add to a difference of cells
    reach = max((float(np.abs(v).max(initial=0)) for e in (a, b) for v in (e.l, e.r, e.yl, e.yr)), default=0.0)
    slack = 1e-11 * reach * reach
    odd_a, odd_b = np.isnan(cells_a).any(1), np.isnan(cells_b).any(1)
    plain, odd = np.flatnonzero(~odd_b), np.flatnonzero(odd_b)
    every = np.arange(len(b))
    if len(plain):
        order, first = leaves(cells_b[plain], max(64, 4 * k))
        order = plain[order]
        x = cells_b[order]
        low, high, sizes = np.minimum.reduceat(x, first[:-1]), np.maximum.reduceat(x, first[:-1]), np.diff(first)

    def compared(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = np.empty(len(i))
        for at in range(0, len(i), step):
            here = slice(at, at + step)
            u, v = a.take(i[here]), b.take(j[here])
            d[here] = distances(overlap_pairs(u, v), area_a[i[here]], area_b[j[here]])
        return d

    def members(r: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of ``r`` with each place in ``order`` of its leaf."""
        n = sizes[leaf]
        ends = np.cumsum(n)
        return np.repeat(r, n), np.arange(n.sum()) + np.repeat(first[leaf] - ends + n, n)

    def searched(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (i, j) among the plain polygons."""
        q, area = cells_a[own], area_a[own]
        bound = np.zeros((len(own), len(sizes)))
        for f in range(q.shape[1]):
            bound += np.maximum(np.maximum(low[:, f] - q[:, f, None], q[:, f, None] - high[:, f]), 0)
        # the k most alike by their cells in the nearest group say how far the rest may be
        r, p = members(np.arange(len(own)), bound.argmin(1))
        apart = np.abs(q[r] - x[p]).sum(1)
        best = np.lexsort((apart, r))
        best = best[np.arange(len(best)) - np.searchsorted(r, r) < k]
        r = r[best]
        d = compared(own[r], order[p[best]])
        worst = np.full(len(own), -np.inf)
        np.maximum.at(worst, r, np.nan_to_num(d, nan=-np.inf))
        worst = np.where(np.bincount(r, ~np.isnan(d), len(own)) >= k, worst, np.inf)
        most = np.minimum(worst, limit[own]) + 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            radius = np.where(most < 1, area * most / (1 - most), np.inf)
        r, leaf = np.nonzero(bound <= radius[:, None] + slack)
        found = []
        ends = np.cumsum(sizes[leaf])
        start = 0
        while start < len(r):
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + step, "right")))
            i, p = members(r[start:end], leaf[start:end])
            apart = np.abs(q[i] - x[p]).sum(1) - slack
            near = 2 * apart <= most[i] * (area[i] + area_b[order[p]] + apart)
            found.append((own[i[near]], order[p[near]]))
            start = end
        return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))

    def kept(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = compared(i, j)
        seen = np.flatnonzero(d <= limit[i])
        seen = seen[np.lexsort((d[seen], i[seen]))]
        own, d = i[seen], d[seen]
        last = np.minimum(np.searchsorted(own, own) + k, np.searchsorted(own, own, "right")) - 1
        stay = d <= d[last]
        return own[stay], j[seen][stay], d[stay]

    out = []
    wide = max(1, step // max(1, len(b)))
    for at in range(0, len(a), 256):
        own = np.arange(at, min(len(a), at + 256))
        whole = own[odd_a[own]] if len(plain) else own
        for w in range(0, len(whole), wide):
            part = whole[w : w + wide]
            out.append(kept(np.repeat(part, len(every)), np.tile(every, len(part))))
        own = own[~odd_a[own]] if len(plain) else own[:0]
        if len(own):
            i, j = searched(own)
            out.append(kept(np.concatenate([i, np.repeat(own, len(odd))]), np.concatenate([j, np.tile(odd, len(own))])))
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def distances(overlap: np.ndarray, area_a: np.ndarray, area_b: np.ndarray) -> np.ndarray:
    """Jaccard distances; NaN if a union has no area."""
    union = area_a + area_b - overlap
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(union == 0, np.nan, 1.0 - overlap / union)


def first_hits(xs: np.ndarray, ys: np.ndarray, first: np.ndarray, px: np.ndarray, py: np.ndarray, step: int = 64) -> np.ndarray:
    """For each ring the 1-based number of the first point inside it, 0 if none is.

    xs, ys: the points of closed rings in a row; ``first``: where each ring begins, one more than rings.
    """
    n = len(first) - 1
    hit = np.zeros(n, np.int64)
    open_ = np.arange(n)
    for at in range(0, len(px), step):
        if not len(open_):
            break
        x, y = px[at : at + step], py[at : at + step]
        size = np.diff(first)[open_] - 1
        ends = np.cumsum(size)
        i = np.repeat(first[open_] - ends + size, size) + np.arange(size.sum())
        x0, y0, x1, y1 = xs[i, None], ys[i, None], xs[i + 1, None], ys[i + 1, None]
        spans = (y0 > y) != (y1 > y)
        level = y1 == y0
        crossing = spans & (x < (x1 - x0) * (y - y0) / np.where(level, 1.0, y1 - y0) + x0)
        counts = np.add.reduceat(np.concatenate([crossing, np.zeros((1, len(x)), bool)]).astype(np.int64), ends - size, axis=0)
        inside = (np.where((size > 0)[:, None], counts, 0) % 2) == 1
        any_ = inside.any(1)
        hit[open_[any_]] = at + 1 + inside[any_].argmax(1)
        open_ = open_[~any_]
    return hit
