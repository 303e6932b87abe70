"""Nearest neighbours by inner product: one navigable graph in layers for each shard, results merged.

Vectors that repeat are one node with the few ids that can appear in a result. A shard holds
a bounded number of nodes; its graph is one row of flat arrays. Every shard answers every
block of queries, and the best of all shards' answers remain.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

INDEX_SCHEMA = "shard bigint, dim int, k int, links int, n_nodes int, vectors binary, id_ends binary, ids binary, layers int, layer_nodes binary, neighbours binary"
NONE = -1


def _diverse(x: np.ndarray, node: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
    """Of each node's candidates, nearest first (-1: none), those that are nearer to the node than to any one chosen before; then the nearest others."""
    rows, width = found.shape
    near = np.where(found >= 0, np.einsum("nd,nkd->nk", x[node], x[found]), -np.inf)
    among = np.matmul(x[found], x[found].transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for k in range(width):
        blocked = (np.where(chosen[:, :k], among[:, k, :k], -np.inf) > near[:, k, None]).any(1) if k else np.zeros(rows, bool)
        take = ~blocked & (found[:, k] >= 0) & (count < most)
        chosen[:, k] = take
        count += take
    # chosen ones first, then what is left, both nearest first
    order = np.argsort(np.where(found < 0, 2, ~chosen), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(found, order, 1)


def _layer(x: np.ndarray, members: np.ndarray, links: int, wide: int, block: int = 512) -> np.ndarray:
    """Neighbours (len(members), 2 * links) in one layer, as positions in ``members``.

    Nodes come in order; each is linked to a diverse choice among the nearest that came before it,
    and is offered to those in turn, which keep a diverse choice of what they were offered.
    """
    v = x[members].astype(np.float32)
    n = len(v)
    out = np.full((n, links), NONE, np.int64)
    for a in range(0, n, block):
        b = min(n, a + block)
        near = v[a:b] @ v[:b].T
        near[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = -np.inf
        k = min(wide, b)
        top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < b else np.tile(np.arange(b), (b - a, 1))
        score = np.take_along_axis(near, top, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        top = np.where(np.take_along_axis(score, order, 1) > -np.inf, np.take_along_axis(top, order, 1), NONE)
        picked = _diverse(v, np.arange(a, b), top, links)
        out[a:b, : picked.shape[1]] = picked
    ends = np.argwhere(out >= 0)
    own = np.stack([ends[:, 0], out[ends[:, 0], ends[:, 1]]], 1)
    both = np.concatenate([own, own[:, ::-1]])
    score = np.einsum("nd,nd->n", v[both[:, 0]], v[both[:, 1]])
    both = both[np.lexsort((both[:, 1], -score, both[:, 0]))]
    first = np.searchsorted(both[:, 0], np.arange(n + 1))
    size = np.diff(first)
    result = np.full((n, 2 * links), NONE, np.int64)
    rank = np.arange(len(both)) - first[both[:, 0]]
    fits = (size[both[:, 0]] <= 2 * links) & (rank < 2 * links)
    result[both[fits, 0], rank[fits]] = both[fits, 1]
    for nodes in np.array_split(np.flatnonzero(size > 2 * links), max(1, n // block)):
        if len(nodes):
            width = min(int(size[nodes].max()), 4 * links)
            at = first[nodes, None] + np.arange(width)[None, :]
            cand = np.where(np.arange(width)[None, :] < size[nodes, None], both[np.minimum(at, len(both) - 1), 1], NONE)
            result[nodes] = _diverse(v, nodes, cand, 2 * links)
    return result


def build_graph(x: np.ndarray, *, links: int = 16, wide: int = 64, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the top to the ground: (node numbers, neighbours as node numbers). A node is in layer n with probability links**-n."""
    rng = np.random.default_rng(seed)
    height = np.floor(-np.log(1 - rng.random(len(x))) / math.log(links)).astype(int)
    layers = []
    for level in range(int(height.max(initial=0)), -1, -1):
        members = np.flatnonzero(height >= level)
        near = _layer(x, members, links, wide)
        layers.append((members.astype(np.int32), np.where(near >= 0, members[near], NONE).astype(np.int32)))
    return layers


def search_graph(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, wide: int) -> np.ndarray:
    """For each query up to ``wide`` nodes found from the top layer down (-1: fewer found), nearest first."""
    n, q = len(x), len(queries)
    at = np.full(q, layers[0][0][0], np.int64)
    where = np.full(n, NONE, np.int64)
    for members, near in layers[:-1]:
        where[:] = NONE
        where[members] = np.arange(len(members))
        best = np.einsum("qd,qd->q", queries, x[at])
        active = np.arange(q)
        while len(active):
            around = near[where[at[active]]]
            score = np.where(around >= 0, np.matmul(x[around], queries[active][:, :, None])[:, :, 0], -np.inf)
            k = score.argmax(1)
            top = score[np.arange(len(active)), k]
            up = top > best[active]
            moved = active[up]
            at[moved] = around[up, k[up]]
            best[moved] = top[up]
            active = moved
    ground = layers[-1][1]
    seen = np.zeros((q, n), bool)
    seen[np.arange(q), at] = True
    pool = np.full((q, wide), NONE, np.int64)
    score = np.full((q, wide), -np.inf)
    open_ = np.zeros((q, wide), bool)
    pool[:, 0], open_[:, 0] = at, True
    score[:, 0] = np.einsum("qd,qd->q", queries, x[at])
    active = np.arange(q)
    while len(active):
        s = np.where(open_[active], score[active], -np.inf)
        k = s.argmax(1)
        go = s[np.arange(len(active)), k] > -np.inf
        active, k = active[go], k[go]
        if not len(active):
            break
        open_[active, k] = False
        around = ground[pool[active, k]]
        new = (around >= 0) & ~seen[active[:, None], around]
        rows, cols = np.nonzero(new)
        seen[active[rows], around[rows, cols]] = True
        reach = np.full(around.shape, -np.inf)
        reach[rows, cols] = np.einsum("nd,nd->n", x[around[rows, cols]], queries[active[rows]])
        all_s = np.concatenate([score[active], reach], 1)
        keep = np.argpartition(-all_s, wide - 1, axis=1)[:, :wide]
        pool[active] = np.take_along_axis(np.concatenate([pool[active], around], 1), keep, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], new], 1), keep, 1)
        score[active] = np.take_along_axis(all_s, keep, 1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.where(np.take_along_axis(score, order, 1) > -np.inf, np.take_along_axis(pool, order, 1), NONE)


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, at least one not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, shard_rows: int = 8192, links: int = 16, wide: int = 64) -> DataFrame:
    """One row for each shard (INDEX_SCHEMA), kept in the shared folder.

    Of vectors that are equal, the ``k`` + 1 least ids are kept: no result of ``k`` can name
    another, since ties go to the smaller id. Vectors of different lengths are in different
    shards. A shard takes about ``shard_rows`` distinct vectors. ``k`` and ``links`` are kept with the index.
    Null, empty, zero and not finite vectors and rows with no id are left out, repeated rows count
    once, an id with several vectors is a node of each; other columns play no part. An empty table gives an index without rows.
    """
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    first = stored(rows.distinct().withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1), "vectors")
    nodes = first.filter("r = 1").count()
    shards = max(1, math.ceil(nodes / shard_rows))
    dealt = first.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).alias("shard"))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        ids = table.column("id").to_numpy()
        x = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        fresh = np.concatenate([[True], (x[1:] != x[:-1]).any(1)])
        starts = np.flatnonzero(fresh)
        nodes, ends = x[starts], np.append(starts[1:], len(ids))
        shuffled = np.random.default_rng(1).permutation(len(nodes))  # the order in which nodes come
        ids = np.concatenate([ids[starts[i] : ends[i]] for i in shuffled])
        ends = np.cumsum((ends - starts)[shuffled])
        nodes = nodes[shuffled]
        layers = build_graph(nodes, links=links, wide=wide)
        flat = lambda parts, kind: np.concatenate([p.ravel() for p in parts]).astype(kind).tobytes()
        sizes = np.array([len(m) for m, _ in layers], np.int32)
        row = {"shard": key[0].as_py(), "dim": dim, "k": k, "links": links, "n_nodes": len(nodes), "vectors": nodes.tobytes(), "id_ends": ends.astype(np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes(), "layers": len(layers), "layer_nodes": flat([sizes, *(m for m, _ in layers)], np.int32), "neighbours": flat([m for _, m in layers], np.int32)}
        kinds = {"shard": pa.int64(), "dim": pa.int32(), "k": pa.int32(), "links": pa.int32(), "n_nodes": pa.int32(), "layers": pa.int32()}
        return pa.table({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in row.items()})

    return stored(dealt.groupBy("shard", "dim").applyInArrow(build, INDEX_SCHEMA), "graphs")


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """An index row's vectors, ids, ends of each node's ids, and layers."""
    x = np.frombuffer(row["vectors"], np.float64).reshape(row["n_nodes"], row["dim"])
    numbers = np.frombuffer(row["layer_nodes"], np.int32)
    near = np.frombuffer(row["neighbours"], np.int32).reshape(-1, 2 * row["links"])
    layers, at = [], 0
    for size in numbers[: row["layers"]]:
        layers.append((numbers[row["layers"] + at : row["layers"] + at + size], near[at : at + size]))
        at += size
    return x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["id_ends"], np.int64), layers


def search_index(index: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, wide: int = 96, block_rows: int = 1 << 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, ties to the smaller id; its own id is no candidate.

    Queries go in blocks of about ``block_rows`` to every shard of their length. A query whose
    vector is null, zero or not finite has no rows. Score: the inner product in double precision.
    A query id that repeats with different vectors is ranked over all of them; repeated rows count once, other
    columns play no part. No queries, or an index without rows, give no rows. ``k`` may not be more than the index was
    built for. The graphs are walked in single precision; what is found is scored in double.
    """
    most = index.agg(F.min("k")).first()[0]
    if most is not None and k > most:
        raise ValueError(f"the index keeps the ids for {most} neighbours, not {k}")
    asked = queries.filter(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("query_id"), F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0)).alias("q")).distinct()
    asked = asked.withColumn("dim", F.size("q"))
    blocks = max(1, math.ceil(asked.count() / block_rows))
    shards = index.select(F.col("shard").alias("shard"), F.col("dim").alias("dim")).distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    sent = asked.select("query_id", "q", "dim", block).join(shards, "dim").select("shard", "dim", "block", "query_id", "q")
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint"))

    def answer(graph: pa.Table, ask: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not graph.num_rows or not ask.num_rows:
            return pa.table(empty)
        x, ids, ends, layers = unpack(graph.to_pylist()[0])
        q = ask.column("q").combine_chunks().flatten().to_numpy().reshape(-1, x.shape[1])
        names = ask.column("query_id").to_numpy()
        x32, q32 = x.astype(np.float32), q.astype(np.float32)
        out = []
        for a in range(0, len(q), 256):
            found = search_graph(x32, layers, q32[a : a + 256], max(wide, k + 1))
            rows, cols = np.nonzero(found >= 0)
            node = found[rows, cols]
            first = np.where(node > 0, ends[node - 1], 0)
            times = ends[node] - first
            rows, node = np.repeat(rows, times), np.repeat(node, times)
            own = ids[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
            score = (x[node] * q[a + rows]).sum(1)
            other = own != names[a + rows]
            rows, own, score = rows[other], own[other], score[other]
            order = np.lexsort((own, -score, rows))
            rows, own, score = rows[order], own[order], score[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            best = place < k
            out.append((names[a + rows[best]], own[best], score[best]))
        return pa.table({c: pa.array(np.concatenate(v)) for c, v in zip(empty, zip(*out, strict=True), strict=True)})

    keys = ["shard", "dim", "block"]
    found = graphs.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(answer, "query_id bigint, vec_id bigint, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
