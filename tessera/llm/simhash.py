"""Near-duplicates by SimHash: candidates from the pigeonring, then the Hamming distance.

The 64 bits are cut into ``segments`` equal segments on a ring. If two fingerprints differ
in at most t bits, some segment starts a chain around the ring of which every prefix of n
segments has at most n*t/segments differing bits. The first few prefixes allow none, so the
equal bits at a chain's start are the join key; the further budgets prune the candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import connected_components
from tessera.llm.common import add_in_arrow, free_name, stored

#: For each byte a word of eight byte counters, one for each of its bits.
_LANES = np.array([sum((b >> i & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Signed 64-bit SimHash of the UTF-8 text: A-Z lower-cased, split at ASCII white space, shingles of ``words`` words, repeats counted."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()
    if not w:
        return 0
    n = max(1, len(w) - words + 1)
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter(map(partial(xxh64_intdigest, seed=seed), shingles), np.uint64, n)
    # counters of a byte hold 255 at most
    counts = sum((np.add.reduce(_LANES[h[i : i + 255].view(np.uint8).reshape(-1, 8)], axis=0).view(np.uint8).astype(np.int64) for i in range(0, n, 255)), np.zeros(64, np.int64))
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, *, text_col: str = "text", out: str = "fingerprint", words: int = 3, seed: int = 42, keep_text: bool = False) -> DataFrame:
    """Adds ``out`` (bigint) to each row; a null or wordless text has fingerprint 0. Other columns pass, the text with ``keep_text``; one of that name is replaced."""
    work = lambda texts: [pa.array([fingerprint((cell.as_py() or "").encode(), words, seed) for cell in texts], pa.int64())]
    return add_in_arrow(df, text_col, {out: T.LongType()}, work, drop=() if keep_text else (text_col,))


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by)) if by else x


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _chain_budgets(segments: int, tau: int) -> list[tuple[int, int]]:
    """(bits of the prefix, most differences): for each budget the longest prefix that it holds for."""
    width = 64 // segments
    longest: dict[int, int] = {}
    for n in range(1, segments + 1):
        longest[n * tau // segments] = n * width
    return [(bits, most) for most, bits in sorted(longest.items())]


def links(prints: DataFrame, *, tau: int = 2, segments: int = 16, crowd: int = 64) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that join all pairs at ``tau`` bits or fewer.

    In buckets of up to ``crowd`` fingerprints each pair is checked, along the chain and then
    in full. A larger bucket isn't paired: its members go to every point that half the
    distance can reach outside the shared bits, and those that meet at a point are
    linked to one of them. Two are within ``tau`` exactly if they meet so, hence no link's
    component is lost and rows stay in proportion to members however full a bucket is.
    """
    if 64 % segments or not 0 < tau < segments:
        raise ValueError("segments must divide 64 and be more than tau")
    width = 64 // segments
    budgets = _chain_budgets(segments, tau)
    shared = budgets[0][0]
    starts = [F.struct(F.lit(i).alias("start"), F.shiftrightunsigned(_rotated(F.col("fp"), i * width), 64 - shared).alias("key"), _rotated(F.col("fp"), i * width).alias("turned")) for i in range(segments)]
    index = prints.select("fp", F.inline(F.array(*starts)))
    full = index.groupBy("start", "key").agg(F.count("*").alias("members")).filter("members > 1")
    met = stored(index.join(full, ["start", "key"]), "ring")

    few = met.filter(F.col("members") <= crowd)
    a = few.select("start", "key", F.col("fp").alias("a"), F.col("turned").alias("ta"))
    b = few.select("start", "key", F.col("fp").alias("b"), F.col("turned").alias("tb"))
    differ = F.col("ta").bitwiseXOR(F.col("tb"))
    chain = F.lit(True)
    for bits, most in budgets[1:-1]:
        chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(_signed(((1 << bits) - 1) << (64 - bits))).cast("bigint"))) <= most)
    paired = a.join(b, ["start", "key"]).filter("a < b").filter(chain).filter(F.bit_count(differ) <= tau).select("a", "b")

    outside = range(64 - shared)
    near, far = tau // 2, tau - tau // 2
    masks = [(0, 0)]
    for r in range(1, far + 1):
        masks += [(sum(1 << i for i in c), r) for c in combinations(outside, r)]
    steps = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(r).alias("steps")) for m, r in masks])
    crowded = met.filter(F.col("members") > crowd).select("start", "key", "fp", "turned", F.inline(steps))
    points = crowded.select("start", "fp", F.col("turned").bitwiseXOR(F.col("mask")).alias("point"), "steps")
    hubs = points.filter(F.col("steps") <= near).groupBy("start", "point").agg(F.min("fp").alias("b"))
    meeting = points.join(hubs, ["start", "point"]).filter("fp <> b").select(F.col("fp").alias("a"), "b")
    return paired.unionByName(meeting).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, tau: int = 2, segments: int = 16, seed: int = 42) -> DataFrame:
    """One row for each row of ``docs``: the id, ``fingerprint`` (bigint), ``component_id`` and ``root``, the component's least fingerprint.

    Texts are linked if their fingerprints differ in ``tau`` bits or fewer; a component is all
    that links reach and is named by its least id. Null and wordless texts have fingerprint 0
    and are linked like any other. Equal texts and repeated rows share a fingerprint and so
    a component; ids that are null are never a component's name unless it has no other.
    An empty table gives an empty table; texts are read whole, however long. No more than ids and fingerprints is kept or moved.
    """
    marked = stored(fingerprints(docs.select(id_col, text_col), text_col=text_col, words=words, seed=seed).select(F.col(id_col), F.col("fingerprint").alias("fp")), "fingerprints")
    groups = marked.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    roots = connected_components(links(marked.select("fp").distinct(), tau=tau, segments=segments))
    rooted = groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id", "root")
    return marked.join(named, "fp").select(id_col, F.col("fp").alias("fingerprint"), "component_id", "root")


def fingerprint_hex(fp: Column) -> Column:
    """16 lowercase hex digits of the bigint's bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def choose_rows(docs: DataFrame, found: DataFrame, mark: Callable[[DataFrame, str], DataFrame], *, id_col: str) -> DataFrame:
    """One row of each component of ``found`` (id, fingerprint, component_id, root), one for each row of ``docs``; ``mark`` adds a row's fingerprint again, under a name that it is given.

    Ids that come once choose their rows by id; so do ids whose rows all have one fingerprint, of which one row stays.
    Rows of other ids, and of none, are marked and chosen by id and fingerprint, so that of two components of the same least id each
    keeps a row. All columns of ``docs`` pass, whatever their names; texts of ids that come once aren't shuffled unless the join by id is.
    """
    found = found.toDF("id", "fp", "component_id", "root")
    given, row_id = [F.col(f"`{c}`") for c in docs.columns], F.col(f"`{id_col}`")
    fp, key, key_fp, root = (free_name(docs, n) for n in ("fp", "key", "key_fp", "root"))
    least = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("id").alias("id"), F.min("fp").alias("fp"))
    again = found.filter(F.col("id").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).filter("n > 1")
    again = stored(again.select(F.col("id").alias(key), (F.col("low") < F.col("high")).alias("several")), "repeated-ids")
    chosen = stored(least.select(F.col("id").alias(key), F.col("fp").alias(key_fp), F.col("root").alias(root)), "chosen")
    of_id = lambda df, ids, how: df.join(ids.select(key), F.col(f"`{id_col}`") == F.col(key), how)
    once = chosen.join(again, key, "left_anti")
    same = chosen.join(again.filter("NOT several"), key, "left_semi")
    parts = [of_id(docs, once, "left_semi"), of_id(docs, same, "left_semi").dropDuplicates([id_col])]
    unsure = of_id(docs, again.filter("several"), "left_semi").select(*given).unionByName(docs.filter(row_id.isNull()))
    marked = mark(unsure, fp)
    parts.append(marked.join(chosen, (F.col(fp) == F.col(key_fp)) & row_id.eqNullSafe(F.col(key))).dropDuplicates([root]))
    return parts[0].select(*given).unionByName(parts[1].select(*given)).unionByName(parts[2].select(*given))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each component of ``near_duplicates``, with all its columns: the one with the least id.

    Of rows of the component that repeat that id one stays; another component of the same least
    id keeps a row of its own. Rows with no id stay only where their whole component has none, one of each such component. An empty table gives an empty table.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    how = {k: v for k, v in options.items() if k in ("words", "seed")}
    return choose_rows(docs, found, lambda d, out: fingerprints(d, text_col=text_col, out=out, keep_text=True, **how), id_col=id_col)
