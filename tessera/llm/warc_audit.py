"""Fixity audit of web archive replicas by Merkle trees.

The leaves of a file's tree are its records' digests by offset; each level above covers
ordered, aligned ranges of offsets, sixteen times as long as those below. Replicas are
compared at their roots, and only below nodes that differ does the comparison go on, down to
the records that are damaged, missing, too many or moved. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored

#: Bytes that a lowest range covers, ranges under one node, and levels of ranges: files of up to 64 KiB * 16**4 = 4 GiB have one root.
RANGE_BYTES, FANOUT, LEVELS = 65_536, 16, 5


def record_bytes(record_id: Column, uri: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as binary: head, blank line, payload, two line ends. Nulls count as empty."""
    body = F.coalesce(payload, F.lit("")).cast("binary")
    size = F.octet_length(body).cast("string")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), F.coalesce(record_id, F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archive(pages: DataFrame, *, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", per_file: int = 512, most: int = 8192) -> DataFrame:
    """Lays pages out as WARC files: (warc_file, offset, length, record_id, digest), a row for each record.

    A file holds ``per_file`` consecutive ids, by id and then digest, gapless from offset 0;
    repeated rows are records of their own, laid one after the other. A page with no id goes to one of 4096 further
    files, numbered from -1 down, by its digest. A file that would hold more than ``most`` different records (an id of
    many contents) is split by digest; the further parts' numbers are 2**40 apart, which takes ids up to 2**49. Null addresses and payloads
    count as empty, payloads are read whole and don't leave their partition, other columns play no part. An empty table gives an empty table.
    """
    record_id = F.concat(F.lit("urn:page:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("none")))
    raw = pages.select(F.col(f"`{id_col}`").alias("_id"), record_id.alias("record_id"), record_bytes(record_id, F.col(f"`{uri_col}`"), F.col(f"`{payload_col}`")).alias("_bytes"))
    laid = raw.select("_id", "record_id", F.octet_length("_bytes").cast("bigint").alias("length"), F.sha2("_bytes", 256).alias("digest"))
    once = laid.groupBy("_id", "record_id", "length", "digest").agg(F.count("*").alias("times"))
    salt = F.crc32(F.col("digest").cast("binary"))
    once = stored(once.withColumn("file", F.coalesce(F.floor(F.col("_id") / F.lit(per_file)).cast("bigint"), -1 - F.pmod(salt, F.lit(4096)))), "records")
    crowded = once.groupBy("file").agg(F.ceil(F.count("*") / F.lit(most)).alias("parts")).filter("parts > 1")
    part = F.pmod(F.floor(salt / F.lit(4096)), F.coalesce("parts", F.lit(1).cast("bigint"))) * F.lit(1 << 40)
    numbered = once.join(crowded, "file", "left").withColumn("warc_file", F.when(F.col("file") < 0, F.col("file") - part).otherwise(F.col("file") + part))
    before = W.partitionBy("warc_file").orderBy("_id", "digest", "record_id").rowsBetween(W.unboundedPreceding, -1)
    placed = numbered.withColumn("start", F.coalesce(F.sum(F.col("times") * F.col("length")).over(before), F.lit(0)).cast("bigint"))
    each = placed.select("warc_file", "start", "length", "record_id", "digest", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)).alias("i"))
    return each.select("warc_file", (F.col("start") + F.col("i") * F.col("length")).alias("offset"), "length", "record_id", "digest")


def _node(offset: Column, level: int) -> Column:
    return F.floor(offset / F.lit(RANGE_BYTES * FANOUT ** (level - 1))).cast("bigint")


def merkle_tree(records: DataFrame) -> DataFrame:
    """(warc_file, level, node, digest) of the ranges of all files, from the lowest (1) to the root (``LEVELS``), kept in the shared folder.

    A range's digest covers the start and digest of each thing in it, in order; records that
    repeat at an offset are all counted. Files beyond the root's range have several roots.
    """
    below = records.select("warc_file", "offset", F.concat_ws("/", F.col("offset").cast("string"), F.col("length").cast("string"), "digest").alias("mark"))
    levels = []
    for level in range(1, LEVELS + 1):
        nodes = below.groupBy("warc_file", _node(F.col("offset"), level).alias("node")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "mark"))), lambda x: x["mark"]), ",").cast("binary"), 256).alias("digest"))
        levels.append(nodes.select("warc_file", F.lit(level).alias("level"), "node", "digest"))
        start = F.col("node") * F.lit(RANGE_BYTES * FANOUT ** (level - 1)).cast("bigint")
        below = nodes.select("warc_file", start.alias("offset"), F.concat_ws("/", start.cast("string"), "digest").alias("mark"))
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return stored(tree, "merkle")


def audit(ours: DataFrame, theirs: DataFrame, *, moved: bool = False) -> DataFrame:
    """Records in which two replicas differ: (warc_file, offset, length, record_id, status, our_digest, their_digest).

    Both: tables as ``archive`` gives. Below ranges that differ, records of a file are matched by their name and bytes,
    wherever they lie, so that a lost record is one row though all that follow it moved up. ``status``: corrupt (of that
    name both have a record that the other has not), missing (only ours) or extra (only theirs); offset, length and
    record_id are ours where we have the record. With ``moved`` records that both have at other offsets are listed too, as moved.
    Records that repeat are compared by their numbers: those too few or too many are listed, the last ones first.
    Equal replicas, and empty ones, give no rows.
    """
    ours, theirs = stored(ours, "replica"), stored(theirs, "replica")
    mine, other = merkle_tree(ours), merkle_tree(theirs)
    suspect = None
    for level in range(LEVELS, 0, -1):
        a = mine.filter(F.col("level") == level).select("warc_file", "node", F.col("digest").alias("a"))
        b = other.filter(F.col("level") == level).select("warc_file", "node", F.col("digest").alias("b"))
        if suspect is not None:
            a, b = (x.withColumn("up", F.floor(F.col("node") / F.lit(FANOUT)).cast("bigint")).join(suspect, ["warc_file", "up"], "left_semi").drop("up") for x in (a, b))
        differ = a.join(b, ["warc_file", "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("warc_file", "node")
        suspect = stored(differ.withColumnRenamed("node", "up"), "suspect")
    what = ["warc_file", "record_id", "digest", "length"]

    def counted(side: DataFrame, name: str) -> DataFrame:
        near = side.withColumn("up", _node(F.col("offset"), 1)).join(suspect, ["warc_file", "up"], "left_semi")
        return near.groupBy(*what).agg(F.count("*").alias(f"n_{name}"), F.min("offset").alias(f"low_{name}"), F.max("offset").alias(f"high_{name}"))

    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    both = stored(counted(ours, "a").join(counted(theirs, "b"), what, "full").withColumn("more", zero("n_a") - zero("n_b")), "compared")

    def single(name: str, sign: int) -> DataFrame:
        """The records that one side has too many, numbered within their name."""
        too_many = both.filter(F.col("more") * sign > 0)
        rows = too_many.select(*what, f"high_{name}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("more") * sign - 1)).alias("i"))
        rows = rows.select("warc_file", "record_id", F.col("digest").alias(f"d_{name}"), F.col("length").alias(f"l_{name}"), (F.col(f"high_{name}") - F.col("i") * F.col("length")).alias(f"o_{name}"))
        return rows.withColumn("i", F.row_number().over(W.partitionBy("warc_file", "record_id").orderBy(f"o_{name}", f"d_{name}")))

    status = F.when(F.col("d_a").isNull(), "extra").when(F.col("d_b").isNull(), "missing").otherwise("corrupt")
    paired = single("a", 1).join(single("b", -1), ["warc_file", "record_id", "i"], "full")
    found = paired.select("warc_file", F.coalesce("o_a", "o_b").alias("offset"), F.coalesce("l_a", "l_b").alias("length"), "record_id", status.alias("status"), F.col("d_a").alias("our_digest"), F.col("d_b").alias("their_digest"))
    if not moved:
        return found
    elsewhere = both.filter((F.col("n_a") > 0) & (F.col("n_b") > 0) & ((F.col("low_a") != F.col("low_b")) | (F.col("more") == 0) & (F.col("high_a") != F.col("high_b"))))
    return found.unionByName(elsewhere.select("warc_file", F.col("low_a").alias("offset"), "length", "record_id", F.lit("moved").alias("status"), F.col("digest").alias("our_digest"), F.col("digest").alias("their_digest")))
