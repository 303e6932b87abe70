"""Placement of records on shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, a permutation
from two digests of its name. Shards take turns; at its turn a shard claims its next
preferred slot that is free, until the table is full. A record's slot is its key's digest
modulo the table's size, so placement is one lookup, shares differ by a slot at most, and
few slots change hands when a shard comes or goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prime; the table's size bounds what is broadcast, whatever the data's size.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """For each slot the index of the shard that claimed it. ``shards``: distinct names, at most ``size``; order doesn't matter to the claims but for turns."""
    if not _is_prime(size):
        raise ValueError("the table's size must be prime")
    if not 0 < len(shards) <= size or len({*shards}) < len(shards):
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    offsets = [_number(s, "offset") % size for s in shards]
    skips = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table = np.full(size, -1, np.int32)
    at = offsets[:]
    left = size
    while left:
        for i in range(len(shards)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skips[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def key_slot(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of the MD5 of its text, modulo the size; a null key counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size).cast("bigint"))


def place(df: DataFrame, key_col: str, shards: list[str], *, size: int = TABLE_SIZE) -> DataFrame:
    """Adds ``slot`` (bigint) and ``shard`` (string) to each row; columns of those names are replaced.

    Equal keys go to the same shard, null and empty ones too. The table has ``size`` rows and
    is broadcast; rows stay in their partitions. An empty table gives an empty table.
    """
    claimed = lookup_table(shards, size)
    spark = df.sparkSession
    schema = T.StructType([T.StructField("slot", T.LongType(), False), T.StructField("shard", T.StringType(), False)])
    lookup = spark.createDataFrame([(i, shards[s]) for i, s in enumerate(claimed.tolist())], schema).coalesce(1)
    # the key may have one of the two names
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*kept, key_slot(F.col(f"`{key_col}`"), size).alias("slot")).join(F.broadcast(lookup), "slot", "left").select(*kept, "slot", "shard")


def write_shards(placed: DataFrame, path: str, *, files_per_shard: int = 1) -> None:
    """Writes each shard's rows to its own folder. A shard that is large gets more files: rows go to them by turns, not by key."""
    salted = placed.withColumn("_file", F.floor(F.rand(7) * files_per_shard).cast("int")) if files_per_shard > 1 else placed.withColumn("_file", F.lit(0))
    salted.repartition("shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
