"""Token counts through a cache keyed by content and tokenizer digests.

The cache holds (content digest, tokenizer digest) with the counts. A run encodes only the
distinct contents that the cache lacks for this tokenizer, appends them, and joins all rows
to the cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bytes_digest, content_digest, exists, file_bytes, fresh_path, small_batches, stored

CACHE_SCHEMA = "digest string, tokenizer string, n_bytes bigint, n_tokens bigint"
_LOADED: dict[str, object] = {}


def _counter(kind: str, data: bytes, digest: str):
    """Function from a list of texts to token counts; one per worker and tokenizer."""
    if digest not in _LOADED:
        if kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            _LOADED[digest] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(data.decode())
            tok.no_truncation()
            tok.no_padding()
            _LOADED[digest] = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[digest]


def _slices(texts: list[str], most: int = 1 << 20) -> Iterator[list[str]]:
    """Runs of texts of about ``most`` characters, so that the ids of a whole batch are never held at once."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def count_tokens(df: DataFrame, tokenizer_path: str, *, text_col: str = "text", normalise=None, cache: str | None = None) -> DataFrame:
    """Adds ``digest``, ``n_bytes`` (UTF-8) and ``n_tokens`` to each row.

    ``tokenizer_path``: a sentencepiece ``.model`` or a tokenizers ``.json``; its SHA-256 is
    the tokenizer's version. ``normalise``: function from the text column to the content that
    is addressed and encoded (default: null to the empty text, nothing else). ``cache``: path
    of the cache, created if missing; None: a new one in the shared folder. Repeated rows and
    texts are encoded once; columns of those three names are replaced; an empty table gives
    an empty table. A text is encoded whole, whatever its length.
    """
    spark = df.sparkSession
    data = file_bytes(tokenizer_path)
    version = bytes_digest(data)
    kind = "sentencepiece" if tokenizer_path.endswith(".model") else "tokenizers"
    sent = spark.sparkContext.broadcast(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(kind, sent.value, version)
        for b in batches:
            texts = b.column("content").to_pylist()
            counts = [n for part in _slices(texts) for n in count(part)]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array([version] * len(texts), pa.string()), b.column("n_bytes"), pa.array(counts, pa.int64())], names=["digest", "tokenizer", "n_bytes", "n_tokens"])

    content: Column = (normalise or (lambda c: F.coalesce(c, F.lit(""))))(F.col(text_col))
    base = df.drop("digest", "n_bytes", "n_tokens")
    addressed = base.select(content_digest(content).alias("digest"), content.alias("content"))
    cache = cache or fresh_path(spark, "token-cache")
    old = exists(spark, cache)
    if old:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).select("digest")
        addressed = addressed.join(known.distinct(), "digest", "left_anti")
    misses = addressed.groupBy("digest").agg(F.first("content").alias("content"))
    misses = misses.select("digest", "content", F.octet_length("content").cast("long").alias("n_bytes"))
    small_batches(spark)
    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").option("compression", "zstd").parquet(cache)

    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version).select("digest", "n_bytes", "n_tokens")
    if old:
        # two runs at once may have added the same content; stored, so that the join below can split a hot digest
        counts = stored(counts.dropDuplicates(["digest"]), "counts")
    return base.withColumn("digest", content_digest(content)).join(counts, "digest", "left")
