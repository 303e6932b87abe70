"""Language identification: multinomial logistic regression on TF-IDF of character n-grams.

N-grams of the lower-cased text are hashed to a fixed number of buckets. Document
frequencies come from all training documents; the weights are fitted on a bounded sample of
them by follow-the-regularised-leader with elastic-net penalties, which leaves most weights
zero, and the scores are calibrated by a temperature on a part of the sample kept for that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import add_in_arrow, small_batches, stored

UNKNOWN = "und"


@dataclass
class Model:
    """``weights``: (buckets, languages), zero for most; ``idf``: (buckets)."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0
    orders: tuple[int, ...] = (1, 2, 3)
    buckets: int = field(init=False)

    def __post_init__(self):
        self.buckets = len(self.idf)


def grams(text: str, buckets: int, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of the whole lower-cased text, ascending, and their counts. White space runs count as one blank."""
    padded = " " + " ".join(text.lower().split()) + " "
    code = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(buckets, np.int64)
    bits = np.uint64(64 - int(math.log2(buckets)))
    for n in orders:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for i in range(n):
            h = (h ^ code[i : len(code) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        counts += np.bincount((h * np.uint64(0xBF58476D1CE4E5B9) >> bits).astype(np.int64), minlength=buckets)
    found = np.flatnonzero(counts)
    return found.astype(np.int32), counts[found].astype(np.int32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _weighed(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear TF-IDF of unit length."""
    x = (1 + np.log(counts)) * idf[found]
    return x / max(1e-12, math.sqrt(float(x @ x)))


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, *, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.5, calibration: float = 0.2, seed: int = 5) -> Model:
    """Fits on (buckets, counts, language). FTRL-proximal with L1 and L2, a rate for each weight."""
    languages = sorted({r[2] for r in rows})
    place = {v: i for i, v in enumerate(languages)}
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: int(len(rows) * calibration)] if len(rows) >= 10 else order
    train = order[int(len(rows) * calibration) :] if len(rows) >= 10 else order
    features = [(r[0], _weighed(r[0], r[1], idf)) for r in rows]
    target = np.array([place[r[2]] for r in rows], int)
    size = (len(idf) + 1, len(languages))
    z, n = np.zeros(size), np.zeros(size)

    def weights(at) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for i in rng.permutation(train):
            at, x = np.append(features[i][0], len(idf)), np.append(features[i][1], 1.0)
            w = weights(at)
            p = _probabilities(x @ w)
            p[target[i]] -= 1
            g = x[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    model = Model(languages, w[:-1].astype(np.float32), w[-1], idf)
    logits = np.array([x @ w[:-1][at] + w[-1] for at, x in (features[i] for i in held)]).reshape(len(held), len(languages))

    def loss(t: float) -> float:
        p = _probabilities(logits / t)
        return -float(np.log(np.maximum(p[np.arange(len(held)), target[held]], 1e-12)).mean())

    if len(held):
        low, high = math.log(0.02), math.log(20.0)
        for _ in range(60):  # golden section on the log of the temperature
            a, b = high - (high - low) * 0.618, low + (high - low) * 0.618
            low, high = (low, b) if loss(math.exp(a)) < loss(math.exp(b)) else (a, high)
        model.temperature = math.exp((low + high) / 2)
    return model


def predict_text(model: Model, text: str | None) -> tuple[str, float]:
    if text is None or not model.languages or not has_letter(text):
        return UNKNOWN, 0.0
    at, counts = grams(text, model.buckets, model.orders)
    p = _probabilities((_weighed(at, counts, model.idf) @ model.weights[at] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def held_out(id_col: Column) -> Column:
    """CRC-32 of the id's text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", rows_per_language: int = 1500, most_languages: int = 256, buckets: int = 1 << 15, orders: tuple[int, ...] = (1, 2, 3)) -> Model:
    """Fits a model on the documents that aren't held out and have an id, a text with letters and a label.

    Document frequencies are of all of these. The weights are fitted on up to
    ``rows_per_language`` documents of each language, those whose ids have the least digests:
    that is the documented bound of the sample. A repeated id counts once there: of its texts the one with the
    least label and digest. More than ``most_languages`` labels are an error, so that the weights and what goes to the
    driver are bounded: one count for each bucket and the sparse counts of the sample. With no such documents
    the model knows no language. Texts are read whole; other columns play no part.
    """
    small_batches(docs.sparkSession)
    pool = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{label_col}`").cast("string").alias("label")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(buckets + 1, np.int64), 0
        for b in batches:
            for cell in b.column("text"):
                df[grams(cell.as_py(), buckets, orders)[0]] += 1
                n += 1
        df[buckets] = n
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(df[found], pa.int64())], names=["bucket", "n"])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [grams(t, buckets, orders) if has_letter(t) else (None, None) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("digest"), pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32()))], names=["id", "label", "digest", "found", "counts"])

    totals = {r["bucket"]: r["n"] for r in pool.select("text").mapInArrow(frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    n = totals.pop(buckets, 0)
    idf = np.log((1 + n) / (1 + np.array([totals.get(i, 0) for i in range(buckets)]))) + 1
    first = W.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = pool.select("id", "label").distinct().withColumn("r", F.row_number().over(first)).filter(F.col("r") <= rows_per_language).select("id", "label")
    chosen = stored(chosen, "language-sample")
    if chosen.select("label").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    # its size is bounded by rows_per_language times most_languages
    sample = pool.join(F.broadcast(chosen), ["id", "label"], "left_semi").withColumn("digest", F.xxhash64("text"))
    sample = sample.mapInArrow(counts, f"id {dict(docs.dtypes)[id_col]}, label string, digest bigint, found array<int>, counts array<int>").filter(F.col("found").isNotNull())
    one = sample.groupBy("id").agg(F.min_by(F.struct("label", "found", "counts"), F.struct("label", "digest")).alias("s"))
    rows = one.orderBy("id").select("s.found", "s.counts", "s.label").toArrow()
    read = zip(rows.column("found"), rows.column("counts"), rows.column("label").to_pylist(), strict=True)
    return fit([(np.asarray(a.values), np.asarray(b.values), c) for a, b, c in read], idf)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1) to each row; ``und`` with score 0 if the text is null or has no letter, or nothing was learned.

    Other columns pass, those of the two names (``pred_col`` and ``score_col`` choose others) are replaced. The text is read whole,
    repeated rows repeat. An empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        got = [predict_text(sent.value, cell.as_py()) for cell in texts]
        return [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]

    return add_in_arrow(docs, text_col, {pred_col: T.StringType(), score_col: T.DoubleType()}, work)
