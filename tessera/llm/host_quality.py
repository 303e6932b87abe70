"""Quality rules for texts, and verdicts on the hosts that they come from.

A text fails the base rules by itself. For each host the failures are counted and the rate
is drawn towards the rate of all hosts by a beta prior that is fitted to them, so that a host
with few documents isn't judged by chance. Documents of a host whose shrunk rate is too
high go as well. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

_BLANK = r"\x20\x09-\x0D"
#: Names of the columns that ``text_features`` adds.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def text_features(df: DataFrame, *, text_col: str = "text", window: int = 8, least_words: int = 20, most_repeat_pct: int = 30) -> DataFrame:
    """Adds the base features (bigint) and ``base_failed`` (boolean); a null text has no words. Columns of those names are replaced.

    Words are runs of other than ASCII white space. ``n_repeat_words``: words inside windows of
    ``window`` words that the text holds twice or more. Windows are compared by 64-bit digests
    of their words within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = [c for c in df.columns if c not in FEATURES]
    words = F.filter(F.split(text, f"[{_BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    # each value that is used more than once is bound, so that it is worked out once
    digests = lambda w: F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(window)])))
    repeats = lambda h: F.when(h.isNull() | (F.size(F.array_distinct(h)) == F.size(h)), F.lit(0)).otherwise(_covered(h, window))
    of_words = _bound(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("chars"), _bound(digests(w), repeats).alias("repeats")))
    of_lines = _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    got = df.select(*[F.col(f"`{c}`") for c in kept], of_words.alias("_w"), symbols.cast("bigint").alias("n_symbols"), of_lines.cast("bigint").alias("n_dup_lines"))
    counts = {"n_words": "_w.n", "word_chars": "_w.chars", "n_repeat_words": "_w.repeats"}
    features = got.withColumns({k: F.col(v).cast("bigint") for k, v in counts.items()}).drop("_w")
    return features.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat_pct * F.col("n_words")))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(digests: Column, window: int) -> Column:
    """How many words lie in windows whose digest comes twice or more."""
    by_digest = F.sort_array(F.transform(digests, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
    places = _bound(by_digest, lambda s: F.sort_array(F.transform(twins(s), lambda x: x["i"])))
    return _bound(places, lambda p: F.aggregate(F.transform(p, lambda a, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - a, F.lit(window)))), F.lit(0), lambda acc, x: acc + x))


def shrink(hosts: DataFrame) -> DataFrame:
    """Adds ``rate``, ``shrunk_rate`` and ``bar`` to (host, n_docs, n_failed).

    The prior beta(a, b) is fitted by moments: its mean is the rate of all documents, its
    strength comes from the spread of the hosts' rates beyond what chance gives. If there is no
    such spread the prior is as strong as all documents together. The ``bar`` is halfway from the prior's mean
    to 1: a host over it is nearer to failing always than to failing as all do. One row of sums goes to the driver.
    """
    n, x = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    got = hosts.agg(F.sum(n).alias("n"), F.sum(x).alias("x"), F.count("*").alias("hosts"), F.sum(x * x / n).alias("xx"), F.sum(n * n).alias("nn")).first()
    mean, strength = 0.0, 1.0
    if got["n"]:
        mean, strength = got["x"] / got["n"], got["n"]
        if got["hosts"] > 1 and 0 < mean < 1:
            # sum n (p - mean)^2 expects mean (1 - mean) (hosts - 1) by chance, and spread * (n - nn / n) more
            spread = (got["xx"] - got["n"] * mean * mean - mean * (1 - mean) * (got["hosts"] - 1)) / (got["n"] - got["nn"] / got["n"])
            if spread > 0:
                strength = min(got["n"], max(1.0, mean * (1 - mean) / spread - 1))
    return hosts.select("*", (x / n).alias("rate"), ((x + F.lit(mean * strength)) / (n + F.lit(strength))).alias("shrunk_rate"), F.lit((1 + mean) / 2).alias("bar"))


def host_rates(features: DataFrame, *, host_col: str = "source", failed_col: str = "base_failed") -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate, bar) of each host, kept in the shared folder; rows with no host are left out."""
    counted = features.filter(F.col(host_col).isNotNull()).groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed_col).cast("bigint")).alias("n_failed"))
    return shrink(stored(counted, "hosts"))


def judge(docs: DataFrame, *, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", host_col: str = "source", most_rate: float | None = None) -> DataFrame:
    """One row for each document: ``id_cols``, the features, ``shrunk_rate`` of its host (null without one) and ``kept``.

    ``kept`` is false if the text fails, or its host's shrunk failure rate is over ``most_rate`` (default: the bar of ``shrink``).
    Documents with no host are judged by their text alone. Rows repeat as in the input; an
    empty table gives an empty table. Only numbers and hosts are kept and moved, no texts.
    """
    seen = docs.select(*[F.col(f"`{c}`") for c in id_cols], F.col(f"`{host_col}`").alias("_host"), F.col(f"`{text_col}`").alias("_text"))
    features = stored(text_features(seen, text_col="_text").drop("_text"), "quality")
    rates = host_rates(features, host_col="_host").select(F.col("host").alias("_host"), "shrunk_rate", "bar")
    bad = F.coalesce(F.col("shrunk_rate") > _bar(most_rate), F.lit(False))
    return features.join(rates, "_host", "left").withColumn("kept", ~F.col("base_failed") & ~bad).drop("_host", "bar")


def _bar(most_rate: float | None) -> Column:
    return F.col("bar") if most_rate is None else F.lit(most_rate)


def keep_good(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", most_rate: float | None = None) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns, whatever their names.

    Texts don't move: the rejected hosts are a small table, which Spark broadcasts if its size
    allows, and the base rules are worked out again beside the text. Null texts fail, documents with no
    host are judged by their text alone, repeated rows repeat, an empty table gives an empty table.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    seen = docs.select(row, F.col(f"`{host_col}`").alias("host"), F.col(f"`{text_col}`").alias("_text"))
    rates = host_rates(text_features(seen.select("host", "_text"), text_col="_text"), host_col="host")
    rejected = stored(rates.filter(F.col("shrunk_rate") > _bar(most_rate)).select("host"), "rejected-hosts")
    good = text_features(seen, text_col="_text").filter(~F.col("base_failed")).select("_row", "host")
    return good.join(rejected, "host", "left_anti").select("_row.*")
