"""Secret scanning over every version of every file, with a ledger of what has been scanned.

A text is known by its content address (SHA-256). The ledger holds one row for each
(blob, rule, rule version) that was ever scanned, with the spans found, none included. A run
scans only the pairs the ledger lacks, appends them, and joins findings back to all paths
that hold the blob. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import content_digest, exists, free_name, fresh_path, stored

LEDGER_SCHEMA = "blob string, kind string, rule_version string, spans array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches of ``pattern`` (Java regular expression, leftmost, non-overlapping)
    count if group ``group`` has at least ``least`` characters. ``version`` is a digest of these three, so that a
    changed rule is a new one to the ledger; ``label`` goes into it too, for changes of other kinds."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    label: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256("\0".join((self.pattern, str(self.group), str(self.least), self.label)).encode()).hexdigest()[:16]


#: The access and hex patterns hold their least length: their greedy runs are the same matches as without it.
BASE_RULES = (
    Rule("assign", r"""(?i)(?=[pstaPSTA])(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def _matches(text: Column, rule: Rule) -> Column:
    """Array of (gap, length, counted): code points between the last match and this one, its length, whether it counts."""
    pattern = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, lambda x: F.char_length(x))
    zipped = F.arrays_zip(
        lengths(F.split(text, rule.pattern, -1)).alias("gap"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        lengths(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
    )
    # the gap after the last match has no match beside it
    found = F.filter(zipped, lambda m: m["size"].isNotNull())
    kept = F.transform(found, lambda m: F.struct(m["gap"].cast("long").alias("gap"), m["size"].cast("long").alias("size"), (m["value"] >= rule.least).alias("counts")))
    return F.when(text.rlike(rule.pattern), kept)


def _scan(blobs: DataFrame, rules: tuple[Rule, ...], wanted: Column | None) -> DataFrame:
    """``blobs`` (blob, text) to ledger rows; wanted: array of the kinds to scan in that blob, all if None.

    Texts end at the first projection: only lengths move on to the sums over the matches of a blob."""
    per_rule = []
    for r in rules:
        todo = F.lit(True) if wanted is None else F.array_contains(wanted, r.kind)
        per_rule.append(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version"), todo.alias("todo"), F.when(todo, _matches(F.col("text"), r)).alias("found")))
    rows = blobs.select("blob", F.inline(F.array(*per_rule))).filter("todo")
    hits = rows.select("blob", "kind", "rule_version", F.posexplode_outer("found").alias("at", "m"))
    order = W.partitionBy("blob", "kind", "rule_version").orderBy("at")
    ends = hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(order)).withColumn("start", F.col("end") - F.col("m.size"))
    return ends.groupBy("blob", "kind", "rule_version").agg(F.sort_array(F.collect_list(F.when(F.col("m.counts"), F.struct("start", "end")))).alias("spans"))


def read_ledger(spark, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows for these rules at their present versions; a pair appended twice counts once."""
    now = [(r.kind, r.version) for r in rules]
    rows = spark.read.schema(LEDGER_SCHEMA).parquet(ledger)
    current = F.lit(False)
    for kind, version in now:
        current = current | ((F.col("kind") == kind) & (F.col("rule_version") == version))
    return rows.filter(current).groupBy("blob", "kind", "rule_version").agg(F.first("spans").alias("spans"))


def scan_versions(versions: DataFrame, *, text_col: str = "text", ledger: str | None = None, rules: tuple[Rule, ...] = BASE_RULES, blob_col: str = "blob", findings_col: str = "findings") -> DataFrame:
    """Adds ``blob`` and ``findings`` to each row of ``versions`` (one row for each path and version).

    ``findings``: array of (start, end, kind), code points, end exclusive, by start and then
    the order of ``rules``; empty if there are none. ``ledger``: path of the ledger, created
    if missing, appended to; None: a new one in the shared folder. A null text counts as
    empty, texts of any length are read whole. Rows repeat as in the input; columns of the two names are replaced (``blob_col``
    and ``findings_col`` choose others), all others pass. An empty input scans nothing and returns no rows.

    Texts are shuffled once, by digest, after equal ones have been merged on the map side;
    on a later run only those with unseen pairs move at all.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = versions.drop(blob_col, findings_col)
    addressed = named.select(content_digest(text).alias("blob"), text.alias("text"))
    ledger = ledger or fresh_path(spark, "secret-ledger")
    if exists(spark, ledger):
        seen = read_ledger(spark, ledger, rules).select("blob", "kind", "rule_version")
        pairs = addressed.select("blob").distinct().select("blob", F.inline(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("rule_version")) for r in rules])))
        unseen = pairs.join(seen, ["blob", "kind", "rule_version"], "left_anti").groupBy("blob").agg(F.collect_set("kind").alias("wanted"))
        blobs = addressed.join(unseen, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
        fresh = _scan(blobs, rules, F.col("wanted"))
    else:
        fresh = _scan(addressed.groupBy("blob").agg(F.first("text").alias("text")), rules, None)
    fresh.write.mode("append").option("compression", "zstd").parquet(ledger)

    place = F.lit(0)
    for i, r in enumerate(rules):
        place = F.when(F.col("kind") == r.kind, F.lit(i)).otherwise(place)
    hits = read_ledger(spark, ledger, rules).filter(F.size("spans") > 0)
    key = free_name(named, "blob_key")
    # stored, so that the join below can split a hot blob
    by_blob = stored(
        hits.select("blob", "kind", place.alias("place"), F.explode("spans").alias("s"))
        .groupBy("blob")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("s.start").alias("start"), "place", F.col("s.end").alias("end"), "kind"))).alias("sorted"))
        .select(F.col("blob").alias(key), F.transform("sorted", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))).alias(findings_col)),
        "findings",
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    found, blob = F.col(f"`{findings_col}`"), F.col(f"`{blob_col}`")
    joined = named.withColumn(blob_col, content_digest(text)).join(by_blob, blob == F.col(key), "left").drop(key)
    return joined.withColumn(findings_col, F.coalesce(found, none))


#: Code points of a block that ``redact`` cuts texts into.
BLOCK = 1024


def redact(scanned: DataFrame, *, text_col: str = "text", findings_col: str = "findings", mark: str = "[SECRET]") -> DataFrame:
    """Replaces the found spans in the text by ``mark``; overlapping ones by a single mark. Null texts stay null.

    A text is cut once into blocks of ``BLOCK`` code points, and what lies between findings is taken from
    the blocks that it touches, so the work follows the text's length and the number of findings. Findings
    are in order of their starts, and those of one rule don't overlap: a finding is looked at
    beside all that end after it starts by the greatest end so far, which is kept for runs of findings.
    """
    text, found = F.col(f"`{text_col}`"), F.col(f"`{findings_col}`")
    ends = F.transform(found, lambda x: x["end"])
    # the greatest end before each finding: within runs of ``run`` findings, and over the runs before
    run = 64
    runs = lambda e: F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / run).cast("int")), lambda r: F.array_max(F.slice(e, r * run + 1, run)))
    tops = lambda m: F.transform(m, lambda _, r: F.when(r == 0, F.lit(0).cast("bigint")).otherwise(F.array_max(F.slice(m, 1, r))))
    before = lambda e, t, i: F.greatest(F.get(t, F.floor(i / run).cast("int")), F.when(i % run == 0, F.lit(0).cast("bigint")).otherwise(F.array_max(F.slice(e, i - i % run + 1, i % run))))
    clear = lambda e, t: F.transform(found, lambda x, i: F.struct(before(e, t, i).alias("at"), x["start"].alias("start")))

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Code points from start to end, from the blocks."""
        a, b = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
        inner = F.array_join(F.slice(blocks, a + 2, F.greatest(b - a - 1, F.lit(0))), "")
        last = F.coalesce(F.substring(F.get(blocks, b), F.lit(1), (end % BLOCK).cast("int")), F.lit(""))
        one = F.substring(F.get(blocks, a), (start % BLOCK + 1).cast("int"), (end - start).cast("int"))
        first = F.substring(F.get(blocks, a), (start % BLOCK + 1).cast("int"), F.lit(BLOCK))
        return F.when(end <= start, F.lit("")).when(a == b, one).otherwise(F.concat(first, inner, last))

    def masked(blocks: Column, gaps: Column) -> Column:
        kept = F.filter(gaps, lambda x: x["start"] >= x["at"])
        return F.concat(F.array_join(F.transform(kept, lambda x: F.concat(cut(blocks, x["at"], x["start"]), F.lit(mark))), ""), cut(blocks, F.array_max(ends), F.char_length(text).cast("bigint")))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    clean = _bound(ends, lambda e: _bound(_bound(runs(e), tops), lambda t: _bound(blocks, lambda b: _bound(clear(e, t), lambda g: masked(b, g)))))
    return scanned.withColumn(text_col, F.when(text.isNull() | (F.size(found) == 0), text).otherwise(clean))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mask(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the found spans of the text replaced, as ``redact`` does. All columns stay as they are but for the text, whatever their names."""
    blob, findings = free_name(docs, "blob"), free_name(docs, "findings")
    scanned = scan_versions(docs, text_col=text_col, blob_col=blob, findings_col=findings, **options)
    return redact(scanned, text_col=text_col, findings_col=findings).select(*[F.col(f"`{c}`") for c in docs.columns])
