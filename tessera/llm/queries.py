"""The queries of these operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, host_quality, language, packing, secret_ledger, sharding, simhash, token_cache, vector_graph, warc_audit
from tessera.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan_versions(table(spark, sf_dir, "documents", "doc_id", "text"))
    marks = F.concat_ws(",", F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(marks.cast("binary"), 256).alias("base_sha256"), marks.alias("spans"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_cache.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vector_graph.search_index(vector_graph.build_index(vectors), vectors.filter("vec_id % 20 = 0"))


SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id", SHARDS).select("doc_id", "source", "slot", "shard")


def op6_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_quality.judge(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenise(table(spark, sf_dir, "documents", "doc_id", "text", "source"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return packing.pack(tokens, with_ids=False).select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    told = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return told.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode_column(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, pattern).select("doc_id", "ids")
    decoded = byte_bpe.decode_column(encoded, ranks, pattern)
    spelled = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(spelled.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as one replica against a second one with known damage, laid out by itself: of some records the payload has another first character, others were lost before."""
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    ours = warc_audit.archive(pages)
    rotten = F.when(F.col("page_id") % 211 == 17, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    lost = F.col("page_id").cast("string").endswith("00")
    theirs = warc_audit.archive(pages.withColumn("html", rotten).filter(~F.coalesce(lost, F.lit(False))))
    return warc_audit.audit(ours, theirs)


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_token_counts, op3_simhash, op4_nearest, op5_sharding, op6_host_quality, op7_packing, op8_language, op9_byte_bpe, op10_warc_fixity)}

_RULES = (("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("'", "''"), 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32))

_SECRETS = "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), " + ", ".join(
    f"p{i} AS (SELECT doc_id, '{kind}' AS kind, {i} AS place, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals, {least} AS least FROM d)" for i, (kind, pattern, group, least) in enumerate(_RULES)
) + """, p AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2),
m AS (SELECT doc_id, kind, place, least, generate_subscripts(hits, 1) AS i, unnest(hits) AS hit, unnest(vals) AS val, unnest(gaps[1:len(hits)]) AS gap FROM p WHERE len(hits) > 0),
s AS (SELECT doc_id, kind, place, length(val) >= least AS ok, length(hit) AS n, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS e FROM m),
g AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, place) AS spans FROM s WHERE ok GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

_QUALITY = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
e AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (SELECT doc_id, i, CASE WHEN i + 7 <= len(ws) THEN array_to_string(ws[i:i + 7], ' ') END AS g FROM e),
hit AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM win),
cov AS (SELECT doc_id, max(CAST(twice AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c FROM hit),
rep AS (SELECT doc_id, sum(c) AS n FROM cov GROUP BY doc_id),
f AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE base_failed) AS DOUBLE) AS x FROM b WHERE source IS NOT NULL GROUP BY source),
a AS (SELECT sum(n) AS n, sum(x) AS x, count(*) AS hosts, sum(x * x / n) AS xx, sum(n * n) AS nn, sum(x) / sum(n) AS mean FROM h),
v AS (SELECT n, mean, CASE WHEN hosts > 1 AND mean > 0 AND mean < 1 THEN (xx - n * mean * mean - mean * (1 - mean) * (hosts - 1)) / (n - nn / n) ELSE 0 END AS spread FROM a),
k AS (SELECT mean, CASE WHEN spread > 0 THEN least(n, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE n END AS strength FROM v),
bad AS (SELECT source FROM h, k WHERE (x + mean * strength) / (n + strength) > (1 + mean) / 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), TRUE) AS kept FROM b"""

_FIXITY = r"""
WITH r AS (SELECT page_id, 'urn:page:' || page_id AS record_id, CAST(floor(page_id / 512) AS BIGINT) AS warc_file, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) AS head, coalesce(html, '') AS html, chr(13) || chr(10) || chr(13) || chr(10) AS tail FROM pages),
o AS (SELECT *, strlen(head || html || tail) AS length, sha256(head || html || tail) AS our_digest FROM r),
p AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY warc_file ORDER BY page_id, our_digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM o)
SELECT warc_file, "offset", length, record_id, CASE WHEN record_id LIKE '%00' THEN 'missing' ELSE 'corrupt' END AS status, our_digest, CASE WHEN record_id NOT LIKE '%00' THEN sha256(head || '?' || substring(html, 2) || tail) END AS their_digest
FROM p WHERE page_id % 211 = 17 OR record_id LIKE '%00'"""


def _shards_sql() -> str:
    """The slot from the key's MD5, and its shard from the claimed table, which is listed."""
    claimed = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return f"""WITH t AS (SELECT string_split('{claimed}', ',') AS shards),
d AS (SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, source, slot, 'shard-' || lpad(shards[slot + 1], 3, '0') AS shard FROM d, t"""


ORACLE_SQL = {"op5_sharding": _shards_sql(), "op1_secret_scan": _SECRETS, "op6_host_quality": _QUALITY, "op10_warc_fixity": _FIXITY}
