"""The pipeline's stages against plain versions that see all documents at once."""

import re
import zlib

import public_tokenizers as P
from pyspark.sql import functions as F
from test_shingles import plain_kept
from test_texts import base_spans, plain_features

import corpus_pipeline
from tessera.llm import language


def plain_quality(docs):
    failed = {}
    for i, d in docs.items():
        n, _, _, _, repeats = plain_features(d["text"] or "")
        failed[i] = n < 20 or 100 * repeats > 30 * n
    hosts: dict = {}
    for i, d in docs.items():
        if d["source"] is not None:
            hosts.setdefault(d["source"], []).append(failed[i])
    n = {h: len(v) for h, v in hosts.items()}
    x = {h: sum(v) for h, v in hosts.items()}
    total, mean = sum(n.values()), sum(x.values()) / sum(n.values())
    between = sum(n[h] * (x[h] / n[h] - mean) ** 2 for h in n) - mean * (1 - mean) * (len(n) - 1)
    spread = between / (total - sum(v * v for v in n.values()) / total)
    strength = min(total, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else total
    bad = {h for h in n if (x[h] + mean * strength) / (n[h] + strength) > (1 + mean) / 2}
    return {i: d for i, d in docs.items() if not failed[i] and d["source"] not in bad}


def plain_dedup(docs):
    kept = plain_kept({i: d["text"] for i, d in docs.items()})
    return {i: d for i, d in docs.items() if i in kept}


def plain_mask(text):
    out, at = "", 0
    for a, b, _ in base_spans(text):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_every_stage_and_the_whole(spark, tmp_path):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    leak = F.concat("text", F.lit("\nPASSWD: 'hunter2-hunter2' and é token=24be64439e3e49cf46b2d7c90f3602a3"))
    given.withColumn("text", F.when(F.col("doc_id") % 17 == 0, leak).otherwise(F.col("text"))).write.parquet(f"{tmp_path}/documents.parquet")
    sf = f"file://{tmp_path}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    quality, lang, dedup, secrets, _ = (f for _, f in corpus_pipeline.STAGES)
    one = plain_quality(rows(docs))
    got = quality(spark, docs, sf)
    assert rows(got) == one
    model = language.train(got)
    two = {i: d for i, d in one.items() for p in [language.predict_text(model, d["text"])] if p[0] != "und" and p[1] >= 0.5}
    got = lang(spark, got, sf)
    assert rows(got) == two and len(two) > 0.95 * len(one)
    three = plain_dedup(two)
    got = dedup(spark, got, sf)
    assert rows(got) == three and len(three) < len(two)
    four = {i: d | {"text": t, "n_chars": len(t)} for i, d in three.items() for t in [plain_mask(d["text"])]}
    got = secrets(spark, got, sf)
    assert rows(got) == four and any("[SECRET]" in d["text"] for d in four.values())
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(d["text"], add_special_tokens=False).ids, 2] for i, d in four.items()}
    pieces = corpus_pipeline.run(spark, sf).collect()
    back: dict = {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = back.setdefault(p["doc_id"], [])
        assert p["start"] == len(own) and p["ids_crc32"] == zlib.crc32(p["ids"])
        own += [int.from_bytes(p["ids"][k : k + 4], "little") for k in range(0, len(p["ids"]), 4)]
    assert back == ids


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = language.identify(docs, language.train(docs)).filter(language.held_out(F.col("doc_id"))).select("lang", "lang_pred", "text").collect()
    sure = [r for r in told if r["text"] and len(re.findall(r"[^\W\d_]+", r["text"])) >= 20]
    assert len(sure) > 150 and sum(r["lang"] == r["lang_pred"] for r in sure) >= 0.98 * len(sure)
