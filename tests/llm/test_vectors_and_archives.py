"""Vector search against brute force, the archive audit against planted damage, and the pipeline against plain stages."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import vector_graph, warc_audit

BAD = [(10_000, None), (10_001, []), (10_002, [0.0] * 24), (10_003, [math.nan] + [1.0] * 23), (10_004, [math.inf] + [1.0] * 23), (10_005, [None] + [1.0] * 23)]


def vectors(n=1500, dim=24, copies=400):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:copies] = x[0]
    return x


@pytest.mark.parametrize("shard_rows", [300, 8192])
def test_nearest(spark, shard_rows):
    x = vectors()
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)] + BAD + [(7, [float(c) for c in np.float32(x[7])]), (20_000, [1.0, 2.0]), (20_001, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4)
    got = vector_graph.search_index(vector_graph.build_index(frame, shard_rows=shard_rows), frame.filter("vec_id % 20 = 0"), block_rows=40).collect()
    x = np.float32(x).astype(float)
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert by.keys() == {*range(0, 1500, 20), 20_000}
    assert [(a, b) for a, b, _ in by.pop(20_000)] == [(1, 20_001)]
    hits = 0
    for q, rows in by.items():
        s = (x * x[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20]
        rows.sort()
        assert [r for r, _, _ in rows] == [*range(1, 21)] and rows == sorted(rows, key=lambda r: (-r[2], r[1]))
        assert all(abs(s[i] - v) < 1e-12 for _, i, v in rows)
        hits += len({*best} & {i for _, i, _ in rows})
        if q < 400:
            assert [i for _, i, _ in rows] == best
    assert hits >= 0.9 * 20 * len(by)


def test_no_vectors(spark):
    frame = spark.createDataFrame(BAD, "vec_id bigint, embedding array<float>")
    assert vector_graph.search_index(vector_graph.build_index(frame), frame).count() == 0


def pages(spark):
    rows = [(i, f"http://h{i % 3}/{i}", f"<p>{'é' * (i % 50)}{i}</p>" if i % 11 else None) for i in range(1500)]
    rows += [(3, "http://h0/3", "<p>again</p>"), (None, None, None), (None, "u", ""), (1499, "http://h2/1499", "x" * 200_000)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_audit(spark):
    ours = warc_audit.archive(pages(spark)).cache()
    rows = ours.collect()
    for f in {r["warc_file"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["warc_file"] == f), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert warc_audit.audit(ours, ours).count() == 0
    hit = F.col("record_id").isin("urn:page:77", "urn:page:900")
    theirs = ours.withColumn("digest", F.when(hit, F.lit("0")).otherwise(F.col("digest"))).filter("record_id <> 'urn:page:1200'")
    more = ours.limit(1).select(F.lit(99).cast("bigint").alias("warc_file"), F.lit(0).cast("bigint").alias("offset"), "length", F.lit("urn:new").alias("record_id"), "digest")
    got = {(r["record_id"], r["status"]) for r in warc_audit.audit(ours, theirs.unionByName(more)).collect()}
    assert got == {("urn:page:77", "corrupt"), ("urn:page:900", "corrupt"), ("urn:page:1200", "missing"), ("urn:new", "extra")}
    assert warc_audit.audit(ours.limit(0), ours.limit(0)).count() == 0


def test_record_bytes(spark):
    got = spark.range(1).select(warc_audit.record_bytes(F.lit("urn:page:1"), F.lit("http://x/"), F.lit("é")).alias("r")).first()["r"]
    head, body = bytes(got).split(b"\r\n\r\n", 1)
    assert head.startswith(b"WARC/1.1\r\n") and b"Content-Length: 2" in head and body == "é".encode() + b"\r\n\r\n"


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.unionByName(docs.limit(5)).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, str(tmp_path))
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before.count()
        before = after
    assert before.count() == before.select("doc_id").distinct().count()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.select("doc_id").distinct().count() == before.count()
    assert out.agg(F.sum("length")).first()[0] == out.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]
