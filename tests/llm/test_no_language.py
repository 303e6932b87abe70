"""The language stage where nothing can be learned."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import language

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("labelled", [False, True])
def test_documents_stay(spark, labelled):
    held = [i for i, h in spark.range(60).select("id", language.held_out(F.col("id"))).collect() if h]
    texts = ["clean words of a text", "日本語", None, "", "123 -- 456", "é"]
    assert len(held) >= len(texts)
    docs = spark.createDataFrame([(i, t, "en" if labelled else None, "s", 0) for i, t in zip(held, texts, strict=False)], SCHEMA)
    assert not language.train(docs).languages
    kept = {r["text"] for r in corpus_pipeline.language_id(spark, docs, "").collect()}
    assert kept == {texts[0], texts[1], texts[5]}
