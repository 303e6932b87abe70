"""Operators at their edges: clashing columns, empty and repeated rows, hot groups, damaged inputs, and fits against plain loops."""

import array
import math
import os
import random

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from test_texts import ODD, SCHEMA, docs

import corpus_pipeline
from tessera.llm import byte_bpe, host_quality, language, packing, queries, secret_ledger, sharding, vector_graph, warc_audit

TURKISH = ["BELEDİYESİ,", "İ.", "(İ)", "Aİ-B", "İstanbul'da İZMİR!", "T\u0308a h\u0331 W\u030a."]


def test_word_tokens_of_any_letters_equal_the_library():
    from tokenizers import Tokenizer

    data = open(P.path("word_bpe_49k.json"), "rb").read()
    words, tok = packing.WordTokens(data), Tokenizer.from_str(data.decode())
    rng = random.Random(11)
    pool = [*"aAbZ09 .,'-(\n\tİıéÉßẞΣσς\u0331\u0301\u0307\u0308ÅKﬁ가각\u1100\u1161일日TihJW\x1c\x85\xa0!#", "'s", "'LL"]
    texts = TURKISH + ["".join(rng.choices(pool, k=rng.randrange(1, 12))) for _ in range(100_000)]
    texts += ["".join(chr(rng.randrange(32, 0x3000) if rng.random() < 0.9 else rng.randrange(0x10000, 0x20000)) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)]
    got = [array.array("H", x).tolist() for x in words.encode([t.encode() for t in texts])]
    assert got == [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def test_packing_to_another_mixture(spark):
    rows = [(i, "a" if i % 10 else "b", bytes(400), 100) for i in range(3000)]
    frame = spark.createDataFrame(rows, "id bigint, source string, ids binary, n_tokens bigint")
    wanted = {"a": 0.5, "b": 0.5}
    got = packing.pack(frame, window=1000, shares=wanted, least_piece=50, partition_tokens=1 << 30).select("id", "length", "sequence_id").collect()
    by: dict = {}
    for p in got:
        w = by.setdefault(p["sequence_id"], [0, 0])
        w[0 if p["id"] % 10 else 1] += p["length"]
    # the rarer source lasts for 60 windows of half each
    assert [by[k] for k in sorted(by)][:58] == [[500, 500]] * 58 and sum(map(sum, by.values())) == 300_000


def test_a_changed_rule_is_scanned_again(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    frame = spark.createDataFrame([(1, "xx abc yy")], "doc_id bigint, text string")
    spans = lambda pattern: [tuple(x) for x in secret_ledger.scan_versions(frame, ledger=ledger, rules=(secret_ledger.Rule("k", pattern),)).first()["findings"]]
    assert spans("abc") == [(3, 6, "k")] and spans("yy") == [(7, 9, "k")] and spans("abc") == [(3, 6, "k")]
    assert spark.read.parquet(ledger).count() == 2


def plain_redact(text, spans):
    out, at = "", 0
    for a, b, _ in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_redact_any_spans(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 5, 100, 1023, 1024, 1025, 2048, 5000, 9000])
        text = "".join(rng.choices("ab é🎉\n", k=n))
        spans = sorted((a, min(n, a + rng.choice([1, 3, 40, 1500])), "k") for a in (rng.randrange(n) for _ in range(rng.choice([0, 1, 3, 70, 300]) if n else 0)))
        rows.append((i, text, spans))
    frame = spark.createDataFrame(rows, "id int, text string, findings array<struct<start:bigint,end:bigint,kind:string>>")
    got = {r["id"]: r["text"] for r in secret_ledger.redact(frame).collect()}
    assert got == {i: plain_redact(t, s) for i, t, s in rows}


def on_table(spark, path, rows, name, schema=SCHEMA):
    """Rows of ``documents``: the query's and those of its SQL."""
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    ours = queries.QUERIES[name](spark, f"file://{path}").toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    theirs = con.execute(queries.ORACLE_SQL[name]).df()[[*ours.columns]]
    key = lambda f: sorted(map(tuple, f.astype(object).where(f.notna(), None).values.tolist()), key=str)
    return key(ours), key(theirs)


def test_bad_hosts_go_in_query_and_sql(spark, tmp_path):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "en", "spam", 0) for i in range(200)] + [(1000 + i, bad if i % 20 == 0 else good, "en", f"h{i % 5}", 0) for i in range(600)] + [(3000, good, "en", None, 0), (3001, None, "en", "h1", 0), (3001, None, "en", "h1", 0)]
    ours, theirs = on_table(spark, tmp_path, rows, "op6_host_quality")
    assert ours == theirs
    by_host = {r[0]: r[7] for r in ours}
    # every tenth document of the bad host passes by itself and goes with its host
    assert not any(by_host[i] for i in range(200)) and all(by_host[1000 + i] == (i % 20 > 0) for i in range(600)) and by_host[3000]


def test_shards_in_sql(spark, tmp_path):
    ours, theirs = on_table(spark, tmp_path, [(i * 7919, t, "en", f"s{i}", 0) for i, t in enumerate(ODD)] + [(None, None, None, None, None)], "op5_sharding")
    assert ours == theirs and len(ours) == len(ODD) + 1


def test_shards_are_written(spark, tmp_path):
    placed = sharding.place(docs(spark).select("doc_id", "text"), "doc_id", ["a", "b", "c"], size=251)
    sharding.write_shards(placed, f"file://{tmp_path}/out", files_per_shard=3)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert sorted(back.select("doc_id", "shard").collect()) == sorted(placed.select("doc_id", "shard").collect())
    key = sharding.place(spark.createDataFrame([("x", "y")], "slot string, shard string"), "slot", ["a"], size=251).first()
    assert key["slot"] == sharding.place(spark.createDataFrame([("x",)], "k string"), "k", ["a"], size=251).first()["slot"]


def test_index_keeps_its_parameters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(rng.normal(size=(150, 8)))]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    index = vector_graph.build_index(frame, k=5, links=4)
    got = vector_graph.search_index(index, frame.filter("vec_id = 3"), k=5, wide=150).collect()
    x = np.array([v for _, v, _ in rows])
    assert [r["vec_id"] for r in got] == [i for i in np.argsort(-(x @ x[3])) if i != 3][:5]
    with pytest.raises(ValueError, match="5 neighbours, not 6"):
        vector_graph.search_index(index, frame, k=6)
    assert vector_graph.search_index(vector_graph.build_index(frame.limit(0)), frame).count() == 0
    assert vector_graph.search_index(index, frame.limit(0), k=5).count() == 0


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_a_lost_record_is_one_row(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'x' * (i % 90)}</p>") for i in range(700)]
    ours = warc_audit.archive(pages(spark, rows))
    theirs = warc_audit.archive(pages(spark, [r for r in rows if r[0] != 100]))
    got = warc_audit.audit(ours, theirs).collect()
    assert [(r["record_id"], r["status"]) for r in got] == [("urn:page:100", "missing")]
    moved = warc_audit.audit(ours, theirs, moved=True).filter("status = 'moved'")
    assert {r["record_id"] for r in moved.collect()} == {f"urn:page:{i}" for i in range(101, 512)}
    assert {r["status"] for r in warc_audit.audit(theirs, ours).collect()} == {"extra"}


def test_a_page_of_many_contents(spark):
    rows = [(5, "u", f"<p>{i}</p>") for i in range(300)] + [(5, "u", "<p>again</p>")] * 200 + [(None, None, None)] * 3
    ours = warc_audit.archive(pages(spark, rows), most=64)
    laid: dict = {}
    for r in ours.collect():
        laid.setdefault(r["warc_file"], []).append((r["offset"], r["length"]))
    for places in laid.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
    assert sum(map(len, laid.values())) == 503 and len(laid) > 3
    theirs = warc_audit.archive(pages(spark, rows[1:299] + [(5, "u", "<p>other</p>")] + rows[301:-1]), most=64)
    got = sorted(r["status"] for r in warc_audit.audit(ours, theirs).collect() if r["record_id"] == "urn:page:5")
    # two contents and one of the repeated ones lost, another come in
    assert len(got) in (3, 4) and {*got} <= {"corrupt", "missing", "extra"}
    none = warc_audit.audit(ours, theirs).filter("record_id = 'urn:page:none'").collect()
    assert [r["status"] for r in none] == ["missing"]


def test_fit_is_ftrl_as_in_plain_loops():
    rng = random.Random(8)
    rows = [(np.array(sorted(rng.sample(range(12), 4)), np.int32), np.array([rng.randrange(1, 4) for _ in range(4)], np.int32), rng.choice(["x", "y", "z"])) for _ in range(30)]
    idf = np.array([1 + i / 10 for i in range(12)])
    epochs, alpha, beta, l1, l2, seed = 2, 0.7, 1.0, 0.05, 0.5, 5
    model = language.fit(rows, idf, epochs=epochs, alpha=alpha, beta=beta, l1=l1, l2=l2, seed=seed)
    draw = np.random.default_rng(seed)
    order = draw.permutation(30)
    z, n = ([[0.0] * 3 for _ in range(13)] for _ in range(2))

    def weight(i, c):
        if abs(z[i][c]) <= l1:
            return 0.0
        return -(z[i][c] - math.copysign(l1, z[i][c])) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    for _ in range(epochs):
        for r in draw.permutation(order[6:]):
            at, counts, name = rows[r]
            x = [(1 + math.log(k)) * idf[i] for i, k in zip(at, counts, strict=True)]
            length = math.sqrt(sum(v * v for v in x))
            features = [*zip(at.tolist(), [v / length for v in x], strict=True), (12, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in features for c in range(3)}
            scores = [sum(v * w[i, c] for i, v in features) for c in range(3)]
            total = sum(math.exp(s) for s in scores)
            for c in range(3):
                error = math.exp(scores[c]) / total - ("xyz"[c] == name)
                for i, v in features:
                    g = error * v
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i, c]
                    n[i][c] += g * g
    want = np.array([[weight(i, c) for c in range(3)] for i in range(13)])
    assert np.allclose(model.weights, want[:12], atol=1e-6) and np.allclose(model.bias, want[12]) and 0.02 <= model.temperature <= 20


def test_language_edges(spark):
    rows = [(i, f"{w} {w} {w}", w[:2], "s", 0) for i in range(40) for w in [["alpha beta", "gamma delta"][i % 2]]]
    twice = [(1, "another text of one id", "ga", "s", 0), (1, "a third text", "al", "s", 0)]
    frame = spark.createDataFrame(rows + twice, SCHEMA)
    one, two = language.train(frame.repartition(3)), language.train(frame.repartition(7))
    assert (one.weights == two.weights).all() and one.temperature == two.temperature
    assert language.identify(frame.limit(0), one).count() == 0
    with pytest.raises(ValueError, match="more than 1 languages"):
        language.train(frame, most_languages=1)


def test_decoding_edges(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    frame = spark.createDataFrame([(1, None, "c"), (2, [], "c"), (3, [0], "c")], "doc_id bigint, ids array<int>, decoded string")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in byte_bpe.decode_column(frame, path, P.PATTERN).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 1
    assert byte_bpe.decode_column(frame.limit(0), path, P.PATTERN).count() == 0


CLASHES = ["score", "lang_pred", "blob", "findings", "n_words", "base_failed", "host", "id", "key", "node", "root", "_fp", "_root", "_text", "_row", "group", "text2", "a.b"]


def test_stages_leave_other_columns_alone(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = given.withColumn("text", F.when(F.col("doc_id") % 40 == 7, F.lit(None)).when(F.col("doc_id") % 40 == 9, F.lit("")).otherwise(F.concat("text", F.lit(" token=abcdefgh1"))))
    texts = texts.withColumn("source", F.when(F.col("doc_id") % 9 > 0, F.col("source"))).withColumn("lang", F.when(F.col("doc_id") % 5 > 0, F.col("lang")))
    before = texts.unionByName(texts.limit(9)).select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, "").cache()
        assert after.columns == before.columns, name
        rows = after.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHES), name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, "")
    assert packed.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_host_rates_without_hosts(spark):
    frame = docs(spark).withColumn("source", F.lit(None).cast("string"))
    assert host_quality.judge(frame).filter("kept AND base_failed").count() == 0
    assert host_quality.keep_good(frame).count() == host_quality.judge(frame).filter("kept").count()


def test_core_without_this_package(tmp_path):
    """The entry point of a copy whose tokenizers can't be imported keeps its other queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("__pycache__"))
    for f in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(root, f), tmp_path / f)
    (tmp_path / "public_tokenizers.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(n.startswith('op1_') for n in q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[1:] == ["False", "False"], out.stderr


def test_workers_hold_little(monkeypatch):
    """One operator's memo at a time, and long words in none of them; results are the same however little is remembered."""
    from tessera.llm import byte_bpe, common, packing, shingles

    long = [b"x%d" % i + b"y" * 200 for i in range(50)]
    words = [b"a", b"b", *long, b"a"]
    whole = shingles.shingle_set(words)
    assert [k[0] for k in common._HELD] == ["digests"] and len(next(iter(common._HELD.values()))) == 2
    data = common.file_bytes(P.path("word_bpe_49k.json"))
    text = b" ".join(words)
    tokens = packing._loaded(data, "key")
    assert [k[0] for k in common._HELD] == ["words"]
    plain = tokens.tok.encode(text.decode(), add_special_tokens=False).ids
    monkeypatch.setattr(packing, "MEMO_BYTES", 100)
    for _ in range(3):
        assert np.frombuffer(tokens.encode([text, b"a new word"])[0], tokens.kind).tolist() == plain
        assert tokens.memo_bytes <= len(text) + 10
    ranks = common.file_bytes(P.path("byte_bpe_50k.tiktoken"))
    bpe = byte_bpe._loaded(ranks, P.PATTERN)
    assert bpe.decode(bpe.encode(text.decode())) == text and max(map(len, bpe.memo)) <= byte_bpe.LONG + 1
    assert [k[0] for k in common._HELD] == ["bytes"] and (shingles.shingle_set(words) == whole).all()
