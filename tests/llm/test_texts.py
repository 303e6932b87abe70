"""Operators on texts against plain versions of them, with odd rows: nulls, empty and long texts, repeats, clashing columns."""

import base64
import hashlib
import re
import zlib

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, host_quality, language, packing, secret_ledger, sharding, simhash, token_cache

ODD = [
    None, "", " ", "\n\n", "a", "  two  blanks ", "tab\tand\x0bvt\x0cff\rcr", "\x1cfs\x1d gs\x85nel\xa0nbsp em ", "▁ ▁▁ literal ▁mark▁ ", "naïve café ﬁ Å é ΑΣ", "日本語 のテキスト 🎉🎉", "12345 6 78'll don't WE'RE",
    "<|endoftext|> <s></s><unk> <|startoftext|>x", "token: abcdefgh token=token: abcdefgh12 PASSWORD = 'hunter2hunter2'", "AKIAAKIAAKIAIOSF api-key=x api_key=\"0123456789\" " + "deadbeef" * 5, "é token=aaaaaaaa🎉secret:bbbbbbbbb",
    "same line\nsame line\n \n \nother", "one two three four five six seven eight nine ten " * 4, "x" * 5000, "word " * 30_000, " ".join(f"w{i}" for i in range(60)), "#*$%&|<>", "don't\n\n\n   stop", "trailing \n ",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts=ODD, **more):
    rows = [(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *rows[:3]], SCHEMA).repartition(5)


def answers(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.select("doc_id", *columns).collect()}


def base_spans(text):
    out = []
    for place, (kind, pattern, group, least, flags) in enumerate([("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, re.I | re.A), ("access", r"AKIA[A-Z0-9]+", 0, 16, 0), ("hex", r"[0-9a-f]+", 0, 32, 0)]):
        out += [(m.start(), place, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def test_secrets(spark, tmp_path):
    frame = docs(spark).withColumn("blob", F.lit("clash"))
    found = secret_ledger.scan_versions(frame)
    assert found.count() == len(ODD) + 3
    got = answers(found, "findings")
    for i, t in enumerate(ODD):
        assert [tuple(x) for x in got[i][0]] == base_spans(t or ""), t
    masked = answers(secret_ledger.redact(found), "text")
    assert masked[0][0] is None and "hunter2hunter2" not in masked[13][0] and masked[20][0] == ODD[20]
    assert masked[15][0] == "é [SECRET]🎉[SECRET]"


def test_secret_ledger_scans_only_what_is_new(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    one = secret_ledger.scan_versions(docs(spark), ledger=ledger)
    rows = lambda: spark.read.parquet(ledger).count()
    pairs = 3 * len({t or "" for t in ODD})
    assert one.count() and rows() == pairs
    secret_ledger.scan_versions(docs(spark, [*ODD, "new text secret=12345678"]), ledger=ledger)
    assert rows() == pairs + 3
    newer = (*secret_ledger.BASE_RULES[:2], secret_ledger.Rule("hex", r"[0-9a-f]{40,}", 0, 40, "2"))
    got = answers(secret_ledger.scan_versions(docs(spark), ledger=ledger, rules=newer), "findings")
    assert rows() == pairs + 3 + pairs // 3
    assert ("hex" in {x["kind"] for x in got[14][0]}) and len(got[13][0]) == len(base_spans(ODD[13]))


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(spark, tmp_path, name):
    cache = f"file://{tmp_path}/cache"
    got = answers(token_cache.count_tokens(docs(spark), P.path(name), cache=cache), "n_bytes", "n_tokens")
    if name.endswith("model"):
        import sentencepiece

        want = lambda t: len(sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(t))
    else:
        from tokenizers import Tokenizer

        want = lambda t: len(Tokenizer.from_file(P.path(name)).encode(t, add_special_tokens=False).ids)
    assert got == {i: (len((t or "").encode()), want(t or "")) for i, t in enumerate(ODD)}
    before = spark.read.parquet(cache).count()
    assert before == len({t or "" for t in ODD})
    assert answers(token_cache.count_tokens(docs(spark, [*ODD, "one more"]), P.path(name), cache=cache), "n_bytes", "n_tokens")[0] == got[0]
    assert spark.read.parquet(cache).count() == before + 1


def test_byte_bpe(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = byte_bpe.encode_column(docs(spark).withColumn("ids", F.lit(1)), path, P.PATTERN)
    got = answers(byte_bpe.decode_column(coded, path, P.PATTERN), "ids", "decoded")
    for i, t in enumerate(ODD):
        ids, raw = got[i]
        assert ids == own.encode_ordinary(t or ""), t
        assert bytes(raw) == (t or "").encode()


def test_byte_bpe_has_every_token():
    path = P.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.ByteBpe(byte_bpe.read_ranks(open(path, "rb").read()), P.PATTERN)
    assert bpe.model.get_piece_size() == len(bpe.ranks) + 1
    for token, rank in [*bpe.ranks.items()][::997]:
        assert bpe.model.piece_to_id(token.decode("latin-1").translate(bpe.chars)) == rank


def plain_print(text, k=3):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", text.lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(spark):
    got = answers(simhash.near_duplicates(docs(spark)), "fingerprint", "component_id")
    assert {i: v[0] % (1 << 64) for i, v in got.items()} == {i: plain_print((t or "").encode()) for i, t in enumerate(ODD)}
    assert got[1][1] == got[0][1] == got[3][1] == 0


def test_keep_one(spark):
    texts = ["a b c d e", "a b c d e", "other words in here now", None, ""]
    rows = [(i if i != 1 else 0, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, t, "en", "s", 0) for t in ("other words in here now", "lone text of no id", "lone text of no id")]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(kept, key=str) == sorted([(0, "a b c d e"), (2, "other words in here now"), (3, None), (None, "lone text of no id")], key=str)


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_join_what_is_near(spark, crowd):
    import random

    rng = random.Random(3)
    prints = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(40))}
    for p in [*prints]:
        for _ in range(8):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64)) if rng.random() < 0.6 else sum(1 << rng.randrange(64) for _ in range(4))
            prints.add(p % (1 << 64))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    roots = {p: p for p in signed}

    def root(p):
        while roots[p] != p:
            p = roots[p]
        return p

    for a in signed:
        for b in signed:
            if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                roots[y] = x
    from tessera.llm.components import connected_components

    got = {r["node"]: r["root"] for r in connected_components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), crowd=crowd)).collect()}
    assert {p: got.get(p, p) for p in signed} == {p: root(p) for p in signed}


def test_chains_of_links(spark):
    from tessera.llm.components import connected_components

    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(7, 7), (5, 4), (5, 4)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_features(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [" ".join(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len({*lines}), len(covered)


def test_quality(spark):
    short = [t for t in ODD if t is None or len(t) < 20_000]
    frame = docs(spark, short).withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1)).drop("kept")
    got = answers(host_quality.judge(frame), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in enumerate(short):
        want = plain_features(t or "")
        assert got[i][:5] == want, t
        assert got[i][5] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i][5] and got[i][6])
    assert host_quality.judge(docs(spark)).count() == len(ODD) + 3


def test_bad_hosts_take_their_documents_along(spark):
    good, bad = " ".join(f"w{i}" for i in range(40)), "short"
    rows = [(i, bad if i % 10 else good, "en", "spam", 0) for i in range(200)] + [(1000 + i, good, "en", f"h{i % 5}", 0) for i in range(300)] + [(2000, bad, "en", "tiny", 0), (2001, good, "en", "tiny2", 0), (2002, good, "en", None, 0)]
    frame = spark.createDataFrame(rows, SCHEMA)
    kept = {r["doc_id"] for r in host_quality.judge(frame).filter("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] >= 1000 and r[0] != 2000}
    assert {r["doc_id"] for r in host_quality.keep_good(frame).collect()} == kept


def test_language(spark):
    words = {"en": "the of and to in that was with for this", "fr": "le la les des une dans pour que qui sur", "de": "der die und nicht mit das ein von auf für"}
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[k].split(), k=30)), k, "s", 0) for i in range(300) for k in [rng.choice([*words])]]
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, SCHEMA)
    model = language.train(frame)
    assert model.languages == sorted(words) and (model.weights == 0).mean() > 0.5
    got = answers(language.identify(frame.withColumn("score", F.lit("clash")), model).withColumn("held", language.held_out(F.col("doc_id"))), "lang_pred", "score", "held")
    out = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in out} == {i for i, v in got.items() if v[2] and i < 1000}
    assert sum(got[r[0]][0] == r[2] for r in out) >= 0.97 * len(out)
    for i, t in enumerate(ODD):
        assert (got[1000 + i][0] == "und") == (t is None or not any(map(str.isalpha, t))), t
        assert 0 <= got[1000 + i][1] <= 1
    none = language.train(frame.limit(0))
    assert answers(language.identify(frame, none), "lang_pred")[0] == ("und",)


def pieces(frame):
    return [r.asDict() for r in frame.collect()]


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    frame = docs(spark)
    got = pieces(packing.pack(packing.tokenise(frame, path, end_id=2), window=256, partition_tokens=4000))
    rows = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    times = {i: sum(1 for j, _ in rows if j == i) for i, _ in rows}
    seen: dict = {}
    for p in got:
        ids = want[p["id"]][p["start"] : p["start"] + p["length"]]
        assert len(ids) == p["length"] and p["doc_tokens"] == len(want[p["id"]])
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert bytes(p["ids"]) == raw and p["ids_crc32"] == zlib.crc32(raw)
        for j in range(p["start"], p["start"] + p["length"]):
            seen[p["id"], j] = seen.get((p["id"], j), 0) + 1
    assert seen == {(i, j): times[i] for i in want for j in range(len(want[i]))}
    by_sequence: dict = {}
    for p in got:
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_packing_follows_the_mixture(spark):
    rows = [(i, "x" * (50 + i % 70), f"s{min(i % 10, 3)}") for i in range(4000)]
    frame = spark.createDataFrame([(i, s, bytes(4 * len(t)), len(t)) for i, t, s in rows], "id bigint, source string, ids binary, n_tokens bigint").repartition(6)
    got = pieces(packing.pack(frame, window=1024, partition_tokens=60_000, least_piece=16))
    source = {i: s for i, _, s in rows}
    total = sum(p["length"] for p in got)
    share = {s: sum(p["length"] for p in got if source[p["id"]] == s) / total for s in {*source.values()}}
    windows: dict = {}
    for p in got:
        w = windows.setdefault(p["sequence_id"], {})
        w[source[p["id"]]] = w.get(source[p["id"]], 0) + p["length"]
    full = [w for w in windows.values() if sum(w.values()) == 1024]
    off = [abs(w.get(s, 0) / 1024 - share[s]) for w in full for s in share]
    assert len(full) > 200 and sorted(off)[int(0.9 * len(off))] < 0.08


def test_word_tokens_equal_the_library():
    from tokenizers import Tokenizer

    data = open(P.path("word_bpe_49k.json"), "rb").read()
    words, tok = packing.WordTokens(data), Tokenizer.from_str(data.decode())
    assert words.apart
    import array

    texts = [t or "" for t in ODD] + ["<|ENDOFTEXT|> x", "A. b, c.. d., e.\nf,\n g.", "İstanbul ΣΑΣ ﬁﬂ Ångström e\u0301t\u00e9", "\u0301 x\u0301 \u0301y"]
    for _ in range(2):
        assert [array.array("H", x).tolist() for x in words.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def plain_table(names, size):
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    order = {s: [(number(s, "offset") + j * (number(s, "skip") % (size - 1) + 1)) % size for j in range(size)] for s in names}
    table: dict = {}
    while len(table) < size:
        for s in names:
            if len(table) < size:
                table[next(x for x in order[s] if x not in table)] = s
    return [table[i] for i in range(size)]


def test_sharding(spark):
    names = [f"n{i}" for i in range(7)]
    assert [names[i] for i in sharding.lookup_table(names, 251)] == plain_table(names, 251)
    frame = docs(spark).withColumn("shard", F.lit(9)).unionByName(docs(spark).withColumn("doc_id", F.lit(None).cast("bigint")).withColumn("shard", F.lit(9)))
    placed = sharding.place(frame, "doc_id", names, size=251)
    table = plain_table(names, 251)
    got = placed.select("doc_id", "slot", "shard").collect()
    assert len(got) == 2 * (len(ODD) + 3)
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 251
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    less, full = sharding.lookup_table(names[:-1], 65_537), sharding.lookup_table(names, 65_537)
    stays = full < 6
    assert (less[stays] == full[stays]).mean() > 0.8


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert secret_ledger.scan_versions(none).count() == 0
    assert token_cache.count_tokens(none, P.path("piece_bpe_32k.model")).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert host_quality.judge(none).count() == 0
    assert host_quality.keep_good(none).count() == 0
    assert packing.pack(packing.tokenise(none, P.path("word_bpe_49k.json"), end_id=2)).count() == 0
    assert sharding.place(none, "doc_id", ["a"]).count() == 0
    assert byte_bpe.encode_column(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
