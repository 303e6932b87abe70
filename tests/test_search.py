"""Readers, signatures, searches, evaluation and sinks."""

import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera import queries as q
from tessera.operators import evaluate, grid, minhash, search, sinks
from tessera.plans.comparison import compare
from tessera.sources import polygons as sources
from tessera.sources.derived import ell, octagon, polygons

SF = "/root/testdata/sf0.001"
LINES = [
    "a\tPOLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))\tx", "b c\tPOLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))\t", "bow\tPOLYGON ((0 0, 2 2, 2 0, 0 2, 0 0))\tx", "p\tPOINT (1 2)\tx", "m\tMULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))\tx",
    "bad\tPOLYGON ((0 0\tx", "one\tPOLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "none", "", "a\tPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))\tlast", "three\tPOLYGON ((0 0, 1e1 0, 1e1 -1e1, 0 0))\t\t", "z\tPOLYGON ((0 0, 1 1, 2 2, 0 0))\tx",
]


def test_lines(spark, tmp_path):
    (tmp_path / "d.txt").write_text("\n".join(LINES))
    good, rejects = sources.read_wkt_with_id(spark, f"file://{tmp_path}/d.txt")
    got = {r["id"]: r for r in good.withColumn("area", __import__("tessera.functions.geometry", fromlist=["area"]).area(F.col("rings"))).collect()}
    assert {k: (v["area"], v["n_parts"], v["repaired"]) for k, v in got.items() } == {"a": (1, 1, False), "b c": (15, 1, False), "bow": (2, 2, True), "three": (50, 1, False)}
    assert sorted(r["reason"].split(":")[0] for r in rejects.collect()) == sorted(["not a polygon", "not a polygon", "bad geometry", "fewer than two tabs", "fewer than two tabs", "no area"])


def test_the_last_line_wins_however_lines_are_dealt(spark, tmp_path):
    for part in range(3):
        lines = [f"{i % 50}\tPOLYGON ((0 0, {n} 0, {n} 1, 0 1, 0 0))\tx" for i in range(400) for n in [400 * part + i + 1]]
        (tmp_path / f"{part}.txt").write_text("\n".join(lines[: 400 - 100 * part]))
    want = {str(i): 800 + 150 + i + 1 for i in range(50)}
    for partitions in (None, 7):
        good, _ = sources.read_wkt_with_id(spark, f"file://{tmp_path}", partitions)
        from tessera.functions import geometry as g

        assert {r["id"]: r["a"] for r in good.select("id", g.area(F.col("rings")).alias("a")).collect()} == want


@pytest.mark.parametrize("block", [1024, 3])
def test_blocks_of_buckets(spark, block):
    s, d = sides(spark)
    index = search.LshIndex.fit(d, minhash.Darts(tables=3, attempts=600))
    want = index.candidates(s).count()
    _, shapes = search._once(s)
    a, b = index._dealt(shapes, bin_rows=100, block=block)
    rows = {}
    for name, side in (("a", a), ("b", b)):
        for r in side.collect():
            rows.setdefault((r["group"], r["sub"]), {"a": [], "b": []})[name].append(r)
    members = {}
    for r in index.members.collect():
        members[r["shape"]] = members.get(r["shape"], 0) + 1
    asked = {}
    for r in search._once(s)[0].collect():
        asked[r["shape"]] = asked.get(r["shape"], 0) + 1
    met = [(x["shape"], y["shape"]) for v in rows.values() for x in v["a"] for y in v["b"] if x["key"] == y["key"] and not any(p == q for p, q in zip(x["sig"][: x["table_id"]], y["sig"]))]
    # each pair that shares a bucket meets once
    assert len(met) == len({*met}) and sum(asked[p] * members[q] for p, q in met) == want


def test_tables_are_removed(spark):
    from tessera import session

    path = session.fresh_path(spark, "x")
    kept = session.stored_at(spark.range(3), path)
    assert kept.count() == 3 and sources.path_exists(spark, path)
    session.remove(spark, path)
    assert not sources.path_exists(spark, path) and path not in session._MADE[spark.sparkContext.applicationId]


def test_other_readers(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("geom\trest\nPOLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))\tx\tPOLYGON\nnonsense\ty\n")
    good, rejects = sources.read_header_tsv(spark, f"file://{tmp_path}/h.tsv")
    assert good.count() == 1 and rejects.count() == 1
    (tmp_path / "w.txt").write_text("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))\n\nPOINT (0 0)\n")
    good, rejects = sources.read_wkt(spark, f"file://{tmp_path}/w.txt", 3)
    assert good.count() == 1 and rejects.count() == 1
    (tmp_path / "g.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"7","geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},\n{"type":"Feature","properties":{"id":"8"},"geometry":{"type":"Point","coordinates":[0,0]}}]}')
    good, rejects = sources.read_geojson(spark, f"file://{tmp_path}/g.json")
    assert [r["id"] for r in good.collect()] == ["7"] and rejects.count() == 1
    assert sources.path_exists(spark, f"file://{tmp_path}/g.json") and not sources.path_exists(spark, f"file://{tmp_path}/no")


def sides(spark, shape=octagon):
    d = search.centred(polygons(spark.range(1, 301).withColumnRenamed("id", "k"), "k", shape=shape))
    s = search.centred(polygons(spark.range(1, 21).withColumnRenamed("id", "k"), "k", F.col("k") * 31 + 5, shape=shape))
    return s, d


@pytest.mark.parametrize("shape", [octagon, ell])
def test_exact_search_is_brute_force(spark, shape):
    from tessera.functions import geometry as g

    s, d = sides(spark, shape)
    e = F.col("rings")
    a, b = (x.select(F.col("id").alias(n), g.edges(e).alias(f"e{n}"), g.area(e).alias(f"a{n}")) for x, n in ((s, "q"), (d, "d")))
    pairs = a.crossJoin(b).select("q", "d", g.jaccard_distance(g.overlap_area(F.col("eq"), F.col("ed")), F.col("aq"), F.col("ad")).alias("v")).collect()
    want = {}
    for r in pairs:
        want.setdefault(r["q"], []).append((round(r["v"], 9), r["d"]))
    for block in (1024, 7):
        got = {}
        for r in search.exact_knn(s, d, 5, block).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], round(r["distance"], 9), r["neighbor_id"]))
        for name, rows in got.items():
            rows.sort()
            assert [v for _, v, _ in rows] == [v for v, _ in sorted(want[name])[:5]]
            assert all((v, n) in want[name] for _, v, n in rows)
        assert got.keys() == want.keys()


def test_first_hits_agree_and_match_similarity(spark):
    s, d = sides(spark)
    box = grid.global_mbr(d).first()
    darts = minhash.Darts(tables=3, length=2, attempts=600)
    key = lambda df: {(r["id"], r["table_id"]): tuple(r["hash"]) for r in df.collect()}
    one, two = key(minhash.signatures(d, box, darts)), key(minhash.signatures_by_cells(d, box, darts))
    assert one == two and len(one) == 900
    assert key(minhash.signatures(d.repartition(7), box, darts)) == one
    many = minhash.Darts(tables=400, attempts=600)
    pair = d.filter("id in ('3', '8')")
    got = key(minhash.signatures(pair, box, many))
    equal = sum(got["3", h] == got["8", h] for h in range(400)) / 400
    from tessera.functions import geometry as g

    e = [r for r in pair.select("id", g.edges(F.col("rings")).alias("e"), g.area(F.col("rings")).alias("a")).collect()]
    o = pair.sparkSession.createDataFrame([(e[0]["e"], e[1]["e"])], f"a {g.EDGES}, b {g.EDGES}").select(g.overlap_area(F.col("a"), F.col("b")).alias("o")).first()["o"]
    similarity = o / (e[0]["a"] + e[1]["a"] - o)
    assert abs(equal - similarity) < 4 * math.sqrt(similarity * (1 - similarity) / 400)


def test_twister_words():
    u, _ = minhash.Darts(attempts=2500, base=5489).unit(0, 0)
    import numpy as np

    words = np.random.RandomState(5489).randint(0, 2**32, 10_000, dtype=np.uint64)
    assert words[-1] == 4123659995 and len(u) == 2500 and (0 <= u).all() and (u < 1).all()


def test_holes_in_signatures(spark):
    d = search.centred(polygons(spark.range(1, 40).withColumnRenamed("id", "k"), "k", shape=lambda k: octagon(k, hole=True)))
    box = grid.global_mbr(d).first()
    darts = minhash.Darts(tables=30, attempts=3000)
    outer, full = ({(r["id"], r["table_id"]): r["hash"][0] for r in minhash.signatures(d, box, darts, ring).collect()} for ring in ("exterior", "full"))
    assert outer.keys() == full.keys() and all(full[k] >= outer[k] for k in outer) and full != outer


def test_index(spark, tmp_path):
    s, d = sides(spark)
    index = search.LshIndex.fit(d, minhash.Darts(attempts=600))
    near, exact = index.knn(s, 10), search.exact_knn(s, d, 10)
    candidates = {(r["query_id"], r["neighbor_id"]) for r in index.candidates(s).collect()}
    rows = near.collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in rows} <= candidates
    best = {(r["query_id"], r["rank"]): r["distance"] for r in exact.collect()}
    assert all(r["distance"] >= best[r["query_id"], r["rank"]] for r in rows)
    p = index.pruning(s).first()
    assert p["refined"] == len(candidates) and p["possible"] == 6000 and p["pruned_pct"] == 100 * (1 - len(candidates) / 6000)
    assert index.bucket_sizes().agg(F.sum("size")).first()[0] == index.buckets().count() == 600
    row = index.buckets().first()
    assert row["id"] in {r["id"] for r in index.lookup(row["table_id"], row["hash"]).collect()}
    index.save(f"file://{tmp_path}/i")
    again = search.LshIndex.load(spark, f"file://{tmp_path}/i").knn(s, 10)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))
    shuffled = search.LshIndex.fit(d.repartition(9), minhash.Darts(attempts=600)).knn(s.repartition(3), 10)
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, rows))
    everything = search.LshIndex.fit(d, minhash.Darts(tables=60, attempts=600)).knn(s, 10)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))


def test_weighted_hashes_match_similarity(spark):
    from tessera.operators import weighted

    cells = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.5), ("a", 2, 0.25), ("b", 0, 0.5), ("b", 1, 0.5), ("b", 3, 0.5)], "id string, cell_id bigint, fill double")
    similarity = 1.0 / 2.25
    n = 600
    for hashed, columns in ((weighted.rejection_hashes(cells, weighted.rejection_points(spark, 4, n, 200)), ["hash"]), (weighted.consistent_hashes(cells, weighted.consistent_parameters(spark, 4, n)), ["cell_id", "t"])):
        got = {(r["id"], r["table_id"]): tuple(r[c] for c in columns) for r in hashed.collect()}
        equal = sum(got["a", h] == got["b", h] for h in range(n)) / n
        assert abs(equal - similarity) < 4 * math.sqrt(similarity * (1 - similarity) / n)


def test_text_roundtrip(spark):
    s, d = sides(spark)
    done = compare(d, s, 4, minhash.Darts(attempts=600), text_roundtrip=True)
    assert all(r["distance"] == float(f"{r['distance']:.6g}") for r in done.exact.collect()) and done.overall.first()["queries"] == 20


def test_evaluation(spark):
    schema = "query_id string, neighbor_id string, distance double, rank bigint"
    approx = spark.createDataFrame([("q", "a", 0.1, 1), ("q", "b", 0.3, 2), ("r", "c", 0.5, 1)], schema)
    exact = spark.createDataFrame([("q", "a", 0.1, 1), ("q", "x", 0.2, 2), ("q", "y", 0.25, 3), ("r", "d", 0.1, 1), ("s", "e", 0.2, 1)], schema)
    rows = {r["query_id"]: r for r in evaluate.per_query(approx, exact).collect()}
    assert rows.keys() == {"q", "r"} and rows["q"]["precision_at_k"] == 0.5 and rows["q"]["recall_at_k"] == 1 / 3 and rows["q"]["mse"] == 0 and rows["r"]["mse"] is None
    o = evaluate.overall(evaluate.per_query(approx, exact)).first()
    assert (o["queries"], o["mean_precision"], o["mean_mse"], o["false_positive_rate"]) == (2, 0.25, 0, pytest.approx(2 / 3))
    assert evaluate.overall(evaluate.per_query(approx, exact), exact).first()["queries"] == 3
    none = evaluate.overall(evaluate.per_query(approx.limit(0), exact)).first()
    assert none["queries"] == 0 and none["false_positive_rate"] == 0
    found = spark.createDataFrame([(str(i), "n", d, 1) for i, d in enumerate([0.0, 0.1, 0.1, 0.5, 0.9])], schema)
    t = evaluate.top1_stats(found).first()
    assert (t["n"], t["median"], t["p10"], t["n_similar"], t["pct_similar"]) == (5, 0.9, pytest.approx(0.1), 3, 60)
    assert evaluate.top1_stats(found.limit(0)).first()["n"] == 0


def test_sinks(spark, tmp_path):
    values = [0.0, 1.0, 0.5, 1 / 3, 0.000123456789, 0.00001234567, 123456.0, 1234567.0, 0.1234565]
    got = [r["t"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", sinks.six_digits(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got[:8] == [f"{v:.6g}" for v in values[:8]] and abs(float(got[8]) - values[8]) <= 1e-6
    s, d = sides(spark)
    done = compare(d, s, 4, minhash.Darts(attempts=600), count_empty=True)
    sinks.write_results(done.approx, f"file://{tmp_path}/lsh")
    back = {(r["query_id"], r["rank"]): (r["neighbor_id"], r["distance"]) for r in sources.read_results(spark, f"file://{tmp_path}/lsh").collect()}
    assert back == {(r["query_id"], r["rank"]): (r["neighbor_id"], float(f"{r['distance']:.6g}")) for r in done.approx.collect()}
    sinks.write_evaluation(done.by_query, f"file://{tmp_path}/cmp")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/cmp").columns == sinks.EVAL_COLUMNS
    sinks.write_signature_stats(done.stats, f"file://{tmp_path}/bits")
    sinks.write_signature_stats(done.stats, f"file://{tmp_path}/bits")
    assert spark.read.csv(f"file://{tmp_path}/bits").count() == 2 * 600
    sinks.write_query_wkt(done.approx, s, d, f"file://{tmp_path}/wkt")
    assert spark.read.text(f"file://{tmp_path}/wkt").count() == 20 + done.approx.count()
    assert done.overall.first()["mean_mse"] == 0


def test_sketch_covers_the_area(spark):
    _, d = sides(spark)
    box = grid.global_mbr(d).first()
    cell = (box["xmax"] - box["xmin"]) * (box["ymax"] - box["ymin"]) / 625
    from tessera.functions import geometry as g

    got = grid.sketch_cells(d, box).groupBy("id").agg(F.sum("fill").alias("f")).join(d.select("id", g.area(F.col("rings")).alias("a")), "id").collect()
    assert len(got) == 300 and all(abs(r["f"] * cell - r["a"]) < 1e-9 for r in got)
    assert all(len(r["sketch"]) == 625 for r in grid.sketches(d, box).limit(3).collect())
    assert grid.sketch_cells(d, Row(xmin=0.0, ymin=0.0, xmax=0.0, ymax=0.0)).count() == 0


def test_stream(spark, tmp_path):
    from tessera.functions.geometry import to_wkt
    from tessera.streaming import search_stream

    s, d = sides(spark)
    index = search.LshIndex.fit(d, minhash.Darts(attempts=600))
    lines = s.select(F.concat_ws("\t", "id", to_wkt(F.col("rings")), F.lit("")).alias("value"))
    lines.write.text(f"{tmp_path}/in")
    run = search_stream(spark.readStream.text(f"{tmp_path}/in"), index, f"{tmp_path}/out", 3).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.knn(s, 3).collect()))


@pytest.mark.parametrize("name", [*q.QUERIES])
def test_queries_equal_their_sql(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    ours = q.QUERIES[name](spark, SF).toPandas()
    theirs = con.execute(q.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    ours, theirs = (x[sorted(x.columns)].sort_values(sorted(x.columns), ignore_index=True) for x in (ours, theirs))
    assert len(ours) == len(theirs) > 0
    for c in ours.columns:
        assert [*map(str, ours[c].where(ours[c].notna(), None))] == [*map(str, theirs[c].where(theirs[c].notna(), None))], c


@pytest.mark.parametrize("shape", [octagon, ell])
def test_candidates_are_counted_without_their_pairs(spark, shape, monkeypatch):
    s, d = sides(spark, shape)
    index = search.LshIndex.fit(d, minhash.Darts(tables=3, attempts=600))
    want = {}
    for r in index.candidates(s).collect():
        want.setdefault(r["query_id"], []).append(int(r["neighbor_id"]))
    monkeypatch.setattr(search.LshIndex, "candidates", None)
    monkeypatch.setattr(search.LshIndex, "shape_candidates", None)
    got = {r["query_id"]: (r["n"], r["total"]) for r in index.candidate_totals(s, F.col("id")).collect()}
    assert got == {n: (len(v), sum(v)) for n, v in want.items()} and got
