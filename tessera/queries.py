"""The polygon queries by name, over whole tables, and SQL that gives the same rows.

Data polygons are octagons worked out from ``part``, query polygons from ``supplier``.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geometry as g
from tessera.operators import evaluate, grid, minhash, search, sinks, weighted
from tessera.session import fresh_path
from tessera.sources import polygons as sources
from tessera.sources.derived import ell, irregular, octagon, polygons

K = 10
#: Enough points for the smallest octagon: it covers over a twentieth of the box.
DARTS = minhash.Darts(attempts=512)
SIZE = 25
ATTEMPTS = 1024


def _keys(spark: SparkSession, sf: str, table: str, key: str) -> DataFrame:
    """The keys of a table, dealt out to all cores where it has fewer partitions: the work on a polygon is far more than its key."""
    keys = spark.read.parquet(f"{sf}/{table}.parquet").select(key)
    cores = spark.sparkContext.defaultParallelism
    return keys.repartition(cores) if keys.rdd.getNumPartitions() < cores else keys


@cache
def _part(spark: SparkSession, sf: str, shape=octagon) -> DataFrame:
    return polygons(_keys(spark, sf, "part", "p_partkey"), "p_partkey", shape=shape)


@cache
def _supplier(spark: SparkSession, sf: str) -> DataFrame:
    return polygons(_keys(spark, sf, "supplier", "s_suppkey"), "s_suppkey", F.col("s_suppkey") * 31 + 5)


@cache
def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Centred (queries, data)."""
    return search.centred(_supplier(spark, sf)), search.centred(_part(spark, sf))


def _box(spark: SparkSession, sf: str):
    return grid.global_mbr(_sides(spark, sf)[1]).first()


def _index(spark: SparkSession, sf: str) -> search.LshIndex:
    return search.LshIndex.fit(_sides(spark, sf)[1], DARTS)


def scan_polygons(spark, sf):
    """Polygons as lines of text, read again."""
    lines = _part(spark, sf).select(F.concat_ws("\t", "id", g.to_wkt(F.col("rings")), F.lit("tail")).alias("value"))
    read, _ = sources.polygons_of_lines(lines)
    return read.select("id", F.size(F.get("rings", F.lit(0))["pts"]).cast("bigint").alias("n_points"), g.area(F.col("rings")).alias("area"), F.col("n_parts").cast("bigint").alias("n_parts"))


def center_polygon(spark, sf):
    p = search.centred(_part(spark, sf)).select("id", g.exterior(F.col("rings")).alias("p"))
    return p.select("id", F.posexplode("p").alias("i", "q")).select("id", F.col("i").cast("bigint").alias("i"), "q.x", "q.y")


def polygon_area(spark, sf):
    table = spark.read.parquet(f"{sf}/part.parquet")
    with_hole = polygons(table, "p_partkey", shape=lambda k: octagon(k, hole=True)).select("id", g.area(F.col("rings")).alias("area_with_hole"))
    return _part(spark, sf).select("id", g.area(F.col("rings")).alias("area")).join(with_hole, "id")


def polygon_centroid(spark, sf):
    c = _part(spark, sf, ell).select("id", g.centroid(F.col("rings")).alias("c"))
    return c.select("id", F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


def polygon_mbr(spark, sf):
    return _part(spark, sf).select("id", g.mbr(F.col("rings")).alias("b")).select("id", "b.*")


def global_mbr(spark, sf):
    return grid.global_mbr(_sides(spark, sf)[1])


def grid_cells(spark, sf):
    return grid.grid_cells(spark, _box(spark, sf), SIZE)


def fill_ratio(spark, sf):
    """Part of each polygon's own lower left quarter box that it covers."""
    p = _part(spark, sf).select("id", g.edges(F.col("rings")).alias("e"), g.mbr(F.col("rings")).alias("b"))
    b = F.col("b")
    quarter = F.struct(b["xmin"].alias("xmin"), b["ymin"].alias("ymin"), ((b["xmin"] + b["xmax"]) / 2).alias("xmax"), ((b["ymin"] + b["ymax"]) / 2).alias("ymax"))
    return p.select("id", F.round(grid.fill_ratio(F.col("e"), quarter) + 1e-9, 6).alias("fill"))


def sketch(spark, sf):
    return grid.sketch_cells(_sides(spark, sf)[1], _box(spark, sf), SIZE).select("id", "cell_id", F.round(F.col("fill") + 1e-9, 6).alias("fill")).filter("fill > 0")


def occupied_cells(spark, sf):
    cells = grid.occupied_cells(_sides(spark, sf)[1], _box(spark, sf), SIZE)
    return cells.select("id", F.size("cells").cast("bigint").alias("n_cells"), F.array_min("cells").alias("first_cell"), F.array_max("cells").alias("last_cell"))


def _sketch_pairs(spark, sf):
    q, d = _sides(spark, sf)
    box = _box(spark, sf)
    a, b = grid.sketches(d, box, 8), grid.sketches(q, box, 8)
    return a.join(b.select("id", F.col("sketch").alias("other")), "id")


def sketch_jaccard(spark, sf):
    return _sketch_pairs(spark, sf).select("id", F.round(g.sketch_jaccard(F.col("sketch"), F.col("other")) + 1e-9, 6).alias("distance"))


def sketch_join_distance(spark, sf):
    return _sketch_pairs(spark, sf).select("id", F.round(g.sketch_join_distance(F.col("sketch"), F.col("other")) + 1e-9, 6).alias("distance"))


def point_in_polygon(spark, sf):
    """Whether each polygon holds a point that depends on its key."""
    p = search.centred(_part(spark, sf)).withColumn("k", F.col("id").cast("bigint"))
    x, y = (F.col("k") * 13 % 41) / 4 - 5, (F.col("k") * 29 % 43) / 4 - 5.125
    return p.select("id", g.contains(g.exterior(F.col("rings")), x, y).alias("inside"))


def jaccard_distance(spark, sf):
    """Distance of the data and the query polygon of the same id."""
    q, d = _sides(spark, sf)
    e = F.col("rings")
    a = d.select("id", g.edges(e).alias("ea"), g.area(e).alias("aa"))
    b = q.select("id", g.edges(e).alias("eb"), g.area(e).alias("ab"))
    return a.join(b, "id").select("id", g.jaccard_distance(g.overlap_area(F.col("ea"), F.col("eb")), F.col("aa"), F.col("ab")).alias("distance"))


def polygon_coordinates(spark, sf):
    """The outer ring's points as they are given."""
    p = _part(spark, sf).select("id", F.posexplode(g.exterior(F.col("rings"))).alias("i", "q"))
    return p.select("id", F.col("i").cast("bigint").alias("i"), "q.x", "q.y")


def similarity(spark, sf):
    """1 - distance of each found neighbour."""
    return lsh_knn(spark, sf).select("query_id", "neighbor_id", (1 - F.col("distance")).alias("similarity"))


def sketch_minhash(spark, sf):
    """First draws below the sketch, on a grid of 8 x 8 cells."""
    cells = grid.sketch_cells(_sides(spark, sf)[1], _box(spark, sf), 8)
    return weighted.rejection_hashes(cells, weighted.rejection_points(spark, 64, attempts=ATTEMPTS)).withColumn("table_id", F.col("table_id").cast("bigint"))


def consistent_minhash(spark, sf):
    cells = grid.sketch_cells(_sides(spark, sf)[1], _box(spark, sf), 8)
    return weighted.consistent_hashes(cells, weighted.consistent_parameters(spark, 64)).withColumn("table_id", F.col("table_id").cast("bigint"))


def darts(spark, sf):
    return minhash.darts_table(spark, _box(spark, sf), DARTS)


def minhash_signatures(spark, sf):
    signed = minhash.signatures(_sides(spark, sf)[1], _box(spark, sf), DARTS)
    return signed.select("id", F.col("table_id").cast("bigint").alias("table_id"), F.get("hash", F.lit(0)).alias("hash0"))


def minhash_by_cells(spark, sf):
    signed = minhash.signatures_by_cells(_sides(spark, sf)[1], _box(spark, sf), DARTS)
    return signed.select("id", F.col("table_id").cast("bigint").alias("table_id"), F.get("hash", F.lit(0)).alias("hash0"))


def signature_stats(spark, sf):
    d, box = _sides(spark, sf)[1], _box(spark, sf)
    return minhash.signature_stats(d, minhash.signatures(d, box, DARTS), box).withColumn("table_id", F.col("table_id").cast("bigint"))


def lsh_buckets(spark, sf):
    b = _index(spark, sf).buckets().select(F.col("table_id").cast("bigint").alias("table_id"), F.get("hash", F.lit(0)).alias("hash0"), "id")
    return b


def bucket_contents(spark, sf):
    """Each bucket with its ids in order."""
    b = lsh_buckets(spark, sf).groupBy("table_id", "hash0").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    return b.select("table_id", "hash0", F.array_join("ids", ",").alias("ids"))


def bucket_sizes(spark, sf):
    return _index(spark, sf).bucket_sizes().select(F.col("table_id").cast("bigint").alias("table_id"), F.get("hash", F.lit(0)).alias("hash0"), "size")


def lsh_candidates(spark, sf):
    """How many candidates each query has, and their ids' sum."""
    return _index(spark, sf).candidate_totals(_sides(spark, sf)[0], F.col("id")).withColumnRenamed("total", "id_sum")


def lsh_knn(spark, sf):
    return _index(spark, sf).knn(_sides(spark, sf)[0], K)


def bf_knn(spark, sf):
    q, d = _sides(spark, sf)
    return search.exact_knn(q, d, K)


def pruning_ratio(spark, sf):
    return _index(spark, sf).pruning(_sides(spark, sf)[0])


def top1_stats(spark, sf):
    t = evaluate.top1_stats(lsh_knn(spark, sf))
    return t.select("n", F.round("mean", 9).alias("mean"), "median", "p10", "p90", "n_similar", F.round("pct_similar", 9).alias("pct_similar"))


def eval_per_query(spark, sf):
    return evaluate.per_query(lsh_knn(spark, sf), bf_knn(spark, sf))


def eval_global(spark, sf):
    e = evaluate.overall(eval_per_query(spark, sf))
    return e.withColumns({c: F.round(c, 9) for c in ("mean_precision", "mean_recall", "mean_mse", "false_positive_rate")})


def eval_global_all(spark, sf):
    """With queries that found nothing counted as zeros."""
    exact = bf_knn(spark, sf)
    e = evaluate.overall(evaluate.per_query(lsh_knn(spark, sf), exact), exact)
    return e.withColumns({c: F.round(c, 9) for c in ("mean_precision", "mean_recall", "mean_mse", "false_positive_rate")})


def result_text_roundtrip(spark, sf):
    return sources.parse_results(sinks.result_blocks(lsh_knn(spark, sf)))


# --- shapes that are all different: concave, with holes, in two parts

#: Longer signatures than the fixed values: few pairs meet.
FINE = minhash.Darts(tables=2, length=4, attempts=1024)


@cache
def _irregular(spark, sf):
    """Centred (queries, data)."""
    data = polygons(_keys(spark, sf, "part", "p_partkey"), "p_partkey", shape=irregular)
    asked = polygons(_keys(spark, sf, "supplier", "s_suppkey"), "s_suppkey", F.col("s_suppkey") * 31 + 5, shape=irregular)
    return search.centred(asked), search.centred(data)


def irregular_shapes(spark, sf):
    """Areas and parts, and the box as a polygon."""
    e = F.col("rings")
    d = _irregular(spark, sf)[1].select("id", F.round(g.area(e), 9).alias("area"), F.col("n_parts").cast("bigint").alias("n_parts"), g.box_polygon(g.mbr(e)).alias("box"))
    return d.select("id", "area", "n_parts", F.round(g.area(F.col("box")), 9).alias("box_area"), F.size(g.exterior(F.col("box"))).cast("bigint").alias("box_points"))


def _near(found):
    return found.select("query_id", "neighbor_id", F.round(F.col("distance") + 1e-9, 6).alias("distance"), "rank")


def irregular_bf_knn(spark, sf):
    """Exact search; polygons in several parts count."""
    return _near(search.exact_knn(*_irregular(spark, sf), K))


def _fine_index(spark, sf):
    return search.LshIndex.fit(_irregular(spark, sf)[1], FINE)


def irregular_lsh_knn(spark, sf):
    """Search through signatures of outer rings; polygons in several parts aren't in the index."""
    return _near(_fine_index(spark, sf).knn(_irregular(spark, sf)[0], K))


def irregular_pruning(spark, sf):
    return _fine_index(spark, sf).pruning(_irregular(spark, sf)[0])


def irregular_excluded(spark, sf):
    """How many polygons have no signature."""
    return _fine_index(spark, sf).excluded(_irregular(spark, sf)[0])


# --- readers and sinks, by way of files in the shared folder


def _line(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _mixed_lines(spark, sf):
    """Lines by the key modulo 8: a square, a point, two polygons, broken text, one tab, none, an empty line, a ring without area."""
    k = F.col("p_partkey") + 1
    square = _line("POLYGON ((0 0, ", k, " 0, ", k, " ", k, ", 0 ", k, ", 0 0))")
    forms = [_line(k, "\t", square, "\tx"), _line(k, "\tPOINT (", k, " 1)\tx"), _line(k, "\tMULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))\t"), _line(k, "\tPOLYGON ((0 0, ", k, "\tx"), _line(k, "\t", square), _line(k, " ", square), F.lit(""), _line(k, "\tPOLYGON ((0 0, 1 1, 2 2, 0 0))\tx")]
    value = forms[-1]
    for i, form in enumerate(forms[:-1]):
        value = F.when(k % 8 == i, form).otherwise(value)
    return spark.read.parquet(f"{sf}/part.parquet").select(value.alias("value"))


def rejected_lines(spark, sf):
    _, rejects = sources.polygons_of_lines(_mixed_lines(spark, sf))
    return rejects.select("line", F.substring_index("reason", ":", 1).alias("reason"))


def last_line_wins(spark, sf):
    """Lines of a file with a hundred ids, dealt out before they are read."""
    k = F.col("p_partkey")
    lines = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", _line(k % 100, "\tPOLYGON ((0 0, ", k, " 0, ", k, " 1, 0 1, 0 0))\tx").alias("value"))
    path = fresh_path(spark, "lines")
    lines.orderBy("p_partkey").select("value").write.text(path)
    read, _ = sources.read_wkt_with_id(spark, path, partitions=7)
    return read.select("id", g.area(F.col("rings")).alias("area"))


def repaired_polygons(spark, sf):
    """By the key modulo 4 a square, a bow tie, a square with a spike, and a square whose hole reaches out of it."""
    k = F.col("p_partkey") + 1
    forms = [_line("((0 0, ", k, " 0, ", k, " ", k, ", 0 ", k, ", 0 0))"), _line("((0 0, ", k, " ", k, ", ", k, " 0, 0 ", k, ", 0 0))"), _line("((0 0, ", k, " 0, ", k, " ", k, ", ", k, " ", k + 5, ", ", k, " ", k, ", 0 ", k, ", 0 0))"), _line("((0 0, ", 4 * k, " 0, ", 4 * k, " ", 4 * k, ", 0 ", 4 * k, ", 0 0), (", 3 * k, " ", k, ", ", 5 * k, " ", k, ", ", 5 * k, " ", 2 * k, ", ", 3 * k, " ", 2 * k, ", ", 3 * k, " ", k, "))")]
    value = forms[-1]
    for i, form in enumerate(forms[:-1]):
        value = F.when(k % 4 == i, form).otherwise(value)
    lines = spark.read.parquet(f"{sf}/part.parquet").select(_line(k, "\tPOLYGON ", value, "\t").alias("value"))
    read, _ = sources.polygons_of_lines(lines)
    return read.select("id", g.area(F.col("rings")).alias("area"), F.col("n_parts").cast("bigint").alias("n_parts"), "repaired")


def _shape_sums(read):
    """Polygons of a reader without ids, by their areas."""
    return read.groupBy(F.round(g.area(F.col("rings")), 6).alias("area")).agg(F.count("*").alias("n"))


def header_tsv(spark, sf):
    path = fresh_path(spark, "header")
    _part(spark, sf).select(g.to_wkt(F.col("rings")).alias("wkt"), "id").write.option("sep", "\t").option("header", True).csv(path)
    return _shape_sums(sources.read_header_tsv(spark, path)[0])


def plain_wkt(spark, sf):
    path = fresh_path(spark, "wkt")
    _part(spark, sf).select(g.to_wkt(F.col("rings"))).write.text(path)
    return _shape_sums(sources.read_wkt(spark, path, partitions=5)[0])


def geojson(spark, sf):
    """A feature on each line, every other one with its id among the properties."""
    pts = F.transform(g.exterior(F.col("rings")), lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(pts).alias("coordinates"))
    even = F.col("id").cast("bigint") % 2 == 0
    feature = F.struct(F.lit("Feature").alias("type"), F.when(even, F.col("id")).alias("id"), F.struct(F.when(~even, F.col("id")).alias("id")).alias("properties"), shape.alias("geometry"))
    path = fresh_path(spark, "geojson")
    _part(spark, sf).select(F.to_json(feature)).write.text(path)
    return sources.read_geojson(spark, path, by_line=True)[0].select("id", g.area(F.col("rings")).alias("area"))


def result_files(spark, sf):
    """Result text written to files, which are there then, and read again."""
    path = fresh_path(spark, "results")
    sinks.write_results(bf_knn(spark, sf), path)
    there = sources.path_exists(spark, path) and not sources.path_exists(spark, f"{path}-not")
    return sources.read_results(spark, path).withColumn("there", F.lit(there))


def comparison_csv(spark, sf):
    path = fresh_path(spark, "comparison")
    sinks.write_evaluation(eval_per_query(spark, sf), path)
    back = spark.read.option("header", True).csv(path)
    counts = {c for c in sinks.EVAL_COLUMNS if c.startswith("total")}
    return back.select("query_id", *(F.col(c).cast("bigint" if c in counts else "double").alias(c) for c in sinks.EVAL_COLUMNS[1:]))


def query_wkt(spark, sf):
    """Geometries of each query and its neighbours, written by query and read again."""
    q, d = _sides(spark, sf)
    path = fresh_path(spark, "query-wkt")
    sinks.write_query_wkt(bf_knn(spark, sf), q, d, path)
    back = spark.read.text(path).select(F.col("query_id").cast("string").alias("query_id"), F.substring_index("value", "\t", -1).alias("wkt"), F.col("value").startswith("query").alias("own"))
    read = sources.parse_geometry(back)
    return read.groupBy("query_id").agg(F.count("*").alias("n"), F.count_if("own").alias("n_own"), F.sum(g.area(F.col("rings"))).alias("area"))


QUERIES = {f.__name__: f for f in (scan_polygons, center_polygon, polygon_area, polygon_centroid, polygon_mbr, global_mbr, grid_cells, fill_ratio, sketch, occupied_cells, sketch_jaccard, sketch_join_distance, point_in_polygon, jaccard_distance, polygon_coordinates, similarity, sketch_minhash, consistent_minhash, darts, minhash_signatures, minhash_by_cells, signature_stats, lsh_buckets, bucket_contents, bucket_sizes, lsh_candidates, lsh_knn, bf_knn, pruning_ratio, top1_stats, eval_per_query, eval_global, eval_global_all, result_text_roundtrip, irregular_shapes, irregular_bf_knn, irregular_lsh_knn, irregular_pruning, irregular_excluded, rejected_lines, last_line_wins, repaired_polygons, header_tsv, plain_wkt, geojson, result_files, comparison_csv, query_wkt)}


# --- SQL -----------------------------------------------------------------------------------------

_CORNERS = [("a - c", "-b"), ("a", "-(b - c)"), ("a", "b - c"), ("a - c", "b"), ("-(a - c)", "b"), ("-a", "b - c"), ("-a", "-(b - c)"), ("-(a - c)", "-b")]


def _octagons(name: str, table: str, key: str, number: str) -> str:
    """CTEs {name} (id, k, a, b, c, area, cx, cy) and {name}_v (id, i, x, y): vertices 1 to 8 around the centre."""
    lists = (", ".join(v[i] for v in _CORNERS) for i in (0, 1))
    xs, ys = lists
    return f"""{name} AS (SELECT *, 4.0E0 * a * b - 2.0E0 * c * c AS area FROM (SELECT CAST({key} AS VARCHAR) AS id, k, 1.0E0 + CAST(k * 7 % 13 AS DOUBLE) / 4.0E0 AS a, 1.0E0 + CAST(k * 11 % 17 AS DOUBLE) / 4.0E0 AS b, 0.25E0 + CAST(k * 5 % 3 AS DOUBLE) / 4.0E0 AS c, CAST(k * 3 % 101 AS DOUBLE) AS cx, CAST(k % 97 AS DOUBLE) AS cy FROM (SELECT {key}, {number} AS k FROM {table}))),
{name}_v AS (SELECT id, cx, cy, generate_subscripts([{xs}], 1) AS i, unnest([{xs}]) AS x, unnest([{ys}]) AS y FROM {name}),
{name}_s AS (SELECT p.id, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM {name}_v p JOIN {name}_v q ON p.id = q.id AND q.i = p.i % 8 + 1),
{name}_e AS (SELECT id, least(x0, x1) AS l, greatest(x0, x1) AS r, CASE WHEN x0 < x1 THEN y0 ELSE y1 END AS yl, CASE WHEN x0 < x1 THEN y1 ELSE y0 END AS yr, sign(x0 - x1) AS s FROM {name}_s WHERE x0 <> x1)"""


_PART = _octagons("d", "part", "p_partkey", "p_partkey")
_SUPP = _octagons("q", "supplier", "s_suppkey", "s_suppkey * 31 + 5")
_BOX = "box AS (SELECT min(-a) AS xmin, min(-b) AS ymin, max(a) AS xmax, max(b) AS ymax FROM d)"


def _overlap(pairs: str, name: str = "o") -> str:
    """CTE {name} (ka, kb, area): overlap of the edges in ``pairs`` (ka, kb, l1, yl1, r1, yr1, s1, l2, ...)."""
    return f"""{name}_w AS (SELECT *, greatest(l1, l2) AS lo, least(r1, r2) AS hi FROM ({pairs}) WHERE greatest(l1, l2) < least(r1, r2)),
{name}_h AS (SELECT ka, kb, s1 * s2 AS s, hi - lo AS w, yl1 + (yr1 - yl1) / (r1 - l1) * (lo - l1) AS a0, yl1 + (yr1 - yl1) / (r1 - l1) * (hi - l1) AS a1, yl2 + (yr2 - yl2) / (r2 - l2) * (lo - l2) AS b0, yl2 + (yr2 - yl2) / (r2 - l2) * (hi - l2) AS b1 FROM {name}_w),
{name} AS (SELECT ka, kb, sum(s * (w * (a0 + a1) / 2 - CASE WHEN a0 >= b0 AND a1 >= b1 THEN w * (a0 - b0 + a1 - b1) / 2 WHEN a0 <= b0 AND a1 <= b1 THEN 0.0E0 ELSE w * greatest(a0 - b0, a1 - b1) * greatest(a0 - b0, a1 - b1) / (2 * (abs(a0 - b0) + abs(a1 - b1))) END)) AS area FROM {name}_h GROUP BY ka, kb)"""


_EDGE_PAIR = "a.l AS l1, a.yl AS yl1, a.r AS r1, a.yr AS yr1, a.s AS s1, b.l AS l2, b.yl AS yl2, b.r AS r2, b.yr AS yr2, b.s AS s2"
#: Distances of all pairs of shapes, then of ids: many ids share a shape.
_PAIRS = f"""{_PART}, {_SUPP}, ds AS (SELECT a, b, c, area, min(id) AS id FROM d GROUP BY a, b, c, area), qs AS (SELECT a, b, c, area, min(id) AS id FROM q GROUP BY a, b, c, area),
{_overlap(f"SELECT a.id AS ka, b.id AS kb, {_EDGE_PAIR} FROM (SELECT * FROM q_e WHERE id IN (SELECT id FROM qs)) a, (SELECT * FROM d_e WHERE id IN (SELECT id FROM ds)) b")},
sp AS (SELECT qs.a AS qa, qs.b AS qb, qs.c AS qc, ds.a, ds.b, ds.c, 1.0E0 - coalesce(o.area, 0) / (qs.area + ds.area - coalesce(o.area, 0)) AS distance FROM qs CROSS JOIN ds LEFT JOIN o ON o.ka = qs.id AND o.kb = ds.id),
alld AS (SELECT q.id AS query_id, d.id AS neighbor_id, sp.distance FROM sp JOIN q ON q.a = qa AND q.b = qb AND q.c = qc JOIN d ON d.a = sp.a AND d.b = sp.b AND d.c = sp.c)"""
_RANK = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS BIGINT) AS rank"


@cache
def _darts_sql(darts: minhash.Darts = DARTS, box: str = _BOX) -> str:
    """CTEs u (table_id, pos, attempt, u, v) and t, the same points in the box."""
    rows = []
    for h in range(darts.tables):
        for i in range(darts.length):
            rows += [f"({h}, {i}, {n}, CAST('{u!r}' AS DOUBLE), CAST('{v!r}' AS DOUBLE))" for n, (u, v) in enumerate(zip(*(x.tolist() for x in darts.unit(h, i)), strict=True), 1)]
    return f"u AS (SELECT * FROM (VALUES {', '.join(rows)}) x(table_id, pos, attempt, u, v)), {box}, t AS (SELECT CAST(table_id AS INTEGER) AS table_id, CAST(pos AS INTEGER) AS pos, CAST(attempt AS BIGINT) AS attempt, u * (xmax - xmin) + xmin AS x, v * (ymax - ymin) + ymin AS y FROM u, box)"


def _hashes(side: str) -> str:
    """CTE {side}_m (id, table_id, hash0)."""
    return f"""{side}_m AS (SELECT id, table_id, min(attempt) AS hash0 FROM (SELECT e.id, t.table_id, t.attempt FROM (SELECT * FROM {side}_s WHERE y0 <> y1) e JOIN t ON (e.y0 > t.y) <> (e.y1 > t.y) AND t.x < (e.x1 - e.x0) * (t.y - e.y0) / (e.y1 - e.y0) + e.x0 GROUP BY e.id, t.table_id, t.attempt HAVING count(*) % 2 = 1) GROUP BY id, table_id)"""


def _grid(size: int) -> str:
    return f"g AS (SELECT CAST(i AS BIGINT) AS cell_id, CAST(i // {size} AS BIGINT) AS r, CAST(i % {size} AS BIGINT) AS c, b.xmin + (i % {size}) * ((b.xmax - b.xmin) / {size}) AS xmin, b.ymin + (i // {size}) * ((b.ymax - b.ymin) / {size}) AS ymin, b.xmin + (i % {size}) * ((b.xmax - b.xmin) / {size}) + (b.xmax - b.xmin) / {size} AS xmax, b.ymin + (i // {size}) * ((b.ymax - b.ymin) / {size}) + (b.ymax - b.ymin) / {size} AS ymax FROM range({size * size}) x(i), box b)"


def _fills(side: str, size: int) -> str:
    """CTE {side}_f (id, cell_id, fill)."""
    box = "SELECT cell_id, xmin AS l, ymin AS yl, xmax AS r, ymin AS yr, -1.0E0 AS s FROM g UNION ALL SELECT cell_id, xmin, ymax, xmax, ymax, 1.0E0 FROM g"
    name = f"{side}_o"
    return f"""{_overlap(f"SELECT a.id AS ka, b.cell_id AS kb, {_EDGE_PAIR} FROM {side}_e a, ({box}) b", name)}, {side}_f AS (SELECT ka AS id, kb AS cell_id, area / ((g.xmax - g.xmin) * (g.ymax - g.ymin)) AS fill FROM {name} JOIN g ON g.cell_id = kb)"""


def _knn() -> str:
    """CTEs of both searches: lsh and bf (query_id, neighbor_id, distance, rank)."""
    return f"""{_PAIRS}, {_darts_sql()}, {_hashes("d")}, {_hashes("q")}, cand AS (SELECT DISTINCT q_m.id AS query_id, d_m.id AS neighbor_id FROM q_m JOIN d_m USING (table_id, hash0)),
lsh AS (SELECT * FROM (SELECT query_id, neighbor_id, distance, {_RANK} FROM cand JOIN alld USING (query_id, neighbor_id)) WHERE rank <= {K}),
bf AS (SELECT * FROM (SELECT *, {_RANK} FROM alld) WHERE rank <= {K}),
per AS (SELECT query_id, count(*) AS n, count(bf.distance) AS m, avg((lsh.distance - bf.distance) * (lsh.distance - bf.distance)) AS mse FROM lsh LEFT JOIN bf USING (query_id, neighbor_id) GROUP BY query_id),
ev AS (SELECT query_id, CAST(m AS DOUBLE) / n AS precision_at_k, CAST(m AS DOUBLE) / nb AS recall_at_k, CAST(m AS DOUBLE) / n AS avg_recall, mse, CAST(n - m AS DOUBLE) / n AS false_positive_rate, n AS total_lsh_neighbors, nb AS total_bf_neighbors, m AS total_matched_neighbors FROM per JOIN (SELECT query_id, count(*) AS nb FROM bf GROUP BY query_id) USING (query_id))"""


_OVERALL = """SELECT count(*) AS queries, round(avg(coalesce(precision_at_k, 0)), 9) AS mean_precision, round(avg(coalesce(recall_at_k, 0)), 9) AS mean_recall, round(avg(coalesce(mse, 0)), 9) AS mean_mse, CAST(sum(coalesce(total_lsh_neighbors, 0)) AS BIGINT) AS total_lsh_neighbors, CAST(sum(total_bf_neighbors) AS BIGINT) AS total_bf_neighbors, CAST(sum(coalesce(total_matched_neighbors, 0)) AS BIGINT) AS total_matched_neighbors, round(CAST(sum(coalesce(total_lsh_neighbors - total_matched_neighbors, 0)) AS DOUBLE) / sum(coalesce(total_lsh_neighbors, 0)), 9) AS false_positive_rate FROM """
_SKETCH_PAIR = f"WITH {_PART}, {_SUPP}, {_BOX}, {_grid(8)}, {_fills('d', 8)}, {_fills('q', 8)}, pairs AS (SELECT d.id, coalesce(x.fill, 0) AS a, coalesce(y.fill, 0) AS b FROM d JOIN q ON d.id = q.id CROSS JOIN g LEFT JOIN d_f x ON x.id = d.id AND x.cell_id = g.cell_id LEFT JOIN q_f y ON y.id = q.id AND y.cell_id = g.cell_id) "
_SIGNED = f"WITH {_PART}, {_darts_sql()}, {_hashes('d')} "

@cache
def _rejection_sql() -> str:
    rows = []
    for h in range(2):
        rng = np.random.RandomState(100 + h)
        draws = zip(rng.randint(0, 64, ATTEMPTS).tolist(), rng.random_sample(ATTEMPTS).tolist(), strict=True)
        rows += [f"({h}, {n}, {c}, CAST('{u!r}' AS DOUBLE))" for n, (c, u) in enumerate(draws, 1)]
    return f"x AS (SELECT * FROM (VALUES {', '.join(rows)}) v(table_id, attempt, cell_id, u))"


@cache
def _consistent_sql() -> str:
    rng = np.random.RandomState(100)
    r, c, beta = rng.gamma(2, 1, (2, 64)).tolist(), rng.gamma(2, 1, (2, 64)).tolist(), rng.random_sample((2, 64)).tolist()
    rows = [f"({h}, {i}, CAST('{r[h][i]!r}' AS DOUBLE), CAST('{c[h][i]!r}' AS DOUBLE), CAST('{beta[h][i]!r}' AS DOUBLE))" for h in range(2) for i in range(64)]
    return f"x AS (SELECT * FROM (VALUES {', '.join(rows)}) v(table_id, cell_id, r, c, beta))"


_FILLED = f"WITH {_PART}, {_BOX}, {_grid(8)}, {_fills('d', 8)}"

ORACLE_SQL = {
    "polygon_coordinates": f"WITH {_PART} SELECT id, CAST(i - 1 AS BIGINT) AS i, cx + x AS x, cy + y AS y FROM d_v UNION ALL SELECT id, 8, cx + x, cy + y FROM d_v WHERE i = 1",
    "similarity": f"WITH {_knn()} SELECT query_id, neighbor_id, 1.0E0 - distance AS similarity FROM lsh",
    "sketch_minhash": f"{_FILLED}, {_rejection_sql()} SELECT id, CAST(table_id AS BIGINT) AS table_id, CAST(min(attempt) AS BIGINT) AS hash FROM d_f JOIN x USING (cell_id) WHERE fill > 1e-12 AND u < fill GROUP BY id, table_id",
    "consistent_minhash": f"{_FILLED}, {_consistent_sql()}, y AS (SELECT id, table_id, cell_id, CAST(floor(ln(fill) / r + beta) AS BIGINT) AS t, r, c, beta FROM d_f JOIN x USING (cell_id) WHERE fill > 1e-12) SELECT id, CAST(table_id AS BIGINT) AS table_id, arg_min(cell_id, ln(c) - r * (t - beta) - r) AS cell_id, arg_min(t, ln(c) - r * (t - beta) - r) AS t FROM y GROUP BY id, table_id",
    "bucket_contents": _SIGNED + "SELECT CAST(table_id AS BIGINT) AS table_id, hash0, string_agg(id, ',' ORDER BY id) AS ids FROM d_m GROUP BY table_id, hash0",
    "scan_polygons": f"WITH {_PART} SELECT id, CAST(9 AS BIGINT) AS n_points, area, CAST(1 AS BIGINT) AS n_parts FROM d",
    "center_polygon": f"WITH {_PART} SELECT id, CAST(i - 1 AS BIGINT) AS i, x, y FROM d_v UNION ALL SELECT id, 8, x, y FROM d_v WHERE i = 1",
    "polygon_area": f"WITH {_PART} SELECT id, area, area - 0.25E0 AS area_with_hole FROM d",
    "polygon_centroid": "WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS id, 1.0E0 + CAST(p_partkey * 7 % 13 AS DOUBLE) / 4 AS w, 1.0E0 + CAST(p_partkey * 11 % 17 AS DOUBLE) / 4 AS h FROM part) SELECT id, round((2 * w * h * w + w * h * w / 2) / (3 * w * h), 6) AS x, round((2 * w * h * h / 2 + w * h * 1.5E0 * h) / (3 * w * h), 6) AS y FROM s",
    "polygon_mbr": f"WITH {_PART} SELECT id, cx - a AS xmin, cy - b AS ymin, cx + a AS xmax, cy + b AS ymax FROM d",
    "global_mbr": f"WITH {_PART}, {_BOX} SELECT * FROM box",
    "grid_cells": f"WITH {_PART}, {_BOX}, {_grid(SIZE)} SELECT * FROM g",
    "fill_ratio": f"WITH {_PART} SELECT id, round((a * b - c * c / 2) / (a * b) + 1e-9, 6) AS fill FROM d",
    "sketch": f"WITH {_PART}, {_BOX}, {_grid(SIZE)}, {_fills('d', SIZE)} SELECT id, cell_id, round(fill + 1e-9, 6) AS fill FROM d_f WHERE fill > 1e-12 AND round(fill + 1e-9, 6) > 0",
    "occupied_cells": f"WITH {_PART}, {_BOX}, {_grid(SIZE)}, {_fills('d', SIZE)} SELECT id, count(*) AS n_cells, min(cell_id) AS first_cell, max(cell_id) AS last_cell FROM d_f WHERE fill > 1e-12 GROUP BY id",
    "sketch_jaccard": _SKETCH_PAIR + "SELECT id, round(CASE WHEN sum(greatest(a, b)) = 0 THEN 1 ELSE 1 - sum(least(a, b)) / sum(greatest(a, b)) END + 1e-9, 6) AS distance FROM pairs GROUP BY id",
    "sketch_join_distance": _SKETCH_PAIR + "SELECT id, round(CASE WHEN sum(a + b) - sum(a * b) = 0 THEN 1 ELSE 1 - sum(a * b) / (sum(a + b) - sum(a * b)) END + 1e-9, 6) AS distance FROM pairs GROUP BY id",
    "point_in_polygon": f"WITH {_PART}, p AS (SELECT id, CAST(k * 13 % 41 AS DOUBLE) / 4 - 5 AS x, CAST(k * 29 % 43 AS DOUBLE) / 4 - 5.125E0 AS y FROM d), n AS (SELECT e.id, count(*) AS n FROM d_s e JOIN p ON p.id = e.id AND e.y0 <> e.y1 AND (e.y0 > p.y) <> (e.y1 > p.y) AND p.x < (e.x1 - e.x0) * (p.y - e.y0) / (e.y1 - e.y0) + e.x0 GROUP BY e.id) SELECT p.id, coalesce(n % 2 = 1, FALSE) AS inside FROM p LEFT JOIN n ON n.id = p.id",
    "jaccard_distance": f"WITH {_PART}, {_SUPP}, {_overlap(f'SELECT a.id AS ka, b.id AS kb, {_EDGE_PAIR} FROM d_e a JOIN q_e b ON a.id = b.id')} SELECT d.id, 1.0E0 - coalesce(o.area, 0) / (d.area + q.area - coalesce(o.area, 0)) AS distance FROM d JOIN q ON d.id = q.id LEFT JOIN o ON o.ka = d.id",
    "darts": f"WITH {_PART}, {_darts_sql()} SELECT * FROM t",
    "minhash_signatures": _SIGNED + "SELECT id, CAST(table_id AS BIGINT) AS table_id, hash0 FROM d_m",
    "signature_stats": _SIGNED + "SELECT m.id, CAST(table_id AS BIGINT) AS table_id, d.area / ((xmax - xmin) * (ymax - ymin)) AS sparsity, CAST(CASE WHEN hash0 > 0 THEN ceil(log2(hash0 + 1)) ELSE 1 END AS BIGINT) AS total_bits FROM d_m m JOIN d ON d.id = m.id, box",
    "bucket_sizes": _SIGNED + "SELECT CAST(table_id AS BIGINT) AS table_id, hash0, count(*) AS size FROM d_m GROUP BY table_id, hash0",
    "lsh_candidates": f"WITH {_PART}, {_SUPP}, {_darts_sql()}, {_hashes('d')}, {_hashes('q')}, cand AS (SELECT DISTINCT q_m.id AS query_id, d_m.id AS neighbor_id FROM q_m JOIN d_m USING (table_id, hash0)) SELECT query_id, count(*) AS n, CAST(sum(CAST(neighbor_id AS BIGINT)) AS BIGINT) AS id_sum FROM cand GROUP BY query_id",
    "lsh_knn": f"WITH {_knn()} SELECT * FROM lsh",
    "bf_knn": f"WITH {_PAIRS} SELECT * FROM (SELECT *, {_RANK} FROM alld) WHERE rank <= {K}",
    "pruning_ratio": f"WITH {_knn()}, n AS (SELECT (SELECT count(*) FROM cand) AS refined, (SELECT count(*) FROM q) * (SELECT count(*) FROM d) AS possible) SELECT refined, possible, 100.0E0 * (1 - CAST(refined AS DOUBLE) / possible) AS pruned_pct FROM n",
    "top1_stats": f"WITH {_knn()}, s AS (SELECT 1.0E0 - distance AS s FROM lsh WHERE rank = 1), l AS (SELECT list(s ORDER BY s) AS l, count(*) AS n, avg(s) AS mean, count(*) FILTER (WHERE s >= 0.8E0) AS c FROM s) SELECT n, round(mean, 9) AS mean, l[n // 2 + 1] AS median, l[n // 10 + 1] AS p10, l[9 * n // 10 + 1] AS p90, c AS n_similar, round(100.0E0 * c / n, 9) AS pct_similar FROM l",
    "eval_per_query": f"WITH {_knn()} SELECT * FROM ev",
    "eval_global": f"WITH {_knn()} {_OVERALL} ev",
    "eval_global_all": f"WITH {_knn()}, x AS (SELECT b.query_id, precision_at_k, recall_at_k, mse, total_lsh_neighbors, b.n AS total_bf_neighbors, total_matched_neighbors FROM (SELECT query_id, count(*) AS n FROM bf GROUP BY query_id) b LEFT JOIN ev USING (query_id)) {_OVERALL} x",
    "result_text_roundtrip": f"WITH {_knn()} SELECT query_id, neighbor_id, CAST(printf('%.6g', distance) AS DOUBLE) AS distance, rank FROM lsh",
}


def _irregular_side(name: str, table: str, key: str, number: str) -> str:
    """CTEs {name} (id, n_parts, area, cx, cy), {name}_s (outer segments of those in one part) and {name}_e (edges), both around the centroid."""
    box = lambda x0, y0, x1, y1: ([x0, x1, x1, x0], [y0, y0, y1, y1])
    rings = [(0, 0, 0, False, (["0", "w", "w", "w * t", "w * t", "0"], ["0", "0", "h * t", "h * t", "h", "h"])), (1, 0, 0, False, box("0", "0", "w", "h")), (1, 0, 1, True, box("w / 4", "h / 4", "w / 2", "h / 2")), (2, 0, 0, False, box("0", "0", "w", "h")), (2, 1, 1, False, box("w + 1", "0", "w + 1 + w * t", "h * t")), (3, 0, 0, False, (["0", "w / 2", "w", "w / 2"], ["0", "h * t", "0", "h"]))]
    points = " UNION ALL ".join(f"SELECT id, {part} AS part, {ring} AS ring, {hole} AS hole, {len(xs)} AS m, generate_subscripts([{', '.join(xs)}], 1) AS i, unnest([{', '.join(f'CAST({x} AS DOUBLE)' for x in xs)}]) AS x, unnest([{', '.join(f'CAST({y} AS DOUBLE)' for y in ys)}]) AS y FROM {name}_k WHERE k % 4 = {kind}" for kind, part, ring, hole, (xs, ys) in rings)
    return f"""{name}_k AS (SELECT CAST({key} AS VARCHAR) AS id, k, 6.0E0 + CAST(k * 7919 % 10007 AS DOUBLE) / 1024 AS w, 6.0E0 + CAST(k * 104729 % 10009 AS DOUBLE) / 1024 AS h, 0.25E0 + CAST(k * 31 % 7 AS DOUBLE) / 16 AS t FROM (SELECT {key}, {number} AS k FROM {table})),
{name}_v AS ({points}),
{name}_g AS (SELECT p.*, q.x AS x1, q.y AS y1 FROM {name}_v p JOIN {name}_v q ON p.id = q.id AND p.ring = q.ring AND q.i = p.i % p.m + 1),
{name}_r AS (SELECT id, part, ring, sum(x * y1 - x1 * y) AS area2, sign(sum(x * y1 - x1 * y)) * CASE WHEN any_value(hole) THEN -1 ELSE 1 END AS role, sum((x + x1) * (x * y1 - x1 * y)) AS mx, sum((y + y1) * (x * y1 - x1 * y)) AS my FROM {name}_g GROUP BY id, part, ring),
{name} AS (SELECT id, count(DISTINCT part) AS n_parts, sum(role * area2) / 2 AS area, sum(role * mx) / (3 * sum(role * area2)) AS cx, sum(role * my) / (3 * sum(role * area2)) AS cy FROM {name}_r GROUP BY id),
{name}_c AS (SELECT g.id, g.hole, n_parts, role, x - cx AS x0, y - cy AS y0, x1 - cx AS x1, y1 - cy AS y1 FROM {name}_g g JOIN {name}_r USING (id, part, ring) JOIN {name} ON {name}.id = g.id),
{name}_s AS (SELECT * FROM {name}_c WHERE NOT hole AND n_parts = 1),
{name}_e AS (SELECT id, least(x0, x1) AS l, greatest(x0, x1) AS r, CASE WHEN x0 < x1 THEN y0 ELSE y1 END AS yl, CASE WHEN x0 < x1 THEN y1 ELSE y0 END AS yr, role * sign(x0 - x1) AS s FROM {name}_c WHERE x0 <> x1)"""


_SIDES = f"{_irregular_side('d', 'part', 'p_partkey', 'p_partkey')}, {_irregular_side('q', 'supplier', 's_suppkey', 's_suppkey * 31 + 5')}"
_IRREGULAR_BOX = "box AS (SELECT min(x0) AS xmin, min(y0) AS ymin, max(x0) AS xmax, max(y0) AS ymax FROM d_c)"
_IRREGULAR_PAIRS = f"""{_SIDES}, {_overlap(f"SELECT a.id AS ka, b.id AS kb, {_EDGE_PAIR} FROM q_e a, d_e b")},
alld AS (SELECT q.id AS query_id, d.id AS neighbor_id, 1.0E0 - coalesce(o.area, 0) / (q.area + d.area - coalesce(o.area, 0)) AS distance FROM q CROSS JOIN d LEFT JOIN o ON o.ka = q.id AND o.kb = d.id)"""


def _long_hashes(side: str) -> str:
    """CTE {side}_m (id, table_id, hash): the first hits of all places of a table."""
    return f"""{side}_m AS (SELECT id, table_id, string_agg(a, ',' ORDER BY pos) AS hash FROM (SELECT id, table_id, pos, min(attempt) AS a FROM (SELECT e.id, t.table_id, t.pos, t.attempt FROM (SELECT * FROM {side}_s WHERE y0 <> y1) e JOIN t ON (e.y0 > t.y) <> (e.y1 > t.y) AND t.x < (e.x1 - e.x0) * (t.y - e.y0) / (e.y1 - e.y0) + e.x0 GROUP BY e.id, t.table_id, t.pos, t.attempt HAVING count(*) % 2 = 1) GROUP BY id, table_id, pos) GROUP BY id, table_id)"""


def _fine() -> str:
    """CTEs of signatures and cand (query_id, neighbor_id), the pairs that share a bucket."""
    return f"{_darts_sql(FINE, _IRREGULAR_BOX)}, {_long_hashes('d')}, {_long_hashes('q')}, cand AS (SELECT DISTINCT q_m.id AS query_id, d_m.id AS neighbor_id FROM q_m JOIN d_m USING (table_id, hash))"


_SUMS = f"WITH {_PART} SELECT round(area, 6) AS area, count(*) AS n FROM d GROUP BY 1"
_SQUARE = "'POLYGON ((0 0, ' || k || ' 0, ' || k || ' ' || k || ', 0 ' || k || ', 0 0))'"
ORACLE_SQL |= {
    "irregular_shapes": f"WITH {_SIDES}, b AS (SELECT id, max(x0) - min(x0) AS w, max(y0) - min(y0) AS h FROM d_c GROUP BY id) SELECT id, round(area, 9) AS area, n_parts, round(w * h, 9) AS box_area, CAST(5 AS BIGINT) AS box_points FROM d JOIN b USING (id)",
    "irregular_bf_knn": f"WITH {_IRREGULAR_PAIRS} SELECT query_id, neighbor_id, round(distance + 1e-9, 6) AS distance, rank FROM (SELECT *, {_RANK} FROM alld) WHERE rank <= {K}",
    "irregular_lsh_knn": f"WITH {_IRREGULAR_PAIRS}, {_fine()} SELECT query_id, neighbor_id, round(distance + 1e-9, 6) AS distance, rank FROM (SELECT query_id, neighbor_id, distance, {_RANK} FROM cand JOIN alld USING (query_id, neighbor_id)) WHERE rank <= {K}",
    "irregular_pruning": f"WITH {_SIDES}, {_fine()}, n AS (SELECT (SELECT count(*) FROM cand) AS refined, (SELECT count(*) FROM q) * (SELECT count(*) FROM d) AS possible) SELECT refined, possible, 100.0E0 * (1 - CAST(refined AS DOUBLE) / possible) AS pruned_pct FROM n",
    "irregular_excluded": f"WITH {_SIDES}, {_fine()} SELECT (SELECT count(*) FROM d WHERE id NOT IN (SELECT id FROM d_m)) AS data, (SELECT count(*) FROM q WHERE id NOT IN (SELECT id FROM q_m)) AS queries",
    "rejected_lines": f"WITH d AS (SELECT p_partkey + 1 AS k, (p_partkey + 1) % 8 AS kind, chr(9) AS tab FROM part) SELECT CASE kind WHEN 1 THEN k || tab || 'POINT (' || k || ' 1)' || tab || 'x' WHEN 2 THEN k || tab || 'MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)))' || tab WHEN 3 THEN k || tab || 'POLYGON ((0 0, ' || k || tab || 'x' WHEN 4 THEN k || tab || {_SQUARE} WHEN 5 THEN k || ' ' || {_SQUARE} ELSE k || tab || 'POLYGON ((0 0, 1 1, 2 2, 0 0))' || tab || 'x' END AS line, CASE WHEN kind IN (1, 2) THEN 'not a polygon' WHEN kind = 3 THEN 'bad geometry' WHEN kind IN (4, 5) THEN 'fewer than two tabs' ELSE 'no area' END AS reason FROM d WHERE kind NOT IN (0, 6)",
    "last_line_wins": "SELECT CAST(p_partkey % 100 AS VARCHAR) AS id, CAST(max(p_partkey) AS DOUBLE) AS area FROM part GROUP BY p_partkey % 100",
    "repaired_polygons": "SELECT CAST(k AS VARCHAR) AS id, CAST(k AS DOUBLE) * k * CASE k % 4 WHEN 1 THEN 0.5E0 WHEN 3 THEN 16 ELSE 1 END AS area, CAST(CASE k % 4 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS BIGINT) AS n_parts, k % 4 > 0 AS repaired FROM (SELECT p_partkey + 1 AS k FROM part)",
    "header_tsv": _SUMS,
    "plain_wkt": _SUMS,
    "geojson": f"WITH {_PART} SELECT id, area FROM d",
    "result_files": f"WITH {_PAIRS} SELECT query_id, neighbor_id, CAST(printf('%.6g', distance) AS DOUBLE) AS distance, rank, TRUE AS there FROM (SELECT *, {_RANK} FROM alld) WHERE rank <= {K}",
    "comparison_csv": f"WITH {_knn()} SELECT query_id, avg_recall, mse, false_positive_rate, total_lsh_neighbors, total_bf_neighbors, total_matched_neighbors FROM ev",
    "query_wkt": f"WITH {_PAIRS}, bf AS (SELECT * FROM (SELECT *, {_RANK} FROM alld) WHERE rank <= {K}), r AS (SELECT query_id, d.area, 0 AS own FROM bf JOIN d ON d.id = neighbor_id UNION ALL SELECT id, area, 1 FROM q) SELECT query_id, count(*) AS n, count(*) FILTER (WHERE own = 1) AS n_own, sum(area) AS area FROM r GROUP BY query_id",
}
ORACLE_SQL["minhash_by_cells"] = ORACLE_SQL["lsh_buckets"] = ORACLE_SQL["minhash_signatures"]
