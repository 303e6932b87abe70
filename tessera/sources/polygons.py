"""Readers. Each gives the polygons, and on request the lines that were turned down, with the reason."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.geometry import RINGS
from tessera.functions.repair import is_valid, make_valid
from tessera.functions.wkt import BadGeometry, as_rings, parse, parse_geojson

_PARSED = f"rings {RINGS}, n_parts int, repaired boolean, reason string"


def _read(text: str | None, reader: Callable) -> dict:
    fail = lambda why: {"rings": None, "n_parts": None, "repaired": None, "reason": why}
    try:
        kind, parts = reader(text or "")
    except BadGeometry as e:
        return fail(f"bad geometry: {e}")
    if kind != "POLYGON":
        return fail("not a polygon")
    if not parts:
        return fail("empty polygon")
    valid = is_valid(parts)
    parts = parts if valid else make_valid(parts)
    if not parts:
        return fail("no area")
    return {"rings": as_rings(parts), "n_parts": len(parts), "repaired": not valid, "reason": None}


def parse_geometry(df: DataFrame, text_col: str = "wkt", form: str = "wkt") -> DataFrame:
    """Adds rings, n_parts, repaired and reason (null where the geometry was read) from WKT or GeoJSON text."""
    reader = {"wkt": parse, "geojson": parse_geojson}[form]
    keep = [f for f in df.schema.fields if f.name not in ("rings", "n_parts", "repaired", "reason")]
    ring = pa.struct([("part", pa.int32()), ("is_hole", pa.bool_()), ("pts", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))])
    kinds = {"rings": pa.list_(ring), "n_parts": pa.int32(), "repaired": pa.bool_(), "reason": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_read(t, reader) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), *(pa.array([g[n] for g in got], k) for n, k in kinds.items())], names=[*(f.name for f in keep), *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return df.select(*(f.name for f in keep)).mapInArrow(run, f"{schema}, {_PARSED}" if schema else _PARSED)


def numbered(lines: DataFrame) -> DataFrame:
    """``value`` with ``line_no``: file, block and place in it, which orders lines as files hold them, files by name; where lines come from no file, the order of Spark's partitions."""
    place = F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.select(place.alias("line_no"), "value")


def split_lines(lines: DataFrame) -> DataFrame:
    """``value`` to (line_no, id, wkt, value): the id ends at the first tab, the text at the last; null without two tabs. Empty lines go.

    ``line_no``: as ``numbered`` gives, if the lines haven't that column yet.
    """
    form = r"^([^\t]*)\t([\s\S]*)\t[^\t]*$"
    full = F.col("value").rlike(form)
    part = lambda n: F.when(full, F.regexp_extract("value", form, n))
    lines = lines if "line_no" in lines.columns else numbered(lines)
    return lines.filter("value <> ''").select("line_no", part(1).alias("id"), part(2).alias("wkt"), "value")


def _parted(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    rejects = parsed.filter("reason IS NOT NULL").select(F.col("value").alias("line"), "reason")
    return parsed.filter("reason IS NULL"), rejects


def polygons_of_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``id TAB wkt TAB rest`` to (id, rings, n_parts, repaired) and the rejects (line, reason). Of a repeated id the last line holds."""
    cut = split_lines(lines)
    parsed = parse_geometry(cut).withColumn("reason", F.when(F.col("id").isNull(), F.lit("fewer than two tabs")).otherwise(F.col("reason")))
    good, rejects = _parted(parsed)
    last = W.partitionBy("id").orderBy(F.desc("line_no"))
    once = good.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return once.select("id", "rings", "n_parts", "repaired"), rejects


def read_wkt_with_id(spark: SparkSession, path: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Polygons and rejects of text files; ``partitions`` deals the lines out in turns first. Of a repeated id the last line holds either way."""
    lines = numbered(spark.read.text(path))
    return polygons_of_lines(lines.repartition(partitions) if partitions else lines)


def read_header_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Files with a header line and WKT up to the first tab: (rings, n_parts, repaired) and rejects."""
    names = F.input_file_name()
    lines = spark.read.text(path).select("value", names.alias("_file"), F.monotonically_increasing_id().alias("_no"))
    heads = lines.groupBy("_file").agg(F.min("_no").alias("_no"))
    body = lines.join(heads, ["_file", "_no"], "left_anti").filter("value <> ''").select("value", F.substring_index("value", "\t", 1).alias("wkt"))
    good, rejects = _parted(parse_geometry(body))
    return good.select("rings", "n_parts", "repaired"), rejects


def read_wkt(spark: SparkSession, path: str, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A geometry on each line, no ids: (rings, n_parts, repaired) and rejects."""
    lines = spark.read.text(path).filter("value <> ''").select("value", F.col("value").alias("wkt"))
    good, rejects = _parted(parse_geometry(lines.repartition(partitions) if partitions else lines))
    return good.select("rings", "n_parts", "repaired"), rejects


def read_geojson(spark: SparkSession, path: str, by_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Features of a FeatureCollection, or of one feature on each line: (id, rings, n_parts, repaired) and rejects.

    The id is the feature's own, else its property ``id``. ``by_line``: the files have a feature on each line and are
    read in splits; otherwise a file is one value, since a collection may span lines.
    """
    if by_line:
        features = spark.read.text(path).filter(F.trim("value") != "")
    else:
        text = spark.read.text(path, wholetext=True)
        whole = F.from_json("value", "features array<string>")["features"]
        split = F.coalesce(whole, F.filter(F.split("value", "\n"), lambda x: F.trim(x) != ""))
        features = text.select(F.explode(split).alias("value"))
    field = lambda at: F.get_json_object("value", at)
    parsed = parse_geometry(features.select("value", F.coalesce(field("$.id"), field("$.properties.id")).alias("id"), field("$.geometry").alias("wkt")), form="geojson")
    good, rejects = _parted(parsed)
    return good.select("id", "rings", "n_parts", "repaired"), rejects


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result text to (query_id, neighbor_id, distance, rank); a query without neighbours has no row."""
    return parse_results(spark.read.option("lineSep", "\n\n").text(path))


def parse_results(blocks: DataFrame) -> DataFrame:
    """``value``: a block of a ``Query ID:`` line and a line for each neighbour."""
    query = F.regexp_extract("value", r"Query ID: ([^\n]*)", 1)
    lines = F.filter(F.split("value", "\n"), lambda x: x.startswith("Neighbor ID: "))
    rows = blocks.select(query.alias("query_id"), F.posexplode(lines).alias("at", "line"))
    form = r"^Neighbor ID: (.*), Distance: (\S+)$"
    return rows.select("query_id", F.regexp_extract("line", form, 1).alias("neighbor_id"), F.regexp_extract("line", form, 2).cast("double").alias("distance"), (F.col("at") + 1).cast("bigint").alias("rank"))


def path_exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
