"""Writers of results. All paths are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words of result files and the columns of the comparison file.
QUERY_LINE = "Query ID: "
NEIGHBOUR_LINE = "Neighbor ID: "
DISTANCE_PART = ", Distance: "
EVAL_COLUMNS = ["query_id", "avg_recall", "mse", "false_positive_rate", "total_lsh_neighbors", "total_bf_neighbors", "total_matched_neighbors"]


def six_digits(value: Column) -> Column:
    """A double with six significant digits and no trailing zeros, as C++ streams print it.

    Plain notation for exponents from -5 to 5, else mantissa and at least two digits of exponent.
    """
    form = F.format_string("%.5e", value)
    exponent = F.regexp_extract(form, r"e([-+]\d+)$", 1).cast("int")
    trim = lambda c: F.regexp_replace(F.when(c.contains("."), F.regexp_replace(c, "0+$", "")).otherwise(c), r"\.$", "")
    # ties go to the even digit
    power = F.pow(F.lit(10.0), (5 - exponent).cast("double"))
    plain = trim(F.format_string("%.12f", F.rint(value * power) / power))
    science = F.concat(trim(F.regexp_extract(form, r"^(.*)e", 1)), F.lit("e"), F.regexp_extract(form, r"e([-+]\d+)$", 1))
    return F.when(value == 0, F.lit("0")).when((exponent < -4) | (exponent >= 6), science).otherwise(plain)


def result_blocks(found: DataFrame) -> DataFrame:
    """``value``: for each query a block of its id and its neighbours in order; distances with six digits."""
    line = F.concat(F.lit(NEIGHBOUR_LINE), F.col("neighbor_id"), F.lit(DISTANCE_PART), six_digits(F.col("distance")))
    lists = found.withColumn("line", line).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return lists.select(F.concat(F.lit(QUERY_LINE), "query_id", F.lit("\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def write_results(found: DataFrame, path: str) -> None:
    """Result text; blocks are parted by an empty line."""
    result_blocks(found).write.option("lineSep", "\n").text(path)


def write_evaluation(per_query: DataFrame, path: str) -> None:
    """Comparison CSV with a header and a row for each query."""
    per_query.select(*EVAL_COLUMNS).write.option("header", True).csv(path)


def write_signature_stats(stats: DataFrame, path: str) -> None:
    """CSV of id, sparsity and bits, a row for each polygon and table, appended, no header."""
    stats.select("id", "sparsity", "total_bits").write.mode("append").csv(path)


def write_query_wkt(found: DataFrame, queries: DataFrame, data: DataFrame, path: str) -> None:
    """For each query a folder of text: its own geometry and those of its neighbours."""
    from tessera.functions.geometry import to_wkt

    own = queries.select(F.col("id").alias("query_id"), F.concat(F.lit("query\t"), to_wkt(F.col("rings"))).alias("value"))
    theirs = found.join(data, found["neighbor_id"] == data["id"]).select("query_id", F.concat(F.col("distance").cast("string"), F.lit("\t"), to_wkt(F.col("rings"))).alias("value"))
    own.unionByName(theirs).write.partitionBy("query_id").text(path)
