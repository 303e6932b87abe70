"""How good approximate lists are: per query and over all, and statistics of the nearest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


BINS = 4096


def top1_stats(found: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row about the similarity (1 - distance) of each query's nearest: n, mean, median, p10, p90, n_similar, pct_similar.

    Quantiles are the values at places n/2, n/10 and 9n/10 (whole numbers, from 0) in ascending
    order. Ranks come from counts of equal values, summed up within bins of the similarity and over
    the bins, of which there are no more than ``BINS`` + 1: nothing is sorted in one place.
    """
    s = found.filter("rank = 1").select((1 - F.col("distance")).alias("s"))
    total = s.agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.count_if(F.col("s") >= threshold).alias("n_similar")).first()
    n = total["n"]
    spark = found.sparkSession
    places = {"median": n // 2, "p10": n // 10, "p90": 9 * n // 10}
    values = {k: None for k in places}
    if n:
        values_ = s.groupBy("s").agg(F.count("*").alias("m")).withColumn("bin", F.floor(F.col("s") * BINS))
        bins = values_.groupBy("bin").agg(F.sum("m").alias("m"))
        before = bins.select("bin", (F.sum("m").over(W.orderBy("bin")) - F.col("m")).alias("before"))
        upto = values_.join(before, "bin").withColumn("upto", F.col("before") + F.sum("m").over(W.partitionBy("bin").orderBy("s")))
        got = upto.agg(*[F.min(F.when(F.col("upto") > p, F.col("s"))).alias(k) for k, p in places.items()]).first()
        values = got.asDict()
    share = 100.0 * total["n_similar"] / n if n else None
    row = (n, total["mean"], values["median"], values["p10"], values["p90"], total["n_similar"], share)
    return spark.createDataFrame([row], "n bigint, mean double, median double, p10 double, p90 double, n_similar bigint, pct_similar double")


def per_query(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """For each query in both lists: precision_at_k (found of the approximate list), recall_at_k (found of the exact), avg_recall (the
    former, under the name that result files use), mse of matched distances (null without a match), false_positive_rate, and the three counts."""
    first = exact.groupBy("query_id", "neighbor_id").agg(F.min_by("distance", "rank").alias("exact_distance"))
    joined = approx.join(first, ["query_id", "neighbor_id"], "left")
    hit = F.col("exact_distance").isNotNull()
    lists = joined.groupBy("query_id").agg(F.count("*").alias("total_lsh_neighbors"), F.count_if(hit).alias("total_matched_neighbors"), F.avg(F.when(hit, F.pow(F.col("distance") - F.col("exact_distance"), F.lit(2.0)))).alias("mse"))
    both = lists.join(exact.groupBy("query_id").agg(F.count("*").alias("total_bf_neighbors")), "query_id")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    matched, ours, theirs = F.col("total_matched_neighbors"), F.col("total_lsh_neighbors"), F.col("total_bf_neighbors")
    return both.select("query_id", ratio(matched, ours).alias("precision_at_k"), ratio(matched, theirs).alias("recall_at_k"), ratio(matched, ours).alias("avg_recall"), "mse", ratio(ours - matched, ours).alias("false_positive_rate"), ours, theirs, matched)


def overall(by_query: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """One row of averages over queries; a query without matches adds nothing to the mean error.

    ``exact``: counts queries that the approximate search gave nothing for, as zeros; without it they are left out.
    """
    rows = by_query
    if exact is not None:
        rows = exact.groupBy("query_id").agg(F.count("*").alias("_n")).join(by_query, "query_id", "left").withColumn("total_bf_neighbors", F.coalesce("total_bf_neighbors", "_n"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    n = F.count("*")
    mean = lambda name: zero(F.try_divide(F.sum(zero(F.col(name))), n.cast("double")))
    made = rows.agg(n.alias("queries"), mean("precision_at_k").alias("mean_precision"), mean("recall_at_k").alias("mean_recall"), mean("mse").alias("mean_mse"), count("total_lsh_neighbors"), count("total_bf_neighbors"), count("total_matched_neighbors"))
    wrong = F.col("total_lsh_neighbors") - F.col("total_matched_neighbors")
    return made.withColumn("false_positive_rate", zero(F.try_divide(wrong.cast("double"), F.col("total_lsh_neighbors").cast("double"))))
