"""Connected components of a graph that is a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path, remove, stored_at


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least of itself and its neighbours."""
    return edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each ``a`` has one ``b`` and no ``b`` is an ``a``: then every ``b`` is the least node of its component."""
    twice = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1)
    inner = edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
    return twice.isEmpty() and inner.isEmpty()


def connected_components(links: DataFrame, *, rounds: int = 60) -> DataFrame:
    """Links (a, b), any order, loops and repeats allowed, to (node, root): root is the least node of the component.

    Large-star and small-star rounds in turn: each node hands its neighbours to its least
    neighbour, until all components are stars around their root. The rounds grow with the logarithm of
    the component's size; each is a table in the shared folder, which goes when the next is there. No neighbour list is ever
    gathered: both steps are an aggregate and a join, which splits where a node has very
    many links. No links give no rows.
    """
    first = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    spark = links.sparkSession
    path = fresh_path(spark, "links")
    edges = stored_at(first, path)
    for _ in range(rounds):
        if _are_stars(edges):
            break
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u")))
        large = both.join(_least(both), "v").filter("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.col("a").alias("v"), F.col("b").alias("u"))
        small = down.join(_least(down), "v")
        moved = small.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(small.select(F.col("v").alias("a"), F.col("m").alias("b")))
        before, path = path, fresh_path(spark, "links")
        edges = stored_at(moved.filter("a <> b").distinct(), path)
        remove(spark, before)
    else:
        raise RuntimeError("components did not settle")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
