"""Connected components of a link table, as rounds of joins and fixed-width aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.rows import stored


def components(links: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for every node that occurs in ``links`` (a, b).

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each node points its larger neighbours, then
    itself and its smaller ones, to the smallest it knows.  The table never grows beyond its first size and converges to
    stars in about log(n) rounds, each of which ends as a table in shared storage.  A count per node tells that it holds
    stars only, so no round is run to see that nothing changes.  Links with a null end and loops are ignored.
    """
    edges = stored(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    while not _are_stars(edges):
        edges = stored(_small_star(_large_star(edges)), "stars")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node points to one other at most, and those that others point to point to none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(
        edges.select("v", F.lit(0), F.lit(1))
    )
    counted = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return counted.agg(F.count_if(F.col("out") + F.col("into") > 1)).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return (
        edges.join(least, "u")
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(least.select("u", "m"))
        .distinct()
    )
