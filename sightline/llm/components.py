"""Connected components of a table of links, by alternating star operations; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, join_counted, write_table


def _least(edges: DataFrame) -> DataFrame:
    return write_table(edges.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")), "least")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every vertex ties its larger neighbours to its least neighbour (or itself). A vertex with many neighbours is not
    dealt to one task."""
    found = join_counted(edges, least, ["a"]).where("b > a")
    return found.select(F.col("b").alias("a"), F.least("a", "least").alias("b"))


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every vertex ties itself and its smaller neighbours to the least of these. Here a > b in every edge."""
    found = join_counted(edges, least, ["a"]).where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return found.unionByName(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """vertex, component for every vertex of links (a, b: long): the smallest vertex that it reaches.

    Links with a null end or equal ends are left out; repeated links count once; no links give no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = write_table(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = _least(both)
        larger = write_table(_large_star(both, least).distinct(), "links")
        smallest = _least(larger)
        made = write_table(_small_star(larger, smallest).distinct(), "links")
        for table in (edges, least, larger, smallest):
            drop_table(table)
        edges = made
        # Equal sums over two rounds mean that the stars no longer move.
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct())
        before = state
    raise RuntimeError("components did not settle")
