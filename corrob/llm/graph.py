"""Connected components of a large graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import shuffled, stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of ``edges`` (a, b) reaches.

    Alternating large-star and small-star contraction: every round hangs
    neighbours on the least id around them, until only stars are left.  A
    round's edges are a written table, and a hub's edges are spread by its
    skewed join, so neither a component nor a hub is ever in one task, nor a
    round's table in the driver.
    """
    now = stored(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _only_stars(now):
        both = now.union(now.select("v", "u"))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.filter("v > u").join(shuffled(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .filter("u <> v").distinct(), "edges")
        small_least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(shuffled(small_least), "u")
        now = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m"))
                     .filter("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _only_stars(edges: DataFrame) -> bool:
    """Whether every id hangs on one smaller id, and none of those on another."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(shuffled(edges.select(F.col("u").alias("v"))), "v", "left_semi").isEmpty()
