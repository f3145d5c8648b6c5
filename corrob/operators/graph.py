"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of ``edges`` (a, b) reaches.

    Ids are hung on the least id around them, first those above an id, then
    those below, until no edge changes.  All steps are minima and joins, so
    neither a component nor a hub is gathered anywhere.
    """
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (mark := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()) != before:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        above = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(lowest, "u")
        now = cut_lineage(below.select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", "m"))
                          .filter("u <> v").distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
