"""Ordered folds per key that stay parallel inside one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.session import written


def row_number_in_buckets(rows: DataFrame, key: str, order: list[str], bucket: Column, name: str = "number") -> DataFrame:
    """Number the rows of each key from 1 in order, without sorting a key in one task.

    ``bucket`` must not decrease along the order: rows are numbered inside
    (key, bucket) and shifted by the size of the key's earlier buckets.
    """
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    return dealt.withColumn("_inside", F.row_number().over(inside)).join(offsets, [key, "_bucket"]).withColumn(
        name, F.col("_inside") + F.col("_offset")).drop("_inside", "_offset", "_bucket")


def accepted_in_chunks(rows: DataFrame, key: str, order: list[str], chunk: Column, value: str,
                       differs: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """The rows of each key that a sequential rule accepts, without ``value``, numbered from 1 as ``name``.

    The first row is accepted, a later one if ``differs(value of the last
    accepted row, its own value)``.  ``chunk`` cuts a key's rows into
    consecutive pieces; it must not decrease along the order.  A piece is one
    row of the table of pieces.  All pieces are folded side by side, each from
    the value that its predecessor's last row has; a piece whose true start is
    another one is folded again, until all starts hold.  By induction along the
    pieces the result is the sequential one.  A piece that accepts nothing
    hands on what it was given, so a start is looked up at the nearest earlier
    piece that accepts a row: a long run of rows too like one another takes no
    more rounds than a short one.
    """
    columns = [F.col(c) for c in rows.columns if c != value]
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_value"), F.struct(*columns).alias("_row"))))
    pieces = written(rows.groupBy(key, chunk.cast("bigint").alias("_chunk")).agg(listed.alias("_all")).select(
        key, "_chunk", F.col("_all._value").alias("_values"), F.col("_all._row").alias("_rows")), "pieces")
    along = Window.partitionBy(key).orderBy("_chunk")  # of pieces by number, without their values

    def folded(started: DataFrame) -> DataFrame:
        """(key, _chunk, _start, _end, _at): the last value accepted, and the places of what is accepted."""
        kind = dict(started.dtypes)["_start"]

        def step(acc: Column, v: Column) -> Column:
            # a one-element array, so that the rule is asked once
            return F.element_at(F.transform(F.array(F.coalesce(differs(acc["last"], v), F.lit(True))), lambda yes: F.struct(
                F.when(yes, v).otherwise(acc["last"]).alias("last"), (acc["place"] + 1).alias("place"),
                F.when(yes, F.concat(acc["at"], F.array(acc["place"]))).otherwise(acc["at"]).alias("at"))), 1)

        begin = F.struct(F.col("_start").cast(kind).alias("last"), F.lit(0).alias("place"), F.array().cast("array<int>").alias("at"))
        done = started.withColumn("_done", F.aggregate("_values", begin, step))
        return done.select(key, "_chunk", "_start", F.col("_done.last").alias("_end"), F.col("_done.at").alias("_at"))

    def from_source(numbered: DataFrame, given: DataFrame) -> DataFrame:
        """(key, _chunk, _start) of every piece of ``numbered`` (key, _chunk, _source)."""
        return numbered.join(given.select(key, F.col("_chunk").alias("_source"), F.col("_end").alias("_start")), [key, "_source"], "left").select(
            key, "_chunk", "_start")

    before = pieces.select(key, "_chunk").withColumn("_source", F.lag("_chunk").over(along))
    starts = from_source(before, pieces.select(key, "_chunk", F.element_at("_values", -1).alias("_end")))
    ends = written(folded(pieces.select(key, "_chunk", "_values").join(starts, [key, "_chunk"])), "ends")
    while True:
        giver = F.last(F.when(F.size("_at") > 0, F.col("_chunk")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
        sourced = ends.select(key, "_chunk", "_at").withColumn("_source", giver).select(key, "_chunk", "_source")
        held = ends.select(key, "_chunk", F.col("_start").alias("_was"))
        wrong = written(from_source(sourced, ends).join(held, [key, "_chunk"]).filter(~F.col("_start").eqNullSafe(F.col("_was"))).drop("_was"), "wrong")
        if wrong.isEmpty():
            break
        again = folded(pieces.select(key, "_chunk", "_values").join(wrong, [key, "_chunk"]))
        ends = written(ends.join(wrong, [key, "_chunk"], "left_anti").unionByName(again), "ends")

    earlier = F.coalesce(F.sum(F.size("_at")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = ends.select(key, "_chunk", "_at").withColumn("_earlier", earlier)
    found = pieces.select(key, "_chunk", "_rows").join(places, [key, "_chunk"]).select("_rows", "_earlier", F.posexplode("_at").alias("_n", "_place"))
    return found.select(F.get("_rows", "_place").alias("_row"), (F.col("_earlier") + F.col("_n") + 1).alias(name)).select("_row.*", name)
