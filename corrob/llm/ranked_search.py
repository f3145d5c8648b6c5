"""Ranked lexical search by bag deduplication.

A search for a set of items sees nothing of a document but how often it holds
the items' terms, and its length factor m.  Documents that agree in both are
one class: copies, and all documents that differ in other words only.

1. One pass over the texts cuts every document down to its bag, the sorted
   (term, frequency) list over the items' vocabulary, and its number of terms.
2. Bags with equal m are grouped: rows are dealt by the hash of bag and m and
   compared on the bags themselves.  Of a class's members only the ``top`` least
   doc_ids can ever be ranked, and each task keeps no more than those before
   the shuffle, so a class with a third of all documents moves like any other.
3. Each class is scored once, against all items, in 64-bit integers.  A task
   keeps the ``top`` best classes of each item: a class behind that many others
   has that many documents in front of all of its own.
4. The classes left are expanded to their members, which are ranked by score
   and then by doc_id.

Items are searched in blocks of bounded size (BLOCK_BYTES of item texts), one
pass over the bags' source per block; that bounds what is broadcast however
many items there are.  Words are compared by 64-bit hash.

Defined cases: a null text has no terms; a document without terms counts in
nothing, one without the items' terms only in the statistics; repeated rows are
documents each, ranked next to each other; a row without doc_id comes behind
equal scores that have one; items that repeat item_id and text are one item;
an item without terms, an empty benchmark or an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import stored
from corrob.llm.wordhash import hashed_words, text_slices
from corrob.session import ship_package

BLOCK_BYTES = 8 << 20  # of item texts searched for at a time
CELLS = 4 << 20  # scores held at a time
#: All of ASCII but letters and digits separates terms.
_SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term of a few texts."""
    parts = [(low, hashed_words(data, offsets, _SEPARATORS)) for low, _, data, offsets in text_slices(pa.array(texts, pa.large_string()))]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return (np.concatenate([low + found[0] for low, found in parts]), np.concatenate([found[3] for _, found in parts]))


class Items:
    """Vocabulary of a block of items, and for each term the items with it and how often."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        row, h = _terms([t for _, t in items])
        self.words, term = np.unique(h, return_inverse=True)
        pair, self.times = np.unique(term * max(1, len(items)) + row, return_counts=True)
        self.item = pair % max(1, len(items))
        self.bounds = np.searchsorted(pair // max(1, len(items)), np.arange(len(self.words) + 1))


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Blocks of items that together hold all, each of bounded size."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"]).filter(
        "text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / BLOCK_BYTES))
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Items([(r["item_id"], r["text"]) for r in mine.collect()])  # about BLOCK_BYTES / 2, by the division above


def _bagger(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1)):
                row, _, _, h = hashed_words(data, offsets, _SEPARATORS)
                spot = np.minimum(np.searchsorted(words, h), len(words) - 1)
                hit = words[spot] == h
                pair, tf = np.unique(row[hit] * len(words) + spot[hit], return_counts=True)
                first = np.searchsorted(pair // len(words), np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low),
                    pa.array(np.bincount(row, minlength=high - low), pa.int64()),
                    pa.ListArray.from_arrays(first, pa.array((pair % len(words)).astype(np.int32))),
                    pa.ListArray.from_arrays(first, pa.array(tf.astype(np.int64)))], names=["doc_id", "n", "terms", "tf"])

    return run


def bags(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, n, terms, tf) of every document with a term, as a written table."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(items.words)
    return stored(docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
        _bagger(shared), "doc_id bigint, n bigint, terms array<int>, tf array<bigint>").filter("n > 0"), "bags")


def classes(bagged: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """(m, terms, tf, members): one row for each set of equal bags, with its ``top`` least doc_ids."""
    m = F.lit(25) + F.expr(f"cast(75 * n as decimal(20,0)) * cast({documents} as decimal(18,0)) div cast({length} as decimal(20,0))")
    keyed = bagged.filter(F.size("terms") > 0).withColumn("m", m.cast("bigint")).withColumn(
        "bag", F.xxhash64("m", "terms", "tf"))
    key = ["bag", "m", "terms", "tf"]
    least = Window.partitionBy(*key).orderBy(F.col("doc_id").asc_nulls_last())
    few = keyed.withColumn("place", F.row_number().over(least)).filter(F.col("place") <= top)
    listed = few.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("members"))
    return listed.select("m", "terms", "tf", F.transform("members", lambda x: x["doc_id"]).alias("members"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a list column."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()


def _scorer(shared, top: int):
    def best(found: list[tuple]) -> list[tuple]:
        return sorted(found, key=lambda x: (-x[0], x[1][0] is None, x[1][0]))[:top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight = shared.value
        ahead: list[list[tuple]] = [[] for _ in items.ids]
        width = len(items.ids)
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS // max(1, width))):
                batch = whole.slice(at, max(1, CELLS // max(1, width)))
                m = batch.column(0).to_numpy()
                count, term = _lists(batch.column(1))
                tf = _lists(batch.column(2))[1]
                row = np.repeat(np.arange(batch.num_rows), count)
                gain = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                uses = items.bounds[term + 1] - items.bounds[term]
                place = np.repeat(items.bounds[term] - (np.cumsum(uses) - uses), uses) + np.arange(uses.sum())
                score = np.zeros(batch.num_rows * width, np.int64)
                np.add.at(score, np.repeat(row, uses) * width + items.item[place], np.repeat(gain, uses) * items.times[place])
                score = score.reshape(batch.num_rows, width)
                members = batch.column(3)
                for i in range(width):
                    mine = score[:, i]
                    bar = ahead[i][-1][0] if len(ahead[i]) == top else 1
                    near = np.flatnonzero(mine >= max(1, bar))
                    if len(near) > top:  # all that tie with the last one that may be kept
                        cut = -np.partition(-mine[near], top - 1)[top - 1]
                        near = near[mine[near] >= cut]
                    if len(near):
                        ahead[i] = best(ahead[i] + [(int(mine[r]), members[int(r)].as_py()) for r in near])
        rows = [(i, members, score) for i, found in enumerate(ahead) for score, members in found]
        yield pa.RecordBatch.from_arrays([
            pa.array([i for i, _, _ in rows], pa.int32()), pa.array([items.ids[i] for i, _, _ in rows], pa.int64()),
            pa.array([x for _, x, _ in rows], pa.list_(pa.int64())), pa.array([s for _, _, s in rows], pa.int64())],
            names=["item", "item_id", "members", "score"])

    return run


def search(docs: DataFrame, benchmark: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best documents of each item."""
    spark = docs.sparkSession
    out = None
    for items in item_blocks(benchmark):
        if not len(items.words):
            continue
        bagged = bags(docs, items)
        documents, length = bagged.agg(F.count(F.lit(1)), F.sum("n")).first()
        having = np.zeros(len(items.words), np.int64)
        for r in bagged.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # the block's vocabulary
            having[r["term"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in having], np.int64)
        shared = spark.sparkContext.broadcast((items, weight))
        scored = classes(bagged, documents, length or 1, top).mapInArrow(
            _scorer(shared, top), "item int, item_id bigint, members array<bigint>, score bigint")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        # a few hundred parts of each item are ranked first, so that one item's rows are few in any task
        spread = scored.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(256))).select(
            "item", "item_id", "part", "score", F.explode("members").alias("doc_id"))
        near = spread.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(
            F.col("rank") <= top)
        ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(
            F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out
