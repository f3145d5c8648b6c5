"""Near copies by SetSketch registers, confirmed on the full shingle sets.

A document's set of word shingles is summed up in registers: for each of m
hash functions the least exponential value over the set, rounded down to a
power of a base close to one and cut to 16 bits.  Registers of a union are the
larger of each pair, so sketches merge, and two sets agree in a register with
a probability close to their Jaccard similarity.

1. Sketch every text (one pass, nothing but sketches leaves it).  Equal sets
   are one set from here on, named by the least document id.
2. Rows of four registers are band keys.  In each bucket all members are
   compared with two representatives, not with each other.
3. A pair is dropped if the likeliest similarity, given both sizes and how
   often one register is larger, equal or smaller, is far below the threshold;
   the rest is checked on the full sets of the whole texts.
4. Links are joined to components.  Members of buckets that then still hold
   several components are searched exactly for links across components: a
   document stays in question only while enough of its shingles occur in
   another component to reach the threshold, and pairs must share one of the
   rarest of those (as many as a link cannot do without).  That takes out the
   bulk of a large group of looser copies, each with edits of its own, in
   linear time.  First each such shingle's documents are compared with one of
   them, which joins most components; then all pairs left over are tested.

After step 4 every pair that shares a bucket has been tested, cannot be linked
or is known to be connected, so the components are those of all pairs that
share a band key: at 24 bands of 4, a pair at the threshold of 0.85 shares
none with a probability of 2e-8 (at 0.8: 3e-6).

Defined cases: a null text is empty; a text without words has no shingles and
no links; rows without doc_id are never linked; rows that repeat a doc_id are
one document (of different texts under one id, one stands for all in links).
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import stored
from corrob.llm.graph import components
from corrob.llm.wordhash import mix, shingle_sets, text_slices
from corrob.session import ship_package

REGISTERS, ROWS = 96, 4  # 24 bands
BASE, RATE, LARGEST = 1.001, 20.0, 2**16 - 2
MARGIN = 5  # standard errors below the threshold at which an estimate drops a pair

_rng = np.random.default_rng(77)
_MULTIPLY = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The sketch of one set: larger values for rarer, that is smaller, minima."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(least, (shingles[at:at + 1024, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    value = -np.log1p(-np.minimum((least + 0.5) / 2.0**64, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LARGEST + 1).astype(np.uint16)


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of ``sketches``; bands never share keys."""
    parts = sketches.reshape(len(sketches), -1, ROWS).astype(np.uint64)
    weights = _MULTIPLY[:ROWS]
    return mix((parts * weights).sum(axis=2, dtype=np.uint64) + _ADD[:parts.shape[1]]).view(np.int64)


def likeliest(u: np.ndarray, v: np.ndarray, size_u: np.ndarray, size_v: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches of sets of known sizes."""
    above, below = (u > v).sum(axis=1), (u < v).sum(axis=1)
    share_u, share_v = size_u / (size_u + size_v), size_v / (size_u + size_v)
    grid = np.linspace(0, 1, 101)[None, :] * (np.minimum(size_u, size_v) / np.maximum(size_u, size_v))[:, None]

    def larger(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up = larger(share_u[:, None] - share_v[:, None] * grid)
    down = larger(share_v[:, None] - share_u[:, None] * grid)
    fit = (above[:, None] * np.log(np.maximum(up, 1e-12)) + below[:, None] * np.log(np.maximum(down, 1e-12))
           + (u.shape[1] - above - below)[:, None] * np.log(np.maximum(1 - up - down, 1e-12)))
    return grid[np.arange(len(u)), fit.argmax(axis=1)]


def _sketcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in text_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, k)
                sketches = np.stack([registers(s) for s in sets])
                keys = band_keys(sketches)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, high - low), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sketches], pa.binary()),
                    pa.array([b.tolist() if len(s) else [] for b, s in zip(keys, sets)], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "registers", "bands"])

    return run


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest, registers, bands) of every row, as a written table."""
    ship_package(docs.sparkSession)
    return stored(docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
        _sketcher(k), "doc_id bigint, n_shingles bigint, digest binary, registers binary, bands array<bigint>"), "sketches")


def _plausible(least_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, REGISTERS) for i in (2, 3))
            n_u, n_v = (batch.column(i).to_numpy().astype(float) for i in (4, 5))
            wanted = least_percent / 100
            error = np.sqrt(wanted * (1 - wanted) / REGISTERS)
            keep = (100 * np.minimum(n_u, n_v) >= least_percent * np.maximum(n_u, n_v)) & (
                likeliest(u, v, n_u, n_v) >= wanted - MARGIN * error)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _linked(k: int, least_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            cache: dict[int, np.ndarray] = {}  # rows come grouped by their second document
            for row, (b, left, right) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))):
                def one(text: str) -> np.ndarray:
                    raw = np.frombuffer(text.encode(), np.uint8)
                    return shingle_sets(raw, np.array([0, len(raw)]), k)[0]

                if b not in cache:
                    cache = {b: one(right)}
                x, y = one(left), cache[b]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[row] = 100 * common >= least_percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(keep)).select([0, 1])

    return run


def _exploded(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(2), 1 << 20):
                sets = shingle_sets(data, offsets, k)
                size = np.array([len(x) for x in sets])
                row = np.repeat(np.arange(low, high), size)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)),
                    pa.array(np.repeat(size, size), pa.int64()), pa.array(np.concatenate(sets).view(np.int64))],
                    names=["id", "component", "n", "shingle"])

    return run


def rare_shingles(members: DataFrame, texts: DataFrame, k: int, least_percent: int) -> DataFrame:
    """(shingle, id, component, n, place): the shingles by which links across components are found.

    ``members`` is (id, component).  A link shares at least ``least_percent``
    of either set, so of a document's shingles, rarest first, one of the first
    n - ceil(n * least_percent / 100) + 1 is shared.  Shingles that only occur
    in the document's own component come first and find nothing; a document
    with enough of them has no link and is left out, which may free others.
    ``place`` counts a document's shingles in that order, from 1.
    """
    rows = stored(members.join(texts, "id").select("id", "component", "text").mapInArrow(
        _exploded(k), "id bigint, component bigint, n bigint, shingle bigint"), "shingles")
    needed = F.ceil(F.col("n") * least_percent / 100)
    for _ in range(2):
        shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("having"), F.min("component").alias("low"),
                                             F.max("component").alias("high")).filter("low < high").select("shingle", "having")
        useful = rows.drop("having", "usable").join(shared, "shingle")
        enough = useful.groupBy("id").agg(F.count(F.lit(1)).alias("usable"), F.first("n").alias("n")).filter(
            F.col("usable") >= needed).select("id", "usable")
        rows = stored(useful.join(enough, "id").select("id", "component", "n", "shingle", "having", "usable"), "shingles")
    order = F.row_number().over(Window.partitionBy("id").orderBy("having", "shingle"))  # one document's shingles
    placed = rows.withColumn("place", order + F.col("n") - F.col("usable"))
    return stored(placed.filter(F.col("place") <= F.col("n") - needed + 1).select("shingle", "id", "component", "n", "place"), "prefixes")


def in_both_prefixes(least_percent: int) -> Column:
    """Whether a shared shingle is among those that this pair cannot do without.

    Sets of n and m shingles are linked from least_percent * (n + m) / (100 +
    least_percent) common ones on; for equal sizes that halves the prefix.
    """
    common = F.ceil(F.lit(least_percent) * (F.col("n") + F.col("its_n")) / F.lit(100 + least_percent))
    return (F.col("place") <= F.col("n") - common + 1) & (F.col("its_place") <= F.col("its_n") - common + 1)


def near_copies(docs: DataFrame, k: int = 3, least_percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    ``kept`` is true for the least doc_id of each component, and for rows
    without doc_id, whose component is null.
    """
    every = sketch(docs, k)
    usable = every.filter("doc_id is not null and n_shingles > 0")
    if not usable.groupBy("doc_id").count().filter("count > 1").isEmpty():
        usable = usable.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles", "registers", "bands")).alias("r")).select(
            "doc_id", "r.*")
    sets = stored(usable.groupBy("digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "registers", "bands")).alias("r"), F.count(F.lit(1)).alias("copies")).select(
        F.col("r.doc_id").alias("id"), "digest", F.col("r.n_shingles").alias("n"), "r.registers", "r.bands", "copies"), "sets")
    keys = sets.select("id", F.explode("bands").alias("key"))
    buckets = stored(keys.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("id").alias("first"), F.min_by("id", F.xxhash64("id")).alias("other"))
        .filter("members > 1").drop("members"), "buckets")
    met = stored(keys.join(buckets, "key"), "met")
    texts = stored(docs.select(docs["doc_id"].cast("bigint").alias("id"), docs["text"]).join(
        met.select("id").distinct(), "id").dropDuplicates(["id"]), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The linked ones of distinct pairs (a, b), as a written table."""
        side = [sets.select(F.col("id").alias(x), F.col("registers").alias(f"registers_{x}"), F.col("n").alias(f"n_{x}"))
                for x in "ab"]
        hopeful = pairs.join(side[0], "a").join(side[1], "b").select(
            "a", "b", "registers_a", "registers_b", "n_a", "n_b").mapInArrow(_plausible(least_percent), "a bigint, b bigint")
        text = [texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]
        return stored(hopeful.join(text[0], "a").join(text[1], "b").select("a", "b", "text_a", "text_b").mapInArrow(
            _linked(k, least_percent), "a bigint, b bigint"), "links")

    def ordered(x: str, y: str) -> list:
        return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]

    stars = stored(met.select("id", F.explode(F.array("first", "other")).alias("to")).filter("id <> to").select(
        *ordered("id", "to")).distinct(), "stars")
    links = confirmed(stars)
    labels = stored(components(links), "labels")
    placed = met.select("key", "id").join(labels, "id", "left").select(
        "key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    open_members = stored(placed.join(mixed.select("key"), "key").select("id", "component").distinct(), "open")
    if not open_members.isEmpty():
        prefixes = rare_shingles(open_members, texts, k, least_percent)
        hubs = stored(prefixes.groupBy("shingle").agg(
            F.min(F.struct("id", "n", "place")).alias("hub"), F.min("component").alias("low"),
            F.max("component").alias("high")).filter("low < high").select(
            "shingle", F.col("hub.id").alias("to"), F.col("hub.n").alias("its_n"), F.col("hub.place").alias("its_place")), "hubs")
        to_hubs = prefixes.join(hubs, "shingle").filter((F.col("id") != F.col("to")) & in_both_prefixes(least_percent))
        tested = stored(to_hubs.select(*ordered("id", "to")).distinct().join(stars, ["a", "b"], "left_anti"), "crossing")
        links = stored(links.union(confirmed(tested)), "links")
        labels = stored(components(links), "labels")
        now = prefixes.drop("component").join(labels, "id", "left").select(
            "shingle", "id", "n", "place", F.coalesce("component", "id").alias("component"))
        other = now.select("shingle", F.col("id").alias("to"), F.col("component").alias("its"), F.col("n").alias("its_n"),
                           F.col("place").alias("its_place"))
        pairs = now.join(other, "shingle").filter((F.col("component") < F.col("its")) & in_both_prefixes(least_percent))
        crossing = pairs.select(*ordered("id", "to")).distinct().join(stars.union(tested), ["a", "b"], "left_anti")
        more = confirmed(stored(crossing, "crossing"))
        if not more.isEmpty():
            labels = stored(components(links.union(more)), "labels")
    named = stored(sets.join(labels, "id", "left").filter("component is not null or copies > 1").select(
        "digest", F.coalesce("component", "id").alias("component")), "named")
    standing = usable.select("doc_id", "digest").join(named, "digest").select("doc_id", "component")
    return every.select("doc_id", "n_shingles").join(standing, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_copies(docs: DataFrame, k: int = 5, least_percent: int = 80) -> DataFrame:
    """``docs`` with one row for each group of near copies, that of the least doc_id.

    Rows without doc_id stay.  Of rows that repeat a doc_id one stays, that of
    the least text.
    """
    verdict = near_copies(docs, k, least_percent)
    gone = verdict.filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return left
    row = F.struct("text", F.struct(*left.columns).alias("row"))
    once = left.filter("doc_id is not null").groupBy("doc_id").agg(F.min(row).alias("least")).select("least.row.*")
    return once.unionByName(left.filter("doc_id is null"))
