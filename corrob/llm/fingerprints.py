"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint has a bit for each of the 64 bits of a hash: set if it is set in
over half of the text's shingle hashes (XXH64).  Fingerprints with at most two
differing bits are linked.

*Fuzzy keys.*  The perfect binary Golay code puts every 23-bit word within
three bits of exactly one of 4,096 codewords.  A segment's keys are the
codewords of itself and of all words one bit away: one or six of them.  Two
segments that differ in at most two bits have a word within one bit of both,
hence a key in common.

*Pigeonhole.*  A fingerprint is cut into three segments.  Two errors leave one
segment intact, and the next one has at most two, so linked fingerprints agree
in (intact segment, a fuzzy key of the next), 33 bits, for one of the three
choices: 18 keys a fingerprint at most.

*Join and verify.*  Distinct fingerprints are compared with the least and the
greatest one under each key.  Where the members of a key then still belong to
several components, all its members are looked at exactly, without pairs: each
one is listed under itself and its 64 one-bit neighbours, fingerprints listed
under the same word are at most two bits apart, and any two that are linked
are listed under a common word; so each is linked to the least one of every
word.  Both steps are minima with a partial aggregate, whatever the size of a
key or word.

Defined cases: a null or blank text has fingerprint zero, linked like any
other; fewer than three words are one shingle; repeated rows are documents
each; a row without doc_id has a fingerprint and the component of it, which is
null if no row has a doc_id there; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import shuffled, stored
from corrob.llm.graph import components
from corrob.llm.wordhash import hashed_words, text_slices
from corrob.session import ship_package

SEED, K, DISTANCE = 42, 3, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.uint8(32)

# --- XXH64 of many strings at once -----------------------------------------------


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``data[start:end]``.

    Strings of equal numbers of 32-byte stripes, 8-byte lanes and so on go
    through the same array operations.
    """
    with np.errstate(over="ignore"):
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        n = len(data)
        word = np.zeros(n, np.uint64)  # the eight bytes from each position on
        for k in range(8):
            word |= padded[k:n + k].astype(np.uint64) << np.uint64(8 * k)
        size, at = end - start, start.copy()
        seed64 = np.uint64(seed)
        h = np.full(len(start), seed64 + P5)
        long = np.flatnonzero(size >= 32)
        if len(long):
            lanes = [np.full(len(long), s) for s in (seed64 + P1 + P2, seed64 + P2, seed64, seed64 - P1)]
            where, stripes = at[long], size[long] // 32
            for k in range(int(stripes.max())):
                live = np.flatnonzero(stripes > k)
                for j in range(4):
                    lanes[j][live] = _round(lanes[j][live], word[where[live] + 32 * k + 8 * j])
            joined = sum(_turn(lane, by) for lane, by in zip(lanes, (1, 7, 12, 18)))
            for lane in lanes:
                joined = (joined ^ _round(np.uint64(0), lane)) * P1 + P4
            h[long] = joined
            at[long] += 32 * stripes
        h += size.astype(np.uint64)
        for _ in range(3):
            live = np.flatnonzero(end - at >= 8)
            h[live] = _turn(h[live] ^ _round(np.uint64(0), word[at[live]]), 27) * P1 + P4
            at[live] += 8
        live = np.flatnonzero(end - at >= 4)
        h[live] = _turn(h[live] ^ ((word[at[live]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
        at[live] += 4
        for _ in range(3):
            live = np.flatnonzero(end > at)
            h[live] = _turn(h[live] ^ ((word[at[live]] & np.uint64(0xFF)) * P5), 11) * P1
            at[live] += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


# --- fingerprints ----------------------------------------------------------------


def fingerprints(data: np.ndarray, offsets: np.ndarray, k: int = K) -> np.ndarray:
    """The fingerprint of each row of a piece of a text column."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    row, start, end, _ = hashed_words(data, offsets)
    if not len(row):
        return out
    # the words in lower case with one space after each
    size = end - start
    first = np.concatenate(([0], np.cumsum(size + 1)))
    joined = np.full(first[-1], _SPACE)
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)  # a byte's place in its word
    joined[np.repeat(first[:-1], size) + inner] = _LOWER[data[np.repeat(start, size) + inner]]
    count = np.bincount(row, minlength=len(out))
    before = np.concatenate(([0], np.cumsum(count)))[row]
    index = np.arange(len(row))
    left = before + count[row] - index  # words from this one to the end of its text
    heads = np.flatnonzero((left >= k) | (index == before))
    last = np.minimum(heads + k, before[heads] + count[row[heads]]) - 1
    h = xxh64(joined, first[heads], first[last] + size[last])
    owner = row[heads]
    begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    shingles = np.diff(np.concatenate((begins, [len(owner)])))
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little")
    out[owner[begins]] = packed.reshape(-1).view("<u8")
    return out


def _marker(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, high - low), pa.array(fingerprints(data, offsets, k).view(np.int64))],
                    names=["doc_id", "fp"])

    return run


# --- the Golay code --------------------------------------------------------------


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the code's generator polynomial, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, 0b101011100011 << (bit - 11), 0)
    return rest


def _errors() -> np.ndarray:
    """The one error of at most three bits for each of the 2,048 syndromes."""
    single = 1 << np.arange(23)
    two = (single[:, None] ^ single[None, :])[np.triu_indices(23, 1)]
    three = np.unique([a ^ b for a in two for b in single if a != (a | b)])
    every = np.concatenate([[0], single, two, three[np.array([bin(int(x)).count("1") == 3 for x in three])]])
    table = np.zeros(1 << 11, np.int64)
    table[_syndromes(every)] = every
    return table


_ERROR = _errors()
_HIGH, _LOW = _syndromes(np.arange(1 << 12) << 11), np.arange(1 << 11)


def codeword(words: np.ndarray) -> np.ndarray:
    """Number, from 0 to 4,095, of the codeword within three bits of each 23-bit word."""
    return (words ^ _ERROR[_HIGH[words >> 11] ^ _LOW[words & 2047]]) >> 11


def fuzzy_keys(segment: np.ndarray, bits: int) -> list[np.ndarray]:
    """The codewords of each segment and of all words one bit away, each once."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    found = np.sort(codeword(segment[:, None] ^ flips[None, :]), axis=1)
    new = np.concatenate([np.ones((len(found), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
    return np.split(found[new], np.cumsum(new.sum(axis=1))[:-1])


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): every fingerprint's keys, of (choice, intact segment, fuzzy key of the next)."""
    parts = [((fps >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    rows, out = [], []
    for i in range(3):
        j = (i + 1) % 3
        codes = fuzzy_keys(parts[j], SEGMENTS[j][1])
        row = np.repeat(np.arange(len(fps)), [len(c) for c in codes])
        rows.append(row)
        out.append((i << 34) | (parts[i][row] << 12) | np.concatenate(codes))
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            row, key = keys(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(key)], names=["fp", "key"])


# --- components ------------------------------------------------------------------


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, root): the least fingerprint each one of distinct ``fps`` (fp) reaches, of those that reach another."""
    keyed = stored(fps.select("fp").mapInArrow(_keyed, "fp bigint, key bigint"), "keys")
    shared = keyed.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last")).filter(
        F.col("first") < F.col("last"))
    met = stored(keyed.join(shuffled(shared), "key"), "met")
    ends = met.select("fp", F.explode(F.array("first", "last")).alias("to")).filter(
        (F.col("fp") != F.col("to")) & (_apart("fp", "to") <= DISTANCE))
    links = stored(ends.select(F.greatest("fp", "to").alias("a"), F.least("fp", "to").alias("b")).distinct(), "links")
    labels = stored(components(links), "labels")
    placed = met.select("key", "fp").join(shuffled(labels.withColumnRenamed("id", "fp")), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter(
        F.col("low") < F.col("high")).select("key")
    open_ = stored(met.select("key", "fp").join(shuffled(several), "key").select("fp").distinct(), "open")
    bits = F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)])
    words = open_.select("fp", F.explode(F.concat(F.array("fp"), F.transform(
        bits, lambda b: F.col("fp").bitwiseXOR(b)))).alias("word"))
    least = words.groupBy("word").agg(F.min("fp").alias("to"), F.max("fp").alias("most")).filter(
        F.col("to") < F.col("most")).drop("most")
    close = words.join(shuffled(least), "word").filter(F.col("fp") != F.col("to")).select(F.col("fp").alias("a"), F.col("to").alias("b"))
    more = stored(close.distinct(), "close")
    if not more.isEmpty():
        labels = stored(components(links.union(more)), "labels")
    return labels.select(F.col("id").alias("fp"), F.col("component").alias("root"))


def simhash_copies(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    marked = stored(docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
        _marker(k), "doc_id bigint, fp bigint"), "marked")
    fps = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "fps")
    rooted = fps.join(shuffled(fingerprint_components(fps)), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    # documents whose fingerprint is theirs alone and linked with none need no look-up
    named = stored(rooted.join(shuffled(smallest), "root").filter((F.col("copies") > 1) | ~F.col("component_id").eqNullSafe(F.col("least")))
                   .select("fp", "component_id"), "named")
    return marked.join(shuffled(named), "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
