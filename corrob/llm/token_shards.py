"""Token ids in training order: a keyed permutation of fixed-length sequences, in fixed-stride shards.

1. Texts are tokenised once; every text ends with the end-of-text id.  The
   token table is written with each row's part and its offset there, which
   fixes the order of the stream: all later steps see the same table, and a
   lost executor repeats only its own tasks.
2. The parts' sums (one number per part) give every token its place in the
   whole stream; sequence q holds the tokens from q * length on, so only the
   last one is padded.
3. A Feistel network over the least even number of bits that holds all
   sequences, walked until it lands below their number, permutes q to a slot.
   Each sequence computes its slot alone: no sort, no random numbers to keep.
4. A shard is a range of slots of fixed size, a task is a shard, and its rows
   come in slot order with the same number of bytes each.  Slot s is row
   s mod rows of shard s div rows, so a reader that stopped at s goes on from
   there, and every shard is equally large whatever the documents are.

Defined cases: a null or empty text is one end-of-text id; repeated rows are
in the stream as often as they occur; a null doc_id is listed as null; an
empty table has no sequences; runs of over RUN characters of a kind (blank or
not) are tokenised in pieces of RUN, which decode to the same text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrob.llm.common import stored
from corrob.llm.wordhash import mix
from corrob.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH, ROWS_PER_SHARD, KEY, ROUNDS, RUN = 2048, 4096, 20240131, 6, 4096
#: The published pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = re.compile(rf"\S{{{RUN + 1},}}|\s{{{RUN + 1},}}")
_encodings: dict[int, tiktoken.Encoding] = {}


def _encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a vocabulary file's content, once per worker."""
    mark = hash(ranks)
    if mark not in _encodings:
        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        _encodings[mark] = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encodings[mark]


def _pieces(text: str) -> list[str]:
    if len(text) <= RUN or not _LONG.search(text):
        return [text]
    out, at = [], 0
    for run in _LONG.finditer(text):
        out.append(text[at:run.start()])
        out += [text[i:min(i + RUN, run.end())] for i in range(run.start(), run.end(), RUN)]
        at = run.end()
    return [*out, text[at:]]


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slot of each sequence below ``n``: a keyed Feistel permutation with cycle walking."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) + np.uint64(key * 0x9E3779B97F4A7C15 % 2**64))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        return (left << shift) | right

    slot = once(index.astype(np.uint64))
    while (outside := slot >= np.uint64(n)).any():
        slot[outside] = once(slot[outside])
    return slot.astype(np.int64)


def _tokeniser(ranks, end: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, part, start = _encoding(ranks.value), TaskContext.get().partitionId(), 0
        close = np.array([end], kind).tobytes()
        for batch in batches:
            bodies, starts, counts = [], [], []
            for text in batch.column(1):
                ids = [encoding.encode_to_numpy(p, disallowed_special=()) for p in _pieces(text.as_py() or "")]
                body = b"".join(x.astype(kind).tobytes() for x in ids) + close
                bodies.append(body)
                starts.append(start)
                counts.append(len(body) // len(close))
                start += counts[-1]
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * batch.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()),
                batch.column(0), pa.array(bodies, pa.binary())], names=["part", "start", "n", "doc_id", "tokens"])

    return run


def _cutter(offsets, total: int, length: int, width: int, rows: int, key: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = -(-total // length)
        for batch in batches:
            part, start, count = (batch.column(i).to_numpy() for i in range(3))
            begin = np.array([offsets[p] for p in part.tolist()], np.int64) + start
            first, last = begin // length, (begin + count - 1) // length
            of = np.repeat(np.arange(batch.num_rows), last - first + 1)
            q = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of]
            low, high = np.maximum(q * length, begin[of]), np.minimum((q + 1) * length, (begin + count)[of])
            slot = permute(q, n, key)
            bodies = batch.column(4)
            cuts = _with_bodies(bodies, of.tolist(), ((low - begin[of]) * width).tolist(), ((high - begin[of]) * width).tolist())
            yield pa.RecordBatch.from_arrays([
                pa.array((slot // rows).astype(np.int32)), pa.array(slot), pa.array((low - q * length).astype(np.int32)),
                batch.column(3).take(pa.array(of)),
                pa.array([body[a:b] for body, a, b in cuts], pa.binary())],
                names=["shard", "slot", "at", "doc_id", "tokens"])

    return run


def _with_bodies(bodies: pa.Array, rows: list[int], begins: list[int], ends: list[int]) -> Iterator[tuple[bytes, int, int]]:
    """Each cut with its row's bytes, fetched once per row."""
    at, body = -1, b""
    for i, a, b in zip(rows, begins, ends):
        if i != at:
            at, body = i, bodies[i].as_py()
        yield body, a, b


def _joiner(length: int, rows: int, end: int, kind: str):
    """Rows of one shard, sorted by slot and place, joined to whole sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = np.dtype(kind).itemsize
        pad = np.array([end], kind).tobytes()
        now: list = []  # shard, slot, document ids, places, tokens
        done: list = []

        def flush() -> pa.RecordBatch:
            shard, slot, ids, places, bodies = zip(*done)
            tokens = [b"".join(b) for b in bodies]
            batch = pa.RecordBatch.from_arrays([
                pa.array(shard, pa.int32()), pa.array(slot, pa.int64()),
                pa.array([(s % rows) * length * width for s in slot], pa.int64()),
                pa.array([len(t) // width for t in tokens], pa.int32()), pa.array(ids, pa.list_(pa.int64())),
                pa.array(places, pa.list_(pa.int32())), pa.array([t + pad * (length - len(t) // width) for t in tokens], pa.binary())],
                names=["shard", "slot", "byte_offset", "n_tokens", "doc_ids", "doc_starts", "tokens"])
            done.clear()
            return batch

        for batch in batches:
            for shard, slot, at, doc, tokens in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if not now or now[1] != slot:
                    if now:
                        done.append(now)
                    now = [shard, slot, [], [], []]
                    if len(done) == 512:
                        yield flush()
                now[2].append(doc)
                now[3].append(at)
                now[4].append(tokens)
        if now:
            done.append(now)
        if done:
            yield flush()

    return run


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, rows_per_shard: int = ROWS_PER_SHARD,
                   key: int = KEY) -> DataFrame:
    """(shard, slot, byte_offset, n_tokens, doc_ids, doc_starts, tokens), one row per sequence.

    ``tokens`` are little-endian ids of two bytes (four for vocabularies of
    65,536 and more), the same number of bytes in every row.  Partitions are
    shards, in slot order inside.
    """
    spark = docs.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as file:  # the driver's copy; a few MB at most
        ranks = file.read()
    end = max(int(line.split()[1]) for line in ranks.splitlines() if line) + 1
    kind = "<u2" if end < 65536 else "<u4"
    tokens = stored(docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
        _tokeniser(spark.sparkContext.broadcast(ranks), end, kind),
        "part int, start bigint, n bigint, doc_id bigint, tokens binary"), "tokens")
    sums = sorted(tokens.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per part
    offsets, total = {}, 0
    for row in sums:
        offsets[row["part"]] = total
        total += row["n"]
    shards = max(1, -(-(-(-total // length)) // rows_per_shard))
    pieces = tokens.mapInArrow(_cutter(offsets, total, length, np.dtype(kind).itemsize, rows_per_shard, key),
                               "shard int, slot bigint, at int, doc_id bigint, tokens binary")
    return pieces.repartitionById(shards, F.col("shard")).sortWithinPartitions("slot", "at").mapInArrow(
        _joiner(length, rows_per_shard, end, kind),
        "shard int, slot bigint, byte_offset bigint, n_tokens int, doc_ids array<bigint>, doc_starts array<int>, tokens binary")


def write_shards(sequences: DataFrame, path: str) -> None:
    """One folder with one file per shard; file and row give the slot."""
    sequences.write.partitionBy("shard").parquet(path)


def read_from(spark: SparkSession, path: str, slot: int, rows_per_shard: int = ROWS_PER_SHARD) -> DataFrame:
    """The sequences from ``slot`` on; shards before it are not opened."""
    later: Column = F.col("shard") >= slot // rows_per_shard
    return spark.read.parquet(path).filter(later & (F.col("slot") >= slot))
