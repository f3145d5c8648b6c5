"""Removing byte strings that occurred before, by induction from sorted sample suffixes.

Every byte covered by a string of LENGTH bytes that also starts earlier (in an
earlier document, or earlier in the same one) is removed.  Sorting all suffixes
would move many times the corpus; here, as in induced sorting, only a sample of
suffixes is sorted and the others' order is derived from it:

1. Sample.  A window is a string of LENGTH bytes; its sample position is the
   start of its least GRAM-byte hash (leftmost of equals).  Equal windows have
   it at the same place, and neighbouring windows mostly share it, so about
   one position in 35 is sampled, with the run of windows it stands for.
2. Sorting.  A sample is a tuple of the gram's hash and the hash of its context
   (all bytes of its windows).  The tuples are sorted over the cluster by a
   range partitioning and Spark's spilling sort.  In a run of equal tuples all
   but the first are repeats, windows and all.
3. Induction.  What is left are first occurrences of a context whose gram also
   stands in other contexts, that is, the ends of repeats.  Their windows are
   sorted by a common core of CORE bytes, then, where a core repeats, each
   window by its bytes left and right of the core.  Of equal windows all but
   the first are repeats.
4. The repeats of a document are merged and cut out.

Steps 2 and 3 read sorted partitions as streams and keep one row; groups are
never gathered.  Within a batch of documents equal tuples are reduced to their
first before the shuffle, and a gram with many contexts is spread by the range
partitioning (a group cut by a partition's end is passed on to step 3, which
is exact).  Strings are compared by 64-bit hashes of grams, contexts and cores.

Defined cases: a null text is empty; a text shorter than LENGTH loses nothing;
rows that repeat a doc_id are one document (the same text is expected) and get
the same result; rows without doc_id neither lose bytes nor cause losses; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import stored
from corrob.llm.wordhash import _powers, mix, text_slices
from corrob.session import ship_package

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1  # gram positions of a window
BLOCK = 23  # windows of one core; SPAN is a multiple
CORE = LENGTH - BLOCK + 1
FLAG = 1 << 15  # marks a sample already known to be a repeat

_rng = np.random.default_rng(5)
_GRAM_BYTE, _CONTEXT_BYTE = (_rng.integers(1, 2**63, 256, dtype=np.uint64) for _ in range(2))


def _prefix(values: np.ndarray, data: np.ndarray, up: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[:len(data)], out=out[1:])
    return out


def samples(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, gram hash, context hash, first window, last window, position) of every sample position."""
    counts = np.maximum(0, np.diff(offsets) - LENGTH + 1)
    if not counts.sum():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    up, down = _powers(len(data) + 1)
    prefix = _prefix(_GRAM_BYTE, data, up)
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * down[:len(data) - GRAM + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:len(least) - (SPAN - width)], least[SPAN - width:])
    row = np.repeat(np.arange(len(counts)), counts)
    window = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][row]
    place = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
    last = np.append(first[1:], len(place)) - 1
    begin, end, place = window[first], window[last], place[first]
    around = _prefix(_CONTEXT_BYTE, data, up)
    context = mix((around[end + LENGTH] - around[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return row[first], gram[place], context, begin, end, place


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples of a batch; of equal ones only the first keeps its tuple, the others are marked."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for low, _, data, offsets in text_slices(batch.column(1), 2 << 20):
            row, gram, context, begin, end, place = samples(data, offsets)
            if not len(row):
                continue
            doc = ids[low + row].astype(np.int64)
            start = begin - offsets[row]
            packed = (start << 16) | ((place - begin) << 8) | (end - begin)
            order = np.lexsort((start, doc, context, gram))
            g, c, d, s = gram[order], context[order], doc[order], start[order]
            fresh = np.append(True, (g[1:] != g[:-1]) | (c[1:] != c[:-1]))
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            later = (d != d[head]) | (s != s[head])
            again = order[later]
            packed[again] |= FLAG
            gram[again] = mix(doc[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start[again].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(packed)],
                names=["gram", "context", "doc", "packed"])


def _first_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted samples to (doc, packed, gram): repeats with a null gram, ends of repeats with theirs."""
    key = mark = first = held = None  # of the current run: gram, context, first (doc, start), a sample not yet passed on
    edge = True  # the partition's first gram may have begun in the partition before
    for batch in batches:
        gram, context, doc, packed = (batch.column(i).to_numpy() for i in range(4))
        known = packed & FLAG != 0
        out = [(doc[known], packed[known] & ~FLAG, np.zeros(known.sum(), np.int64), np.ones(known.sum(), bool))]
        gram, context, doc, packed = (x[~known] for x in (gram, context, doc, packed))
        n = len(gram)
        if n:
            new_gram = np.append(key is None or gram[0] != key, gram[1:] != gram[:-1])
            new = new_gram | np.append(key is None or context[0] != mark, context[1:] != context[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            start = packed >> 16
            if at[0] < 0:  # goes on with the run of the batch before
                first_doc, first_start = np.where(at < 0, first[0], doc[at]), np.where(at < 0, first[1], start[at])
            else:
                first_doc, first_start = doc[at], start[at]
            again = (doc != first_doc) | (start != first_start)
            out.append((doc[again], packed[again], gram[again], np.ones(again.sum(), bool)))
            run = np.cumsum(new_gram)  # 0: the gram of the batch before
            heads = np.flatnonzero(new)
            several = np.bincount(run[heads], minlength=run[-1] + 1)
            if held is not None and several[0]:  # its gram has another context, anywhere in the batch
                out.append(tuple(np.array([x]) for x in held) + (np.zeros(1, bool),))
            if several[0] or run[-1]:
                held = None
            open_before = key is not None  # contexts seen in earlier batches of run 0
            multi = several > 1
            if open_before:
                multi[0] = True
            if edge:
                multi[0 if not new_gram[0] else 1 if len(multi) > 1 else 0] = True
            edge = edge and run[-1] <= (1 if key is None else 0)
            pick = heads[multi[run[heads]]]
            out.append((doc[pick], packed[pick], gram[pick], np.zeros(len(pick), bool)))
            if len(heads) and not multi[run[-1]] and run[heads[-1]] == run[-1]:
                held = (doc[heads[-1]], packed[heads[-1]], gram[heads[-1]])
            key, mark, first = gram[-1], context[-1], (first_doc[-1], first_start[-1])
        yield _found(out)
    if held is not None:
        yield _found([tuple(np.array([x]) for x in held) + (np.zeros(1, bool),)])


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    doc, packed, gram, repeat = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(packed.astype(np.int64)),
                                       pa.array(gram.astype(np.int64), mask=repeat)], names=["doc", "packed", "gram"])


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, packed samples) to the cores of their windows with the bytes around them."""
    for batch in batches:
        rows: list[tuple[int, int, int, int, int, bytes]] = []
        for doc, text, ends in zip(batch.column(0), batch.column(1), batch.column(2)):
            if not ends.is_valid:
                continue
            body = text.as_py().encode()
            for packed in ends.as_py():
                start, reach, more = packed >> 16, packed >> 8 & 0x7F, packed & 0x7F
                place = start + reach
                for block in range((reach - more) // BLOCK, reach // BLOCK + 1):
                    core = place - block * BLOCK
                    low, high = max(0, reach - more - block * BLOCK), min(BLOCK - 1, reach - block * BLOCK)
                    around = body[core - high:core] + body[core + CORE:core + CORE + BLOCK - 1 - low]
                    rows.append((_signed(xxhash.xxh3_64_intdigest(body[core:core + CORE])), doc.as_py(), core, low, high, around))
        if rows:
            key, doc, core, low, high, around = zip(*rows)
            yield pa.RecordBatch.from_arrays([
                pa.array(key, pa.int64()), pa.array(doc, pa.int64()),
                pa.array((np.array(core, np.int64) << 16) | (np.array(low, np.int64) << 8) | np.array(high, np.int64)),
                pa.array(around, pa.binary())], names=["core", "doc", "packed", "around"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cores to the windows of those that repeat; a partition's end counts as a repeat."""
    before, held = None, None

    def emit(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[int, int]] = {}
        extra: list[tuple[int, int, int]] = []  # repeats inside the batch
        for core, doc, packed, around in rows:
            place, low, high = packed >> 16, packed >> 8 & 0x7F, packed & 0x7F
            head = core.to_bytes(8, "little", signed=True)
            for t in range(low, high + 1):
                # t bytes from the left of the core, the others from its right
                key = _signed(xxhash.xxh3_64_intdigest(head + bytes([t]) + around[high - t:high + BLOCK - 1 - t]))
                mine = (doc, place - t)
                seen = made.setdefault(key, mine)
                if mine != seen:
                    made[key] = min(mine, seen)
                    late = max(mine, seen)
                    extra.append((_signed(xxhash.xxh3_64_intdigest(head + bytes([t]) + b"%d,%d" % late)), *late))
        if made:
            # a repeat inside the batch travels under a key of its own, flagged by a negative start
            keys = [*made, *(e[0] for e in extra)]
            docs = [*(m[0] for m in made.values()), *(e[1] for e in extra)]
            starts = [*(m[1] for m in made.values()), *(-1 - e[2] for e in extra)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64())],
                                             names=["window", "doc", "start"])

    for batch in batches:
        rows = ([held] if held else []) + list(zip(*(batch.column(i).to_pylist() for i in range(4))))
        if not rows:
            continue
        repeat = [before is None or rows[0][0] == before] + [rows[i][0] == rows[i - 1][0] for i in range(1, len(rows))]
        yield from emit([r for i, r in enumerate(rows[:-1]) if repeat[i] or repeat[i + 1]])
        held = rows[-1]
        if len(rows) > 1:
            before = rows[-2][0]
    if held:
        yield from emit([held])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows to (doc, packed) of all but the first of each."""
    key, first = None, None
    for batch in batches:
        window, doc, start = (batch.column(i).to_numpy() for i in range(3))
        known = start < 0
        out = [(doc[known], -1 - start[known])]
        window, doc, start = window[~known], doc[~known], start[~known]
        if len(window):
            new = np.append(key is None or window[0] != key, window[1:] != window[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(window)), -1))
            lead = first if first is not None else (0, 0)
            later = (doc != np.where(at < 0, lead[0], doc[at])) | (start != np.where(at < 0, lead[1], start[at]))
            out.append((doc[later], start[later]))
            key = window[-1]
            first = (doc[at[-1]], start[at[-1]]) if at[-1] >= 0 else first
        doc, start = (np.concatenate([p[i] for p in out]) for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int64) << 16)],
                                         names=["doc", "packed"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, found in zip(batch.column(0), batch.column(1), batch.column(2)):
            body = (text.as_py() or "").encode()
            gone = merged(found.as_py() if found.is_valid else [], len(body))
            kept, at = sha256(), 0
            for a, b in gone:
                kept.update(body[at:a])
                at = b
            kept.update(body[at:])
            rows.append((doc.as_py(), len(body), sum(b - a for a, b in gone), len(gone), kept.hexdigest(),
                         [{"start": a, "end": b} for a, b in gone]))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), _RESULT.types)], schema=_RESULT)


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()),
                     ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def merged(packed: list[int], limit: int) -> list[tuple[int, int]]:
    """Packed samples (start, windows after the first) as maximal byte ranges."""
    out: list[list[int]] = []
    for x in sorted(packed):
        a, b = x >> 16, min(limit, (x >> 16) + (x & 0x7F) + LENGTH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"])
    found = stored(
        texts.filter("doc_id is not null and octet_length(text) >= 100")
        .mapInArrow(_sampler, "gram bigint, context bigint, doc bigint, packed bigint")
        .repartitionByRange("gram", "context").sortWithinPartitions("gram", "context", "doc", "packed")
        .mapInArrow(_first_of_runs, "doc bigint, packed bigint, gram bigint"), "found")
    # both joins below read one shuffle of the texts: it is left as it is, without a filter
    ends = found.filter("gram is not null").groupBy("doc").agg(F.collect_list("packed").alias("packed"))
    cores = texts.join(ends, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "packed").mapInArrow(
        _cores, "core bigint, doc bigint, packed bigint, around binary")
    windows = cores.repartitionByRange("core", "doc").sortWithinPartitions("core", "doc").mapInArrow(
        _windows, "window bigint, doc bigint, start bigint")
    later = windows.repartition("window").sortWithinPartitions("window", "doc", "start").mapInArrow(
        _later, "doc bigint, packed bigint")
    gone = found.filter("gram is null").select("doc", "packed").unionByName(later).groupBy("doc").agg(
        F.collect_list("packed").alias("packed"))
    return texts.join(gone, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "packed").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
              "spans array<struct<start: bigint, end: bigint>>")
