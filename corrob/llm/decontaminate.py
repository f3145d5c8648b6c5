"""Benchmark decontamination: BM25 with block-max WAND, then overlap of question and answer.

The index holds the test items: for each of their words the items with it and
the BM25 weight there, divided by what the item would score against itself, so
a score is the share of the item that a passage explains.

Words are compared in lower case and without punctuation.  Every document is
cut into overlapping passages, twice as long as the longest item, so some
passage holds most of any copied item.  As in WAND, words that cannot lift an
item over the threshold are not followed: the bound is kept per block of one
item, whose most used words (by a count of the first texts seen) are skipped as
long as their weights stay below SLACK.  Items that the other words of a
passage bring within reach are scored in full, and all from the threshold up
are retrieved (no top k).  All passages of a few megabytes of texts go through
one set of array operations.  Each item retrieved is verified on the whole
document: the last sentence of an item is its answer, the rest its question,
and three-word shingles of both must be there.

Test items are indexed in blocks of bounded size (INDEX_BYTES), one pass over
the documents per block; that bounds what is broadcast however many items
there are.

Defined cases: a null text or an item without words matches nothing; repeated
documents and items are each reported; an empty benchmark gives no matches; a
document without doc_id is reported with a null one (and dropped by ``clean``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrob.llm.wordhash import blanks_and, hashed_words, mix, text_slices
from corrob.session import ship_package

INDEX_BYTES = 16 << 20  # of item texts per index
K1, B = 1.2, 0.75  # BM25
THRESHOLD = 0.4  # of an item's score against itself
OVERLAP, WHOLE_OVERLAP = 0.5, 0.8  # of question and of answer, or of both together
SLACK = 0.25  # of an item's weight that its most used words may have outside the candidate search
SHINGLE, LEAST_PASSAGE = 3, 64
_SEPARATORS = blanks_and(".,;:!?\"'()[]")
_FILTER_BITS = 20


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Pieces of a column in lower case, of all scripts."""
    return text_slices(pc.utf8_lower(texts.cast(pa.large_string())))


def _hashes(text: str) -> np.ndarray:
    return np.concatenate([hashed_words(data, offsets, _SEPARATORS)[3] for _, _, data, offsets in _pieces(pa.array([text]))])


def _shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    if not 0 < n <= len(hashes):
        return hashes[:0]
    weights = [np.uint64(2 * j + 3) for j in range(n)]
    return mix(sum(hashes[j:len(hashes) - n + 1 + j] * weights[j] for j in range(n)))


class Index:
    """Posting lists of one block of items, and each item's essential words."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        hashes = [_hashes(t) for _, t in items]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        row = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
        length = np.bincount(row, minlength=len(items))
        self.longest = int(length.max(initial=0))
        # postings, sorted by word, then item
        pairs, frequency = np.unique(np.stack([h, row.astype(np.uint64)]), axis=1, return_counts=True)
        self.words, self.word, having = np.unique(pairs[0], return_inverse=True, return_counts=True)
        self.item = pairs[1].astype(np.int64)
        n = max(1, len(items))
        rarity = np.log(1 + (n - having + 0.5) / (having + 0.5))[self.word]
        norm = K1 * (1 - B + B * length[self.item] / max(1.0, length.mean() if len(length) else 1.0))
        weight = rarity * frequency * (K1 + 1) / (frequency + norm)
        self.weight = weight / np.bincount(self.item, weights=weight, minlength=len(items))[self.item]
        self.of_item = np.split(np.argsort(self.item, kind="stable"), np.cumsum(np.bincount(self.item, minlength=len(items)))[:-1])
        self.possible = np.zeros(1 << _FILTER_BITS, bool)
        self.possible[self.words & np.uint64((1 << _FILTER_BITS) - 1)] = True
        self.parts = [self._parts(t) for _, t in items]
        self.essential = None
        self.tune(having)

    @staticmethod
    def _parts(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of question and answer; of a single sentence both are the whole."""
        sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
        pieces = (" ".join(sentences[:-1]), sentences[-1]) if len(sentences) > 1 else (text, text)
        return tuple(np.unique(_shingles(h, min(SHINGLE, len(h)))) for h in map(_hashes, pieces))

    def tune(self, uses: np.ndarray) -> None:
        """Choose each item's essential words for words of the given numbers of uses.

        The most used words of an item that together weigh less than SLACK of
        it are left out of the candidate search: a passage at the threshold
        must make up the rest from the others.  Any numbers give the same
        matches; good ones give fewer candidates.
        """
        order = np.lexsort((-uses[self.word], self.item))
        weight = self.weight[order]
        total = np.cumsum(weight)
        first = np.searchsorted(self.item[order], np.arange(len(self.ids)))
        before = np.concatenate(([0.0], total))[first]
        skipped = (total - before[self.item[order]]) < SLACK
        self.slack = np.bincount(self.item[order], weights=weight * skipped, minlength=len(self.ids))
        kept = np.sort(order[~skipped])  # by word again
        self.essential = kept
        self.bounds = np.searchsorted(self.word[kept], np.arange(len(self.words) + 1))

    def retrieve(self, word: np.ndarray, passage: np.ndarray) -> list[tuple[int, int, float]]:
        """(passage, item, score) of every item that a passage's words score at the threshold or above.

        ``word`` holds the indexed words in order of occurrence, ``passage`` the passages they are in.
        """
        counts = (self.bounds[1:] - self.bounds[:-1])[word]
        use = np.flatnonzero(counts)
        word_, passage_, counts = word[use], passage[use], counts[use]
        if not len(use):
            return []
        place = np.repeat(self.bounds[word_] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        # a word counts once in a passage
        distinct = np.unique(np.repeat(passage_, counts) * len(self.essential) + place)
        posting, where = self.essential[distinct % len(self.essential)], distinct // len(self.essential)
        pair, at = np.unique(where * len(self.ids) + self.item[posting], return_inverse=True)
        bound = np.bincount(at, weights=self.weight[posting]) + self.slack[pair % len(self.ids)]
        out = []
        order = np.argsort(passage, kind="stable")
        word, passage = word[order], passage[order]
        for p in pair[bound >= THRESHOLD - 1e-12].tolist():
            where, item = divmod(p, len(self.ids))
            low, high = np.searchsorted(passage, [where, where + 1])
            mine = self.of_item[item]
            score = float(self.weight[mine][np.isin(self.word[mine], word[low:high])].sum())
            if score >= THRESHOLD:
                out.append((where, item, score))
        return out

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of all verified items."""
        out: list[tuple[int, int, float, float, float]] = []
        if not len(self.words) or not len(data):
            return out
        row, _, _, h = hashed_words(data, offsets, _SEPARATORS)
        maybe = np.flatnonzero(self.possible[h & np.uint64((1 << _FILTER_BITS) - 1)])
        spot = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        hit = self.words[spot] == h[maybe]
        place, word = maybe[hit], spot[hit]
        if not self.tuned:
            self.tune(np.bincount(word, minlength=len(self.words)))
            self.tuned = True
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        # passage k of a document begins at its word k * half and is two halves long
        half = max(LEAST_PASSAGE, 2 * self.longest) // 2
        doc = row[place]
        first = np.concatenate(([0], np.cumsum((bounds[1:] - bounds[:-1]) // half + 1)))  # passages of the documents before
        k = (place - bounds[doc]) // half
        second = k > 0
        passages = np.concatenate([first[doc] + k, (first[doc] + k - 1)[second]])
        best: dict[tuple[int, int], float] = {}
        for passage, item, score in self.retrieve(np.concatenate([word, word[second]]), passages):
            key = (int(np.searchsorted(first, passage, "right")) - 1, item)
            best[key] = max(best.get(key, 0.0), score)
        there, of = None, -1
        for (d, i), score in sorted(best.items()):
            if d != of:
                words = h[bounds[d]:bounds[d + 1]]
                there, of = np.unique(np.concatenate([_shingles(words, n) for n in range(1, SHINGLE + 1)])), d
            question, answer = (np.isin(p, there) for p in self.parts[i])
            q, r = (float(x.mean()) if len(x) else 0.0 for x in (question, answer))
            whole = float(np.concatenate([question, answer]).mean()) if len(question) + len(answer) else 0.0
            if (q >= OVERLAP and r >= OVERLAP) or whole >= WHOLE_OVERLAP:
                out.append((d, i, score, q, r))
        return out

    tuned = False


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size that together hold all items."""
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"]).filter(
        F.length(F.trim("text")) > 0)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * total / INDEX_BYTES))
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r["item_id"], r["text"]) for r in mine.collect()])  # INDEX_BYTES at most, by the division above


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every item found in a document."""
    ship_package(docs.sparkSession)
    out = None
    for index in indexes(benchmark):
        part = docs.select(docs["doc_id"].cast("bigint"), docs["text"]).mapInArrow(
            _finder(docs.sparkSession.sparkContext.broadcast(index)),
            "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.unionByName(part)
    return out


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for low, _, data, offsets in _pieces(batch.column(1)):
                if found := index.matches(data, offsets):
                    row, item, score, q, a = zip(*found)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array([low + r for r in row])),
                        pa.array([index.ids[i] for i in item], pa.int64()), pa.array(score), pa.array(q), pa.array(a)],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no test item was found; one pass, no join."""
    ship_package(docs.sparkSession)
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index("text")
        docs = docs.mapInArrow(_sieve(shared, at), docs.schema)
    return docs


def _sieve(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for low, _, data, offsets in _pieces(batch.column(at)):
                keep[[low + m[0] for m in index.matches(data, offsets)]] = False
            yield batch.filter(pa.array(keep))

    return run
