"""Toxicity: a weighted lexicon found by Aho-Corasick in folded text.

Folding undoes disguises: case, full-width letters, look-alike letters of
other scripts, digits and signs for letters, invisible characters.  Letters
that one digit can stand for fall together (i, l and 1), in texts and lexicon
alike.  Punctuation becomes a space, so terms match at the start of a word.

The lexicon is learned from labelled rows of the training fold: beginnings of
words (3 to 8 letters) and whole words, by the log-likelihood ratio of their
document counts in toxic and other rows; of nested terms the strongest stays.
A term's weight is its smoothed log odds.  Word pairs around a term that occur
in other rows only become exception phrases: a term inside one does not count.
The score is a logistic function of the summed weights and of their density
per word, fitted on the same rows.

The lexicon and the fit use a bounded sample: SAMPLE labelled rows of each
class, those of the least hash.  In the fit a row of the sample stands for as
many rows as its class has in the training fold for one in the sample, so a
score means the same however large the tables are.  What is broadcast is bounded by it: the
sample's ids, and at most TERMS terms and PHRASES phrases.  Scoring is one pass
over the texts without a shuffle.

Defined cases: a null text is empty; an empty text has no hits and gets the
fit's lowest score; without toxic labelled rows every score is 0; a null
doc_id is not held out and never trained on; repeated rows are scored each;
a document with several labels is trained on with its largest.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.session import ship_package

SAMPLE, TERMS, PHRASES = 5000, 2000, 2000
LEAST_RATIO = 20.0  # log-likelihood ratio of a term; about one chance term in 100,000
LEAST_DOCS, SHORTEST, LONGEST = 3, 3, 8
EXCEPTION_DOCS = 5  # other rows that must hold an exception phrase
THRESHOLD = 0.7

#: Cyrillic and Greek letters that look like Latin ones.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m",
    "т": "t", "в": "b", "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}
_INVISIBLE = "​‌‍⁠﻿­"
_FOLD = {ord(a): b for a, b in {**LOOK_ALIKES, **SUBSTITUTES}.items()}
_FOLD.update({0xFF41 + i: _FOLD.get(97 + i, chr(97 + i)) for i in range(26)})
_FOLD.update({ord(c): None for c in _INVISIBLE})
_FOLD.update({ord(c): " " for c in "\t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|/\\*#%&+=_-~^`"})


def fold(text: str) -> str:
    return f" {text.lower().translate(_FOLD)} "


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training fold."""
    return labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).filter(~held_out(F.col("doc_id")))


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of at most SAMPLE rows of each class from the training fold."""
    known = training_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("toxic") == kind).orderBy(*order).limit(SAMPLE) for kind in (0, 1)]
    picked = chosen[0].unionByName(chosen[1])
    once = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    return once.join(F.broadcast(picked), "doc_id").select("text", "toxic")  # 2 * SAMPLE rows at most


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        terms = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            seen = set()
            for word in set(fold(text).split()):
                seen.update(word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1))
                if LONGEST < len(word) <= 24:
                    seen.add(word)
            counts[toxic].update(seen)
            if len(counts[0]) + len(counts[1]) > 200_000:
                yield flush()
    yield flush()


def _ratio(a: Column, b: Column, all_a: int, all_b: int) -> Column:
    """Log-likelihood ratio of a term in ``a`` of ``all_a`` toxic and ``b`` of ``all_b`` other rows."""

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(F.lit(0.0))

    both = (a + b) / F.lit(float(all_a + all_b))
    return 2 * (part(a, both * all_a) + part(b, both * all_b)
                + part(all_a - a, (1 - both) * all_a) + part(all_b - b, (1 - both) * all_b))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    a, b = F.col("toxic"), F.col("other")
    counted = sample.mapInArrow(_count_terms, "term string, toxic bigint, other bigint").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(
        (a >= LEAST_DOCS) & (a / toxic > 4 * b / other)).withColumn("ratio", _ratio(a, b, toxic, other)).filter(
        F.col("ratio") >= LEAST_RATIO)
    strongest = counted.orderBy(F.desc("ratio"), F.desc(F.length("term")), "term").limit(10 * TERMS).collect()
    lexicon: dict[str, float] = {}
    longer: set[str] = set()  # beginnings of accepted terms
    for row in strongest:
        term = row["term"]
        if len(lexicon) == TERMS:
            break
        if term in longer or any(term[:n] in lexicon for n in range(SHORTEST, len(term))):
            continue
        lexicon[term] = math.log((row["toxic"] + 0.5) / (toxic + 1)) - math.log((row["other"] + 0.5) / (other + 1))
        longer.update(term[:n] for n in range(1, len(term)))
    return lexicon


class Scanner:
    """The automaton of terms and exception phrases."""

    def __init__(self, lexicon: dict[str, float], phrases: list[str]):
        self.lexicon, self.phrases = lexicon, phrases
        self.machine = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "phrases": self.phrases, "machine": None}

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(start, term) of the terms outside exception phrases; of nested terms each counts."""
        if not self.lexicon:
            return []
        if self.machine is None:  # built once per worker
            self.machine = ahocorasick.Automaton()
            for term in self.lexicon:
                self.machine.add_word(" " + term, (False, term))
            for phrase in self.phrases:
                self.machine.add_word(f" {phrase} ", (True, phrase))
            self.machine.make_automaton()
        terms, masked = [], []
        for end, (exempt, what) in self.machine.iter(text):
            (masked if exempt else terms).append((end - len(what) - (1 if exempt else 0), end, what))
        return [(a, what) for a, b, what in terms if not any(x <= a and b <= y for x, y, _ in masked)]

    def features(self, text: str) -> tuple[float, float, int]:
        folded = fold(text)
        found = self.hits(folded)
        total = sum(self.lexicon[t] for _, t in found)
        return math.log1p(total), math.log1p(100 * total / max(20, len(folded.split()))), len(found)


def _around(shared):
    """Word pairs around terms, with how many toxic and other rows hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, counts = shared.value, (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, pairs = fold(text), set()
                for start, _ in scanner.hits(folded):
                    before, after = folded[max(0, start - 40):start].split(), folded[start:start + 80].split()
                    pairs.update(" ".join(p) for p in ([*before[-1:], *after[:1]], after[:2]) if len(p) == 2)
                # a folded text may have several spaces in a row; such pairs never match and do no harm
                counts[toxic].update(pairs)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "other"])

    return run


def _measured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, _ = zip(*[shared.value.features(t) for t in batch.column(0).to_pylist()]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(y, pa.float64()), batch.column(1)],
                                             names=["total", "density", "toxic"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, stands_for: np.ndarray | float = 1.0, ridge: float = 0.1) -> np.ndarray:
    """Weights (last: intercept) by Newton's steps with a small ridge; a row counts as the rows it stands for."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (stands_for * (p * (1 - p)) + 1e-9)[:, None]).T @ x + penalty, x.T @ (stands_for * (p - y)) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame) -> tuple[Scanner, list[float]]:
    """Lexicon, exceptions and fit, all of bounded size."""
    context = docs.sparkSession.sparkContext
    sample = training_sample(docs, labels)
    lexicon = learn_lexicon(sample)
    if not lexicon:
        return Scanner({}, []), []
    pairs = sample.mapInArrow(_around(context.broadcast(Scanner(lexicon, []))), "term string, toxic bigint, other bigint")
    exempt = pairs.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter(
        f"toxic = 0 and other >= {EXCEPTION_DOCS}").orderBy(F.desc("other"), "term").limit(PHRASES)
    scanner = Scanner(lexicon, [r["term"] for r in exempt.collect()])
    rows = sample.mapInArrow(_measured(context.broadcast(scanner)), "total double, density double, toxic int").collect()
    data = np.array([[r["total"], r["density"], r["toxic"]] for r in rows])
    sizes = {r["toxic"]: r["n"] for r in training_labels(labels).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    stands_for = np.array([max(1.0, sizes.get(kind, 0) / SAMPLE) for kind in (0, 1)])[data[:, 2].astype(int)]
    return scanner, fit_logistic(data[:, :2], data[:, 2], stands_for).tolist()


def _scored(shared, weights: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in batches:
            measured = [scanner.features(t.as_py() or "") for t in batch.column(2)]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, weights[0] * a + weights[1] * b + weights[2])))) if weights else 0.0
                      for a, b, _ in measured]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array([n for *_, n in measured], pa.int64())],
                names=["doc_id", "held_out", "score", "predicted", "n_hits"])

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits) of every row of ``docs`` (doc_id, text)."""
    ship_package(docs.sparkSession)
    scanner, weights = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"]).mapInArrow(
        _scored(shared, weights), "doc_id bigint, held_out boolean, score double, predicted int, n_hits bigint")
