"""Quality rules: counts of one text, and its distance to its language's reference.

A document is kept if it passes the counting rules and if neither of two
histograms strays from the average of its language: the share of character
classes, and the share of common words.  The distance is Jensen-Shannon's (the
square root of the divergence in bits, from 0 to 1).  Texts that are too short
for a histogram are not judged by it.  A language's average is drawn towards
that of all languages, as if it had PRIOR_DOCS more documents like them: the few
documents of a rare language do not set its reference alone, and no count
switches from one reference to another.

Everything is built-in expressions; a text is read once and its counts, a few
hundred bytes, are what the later steps see.  The references are sums with a
partial aggregate, so a language with most of the rows costs no more than
another.

Defined cases: a null text is empty and fails (too few words); a null language
is a language of its own; repeated rows are judged each by itself and count
each in the reference; an empty table gives an empty result; other columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import BLANK_RUN, BLANKS, count_of, let, stored, text_or_empty, words

#: The symbols the contract counts.
SYMBOLS = "#*$%&|<>"
#: The frequent words of English, German, French and Spanish.
COMMON_WORDS = ["the", "of", "and", "to", "der", "die", "und", "den", "le", "les", "et", "des", "el", "que", "los", "en",
                "de", "la"]
#: Classes of characters, in the order they are taken out; what is left is the last class.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", BLANKS, ".,;:'\"!?()-", SYMBOLS]

MIN_WORDS, MAX_REPEATED = 50, 50  # the counting rules: words at least, per cent of repeated words at most
MIN_CHARS_FOR_CLASSES, MIN_WORDS_FOR_WORDS = 200, 50  # shorter texts have no histogram worth judging
PRIOR_DOCS = 50  # documents of the average of all languages that every language's reference begins with
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.3, 0.4


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are compared by 64-bit hash.  Sorting (hash, position) puts equal
    windows next to each other; the covered words are then the gaps between
    the repeated windows' starts, three at most each.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.transform(
            F.filter(s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])), lambda e: e["i"]))
        return let(F.sort_array(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0), lambda a, b: a + b))

    windows = F.transform(F.sequence(F.lit(0), F.size(tokens) - 3),
                          lambda i: F.xxhash64(F.get(tokens, i), F.get(tokens, i + 1), F.get(tokens, i + 2)))
    return F.when(F.size(tokens) < 4, F.lit(0)).otherwise(let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))))


def class_counts(text: Column) -> Column:
    """Characters in each of CLASSES and, last, in none of them."""

    def take_out(rest: Column, left: list[str], so_far: list[Column]) -> Column:
        if not left:
            return F.array(*so_far, F.length(rest))
        # letters come in runs: for them one replacement per run is cheaper
        without = F.regexp_replace(rest, "[a-z]+", "") if left[0][0] == "a" else F.translate(rest, left[0], "")
        return let(without, lambda r: take_out(r, left[1:], [*so_far, F.length(rest) - F.length(r)]))

    return let(text, lambda t: take_out(t, CLASSES, []))


def common_counts(tokens: Column) -> Column:
    """Occurrences of each of COMMON_WORDS and, last, of any other word."""

    def equal_to(x: str):
        return lambda w: w == x

    hits = F.filter(tokens, lambda w: w.isin(COMMON_WORDS))
    return let(hits, lambda c: F.array(
        *[F.size(F.filter(c, equal_to(x))) for x in COMMON_WORDS], F.size(tokens) - F.size(c)))


def measures(text: Column) -> Column:
    """All counts of one text as a struct."""

    def of(t: Column, tokens: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
        return F.struct(
            F.size(tokens).cast("bigint").alias("n_words"),
            F.length(F.regexp_replace(t, BLANK_RUN, "")).cast("bigint").alias("word_chars"),
            count_of(t, SYMBOLS).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
            repeated_words(tokens).cast("bigint").alias("n_repeat_words"),
            F.length(t).cast("bigint").alias("chars"),
            class_counts(t).alias("classes"), common_counts(tokens).alias("commons"))

    return let(text, lambda t: let(words(t), lambda tokens: of(t, tokens)))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    bits = F.aggregate(F.zip_with(p, q, lambda a, b: (part(a, b) + part(b, a)) / 2), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(bits, F.lit(0.0)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0), lambda a, b: a + b)
    return let(total, lambda n: F.transform(counts, lambda c: c / F.greatest(n, F.lit(1))))


def references(measured: DataFrame) -> DataFrame:
    """One row per language: the mean shares of its documents that pass the counting rules, and of PRIOR_DOCS average ones."""
    sizes = {"classes": len(CLASSES) + 1, "commons": len(COMMON_WORDS) + 1}
    sums = measured.filter(~F.col("base_failed")).groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)])
    flat = [f"{c}{i}" for c, n in sizes.items() for i in range(n)]
    everyone = sums.agg(F.sum("docs").alias("all_docs"), *[F.sum(c).alias(f"all_{c}") for c in flat])

    def mean(name: str, n: int) -> Column:
        return F.array(*[(F.col(f"{name}{i}") + PRIOR_DOCS * F.col(f"all_{name}{i}") / F.col("all_docs"))
                         / (F.col("docs") + PRIOR_DOCS) for i in range(n)])

    return sums.crossJoin(everyone).select(F.col("lang").alias("ref_lang"), *[
        mean(c, n).alias(f"ref_{c}") for c, n in sizes.items()])  # one row on the right


def judge(docs: DataFrame, carry: Column | None = None) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs`` (doc_id, text, lang).

    ``carry`` is a column of ``docs`` that comes back as ``carried``.
    """
    rows = docs.select(docs["doc_id"], docs["lang"], (F.lit(None) if carry is None else carry).alias("carried"),
                       measures(text_or_empty(docs)).alias("m"))
    base_failed = (F.col("m.n_words") < MIN_WORDS) | (
        100 * F.col("m.n_repeat_words") > MAX_REPEATED * F.col("m.n_words"))
    measured = stored(rows.select(
        "doc_id", "lang", *([] if carry is None else ["carried"]), "m.n_words", "m.word_chars", "m.n_symbols",
        "m.n_dup_lines", "m.n_repeat_words", "m.chars", base_failed.alias("base_failed"),
        shares(F.col("m.classes")).alias("classes"), shares(F.col("m.commons")).alias("commons")), "quality")
    # written, so that its measured size (a row per language) decides: the documents then stay where they are
    met = measured.join(stored(references(measured), "references"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    far = ((F.col("chars") >= MIN_CHARS_FOR_CLASSES) & (F.col("class_distance") > MAX_CLASS_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    return met.withColumn("class_distance", distance(F.col("classes"), F.col("ref_classes"))).withColumn(
        "word_distance", distance(F.col("commons"), F.col("ref_commons"))).withColumn(
        "kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).drop(
        "ref_lang", "ref_classes", "ref_commons", "classes", "commons")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, as they came."""
    return judge(docs, F.struct(*[docs[c] for c in docs.columns])).filter("kept").select("carried.*")
