"""Mixing sources to target weights: whole copies, then a Pareto order sample.

A source's target is its share of the mix's size by weight, at most a given
multiple of what it has; what is cut off goes to the others by weight.  Inside
a source, long documents are worth more: a document's expected number of
copies is in proportion to its size class (powers of two of its words) to the
power of PREFERENCE, at most the multiple, at a level at which the expected
words are the target.  Classes stop at the multiple in the order of their
worth, so the level is found in closed form from a source's class sums.

The whole part of the expected copies is taken for certain; the fraction is
the document's inclusion probability.  Documents are ranked by the odds of a
random number over the odds of their inclusion probability, and the ranking is
cut where the words add up to what the whole copies leave of the target.
Random numbers are hashes of doc_id and text, so reruns agree.

The cut is found without sorting a source: ranks fall into 4,096 bins of equal
width, the bin that holds the cut into 4,096 again.  The sums are partial
aggregates, so a source with a third of the rows is no heavier than another.
What the cut leaves open (less than the next document) is filled with further
documents of the ranking that fit, in three more rounds.

Defined cases: a null text has no words and is never worth taking; rows
without source are a source of their own, the last; equal rows (doc_id, text)
are taken alike; an empty table gives an empty mix; columns beside doc_id,
text and source are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob.llm.common import stored, text_or_empty, words

WEIGHTS = (5, 2, 1)  # by rank of the source's name, repeating
SIZE_PERCENT, LARGEST_MULTIPLE = 150, 2
PREFERENCE = 0.25
BINS, ROUNDS, SEED = 4096, 4, 11


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def sized(docs: DataFrame) -> list[Column]:
    """The columns the mix needs of each row: size, source key and random number."""
    text = text_or_empty(docs)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), docs["doc_id"], text), 11)
    return [F.size(words(text)).cast("bigint").alias("size"), _key(docs["source"].cast("string")).alias("source_key"),
            ((draw + 0.5) / 2.0**53).alias("draw")]


def _class() -> Column:
    """Size class of a document: the number of bits of its size."""
    return F.length(F.bin("size"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source_key, source_size, target): weights filled up to each source's limit.

    Sources stop in the order of limit over weight.  If those before one have
    stopped, the rest is shared by the weights from it on; the first source
    that does not reach its limit that way sets the level for all after it.
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    # code point order, the null source ("") last; as many rows as there are sources
    order = Window.orderBy((F.col("source_key") == "").asc(), "source_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1)
    named = totals.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(LARGEST_MULTIPLE))
    by_stop = Window.orderBy(F.col("limit") / F.col("weight"), "source_key")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * (SIZE_PERCENT / 100) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    tried = named.withColumn("level", level).withColumn("place", F.row_number().over(by_stop)).withColumn(
        "open", F.col("level") * F.col("weight") <= F.col("limit"))
    first = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(everything)["level"]
    return tried.withColumn("final", first).select(
        "source_key", "source_size", F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit"))).alias("target"))


def expected_copies(sizes: DataFrame, aims: DataFrame) -> DataFrame:
    """(source_key, class, copies, share): whole copies and inclusion probability of each class of a source.

    At most 63 rows a source.  As with the sources, the first class that stays
    below the multiple at its level sets the level for all after it.
    """
    worth = F.pow(F.pow(F.lit(2.0), F.col("class") - 1), F.lit(PREFERENCE))
    sums = sizes.filter(F.col("size") > 0).groupBy("source_key", _class().alias("class")).agg(
        F.sum("size").cast("double").alias("words")).withColumn("worth", worth).join(aims, "source_key")
    falling = Window.partitionBy("source_key").orderBy(F.desc("class"))
    rising = Window.partitionBy("source_key").orderBy("class")
    full = (F.sum("words").over(falling) - F.col("words")) * LARGEST_MULTIPLE
    level = (F.col("target") - full) / F.sum(F.col("words") * F.col("worth")).over(rising)
    tried = sums.withColumn("level", level).withColumn("open", F.col("level") * F.col("worth") <= LARGEST_MULTIPLE)
    first = F.max(F.when(F.col("open"), F.struct("class", "level"))).over(Window.partitionBy("source_key"))
    multiple = F.when(F.col("class") > F.col("first.class"), F.lit(float(LARGEST_MULTIPLE))).otherwise(
        F.least(F.lit(float(LARGEST_MULTIPLE)), F.col("first.level") * F.col("worth")))
    held = tried.withColumn("first", first).withColumn(
        "multiple", F.coalesce(F.greatest(multiple, F.lit(0.0)), F.lit(float(LARGEST_MULTIPLE))))
    whole = F.floor(F.col("multiple") + 1e-12)
    return held.select("source_key", "class", "words", whole.alias("copies"),
                       F.greatest(F.col("multiple") - whole, F.lit(0.0)).alias("share"))


def _taken_extra(rounds: int) -> Column:
    """Whether the rounds so far take a document once more: before the cut, and small enough for the round."""
    parts = [(F.col("place") < F.col(f"cut{r}")) & (F.col("size") <= F.col(f"room{r}")) for r in range(rounds)]
    taken = F.lit(False)
    for p in parts:
        taken = taken | p
    return taken & (F.col("size") > 0) & (F.col("copies") < LARGEST_MULTIPLE)


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan, ``copies``, and ``place``, the Pareto rank on a scale of BINS squared."""
    rows = rows.join(plan, "source_key").withColumn("class", _class()).withColumn("_mine", F.when(F.col("size") > 0, F.try_element_at(
        F.filter("classes", lambda c: c["class"] == F.col("class")), F.lit(1))))
    rows = rows.withColumn("copies", F.coalesce("_mine.copies", F.lit(0))).withColumn("share", F.coalesce("_mine.share", F.lit(0.0)))
    share = F.col("share")
    rank = (F.col("draw") / (1 - F.col("draw"))) / (share / (1 - share))
    # without a fraction a document comes after all others, for the rounds that fill up
    place = F.when((share > 0) & (share < 1), F.floor(rank / (1 + rank) * BINS * BINS)).otherwise(F.lit(BINS * BINS - 1))
    return rows.withColumn("place", place).drop("classes", "class", "_mine")


def make_plan(sizes: DataFrame) -> DataFrame:
    """One row per source: target, whole copies and inclusion probability by class, and the cuts of the ranking."""
    aims = stored(targets(sizes), "targets")
    copies = expected_copies(sizes, aims.select("source_key", "target")).groupBy("source_key").agg(
        F.collect_list(F.struct("class", "copies", "share")).alias("classes"),  # at most 63
        F.sum(F.col("words") * F.col("copies")).alias("certain"))
    plan = stored(aims.join(copies, "source_key", "left").withColumn(
        "room0", F.col("target") - F.coalesce("certain", F.lit(0.0))).drop("certain"), "plan")
    for r in range(ROUNDS):
        left = _placed(sizes, plan).filter((F.col("size") > 0) & (F.col("copies") < LARGEST_MULTIPLE) & (F.col("size") <= F.col(f"room{r}")) & ~_taken_extra(r))
        bins = left.groupBy("source_key", F.floor(F.col("place") / BINS).alias("bin")).agg(F.sum("size").alias("words"))
        cuts = stored(_cut(bins, plan, r, F.lit(0)), "cuts")
        inner = left.join(cuts, "source_key").filter(F.floor(F.col("place") / BINS) == F.col("bin")).groupBy(
            "source_key", F.pmod("place", F.lit(BINS)).alias("inner")).agg(F.sum("size").alias("words"))
        start = cuts.select("source_key", F.col("bin").alias("outer"), F.col("used").alias("base"))
        fine = _cut(inner.withColumnRenamed("inner", "bin").join(start, "source_key"), plan, r, F.col("base"))
        fine = fine.select("source_key", F.col("bin").alias("inner"), F.col("used").alias("inner_used"))
        # no bin over the room: everything is taken and the cut lies behind all places
        spent = left.groupBy("source_key").agg(F.sum("size").alias("all_words"))
        found = start.join(fine, "source_key", "left").join(spent, "source_key", "full")
        plan = stored(plan.join(found, "source_key", "left").withColumn(
            f"cut{r}", F.coalesce(F.col("outer") * BINS + F.coalesce("inner", F.lit(BINS)), F.lit(BINS * BINS + 1))).withColumn(
            f"room{r + 1}", F.col(f"room{r}") - F.when(F.col("outer").isNull(), F.coalesce("all_words", F.lit(0))).otherwise(
                F.coalesce("inner_used", "base"))).drop("outer", "base", "inner", "inner_used", "all_words"), "plan")
    return plan


def _cut(bins: DataFrame, plan: DataFrame, r: int, base: Column) -> DataFrame:
    """(source_key, bin, used): the first bin that goes over the room, and the words used before it.

    At most BINS rows for a source.
    """
    along = Window.partitionBy("source_key").orderBy("bin")
    summed = bins.withColumn("end", base + F.sum("words").over(along)).join(plan.select("source_key", f"room{r}"), "source_key")
    over = F.min(F.when(F.col("end") > F.col(f"room{r}"), F.struct("bin", (F.col("end") - F.col("words")).alias("used"))))
    return summed.groupBy("source_key").agg(over.alias("x")).filter("x is not null").select("source_key", "x.*")


def _times() -> Column:
    return F.col("copies") + _taken_extra(ROUNDS).cast("int")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row."""
    sizes = stored(docs.select(docs["doc_id"], *sized(docs)), "sizes")
    return _placed(sizes, make_plan(sizes)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _times()).cast("bigint").alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    sizes = stored(docs.select(*sized(docs)), "sizes")
    return _placed(docs.select(row, *sized(docs)), make_plan(sizes)).select(
        "row", F.explode(F.array_repeat(F.lit(0), _times().cast("int")))).select("row.*")
