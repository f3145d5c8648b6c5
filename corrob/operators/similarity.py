"""Similarity joins, nearest neighbours, centroids and ordered selection."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.vectors import sparse_dot
from corrob.session import cut_lineage, working_table, written


def heavy_keys(facts: DataFrame, keys: list[str]) -> DataFrame | None:
    """(_h, _pieces): keys with more rows than a quarter of an even partition, and in how many pieces to split them.

    Found by a frequency sketch whose partial results merge, in one pass.  At
    most four keys a shuffle partition can be that heavy, which bounds the
    table; None if there are none.
    """
    spark = facts.sparkSession
    room = min(10_000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    total, top = facts.select(F.xxhash64(*keys).alias("_h")).agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(_h, {room}, {min(1_000_000, 16 * room)})")).first()
    share = max(1.0, total / room)
    heavy = [(r["item"], math.ceil(r["count"] / share)) for r in top or [] if r["count"] > share]
    return spark.createDataFrame(heavy, "_h bigint, _pieces int") if heavy else None


def salted_lookup(facts: DataFrame, dim: DataFrame, keys: list[str], row_key: list[str], how: str = "left") -> DataFrame:
    """Join facts to a table with one row per key although a few keys may be very hot.

    Only the keys measured as heavy are split, in proportion to their rows: the
    wide side by a hash of its own row key, the narrow side by a copy for each
    piece.
    """
    heavy = heavy_keys(facts, keys)
    if heavy is None:
        return facts.join(dim, keys, how)

    def pieces(df: DataFrame) -> DataFrame:
        # broadcast: a few rows a shuffle partition at most
        return df.withColumn("_h", F.xxhash64(*keys)).join(F.broadcast(heavy), "_h", "left").withColumn(
            "_pieces", F.coalesce("_pieces", F.lit(1)))

    wide = pieces(facts).withColumn("_salt", F.pmod(F.xxhash64(*row_key), F.col("_pieces").cast("bigint")).cast("int"))
    narrow = pieces(dim).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    return wide.drop("_h", "_pieces").join(narrow.drop("_h", "_pieces"), [*keys, "_salt"], how).drop("_salt")


#: Words of a membership filter: at most 2^22, some 130 MB in the join's hash table.
MOST_WORDS = 1 << 22


def members_of(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` may be among those of ``wanted``: all that are, and about one in 2,000 others.

    A Bloom filter of 64-bit words, built by ``bit_or``: a key sets four bits of
    one word, so the test is one broadcast look-up and happens where the rows
    are read, before any shuffle.  Its size follows the measured number of
    keys; beyond ``MOST_WORDS`` the rows come back as they are.
    """
    count = wanted.select(F.approx_count_distinct(F.xxhash64(*keys))).first()[0]
    words = 1 << max(4, math.ceil(math.log2(max(1, count))) - 1)  # two to a word, 32 bits a key
    if words > MOST_WORDS:
        return rows
    bits = " | ".join(f"shiftleft(1L, CAST(shiftrightunsigned(_h, {start}) & 63 AS INT))" for start in (24, 30, 36, 42))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*keys)).withColumns(
            {"_word": F.pmod("_h", F.lit(words)), "_bits": F.expr(bits)}).drop("_h")

    table = placed(wanted.select(*keys)).groupBy("_word").agg(F.bit_or("_bits").alias("_set"))
    found = placed(rows).join(F.broadcast(table), "_word")  # at most ``words`` rows of two numbers
    return found.filter(F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(*rows.columns)


def bucket_ranks(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(bucket, rank): buckets from rare to common.  At most ``dim`` rows."""
    counts = vectors.select(F.explode(vec).alias("e")).groupBy(F.col("e.bucket").alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select("bucket", F.struct("n", "bucket").alias("rank"))


def prefix_of(vectors: DataFrame, ranks: DataFrame, min_cos: float, key: str, vec: str = "vec") -> DataFrame:
    """Add ``prefix``: the rare buckets that any match at ``min_cos`` must share one of; and all ``buckets``.

    Both are ordered from rare to common; the tail whose length is below
    ``min_cos`` cannot carry a match alone (Cauchy-Schwarz) and is left out of the prefix.
    """
    entries = vectors.select(key, F.explode(vec).alias("e")).select(key, "e.bucket", "e.w")
    ranked = entries.join(ranks, "bucket").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("ordered"))

    def trim(acc, e):
        return F.struct(
            (acc["mass"] + e["w"] * e["w"]).alias("mass"),
            F.when(acc["mass"] + e["w"] * e["w"] < min_cos * min_cos - 1e-9, acc["keep"] - 1)
            .otherwise(acc["keep"]).alias("keep"))

    kept = F.aggregate(F.reverse("ordered"), F.struct(F.lit(0.0).alias("mass"), F.size("ordered").alias("keep")),
                       trim, lambda acc: acc["keep"])
    buckets = F.transform("ordered", lambda e: e["rank"]["bucket"])
    return vectors.join(ranked.select(key, F.slice(buckets, F.lit(1), kept).alias("prefix"), buckets.alias("buckets")), key)


#: Rows of a bucket that are met by all others of it at a time, and comparisons of a task.
PIECE, PER_TASK = 2_000, 20_000_000
#: Shared buckets that are multiplied one by one.
FEW = 8
MASKS = ["_mask0", "_mask1", "_mask2", "_mask3"]


def _with_reach(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Add ``_mask0`` to ``_mask3``, ``_extra`` and ``_reach``, which bound a product from above without looking at the vectors.

    The masks have a bit for every bucket, modulo 256; ``_extra`` is the number
    of buckets beyond the bits.  Two vectors share at most the common bits and
    the lesser extra.  ``_reach`` has the length of the n largest entries: with
    n buckets in common a product is at most that of the two lengths.
    """
    def word(k: int) -> Column:
        mine = F.filter(vec, lambda e: F.pmod(F.shiftright(e["bucket"], 6), F.lit(4)) == k)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, e: acc.bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("bigint"), e["bucket"].bitwiseAND(63))))

    largest = F.reverse(F.array_sort(F.transform(vec, lambda e: e["w"] * e["w"])))
    start = F.array().cast("array<double>")
    sums = F.aggregate(largest, start, lambda acc, s: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + s)))
    masked = vectors.withColumns({**{mask: word(k) for k, mask in enumerate(MASKS)}, "_reach": F.transform(sums, F.sqrt)})
    return masked.withColumn("_extra", F.size(vec) - reduce(Column.__add__, [F.bit_count(mask) for mask in MASKS]))


def prefix_join(left: DataFrame, right: DataFrame, min_cos: float, same: list[str] | None = None,
                condition=None, dealt: bool = False) -> DataFrame:
    """Pairs of rows with cosine of at least ``min_cos`` at nine decimals, with no false dismissal.

    Both sides carry ``vec``, ``prefix`` and ``buckets``.  Column names on the
    right get the suffix ``_r``.  A pair is verified only under its first shared
    bucket, so each pair comes out once without a distinct.  ``same`` lists
    further equality keys; ``condition`` is a predicate on the pair.

    Vectors are multiplied only where the number of buckets they can share, and
    then the number they do share, let them reach ``min_cos``.  With ``dealt``
    the pairs of a bucket are dealt to tasks of bounded size, whose number
    follows the comparisons; both sides must be written tables.
    """
    left, right = (_with_reach(side).withColumn("_weights", F.map_from_entries("vec")) for side in (left, right))
    renamed = right.select([F.col(c).alias(f"{c}_r") for c in right.columns])
    a = left.withColumn("bucket", F.explode("prefix"))
    b = renamed.withColumn("bucket", F.explode("prefix_r"))
    for name in same or []:
        b = b.withColumnRenamed(f"{name}_r", name)
    keys = ["bucket", *(same or [])]
    if dealt:
        counts = written(right.select(F.explode("prefix").alias("bucket")).groupBy("bucket").agg(
            F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")), "pieces")
        tasks = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                    math.ceil((counts.agg(F.sum(F.col("n") * F.col("n"))).first()[0] or 0) / PER_TASK))
        pieces = F.broadcast(counts.drop("n"))  # at most ``dim`` rows
        keys = [*keys, "_piece"]
        a = a.join(pieces, "bucket").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        b = b.join(pieces, "bucket").withColumn("_piece", F.pmod(F.xxhash64("vec_r"), F.col("pieces")).cast("int"))
        # by a shuffle: a table small on disk is many times that in memory, and its pairs are to be dealt out
        a, b = a.drop("pieces").repartition(tasks, *keys), b.drop("pieces").repartition(tasks, *keys).hint("merge")

    def within(number: Column) -> Column:
        return F.get("_reach", number - 1) * F.get("_reach_r", number - 1) >= min_cos - 1e-9

    most = reduce(Column.__add__, [F.bit_count(F.col(mask).bitwiseAND(F.col(f"{mask}_r"))) for mask in MASKS]) + F.least("_extra", "_extra_r")
    pairs = a.join(b, keys).filter((F.lit(True) if condition is None else condition) & within(most))
    # generated, so that what follows from it stays above the join
    pairs = pairs.withColumn("_shared", F.explode(F.array(F.array_intersect("buckets", "buckets_r")))).filter(
        (F.col("bucket") == F.get("_shared", F.lit(0))) & within(F.size("_shared")))
    # at nine decimals, so that a cosine of just min_cos does not hang on the order of a sum
    found = pairs.withColumn("cos", _shared_dot()).filter(F.round("cos", 9) >= min_cos)
    return found.drop("bucket", *[c for c in found.columns if c.startswith("_")])


def _shared_dot() -> Column:
    """Sum of products over ``_shared`` buckets; the first few without a lambda, which costs more than the rest of the join."""

    def product(bucket: Column) -> Column:
        return F.element_at("_weights", bucket) * F.element_at("_weights_r", bucket)

    few = reduce(Column.__add__, [F.coalesce(product(F.get("_shared", F.lit(k))), F.lit(0.0)) for k in range(FEW)])
    return F.when(F.size("_shared") <= FEW, few).otherwise(
        F.aggregate("_shared", F.lit(0.0), lambda acc, bucket: acc + product(bucket)))


def similar_pairs(vectors: DataFrame, min_cos: float) -> DataFrame:
    """(id_a, id_b, cos) over *distinct* sparse vectors, ``id_a < id_b``.

    ``vectors`` is (id, vec).  Equal vectors are one group named by its least
    id, which keeps a headline that repeats from pairing with itself.  Equal
    means at nine decimals: words that all stand there twice have the weights
    of the same words standing there once, but for the rounding.
    """
    same = vectors.filter(F.size("vec") > 0).groupBy("vec").agg(F.min("id").alias("id"))
    digits = F.transform("vec", lambda e: F.struct(e["bucket"].alias("bucket"), F.round(e["w"], 9).alias("w")))
    # written, so that texts are read and made vectors once
    groups = written(same.groupBy(digits.alias("digits")).agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")).drop(
        "digits"), "groups")
    ready = written(prefix_of(groups, bucket_ranks(groups), min_cos, "id"), "prefixes")
    pairs = prefix_join(ready, ready, min_cos, condition=F.col("id") < F.col("id_r"), dealt=True)
    return pairs.select(F.col("id").alias("id_a"), F.col("id_r").alias("id_b"), "cos")


def _bounded_prefix(heads: DataFrame, min_cos: float) -> DataFrame:
    """(vec, prefix): as :func:`prefix_of`, entries (bucket, rest) from rare to common.

    ``rest`` is the length of the vector from the entry on: if two vectors
    share nothing before it, their cosine is at most the product of their rests.
    """
    entries = heads.select("vec", F.explode("vec").alias("e")).select("vec", "e.bucket", "e.w")
    ordered = entries.join(bucket_ranks(heads), "bucket").groupBy("vec").agg(
        F.sort_array(F.collect_list(F.struct("rank", "w"))).alias("_ordered"))

    def longer(acc, e):
        squared = F.coalesce(F.try_element_at(acc, F.lit(1))["squared"], F.lit(0.0)) + e["w"] * e["w"]
        return F.concat(F.array(F.struct(e["rank"]["bucket"].alias("bucket"), squared.alias("squared"))), acc)

    start = F.array().cast("array<struct<bucket:int,squared:double>>")
    long = F.filter(F.aggregate(F.reverse("_ordered"), start, longer), lambda e: e["squared"] >= min_cos * min_cos - 1e-9)
    prefix = F.transform(long, lambda e: F.struct(e["bucket"].alias("bucket"), F.sqrt(e["squared"]).alias("rest")))
    return ordered.select("vec", prefix.alias("prefix"))


def similar_in_time(rows: DataFrame, min_cos: float, hours: int = V.EVENT_WINDOW_HOURS, candidates: bool = False,
                    embed: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of rows with cosine of at least ``min_cos`` whose times are at most ``hours`` apart, as classes.

    ``rows`` is (id, vec, at).  Time is cut into cells of ``hours``; a class is
    the rows of one vector in one cell, named by its least id.  Returns

    * pairs (class_a, class_b, cos, whole): class_a is in the earlier cell, or
      has the smaller id.  With ``whole`` every row of one is linked to every
      row of the other; else those at most ``hours`` apart, at least one pair.
    * members (id, class_id, at).  Rows of one class are all linked.

    The cell is part of the join key: a class meets classes of its own and the
    next cell under a shared rare bucket only, once, and the vectors are
    multiplied only where what follows the first shared bucket can reach
    ``min_cos``.  Work grows with the classes of a cell, not with repeated rows
    nor with history.  Rows without a time or with an empty vector are linked
    with nothing.  ``candidates`` keeps what is multiplied but falls short.

    With ``embed``, ``rows`` is (id, text, at): rows are first summed up by
    text and cell, and only the distinct texts become vectors.
    """
    name = "vec" if embed is None else "text"
    width = hours * 3_600_000_000
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    timed = rows.filter(F.col("at").isNotNull()).select(
        "id", name, "at", (micros - F.pmod(micros, F.lit(width))).alias("cell"), micros.alias("micros"))
    if embed is None:
        timed = timed.filter(F.size("vec") > 0)
    # the tables below are asked for several times; written, so that the rows are read once
    spans = written(timed.groupBy(name, "cell").agg(
        F.min("id").alias("class_id"), F.min("micros").alias("first"), F.max("micros").alias("last")), "spans")
    classes = spans
    if embed is not None:
        vectors = written(spans.select("text").distinct().withColumn("vec", embed(F.col("text"))), "vectors")
        spans = written(spans.join(vectors.filter(F.size("vec") > 0), "text"), "spans")
        classes = written(spans.groupBy("vec", "cell").agg(
            F.min("class_id").alias("class_id"), F.min("first").alias("first"), F.max("last").alias("last")), "classes")
    ready = classes.join(_bounded_prefix(classes.select("vec").distinct(), min_cos), "vec")
    a = ready.select(*[F.col(c).alias(f"{c}_a") for c in ready.columns]).withColumn("p", F.explode("prefix_a")).select(
        "*", F.col("p.bucket").alias("bucket"), F.explode(F.array(F.col("cell_a"), F.col("cell_a") + width)).alias("cell")).drop("p")
    b = ready.withColumn("p", F.explode("prefix")).select("*", F.col("p.bucket").alias("bucket"), F.col("p.rest").alias("rest")).drop("p")
    met = a.join(b, ["bucket", "cell"]).filter(
        ((F.col("cell_a") < F.col("cell")) | (F.col("class_id_a") < F.col("class_id"))) & (F.col("first") - F.col("last_a") <= width))
    shared = F.filter("prefix_a", lambda e: F.array_contains(F.col("prefix.bucket"), e["bucket"]))
    met = met.withColumn("_first", F.element_at(shared, 1)).filter(
        (F.col("bucket") == F.col("_first.bucket")) & (F.col("_first.rest") * F.col("rest") >= min_cos - 1e-9))
    pairs = met.select(F.col("class_id_a").alias("class_a"), F.col("class_id").alias("class_b"),
                       sparse_dot(F.col("vec_a"), F.col("vec")).alias("cos"),
                       (F.col("last") - F.col("first_a") <= width).alias("whole"))
    class_of = classes.select("vec", "cell", "class_id")
    if embed is not None:
        class_of = spans.select("text", "vec", "cell").join(class_of, ["vec", "cell"]).drop("vec")
    named = salted_lookup(timed, class_of, [name, "cell"], ["id"], "inner")
    members = named.select("id", "class_id", "at")
    return (pairs if candidates else pairs.filter(F.col("cos") >= min_cos)), members


def lexically_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids kept when rows are taken in order and each is dropped if an earlier kept row is its neighbour.

    ``nodes`` is (id), ``edges`` (earlier, later).  Decided in parallel rounds:
    a row with no undecided earlier neighbour is kept, its later neighbours are
    dropped.  The result equals the one-by-one pass; the number of rounds is
    the longest alternating chain, not the number of rows.
    """
    spark = nodes.sparkSession
    open_edges = cut_lineage(edges.select("earlier", "later"))
    touched = cut_lineage(open_edges.select(F.col("later").alias("id")).distinct())
    kept = nodes.select("id").join(touched, "id", "left_anti")
    candidates = touched
    accepted = [kept]
    while not open_edges.isEmpty():
        ready = open_edges.select(F.col("earlier").alias("id")).distinct().join(
            open_edges.select(F.col("later").alias("id")).distinct(), "id", "left_anti")
        ready = cut_lineage(ready)
        dropped = cut_lineage(open_edges.join(ready, open_edges.earlier == ready.id, "left_semi")
                              .select(F.col("later").alias("id")).distinct())
        rest = open_edges.join(dropped, open_edges.later == dropped.id, "left_anti")
        open_edges = cut_lineage(rest.join(dropped, rest.earlier == dropped.id, "left_anti"))
        candidates = cut_lineage(candidates.join(dropped, "id", "left_anti"))
    accepted.append(candidates)
    return accepted[0].unionByName(accepted[1])


def centroids(vectors: DataFrame, key: str) -> DataFrame:
    """Unit mean direction per ``key`` of dense vectors ``vec``; NULL vectors are skipped.

    Sums are taken per (key, dimension), so that partial aggregation does the
    work on the map side whatever the size of a group.
    """
    sums = vectors.filter(F.col("vec").isNotNull()).select(key, F.posexplode("vec").alias("dim", "w")).groupBy(
        key, "dim").agg(F.sum(F.col("w").cast("double")).alias("s"))
    lists = sums.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "s"))).alias("entries"),
                                  F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    unit = F.transform("entries", lambda e: F.when(F.col("norm") > 0, e["s"] / F.col("norm")).otherwise(e["s"]))
    return lists.select(key, unit.alias("centroid"))


def sparse_centroids(members: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """(key, total, norm): summed sparse vectors ``vec`` per key, with their length."""
    n = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = members.select(key, n.alias("n"), F.explode("vec").alias("e")).groupBy(
        key, F.col("e.bucket").alias("bucket")).agg(F.sum(F.col("e.w") * F.col("n")).alias("w"))
    return sums.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("bucket", "w"))).alias("total"),
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def _best(query_ids: np.ndarray, asked: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` rows of ``matrix`` with the largest products for each row of ``asked``; ties to the smaller id."""
    found = []
    for low in range(0, len(asked), 64):
        # summed up row by row, so that a pair has one score whatever block it is computed in
        scores = np.einsum("qd,bd->qb", asked[low:low + 64], matrix)
        for query_id, score in zip(query_ids[low:low + 64], scores):
            # only what reaches the k-th best score is sorted
            near = np.arange(len(ids)) if len(ids) <= k else np.flatnonzero(score >= np.partition(score, len(ids) - k)[len(ids) - k])
            best = near[np.lexsort((ids[near], -score[near]))[:k]]
            found.append(pd.DataFrame({"query_id": query_id, "id": ids[best], "similarity": score[best]}))
    return pd.concat(found)


def _met(asked: DataFrame, dealt: DataFrame, keys: list[str], k: int) -> DataFrame:
    """For each query at most ``k`` rows (query_id, id, similarity) of every group of ``keys`` it is in."""

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if q.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return _best(q["query_id"].to_numpy(), np.stack(q["vec"].to_numpy()), b["id"].to_numpy(), np.stack(b["vec"].to_numpy()), k)

    return asked.select(*keys, "query_id", "vec").groupBy(*keys).cogroup(
        dealt.select(*keys, "id", "vec").groupBy(*keys)).applyInPandas(nearest, "query_id bigint, id bigint, similarity double")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _angles(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the vectors and their angles to unit pivots; a zero vector is at an angle of zero to all."""
    length = np.linalg.norm(vectors, axis=1)
    cos = (vectors @ pivots.T) / np.where(length > 0, length, 1.0)[:, None]
    return length, np.where(length[:, None] > 0, np.arccos(np.clip(cos, -1.0, 1.0)), 0.0)


def _pivots(base: DataFrame, count: int) -> np.ndarray:
    """``count`` base vectors at most, those with the least hash of their values, as unit vectors."""
    length = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x * x)
    hashed = base.filter(length > 0).withColumn("h", F.xxhash64("vec"))
    least = hashed.select("h").distinct().orderBy("h").limit(count)  # only hashes are shuffled
    chosen = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("vec").alias("vec")).orderBy("h").collect()
    rows = np.array([r["vec"] for r in chosen], dtype=np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None] if len(rows) else np.zeros((0, 0))


def top_k_neighbors(queries: DataFrame, base: DataFrame, k: int = V.MAX_CANDIDATES,
                    rows_per_cell: int = 200_000, pivots: int = 64) -> DataFrame:
    """The ``k`` base vectors nearest to each query vector, by exact product; unit vectors give the cosine.

    ``queries`` is (query_id, vec), ``base`` is (id, vec), both dense, without
    nulls and of one width.  Returns (query_id, id, similarity, rank, scored);
    ``scored`` is the number of base vectors the query was compared with.

    Every base vector belongs to the cell of the pivot at the least angle.  A
    cell knows its row count, its widest angle and its longest vector.  An
    angle from query to vector is at least the angle from query to pivot less
    the widest one (triangle inequality), which bounds every score of the cell.
    A query first visits the cells nearest to it until they hold ``k`` rows;
    its k-th best score then rules out cells whose bound is below it, and it
    visits the rest.  What is held in one place is the pivots and a row for
    each cell; cells are cut into pieces of ``rows_per_cell`` and the queries
    of a cell into pieces of the same size.  The saving depends on the data:
    in many dimensions without clusters all cells can hold a neighbour.  A base
    that fits into one piece is scored whole, with the same result.
    """
    spark = base.sparkSession
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vec").cast("array<double>").alias("vec"))
    base = base.select("id", F.col("vec").cast("array<double>").alias("vec"))
    count = base.count()
    if count <= rows_per_cell:
        parts = max(1, -(-asked.count() // rows_per_cell))
        return _ranked(_met(asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")),
                            base.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["part"], k), k).withColumn(
            "scored", F.lit(count).cast("bigint"))
    centres = _pivots(base, pivots)
    if not len(centres):  # zero vectors only: one cell, any direction will do
        centres = np.eye(1, base.select(F.max(F.size("vec"))).first()[0])

    def in_cells(batches):
        for rows in batches:
            if len(rows):
                length, angle = _angles(np.stack(rows["vec"].to_numpy()).astype(np.float64), centres)
                cell = angle.argmin(axis=1)
                yield rows.assign(cell=cell.astype("int32"), angle=angle[np.arange(len(rows)), cell], length=length)

    path = working_table(spark, "cells")
    base.mapInPandas(
        in_cells, "id bigint, vec array<double>, cell int, angle double, length double").write.parquet(path)
    cells = spark.read.parquet(path)
    # a row for each pivot at most
    known = sorted(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("widest"),
                                             F.max("length").alias("longest"), F.min("length").alias("shortest")).collect())
    number, rows_in, widest, longest, shortest = (np.array(c) for c in zip(*known))
    pieces = {int(c): -(-int(n) // rows_per_cell) for c, n in zip(number, rows_in)}

    def bounds(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Angles to the pivots of the cells, and the largest score a vector of each cell can have."""
        length, angle = _angles(vectors, centres[number])
        cos = np.cos(np.maximum(0.0, angle - widest[None, :]))
        return angle, length[:, None] * np.where(cos > 0, longest, shortest) * cos

    def first_cells(batches):
        for rows in batches:
            if len(rows):
                angle, _ = bounds(np.stack(rows["vec"].to_numpy()))
                order = np.argsort(angle, axis=1, kind="stable")
                full = np.cumsum(rows_in[order], axis=1)
                visited = [number[o[:np.searchsorted(f, k) + 1]] for o, f in zip(order, full)]
                yield rows.assign(cell=visited).explode("cell").astype({"cell": "int32"})

    def other_cells(batches):
        for rows in batches:
            if len(rows):
                angle, best = bounds(np.stack(rows["vec"].to_numpy()))
                open_cells = best + 1e-9 * (1.0 + np.abs(best)) >= rows["least"].to_numpy()[:, None]
                visited = [number[o & ~np.isin(number, done)] for o, done in zip(open_cells, rows["visited"])]
                yield rows[["query_id", "vec"]].assign(cell=visited).explode("cell").dropna(subset=["cell"]).astype({"cell": "int32"})

    sizes = spark.createDataFrame([(c, p) for c, p in pieces.items()], "cell int, pieces int")

    def scored(visits: DataFrame) -> DataFrame:
        """At most ``k`` rows of every piece of a cell for each query that visits it."""
        visits = visits.join(F.broadcast(sizes), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        parts = visits.groupBy("cell").agg(F.ceil(F.countDistinct("query_id") / rows_per_cell).cast("int").alias("parts"))  # a row a cell
        coming = visits.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        dealt = cells.join(F.broadcast(sizes), "cell").join(F.broadcast(parts), "cell").withColumn(
            "piece", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).withColumn(
            "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

        return _met(coming, dealt, ["cell", "piece", "part"], k)

    def written(rows: DataFrame, name: str) -> DataFrame:
        target = working_table(spark, name)
        rows.write.parquet(target)
        return spark.read.parquet(target)

    visit = "query_id bigint, vec array<double>, cell int"
    first = written(asked.mapInPandas(first_cells, visit), "visits")
    near = written(_ranked(scored(first), k), "near")
    least = near.groupBy("query_id").agg(F.min("similarity").alias("least"))
    done = first.groupBy("query_id").agg(F.first("vec").alias("vec"), F.collect_set("cell").alias("visited"))  # the cells of a query
    second = written(done.join(least, "query_id").mapInPandas(other_cells, visit), "visits")
    weights = spark.createDataFrame([(int(c), int(n)) for c, n in zip(number, rows_in)], "cell int, n bigint")
    seen = first.select("query_id", "cell").unionByName(second.select("query_id", "cell")).join(
        F.broadcast(weights), "cell").groupBy("query_id").agg(F.sum("n").alias("scored"))
    best = _ranked(near.drop("rank").unionByName(scored(second)), k)
    return best.join(seen, "query_id")
