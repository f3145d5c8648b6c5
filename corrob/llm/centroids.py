"""Centroid clustering of integer vectors, in built-in expressions alone.

A vector's squared distance to a centroid is |x|^2 + (|c|^2 - 2 x.c); only the
bracket differs between centroids.  ``zip_with`` and ``aggregate`` compute it
for every centroid of a literal array of arrays, and ``array_min`` over structs of
(bracket, number) takes the nearest, the smaller number on ties.  New centroids
come from one column sum per component with a partial aggregate, so a cluster
with most of the vectors costs no more than another.  Everything is 64-bit
integers: the result depends on neither the order nor the layout of the rows.

What the driver holds is the centroids: k times the number of components,
both parameters.  The integer vectors are written once and read in each round.

Defined cases: a vector that is null, of another length, or with a null or
non-finite component is left out; a component beyond 2**27 after scaling counts
as that (so no distance overflows); a row without vec_id is clustered but never
a first centroid; repeated rows are each clustered; with fewer than k vectors
there are as many centroids as vectors; an empty table gives an empty result;
an inertia beyond 64 bits is null; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob.llm.common import let, stored

LARGEST = 2**27  # of a scaled component: 64 squared differences of such stay below 2**63


def integer_vectors(vectors: DataFrame, dims: int, scale: int, column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that can be clustered, in whole numbers."""
    x = vectors[column]
    fits = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    whole = F.transform(x, lambda e: F.floor(F.greatest(F.least(
        F.lit(scale) * e.cast("double"), F.lit(float(LARGEST))), F.lit(float(-LARGEST)))))
    return vectors.filter(fits).select(vectors["vec_id"], whole.alias("v"))


def first_centroids(ints: DataFrame, k: int, prefix: str) -> list[list[int]]:
    """The k vectors of the smallest sha256 of ``prefix`` and vec_id, in that order."""
    name = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    return [r["v"] for r in ints.filter("vec_id is not null").orderBy(name, "v").limit(k).select("v").collect()]


def _inner(v: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(0).cast("bigint"), lambda s, x: s + x)


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """struct(d, c): squared distance to the nearest of ``centroids``, and its number."""
    table = F.expr("array(" + ", ".join(
        f"named_struct('n', {sum(x * x for x in c)}L, 'c', array({', '.join(f'{x}L' for x in c)}))" for c in centroids) + ")")
    numbered = F.transform(table, lambda c, i: F.struct((c["n"] - 2 * _inner(v, c["c"])).alias("d"), i.alias("c")))
    return let(F.array_min(numbered), lambda b: F.struct((b["d"] + _inner(v, v)).alias("d"), b["c"].alias("c")))


def moved(ints: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Each centroid replaced by the floor of its vectors' mean; one without vectors stays."""
    dims = len(centroids[0])
    sums = ints.withColumn("c", nearest(F.col("v"), centroids)["c"]).groupBy("c").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(dims)])
    means = {r["c"]: [r[f"s{j}"] // r["n"] for j in range(dims)] for r in sums.collect()}  # k rows at most
    return [means.get(i, c) for i, c in enumerate(centroids)]


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, scale: int = 256, rounds: int = 5, prefix: str = "2:"
            ) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector that fits, as a written table, and the final centroids."""
    ints = stored(integer_vectors(vectors, dims, scale), "vectors")
    centroids = first_centroids(ints, k, prefix)
    if not centroids:
        return ints.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), []
    for _ in range(rounds):
        centroids = moved(ints, centroids)
    found = ints.select("vec_id", nearest(F.col("v"), centroids).alias("b"))
    return stored(found.select("vec_id", F.col("b.c").alias("cluster"), F.col("b.d").alias("distance")), "clusters"), centroids


def described(vectors: DataFrame, **options) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that fits."""
    rows, centroids = cluster(vectors, **options)
    spark = vectors.sparkSession
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    of_cluster = rows.groupBy("cluster").agg(total.alias("of_cluster"))
    everything = rows.agg(total.alias("of_all"))
    named = spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>").select(
        "cluster", F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256).alias("centroid_sha256"))
    # one row per cluster, k at most
    facts = named.join(of_cluster, "cluster").crossJoin(everything)
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", F.expr("try_cast(of_cluster AS bigint)").alias("cluster_inertia"),
        F.expr("try_cast(of_all AS bigint)").alias("inertia"), "centroid_sha256")
