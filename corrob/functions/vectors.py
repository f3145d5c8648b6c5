"""Vectors as columns: dense arrays of floats and sparse arrays of (bucket, w).

A hashing embedding of a headline has fewer than twenty non-zero entries out of
1536, so it is kept sparse throughout.
"""

from __future__ import annotations

import math
from collections import Counter
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corrob import fixed_values as V

SPARSE = T.ArrayType(T.StructType().add("bucket", "integer").add("w", "double"))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two dense unit vectors; unequal lengths are an error."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)
    return F.when(F.size(a) == F.size(b), total).otherwise(
        F.raise_error(F.lit("vectors must have equal length")).cast("double"))


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of two sparse vectors."""

    def dot(weights: Column) -> Column:
        return F.aggregate(
            a, F.lit(0.0),
            lambda acc, e: acc + e["w"] * F.coalesce(F.try_element_at(weights, e["bucket"]), F.lit(0.0)))

    # a one-element array, so that the lookup map is built once per pair
    return F.element_at(F.transform(F.array(F.map_from_entries(b)), dot), 1)


def sparse_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["w"] * e["w"]))


def sparse_unit(a: Column) -> Column:
    """Scale to length one; the zero vector is left as it is."""

    def scale(norm: Column) -> Column:
        return F.transform(a, lambda e: F.struct(
            e["bucket"].alias("bucket"), F.when(norm > 0, e["w"] / norm).otherwise(e["w"]).alias("w")))

    return F.element_at(F.transform(F.array(sparse_norm(a)), scale), 1)


def _stem(w: Column) -> Column:
    expr = None
    for suffix in V.STEM_SUFFIXES:
        fits = (F.length(w) > len(suffix) + 2) & F.endswith(w, F.lit(suffix))
        cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
        expr = F.when(fits, cut) if expr is None else expr.when(fits, cut)
    return expr.otherwise(w)


def embed_tokens(c: Column) -> Column:
    """Words that carry topic: no stop words or quantities, synonyms folded, stemmed."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    dropped = V.STOPWORDS + list(V.NUMBER_WORDS)
    kept = F.filter(words, lambda w: ~w.isin(dropped) & ~w.rlike("^[0-9]+$"))
    synonyms = F.create_map(*[F.lit(x) for kv in V.SYNONYMS.items() for x in kv])
    folded = F.transform(kept, lambda w: F.coalesce(F.try_element_at(synonyms, w), w))
    return F.transform(folded, _stem)


def token_embedding(dim: int = V.EMBEDDING_DIM):
    """Column function from tokens to a sparse unit vector, hashed with BLAKE2b."""

    @pandas_udf(SPARSE)
    def embed(tokens: pd.Series) -> pd.Series:
        bucket_of: dict[str, int] = {}

        def bucket(token: str) -> int:
            if token not in bucket_of:
                digest = blake2b(token.encode(), digest_size=8).digest()
                bucket_of[token] = int.from_bytes(digest, "big") % dim
            return bucket_of[token]

        def vector(words) -> list[dict]:
            weights = {b: 1.0 + math.log(n) for b, n in sorted(Counter(map(bucket, words)).items())}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            return [{"bucket": b, "w": w / norm} for b, w in weights.items()]

        return pd.Series([vector(words) for words in tokens], index=tokens.index)

    return embed


def hash_embedding(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    return token_embedding(dim)(embed_tokens(text))


def hash_embedding_md5(text: Column, dim: int = V.EMBEDDING_DIM) -> Column:
    """As :func:`hash_embedding` with MD5 buckets: JVM only, reproducible in SQL."""
    buckets = F.transform(
        embed_tokens(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("bigint") % dim).cast("int"))

    def weighted(found: Column) -> Column:
        return F.transform(F.array_sort(F.array_distinct(found)), lambda b: F.struct(
            b.alias("bucket"),
            (1.0 + F.ln(F.size(F.filter(found, lambda x: x == b)))).cast("double").alias("w")))

    counted = F.element_at(F.transform(F.array(buckets), weighted), 1)
    return F.element_at(F.transform(F.array(counted), sparse_unit), 1)
