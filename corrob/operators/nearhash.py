"""SimHash signatures and exact near-duplicate pairs."""

from __future__ import annotations

from hashlib import blake2b, md5
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corrob.functions.text import normalize_text
from corrob.session import cut_lineage


def _simhash_udf(digest):
    @pandas_udf(T.StringType())
    def signature(normalized: pd.Series) -> pd.Series:
        """Majority vote over the token hashes' bits; every occurrence votes."""
        index: dict[str, int] = {}
        rows = [[index.setdefault(t, len(index)) for t in text.split()] for text in normalized]
        raw = np.frombuffer(b"".join(digest(t.encode()) for t in index), dtype=np.uint8).reshape(-1, 8)
        votes = np.unpackbits(raw, axis=1).astype(np.int32) * 2 - 1
        return pd.Series([np.packbits(votes[r].sum(axis=0) > 0).tobytes().hex() if r else "0" * 16 for r in rows],
                         index=normalized.index)

    return signature


def simhash(text: Column, algorithm: str = "blake2b") -> Column:
    """64-bit SimHash in hex.  Map-only: no token ever crosses a shuffle.

    ``algorithm`` is the token hash, ``blake2b`` or (first 8 bytes of) ``md5``.
    """
    digests = {"blake2b": lambda b: blake2b(b, digest_size=8).digest(), "md5": lambda b: md5(b).digest()[:8]}
    return _simhash_udf(digests[algorithm])(normalize_text(text))


def simhash_md5(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, simhash) with MD5 token hashes, from built-in expressions only.

    All tokens of a row sit in one partition, so the 64 vote sums collapse
    before the shuffle to one row per document.
    """
    token = F.explode_outer(F.split(normalize_text(F.col(text)), " "))
    hashed = df.select(key, token.alias("token")).select(
        key,
        (F.coalesce(F.col("token"), F.lit("")) != "").alias("real"),
        F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint").alias("high"),
        F.conv(F.substring(F.md5("token"), 9, 8), 16, 10).cast("bigint").alias("low"))

    def vote(half: str, bit: int) -> Column:
        on = F.shiftright(F.col(half), bit).bitwiseAND(F.lit(1))
        return F.sum(F.when(F.col("real"), 2 * on - 1).otherwise(F.lit(0))).alias(f"{half}{bit}")

    votes = hashed.groupBy(key).agg(*[vote(h, b) for h in ("high", "low") for b in range(32)])

    def word(half: str) -> Column:
        total = sum(F.when(F.col(f"{half}{b}") > 0, F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint")
                    for b in range(32))
        return F.lpad(F.lower(F.hex(total)), 8, "0")

    return votes.select(key, F.concat(word("high"), word("low")).alias("simhash"))


def near_dup_pairs(signatures: DataFrame, max_hamming: int = 3, intact: int = 3) -> DataFrame:
    """All pairs of *distinct* signatures at most ``max_hamming`` bits apart.

    ``signatures`` is (id, simhash).  Equal signatures are one group, named by
    its least id with its size, so copies never multiply into pairs.  The 64
    bits are cut in ``max_hamming + intact`` blocks; two hashes that differ in
    at most ``max_hamming`` bits agree on at least ``intact`` whole blocks, so
    joining on every choice of ``intact`` blocks finds every pair.  More intact
    blocks mean longer, rarer join keys, which is the knob for size.
    """
    groups = signatures.groupBy("simhash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    # both sides of the join need it; the texts behind it are hashed once
    groups = cut_lineage(groups)
    blocks = max_hamming + intact
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in choice)
             for choice in combinations(range(blocks), intact)]
    halves = groups.select("id", "copies", *[
        F.conv(F.substring("simhash", start, 8), 16, 10).cast("bigint").alias(name)
        for name, start in (("high", 1), ("low", 9))])
    keys = [F.struct(F.lit(n).alias("choice"), F.col("high").bitwiseAND(F.lit(m >> 32)).alias("h"),
                     F.col("low").bitwiseAND(F.lit(m & 0xFFFFFFFF)).alias("l")) for n, m in enumerate(masks)]
    banded = halves.select("id", "copies", "high", "low", F.inline(F.array(*keys)))
    other = banded.select(*[F.col(c).alias(c if c in ("choice", "h", "l") else f"{c}_b") for c in banded.columns])
    distance = (F.bit_count(F.col("high").bitwiseXOR(F.col("high_b")))
                + F.bit_count(F.col("low").bitwiseXOR(F.col("low_b"))))
    near = banded.join(other, ["choice", "h", "l"]).filter((F.col("id") < F.col("id_b")) & (distance <= max_hamming))
    return near.select(F.col("id").alias("id_a"), "id_b", F.col("copies").alias("copies_a"), "copies_b",
                       distance.cast("int").alias("distance")).dropDuplicates(["id_a", "id_b"])
