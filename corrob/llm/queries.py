"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from corrob.llm import (
    centroids, decontaminate, disclosure, fingerprints, licenses, mixing, nearcopies, oracles, quality, ranked_search, repeats,
    token_shards, toxicity, url_templates)
from corrob.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op9_quality_divergence", oracles.quality())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_setsketch_near_copies", oracles.near_copies())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


@query("op3_bm25_decontamination")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_pareto_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op1_training_order_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.training_order(table(spark, sf_dir, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op4_toxicity_lexicon")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_induced_repeats")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


@query("op6_disclosure")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.listed(table(spark, sf_dir, "documents"))


@query("op7_path_templates")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(table(spark, sf_dir, "pages"))


@query("op2_license_sentences")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op11_centroid_clusters", oracles.centroids())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.described(table(spark, sf_dir, "embeddings"))


@query("op12_ranked_search", oracles.ranked_search())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_golay_simhash")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.simhash_copies(table(spark, sf_dir, "documents"))
