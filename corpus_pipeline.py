"""The corpus pipeline: from raw documents to token shards in training order.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return rows with the columns of ``documents``.  Between
stages the rows are written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corrob.llm import decontaminate, mixing, nearcopies, quality, token_shards
from corrob.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.drop_near_copies(docs, k=5, least_percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_shards.training_order(docs)


STAGES = [("quality rules", quality_rules), ("near copies", near_copies), ("decontamination", decontamination),
          ("source mix", source_mix), ("token ids", token_ids)]

#: Hashes, sketches and a tokenizer decide rows, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
