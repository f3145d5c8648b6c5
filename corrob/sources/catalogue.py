"""Source catalogue, model tables, and idempotent writes."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corrob import fixed_values as V

SOURCE_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("rss_url", T.StringType()), T.StructField("website_url", T.StringType()),
    T.StructField("api_url", T.StringType()), T.StructField("enabled", T.BooleanType()), T.StructField("priority", T.IntegerType()),
    T.StructField("language", T.StringType()), T.StructField("poll_interval_seconds", T.IntegerType()),
    T.StructField("reliability_score", T.DoubleType()), T.StructField("is_international", T.BooleanType()),
    T.StructField("raw_text_permitted", T.BooleanType())])
MAPPING_SCHEMA = T.StructType([
    T.StructField("country_code", T.StringType()), T.StructField("primary", T.StringType()),
    T.StructField("backup", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("enabled", T.BooleanType())])


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue of sources from a JSON list, defaults filled in, countries upper-cased."""
    raw = spark.read.schema(SOURCE_SCHEMA).option("multiLine", True).json(path)
    defaults = {"enabled": True, "language": "en", "poll_interval_seconds": 300, "reliability_score": 70.0,
                "raw_text_permitted": False, "is_international": False}
    return raw.fillna(defaults).withColumn("country", F.upper(F.trim("country")))


def read_country_sources(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(MAPPING_SCHEMA).option("multiLine", True).json(path)
    return raw.fillna({"priority": 50, "enabled": True}).withColumn("country_code", F.upper(F.trim("country_code")))


def all_sources(international: DataFrame, local: DataFrame) -> DataFrame:
    """Both catalogues, told apart by ``is_international``."""
    return international.withColumn("is_international", F.lit(True)).unionByName(
        local.withColumn("is_international", F.lit(False)))


def check_sources(sources: DataFrame, mappings: DataFrame, expected_international: int = V.INTERNATIONAL_SOURCES) -> DataFrame:
    """(rule, key) of every broken catalogue rule; empty when all is well."""
    rules = [
        ("country must be ISO 3166-1 alpha-2", ~F.coalesce(F.upper(F.trim("country")), F.lit("")).rlike("^[A-Z]{2}$")),
        ("priority must be 0-100", ~F.col("priority").between(0, 100)),
        ("reliability must be 0-100", ~F.col("reliability_score").between(0, 100)),
        ("poll interval too short", F.col("poll_interval_seconds") < V.MIN_POLL_SECONDS),
        ("feed source has no rss_url", F.col("type").isin("rss", "atom") & F.col("rss_url").isNull()),
        ("unknown source type", ~F.col("type").isin("rss", "atom", "api")),
    ]
    per_row = F.array_compact(F.array(*[F.when(bad, rule) for rule, bad in rules]))
    broken = sources.select(F.explode(per_row).alias("rule"), F.col("id").alias("key"))
    repeated = sources.groupBy("is_international", "id").count().filter("count > 1").select(
        F.lit("source id is not unique").alias("rule"), F.col("id").alias("key"))
    count = sources.agg(F.count_if("is_international").alias("n")).filter(F.col("n") != expected_international).select(
        F.lit("wrong number of international sources").alias("rule"), F.col("n").cast("string").alias("key"))
    unknown = mappings.join(sources.select(F.col("id").alias("primary")), "primary", "left_anti").select(
        F.lit("mapping points to unknown source").alias("rule"), F.col("country_code").alias("key"))
    bad_code = mappings.filter(~F.col("country_code").rlike("^[A-Za-z]{2}$")).select(
        F.lit("mapping country must be ISO 3166-1 alpha-2").alias("rule"), F.col("country_code").alias("key"))
    return broken.unionByName(repeated).unionByName(count).unionByName(unknown).unionByName(bad_code)


#: Model tables and their columns; see the README for meanings.
TABLE_SCHEMAS = {
    "reports": "report_id string, source_id string, source_url string, canonical_url string, canonical_url_hash string, "
               "title string, description string, published_at timestamp, retrieved_at timestamp, language string, "
               "author string, raw_text string, content_hash string, simhash string, event_type string, "
               "vec array<struct<bucket:int,w:double>>, status string",
    "events": "event_id string, event_type string, title string, country string, first_detected_at timestamp, "
              "last_updated_at timestamp, importance_score double, confidence_score double, report_count bigint, "
              "independent_source_count bigint, conflict_count bigint, status string",
    "event_reports": "event_id string, report_id string, similarity_score double, is_primary boolean",
    "event_facts": "event_id string, fact_key string, fact_type string, statement string, value_numeric double, "
                   "value_text string, first_seen_at timestamp, last_confirmed_at timestamp, source_count bigint, "
                   "independent_source_count bigint, superseded_by string",
    "event_conflicts": "event_id string, measure string, claim string, status string, detected_at timestamp, "
                       "resolved_at timestamp, resolution string",
    "articles": "article_id string, event_id string, locale_country string, is_global boolean, slug string, headline string, "
                "body string, key_points string, timeline string, confidence_score double, importance_score double, "
                "current_version int, is_published boolean, published_at timestamp",
}


class Tables:
    """Scans of the model tables under one folder, with fixed schemas (no inference pass)."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_SCHEMAS:
            raise AttributeError(name)
        return self._spark.read.schema(TABLE_SCHEMAS[name]).parquet(os.path.join(self._path, name))


def merge_upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``target`` with the rows of ``updates`` inserted, or replacing those of equal keys.

    Of several updates of a key the last by ``order`` counts (columns of
    ``updates``; without them, the order in which the rows come).
    """
    rank = F.struct(*order) if order else F.monotonically_increasing_id()
    numbered = updates.withColumn("_rank", rank)
    # a key per row is the usual case, and the maximum is combined on the map side
    last = numbered.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), "_rank").alias("_row")).select("_row.*")
    last = last.select(*[c for c in target.columns if c in last.columns])
    return target.join(last.select(keys), keys, "left_anti").unionByName(last)


def append_new(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Mark each distinct key of a batch ``created`` or already present; created rows are to be appended."""
    known = target.select(key).distinct().withColumn("_known", F.lit(True))
    return batch.dropDuplicates([key]).join(known, key, "left").withColumn(
        "created", F.col("_known").isNull()).drop("_known")
