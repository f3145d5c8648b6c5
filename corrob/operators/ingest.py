"""Entry validation and the three-level deduplicating ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.scores import hours_between
from corrob.functions.text import canonicalize_url, content_hash, normalize_text, strip
from corrob.session import written

OUTCOMES = ["stored", "duplicate_url", "duplicate_content", "duplicate_batch", "rejected"]


def reject_reason(as_of: Column) -> Column:
    """First failing rule for an entry, NULL when it is usable."""
    title, link = F.coalesce("title", F.lit("")), F.coalesce("link", F.lit(""))
    future_hours = V.MAX_FUTURE_SKEW_SECONDS / 3600
    return (
        F.when(strip(title) == "", "empty title")
        .when(strip(link) == "", "empty link")
        .when(~F.col("canonical_url").rlike("^https?://"), "non-http(s) link")
        .when(F.length(title) > V.MAX_TITLE_LENGTH, "title too long")
        .when(F.length("description") > V.MAX_DESCRIPTION_LENGTH, "description too long")
        .when(hours_between(F.col("published_at"), as_of) > future_hours,
              "published_at implausibly in the future"))


def validate_entries(entries: DataFrame, as_of: Column) -> DataFrame:
    """Add ``canonical_url`` (when absent) and ``reject_reason``."""
    if "canonical_url" not in entries.columns:
        entries = entries.withColumn("canonical_url", canonicalize_url(F.col("link")))
    return entries.withColumn("reject_reason", reject_reason(as_of))


def _first_per(rows: DataFrame, key: str, *carried: str) -> DataFrame:
    """First row per key by (ord, entry_id): a map-side minimum, no sort of a hot key."""
    first = F.min(F.struct("ord", "entry_id", *carried)).alias("first")
    return rows.groupBy(key).agg(first).select(key, "first.*")


def _flag_known(rows: DataFrame, known: DataFrame | None, key: str, flag: str) -> DataFrame:
    """Mark the rows (one per key) whose key the store has."""
    if known is None:
        return rows.withColumn(flag, F.lit(False))
    marks = known.distinct().withColumn(flag, F.lit(True))
    return rows.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def classify_entries(entries: DataFrame, store: DataFrame | None, as_of: Column) -> DataFrame:
    """Give every entry of a batch its ``outcome``.

    ``entries``: entry_id (unique), ord, title, description, link and maybe
    published_at; ``store``: canonical_url_hash, content_hash of what is kept
    already.  An address already seen in the batch is ``duplicate_batch``
    before the store is asked; an entry that loses on its address never claims
    its content; one whose content is in the store still claims it in the
    batch; rejected entries claim nothing.

    Only the first row per hash matters, and there is one such row per key, so
    hash minima are aggregated on the map side and the verdicts come back by
    the unique ``entry_id``: a hash shared by a third of all rows moves no
    more data than any other.
    """
    known_urls = known_contents = None
    if store is not None:
        known_urls = store.select(F.col("canonical_url_hash").alias("url_hash"))
        known_contents = store.select("content_hash")
    # hashes cost most of the work and are asked for twice: for the winners and for the verdicts
    return classify_hashed(written(hash_entries(entries, as_of), "hashed"), known_urls, known_contents)


def hash_entries(entries: DataFrame, as_of: Column) -> DataFrame:
    """Entries with canonical_url, reject_reason, url_hash and content_hash."""
    if "published_at" not in entries.columns:
        entries = entries.withColumn("published_at", F.lit(None).cast("timestamp"))
    return validate_entries(entries, as_of).withColumn("url_hash", F.sha2("canonical_url", 256)).withColumn(
        "content_hash", content_hash(F.col("title"), F.col("description")))


def classify_hashed(checked: DataFrame, known_urls: DataFrame | None, known_contents: DataFrame | None) -> DataFrame:
    """``outcome`` of hashed entries, given the address and content hashes that are kept already."""
    usable = checked.filter(F.col("reject_reason").isNull())
    by_url = _first_per(usable, "url_hash", "content_hash")
    by_url = _flag_known(by_url, known_urls, "url_hash", "url_known")
    by_content = _first_per(by_url.filter(~F.col("url_known")), "content_hash")
    by_content = _flag_known(by_content, known_contents, "content_hash", "content_known")
    url_winners = by_url.select("entry_id", "url_known")
    content_winners = by_content.select("entry_id", "content_known")
    verdicts = url_winners.join(content_winners, "entry_id", "left")
    outcome = (
        F.when(F.col("reject_reason").isNotNull(), "rejected")
        .when(F.col("url_known").isNull(), "duplicate_batch")
        .when(F.col("url_known"), "duplicate_url")
        .when(F.col("content_known").isNull(), "duplicate_batch")
        .when(F.col("content_known"), "duplicate_content")
        .otherwise("stored"))
    return checked.join(verdicts, "entry_id", "left").withColumn("outcome", outcome).drop(
        "url_known", "content_known")


def ingest(entries: DataFrame, store: DataFrame | None, sources: DataFrame | None, as_of: Column) -> DataFrame:
    """Classify a batch and shape its stored rows as reports."""
    classified = classify_entries(entries, store, as_of)
    return shape_reports(classified, sources, as_of) if sources is not None else classified


def shape_reports(entries: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Report columns of entries: language fallback, permitted raw text, empty text as NULL."""
    permitted = sources.select("source_id", F.col("language").alias("source_language"), "raw_text_permitted")
    language = F.coalesce(F.nullif("language", F.lit("")), F.nullif("source_language", F.lit("")), F.lit("en"))
    return (entries.join(permitted, "source_id", "left")
            .withColumn("language", F.substring(language, 1, 16))
            .withColumn("raw_text", F.when(F.col("raw_text_permitted"), F.col("description")))
            .withColumn("description", F.nullif("description", F.lit("")))
            .withColumn("retrieved_at", as_of)
            .drop("source_language", "raw_text_permitted"))


def ingest_stats(classified: DataFrame, key: str = "source_id") -> DataFrame:
    """Counters per source: fetched and one column per outcome."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return classified.groupBy(key).agg(F.count(F.lit(1)).alias("fetched"), *counts)


def content_dedup(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Add ``content_hash`` and ``outcome`` by text content alone, first copy stored."""
    hashed = documents.withColumn("content_hash", F.sha2(normalize_text(F.col(text)), 256))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias(key)).select(key, F.lit(True).alias("is_first"))
    outcome = F.when(F.col("is_first"), "stored").otherwise("duplicate_batch")
    return hashed.join(first, key, "left").withColumn("outcome", outcome).drop("is_first")


def content_originals(reports: DataFrame) -> DataFrame:
    """Earliest stored report of each content hash."""
    return reports.groupBy("content_hash").agg(
        F.min(F.struct("retrieved_at", "report_id")).alias("first"), F.count(F.lit(1)).alias("copies")).select(
        "content_hash", F.col("first.report_id").alias("report_id"),
        F.col("first.retrieved_at").alias("retrieved_at"), "copies")
