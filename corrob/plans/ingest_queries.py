"""Registered queries: text, URLs, validation, deduplicating ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import text as X
from corrob.operators import ingest as I
from corrob.operators.nearhash import near_dup_pairs, simhash, simhash_md5
from corrob.plans import views
from corrob.plans.registry import query
from corrob.plans.views import sql_canonical, sql_norm, table, with_views
from corrob.session import working_table
from corrob.sources.catalogue import Tables, read_sources
from corrob.sources.feeds import parse_entry_ts, read_feed_entries, read_feed_rejects, read_page_entries

DATE = "%Y-%m-%d %H:%M:%S"


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("content_dedup_outcomes", f"""
WITH h AS (SELECT doc_id, source, sha256({sql_norm('text')}) AS content_hash FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS rn FROM h)
SELECT source, count(*) AS fetched, count(*) FILTER (WHERE rn = 1) AS stored,
  count(*) FILTER (WHERE rn > 1) AS duplicate_batch FROM r GROUP BY source""")
def content_dedup_outcomes(spark, sf_dir):
    """Documents kept and dropped as copies, per source (flagship)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return I.ingest_stats(I.content_dedup(docs, "doc_id", "text"), "source").select(
        "source", "fetched", "stored", "duplicate_batch")


@query("normalized_texts", f"""
SELECT doc_id, sha256({sql_norm('text')}) AS content_hash, length({sql_norm('text')}) AS normalized_chars,
  sha256({sql_norm("source")} || chr(10) || {sql_norm('text')}) AS report_hash FROM documents""")
def normalized_texts(spark, sf_dir):
    norm = X.normalize_text(F.col("text"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(norm, 256).alias("content_hash"), F.length(norm).cast("bigint").alias("normalized_chars"),
        X.content_hash(F.col("source"), F.col("text")).alias("report_hash"))


@query("normalized_texts_nfkc", f"""
SELECT doc_id, sha256({sql_norm('text')}) AS content_hash FROM documents""")
def normalized_texts_nfkc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2(X.normalize_text_nfkc(F.col("text")), 256).alias("content_hash"))


@query("canonical_urls", f"""
SELECT page_id, {sql_canonical('url')} AS canonical_url, sha256({sql_canonical('url')}) AS url_hash FROM pages""")
def canonical_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id", X.canonicalize_url(F.col("url")).alias("canonical_url"), X.url_hash(F.col("url")).alias("url_hash"))


@query("url_dedup", f"""
WITH u AS (SELECT page_id AS entry_id, sha256({sql_canonical('url')}) AS url_hash FROM pages
  UNION ALL SELECT page_id + 1000000000, sha256({sql_canonical("replace(url, 'https:', 'http:')")}) FROM pages)
SELECT url_hash, min(entry_id) AS first_entry, count(*) AS copies FROM u GROUP BY url_hash""")
def url_dedup(spark, sf_dir):
    """First entry per canonical address over two spellings of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    other = pages.select(F.col("page_id") + 1000000000, F.replace("url", F.lit("https:"), F.lit("http:")))
    both = pages.select(F.col("page_id").alias("entry_id"), "url").union(other)
    return both.groupBy(X.url_hash(F.col("url")).alias("url_hash")).agg(
        F.min("entry_id").alias("first_entry"), F.count(F.lit(1)).alias("copies"))


@query("page_titles", f"""
SELECT page_id, {views._TITLE} AS title, sha256({views._BODY}) AS body_hash, {sql_canonical('url')} AS canonical_url
FROM pages""")
def page_titles(spark, sf_dir):
    return read_page_entries(table(spark, sf_dir, "pages")).select(
        "page_id", "title", F.sha2("description", 256).alias("body_hash"), "canonical_url")


@query("entry_dates", f"""
SELECT event_id, strftime(ts, '{DATE}') AS from_rfc, strftime(ts, '{DATE}') AS from_iso,
  strftime(ts, '{DATE}') AS from_fallback, CAST(NULL AS VARCHAR) AS from_junk, CAST(NULL AS VARCHAR) AS from_clock,
  strftime(ts + INTERVAL 5 HOUR, '{DATE}') AS from_est, strftime(ts + INTERVAL 7 HOUR, '{DATE}') AS from_pdt,
  strftime(date_trunc('day', ts), '{DATE}') AS from_month_first, strftime(ts, '{DATE}') AS from_short_year,
  strftime(date_trunc('minute', ts), '{DATE}') AS from_slashes, strftime(date_trunc('minute', ts), '{DATE}') AS from_no_seconds,
  strftime(ts - INTERVAL 330 MINUTE, '{DATE}') AS from_offset FROM events""")
def entry_dates(spark, sf_dir):
    """Every event time written in the spellings of feeds and parsed back."""
    rfc = F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    junk = F.lit("not a date")
    spelled = {"est": "EEE, dd MMM yyyy HH:mm:ss 'EST'", "pdt": "dd MMM yyyy HH:mm:ss 'PDT'", "month_first": "MMMM d, yyyy",
               "short_year": "EEE, dd MMM yy HH:mm:ss 'GMT'", "slashes": "yyyy/MM/dd HH:mm", "no_seconds": "d MMMM yyyy HH:mm",
               "offset": "EEE, dd MMM yyyy HH:mm:ss '+0530'"}
    return table(spark, sf_dir, "events").select(
        "event_id", stamp(parse_entry_ts(rfc)).alias("from_rfc"), stamp(parse_entry_ts(iso)).alias("from_iso"),
        stamp(parse_entry_ts(junk, rfc)).alias("from_fallback"), stamp(parse_entry_ts(junk)).alias("from_junk"),
        stamp(parse_entry_ts(F.date_format("ts", "HH:mm"))).alias("from_clock"),
        *[stamp(parse_entry_ts(F.date_format("ts", f))).alias(f"from_{name}") for name, f in spelled.items()])


_REASON = f"""CASE WHEN trim(title) = '' THEN 'empty title' WHEN trim(link) = '' THEN 'empty link'
  WHEN NOT regexp_matches(link, '^https?://') THEN 'non-http(s) link'
  WHEN length(title) > {V.MAX_TITLE_LENGTH} THEN 'title too long'
  WHEN length(description) > {V.MAX_DESCRIPTION_LENGTH} THEN 'description too long'
  WHEN published_at > TIMESTAMP '{views.AS_OF_EVENTS}' + INTERVAL {V.MAX_FUTURE_SKEW_SECONDS} SECOND
    THEN 'published_at implausibly in the future' END"""


@query("entry_validation", with_views("entries") + f"""
SELECT entry_id, coalesce({_REASON}, 'ok') AS reject_reason FROM entries""")
def entry_validation(spark, sf_dir):
    checked = I.validate_entries(views.entries(spark, sf_dir), views.as_of_events())
    return checked.select("entry_id", F.coalesce("reject_reason", F.lit("ok")).alias("reject_reason"))


_CLASSIFIED = with_views("entries", "stored") + f""",
checked AS (SELECT *, {_REASON} AS reason, sha256({sql_canonical('link')}) AS url_hash,
  sha256({sql_norm('title')} || chr(10) || {sql_norm('description')}) AS chash FROM entries),
u AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY ord) AS url_rn FROM checked WHERE reason IS NULL),
v AS (SELECT *, url_hash IN (SELECT canonical_url_hash FROM stored) AS url_known FROM u WHERE url_rn = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY chash ORDER BY ord) AS c_rn,
  chash IN (SELECT content_hash FROM stored) AS content_known FROM v WHERE NOT url_known),
classified AS (SELECT c.*, CASE WHEN c.reason IS NOT NULL THEN 'rejected' WHEN v.entry_id IS NULL THEN 'duplicate_batch'
    WHEN v.url_known THEN 'duplicate_url' WHEN w.c_rn > 1 THEN 'duplicate_batch'
    WHEN w.content_known THEN 'duplicate_content' ELSE 'stored' END AS outcome
  FROM checked c LEFT JOIN v USING (entry_id) LEFT JOIN w USING (entry_id))
"""


def classified(spark, sf_dir):
    return I.classify_entries(views.entries(spark, sf_dir), views.stored(spark, sf_dir), views.as_of_events())


@query("ingest_outcomes", _CLASSIFIED + "SELECT entry_id, outcome FROM classified")
def ingest_outcomes(spark, sf_dir):
    return classified(spark, sf_dir).select("entry_id", "outcome")


@query("ingest_counters", _CLASSIFIED + """
SELECT source_id, count(*) AS fetched, count(*) FILTER (WHERE outcome = 'stored') AS stored,
  count(*) FILTER (WHERE outcome = 'duplicate_url') AS duplicate_url,
  count(*) FILTER (WHERE outcome = 'duplicate_content') AS duplicate_content,
  count(*) FILTER (WHERE outcome = 'duplicate_batch') AS duplicate_batch,
  count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM classified GROUP BY source_id""")
def ingest_counters(spark, sf_dir):
    return I.ingest_stats(classified(spark, sf_dir))


@query("shaped_reports", with_views("entries", "sources") + f"""
SELECT entry_id, left(coalesce(nullif(e.language, ''), nullif(s.language, ''), 'en'), 16) AS language,
  coalesce(length(CASE WHEN s.raw_text_permitted THEN description END), -1) AS raw_chars, description = '' AS was_empty,
  nullif(description, '') IS NULL AS is_null
FROM entries e LEFT JOIN sources s USING (source_id)""")
def shaped_reports(spark, sf_dir):
    entries = views.entries(spark, sf_dir).withColumn("was_empty", F.col("description") == "")
    shaped = I.shape_reports(entries, views.sources(spark, sf_dir), views.as_of_events())
    return shaped.select("entry_id", "language", F.coalesce(F.length("raw_text"), F.lit(-1)).cast("bigint").alias("raw_chars"), "was_empty",
                         F.col("description").isNull().alias("is_null"))


@query("content_originals", f"""
WITH h AS (SELECT event_id AS report_id, ts AS retrieved_at,
  sha256({sql_norm('event_type')} || chr(10) || {sql_norm('props')}) AS content_hash FROM events)
SELECT content_hash, arg_min(report_id, (retrieved_at, report_id)) AS report_id,
  strftime(min(retrieved_at), '{DATE}') AS retrieved_at, count(*) AS copies FROM h GROUP BY content_hash""")
def content_originals(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("report_id"), F.col("ts").alias("retrieved_at"),
        X.content_hash(F.col("event_type"), F.col("props")).alias("content_hash"))
    return I.content_originals(rows).withColumn("retrieved_at", stamp("retrieved_at"))


_VOTES = {h: " + ".join(f"(CASE WHEN sum(2 * (({h} >> {b}) & 1) - 1) > 0 THEN {1 << b} ELSE 0 END)" for b in range(32))
          for h in ("high", "low")}
_SIMHASH = f"""
WITH tokens AS (SELECT doc_id, unnest(string_split({sql_norm('text')}, ' ')) AS token FROM documents),
hashed AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 8))::BIGINT AS high, ('0x' || substr(md5(token), 9, 8))::BIGINT AS low
  FROM tokens WHERE token <> ''),
sig AS (SELECT doc_id, lower(lpad(printf('%x', CAST({_VOTES['high']} AS BIGINT)), 8, '0') ||
  lpad(printf('%x', CAST({_VOTES['low']} AS BIGINT)), 8, '0')) AS simhash FROM hashed GROUP BY doc_id),
signatures AS (SELECT doc_id, coalesce(simhash, '0000000000000000') AS simhash FROM documents LEFT JOIN sig USING (doc_id))
"""


@query("simhash_md5", _SIMHASH + "SELECT doc_id, simhash FROM signatures")
def simhash_md5_query(spark, sf_dir):
    return simhash_md5(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("simhash_signatures")
def simhash_signatures(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", simhash(F.col("text")).alias("simhash"))


@query("near_dup_pairs", _SIMHASH + """,
g AS (SELECT simhash, min(doc_id) AS id, count(*) AS copies, ('0x' || substr(simhash, 1, 8))::BIGINT AS high,
  ('0x' || substr(simhash, 9, 8))::BIGINT AS low FROM signatures GROUP BY simhash)
SELECT a.id AS id_a, b.id AS id_b, a.copies AS copies_a, b.copies AS copies_b,
  CAST(bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) AS INT) AS distance
FROM g a JOIN g b ON a.id < b.id WHERE bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= 3""")
def near_dup(spark, sf_dir):
    signatures = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), simhash(F.col("text"), "md5").alias("simhash"))
    return near_dup_pairs(signatures, 3)


@query("slugs_and_pseudonyms", f"""
SELECT event_id, coalesce(nullif(left(trim(replace(replace({sql_norm("event_type || ' ' || props")}, ' ', '-'), '_', ''), '-'), 180), ''), 'article') AS slug,
  left(sha256(CAST(user_id AS VARCHAR)), 12) AS client FROM events""")
def slugs_and_pseudonyms(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", X.slugify(F.concat_ws(" ", "event_type", "props")).alias("slug"),
        X.pseudonym(F.col("user_id").cast("string")).alias("client"))


@query("number_token_sets", """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(\\d+(?:[.,]\\d+)?)', 1)) AS raw FROM documents),
n AS (SELECT DISTINCT doc_id, CAST(replace(raw, ',', '') AS DOUBLE) AS v FROM t)
SELECT doc_id, count(v) AS numbers, round(coalesce(sum(v % 1000003), 0), 2) AS checksum
FROM documents LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def number_token_sets(spark, sf_dir):
    values = X.number_tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", values.alias("v")).select(
        "doc_id", F.size("v").cast("bigint").alias("numbers"),
        F.round(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x % 1000003), 2).alias("checksum"))


@query("json_keys", """
SELECT event_id, coalesce(array_to_string(CAST('["' || event_type || '","' || CAST(user_id AS VARCHAR) || '"]' AS JSON)::VARCHAR[], '|'), '') AS decoded,
  true AS object_is_null FROM events""")
def json_keys(spark, sf_dir):
    listed = F.to_json(F.array("event_type", F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select(
        "event_id", F.array_join(X.json_list(listed), "|").alias("decoded"),
        X.json_list(F.col("props")).isNull().alias("object_is_null"))


# --- landed files: feeds, catalogues, model tables ------------------------------


def landed_feeds(spark, sf_dir) -> str:
    """Events as ten RSS files and regions as files that are no feeds, under one folder."""
    feed = (F.col("user_id") % 10).cast("int")
    events = table(spark, sf_dir, "events").select(feed.alias("feed"), F.col("event_id").alias("ord"), F.format_string(
        "<item><title>Event %d</title><link>http://Host.example/%d/?utm_source=x#top</link><description>&lt;b&gt;%s&lt;/b&gt; seen</description>"
        "<pubDate>%s</pubDate></item>", "event_id", "event_id", "event_type", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).alias("value"))
    feeds = events.select("feed").distinct()
    head = feeds.select("feed", F.lit(-1).alias("ord"), F.format_string(
        '<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title><language>l%d</language>', "feed").alias("value"))
    tail = feeds.select("feed", F.lit(2**62).alias("ord"), F.lit("</channel></rss>").alias("value"))
    junk = table(spark, sf_dir, "region").select((100 + F.col("r_regionkey")).cast("int").alias("feed"), F.lit(0).alias("ord"),
                                                 F.concat(F.lit("no feed of "), "r_name").alias("value"))
    path = working_table(spark, "feeds")
    head.unionByName(events).unionByName(tail).unionByName(junk).repartition("feed").sortWithinPartitions("feed", "ord").select(
        "feed", "value").write.partitionBy("feed").text(path)
    return path


FEED_SQL = f"""
SELECT 'Event ' || CAST(event_id AS VARCHAR) AS title, event_type || '  seen' AS description, 'https://host.example/' || CAST(event_id AS VARCHAR) AS canonical_url,
  strftime(ts, '{DATE}') AS published_at, 'l' || CAST(user_id % 10 AS VARCHAR) AS language FROM events"""


@query("feed_entries", FEED_SQL)
def feed_entries(spark, sf_dir):
    return read_feed_entries(spark, landed_feeds(spark, sf_dir)).select(
        "title", "description", "canonical_url", stamp("published_at").alias("published_at"), "language")


@query("feed_rejects", "SELECT CAST(100 + r_regionkey AS VARCHAR) AS feed, 'feed could not be parsed' AS problem FROM region")
def feed_rejects(spark, sf_dir):
    return read_feed_rejects(spark, landed_feeds(spark, sf_dir)).select(
        F.regexp_extract("feed_file", "feed=([0-9]+)/", 1).alias("feed"), "problem")


@query("catalogue_file", """
SELECT 's' || CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, CASE WHEN s_nationkey % 2 = 0 THEN 'GB' ELSE 'FR' END AS country,
  CASE WHEN s_suppkey % 3 = 0 THEN 300 ELSE 60 + s_nationkey END AS poll_interval_seconds, 70.0::DOUBLE AS reliability_score, 'en' AS language, true AS enabled
FROM supplier""")
def catalogue_file(spark, sf_dir):
    """A JSON list of sources with missing fields, read with its defaults."""
    n = F.col("s_nationkey")
    source = F.to_json(F.struct(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        F.when(n % 2 == 0, " gb ").otherwise("fr").alias("country"),
        F.when(F.col("s_suppkey") % 3 != 0, (60 + n).cast("int")).alias("poll_interval_seconds")))
    suppliers = table(spark, sf_dir, "supplier")
    first = suppliers.agg(F.min("s_suppkey").alias("first"))
    rows = suppliers.crossJoin(first).select(F.col("s_suppkey").alias("ord"), F.concat(
        F.when(F.col("s_suppkey") == F.col("first"), "[").otherwise(","), source).alias("value"))
    end = first.select(F.lit(2**62).alias("ord"), F.lit("]").alias("value"))
    path = working_table(spark, "catalogue")
    rows.unionByName(end).coalesce(1).sortWithinPartitions("ord").select("value").write.text(path)
    return read_sources(spark, path).select("id", "name", "country", "poll_interval_seconds", "reliability_score", "language", "enabled")


@query("model_table_scan", "SELECT CAST(o_custkey AS VARCHAR) AS event_id, CAST(o_orderkey AS VARCHAR) AS report_id FROM orders WHERE o_orderstatus = 'F'")
def model_table_scan(spark, sf_dir):
    path = working_table(spark, "model")
    table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("event_id"), F.col("o_orderkey").cast("string").alias("report_id"),
        F.col("o_totalprice").alias("similarity_score"), (F.col("o_orderstatus") == "F").alias("is_primary")).write.parquet(f"{path}/event_reports")
    return Tables(spark, path).event_reports.filter("is_primary").select("event_id", "report_id")
