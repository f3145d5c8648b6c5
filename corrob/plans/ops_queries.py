"""Registered queries: health, metrics, maintenance, quotas, catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import scores as S
from corrob.operators import ops as O
from corrob.plans import views
from corrob.plans.ingest_queries import DATE, stamp
from corrob.plans.registry import query
from corrob.plans.views import table, with_views
from corrob.session import working_table
from corrob.sources import catalogue as C
from corrob.sources.keyed import KeyedTable

_HEALTH = """numbered AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY checked_at DESC, poll_id DESC) - 1 AS k,
  count(*) OVER (PARTITION BY source_id) AS n FROM polls),
ewma AS (SELECT source_id, sum(CASE WHEN k = n - 1 THEN pow(0.7, k) ELSE 0.3 * pow(0.7, k) END * latency_ms) AS avg_latency_ms FROM numbered GROUP BY source_id),
folded AS (SELECT source_id, count(*) FILTER (WHERE ok) AS success_count, count(*) FILTER (WHERE NOT ok) AS failure_count,
  coalesce(min(k) FILTER (WHERE ok), count(*)) AS consecutive_failures, max(checked_at) FILTER (WHERE ok) AS last_success_at,
  max(checked_at) FILTER (WHERE NOT ok) AS last_failure_at, max(checked_at) AS last_checked_at,
  max(CASE WHEN k = 0 AND NOT ok THEN left(error, 2000) END) AS last_error, bool_or(k = 0 AND ok) AS last_ok FROM numbered GROUP BY source_id),
health AS (SELECT f.*, e.avg_latency_ms, CASE WHEN last_ok THEN CASE WHEN avg_latency_ms > 10000 THEN 'degraded' ELSE 'healthy' END
  WHEN consecutive_failures >= 6 THEN 'down' ELSE 'degraded' END AS status FROM folded f JOIN ewma e USING (source_id))
"""
HEALTH_SQL = with_views("polls", "sources") + ", " + _HEALTH


def health(spark, sf_dir):
    return O.source_health(views.polls(spark, sf_dir))


@query("ewma_latency", HEALTH_SQL + "SELECT source_id, round(avg_latency_ms, 6) AS avg_latency_ms FROM ewma")
def ewma_latency(spark, sf_dir):
    return O.ewma_latency(views.polls(spark, sf_dir)).withColumn("avg_latency_ms", F.round("avg_latency_ms", 6))


@query("failure_streaks", HEALTH_SQL + "SELECT source_id, success_count, failure_count, consecutive_failures FROM folded")
def failure_streaks(spark, sf_dir):
    return O.failure_streaks(views.polls(spark, sf_dir)).select(
        "source_id", "success_count", "failure_count", "consecutive_failures")


@query("source_health", HEALTH_SQL + f"""
SELECT source_id, status, success_count, failure_count, consecutive_failures, round(avg_latency_ms, 4) AS avg_latency_ms,
  strftime(last_success_at, '{DATE}') AS last_success_at, strftime(last_failure_at, '{DATE}') AS last_failure_at,
  strftime(last_checked_at, '{DATE}') AS last_checked_at, last_error FROM health""")
def source_health(spark, sf_dir):
    return health(spark, sf_dir).select(
        "source_id", "status", "success_count", "failure_count", "consecutive_failures",
        F.round("avg_latency_ms", 4).alias("avg_latency_ms"), stamp("last_success_at").alias("last_success_at"),
        stamp("last_failure_at").alias("last_failure_at"), stamp("last_checked_at").alias("last_checked_at"), "last_error")


@query("source_health_report", HEALTH_SQL + """
SELECT slug, name, enabled, is_international, coalesce(h.status, 'unknown') AS status,
  coalesce(h.consecutive_failures, 0) AS consecutive_failures, coalesce(h.success_count, 0) AS success_count,
  coalesce(h.failure_count, 0) AS failure_count FROM sources s LEFT JOIN (SELECT * FROM health WHERE source_id % 10 <> 3) h USING (source_id)""")
def source_health_report(spark, sf_dir):
    """Health of every source; those ending in 3 have never been polled."""
    polled = health(spark, sf_dir).filter(F.col("source_id") % 10 != 3)
    return O.source_health_report(views.sources(spark, sf_dir), polled, worst_first=True).select(
        "slug", "name", "enabled", "is_international", "status", "consecutive_failures", "success_count", "failure_count")


OVERDUE_SQL = HEALTH_SQL + f"""
, due AS (SELECT source_id, coalesce(last_success_at, last_failure_at) + to_seconds(poll_interval_seconds * least(greatest(coalesce(consecutive_failures, 0), 1), 8)) AS d
  FROM sources LEFT JOIN health USING (source_id) WHERE enabled)
SELECT source_id, strftime(coalesce(d, TIMESTAMP '2024-01-30 23:00:00'), '{DATE}') AS next_due FROM due WHERE d IS NULL OR d <= TIMESTAMP '2024-01-30 23:00:00'"""


def overdue_report(sources, health, clock):
    return O.overdue_sources(sources, health, clock).select("source_id", stamp("next_due").alias("next_due"))


@query("overdue_sources", OVERDUE_SQL)
def overdue_sources(spark, sf_dir):
    clock = F.lit("2024-01-30 23:00:00").cast("timestamp_ntz")
    return overdue_report(views.sources(spark, sf_dir), health(spark, sf_dir), clock)


@query("offline_sources", HEALTH_SQL + "SELECT name FROM sources JOIN health USING (source_id) WHERE enabled AND consecutive_failures >= 1")
def offline_sources(spark, sf_dir):
    """Names of enabled sources, counting any running failure streak as down."""
    state = health(spark, sf_dir).withColumn(
        "status", F.when(F.col("consecutive_failures") >= 1, "down").otherwise(F.col("status")))
    return O.offline_sources(views.sources(spark, sf_dir), state)


_STATUS_OF_KIND = "CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'view' THEN 'DUPLICATE' ELSE 'NEW' END"


def statused_reports(spark, sf_dir):
    kind = F.col("kind")
    return views.reports(spark, sf_dir).withColumn(
        "status", F.when(kind == "error", "FAILED").when(kind == "view", "DUPLICATE").otherwise("NEW"))


_CLOCK = f"TIMESTAMP '{views.AS_OF_EVENTS}'"
_REPORTS_ROWS = f"""SELECT 'ingestion' AS section, unnest(['reports_total', 'reports_last_hour', 'reports_last_24h', 'duplicates_total', 'failed_reports_total']) AS metric,
  unnest([count(*), count(*) FILTER (WHERE ts >= {_CLOCK} - INTERVAL 1 HOUR), count(*) FILTER (WHERE ts >= {_CLOCK} - INTERVAL 24 HOUR),
  count(*) FILTER (WHERE {_STATUS_OF_KIND} = 'DUPLICATE'), count(*) FILTER (WHERE {_STATUS_OF_KIND} = 'FAILED')])::DOUBLE AS value FROM events"""


@query("ops_snapshot", with_views("polls", "sources", "event_rows", "jobs", "articles") + ", " + _HEALTH + f""",
state AS (SELECT enabled, coalesce(status, 'unknown') AS status FROM sources LEFT JOIN health USING (source_id))
SELECT 'sources' AS section, unnest(['total', 'enabled', 'healthy', 'degraded', 'down', 'unknown']) AS metric,
  unnest([count(*), count(*) FILTER (WHERE enabled), count(*) FILTER (WHERE status = 'healthy'), count(*) FILTER (WHERE status = 'degraded'),
  count(*) FILTER (WHERE status = 'down'), count(*) FILTER (WHERE status = 'unknown')])::DOUBLE AS value FROM state
UNION ALL {_REPORTS_ROWS}
UNION ALL SELECT 'events', unnest(['total', 'created_last_24h']), unnest([count(*), count(*) FILTER (WHERE first_detected_at >= {_CLOCK} - INTERVAL 24 HOUR)])::DOUBLE FROM event_rows
UNION ALL SELECT 'events_by_status', status, count(*)::DOUBLE FROM event_rows GROUP BY status
UNION ALL SELECT 'events', 'merged_reports_total', count(*)::DOUBLE FROM events
UNION ALL SELECT 'jobs', unnest(['dead_total', 'failures_last_hour', 'max_attempts_seen']), unnest([count(*) FILTER (WHERE status = 'DEAD'),
  count(*) FILTER (WHERE attempts > 1 AND updated_at >= {_CLOCK} - INTERVAL 1 HOUR), max(attempts)])::DOUBLE FROM jobs
UNION ALL SELECT 'queue', status, count(*)::DOUBLE FROM jobs GROUP BY status
UNION ALL SELECT 'articles', 'articles_published', count(*) FILTER (WHERE is_published)::DOUBLE FROM articles""")
def ops_snapshot(spark, sf_dir):
    reports = statused_reports(spark, sf_dir)
    return O.ops_snapshot(
        views.sources(spark, sf_dir), health(spark, sf_dir), reports, views.events(spark, sf_dir),
        reports.select("event_key", "report_id"), views.jobs(spark, sf_dir), views.articles(spark, sf_dir), views.as_of_events())


@query("accuracy_snapshot", with_views("articles", "article_versions", "conflicts", "event_rows", "as_of_orders") + """,
a AS (SELECT count(*) FILTER (WHERE is_published) AS articles_published,
  count(*) FILTER (WHERE is_published AND published_at >= as_of - INTERVAL 24 HOUR) AS articles_published_24h,
  count(*) FILTER (WHERE is_published AND confidence_score < 70) AS low_confidence_publications FROM articles, clock),
v AS (SELECT count(*) FILTER (WHERE version > 1) AS corrections FROM article_versions),
c AS (SELECT count(*) FILTER (WHERE status = 'unresolved') AS source_conflicts_open FROM conflicts),
e AS (SELECT count(*) FILTER (WHERE status = 'EDITORIAL_REVIEW') AS er FROM event_rows),
d AS (SELECT count(*) AS duplicate_publications FROM (SELECT event_id FROM articles WHERE is_published GROUP BY event_id HAVING count(*) > 1) q)
SELECT articles_published, articles_published_24h, low_confidence_publications, corrections, source_conflicts_open, duplicate_publications,
  corrections + er AS fact_validation_failures, round((corrections + er) / (articles_published + corrections + er), 4) AS rejection_rate,
  70.0::DOUBLE AS confidence_floor FROM a, v, c, e, d""")
def accuracy_snapshot(spark, sf_dir):
    return O.accuracy_snapshot(views.articles(spark, sf_dir), views.article_versions(spark, sf_dir),
                               views.conflicts(spark, sf_dir), views.events(spark, sf_dir), views.as_of_orders(spark, sf_dir))


@query("duplicate_publications", with_views("articles") + """
SELECT event_id, count(*) AS published FROM articles WHERE is_published GROUP BY event_id HAVING count(*) > 1""")
def duplicate_publications(spark, sf_dir):
    return O.duplicate_publications(views.articles(spark, sf_dir))


@query("ingestion_stats", with_views("polls", "jobs") + ", " + _HEALTH + f"""
SELECT replace(section, 'ingestion', 'reports') AS section, metric, value FROM ({_REPORTS_ROWS}) r WHERE metric <> 'failed_reports_total'
UNION ALL SELECT 'sources', unnest(['sources_healthy', 'sources_degraded', 'sources_down', 'sources_unknown']),
  unnest([count(*) FILTER (WHERE status = 'healthy'), count(*) FILTER (WHERE status = 'degraded'), count(*) FILTER (WHERE status = 'down'), count(*) FILTER (WHERE status = 'unknown')])::DOUBLE FROM health
UNION ALL SELECT 'queue', status, count(*)::DOUBLE FROM jobs GROUP BY status""")
def ingestion_stats(spark, sf_dir):
    return O.ingestion_stats(statused_reports(spark, sf_dir), health(spark, sf_dir), views.jobs(spark, sf_dir), views.as_of_events())


@query("intelligence_stats", with_views("event_rows", "conflicts", "article_versions") + """
SELECT 'events' AS section, unnest(['events_total', 'events_verified', 'events_unverified', 'events_with_conflicts', 'mean_confidence', 'low_confidence_published']) AS metric,
  unnest([count(*)::DOUBLE, count(*) FILTER (WHERE status = 'VERIFIED'), count(*) FILTER (WHERE status = 'UNVERIFIED'), count(*) FILTER (WHERE conflict_count > 0),
  round(avg(confidence_score), 2), count(*) FILTER (WHERE status IN ('PUBLISHED', 'UPDATING') AND confidence_score < 70)])::DOUBLE AS value FROM event_rows
UNION ALL SELECT 'events_by_status', status, count(*)::DOUBLE FROM event_rows GROUP BY status
UNION ALL SELECT 'facts', 'facts_total', count(*)::DOUBLE FROM article_versions
UNION ALL SELECT 'conflicts', unnest(['conflicts_total', 'conflicts_unresolved']), unnest([count(*), count(*) FILTER (WHERE status = 'unresolved')])::DOUBLE FROM conflicts""")
def intelligence_stats(spark, sf_dir):
    return O.intelligence_stats(views.events(spark, sf_dir), views.article_versions(spark, sf_dir), views.conflicts(spark, sf_dir))


@query("queue_depth", with_views("jobs") + "SELECT status, count(*) AS jobs FROM jobs GROUP BY status")
def queue_depth(spark, sf_dir):
    return O.queue_depth(views.jobs(spark, sf_dir))


@query("queue_depth_urgent", with_views("jobs") + "SELECT status, count(*) AS jobs FROM jobs WHERE job_type = '1-URGENT' GROUP BY status")
def queue_depth_urgent(spark, sf_dir):
    return O.queue_depth(views.jobs(spark, sf_dir), "1-URGENT")


@query("active_events", with_views("event_rows") + """SELECT count(*) FILTER (WHERE status IN ('DETECTED', 'CLUSTERING', 'VERIFYING',
  'VERIFIED', 'EDITORIAL_REVIEW', 'PUBLISHED', 'UPDATING')) AS active_events FROM event_rows""")
def active_events(spark, sf_dir):
    return O.count_active(views.events(spark, sf_dir))


@query("latency_summary", """
WITH r AS (SELECT value AS latency_ms, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events),
t AS (SELECT count(*) AS requests, max(value) AS max_ms, round(avg(value), 6) AS mean_ms,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS error_rate,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS requests_per_second FROM events)
SELECT t.*, (SELECT latency_ms FROM r WHERE i = CAST(round_even(0.50 * (n - 1), 0) AS BIGINT)) AS p50_ms,
  (SELECT latency_ms FROM r WHERE i = CAST(round_even(0.90 * (n - 1), 0) AS BIGINT)) AS p90_ms,
  (SELECT latency_ms FROM r WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) AS p95_ms,
  (SELECT latency_ms FROM r WHERE i = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT)) AS p99_ms FROM t""")
def latency_summary(spark, sf_dir):
    return O.latency_summary(table(spark, sf_dir, "events").select(
        F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"), F.col("ts").alias("at")))


@query("supported_countries", with_views("countries", "country_sources") + """,
m AS (SELECT country_key + 3 AS country_key, bool_or(enabled) AS on_ FROM country_sources GROUP BY 1)
SELECT coalesce(c.country_key, m.country_key) AS country_key, coalesce(name, CAST(m.country_key AS VARCHAR)) AS name,
  CASE WHEN name IS NULL THEN true ELSE coalesce(on_, false) END AS is_supported FROM countries c FULL OUTER JOIN m ON c.country_key = m.country_key""")
def supported_countries(spark, sf_dir):
    """Mappings moved three keys up, so that some countries are unmapped and some unlisted."""
    moved = views.country_sources(spark, sf_dir).withColumn("country_key", F.col("country_key") + 3)
    return O.supported_countries(views.countries(spark, sf_dir), moved)


@query("reconcile", """
SELECT 'orders' AS "table", count(*) AS rows_a, count(*) AS rows_b, 'OK' AS status FROM orders
UNION ALL SELECT 'part', count(*), count(*), 'FAIL' FROM part
UNION ALL SELECT 'customer', count(*), 2 * count(*), 'FAIL' FROM customer""")
def reconcile(spark, sf_dir):
    """Copies of three tables: equal, one value changed everywhere, rows doubled."""
    orders, part, customer = (table(spark, sf_dir, t) for t in ("orders", "part", "customer"))
    changed = part.withColumn("p_retailprice", F.col("p_retailprice") + 1)
    return O.reconcile({"orders": (orders, orders), "part": (part, changed), "customer": (customer, customer.union(customer))})


@query("archive_stale", with_views("event_rows", "as_of_orders") + f""",
s AS (SELECT *, status IN ('DETECTED', 'CLUSTERING', 'VERIFYING', 'VERIFIED', 'EDITORIAL_REVIEW', 'PUBLISHED', 'UPDATING')
  AND last_updated_at < as_of - INTERVAL 168 HOUR AS stale FROM event_rows, clock)
SELECT event_id, CASE WHEN stale THEN 'ARCHIVED' ELSE status END AS status,
  strftime(CASE WHEN stale THEN as_of ELSE last_updated_at END, '{DATE}') AS last_updated_at FROM s""")
def archive_stale(spark, sf_dir):
    return O.archive_stale(views.events(spark, sf_dir), views.as_of_orders(spark, sf_dir)).select(
        "event_id", "status", stamp("last_updated_at").alias("last_updated_at"))


@query("job_retention", with_views("jobs", "as_of_orders") + """
SELECT job_id, status FROM jobs, clock WHERE NOT (status = 'SUCCEEDED' AND updated_at < as_of - INTERVAL 7 DAY)""")
def job_retention(spark, sf_dir):
    return O.prune_jobs(views.jobs(spark, sf_dir), views.as_of_orders(spark, sf_dir)).select("job_id", "status")


@query("expired_images", """
SELECT event_id AS image_id FROM events WHERE event_type <> 'view' AND ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:00:00'""")
def expired_images(spark, sf_dir):
    expires = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    images = table(spark, sf_dir, "events").select(F.col("event_id").alias("image_id"), expires.alias("expires_at"))
    return O.expired(images, F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")).select("image_id")


@query("retry_backoff", with_views("jobs") + "SELECT job_id, least(30 * pow(2, attempts - 1), 3600)::DOUBLE AS wait_seconds FROM jobs")
def retry_backoff(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("job_id", S.retry_backoff(F.col("attempts")).alias("wait_seconds"))


@query("hourly_budget", """
WITH r AS (SELECT event_id AS request_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) AS k FROM events)
SELECT request_id, k <= 10 AS admitted FROM r""")
def hourly_budget(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.col("ts").alias("at"))
    return O.admit_hourly(requests, 10).select("request_id", "admitted")


_PATH = "CASE event_type WHEN 'error' THEN '/health' WHEN 'signup' THEN '/admin/jobs' ELSE '/feed' END"


def requests(spark, sf_dir):
    """Access log with few clients, so that quotas bind."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("client"), F.col("ts").alias("at"),
        F.when(kind == "error", "/health").when(kind == "signup", "/admin/jobs").otherwise("/feed").alias("path"))


@query("window_quota", f"""
WITH r AS (SELECT event_id AS request_id, user_id % 5 AS client, ts, {_PATH} AS path FROM events),
k AS (SELECT request_id, row_number() OVER (PARTITION BY client, epoch_us(ts) // 60000000 ORDER BY ts, request_id) AS k FROM r WHERE path <> '/health')
SELECT request_id, path = '/health' OR k <= CASE WHEN path LIKE '/admin%' THEN 1 ELSE 2 END AS admitted FROM r LEFT JOIN k USING (request_id)""")
def window_quota(spark, sf_dir):
    return O.admit_window(requests(spark, sf_dir), 2, 1).select("request_id", "admitted")


@query("poll_buckets", """
SELECT event_id, CAST(epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 300 AS BIGINT) AS bucket FROM events""")
def poll_buckets(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.poll_bucket(F.col("ts"), F.lit(300)).alias("bucket"))


_CATALOGUE = """WITH cat AS (SELECT 'src' || CAST(s_suppkey // 2 AS VARCHAR) AS id, CASE WHEN s_nationkey % 5 = 0 THEN 'U1' ELSE 'us' END AS country,
  CASE WHEN s_suppkey % 6 = 0 THEN 'html' WHEN s_suppkey % 2 = 0 THEN 'rss' ELSE 'api' END AS type,
  CASE WHEN s_suppkey % 4 <> 0 THEN 'https://e.com/rss' END AS rss_url, CAST(s_suppkey % 120 AS INT) AS priority,
  s_acctbal / 100 AS reliability_score, CAST(20 + s_suppkey % 40 AS INT) AS poll, s_suppkey % 3 = 0 AS is_international FROM supplier),
maps AS (SELECT CASE WHEN n_nationkey % 4 = 0 THEN 'X9' ELSE 'FR' END AS country_code, 'src' || CAST(n_nationkey * 9 AS VARCHAR) AS prim FROM nation)
"""


def catalogue(spark, sf_dir):
    s, lit = F.col("s_suppkey"), F.lit
    sources = table(spark, sf_dir, "supplier").select(
        F.concat(lit("src"), F.floor(s / 2).cast("string")).alias("id"),
        F.when(F.col("s_nationkey") % 5 == 0, "U1").otherwise("us").alias("country"),
        F.when(s % 6 == 0, "html").when(s % 2 == 0, "rss").otherwise("api").alias("type"),
        F.when(s % 4 != 0, "https://e.com/rss").alias("rss_url"), (s % 120).cast("int").alias("priority"),
        (F.col("s_acctbal") / 100).alias("reliability_score"), (20 + s % 40).cast("int").alias("poll_interval_seconds"),
        (s % 3 == 0).alias("is_international"))
    n = F.col("n_nationkey")
    mappings = table(spark, sf_dir, "nation").select(
        F.when(n % 4 == 0, "X9").otherwise("FR").alias("country_code"), F.concat(lit("src"), (n * 9).cast("string")).alias("primary"))
    return sources, mappings


@query("check_sources", _CATALOGUE + """
SELECT 'country must be ISO 3166-1 alpha-2' AS rule, id AS key FROM cat WHERE country = 'U1'
UNION ALL SELECT 'priority must be 0-100', id FROM cat WHERE priority > 100
UNION ALL SELECT 'reliability must be 0-100', id FROM cat WHERE reliability_score < 0 OR reliability_score > 100
UNION ALL SELECT 'poll interval too short', id FROM cat WHERE poll < 30
UNION ALL SELECT 'feed source has no rss_url', id FROM cat WHERE type = 'rss' AND rss_url IS NULL
UNION ALL SELECT 'unknown source type', id FROM cat WHERE type = 'html'
UNION ALL SELECT 'source id is not unique', id FROM cat GROUP BY is_international, id HAVING count(*) > 1
UNION ALL SELECT 'wrong number of international sources', CAST(count(*) FILTER (WHERE is_international) AS VARCHAR) FROM cat HAVING count(*) FILTER (WHERE is_international) <> 30
UNION ALL SELECT 'mapping points to unknown source', country_code FROM maps WHERE prim NOT IN (SELECT id FROM cat)
UNION ALL SELECT 'mapping country must be ISO 3166-1 alpha-2', country_code FROM maps WHERE country_code = 'X9'""")
def check_sources(spark, sf_dir):
    return C.check_sources(*catalogue(spark, sf_dir))


@query("source_catalogue", _CATALOGUE + """
SELECT id, is_international, count(*) AS rows_of_id FROM (SELECT id, true AS is_international FROM cat UNION ALL SELECT 'local-' || id, false FROM cat) u GROUP BY ALL""")
def source_catalogue(spark, sf_dir):
    sources, _ = catalogue(spark, sf_dir)
    local = sources.withColumn("id", F.concat(F.lit("local-"), "id"))
    return C.all_sources(sources, local).groupBy("id", "is_international").agg(F.count(F.lit(1)).alias("rows_of_id"))


@query("merge_upsert", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'X' END, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END
  FROM orders WHERE o_orderpriority = '1-URGENT'
UNION ALL SELECT -1 - o_orderkey, 'N', 1 FROM orders WHERE o_orderpriority = '1-URGENT'""")
def merge_upsert(spark, sf_dir):
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    urgent = target.filter(F.col("o_orderpriority") == "1-URGENT")
    updates = urgent.withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.lit(0.0)}).unionByName(
        urgent.withColumns({"o_orderkey": -1 - F.col("o_orderkey"), "o_orderstatus": F.lit("N"), "o_totalprice": F.lit(1.0)}))
    # a third of the keys is updated twice
    again = urgent.filter("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("Y"), "o_totalprice": F.lit(2.0)})
    numbered = updates.withColumn("sent", F.lit(1)).unionByName(again.withColumn("sent", F.lit(2)))
    return C.merge_upsert(target, numbered, ["o_orderkey"], ["sent"]).drop("o_orderpriority")


@query("append_new", """
WITH known AS (SELECT DISTINCT 'poll:' || CAST(user_id AS VARCHAR) || ':' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS key FROM events WHERE event_type = 'click'),
batch AS (SELECT DISTINCT 'poll:' || CAST(user_id AS VARCHAR) || ':' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS key FROM events)
SELECT key, key NOT IN (SELECT key FROM known) AS created FROM batch""")
def append_new(spark, sf_dir):
    """Idempotency keys per user and hour; those of clicks are present already."""
    key = F.concat_ws(":", F.lit("poll"), F.col("user_id").cast("string"),
                      F.floor(O.micros(F.col("ts")) / 3_600_000_000).cast("string"))
    batch = table(spark, sf_dir, "events").select(key.alias("key"), "event_type")
    known = batch.filter(F.col("event_type") == "click").select("key")
    return C.append_new(known, batch.select("key"), "key")


@query("upsert_sink", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, CAST(max(o_orderdate) AS VARCHAR) AS o_orderdate
FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) o GROUP BY o_custkey""")
def upsert_sink(spark, sf_dir):
    """The newest order of every customer, years upserted one after another, each of them sent twice."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"))
    sink = KeyedTable(spark, working_table(spark, "newest"), ["o_custkey"], 8)
    years = [r["y"] for r in orders.select(F.year("o_orderdate").alias("y")).distinct().orderBy("y").collect()]
    for batch, year in enumerate(years):
        for _ in range(2):
            sink.upsert(orders.filter(F.year("o_orderdate") == year), ["o_orderdate", "o_orderkey"], batch)
    return sink.read().withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


@query("append_sink", """
SELECT DISTINCT 'poll:' || CAST(user_id AS VARCHAR) || ':' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS key, min(event_id) AS event_id FROM events GROUP BY 1""")
def append_sink(spark, sf_dir):
    """Idempotency keys per user and hour, appended in four batches in the order of events, each sent twice; the first event counts."""
    key = F.concat_ws(":", F.lit("poll"), F.col("user_id").cast("string"),
                      F.floor(O.micros(F.col("ts")) / 3_600_000_000).cast("string"))
    rows = table(spark, sf_dir, "events").select(key.alias("key"), "event_id")
    top = rows.agg(F.max("event_id")).first()[0] or 0
    sink = KeyedTable(spark, working_table(spark, "keys"), ["key"], 8)
    for batch in range(4):
        part = F.floor(F.col("event_id") * 4 / F.lit(top + 1)) == batch
        for _ in range(2):
            sink.append_new(rows.filter(part), ["event_id"], batch)
    return sink.read()
