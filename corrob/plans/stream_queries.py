"""Registered queries: streams run over the landed tables, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob.operators.cluster import md5_embedder
from corrob.plans import views
from corrob.plans.ingest_queries import DATE, FEED_SQL, _CLASSIFIED, landed_feeds, stamp
from corrob.plans.ops_queries import HEALTH_SQL, OVERDUE_SQL, overdue_report
from corrob.plans.registry import query
from corrob.plans.similarity_queries import CLUSTERED_SQL
from corrob.plans.views import table
from corrob.session import working_table
from corrob.streaming import streams as O


BATCHES = 5


#: Rows of a landed file, and bytes before compression, about: whichever is reached first.
FILE_ROWS = 1_000_000
FILE_BYTES = 16 << 20


def _ranges(rows, order, batches):
    """(number of the range of ``order`` that a row is in, files per range), the ranges being of equal width."""
    place = F.unix_micros(F.col(order).cast("timestamp")) if order in ("ts", "retrieved_at") else F.col(order)
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in rows.schema if f.dataType.typeName() == "string"]
    size = sum(texts, F.lit(8 * len(rows.columns)))
    low, high, n, bytes_ = rows.agg(F.min(place), F.max(place), F.count(F.lit(1)), F.sum(size.cast("bigint"))).first()
    width = ((high or 0) - (low or 0)) / batches + 1
    files = max(1, n // (batches * FILE_ROWS), -(-(bytes_ or 0) // (batches * FILE_BYTES)))
    return F.coalesce(F.floor((place - F.lit(low)) / width), F.lit(0)), files


def _land(rows, files, path):
    # a shuffle even for one file: without it the task that writes it reads the whole table alone
    rows.repartition(files).write.mode("append").parquet(path)


def landed(rows, order, name, batches=BATCHES):
    """Rows as a stream that lands in several parts, one after another along ``order``, about one per micro-batch.

    State, stores and watermarks thus have to carry over from batch to batch.
    """
    spark, path = rows.sparkSession, working_table(rows.sparkSession, f"landed-{name}")
    number, files = _ranges(rows, order, batches)
    for batch in range(batches):
        _land(rows.filter(number == batch), files, path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def land_and_run(rows, order, name, run, batches=BATCHES):
    """Land one part after another and run the stream to its end after each: a restart per part."""
    spark, path = rows.sparkSession, working_table(rows.sparkSession, f"landed-{name}")
    number, files = _ranges(rows, order, batches)
    for batch in range(batches):
        _land(rows.filter(number == batch), files, path)
        run(spark.readStream.schema(rows.schema).parquet(path)).awaitTermination()


@query("stream_feed_entries", FEED_SQL)
def stream_feed_entries(spark, sf_dir):
    """The landed feeds as a stream of several micro-batches."""
    out = working_table(spark, "feed-stream")
    O.stream_feeds(spark, landed_feeds(spark, sf_dir), f"{out}/rows", f"{out}/progress", files_per_batch=5).awaitTermination()
    return spark.read.parquet(f"{out}/rows/entries").select(
        "title", "description", "canonical_url", stamp("published_at").alias("published_at"), "language")


def polls(events):
    ok = F.col("event_type") != "error"
    return events.select(F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("checked_at"), ok.alias("ok"),
                         (F.col("value") * 50).alias("latency_ms"), F.col("event_id").alias("poll_id"),
                         F.when(~ok, F.concat(F.lit("timeout "), F.col("props"))).alias("error"))


@query("stream_ingest", _CLASSIFIED + """
SELECT entry_id, CASE WHEN starts_with(outcome, 'duplicate') THEN 'duplicate' ELSE outcome END AS outcome
FROM classified WHERE entry_id < 1000000000""")
def stream_ingest(spark, sf_dir):
    """The pages of the ingest batch as a stream; pages and events share no address or text."""
    from corrob.sources.feeds import read_page_entries

    pages = read_page_entries(landed(table(spark, sf_dir, "pages"), "page_id", "pages")).select(
        F.col("page_id").alias("entry_id"), F.col("page_id").alias("ord"), "title", "description", "link",
        F.lit(None).cast("timestamp_ntz").alias("published_at"))
    path = working_table(spark, "ingest")
    O.stream_ingest(pages, path, working_table(spark, "ingest-progress"), views.as_of_events()).awaitTermination()
    # which kind of duplicate depends on the micro-batches: inside one, or of an earlier one
    outcome = F.when(F.col("outcome").startswith("duplicate"), "duplicate").otherwise(F.col("outcome"))
    return spark.read.parquet(path).select("entry_id", outcome.alias("outcome"))


def streamed_health(spark, sf_dir):
    path = working_table(spark, "health")
    landed_polls = polls(landed(table(spark, sf_dir, "events"), "ts", "events"))
    O.stream_health(landed_polls, path, working_table(spark, "health-progress")).awaitTermination()
    return O.health_now(spark, path)


@query("stream_health", HEALTH_SQL + f"""
SELECT source_id, status, success_count, failure_count, consecutive_failures, round(avg_latency_ms, 4) AS avg_latency_ms, last_error,
  strftime(last_success_at, '{DATE}') AS last_success_at, strftime(last_failure_at, '{DATE}') AS last_failure_at,
  strftime(last_checked_at, '{DATE}') AS last_checked_at FROM health""")
def stream_health(spark, sf_dir):
    times = ("last_success_at", "last_failure_at", "last_checked_at")
    return streamed_health(spark, sf_dir).select(
        "source_id", "status", "success_count", "failure_count", "consecutive_failures",
        F.round("avg_latency_ms", 4).alias("avg_latency_ms"), "last_error", *[stamp(c).alias(c) for c in times])


@query("stream_overdue_sources", OVERDUE_SQL)
def stream_overdue_sources(spark, sf_dir):
    """Sources whose next poll is due, from the health that the stream keeps."""
    clock = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return overdue_report(views.sources(spark, sf_dir), streamed_health(spark, sf_dir), clock)


_LATE = f"""
WITH w AS (SELECT min(user_id) AS low, (max(user_id) - min(user_id)) / {BATCHES}.0 + 1 AS width FROM events),
b AS (SELECT event_id, ts, CAST(floor((user_id - low) / width) AS INT) AS batch, ts > TIMESTAMP '2024-01-28 01:00:00' AS ahead FROM events, w),
m AS (SELECT batch, max(ts) FILTER (WHERE NOT ahead) AS newest FROM b GROUP BY batch),
c AS (SELECT a.batch, max(z.newest) AS clock FROM m a LEFT JOIN m z ON z.batch < a.batch GROUP BY a.batch)
SELECT event_id, CASE WHEN ahead THEN 'future' WHEN clock - ts > INTERVAL 72 HOUR THEN 'late' ELSE 'on_time' END AS verdict
FROM b JOIN c USING (batch)"""


@query("stream_late_reports", _LATE)
def stream_late_reports(spark, sf_dir):
    """Events landed by user, so that later batches bring old ones: late and future rows go to side tables."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("published_at"))
    out, progress = working_table(spark, "in-time"), working_table(spark, "in-time-progress")
    as_of = F.lit("2024-01-28 00:00:00").cast("timestamp")
    land_and_run(rows, "user_id", "users", lambda stream: O.stream_in_time(stream, out, progress, as_of))
    return spark.read.parquet(f"{out}/rows").select("event_id", "verdict")


_HOURLY = f"SELECT strftime(date_trunc('hour', ts), '{DATE}') AS start, count(*) AS reports FROM events GROUP BY ALL"


def arrivals(events):
    return events.select(F.col("event_id"), F.col("ts").cast("timestamp").alias("retrieved_at"))


@query("throughput_windows", _HOURLY)
def throughput_windows(spark, sf_dir):
    return O.throughput(arrivals(table(spark, sf_dir, "events"))).withColumn("start", stamp("start"))


@query("stream_throughput", _HOURLY)
def stream_throughput(spark, sf_dir):
    updates = O.run_to_table(O.throughput(arrivals(landed(table(spark, sf_dir, "events"), "ts", "events"))), "update", "throughput")
    return O.latest_per_key(updates, ["start"]).withColumn("start", stamp("start"))


@query("throughput_daily", f"""
WITH h AS (SELECT date_trunc('hour', ts) AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT strftime(h + to_hours(CAST(k AS INT)), '{DATE}') AS "end", CAST(sum(n) AS BIGINT) AS reports FROM h, (SELECT unnest(generate_series(1, 24)) AS k) s GROUP BY ALL""")
def throughput_daily(spark, sf_dir):
    return O.throughput_daily(arrivals(table(spark, sf_dir, "events"))).withColumn("end", stamp("end"))


_COLLAPSED = f"""SELECT DISTINCT user_id AS source_id, strftime(make_timestamp((epoch_us(ts) // 300000000) * 300000000), '{DATE}') AS bucket FROM events"""


@query("poll_collapse", _COLLAPSED)
def poll_collapse(spark, sf_dir):
    return O.collapse_polls(polls(table(spark, sf_dir, "events"))).withColumn("bucket", stamp("bucket"))


@query("stream_poll_collapse", _COLLAPSED)
def stream_poll_collapse(spark, sf_dir):
    out = O.run_to_table(O.collapse_polls(polls(landed(table(spark, sf_dir, "events"), "ts", "events"))), "append", "collapse")
    return out.select("source_id", stamp("bucket").alias("bucket"))


@query("late_and_future", """
SELECT event_id, CASE WHEN ts > TIMESTAMP '2024-01-28 01:00:00' THEN 'future' WHEN abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) > 259200000000
  THEN 'new_event' ELSE 'on_time' END AS verdict FROM events""")
def late_and_future(spark, sf_dir):
    reports = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("published_at"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return O.late_or_future(reports, at("2024-01-28 00:00:00"), at("2024-01-15 00:00:00")).select("event_id", "verdict")


_SPELLS = f"""
WITH e AS (SELECT user_id AS event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_id ORDER BY ts) AS spell FROM e),
spells AS (SELECT event_id, strftime(min(ts), '{DATE}') AS first, strftime(max(ts), '{DATE}') AS last, count(*) AS updates,
  strftime(max(ts) + INTERVAL 12 HOUR, '{DATE}') AS archived_at, max(ts) + INTERVAL 12 HOUR AS ends FROM s GROUP BY event_id, spell)"""


@query("quiet_spells", _SPELLS + "SELECT * EXCLUDE (ends) FROM spells")
def quiet_spells(spark, sf_dir):
    """Spells of activity per user that 12 hours of silence end."""
    updates = table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id"), F.col("ts").cast("timestamp").alias("updated_at"))
    return O.archive_quiet(updates, 12).select(
        "event_id", stamp("first").alias("first"), stamp("last").alias("last"), "updates", stamp("archived_at").alias("archived_at"))


@query("stream_quiet_spells", _SPELLS + """
SELECT * EXCLUDE (ends) FROM spells WHERE ends <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_quiet_spells(spark, sf_dir):
    """The same as a stream: spells come out once the watermark, an hour behind, has passed their end."""
    updates = landed(table(spark, sf_dir, "events"), "ts", "events").select(
        F.col("user_id").alias("event_id"), F.col("ts").cast("timestamp").alias("updated_at"))
    return O.run_to_table(O.archive_quiet(updates, 12), "append", "quiet").select(
        "event_id", stamp("first").alias("first"), stamp("last").alias("last"), "updates", stamp("archived_at").alias("archived_at"))


@query("stream_clusters", CLUSTERED_SQL + "SELECT event_id, report_id FROM edges")
def stream_clusters(spark, sf_dir):
    """Reports clustered as a stream of micro-batches, to the events of the one-at-a-time pass."""
    reports = landed(views.reports(spark, sf_dir), "retrieved_at", "reports", 3)
    out = working_table(spark, "clusters")
    O.stream_cluster(reports, out, working_table(spark, "clusters-progress"), embedder=md5_embedder).awaitTermination()
    return spark.read.parquet(f"{out}/edges").select("event_id", "report_id")
