"""Structured Streaming forms of the pipeline.

Sinks write every micro-batch to a folder of its own (``batch=<id>``,
overwritten on replay), which makes at-least-once delivery exactly-once in
the stored result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrob import fixed_values as V
from corrob.functions.scores import hours_between
from corrob.operators.cluster import cluster_batch, default_embedder
from corrob.operators.ingest import classify_hashed, hash_entries
from corrob.operators.ops import continue_health, source_health
from corrob.session import working_table
from corrob.sources.feeds import read_feed_entries, read_feed_rejects
from corrob.sources.keyed import KeyedTable


def _earlier_batches(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """What batches before this one stored; None before the first."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return None
    return spark.read.parquet(path).filter(F.col("batch") < batch_id)


class Snapshots:
    """One small table per batch, ``batch=N``, made from the newest of an earlier batch.

    A batch that runs again reads the same earlier table and overwrites its
    own; older tables than those two are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self) -> list[int]:
        if not self._fs.exists(self._place(self._path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._place(self._path))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))

    def before(self, batch_id: int) -> DataFrame | None:
        earlier = [b for b in self._batches() if b < batch_id]
        return self._spark.read.parquet(f"{self._path}/batch={earlier[-1]}") if earlier else None

    def newest(self) -> DataFrame | None:
        batches = self._batches()
        return self.before(batches[-1] + 1) if batches else None

    def put(self, rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self._path}/batch={batch_id}")
        for old in [b for b in self._batches() if b < batch_id][:-1]:
            self._fs.delete(self._place(f"{self._path}/batch={old}"), True)


def _start(stream: DataFrame, handle, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- ingest ------------------------------------------------------------------

_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def stream_feeds(spark: SparkSession, folder: str, out_path: str, checkpoint: str, files_per_batch: int = 1000,
                 available_now: bool = True) -> StreamingQuery:
    """Feed files as they land: usable entries to ``entries``, broken ones to ``rejects`` under ``out_path``.

    The stream carries file names; a batch reads its own files the way the
    batch reader does, so both give the same rows.  What the driver holds is
    ``files_per_batch`` names.  A file that grows after it was read is not
    read again.
    """
    names = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_batch).load(folder).select("path")

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        files = [re.sub(r"([\\*?\[\]{}])", r"\\\1", r["path"]) for r in batch.collect()]  # names, not patterns
        if files:
            for rows, kind in ((read_feed_entries(session, files), "entries"), (read_feed_rejects(session, files), "rejects")):
                rows.write.mode("overwrite").parquet(f"{out_path}/{kind}/batch={batch_id}")

    return _start(names, handle, checkpoint, available_now=available_now)


def stream_ingest(entries: DataFrame, store_path: str, checkpoint: str, as_of: Column,
                  in_flight: str | None = None, available_now: bool = True, buckets: int = 64) -> StreamingQuery:
    """Deduplicating ingest: every batch is classified against all earlier ones.

    The hashes of what is stored lie in a keyed table, ``<store_path>/_keys``;
    a batch reads the hash buckets that its own hashes fall into, never the
    stored entries.  Outcomes are written before the hashes are committed,
    so a batch that runs again finds the hashes of earlier batches only.

    ``in_flight`` (a watermark delay on ``published_at``) drops repeats of an
    address inside the stream already, in bounded state; the store decides
    about everything older.
    """
    if in_flight:
        entries = entries.withWatermark("published_at", in_flight).dropDuplicatesWithinWatermark(["link"])

    def hashes(rows: DataFrame) -> DataFrame:
        both = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("hash")) for kind in ("url_hash", "content_hash")])
        return rows.select(F.explode(both).alias("h")).select("h.*")

    def handle(batch: DataFrame, batch_id: int) -> None:
        keys = KeyedTable(batch.sparkSession, f"{store_path}/_keys", ["kind", "hash"], buckets)
        if keys.applied(batch_id):
            return
        checked = hash_entries(batch, as_of).persist()
        kept = keys.read_for(hashes(checked.filter(F.col("reject_reason").isNull())))
        known = {kind: None if kept is None else kept.filter(F.col("kind") == kind).select(F.col("hash").alias(kind))
                 for kind in ("url_hash", "content_hash")}
        path = f"{store_path}/batch={batch_id}"
        classify_hashed(checked, known["url_hash"], known["content_hash"]).write.mode("overwrite").parquet(path)
        checked.unpersist()
        keys.append_new(hashes(batch.sparkSession.read.parquet(path).filter(F.col("outcome") == "stored")), [], batch_id)
        keys.compact()

    return _start(entries, handle, checkpoint, available_now=available_now)


def stream_in_time(reports: DataFrame, out_path: str, checkpoint: str, as_of: Column,
                   delay_hours: float = V.EVENT_WINDOW_HOURS, available_now: bool = True) -> StreamingQuery:
    """Split a stream by time: ``verdict`` future, late or on_time; nothing is dropped.

    Future is more than an hour past ``as_of``.  Late is more than
    ``delay_hours`` before the newest time, future ones apart, that earlier
    batches brought; the batch itself does not move its own clock.  A report
    without a time is on time.  Results: ``<out_path>/rows/verdict=V/batch=N``,
    so late rows form a side table; the clock is one row per batch.
    """
    future = hours_between(F.col("published_at"), as_of) > V.MAX_FUTURE_SKEW_SECONDS / 3600

    def handle(batch: DataFrame, batch_id: int) -> None:
        clocks = Snapshots(batch.sparkSession, f"{out_path}/clock")
        last = clocks.before(batch_id)
        newest = last.first()["newest"] if last is not None else None
        limit = F.lit(newest).cast(batch.schema["published_at"].dataType)
        late = hours_between(limit, F.col("published_at")) > delay_hours
        judged = batch.withColumn("verdict", F.when(future, "future").when(late, "late").otherwise("on_time")).persist()
        for verdict in ("on_time", "late", "future"):
            judged.filter(F.col("verdict") == verdict).drop("verdict").write.mode("overwrite").parquet(
                f"{out_path}/rows/verdict={verdict}/batch={batch_id}")
        seen = judged.agg(F.max(F.when(F.col("verdict") != "future", F.col("published_at"))).alias("newest"))
        clocks.put(seen.select(F.greatest("newest", limit).alias("newest")), batch_id)
        judged.unpersist()

    return _start(reports, handle, checkpoint, available_now=available_now)


def late_or_future(reports: DataFrame, as_of: Column, last_activity: Column) -> DataFrame:
    """Add ``verdict``: future, new_event (outside the window of the event's activity) or on_time."""
    ahead = hours_between(F.col("published_at"), as_of) > V.MAX_FUTURE_SKEW_SECONDS / 3600
    apart = F.abs(hours_between(F.col("published_at"), last_activity)) > V.EVENT_WINDOW_HOURS
    return reports.withColumn("verdict", F.when(ahead, "future").when(apart, "new_event").otherwise("on_time"))


# --- clustering --------------------------------------------------------------


def stream_cluster(reports: DataFrame, state_path: str, checkpoint: str, available_now: bool = True,
                   embedder=default_embedder) -> StreamingQuery:
    """Cluster every micro-batch against the events found so far; the trigger does not change the result.

    Results: ``<state_path>/events/batch=N``, the events that batch N touched
    (the newest version of an event counts), and ``<state_path>/edges/batch=N``.
    A batch reads the versions within reach of its own times only.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = _earlier_batches(batch.sparkSession, f"{state_path}/events", batch_id)
        versions = None if known is None else known.withColumnRenamed("batch", "version")
        touched, edges = cluster_batch(batch, versions, embedder)
        touched.write.mode("overwrite").parquet(f"{state_path}/events/batch={batch_id}")
        edges.write.mode("overwrite").parquet(f"{state_path}/edges/batch={batch_id}")

    return _start(reports, handle, checkpoint, available_now=available_now)


# --- stateful source health --------------------------------------------------


def stream_health(polls: DataFrame, state_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Health of each source after every batch of polls, with all columns of ``source_health``.

    State is one row a source: the batch is summed up by source, joined to the
    health before it and written as the next snapshot (``health_now`` reads the
    newest).  Polls count in the order of their batches, inside a batch by
    (checked_at, poll_id).  A keyed state operator would bring all polls of a
    source to one task and order them there; sums by source do not.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        snapshots = Snapshots(batch.sparkSession, state_path)
        health = snapshots.before(batch_id)
        batch = batch.persist()
        snapshots.put(source_health(batch) if health is None else continue_health(health, batch), batch_id)
        batch.unpersist()

    return _start(polls, handle, checkpoint, available_now=available_now)


def health_now(spark: SparkSession, state_path: str) -> DataFrame | None:
    """The newest snapshot of ``stream_health``; None before the first batch."""
    return Snapshots(spark, state_path).newest()


# --- windows -----------------------------------------------------------------


def throughput(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Reports per hour."""
    return reports.withWatermark("retrieved_at", delay).groupBy(F.window("retrieved_at", "1 hour").alias("w")).agg(
        F.count(F.lit(1)).alias("reports")).select(F.col("w.start").alias("start"), "reports")


def throughput_daily(reports: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Reports in the 24 hours up to each full hour."""
    sliding = F.window("retrieved_at", "24 hours", "1 hour").alias("w")
    return reports.withWatermark("retrieved_at", delay).groupBy(sliding).agg(
        F.count(F.lit(1)).alias("reports")).select(F.col("w.end").alias("end"), "reports")


def collapse_polls(polls: DataFrame, seconds: int = 300, delay: str = "1 hour") -> DataFrame:
    """One row per source and polling interval."""
    windowed = polls.withWatermark("checked_at", delay).withColumn("w", F.window("checked_at", f"{seconds} seconds"))
    return windowed.select("source_id", F.col("w.start").alias("bucket")).dropDuplicates(["source_id", "bucket"])


def archive_quiet(updates: DataFrame, hours: int = V.STALE_EVENT_HOURS, delay: str = "1 hour") -> DataFrame:
    """(event_id, first, last, updates, archived_at): spells of activity that ended in ``hours`` of silence.

    In a stream a spell comes out once the watermark has passed its end.
    """
    spell = F.session_window("updated_at", f"{hours} hours").alias("s")
    return updates.withWatermark("updated_at", delay).groupBy("event_id", spell).agg(
        F.min("updated_at").alias("first"), F.max("updated_at").alias("last"), F.count(F.lit(1)).alias("updates")).select(
        "event_id", "first", "last", "updates", F.col("s.end").alias("archived_at"))


# --- driving a stream to its end ---------------------------------------------


def run_to_table(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run a stream over what has landed and return all it put out, with its ``batch``."""
    spark = stream.sparkSession
    path, checkpoint = working_table(spark, name), working_table(spark, f"{name}-progress")

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _start(stream, handle, checkpoint, mode).awaitTermination()
    return spark.read.parquet(path)


def latest_per_key(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of every key in the output of an update-mode stream."""
    rest = [c for c in updates.columns if c not in keys and c != "batch"]
    last = updates.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("u"))
    return last.select(*keys, *[f"u.{c}" for c in rest])
