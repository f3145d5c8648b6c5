"""Keyed tables, and streams that keep state in them: batches sent again, batches that die, hot keys, late rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corrob.operators.ops import continue_health, source_health
from corrob.sources.keyed import KeyedTable
from corrob.streaming import streams

ROW = "k int, name string, sent int"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_equals_a_dictionary(spark, tmp_path):
    rng, want = random.Random(3), {}
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    assert table.read() is None
    for batch in range(4):
        rows = [(rng.choice([None, *range(12)]), f"{batch}-{i}", i) for i in range(15)]
        for row in rows:
            want[row[0]] = row
        for _ in range(2):  # sent twice
            table.upsert(spark.createDataFrame(rows, ROW), ["sent"], batch)
    table.upsert(spark.createDataFrame([(1, "stale", 99)], ROW), ["sent"], 2)  # an old batch arrives again
    table.upsert(spark.createDataFrame([], ROW), ["sent"], 4)
    assert rows_of(table.read()) == sorted(want.values(), key=str)
    table.vacuum()
    assert rows_of(KeyedTable(spark, str(tmp_path / "t"), ["k"]).read()) == sorted(want.values(), key=str)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)
    table.upsert(spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("name"), F.lit(0).alias("sent")), ["sent"], 0)
    before = table.files_of()
    table.upsert(spark.createDataFrame([(7, "b", 1)], ROW), ["sent"], 1)
    after = table.files_of()
    assert sum(before[b] != after[b] for b in before) == 1 and table.read().count() == 100
    probe = table.read_for(spark.createDataFrame([(7,)], "k bigint"))  # another integer type finds the same bucket
    assert probe.filter("name = 'b'").count() == 1 and probe.count() < 50


def test_a_batch_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(spark.createDataFrame([(1, "a", 0), (2, "b", 0)], ROW), ["sent"], 0)

    def die(manifest):
        raise RuntimeError("lost")

    update = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], ROW)
    with monkeypatch.context() as m:
        m.setattr(table, "_commit", die)
        with pytest.raises(RuntimeError):
            table.upsert(update, ["sent"], 1)
        with pytest.raises(RuntimeError):
            table.append_new(update, ["sent"], 1)
    assert rows_of(table.read()) == [(1, "a", 0), (2, "b", 0)] and not table.applied(1)
    table.vacuum()
    table.upsert(update, ["sent"], 1)
    assert rows_of(table.read()) == [(1, "a", 0), (2, "c", 1), (3, "d", 1)] and table.applied(1)


def test_a_second_writer_of_a_version_is_refused(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    table.upsert(spark.createDataFrame([(1, "a", 0)], ROW), ["sent"], 0)
    stale = table._manifest()
    table.upsert(spark.createDataFrame([(1, "b", 0)], ROW), ["sent"], 1)
    with pytest.raises(Exception, match="exist"):
        table._commit(stale)
    assert rows_of(table.read()) == [(1, "b", 0)]


def test_append_answers_the_same_when_sent_again(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 4)
    first = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "n", 1)], ROW)
    second = spark.createDataFrame([(1, "z", 0), (None, "m", 0), (5, "e", 0)], ROW)
    for _ in range(2):
        assert rows_of(table.append_new(first, ["sent"], 0, "feed")) == [(1, True), (None, True)]
    for _ in range(2):
        assert rows_of(table.append_new(second, ["sent"], 1, "feed")) == [(1, False), (5, True), (None, False)]
    assert rows_of(table.append_new(second, ["sent"], 0, "other")) == [(1, False), (5, False), (None, False)]
    assert rows_of(table.read()) == [(1, "a", 1), (5, "e", 0), (None, "n", 1)]
    table.compact(most=1)
    assert all(len(folders) == 1 for folders in table.files_of().values())
    assert rows_of(table.read()) == [(1, "a", 1), (5, "e", 0), (None, "n", 1)]


POLL = "source_id bigint, checked_at timestamp, ok boolean, latency_ms double, poll_id bigint, error string"
T0 = dt.datetime(2025, 1, 1)


def some_polls(seed, n, hot):
    rng = random.Random(seed)
    return [(hot if i % 3 == 0 else rng.randrange(12), T0 + dt.timedelta(seconds=i // 2 * 7), rng.random() < 0.4,
             rng.choice([None, 50.0, 20_000.0 * rng.random()]), i, None if rng.random() < 0.3 else f"e{i}" * 900) for i in range(n)]


def fold(polls):
    """Poll by poll, as a health record is kept."""
    out = {}
    for source, at, ok, latency, _, error in polls:
        h = out.setdefault(source, dict(ok=0, bad=0, streak=0, avg=None, good=None, failed=None, at=None, error=None))
        h["ok"], h["bad"], h["streak"] = h["ok"] + ok, h["bad"] + (not ok), 0 if ok else h["streak"] + 1
        h["at"], h["error"] = at, None if ok or error is None else error[:2000]
        h["good" if ok else "failed"] = at
        if latency is not None:
            h["avg"] = latency if h["avg"] is None else 0.3 * latency + 0.7 * h["avg"]
        slow = h["avg"] is not None and h["avg"] > 10_000
        h["status"] = ("degraded" if slow else "healthy") if ok else ("down" if h["streak"] >= 6 else "degraded")
    return out


def health_dict(df):
    return {r["source_id"]: dict(ok=r["success_count"], bad=r["failure_count"], streak=r["consecutive_failures"],
                                 avg=None if r["avg_latency_ms"] is None else pytest.approx(r["avg_latency_ms"]),
                                 good=r["last_success_at"], failed=r["last_failure_at"], at=r["last_checked_at"],
                                 error=r["last_error"], status=r["status"]) for r in df.collect()}


def test_health_stream_equals_the_fold(spark, tmp_path):
    """Five batches, a third of the polls on one source, a source without latencies, one that leaves after the first batch."""
    polls = some_polls(1, 400, 99)
    polls[:0] = [(50, T0 - dt.timedelta(hours=1), False, None, -2, "gone"), (51, T0 - dt.timedelta(hours=1), True, 7.0, -1, None)]
    landed, state, progress = (str(tmp_path / n) for n in ("in", "state", "progress"))
    for part in range(5):
        spark.createDataFrame(polls[part * 81:(part + 1) * 81], POLL).coalesce(1).write.mode("append").parquet(landed)
        streams.stream_health(spark.readStream.schema(POLL).parquet(landed), state, progress).awaitTermination()
    got = health_dict(streams.health_now(spark, state))
    assert got == fold(polls) and got[50]["avg"] is None
    assert len([n for n in (tmp_path / "state").iterdir() if n.name.startswith("batch=")]) == 2  # older snapshots are gone


def test_health_of_any_cut_and_of_nothing(spark):
    polls = some_polls(2, 60, 3)
    frame = spark.createDataFrame(polls, POLL)
    empty = source_health(frame.filter("false"))
    for cut in (0, 1, 31, 60):
        first, rest = (frame.filter(F.col("poll_id") < cut), frame.filter(F.col("poll_id") >= cut))
        assert health_dict(continue_health(source_health(first), rest)) == fold(polls)
    assert continue_health(empty, frame.filter("false")).count() == 0


def test_late_and_future_rows_go_to_side_tables(spark, tmp_path):
    schema = "report_id bigint, published_at timestamp"
    day = lambda n: T0 + dt.timedelta(days=n)
    batches = [[(1, day(10)), (2, day(0)), (3, day(40))],  # the batch's own clock makes nothing late
               [(4, day(6)), (5, day(7)), (6, None), (7, day(12))],
               [(8, day(8)), (9, day(9)), (10, day(20.05))]]
    landed, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    as_of = F.lit(day(20)).cast("timestamp")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        streams.stream_in_time(spark.readStream.schema(schema).parquet(landed), out, progress, as_of).awaitTermination()
    got = {r["report_id"]: r["verdict"] for r in spark.read.parquet(f"{out}/rows").collect()}
    assert got == {1: "on_time", 2: "on_time", 3: "future", 4: "late", 5: "on_time", 6: "on_time", 7: "on_time",
                   8: "late", 9: "on_time", 10: "future"}


def test_ingest_batch_that_runs_again_gives_the_same(spark, tmp_path):
    """The commit of the hashes is lost after the outcomes were written: the batch runs again and knows nothing of itself."""
    schema = "entry_id bigint, ord bigint, title string, description string, link string"
    parts = [[(1, 1, "A", "x", "https://e.com/1"), (2, 2, "B", "y", "https://e.com/2")],
             [(3, 3, "C", "z", "https://e.com/1"), (4, 4, "b", "Y", "https://e.com/4"), (5, 5, "E", "v", "https://e.com/5")]]
    landed, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    as_of = F.lit(T0).cast("timestamp")
    run = lambda: streams.stream_ingest(spark.readStream.schema(schema).parquet(landed), store, progress, as_of, buckets=4)
    spark.createDataFrame(parts[0], schema).coalesce(1).write.mode("append").parquet(landed)
    run().awaitTermination()
    spark.createDataFrame(parts[1], schema).coalesce(1).write.mode("append").parquet(landed)
    commit = KeyedTable._commit
    try:
        KeyedTable._commit = lambda self, manifest: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(Exception, match="lost"):
            run().awaitTermination()
    finally:
        KeyedTable._commit = commit
    run().awaitTermination()
    got = {r["entry_id"]: r["outcome"] for r in spark.read.parquet(store).collect()}
    assert got == {1: "stored", 2: "stored", 3: "duplicate_url", 4: "duplicate_content", 5: "stored"}
    assert KeyedTable(spark, f"{store}/_keys", ["kind", "hash"]).read().count() == 6
