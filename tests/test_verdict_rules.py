"""Refused requests, repeated updates, settled conflicts, slugs, dates and addresses."""

import datetime as dt
import ipaddress

import pytest
from pyspark.sql import functions as F

from corrob.operators.editorial import unique_slugs
from corrob.operators.serve import address_bits, event_review, list_jobs, rejected_queue
from corrob.operators.similarity import heavy_keys, salted_lookup
from corrob.operators.verify import merge_conflicts
from corrob.sources.catalogue import merge_upsert
from corrob.sources.feeds import parse_entry_ts


def test_oversized_listings_are_refused(spark):
    empty = spark.createDataFrame([], "event_id int, job_id int, status string, created_at date, importance_score double, last_updated_at date")
    for listing in (lambda: list_jobs(empty, n=501), lambda: rejected_queue(empty, 201), lambda: event_review(empty, empty, empty, n=0)):
        with pytest.raises(ValueError):
            listing()


def test_last_update_of_a_key_wins(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    updates = spark.createDataFrame([(2, "x", 1), (2, "z", 3), (2, "y", 2), (3, "n", 1)], "k int, v string, sent int")
    assert sorted(map(tuple, merge_upsert(target, updates, ["k"], ["sent"]).collect())) == [(1, "a"), (2, "z"), (3, "n")]
    plain = spark.createDataFrame([(2, "x"), (2, "y")], "k int, v string").coalesce(1)
    assert sorted(map(tuple, merge_upsert(target, plain, ["k"]).collect())) == [(1, "a"), (2, "y")]


def test_settled_conflict_keeps_its_resolution(spark):
    old = spark.createDataFrame([("e", "c", "deaths", "by hand", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1))],
                                "event_id string, claim string, measure string, resolution string, detected_at timestamp, resolved_at timestamp")
    new = spark.createDataFrame([("e", "c", "deaths")], "event_id string, claim string, measure string")
    row = merge_conflicts(old, new, F.lit("2025-01-02 00:00:00").cast("timestamp")).first()
    assert (row["status"], row["resolution"], row["resolved_at"]) == ("resolved", "by hand", dt.datetime(2025, 1, 1))


def test_long_spelled_suffixes_are_skipped(spark):
    rows = [(1, "storm"), (2, "storm"), (3, "storm 2"), (4, "storm 12345678901")]
    slugs = unique_slugs(spark.createDataFrame(rows, "article_id bigint, headline string"), F.lit(0)).select("slug").collect()
    assert len({r[0] for r in slugs}) == len(rows)


@pytest.mark.parametrize("text, parsed", [
    ("Mon, 06 Oct 2025 08:00:00 EST", "2025-10-06 13:00:00"), ("Mon, 06 Oct 2025 08:00:00 PDT", "2025-10-06 15:00:00"),
    ("October 6, 2025", "2025-10-06 00:00:00"), ("Mon, 06 Oct 25 08:00:00 GMT", "2025-10-06 08:00:00"),
    ("2025/10/06 08:00", "2025-10-06 08:00:00"), ("6 October 2025 08:00", "2025-10-06 08:00:00"),
    ("Oct 6, 2025 8:05 PM", "2025-10-06 20:05:00"), ("2025-10-06T08:00:00.250+02:00", "2025-10-06 06:00:00.250"),
    ("2025-10-06T08:00:00Z", "2025-10-06 08:00:00"), ("06 Oct 2025 08:00 +0530", "2025-10-06 02:30:00"), ("2025-10-06", "2025-10-06 00:00:00"),
    ("12:30", None), ("junk", None), ("31 Foo 2025", None), ("45 Oct 2025", None), ("", None)])
def test_dates_as_feeds_write_them(spark, text, parsed):
    row = spark.range(1).select(parse_entry_ts(F.lit(text)).cast("timestamp_ntz").alias("t")).first()
    assert row["t"] == (None if parsed is None else dt.datetime.fromisoformat(parsed))


@pytest.mark.parametrize("ip", ["1.2.3.4", "255.255.255.255", "::", "::1", "2001:db8::ff00:42:8329", "fe80:0:0:0:1:2:3:4", "::ffff:1.2.3.4",
                                "1:2:3:4:5:6:7::", "2001:DB8::1", "1:2:3:4:5:6:7:8:9", ":::", "1::2::3", "12345::", "1.2.3", "g::1", ":1", "1:", ""])
def test_addresses(spark, ip):
    try:
        address = ipaddress.ip_address(ip)
        want = f"{int(address):0{address.max_prefixlen}b}"
    except ValueError:
        want = None
    assert spark.range(1).select(address_bits(F.lit(ip)).alias("b")).first()["b"] == want


def test_heavy_keys_are_split_in_proportion(spark):
    """A third of the rows on one key, a null key, light keys: the join is whole and no piece of it is large."""
    rows = spark.range(30_000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id") % 4000).alias("k"))
    dim = spark.range(-1, 3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    pieces = {r["_h"]: r["_pieces"] for r in heavy_keys(rows, ["k"]).collect()}
    hot = rows.filter("k = -1").select(F.xxhash64("k").alias("h")).first()["h"]
    share = 30_000 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert pieces[hot] >= 10_000 / share and len(pieces) <= 2
    largest = rows.filter("k = -1").groupBy(F.pmod(F.xxhash64("id"), F.lit(pieces[hot]))).count().agg(F.max("count")).first()[0]
    assert largest <= 1.2 * share
    for how in ("left", "inner"):
        got = sorted(map(str, salted_lookup(rows, dim, ["k"], ["id"], how=how).select("id", "k", "v").collect()))
        assert got == sorted(map(str, rows.join(dim, "k", how).select("id", "k", "v").collect()))
    assert heavy_keys(spark.range(0).withColumnRenamed("id", "k"), ["k"]) is None
