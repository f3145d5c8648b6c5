"""Costly steps are done once per distinct text or row, and comparisons do not hang on rounding."""

import math

from pyspark.sql import functions as F

from corrob.functions.facts import explode_facts
from corrob.operators.ingest import classify_entries
from corrob.operators.similarity import similar_pairs
from corrob.plans.verify_queries import members
from corrob.sources.feeds import parse_entry_ts


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cosine_of_just_the_threshold_is_a_pair(spark):
    w = 1 / math.sqrt(5)
    assert w * w + w * w < 0.4  # 2 of 5 words in common, less the rounding
    rows = [(k, [(b, w) for b in buckets]) for k, buckets in enumerate([(1, 2, 3, 4, 5), (4, 5, 6, 7, 8), (8, 9, 10, 11, 12)])]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<struct<bucket:int,w:double>>")
    assert [(r["id_a"], r["id_b"]) for r in similar_pairs(vectors, 0.4).collect()] == [(0, 1)]


def test_a_date_is_matched_once_per_spelling(spark):
    dates = spark.createDataFrame([(" Mon, 01 Jan 2024 10:30:05.25 PM EST\n", "2024-01-02T03:30:05.250000"), ("2024-02-30", None),
                                   ("Jan 5th, 2024", "2024-01-05T00:00:00.000000"), ("2024-01-01 10:00\u0001\u0001\u0001", None)], "t string, want string")
    read = dates.select("want", F.date_format(parse_entry_ts(F.col("t")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("got"))
    assert plan_of(read).lower().count("regexp") <= 10
    assert all(r["got"] == r["want"] for r in read.collect())


def test_facts_are_extracted_once_per_text(spark):
    rows = [(k, "Quake strikes Japan killing 12", "On 5 January 2024.") for k in range(50)]
    rows += [(50, None, "Japan"), (51, "", "Japan"), (52, "a\u0001Kenya", ""), (53, "a", "Kenya\u0001")]
    reports = spark.createDataFrame(rows, "report_id bigint, title string, description string")
    found = explode_facts(reports)
    assert "_text_id" in plan_of(found) and "Aggregate" in plan_of(found)
    per = {r["report_id"]: r["n"] for r in found.groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len({per[k] for k in range(50)}) == 1 and per[0] >= 3
    assert 50 not in per and 51 in per and 52 in per and 53 in per


def test_entries_are_hashed_once(spark):
    entries = spark.createDataFrame([(0, 0, "A", "x", "https://e.com/1"), (1, 1, "B", "y", "https://e.com/1")],
                                    "entry_id bigint, ord bigint, title string, description string, link string")
    got = classify_entries(entries, None, F.lit("2024-01-01").cast("timestamp"))
    assert "sha2" not in plan_of(got)
    assert {r["entry_id"]: r["outcome"] for r in got.collect()} == {0: "stored", 1: "duplicate_batch"}


def test_members_are_joined_once(spark):
    assert "Join" not in plan_of(members(spark, "/root/testdata/sf0.001"))
