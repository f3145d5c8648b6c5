"""Draft validation goldens, and ordered folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from corrob.functions.text import word_set
from corrob.operators.editorial import (
    article_versions, compose_brief, evidence_numbers, evidence_text, ngram_overlap, unique_slugs, validate_drafts)

FACT = "struct<fact_type:string,fact_key:string,fact:string,sources:array<string>,independent_sources:bigint>"


@pytest.fixture(scope="module")
def package(spark):
    rows = [("e", "Earthquake strikes Japan", [("a", "1", f, ["s1", "s2"], 2) for f in (
        "Earthquake occurred", "Magnitude was 6.8", "12 people were killed")], [], [])]
    return spark.createDataFrame(rows, f"event_id string, title string, confirmed_facts array<{FACT}>, "
                                       f"single_source_facts array<{FACT}>, conflicting_claims array<string>")


COPIED = ("An earthquake occurred in Japan. The magnitude was 6.8 and 12 people were killed, according to reports from "
          "the region. Officials continue to assess the situation as rescue teams work across the affected areas.")
TWICE = "An earthquake occurred in Japan and the magnitude was 6.8 with 12 people killed according to reports."


@pytest.mark.parametrize("body, failure", [
    ("The earthquake killed 48 people across the region.", "numbers not in evidence: 48.0"),
    ("The quake registered magnitude 9.1, the strongest in years.", "numbers not in evidence: 9.1"),
    ("Prime Minister Kenji Watanabe declared a national emergency.", "names not in evidence: kenji, minister"),
    ("Full coverage at https://not-a-real-source.example/quake", "article contains a URL"),
    (f"{TWICE}\n\n{TWICE}", "duplicated paragraph"),
    (COPIED, "copies 90% of a source article (limit 30%)"),
    ("", "missing body"),
    ("An earthquake occurred in Japan. The magnitude was 6.8. Authorities reported that 12 people were killed.", None),
])
def test_drafts(spark, package, body, failure):
    drafts = spark.createDataFrame([("d", "e", "Earthquake strikes Japan", body, [])],
                                   "draft_id string, event_id string, headline string, body string, key_points array<string>")
    sources = spark.createDataFrame([("e", 1, COPIED), ("e", 2, COPIED)], "event_id string, source_id bigint, text string")
    row = validate_drafts(drafts, package, sources).first()
    assert row["ok"] == (failure is None)
    if failure:
        assert failure in "; ".join(row["failures"])


def test_insufficient_short_circuits(spark, package):
    drafts = spark.createDataFrame([("d", "e", "x", "48 things", [], True)], "draft_id string, event_id string, headline string, "
                                   "body string, key_points array<string>, insufficient_evidence boolean")
    assert validate_drafts(drafts, package).first()["failures"] == ["writer reported insufficient evidence"]


def test_evidence_text_and_brief(spark, package):
    row = package.select(evidence_text().alias("t"), evidence_numbers().alias("n")).first()
    assert "magnitude was 6.8" in row["t"] and sorted(row["n"]) == [6.8, 12.0]
    brief = compose_brief(package).first()
    assert brief["body"] == "Earthquake occurred Magnitude was 6.8 12 people were killed"
    assert not brief["insufficient_evidence"]
    empty = compose_brief(package.withColumn("confirmed_facts", F.slice("confirmed_facts", 1, 0))).first()
    assert empty["insufficient_evidence"] and empty["body"] == ""


def test_overlap_takes_the_worst_source(spark):
    words = [f"w{i}" for i in range(20)]
    drafts = spark.createDataFrame([(1, " ".join(words)), (2, "too short")], "draft_id bigint, text string")
    sources = spark.createDataFrame([(1, " ".join(words[:10])), (2, " ".join(words[5:])), (3, "other")], "source_id bigint, text string")
    got = {r["draft_id"]: r["overlap"] for r in ngram_overlap(drafts, sources).collect()}
    assert got == {1: pytest.approx(8 / 13), 2: 0.0}


def test_slugs_are_unique(spark):
    titles = ["Big Quake", "Big quake!", "big-quake-2", "BIG QUAKE", "!!", "??", "Big Quake 2"]
    df = spark.createDataFrame(list(enumerate(titles)), "article_id bigint, headline string")
    got = [r["slug"] for r in unique_slugs(df, F.floor(F.col("article_id") / 2)).orderBy("article_id").collect()]
    assert got == ["big-quake", "big-quake-3", "big-quake-2", "big-quake-4", "article", "article-2", "big-quake-2-2"]


def test_versions_equal_a_plain_loop(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(120)]
    rows, body = [], list(vocabulary)
    for i in range(60):
        if rng.random() < 0.6:
            body[rng.randrange(len(body))] = f"x{i}"
        rows.append((rng.choice([1, 1, 1, 2]), i, " ".join(body)))
    drafts = spark.createDataFrame(rows, "article_id bigint, ord bigint, body string")
    expected, last, number = {}, {}, {}
    for a, i, text in rows:
        now = set(text.split())
        old = last.get(a)
        if old is None or (len(now | old) - len(now & old)) / len(now | old) >= 0.02:
            last[a], number[a] = now, number.get(a, 0) + 1
            expected[(a, i)] = number[a]
    for chunk in (F.lit(0), F.floor(F.col("ord") / 5)):
        got = {(r["article_id"], r["ord"]): r["version"] for r in article_versions(drafts, chunk).collect()}
        assert got == expected
    assert spark.range(1).select(word_set(F.lit("a a b")).alias("w")).first()["w"] == ["a", "b"]


def test_a_long_history_of_like_drafts_takes_few_rounds(spark):
    """Forty pieces of drafts that all differ from one another, but by less than 2 %: the first draft stands for all of them."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, i, " ".join([*words, f"x{i}"])) for i in range(160)] + [(1, 160, "another text"), (2, 0, ""), (2, 9, "!"), (2, 10, "a")]
    sc = spark.sparkContext
    sc.setJobGroup("long history", "")
    try:
        got = article_versions(spark.createDataFrame(rows, "article_id bigint, ord bigint, body string"), F.floor(F.col("ord") / 4))
        assert got.columns == ["article_id", "ord", "body", "version"]
        got = {(r["article_id"], r["ord"]): r["version"] for r in got.collect()}
        jobs = len(sc.statusTracker().getJobIdsForGroup("long history"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(1, 0): 1, (1, 160): 2, (2, 0): 1, (2, 10): 2}
    assert jobs < 80  # more than that if the pieces take turns
