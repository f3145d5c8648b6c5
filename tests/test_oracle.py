"""Registered queries against a second SQL engine, and the shape of their plans.

All oracles run with CORROB_ALL_ORACLES=1; by default a cross-section does.
"""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
QUICK = ["content_dedup_outcomes", "canonical_urls", "page_titles", "ingest_outcomes", "near_dup_pairs", "vector_centroids",
         "top_k_neighbors", "cosine_pairs", "title_embeddings", "fact_support", "numeric_conflicts", "superseded_facts",
         "verification_status", "evidence_packages", "ngram_contamination", "unique_slugs", "global_feed", "local_feeds",
         "geo_enrich", "source_health", "ops_snapshot", "accuracy_snapshot", "latency_summary", "window_quota",
         "localized_countries", "stream_throughput"]
CHECKED = sorted(ORACLES) if os.environ.get("CORROB_ALL_ORACLES") else QUICK


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def frame(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v != v:
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", CHECKED)
def test_same_rows_as_sql(spark, con, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert frame(got) == frame(want)


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and set(QUICK) <= set(ORACLES)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["content_dedup_outcomes", "ingest_outcomes", "fact_support", "cosine_pairs", "geo_enrich",
                                  "local_feeds", "localized_countries", "source_health", "ngram_contamination"])
def test_no_cross_products_and_no_python(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "EvalPython" not in text and "InPandas" not in text


def test_scans_are_narrow_and_limits_early(spark, sf_dir):
    feed = plan(QUERIES["global_feed"](spark, sf_dir))
    assert "TakeOrderedAndProject" in feed
    local = plan(QUERIES["local_feeds"](spark, sf_dir))
    assert "WindowGroupLimit" in local
    urls = plan(QUERIES["canonical_urls"](spark, sf_dir))
    assert "html" not in urls
    lookup = plan(QUERIES["job_listing"](spark, sf_dir))
    assert "EqualTo(o_orderpriority,2-HIGH)" in lookup
