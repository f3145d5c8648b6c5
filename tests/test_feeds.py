"""Landed feeds, catalogue files, model tables, streams over several files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from corrob.operators.ingest import classify_entries, ingest_stats
from corrob.sources.catalogue import TABLE_SCHEMAS, Tables, check_sources, read_country_sources, read_sources
from corrob.sources.feeds import parse_entry_ts, read_feed_entries, read_feed_rejects
from corrob.streaming import streams

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Wire</title><language>en-gb</language>
<item><title>Quake &lt;b&gt;hits&lt;/b&gt;</title><link>http://E.com/a/?utm_source=x&amp;id=1</link>
<description>&lt;p&gt;Twelve&lt;/p&gt; dead</description><pubDate>Mon, 06 Oct 2025 08:00:00 GMT</pubDate></item>
<item><title> </title><link>http://e.com/b</link></item><item><title>No link</title></item></channel></rss>"""
ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Flood</title>
<link rel="self" href="https://e.org/self"/><link href="https://e.org/c#top"/><summary>Rising</summary>
<updated>2025-10-06T10:00:00+02:00</updated><author><name>Ann</name></author></entry></feed>"""


def test_feeds(spark, tmp_path):
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "this is no feed")):
        (tmp_path / name).write_text(text)
    rows = {r["title"]: r for r in read_feed_entries(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Quake  hits", "Flood"}
    quake, flood = rows["Quake  hits"], rows["Flood"]
    assert quake["canonical_url"] == "https://e.com/a?id=1" and quake["language"] == "en-gb"
    assert quake["description"] == "Twelve  dead"
    assert quake["published_at"] == flood["published_at"] == dt.datetime(2025, 10, 6, 8)
    assert flood["canonical_url"] == "https://e.org/c" and flood["author"] == "Ann" and flood["language"] is None
    rejects = read_feed_rejects(spark, str(tmp_path)).collect()
    assert [r["problem"] for r in rejects] == ["feed could not be parsed"] and rejects[0]["feed_file"].endswith("c.xml")


RDF = """<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"
 xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/">
<channel rdf:about="http://e.net"><title>Wire</title><dc:language>de</dc:language></channel>
<item rdf:about="http://e.net/1"><title>Storm</title><link>http://e.net/1</link><pubDate>soon</pubDate><dc:date>2025-10-06T08:00:00Z</dc:date>
<dc:creator>Bo</dc:creator><description> </description><content:encoded><![CDATA[<p>Heavy</p> rain]]></content:encoded></item></rdf:RDF>"""
CONTENT = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Fire</title><link href="https://e.org/f"/>
<content type="html">&lt;b&gt;Smoke&lt;/b&gt; seen</content><published>2025-10-06T08:00:00Z</published></entry></feed>"""


def test_rdf_items_and_modules(spark, tmp_path):
    (tmp_path / "a.xml").write_text(RDF)
    (tmp_path / "b.xml").write_text(CONTENT)
    storm, fire = read_feed_entries(spark, str(tmp_path)).orderBy(F.desc("title")).collect()
    at = dt.datetime(2025, 10, 6, 8)
    assert (storm["description"], storm["author"], storm["language"], storm["published_at"]) == ("Heavy  rain", "Bo", "de", at)
    assert (fire["description"], fire["language"], fire["published_at"]) == ("Smoke  seen", None, at)


def test_feeds_as_a_stream_equal_the_batch(spark, tmp_path):
    landing, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    landing.mkdir()
    for name, text in (("a.xml", RSS), ("b.xml", ATOM), ("c.xml", "this is no feed"), ("d[1].xml", RDF)):  # one batch after another
        (landing / name).write_text(text)
        streams.stream_feeds(spark, str(landing), out, progress, files_per_batch=1).awaitTermination()
    columns = ["title", "link", "description", "published_at", "author", "language", "canonical_url"]

    def rows(df, names):
        return sorted(str(r) for r in df.select(names).collect())

    entries, rejects = spark.read.parquet(f"{out}/entries"), spark.read.parquet(f"{out}/rejects")
    assert rows(entries, columns) == rows(read_feed_entries(spark, str(landing)), columns)
    assert {r["batch"] for r in entries.collect()} == {0, 1, 3}
    assert rows(rejects, ["problem", "payload"]) == rows(read_feed_rejects(spark, str(landing)), ["problem", "payload"])


@pytest.mark.parametrize("text, expected", [
    ("Mon, 06 Oct 2025 08:00:00 GMT", dt.datetime(2025, 10, 6, 8)), ("6 Oct 2025 10:00:00 +0200", dt.datetime(2025, 10, 6, 8)),
    ("2025-10-06T08:00:00Z", dt.datetime(2025, 10, 6, 8)), ("2025-10-06 08:00:00", dt.datetime(2025, 10, 6, 8)), ("soon", None)])
def test_entry_dates(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(parse_entry_ts(F.lit(None).cast("string"), F.col("t")).alias("v")).first()["v"] == expected


def test_catalogue(spark, tmp_path):
    good = dict(id="a", name="A", country="gb", type="rss", rss_url="https://a/rss", website_url="https://a", priority=5,
                is_international=True)
    (tmp_path / "s.json").write_text(json.dumps([good, {**good, "rss_url": None, "priority": 101}]))
    (tmp_path / "m.json").write_text(json.dumps([{"country_code": "gb", "primary": "zz"}]))
    sources, mappings = read_sources(spark, str(tmp_path / "s.json")), read_country_sources(spark, str(tmp_path / "m.json"))
    first = sources.first()
    assert first["country"] == "GB" and first["poll_interval_seconds"] == 300 and mappings.first()["priority"] == 50
    rules = {r["rule"] for r in check_sources(sources, mappings).collect()}
    assert rules == {"priority must be 0-100", "feed source has no rss_url", "source id is not unique",
                     "wrong number of international sources", "mapping points to unknown source"}


def test_tables_scan_with_fixed_schema_and_pushdown(spark, tmp_path):
    spark.createDataFrame([("a", "x", 1.0, True)], TABLE_SCHEMAS["event_reports"]).write.parquet(str(tmp_path / "event_reports"))
    df = Tables(spark, str(tmp_path)).event_reports.filter(F.col("event_id") == "a").select("report_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_id,a)" in plan and "ReadSchema: struct<event_id:string,report_id:string>" in plan
    assert df.first()["report_id"] == "x"


ENTRY = "entry_id bigint, ord bigint, source_id bigint, title string, description string, link string"
ROWS = [(1, 1, 1, "A", "x", "https://e.com/1"), (2, 2, 1, "B", "x", "http://e.com/1/"), (3, 3, 1, "a!", "X", "https://e.com/2"),
        (4, 4, 2, "", "x", "https://e.com/3"), (5, 5, 2, "C", "x", "javascript:alert(1)"), (6, 6, 2, "B", "x", "https://e.com/4"),
        (7, 7, 2, "D", "kept", "https://e.com/9"), (8, 8, 2, "d", "kept", "https://e.com/8"), (9, 9, 2, "Z", "z", "https://e.com/known")]


def test_dedup_levels_and_their_order(spark):
    as_of = F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")
    entries = spark.createDataFrame(ROWS, ENTRY)
    earlier = classify_entries(spark.createDataFrame([(0, 0, 1, "D", "kept", "https://e.com/known")], ENTRY), None, as_of)
    store = earlier.select(F.col("url_hash").alias("canonical_url_hash"), "content_hash")
    got = classify_entries(entries, store, as_of)
    assert {r["entry_id"]: r["outcome"] for r in got.collect()} == {
        1: "stored", 2: "duplicate_batch", 3: "duplicate_batch", 4: "rejected", 5: "rejected", 6: "stored",
        7: "duplicate_content", 8: "duplicate_batch", 9: "duplicate_url"}
    counts = {r["source_id"]: (r["fetched"], r["stored"], r["rejected"]) for r in ingest_stats(got).collect()}
    assert counts == {1: (3, 1, 0), 2: (6, 1, 2)}


def test_streamed_ingest_knows_earlier_batches(spark, tmp_path):
    as_of = F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")
    landed, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    for part in (ROWS[:3], ROWS[2:7]):
        spark.createDataFrame(part, ENTRY).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(ENTRY).parquet(landed)
        streams.stream_ingest(stream, store, progress, as_of).awaitTermination()
    rows = spark.read.parquet(store).groupBy("batch", "outcome").count().collect()
    assert {(r["batch"], r["outcome"]): r["count"] for r in rows} == {
        (0, "stored"): 1, (0, "duplicate_batch"): 2, (1, "rejected"): 2, (1, "duplicate_content"): 1, (1, "stored"): 2}


def test_streamed_clusters_join_events_of_earlier_batches(spark, tmp_path):
    landed, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "report_id bigint, title string, description string, published_at timestamp, retrieved_at timestamp"
    t = dt.datetime(2025, 10, 6, 8)
    batches = [[(1, "Earthquake strikes Japan killing 12", "", t, t), (2, "Flooding in Kenya", "", t, t)],
               [(3, "Twelve killed after earthquake hits Japan", "", t + dt.timedelta(hours=5), t + dt.timedelta(hours=5))]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        streams.stream_cluster(spark.readStream.schema(schema).parquet(landed), out, progress).awaitTermination()
    edges = {r["report_id"]: r["event_id"] for r in spark.read.parquet(f"{out}/edges").collect()}
    assert edges == {1: 1, 2: 2, 3: 1}


def test_no_task_lands_a_whole_table(spark, tmp_path, monkeypatch):
    """A part is read by as many tasks as the table has pieces, and long texts are cut into files by their size."""
    from corrob.plans import stream_queries

    table = str(tmp_path / "pages")
    spark.range(400).select((F.col("id") * 7 % 400).alias("page_id"), F.repeat(F.lit("x"), 200).alias("html")).repartition(8).write.parquet(table)
    monkeypatch.setattr(stream_queries, "FILE_BYTES", 8_000)
    folder = str(tmp_path / "landed")
    monkeypatch.setattr(stream_queries, "working_table", lambda spark, name: folder)
    sc = spark.sparkContext
    sc.setJobGroup("landing", "")
    try:
        stream_queries.landed(spark.read.parquet(table), "page_id", "pages")
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("landing") for s in tracker.getJobInfo(j).stageIds}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(tracker.getStageInfo(s).numTasks > 1 for s in stages if tracker.getStageInfo(s)) >= stream_queries.BATCHES + 1
    landed = spark.read.parquet(folder)
    assert sorted(r["page_id"] for r in landed.collect()) == list(range(400))
    assert landed.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 40  # of 80 rows a part
