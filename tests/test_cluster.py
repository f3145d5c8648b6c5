"""Clustering and independence, against goldens and a one-at-a-time brute force."""

import datetime as dt
import math
import random
from collections import Counter
from hashlib import blake2b

import pytest
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.facts import report_facts
from corrob.functions.scores import combined_similarity
from corrob.functions.text import jaccard
from corrob.functions.vectors import embed_tokens, hash_embedding, sparse_dot
from corrob.operators import cluster
from corrob.operators.cluster import SCALE, arrival_wave, cluster_events, latest_events
from corrob.operators.similarity import lexically_first
from corrob.operators.verify import event_members, independent_chains, verify_events
from corrob.streaming.streams import stream_cluster

T0 = dt.datetime(2025, 10, 6, 8, 0)
SCHEMA = "report_id bigint, source_id bigint, title string, description string, published_at timestamp, retrieved_at timestamp"

#: The headlines that decide what one event is.
CORPUS = [
    ("Reuters", None, "Earthquake strikes Japan killing 12", "A magnitude 6.8 earthquake struck Japan."),
    ("Daily Wire Republisher", 1, "Earthquake strikes Japan killing 12 people", "A magnitude 6.8 earthquake struck Japan, killing 12 people."),
    ("Metro Herald", 1, "Strong earthquake strikes Japan, killing 12", "A magnitude 6.8 earthquake struck Japan, killing 12 people."),
    ("Japan Meteorological Agency", None, "Magnitude 6.8 earthquake strikes Japan killing 12", "A magnitude 6.8 earthquake struck Japan, killing 12 people."),
    ("NHK", None, "Powerful earthquake strikes Japan killing 12", "A magnitude 6.8 earthquake struck Japan, killing 12 people."),
]


@pytest.mark.parametrize("a, b, same", [
    ("Earthquake strikes Japan killing 12", "Twelve killed after earthquake hits Japan", True),
    ("Earthquake strikes Japan killing 12", "Japan earthquake: 12 dead", True),
    ("Magnitude 6.8 earthquake strikes Japan", "Strong 6.8 quake hits Japan", True),
    ("Flooding in Bangladesh displaces thousands", "Thousands displaced by Bangladesh floods", True),
    ("Wildfire forces evacuations in California", "California wildfire prompts evacuation orders", True),
    ("Earthquake strikes Japan killing 12", "Quake in Japan leaves twelve dead", True),
    ("Earthquake strikes Japan killing 12", "Earthquake strikes Chile killing 12", False),
    ("Earthquake strikes Japan killing 12", "Japan election: polls open", False),
    ("Flooding in Bangladesh displaces thousands", "Wildfire forces evacuations in California", False),
    ("Magnitude 6.8 earthquake strikes Japan", "Magnitude 5.1 earthquake hits Greece", False),
])
def test_paraphrase_scores(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").withColumns(
        {"va": hash_embedding(F.col("a")), "vb": hash_embedding(F.col("b"))})

    def signal(c, kind, field):
        found = F.filter(report_facts(F.col(c), F.lit("")), lambda f: f["fact_type"] == kind)
        return F.transform(found, lambda f: F.lower(f[field]))

    score = combined_similarity(
        sparse_dot(F.col("va"), F.col("vb")),
        jaccard(signal("a", "entity", "value_text"), signal("b", "entity", "value_text")),
        jaccard(signal("a", "number", "fact_key"), signal("b", "number", "fact_key")),
        F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert (df.select(score.alias("s")).first()["s"] >= V.CLUSTER_THRESHOLD) == same


def corpus(spark):
    rows = [(i + 1, i + 1, t, d, T0 + dt.timedelta(minutes=i), T0 + dt.timedelta(minutes=i))
            for i, (_, _, t, d) in enumerate(CORPUS)]
    sources = [(i + 1, name, root, 85.0) for i, (name, root, _, _) in enumerate(CORPUS)]
    return (spark.createDataFrame(rows, SCHEMA),
            spark.createDataFrame(sources, "source_id bigint, name string, lineage_root_id bigint, reliability_score double"))


def test_corpus_is_one_event_with_three_chains(spark):
    reports, sources = corpus(spark)
    events, edges = cluster_events(reports)
    assert edges.count() == 5 and events.count() == 1
    assert events.first()["report_count"] == 5
    members = event_members(edges, reports, sources).withColumn("vec", hash_embedding(F.col("title")))
    state = verify_events(members, F.lit(T0 + dt.timedelta(hours=1))).first()
    assert state["chains"] == 3 and state["report_count"] == 5
    assert state["conflict_count"] == 0 and state["status"] == "VERIFIED"


def brute_force(rows):
    """The one-at-a-time procedure, spelled out on dicts: {report: (event, score)}."""
    def embed(tokens):
        counts = Counter(int.from_bytes(blake2b(t.encode(), digest_size=8).digest(), "big") % V.EMBEDDING_DIM for t in tokens)
        w = {b: 1 + math.log(n) for b, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {b: math.floor(x / norm * SCALE + 0.5) for b, x in w.items()} if norm else {}

    def share(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    def length(vec):
        return math.sqrt(sum(x * x for x in vec.values()))

    events, edges = [], {}
    for rid, facts, when, tokens in rows:
        ents = {f["value_text"].lower() for f in facts if f["fact_type"] == "entity"}
        nums = {f["fact_key"] for f in facts if f["fact_type"] == "number"}
        kind = next((f["value_text"] for f in facts if f["fact_type"] == "event_type"), None)
        vec, best = embed(tokens), None
        for place, e in enumerate(events):
            if abs((when - e["last"]).total_seconds()) > V.EVENT_WINDOW_HOURS * 3600:
                continue
            norm = length(e["sum"]) * length(vec)
            cos = sum(x * e["sum"].get(b, 0) for b, x in vec.items()) / norm if norm else 0.0
            score = .8 * max(cos, 0) + .15 * share(ents, e["ents"]) + .05 * share(nums, e["nums"])
            if kind and e["kind"] and kind != e["kind"]:
                score *= V.TYPE_MISMATCH_PENALTY
            rank = (-round(score, 9), -round(cos, 9), place)
            if round(score, 9) >= V.CLUSTER_THRESHOLD and (best is None or rank < best[0]):
                best = rank, e, score
        if best is None:
            best = None, dict(id=rid, ents=ents, nums=nums, kind=kind, sum=Counter(), last=when), 1.0
            events.append(best[1])
        event = best[1]
        for b, x in vec.items():
            event["sum"][b] += x
        event["last"] = max(event["last"], when)
        edges[rid] = event["id"], round(best[2], 4)
    return edges


def one_at_a_time(reports):
    rows = reports.withColumns({"tokens": embed_tokens(F.col("title")), "facts": report_facts(F.col("title"), F.coalesce("description", F.lit("")))})
    return brute_force([(r["report_id"], r["facts"], r["published_at"] or r["retrieved_at"], r["tokens"])
                        for r in rows.orderBy("retrieved_at", "report_id").collect()])


def edges_of(edges):
    return {r["report_id"]: (r["event_id"], r["similarity_score"]) for r in edges.collect()}


HEADLINES = [
    ("Earthquake strikes Japan killing 12", 0), ("Quake hits Japan", 2), ("Flooding in Kenya displaces thousands", 3),
    ("Strong quake hits Japan killing 5", 10), ("Earthquake strikes Chile killing 12", 12), ("12 to 13", 13),
    ("Kenya floods displace thousands", 90), ("Japan quake toll rises to 14", 20), ("12 to 13", 21),
    ("Earthquake strikes Japan killing 12", 150), ("Wildfire forces evacuations in California", 30),
]


def headlines(spark):
    rows = [(i, 1, t, "", T0 + dt.timedelta(hours=h), T0 + dt.timedelta(hours=i)) for i, (t, h) in enumerate(HEADLINES)]
    return spark.createDataFrame(rows, SCHEMA)


def test_waves_of_one_equal_the_one_at_a_time_procedure(spark):
    reports = headlines(spark).filter("report_id < 3")
    want = one_at_a_time(reports)
    for wave in (F.col("report_id"), None):
        assert edges_of(cluster_events(reports, wave)[1]) == want


PLACES = ["Japan", "Chile", "Kenya", "Nepal"]
HAPPENINGS = ["Earthquake strikes {}", "Strong quake hits {} coast", "{} floods displace thousands", "Flooding in {} after quake", "12 to 13",
              "Rescue teams reach {} quake victims", "{} coast: strong earthquake, flooding"]


def mixture(spark, n=240, seed=1):
    """Related stories in free mixture: late and early reports, silences, repeated headlines."""
    rng = random.Random(seed)
    rows, hour = [], 0.0
    for i in range(n):
        hour += rng.choice([0.1, 1, 4, 4, 9, 20]) + (100 if i in (n // 3, n // 2) else 0)
        title = rng.choice(HAPPENINGS).format(rng.choice(PLACES)) + rng.choice(["", "", " killing 12", " killing 5"])
        occurred = None if rng.random() < 0.1 else T0 + dt.timedelta(hours=hour - rng.choice([0, 0, 1, 30, 70]))
        rows.append((i, 1, title, rng.choice([None, "", "A magnitude 6.8 earthquake."]), occurred, T0 + dt.timedelta(hours=hour)))
    return spark.createDataFrame(rows, SCHEMA)


def test_result_depends_on_neither_waves_nor_stretches(spark, monkeypatch):
    reports = mixture(spark)
    want = one_at_a_time(reports)
    assert 10 < len({e for e, _ in want.values()}) < 150
    events, edges = cluster_events(reports)
    assert edges_of(edges) == want
    members = Counter(e for e, _ in want.values())
    assert {r["event_id"]: r["report_count"] for r in events.collect()} == members
    # stretches so short that most start from a guess and are run again
    monkeypatch.setattr(cluster, "STRETCH", 40)
    assert edges_of(cluster_events(reports)[1]) == want
    events, edges = cluster_events(reports, arrival_wave(480))
    assert edges_of(edges) == want
    assert {r["event_id"]: r["report_count"] for r in events.collect()} == members


def test_another_embedder_and_odd_reports(spark):
    rows = [(1, 1, None, None, None, T0), (2, 1, "", "", None, T0), (3, 1, "12", None, T0, T0), (4, 1, "12", None, T0, T0),
            (5, 1, "Quake hits Japan", None, T0, T0), (6, 1, "Quake hits Japan", None, T0, T0), (7, 1, "Quake hits Japan " * 3000, None, T0, T0)]
    reports = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("sig", "unit", "task", "vec", "n", "day", "node")})
    _, edges = cluster_events(reports, embedder=cluster.md5_embedder)
    got = {r["report_id"]: r["event_id"] for r in edges.collect()}
    assert [got[i] for i in range(1, 5)] == [1, 2, 3, 4] and got[6] == got[7] == 5
    flat = lambda texts: texts.withColumn("vec", F.expr("array(named_struct('bucket', 1, 'w', 1.0D))"))
    _, edges = cluster_events(reports, embedder=flat)
    assert {r["event_id"] for r in edges.collect()} == {1}
    events, edges = cluster_events(reports.limit(0))
    assert events.count() == 0 == edges.count()


def test_stream_gives_the_events_of_the_batch(spark, tmp_path):
    reports = mixture(spark, 90, 2).cache()
    want, landed = one_at_a_time(reports), str(tmp_path / "in")
    for low in (0, 20, 75):  # micro-batches of unequal size
        high = {0: 20, 20: 75, 75: 90}[low]
        reports.filter(f"report_id >= {low} and report_id < {high}").coalesce(1).write.mode("append").parquet(landed)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    stream_cluster(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination()
    assert edges_of(spark.read.parquet(str(tmp_path / "out" / "edges"))) == want
    versions = spark.read.parquet(str(tmp_path / "out" / "events")).withColumnRenamed("batch", "version")
    assert {r["event_id"]: r["report_count"] for r in latest_events(versions).collect()} == Counter(e for e, _ in want.values())
    # a batch writes the events it touched, not all there are
    sizes = [r["count"] for r in versions.groupBy("version").count().orderBy("version").collect()]
    assert len(sizes) == 3 and sizes[-1] < latest_events(versions).count()


@pytest.mark.parametrize("wave", [lambda: None, lambda: F.lit(0)])
def test_equal_headlines_far_apart_are_different_events_in_any_wave(spark, wave):
    title = "Earthquake strikes Japan killing 12"
    rows = [(i, 1, title, f"copy {i % 2}", T0 + dt.timedelta(hours=h), T0 + dt.timedelta(minutes=i)) for i, h in enumerate([0, 1, 400, 60, 401])]
    _, edges = cluster_events(spark.createDataFrame(rows, SCHEMA), wave=wave())
    assert {r["report_id"]: r["event_id"] for r in edges.collect()} == {0: 0, 1: 0, 3: 0, 2: 2, 4: 2}


def test_wide_wave_keeps_every_report_once_whatever_the_row_order(spark):
    reports = headlines(spark)
    _, a = cluster_events(reports, wave=F.lit(0))
    _, b = cluster_events(reports.orderBy(F.desc("title")).repartition(3), wave=F.lit(0))
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert a == b and len(a) == len(HEADLINES)


def test_ordered_selection_equals_a_pass(spark):
    edges = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 6), (5, 6), (6, 7)]
    kept = []
    for n in range(1, 9):
        if not any((k, n) in edges for k in kept):
            kept.append(n)
    nodes = spark.range(1, 9)
    got = lexically_first(nodes, spark.createDataFrame(edges, "earlier bigint, later bigint"))
    assert sorted(r["id"] for r in got.collect()) == kept


def test_chains_without_vector_and_near_copies(spark):
    rows = [("e", 1, 10, T0, [(1, 1.0)]), ("e", 2, 20, T0, [(1, 1.0)]), ("e", 3, 30, T0, [(1, 0.95), (2, 0.3122)]),
            ("e", 4, 40, T0, None), ("e", 5, 40, T0, []), ("e", 6, 50, T0, [(2, 1.0)])]
    members = spark.createDataFrame(rows, "event_id string, report_id bigint, lineage_root bigint, retrieved_at timestamp, "
                                          "vec array<struct<bucket:int,w:double>>")
    assert [tuple(r) for r in independent_chains(members).collect()] == [("e", 3)]
