"""Similar rows within a time window, n-gram filters, ranks and nearest vectors against brute force."""

import datetime as dt
import math
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corrob.operators import similarity
from corrob.operators.editorial import ngram_overlap
from corrob.operators.ops import latency_summary, nearest_ranks
from corrob.operators.similarity import members_of, similar_in_time

T0 = dt.datetime(1969, 12, 20)  # cells on both sides of the epoch
SCHEMA = "id bigint, vec array<struct<bucket:int,w:double>>, at timestamp"


def unit(weights):
    norm = math.sqrt(sum(w * w for w in weights.values()))
    return [(b, w / norm) for b, w in sorted(weights.items())]


def cosine(a, b):
    b = dict(b)
    return sum(w * b.get(k, 0.0) for k, w in a)


def test_similar_in_time_equals_all_pairs(spark):
    rng = random.Random(5)
    vectors = [unit({rng.randrange(14): 1 + rng.random() for _ in range(rng.randrange(1, 6))}) for _ in range(25)]
    rows = [(i, rng.choice(vectors[:3] if i % 3 == 0 else vectors), T0 + dt.timedelta(hours=rng.choice([rng.random() * 600, 72 * rng.randrange(8)])))
            for i in range(240)]
    odd = [(900, [], T0), (901, vectors[0], None)]
    pairs, members = similar_in_time(spark.createDataFrame(rows + odd, SCHEMA), 0.6)
    members, pairs = {r["id"]: (r["class_id"], r["at"]) for r in members.collect()}, pairs.collect()
    classes = {}
    for i, (c, at) in members.items():
        classes.setdefault(c, []).append((i, at))
    window, got = dt.timedelta(hours=72), set()
    for ids in classes.values():
        got |= {(min(i, j), max(i, j)) for i, _ in ids for j, _ in ids if i != j}
    for p in pairs:
        linked = {(min(i, j), max(i, j)) for i, t in classes[p["class_a"]] for j, u in classes[p["class_b"]] if abs(t - u) <= window}
        assert linked and p["whole"] == (len(linked) == len(classes[p["class_a"]]) * len(classes[p["class_b"]]))
        assert not linked & got  # every link comes from one pair of classes
        got |= linked
    want = {(i, j) for i, v, t in rows for j, u, s in rows if i < j and abs(t - s) <= window and cosine(v, u) >= 0.6}
    assert got == want and sorted(members) == list(range(240))


def test_repeated_headlines_add_no_candidates(spark):
    """Twenty headlines repeated three hundred times: candidates stay near the verified pairs, whatever the repeats."""
    rng = random.Random(6)
    themes = [{rng.randrange(400): 1.0 for _ in range(6)} for _ in range(5)]
    vectors = [unit({**theme, 500 + i: 0.5}) for i, theme in enumerate(themes * 4)]
    rows = [(i, vectors[i % 20], T0 + dt.timedelta(hours=rng.random() * 700)) for i in range(6000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    candidates = similar_in_time(frame, 0.8, candidates=True)[0].count()
    verified = similar_in_time(frame, 0.8)[0].count()
    cells = 12
    assert verified <= candidates <= 2 * verified and verified <= cells * (20 * 3 + 20) * 2


def test_each_headline_is_embedded_once(spark):
    """Texts give the classes of their vectors; a third of the rows share one text, and two texts one vector."""
    rng = random.Random(8)
    words = ["quake", "flood", "japan", "chile", "dam", "storm", "peru"]
    texts = [" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(12)] + ["japan quake", "quake japan", "the", None]
    rows = [(i, texts[0] if i % 3 == 0 else rng.choice(texts), None if i == 7 else T0 + dt.timedelta(hours=rng.random() * 400)) for i in range(600)]
    frame = spark.createDataFrame(rows, "id bigint, text string, at timestamp")
    made = spark.sparkContext.accumulator(0)

    def unit_of(text):
        made.add(1)
        known = sorted({words.index(w) for w in (text or "").split() if w in words})
        return [(b, 1.0 / len(known) ** 0.5) for b in known]

    embed = F.udf(unit_of, "array<struct<bucket:int,w:double>>")
    pairs, members = similar_in_time(frame, 0.6, embed=embed)
    got = [{tuple(r) for r in df.collect()} for df in (pairs, members)]
    assert made.value <= 2 * len(set(texts))
    vectors = [(i, unit_of(t), at) for i, t, at in rows]
    want = [{tuple(r) for r in df.collect()} for df in similar_in_time(spark.createDataFrame(vectors, SCHEMA), 0.6)]
    assert got == want and got[0] and got[1]


def test_nothing_is_similar_in_an_empty_table(spark):
    pairs, members = similar_in_time(spark.createDataFrame([], SCHEMA), 0.8)
    assert pairs.count() == members.count() == 0


def test_member_filter_loses_nothing_and_passes_little_else(spark):
    rows = spark.range(200_000).select(F.col("id"), F.col("id").cast("string").alias("g"))
    wanted = spark.range(0, 400_000, 100).select(F.col("id").cast("string").alias("g"))
    kept = members_of(rows, wanted, ["g"])
    assert kept.columns == rows.columns
    assert kept.filter("id % 100 = 0").count() == 2_000 and kept.count() <= 2 * 2_000
    assert members_of(rows, wanted.filter("false"), ["g"]).count() == 0
    odd = spark.createDataFrame([(1, None), (2, "7"), (3, "")], "id bigint, g string")
    assert {r["id"] for r in members_of(odd, spark.createDataFrame([("7",), ("",), (None,)], "g string"), ["g"]).collect()} == {1, 2, 3}


def test_a_large_filter_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(similarity, "MOST_WORDS", 16)
    rows = spark.range(1000).select(F.col("id").alias("g"))
    assert members_of(rows, spark.range(500).select(F.col("id").alias("g")), ["g"]).count() == 1000


def test_overlap_filters_before_the_shuffle_and_knows_equal_texts(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(40)] + [f"{' '.join(words[:20])} {passage}"] * 3
    drafts = [(1, passage), (2, "too short"), (3, " ".join(passage.split()[:15] + words[100:115])), (4, None)]

    def grams(text):
        tokens = (text or "").split()
        return {tuple(tokens[i:i + 8]) for i in range(len(tokens) - 7)}

    want = {d: max((len(grams(t) & grams(s)) / len(grams(t)) for s in texts), default=0.0) if grams(t) else 0.0 for d, t in drafts}
    got = ngram_overlap(spark.createDataFrame(drafts, "draft_id bigint, text string"),
                        spark.createDataFrame(list(enumerate(texts)), "source_id bigint, text string"))
    assert {r["draft_id"]: round(r["overlap"], 9) for r in got.collect()} == {d: round(o, 9) for d, o in want.items()}
    assert got.filter("overlap > 0").count() == 2


def test_ranks_equal_the_sorted_list(spark):
    rng = random.Random(9)
    lists = {"spread": [rng.random() * 1e6 for _ in range(5000)], "one value": [7.0] * 5000,
             "heavy": [5.0] * 4900 + [rng.random() * 10 for _ in range(100)], "two": [1.0, 2.0], "single": [3.0],
             "edge": [5.0] * 4999 + [6.0]}
    for name, values in lists.items():
        frame = spark.createDataFrame([(v,) for v in values] + [(None,)] * 3, "x double")
        n = len(values)
        wanted = sorted({0, n // 2, int(0.99 * (n - 1)), n - 1})
        for room in (40, 100_000):  # with little room the sketch has to narrow several times
            assert nearest_ranks(frame, "x", wanted, room) == {i: sorted(values)[i] for i in wanted}, (name, room)
        assert nearest_ranks(frame, "x", [n]) == {}


def test_latency_of_no_requests(spark):
    row = latency_summary(spark.createDataFrame([], "latency_ms double, failed boolean, at timestamp")).first()
    assert row["requests"] == 0 and row["p50_ms"] is None


def _nearest(rows_q, rows_b, k):
    out = set()
    for q, v in rows_q:
        best = sorted(((-round(sum(x * y for x, y in zip(v, w)), 9), i) for i, w in rows_b))[:k]
        out |= {(q, i, rank) for rank, (_, i) in enumerate(best, 1)}
    return out


def test_nearest_vectors_equal_a_full_scan_and_skip_cells(spark):
    rng = random.Random(9)
    hubs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    base = [(i, [x + rng.gauss(0, 0.05) for x in hubs[i % 12]]) for i in range(900)]
    base += [(2000 + i, base[0][1]) for i in range(30)] + [(3000, [0.0] * 8), (3001, [-x for x in hubs[0]])]  # ties, a zero vector
    asked = [(i, [x + rng.gauss(0, 0.05) for x in hubs[i % 12]]) for i in range(24)] + [(50, [0.0] * 8), (51, base[0][1])]
    schema = "{} bigint, vec array<double>"
    got = similarity.top_k_neighbors(spark.createDataFrame(asked, schema.format("query_id")),
                                     spark.createDataFrame(base, schema.format("id")), 7, rows_per_cell=40, pivots=24).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in got} == _nearest(asked, base, 7)
    shares = {r["query_id"]: r["scored"] / len(base) for r in got}
    assert shares[50] == 1.0 and sum(s for q, s in shares.items() if q < 50) / 24 < 0.4


def test_nearest_vectors_of_small_tables(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0])], "query_id bigint, vec array<double>").distinct()
    schema = "id bigint, vec array<double>"
    none = spark.createDataFrame([], schema)
    assert similarity.top_k_neighbors(q, none, 3).collect() == []
    zeros = spark.createDataFrame([(5, [0.0, 0.0]), (4, [0.0, 0.0])], schema)
    for size in (1, 100):  # in cells, and whole
        assert [(r["id"], r["rank"], r["scored"]) for r in similarity.top_k_neighbors(q, zeros, 3, size).orderBy("rank").collect()] == [
            (4, 1, 2), (5, 2, 2)]
    assert similarity.top_k_neighbors(none.withColumnRenamed("id", "query_id"), zeros, 3).collect() == []


def test_titles_of_repeated_words_are_equal_in_query_and_sql(spark, tmp_path):
    """Every word twice or four times over weighs as once; the last digits of the weights differ."""
    words = "anchor beacon cobalt delta ember falcon granite harbor indigo".split()
    titles = [" ".join(words[:k] * c) for k in (1, 2, 3, 4, 5, 7) for c in (1, 2, 4, 5)] + ["beacon anchor", "anchor anchor beacon", "delta", ""]
    rows = [(i, "http://a.example/", f"<title>{t}</title>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["cosine_pairs"]).fetchall())
    got = sorted((r["id_a"], r["id_b"], r["cos"]) for r in entry.queries()["cosine_pairs"](spark, str(tmp_path)).collect())
    assert got == want and {a for a, _, _ in got} <= {0, 4, 8, 12, 16, 20, 25, 26} and max(c for _, _, c in got) < 1


def test_pairs_equal_all_pairs_and_are_multiplied_above_the_join(spark, monkeypatch):
    """Common buckets in many pieces, buckets equal modulo 256, more shared buckets than are multiplied one by one."""
    monkeypatch.setattr(similarity, "PIECE", 7, raising=False)
    monkeypatch.setattr(similarity, "PER_TASK", 500, raising=False)
    rng = random.Random(11)
    draws = [{rng.choice([rng.randrange(9), 256 * rng.randrange(5) + rng.randrange(4), rng.randrange(1500)]): 1 + rng.choice([0, 0, rng.random()])
              for _ in range(rng.randrange(1, 11))} for _ in range(160)]
    long = {40 * i: 1.0 + i % 3 for i in range(14)}
    draws += [{b: w for b, w in long.items() if b != 40 * drop} for drop in range(6)] + [long, {7: 1.0}, {263: 2.0}]
    heads = {}
    for i, d in enumerate(draws):
        heads.setdefault(tuple((b, round(w, 9)) for b, w in unit(d)), (i, unit(d)))
    rows = [(i, unit(d)) for i, d in enumerate(draws)] + [(900 + i, unit(draws[i])) for i in range(40)] + [(999, [])]
    found = similarity.similar_pairs(spark.createDataFrame(rows, "id bigint, vec array<struct<bucket:int,w:double>>"), 0.4)
    got = {(r["id_a"], r["id_b"]): round(r["cos"], 9) for r in found.collect()}
    want = {(i, j): round(cosine(v, u), 9) for i, v in heads.values() for j, u in heads.values() if i < j}
    assert got == {pair: cos for pair, cos in want.items() if cos >= 0.4} and len(got) > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not [line for line in joins if "lambda" in line] and "ExistingRDD" not in plan
