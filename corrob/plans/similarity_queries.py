"""Registered queries: vectors, similarity joins, clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import scores as S
from corrob.functions import text as X
from corrob.functions import vectors as VX
from corrob.operators import similarity as O
from corrob.operators.cluster import SCALE, WINDOW_US, arrival_wave, backfill, cluster_events, md5_embedder
from corrob.plans import views
from corrob.plans.registry import query
from corrob.plans.views import sql_norm, table, with_views
from corrob.sources.feeds import read_page_entries

WAVE_HOURS = 360


def embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


_CENTROIDS = """WITH e AS (SELECT vec_id, label, unnest(embedding) AS w, generate_subscripts(embedding, 1) AS dim FROM embeddings),
s AS (SELECT label, dim, sum(CAST(w AS DOUBLE)) AS s FROM e GROUP BY label, dim),
c AS (SELECT label, dim, s / sqrt(sum(s * s) OVER (PARTITION BY label)) AS w FROM s)
"""


@query("vector_centroids", _CENTROIDS + "SELECT label, CAST(dim - 1 AS INT) AS dim, round(w, 6) AS w FROM c")
def vector_centroids(spark, sf_dir):
    return O.centroids(embeddings(spark, sf_dir), "label").select(
        "label", F.posexplode("centroid").alias("dim", "w")).withColumn("w", F.round("w", 6))


@query("top_k_neighbors", _CENTROIDS + """, d AS (SELECT c.label AS query_id, e.vec_id AS id, sum(c.w * CAST(e.w AS DOUBLE)) AS sim
  FROM c JOIN e USING (dim) GROUP BY c.label, e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM d)
SELECT CAST(query_id AS BIGINT) AS query_id, id, round(sim, 6) AS similarity, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20""")
def top_k_neighbors(spark, sf_dir):
    """The 20 vectors nearest to each label's centroid."""
    base = embeddings(spark, sf_dir)
    centres = O.centroids(base, "label").select(F.col("label").cast("bigint").alias("query_id"), F.col("centroid").alias("vec"))
    return O.top_k_neighbors(centres, base.select("id", F.col("vec").cast("array<double>").alias("vec")), 20).select(
        F.col("query_id"), "id", F.round("similarity", 6).alias("similarity"), "rank")


@query("centroid_cosines", _CENTROIDS + """
SELECT e.vec_id AS id, round(sum(c.w * CAST(e.w AS DOUBLE)), 6) AS cosine FROM c JOIN e USING (label, dim) GROUP BY e.vec_id""")
def centroid_cosines(spark, sf_dir):
    base = embeddings(spark, sf_dir)
    return base.join(O.centroids(base, "label"), "label").select(
        "id", F.round(VX.cosine(F.col("vec").cast("array<double>"), F.col("centroid")), 6).alias("cosine"))


def _in(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_FOLD = "CASE tok " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.SYNONYMS.items()) + " ELSE tok END"
_STEM = "CASE " + " ".join(f"WHEN length(t) > {len(s) + 2} AND suffix(t, '{s}') THEN left(t, length(t) - {len(s)})"
                           for s in V.STEM_SUFFIXES) + " ELSE t END"


def _tokens_sql(source: str, text: str) -> str:
    return f"""raw AS (SELECT id, unnest(regexp_extract_all(lower({text}), '([a-z0-9]+)', 1)) AS tok,
  generate_subscripts(regexp_extract_all(lower({text}), '([a-z0-9]+)', 1), 1) AS pos FROM {source}),
folded AS (SELECT id, pos, {_FOLD} AS t FROM raw WHERE tok NOT IN {_in(V.STOPWORDS + list(V.NUMBER_WORDS))} AND NOT regexp_matches(tok, '^[0-9]+$')),
tokens AS (SELECT id, pos, {_STEM} AS token FROM folded)"""


_WEIGHTS = f"""counted AS (SELECT id, ('0x' || substr(md5(token), 1, 8))::BIGINT % {V.EMBEDDING_DIM} AS bucket, 1 + ln(count(*)) AS w FROM tokens GROUP BY ALL),
vectors AS (SELECT id, CAST(bucket AS INT) AS bucket, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM counted)"""


@query("embedding_tokens", "WITH " + _tokens_sql("(SELECT doc_id AS id, text FROM documents)", "text") + """
SELECT id, count(*) AS tokens, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM tokens GROUP BY id""")
def embedding_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), VX.embed_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0).select(
        "id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def page_vectors(spark, sf_dir):
    pages = read_page_entries(table(spark, sf_dir, "pages"))
    return pages.select(F.col("page_id").alias("id"), VX.hash_embedding_md5(F.col("title")).alias("vec"))


_PAGE_VECTORS = f"WITH titles AS (SELECT page_id AS id, {views._TITLE} AS title FROM pages), " + _tokens_sql(
    "titles", "title") + ", " + _WEIGHTS


@query("title_embeddings", _PAGE_VECTORS + " SELECT id, bucket, round(w, 6) AS w FROM vectors")
def title_embeddings(spark, sf_dir):
    return page_vectors(spark, sf_dir).select("id", F.explode("vec").alias("e")).select(
        "id", "e.bucket", F.round("e.w", 6).alias("w"))


@query("title_embeddings_blake2b")
def title_embeddings_blake2b(spark, sf_dir):
    pages = read_page_entries(table(spark, sf_dir, "pages"))
    return pages.select(F.col("page_id").alias("id"), VX.hash_embedding(F.col("title")).alias("vec")).select(
        "id", F.explode("vec").alias("e")).select("id", "e.bucket", F.round("e.w", 6).alias("w"))


@query("cosine_pairs", _PAGE_VECTORS + """,
lists AS (SELECT id, list(bucket || ':' || round(w, 9) ORDER BY bucket) AS v FROM vectors GROUP BY id),
heads AS (SELECT min(id) AS id FROM lists GROUP BY v),
d AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.w * b.w) AS cos FROM vectors a JOIN vectors b USING (bucket) WHERE a.id < b.id
  AND a.id IN (SELECT id FROM heads) AND b.id IN (SELECT id FROM heads) GROUP BY ALL)
SELECT id_a, id_b, round(cos, 6) AS cos FROM d WHERE round(cos, 9) >= 0.4""")
def cosine_pairs(spark, sf_dir):
    """Pairs of page titles with a cosine of 0.4 or more at nine decimals, so that 2 of 5 words in common are a pair."""
    return O.similar_pairs(page_vectors(spark, sf_dir), 0.4).withColumn("cos", F.round("cos", 6))


_IN_TIME = with_views("reports") + ", t AS (SELECT min(report_id) AS id, title FROM reports GROUP BY title), " + _tokens_sql("t", "title") + ", " + _WEIGHTS + """,
lists AS (SELECT id, list(bucket || ':' || round(w, 9) ORDER BY bucket) AS v FROM vectors GROUP BY id),
timed AS (SELECT report_id, v, epoch_us(published_at) AS us, epoch_us(published_at) // 259200000000 AS cell FROM reports JOIN t USING (title) JOIN lists USING (id) WHERE published_at IS NOT NULL),
classes AS (SELECT v, cell, min(report_id) AS class_id, min(us) AS first, max(us) AS last FROM timed GROUP BY v, cell),
heads AS (SELECT v, min(id) AS id FROM lists GROUP BY v),
d AS (SELECT a.id AS id_a, b.id AS id_b, sum(a.w * b.w) AS cos FROM vectors a JOIN vectors b USING (bucket)
  WHERE a.id IN (SELECT id FROM heads) AND b.id IN (SELECT id FROM heads) GROUP BY ALL HAVING sum(a.w * b.w) >= 0.4)
"""


@query("similar_in_time", _IN_TIME + """
SELECT a.class_id AS class_a, b.class_id AS class_b, round(cos, 6) AS cos, b.last - a.first <= 259200000000 AS whole
FROM d JOIN heads ha ON ha.id = id_a JOIN heads hb ON hb.id = id_b JOIN classes a ON a.v = ha.v JOIN classes b ON b.v = hb.v
WHERE (b.cell = a.cell AND a.class_id < b.class_id) OR (b.cell = a.cell + 1 AND b.first - a.last <= 259200000000)""")
def similar_in_time(spark, sf_dir):
    """Classes of headlines with a cosine of 0.4 or more within 72 hours of each other."""
    pairs, _ = O.similar_in_time(_timed_headlines(spark, sf_dir), 0.4, embed=VX.hash_embedding_md5)
    return pairs.withColumn("cos", F.round("cos", 6))


@query("similar_in_time_members", _IN_TIME + "SELECT report_id AS id, class_id FROM timed JOIN classes USING (v, cell)")
def similar_in_time_members(spark, sf_dir):
    """Reports and their classes, of which all rows are linked."""
    return O.similar_in_time(_timed_headlines(spark, sf_dir), 0.4, embed=VX.hash_embedding_md5)[1].select("id", "class_id")


def _timed_headlines(spark, sf_dir):
    return views.reports(spark, sf_dir).select(
        F.col("report_id").alias("id"), F.col("title").alias("text"), F.col("published_at").alias("at"))


@query("jaccard_titles", f"""
WITH t AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations),
s AS (SELECT conv_id, turn, list_distinct(string_split({sql_norm("text")}, ' ')) AS a, list_distinct(string_split({sql_norm("next")}, ' ')) AS b FROM t WHERE next IS NOT NULL)
SELECT conv_id, turn, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS overlap FROM s""")
def jaccard_titles(spark, sf_dir):
    """Word overlap of each turn with the one after it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(X.jaccard(X.word_set(F.col("text")), X.word_set(F.col("next"))), 6).alias("overlap"))


@query("combined_similarity", """
SELECT event_id, round((0.80 * greatest(0, value / 250 - 0.1) + 0.15 * (CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1.0 / 3 END) + 0.05)
  * CASE WHEN event_type <> 'view' AND user_id % 3 <> 0 THEN 0.9 ELSE 1 END, 6) AS score,
  abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-16 00:00:00')) <= 72 * 3600000000 AS in_window FROM events""")
def combined_similarity(spark, sf_dir):
    user = F.col("user_id")
    left = F.when(user % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("japan"), F.lit("tokyo")))
    right = F.array(F.lit("japan"), F.lit("osaka"))
    kind = F.when(user % 3 != 0, F.lit("view"))
    score = S.combined_similarity(F.col("value") / 250 - 0.1, X.jaccard(left, right),
                                  X.jaccard(F.array(F.lit("a")), F.array(F.lit("a"))), F.col("event_type"), kind)
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(score, 6).alias("score"),
        S.within_window(F.col("ts"), F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")).alias("in_window"))


def clustered_sql(view: str = "reports") -> str:
    """CTEs up to ``edges``: reports one after another, each against the events as they stand.

    The state of the recursion is the list of events within the time window;
    the view's reports have one place, and one event type for all.
    """
    tokens = _tokens_sql(f"(SELECT DISTINCT title AS id, title FROM {view})", "title")
    return f"""{tokens}, {_WEIGHTS},
vocabulary AS (SELECT DISTINCT bucket FROM vectors),
dense AS (SELECT t.id, list(coalesce(round(w * {SCALE}), 0)::DOUBLE ORDER BY v.bucket) AS v
  FROM (SELECT DISTINCT id FROM vectors) t CROSS JOIN vocabulary v LEFT JOIN vectors x ON x.id = t.id AND x.bucket = v.bucket GROUP BY t.id),
queue AS MATERIALIZED (SELECT row_number() OVER (ORDER BY retrieved_at, report_id) AS i, report_id, epoch_us(published_at) AS t, place, v,
  list_sort(['deaths:' || deaths, 'injured:' || injured, 'magnitude:' || magnitude]) AS nums FROM {view} JOIN dense ON dense.id = title),
pass AS (
  SELECT 0::BIGINT AS i, NULL::BIGINT AS report_id, NULL::BIGINT AS event_id, NULL::DOUBLE AS score, false AS is_new,
    []::STRUCT(id BIGINT, seq BIGINT, last BIGINT, place VARCHAR, nums VARCHAR[], s DOUBLE[])[] AS live
  UNION ALL
  SELECT i, report_id, CASE WHEN fits THEN best.id ELSE report_id END, CASE WHEN fits THEN best.score ELSE 1.0 END, NOT fits,
    CASE WHEN fits THEN list_transform(live, lambda e: CASE WHEN e.seq = best.seq THEN {{'id': e.id, 'seq': e.seq, 'last': greatest(e.last, t),
      'place': e.place, 'nums': e.nums, 's': list_transform(list_zip(e.s, v), lambda z: z[1] + z[2])}} ELSE e END)
    ELSE list_append(live, {{'id': report_id, 'seq': i, 'last': t, 'place': place, 'nums': nums, 's': v}}) END
  FROM (SELECT *, coalesce(round(best.score, 9) >= {V.CLUSTER_THRESHOLD}, false) AS fits FROM (
    SELECT *, list_sort(list_transform(cosines, lambda c: {{'a': -round({V.WEIGHT_SEMANTIC} * c.cos + c.rest, 9), 'b': -round(c.cos, 9), 'seq': c.seq, 'id': c.id,
        'score': {V.WEIGHT_SEMANTIC} * c.cos + c.rest}}))[1] AS best FROM (
      SELECT *, list_transform(live, lambda e: {{'id': e.id, 'seq': e.seq,
        'cos': list_dot_product(e.s, v) / (sqrt(list_dot_product(e.s, e.s)) * sqrt(list_dot_product(v, v))),
        'rest': CASE WHEN e.place = place THEN {V.WEIGHT_ENTITY} ELSE 0 END
          + {V.WEIGHT_NUMBER} * len(list_intersect(e.nums, nums)) / len(list_distinct(list_concat(e.nums, nums)))}}) AS cosines FROM (
        SELECT q.i, q.report_id, q.t, q.place, q.v, q.nums, list_filter(p.live, lambda e: q.t - e.last <= {WINDOW_US}) AS live
        FROM pass p JOIN queue q ON q.i = p.i + 1) a) b) c) d),
edges AS (SELECT event_id, report_id, round(score, 4) AS similarity_score, is_new AS is_primary FROM pass WHERE report_id IS NOT NULL)
"""


CLUSTERED_SQL = with_views("reports").replace("WITH ", "WITH RECURSIVE ", 1) + ", " + clustered_sql()


@query("cluster_events", CLUSTERED_SQL + """
SELECT event_id, any_value(h.title) AS title, 'earthquake' AS event_type, count(*) AS report_count,
  strftime(any_value(h.published_at), '%Y-%m-%d %H:%M:%S') AS first_detected_at, strftime(max(r.published_at), '%Y-%m-%d %H:%M:%S') AS last_activity
FROM edges JOIN reports r USING (report_id) JOIN reports h ON h.report_id = event_id GROUP BY event_id""")
def clusters(spark, sf_dir):
    """Events found in the reports: members, span and type of each."""
    events, _ = cluster_events(views.reports(spark, sf_dir), embedder=md5_embedder)
    return events.select("event_id", "title", "event_type", "report_count",
                         F.date_format("first_detected_at", "yyyy-MM-dd HH:mm:ss").alias("first_detected_at"),
                         F.date_format("last_activity", "yyyy-MM-dd HH:mm:ss").alias("last_activity"))


@query("cluster_edges", CLUSTERED_SQL + "SELECT event_id, report_id, similarity_score, is_primary FROM edges")
def cluster_edges(spark, sf_dir):
    """The event of every report, taken in two waves."""
    _, edges = cluster_events(views.reports(spark, sf_dir), arrival_wave(WAVE_HOURS), embedder=md5_embedder)
    return edges.select("event_id", "report_id", "similarity_score", "is_primary")


@query("backfill_verified")
def backfill_verified(spark, sf_dir):
    verified, _, _ = backfill(views.reports(spark, sf_dir), views.sources(spark, sf_dir), views.as_of_events())
    return verified.select("event_id", "report_count", "chains", "conflict_count", "confidence_score", "status")
