"""Registered queries: feeds, listings, localisation, visitor countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob.functions import scores as S
from corrob.operators import serve as O
from corrob.plans import views
from corrob.plans.ingest_queries import DATE, stamp
from corrob.plans.registry import query
from corrob.plans.views import table, with_views

_SCORE = """(0.55 * importance_score + 0.30 * confidence_score
  + 15.0 * pow(0.5, greatest(0, (epoch_us(as_of) - epoch_us(published_at)) / 3.6e9) / 18.0))"""


@query("rank_scores", with_views("articles", "as_of_orders") + f"""
SELECT article_id, round({_SCORE}, 6) AS score, round(pow(0.5, (epoch_us(as_of) - epoch_us(published_at)) / 3.6e9 / 18.0), 6) AS recency
FROM articles, clock""")
def rank_scores(spark, sf_dir):
    as_of = views.as_of_orders(spark, sf_dir)
    return views.articles(spark, sf_dir).select(
        "article_id", F.round(S.rank_score(F.col("importance_score"), F.col("confidence_score"), F.col("published_at"), as_of), 6).alias("score"),
        F.round(S.recency(F.col("published_at"), as_of), 6).alias("recency"))


@query("global_feed", with_views("articles", "as_of_orders") + f"""
SELECT article_id, event_id, round({_SCORE}, 6) AS score FROM articles, clock WHERE is_published AND is_global
ORDER BY {_SCORE} DESC, published_at DESC, article_id LIMIT 20""")
def global_feed(spark, sf_dir):
    return O.global_feed(views.articles(spark, sf_dir), views.as_of_orders(spark, sf_dir)).select(
        "article_id", "event_id", F.round("score", 6).alias("score"))


@query("local_feeds", with_views("articles", "country_sources", "as_of_orders") + f""",
spread AS (SELECT locale_key AS country_key, * FROM articles WHERE is_published AND locale_key IS NOT NULL
  UNION SELECT event_country_key, * FROM articles WHERE is_published),
chosen AS (SELECT *, row_number() OVER (PARTITION BY country_key, event_id ORDER BY coalesce(locale_key = country_key, false) DESC, is_global DESC, article_id) AS pick FROM spread),
scored AS (SELECT c.country_key, event_id, article_id, published_at, {_SCORE} * 1.10 AS score FROM chosen c, clock WHERE pick = 1
  AND c.country_key IN (SELECT country_key FROM country_sources WHERE enabled)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY country_key ORDER BY score DESC, published_at DESC, article_id) AS rank FROM scored)
SELECT country_key, CAST(rank AS INT) AS rank, article_id, event_id, round(score, 6) AS score FROM ranked WHERE rank <= 20""")
def local_feeds(spark, sf_dir):
    return O.local_feeds(views.articles(spark, sf_dir), views.country_sources(spark, sf_dir),
                         views.as_of_orders(spark, sf_dir)).select(
        "country_key", "rank", "article_id", "event_id", F.round("score", 6).alias("score"))


@query("primary_mapping", with_views("country_sources") + """
SELECT country_key, source_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY country_key ORDER BY priority DESC, source_id) AS rn
  FROM country_sources WHERE enabled) m WHERE rn = 1""")
def primary_mapping(spark, sf_dir):
    return O.primary_mapping(views.country_sources(spark, sf_dir))


@query("latest_articles", with_views("articles") + f"""
SELECT article_id, strftime(published_at, '{DATE}') AS published_at FROM articles WHERE is_published ORDER BY articles.published_at DESC, article_id LIMIT 20""")
def latest_articles(spark, sf_dir):
    return O.latest_articles(views.articles(spark, sf_dir)).select("article_id", stamp("published_at").alias("published_at"))


@query("public_events", with_views("event_rows") + """
SELECT event_id, status, importance_score FROM event_rows WHERE status IN ('VERIFIED', 'EDITORIAL_REVIEW', 'PUBLISHED', 'UPDATING', 'ARCHIVED')
ORDER BY importance_score DESC, last_updated_at DESC, event_id LIMIT 20""")
def public_events(spark, sf_dir):
    return O.public_events(views.events(spark, sf_dir)).select("event_id", "status", "importance_score")


@query("status_predicates", with_views("event_rows") + """
SELECT event_id, status IN ('VERIFIED', 'EDITORIAL_REVIEW', 'PUBLISHED', 'UPDATING', 'ARCHIVED') AS is_public,
  status IN ('DETECTED', 'CLUSTERING', 'VERIFYING', 'VERIFIED', 'PUBLISHED', 'UPDATING') AS is_active,
  status IN ('DETECTED', 'CLUSTERING', 'VERIFYING', 'VERIFIED', 'PUBLISHED', 'UPDATING', 'EDITORIAL_REVIEW') AS is_maintained,
  CASE WHEN importance_score >= 80 THEN 'major' WHEN importance_score >= 60 THEN 'significant' WHEN importance_score >= 40 THEN 'moderate' ELSE 'minor' END AS band FROM event_rows""")
def status_predicates(spark, sf_dir):
    s = F.col("status")
    return views.events(spark, sf_dir).select(
        "event_id", S.is_public(s).alias("is_public"), S.is_active(s).alias("is_active"),
        S.is_active(s, for_maintenance=True).alias("is_maintained"), S.importance_band(F.col("importance_score")).alias("band"))


@query("enabled_local_sources", with_views("sources") + "SELECT source_id, slug, priority FROM sources WHERE enabled AND NOT is_international")
def enabled_local_sources(spark, sf_dir):
    return O.list_sources(views.sources(spark, sf_dir), enabled=True, international=False).select("source_id", "slug", "priority")


@query("job_listing", with_views("jobs") + """
SELECT job_id, job_type, attempts FROM jobs WHERE status = 'PENDING' AND job_type = '2-HIGH' ORDER BY created_at DESC, job_id LIMIT 500""")
def job_listing(spark, sf_dir):
    return O.list_jobs(views.jobs(spark, sf_dir), "2-HIGH", "PENDING", 500).select("job_id", "job_type", "attempts")


@query("rejected_queue", with_views("event_rows") + """
SELECT event_id, title, confidence_score, importance_score, conflict_count FROM event_rows WHERE status = 'EDITORIAL_REVIEW'
ORDER BY importance_score DESC, event_id LIMIT 50""")
def rejected_queue(spark, sf_dir):
    return O.rejected_queue(views.events(spark, sf_dir)).select(
        "event_id", "title", "confidence_score", "importance_score", "conflict_count")


@query("source_lookup", with_views("sources") + "SELECT source_id, name FROM sources WHERE slug = 'src7'")
def source_lookup(spark, sf_dir):
    return O.lookup(views.sources(spark, sf_dir), slug="src7").select("source_id", "name")


@query("event_review", with_views("event_rows", "conflicts") + """,
picked AS (SELECT event_id, title FROM event_rows WHERE status = 'VERIFYING' ORDER BY last_updated_at DESC, event_id LIMIT 50)
SELECT p.event_id, title, (SELECT string_agg('line ' || CAST(l_linenumber AS VARCHAR) || ' of ' || CAST(l_orderkey AS VARCHAR), '|' ORDER BY l_orderkey, l_linenumber)
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = p.event_id) AS facts,
  (SELECT string_agg(claim || ':' || status, '|' ORDER BY claim) FROM conflicts c WHERE c.event_id = p.event_id) AS conflicts FROM picked p""")
def event_review(spark, sf_dir):
    """Order lines stand in for facts, orders for conflicts."""
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("event_id"), F.lpad(F.col("l_orderkey").cast("string"), 19, "0").alias("fact_type"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("fact_key"),
        F.format_string("line %d of %d", "l_linenumber", "l_orderkey").alias("statement"))
    review = O.event_review(views.events(spark, sf_dir), lines, views.conflicts(spark, sf_dir), "VERIFYING", 50)
    joined = lambda c, f: F.array_join(F.transform(c, f), "|").alias(c)
    return review.select("event_id", "title", joined("facts", lambda x: x["statement"]),
                         joined("conflicts", lambda x: F.concat_ws(":", x["claim"], x["status"])))


@query("article_detail", with_views("articles") + """
SELECT a.article_id, headline || '|second point' AS key_points,
  (SELECT string_agg('Publisher ' || CAST(l_suppkey AS VARCHAR), '|' ORDER BY 'Publisher ' || CAST(l_suppkey AS VARCHAR), l_linenumber) FROM lineitem WHERE l_orderkey = a.article_id) AS sources,
  coalesce((SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = a.article_id), -1) AS image_id FROM articles a WHERE is_published""")
def article_detail(spark, sf_dir):
    """Order lines stand in for attributions and images of an article."""
    lines = table(spark, sf_dir, "lineitem")
    attributions = lines.select(
        F.col("l_orderkey").alias("article_id"), F.concat(F.lit("Publisher "), F.col("l_suppkey").cast("string")).alias("source_name"),
        F.lpad(F.col("l_linenumber").cast("string"), 3, "0").alias("url"), F.lit(True).alias("is_independent"))
    images = lines.select(F.col("l_orderkey").alias("article_id"), F.col("l_linenumber").alias("image_id"),
                          F.lit("https://img.example/").alias("ephemeral_url"))
    articles = views.articles(spark, sf_dir).withColumn("key_points", F.to_json(F.array("headline", F.lit("second point"))))
    return O.article_detail(articles, attributions, images).select(
        "article_id", F.array_join("key_points", "|").alias("key_points"),
        F.array_join(F.col("sources.source_name"), "|").alias("sources"), F.coalesce("image.image_id", F.lit(-1)).alias("image_id"))


@query("country_source_listing", with_views("country_sources", "sources") + """
SELECT c.country_key, role, c.priority, c.enabled, slug AS source_slug, name AS source_name FROM country_sources c JOIN sources s USING (source_id)""")
def country_source_listing(spark, sf_dir):
    return O.country_source_listing(views.country_sources(spark, sf_dir), views.sources(spark, sf_dir))


@query("localized_countries", with_views("event_rows", "country_sources", "countries") + """,
own AS (SELECT event_id, country_key FROM event_rows JOIN countries c USING (country_key) WHERE c.is_supported)
SELECT event_id, country_key FROM own
UNION ALL SELECT DISTINCT e.event_id, cs.country_key FROM event_rows e JOIN orders ON o_custkey = e.event_id JOIN lineitem ON l_orderkey = o_orderkey
  JOIN country_sources cs ON cs.source_id = l_suppkey AND cs.enabled WHERE e.event_id NOT IN (SELECT event_id FROM own)""")
def localized_countries(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("event_id"), F.col("l_suppkey").alias("source_id"))
    return O.localized_countries(views.events(spark, sf_dir), members, views.country_sources(spark, sf_dir),
                                 views.countries(spark, sf_dir))


@query("geo_enrich", """
WITH v AS (SELECT event_id, user_id % 40 AS a, event_id % 7 AS b, event_id % 11 AS c FROM events),
ips AS (SELECT event_id, CASE WHEN c = 0 THEN 'not-an-ip' WHEN c = 1 THEN CAST(a AS VARCHAR) || '.1.1.256' WHEN c = 3 THEN 'six' WHEN c <> 2 THEN 'ok' END AS ip,
  a * 16777216 + b * 65536 + 257 AS num, a, b FROM v),
six AS (SELECT event_id, upper('s' || CAST(n_nationkey AS VARCHAR)) AS code FROM ips JOIN nation ON ip = 'six' AND n_nationkey = a AND b % 2 = n_nationkey % 2),
nets AS (SELECT n_nationkey AS ord, n_nationkey * 16777216 AS lo, n_nationkey * 16777216 + 16777215 AS hi, 'n' || CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT n_nationkey, n_nationkey * 16777216 + 131072, n_nationkey * 16777216 + 196607, 'm' || CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_nationkey % 2 = 1
  UNION ALL SELECT 1000, 0, 536870911, '' || 'zz' ),
m AS (SELECT event_id, arg_min(upper(code), ord) AS code FROM ips JOIN nets ON ip = 'ok' AND num BETWEEN lo AND hi GROUP BY event_id
  UNION ALL SELECT event_id, code FROM six)
SELECT event_id, coalesce(code, 'XX') AS country_code, code IS NOT NULL AS resolved FROM ips LEFT JOIN m USING (event_id)""")
def geo_enrich(spark, sf_dir):
    """Visits from made addresses; IPv4 networks /8, /16 and one overlapping /3, and IPv6 networks /33."""
    n = F.col("n_nationkey")
    even = n % 2 == 0
    nets = table(spark, sf_dir, "nation").select(
        n.alias("ord"),
        F.concat(n.cast("string"), F.when(even, ".0.0.0/8").otherwise(".2.0.0/16")).alias("cidr"),
        F.concat(F.when(even, "n").otherwise("m"), n.cast("string")).alias("code"))
    wide = table(spark, sf_dir, "region").agg(F.lit(1000).alias("ord"), F.lit("0.0.0.0/3").alias("cidr"), F.lit("zz").alias("code"))
    # 2001:<nation>::/33 or 2001:<nation>:8000::/33; written in short and in long form
    six = table(spark, sf_dir, "nation").select(
        (2000 + n).alias("ord"), F.concat(F.lit("2001:"), F.hex(n), F.when(even, "::/33").otherwise(":8000::/33")).alias("cidr"),
        F.concat(F.lit("s"), n.cast("string")).alias("code"))
    a, b, c = F.col("user_id") % 40, F.col("event_id") % 7, F.col("event_id") % 11
    ip = (F.when(c == 0, "not-an-ip").when(c == 1, F.concat(a.cast("string"), F.lit(".1.1.256")))
          .when(c == 3, F.concat(F.lit("2001:"), F.hex(a), F.when(b % 2 == 0, "::1").otherwise(":8000:0:0:0:1.2.3.4")))
          .when(c != 2, F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("1.1"))))
    visits = table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    return O.geo_enrich(visits, nets.unionByName(wide).unionByName(six), "event_id").select("event_id", "country_code", "resolved")
