"""Registered queries: claims, conflicts, independence, confidence, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import facts as FX
from corrob.functions import scores as S
from corrob.functions.vectors import hash_embedding
from corrob.operators import verify as O
from corrob.plans import views
from corrob.plans.ingest_queries import DATE, stamp
from corrob.plans.registry import query
from corrob.plans.views import table, with_views
from corrob.session import written

DISPLAY = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


def _d(c):
    return DISPLAY.format(c)


_MENTIONS = f"""members AS (SELECT r.*, r.event_key AS event_id, s.name AS source_name, s.reliability_score,
  coalesce(s.lineage_root_id, s.source_id) AS lineage_root FROM reports r JOIN sources s USING (source_id)),
mentions AS (
  SELECT event_id, report_id, source_id, source_name, lineage_root, retrieved_at, m.kind AS fact_type, m.key AS fact_key,
    m.statement, m.num AS value_numeric, m.measure FROM members, LATERAL (VALUES
    ('number', 'number:deaths:' || {_d('deaths')}, 'deaths reported as ' || {_d('deaths')}, deaths, 'deaths'),
    ('number', 'number:injured:' || {_d('injured')}, 'injured reported as ' || {_d('injured')}, injured, 'injured'),
    ('number', 'number:magnitude:' || {_d('magnitude')}, 'magnitude reported as ' || {_d('magnitude')}, magnitude, 'magnitude'),
    ('date', 'date:' || iso_day, 'date referenced: ' || iso_day, NULL, NULL),
    ('entity', 'entity:' || lower(place), 'entity mentioned: ' || place, NULL, NULL),
    ('event_type', 'event_type:earthquake', 'event type: earthquake', NULL, NULL)) m(kind, key, statement, num, measure)),
facts AS (SELECT event_id, fact_key, min(fact_type) AS fact_type, min(statement) AS statement,
  min(value_numeric) AS value_numeric, min(measure) AS measure, min(retrieved_at) AS first_seen_at,
  max(retrieved_at) AS last_confirmed_at, count(DISTINCT report_id) AS source_count,
  count(DISTINCT lineage_root) AS independent_source_count FROM mentions GROUP BY event_id, fact_key),
disputes AS (SELECT event_id, measure, count(*) AS contested, 'sources disagree on ' || measure || ': ' ||
  string_agg({_d('value_numeric')} || ' (' || CAST(independent_source_count AS VARCHAR) || ' independent)', ', ' ORDER BY value_numeric) AS claim
  FROM facts WHERE fact_type = 'number' GROUP BY event_id, measure
  HAVING count(*) >= 2 AND (max(value_numeric) - min(value_numeric)) / max(value_numeric) > {V.CONFLICT_TOLERANCE})
"""
FACTS_SQL = with_views("reports", "sources") + ", " + _MENTIONS


def members(spark, sf_dir):
    """Reports of every source, grouped under their derived event key.

    Written, as most queries read them several times: the join of edges and reports is made once.
    """
    reports = views.reports(spark, sf_dir).withColumnRenamed("event_key", "event_id")
    edges = reports.select("event_id", "report_id")
    return written(O.event_members(edges, reports.drop("event_id"), views.sources(spark, sf_dir)), "members")


@query("event_members", FACTS_SQL + """
SELECT event_id, report_id, source_id, source_name, CAST(lineage_root AS BIGINT) AS lineage_root FROM members""")
def event_members(spark, sf_dir):
    return members(spark, sf_dir).select("event_id", "report_id", "source_id", "source_name", "lineage_root")


@query("extracted_facts", FACTS_SQL + "SELECT report_id, fact_key, statement, value_numeric FROM mentions")
def extracted_facts(spark, sf_dir):
    return FX.explode_facts(views.reports(spark, sf_dir).select("report_id", "title", "description")).select(
        "report_id", "fact_key", "statement", "value_numeric")


@query("extracted_facts_arrow", FACTS_SQL + "SELECT report_id, fact_key, statement, value_numeric FROM mentions")
def extracted_facts_arrow(spark, sf_dir):
    """The facts through the view for SQL users."""
    views.reports(spark, sf_dir).select("report_id", "title", "description").createOrReplaceTempView("corrob_fact_reports")
    FX.facts_view(spark, "corrob_fact_reports", "corrob_facts")
    return spark.sql("SELECT report_id, fact_key, statement, value_numeric FROM corrob_facts")


@query("extracted_facts_table_function", FACTS_SQL + "SELECT report_id, fact_key, statement FROM mentions")
def extracted_facts_table_function(spark, sf_dir):
    views.reports(spark, sf_dir).createOrReplaceTempView("corrob_reports")
    FX.facts_view(spark, "corrob_reports", "corrob_report_facts")
    return spark.sql("SELECT report_id, fact_key, statement FROM corrob_report_facts")


_TYPE_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{name}'"
    for name, words in V.EVENT_TYPE_KEYWORDS) + " END"


@query("event_type_classify", f"SELECT doc_id, {_TYPE_SQL} AS event_type FROM documents")
def event_type_classify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", FX.event_type(F.col("text")).alias("event_type"))


_NOTICE_SQL = """WITH notices AS (SELECT o_orderkey AS id, 'Kenya National Bank and the Supreme Court met on ' || CAST(day(o_orderdate) AS VARCHAR) || ' '
  || strftime(o_orderdate, '%B') || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS title, o_orderdate AS d, c_nationkey AS n, o_orderkey % 90 AS k
  FROM orders JOIN customer ON c_custkey = o_custkey)
"""


def notices(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Kenya National Bank and the Supreme Court met on "), F.day(day).cast("string"), F.lit(" "),
                 F.date_format(day, "MMMM"), F.lit(" "), F.year(day).cast("string")).alias("title"),
        F.concat(F.date_format(day, "MMM"), F.lit(". "), F.day(day).cast("string"), F.lit(", "),
                 (F.year(day) + 20).cast("string"), F.lit(" in japan; ministry unnamed. Customer Lake City")).alias("description"))


@query("date_entity_facts", """
WITH keys AS (SELECT o_orderkey AS id, unnest(['date:' || strftime(o_orderdate, '%Y-%m-%d'),
  'date:' || CAST(year(o_orderdate) + 20 AS VARCHAR) || strftime(o_orderdate, '-%m-%d'),
  'entity:kenya national bank', 'entity:supreme court', 'entity:japan', 'entity:kenya', 'entity:customer lake city']) AS fact_key FROM orders)
SELECT id, fact_key FROM keys""")
def date_entity_facts(spark, sf_dir):
    found = FX.explode_facts(notices(spark, sf_dir)).filter(F.col("fact_type").isin("date", "entity"))
    return found.select("id", "fact_key")


@query("fact_support", FACTS_SQL + f"""
SELECT event_id, fact_key, fact_type, statement, value_numeric, source_count, independent_source_count,
  strftime(first_seen_at, '{DATE}') AS first_seen_at, strftime(last_confirmed_at, '{DATE}') AS last_confirmed_at FROM facts""")
def fact_support(spark, sf_dir):
    return O.aggregate_facts(members(spark, sf_dir)).select(
        "event_id", "fact_key", "fact_type", "statement", "value_numeric", "source_count", "independent_source_count",
        stamp("first_seen_at").alias("first_seen_at"), stamp("last_confirmed_at").alias("last_confirmed_at"))


@query("numeric_conflicts", FACTS_SQL + "SELECT event_id, measure, claim, contested FROM disputes")
def numeric_conflicts(spark, sf_dir):
    return O.numeric_conflicts(O.aggregate_facts(members(spark, sf_dir)))


@query("superseded_facts", FACTS_SQL + """, ranked AS (SELECT *, first_value(fact_key) OVER (PARTITION BY event_id, measure
  ORDER BY last_confirmed_at DESC, independent_source_count DESC, fact_key) AS top FROM facts)
SELECT event_id, fact_key, CASE WHEN measure IS NOT NULL AND top <> fact_key THEN top END AS superseded_by FROM ranked""")
def superseded_facts(spark, sf_dir):
    return O.supersede(O.aggregate_facts(members(spark, sf_dir))).select("event_id", "fact_key", "superseded_by")


_EARLY = "hour(retrieved_at) % 6 < 3"


@query("merged_facts", FACTS_SQL + f""", old AS (SELECT event_id, fact_key, min(retrieved_at) AS first_seen_at FROM mentions
  WHERE {_EARLY} GROUP BY event_id, fact_key)
SELECT f.event_id, f.fact_key, strftime(coalesce(old.first_seen_at, TIMESTAMP '{views.AS_OF_EVENTS}'), '{DATE}') AS first_seen_at,
  strftime(f.last_confirmed_at, '{DATE}') AS last_confirmed_at, f.source_count, f.independent_source_count
FROM facts f LEFT JOIN old USING (event_id, fact_key)""")
def merged_facts(spark, sf_dir):
    """Facts of an earlier run (first half of each quarter day) refreshed by all reports."""
    everyone = members(spark, sf_dir)
    old = O.aggregate_facts(everyone.filter(F.hour("retrieved_at") % 6 < 3))
    return O.merge_facts(old, O.aggregate_facts(everyone), views.as_of_events()).select(
        "event_id", "fact_key", stamp("first_seen_at").alias("first_seen_at"),
        stamp("last_confirmed_at").alias("last_confirmed_at"), "source_count", "independent_source_count")


@query("conflict_lifecycle", FACTS_SQL + f""", old_facts AS (SELECT event_id, measure, value_numeric,
  count(DISTINCT lineage_root) AS ind FROM mentions WHERE fact_type = 'number' AND {_EARLY} GROUP BY event_id, measure, value_numeric),
old AS (SELECT event_id, measure, 'sources disagree on ' || measure || ': ' || string_agg({_d('value_numeric')} || ' (' ||
  CAST(ind AS VARCHAR) || ' independent)', ', ' ORDER BY value_numeric) AS claim FROM old_facts GROUP BY event_id, measure
  HAVING count(*) >= 2 AND (max(value_numeric) - min(value_numeric)) / max(value_numeric) > {V.CONFLICT_TOLERANCE})
SELECT event_id, claim, coalesce(old.measure, n.measure) AS measure,
  CASE WHEN n.claim IS NULL THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN n.claim IS NULL THEN 'sources now agree' END AS resolution
FROM old FULL OUTER JOIN disputes n USING (event_id, claim)""")
def conflict_lifecycle(spark, sf_dir):
    everyone = members(spark, sf_dir)
    as_of = views.as_of_events()
    old = O.numeric_conflicts(O.aggregate_facts(everyone.filter(F.hour("retrieved_at") % 6 < 3))).withColumn(
        "detected_at", as_of).withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    new = O.numeric_conflicts(O.aggregate_facts(everyone))
    return O.merge_conflicts(old, new, as_of).select("event_id", "claim", "measure", "status", "resolution")


@query("chains_by_lineage", FACTS_SQL + """
SELECT event_id, count(DISTINCT lineage_root) AS chains FROM members GROUP BY event_id""")
def chains_by_lineage(spark, sf_dir):
    return O.lineage_support(members(spark, sf_dir)).select("event_id", "chains")


_RELIABILITY = """reliability AS (SELECT event_id, avg(r) AS mean_reliability, count(*) AS chains FROM (SELECT event_id, lineage_root,
  arg_min(reliability_score, (retrieved_at, report_id)) AS r FROM members GROUP BY event_id, lineage_root) q GROUP BY event_id)"""


@query("mean_reliability", FACTS_SQL + ", " + _RELIABILITY + """
SELECT event_id, round(mean_reliability, 6) AS mean_reliability FROM reliability""")
def mean_reliability(spark, sf_dir):
    return O.lineage_support(members(spark, sf_dir)).select(
        "event_id", F.round("mean_reliability", 6).alias("mean_reliability"))


_OFFICIAL = "regexp_matches(lower({0}), '" + "|".join(V.OFFICIAL_WORDS) + "')"
_INPUTS = _RELIABILITY + f""",
agree AS (SELECT f.event_id, count(*) AS n_facts, count(*) FILTER (WHERE fact_type = 'number') AS numbers FROM facts f GROUP BY f.event_id),
contested AS (SELECT event_id, CAST(sum(contested) AS BIGINT) AS contested, count(*) AS conflict_count FROM disputes GROUP BY event_id),
totals AS (SELECT event_id, count(*) AS report_count, count(DISTINCT source_id) AS total_sources,
  bool_or({_OFFICIAL.format('source_name')}) AS official, max(retrieved_at) AS newest FROM members GROUP BY event_id),
inputs AS (SELECT t.*, r.chains, r.mean_reliability, coalesce(c.conflict_count, 0) AS conflict_count,
  (a.numbers - coalesce(c.contested, 0)) / a.numbers AS agreement, 1.0 - coalesce(c.contested, 0) / a.n_facts AS consistency,
  greatest(0.0, epoch_us(TIMESTAMP '{views.AS_OF_EVENTS}') - epoch_us(newest)) / 3.6e9 AS age_hours
  FROM totals t JOIN reliability r USING (event_id) JOIN agree a USING (event_id) LEFT JOIN contested c USING (event_id)),
scored AS (SELECT *, round(greatest(0.0, least(99.0, (0.45 * least(100.0, 100.0 * (1 - pow(0.6, least(chains, 5)))) + 0.20 * least(100.0, mean_reliability)
  + 0.20 * 100 * agreement + 0.15 * CASE WHEN official THEN 100 ELSE 0 END) * consistency
  * CASE WHEN age_hours > 24 THEN greatest(0.0, 1 - 0.06 * (age_hours - 24) / 24) ELSE 1 END
  * CASE WHEN conflict_count > 0 THEN pow(0.85, conflict_count) ELSE 1 END)), 2) AS confidence_score FROM inputs)
"""
SCORED_SQL = FACTS_SQL + ", " + _INPUTS


@query("event_agreement", SCORED_SQL + """
SELECT event_id, round(agreement, 6) AS agreement, round(consistency, 6) AS consistency, conflict_count FROM inputs""")
def event_agreement(spark, sf_dir):
    facts = O.aggregate_facts(members(spark, sf_dir))
    return O.event_agreement(facts, O.numeric_conflicts(facts)).select(
        "event_id", F.round("agreement", 6).alias("agreement"), F.round("consistency", 6).alias("consistency"),
        F.col("conflict_count").cast("bigint").alias("conflict_count"))


_CONF_BAND = "CASE WHEN {0} >= 95 THEN 'HIGHLY_CONFIRMED' WHEN {0} >= 85 THEN 'STRONGLY_SUPPORTED' WHEN {0} >= 70 THEN 'REASONABLY_SUPPORTED' WHEN {0} >= 50 THEN 'UNCERTAIN' ELSE 'DO_NOT_PUBLISH' END"


@query("confidence_scores", SCORED_SQL + f"""
SELECT event_id, report_count, total_sources, chains, official, confidence_score, {_CONF_BAND.format('confidence_score')} AS band,
  confidence_score >= 70 AS publishable FROM (SELECT * REPLACE (CAST(report_count AS BIGINT) AS report_count) FROM scored) s""")
def confidence_scores(spark, sf_dir):
    everyone = members(spark, sf_dir)
    scored = O.score_confidence(O.confidence_inputs(everyone, O.aggregate_facts(everyone), views.as_of_events()))
    return scored.select("event_id", "report_count", "total_sources", "chains", "official", "confidence_score",
                         S.confidence_band(F.col("confidence_score")).alias("band"),
                         S.is_publishable(F.col("confidence_score")).alias("publishable"))


_STATUS_SQL = """CASE WHEN confidence_score >= 70 AND conflict_count = 0 THEN 'VERIFIED' WHEN confidence_score < 50 THEN 'UNVERIFIED' ELSE 'VERIFYING' END"""


@query("verification_status", SCORED_SQL + f"""
SELECT event_id, CAST(conflict_count AS BIGINT) AS conflict_count, confidence_score, {_STATUS_SQL} AS status FROM scored""")
def verification_status(spark, sf_dir):
    return O.verify_events(members(spark, sf_dir), views.as_of_events()).select(
        "event_id", F.col("conflict_count").cast("bigint").alias("conflict_count"), "confidence_score", "status")


@query("verified_with_copies_collapsed")
def verified_with_copies_collapsed(spark, sf_dir):
    """Verification that also collapses near-identical headlines into one chain."""
    everyone = members(spark, sf_dir).withColumn("vec", hash_embedding(F.col("title")))
    return O.verify_events(everyone, views.as_of_events()).select(
        "event_id", "report_count", "chains", "conflict_count", "confidence_score", "status")


@query("independent_chains")
def independent_chains(spark, sf_dir):
    return O.independent_chains(members(spark, sf_dir).withColumn("vec", hash_embedding(F.col("title"))))


@query("confidence_input_violations", SCORED_SQL + """
SELECT event_id, 'agreement must be in [0, 1]' AS violations FROM inputs WHERE conflict_count > 0""")
def confidence_input_violations(spark, sf_dir):
    """Contract check on inputs whose agreement is shifted below zero by every conflict."""
    everyone = members(spark, sf_dir)
    inputs = O.confidence_inputs(everyone, O.aggregate_facts(everyone), views.as_of_events())
    shifted = inputs.withColumn("agreement", F.col("agreement") - 2 * F.least("conflict_count", F.lit(1)))
    return O.input_violations(shifted).select("event_id", F.array_join("violations", "; ").alias("violations"))


@query("official_sources", with_views("sources") + f"""
SELECT source_id, {_OFFICIAL.format('name')} AS official FROM sources""")
def official_sources(spark, sf_dir):
    return views.sources(spark, sf_dir).select("source_id", S.is_official(F.col("name")).alias("official"))


@query("lineage_roots", with_views("sources") + """
SELECT source_id, coalesce(lineage_root_id, source_id) AS lineage_root FROM sources""")
def lineage_roots(spark, sf_dir):
    return views.sources(spark, sf_dir).select(
        "source_id", O.lineage_root(F.col("lineage_root_id"), F.col("source_id")).alias("lineage_root"))


@query("event_timeline", SCORED_SQL + f"""
, firsts AS (SELECT event_id, arg_min(report_id, (retrieved_at, report_id)) AS first_id FROM members GROUP BY event_id)
SELECT m.event_id, strftime(m.retrieved_at, '{DATE}') AS occurred_at, CASE WHEN report_id = first_id THEN 'detected' ELSE 'report_added' END AS update_type,
  CASE WHEN report_id = first_id THEN 'Event first detected from ' || source_name ELSE 'New report attached from ' || left(title, 120) END AS summary, CAST(report_id AS VARCHAR) AS report_id
  FROM members m JOIN firsts USING (event_id)
UNION ALL
SELECT event_id, '{views.AS_OF_EVENTS}', 'verified', printf('Verified: %d independent source(s), %d conflict(s), confidence %.1f', chains, conflict_count, confidence_score), NULL FROM scored""")
def event_timeline(spark, sf_dir):
    everyone = members(spark, sf_dir)
    as_of = views.as_of_events()
    first = O.primary_reports(everyone.withColumn("is_primary", F.lit(False))).withColumn("is_primary", F.lit(True))
    edges = everyone.join(first, ["event_id", "report_id"], "left").withColumn(
        "is_primary", F.coalesce("is_primary", F.lit(False)))
    events = O.verify_events(everyone, as_of)
    return O.event_timeline(events, edges, as_of).withColumns(
        {"occurred_at": stamp("occurred_at"), "report_id": F.col("report_id").cast("string")})


@query("primary_reports", FACTS_SQL + """
SELECT event_id, arg_min(report_id, (report_id % 5 <> 0, retrieved_at, report_id)) AS report_id FROM members GROUP BY event_id""")
def primary_reports(spark, sf_dir):
    return O.primary_reports(members(spark, sf_dir).withColumn("is_primary", F.col("report_id") % 5 == 0))


@query("measure_words", """
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 <> 0 THEN event_type END AS measure FROM events""")
def measure_words(spark, sf_dir):
    """The measure of claim keys of several kinds and lengths; only whole number keys have one."""
    kind = F.element_at(F.array(F.lit("number"), F.lit("date"), F.lit("entity")), (F.col("event_id") % 3 + 1).cast("int"))
    key = F.concat_ws(":", kind, "event_type", F.col("user_id").cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit("more")))
    return table(spark, sf_dir, "events").select("event_id", FX.measure_of(key).alias("measure"))
