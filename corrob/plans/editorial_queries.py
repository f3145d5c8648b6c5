"""Registered queries: importance, evidence, drafts, publication."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import text as X
from corrob.operators import editorial as O
from corrob.operators import verify as VO
from corrob.plans import views
from corrob.plans.registry import query
from corrob.plans.verify_queries import SCORED_SQL, members
from corrob.plans.views import sql_norm, table, with_views
from corrob.session import cut_lineage


class Desk:
    """The tables editorial work starts from, built over all reports."""

    def __init__(self, spark, sf_dir):
        self.as_of = views.as_of_events()
        self.members = members(spark, sf_dir).withColumn(
            "url", F.concat(F.lit("https://wire.example/"), F.col("report_id").cast("string")))
        self.sources = views.sources(spark, sf_dir)
        # claims are far fewer than reports; they are written once, as a pipeline would
        found = cut_lineage(VO.aggregate_facts(self.members))
        self.facts = VO.supersede(found)
        self.conflicts = VO.numeric_conflicts(found)
        head = F.min(F.struct("retrieved_at", "report_id", "title"))
        self.heads = self.members.groupBy("event_id").agg(head.alias("h")).select(
            "event_id", F.col("h.title").alias("title"), F.lit("earthquake").alias("event_type"),
            F.substring_index("event_id", "-", 1).alias("country"), F.col("h.retrieved_at").alias("first_detected_at"))

    def events(self):
        verified = VO.verify_events(self.members, self.as_of, facts=self.facts.drop("superseded_by"))
        return self.heads.join(verified.select("event_id", "confidence_score", "conflict_count", "status"), "event_id")

    def scored(self, as_of=None):
        return O.score_importance(self.events(), self.facts, self.members, as_of if as_of is not None else self.as_of)

    @cached_property
    def provenance(self):
        return VO.fact_provenance(self.members)

    @cached_property
    def packages(self):
        return cut_lineage(O.evidence(self.heads, self.facts, self.provenance, self.sources, self.conflicts))

    @cached_property
    def drafts(self):
        """A brief per event; by day, some get an invented number, name, link or repeated paragraph."""
        day = F.split("event_id", "-")[1].cast("int")
        brief = O.compose_brief(self.packages)
        extra = (F.when(day % 6 == 1, " In all 999 people gathered.")
                 .when(day % 6 == 2, " Yesterday spokesperson Yuki Tanaka spoke.")
                 .when(day % 6 == 3, " See https://fake.example/story now.")
                 .when(day % 6 == 4, "\n\nThe same long paragraph stands here twice over.\n\nThe same long paragraph stands here twice over.")
                 .otherwise(""))
        return cut_lineage(brief.select(
            "event_id", F.col("event_id").alias("draft_id"), "headline", F.concat("body", extra).alias("body"),
            "key_points", "insufficient_evidence", "seo_title", "seo_description"))

    def texts(self):
        return self.members.select("event_id", F.col("report_id").alias("source_id"),
                                   F.concat_ws(" ", "title", "description").alias("text"))


_EDIT = SCORED_SQL + f""",
ranked AS (SELECT *, first_value(fact_key) OVER (PARTITION BY event_id, measure ORDER BY last_confirmed_at DESC, independent_source_count DESC, fact_key) AS top FROM facts),
current AS (SELECT * FROM ranked WHERE measure IS NULL OR top = fact_key),
measures AS (SELECT event_id, measure, max(value_numeric) AS v FROM current WHERE measure IS NOT NULL GROUP BY event_id, measure),
m AS (SELECT event_id, max(v) FILTER (WHERE measure = 'deaths') AS deaths, max(v) FILTER (WHERE measure = 'injured') AS injured,
  max(v) FILTER (WHERE measure = 'magnitude') AS magnitude FROM measures GROUP BY event_id),
breadth AS (SELECT event_id, count(DISTINCT description) AS entities, count(*) AS updates, arg_min(title, (retrieved_at, report_id)) AS title,
  min(retrieved_at) AS first_at, min(place) AS country FROM members GROUP BY event_id),
h AS (SELECT *, CASE WHEN deaths < 1 THEN 0 ELSE least(100, 100 * log10(deaths) / 3) END AS hd,
  0.55 * CASE WHEN injured < 1 THEN 0 ELSE least(100, 100 * log10(injured) / 3) END AS hi FROM m JOIN breadth USING (event_id)),
names AS (SELECT event_id, fact_key, string_agg(DISTINCT source_name, ',' ORDER BY source_name) AS sources FROM mentions GROUP BY event_id, fact_key),
listed AS (SELECT c.*, n.sources, independent_source_count >= {V.SOLID_SUPPORT} AS confirmed,
  row_number() OVER (PARTITION BY event_id ORDER BY fact_type, fact_key) AS pos FROM current c JOIN names n USING (event_id, fact_key)),
parts AS (SELECT event_id, string_agg(statement, ' \n ' ORDER BY NOT confirmed, fact_type, fact_key) AS facts_text FROM listed GROUP BY event_id),
claims AS (SELECT event_id, string_agg(claim, ' \n ' ORDER BY claim) AS claims_text, string_agg(claim, '; ' ORDER BY claim) AS disputed FROM disputes GROUP BY event_id),
proof AS (SELECT event_id, lower(title || ' \n ' || facts_text || CASE WHEN claims_text IS NULL THEN '' ELSE ' \n ' || claims_text END) AS proof, disputed, title
  FROM breadth JOIN parts USING (event_id) LEFT JOIN claims USING (event_id))
"""


def _importance(as_of: str) -> str:
    return f"""round(0.34 * 78 + 0.24 * least(100, greatest(hd, hi) + least(hd, hi) / 3) + 0.14 * least(100, 100 * log10(magnitude))
  + 0.14 * greatest(40.0, least(100, 12.0 * entities)) + 0.14 * CASE WHEN (epoch_us({as_of}) - epoch_us(first_at)) / 3.6e9 > 6 THEN 0
    ELSE least(100, least(100, 25.0 * greatest(0, updates - 1)) + 25) END, 2)"""


_CLOCK = f"TIMESTAMP '{views.AS_OF_EVENTS}'"


@query("event_measures", _EDIT + "SELECT event_id, deaths, injured, magnitude FROM m")
def event_measures(spark, sf_dir):
    m = F.col("measures")
    return O.event_measures(Desk(spark, sf_dir).facts).select(
        "event_id", m["deaths"].alias("deaths"), m["injured"].alias("injured"), m["magnitude"].alias("magnitude"))


@query("importance_scores", _EDIT + f"""
SELECT event_id, entities AS entity_count, CAST(updates AS BIGINT) AS update_count, {_importance("TIMESTAMP '2024-01-16 00:00:00'")} AS importance_score FROM h""")
def importance_scores(spark, sf_dir):
    """Importance as of mid-month, so that later events are still developing."""
    desk = Desk(spark, sf_dir)
    scored = O.score_importance(desk.heads, desk.facts, desk.members, F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    return scored.select("event_id", "entity_count", "update_count", "importance_score")


@query("importance_input_violations", _EDIT + """
SELECT event_id, 'entity_count,update_count' AS violations FROM breadth WHERE updates > 80""")
def importance_input_violations(spark, sf_dir):
    """Contract check on counts turned negative for busy events."""
    breadth = O.report_breadth(members(spark, sf_dir))
    turned = F.when(F.col("update_count") > 80, -1).otherwise(1)
    broken = breadth.withColumns({"entity_count": F.col("entity_count") * turned, "update_count": F.col("update_count") * turned})
    return O.importance_violations(broken).select("event_id", F.array_join("violations", ",").alias("violations"))


@query("fact_sources", _EDIT + "SELECT event_id, fact_key, sources FROM names")
def fact_sources(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    return O.fact_sources(desk.provenance, desk.sources).withColumn("sources", F.array_join("sources", ","))


@query("attribution", _EDIT + """
SELECT event_id, source_id, min(report_id) AS report_id, 'https://wire.example/' || CAST(arg_min(report_id, (retrieved_at, report_id)) AS VARCHAR) AS url FROM
  (SELECT *, first_value(report_id) OVER (PARTITION BY event_id, source_id ORDER BY retrieved_at, report_id) AS f FROM members) q WHERE report_id = f GROUP BY event_id, source_id""")
def attribution(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    articles = desk.heads.withColumn("article_id", F.col("event_id"))
    return O.article_attribution(articles, desk.members).select("event_id", "source_id", "report_id", "url")


@query("evidence_packages", _EDIT + """
SELECT event_id, CASE WHEN confirmed THEN 'confirmed' ELSE 'single' END AS section, fact_key, statement AS fact, sources,
  independent_source_count AS independent_sources FROM listed""")
def evidence_packages(spark, sf_dir):
    packages = Desk(spark, sf_dir).packages

    def tag(column, section):
        return F.transform(column, lambda f: F.struct(F.lit(section).alias("section"), f.alias("f")))

    tagged = F.concat(tag("confirmed_facts", "confirmed"), tag("single_source_facts", "single"))
    return packages.select("event_id", F.explode(tagged).alias("x")).select(
        "event_id", "x.section", "x.f.fact_key", "x.f.fact", F.array_join("x.f.sources", ",").alias("sources"),
        "x.f.independent_sources")


@query("evidence_texts", _EDIT + """,
nums AS (SELECT DISTINCT event_id, CAST(unnest(regexp_extract_all(statement, '(\\d+(?:\\.\\d+)?)', 1)) AS DOUBLE) AS v FROM listed)
SELECT event_id, md5(proof) AS digest, (SELECT count(*) FROM nums n WHERE n.event_id = proof.event_id) AS numbers,
  (SELECT round(sum(v), 4) FROM nums n WHERE n.event_id = proof.event_id) AS total FROM proof""")
def evidence_texts(spark, sf_dir):
    numbers = O.evidence_numbers()
    return Desk(spark, sf_dir).packages.select("event_id", O.evidence_text().alias("t"), numbers.alias("n")).select(
        "event_id", F.md5("t").alias("digest"), F.size("n").cast("bigint").alias("numbers"),
        F.round(F.aggregate("n", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


_BRIEF = """,
confirmed AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY fact_type, fact_key) AS cpos FROM listed WHERE confirmed),
brief AS (SELECT p.event_id, trim(p.title) AS headline, coalesce(lead_, '') ||
  CASE WHEN rest IS NULL THEN '' ELSE chr(10) || chr(10) || rest END || CASE WHEN disputed IS NULL THEN '' ELSE chr(10) || chr(10) || 'Some details remain disputed: ' || disputed END AS body,
  points, lead_ IS NULL AS insufficient FROM proof p LEFT JOIN (SELECT event_id, string_agg(statement, ' ' ORDER BY cpos) FILTER (WHERE cpos <= 4) AS lead_,
    string_agg(statement, ' ' ORDER BY cpos) FILTER (WHERE cpos > 4) AS rest, string_agg(statement, '|' ORDER BY cpos) FILTER (WHERE cpos <= 5) AS points
    FROM confirmed GROUP BY event_id) c USING (event_id))
"""


@query("composed_briefs", _EDIT + _BRIEF + """
SELECT event_id, headline, CASE WHEN insufficient THEN '' ELSE body END AS body, coalesce(points, '') AS key_points, insufficient AS insufficient_evidence FROM brief""")
def composed_briefs(spark, sf_dir):
    return O.compose_brief(Desk(spark, sf_dir).packages).select(
        "event_id", "headline", "body", F.array_join("key_points", "|").alias("key_points"), "insufficient_evidence")


_VALID = _BRIEF + """,
dayed AS (SELECT brief.*, disputed IS NOT NULL AS contested, CAST(split_part(event_id, '-', 2) AS INT) % 6 AS variant FROM brief JOIN proof USING (event_id)),
verdicts AS (SELECT event_id, insufficient, CASE WHEN insufficient THEN 'writer reported insufficient evidence' ELSE
  -- a capital after text without a full stop counts as a name, as in "...japan Some details"
  array_to_string(list_filter([CASE WHEN variant = 1 THEN 'numbers not in evidence: 999.0' END,
    CASE WHEN variant = 3 THEN 'article contains a URL; sources are attributed separately' END,
    CASE WHEN variant = 2 AND contested THEN 'names not in evidence: some, tanaka, yuki' WHEN variant = 2 THEN 'names not in evidence: tanaka, yesterday, yuki'
      WHEN contested THEN 'names not in evidence: some' END,
    CASE WHEN variant = 4 THEN 'duplicated paragraph' END], lambda x: x IS NOT NULL), '; ') END AS failures,
  length(body) + CASE variant WHEN 1 THEN 28 WHEN 2 THEN 42 WHEN 3 THEN 36 WHEN 4 THEN 98 ELSE 0 END AS body_length FROM dayed)
"""


@query("validated_drafts", _EDIT + _VALID + """
SELECT event_id, failures = '' AS ok, failures, CASE WHEN NOT insufficient AND body_length < 200 THEN 'short body' ELSE '' END AS warnings FROM verdicts""")
def validated_drafts(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    return O.validate_drafts(desk.drafts, desk.packages, desk.texts()).select(
        "event_id", "ok", F.array_join("failures", "; ").alias("failures"), F.array_join("warnings", "; ").alias("warnings"))


_GATE = _VALID + f""",
gated AS (SELECT s.event_id, confidence_score, conflict_count, {_importance(_CLOCK)} AS importance_score, failures FROM scored s JOIN h USING (event_id) JOIN verdicts USING (event_id)),
outcomes AS (SELECT *, CASE WHEN confidence_score < 40 THEN 'low' WHEN conflict_count > 0 THEN CAST(conflict_count AS VARCHAR) || ' unresolved conflict(s); not publishing'
  WHEN importance_score < 30 THEN 'minor' WHEN failures <> '' THEN 'validation failed: ' || failures ELSE 'published' END AS outcome FROM gated)
"""


def gated(desk):
    """Events at the gate, their confidence moved up so that all gates are reached."""
    events = desk.scored().withColumn("confidence_score", F.col("confidence_score") + 30)
    return O.publish_gate(events, desk.packages, O.validate_drafts(desk.drafts, desk.packages, desk.texts()))


@query("publish_gate", _EDIT + _GATE + """
SELECT event_id, importance_score, CASE outcome WHEN 'low' THEN 'confidence' WHEN 'minor' THEN 'importance' ELSE outcome END AS outcome FROM outcomes""")
def publish_gate(spark, sf_dir):
    outcome = F.regexp_replace("outcome", "^(confidence|importance) .*$", "$1")
    return gated(Desk(spark, sf_dir)).select("event_id", "importance_score", outcome.alias("outcome"))


@query("published_articles", _EDIT + _GATE + """
SELECT sha256(event_id || '|global') AS article_id, event_id, headline, true AS is_global FROM outcomes JOIN brief USING (event_id) WHERE outcome = 'published'""")
def published_articles(spark, sf_dir):
    desk = Desk(spark, sf_dir)
    return O.publish(gated(desk), desk.drafts, desk.as_of).select("article_id", "event_id", "headline", "is_global")


@query("localized_editions", _EDIT + _GATE + """
SELECT sha256(event_id || '|' || CAST(n_nationkey AS VARCHAR)) AS article_id, event_id, CAST(n_nationkey AS VARCHAR) AS locale_country
FROM outcomes, nation WHERE outcome = 'published' AND n_nationkey = (CAST(split_part(event_id, '-', 2) AS INT)) % 25""")
def localized_editions(spark, sf_dir):
    """Editions for the one country each event is assigned by its day."""
    desk = Desk(spark, sf_dir)
    day = (F.split("event_id", "-")[1].cast("int") % 25).alias("country_key")
    locales = desk.heads.select("event_id", day).join(
        views.countries(spark, sf_dir).select("country_key"), "country_key", "left_semi")
    return O.localize(gated(desk), desk.drafts, locales, desk.as_of).select("article_id", "event_id", "locale_country")


def _grams(src: str) -> str:
    toks = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
    return f"""(SELECT DISTINCT id, array_to_string(toks[i : i + 7], ' ') AS g FROM (SELECT id, toks, unnest(generate_series(1, len(toks) - 7)) AS i
  FROM (SELECT id, {toks} AS toks FROM {src}) t WHERE len(toks) >= 8) u)"""


@query("ngram_contamination", f"""
WITH d AS {_grams('(SELECT doc_id AS id, text FROM documents)')}, b AS {_grams('(SELECT item_id AS id, text FROM benchmark)')},
hits AS (SELECT b.id, d.id AS doc, count(*) AS hits FROM b JOIN d USING (g) GROUP BY b.id, d.id),
worst AS (SELECT id, max(hits) AS hits FROM hits GROUP BY id), total AS (SELECT id, count(*) AS n FROM b GROUP BY id)
SELECT item_id AS draft_id, round(coalesce(hits / n, 0.0), 6) AS overlap FROM benchmark LEFT JOIN total ON total.id = item_id LEFT JOIN worst ON worst.id = item_id""")
def ngram_contamination(spark, sf_dir):
    """Worst 8-gram overlap of each benchmark passage with any one document."""
    drafts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("draft_id"), "text")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return O.ngram_overlap(drafts, sources).withColumn("overlap", F.round("overlap", 6))


@query("proper_noun_sets", """
SELECT c_custkey, array_to_string(list_sort(['minister', lower(c_mktsegment)]), ',') AS names FROM customer""")
def proper_noun_sets(spark, sf_dir):
    """Names inside a sentence count, sentence openers and names after brackets and colons do not."""
    text = F.concat(F.lit("Today prime Minister "), F.initcap(F.lower("c_mktsegment")), F.lit(" met. Nobody "), F.lower("c_name"),
                    F.lit(": Another (Osaka) Bob"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(F.array_sort(X.proper_nouns(text)), ",").alias("names"))


@query("unique_slugs", f"""
WITH a AS (SELECT p_partkey AS article_id, CASE WHEN p_partkey % 100 = 7 THEN p_name || ' 2' ELSE p_name END AS headline FROM part),
b AS (SELECT *, replace({sql_norm('headline')}, ' ', '-') AS base FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY article_id) AS copy FROM b),
t AS (SELECT DISTINCT regexp_extract(base, '^(.+)-2$', 1) AS stem FROM b WHERE regexp_matches(base, '-2$'))
SELECT article_id, CASE WHEN copy = 1 THEN base ELSE base || '-' || CAST(copy + CASE WHEN base IN (SELECT stem FROM t) THEN 1 ELSE 0 END AS VARCHAR) END AS slug FROM n""")
def unique_slugs(spark, sf_dir):
    """Slugs of part names, of which some spell out a suffix themselves."""
    k = F.col("p_partkey")
    articles = table(spark, sf_dir, "part").select(
        k.alias("article_id"), F.when(k % 100 == 7, F.concat("p_name", F.lit(" 2"))).otherwise(F.col("p_name")).alias("headline"))
    return O.unique_slugs(articles, F.floor(F.col("article_id") / 1000)).select("article_id", "slug")


@query("article_versions", f"""
WITH RECURSIVE w AS (SELECT conv_id AS article_id, turn AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  list_distinct(list_filter(string_split({sql_norm('text')}, ' '), lambda x: x <> '')) AS words FROM conversations),
j AS (SELECT article_id, ord, k, words AS last, true AS fresh FROM w WHERE k = 1
  UNION ALL SELECT article_id, ord, k, CASE WHEN fresh THEN words ELSE last END, fresh FROM (
    SELECT w.article_id, w.ord, w.k, w.words, j.last, len(list_distinct(list_concat(w.words, j.last))) AS n,
      n > 0 AND (n - len(list_intersect(w.words, j.last))) / n >= {V.MIN_BODY_CHANGE} AS fresh
    FROM j JOIN w ON w.article_id = j.article_id AND w.k = j.k + 1) q)
SELECT article_id, ord, row_number() OVER (PARTITION BY article_id ORDER BY ord) AS version FROM j WHERE fresh""")
def article_versions(spark, sf_dir):
    """Turns of a conversation as successive drafts of one article."""
    drafts = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("article_id"), F.col("turn").alias("ord"), F.col("text").alias("body"))
    return O.article_versions(drafts, F.floor(F.col("ord") / 4)).select("article_id", "ord", "version")


@query("image_prompts", with_views("articles") + f"""
SELECT article_id, prompt, sha256(prompt) AS prompt_hash FROM (SELECT article_id, printf('{V.IMAGE_PROMPT}', headline, 'unspecified location',
  CASE WHEN is_global THEN 'world' ELSE 'general news' END) AS prompt FROM articles) q""")
def image_prompts(spark, sf_dir):
    articles = views.articles(spark, sf_dir).withColumns({
        "location": F.lit(None).cast("string"), "category": F.when(F.col("is_global"), "world").otherwise("")})
    return O.image_prompt(articles).select("article_id", "prompt", "prompt_hash")
