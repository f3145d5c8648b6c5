"""Importance, evidence packages, draft validation and publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions import text as X
from corrob.functions.scores import hours_between, importance_score
from corrob.operators.folds import accepted_in_chunks, row_number_in_buckets
from corrob.operators.similarity import members_of
from corrob.operators.verify import with_measure


# --- importance --------------------------------------------------------------


def event_measures(facts: DataFrame) -> DataFrame:
    """(event_id, measures): largest current value of each measure, as a map."""
    current = with_measure(facts).filter(F.col("superseded_by").isNull() & F.col("measure").isNotNull()
                                         & F.col("value_numeric").isNotNull())
    largest = current.groupBy("event_id", "measure").agg(F.max("value_numeric").alias("v"))
    return largest.groupBy("event_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("measure", "v")))).alias("measures"))


def report_breadth(members: DataFrame) -> DataFrame:
    """(event_id, entity_count, update_count): distinct descriptions and reports."""
    # by hash: the texts themselves stay where they are
    texts = members.groupBy("event_id", F.md5("description").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return texts.groupBy("event_id").agg(F.count("text").alias("entity_count"), F.sum("n").alias("update_count"))


def score_importance(events: DataFrame, facts: DataFrame, members: DataFrame, as_of: Column) -> DataFrame:
    """Events with ``importance_score``; the only location an event has is its country."""
    j = events.drop("importance_score").join(event_measures(facts), "event_id", "left").join(
        report_breadth(members), "event_id", "left")
    measures = F.coalesce("measures", F.create_map().cast("map<string,double>"))
    deaths = F.coalesce(F.try_element_at(measures, F.lit("deaths")), F.lit(0.0)) + F.coalesce(
        F.try_element_at(measures, F.lit("killed")), F.lit(0.0))
    age = F.greatest(F.lit(0.0), hours_between(as_of, F.col("first_detected_at")))
    return j.withColumn("importance_score", importance_score(
        F.col("event_type"), measures, F.when(F.coalesce(F.col("country").cast("string"), F.lit("")) != "", 1).otherwise(0),
        F.coalesce("entity_count", F.lit(0)), F.coalesce("update_count", F.lit(0)), age, deaths > 0))


def importance_violations(inputs: DataFrame, counts: tuple[str, ...] = ("entity_count", "update_count")) -> DataFrame:
    """Rows whose counts break the scoring contract (must be >= 0)."""
    negative = F.array_compact(F.array(*[F.when(F.col(c) < 0, F.lit(c)) for c in counts]))
    return inputs.withColumn("violations", negative).filter(F.size("violations") > 0)


# --- evidence ----------------------------------------------------------------


def fact_sources(provenance: DataFrame, sources: DataFrame) -> DataFrame:
    """(event_id, fact_key, sources): sorted distinct names of who asserts each claim.

    Copies per (claim, source) go before the names are gathered.
    """
    pairs = provenance.select("event_id", "fact_key", "source_id").distinct()
    named = pairs.join(sources.select("source_id", "name"), "source_id")
    return named.groupBy("event_id", "fact_key").agg(F.array_sort(F.collect_set("name")).alias("sources"))


def attribution(members: DataFrame) -> DataFrame:
    """One row per (event, source): the first report supplies the link."""
    first = F.min(F.struct("retrieved_at", "report_id", "url", "source_name"))
    return members.groupBy("event_id", "source_id").agg(first.alias("f")).select(
        "event_id", "source_id", F.col("f.report_id").alias("report_id"), F.col("f.url").alias("url"),
        F.col("f.source_name").alias("source_name"), F.lit(True).alias("is_independent"))


def article_attribution(articles: DataFrame, members: DataFrame) -> DataFrame:
    """Sources section of every article."""
    return articles.select("article_id", "event_id").join(attribution(members), "event_id")


def evidence(events: DataFrame, facts: DataFrame, provenance: DataFrame, sources: DataFrame, conflicts: DataFrame,
             members: DataFrame | None = None, audience_country: str | None = None) -> DataFrame:
    """The evidence package of every event, one nested row each.

    Superseded claims are left out; claims with two or more independent chains
    are confirmed, others single-source; both sorted by (type, key).  Open
    conflicts are those without ``resolved_at``.
    """
    current = facts.filter(F.col("superseded_by").isNull()).join(
        fact_sources(provenance, sources), ["event_id", "fact_key"], "left")
    entry = F.struct("fact_type", "fact_key", F.col("statement").alias("fact"),
                     F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
                     F.col("independent_source_count").alias("independent_sources"), "last_confirmed_at")
    listed = current.groupBy("event_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    solid = lambda f: f["independent_sources"] >= V.SOLID_SUPPORT
    split = listed.select("event_id", F.filter("all", solid).alias("confirmed_facts"),
                          F.filter("all", lambda f: ~solid(f)).alias("single_source_facts"))
    still_open = conflicts.filter(F.col("resolved_at").isNull()) if "resolved_at" in conflicts.columns else conflicts
    claims = still_open.groupBy("event_id").agg(F.array_sort(F.collect_list("claim")).alias("conflicting_claims"))
    package = events.join(split, "event_id", "left").join(claims, "event_id", "left")
    if members is not None:
        named = attribution(members).groupBy("event_id", "source_name").agg(F.min("url").alias("url"))
        package = package.join(named.groupBy("event_id").agg(
            F.array_sort(F.collect_list(F.struct("source_name", "url"))).alias("attribution")), "event_id", "left")
    empty_facts = F.filter(F.col("confirmed_facts"), lambda f: F.lit(False))
    no_facts = F.coalesce(empty_facts, F.array().cast(dict(package.dtypes)["confirmed_facts"]))
    return package.withColumns({
        "confirmed_facts": F.coalesce("confirmed_facts", no_facts),
        "single_source_facts": F.coalesce("single_source_facts", no_facts),
        "conflicting_claims": F.coalesce("conflicting_claims", F.array().cast("array<string>")),
        "audience_country": F.lit(audience_country).cast("string")})


def _statements(package_column: str) -> Column:
    return F.transform(package_column, lambda f: f["fact"])


def evidence_text() -> Column:
    """All evidence as one lower-case text: title, facts, disputed claims."""
    return F.lower(F.array_join(F.concat(
        F.array(F.coalesce("title", F.lit(""))), _statements("confirmed_facts"), _statements("single_source_facts"),
        F.col("conflicting_claims")), " \n "))


def evidence_numbers() -> Column:
    """Distinct values in the facts' statements."""
    facts = F.concat(_statements("confirmed_facts"), _statements("single_source_facts"))
    return F.array_distinct(F.flatten(F.transform(facts, X.evidence_number_tokens)))


def compose_brief(packages: DataFrame) -> DataFrame:
    """An extractive draft from the confirmed facts alone."""
    title = F.trim(F.coalesce("title", F.lit("")))
    facts = F.filter(F.transform(_statements("confirmed_facts"), lambda s: F.trim(s)), lambda f: f != "")
    enough = (title != "") & (F.size("confirmed_facts") > 0)
    drafted = packages.withColumn("_facts", facts)
    lead = F.array_join(F.slice("_facts", 1, 4), " ")
    rest = F.when(F.size("_facts") > 4, F.array_join(F.slice("_facts", F.lit(5), F.size("_facts")), " "))
    disputed = F.when(F.size("conflicting_claims") > 0, F.concat(
        F.lit("Some details remain disputed: "), F.array_join("conflicting_claims", "; ")))
    body = F.concat_ws("\n\n", F.nullif(lead, F.lit("")), rest, disputed)
    none = F.array().cast("array<string>")
    return drafted.withColumns({
        "headline": title, "body": F.when(enough, body).otherwise(""),
        "key_points": F.when(enough, F.slice("_facts", 1, 5)).otherwise(none),
        "insufficient_evidence": ~enough,
        "seo_title": F.when(enough, F.nullif(F.substring(title, 1, 70), F.lit(""))),
        "seo_description": F.when(enough, F.substring(F.try_element_at("_facts", F.lit(1)), 1, 160)),
    }).drop("_facts")


# --- copying and validation --------------------------------------------------


def ngram_overlap(drafts: DataFrame, sources: DataFrame, n: int = V.COPY_NGRAM, within: str | None = None) -> DataFrame:
    """(draft_id, overlap): worst share of a draft's n-grams found in one source.

    ``drafts`` is (draft_id, text), ``sources`` (source_id, text); with
    ``within`` both also carry a column that must agree.  Distinct n-grams are
    compared by a 128-bit hash.  Those of the sources pass a filter of the
    drafts' n-grams where the texts are read, so only what is likely to be a
    hit is shuffled, and no text is; then equal source texts, known by their
    hash, are one.
    """
    scope = [within] if within else []

    def runs(df: DataFrame, ids: list) -> DataFrame:
        grams = X.ngrams(X.copy_tokens(F.col("text")), n)
        named = df.select(*ids, *scope, F.explode(grams).alias("g"))
        return named.withColumn("g", F.md5("g"))

    wanted = runs(drafts, ["draft_id"])
    offered = members_of(runs(sources, [F.sha2("text", 256).alias("source")]), wanted, ["g", *scope]).distinct()
    hits = wanted.join(offered, ["g", *scope]).groupBy("draft_id", "source").agg(F.count(F.lit(1)).alias("hits"))
    worst = hits.groupBy("draft_id").agg(F.max("hits").alias("hits"))
    totals = wanted.groupBy("draft_id").agg(F.count(F.lit(1)).alias("total"))
    scored = totals.join(worst, "draft_id", "left").select(
        "draft_id", (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("overlap"))
    return drafts.select("draft_id").join(scored, "draft_id", "left").withColumn(
        "overlap", F.coalesce("overlap", F.lit(0.0)))


def draft_text() -> Column:
    points = F.array_join(F.coalesce("key_points", F.array().cast("array<string>")), "\n")
    return F.concat(F.coalesce("headline", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")), F.lit("\n"), points)


def _listed(prefix: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(prefix), F.array_join(F.array_sort(values), ", ")))


def validate_drafts(drafts: DataFrame, packages: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Check every draft against its event's evidence -> ok, failures, warnings.

    ``drafts``: draft_id, event_id, headline, body, key_points and maybe
    insufficient_evidence; ``packages``: :func:`evidence`; ``sources``:
    event_id, source_id, text of the reports behind the event.
    """
    if "insufficient_evidence" not in drafts.columns:
        drafts = drafts.withColumn("insufficient_evidence", F.lit(False))
    proof = packages.select("event_id", evidence_text().alias("_proof"))
    j = drafts.join(proof, "event_id", "left").withColumn("_text", draft_text())
    if sources is not None:
        scoped = drafts.select("draft_id", "event_id", draft_text().alias("text"))
        j = j.join(ngram_overlap(scoped, sources, within="event_id"), "draft_id", "left")
    else:
        j = j.withColumn("overlap", F.lit(0.0))
    numbers = F.array_except(X.number_tokens(F.col("_text")), X.number_tokens(F.col("_proof")))
    names = F.filter(X.proper_nouns(F.col("_text")), lambda n: ~F.contains(F.col("_proof"), n))
    shown = F.transform(F.array_sort(numbers), lambda v: v.cast("string"))
    paragraphs = F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda p: F.lower(X.strip(p))),
                          lambda p: F.length(p) >= V.MIN_PARAGRAPH_CHARS)
    percent = F.format_number(F.col("overlap") * 100, 0)
    checks = F.array_compact(F.array(
        F.when(X.strip(F.coalesce("headline", F.lit(""))) == "", "missing headline"),
        F.when(X.strip(F.coalesce("body", F.lit(""))) == "", "missing body"),
        F.when(F.size(numbers) > 0, F.concat(F.lit("numbers not in evidence: "), F.array_join(shown, ", "))),
        F.when(F.col("_text").rlike(r"(?i)https?://[^\s)\]]+"), "article contains a URL; sources are attributed separately"),
        _listed("names not in evidence: ", names),
        F.when(F.size(F.array_distinct(paragraphs)) < F.size(paragraphs), "duplicated paragraph"),
        F.when(F.col("overlap") > V.MAX_COPY_OVERLAP, F.concat(
            F.lit("copies "), percent, F.lit("% of a source article (limit 30%)")))))
    failures = F.when(F.col("insufficient_evidence"), F.array(F.lit("writer reported insufficient evidence"))).otherwise(checks)
    warnings = F.when(~F.col("insufficient_evidence") & (F.length(F.coalesce("body", F.lit(""))) < V.SHORT_BODY_CHARS),
                      F.array(F.lit("short body"))).otherwise(F.array().cast("array<string>"))
    return j.withColumns({"failures": failures, "warnings": warnings}).withColumn(
        "ok", F.size("failures") == 0).drop("_proof", "_text", "overlap")


# --- publication -------------------------------------------------------------


def publish_gate(events: DataFrame, packages: DataFrame, validated: DataFrame, budget: DataFrame | None = None) -> DataFrame:
    """Add ``outcome`` (why an event is or is not published) and ``published``.

    ``budget`` is (event_id, admitted), from the hourly budget operator.
    """
    has_facts = (F.size("confirmed_facts") + F.size("single_source_facts")) > 0
    j = events.join(packages.select("event_id", has_facts.alias("_facts")), "event_id", "left").join(
        validated.select("event_id", "ok", F.array_join("failures", "; ").alias("_why")), "event_id", "left")
    j = j.join(budget.select("event_id", "admitted"), "event_id", "left") if budget is not None else j.withColumn("admitted", F.lit(True))
    score = lambda c: F.format_number(c, 1)
    floor = f" below publish floor {V.CONFIDENCE_FLOOR}"
    outcome = (
        F.when(F.col("confidence_score") < V.CONFIDENCE_FLOOR, F.concat(F.lit("confidence "), score("confidence_score"), F.lit(floor)))
        .when(F.col("conflict_count") > 0, F.concat(F.col("conflict_count").cast("string"), F.lit(" unresolved conflict(s); not publishing")))
        .when(F.col("importance_score") < V.IMPORTANCE_FLOOR, F.concat(
            F.lit("importance "), score("importance_score"), F.lit(f" below publish floor {V.IMPORTANCE_FLOOR}")))
        .when(~F.coalesce("_facts", F.lit(False)), "no facts to write from")
        .when(~F.coalesce("admitted", F.lit(True)), "hourly budget exhausted; deferring generation")
        .when(~F.coalesce("ok", F.lit(False)), F.concat(F.lit("validation failed: "), F.coalesce("_why", F.lit("no draft"))))
        .otherwise("published"))
    return j.withColumn("outcome", outcome).withColumn("published", F.col("outcome") == "published").drop(
        "_facts", "_why", "ok", "admitted")


def unique_slugs(articles: DataFrame, bucket: Column) -> DataFrame:
    """Add ``slug``: the headline's slug, then ``-2``, ``-3`` ... in order of ``article_id``.

    A suffixed name that some headline spells out itself is skipped, so slugs
    are unique whatever the headlines (longer numbers than 18 digits are out of
    any count's reach).  ``bucket`` grows with ``article_id``
    and splits the numbering of a very common headline.
    """
    based = articles.withColumn("base", X.slugify(F.col("headline")))
    numbered = row_number_in_buckets(based, "base", ["article_id"], bucket, "copy")
    bases = based.select("base").distinct()
    spelled = bases.filter(F.col("base").rlike("^.+-([2-9]|[1-9][0-9]{1,17})$")).select(
        F.regexp_extract("base", "^(.+)-([0-9]+)$", 1).alias("base"),
        F.regexp_extract("base", "^(.+)-([0-9]+)$", 2).cast("bigint").alias("taken"))
    taken = spelled.groupBy("base").agg(F.array_sort(F.collect_list("taken")).alias("taken"))
    suffix = F.aggregate(F.coalesce("taken", F.array().cast("array<bigint>")), F.col("copy").cast("bigint"),
                         lambda s, t: F.when(t <= s, s + 1).otherwise(s))
    return numbered.join(taken, "base", "left").withColumn(
        "slug", F.when(F.col("copy") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", suffix.cast("string")))).drop(
        "base", "copy", "taken")


def _changed_enough(last: Column, words: Column) -> Column:
    """Whether two word sets differ in enough of their union; null where there is no last one."""
    union = F.size(F.array_union(last, words))
    return F.when(last.isNull(), F.lit(None)).otherwise(F.element_at(F.transform(F.array(union), lambda n: (n > 0) & (
        (n - (F.size(last) + F.size(words) - n)) / n >= V.MIN_BODY_CHANGE)), 1))


def article_versions(drafts: DataFrame, chunk: Column) -> DataFrame:
    """Number the drafts that change an article enough: article_id, ord, body -> version.

    Each draft is compared with the last *accepted* one.  ``chunk`` (growing
    with ``ord``) cuts a history into pieces that are folded side by side.
    """
    worded = drafts.withColumn("words", F.array_sort(X.word_set(F.col("body"))))
    return accepted_in_chunks(worded, "article_id", ["ord"], chunk, "words", _changed_enough, "version")


def publish(gated: DataFrame, drafts: DataFrame, as_of: Column, locales: DataFrame | None = None) -> DataFrame:
    """Articles of the published events: one global edition, or one per (event, country) of ``locales``."""
    d = drafts.select("event_id", "headline", "body", "key_points", F.col("seo_title"), F.col("seo_description"))
    live = gated.filter("published").select("event_id", "event_type", "country", "confidence_score", "importance_score").join(d, "event_id")
    if locales is None:
        live = live.withColumn("locale_country", F.lit(None).cast("string"))
    else:
        live = live.join(locales.select("event_id", F.col("country_key").cast("string").alias("locale_country")), "event_id")
    name = F.concat_ws("|", F.col("event_id").cast("string"), F.coalesce("locale_country", F.lit("global")))
    return live.select(
        F.sha2(name, 256).alias("article_id"), "event_id", "locale_country", F.col("locale_country").isNull().alias("is_global"),
        "headline", "body", F.to_json("key_points").alias("key_points"), F.col("event_type").alias("category"),
        F.col("country").cast("string").alias("location"), "seo_title", "seo_description", "confidence_score",
        "importance_score", F.lit(1).alias("current_version"), F.lit(True).alias("is_published"), as_of.alias("published_at"))


def localize(gated: DataFrame, drafts: DataFrame, locales: DataFrame, as_of: Column) -> DataFrame:
    """One edition per (event, country), from the same evidence."""
    return publish(gated, drafts, as_of, locales)


def image_prompt(articles: DataFrame) -> DataFrame:
    """Add ``prompt`` and its ``prompt_hash`` from headline, location and category."""

    def filled(c: str, default: str) -> Column:
        return F.trim(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))

    subject = F.coalesce(F.nullif(F.trim(F.coalesce("headline", F.lit(""))), F.lit("")), F.lit("a world news event"))
    prompt = F.format_string(V.IMAGE_PROMPT, subject, filled("location", "unspecified location"),
                             filled("category", "general news"))
    return articles.withColumn("prompt", prompt).withColumn("prompt_hash", F.sha2("prompt", 256))
