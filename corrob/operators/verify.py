"""Multi-source verification: claims, conflicts, independence, confidence.

``members`` is one row per (event, report): event_id, report_id, source_id,
title, description, retrieved_at, lineage_root, reliability_score, source_name
and maybe a sparse headline vector ``vec``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.facts import measure_of, report_facts
from corrob.functions.scores import confidence_score, hours_between, is_official
from corrob.functions.text import display_number
from corrob.operators.similarity import bucket_ranks, lexically_first, prefix_join, prefix_of, salted_lookup
from corrob.session import cut_lineage

_FACT_FIELDS = ["fact_type", "statement", "value_numeric", "value_text"]


def lineage_root(declared: Column, own: Column) -> Column:
    """Reporting chain of a source: its declared root, else itself."""
    return F.coalesce(declared, own)


def event_members(edges: DataFrame, reports: DataFrame, sources: DataFrame) -> DataFrame:
    """Membership edges with their report and source; inner on both."""
    described = sources.select(
        "source_id", F.col("name").alias("source_name"), "reliability_score",
        lineage_root(F.col("lineage_root_id"), F.col("source_id")).alias("lineage_root"))
    return edges.join(reports, "report_id").join(described, "source_id")


def _text_id() -> Column:
    return F.md5(F.concat_ws("\u0001", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))


def _facts_of_texts(members: DataFrame) -> DataFrame:
    """(text_id, facts): extraction, once per distinct text."""
    texts = members.select(_text_id().alias("text_id"), "title", F.coalesce("description", F.lit("")).alias("description"))
    distinct = texts.groupBy("text_id").agg(F.max(F.struct("title", "description")).alias("t"))
    return distinct.select("text_id", report_facts(F.col("t.title"), F.col("t.description")).alias("facts"))


def aggregate_facts(members: DataFrame) -> DataFrame:
    """One row per (event, claim) with its support.

    Copies of a text are merged per (event, text, chain) on the map side, the
    facts of each distinct text are extracted once, and both meet in a salted
    lookup: a report that a third of the feeds repeat is one row of each.
    """
    order = F.struct("retrieved_at", "report_id")
    texts = members.groupBy("event_id", _text_id().alias("text_id"), "lineage_root").agg(
        F.count(F.lit(1)).alias("reports"), F.max("retrieved_at").alias("last"), F.min(order).alias("first"))
    found = salted_lookup(texts, _facts_of_texts(members), ["text_id"], ["event_id", "lineage_root"], how="inner")
    found = found.select("event_id", "lineage_root", "reports", "last", "first", F.explode("facts").alias("f"))
    chains = found.groupBy("event_id", F.col("f.fact_key").alias("fact_key"), "lineage_root").agg(
        F.sum("reports").alias("reports"), F.max("last").alias("last"),
        F.min(F.struct("first", *[F.col(f"f.{c}").alias(c) for c in _FACT_FIELDS])).alias("head"))
    return chains.groupBy("event_id", "fact_key").agg(
        F.sum("reports").alias("source_count"), F.count(F.lit(1)).alias("independent_source_count"),
        F.max("last").alias("last_confirmed_at"), F.min("head").alias("head")).select(
        "event_id", "fact_key", *[F.col(f"head.{c}").alias(c) for c in _FACT_FIELDS],
        F.col("head.first.retrieved_at").alias("first_seen_at"), "last_confirmed_at", "source_count",
        "independent_source_count")


def fact_provenance(members: DataFrame) -> DataFrame:
    """(event_id, fact_key, source_id): which source asserts which claim, once each."""
    texts = members.select("event_id", "source_id", _text_id().alias("text_id")).distinct()
    found = salted_lookup(texts, _facts_of_texts(members), ["text_id"], ["event_id", "source_id"], how="inner")
    return found.select("event_id", "source_id", F.explode(F.transform("facts", lambda f: f["fact_key"])).alias(
        "fact_key")).distinct()


def merge_facts(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Refresh stored facts: first sight kept, counts overwritten, confirmation only moves on."""
    o, n = old.alias("o"), new.alias("n")
    merged = o.join(n, ["event_id", "fact_key"], "full_outer")

    def newest(name: str) -> Column:
        return F.coalesce(F.col(f"n.{name}"), F.col(f"o.{name}"))

    return merged.select(
        "event_id", "fact_key", *[F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in _FACT_FIELDS],
        F.coalesce(F.col("o.first_seen_at"), as_of).alias("first_seen_at"),
        F.greatest("o.last_confirmed_at", "n.last_confirmed_at").alias("last_confirmed_at"),
        newest("source_count").alias("source_count"),
        newest("independent_source_count").alias("independent_source_count"))


def with_measure(facts: DataFrame) -> DataFrame:
    return facts.withColumn("measure", measure_of(F.col("fact_key")))


def numeric_conflicts(facts: DataFrame, tolerance: float = V.CONFLICT_TOLERANCE) -> DataFrame:
    """(event_id, measure, claim, contested): measures whose values spread beyond the tolerance.

    The claim lists every value in order with its independent support.
    """
    numbers = with_measure(facts).filter(F.col("measure").isNotNull() & F.col("value_numeric").isNotNull())
    grouped = numbers.groupBy("event_id", "measure").agg(
        F.min("value_numeric").alias("low"), F.max("value_numeric").alias("high"),
        F.count(F.lit(1)).alias("contested"),
        F.array_sort(F.collect_list(F.struct("value_numeric", "independent_source_count"))).alias("values"))
    spread = F.when(F.col("high") != 0, (F.col("high") - F.col("low")) / F.col("high")).otherwise(0.0)
    shown = F.transform("values", lambda v: F.concat(
        display_number(v["value_numeric"]), F.lit(" ("), v["independent_source_count"].cast("string"),
        F.lit(" independent)")))
    claim = F.concat(F.lit("sources disagree on "), "measure", F.lit(": "), F.array_join(shown, ", "))
    return grouped.filter((F.col("high") > F.col("low")) & (spread > tolerance)).select(
        "event_id", "measure", claim.alias("claim"), "contested")


def merge_conflicts(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Conflict life cycle by (event, claim text); ``measure`` tells reworded claims apart from settled ones.

    A settled claim that is found again stays as it was, with its resolution.
    """
    reason = F.col("resolution") if "resolution" in old.columns else F.when(F.col("resolved_at").isNotNull(), "sources now agree")
    o = old.select("event_id", "claim", "measure", "detected_at", "resolved_at", reason.alias("reason"), F.lit(True).alias("was"))
    n = new.select("event_id", "claim", F.col("measure").alias("new_measure"), F.lit(True).alias("now"))
    j = o.join(n, ["event_id", "claim"], "full_outer")
    settled = F.col("now").isNull()
    return j.select(
        "event_id", "claim", F.coalesce("measure", "new_measure").alias("measure"),
        F.when(settled | (F.col("was") & F.col("resolved_at").isNotNull()), "resolved").otherwise("unresolved").alias("status"),
        F.coalesce("detected_at", as_of).alias("detected_at"),
        F.when(settled, F.coalesce("resolved_at", as_of)).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.coalesce("reason", F.when(settled, "sources now agree")).alias("resolution"))


def supersede(facts: DataFrame) -> DataFrame:
    """Add ``superseded_by``: the newest (then best supported) claim of the same measure, NULL on that claim."""
    measured = with_measure(facts)
    dominant = measured.filter(F.col("measure").isNotNull()).groupBy("event_id", "measure").agg(
        F.min(F.struct((-F.unix_micros(F.col("last_confirmed_at").cast("timestamp"))).alias("t"),
                       (-F.col("independent_source_count")).alias("n"), "fact_key")).alias("top")).select(
        "event_id", "measure", F.col("top.fact_key").alias("dominant"))
    joined = measured.join(dominant, ["event_id", "measure"], "left")
    return joined.withColumn(
        "superseded_by", F.when(F.col("dominant") != F.col("fact_key"), F.col("dominant"))).drop("dominant", "measure")


def event_agreement(facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(event_id, agreement, consistency, conflict_count) from facts and their contested measures."""
    totals = facts.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if(F.col("fact_type") == "number").alias("numbers"))
    disputed = conflicts.groupBy("event_id").agg(
        F.sum("contested").alias("contested"), F.count(F.lit(1)).alias("conflict_count"))
    j = totals.join(disputed, "event_id", "left")
    contested = F.coalesce("contested", F.lit(0))
    agreement = F.when(F.col("numbers") > 0, (F.col("numbers") - contested) / F.col("numbers")).otherwise(1.0)
    return j.select("event_id", agreement.alias("agreement"),
                    (1.0 - contested / F.col("facts")).alias("consistency"),
                    F.coalesce("conflict_count", F.lit(0)).alias("conflict_count"))


def lineage_support(members: DataFrame) -> DataFrame:
    """(event_id, chains, mean_reliability): distinct chains, each rated by its first report's source."""
    per_chain = members.groupBy("event_id", "lineage_root").agg(
        F.min(F.struct("retrieved_at", "report_id", "reliability_score")).alias("first"))
    return per_chain.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("chains"), F.avg("first.reliability_score").alias("mean_reliability"))


def independent_chains(members: DataFrame, threshold: float = V.NEAR_DUPLICATE_COSINE) -> DataFrame:
    """(event_id, chains): distinct lineage roots after near-duplicate headlines collapse.

    In order of (retrieved_at, report_id) a report is a copy when an earlier
    *kept* one has a cosine of at least ``threshold``; reports without a vector
    are always kept.  Equal vectors collapse first, by a map-side minimum; the
    ordered selection then runs over the near pairs of distinct vectors only,
    in parallel rounds, so no event is ever gathered in one task.
    """
    order = F.struct("retrieved_at", "report_id")
    blank = F.col("vec").isNull() | (F.size("vec") == 0)
    always = members.filter(blank).select("event_id", "lineage_root")
    distinct = members.filter(~blank).groupBy("event_id", "vec").agg(
        F.min(F.struct(order.alias("ord"), "lineage_root")).alias("head")).select(
        "event_id", "vec", F.col("head.ord").alias("ord"), F.col("head.lineage_root").alias("lineage_root"),
        F.col("head.ord.report_id").alias("id"))
    distinct = cut_lineage(distinct)
    ready = prefix_of(distinct, bucket_ranks(distinct), threshold, "id")
    near = prefix_join(ready, ready, threshold, same=["event_id"], condition=F.col("ord") < F.col("ord_r"))
    kept = lexically_first(distinct, near.select(F.col("id").alias("earlier"), F.col("id_r").alias("later")))
    roots = distinct.join(kept, "id").select("event_id", "lineage_root").unionByName(always)
    return roots.distinct().groupBy("event_id").agg(F.count(F.lit(1)).alias("chains"))


def confidence_inputs(members: DataFrame, facts: DataFrame, as_of: Column) -> DataFrame:
    """Everything the confidence score needs, one row per event."""
    # (event, source) first: a source with a third of all reports stays cheap to count
    per_source = members.groupBy("event_id", "source_id").agg(
        F.count(F.lit(1)).alias("reports"), F.max("retrieved_at").alias("newest"),
        F.max(is_official(F.col("source_name"))).alias("official"))
    totals = per_source.groupBy("event_id").agg(
        F.sum("reports").alias("report_count"), F.count(F.lit(1)).alias("total_sources"),
        F.max("official").alias("official"), F.max("newest").alias("newest"))
    chains = lineage_support(members)
    if "vec" in members.columns:
        chains = chains.drop("chains").join(independent_chains(members), "event_id")
    agreement = event_agreement(facts, numeric_conflicts(facts))
    return (totals.join(chains, "event_id").join(agreement, "event_id", "left")
            .withColumn("agreement", F.coalesce("agreement", F.lit(1.0)))
            .withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
            .withColumn("conflict_count", F.coalesce("conflict_count", F.lit(0)))
            .withColumn("age_hours", F.greatest(F.lit(0.0), hours_between(as_of, F.col("newest")))))


def input_violations(inputs: DataFrame) -> DataFrame:
    """Rows that break the scoring contract (negative counts, shares outside 0-1)."""
    bad = F.array_compact(F.array(
        F.when(F.col("chains") < 0, "independent_sources must be >= 0"),
        F.when(~F.col("agreement").between(0, 1), "agreement must be in [0, 1]"),
        F.when(~F.col("consistency").between(0, 1), "factual_consistency must be in [0, 1]")))
    return inputs.withColumn("violations", bad).filter(F.size("violations") > 0)


def score_confidence(inputs: DataFrame) -> DataFrame:
    return inputs.withColumn("confidence_score", confidence_score(
        F.col("chains"), F.col("mean_reliability"), F.col("agreement"), F.col("conflict_count"),
        F.col("age_hours"), F.col("official"), F.col("consistency")))


def next_status(status: Column, confidence: Column, conflicts: Column, reconsider: bool = False) -> Column:
    """State after verification.  UNVERIFIED is final unless ``reconsider``."""
    movable = V.OPEN_STATUSES + (["UNVERIFIED"] if reconsider else [])
    moved = (F.when((confidence >= V.CONFIDENCE_FLOOR) & (conflicts == 0), "VERIFIED")
             .when(confidence < V.UNVERIFIED_BELOW, "UNVERIFIED").otherwise("VERIFYING"))
    return F.when(status.isin(movable), moved).otherwise(status)


def verify_events(members: DataFrame, as_of: Column, statuses: DataFrame | None = None,
                  facts: DataFrame | None = None, reconsider: bool = False) -> DataFrame:
    """Verified state per event: counts, confidence and status.

    ``statuses`` is (event_id, status) of events known before; others are new.
    """
    facts = aggregate_facts(members) if facts is None else facts
    scored = score_confidence(confidence_inputs(members, facts, as_of))
    if statuses is not None:
        scored = scored.join(statuses.select("event_id", "status"), "event_id", "left")
        scored = scored.withColumn("status", F.coalesce("status", F.lit("DETECTED")))
    else:
        scored = scored.withColumn("status", F.lit("DETECTED"))
    return scored.withColumn("status", next_status(
        F.col("status"), F.col("confidence_score"), F.col("conflict_count"), reconsider)).withColumn(
        "last_updated_at", as_of)


def event_timeline(events: DataFrame, edges: DataFrame, as_of: Column) -> DataFrame:
    """Append-only history rows: detection, every report added, verification.

    ``edges``: event_id, report_id, is_primary, source_name, title,
    retrieved_at; ``events``: output of :func:`verify_events`.
    """
    primary = F.col("is_primary")
    joined = edges.select(
        "event_id", F.col("retrieved_at").alias("occurred_at"),
        F.when(primary, "detected").otherwise("report_added").alias("update_type"),
        F.when(primary, F.concat(F.lit("Event first detected from "), "source_name"))
        .otherwise(F.concat(F.lit("New report attached from "), F.substring("title", 1, 120))).alias("summary"),
        "report_id")
    verified = events.select(
        "event_id", as_of.alias("occurred_at"), F.lit("verified").alias("update_type"),
        F.format_string("Verified: %d independent source(s), %d conflict(s), confidence %s",
                        "chains", "conflict_count", F.format_number("confidence_score", 1)).alias("summary"),
        F.lit(None).cast("bigint").alias("report_id"))
    return joined.unionByName(verified)


def primary_reports(edges: DataFrame) -> DataFrame:
    """The report an event's signals come from: marked primary, else the earliest."""
    head = F.min(F.struct(F.when(F.col("is_primary"), 0).otherwise(1).alias("p"), "retrieved_at", "report_id"))
    return edges.groupBy("event_id").agg(head.alias("h")).select("event_id", F.col("h.report_id").alias("report_id"))
