"""Source health, operational and accuracy metrics, maintenance, quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corrob import fixed_values as V
from corrob.functions.scores import is_active


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


# --- source health -----------------------------------------------------------


def bucketed_rank(rows: DataFrame, key: str, order: list[str], bucket: Column) -> DataFrame:
    """Add ``from_end``: how many later rows the key has (0 for its last).

    A window over the whole key would sort a hot key in one task.  Here rows
    are ranked inside (key, bucket) and the sizes of the later buckets are
    added, so only the short list of a key's buckets is ordered at once.
    ``bucket`` must grow with the first order column.
    """
    dealt = rows.withColumn("_bucket", bucket)
    sizes = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("n"))
    later = Window.partitionBy(key).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n").over(later), F.lit(0))).drop("n")
    inside = Window.partitionBy(key, "_bucket").orderBy(*[F.desc(c) for c in order])
    ranked = dealt.withColumn("_inside", F.row_number().over(inside) - 1)
    return ranked.join(offsets, [key, "_bucket"]).withColumn(
        "from_end", F.col("_inside") + F.col("offset")).drop("_inside", "offset", "_bucket")


def latency_parts(polls: DataFrame) -> DataFrame:
    """(source_id, samples, blend, oldest): what a stretch of polls does to the moving average.

    An average ``a`` before the stretch becomes ``0.7^samples * a + blend``; at
    the start ``oldest``, the first sample, stands for ``a``.  The weight of a
    sample depends only on the number of later ones, so this is an ordinary
    aggregate, and stretches can be joined end to end.
    """
    samples = polls.filter(F.col("latency_ms").isNotNull())
    hour = F.floor(micros(F.col("checked_at")) / 3_600_000_000)
    ranked = bucketed_rank(samples, "source_id", ["checked_at", "poll_id"], hour)
    keep = 1.0 - V.LATENCY_SMOOTHING
    weight = F.pow(F.lit(keep), F.col("from_end").cast("double"))
    sums = ranked.groupBy("source_id").agg(
        F.sum(V.LATENCY_SMOOTHING * weight * F.col("latency_ms")).alias("blend"),
        F.max(F.struct("from_end", "latency_ms")).alias("first"))
    return sums.select("source_id", (F.col("first.from_end") + 1).cast("double").alias("samples"), "blend",
                       F.col("first.latency_ms").alias("oldest"))


def _average(before: Column) -> Column:
    """The moving average after a stretch with the columns of ``latency_parts``."""
    faded = F.pow(F.lit(1.0 - V.LATENCY_SMOOTHING), F.col("samples"))
    return F.col("blend") + faded * F.coalesce(before, F.col("oldest"))


def ewma_latency(polls: DataFrame) -> DataFrame:
    """(source_id, avg_latency_ms): the first sample, then each new one blended in."""
    return latency_parts(polls).select("source_id", _average(F.lit(None)).alias("avg_latency_ms"))


def failure_streaks(polls: DataFrame) -> DataFrame:
    """(source_id, success_count, failure_count, consecutive_failures and last times).

    The current streak is what failed after the last success: two aggregates
    with map-side combine and a join by source, no window.
    """
    at = F.struct("checked_at", "poll_id")
    totals = polls.groupBy("source_id").agg(
        F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"),
        F.max(F.when(F.col("ok"), at)).alias("ok_at"), F.max(F.when(~F.col("ok"), at)).alias("bad_at"),
        F.max(F.struct(at.alias("at"), "ok", F.substring("error", 1, 2000).alias("error"))).alias("last"))
    failures = polls.filter(~F.col("ok")).select("source_id", at.alias("at"))
    since = failures.join(totals.select("source_id", "ok_at"), "source_id").filter(
        F.col("ok_at").isNull() | (F.col("at") > F.col("ok_at")))
    streak = since.groupBy("source_id").agg(F.count(F.lit(1)).alias("consecutive_failures"))
    return totals.join(streak, "source_id", "left").select(
        "source_id", "success_count", "failure_count",
        F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"),
        F.col("ok_at.checked_at").alias("last_success_at"), F.col("bad_at.checked_at").alias("last_failure_at"),
        F.col("last.at.checked_at").alias("last_checked_at"), F.col("last.ok").alias("last_ok"),
        F.when(~F.col("last.ok"), F.col("last.error")).alias("last_error"))


def _status() -> Column:
    """A source without a running streak of failures was last polled with success."""
    slow = F.coalesce(F.col("avg_latency_ms") > V.SLOW_LATENCY_MS, F.lit(False))
    return (F.when(F.col("consecutive_failures") == 0, F.when(slow, "degraded").otherwise("healthy"))
            .when(F.col("consecutive_failures") >= V.DOWN_AFTER, "down").otherwise("degraded"))


def source_health(polls: DataFrame) -> DataFrame:
    """Health of every polled source, folded from the poll log."""
    folded = failure_streaks(polls).join(ewma_latency(polls), "source_id", "left")
    return folded.withColumn("status", _status()).drop("last_ok")


def continue_health(health: DataFrame, polls: DataFrame) -> DataFrame:
    """``health`` (of ``source_health``) after more polls, which count as later than all before.

    Polls are summed up by source first, so a source with a third of them
    costs no more than another, and one row a source meets one row a source.
    """
    more = failure_streaks(polls).join(latency_parts(polls), "source_id", "left")
    was = health.select("source_id", F.struct(*[c for c in health.columns if c != "source_id"]).alias("was"))
    j = was.join(more, "source_id", "full")

    def added(c: str) -> Column:
        return (F.coalesce(F.col(f"was.{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c)

    def later(c: str) -> Column:
        return F.greatest(F.col(f"was.{c}"), F.col(c)).alias(c)

    polled = F.col("last_ok").isNotNull()
    streak = F.when(F.col("success_count") > 0, F.col("consecutive_failures")).otherwise(added("consecutive_failures"))
    average = F.when(F.col("samples").isNull(), F.col("was.avg_latency_ms")).otherwise(_average(F.col("was.avg_latency_ms")))
    folded = j.select("source_id", added("success_count"), added("failure_count"), streak.alias("consecutive_failures"),
                      later("last_success_at"), later("last_failure_at"), later("last_checked_at"),
                      F.when(polled, F.col("last_error")).otherwise(F.col("was.last_error")).alias("last_error"),
                      average.alias("avg_latency_ms"))
    return folded.withColumn("status", _status()).select(*health.columns)


def source_health_report(sources: DataFrame, health: DataFrame, status: str | None = None,
                         worst_first: bool = False) -> DataFrame:
    """Every source with its health; never polled is ``unknown`` with zero counts.

    ``worst_first`` orders by status descending with unknown first, then slug.
    """
    j = sources.join(health, "source_id", "left")
    if status:
        j = j.filter(F.col("status") == status)
    if worst_first:
        j = j.orderBy(F.desc_nulls_first("status"), "slug")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("consecutive_failures", "success_count", "failure_count")]
    return j.select("slug", "name", "enabled", "is_international", F.coalesce("status", F.lit("unknown")).alias("status"),
                    *counts, "avg_latency_ms", "last_success_at", "last_failure_at", "last_error")


def overdue_sources(sources: DataFrame, health: DataFrame, as_of: Column) -> DataFrame:
    """Enabled sources whose next poll is due; failing ones wait up to eight intervals."""
    j = sources.filter("enabled").join(health.drop("status"), "source_id", "left")
    patience = F.least(F.greatest(F.coalesce("consecutive_failures", F.lit(0)), F.lit(1)), F.lit(V.MAX_BACKOFF_MULTIPLIER))
    wait = F.make_dt_interval(secs=(F.col("poll_interval_seconds") * patience).cast("decimal(18,6)"))
    last = F.coalesce("last_success_at", "last_failure_at")
    due = F.when(last.isNull(), as_of).otherwise(last + wait)
    return j.withColumn("next_due", due).filter(F.col("next_due") <= as_of)


# --- snapshots: one conditional-aggregate pass per table ----------------------


def _rows(df: DataFrame, section: str) -> DataFrame:
    """Unpivot a one-row frame of counters into (section, metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])
    return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")


def _by(df: DataFrame, column: str, section: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")).select(
        F.lit(section).alias("section"), "metric", "value")


def offline_sources(sources: DataFrame, health: DataFrame) -> DataFrame:
    """Names of enabled sources that are down, in order."""
    return sources.filter("enabled").join(health.filter(F.col("status") == "down").select("source_id"),
                                          "source_id", "left_semi").select("name").orderBy("name")


def ops_snapshot(sources: DataFrame, health: DataFrame, reports: DataFrame, events: DataFrame, edges: DataFrame,
                 jobs: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(section, metric, value): the operational picture, one scan per table."""
    hour, day = as_of - F.expr("INTERVAL 1 HOUR"), as_of - F.expr("INTERVAL 24 HOURS")
    state = sources.select("source_id", "enabled").join(health.select("source_id", "status"), "source_id", "left")
    bucket = F.lower(F.coalesce("status", F.lit("unknown")))
    parts = [
        _rows(state.agg(F.count(F.lit(1)).alias("total"), F.count_if("enabled").alias("enabled"),
                        *[F.count_if(bucket == s).alias(s) for s in ("healthy", "degraded", "down", "unknown")]), "sources"),
        _rows(reports.agg(F.count(F.lit(1)).alias("reports_total"), F.count_if(F.col("retrieved_at") >= hour).alias("reports_last_hour"),
                          F.count_if(F.col("retrieved_at") >= day).alias("reports_last_24h"),
                          F.count_if(F.col("status") == "DUPLICATE").alias("duplicates_total"),
                          F.count_if(F.col("status") == "FAILED").alias("failed_reports_total")), "ingestion"),
        _rows(events.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("first_detected_at") >= day).alias("created_last_24h")), "events"),
        _by(events, "status", "events_by_status"),
        _rows(edges.agg(F.count(F.lit(1)).alias("merged_reports_total")), "events"),
        _rows(jobs.agg(F.count_if(F.col("status") == "DEAD").alias("dead_total"),
                       F.count_if((F.col("attempts") > 1) & (F.col("updated_at") >= hour)).alias("failures_last_hour"),
                       F.coalesce(F.max("attempts"), F.lit(0)).alias("max_attempts_seen")), "jobs"),
        _by(jobs, "status", "queue"),
        _rows(articles.agg(F.count_if("is_published").alias("articles_published")), "articles"),
    ]
    return _stack(parts)


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def duplicate_publications(articles: DataFrame) -> DataFrame:
    """(event_id, published): events with more than one published article."""
    return articles.filter("is_published").groupBy("event_id").agg(F.count(F.lit(1)).alias("published")).filter(
        F.col("published") > 1)


def accuracy_snapshot(articles: DataFrame, versions: DataFrame, conflicts: DataFrame, events: DataFrame,
                      as_of: Column, floor: float = V.CONFIDENCE_FLOOR) -> DataFrame:
    """One row: how accurate what was published turned out to be."""
    live = F.col("is_published")
    parts = [
        articles.agg(F.count_if(live).alias("articles_published"),
                     F.count_if(live & (F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS"))).alias("articles_published_24h"),
                     F.count_if(live & (F.col("confidence_score") < floor)).alias("low_confidence_publications")),
        versions.agg(F.count_if(F.col("version") > 1).alias("corrections")),
        conflicts.agg(F.count_if(F.col("status") == "unresolved").alias("source_conflicts_open")),
        events.agg(F.count_if(F.col("status") == "EDITORIAL_REVIEW").alias("editorial_review")),
        duplicate_publications(articles).agg(F.count(F.lit(1)).alias("duplicate_publications")),
    ]
    row = _one_row(parts)
    failures = F.col("corrections") + F.col("editorial_review")
    attempts = F.col("articles_published") + failures
    return row.withColumn("fact_validation_failures", failures).withColumn(
        "rejection_rate", F.when(attempts > 0, F.round(failures / attempts, 4)).otherwise(0.0)).withColumn(
        "confidence_floor", F.lit(float(floor))).drop("editorial_review")


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put one-row frames side by side, joined on a constant key."""
    keyed = [p.withColumn("_one", F.lit(1)) for p in parts]
    out = keyed[0]
    for part in keyed[1:]:
        out = out.join(part, "_one")
    return out.drop("_one")


def ingestion_stats(reports: DataFrame, health: DataFrame, jobs: DataFrame, as_of: Column) -> DataFrame:
    hour, day = as_of - F.expr("INTERVAL 1 HOUR"), as_of - F.expr("INTERVAL 24 HOURS")
    return _stack([
        _rows(reports.agg(F.count(F.lit(1)).alias("reports_total"), F.count_if(F.col("retrieved_at") >= hour).alias("reports_last_hour"),
                          F.count_if(F.col("retrieved_at") >= day).alias("reports_last_24h"),
                          F.count_if(F.col("status") == "DUPLICATE").alias("duplicates_total")), "reports"),
        _rows(health.agg(*[F.count_if(F.col("status") == s).alias(f"sources_{s}")
                           for s in ("healthy", "degraded", "down", "unknown")]), "sources"),
        _by(jobs, "status", "queue")])


def intelligence_stats(events: DataFrame, facts: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(section, metric, value): how much is verified, conflicted or uncertain."""
    shipped = F.col("status").isin("PUBLISHED", "UPDATING")
    return _stack([
        _rows(events.agg(
            F.count(F.lit(1)).alias("events_total"), F.count_if(F.col("status") == "VERIFIED").alias("events_verified"),
            F.count_if(F.col("status") == "UNVERIFIED").alias("events_unverified"),
            F.count_if(F.col("conflict_count") > 0).alias("events_with_conflicts"),
            F.round(F.avg("confidence_score"), 2).alias("mean_confidence"),
            F.count_if(shipped & (F.col("confidence_score") < V.CONFIDENCE_FLOOR)).alias("low_confidence_published")), "events"),
        _by(events, "status", "events_by_status"),
        _rows(facts.agg(F.count(F.lit(1)).alias("facts_total")), "facts"),
        _rows(conflicts.agg(F.count(F.lit(1)).alias("conflicts_total"),
                            F.count_if(F.col("status") == "unresolved").alias("conflicts_unresolved")), "conflicts")])


def queue_depth(jobs: DataFrame, job_type: str | None = None) -> DataFrame:
    rows = jobs.filter(F.col("job_type") == job_type) if job_type else jobs
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("jobs"))


def count_active(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(is_active(F.col("status"), for_maintenance=True)).alias("active_events"))


#: Relative rank error of the quantile sketch is one in this number.
ACCURACY = 10_000


def nearest_ranks(rows: DataFrame, column: str, indexes: list[int], room: int = 100_000) -> dict[int, float]:
    """The values at zero-based ``indexes`` of the sorted column; nulls are left out, an index beyond the end is missing.

    A mergeable quantile sketch brackets each rank, a pass counts exactly what
    lies below and inside the bracket, and so on until it holds at most
    ``room`` different values; those are counted and cumulated.  Nothing else
    is ordered, whatever the number of rows, bins or equal values.
    """
    x, brackets, small = F.col(column), dict.fromkeys(set(indexes), (None, None)), {}

    def inside(bracket) -> Column:
        low, high = bracket
        return x.isNotNull() if low is None else x.between(low, high)

    while brackets:
        aggregates = []
        for i, bracket in brackets.items():
            aggregates += [F.count_if(x < bracket[0] if bracket[0] is not None else F.lit(False)).alias(f"below{i}"),
                           F.count_if(inside(bracket)).alias(f"inside{i}"),
                           F.approx_count_distinct(F.when(inside(bracket), x)).alias(f"values{i}")]
        known, sketches = rows.agg(*aggregates).first().asDict(), []
        for i, bracket in list(brackets.items()):
            below, n = known[f"below{i}"], known[f"inside{i}"]
            if i >= below + n:  # beyond the end
                del brackets[i]
            elif known[f"values{i}"] <= room // 2 or bracket[0] is not None and bracket[0] == bracket[1]:
                small[i] = (*brackets.pop(i), below)
            else:
                around = [min(1.0, max(0.0, (i - below + side) / n + side * 2 / ACCURACY)) for side in (-1, 1)]
                sketches.append(F.percentile_approx(F.when(inside(bracket), x), around, ACCURACY).alias(f"sketch{i}"))
        if not brackets:
            break
        narrowed = rows.agg(*sketches).first().asDict()
        for i, bracket in list(brackets.items()):
            low, high = narrowed[f"sketch{i}"]
            if (low, high) == bracket:  # a value of very many rows beside the wanted one
                small[i] = (*brackets.pop(i), known[f"below{i}"])
            else:
                brackets[i] = (low, high)
    found = {}
    for i, (low, high, below) in small.items():
        values = rows.filter(inside((low, high))).groupBy(x.alias("x")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("x")) + below  # at most ``room`` rows, about
        hit = values.withColumn("upto", upto).filter(F.col("upto") > i).agg(F.min("x")).first()[0]
        found[i] = hit
    return found


def latency_summary(requests: DataFrame, percentiles=(50, 90, 95, 99)) -> DataFrame:
    """One row: exact nearest-rank percentiles, maximum, mean, error rate and request rate.

    ``requests``: latency_ms, failed, at.
    """
    span = (F.max(micros(F.col("at"))) - F.min(micros(F.col("at")))) / 1e6
    totals = requests.agg(F.count(F.lit(1)).alias("requests"), F.max("latency_ms").alias("max_ms"),
                          F.round(F.avg("latency_ms"), 6).alias("mean_ms"),
                          F.round(F.try_divide(F.count_if("failed"), F.count(F.lit(1))), 6).alias("error_rate"),
                          F.round(F.try_divide(F.count(F.lit(1)), span), 6).alias("requests_per_second"))
    n = requests.select(F.count("latency_ms")).first()[0]
    index = {p: round(p / 100 * (n - 1)) for p in percentiles} if n else {}
    found = nearest_ranks(requests, "latency_ms", list(index.values()))
    kind = requests.schema["latency_ms"].dataType
    return totals.select("*", *[F.lit(found.get(index.get(p))).cast(kind).alias(f"p{p}_ms") for p in percentiles])


def supported_countries(countries: DataFrame, mappings: DataFrame) -> DataFrame:
    """Countries with support as their mapping says; mapped but unlisted ones are added by code."""
    by_country = mappings.groupBy("country_key").agg(F.max("enabled").alias("mapped_enabled"))
    j = countries.join(by_country, "country_key", "full_outer")
    return j.select("country_key", F.coalesce("name", F.col("country_key").cast("string")).alias("name"),
                    F.when(F.col("name").isNull() & F.col("mapped_enabled").isNotNull(), True)
                    .otherwise(F.coalesce("mapped_enabled", F.lit(False))).alias("is_supported"))


def reconcile(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(table, rows_a, rows_b, status): counts and an order-free content hash of two copies."""
    parts = []
    for name, sides in pairs.items():
        summed = []
        for tag, df in zip("ab", sides):
            digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
            summed.append(df.agg(F.count(F.lit(1)).alias(f"rows_{tag}"), digest.alias(f"hash_{tag}")))
        same = (F.col("rows_a") == F.col("rows_b")) & F.col("hash_a").eqNullSafe(F.col("hash_b"))
        parts.append(_one_row(summed).select(
            F.lit(name).alias("table"), "rows_a", "rows_b", F.when(same, "OK").otherwise("FAIL").alias("status")))
    return _stack(parts)


# --- maintenance and quotas --------------------------------------------------


def archive_stale(events: DataFrame, as_of: Column, hours: int = V.STALE_EVENT_HOURS) -> DataFrame:
    """Active events quiet for longer than ``hours`` become ARCHIVED as of now."""
    quiet = micros(as_of) - micros(F.col("last_updated_at")) > hours * 3_600_000_000
    stale = is_active(F.col("status"), for_maintenance=True) & quiet
    return events.withColumns({
        "last_updated_at": F.when(stale, as_of).otherwise(F.col("last_updated_at")),
        "status": F.when(stale, "ARCHIVED").otherwise(F.col("status"))})


def prune_jobs(jobs: DataFrame, as_of: Column, days: int = V.JOB_RETENTION_DAYS) -> DataFrame:
    """What retention keeps: everything but successes older than ``days``."""
    old = micros(as_of) - micros(F.col("updated_at")) > days * 86_400_000_000
    return jobs.filter(~((F.col("status") == "SUCCEEDED") & old))


def expired(images: DataFrame, as_of: Column) -> DataFrame:
    return images.filter(F.col("expires_at").isNotNull() & (F.col("expires_at") <= as_of))


def admit_first(requests: DataFrame, keys: list[str], limit: Column, max_limit: int, order: list[str]) -> DataFrame:
    """Add ``admitted``: the first ``limit`` rows of each key in order.

    The ranked window is cut at ``max_limit`` on the map side before it
    shuffles, and the verdict returns by the unique row id (last order
    column), so a key with a third of all rows costs no more than another.
    """
    row_id = order[-1]
    window = Window.partitionBy(*keys).orderBy(*order)
    first = requests.withColumn("_limit", limit).select(*keys, *order, "_limit").withColumn(
        "_rank", F.row_number().over(window)).filter(F.col("_rank") <= max_limit)
    winners = first.filter(F.col("_rank") <= F.col("_limit")).select(row_id, F.lit(True).alias("admitted"))
    return requests.join(winners, row_id, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def admit_hourly(requests: DataFrame, limit: int = V.HOURLY_BUDGET) -> DataFrame:
    """Budget per epoch hour over ``at``, ``request_id``; no limit when it is not positive."""
    hour = F.floor(micros(F.col("at")) / 3_600_000_000)
    rows = requests.withColumn("hour", hour)
    if limit <= 0:
        return rows.withColumn("admitted", F.lit(True))
    return admit_first(rows, ["hour"], F.lit(limit), limit, ["at", "request_id"])


def admit_window(requests: DataFrame, per_minute: int = V.REQUESTS_PER_MINUTE,
                 admin_per_minute: int = V.ADMIN_REQUESTS_PER_MINUTE) -> DataFrame:
    """Fixed one-minute quota per client; admin paths have their own, ``/health`` is exempt.

    The counter is shared by all of a client's paths; the limit that applies
    is that of the path asked for.
    """
    exempt = F.col("path") == "/health"
    counted = requests.filter(~exempt).withColumn("minute", F.floor(micros(F.col("at")) / 60_000_000))
    limit = F.when(F.startswith("path", F.lit("/admin")), admin_per_minute).otherwise(per_minute)
    judged = admit_first(counted, ["client", "minute"], limit, max(per_minute, admin_per_minute), ["at", "request_id"])
    free = requests.filter(exempt).withColumn("minute", F.lit(None).cast("bigint")).withColumn("admitted", F.lit(True))
    return judged.unionByName(free)
