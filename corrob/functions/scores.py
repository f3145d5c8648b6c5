"""Score, band and predicate column functions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from corrob import fixed_values as V


def clamp(c: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def hours_between(later: Column, earlier: Column) -> Column:
    """Exact hours from ``earlier`` to ``later`` (negative when reversed)."""
    later, earlier = later.cast("timestamp"), earlier.cast("timestamp")
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def within_window(a: Column, b: Column, hours: float = V.EVENT_WINDOW_HOURS) -> Column:
    return F.abs(hours_between(a, b)) <= hours


def _bands(c: Column, cutoffs, lowest: str) -> Column:
    expr = F.when(c >= cutoffs[0][0], cutoffs[0][1])
    for floor, name in cutoffs[1:]:
        expr = expr.when(c >= floor, name)
    return expr.otherwise(lowest)


def confidence_band(c: Column) -> Column:
    return _bands(c, V.CONFIDENCE_BANDS, V.CONFIDENCE_LOWEST_BAND)


def importance_band(c: Column) -> Column:
    return _bands(c, V.IMPORTANCE_BANDS, V.IMPORTANCE_LOWEST_BAND)


def is_publishable(c: Column, floor: float = V.CONFIDENCE_FLOOR) -> Column:
    return c >= floor


def is_public(status: Column) -> Column:
    return status.isin(V.PUBLIC_STATUSES)


def is_active(status: Column, for_maintenance: bool = False) -> Column:
    """Still evolving.  Maintenance also counts events in editorial review."""
    return status.isin(V.MAINTAINED_STATUSES if for_maintenance else V.ACTIVE_STATUSES)


def is_official(name: Column) -> Column:
    return F.coalesce(F.lower(name).rlike("|".join(V.OFFICIAL_WORDS)), F.lit(False))


def recency(ts: Column, as_of: Column, half_life: float = V.RECENCY_HALF_LIFE_HOURS) -> Column:
    """Halves every ``half_life`` hours; 0 when unknown, 1 when in the future."""
    age = F.greatest(F.lit(0.0), hours_between(as_of, ts))
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(0.5), age / half_life))


def rank_score(importance: Column, confidence: Column, published_at: Column, as_of: Column,
               local: bool = False) -> Column:
    w = V.RANK_WEIGHTS
    base = (
        w["importance"] * clamp(F.coalesce(importance, F.lit(0.0)))
        + w["confidence"] * clamp(F.coalesce(confidence, F.lit(0.0)))
        + w["recency"] * 100.0 * recency(published_at, as_of)
    )
    return base * V.LOCAL_BONUS if local else base


def confidence_score(independent: Column, reliability: Column, agreement: Column, conflicts: Column,
                     age_hours: Column, official: Column, consistency: Column) -> Column:
    """Saturating, reliability-weighted trust in an event's facts, 0-99."""
    w = V.CONFIDENCE_WEIGHTS
    reached = F.least(independent, F.lit(V.INDEPENDENT_TARGET)).cast("double")
    support = F.when(independent <= 0, 0.0).otherwise(
        F.least(F.lit(100.0), 100.0 * (1.0 - F.pow(F.lit(V.INDEPENDENT_MISS), reached)))
    )
    blend = (
        w["independent"] * support
        + w["reliability"] * clamp(reliability)
        + w["agreement"] * 100.0 * agreement
        + w["official"] * F.when(official, 100.0).otherwise(0.0)
    )
    days_stale = (age_hours - V.STALE_GRACE_HOURS) / 24.0
    decay = F.when(
        age_hours > V.STALE_GRACE_HOURS,
        F.greatest(F.lit(0.0), 1.0 - V.STALE_LOSS_PER_DAY * days_stale),
    ).otherwise(1.0)
    penalty = F.when(conflicts > 0, F.pow(F.lit(V.CONFLICT_FACTOR), conflicts.cast("double"))).otherwise(1.0)
    return F.round(clamp(blend * consistency * decay * penalty, 0.0, V.CONFIDENCE_CAP), 2)


def severity(event_type: Column) -> Column:
    """Intrinsic severity by event type."""
    table = F.create_map(*[F.lit(x) for kv in V.TYPE_SEVERITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(event_type)), F.lit(V.DEFAULT_SEVERITY))


def _log_share(value: Column, ceiling: float) -> Column:
    span = F.log10(F.lit(ceiling))
    share = F.least(F.lit(100.0), 100.0 * F.log10(value) / span)
    return F.when(value >= 1.0, share).when(value < 1.0, 0.0)


def harm(measures: Column) -> Column:
    """Worst harm measure in full plus a third of every other, capped at 100."""
    terms = []
    for name, weight in V.HARM_MEASURES.items():
        value = F.try_element_at(measures, F.lit(name))
        terms.append(F.coalesce(_log_share(value, V.HARM_CEILING) * weight, F.lit(0.0)))
    worst = F.greatest(*terms)
    return F.least(F.lit(100.0), worst + (reduce(add, terms) - worst) / 3.0)


def physical_scale(measures: Column) -> Column:
    values = [_log_share(F.try_element_at(measures, F.lit(m)), V.SCALE_CEILING) for m in V.SCALE_MEASURES]
    return F.coalesce(F.greatest(*values), F.lit(0.0))


def importance_score(event_type: Column, measures: Column, locations: Column, entities: Column,
                     updates: Column, hours_since_first: Column, official_action: Column) -> Column:
    """How much an event matters, 0-100, from its type, harm, scale, reach and pace."""
    w = V.IMPORTANCE_WEIGHTS
    scope = F.greatest(F.least(F.lit(100.0), 40.0 * locations), F.least(F.lit(100.0), 12.0 * entities))
    pace = F.least(F.lit(100.0), 25.0 * F.greatest(F.lit(0), updates - 1))
    pace = F.when(official_action, F.least(F.lit(100.0), pace + 25.0)).otherwise(pace)
    pace = F.when(hours_since_first > V.DEVELOPING_HOURS, 0.0).otherwise(pace)
    total = (
        w["severity"] * severity(event_type)
        + w["harm"] * harm(measures)
        + w["scale"] * physical_scale(measures)
        + w["scope"] * scope
        + w["developing"] * pace
    )
    return F.round(clamp(total), 2)


def combined_similarity(cosine: Column, entities: Column, numbers: Column, type_a: Column,
                        type_b: Column) -> Column:
    """Clustering score from a cosine, two Jaccard shares and two event types."""
    score = (
        V.WEIGHT_SEMANTIC * F.greatest(F.lit(0.0), F.coalesce(cosine, F.lit(0.0)))
        + V.WEIGHT_ENTITY * entities
        + V.WEIGHT_NUMBER * numbers
    )
    differ = type_a.isNotNull() & type_b.isNotNull() & (type_a != type_b)
    return F.when(cosine.isNull(), 0.0).when(differ, score * V.TYPE_MISMATCH_PENALTY).otherwise(score)


def retry_backoff(attempts: Column) -> Column:
    """Seconds before the next attempt."""
    doubled = V.RETRY_BASE_SECONDS * F.pow(F.lit(2.0), attempts - 1)
    return F.least(doubled, F.lit(float(V.RETRY_CAP_SECONDS)))


def poll_bucket(ts: Column, seconds: Column) -> Column:
    """Start (epoch seconds) of the polling interval a time falls in."""
    epoch = F.unix_seconds(ts.cast("timestamp"))
    return epoch - F.pmod(epoch, F.greatest(seconds, F.lit(1)))
