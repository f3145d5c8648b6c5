"""Hand-computed values of the scoring formulas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from corrob.functions import scores as S


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("independent, official, conflicts, age, expected", [
    (1, False, 0, 0.0, 55.0), (3, True, 0, 0.0, 87.28), (0, False, 0, 0.0, 37.0),
    (1, False, 1, 0.0, 46.75), (1, False, 0, 48.0, 51.7), (9, True, 0, 0.0, 93.5),
])
def test_confidence(spark, independent, official, conflicts, age, expected):
    score = S.confidence_score(F.lit(independent), F.lit(85.0), F.lit(1.0), F.lit(conflicts), F.lit(age),
                               F.lit(official), F.lit(1.0))
    assert value(spark, score) == pytest.approx(expected, abs=0.01)


def importance(spark, kind, measures, locations, entities, updates, hours, official):
    pairs = [F.lit(x) for kv in measures.items() for x in kv]
    table = F.create_map(*pairs).cast("map<string,double>")
    return value(spark, S.importance_score(F.lit(kind), table, F.lit(locations), F.lit(entities), F.lit(updates),
                                           F.lit(hours), F.lit(official)))


def test_importance(spark):
    assert importance(spark, "sports", {}, 1, 1, 1, 48.0, False) == pytest.approx(14.10)
    major = importance(spark, "earthquake", {"magnitude": 7.8, "deaths": 240.0, "injured": 3000.0}, 6, 20, 3, 1.0, True)
    assert major == pytest.approx(86.95)
    assert importance(spark, None, {}, 0, 0, 0, 0.0, False) == pytest.approx(13.6)
    few, many = (importance(spark, "earthquake", {"deaths": n}, 1, 2, 1, 2.0, False) for n in (2.0, 200.0))
    assert many > few


def test_bands(spark):
    assert [value(spark, S.confidence_band(F.lit(x))) for x in (95, 85, 70, 50, 49.9)] == [
        "HIGHLY_CONFIRMED", "STRONGLY_SUPPORTED", "REASONABLY_SUPPORTED", "UNCERTAIN", "DO_NOT_PUBLISH"]
    assert [value(spark, S.importance_band(F.lit(x))) for x in (80, 60, 40, 39)] == [
        "major", "significant", "moderate", "minor"]


def test_recency_and_rank(spark):
    now = F.lit(dt.datetime(2025, 1, 2)).cast("timestamp")
    half = F.lit(dt.datetime(2025, 1, 1, 6)).cast("timestamp")
    later = F.lit(dt.datetime(2025, 1, 3)).cast("timestamp")
    assert value(spark, S.recency(half, now)) == pytest.approx(0.5)
    assert value(spark, S.recency(later, now)) == 1.0
    assert value(spark, S.recency(F.lit(None).cast("timestamp"), now)) == 0.0
    assert value(spark, S.rank_score(F.lit(200.0), F.lit(None), now, now, local=True)) == pytest.approx(77.0)


def test_backoff_and_window(spark):
    assert [value(spark, S.retry_backoff(F.lit(n))) for n in (1, 3, 9)] == [30.0, 120.0, 3600.0]
    a = F.lit(dt.datetime(2025, 1, 1)).cast("timestamp")
    b = F.lit(dt.datetime(2025, 1, 4)).cast("timestamp")
    assert value(spark, S.within_window(a, b)) and not value(spark, S.within_window(a, b, 71.9))
