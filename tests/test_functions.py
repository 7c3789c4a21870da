from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from engramic.functions import numeric as N
from engramic.functions import scores as X
from engramic.functions import vectors as V


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def ts(text):
    return F.lit(text).cast("timestamp")


@pytest.mark.parametrize("x", [-2.0, -0.3, 0.0, 0.5, 1.7])
def test_erf(spark, x):
    assert one(spark, N.erf(F.lit(x))) == pytest.approx(math.erf(x), abs=2e-7)


def test_inverse_and_cdf(spark):
    assert one(spark, F.lit(math.sqrt(2)) * N.erf_inv(F.lit(0.9))) == pytest.approx(1.644670, abs=1e-6)
    assert one(spark, N.normal_cdf(F.lit(0.0))) == pytest.approx(0.5)


@pytest.mark.parametrize(("x", "want"), [(None, 0.5), (0.0, 0.5), (float("nan"), 0.5), (2.0, 2.0)])
def test_or_default(spark, x, want):
    assert one(spark, N.or_default(F.lit(x).cast("double"), 0.5)) == want


def test_safe_division(spark):
    assert one(spark, N.safe_div(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, N.half_up(F.lit(-0.5))) == 0


@pytest.mark.parametrize(("a", "b", "want"), [([1, 0], [1, 0], 1.0), ([1, 0], [0, 1], 0.0), ([0, 0], [1, 1], 0.0), ([1, 2], [1, 2, 3], 0.0), ([3, 4], [-3, -4], -1.0)])
def test_cosine(spark, a, b, want):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    assert one(spark, V.cosine(lit(a), lit(b))) == pytest.approx(want)


def test_sets_and_distance(spark):
    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    assert one(spark, V.jaccard(arr("a", "b"), arr("b", "c"))) == pytest.approx(1 / 3)
    assert one(spark, V.jaccard(arr(), arr())) == 0.0
    assert one(spark, V.euclidean(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))) == 5.0


def test_neural_weights_are_fixed(spark):
    w = V.neural_weights(F.lit(0.5), F.lit(0.5), F.lit(7))
    a, b = one(spark, w), one(spark, w)
    assert a == b and len(a) == 128 and a[0] >= math.tanh(0.5) and a[1] <= math.tanh(0.0) + 1e-9


def test_decay_and_importance(spark):
    s = X.decayed(F.lit(1.0), F.lit(0.01), F.lit(7.0), F.lit(0), F.lit(0.5))
    assert one(spark, s) == pytest.approx(0.906667, abs=1e-6)
    assert one(spark, X.decayed(F.lit(1.0), F.lit(0.01), F.lit(7.0), F.lit(0), F.lit(0.0))) == pytest.approx(0.1)
    assert one(spark, X.importance(F.lit(0.5), F.lit(1.0), F.lit(0), F.lit(0))) == pytest.approx(0.5)


@pytest.mark.parametrize(("e", "want"), [([], 0.3), (["joy"], 0.6), (["joy", "fear"], 0.7)])
def test_emotions(spark, e, want):
    assert one(spark, X.emotional(F.array(*[F.lit(x) for x in e]).cast("array<string>"))) == pytest.approx(want)


def test_day_labels(spark):
    assert one(spark, X.day_part(ts("2024-01-06 05:59:00"))) == "night"
    assert one(spark, X.day_context(ts("2024-01-06 05:00:00"))) == "morning_context"
    assert one(spark, X.day_kind(ts("2024-01-06 05:00:00"))) == "weekend"
    assert one(spark, X.access_labels(F.lit(51), ts("2024-01-01"), ts("2024-01-04"))) == ["medium_frequency", "weekly_access"]
    assert one(spark, X.access_labels(F.lit(None).cast("int"), F.lit(None).cast("timestamp"), ts("2024-01-04"))) == ["low_frequency", "recently_accessed"]


def test_labels_and_view(spark):
    assert one(spark, X.strength_label(F.lit(-0.5))) == "moderate"
    assert one(spark, X.trend_label(F.lit(0.05))) == "stable"
    assert one(spark, X.health_status(F.lit(0.95), 0.7, 0.9)) == "healthy"
    assert one(spark, X.cluster_colour(F.lit(0.5), F.lit(0.25))) == "rgb(127, 127, 191)"
    assert one(spark, X.preview(F.lit("x" * 120))) == "x" * 100 + "..."
    assert one(spark, X.date_label(F.lit(dt.date(2024, 1, 5)))) == "1/5"


def test_cache_value_never_divides_by_zero(spark):
    assert one(spark, X.cache_value(F.lit(0), F.lit(0.0), F.lit(10.0), F.lit(10))) > 1e200


def test_pool_scores(spark):
    assert one(spark, X.clamped_priority(F.lit(12))) == 10
    assert one(spark, X.predicted_completion(F.lit(10))) == 7500.0
    assert one(spark, X.scaled_pool(F.lit(4), F.lit(100), F.lit(0.9), F.lit(0.9))) == 8
    assert one(spark, X.health_after(F.lit(1.0), F.lit(True), F.lit(False))) == 0.9
