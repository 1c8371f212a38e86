"""Curves of scored predictions against MLlib's exact ones."""

import random

import pytest

from heatloom.operators.curves import curve_points, score_curve, scored_areas


def mllib_areas(spark, pairs):
    """Areas without binning, from the JVM class itself."""
    from pyspark.mllib.evaluation import BinaryClassificationMetrics

    found = BinaryClassificationMetrics(spark.sparkContext.parallelize(pairs))
    return found.areaUnderPR, found.areaUnderROC


@pytest.mark.parametrize("digits", [1, 6])
def test_areas_equal_mllib(spark, digits):
    rng = random.Random(digits)
    rows = [(m, int(rng.random() < 0.3), round(rng.random(), digits)) for m in "ab" for _ in range(300)]
    rows += [("b", 0, 0.5)] * 500  # one score that many rows share
    frame = spark.createDataFrame(rows, "model string, label int, score double").repartition(7)
    got = {r["model"]: (r["pr"], r["roc"]) for r in scored_areas(frame).collect()}
    for m in "ab":
        assert got[m] == pytest.approx(mllib_areas(spark, [(s, float(y)) for n, y, s in rows if n == m]))


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [("x", 1, 0.9), ("x", 0, 0.9), ("x", 1, 0.1), ("x", None, 0.5), ("x", 1, None), ("x", 0, nan), ("x", 1, 0.9),
            ("only_no", 0, 0.2), ("only_yes", 1, 0.2), (None, 1, -0.0), (None, 0, 0.0)]
    frame = spark.createDataFrame(rows, "model string, label int, score double")
    got = {r["model"]: (r["pr"], r["roc"]) for r in scored_areas(frame).collect()}
    assert got["x"] == pytest.approx((2 / 3 * 2 / 3 + 1 / 3 * (2 / 3 + 3 / 4) / 2, 1 / 3))
    assert got["only_no"] == (None, None) and got["only_yes"] == (1.0, None)
    assert got[None] == (0.5, 0.5)  # both zeros are one score
    points = [tuple(r)[1:] for r in curve_points(score_curve(frame)).filter("model = 'x'").orderBy("score").collect()]
    assert points == [pytest.approx((0.1, 1.0, 0.75, 1.0)), pytest.approx((0.9, 2 / 3, 2 / 3, 1.0))]
    assert scored_areas(frame.limit(0)).count() == 0
