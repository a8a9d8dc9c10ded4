"""Published example values of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.functions import kernels
from ocutide.operators import correlation, features, fit, landmarks, metadata

LEFT_Y = [15.39929676055908, 26.77018928527832, 40.02022171020508, 54.1110496520996, 67.9448471069336, 80.32972717285156]
RIGHT_Y = [81.576363, 76.221619, 72.655701, 69.304802, 64.227875, 57.023861, 49.117550, 42.331360, 37.262333, 32.985798, 28.144085, 22.177107, 15.572393, 9.2089672]


def signal(spark, values):
    return spark.createDataFrame([("r", "c", i, float(v)) for i, v in enumerate(values)], "rec_id string, ch string, i bigint, v double")


def value(spark, expr):
    return spark.range(1).select(expr).first()[0]


def arr(values):
    return F.array(*map(F.lit, map(float, values)))


@pytest.mark.parametrize("values, peak, want", [
    ([0.5, -0.4, -0.3, 0.2, 0.4, 0.5, 0.6, -0.1, -0.3, 0.2], 4, (2, 7)),
    ([-0.2, 0.2, 0.3, 0.4, 0.5, -0.1, -0.3], 3, (0, 5)),
    ([0.2, -0.2, -0.3, 0.4, 0.5, 0.6, 0.7, -0.4], 5, (2, 7)),
    ([0.2, 0.3, 0.4, 0.4, 0.5, 0.6, 0.7, 0.7], 5, (None, None)),
])
def test_zero_crossings(spark, values, peak, want):
    blinks = spark.createDataFrame([("r", "c", peak)], "rec_id string, ch string, max_blink bigint")
    row = landmarks.zero_crossings(blinks, signal(spark, values)).first()
    assert (row.left_zero, row.right_zero) == want


def test_polyfit_and_polyval(spark):
    points = spark.createDataFrame([(1, float(43 + k), y) for k, y in enumerate(LEFT_Y)], "k int, x double, y double")
    fits = fit.polyfit(points, ["k"])
    r = fits.first()
    assert np.allclose([r.p0, r.p1, r.mu, r.sigma, r.normr, r.rsquared], [24.70920753, 47.42922211, 45.5, 1.870828693, 1.691495419, 0.999063611], rtol=1e-6) and r.df == 4
    got = [x.y_fit for x in fit.polyval(points.select("k", "x"), fits, ["k"]).orderBy("x").collect()]
    assert np.allclose(got, [14.41015625, 27.61778069, 40.82540894, 54.03303528, 67.24066162, 80.44828796], rtol=1e-6)
    assert abs(correlation.corr(points.withColumn("z", F.col("x")), ["k"], "x", "y").first().r - 0.999531686) < 1e-6


def test_lines_and_their_intersection(spark):
    x, y = fit.intersection(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    left, right = A.line(F.lit(43), arr(LEFT_Y)), A.line(F.lit(53), arr(RIGHT_Y))
    r = spark.range(1).select(left.alias("l"), right.alias("r")).select("l", "r", F.col("l.slope").alias("a"), F.col("l.intercept").alias("b"), F.col("r.slope").alias("c"), F.col("r.intercept").alias("d"))
    row = r.select("l.r", F.col("r.r").alias("rr"), x, y, fit.x_intercept(F.col("a"), F.col("b")), fit.x_intercept(F.col("c"), F.col("d"))).first()
    assert np.allclose(list(row), [0.99953169, 0.99763674, 49.67326355, 102.5481115, 41.90895081, 67.80984], atol=2e-3)


def test_level_and_parallel_lines(spark):
    one = F.lit(1.0)
    assert value(spark, fit.x_intercept(F.lit(0.0), one)) is None
    assert value(spark, fit.intersection(one, one, one, F.lit(2.0))[0]) is None


def test_windows(spark):
    df = spark.createDataFrame([([0.1, 0.5], [0.2, 0.1], None, None), ([9.0], [9.0], [0.3], [0.2])], "blink_onset array<double>, blink_duration array<double>, blink_onset_eog array<double>, blink_duration_eog array<double>")
    got = sorted((r.onset, r.duration) for r in metadata.windows(df, F.lit("eog"), ["eog"]).collect())
    assert got == [(0.1, 0.2), (0.3, 0.2), (0.5, 0.1)]


@pytest.mark.parametrize("onset, duration, want", [(-0.1, 0.5, (0, 40)), (9.9, 5.0, (990, 1000))])
def test_sample_clamp(spark, onset, duration, want):
    a, b = metadata.sample_range(F.lit(onset), F.lit(duration), 100.0, 1000)
    assert (value(spark, a), value(spark, b)) == want


def test_safe_stats_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.0)], "k int, v double")
    got = {r.k: tuple(r)[1:] for r in features.safe_stats(rows, ["k"], ["v"]).collect()}
    assert got == {1: (None, None, None), 2: (0.0, 0.0, None)}


def test_tkeo(spark):
    assert value(spark, kernels.tkeo(arr([1, 2, 3, 4]))) == [0.0, 1.0, 1.0, 0.0]


def test_polymorphic_cells(spark):
    cells = {"[1.5, 2]": [1.5, 2.0], "3": [3.0], "": [], "x": [], None: []}
    df = spark.createDataFrame([(k,) for k in cells], "c string").select("c", metadata.as_list(F.col("c"), "string").alias("a"))
    assert {r.c: r.a for r in df.collect()} == cells
    assert value(spark, metadata.as_list(F.lit(2.0), "double")) == [2.0]
    assert value(spark, metadata.fit_length(arr([1, 2, 3]), 2, F.lit(0.0))) == [1.0, 2.0]
    assert value(spark, metadata.fit_length(arr([1]), 3, F.lit(0.0))) == [1.0, 0.0, 0.0]


@pytest.mark.parametrize("seg", [[1, 2, 3, 4], [0.5], [0, 1, 5, 9, 10, 7, 2, 0.5, 0], [3, 1, 2]])
def test_kinematics_against_numpy(spark, seg):
    x, f = np.array(seg, float), 100.0
    got = spark.range(1).select(arr(seg).alias("x")).select(*(c.alias(k) for k, c in kernels.kinematics(F.col("x"), f).items())).first()
    a = np.abs(x)
    assert got.peak_amp == a.max() and got.t2p == a.argmax() / f and np.isclose(got.auc, a.sum() / f)
    assert np.isclose(got.vel_peak, np.abs(np.diff(x)).max() * f) if len(x) > 1 else got.vel_peak is None
    assert np.isclose(got.acc_mean, np.abs(np.diff(x, 2)).mean() * f * f) if len(x) > 2 else got.acc_mean is None
    if len(seg) == 9:
        assert np.isclose(got.rise_time, 0.02) and np.isclose(got.fall_time, 0.02)


def test_correlation_options(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, None), (1, 3.0, 7.0), (1, 4.0, 6.0), (2, 1.0, 1.0)], "k int, a double, b double")
    both = {r.k: r for r in correlation.corr(df, ["k"], "a", "b", rows="complete").collect()}
    assert np.isclose(both[1].r, np.corrcoef([1, 3, 4], [2, 7, 6])[0, 1]) and both[2].r is None
    assert {r.k: r.r for r in correlation.corr(df, ["k"], "a", "b").collect()}[1] is None
    right = {r.k: r.p for r in correlation.corr(df, ["k"], "a", "b", rows="complete", tail="right").collect()}
    assert np.isclose(right[1], both[1].p / 2)
    for bad in ({"kind": "x"}, {"rows": "x"}, {"tail": "x"}):
        with pytest.raises(ValueError):
            correlation.corr(df, ["k"], "a", "b", **bad)


def test_student_p_value():
    assert np.isclose(correlation.two_sided(0.5, 12), 0.09785, atol=1e-4)  # t = 1.826 with 10 degrees of freedom
    assert correlation.two_sided(1.0, 5) == 0.0 and correlation.two_sided(0.1, 2) is None
