"""Medians, ranks and concordance from counts, against plain Python; report pages."""

import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from ocutide.functions import ranks
from ocutide.operators import correlation, detect
from ocutide.sources import preprocess, report

GROUPS = {
    "one": [3.5], "two": [1.0, 2.0], "ties": [7.0] * 5000 + [1.0, 9.0], "even": [float(k) for k in range(40_000)],
    "odd": [float((k * 7919) % 30_011) for k in range(30_011)], "skewed": [2.0 ** (k % 60) for k in range(25_000)], "signs": [-3.0, 0.0, -0.0, 5.0, 0.0],
}


def test_medians_are_exact(spark):
    rows = [("r", g, i, v) for g, vs in GROUPS.items() for i, v in enumerate(vs)] + [("r", "none", 0, None), ("r", "two", 2, None)]
    got = {r.ch: r for r in detect.robust_stats(spark.createDataFrame(rows, "rec_id string, ch string, i bigint, v double"), "v").collect()}
    assert set(got) == {*GROUPS, "none"} and got["none"].med is None and got["none"].mad is None
    for g, vs in GROUPS.items():
        med = statistics.median(vs)
        assert got[g].med == med and got[g].mad == statistics.median(abs(v - med) for v in vs)


def test_median_of_shuffled_values(spark):
    rng = random.Random(1)
    for n in (2, 9_999, 10_001, 60_000):
        vs = [rng.choice((rng.gauss(0, 1), float(rng.randrange(5)))) for _ in range(n)]
        df = spark.createDataFrame([("k", v) for v in vs], "k string, v double").repartition(7)
        assert ranks.exact_median(df, F.col("v"), ["k"], "m").first().m == statistics.median(vs)


def test_rows_below(spark):
    rng = random.Random(2)
    vs = [float(rng.randrange(400)) for _ in range(3000)] + [5.0] * 3000
    got = {r.v: (r.ties, r.below) for r in ranks.rows_below(spark.createDataFrame([("k", v) for v in vs], "k string, v double"), ["k"], "v").collect()}
    assert got == {v: (vs.count(v), sum(x < v for x in vs)) for v in set(vs)}


@pytest.mark.parametrize("span", (4, 1 << 20))
def test_concordance(spark, monkeypatch, span):
    monkeypatch.setattr(correlation, "SPAN", span)
    rng = random.Random(3)
    groups = {"free": [(rng.random(), rng.random()) for _ in range(300)], "ties": [(float(rng.randrange(4)), float(rng.randrange(6))) for _ in range(300)], "flat": [(1.0, float(k)) for k in range(5)], "one": [(1.0, 2.0)], "up": [(float(k), k / 2) for k in range(64)], "down": [(float(k), -k / 2) for k in range(65)]}
    df = spark.createDataFrame([(g, *p) for g, ps in groups.items() for p in ps], "g string, a double, b double")
    got = {r.g: r for r in correlation.corr(df, ["g"], "a", "b", "Kendall").collect()}
    sign = lambda v: (v > 0) - (v < 0)
    for g, ps in groups.items():
        every = [(sign(a - c), sign(b - d)) for i, (a, b) in enumerate(ps) for c, d in ps[:i]]
        size = sum(x * x for x, _ in every) * sum(y * y for _, y in every)
        assert got[g].n == len(ps)
        assert got[g].r is None if not size else abs(got[g].r - sum(x * y for x, y in every) / size**0.5) < 1e-12


def test_resampling_to_a_higher_rate_and_single_frames(spark):
    rows = [("r", "a", i, float(i * i)) for i in range(6)] + [("r", "b", 0, 4.0)]
    s = spark.createDataFrame(rows, "rec_id string, ch string, i bigint, v double")
    got = sorted((r.ch, r.i, r.v) for r in preprocess.resample(s, 10.0, 20.0).collect())
    assert got == [("a", k, (k // 2) ** 2 if k % 2 == 0 else ((k // 2) ** 2 + (k // 2 + 1) ** 2) / 2) for k in range(11)] + [("b", 0, 4.0)]


def test_report_pages(spark, tmp_path):
    s = spark.createDataFrame([("r<1>", c, i, float(i % 3)) for c in ("x&y", "flat") for i in range(20)], "rec_id string, ch string, i bigint, v double")
    s = s.withColumn("v", F.when(F.col("ch") == "flat", 2.0).otherwise(F.col("v")))
    rows = [("r<1>", "x&y", 1, 10, 0, 2), ("r<1>", "flat", 1, 10, 4, 5), ("r<1>", "flat", 1, 10, 4, 5), ("r<1>", "x&y", 0, 0, 3, 9)]
    w = spark.createDataFrame(rows, "rec_id string, ch string, epoch_id bigint, epoch_start bigint, win_lo bigint, win_hi bigint")
    pages = report.blink_pages(w, s, 10.0)
    got = {r.epoch_id: r.page for r in pages.collect()}
    assert set(got) == {0, 1} and "r&lt;1&gt;, epoch 1" in got[1] and "x&amp;y 1.00 s" in got[1]
    assert re.findall('points="([^"]*)"', got[1]) == ["0.0,60.0 300.0,0.0 600.0,120.0", "0.0,60.0 600.0,60.0"]
    report.write_report(pages, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(got.values())
    with pytest.raises(Exception, match="(?i)exists"):
        report.write_report(pages, str(tmp_path / "out"))
    assert report.blink_pages(w.limit(0), s, 10.0).count() == 0
