"""Landmarks whose searches pass a neighbour's peak, against the chain of the SQL."""

import pytest

duckdb = pytest.importorskip("duckdb")
from ocutide.operators import landmarks  # noqa: E402
from ocutide.plans.oracle import part  # noqa: E402

#: Two blinks without a negative sample between them; the signal falls most steeply after both, past the second's zero.
SIGNAL = [-5.0] * 10 + [0, 9, 18, 27, 36, 40, 20, 18, 16, 14, 10, 8, 20, 24, 28, 31, 34, 40, 46, 49, 50, 44, 36, 28, 16, 5, -1] + [-100.0] * 20
BLINKS = [(12, 19), (25, 34)]


def sql_rows(columns):
    values = ", ".join(f"('c', {i}, {v}::DOUBLE)" for i, v in enumerate(SIGNAL))
    blinks = ", ".join(f"('c', {a}, {b})" for a, b in BLINKS)
    chain = part("len", "pk", "peaks", "bounded", "zeros", "vel", "strokes", "based")
    return duckdb.connect().sql(f"WITH samples(ch, i, v) AS (VALUES {values}), blinks(ch, start_blink, end_blink) AS (VALUES {blinks}),\n{chain}\nSELECT start_blink, {columns} FROM based").fetchall()


def located(spark):
    samples = spark.createDataFrame([("r", "c", i, float(v)) for i, v in enumerate(SIGNAL)], "rec_id string, ch string, i bigint, v double")
    blinks = spark.createDataFrame([("r", "c", a, b) for a, b in BLINKS], "rec_id string, ch string, start_blink bigint, end_blink bigint")
    return landmarks.locate(blinks, samples)


def test_extreme_velocities_reach_past_the_next_peak(spark):
    got = located(spark).select("start_blink", "max_pos_vel_frame", "max_neg_vel_frame").collect()
    assert [tuple(r) for r in got] == sql_rows("mpv, mnv") and got


def test_left_bases_of_blinks_that_stay(spark):
    got = located(spark).select("start_blink", "max_pos_vel_frame", "left_base").collect()
    assert [tuple(r) for r in got] == sql_rows("mpv, left_base") and got


def test_both_bases_of_blinks_that_stay(spark):
    got = located(spark).select("start_blink", "left_base", "right_base").collect()
    assert [tuple(r) for r in got] == sql_rows("left_base, right_base") and got


def test_right_bases_of_blinks_that_stay(spark):
    got = located(spark).select("start_blink", "max_neg_vel_frame", "right_base").collect()
    assert [tuple(r) for r in got] == sql_rows("mnv, right_base") and got
