"""Blinks of a segment whose searches pass a neighbour's peak."""

from ocutide.model import Params
from ocutide.plans import pipeline

SIGNAL = [-5.0] * 10 + [0, 9, 18, 27, 36, 40, 20, 18, 16, 14, 10, 8, 20, 24, 28, 31, 34, 40, 46, 49, 50, 44, 36, 28, 16, 5, -1] + [-100.0] * 20


def test_blinks_that_miss_a_base_are_not_numbered(spark):
    n = len(SIGNAL)
    samples = spark.createDataFrame([("r", "eeg", i, float(v)) for i, v in enumerate(SIGNAL)], "rec_id string, ch string, i bigint, v double")
    windows = spark.createDataFrame([("r", "eeg", 0, 0, n, a, b) for a, b in ((12, 19), (25, 34))], "rec_id string, ch string, epoch_id bigint, start_i bigint, end_i bigint, start_blink bigint, end_blink bigint")
    got = pipeline.segment_properties(samples, windows, Params()).select("blink_id", "start_blink", "max_blink").collect()
    assert [tuple(r) for r in got] == [(0, 25, 30)]
