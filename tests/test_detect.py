"""Detection and lookups against plain Python on random signals, streams, errors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ocutide.functions import scan, wavelet
from ocutide.model import Params, nan_to_null, require
from ocutide.operators import channels, detect, epochs, features, landmarks, metadata
from ocutide.plans import pipeline
from ocutide.sources import preprocess, tables
from ocutide.streaming import detect as streaming

P = Params()


def frame(spark, channels_):
    rows = [("r", c, i, float(v)) for c, values in channels_.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "rec_id string, ch string, i bigint, v double")


def machine(v, p=P):
    """The state machine that detection stands for."""
    med = np.median(v)
    thr = np.mean(v) + p.std_threshold * 1.4826 * np.median(np.abs(v - med))
    out, start = [], None
    for i, x in enumerate(v):
        if start is None and x > thr:
            start = i
        elif start is not None and x < thr:
            if i - start > p.min_event_len * p.sfreq:
                out.append((start, i))
            start = None
    near = [k for k in range(len(out) - 1) if (out[k + 1][0] - out[k][1]) / p.sfreq <= p.min_event_len]
    gone = set(near) | {k + 1 for k in near}
    return [b for k, b in enumerate(out) if k not in gone]


def noisy(seed, n=600):
    rng = np.random.default_rng(seed)
    v = np.rint(rng.normal(0, 3, n))
    for _ in range(rng.integers(0, 14)):
        a, w = rng.integers(0, n), rng.integers(2, 30)
        v[a : a + w] += rng.integers(5, 60)
    return v


def test_detection_equals_the_state_machine(spark):
    signals = {f"c{k}": noisy(k) for k in range(40)}
    signals["flat"] = np.zeros(50)
    got = {c: [] for c in signals}
    for r in detect.detect_blinks(frame(spark, signals), P).orderBy("start_blink").collect():
        got[r.ch].append((r.start_blink, r.end_blink))
    assert got == {c: machine(v) for c, v in signals.items()}


def test_chunked_scans_equal_one_window(spark):
    s = frame(spark, {f"c{k}": noisy(k, 200) for k in range(4)})
    neg = F.when(F.col("v") < 0, F.col("i"))
    for f in (scan.last_known, scan.next_known):
        for own in (True, False):
            whole = f(s, {"x": neg}, own=own).select("ch", "i", "x")
            assert whole.exceptAll(f(s, {"x": neg}, own=own, chunk=7).select("ch", "i", "x")).count() == 0
            assert whole.where("x IS NOT NULL").count() > 0


def test_stream_equals_batch(spark, tmp_path):
    s = frame(spark, {f"c{k}": np.concatenate([noisy(k), np.full(40, -5.0)]) for k in range(6)})
    thr = detect.thresholds(s, P)
    for k in range(4):
        s.where(f"floor(i / 160) = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = streaming.detect_stream(stream, spark.createDataFrame(thr.toPandas()), P).writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("found").collect()}
    want = {(r.rec_id, r.ch, r.start_blink, r.end_blink) for r in detect.detect_blinks(s, P).collect()}
    assert got == want and want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-4, 12), min_size=1, max_size=120), st.integers(1, 30))
def test_stream_steps_equal_the_state_machine(values, step):
    p = Params(sfreq=20.0)
    v = np.array(values + [-9] * 3, float)
    med = np.median(v)
    thr = v.mean() + p.std_threshold * 1.4826 * np.median(np.abs(v - med))
    state, got = (-1, -1, -1, -1, False), []
    for a in range(0, len(v), step):
        state, out = streaming._advance(np.arange(a, min(a + step, len(v))), v[a : a + step], thr, state, p)
        got += out
    assert got == machine(v, p)


def test_empty_detection_flows_through(spark):
    s = frame(spark, {"a": np.zeros(30)})
    blinks, stats = pipeline.channel_blinks(s, P)
    assert blinks.count() == 0 and stats.count() == 0


def test_order_of_landmarks(spark):
    s = frame(spark, {f"c{k}": np.convolve(noisy(k), np.hanning(9), "same") for k in range(12)})
    rows = landmarks.locate(detect.detect_blinks(s, P), s).collect()
    assert rows
    for r in rows:
        assert r.left_zero < r.max_blink <= r.right_zero and r.outer_start < r.max_pos_vel_frame <= r.max_blink and r.left_base < r.right_base


def test_errors(spark):
    s = frame(spark, {"a": [1, 2]})
    with pytest.raises(ValueError):
        metadata.pick_channels(s, ["a", "b"])
    with pytest.raises(ValueError):
        epochs.assign_epochs(s, s, 10, "other")
    with pytest.raises(ValueError):
        features.event_features(s, [], 1.0, ["nonsense"])
    with pytest.raises(ValueError):
        channels.representative_channel(s, s, P, "other")
    with pytest.raises(ValueError):
        require(s, ["nope"])
    assert metadata.pick_channels(s, "a").count() == 2


def test_majority_ties_go_to_the_first_epoch(spark):
    b = spark.createDataFrame([("r", "c", 5, 14), ("r", "c", 0, 40)], "rec_id string, ch string, start_blink bigint, end_blink bigint")
    e = epochs.full_epochs(spark.createDataFrame([("r", 50)], "rec_id string, n bigint"), 10)
    assert {(r.start_blink, r.epoch_id) for r in epochs.assign_epochs(b, e, 10).collect()} == {(5, 0)}  # the long one reaches no half
    assert epochs.assign_epochs(b, e, 10, "strict").count() == 2 + 5


def test_filters_keep_all_when_none_passes(spark):
    rows = [("r", "a", 1.0, 3, 0.1), ("r", "b", 2.0, 4, 0.9), ("s", "a", 10.0, 30, 0.8), ("s", "b", 99.0, 90, 0.9)]
    stats = spark.createDataFrame(rows, "rec_id string, ch string, blink_amp_ratio double, number_good_blinks int, good_ratio double")
    assert sorted((r.rec_id, r.ch) for r in channels.select_channels(stats, P).collect()) == [("r", "b"), ("s", "a")]


def test_wavelet_properties(spark):
    rows = [("const", [3.0] * 64), ("cubic", [float((i / 32) ** 3) for i in range(96)]), ("short", [1.0, 2.0]), ("bump", [0.0] * 40 + [1.0, -2.0, 3.0] + [0.0] * 40)]
    df = spark.createDataFrame(rows, "k string, x array<double>")
    got = {r.k: r for r in wavelet.with_energies(df, "x", 100.0, ["k"]).collect()}
    assert all(abs(got["const"][f"detail_energy_L{k}"]) < 1e-20 for k in (1, 2, 3)) and got["const"].detail_energy_L4 is None
    assert got["short"].detail_energy_L1 is None and got["bump"].wavelet_energy_d1 == got["bump"].detail_energy_L3
    low = df.where("k = 'bump'").select(F.aggregate(wavelet.convolved(F.col("x"), wavelet.DEC_LO), F.lit(0.0), lambda a, v: a + v * v)).first()[0]
    assert abs(low + got["bump"].detail_energy_L1 - 14.0) < 1e-9  # orthogonal: energy is kept


def test_fir_and_resampling(spark):
    v = noisy(3, 500)
    taps = preprocess.bandpass_taps(0.5, 20.5, 100.0, 31)
    got = np.array([r.v for r in preprocess.fir(frame(spark, {"a": v}), taps, block=64).orderBy("i").collect()])
    assert np.allclose(got, np.convolve(v, taps, "same"))
    half = np.array([r.v for r in preprocess.resample(frame(spark, {"a": v}), 100.0, 40.0).orderBy("i").collect()])
    assert np.allclose(half, np.interp(np.arange(len(half)) * 2.5, np.arange(500), v))


def test_sources(spark, tmp_path):
    s = frame(spark, {"a": [1.0, float("nan")]})
    s.write.parquet(str(tmp_path / "s"))
    assert tables.read_samples(spark, str(tmp_path / "s")).where("v IS NULL").count() == 1
    assert nan_to_null(s).where("isnan(v)").count() == 0
    (tmp_path / "c.csv").write_text("epoch_id,blink_count\n0,2\n1,5\n")
    assert tables.read_counts(spark, str(tmp_path / "c.csv")).agg(F.sum("blink_count")).first()[0] == 7
    tables.write_segments(s.withColumn("seg_id", F.lit(0)), str(tmp_path / "seg"))
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_segments(s.withColumn("seg_id", F.lit(0)), str(tmp_path / "seg"))
    with pytest.raises(NotImplementedError):
        tables.read_fif("x.fif")


def test_metadata_replacement_is_idempotent(spark):
    old = spark.createDataFrame([("r", 0, 1, 9), ("r", 1, 2, 9)], "rec_id string, epoch_id bigint, kept int, blink_old int")
    new = spark.createDataFrame([("r", 0, 3)], "rec_id string, epoch_id bigint, n_blinks int")
    one = epochs.replace_metadata(old, new)
    assert one.columns == ["rec_id", "epoch_id", "kept", "n_blinks"]
    assert one.exceptAll(epochs.replace_metadata(one, new)).count() == 0


def test_segments_of_a_whole_multiple(spark):
    lengths = spark.createDataFrame([("a", 50), ("b", 51), ("c", 9), ("d", 10), ("e", 1)], "rec_id string, n bigint")
    count = lambda df: {r.rec_id: r["count"] for r in df.groupBy("rec_id").count().collect()}
    assert count(epochs.full_segments(lengths, 10)) == {"a": 4, "b": 5}
    assert count(epochs.full_epochs(lengths, 10)) == {"a": 5, "b": 5, "d": 1}


def test_dropped_epochs_close_up(spark):
    samples = spark.createDataFrame([("r", c, i, float(i)) for c in "xy" for i in range(50)], "rec_id string, ch string, i bigint, v double")
    kept = epochs.full_epochs(spark.createDataFrame([("r", 50)], "rec_id string, n bigint"), 10).where("epoch_id IN (0, 2, 4)")
    got = sorted((r.ch, r.i, r.frame, r.v) for r in detect.concatenated(samples, kept).collect())
    frames = [*range(10), *range(20, 30), *range(40, 50)]
    assert got == [(c, k, f, float(f)) for c in "xy" for k, f in enumerate(frames)]
