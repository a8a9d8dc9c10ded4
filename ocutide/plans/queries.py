"""Queries by operator over the tables of a folder, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.functions import kernels, scan, wavelet
from ocutide.model import KEYS
from ocutide.operators import channels, correlation, detect, epochs, features, fit, landmarks, metadata, properties
from ocutide.plans import pipeline
from ocutide.plans.oracle import FRAMES, SECONDS, P, part, rounded, sql
from ocutide.sources import preprocess, report, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, final: str | None = None) -> Callable[[Query], Query]:
    """Register a query and what its SQL selects from the chain."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if final:
            ORACLE[name] = final if final.lstrip().startswith("WITH") else sql(final)
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    # plans of nested array searches print to many megabytes, at each adaptive step
    spark.conf.set("spark.sql.maxPlanStringLength", 20_000)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return tables.events_signal(_read(spark, d, "events")).persist()


def _blinks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = _samples(spark, d)
    return detect.detect_blinks(s, P).persist(), s


def _located(spark: SparkSession, d: str) -> DataFrame:
    b, s = _blinks(spark, d)
    return landmarks.locate(b, s).persist()


def _fitted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    b, s = _blinks(spark, d)
    return fit.fit_blinks(landmarks.locate(b, s).persist(), P.base_fraction).persist(), s


def _round(df: DataFrame, columns: list[str], digits: int = 4, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *(F.round(c, digits).alias(c) for c in columns))


def _ann(spark: SparkSession, d: str) -> DataFrame:
    """Annotations, each channel as a recording of its own."""
    b, _ = _blinks(spark, d)
    return epochs.annotations(b, P.sfreq).withColumn("rec_id", F.col("ch"))


def _epochs(samples: DataFrame) -> DataFrame:
    return epochs.full_epochs(landmarks.channel_lengths(samples).select(F.col("ch").alias("rec_id"), "n"), FRAMES)


def _own(df: DataFrame) -> DataFrame:
    return df.withColumn("rec_id", F.col("ch"))


# -- sources and sinks


@query("A1_read_samples", "SELECT ch, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM samples GROUP BY ch")
def _(spark, d):
    return _samples(spark, d).groupBy("ch").agg(F.count("*").alias("n"), F.sum("v").cast("bigint").alias("total"))


_TAPS = preprocess.bandpass_taps(0.5, 20.5, P.sfreq, 21)


@query("A2_filter_resample", f"""SELECT ch, i, round(v, 3) AS v FROM (SELECT c.ch, c.i // 4 AS i, sum(s.v * t.tap) AS v FROM samples AS c JOIN (SELECT unnest({_TAPS}) AS tap, unnest(range(-10, 11)) AS off) AS t ON true JOIN samples AS s ON s.ch = c.ch AND s.i = c.i + t.off WHERE c.i % 4 = 0 GROUP BY c.ch, c.i)""")
def _(spark, d):
    return _round(preprocess.resample(preprocess.fir(_samples(spark, d), _TAPS), P.sfreq, 25.0), ["v"], 3, ("ch", "i"))


@query("A3_segment_names", f"SELECT ch, epoch_id, printf('epoch_%04d_%07.2fs-%07.2fs_raw', epoch_id, epoch_id * {SECONDS}, (epoch_id + 1) * {SECONDS}) AS name FROM ep")
def _(spark, d):
    e = F.col("epoch_id")
    return _epochs(_samples(spark, d)).select(F.col("rec_id").alias("ch"), "epoch_id", epochs.segment_name(e, e * SECONDS, (e + 1) * SECONDS).alias("name"))


@query("A4_read_counts", "SELECT epoch_id, n_blinks AS blink_count FROM mapped")
def _(spark, d):
    path = f"{tables.shared_folder(spark)}/counts-{uuid.uuid4().hex}"
    counts = _mapped(spark, d)[0].select("epoch_id", F.size("blink_onset").cast("bigint").alias("blink_count"))
    counts.write.csv(path, header=True)
    return tables.read_counts(spark, path)


def _windows_in_epochs(spark, d) -> tuple[DataFrame, DataFrame]:
    s = _own(_samples(spark, d))
    return epochs.overlap_windows(_ann(spark, d), _epochs(s), SECONDS, P.sfreq), s


@query("A6_padded_window", f"SELECT ch, epoch_id, start_rel, greatest(start_rel - 50, 0) AS win_lo, least(end_rel + 50, {FRAMES - 1}) AS win_hi FROM (SELECT *, row_number() OVER (PARTITION BY ch, epoch_id ORDER BY start_rel) AS k FROM ow) WHERE k <= 2")
def _(spark, d):
    w, _ = _windows_in_epochs(spark, d)
    out = epochs.padded_window(metadata.trough_middle(w), FRAMES, P.sfreq)
    return epochs.first_per_epoch(out, 2).select("ch", "epoch_id", "start_rel", "win_lo", "win_hi")


@query("A5_blink_report", f"SELECT ch, epoch_id, count(*) AS n_blinks, CAST(sum(hi - lo + 1) AS BIGINT) AS n_points FROM (SELECT DISTINCT ch, epoch_id, greatest(start_rel - 50, 0) AS lo, least(end_rel + 50, {FRAMES - 1}) AS hi FROM ow) GROUP BY ch, epoch_id")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    padded = epochs.padded_window(metadata.trough_middle(w), FRAMES, P.sfreq)
    path = f"{tables.shared_folder(spark)}/report-{uuid.uuid4().hex}"
    report.write_report(report.blink_pages(padded.withColumn("epoch_start", F.col("epoch_id") * FRAMES), s, P.sfreq), path)
    # digests of what was written
    page, lines = F.col("value"), F.regexp_extract_all("value", F.lit('points="([^"]*)"'))
    counted = F.aggregate(F.transform(lines, lambda x: F.size(F.split(x, " "))), F.lit(0), lambda a, n: a + n).cast("bigint")
    return spark.read.text(path).select(F.col("rec_id").alias("ch"), F.regexp_extract(page, "epoch (\\d+)</h2>", 1).cast("bigint").alias("epoch_id"), F.size(lines).cast("bigint").alias("n_blinks"), counted.alias("n_points"))


@query("A7_annotations", "SELECT ch, onset, duration, 'eye_blink' AS label FROM ann")
def _(spark, d):
    return _ann(spark, d).select("ch", "onset", "duration", "label")


# -- projections and filters


@query("B1_pick_channels", "SELECT ch, count(*) AS n FROM samples WHERE ch IN ('click', 'view') GROUP BY ch")
def _(spark, d):
    return metadata.pick_channels(_samples(spark, d), ["click", "view"], ["click", "view"]).groupBy("ch").agg(F.count("*").alias("n"))


@query("B2_label_filter", "SELECT event_id, event_type FROM events WHERE lower(event_type) = 'click'")
def _(spark, d):
    ev = _read(spark, d, "events").withColumn("label", F.col("event_type"))
    return epochs.with_label(ev, "CLICK", True).select("event_id", "event_type")


@query("B3_annotation_frames", "SELECT ch, CAST(trunc((onset - 0.5) * 100.0) AS BIGINT) AS start_frame, CAST(trunc((onset + duration - 0.5) * 100.0) AS BIGINT) AS end_frame FROM ann WHERE onset > 0.5")
def _(spark, d):
    out = epochs.annotation_frames(_ann(spark, d), "eye_blink", P.sfreq, 0.5)
    return out.select("ch", F.col("start_blink").alias("start_frame"), F.col("end_blink").alias("end_frame"))


@query("B4_good_blink_mask", "SELECT ch, start_blink FROM masked")
def _(spark, d):
    f, s = _fitted(spark, d)
    return channels.keep_good(f, channels.blink_statistics(f, s, P), P).select("ch", "start_blink")


@query("B5_ratio_restriction", "SELECT ch, start_blink FROM final")
def _(spark, d):
    return pipeline.channel_blinks(_samples(spark, d), P)[0].select("ch", "start_blink")


@query("B6_blink_quality", "SELECT ch, start_blink, CASE WHEN (ch, start_blink) IN (SELECT (ch, start_blink) FROM masked) THEN 'Good' ELSE 'Bad' END AS blink_quality FROM lines")
def _(spark, d):
    f, s = _fitted(spark, d)
    return channels.quality(f, channels.blink_statistics(f, s, P), P).select("ch", "start_blink", "blink_quality")


@query("B8_cells", "SELECT vec_id, list_transform([embedding[1], embedding[2], embedding[3], NULL, NULL], lambda x: CAST(x AS DOUBLE)) AS padded, CAST(label AS DOUBLE) AS first_cell FROM embeddings")
def _(spark, d):
    e = _read(spark, d, "embeddings")
    three = metadata.as_list(F.slice("embedding", 1, 3), "array<float>")
    return e.select("vec_id", metadata.fit_length(three, 5, F.lit(None).cast("double")).alias("padded"), F.get(metadata.as_list(F.col("label").cast("string"), "string"), F.lit(0)).alias("first_cell"))


@query("B9_outer_defaults", "SELECT ch, epoch_id, u.k, coalesce(blink_onset[u.k + 2], blink_onset[u.k + 1]) AS bound FROM mapped, (SELECT unnest(range(2)) AS k) AS u WHERE n_blinks > u.k")
def _(spark, d):
    m = _mapped(spark, d)[0].withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(1)))).where("n_blinks > k")
    return m.select("ch", "epoch_id", F.col("k").cast("bigint").alias("k"), metadata.outer_defaults(F.col("blink_onset"), F.col("k") + 1, F.get("blink_onset", F.col("k"))).alias("bound"))


@query("B10_modality", """SELECT name, CASE WHEN contains(lower(name), 'eeg') THEN 'eeg' WHEN contains(lower(name), 'eog') THEN 'eog' ELSE 'ear' END AS a,
  CASE WHEN contains(lower(name), 'ear') THEN 'ear' WHEN contains(lower(name), 'eog') THEN 'eog' ELSE 'eeg' END AS b, CASE WHEN contains(lower(name), 'ear') THEN 'EAR' ELSE 'EEG' END AS c
  FROM (SELECT unnest(['EEG-E8', 'EOG-EEG-eog_vert_left', 'EAR-avg_ear', 'other']) AS name)""")
def _(spark, d):
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, ["EEG-E8", "EOG-EEG-eog_vert_left", "EAR-avg_ear", "other"]))).alias("name"))
    return names.select("name", *(metadata.modality(F.col("name"), r).alias(r) for r in "abc"))


# -- joins


@query("C1_assign_epochs", "SELECT ch, start_blink, epoch_id, round(fraction, 6) AS fraction FROM major")
def _(spark, d):
    s = _own(_samples(spark, d))
    b = _own(_blinks(spark, d)[0])
    return _round(epochs.assign_epochs(b, _epochs(s), FRAMES), ["fraction"], 6, ("ch", "start_blink", "epoch_id"))


@query("C1_assign_strict", "SELECT ch, start_blink, epoch_id FROM hit")
def _(spark, d):
    s = _own(_samples(spark, d))
    return epochs.assign_epochs(_own(_blinks(spark, d)[0]), _epochs(s), FRAMES, "strict").select("ch", "start_blink", "epoch_id")


def _mapped(spark, d) -> tuple[DataFrame, DataFrame]:
    s = _own(_samples(spark, d))
    return epochs.map_blinks(_own(_blinks(spark, d)[0]), _epochs(s), FRAMES, P.sfreq), s


@query("C2_map_blinks", "SELECT ch, epoch_id, blink_onset, blink_duration, n_blinks FROM mapped")
def _(spark, d):
    return _mapped(spark, d)[0].select("ch", "epoch_id", "blink_onset", "blink_duration", F.col("n_blinks").cast("bigint").alias("n_blinks"))


@query("C3_annotations_in_epochs", f"SELECT ep.ch, ep.epoch_id, count(onset) AS n_blinks, round(coalesce(sum(onset - ep.epoch_id * {SECONDS}), 0), 6) AS total FROM ep LEFT JOIN ann ON ann.ch = ep.ch AND floor(onset / {SECONDS}) = ep.epoch_id GROUP BY ALL")
def _(spark, d):
    out = epochs.annotations_in_epochs(_ann(spark, d), _epochs(_samples(spark, d)), SECONDS)
    return out.select(F.col("rec_id").alias("ch"), "epoch_id", F.col("n_blinks").cast("bigint").alias("n_blinks"), F.round(A.total(F.col("blink_onset")), 6).alias("total"))


@query("C4_overlap_windows", "SELECT ch, start_blink, epoch_id, start_rel, end_rel FROM ow")
def _(spark, d):
    w, _ = _windows_in_epochs(spark, d)
    return w.select("ch", F.rint(F.col("onset") * 100).cast("bigint").alias("start_blink"), "epoch_id", "start_rel", "end_rel")


@query("C5_zero_crossings", "SELECT ch, start_blink, max_blink, left_zero, right_zero FROM zeros")
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.zero_crossings(landmarks.find_peaks(b, s), s).select("ch", "start_blink", "max_blink", "left_zero", "right_zero")


@query("C6_blink_mask", "SELECT ch, count(*) AS frames, CAST(sum(i) AS BIGINT) AS total FROM mask GROUP BY ch")
def _(spark, d):
    return channels.blink_mask(_fitted(spark, d)[0]).groupBy("ch").agg(F.count("*").alias("frames"), F.sum("i").alias("total"))


@query("C7_open_samples", "SELECT s.ch, count(*) AS frames FROM samples AS s WHERE NOT EXISTS (SELECT 1 FROM blinks AS b WHERE b.ch = s.ch AND s.i BETWEEN start_blink AND end_blink) GROUP BY s.ch")
def _(spark, d):
    b, s = _blinks(spark, d)
    return channels.outside_blinks(s, b).groupBy("ch").agg(F.count("*").alias("frames"))


@query("C8_epoch_channel_pairs", "SELECT e.epoch_id, l.ch FROM (SELECT DISTINCT epoch_id FROM ep) AS e, len AS l")
def _(spark, d):
    s = _samples(spark, d)
    e = _epochs(s).select(F.lit("events").alias("rec_id"), "epoch_id").distinct()
    return epochs.boundary_cross(e, landmarks.channel_lengths(s)).select("epoch_id", "ch")


@query("C9_remap", "SELECT ch, start_blink, epoch_id AS place FROM major")
def _(spark, d):
    e = _epochs(_own(_samples(spark, d)))
    b = epochs.assign_epochs(_own(_blinks(spark, d)[0]), e, FRAMES).withColumnRenamed("epoch_id", "seg_id")
    return epochs.remap(b, e.select("rec_id", F.col("epoch_id").alias("seg_id"), "epoch_id")).select("ch", "start_blink", F.col("epoch_id").alias("place"))


@query("C11_zip_by_place", "SELECT a.ch, a.start_blink, b.max_blink FROM (SELECT ch, start_blink, row_number() OVER (PARTITION BY ch ORDER BY start_blink) AS k FROM blinks) AS a JOIN (SELECT ch, max_blink, row_number() OVER (PARTITION BY ch ORDER BY start_blink) AS k FROM peaks) AS b USING (ch, k)")
def _(spark, d):
    b, s = _blinks(spark, d)
    p = landmarks.find_peaks(b, s)
    return epochs.zip_by_place(b.select("ch", "start_blink"), p.select("ch", "start_blink", "max_blink"), ["ch"], "start_blink").select("ch", "start_blink", "max_blink")


@query("C12_replace_metadata", "SELECT ep.ch, ep.epoch_id, 7 AS kept, m.n_blinks FROM ep LEFT JOIN mapped AS m USING (ch, epoch_id)")
def _(spark, d):
    m, s = _mapped(spark, d)
    old = _epochs(s).select("rec_id", "epoch_id", F.lit(7).alias("kept"), F.lit(-1).alias("n_blinks"), F.lit("x").alias("blink_old"))
    out = epochs.replace_metadata(old, m.select("rec_id", "epoch_id", F.col("n_blinks").cast("bigint").alias("n_blinks")))
    return epochs.replace_metadata(out, m.select("rec_id", "epoch_id", F.col("n_blinks").cast("bigint").alias("n_blinks"))).select(F.col("rec_id").alias("ch"), "epoch_id", "kept", "n_blinks")


@query("C13_count_join", "SELECT ep.ch, ep.epoch_id, coalesce(n, 0) AS blink_count FROM ep LEFT JOIN (SELECT ch, epoch_id, count(*) AS n FROM major GROUP BY ALL) USING (ch, epoch_id)")
def _(spark, d):
    s = _own(_samples(spark, d))
    e = _epochs(s)
    n = epochs.assign_epochs(_own(_blinks(spark, d)[0]), e, FRAMES).groupBy("rec_id", "epoch_id").agg(F.count("*").alias("n"))
    return e.join(n, ["rec_id", "epoch_id"], "left").select(F.col("rec_id").alias("ch"), "epoch_id", F.coalesce("n", F.lit(0).cast("bigint")).alias("blink_count"))


@query("C15_boundary_pairs", f"SELECT DISTINCT a.ch, CAST(floor(onset / {SECONDS}) AS BIGINT) AS epoch_id, CAST(floor(onset / {SECONDS}) AS BIGINT) + 1 AS next_epoch_id FROM ann AS a JOIN len AS l USING (ch) WHERE onset + duration > (floor(onset / {SECONDS}) + 1) * {SECONDS} AND floor(onset / {SECONDS}) + 1 < floor(n / {FRAMES})")
def _(spark, d):
    s = _samples(spark, d)
    ann = _ann(spark, d).join(landmarks.channel_lengths(s).select("ch", "n"), "ch")
    return epochs.boundary_pairs(ann, F.floor(F.col("n") / FRAMES), SECONDS).withColumnRenamed("rec_id", "ch")


# -- detection


@query("D1_detect_blinks", "SELECT ch, start_blink, end_blink FROM blinks")
def _(spark, d):
    return _blinks(spark, d)[0].select("ch", "start_blink", "end_blink")


def _variant(source: str, test: str) -> str:
    """SQL of a detection on another signal or least length."""
    return f"""SELECT ch, start_blink, end_blink FROM (SELECT *, lag(end_blink) OVER w AS pe, lead(start_blink) OVER w AS ns FROM (
      SELECT ch, i AS start_blink, stop AS end_blink FROM (SELECT *, lead(i) OVER (PARTITION BY ch ORDER BY i) AS stop FROM (SELECT *, lag(st, 1, 0) OVER (PARTITION BY ch ORDER BY i) AS b4 FROM (
        SELECT ch, i, CASE WHEN v > t THEN 1 WHEN v < t THEN 0 END AS st FROM ({source}) JOIN (SELECT ch, mean + {P.std_threshold} * 1.4826 * median(abs(v - m)) AS t FROM ({source}) JOIN (SELECT ch, avg(v) AS mean, median(v) AS m FROM ({source}) GROUP BY ch) USING (ch) GROUP BY ch, mean) USING (ch)
      ) WHERE st IS NOT NULL) WHERE st <> b4) WHERE st = 1 AND stop - i > {test}) WINDOW w AS (PARTITION BY ch ORDER BY start_blink))
      WHERE NOT (coalesce((start_blink - pe) / 100.0 <= 0.05, false) OR coalesce((ns - end_blink) / 100.0 <= 0.05, false))"""


@query("D2_detect_whole_frames", _variant("SELECT ch, i, v FROM samples", "5"))
def _(spark, d):
    return detect.detect_blinks(_samples(spark, d), P, True).select("ch", "start_blink", "end_blink")


@query("D3_find_blinks_epoch", _variant(f"SELECT s.ch, s.i, v FROM samples AS s JOIN len USING (ch) WHERE s.i < floor(n / {FRAMES}) * {FRAMES}", "5"))
def _(spark, d):
    s = _own(_samples(spark, d))
    return detect.detect_blinks(detect.concatenated(s, _epochs(s)), P, True).select("ch", "start_blink", "end_blink")


@query("D4_blink_counts", "SELECT ch, epoch_id, n_blinks FROM mapped")
def _(spark, d):
    return _mapped(spark, d)[0].select("ch", "epoch_id", F.size("blink_onset").cast("bigint").alias("n_blinks"))


@query("D5_detect_troughs", _variant("SELECT ch, i, -v AS v FROM samples", "5.0"))
def _(spark, d):
    return detect.detect_troughs(_samples(spark, d), P).select("ch", "start_blink", "end_blink")


@query("D6_micropauses", """SELECT ch, epoch_id, count(*) FILTER (len / 100.0 >= 0.1 AND len / 100.0 <= 0.3) AS micropause_count FROM (
  SELECT f.ch, f.epoch_id, r.len FROM (SELECT DISTINCT ch, epoch_id FROM flagged) AS f LEFT JOIN (
    SELECT ch, epoch_id, run, count(*) AS len FROM (SELECT ch, epoch_id, k - row_number() OVER (PARTITION BY ch, epoch_id ORDER BY k) AS run FROM (SELECT *, avg(v) FILTER (NOT shut) OVER (PARTITION BY ch, epoch_id) AS m FROM flagged) WHERE NOT shut AND v <= 0.5 * m) GROUP BY ALL) AS r USING (ch, epoch_id)) GROUP BY ALL""")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    shut = w.select("ch", "epoch_id", F.explode(F.sequence("start_rel", "end_rel")).alias("k")).distinct().withColumn("shut", F.lit(True))
    e = _epochs(s)
    x = s.withColumn("epoch_id", F.floor(F.col("i") / FRAMES)).join(e.select("rec_id", "epoch_id"), ["rec_id", "epoch_id"]).withColumn("k", F.col("i") - F.col("epoch_id") * FRAMES)
    x = x.join(shut, ["ch", "epoch_id", "k"], "left").withColumn("shut", F.coalesce("shut", F.lit(False)))
    return detect.micropauses(x, ("ch", "epoch_id"), "shut", P)


# -- landmarks


@query("E1_peaks", "SELECT ch, start_blink, max_value, max_blink FROM peaks")
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.find_peaks(b, s).select("ch", "start_blink", "max_value", "max_blink")


def _extreme(order: str) -> str:
    return f"SELECT b.ch, start_blink, (SELECT i FROM samples AS s WHERE s.ch = b.ch AND i BETWEEN start_blink AND end_blink ORDER BY {order}, i LIMIT 1) AS max_blink FROM blinks AS b"


@query("E2_magnitude_peaks", _extreme("abs(v) DESC"))
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.find_peaks(b, s, "abs").select("ch", "start_blink", "max_blink")


@query("E3_trough_peaks", _extreme("v"))
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.find_peaks(b, s, "min").select("ch", "start_blink", "max_blink")


@query("E4_outer_bounds", "SELECT ch, start_blink, outer_start, outer_end FROM bounded")
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.outer_bounds(landmarks.find_peaks(b, s), landmarks.channel_lengths(s)).select("ch", "start_blink", "outer_start", "outer_end")


@query("E5_velocity", "SELECT ch, i, vel FROM vel")
def _(spark, d):
    return scan.velocity(_samples(spark, d)).where("vel IS NOT NULL").select("ch", "i", "vel")


@query("E6_extreme_velocity", "SELECT ch, start_blink, mpv AS max_pos_vel_frame, mnv AS max_neg_vel_frame FROM based")
def _(spark, d):
    return _located(spark, d).select("ch", "start_blink", "max_pos_vel_frame", "max_neg_vel_frame")


@query("E7_bases", "SELECT ch, start_blink, left_base, right_base FROM based")
def _(spark, d):
    return _located(spark, d).select("ch", "start_blink", "left_base", "right_base")


_HALF = ["left_zero_half_height", "right_zero_half_height", "left_base_half_height", "right_base_half_height"]


@query("E10_half_heights", f"SELECT ch, start_blink, {', '.join(_HALF)} FROM halves")
def _(spark, d):
    return landmarks.half_heights(_located(spark, d)).select("ch", "start_blink", *_HALF)


_RANGE = ["left_lo", "left_hi", "right_lo", "right_hi"]


@query("E11_fit_ranges", f"SELECT ch, start_blink, {', '.join(_RANGE)} FROM ranges")
def _(spark, d):
    return landmarks.fit_ranges(_located(spark, d), P.base_fraction).select("ch", "start_blink", *_RANGE)


@query("E12_fit_blinks", "SELECT ch, start_blink, end_blink, max_blink, left_base, right_base, left_lo, right_hi FROM lines")
def _(spark, d):
    return _fitted(spark, d)[0].select("ch", "start_blink", "end_blink", "max_blink", "left_base", "right_base", "left_lo", "right_hi")


@query("E13_refine_maximum", "SELECT o.ch, o.epoch_id, o.start_rel, (SELECT k FROM epx AS e WHERE e.ch = o.ch AND e.epoch_id = o.epoch_id AND k BETWEEN o.start_rel AND o.end_rel ORDER BY v DESC, k LIMIT 1) AS peak, CAST(floor((o.start_rel + o.end_rel) / 2) AS BIGINT) AS middle FROM ow AS o")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    x = w.join(features.epoch_signals(s, FRAMES).withColumnRenamed("x", "sig"), [*KEYS, "epoch_id"]).withColumn("peak_rel", F.lit(None).cast("bigint"))
    out = metadata.local_maximum(x, FRAMES).withColumnRenamed("refined_peak_frame", "peak").drop("refined_start_frame", "refined_end_frame")
    return metadata.trough_middle(out).select("ch", "epoch_id", "start_rel", "peak", F.col("refined_peak_frame").alias("middle"))


@query("E15_modality_mean", "SELECT CASE WHEN contains(ch, 'eeg') THEN 'eeg' WHEN contains(ch, 'eog') THEN 'eog' ELSE 'ear' END AS modality, i, round(avg(v), 4) AS v FROM samples GROUP BY ALL")
def _(spark, d):
    return _round(metadata.modality_mean(_samples(spark, d)), ["v"], 4, ("modality", "i"))


# -- aggregations


@query("F1_robust_stats", "SELECT ch, round(mean, 4) AS mean, med, mad FROM madt")
def _(spark, d):
    return detect.robust_stats(_samples(spark, d), "v").select("ch", F.round("mean", 4).alias("mean"), "med", "mad")


def _pearson(lines: DataFrame) -> DataFrame:
    x = lines.select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return _round(correlation.corr(x, ["k"], "a", "b"), ["r"], 6, ("k", "n"))


@query("F2_pearson", "WITH x AS (SELECT l_partkey AS k, l_quantity AS a, l_extendedprice AS b FROM lineitem) SELECT k, count(*) AS n, round(CASE WHEN count(*) > 1 THEN corr(a, b) END, 6) AS r FROM x GROUP BY k")
def _(spark, d):
    return _pearson(_read(spark, d, "lineitem"))


def _rank(c: str) -> str:
    return f"rank() OVER (PARTITION BY k ORDER BY {c}) + (count(*) OVER (PARTITION BY k, {c}) - 1) / 2.0"


@query("F2_spearman", f"WITH x AS (SELECT l_suppkey % 5 AS k, l_quantity AS a, l_extendedprice AS b FROM lineitem), r AS (SELECT k, {_rank('a')} AS a, {_rank('b')} AS b FROM x) SELECT k, count(*) AS n, round(corr(a, b), 6) AS r FROM r GROUP BY k")
def _(spark, d):
    x = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    return _round(correlation.corr(x, ["k"], "a", "b", "Spearman"), ["r"], 6, ("k", "n"))


@query("F2_kendall", """WITH x AS (SELECT l_partkey AS k, l_quantity AS a, l_discount AS b, row_number() OVER () AS id FROM lineitem),
p AS (SELECT x.k, sum(sign(y.a - x.a) * sign(y.b - x.b)) AS s, count(*) FILTER (x.a <> y.a) AS na, count(*) FILTER (x.b <> y.b) AS nb FROM x JOIN x AS y ON x.k = y.k AND x.id < y.id GROUP BY x.k)
SELECT k, n, round(s / nullif(sqrt(CAST(na AS DOUBLE) * nb), 0), 6) AS r FROM (SELECT k, count(*) AS n FROM x GROUP BY k) LEFT JOIN p USING (k)""")
def _(spark, d):
    return _kendall(_read(spark, d, "lineitem"))


def _kendall(lines: DataFrame) -> DataFrame:
    x = lines.select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"))
    return _round(correlation.corr(x, ["k"], "a", "b", "Kendall"), ["r"], 6, ("k", "n"))


@query("F3_weighted_corr", "WITH x AS (SELECT l_suppkey % 5 AS k, l_quantity AS a, l_extendedprice AS b, l_tax + 0.01 AS w FROM lineitem), m AS (SELECT k, sum(w * a) / sum(w) AS ma, sum(w * b) / sum(w) AS mb FROM x GROUP BY k) SELECT k, round(sum(w * (a - ma) * (b - mb)) / sqrt(sum(w * (a - ma) * (a - ma)) * sum(w * (b - mb) * (b - mb))), 6) AS r FROM x JOIN m USING (k) GROUP BY k")
def _(spark, d):
    x = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), (F.col("l_tax") + 0.01).alias("w"))
    return _round(correlation.weighted_corr(x, ["k"], "a", "b", "w"), ["r"], 6, ("k",))


@query("F4_polyfit", "WITH x AS (SELECT l_suppkey % 5 AS k, l_quantity AS a, l_extendedprice AS b FROM lineitem) SELECT k, round(regr_slope(b, a) * stddev_samp(a), 3) AS p0, round(avg(b), 3) AS p1, round(avg(a), 4) AS mu, round(stddev_samp(a), 4) AS sigma, count(*) - 2 AS df, round(regr_r2(b, a), 6) AS rsquared FROM x GROUP BY k")
def _(spark, d):
    x = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 5).alias("k"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    out = fit.polyfit(x, ["k"])
    return out.select("k", F.round("p0", 3).alias("p0"), F.round("p1", 3).alias("p1"), F.round("mu", 4).alias("mu"), F.round("sigma", 4).alias("sigma"), "df", F.round("rsquared", 6).alias("rsquared"))


@query("F4_polyval", """WITH x AS (SELECT ps AS k, CAST(row_number() OVER (PARTITION BY ps ORDER BY p_partkey) AS DOUBLE) AS a, p_retailprice AS b FROM (SELECT *, p_partkey % 3 AS ps FROM part)),
f AS (SELECT k, regr_slope(b, a) AS s, regr_intercept(b, a) AS i, avg(a) AS mu, stddev_samp(a) AS sg, count(*) AS n, sqrt(greatest(regr_syy(b, a) - regr_sxy(b, a) ** 2 / regr_sxx(b, a), 0)) AS nr FROM x GROUP BY k)
SELECT k, a AS x, round(s * a + i, 4) AS y_fit, round(nr / sqrt(n - 2) * sqrt(1 + 1.0 / n + ((a - mu) / sg) ** 2 / (n - 1)), 4) AS delta FROM x JOIN f USING (k)""")
def _(spark, d):
    from pyspark.sql import Window as W

    x = _read(spark, d, "part").withColumn("k", F.col("p_partkey") % 3).select("k", F.row_number().over(W.partitionBy("k").orderBy("p_partkey")).cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    return _round(fit.polyval(x.select("k", "x"), fit.polyfit(x, ["k"]), ["k"]), ["y_fit", "delta"], 4, ("k", "x"))


_LINES = ["left_slope", "right_slope", "left_r2", "right_r2", "x_intersect", "y_intersect", "left_x_intercept", "right_x_intercept"]


@query("F6_lines", f"SELECT ch, start_blink, {rounded(_LINES, 3)} FROM lines")
def _(spark, d):
    return _round(_fitted(spark, d)[0], _LINES, 3, ("ch", "start_blink"))


_STATS = ["blink_amp_ratio", "best_median", "best_robust_std", "cutoff", "good_ratio"]


@query("F7_blink_statistics", f"SELECT ch, number_blinks, number_good_blinks, {rounded(_STATS)} FROM stats")
def _(spark, d):
    f, s = _fitted(spark, d)
    return _round(channels.blink_statistics(f, s, P), _STATS, 4, ("ch", "number_blinks", "number_good_blinks"))


@query("F9_select_channels", "SELECT ch, number_good_blinks FROM chosen")
def _(spark, d):
    f, s = _fitted(spark, d)
    return channels.select_channels(channels.blink_statistics(f, s, P), P).select("ch", "number_good_blinks")


def _order(samples: DataFrame) -> DataFrame:
    """Channels in alphabetical order."""
    from pyspark.sql import Window as W

    return samples.select(*KEYS).distinct().withColumn("ord", F.row_number().over(W.partitionBy("rec_id").orderBy("ch")))


@query("F10_representative_channel", "SELECT min(ch) AS first_channel, (SELECT ch FROM chosen ORDER BY number_good_blinks DESC, ch LIMIT 1) AS most_good FROM chosen HAVING count(*) > 0")
def _(spark, d):
    f, s = _fitted(spark, d)
    stats = channels.blink_statistics(f, s, P)
    one = channels.representative_channel(stats, _order(s), P).select("rec_id", F.col("ch").alias("first_channel"))
    two = channels.representative_channel(stats, _order(s), P, "max").select("rec_id", F.col("ch").alias("most_good"))
    return one.join(two, "rec_id").drop("rec_id")


@query("F11_safe_stats", "WITH x AS (SELECT l_suppkey % 7 AS k, nullif(l_discount, 0.0) AS v FROM lineitem) SELECT k, round(avg(v), 6) AS v_mean, round(stddev_pop(v), 6) AS v_std, round(stddev_pop(v) / nullif(avg(v), 0), 6) AS v_cv FROM x GROUP BY k")
def _(spark, d):
    x = _read(spark, d, "lineitem").select((F.col("l_suppkey") % 7).alias("k"), F.nullif(F.col("l_discount"), F.lit(0.0)).alias("v"))
    return _round(features.safe_stats(x, ["k"], ["v"]), ["v_mean", "v_std", "v_cv"], 6, ("k",))


@query("F12_blink_rate", f"SELECT ch, epoch_id, CAST(n_blinks AS DOUBLE) AS blink_total, n_blinks / {SECONDS} * 60.0 AS blink_rate FROM mapped")
def _(spark, d):
    return features.blink_rates(_mapped(spark, d)[0], SECONDS).select("ch", "epoch_id", "blink_total", "blink_rate")


_IBI = ["ibi_mean", "ibi_std", "ibi_median", "ibi_min", "ibi_max", "ibi_cv", "ibi_rmssd", "poincare_sd1", "poincare_sd2", "poincare_ratio", "ibi_hurst_exponent", "ibi_permutation_entropy"]


@query("F13_interval_features", f"""SELECT b.ch, {rounded(_IBI, 5)} FROM (SELECT DISTINCT ch FROM blinks) AS b LEFT JOIN (
  SELECT ch, avg(x) AS ibi_mean, stddev_samp(x) AS ibi_std, median(x) AS ibi_median, min(x) AS ibi_min, max(x) AS ibi_max, stddev_samp(x) / nullif(avg(x), 0) AS ibi_cv, sqrt(avg((y - x) * (y - x))) AS ibi_rmssd,
    CASE WHEN count(x) > 2 THEN sqrt(var_samp(y - x) / 2) END AS poincare_sd1, CASE WHEN count(x) > 2 THEN sqrt(var_samp(x + y) / 2) END AS poincare_sd2, CASE WHEN count(x) > 2 THEN sqrt(var_samp(y - x) / 2) / nullif(sqrt(var_samp(x + y) / 2), 0) END AS poincare_ratio,
    CASE WHEN count(x) >= 20 AND stddev_samp(x) > 0 AND max(cum) > min(cum) THEN ln((max(cum) - min(cum)) / stddev_samp(x)) / ln(count(x)) END AS ibi_hurst_exponent
  FROM (SELECT *, sum(x - m) OVER (PARTITION BY ch ORDER BY start_blink) AS cum FROM (SELECT *, lead(x) OVER (PARTITION BY ch ORDER BY start_blink) AS y, avg(x) OVER (PARTITION BY ch) AS m FROM (SELECT ch, start_blink, (lead(start_blink) OVER (PARTITION BY ch ORDER BY start_blink) - end_blink) / 100.0 AS x FROM blinks) WHERE x IS NOT NULL)) GROUP BY ch) USING (ch) LEFT JOIN (
  SELECT ch, -sum(p * ln(p)) AS ibi_permutation_entropy FROM (SELECT ch, count(*) / sum(count(*)) OVER (PARTITION BY ch) AS p FROM (SELECT ch, x > y AS a, x > z AS b, y > z AS c FROM (SELECT ch, x, lead(x) OVER (PARTITION BY ch ORDER BY start_blink) AS y, lead(x, 2) OVER (PARTITION BY ch ORDER BY start_blink) AS z FROM (SELECT ch, start_blink, (lead(start_blink) OVER (PARTITION BY ch ORDER BY start_blink) - end_blink) / 100.0 AS x FROM blinks) WHERE x IS NOT NULL) WHERE z IS NOT NULL) GROUP BY ch, a, b, c) GROUP BY ch) USING (ch)""")
def _(spark, d):
    return _round(features.interval_features(_blinks(spark, d)[0], ["ch"], P.sfreq), _IBI, 5, ("ch",))


@query("F16_mean_interval", "SELECT ch, epoch_id, CASE WHEN len(blink_onset) >= 2 THEN round(list_avg(list_transform(range(1, len(blink_onset)), lambda j: blink_onset[j + 1] - (blink_onset[j] + blink_duration[j]))), 6) END AS ibi FROM mapped")
def _(spark, d):
    return _round(features.mean_interval(_mapped(spark, d)[0]), ["ibi"], 6, ("ch", "epoch_id"))


@query("F17_event_features", f"SELECT ch, epoch_id, CAST(n_blinks AS DOUBLE) AS blink_total, n_blinks / {SECONDS} * 60.0 AS blink_rate, CASE WHEN len(blink_onset) >= 2 THEN round(list_avg(list_transform(range(1, len(blink_onset)), lambda j: blink_onset[j + 1] - (blink_onset[j] + blink_duration[j]))), 6) END AS ibi_a FROM mapped")
def _(spark, d):
    out = features.event_features(_mapped(spark, d)[0], ["a"], SECONDS)
    return out.select(F.col("rec_id").alias("ch"), "epoch_id", "blink_total", "blink_rate", F.round("ibi_a", 6).alias("ibi_a"))


@query("F18_classification", f"SELECT ep.ch, ep.epoch_id, count(w.win_start) FILTER (list_max(x) - list_min(x) < 60000) AS partial_blink_total, count(w.win_start) FILTER (list_max(x) - list_min(x) >= 60000) AS complete_blink_total, count(w.win_start) FILTER (list_max(x) - list_min(x) < 60000) / {SECONDS} * 60.0 AS partial_frequency_bpm, count(w.win_start) FILTER (list_max(x) - list_min(x) >= 60000) / {SECONDS} * 60.0 AS complete_frequency_bpm FROM ep LEFT JOIN (SELECT * FROM wx WHERE len(x) >= 3) AS w USING (ch, epoch_id) GROUP BY ALL")
def _(spark, d):
    w, s = _window_signals(spark, d)
    m = features.per_window(w, kernels.morphology, P.sfreq)
    every = _epochs(s).select("rec_id", F.col("rec_id").alias("ch"), "epoch_id")
    return features.classify(m, every, SECONDS, "peak_to_peak", 60000).drop("rec_id")


@query("F19_event_lists", "SELECT ep.ch, ep.epoch_id, count(m.start_blink) AS n_blinks, coalesce(list(m.start_blink / 100.0 ORDER BY m.start_blink) FILTER (m.start_blink IS NOT NULL), NULL) AS blink_onset, list(nullif(m.end_blink - m.start_blink, 10) ORDER BY m.start_blink) FILTER (m.end_blink - m.start_blink <> 10) AS blink_width FROM ep LEFT JOIN major AS m USING (ch, epoch_id) GROUP BY ALL")
def _(spark, d):
    s = _own(_samples(spark, d))
    e = _epochs(s)
    b = epochs.assign_epochs(_own(_blinks(spark, d)[0]), e, FRAMES).withColumn("width", F.nullif(F.col("end_blink") - F.col("start_blink"), F.lit(10)))
    out = metadata.event_lists(metadata.number_blinks(b), e, P.sfreq, ["width"])
    return out.select(F.col("rec_id").alias("ch"), "epoch_id", "n_blinks", "blink_onset", F.when(F.size("blink_width") > 0, F.col("blink_width")).alias("blink_width"))


_OPEN = ["baseline_mean", "baseline_drift", "baseline_std", "baseline_mad", "perclos", "eye_opening_rms"]
_OPEN_SQL = f"""(SELECT a.*, c.low / {float(FRAMES)} AS perclos FROM (SELECT ch, epoch_id, avg(v) AS baseline_mean, regr_slope(v, j / 100.0) AS baseline_drift, stddev_samp(v) AS baseline_std, median(abs(v - md)) AS baseline_mad, sqrt(avg(v * v)) AS eye_opening_rms, any_value(m) AS m
  FROM (SELECT *, median(v) OVER (PARTITION BY ch, epoch_id) AS md, avg(v) OVER (PARTITION BY ch, epoch_id) AS m FROM open_) GROUP BY ch, epoch_id) AS a
  JOIN (SELECT e.ch, e.epoch_id, count(*) FILTER (e.v <= 0.2 * o.m) AS low FROM epx AS e JOIN (SELECT ch, epoch_id, avg(v) AS m FROM open_ GROUP BY ALL) AS o USING (ch, epoch_id) GROUP BY ALL) AS c USING (ch, epoch_id))"""
_SIGNS = "(SELECT ch, epoch_id, count(*) FILTER ((d < 0) <> (pd < 0)) AS zero_crossing_rate FROM (SELECT ch, epoch_id, j, d, lag(d) OVER (PARTITION BY ch, epoch_id ORDER BY j) AS pd FROM (SELECT ch, epoch_id, j, lead(v) OVER (PARTITION BY ch, epoch_id ORDER BY j) - v AS d FROM open_) WHERE d IS NOT NULL) GROUP BY ALL)"


@query("G5_open_eye", f"SELECT a.ch, a.epoch_id, {rounded([f for f in _OPEN], 3)}, s.zero_crossing_rate FROM {_OPEN_SQL} AS a JOIN {_SIGNS} AS s USING (ch, epoch_id)")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    out = features.open_eye(s, w, FRAMES, P.sfreq).where("baseline_mean IS NOT NULL")
    return _round(out, _OPEN, 3, ("ch", "epoch_id", "zero_crossing_rate")).withColumn("zero_crossing_rate", F.col("zero_crossing_rate").cast("bigint"))


@query("F20_open_eye_baseline", f"SELECT ch, {', '.join(f'round(avg({c}), 3) AS {c}' for c in _OPEN)} FROM {_OPEN_SQL} WHERE epoch_id < 5 GROUP BY ch")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    return _round(features.open_eye_baseline(features.open_eye(s, w, FRAMES, P.sfreq), range(5)), _OPEN, 3, ("ch",))


@query("F22_segment_means", "SELECT ch, epoch_id AS seg_id, round(avg(v), 4) AS v, count(*) AS n FROM epx GROUP BY ALL")
def _(spark, d):
    s = _samples(spark, d).withColumn("seg_id", F.floor(F.col("i") / FRAMES))
    return s.groupBy("ch", "seg_id").agg(F.round(F.avg("v"), 4).alias("v"), F.count("*").alias("n")).where(F.col("n") == FRAMES)


# -- feature kernels


def _window_signals(spark, d) -> tuple[DataFrame, DataFrame]:
    m, s = _mapped(spark, d)
    w = metadata.sample_windows(metadata.windows(m, F.lit("ear")), P.sfreq, FRAMES)
    return features.window_signals(w.select(*KEYS, "epoch_id", "win_start", "win_stop", "duration"), s, FRAMES), s


@query("G1_sample_windows", "SELECT ch, epoch_id, win_start, win_stop FROM win")
def _(spark, d):
    m, _ = _mapped(spark, d)
    return metadata.sample_windows(metadata.windows(m, F.lit("ear")), P.sfreq, FRAMES).select("ch", "epoch_id", "win_start", "win_stop")


_DIFF = "list_transform(range(1, len(x)), lambda j: x[j + 1] - x[j])"
_TK = "list_transform(range(2, len(x)), lambda j: x[j] * x[j] - x[j - 1] * x[j + 1])"


def _stats(metrics: dict[str, str], digits: int) -> str:
    """Mean, deviation and ratio of each metric over an epoch's windows."""
    inner = ", ".join(f"{c} AS {m}" for m, c in metrics.items())
    outer = ", ".join(f"round(avg({m}), {digits}) AS {m}_mean, round(stddev_pop({m}), {digits}) AS {m}_std, round(stddev_pop({m}) / nullif(avg({m}), 0), {digits}) AS {m}_cv" for m in metrics)
    return f"SELECT ep.ch, ep.epoch_id, {outer} FROM ep LEFT JOIN (SELECT ch, epoch_id, {inner} FROM wx) AS w USING (ch, epoch_id) GROUP BY ALL"


def _table(spark, d, kernel, digits: int, names: list[str]) -> DataFrame:
    w, s = _window_signals(spark, d)
    every = _epochs(s).select("rec_id", F.col("rec_id").alias("ch"), "epoch_id")
    out = features.epoch_table(w, every, kernel, P.sfreq)
    return _round(out, [f"{m}_{x}" for m in names for x in features.STATS], digits, ("ch", "epoch_id"))


_ENERGY = {"blink_line_length": f"coalesce(list_sum(list_transform({_DIFF}, lambda y: abs(y))), 0)", "blink_velocity_integral": f"coalesce(list_sum(list_transform({_DIFF}, lambda y: abs(y * 100.0))), 0)"}
_ENERGY_E6 = {"blink_signal_energy": "list_sum(list_transform(x, lambda y: y * y)) ", "teager_kaiser_energy": f"CASE WHEN len(x) >= 3 THEN list_avg(list_transform({_TK}, lambda y: abs(y))) END"}


@query("G4a_energy", _stats(_ENERGY | _ENERGY_E6, 4))
def _(spark, d):
    return _table(spark, d, kernels.window_energy, 4, [*_ENERGY, *_ENERGY_E6])


_TRAPZ = "(list_sum({0}) - ({0}[1] + {0}[len(x)]) / 2) * 0.01"
_GRAD = "list_transform(range(1, len(x) + 1), lambda j: abs((x[least(j + 1, len(x))] - x[greatest(j - 1, 1)]) / (least(j + 1, len(x)) - greatest(j - 1, 1)) * 100.0))"
_SEGMENT = {"energy": _TRAPZ.format("list_transform(x, lambda y: y * y)"), "teager": f"list_sum(list_transform({_TK}, lambda y: abs(y))) * 0.01", "line_length": f"list_sum(list_transform({_DIFF}, lambda y: abs(y)))", "velocity_integral": _TRAPZ.format(_GRAD)}


@query("G4c_segment_energy", f"SELECT ch, epoch_id, {', '.join(f'round({c}, 4) AS {m}' for m, c in _SEGMENT.items())} FROM kx")
def _(spark, d):
    x = features.epoch_signals(_samples(spark, d), FRAMES)
    return _round(features.per_window(x, kernels.blink_energy, P.sfreq), list(_SEGMENT), 4, ("ch", "epoch_id"))


@query("G4b_blink_energy", f"SELECT ch, epoch_id, win_start, {', '.join(f'round(CASE WHEN len(x) >= 2 THEN {c} END, 4) AS {m}' for m, c in _SEGMENT.items() if m != 'teager')}, round(CASE WHEN len(x) > 2 THEN {_SEGMENT['teager']} END, 4) AS teager FROM wx")
def _(spark, d):
    return _round(features.per_window(_window_signals(spark, d)[0], kernels.blink_energy, P.sfreq), list(_SEGMENT), 4, ("ch", "epoch_id", "win_start"))


@query("G4d_tkeo", f"SELECT ch, epoch_id, round(list_sum({_TK}), 4) AS total, len(x) AS n FROM kx")
def _(spark, d):
    x = features.epoch_signals(_samples(spark, d), FRAMES).withColumn("t", kernels.tkeo(F.col("x")))
    return x.select("ch", "epoch_id", F.round(A.total(F.col("t")), 4).alias("total"), F.size("t").cast("bigint").alias("n"))


@query("G6_ear_metrics", f"SELECT k.ch, k.epoch_id, round(CASE WHEN f.s IS NULL THEN list_avg(x) ELSE list_avg(x[greatest(f.s - 300, 0) + 1 : f.s]) END, 4) AS ear_before_blink, list_min(x) AS ear_min, list_max(x) AS ear_max FROM kx AS k LEFT JOIN (SELECT ch, epoch_id, arg_min(start_rel, start_blink) AS s FROM ow GROUP BY ALL) AS f USING (ch, epoch_id)")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    out = features.ear_metrics(s, w.withColumn("blink_id", F.col("onset")), FRAMES, P.sfreq)
    return out.select("ch", "epoch_id", F.round("ear_before_blink", 4).alias("ear_before_blink"), "ear_min", "ear_max")


_ABS = "list_transform(x, lambda y: abs(y))"
_DD = "list_transform(range(2, len(x)), lambda j: abs((x[j + 1] - 2 * x[j] + x[j - 1]) * 10000.0))"
_PEAK = f"list_position({_ABS}, list_max({_ABS}))"
_KIN = {
    "peak_amp": f"list_max({_ABS})", "t2p": f"({_PEAK} - 1) / 100.0", "vel_mean": f"list_avg(list_transform({_DIFF}, lambda y: abs(y * 100.0)))", "vel_peak": f"list_max(list_transform({_DIFF}, lambda y: abs(y * 100.0)))",
    "acc_mean": f"CASE WHEN len(x) >= 3 THEN list_avg({_DD}) END", "acc_peak": f"CASE WHEN len(x) >= 3 THEN list_max({_DD}) END", "auc": f"list_sum({_ABS}) / 100.0",
    "symmetry": f"(coalesce(list_sum({_ABS}[:{_PEAK} - 1]), 0) - list_sum({_ABS}[{_PEAK}:])) / 100.0 / (list_sum({_ABS}) / 100.0 + 1e-8)",
}


@query("G7_kinematics", _stats(_KIN, 5))
def _(spark, d):
    return _table(spark, d, kernels.kinematics, 5, list(_KIN))


_TOP = "list_position(x, list_max(x))"
_MORPH = {
    "peak_amplitude": "list_max(x)", "trough_amplitude": "list_min(x)", "peak_to_peak": "list_max(x) - list_min(x)", "area_abs": _TRAPZ.format(_ABS),
    "rise_time": f"({_TOP} - 1) / 100.0", "fall_time": f"(len(x) - {_TOP}) / 100.0", "slope_rise": f"list_max({_DIFF}) * 100.0", "slope_fall": f"list_min({_DIFF}) * 100.0",
}


@query("G9_morphology", _stats({m: f"CASE WHEN len(x) >= 3 THEN {c} END" for m, c in _MORPH.items()} | {"duration": "duration"}, 5))
def _(spark, d):
    return _table(spark, d, features.morphology_with_duration, 5, [*_MORPH, "duration"])


def _level(x: str, taps: tuple[float, ...]) -> str:
    n = f"len({x})"
    m = f"((2 * k + 1 - j) % (2 * {n}) + 2 * {n}) % (2 * {n})"
    return f"list_transform(range(({n} + 7) // 2), lambda k: list_sum(list_transform(range(8), lambda j: {list(taps)}[j + 1] * {x}[CASE WHEN {m} < {n} THEN {m} ELSE 2 * {n} - 1 - {m} END + 1])))"


def _levels(source: str, keys: str) -> str:
    """Expressions a0 to a4 over ``source``, which has the keys and an array x: the approximation x and the details d of each level."""
    out = f"a0 AS (SELECT {keys}, x, least(floor(log2(len(x) / 7.0)), 4) AS lv FROM {source})"
    for k in range(1, 5):
        out += f",\na{k} AS (SELECT {keys}, lv, CASE WHEN lv >= {k} THEN {_level('x', wavelet.DEC_LO)} ELSE x END AS x, CASE WHEN lv >= {k} THEN {_level('x', wavelet.DEC_HI)} END AS d FROM a{k - 1})"
    return out


_SQUARES = [f"list_sum(list_transform(a{k}.d, lambda y: y * y))" for k in range(1, 5)]


def _dwt() -> str:
    cols = ", ".join(f"round({e}, 6) AS detail_energy_L{k}" for k, e in enumerate(_SQUARES, 1))
    doubles = "(SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS x FROM embeddings)"
    return f"WITH {_levels(doubles, 'vec_id')}\nSELECT a1.vec_id, {cols} FROM a1 JOIN a2 USING (vec_id) JOIN a3 USING (vec_id) JOIN a4 USING (vec_id)"


def _window_dwt() -> str:
    keys = "ch, epoch_id, win_start"
    levels = range(1, 5)
    details = ", ".join(f"{e} AS detail_energy_L{k}" for k, e in enumerate(_SQUARES, 1))
    joined = " ".join(f"JOIN a{k} USING ({keys})" for k in levels[1:])
    first = ", ".join(f"CASE WHEN lv >= {k} THEN [detail_energy_L1, detail_energy_L2, detail_energy_L3, detail_energy_L4][CAST(lv AS BIGINT) - {k} + 1] END AS wavelet_energy_d{k}" for k in levels)
    names = [f"{stem}{k}" for stem in ("wavelet_energy_d", "detail_energy_L") for k in levels]
    means = ", ".join(f"round(avg({n}), 3) AS {n}" for n in names)
    return f"""SELECT ep.ch, ep.epoch_id, {means} FROM ep LEFT JOIN (WITH {_levels("wx", keys)},
e AS (SELECT {keys}, a1.lv, {details} FROM a1 {joined}) SELECT *, {first} FROM e) AS w USING (ch, epoch_id) GROUP BY ep.ch, ep.epoch_id"""


@query("G11_wavelet_energy", _dwt())
def _(spark, d):
    return _wavelet_energies(_read(spark, d, "embeddings"))


def _wavelet_energies(vectors: DataFrame) -> DataFrame:
    e = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return _round(wavelet.with_energies(e, "x", P.sfreq, ["vec_id"]), [f"detail_energy_L{k}" for k in range(1, 5)], 6, ("vec_id",))


@query("G12_frequency_features", _window_dwt())
def _(spark, d):
    w, s = _window_signals(spark, d)
    every = _epochs(s).select("rec_id", F.col("rec_id").alias("ch"), "epoch_id")
    out = features.frequency_features(w, every, P.sfreq)
    return _round(out, [c for c in out.columns if "energy" in c], 3, ("ch", "epoch_id"))


# -- properties


_H = ["duration_base", "duration_zero", "closing_time_zero", "reopening_time_zero", "time_shut_base", "peak_max_blink", "peak_time_blink", "pos_amp_vel_ratio_zero", "neg_amp_vel_ratio_zero", "pos_amp_vel_ratio_base", "neg_amp_vel_ratio_base", "inter_blink_max_vel_base", "inter_blink_max_vel_zero", "inter_blink_max_amp"]
_HFIT = ["duration_tent", "duration_half_base", "duration_half_zero", "neg_amp_vel_ratio_tent", "pos_amp_vel_ratio_tent", "closing_time_tent", "reopening_time_tent", "time_shut_tent", "peak_max_tent", "peak_time_tent"]


def _masked(spark, d) -> DataFrame:
    return _masked_with_samples(spark, d)[0]


def _masked_with_samples(spark, d) -> tuple[DataFrame, DataFrame]:
    f, s = _fitted(spark, d)
    return channels.keep_good(f, channels.blink_statistics(f, s, P), P), s


@query("H1_properties", f"SELECT ch, start_blink, {rounded(_H)} FROM props")
def _(spark, d):
    return _round(properties.unfitted(_masked(spark, d), P), _H, 4, ("ch", "start_blink"))


@query("H2_fitted_properties", f"SELECT ch, start_blink, {rounded(_HFIT, 3)} FROM props")
def _(spark, d):
    b, s = _masked_with_samples(spark, d)
    return _round(properties.fitted(b, P, s), _HFIT, 3, ("ch", "start_blink"))


# -- segmentation


@query("I1_full_segments", f"SELECT ch, epoch_id, epoch_id * {FRAMES} AS start_i, (epoch_id + 1) * {FRAMES} AS end_i FROM (SELECT ch, unnest(range(CAST((n - 1) // {FRAMES} AS BIGINT))) AS epoch_id FROM len)")
def _(spark, d):
    lengths = landmarks.channel_lengths(_samples(spark, d)).select(F.col("ch").alias("rec_id"), "n")
    return epochs.full_segments(lengths, FRAMES).withColumnRenamed("rec_id", "ch")


@query("I2_all_segments", f"SELECT l.ch, e.epoch_id, epoch_id * {FRAMES} AS start_i, least((epoch_id + 1) * {FRAMES}, n - 1) AS end_i, (SELECT count(*) FROM ann AS a WHERE a.ch = l.ch AND floor(onset * 100.0 / {FRAMES}) = epoch_id) AS blink_count FROM len AS l, (SELECT unnest(range((SELECT CAST(max(n) // {FRAMES} + 1 AS BIGINT) FROM len))) AS epoch_id) AS e WHERE epoch_id < ceil((n - 1) / {FRAMES})")
def _(spark, d):
    s = _samples(spark, d)
    e = epochs.all_epochs(landmarks.channel_lengths(s).select(F.col("ch").alias("rec_id"), "n"), FRAMES)
    return epochs.onset_counts(_ann(spark, d), e, FRAMES, P.sfreq).withColumnRenamed("rec_id", "ch")


@query("I5_epoch_bounds", "SELECT ch, start_blink, start_blink + CAST(round_even(-0.2 * 100, 0) AS BIGINT) AS start_i, start_blink + CAST(round_even(-0.2 * 100, 0) AS BIGINT) + 59 AS last_i FROM blinks")
def _(spark, d):
    b = _blinks(spark, d)[0].withColumn("event", F.col("start_blink"))
    return epochs.epoch_bounds(b, -0.2, P.sfreq, 60).select("ch", "start_blink", "start_i", "last_i")


@query("I6_blink_events", "SELECT ch, start_blink, end_blink, max_blink, outer_start, least(outer_end, n - 1) AS outer_end, left_zero, right_zero, row_number() OVER (PARTITION BY ch ORDER BY start_blink) - 1 AS blink_id FROM zeros")
def _(spark, d):
    b, s = _blinks(spark, d)
    out = landmarks.outer_bounds(landmarks.find_peaks(b, s), landmarks.channel_lengths(s), True)
    out = metadata.number_blinks(landmarks.zero_crossings(out, s))
    return out.select("ch", "start_blink", "end_blink", "max_blink", "outer_start", "outer_end", "left_zero", "right_zero", "blink_id")


# -- entry points


@query("M1_get_blinks", f"SELECT ch, start_blink, end_blink, {rounded(['max_value', 'duration_base', 'duration_tent', 'pos_amp_vel_ratio_zero'], 3)} FROM final WHERE ch = (SELECT min(ch) FROM chosen)")
def _(spark, d):
    s = _samples(spark, d)
    out = pipeline.get_blinks(s, _order(s), P)["blinks"]
    return _round(out, ["max_value", "duration_base", "duration_tent", "pos_amp_vel_ratio_zero"], 3, ("ch", "start_blink", "end_blink"))


def _alone() -> str:
    """The chain from peaks to bases over epochs, each as a channel of its own."""
    name = "ch || '/' || epoch_id AS ch"
    over = "(s.v) OVER (PARTITION BY b.ch, start_blink)"
    # blinks are troughs in channels that are neither EEG nor EOG
    extreme = f"CASE WHEN lower(b.ch) LIKE '%eeg%' OR lower(b.ch) LIKE '%eog%' THEN max{over} ELSE min{over} END"
    chain = part("len", "pk", "peaks", "bounded", "zeros", "vel", "strokes", "based").replace(f"max{over}", extreme, 1)
    return f"""SELECT split_part(ch, '/', 1) AS ch, CAST(split_part(ch, '/', 2) AS BIGINT) AS seg_id, row_number() OVER (PARTITION BY ch ORDER BY start_blink) - 1 AS blink_id, start_blink, max_blink,
round((right_base - left_base) / 100.0, 4) AS duration_base, round((right_zero - left_zero) / 100.0, 4) AS duration_zero,
round(CASE WHEN shut IS NULL THEN 0 ELSE (SELECT min(i) FROM parts AS s WHERE s.ch = z.ch AND i BETWEEN shut AND right_base AND v < {P.shut_amp_fraction} * max_value) - shut END / 100.0, 4) AS time_shut_base
FROM (WITH samples AS MATERIALIZED (SELECT {name}, k AS i, v FROM epx), blinks AS MATERIALIZED (SELECT DISTINCT {name}, start_rel AS start_blink, end_rel AS end_blink FROM ow),
{chain}
SELECT *, (SELECT min(i) FROM samples AS s WHERE s.ch = b.ch AND i BETWEEN left_base AND right_base AND v >= {P.shut_amp_fraction} * max_value) AS shut FROM based AS b) AS z"""


def _segments_sql() -> str:
    parts = "parts AS MATERIALIZED (SELECT ch || '/' || epoch_id AS ch, k AS i, v FROM epx)"
    return sql(_alone()).replace("\nSELECT split_part", f",\n{parts}\nSELECT split_part", 1)


@query("M2_segment_properties", _segments_sql())
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    base = F.col("epoch_id") * FRAMES
    rows = w.select(*KEYS, "epoch_id", base.alias("start_i"), (base + FRAMES).alias("end_i"), (base + F.col("start_rel")).alias("start_blink"), (base + F.col("end_rel")).alias("end_blink"))
    out = pipeline.segment_properties(s, rows, P)
    return _round(out, ["duration_base", "duration_zero", "time_shut_base"], 4, ("ch", "seg_id", "blink_id", "start_blink", "max_blink"))


@query("M3_extract_features", f"SELECT ep.ch, ep.epoch_id, m.n_blinks / {SECONDS} * 60.0 AS blink_rate, list_min(x) AS ear_min, list_max(x) AS ear_max FROM ep LEFT JOIN mapped AS m USING (ch, epoch_id) JOIN kx USING (ch, epoch_id)")
def _(spark, d):
    m, s = _mapped(spark, d)
    w, _ = _windows_in_epochs(spark, d)
    parts = {"events": features.event_features(m, [], SECONDS, ["blink_rate"]), "ear": features.ear_metrics(s, w.withColumn("blink_id", F.col("onset")), FRAMES, P.sfreq).select("rec_id", "epoch_id", "ear_min", "ear_max")}
    out = pipeline.extract_features(parts, _epochs(s).select("rec_id", "epoch_id"))
    return out.withColumnRenamed("rec_id", "ch")


@query("M4_channel_blinks", f"SELECT ch, start_blink, {rounded(['time_shut_tent', 'inter_blink_max_amp', 'best_median'], 3)} FROM final")
def _(spark, d):
    return _round(pipeline.channel_blinks(_samples(spark, d), P)[0], ["time_shut_tent", "inter_blink_max_amp", "best_median"], 3, ("ch", "start_blink"))


@query("L1_refine_callback", "SELECT o.ch, o.epoch_id, o.start_rel, (SELECT k FROM epx AS e WHERE e.ch = o.ch AND e.epoch_id = o.epoch_id AND k BETWEEN o.start_rel AND o.end_rel ORDER BY v DESC, k LIMIT 1) AS refined_peak_frame FROM ow AS o")
def _(spark, d):
    w, s = _windows_in_epochs(spark, d)
    x = w.join(features.epoch_signals(s, FRAMES).withColumnRenamed("x", "sig"), [*KEYS, "epoch_id"]).withColumn("peak_rel", F.lit(None).cast("bigint"))
    top = lambda sig, a, b, _: (a, a + int(sig[a : b + 1].argmax()), b)
    return metadata.refine_with(x, top, ["ch", "epoch_id", "start_rel"]).select("ch", "epoch_id", "start_rel", "refined_peak_frame")


# -- parts of the above under their own names


@query("B7_drop_missing", "SELECT ch, start_blink FROM zeros WHERE left_zero IS NOT NULL AND right_zero IS NOT NULL")
def _(spark, d):
    b, s = _blinks(spark, d)
    return landmarks.zero_crossings(landmarks.find_peaks(b, s), s).dropna("any").select("ch", "start_blink")


@query("C10_segment_rows", f"SELECT b.ch, start_blink, epoch_id AS seg_id FROM blinks AS b JOIN ep ON ep.ch = b.ch AND b.start_blink // {FRAMES} = epoch_id")
def _(spark, d):
    s = _own(_samples(spark, d))
    b = _own(_blinks(spark, d)[0]).withColumn("seg_id", epochs.epoch_of(F.col("start_blink"), FRAMES))
    return b.join(_epochs(s).select("rec_id", F.col("epoch_id").alias("seg_id")), ["rec_id", "seg_id"]).select("ch", "start_blink", "seg_id")


@query("C14_compare_tables", "SELECT ch, start_blink, CASE WHEN a.m IS NULL THEN 'right_only' WHEN b.m IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT ch, start_blink, 1 AS m FROM cand) AS a FULL JOIN (SELECT ch, start_blink, 1 AS m FROM lines) AS b USING (ch, start_blink)")
def _(spark, d):
    f, s = _fitted(spark, d)
    runs = detect.crossings(s, detect.thresholds(s, P)).where(F.col("end_blink") - F.col("start_blink") > P.min_event_len * P.sfreq)
    return epochs.compare(runs.select("ch", "start_blink"), f.select("ch", "start_blink"), ["ch", "start_blink"])


@query("E8_left_base", "SELECT ch, start_blink, mpv AS max_pos_vel_frame, left_base FROM based")
def _(spark, d):
    return _located(spark, d).select("ch", "start_blink", "max_pos_vel_frame", "left_base")


@query("E9_right_base", "SELECT ch, start_blink, mnv AS max_neg_vel_frame, right_base FROM based")
def _(spark, d):
    return _located(spark, d).select("ch", "start_blink", "max_neg_vel_frame", "right_base")


@query("E14_refine_annotations", f"""SELECT a.ch, a.start_blink, e.epoch_id, r.s AS refined_start_frame, (SELECT k FROM epx AS x WHERE x.ch = a.ch AND x.epoch_id = e.epoch_id AND k BETWEEN r.s AND r.e ORDER BY v DESC, k LIMIT 1) AS refined_peak_frame, r.e AS refined_end_frame
  FROM ann AS a JOIN ep AS e ON e.ch = a.ch AND floor(onset / {SECONDS}) = e.epoch_id, LATERAL (SELECT least(greatest(CAST(round_even((onset - e.epoch_id * {SECONDS}) * 100.0, 0) AS BIGINT), 0), {FRAMES - 1}) AS s, least(greatest(CAST(round_even((onset - e.epoch_id * {SECONDS} + duration) * 100.0, 0) AS BIGINT), 0), {FRAMES - 1}) AS e) AS r""")
def _(spark, d):
    s = _own(_samples(spark, d))
    out = metadata.refine_annotations(_ann(spark, d), features.epoch_signals(s, FRAMES), SECONDS, P.sfreq, FRAMES)
    return out.select("ch", F.rint(F.col("onset") * 100).cast("bigint").alias("start_blink"), "epoch_id", "refined_start_frame", "refined_peak_frame", "refined_end_frame")


@query("F5_intersection", "SELECT ch, start_blink, round((ri - li) / nullif(ls - rs, 0), 3) AS x, round(-li / nullif(ls, 0), 3) AS x_left FROM sides JOIN sides2 USING (ch, start_blink)")
def _(spark, d):
    f, _ = _fitted(spark, d)
    left = -F.col("left_x_intercept") * F.col("left_slope")
    x, _ = fit.intersection(F.col("left_slope"), left, F.col("right_slope"), -F.col("right_x_intercept") * F.col("right_slope"))
    return f.select("ch", "start_blink", F.round(x, 3).alias("x"), F.round(fit.x_intercept(F.col("left_slope"), left), 3).alias("x_left"))


@query("F8_good_ratio", f"SELECT ch, {rounded(['good_ratio'], 6)} FROM stats")
def _(spark, d):
    f, s = _fitted(spark, d)
    return _round(channels.blink_statistics(f, s, P), ["good_ratio"], 6, ("ch",))


def _part(name: str, of: str, columns: list[str], keep: tuple[str, ...] = ("ch",)) -> None:
    """Some columns of a registered query."""
    whole, text = QUERIES[of], ORACLE[of]
    QUERIES[name] = lambda spark, d: whole(spark, d).select(*keep, *columns)
    ORACLE[name] = f"SELECT {', '.join((*keep, *columns))} FROM ({text})"


_part("F14_permutation_entropy", "F13_interval_features", ["ibi_permutation_entropy"])
_part("F15_hurst_exponent", "F13_interval_features", ["ibi_hurst_exponent"])
for _name, _columns in {
    "H3_amp_vel_ratio_zero": ["pos_amp_vel_ratio_zero", "neg_amp_vel_ratio_zero"],
    "H4_amp_vel_ratio_base": ["pos_amp_vel_ratio_base", "neg_amp_vel_ratio_base"],
    "H6_closing_times": ["closing_time_zero", "reopening_time_zero"],
    "H7_time_shut_base": ["time_shut_base"],
    "H10_peaks": ["peak_max_blink", "peak_time_blink"],
    "H11_interval_to_next": ["inter_blink_max_amp"],
    "H12_velocity_times": ["inter_blink_max_vel_base", "inter_blink_max_vel_zero"],
}.items():
    _part(_name, "H1_properties", _columns, ("ch", "start_blink"))
for _name, _columns in {
    "H5_amp_vel_ratio_tent": ["neg_amp_vel_ratio_tent", "pos_amp_vel_ratio_tent"],
    "H8_tent_times": ["closing_time_tent", "reopening_time_tent"],
    "H9_time_shut_tent": ["time_shut_tent"],
}.items():
    _part(_name, "H2_fitted_properties", _columns, ("ch", "start_blink"))


@query("F21_group_by_epoch", "SELECT ch, epoch_id, count(*) AS n_blinks, min(start_rel) AS first_start FROM ow GROUP BY ALL")
def _(spark, d):
    w, _ = _windows_in_epochs(spark, d)
    return w.groupBy("ch", "epoch_id").agg(F.count("*").alias("n_blinks"), F.min("start_rel").alias("first_start"))


@query("G2_windows", "SELECT ch, epoch_id, unnest(blink_onset) AS onset, unnest(blink_duration) AS duration FROM mapped")
def _(spark, d):
    return metadata.windows(_mapped(spark, d)[0], F.lit("ear")).select("ch", "epoch_id", "onset", "duration")


@query("G3_sample_windows", "SELECT ch, epoch_id, win_start, win_stop - win_start AS frames FROM win")
def _(spark, d):
    m, _ = _mapped(spark, d)
    w = metadata.sample_windows(metadata.windows(m, F.lit("ear")), P.sfreq, FRAMES)
    return w.select("ch", "epoch_id", "win_start", (F.col("win_stop") - F.col("win_start")).alias("frames"))


@query("G8_kinematics_wide", "SELECT ep.epoch_id, " + ", ".join(f"round(max(p) FILTER (ep.ch = '{c}'), 4) AS peak_amp_mean_{c}" for c in ("click", "view")) + f" FROM ep LEFT JOIN (SELECT ch, epoch_id, avg({_KIN['peak_amp']}) AS p FROM wx GROUP BY ALL) AS w USING (ch, epoch_id) GROUP BY ep.epoch_id")
def _(spark, d):
    w, s = _window_signals(spark, d)
    every = _epochs(s).select("rec_id", F.col("rec_id").alias("ch"), "epoch_id")
    table = features.epoch_table(w, every, kernels.kinematics, P.sfreq).withColumn("rec_id", F.lit("events"))
    out = features.wide(table, ["click", "view"], ["peak_amp_mean"])
    return _round(out, ["peak_amp_mean_click", "peak_amp_mean_view"], 4, ("epoch_id",))


@query("G10_epoch_morphology", _stats({"peak_to_peak": "CASE WHEN len(x) >= 3 THEN list_max(x) - list_min(x) END", "duration": "duration"}, 5))
def _(spark, d):
    return _table(spark, d, features.morphology_with_duration, 5, ["peak_to_peak", "duration"])


@query("I3_epochs_with_events", "SELECT ch, epoch_id, count(*) AS n_blinks FROM ow GROUP BY ALL")
def _(spark, d):
    return _windows_in_epochs(spark, d)[0].groupBy("ch", "epoch_id").agg(F.count("*").alias("n_blinks"))


@query("I4_mini_segments", f"SELECT l.ch, e.epoch_id, printf('epoch_%04d_%07.2fs-%07.2fs_raw', e.epoch_id, epoch_id * {SECONDS}, least((epoch_id + 1) * {FRAMES}, n - 1) / 100.0) AS name FROM len AS l, (SELECT unnest(range((SELECT CAST(max(n) // {FRAMES} + 1 AS BIGINT) FROM len))) AS epoch_id) AS e WHERE epoch_id < ceil((n - 1) / {FRAMES})")
def _(spark, d):
    e = epochs.all_epochs(landmarks.channel_lengths(_samples(spark, d)).select(F.col("ch").alias("rec_id"), "n"), FRAMES)
    return e.select(F.col("rec_id").alias("ch"), "epoch_id", epochs.segment_name(F.col("epoch_id"), F.col("start_i") / P.sfreq, F.col("end_i") / P.sfreq).alias("name"))


@query("I7_refined_segments", f"SELECT a.ch, CAST(floor(onset / {SECONDS}) AS BIGINT) AS epoch_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS places FROM (SELECT *, row_number() OVER (PARTITION BY ch, floor(onset / {SECONDS}) ORDER BY onset) AS k FROM ann) AS a JOIN ep ON ep.ch = a.ch AND ep.epoch_id = floor(onset / {SECONDS}) GROUP BY ALL")
def _(spark, d):
    s = _own(_samples(spark, d))
    ann = _ann(spark, d)
    refined = metadata.refine_annotations(ann, features.epoch_signals(s, FRAMES), SECONDS, P.sfreq, FRAMES)
    both = epochs.zip_by_place(refined.select("ch", "epoch_id", "onset"), ann.withColumn("epoch_id", F.floor(F.col("onset") / SECONDS)).select("ch", "epoch_id", "onset", "label"), ["ch", "epoch_id"], "onset")
    from pyspark.sql import Window as W

    return both.withColumn("k", F.row_number().over(W.partitionBy("ch", "epoch_id").orderBy("onset"))).groupBy("ch", "epoch_id").agg(F.count("*").alias("n"), F.sum("k").cast("bigint").alias("places"))


@query("K1_stream_window_counts", """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY ALL), m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, event_type, n FROM w, m WHERE s + INTERVAL 1 HOUR <= mark""")
def _(spark, d):
    from ocutide.streaming.detect import counts_by_window, run_to_end

    schema = _read(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = run_to_end(counts_by_window(stream, "ts", "1 hour", "10 minutes"), "counts")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
