"""Event detection: threshold sessionisation of a signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.functions.ranks import exact_median
from ocutide.functions.scan import last_known
from ocutide.model import KEYS, MAD_SCALE, Params


def robust_stats(df: DataFrame, value: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Mean, exact median and unscaled median absolute deviation of a column per key (F1)."""
    by = list(keys)
    centre = exact_median(df, F.col(value), by, "med", {"mean": F.avg(value)})
    apart = df.select(*by, value).join(centre, by)
    return exact_median(apart, F.abs(F.col(value) - F.col("med")), by, "mad", {n: F.any_value(n) for n in ("mean", "med")})


def thresholds(samples: DataFrame, p: Params) -> DataFrame:
    """Detection threshold of each channel."""
    s = robust_stats(samples, "v")
    return s.select(*KEYS, (F.col("mean") + F.lit(p.std_threshold) * MAD_SCALE * F.col("mad")).alias("thr"))


def crossings(samples: DataFrame, thr: DataFrame) -> DataFrame:
    """Runs above the threshold: start, and the first frame below it; a run open at the end has none.

    A sample that equals the threshold keeps the state.
    """
    state = F.when(F.col("v") > F.col("thr"), 1).when(F.col("v") < F.col("thr"), 0)
    marked = samples.join(thr, list(KEYS)).select(*KEYS, "i", state.alias("st")).where("st IS NOT NULL")
    edges = last_known(marked, {"before": F.col("st")}, own=False).where("st <> coalesce(before, 0)")
    closed = W.partitionBy(*KEYS).orderBy("i")
    runs = edges.select(*KEYS, "st", F.col("i").alias("start_blink"), F.lead("i").over(closed).alias("end_blink"))
    return runs.where("st = 1").drop("st")


def drop_close_pairs(runs: DataFrame, p: Params) -> DataFrame:
    """Both of two neighbours go whose gap is at most the shortest event (they aren't merged)."""
    w = W.partitionBy(*KEYS).orderBy("start_blink")
    gap = lambda a, b: F.coalesce((a - b) / F.lit(p.sfreq) <= p.min_event_len, F.lit(False))
    near = gap(F.col("start_blink"), F.lag("end_blink").over(w)) | gap(F.lead("start_blink").over(w), F.col("end_blink"))
    return runs.withColumn("near", near).where("NOT near").drop("near")


def detect_blinks(samples: DataFrame, p: Params, whole_frames: bool = False) -> DataFrame:
    """Blinks of each channel: start_blink, end_blink (first frame below) (D1; ``whole_frames``: least length truncated to frames, D2)."""
    least = float(int(p.min_event_len * p.sfreq)) if whole_frames else p.min_event_len * p.sfreq
    runs = crossings(samples, thresholds(samples, p)).where(F.col("end_blink") - F.col("start_blink") > least)
    return drop_close_pairs(runs, p)


def detect_troughs(samples: DataFrame, p: Params) -> DataFrame:
    """Blinks of eye-aspect-ratio channels, which are troughs: detection on the negated signal (D5, our definition)."""
    return detect_blinks(samples.withColumn("v", -F.col("v")), p)


def concatenated(samples: DataFrame, epochs: DataFrame) -> DataFrame:
    """Samples of the kept epochs as one signal; ``frame`` is the true frame (D3).

    Places follow from the lengths of the epochs before, which are few; samples are not ranked.
    """
    before = W.partitionBy("rec_id").orderBy("start_i").rowsBetween(W.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(F.col("end_i") - F.col("start_i")).over(before), F.lit(0)) - F.col("start_i")
    frames = epochs.select("rec_id", "epoch_id", "start_i", "end_i", shift.alias("shift")).select("rec_id", "epoch_id", "start_i", "end_i", "shift", F.explode(F.sequence("start_i", F.col("end_i") - 1)).alias("i"))
    return samples.join(frames, ["rec_id", "i"]).withColumnRenamed("i", "frame").withColumn("i", (F.col("frame") + F.col("shift")).cast("bigint")).drop("shift", "epoch_id", "start_i", "end_i")


def micropauses(samples: DataFrame, by: tuple[str, ...], in_blink: str, p: Params, ratio: float = 0.5, least: float = 0.1, most: float = 0.3) -> DataFrame:
    """Runs of low samples outside blinks, of a length in seconds, per group of ``by``."""
    whole = W.partitionBy(*by)
    open_mean = F.avg(F.when(~F.col(in_blink), F.col("v"))).over(whole)
    low = samples.withColumn("low", ~F.col(in_blink) & (F.col("v") <= ratio * open_mean))
    runs = low.where("low").withColumn("run", F.col("i") - F.row_number().over(whole.orderBy("i")))
    lengths = runs.groupBy(*by, "run").agg((F.count("*") / F.lit(p.sfreq)).alias("s"))
    found = lengths.groupBy(*by).agg(F.count_if((F.col("s") >= least) & (F.col("s") <= most)).alias("micropause_count"))
    return samples.select(*by).distinct().join(found, list(by), "left").withColumn("micropause_count", F.coalesce("micropause_count", F.lit(0).cast("bigint")))
