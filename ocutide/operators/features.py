"""Feature tables per blink, per epoch and channel, and per segment."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.functions import kernels, wavelet
from ocutide.model import KEYS
from ocutide.operators.landmarks import attach_signal

EPOCH = (*KEYS, "epoch_id")
EVENT_FEATURES = ("blink_total", "blink_rate", "ibi")
STATS = ("mean", "std", "cv")
Kernel = Callable[[Column, float], dict[str, Column]]


def epoch_signals(samples: DataFrame, frames: int) -> DataFrame:
    """Each complete epoch of a channel as one array ``x``."""
    tiled = samples.withColumn("epoch_id", F.floor(F.col("i") / frames))
    out = tiled.groupBy(*EPOCH).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s")).where(F.size("s") == frames)
    return out.select(*EPOCH, F.transform("s", lambda r: r["v"]).alias("x"))


def window_signals(windows: DataFrame, samples: DataFrame, frames: int, stop: Column | None = None) -> DataFrame:
    """Windows (keys, epoch_id, win_start, win_stop exclusive) with their samples as ``x``."""
    base = F.col("epoch_id") * frames
    end = F.col("win_stop") - 1 if stop is None else stop
    by = (*EPOCH, "win_start")
    return attach_signal(windows, samples, base + F.col("win_start"), base + end, by, "x").drop("x_lo")


def per_window(windows: DataFrame, kernel: Kernel, sfreq: float) -> DataFrame:
    """One column per metric of a kernel."""
    return windows.withColumns(kernel(F.coalesce("x", F.array().cast("array<double>")), sfreq))


def safe_stats(rows: DataFrame, by: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """Mean, population deviation and their ratio per group and metric, missing values left out (F11): columns ``{metric}_{mean|std|cv}``."""
    aggs = []
    for m in metrics:
        mean, std = F.avg(m), F.stddev_pop(m)
        aggs += [mean.alias(f"{m}_mean"), std.alias(f"{m}_std"), F.when(mean != 0, F.try_divide(std, mean)).alias(f"{m}_cv")]
    return rows.groupBy(*by).agg(*aggs)


def epoch_table(windows: DataFrame, every: DataFrame, kernel: Kernel, sfreq: float) -> DataFrame:
    """Stats of a kernel's metrics over the windows of each epoch and channel; NULL where there is none."""
    metrics = list(kernel(F.array().cast("array<double>"), sfreq))
    stats = safe_stats(per_window(windows, kernel, sfreq), EPOCH, metrics)
    return every.join(stats, list(EPOCH), "left")


def morphology_with_duration(x: Column, sfreq: float) -> dict[str, Column]:
    """Morphology and the window's own duration."""
    return kernels.morphology(x, sfreq) | {"duration": F.col("duration")}


def wide(table: DataFrame, channels: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """One row per epoch, columns ``{metric}_{channel}``."""
    metrics = list(metrics)
    return table.groupBy("rec_id", "epoch_id").agg(*(F.max(F.when(F.col("ch") == c, F.col(m))).alias(f"{m}_{c}") for c in channels for m in metrics))


# -- open eye --------------------------------------------------------------------------


def open_eye(samples: DataFrame, blinks: DataFrame, frames: int, sfreq: float) -> DataFrame:
    """Baseline figures of each complete epoch and channel outside its blinks (G5). ``blinks``: keys, epoch_id, start_rel, end_rel (inclusive).

    Drift and sign changes count along the compacted open samples; perclos and
    micropauses along all samples.  A micropause is a run of low open samples of 0.1 to 0.3 s.
    """
    spans = blinks.where("start_rel <= end_rel").groupBy(*EPOCH).agg(F.collect_set(F.struct("start_rel", "end_rel")).alias("b"))
    x = epoch_signals(samples, frames).join(spans, list(EPOCH), "left")
    shut = lambda k: F.coalesce(F.exists("b", lambda s: (s["start_rel"] <= k) & (k <= s["end_rel"])), F.lit(False))
    x = x.withColumn("shut", F.transform("x", lambda v, k: shut(k)))
    x = x.withColumn("open", F.transform(F.filter(F.arrays_zip("x", "shut"), lambda r: ~r["shut"]), lambda r: r["x"]))
    o, n = F.col("open"), F.size("open")
    x = x.withColumns({"m": A.mean(o), "med": _median(o), "dif": A.differences(o)})
    m = F.col("m")
    var = F.aggregate(o, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
    x = x.withColumns({
        "baseline_mean": m,
        "baseline_std": F.when(n >= 2, F.sqrt(var / (n - 1))),
        "baseline_mad": _median(F.transform(o, lambda v: F.abs(v - F.col("med")))),
        "eye_opening_rms": F.sqrt(F.try_divide(F.aggregate(o, F.lit(0.0), lambda a, v: a + v * v), n)),
        "baseline_drift": F.when(n >= 2, A.line(F.lit(0.0), o)["slope"] * sfreq),
        "zero_crossing_rate": F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("dif") - 1, F.lit(1))), lambda k: (F.get("dif", k) < 0) != (F.get("dif", k - 1) < 0))),
        "perclos": F.try_divide(F.size(F.filter("x", lambda v: v <= 0.2 * m)), F.size("x")),
        "low": F.array_join(F.transform(F.arrays_zip("x", "shut"), lambda r: F.when(~r["shut"] & (r["x"] <= 0.5 * m), "1").otherwise("0")), ""),
    })
    runs = F.filter(F.split("low", "0+"), lambda r: (F.length(r) / F.lit(sfreq) >= 0.1) & (F.length(r) / F.lit(sfreq) <= 0.3))
    names = ["baseline_mean", "baseline_drift", "baseline_std", "baseline_mad", "perclos", "eye_opening_rms", "zero_crossing_rate"]
    return x.select(*EPOCH, F.col("b").isNotNull().alias("has_blinks"), *names, F.coalesce(F.size(runs), F.lit(0)).alias("micropause_count"))


def _median(arr: Column) -> Column:
    middle = lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2
    return A.let(F.array_sort(arr), lambda s: F.when(F.size(s) > 0, middle(s)))


def open_eye_of_blinks(table: DataFrame) -> DataFrame:
    """As ``open_eye``, without figures (and without micropauses) where an epoch has no blink to carry its signal."""
    kept = [c for c in table.columns if c not in (*EPOCH, "has_blinks", "micropause_count")]
    return table.select(*EPOCH, *(F.when(F.col("has_blinks"), F.col(c)).alias(c) for c in kept), F.when(F.col("has_blinks"), F.col("micropause_count")).otherwise(0).alias("micropause_count"))


def open_eye_baseline(table: DataFrame, epochs: Iterable[int] | None = None) -> DataFrame:
    """Mean of each open-eye figure over some epochs, per channel."""
    some = table if epochs is None else table.where(F.col("epoch_id").isin(list(epochs)))
    return some.groupBy(*KEYS).agg(*(F.avg(c).alias(c) for c in table.columns if c not in (*EPOCH, "has_blinks")))


# -- eye-aspect ratio -------------------------------------------------------------------


def ear_metrics(samples: DataFrame, blinks: DataFrame, frames: int, sfreq: float, lookback: float = 3.0) -> DataFrame:
    """Mean before the first-listed blink (of the whole epoch without one), least and greatest sample of each epoch."""
    first = blinks.groupBy(*EPOCH).agg(F.min_by("start_rel", "blink_id").alias("s"))
    x = epoch_signals(samples, frames).join(first, list(EPOCH), "left")
    lo = F.greatest(F.col("s") - int(lookback * sfreq), F.lit(0).cast("bigint"))
    before = A.between(F.col("x"), F.lit(0).cast("bigint"), lo, F.col("s") - 1)
    return x.select(*EPOCH, A.mean(F.when(F.col("s").isNull(), F.col("x")).otherwise(before)).alias("ear_before_blink"), F.array_min("x").alias("ear_min"), F.array_max("x").alias("ear_max"))


# -- events -----------------------------------------------------------------------------


def blink_rates(counts: DataFrame, seconds: float, count: str = "n_blinks") -> DataFrame:
    """blink_total and blinks per minute of each epoch."""
    return counts.withColumns({"blink_total": F.coalesce(F.col(count), F.lit(0)).cast("double"), "blink_rate": F.coalesce(F.col(count), F.lit(0)) / F.lit(seconds) * 60.0})


def mean_interval(meta: DataFrame) -> DataFrame:
    """``ibi``: mean time from one blink's end to the next onset, in list order (F16); NULL below two blinks."""
    n = F.least(F.size("blink_onset"), F.size("blink_duration"))
    gaps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.get("blink_onset", k) - (F.get("blink_onset", k - 1) + F.get("blink_duration", k - 1)))
    return meta.withColumn("ibi", F.when(n >= 2, A.mean(gaps)))


def event_features(meta: DataFrame, picks: Iterable[str], seconds: float, features: Iterable[str] | None = None) -> DataFrame:
    """Requested event features per epoch, intervals once per picked channel."""
    wanted = EVENT_FEATURES if features is None else list(features)
    if unknown := set(wanted) - set(EVENT_FEATURES):
        raise ValueError(f"unknown features: {', '.join(sorted(unknown))}")
    table = mean_interval(blink_rates(meta, seconds))
    cols = [c for c in ("blink_total", "blink_rate") if c in wanted] + ([F.col("ibi").alias(f"ibi_{c}") for c in picks] if "ibi" in wanted else [])
    return table.select("rec_id", "epoch_id", *cols)


def interval_features(blinks: DataFrame, by: Iterable[str], sfreq: float, start: str = "start_blink", end: str = "end_blink") -> DataFrame:
    """Statistics of the times between blinks per group (F13 to F15); groups of fewer than two blinks are all NULL."""
    by = list(by)
    w = W.partitionBy(*by).orderBy(start, end)
    along = w.rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    c = F.col
    gaps = blinks.select(*by, start, end, ((F.lead(start).over(w) - c(end)) / F.lit(sfreq)).alias("x")).where("x IS NOT NULL")
    gaps = gaps.withColumns({"y": F.lead("x").over(w), "z": F.lead("x", 2).over(w), "dev": c("x") - F.avg("x").over(whole)})
    gaps = gaps.withColumn("cum", F.sum("dev").over(along))
    # rank of each of three neighbours, ties by place: one number per order
    pattern = F.when(c("z").isNotNull(), (c("x") > c("y")).cast("int") * 4 + (c("x") > c("z")).cast("int") * 2 + (c("y") > c("z")).cast("int"))
    gaps = gaps.withColumn("pattern", pattern)
    n, s = F.count("x"), F.stddev_samp("x")
    sd1, sd2 = F.sqrt(F.var_samp(c("y") - c("x")) / 2), F.sqrt(F.var_samp(c("x") + c("y")) / 2)
    r = F.max("cum") - F.min("cum")
    stats = gaps.groupBy(*by).agg(
        F.avg("x").alias("ibi_mean"), s.alias("ibi_std"), F.median("x").alias("ibi_median"), F.min("x").alias("ibi_min"), F.max("x").alias("ibi_max"),
        F.when(F.avg("x") != 0, F.try_divide(s, F.avg("x"))).alias("ibi_cv"), F.sqrt(F.avg((c("y") - c("x")) * (c("y") - c("x")))).alias("ibi_rmssd"),
        F.when(n > 2, sd1).alias("poincare_sd1"), F.when(n > 2, sd2).alias("poincare_sd2"), F.when((n > 2) & (sd2 != 0), F.try_divide(sd1, sd2)).alias("poincare_ratio"),
        F.when((n >= 20) & (s > 0) & (r > 0), F.ln(F.try_divide(r, s)) / F.ln(n)).alias("ibi_hurst_exponent"),
    )
    shares = gaps.where("pattern IS NOT NULL").groupBy(*by, "pattern").agg(F.count("*").alias("k")).withColumn("p", c("k") / F.sum("k").over(whole))
    entropy = shares.groupBy(*by).agg((-F.sum(c("p") * F.ln("p"))).alias("ibi_permutation_entropy"))
    return blinks.select(*by).distinct().join(stats, by, "left").join(entropy, by, "left")


def classify(blinks: DataFrame, every: DataFrame, seconds: float, amplitude: str, threshold: float = 0.15) -> DataFrame:
    """Partial and complete blinks of each epoch, totals and per minute, epochs without blinks included."""
    by = [c for c in every.columns if c in EPOCH]
    partial = F.count_if(F.col(amplitude) < threshold)
    counts = blinks.groupBy(*by).agg(partial.alias("p"), F.count_if(F.col(amplitude) >= threshold).alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    out = every.join(counts, by, "left").withColumns({"partial_blink_total": zero("p"), "complete_blink_total": zero("c")}).drop("p", "c")
    return out.withColumns({f"{k}_frequency_bpm": F.col(f"{k}_blink_total") / F.lit(seconds) * 60.0 for k in ("partial", "complete")})


# -- frequency domain -------------------------------------------------------------------


def mean_channel(samples: DataFrame, picks: list[str]) -> DataFrame:
    """The picked channels averaged frame by frame, under the first one's name."""
    return samples.where(F.col("ch").isin(picks)).groupBy("rec_id", "i").agg(F.avg("v").alias("v")).select("rec_id", F.lit(picks[0]).alias("ch"), "i", "v")


def frequency_features(windows: DataFrame, every: DataFrame, sfreq: float) -> DataFrame:
    """Mean wavelet energy of each level over an epoch's windows."""
    energies = wavelet.with_energies(windows, "x", sfreq, [*EPOCH, "win_start"])
    means = [F.avg(c).alias(c) for c in energies.columns if c.startswith(("wavelet_", "detail_"))]
    return every.join(energies.groupBy(*EPOCH).agg(*means), list(EPOCH), "left")
