"""Blink statistics per channel, blink filters, and the choice of a channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.model import KEYS, MAD_SCALE, Params


def blink_mask(blinks: DataFrame) -> DataFrame:
    """Frames inside blinks, from one before the left zero to one before the right (C6): keys, i, each once."""
    return blinks.select(*KEYS, F.explode(F.sequence(F.col("left_zero") - 1, F.col("right_zero") - 1)).alias("i")).distinct()


def outside_blinks(samples: DataFrame, blinks: DataFrame) -> DataFrame:
    """Samples outside all blinks, first to last frame of each blink included."""
    frames = blinks.select(*KEYS, F.explode(F.sequence("start_blink", "end_blink")).alias("i"))
    return samples.join(frames, [*KEYS, "i"], "left_anti")


def amp_ratio(samples: DataFrame, blinks: DataFrame) -> DataFrame:
    """Mean positive sample inside blinks over that outside, per channel."""
    flagged = samples.where("v > 0").join(blink_mask(blinks).withColumn("inside", F.lit(True)), [*KEYS, "i"], "left")
    inside = F.avg(F.when(F.col("inside"), F.col("v")))
    return flagged.groupBy(*KEYS).agg(F.try_divide(inside, F.avg(F.when(F.col("inside").isNull(), F.col("v")))).alias("blink_amp_ratio"))


def blink_statistics(blinks: DataFrame, samples: DataFrame, p: Params) -> DataFrame:
    """One row per channel with blinks: counts, amplitude ratio, medians and spreads of best and worst blinks, cutoff, good ratio."""
    c = F.col
    graded = blinks.withColumns({"best": (c("left_r2") >= p.best_corr) & (c("right_r2") >= p.best_corr), "good": (c("left_r2") >= p.good_corr) & (c("right_r2") >= p.good_corr)})
    medians = graded.groupBy(*KEYS).agg(F.median(F.when(c("best"), c("max_value"))).alias("best_median"), F.median(F.when(~c("good"), c("max_value"))).alias("worst_median"))
    spread = lambda group, centre: MAD_SCALE * F.median(F.when(group, F.abs(c("max_value") - c(centre))))
    both = graded.join(medians, list(KEYS)).groupBy(*KEYS, "best_median", "worst_median").agg(
        F.count("*").alias("number_blinks"),
        F.count_if("good").alias("number_good_blinks"),
        spread(c("best"), "best_median").alias("best_robust_std"),
        spread(~c("good"), "worst_median").alias("worst_robust_std"),
    )
    near = F.abs(c("max_value") - c("best_median")) <= 2 * c("best_robust_std")
    ratio = graded.join(both.select(*KEYS, "best_median", "best_robust_std"), list(KEYS)).groupBy(*KEYS).agg(F.try_divide(F.count_if(c("good") & near), F.count_if(near)).alias("good_ratio"))
    cutoff = F.try_divide(c("best_median") * c("worst_robust_std") + c("worst_median") * c("best_robust_std"), c("best_robust_std") + c("worst_robust_std"))
    return both.withColumn("cutoff", cutoff).join(ratio, list(KEYS)).join(amp_ratio(samples, blinks), list(KEYS), "left")


def good_blink(p: Params) -> Column:
    """Whether fit and height of a blink agree with its channel's best blinks."""
    c = F.col

    def within(corr: float, z: float) -> Column:
        low = F.greatest(c("best_median") - z * c("best_robust_std"), F.lit(0.0))
        return (c("left_r2") >= corr) & (c("right_r2") >= corr) & c("max_value").between(low, c("best_median") + z * c("best_robust_std"))

    return F.coalesce(within(p.good_corr, p.good_z) | within(p.best_corr, p.best_z), F.lit(False))


def keep_good(blinks: DataFrame, stats: DataFrame, p: Params) -> DataFrame:
    """Blinks that pass the mask, with their channel's best median and spread."""
    joined = blinks.join(stats.select(*KEYS, "best_median", "best_robust_std"), list(KEYS))
    return joined.where(good_blink(p))


def quality(blinks: DataFrame, stats: DataFrame, p: Params) -> DataFrame:
    """Blinks with ``blink_quality`` Good or Bad, which a filter may use."""
    joined = blinks.join(stats.select(*KEYS, "best_median", "best_robust_std"), list(KEYS), "left")
    return joined.withColumn("blink_quality", F.when(good_blink(p), "Good").otherwise("Bad"))


def restrict_ratio(blinks: DataFrame, p: Params) -> DataFrame:
    """Without blinks of a low amplitude-velocity ratio that are low as well."""
    weak = (F.col("pos_amp_vel_ratio_zero") < p.p_avr_threshold) & (F.col("max_value") < F.col("best_median") - F.col("best_robust_std"))
    return blinks.where(~F.coalesce(weak, F.lit(False)))


def _filter_unless_empty(df: DataFrame, test: Column) -> DataFrame:
    """Rows that pass, or all rows of a recording where none does."""
    any_ = F.max(test).over(W.partitionBy("rec_id"))
    return df.withColumns({"_ok": F.coalesce(test, F.lit(False)), "_any": F.coalesce(any_, F.lit(False))}).where("_ok OR NOT _any").drop("_ok", "_any")


def select_channels(stats: DataFrame, p: Params) -> DataFrame:
    """Channels left by the cascade of amplitude ratio, number of good blinks and good ratio."""
    out = _filter_unless_empty(stats, F.col("blink_amp_ratio").between(*p.amp_range))
    out = _filter_unless_empty(out, F.col("number_good_blinks") > p.min_good_blinks)
    return _filter_unless_empty(out, F.col("good_ratio") >= p.min_good_ratio)


def representative_channel(stats: DataFrame, channels: DataFrame, p: Params, mode: str = "first") -> DataFrame:
    """The chosen channel of each recording (F10): the first by ``ord``, or with mode "max" that of the most good blinks."""
    if mode not in ("first", "max"):
        raise ValueError(f"unknown mode: {mode}")
    order = [F.col("number_good_blinks").desc(), F.col("ord")] if mode == "max" else [F.col("ord")]
    left = select_channels(stats, p).join(channels.select(*KEYS, "ord"), list(KEYS))
    return left.withColumn("_k", F.row_number().over(W.partitionBy("rec_id").orderBy(*order))).where("_k = 1").drop("_k")
