"""Landmarks of a blink: peak, zero crossings, bases, half heights, fit ranges.

Samples are joined to blinks once, as one array per blink that spans its
neighbours' peaks; every later search is an array expression, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.functions.scan import last_known, next_known
from ocutide.model import BLINK, KEYS


def attach_signal(rows: DataFrame, samples: DataFrame, lo: Column, hi: Column, by: tuple[str, ...] = BLINK, name: str = "sig") -> DataFrame:
    """``rows`` with the frames lo to hi of their channel as an array, and its first frame ``{name}_lo``.

    A range join as an equi-join: ranges are exploded into frames.  ``by`` tells rows apart.
    """
    keyed = rows.withColumns({"_lo": lo.cast("bigint"), "_hi": hi.cast("bigint")})
    frames = keyed.where("_lo <= _hi").select(*by, F.explode(F.sequence("_lo", "_hi")).alias("i"))
    found = frames.join(samples.select(*KEYS, "i", "v"), [*KEYS, "i"]).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("_s"))
    joined = keyed.join(found, list(by), "left")
    return joined.withColumns({name: F.transform("_s", lambda x: x["v"]), f"{name}_lo": F.get("_s", F.lit(0))["i"]}).drop("_s", "_lo", "_hi")


def find_peaks(blinks: DataFrame, samples: DataFrame, kind: str = "max") -> DataFrame:
    """max_value and max_blink over [start, end], first extreme: largest value (E1), magnitude ("abs", E2) or smallest value ("min", E3)."""
    with_sig = attach_signal(blinks, samples, F.col("start_blink"), F.col("end_blink"))
    sig = F.col("sig")
    where = {"max": A.argmax(sig), "min": A.argmin(sig), "abs": A.argmax(F.transform(sig, F.abs))}[kind]
    peak = with_sig.withColumn("max_blink", F.col("sig_lo") + where)
    return peak.withColumn("max_value", A.at(sig, F.col("sig_lo"), F.col("max_blink"))).drop("sig", "sig_lo")


def outer_bounds(blinks: DataFrame, lengths: DataFrame, last_frame: bool = False) -> DataFrame:
    """The neighbours' peaks; 0 before the first, the length (or the last frame) after the last (E4). ``lengths``: keys, n."""
    w = W.partitionBy(*KEYS).orderBy("max_blink")
    end = F.col("n") - (1 if last_frame else 0)
    out = blinks.join(lengths, list(KEYS))
    return out.withColumns({"outer_start": F.coalesce(F.lag("max_blink").over(w), F.lit(0).cast("bigint")), "outer_end": F.coalesce(F.lead("max_blink").over(w), end)})


def channel_lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy(*KEYS).agg((F.max("i") + 1).alias("n"))


def zero_crossings(blinks: DataFrame, samples: DataFrame) -> DataFrame:
    """left_zero: last frame before the peak below zero; right_zero: first from the peak on.

    As-of lookups in both directions by two scans, then an equi-join at the peak.
    Outer bounds don't matter: the fallback to the whole side finds the same frames.
    """
    below = F.when(F.col("v") < 0, F.col("i"))
    near = next_known(last_known(samples, {"left_zero": below}, own=False), {"right_zero": below}, own=True)
    return blinks.join(near.select(*KEYS, F.col("i").alias("max_blink"), "left_zero", "right_zero"), [*KEYS, "max_blink"], "left")


def with_hull(blinks: DataFrame, samples: DataFrame) -> DataFrame:
    """Blinks with the signal from before the outer start to past the outer end and the zeros, and its velocity.

    The frame after each end belongs to it: the velocity at the end needs it.
    """
    lo = F.greatest(F.least(F.col("outer_start") - 1, "left_zero", "start_blink"), F.lit(0).cast("bigint"))
    hi = F.least(F.greatest("outer_end", "right_zero", "end_blink") + 1, F.col("n") - 1)
    return attach_signal(blinks, samples, lo, hi).withColumn("vel", A.differences(F.col("sig")))


def bases(hulls: DataFrame) -> DataFrame:
    """Frames of extreme velocity, and the base frames beside them (E6 to E9); rows without any of them go.

    A left base before the first frame is the first frame.
    """
    lo, vel = F.col("sig_lo"), F.col("vel")
    c = F.col
    out = hulls.where("left_zero IS NOT NULL AND right_zero IS NOT NULL AND sig IS NOT NULL")
    out = out.withColumns({
        "max_pos_vel_frame": c("left_zero") + A.argmax(A.between(vel, lo, c("left_zero"), c("max_blink"))),
        "max_neg_vel_frame": c("max_blink") + A.argmin(A.between(vel, lo, c("max_blink"), c("right_zero"))),
    }).where("outer_start < max_pos_vel_frame")
    up = A.between(vel, lo, c("outer_start"), c("max_pos_vel_frame"))
    left = c("max_pos_vel_frame") - F.coalesce(F.size(up) - 1 - A.last_index(up, lambda x: x <= 0), F.lit(0)) - 1
    end = F.least(c("outer_end"), c("n") - 1) - 1
    down = A.between(vel, lo, c("max_neg_vel_frame"), end)
    right = F.when((c("max_neg_vel_frame") <= c("outer_end")) & (c("max_neg_vel_frame") <= end), c("max_neg_vel_frame") + F.coalesce(A.first_index(down, lambda x: x >= 0), F.lit(0)) + 1)
    return out.withColumns({"left_base": F.greatest(left, F.lit(0).cast("bigint")), "right_base": right}).where("right_base IS NOT NULL")


def half_heights(blinks: DataFrame) -> DataFrame:
    """Frames halfway between the peak and the left base, and between the peak and zero."""
    c, lo, sig = F.col, F.col("sig_lo"), F.col("sig")
    top = A.at(sig, lo, c("max_blink"))
    half = top - 0.5 * (top - A.at(sig, lo, c("left_base")))
    zero = 0.5 * top
    first = lambda a, b, test: F.coalesce(A.first_index(A.between(sig, lo, a, b), test), F.lit(0))
    peak = c("max_blink")
    return blinks.withColumns({"_half": half, "_zero": zero}).withColumns({
        "left_zero_half_height": c("left_zero") + first(c("left_zero"), peak, lambda x: x >= c("_zero")) + 1,
        "right_zero_half_height": F.least(c("outer_end"), peak + first(peak, c("right_zero"), lambda x: x <= c("_zero"))),
        "left_base_half_height": c("left_base") + first(c("left_base"), peak, lambda x: x >= c("_half")) + 1,
        "right_base_half_height": F.least(c("outer_end"), peak + first(peak, F.least(c("outer_end"), c("n") - 1), lambda x: x <= c("_half"))),
    }).drop("_half", "_zero")


def fit_ranges(blinks: DataFrame, base_fraction: float) -> DataFrame:
    """Frames of the rising and falling flank to fit lines to (E11): left_lo..left_hi, right_lo..right_hi; blinks with a flank of fewer than two go."""
    c, lo, sig = F.col, F.col("sig_lo"), F.col("sig")
    high, low = A.at(sig, lo, c("max_blink")), A.at(sig, lo, c("left_zero"))
    out = blinks.withColumns({"_top": high - base_fraction * (high - low), "_bottom": low + base_fraction * (high - low)})
    up, down = A.between(sig, lo, c("left_zero"), c("max_blink")), A.between(sig, lo, c("max_blink"), c("right_zero"))
    out = out.withColumns({
        "left_lo": c("left_zero") + A.first_index(up, lambda x: x > c("_bottom")),
        "left_hi": c("left_zero") + A.last_index(up, lambda x: x < c("_top")),
        "right_lo": c("max_blink") + F.coalesce(A.first_index(down, lambda x: x < c("_top")), F.lit(0)),
        "right_hi": c("max_blink") + A.last_index(down, lambda x: x > c("_bottom")),
    }).drop("_top", "_bottom")
    return out.where("left_hi - left_lo >= 1 AND right_hi - right_lo >= 1")


def locate(blinks: DataFrame, samples: DataFrame) -> DataFrame:
    """From start and end of blinks to peak, outer bounds, zeros, hull and bases (E12 without the fit)."""
    peaks = find_peaks(blinks, samples)
    bounded = outer_bounds(peaks, channel_lengths(samples))
    return bases(with_hull(zero_crossings(bounded, samples), samples))
