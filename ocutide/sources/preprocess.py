"""Filtering and resampling of signals (A2)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocutide.functions.scan import next_known
from ocutide.model import KEYS

BLOCK = 4096


def bandpass_taps(low: float, high: float, sfreq: float, n: int = 101) -> list[float]:
    """Windowed-sinc taps (Hamming) of a linear-phase band-pass; n odd."""
    m = n // 2
    sinc = lambda f, k: 2 * f / sfreq if k == 0 else math.sin(2 * math.pi * f / sfreq * k) / (math.pi * k)
    return [(sinc(high, k) - sinc(low, k)) * (0.54 + 0.46 * math.cos(math.pi * k / m)) for k in range(-m, m + 1)]


def fir(samples: DataFrame, taps: list[float], block: int = BLOCK) -> DataFrame:
    """Convolution with symmetric taps; zeros beyond the ends.

    Samples are gathered in blocks with a halo of half the taps, so a long channel is
    spread over many tasks and each block is filtered by array expressions.
    """
    half = len(taps) // 2
    lo, hi = F.floor((F.col("i") - half) / block), F.floor((F.col("i") + half) / block)
    spread = samples.select(*KEYS, "i", "v", F.explode(F.sequence(F.greatest(lo, F.lit(0).cast("bigint")), hi)).alias("b"))
    blocks = spread.groupBy(*KEYS, "b").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    x = blocks.select(*KEYS, F.transform("s", lambda r: r["v"]).alias("x"), F.get("s", F.lit(0))["i"].alias("lo"), "b", F.size("s").alias("m"))
    kernel = F.array(*map(F.lit, taps))
    own_lo = F.greatest(F.col("b") * block, F.col("lo"))
    own_hi = F.least((F.col("b") + 1) * block, F.col("lo") + F.col("m")) - 1
    value = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(2 * half)), F.lit(0.0), lambda a, j: a + F.coalesce(F.get("x", F.greatest((i - F.col("lo")).cast("int") - half + j, F.lit(-1))), F.lit(0.0)) * F.get(kernel, j))
    out = x.where(own_lo <= own_hi).select(*KEYS, F.explode(F.transform(F.sequence(own_lo, own_hi), lambda i: F.struct(i.alias("i"), value(i).alias("v")))).alias("r"))
    return out.select(*KEYS, "r.i", "r.v")


def resample(samples: DataFrame, sfreq: float, rate: float) -> DataFrame:
    """Linear interpolation at another rate (A2).

    Each frame gives the new frames that lie between it and the next one, which a scan
    in chunks finds; a channel's last frame gives those at its own place.
    """
    step, c = sfreq / rate, F.col
    ahead = next_known(samples.select(*KEYS, "i", "v"), {"_next": c("v")}, own=False)
    low, high = F.ceil(c("i") / step), F.ceil((c("i") + 1) / step) - 1
    frames = ahead.where(low <= high).select(*KEYS, "i", "v", "_next", F.explode(F.sequence(low, high)).alias("k"))
    near = frames.where((c("k") * step == c("i")) | c("_next").isNotNull())
    return near.select(*KEYS, c("k").alias("i"), (c("v") + (F.coalesce("_next", "v") - c("v")) * (c("k") * step - c("i"))).alias("v"))
