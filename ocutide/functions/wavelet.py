"""Wavelet energies of a window (db4, half-point symmetric extension)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decomposition filters of the Daubechies wavelet with four vanishing moments (fixed values).
DEC_HI = (-0.2303778133088965, 0.7148465705529157, -0.6308807679298589, -0.027983769416859854, 0.18703481171909309, 0.030841381835560764, -0.0328830116668852, -0.010597401785069032)
DEC_LO = (-0.010597401785069032, 0.0328830116668852, 0.030841381835560764, -0.18703481171909309, -0.027983769416859854, 0.6308807679298589, 0.7148465705529157, 0.2303778133088965)
TAPS = 8
MAX_LEVEL = 4


def _reflected(m: Column, n: Column) -> Column:
    """Index of the half-point symmetric extension, of any width."""
    r = F.pmod(m, 2 * n)
    return F.when(r < n, r).otherwise(2 * n - 1 - r)


def convolved(x: Column, taps: tuple[float, ...]) -> Column:
    """Every second value of the filtered, extended array."""
    n = F.size(x)
    filt = F.array(*map(F.lit, taps))
    out = F.floor((n + TAPS - 1) / 2).cast("int")

    def one(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(TAPS - 1)), F.lit(0.0), lambda a, j: a + F.get(filt, j) * F.get(x, _reflected(2 * k + 1 - j, n).cast("int")))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), out - 1), one))


def level_of(x: Column) -> Column:
    """Levels that an array of this length allows, MAX_LEVEL at most."""
    n = F.size(x)
    return F.when(n >= TAPS - 1, F.least(F.floor(F.log2(n / F.lit(float(TAPS - 1)))), F.lit(MAX_LEVEL))).otherwise(0)


def with_energies(df, x: str, sfreq: float, by: list[str]):
    """Per row ``wavelet_energy_d1..d4`` (coarsest first, the conventional labels) and ``detail_energy_L1..L4`` (true level)."""
    cur = df.select(*by, F.col(x).alias("_a"), level_of(F.col(x)).alias("_levels"))
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    for k in range(1, MAX_LEVEL + 1):
        live = F.col("_levels") >= k
        cur = cur.withColumns({f"detail_energy_L{k}": F.when(live, square(convolved(F.col("_a"), DEC_HI))), "_n": F.when(live, convolved(F.col("_a"), DEC_LO)).otherwise(F.col("_a"))}).drop("_a").withColumnRenamed("_n", "_a")
    details = F.array(*(F.col(f"detail_energy_L{k}") for k in range(1, MAX_LEVEL + 1)))
    first = {f"wavelet_energy_d{k}": F.when(F.col("_levels") >= k, F.get(details, (F.col("_levels") - k).cast("int"))) for k in range(1, MAX_LEVEL + 1)}
    if sfreq < 30:  # the finest band would reach past half the rate
        first["wavelet_energy_d1"] = F.lit(None).cast("double")
    return cur.withColumns(first).drop("_a", "_levels")
