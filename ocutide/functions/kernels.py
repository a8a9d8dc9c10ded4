"""Features of one window of samples, as struct columns over an array ``x``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ocutide.functions import arrays as A


def _abs_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v))


def _interior(x: Column) -> Column:
    """Teager-Kaiser energy of the inner samples."""
    n = F.greatest(F.size(x) - 2, F.lit(0))
    return F.transform(F.slice(x, 2, n), lambda v, k: v * v - F.get(x, k) * F.get(x, k + 2))


def tkeo(x: Column) -> Column:
    """Teager-Kaiser energy of each sample, 0 at the ends (G4d)."""
    return F.transform(x, lambda v, k: F.when((k == 0) | (k == F.size(x) - 1), 0.0).otherwise(v * v - F.get(x, k - 1) * F.get(x, k + 1)))


def trapezoid(x: Column, dt: float) -> Column:
    """Integral by trapezoids."""
    ends = (F.get(x, F.lit(0)) + F.get(x, F.size(x) - 1)) / 2
    return F.when(F.size(x) > 0, (A.total(x) - ends) * dt)


def gradient(x: Column, sfreq: float) -> Column:
    """Central differences, one-sided at the ends."""
    last = F.size(x) - 1

    def one(_: Column, k: Column) -> Column:
        lo, hi = F.greatest(k - 1, F.lit(0)), F.least(k + 1, last)
        return (F.get(x, hi) - F.get(x, lo)) / (hi - lo) * sfreq

    return F.transform(x, one)


def window_energy(x: Column, sfreq: float) -> dict[str, Column]:
    """Energies of a metadata window (G4a); NULL for an empty one."""
    n = F.size(x)
    d = A.differences(x)
    some = lambda c: F.when(n > 0, c)
    return {
        "blink_signal_energy": some(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)),
        "teager_kaiser_energy": F.when(n >= 3, _abs_sum(_interior(x)) / (n - 2)),
        "blink_line_length": some(_abs_sum(d)),
        "blink_velocity_integral": some(F.aggregate(d, F.lit(0.0), lambda a, v: a + F.abs(v * sfreq))),
    }


def blink_energy(x: Column, sfreq: float) -> dict[str, Column]:
    """Energies of a refined blink or a segment (G4b, G4c): integrals over time, not sums; NULL below two samples."""
    dt = 1.0 / sfreq
    n = F.size(x)
    return {
        "energy": F.when(n >= 2, trapezoid(F.transform(x, lambda v: v * v), dt)),
        "teager": F.when(n > 2, _abs_sum(_interior(x)) * dt),
        "line_length": F.when(n >= 2, _abs_sum(A.differences(x))),
        "velocity_integral": F.when(n >= 2, trapezoid(F.transform(gradient(x, sfreq), F.abs), dt)),
    }


def kinematics(x: Column, sfreq: float) -> dict[str, Column]:
    """Speed, acceleration, flank times, area and symmetry (G7); NULL for an empty window."""
    a = F.transform(x, F.abs)
    n = F.size(x)
    top, peak = F.array_max(a), A.argmax(a).cast("int")
    d = A.differences(x)
    vel, acc = F.transform(d, lambda v: F.abs(v * sfreq)), F.transform(A.differences(d), lambda v: F.abs(v * sfreq * sfreq))
    steady = lambda i, j, up: F.forall(F.sequence(F.lit(0), j - i - 1), lambda k: (F.get(a, i + k + 1) - F.get(a, i + k)) * (1 if up else -1) >= 0)
    head = F.slice(a, F.lit(1), peak + 1)
    i10, i90 = A.first_index(head, lambda v: v >= 0.1 * top).cast("int"), A.first_index(head, lambda v: v >= 0.9 * top).cast("int")
    tail = F.slice(a, peak + 1, n - peak)
    j90 = peak + A.first_index(tail, lambda v: v <= 0.9 * top).cast("int")
    rest = F.slice(a, j90 + 1, n - j90)
    j10 = j90 + A.first_index(rest, lambda v: v <= 0.1 * top).cast("int")
    left, right = A.total(F.slice(a, F.lit(1), peak)) / sfreq, A.total(tail) / sfreq
    return {
        "peak_amp": top,
        "t2p": peak / F.lit(sfreq),
        "vel_mean": F.when(n >= 2, A.mean(vel)), "vel_peak": F.array_max(vel),
        "acc_mean": F.when(n >= 3, A.mean(acc)), "acc_peak": F.array_max(acc),
        "rise_time": F.when(i90 > i10, F.when(steady(i10, i90, True), (i90 - i10) / F.lit(sfreq))),
        "fall_time": F.when(j10 > j90, F.when(steady(j90, j10, False), (j10 - j90) / F.lit(sfreq))),
        "auc": F.when(n > 0, A.total(a) / sfreq),
        "symmetry": F.when(n > 0, (left - right) / (left + right + 1e-8)),
    }


def morphology(x: Column, sfreq: float) -> dict[str, Column]:
    """Shape of a blink (G9); NULL below three samples."""
    n = F.size(x)
    peak, trough, p = F.array_max(x), F.array_min(x), A.argmax(x).cast("int")
    half = trough + 0.5 * (peak - trough)
    left = A.last_index(F.slice(x, F.lit(1), p + 1), lambda v: v <= half)
    right = p + A.first_index(F.slice(x, p + 1, n - p), lambda v: v <= half)
    d = F.transform(A.differences(x), lambda v: v * sfreq)
    cols = {
        "peak_amplitude": peak, "trough_amplitude": trough, "peak_to_peak": peak - trough,
        "area_abs": trapezoid(F.transform(x, F.abs), 1.0 / sfreq),
        "rise_time": p / F.lit(sfreq), "fall_time": (n - 1 - p) / F.lit(sfreq),
        "half_width": F.when(right > left, (right - left) / F.lit(sfreq)),
        "slope_rise": F.array_max(d), "slope_fall": F.array_min(d),
    }
    return {k: F.when(n >= 3, c) for k, c in cols.items()}
