"""Searches in arrays that hold a stretch of a signal.

A stretch is an array ``sig`` whose first element is frame ``lo``.  Frames go in and
come out; ranges are inclusive, empty where their end is before their start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Test = Callable[[Column], Column]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def between(sig: Column, lo: Column, a: Column, b: Column) -> Column:
    """Frames ``a`` to ``b`` of a stretch, as far as it has them."""
    first = F.greatest(a - lo, F.lit(0).cast("bigint"))
    return F.slice(sig, (first + 1).cast("int"), F.greatest(b - lo - first + 1, F.lit(0)).cast("int"))


def at(sig: Column, lo: Column, frame: Column) -> Column:
    return F.get(sig, (frame - lo).cast("int"))


def first_index(arr: Column, test: Test) -> Column:
    """Index of the first element that passes; NULL if none does."""
    return _found(F.array_position(F.transform(arr, test), F.lit(True)))


def last_index(arr: Column, test: Test) -> Column:
    return let(F.transform(arr, test), lambda a: F.size(a) - 1 - _found(F.array_position(F.reverse(a), F.lit(True))))


def _found(position: Column) -> Column:
    return let(position, lambda p: F.when(p > 0, p - 1))


def argmax(arr: Column) -> Column:
    """Index of the first greatest element."""
    return let(arr, lambda a: _found(F.array_position(a, F.array_max(a))))


def argmin(arr: Column) -> Column:
    return let(arr, lambda a: _found(F.array_position(a, F.array_min(a))))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def mean(arr: Column) -> Column:
    return let(arr, lambda a: F.try_divide(total(a), F.size(a)))


def differences(arr: Column) -> Column:
    """Each element less the one before it; one fewer than the array has."""
    return F.zip_with(F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))), F.slice(arr, 1, F.greatest(F.size(arr) - 1, F.lit(0))), lambda b, a: b - a)


def line(first: Column, y: Column) -> Column:
    """Least-squares line through (first, y[0]), (first + 1, y[1]), ...: struct of slope, intercept and r (of y and its fit)."""


    def fitted(y: Column, n: Column, half: Column, my: Column) -> Column:
        sxx = n * (n * n - 1) / F.lit(12.0)
        sums = F.struct(
            total(F.transform(y, lambda v, k: (k - half) * (v - my))).alias("xy"),
            total(F.transform(y, lambda v: (v - my) * (v - my))).alias("yy"),
        )
        return let(sums, lambda s: let(F.try_divide(s["xy"], sxx), lambda slope: F.struct(
            slope.alias("slope"),
            (my - slope * (first + half)).alias("intercept"),
            F.abs(F.try_divide(s["xy"], F.sqrt(sxx * s["yy"]))).alias("r"),
        )))

    return let(y, lambda a: let(F.struct(F.size(a).alias("n"), mean(a).alias("m")), lambda t: fitted(a, t["n"], (t["n"] - 1) / 2.0, t["m"])))
