"""Line fits of a blink's flanks, and the scalar algebra of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.operators.landmarks import fit_ranges, half_heights


def x_intercept(slope: Column, intercept: Column) -> Column:
    """Where a line meets zero; NULL for a level line."""
    return F.try_divide(-intercept, slope)


def intersection(s1: Column, b1: Column, s2: Column, b2: Column) -> tuple[Column, Column]:
    """Where two lines meet; NULL for parallel ones."""
    x = F.try_divide(b2 - b1, s1 - s2)
    return x, s1 * x + b1


def fit_lines(blinks: DataFrame) -> DataFrame:
    """Lines through both flanks.

    ``left_r2`` and ``right_r2`` are the correlation of the samples with their fit, not
    its square.  The slope from the intersection to an intercept, and the average
    velocity of the flank, are both the fitted slope.
    """
    c, lo, sig = F.col, F.col("sig_lo"), F.col("sig")
    out = blinks.withColumns({
        "_l": A.line(c("left_lo"), A.between(sig, lo, c("left_lo"), c("left_hi"))),
        "_r": A.line(c("right_lo"), A.between(sig, lo, c("right_lo"), c("right_hi"))),
    })
    l, r = c("_l"), c("_r")  # noqa: E741
    x, y = intersection(l["slope"], l["intercept"], r["slope"], r["intercept"])
    return out.withColumns({
        "left_slope": l["slope"], "right_slope": r["slope"],
        "aver_left_velocity": l["slope"], "aver_right_velocity": r["slope"],
        "right_r2": r["r"], "left_r2": l["r"],
        "x_intersect": x, "y_intersect": y,
        "left_x_intercept": x_intercept(l["slope"], l["intercept"]),
        "right_x_intercept": x_intercept(r["slope"], r["intercept"]),
    }).drop("_l", "_r")


def fit_blinks(located: DataFrame, base_fraction: float) -> DataFrame:
    """Half heights, fit ranges and lines of located blinks."""
    return fit_lines(fit_ranges(half_heights(located), base_fraction))


def polyfit(groups: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Straight line per group on centred and scaled x: p0, p1, mu, sigma, df, normr, rsquared (F4, degree 1)."""
    n, sxx, syy = F.count(x), F.regr_sxx(y, x), F.regr_syy(y, x)
    sse = F.greatest(syy - F.try_divide(F.regr_sxy(y, x) * F.regr_sxy(y, x), sxx), F.lit(0.0))
    return groups.groupBy(*by).agg(
        (F.regr_slope(y, x) * F.stddev_samp(x)).alias("p0"), F.avg(y).alias("p1"),
        F.avg(x).alias("mu"), F.stddev_samp(x).alias("sigma"),
        F.greatest(n - 2, F.lit(0).cast("bigint")).alias("df"), F.sqrt(sse).alias("normr"), F.regr_r2(y, x).alias("rsquared"),
    )


def polyval(points: DataFrame, fits: DataFrame, by: list[str], x: str = "x") -> DataFrame:
    """Value and standard error of prediction of fitted lines at points (F4); infinite without degrees of freedom."""
    z = (F.col(x) - F.col("mu")) / F.col("sigma")
    n = F.col("df") + 2
    # the inverse of the triangular factor in closed form, for centred and scaled x
    spread = F.sqrt(1 + 1 / n + z * z / (n - 1))
    delta = F.when(F.col("df") > 0, F.col("normr") / F.sqrt("df") * spread).otherwise(F.lit(float("inf")))
    return points.join(fits, by).select(*points.columns, (F.col("p0") * z + F.col("p1")).alias("y_fit"), delta.alias("delta"))
