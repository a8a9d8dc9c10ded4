"""Correlation of paired columns, and p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ocutide.functions.ranks import rows_below, running_sum

#: Ranks that a running sum of Kendall's tau covers in one task.
SPAN = 1 << 20
KINDS, ROWS, TAILS = ("Pearson", "Spearman", "Kendall"), ("all", "complete", "pairwise"), ("both", "right", "left")


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for k in range(300):
        m = k // 2
        n = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or 1e-300)
        c = (1 + n / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def two_sided(r: float, n: float) -> float | None:
    """p-value of a correlation under Student's t with n - 2 degrees of freedom."""
    if r is None or n is None or pd.isna(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return _beta(df / 2, 0.5, df / (df + t2))


def kendall_p(tau: float, n: float) -> float | None:
    """p-value of Kendall's tau by its normal limit."""
    if tau is None or pd.isna(tau) or n < 2:
        return None
    return math.erfc(abs(tau) / math.sqrt(2 * (2 * n + 5) / (9 * n * (n - 1))) / math.sqrt(2))


@F.pandas_udf(DoubleType())
def _p_pearson(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([two_sided(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def _p_kendall(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([kendall_p(a, b) for a, b in zip(r, n, strict=True)], dtype="float64")


def _tailed(p: Column, r: Column, tail: str) -> Column:
    if tail == "both":
        return p
    return F.when((r > 0) == (tail == "right"), p / 2).otherwise(1 - p / 2)


def average_rank(df: DataFrame, by: list[str], c: str, name: str) -> DataFrame:
    """Rank of a value in its group, ties at their mean."""
    ranks = rows_below(df, by, c).select(*by, c, (F.col("below") + (F.col("ties") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, c])


def weighted_corr(df: DataFrame, by: list[str], x: str, y: str, w: str) -> DataFrame:
    """Weighted Pearson correlation per group (F3), from sums about the weighted means."""
    c = F.col
    mean = lambda v: F.sum(c(w) * c(v)) / F.sum(w)
    centred = df.join(df.groupBy(*by).agg(mean(x).alias("_mx"), mean(y).alias("_my")), by)
    dx, dy = c(x) - c("_mx"), c(y) - c("_my")
    return centred.groupBy(*by).agg(F.try_divide(F.sum(c(w) * dx * dy), F.sqrt(F.sum(c(w) * dx * dx) * F.sum(c(w) * dy * dy))).alias("r"))


def corr(df: DataFrame, by: list[str], x: str, y: str, kind: str = "Pearson", rows: str = "all", tail: str = "both", weights: str | None = None) -> DataFrame:
    """Coefficient ``r`` and p-value ``p`` of two columns per group (F2); below two rows both are NULL.

    ``rows``: "all" gives NULL where a value is missing, "complete" leaves such rows
    out, "pairwise" is as "all".  Weights count for Pearson only, without a p-value.
    Ranks and Kendall's tau-b come from counts, so a group may be of any size.
    """
    for value, known in ((kind, KINDS), (rows, ROWS), (tail, TAILS)):
        if value not in known:
            raise ValueError(f"unknown option: {value}")
    full = F.col(x).isNotNull() & F.col(y).isNotNull()
    lacking = df.groupBy(*by).agg(F.min(full).alias("_full"), F.count_if(full).alias("n"))
    base = df.where(full)
    if kind == "Pearson" and weights:
        found = weighted_corr(base, by, x, y, weights).withColumn("p", F.lit(None).cast("double"))
    elif kind == "Kendall":
        found = _kendall(base, by, x, y)
        found = found.withColumn("p", _tailed(_p_kendall("r", F.col("m").cast("double")), F.col("r"), tail)).drop("m")
    else:
        if kind == "Spearman":
            base = average_rank(average_rank(base, by, x, "_x"), by, y, "_y")
            x, y = "_x", "_y"
        m = F.count("*")
        found = base.groupBy(*by).agg(F.when(m > 1, F.corr(x, y)).alias("r"), m.alias("m"))
        found = found.withColumn("p", _tailed(_p_pearson("r", F.col("m").cast("double")), F.col("r"), tail)).drop("m")
    ok = F.lit(True) if rows == "complete" else F.col("_full")
    out = lacking.join(found, by, "left")
    return out.select(*by, "n", F.when(ok & (F.col("n") > 1), F.col("r")).alias("r"), F.when(ok & (F.col("n") > 1), F.col("p")).alias("p"))


def _kendall(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Tau-b from the number of pairs that rise in both columns, counted by halving.

    Two places in the order of x first differ in one binary digit; at that digit the row
    that has 0 is below the other.  So per digit and common prefix, running sums along y
    count the pairs: rows times digits in all, and no task holds a group.
    """
    c, pairs = F.col, lambda n: n * (n - 1) / 2
    # equal rows are combined first, so that ties don't grow
    both = df.groupBy(*by, c(x).cast("double").alias("_x"), c(y).cast("double").alias("_y")).agg(F.count("*").alias("_m"))
    n = both.groupBy(*by).agg(F.sum("_m").alias("m"), F.sum(pairs(c("_m"))).alias("_txy"))
    placed = both
    for v in ("_x", "_y"):
        values = rows_below(df.select(*by, c(x if v == "_x" else y).cast("double").alias(v)), by, v)
        n = n.join(values.groupBy(*by).agg(F.sum(pairs(c("ties"))).alias(f"_t{v}")), by)
        placed = placed.join(values.select(*by, v, c("below").alias(f"_r{v}")), [*by, v])
    digits = n.select(*by, F.length(F.bin(c("m"))).alias("_digits"))
    spread = placed.join(digits, by).select(*by, "_r_x", "_r_y", "_m", F.posexplode(F.sequence(F.lit(1), "_digits")).alias("_digit", "_")).drop("_")
    digit = F.expr("shiftright(_r_x, _digit) & 1")
    node = [*by, "_digit", "_prefix"]
    halves = spread.withColumn("_prefix", F.expr("shiftright(_r_x, _digit + 1)")).groupBy(*node, "_r_y").agg(F.sum(F.when(digit == 0, c("_m")).otherwise(0)).alias("_low"), F.sum(F.when(digit == 1, c("_m")).otherwise(0)).alias("_high"))
    run = running_sum(halves.withColumn("_part", F.floor(c("_r_y") / SPAN)), node, "_part", "_r_y", "_low", "_under")
    rising = run.groupBy(*by).agg(F.sum(c("_under") * c("_high")).cast("double").alias("_up"))
    total = pairs(c("m"))
    score = 2 * c("_up") - (total - c("_t_x") - c("_t_y") + c("_txy"))
    return rising.join(n, by).select(*by, F.try_divide(score, F.sqrt((total - c("_t_x")) * (total - c("_t_y")))).alias("r"), "m")
