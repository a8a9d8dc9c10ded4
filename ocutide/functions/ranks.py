"""Exact medians and ranks of groups of any size, without a task that holds a group.

Quantiles of a mergeable sketch say where values lie; exact counts do the rest.  The
sketch only decides which rows meet, so its error costs work but no exactness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accuracy of the sketch (an error of n / ACCURACY ranks), and reach about the median, ten times that.
ACCURACY, REACH = 10_000, 0.001
#: Parts that the values of a group are ranked in.
PARTS = 64


def exact_median(df: DataFrame, value: Column, keys: Sequence[str], name: str, beside: dict[str, Column] | None = None) -> DataFrame:
    """Median of a column per key, NULL where there is no value, and the aggregates ``beside`` it.

    Only values within REACH of the middle are told apart, after being combined where
    they are read; those below are a count.
    """
    c, also = F.col, list(beside or {})
    rows = df.withColumn("_v", value)
    near = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [0.5 - REACH, 0.5 + REACH], ACCURACY).alias("_near"), *(a.alias(n) for n, a in (beside or {}).items()))
    met = rows.select(*keys, "_v").join(near, list(keys)).where(F.coalesce(c("_v") <= c("_near")[1], c("_near").isNull()))
    counts = met.groupBy(*keys, *also, "_n", F.when(c("_v") >= c("_near")[0], c("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = counts.withColumn("_to", F.sum("_c").over(W.partitionBy(*keys).orderBy(c("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)))
    first = lambda rank: F.min(F.when(c("_to") >= rank, c("_v")))
    low, high = first(F.floor((c("_n") + 1) / 2)), first(F.floor(c("_n") / 2) + 1)
    return upto.groupBy(*keys, *also).agg((0.5 * low + 0.5 * high).alias(name))


def rows_below(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Per distinct value of a group the rows that have it (``ties``) and those of a smaller one (``below``).

    A group's values are dealt to PARTS ranges; running sums go within a range, and what
    lies before it comes from one row per range.
    """
    c = F.col
    cuts = [k / PARTS for k in range(1, PARTS)]
    splits = df.groupBy(*by).agg(F.percentile_approx(value, cuts, ACCURACY).alias("_splits"))
    counts = df.groupBy(*by, value).agg(F.count("*").alias("ties")).join(splits, list(by))
    dealt = counts.withColumn("_part", F.size(F.filter("_splits", lambda s: s < c(value)))).drop("_splits")
    return running_sum(dealt, by, "_part", value, "ties", "below").drop("_part")


def running_sum(df: DataFrame, by: Sequence[str], part: str, order: str, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows before each one of its group, where ``part`` cuts the order into ranges and ``order`` has no ties."""
    inside = W.partitionBy(*by, part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    along = W.partitionBy(*by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint"))
    before = df.groupBy(*by, part).agg(F.sum(amount).alias("_sum")).select(*by, part, zero(F.sum("_sum").over(along)).alias("_before"))
    out = df.join(before, [*by, part]).withColumn(name, F.col("_before") + zero(F.sum(amount).over(inside)))
    return out.drop("_before")
