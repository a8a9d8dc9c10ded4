"""Running lookups along a signal that split one long channel over many tasks.

A window over a whole channel puts the channel into one task.  These functions cut
it into chunks of ``CHUNK`` frames: windows run within a chunk, and what a chunk needs
from those before (or after) it comes from a summary of one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.model import KEYS

CHUNK = 1 << 20


def _scan(df: DataFrame, wanted: dict[str, Column], forward: bool, own: bool, keys: Sequence[str], order: str, chunk: int) -> DataFrame:
    """For each name the latest non-null value at or before (``own``), or before, a row; after it with ``forward``."""
    part = [*keys, "_chunk"]
    sort = F.col(order).desc() if forward else F.col(order).asc()
    df = df.withColumns({"_chunk": F.floor(F.col(order) / chunk)} | {f"_{n}": c for n, c in wanted.items()})
    inside = W.partitionBy(*part).orderBy(sort).rowsBetween(W.unboundedPreceding, 0 if own else -1)
    pick = F.min_by if forward else F.max_by
    held = df.groupBy(*part).agg(*(pick(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_{n}") for n in wanted))
    along = W.partitionBy(*keys).orderBy(F.col("_chunk").desc() if forward else F.col("_chunk").asc()).rowsBetween(W.unboundedPreceding, -1)
    carried = held.select(*part, *(F.last(f"_{n}", True).over(along).alias(f"_carry_{n}") for n in wanted))
    out = df.join(carried, part).withColumns({n: F.coalesce(F.last(f"_{n}", True).over(inside), F.col(f"_carry_{n}")) for n in wanted})
    return out.drop("_chunk", *(f"_{n}" for n in wanted), *(f"_carry_{n}" for n in wanted))


def last_known(df: DataFrame, wanted: dict[str, Column], own: bool = True, keys: Sequence[str] = KEYS, order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Columns of the latest non-null values up to each row."""
    return _scan(df, wanted, False, own, keys, order, chunk)


def next_known(df: DataFrame, wanted: dict[str, Column], own: bool = True, keys: Sequence[str] = KEYS, order: str = "i", chunk: int = CHUNK) -> DataFrame:
    """Columns of the next non-null values from each row on."""
    return _scan(df, wanted, True, own, keys, order, chunk)


def velocity(samples: DataFrame, name: str = "vel") -> DataFrame:
    """First difference to the next frame; NULL at a channel's end (E5)."""
    ahead = next_known(samples, {"_next": F.col("v")}, own=False)
    return ahead.withColumn(name, F.col("_next") - F.col("v")).drop("_next")
