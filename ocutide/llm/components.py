"""Connected components: forests within partitions of bounded size, then alternating large and small stars between them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocutide.llm.storage import discard, stored


#: Rows to a task: a small table dealt to many tasks costs more in shuffle files than in work.
ROWS = 200_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows, in as many partitions as that takes."""
    return df.coalesce(2 + rows // ROWS)


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n)
    return few(both.where("v > u").join(least, "u"), n).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = few(down.groupBy("u").agg(F.min("v").alias("m")), n)
    near = few(down.join(least, "u"), n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _put(edges: DataFrame, n: int) -> DataFrame:
    return stored(few(edges, n), "edges")


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each node of a partition's edges to the smallest node it is connected with there."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := above.setdefault(x, x)) != x:
            above[x] = above[y]
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                above[max(a, b)] = min(a, b)
    pairs = [(x, top(x)) for x in list(above) if top(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (u, v) with the smallest node of its component: node, label.

    What a partition of some ROWS edges holds is contracted by one task.  Where there are
    several, a round moves the edges four times; their number does not grow, and the
    number of rounds is about the logarithm of the longest path.
    """
    n = edges.count()
    parts = 1 + n // ROWS
    cur = stored(edges.select("u", "v").coalesce(parts).mapInArrow(_forest, "u bigint, v bigint"), "edges")
    mark = None
    while parts > 1:
        now = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first()
        if now == mark:
            break
        mark = now
        old, cur = cur, _put(_small(_large(cur, n), n), n)
        discard(old)
    # every edge now leads from a node to the smallest of its component
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
    out._stored_at = cur._stored_at  # to be discarded with it
    return out
