"""Report pages with a line plot per blink (A5), drawn by string expressions on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocutide.model import KEYS, require
from ocutide.operators.landmarks import attach_signal

WIDTH, HEIGHT = 600, 120


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", " ")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _line(sig: Column) -> Column:
    """Points of a polyline that fills the plot; a missing value lies at the bottom, a flat signal in the middle."""
    low, span = F.array_min(sig), F.array_max(sig) - F.array_min(sig)
    across = F.lit(float(WIDTH)) / F.greatest(F.size(sig) - 1, F.lit(1))
    up = lambda v: F.coalesce(F.try_divide(F.coalesce(v, low) - low, span), F.lit(0.5))
    return F.array_join(F.transform(sig, lambda v, j: F.concat(F.round(j * across, 1), F.lit(","), F.round(HEIGHT * (1 - up(v)), 1))), " ")


def blink_pages(windows: DataFrame, samples: DataFrame, sfreq: float) -> DataFrame:
    """One page per recording and epoch: rec_id, epoch_id, page. ``windows``: keys, epoch_id, epoch_start (frame), win_lo and win_hi (frames of the epoch)."""
    require(windows, [*KEYS, "epoch_id", "epoch_start", "win_lo", "win_hi"])
    by, c = (*KEYS, "epoch_id", "win_lo", "win_hi"), F.col
    drawn = attach_signal(windows.select(*by, "epoch_start").distinct(), samples, c("epoch_start") + c("win_lo"), c("epoch_start") + c("win_hi"), by)
    title = F.concat(_escaped(c("ch")), F.format_string(" %.2f s", (c("epoch_start") + c("win_lo")) / F.lit(sfreq)))
    plot = F.concat(F.lit(f'<svg viewBox="0 0 {WIDTH} {HEIGHT}"><polyline fill="none" stroke="black" points="'), F.coalesce(_line(c("sig")), F.lit("")), F.lit('"/></svg>'))
    section = F.concat(F.lit("<section><h3>"), title, F.lit("</h3>"), plot, F.lit("</section>"))
    pages = drawn.groupBy("rec_id", "epoch_id").agg(F.array_sort(F.collect_list(F.struct("win_lo", "ch", section.alias("html")))).alias("s"))
    head = F.concat(F.lit('<!doctype html><meta charset="utf-8"><h2>'), _escaped(c("rec_id")), F.format_string(", epoch %d</h2>", "epoch_id"))
    return pages.select("rec_id", "epoch_id", F.concat(head, F.array_join(F.transform("s", lambda r: r["html"]), "")).alias("page"))


def write_report(pages: DataFrame, path: str, overwrite: bool = False) -> None:
    """Pages in a folder per recording, one per line of its files; an existing report is an error unless overwritten."""
    pages.repartition("rec_id", "epoch_id").sortWithinPartitions("rec_id", "epoch_id").select("rec_id", F.col("page").alias("value")).write.mode("overwrite" if overwrite else "error").partitionBy("rec_id").text(path)
