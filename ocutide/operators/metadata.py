"""Modality, channel picks, polymorphic cells, refinement and event lists per epoch."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ocutide.functions import arrays as A
from ocutide.model import KEYS


def _field(name: str):
    return lambda x: x[name]


def modality(ch: Column, rule: str = "a") -> Column:
    """Modality by channel name under one of three rules that differ in order and default."""
    name = F.lower(ch)
    if rule == "a":
        return F.when(name.contains("eeg"), "eeg").when(name.contains("eog"), "eog").otherwise("ear")
    if rule == "b":
        return F.when(name.contains("ear"), "ear").when(name.contains("eog"), "eog").otherwise("eeg")
    if rule == "c":
        return F.when(name.contains("ear"), "EAR").otherwise("EEG")
    raise ValueError(f"unknown rule: {rule}")


def pick_channels(samples: DataFrame, picks: str | Iterable[str], available: Iterable[str] | None = None) -> DataFrame:
    """Samples of some channels; ValueError for one that isn't there (B1)."""
    wanted = [picks] if isinstance(picks, str) else list(picks)
    if available is None:
        available = [r["ch"] for r in samples.where(F.col("ch").isin(wanted)).select("ch").distinct().collect()]  # the picks at most
    if missing := [c for c in wanted if c not in set(available)]:
        raise ValueError(f"channels not found: {', '.join(missing)}")
    return samples.where(F.col("ch").isin(wanted))


def as_list(cell: Column, kind: str) -> Column:
    """A cell as an array: of a scalar one element, of a string the list it spells, of NULL none."""
    none = F.array().cast("array<double>")
    if kind == "string":
        text = F.trim(cell)
        lists = F.from_json(text, "array<double>")
        return F.coalesce(F.when(text.startswith("["), lists).otherwise(F.when(text.try_cast("double").isNotNull(), F.array(text.try_cast("double")))), none)
    if kind.startswith("array"):
        return F.coalesce(F.filter(cell.cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x)), none)
    return F.when(cell.isNull() | F.isnan(cell.cast("double")), none).otherwise(F.array(cell.cast("double")))


def fit_length(arr: Column, n: Column | int, fill: Column) -> Column:
    """An array cut or padded to n elements."""
    size = F.lit(n) if isinstance(n, int) else n
    return F.slice(F.concat(arr, F.array_repeat(fill, F.greatest(size - F.size(arr), F.lit(0)))), F.lit(1), size)


def outer_defaults(meta: Column, k: Column, default: Column) -> Column:
    """The k-th (0-based) bound of a metadata list, or the window's own."""
    return F.coalesce(F.get(meta, k.cast("int")), default)


def windows(meta: DataFrame, mod: Column, modalities: Iterable[str] = ("eeg", "eog", "ear")) -> DataFrame:
    """Onset and duration of each window of an epoch, of the modality's own lists where there are any, else of the general ones.

    Pairs with a missing value are skipped, surplus elements of the longer list ignored.
    """
    pick = lambda what: F.coalesce(*(F.when((mod == m) & F.col(f"blink_{what}_{m}").isNotNull(), F.col(f"blink_{what}_{m}")) for m in modalities if f"blink_{what}_{m}" in meta.columns), F.col(f"blink_{what}"))
    pairs = meta.withColumn("w", F.explode(F.arrays_zip(pick("onset").alias("o"), pick("duration").alias("d"))))
    out = pairs.withColumns({"onset": F.col("w")["o"], "duration": F.col("w")["d"]}).drop("w")
    return out.where("onset IS NOT NULL AND duration IS NOT NULL")


def sample_range(onset: Column, duration: Column, sfreq: float, n: int | Column) -> tuple[Column, Column]:
    """First and exclusive last frame of a window, rounded half to even, then clamped (G1)."""
    size = F.lit(n) if isinstance(n, int) else n
    start = F.rint(onset * sfreq).cast("bigint")
    stop = start + F.rint(duration * sfreq).cast("bigint")
    return F.greatest(start, F.lit(0).cast("bigint")), F.least(stop, size.cast("bigint"))


def sample_windows(rows: DataFrame, sfreq: float, n: int) -> DataFrame:
    """Windows as frames, those of more than one frame."""
    start, stop = sample_range(F.col("onset"), F.col("duration"), sfreq, n)
    return rows.withColumns({"win_start": start, "win_stop": stop}).where("win_stop - win_start > 1")


def local_maximum(blinks: DataFrame, n: int) -> DataFrame:
    """Start and end clamped to the segment; the given peak if it lies inside, else the window's first maximum (E13). ``sig`` is the segment."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))
    out = blinks.withColumns({"refined_start_frame": clamp(F.col("start_rel")), "refined_end_frame": clamp(F.col("end_rel"))})
    lo, hi = F.col("refined_start_frame"), F.col("refined_end_frame")
    found = lo + A.argmax(A.between(F.col("sig"), F.lit(0).cast("bigint"), lo, hi))
    return out.withColumn("refined_peak_frame", F.when(F.col("peak_rel").between(lo, hi), F.col("peak_rel")).otherwise(found))


def trough_middle(blinks: DataFrame) -> DataFrame:
    """Start and end as given, and the middle between them as the trough (E13, eye-aspect-ratio stub)."""
    middle = F.floor((F.col("start_rel") + F.col("end_rel")) / 2)
    return blinks.withColumns({"refined_start_frame": F.col("start_rel"), "refined_peak_frame": middle, "refined_end_frame": F.col("end_rel")})


def refine_annotations(ann: DataFrame, signals: DataFrame, seconds: float, sfreq: float, n: int) -> DataFrame:
    """Annotations refined in the segment where they begin (E14): frames rounded half to even, then ``local_maximum``. ``signals``: keys, epoch_id, x."""
    rel = F.col("onset") - F.col("epoch_id") * seconds
    frame = lambda x: F.rint(x * sfreq).cast("bigint")
    rows = ann.withColumn("epoch_id", F.floor(F.col("onset") / seconds)).join(signals.withColumnRenamed("x", "sig"), [*KEYS, "epoch_id"])
    rows = rows.withColumns({"start_rel": frame(rel), "end_rel": frame(rel + F.col("duration")), "peak_rel": F.lit(None).cast("bigint")})
    return local_maximum(rows, n)


def refine_with(blinks: DataFrame, refine, by: list[str]) -> DataFrame:
    """Refinement by a user's function ``(signal, start, end, peak) -> (start, peak, end)`` (L1), in Arrow batches of blinks."""
    schema = ", ".join(f"`{c}` {t}" for c, t in blinks.select(*by).dtypes) + ", refined_start_frame bigint, refined_peak_frame bigint, refined_end_frame bigint"

    def apply(frames):
        for pdf in frames:
            rows = [refine(s, a, b, None if pd.isna(p) else p) for s, a, b, p in zip(pdf["sig"], pdf["start_rel"], pdf["end_rel"], pdf["peak_rel"], strict=True)]
            yield pdf[by].assign(**{c: pd.array([r[k] for r in rows], "Int64") for k, c in enumerate(("refined_start_frame", "refined_peak_frame", "refined_end_frame"))})

    return blinks.select(*dict.fromkeys([*by, "sig", "start_rel", "end_rel", "peak_rel"])).mapInPandas(apply, schema)


def modality_mean(samples: DataFrame, rule: str = "a") -> DataFrame:
    """Mean over the channels of each modality, frame by frame."""
    m = samples.withColumn("modality", modality(F.col("ch"), rule))
    return m.groupBy("rec_id", "modality", "i").agg(F.avg("v").alias("v"))


def event_lists(blinks: DataFrame, epochs: DataFrame, sfreq: float, columns: Iterable[str] = ()) -> DataFrame:
    """Blinks of each epoch as lists ordered by blink_id, missing values left out of each list; onset, duration, number (F19). ``blinks``: rec_id, epoch_id, blink_id, ..."""
    rows = blinks.withColumns({"blink_onset": F.col("start_blink") / F.lit(sfreq), "blink_duration": (F.col("end_blink") - F.col("start_blink")) / F.lit(sfreq)})
    names = ["blink_onset", "blink_duration", *columns]
    lists = rows.groupBy("rec_id", "epoch_id").agg(F.array_sort(F.collect_list(F.struct("blink_id", *names))).alias("a"), F.count("*").alias("n_blinks"))
    cells = [F.filter(F.transform("a", _field(c)), lambda x: x.isNotNull()).alias(c if c.startswith("blink_") else f"blink_{c}") for c in names]
    out = epochs.select("rec_id", "epoch_id").join(lists, ["rec_id", "epoch_id"], "left")
    return out.select("rec_id", "epoch_id", *cells, F.coalesce("n_blinks", F.lit(0).cast("bigint")).alias("n_blinks"))


def number_blinks(blinks: DataFrame, by: tuple[str, ...] = KEYS, order: str = "start_blink") -> DataFrame:
    """blink_id, dense from 0 per group."""
    from pyspark.sql import Window as W

    return blinks.withColumn("blink_id", F.row_number().over(W.partitionBy(*by).orderBy(order)).cast("bigint") - 1)
