"""Epochs as tumbling windows of frames, and events in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.model import KEYS


def _field(name: str):
    return lambda x: x[name]


def epoch_of(frame: Column, frames: int) -> Column:
    return F.floor(frame / F.lit(frames))


def full_epochs(lengths: DataFrame, frames: int) -> DataFrame:
    """Complete epochs of each recording (I3): rec_id, epoch_id, start_i, end_i (exclusive). ``lengths``: rec_id, n."""
    return _tiles(lengths, F.floor(F.col("n") / frames), frames)


def full_segments(lengths: DataFrame, frames: int) -> DataFrame:
    """Segments that end at the time of the last frame at most (I1): as ``full_epochs``, but one less where the length is a whole multiple."""
    return _tiles(lengths, F.floor((F.col("n") - 1) / frames), frames)


def _tiles(lengths: DataFrame, k: Column, frames: int) -> DataFrame:
    ids = lengths.where(k > 0).select("rec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("epoch_id"))
    return ids.select("rec_id", "epoch_id", (F.col("epoch_id") * frames).alias("start_i"), ((F.col("epoch_id") + 1) * frames).alias("end_i"))


def all_epochs(lengths: DataFrame, frames: int) -> DataFrame:
    """Epochs with a shorter last one (I2); the end is the last frame at most."""
    last = F.col("n") - 1
    k = F.ceil(last / frames)
    ids = lengths.where(k > 0).select("rec_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), k - 1)).alias("epoch_id"))
    return ids.select("rec_id", "epoch_id", (F.col("epoch_id") * frames).alias("start_i"), F.least((F.col("epoch_id") + 1) * frames, last).alias("end_i"))


def epoch_bounds(events: DataFrame, tmin: float, sfreq: float, n: int) -> DataFrame:
    """First and last frame of epochs around event frames."""
    start = F.col("event") + F.rint(F.lit(tmin * sfreq)).cast("bigint")
    return events.withColumns({"start_i": start, "last_i": start + n - 1})


def annotations(blinks: DataFrame, sfreq: float, label: str = "eye_blink") -> DataFrame:
    """Blinks as onset and duration in seconds with one label."""
    return blinks.select(*KEYS, (F.col("start_blink") / F.lit(sfreq)).alias("onset"), ((F.col("end_blink") - F.col("start_blink")) / F.lit(sfreq)).alias("duration"), F.lit(label).alias("label"))


def with_label(ann: DataFrame, label: str | None, any_case: bool = False) -> DataFrame:
    """Annotations of a label, exactly or in any case; all for None (B2)."""
    if label is None:
        return ann
    return ann.where(F.lower("label") == label.lower()) if any_case else ann.where(F.col("label") == label)


def annotation_frames(ann: DataFrame, label: str | None, sfreq: float, first_time: float = 0.0) -> DataFrame:
    """Frames of annotations that begin strictly after the recording's first time, truncated."""
    kept = with_label(ann, label).where(F.col("onset") > first_time)
    frame = lambda x: ((x - first_time) * sfreq).cast("bigint")
    return kept.withColumns({"start_blink": frame(F.col("onset")), "end_blink": frame(F.col("onset") + F.col("duration"))})


def annotations_in_epochs(ann: DataFrame, epochs: DataFrame, seconds: float) -> DataFrame:
    """Each epoch with the onsets (relative), durations and number of annotations that begin in it (C3); an equi-join, as epochs tile the time."""
    hits = ann.withColumn("epoch_id", F.floor(F.col("onset") / seconds)).groupBy("rec_id", "epoch_id")
    rel = F.struct((F.col("onset") - F.col("epoch_id") * seconds).alias("onset"), "duration")
    lists = hits.agg(F.array_sort(F.collect_list(rel)).alias("a"))
    out = epochs.join(lists, ["rec_id", "epoch_id"], "left")
    return out.select("rec_id", "epoch_id", *(F.coalesce(F.transform("a", _field(k)), F.array().cast("array<double>")).alias(f"blink_{k}") for k in ("onset", "duration")), F.coalesce(F.size("a"), F.lit(0)).alias("n_blinks"))


def onset_counts(ann: DataFrame, epochs: DataFrame, frames: int, sfreq: float) -> DataFrame:
    """Number of annotations that begin in each epoch, the shorter last one included."""
    hits = ann.withColumn("epoch_id", F.floor(F.col("onset") * sfreq / frames)).groupBy("rec_id", "epoch_id").agg(F.count("*").alias("blink_count"))
    return epochs.join(hits, ["rec_id", "epoch_id"], "left").withColumn("blink_count", F.coalesce("blink_count", F.lit(0).cast("bigint")))


def boundary_pairs(ann: DataFrame, n_epochs: Column, seconds: float) -> DataFrame:
    """Neighbouring epochs that an annotation spans."""
    e = F.floor(F.col("onset") / seconds)
    spans = (F.col("onset") + F.col("duration") > (e + 1) * seconds) & (e + 1 < n_epochs)
    return ann.where(spans).select("rec_id", e.alias("epoch_id"), (e + 1).alias("next_epoch_id")).distinct()


def overlaps(blinks: DataFrame, frames: int) -> DataFrame:
    """Each blink with each equally long epoch that it overlaps, ends included: a range join as an equi-join on the epoch."""
    ids = F.sequence(epoch_of(F.col("start_blink"), frames), epoch_of(F.col("end_blink"), frames))
    hits = blinks.withColumn("epoch_id", F.explode(ids))
    first, last = F.col("epoch_id") * frames, (F.col("epoch_id") + 1) * frames - 1
    shared = F.least("end_blink", last) - F.greatest("start_blink", first) + 1
    return hits.withColumns({"ep_start": first, "fraction": shared / (F.col("end_blink") - F.col("start_blink") + 1)})


def assign_epochs(blinks: DataFrame, epochs: DataFrame, frames: int, policy: str = "majority", threshold: float = 0.5) -> DataFrame:
    """Epochs of blinks: all that they overlap ("strict"), or the one of the largest share, of ties the first, if that reaches the threshold."""
    if policy not in ("strict", "majority"):
        raise ValueError(f"unknown policy: {policy}")
    hits = overlaps(blinks, frames).join(epochs.select("rec_id", "epoch_id"), ["rec_id", "epoch_id"])
    if policy == "majority":
        order = W.partitionBy(*KEYS, "start_blink").orderBy(F.col("fraction").desc(), "epoch_id")
        hits = hits.withColumn("_k", F.row_number().over(order)).where((F.col("_k") == 1) & (F.col("fraction") >= threshold)).drop("_k")
    return hits


def map_blinks(blinks: DataFrame, epochs: DataFrame, frames: int, sfreq: float, policy: str = "majority", threshold: float = 0.5) -> DataFrame:
    """Each epoch and channel with lists of onsets (relative, clipped), durations (whole) and their number (C2, D4); epochs without blinks keep empty lists."""
    hits = assign_epochs(blinks, epochs, frames, policy, threshold)
    onset = (F.greatest("start_blink", "ep_start") - F.col("ep_start")) / F.lit(sfreq)
    row = F.struct("start_blink", onset.alias("onset"), ((F.col("end_blink") - F.col("start_blink")) / F.lit(sfreq)).alias("duration"))
    lists = hits.groupBy(*KEYS, "epoch_id").agg(F.array_sort(F.collect_list(row)).alias("a"))
    every = epochs.select("rec_id", "epoch_id").join(blinks.select(*KEYS).distinct(), "rec_id")
    out = every.join(lists, [*KEYS, "epoch_id"], "left")
    return out.select(*KEYS, "epoch_id", *(F.coalesce(F.transform("a", _field(k)), F.array().cast("array<double>")).alias(f"blink_{k}") for k in ("onset", "duration")), F.coalesce(F.size("a"), F.lit(0)).alias("n_blinks"))


def overlap_windows(ann: DataFrame, epochs: DataFrame, seconds: float, sfreq: float) -> DataFrame:
    """Annotations in every epoch that they overlap, as frames within it (C4): half-open, rounded half to even, clipped, at least one frame.

    An annotation across a boundary goes to both epochs; one of no length to none.
    """
    n = int(round(seconds * sfreq))
    end = F.col("onset") + F.col("duration")
    ids = F.sequence(F.floor(F.col("onset") / seconds), F.floor(end / seconds))
    hits = ann.withColumn("epoch_id", F.explode(ids)).join(epochs.select("rec_id", "epoch_id"), ["rec_id", "epoch_id"])
    t0, t1 = F.col("epoch_id") * seconds, (F.col("epoch_id") + 1) * seconds
    hits = hits.where(F.greatest("onset", t0) < F.least(end, t1))
    clip = lambda x: F.least(F.greatest(x, F.lit(0).cast("bigint")), F.lit(n - 1).cast("bigint"))
    start = clip(F.rint((F.greatest("onset", t0) - t0) * sfreq).cast("bigint"))
    stop = clip(F.rint((F.least(end, t1) - t0) * sfreq).cast("bigint") - 1)
    return hits.withColumns({"start_rel": start, "end_rel": F.greatest(stop, start)})


def boundary_cross(epochs: DataFrame, channels: DataFrame) -> DataFrame:
    """Every epoch with every channel of its recording."""
    return epochs.select("rec_id", "epoch_id").join(channels.select(*KEYS), "rec_id")


def remap(blinks: DataFrame, selection: DataFrame) -> DataFrame:
    """Segment numbers of kept epochs: inner join on (rec_id, seg_id), whose result has the epoch's place after drops."""
    return blinks.join(selection.select("rec_id", "seg_id", "epoch_id"), ["rec_id", "seg_id"])


def zip_by_place(left: DataFrame, right: DataFrame, by: list[str], order: str) -> DataFrame:
    """The k-th row of one table beside the k-th of the other, per group (C11)."""
    w = W.partitionBy(*by).orderBy(order)
    return left.withColumn("_k", F.row_number().over(w)).join(right.withColumn("_k", F.row_number().over(w)).drop(order), [*by, "_k"]).drop("_k")


def replace_metadata(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Metadata with recomputed columns, and all that begin with ``blink_`` or ``n_blinks``, taken from ``new`` (C12); running it twice changes nothing."""
    keys = ["rec_id", "epoch_id"]
    keep = [c for c in existing.columns if c in keys or c not in new.columns and not c.startswith(("blink_", "n_blinks"))]
    return existing.select(*keep).join(new, keys, "left")


def segment_name(epoch: Column, start: Column, stop: Column) -> Column:
    """File name of a segment (A3)."""
    return F.format_string("epoch_%04d_%07.2fs-%07.2fs_raw", epoch, start, stop)


def padded_window(blinks: DataFrame, n: int, sfreq: float, before: float = 0.5, after: float = 0.5) -> DataFrame:
    """The union of a blink's rough and refined window, padded and clipped to its epoch (A6): win_lo, win_hi."""
    lo = F.least("start_rel", "refined_start_frame") - int(before * sfreq)
    hi = F.greatest("end_rel", "refined_end_frame") + int(after * sfreq)
    return blinks.withColumns({"win_lo": F.greatest(lo, F.lit(0).cast("bigint")), "win_hi": F.least(hi, F.lit(n - 1).cast("bigint"))})


def first_per_epoch(blinks: DataFrame, limit: int, order: str = "start_rel") -> DataFrame:
    """At most the first ``limit`` blinks of each epoch and channel."""
    w = W.partitionBy(*KEYS, "epoch_id").orderBy(order)
    return blinks.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= limit).drop("_k")


def compare(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Keys of either table and where they are: left_only, right_only or both (C14)."""
    a, b = left.select(*by).distinct().withColumn("_l", F.lit(True)), right.select(*by).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, by, "full_outer").select(*by, side.alias("side"))
