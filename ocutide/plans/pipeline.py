"""Entry points: detection over recordings, properties of segments, feature tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocutide.model import KEYS, Params, require
from ocutide.operators import channels, detect, epochs, fit, landmarks, metadata, properties
from ocutide.sources import preprocess


def channel_blinks(samples: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """Fitted, filtered blinks with properties, and statistics of all channels at once (M4).

    Order matters: statistics of all fitted blinks, then the mask, then properties
    (of which one looks at the next blink that is left), then the ratio filter.
    """
    # kept at the stages that several later ones read: else each would search the signal again
    located = landmarks.locate(detect.detect_blinks(samples, p).persist(), samples).persist()
    fitted = fit.fit_blinks(located, p.base_fraction).persist()
    stats = channels.blink_statistics(fitted, samples, p).persist()
    kept = channels.keep_good(fitted, stats, p).persist()
    done = properties.fitted(properties.unfitted(kept, p), p, samples)
    return channels.restrict_ratio(done, p), stats


def prepare(samples: DataFrame, sfreq: float, low: float = 0.5, high: float = 20.5, rate: float | None = None, picks: list[str] | None = None) -> tuple[DataFrame, float]:
    """Picked channels, band-passed and resampled, with their rate (A2)."""
    chosen = metadata.pick_channels(samples, picks) if picks else samples
    out = preprocess.fir(chosen, preprocess.bandpass_taps(low, high, sfreq))
    return (preprocess.resample(out, sfreq, rate), rate) if rate and rate != sfreq else (out, sfreq)


def get_blinks(samples: DataFrame, channel_order: DataFrame, p: Params, label: str | None = None, filter_bad: bool = False, mode: str = "first", filtered: tuple[float, float] | None = None, rate: float | None = None) -> dict[str, DataFrame]:
    """Blinks of each recording's representative channel (M1): blinks, annotations, chosen channel, statistics.

    ``filtered``: pass band in Hz; ``rate``: resampling rate.  Frames and seconds are of
    one rate throughout, that of the analysed signal.
    """
    if filtered or rate:
        low, high = filtered or (0.5, 20.5)
        samples, now = prepare(samples, p.sfreq, low, high, rate)
        p = replace(p, sfreq=now)
    blinks, stats = channel_blinks(samples, p)
    chosen = channels.representative_channel(stats, channel_order, p, mode)
    out = blinks.join(chosen.select(*KEYS), list(KEYS), "left_semi")
    if filter_bad:
        out = channels.quality(out.drop("best_median", "best_robust_std"), stats, p).where("blink_quality = 'Good'")
    return {"blinks": out, "annotations": epochs.annotations(out, p.sfreq, label or "eye_blink"), "channel": chosen, "statistics": stats}


def segment_properties(samples: DataFrame, windows: DataFrame, p: Params, run_fit: bool = False) -> DataFrame:
    """Properties of blinks given as windows of epochs (M2). ``windows``: keys, epoch_id, start_blink, end_blink as frames of the recording.

    Each epoch's signal stands alone: neighbours' peaks, zero crossings and searches end at
    its edges.  Peaks are minima in eye-aspect-ratio channels.  Blinks that miss a
    landmark are left out, and blink_id counts those that stay.
    """
    require(windows, [*KEYS, "epoch_id", "start_blink", "end_blink"])
    seg = lambda df: df.withColumn("rec_id", F.concat_ws("\x1f", "rec_id", F.col("epoch_id").cast("string")))
    bounds = windows.select(*KEYS, "epoch_id", "start_i", "end_i").distinct()
    frames = bounds.select(*KEYS, "epoch_id", "start_i", F.explode(F.sequence("start_i", F.col("end_i") - 1)).alias("i"))
    own = seg(samples.join(frames, [*KEYS, "i"])).select(*KEYS, (F.col("i") - F.col("start_i")).alias("i"), "v", "epoch_id")
    rows = seg(windows).select(*KEYS, "epoch_id", (F.col("start_blink") - F.col("start_i")).alias("start_blink"), (F.col("end_blink") - F.col("start_i")).alias("end_blink"))
    ear = metadata.modality(F.col("ch")) == "ear"
    peaks = landmarks.find_peaks(rows.where(~ear), own).unionByName(landmarks.find_peaks(rows.where(ear), own, "min"))
    bounded = landmarks.outer_bounds(peaks, landmarks.channel_lengths(own))
    located = landmarks.bases(landmarks.with_hull(landmarks.zero_crossings(bounded, own), own)).persist()
    if run_fit:
        located = fit.fit_blinks(located, p.base_fraction)
    done = properties.unfitted(located, p)
    done = properties.fitted(done, p, own) if run_fit else done
    numbered = metadata.number_blinks(done, KEYS, "start_blink")
    return numbered.withColumn("rec_id", F.split("rec_id", "\x1f")[0]).withColumnRenamed("epoch_id", "seg_id")


def extract_features(parts: dict[str, DataFrame], every: DataFrame) -> DataFrame:
    """Feature tables side by side, one row per epoch (M3): left joins on (rec_id, epoch_id), columns prefixed by nothing, so names must differ."""
    out = every
    for name in ("events", "ear", "classification", "kinematics", "energy", "open_eye", "frequency", "waveform"):
        if name in parts:
            out = out.join(parts[name], ["rec_id", "epoch_id"], "left")
    return out
