"""Tables and parameters.

``samples``     rec_id, ch, i (0-based frame), v
``blinks``      rec_id, ch, start_blink, end_blink, then a column group per stage
``annotations`` rec_id, ann_id, onset, duration (seconds), label
``epochs``      rec_id, epoch_id, start_i, end_i (exclusive)

A missing value is NULL, never NaN; frames are BIGINT, seconds are DOUBLE.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("rec_id", "ch")
BLINK = (*KEYS, "start_blink")
#: Scale from the median absolute deviation to a standard deviation of normal data.
MAD_SCALE = 1.4826


@dataclass(frozen=True)
class Params:
    """Thresholds of detection, fitting and channel choice (fixed values)."""

    sfreq: float = 100.0
    min_event_len: float = 0.05
    std_threshold: float = 1.5
    base_fraction: float = 0.1
    shut_amp_fraction: float = 0.9
    p_avr_threshold: float = 3.0
    good_corr: float = 0.90
    best_corr: float = 0.98
    good_z: float = 2.0
    best_z: float = 5.0
    amp_range: tuple[float, float] = (3.0, 50.0)
    min_good_blinks: int = 10
    min_good_ratio: float = 0.7


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """ValueError where a table lacks a column."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN of any floating column as NULL, as all operators expect."""
    return df.withColumns({c: F.nanvl(c, F.lit(None).cast(t)) for c, t in df.dtypes if t in ("double", "float")})
