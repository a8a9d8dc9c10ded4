"""Sources and sinks: sample tables, counts, segments, and a signal made from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ocutide.model import KEYS, nan_to_null, require

SAMPLES = "rec_id string, ch string, i bigint, v double"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples in Parquet, best partitioned by rec_id; filters on rec_id and ch reach the files."""
    df = spark.read.parquet(path)
    require(df, [*KEYS, "i", "v"])
    return nan_to_null(df)


def read_fif(path: str) -> DataFrame:
    """A recording in FIF, by the package that knows the format (A1)."""
    try:
        import mne
    except ImportError as e:
        raise NotImplementedError("reading FIF needs the mne package; convert to Parquet elsewhere") from e
    import pandas as pd

    raw = mne.io.read_raw_fif(path, preload=False)
    if not len(raw.annotations):
        raise ValueError("the recording has no annotations")
    spark = SparkSession.active()
    parts = None
    for ch in raw.ch_names:  # one channel at a time: the driver never holds the whole matrix
        v = raw.get_data(picks=ch)[0]
        one = spark.createDataFrame(pd.DataFrame({"rec_id": path, "ch": ch, "i": range(len(v)), "v": v}), SAMPLES)
        parts = one if parts is None else parts.unionByName(one)
    return parts


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for tables between jobs; a folder of this machine only where all of the session is on it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Expected blinks per epoch from a CSV file with a header (A4)."""
    return spark.read.csv(path, schema="epoch_id bigint, blink_count bigint", header=True)


def write_segments(segments: DataFrame, path: str, overwrite: bool = False) -> None:
    """Samples in a folder per recording and segment; existing data is an error unless overwritten (A3)."""
    segments.repartition("rec_id", "seg_id").write.partitionBy("rec_id", "seg_id").parquet(path, mode="overwrite" if overwrite else "error")


def events_signal(events: DataFrame) -> DataFrame:
    """A signal from an event table: a channel per event_type, centred moving sums of values in cents, exact in integers."""
    w = W.partitionBy("event_type").orderBy("event_id")
    cents = events.select(F.lit("events").alias("rec_id"), F.col("event_type").alias("ch"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.round(F.col("value") * 100).cast("bigint").alias("c"))
    near = W.partitionBy(*KEYS).orderBy("i").rowsBetween(-7, 7)
    sums = cents.select(*KEYS, "i", F.sum("c").over(near).alias("s"))
    centre = sums.groupBy(*KEYS).agg(F.floor(F.median("s")).alias("m"))
    return sums.join(centre, list(KEYS)).select(*KEYS, "i", (F.col("s") - F.col("m")).cast("double").alias("v"))
