"""Intermediate tables in the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Only for sessions of one machine that name no folder, as in local tests.
LOCAL = "/tmp/checkpoints"
#: Rows of an Arrow batch: texts can be long, and a batch is held by the executor and its Python worker at once.
BATCH_ROWS = 500
_BATCH, _DEFAULT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of what the session plans from now on, unless it has a bound of its own.

    The bound is read when a plan runs, after the function that made it has returned, so it stays.
    """
    if spark.conf.get(_BATCH, _DEFAULT_ROWS) == _DEFAULT_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


def shared_folder(df: DataFrame) -> str:
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = LOCAL
    return folder.rstrip("/")


#: Shuffle files of a finished write are of no more use; without this they stay until the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _place(df: DataFrame, path: str):
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, and any executor may be lost.

    The table goes with ``discard``, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(df)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    place, fs = _place(df, path)
    fs.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            place, fs = _place(df, path)
            fs.delete(place, True)
            fs.cancelDeleteOnExit(place)


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, with more underscores where a table has such a column."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
