"""Detection on a stream of samples, with thresholds frozen from a calibration batch (an extension of ours).

Mean and median absolute deviation need a whole recording, so a stream takes the
thresholds of an earlier one.  Samples of a channel must arrive in order of their
frame; late ones are dropped.  A batch over the same samples gives the same blinks,
but for those too near to the end of the stream to be known.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ocutide.model import KEYS, Params
from ocutide.sources.tables import shared_folder

OUTPUT = "rec_id string, ch string, start_blink bigint, end_blink bigint"
STATE = "last bigint, start bigint, pend_start bigint, pend_end bigint, pend_bad boolean"


def _advance(i: np.ndarray, v: np.ndarray, thr: float, state: tuple, p: Params) -> tuple[tuple, list[tuple[int, int]]]:
    """New state and closed blinks after more samples of one channel; ``start`` is -1 outside a run, ``pend_start`` -1 without a blink that waits for its neighbour."""
    last, start, ps, pe, bad = state
    order = np.argsort(i, kind="stable")
    i, v = i[order], v[order]
    i, v = i[i > last], v[i > last]
    out: list[tuple[int, int]] = []
    if not len(i):
        return state, out
    st = np.where(v > thr, 1, np.where(v < thr, 0, -1))
    known = st >= 0
    ki, ks = i[known], st[known]
    before = np.concatenate([[int(start >= 0)], ks[:-1]])
    for k in np.flatnonzero(ks != before):
        if ks[k] == 1:
            start = int(ki[k])
            continue
        a, b, start = start, int(ki[k]), -1
        if b - a <= p.min_event_len * p.sfreq:
            continue
        near = ps >= 0 and (a - pe) / p.sfreq <= p.min_event_len
        if ps >= 0 and not bad and not near:
            out.append((ps, pe))
        ps, pe, bad = a, b, near
    last = int(i[-1])
    free = start if start >= 0 else last + 1  # no later blink can start before
    if ps >= 0 and (free - pe) / p.sfreq > p.min_event_len:
        if not bad:
            out.append((ps, pe))
        ps, pe, bad = -1, -1, False
    return (last, start, ps, pe, bad), out


def detect_stream(samples: DataFrame, thresholds: DataFrame, p: Params) -> DataFrame:
    """Blinks of a stream of samples (rec_id, ch, i, v) as they close. ``thresholds``: rec_id, ch, thr (static)."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (-1, -1, -1, -1, False)
        found: list[tuple[int, int]] = []
        pdf = pd.concat(list(frames))
        if len(pdf):
            now, found = _advance(pdf["i"].to_numpy(), pdf["v"].to_numpy(), float(pdf["thr"].iloc[0]), now, p)
        state.update(now)
        yield pd.DataFrame({"rec_id": key[0], "ch": key[1], "start_blink": [a for a, _ in found], "end_blink": [b for _, b in found]})

    joined = samples.join(thresholds, list(KEYS))
    return joined.groupBy(*KEYS).applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def counts_by_window(events: DataFrame, time: str = "ts", width: str = "30 seconds", late: str = "10 seconds", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Events per tumbling window of event time, closed by a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_to_end(stream: DataFrame, name: str = "stream") -> DataFrame:
    """What a stream puts out over the data that is there, through files in the cluster's shared folder."""
    spark = stream.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/out")
