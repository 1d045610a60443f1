"""Structured Streaming variants: append sinks, event-time windows and a stateful pause filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEPT = "episode long, ts timestamp, value double, keep boolean"


def windowed(events: DataFrame, length: str, slide: str, late: str) -> DataFrame:
    """Counts and sums by event-time window and kind; on a stream rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("window"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def pause_filter(epsilon: float) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """For applyInPandasWithState by episode: keep is false from the second frame of a pause on, across micro-batches.
    Frames of a batch are sorted by time; the state is the last value and whether it was in a pause."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, paused = state.get if state.exists else (None, False)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        keep = []
        for v in rows["value"]:
            still = last is not None and abs(v - last) < epsilon
            keep.append(not (still and paused))
            last, paused = v, still
        state.update((last, paused))
        yield rows.assign(episode=key[0], keep=keep)[["episode", "ts", "value", "keep"]]

    return run


def stream_pauses(frames: DataFrame, epsilon: float) -> DataFrame:
    return frames.groupBy("episode").applyInPandasWithState(pause_filter(epsilon), KEPT, "last double, paused boolean", "append", GroupStateTimeout.NoTimeout)


def append_once(rows: DataFrame, path: str, checkpoint: str):
    """Appends a stream to a table; a batch that is run again overwrites its own folder, so each row lands once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
