"""Rates of live recordings: frames that repeat or come late, rates that leave their target, devices that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: device as text; problem: repeated, late, slow, fast or stalled; rate is that of the last frames, null for the others
FOUND = "device string, frame long, ts timestamp, problem string, rate double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def problems(frames: DataFrame, hertz: float, window: int, threshold: float) -> DataFrame:
    """frames (device, frame, ts) as one finished table: the rows of FOUND without stalls.

    In the order of time a frame whose number is the highest so far is repeated if it is there again, and late if it is
    below; the others follow each other. Once `window` periods between them are known, their mean rate is slow or fast if
    it is off the target by more than threshold times the target; it is told when that begins, and again after it was good."""
    w = Window.partitionBy("device").orderBy("ts", "frame")
    df = frames.select(F.col("device").cast("string").alias("device"), "frame", "ts").withColumn("_top", F.max("frame").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("problem", F.when(F.col("frame") == F.col("_top"), "repeated").when(F.col("frame") < F.col("_top"), "late"))
    bad = df.filter("problem IS NOT NULL").select("device", "frame", "ts", "problem", F.lit(None).cast("double").alias("rate"))
    good = df.filter("problem IS NULL").withColumn("_p", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6)
    recent = w.rowsBetween(1 - window, 0)
    rate = F.when(F.count("_p").over(recent) == window, F.try_divide(F.lit(float(window)), F.sum("_p").over(recent)))
    good = good.withColumn("rate", rate).withColumn("_off", F.when(F.col("rate") < hertz * (1 - threshold), "slow").when(F.col("rate") > hertz * (1 + threshold), "fast"))
    began = F.col("_off").isNotNull() & F.lag("_off").over(w).isNull()
    off = good.withColumn("_b", began).filter("_b").select("device", "frame", "ts", F.col("_off").alias("problem"), "rate")
    return bad.unionAll(off)


class RateMonitor(StatefulProcessor):
    """problems() on a stream, and stalls: a device without a new frame for `silent` seconds of event time. The state of a
    device is its last frame, whether its rate was off, and `window` periods; it survives restarts with the checkpoint."""

    def __init__(self, hertz: float, window: int, threshold: float, silent: float) -> None:
        self.hertz, self.window, self.threshold, self.silent = hertz, window, threshold, silent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame long, micros long, off boolean")
        self.recent = handle.getListState("recent", "period double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = pd.concat(list(rows)).sort_values(["ts", "frame"], kind="stable")
        top, micros, off = self.last.get() if self.last.exists() else (None, None, False)
        periods = [x[0] for x in self.recent.get()] if self.recent.exists() else []
        found = []
        for frame, ts in zip(new["frame"].tolist(), new["ts"], strict=True):
            if top is not None and frame <= top:
                found.append((key[0], frame, ts, "repeated" if frame == top else "late", None))
                continue
            now = ts.value // 1000
            if micros is not None:
                periods = [*periods, (now - micros) / 1e6][-self.window :]
            top, micros = frame, now
            whole = len(periods) == self.window and sum(periods) > 0
            rate = self.window / sum(periods) if whole else None
            wrong = None if rate is None else "slow" if rate < self.hertz * (1 - self.threshold) else "fast" if rate > self.hertz * (1 + self.threshold) else None
            if wrong and not off:
                found.append((key[0], frame, ts, wrong, rate))
            off = wrong is not None
        if top is not None:
            self.last.update((top, micros, off))
            if periods:
                self.recent.put([(p,) for p in periods])
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(micros // 1000 + int(self.silent * 1000))
        yield _frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        top, micros, _ = self.last.get()
        yield _frame([(key[0], top, pd.Timestamp(micros * 1000), "stalled", None)])

    def close(self) -> None:
        pass


def _frame(found: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["device", "frame", "ts", "problem", "rate"])
    return out.astype({"frame": "int64", "ts": "datetime64[ns]", "rate": "float64"})


def monitored(frames: DataFrame, hertz: float, window: int, threshold: float, silent: float, late: str) -> DataFrame:
    """frames, a stream (device, frame, ts): FOUND. Needs the RocksDB state store (PROVIDER)."""
    df = frames.select(F.col("device").cast("string").alias("device"), "frame", "ts").withWatermark("ts", late)
    return df.groupBy("device").transformWithStateInPandas(RateMonitor(hertz, window, threshold, silent), FOUND, "append", "EventTime")
