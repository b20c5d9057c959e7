"""Alert suppression and silence detection on streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from switchboard.operators.monitoring import keep_greedily
from switchboard.streaming.tables import use_rocksdb


class LastKept(StatefulProcessor):
    """Keeps an alert unless an equal one was kept less than a window ago.

    Once the watermark is a window past the last kept alert, that one no longer matters
    and its state goes.
    """

    def __init__(self, window_us: int, columns: list[str]):
        self.window_us, self.columns = window_us, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "alert_id"])
        stored = self.last.get()
        last = None if stored is None else int(stored[0])
        keep, last = keep_greedily(batch["us"].to_numpy(), batch["resolved"].to_numpy(dtype=bool), last,
                                   self.window_us)
        if last is not None and (stored is None or last != stored[0]):
            if stored is not None:
                self.handle.deleteTimer(self._over(int(stored[0])))
            self.last.update((int(last),))
            self.handle.registerTimer(self._over(int(last)))
        if keep.any():
            yield batch.loc[keep, self.columns]

    def _over(self, last: int) -> int:
        return (last + self.window_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(alerts: DataFrame, seconds: int = 3600, delay: str = "10 minutes",
                 keys: Sequence[str] = ("component", "message")) -> DataFrame:
    """Arriving alerts without repeats of one kept within ``seconds``."""
    use_rocksdb(alerts.sparkSession)
    rows = alerts.withWatermark("ts", delay).select(
        "alert_id", F.unix_micros("ts").alias("us"), "severity", "component", "message", "resolved")
    kept = rows.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=LastKept(seconds * 1_000_000, rows.columns), outputStructType=rows.schema,
        outputMode="Append", timeMode="EventTime")
    return kept.withColumn("ts", F.timestamp_micros("us")).drop("us")


class Silence(StatefulProcessor):
    """Emits a row once a key has been silent, or a run open, for too long."""

    def __init__(self, limit_ms: int, name: str):
        self.limit_ms, self.name = limit_ms, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "us long, timer long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for batch in rows:  # only the latest row counts
            latest = batch.iloc[batch["us"].to_numpy().argmax()]
            if last is None or latest["us"] >= last["us"]:
                last = latest
        stored = self.seen.get()
        if stored is not None:
            self.handle.deleteTimer(stored[1])
        if last["closed"]:
            self.seen.clear()
        else:
            timer = int(last["us"]) // 1000 + self.limit_ms
            self.handle.registerTimer(timer)
            self.seen.update((int(last["us"]), timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stored = self.seen.get()
        if stored is None:
            return iter(())
        us = int(stored[0])
        self.seen.clear()
        return iter([pd.DataFrame({self.name: [key[0]], "us": [us]})])

    def close(self) -> None:
        pass


def _silent(rows: DataFrame, key: str, seconds: int, delay: str) -> DataFrame:
    use_rocksdb(rows.sparkSession)
    slim = rows.withWatermark("ts", delay).select(
        F.col(key).cast("string").alias(key), "ts", F.unix_micros("ts").alias("us"), "closed")
    out = slim.groupBy(key).transformWithStateInPandas(
        statefulProcessor=Silence(seconds * 1000, key), outputStructType=f"{key} string, us long",
        outputMode="Append", timeMode="EventTime")
    return out.select(key, F.timestamp_micros("us").alias("last_seen"), F.lit("high").alias("severity"))


def stale_component_stream(beats: DataFrame, seconds: int = 120, delay: str = "10 seconds") -> DataFrame:
    """Components without a heartbeat for ``seconds`` of event time."""
    return _silent(beats.withColumn("closed", F.lit(False)), "component", seconds, delay)


def stalled_run_stream(runs: DataFrame, seconds: int = 3600, delay: str = "10 seconds") -> DataFrame:
    """Runs whose start is not followed by an end within ``seconds`` of event time."""
    return _silent(runs.withColumn("closed", F.col("status") != "started"), "run_id", seconds, delay)
