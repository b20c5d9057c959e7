"""Calls analysed as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.operators import insights as I
from switchboard.sources import sinks


def analyse_stream(calls: DataFrame, spread: int | None = None, **options) -> DataFrame:
    """Accepted calls with all engines' results; the batch projection, unchanged.

    ``spread`` deals the calls of a batch out to so many tasks first, for sources whose few
    large files would be read by as few.
    """
    if spread is not None:
        calls = calls.repartition(spread)
    return I.analyse_calls(I.acceptable_call(calls).where(F.col("status") == "accepted"), **options)


def insights_sink(path: str, mode: str = "skip", writer: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of insights.

    The store's commit names the last batch of each ``writer``, so a repeated batch is not even read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        sinks.append_insights(batch, path, mode, writer, batch_id)

    return write


def insight_stream(calls: DataFrame, **options) -> DataFrame:
    """Rule-only insights of arriving calls."""
    return I.fallback_insight(calls.withColumn("ts", F.coalesce("ts", "acquired_at")), ts=F.col("ts"), **options)
