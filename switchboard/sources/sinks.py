"""Writers: stored insights, exports, reports, predictions and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard import schema as S
from switchboard.operators import coaching as C
from switchboard.sources import store
from switchboard.sources.files import Folder
from switchboard.sources.store import DuplicateCalls  # noqa: F401  (raised by append_insights)


def append_insights(df: DataFrame, path: str, mode: str = "skip", writer: str | None = None, batch: int | None = None) -> int:
    """Appends insights, stored by day, with ``call_id`` unique; see ``store.append``."""
    return store.append(df, path, mode, writer=writer, batch=batch)


def write_by_day(df: DataFrame, path: str, ts: str = "ts", rows_per_file: int = 1_000_000) -> None:
    """Appends to a plain folder partitioned by day, whose ids needn't be unique."""
    store.write_days(df, path, ts, rows_per_file)


def read_insights(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows of a store, or all rows of a plain folder."""
    return store.read(spark, path) if Folder(spark, path).exists("commits") else spark.read.parquet(path)


def insights_of_days(spark: SparkSession, path: str, start, end) -> DataFrame:
    """Insights between two times; whole days are pruned before any file is opened."""
    return read_insights(spark, path).where(
        F.col("day").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))) & F.col("ts").between(start, end))


def export_rows(df: DataFrame) -> DataFrame:
    """The fourteen exported fields, newest first, time as ISO text."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(*S.EXPORT_FIELDS).orderBy(F.desc("ts"), "call_id").select(
        "call_id", iso.alias("timestamp"), *S.EXPORT_FIELDS[2:])


def export_json(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").json(path)


def csv_rows(df: DataFrame) -> DataFrame:
    return export_rows(df).withColumns({c: F.concat_ws(", ", c) for c in S.LIST_FIELDS})


def export_csv(df: DataFrame, path: str) -> None:
    """List fields joined with a comma and a blank."""
    csv_rows(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def prediction_rows(forecast: DataFrame, confidence: dict[str, float], version: str = "v1.0") -> DataFrame:
    """A wide forecast as one row per type and day, the actual value still open."""
    kinds = {"call_volume": "call_volume", "sentiment": "sentiment", "revenue": "revenue"}
    rows = F.array(*[F.struct(
        F.lit(k).alias("prediction_type"), F.col("date").alias("prediction_date"),
        F.col(c).cast("double").alias("predicted_value"),
        F.lit(float(confidence.get(k, 0.0))).alias("confidence_score"),
        F.lit(None).cast("double").alias("actual_value"), F.lit(version).alias("model_version"))
        for k, c in kinds.items()])
    return forecast.select(F.inline(rows))


def write_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").partitionBy("prediction_type").parquet(path)


def coaching_session_rows(responses: DataFrame) -> DataFrame:
    """One stored row per call: times, kinds of advice given and the final score."""
    return coaching_session_rows_of_parts(C.report_parts(responses))


def coaching_session_rows_of_parts(parts: DataFrame) -> DataFrame:
    """The same from merged parts of reports, as a live session leaves them."""
    return parts.select("call_id", "start_time", "end_time", *[F.sort_array(c).alias(c) for c in C.KINDS], F.col("last.overall").alias("final_performance_score"))


def staff_performance_rows(reports: DataFrame, staff: DataFrame) -> DataFrame:
    """One row per (staff, call): four scores, overall and notes."""
    return reports.join(staff, "call_id").select(
        "staff_id", "call_id", *[F.col(s).alias(f"{s}_score") for s in R.SCORES],
        F.col("overall").alias("overall_score"),
        F.array_join("areas_for_improvement", "; ").alias("coaching_notes"), F.col("end_time").alias("ended_at"))


def quarantine_rows(failed: DataFrame, error: Column, at: Column, text: str = "transcript", keep: int = 200) -> DataFrame:
    """call_id, error, time and an excerpt for the operator's log."""
    body = F.col(text)
    shown = F.when(F.length(body) > keep, F.concat(F.left(body, F.lit(keep)), F.lit("..."))).otherwise(body)
    return failed.select("call_id", error.alias("error"), at.alias("ts"), shown.alias("transcript"))


def append_dead_letters(rows: DataFrame, path: str) -> None:
    """Stores quarantined rows by the hour of their failure."""
    hour = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH")
    rows.withColumn("hour", hour).write.mode("append").partitionBy("hour").parquet(path)


def _oldest_hour(now: Column, hours: int) -> Column:
    return F.date_format(F.date_trunc("hour", now - F.make_interval(hours=F.lit(hours))), "yyyy-MM-dd'T'HH")


def dead_letters(spark: SparkSession, path: str, now: Column, hours: int = 24) -> DataFrame:
    """Quarantined rows that failed less than ``hours`` before ``now``; older hours aren't opened."""
    stored = spark.read.option("basePath", path).schema("call_id string, error string, ts timestamp, transcript string, hour string").parquet(path)
    kept = (F.col("hour") >= _oldest_hour(now, hours)) & (F.col("ts") > now - F.make_interval(hours=F.lit(hours)))
    return stored.where(kept).drop("hour")


def expire_dead_letters(spark: SparkSession, path: str, now: Column, hours: int = 24) -> int:
    """Deletes the hours that are wholly over; how many."""
    oldest = spark.range(1).select(_oldest_hour(now, hours)).first()[0]
    folder = Folder(spark, path)
    over = [n for n in folder.names() if n.startswith("hour=") and n.removeprefix("hour=") < oldest]
    for name in over:
        folder.delete(name)
    return len(over)


def latest_results(df: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest results (a report of fixed length)."""
    return df.orderBy(F.desc("ts"), F.desc("call_id")).limit(n)
