"""Queries that land the tables as call files and read them back, and that write stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.operators import conversation as CV
from switchboard.plans import tables as B
from switchboard.plans.registry import big, joined, num, q, query
from switchboard.session import scratch_path
from switchboard.sources import calls as C
from switchboard.sources import sinks

_READ = f"WITH {B.CALLS} SELECT call_id, md5(transcript) AS digest FROM calls"


def _digest(df: DataFrame) -> DataFrame:
    return df.select("call_id", F.md5("transcript").alias("digest"))


@query("load_calls_json", _READ)
def load_calls_json(spark, d):
    """JSON arrays of at most 500 records per file."""
    path = scratch_path(spark, "json")
    calls = B.calls(spark, d).select("call_id", "transcript", "duration", "source_id",
                                     F.floor(F.col("call_id").cast("bigint") / 500).alias("block"))
    arrays = calls.groupBy("block").agg(F.to_json(F.collect_list(F.struct("call_id", "transcript", "duration", "source_id"))).alias("value"))
    arrays.repartition("block").write.partitionBy("block").text(path)
    return _digest(C.load_calls(spark, path, "json"))


@query("load_calls_csv", f"WITH {B.CALLS} SELECT call_id, md5(transcript) AS digest, duration FROM calls")
def load_calls_csv(spark, d):
    path = scratch_path(spark, "csv")
    (B.calls(spark, d).select("call_id", "transcript", "duration").write.option("header", True).option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    calls = C.load_calls(spark, path, "csv")
    return calls.select("call_id", F.md5("transcript").alias("digest"), "duration")


@query("require_fields", f"WITH {B.CALLS} SELECT CASE WHEN lang = 'de' THEN 'rejected' ELSE 'complete' END AS part, CAST(count(*) AS BIGINT) AS calls FROM calls GROUP BY 1")
def require_fields(spark, d):
    calls = B.calls(spark, d).withColumn("transcript", F.when(F.col("lang") != "de", F.col("transcript")))
    good, bad = C.require_fields(calls)
    parts = good.select(F.lit("complete").alias("part")).unionByName(bad.select(F.lit("rejected").alias("part")))
    return parts.groupBy("part").agg(F.count("*").alias("calls"))


def _landed_talks(spark, d, label):
    """Every conversation as one text file."""
    path = scratch_path(spark, label)
    talks = CV.concat_segments(B.chunks(spark, d)).select(F.col("transcript").alias("value"))
    talks.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


_TALKS = f"WITH {B.CHUNKS}, t AS (SELECT string_agg(text, chr(10) ORDER BY seq) AS transcript FROM chunks GROUP BY call_id)"


@query("scan_call_dir", _TALKS + " SELECT md5(transcript) AS digest, 'text' AS file_type, 1 AS named FROM t")
def scan_call_dir(spark, d):
    calls = C.scan_call_dir(spark, _landed_talks(spark, d, "texts"), ["*.txt"])
    body = F.regexp_replace("transcript", "\n$", "")
    return calls.select(F.md5(body).alias("digest"), "file_type", (F.length("call_id") > 0).cast("int").alias("named"))


@query("fresh_files", _TALKS + " SELECT 'since 2020' AS kept, CAST(count(*) AS BIGINT) AS files FROM t UNION ALL SELECT 'since 2100', 0")
def fresh_files(spark, d):
    path = _landed_talks(spark, d, "fresh")
    out = None
    for year in ("2020", "2100"):
        seen = C.scan_call_dir(spark, path, ["*.txt"], modified_after=f"{year}-01-01T00:00:00")
        part = seen.agg(F.count("*").alias("files")).select(F.lit(f"since {year}").alias("kept"), "files")
        out = part if out is None else out.unionByName(part)
    return out


@query("normalise_api_calls", f"WITH {B.CALLS} SELECT call_id, md5(transcript) AS digest, duration, source_id AS caller FROM calls")
def normalise_api_calls(spark, d):
    """API pages of a hundred calls, half of them bare arrays."""
    n = F.col("call_id").cast("bigint")
    item = F.struct(F.col("call_id").alias("id"), "transcript", "duration",
                    F.create_map(F.lit("name"), F.col("source_id")).alias("caller"))
    pages = B.calls(spark, d).groupBy(F.floor(n / 100).alias("page")).agg(F.collect_list(item).alias("calls"))
    value = F.when(F.col("page") % 2 == 0, F.to_json(F.struct("calls"))).otherwise(F.to_json("calls"))
    calls = C.normalise_api_calls(pages.select(value.alias("value")))
    return calls.select("call_id", F.md5("transcript").alias("digest"), "duration", F.element_at("caller", F.lit("name")).alias("caller"))


@query("incremental_since", f"WITH {B.INSIGHTS} SELECT call_id FROM insights WHERE ts > (SELECT max(ts) FROM insights WHERE CAST(call_id AS BIGINT) < 5000)")
def incremental_since(spark, d):
    i = B.insights(spark, d)
    mark = C.high_water_mark(i.where(F.col("call_id").cast("bigint") < 5000)).scalar()
    return C.incremental_since(i, mark).select("call_id")


@query("normalise_landed_files", f"WITH {B.CALLS} SELECT 'ftp_call' || call_id || CASE WHEN lang = 'de' THEN '.wav' ELSE '.txt' END || '_20240102_030405' AS call_id, "
       "md5(CASE WHEN lang = 'de' THEN '' ELSE transcript END) AS digest, CASE WHEN lang = 'de' THEN 'audio' ELSE 'text' END AS file_type FROM calls WHERE lang <> 'fr'")
def normalise_landed_files(spark, d):
    suffix = F.when(F.col("lang") == "de", ".wav").when(F.col("lang") == "fr", ".pdf").otherwise(".txt")
    files = B.calls(spark, d).select(F.concat(F.lit("call"), "call_id", suffix).alias("file_name"),
                                     F.to_timestamp(F.lit("2024-01-02 03:04:05")).alias("modified"),
                                     F.concat("transcript", F.lit("\n")).alias("content"))
    c = C.normalise_landed_files(files)
    return c.select("call_id", F.md5("transcript").alias("digest"), "file_type")


@query("load_history", f"WITH {B.INSIGHTS} SELECT call_id, epoch_us(ts) AS us, round(sentiment_score, 6) AS sentiment, array_to_string(pain_points, '|') AS pain_points FROM insights")
def load_history(spark, d):
    path = scratch_path(spark, "history")
    i = B.insights(spark, d).drop("staff_id").withColumns({
        "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "block": F.floor(F.col("call_id").cast("bigint") / 2000)})
    row = F.struct(*[F.col(c).alias("timestamp" if c == "ts" else c) for c in i.columns if c != "block"])
    i.groupBy("block").agg(F.to_json(F.collect_list(row)).alias("value")).repartition("block").write.partitionBy("block").text(path)
    h = C.load_history(spark, path)
    return h.select("call_id", F.unix_micros("ts").alias("us"), num("sentiment_score").alias("sentiment"), joined("pain_points").alias("pain_points"))


@query("source_registry", "SELECT source AS source_id, CAST(count(*) AS BIGINT) AS calls FROM documents WHERE source IN ('src1', 'src2') GROUP BY 1")
def source_registry(spark, d):
    """Three registered folders, one of them disabled; the calls of the others, stamped."""
    root = scratch_path(spark, "sources")
    calls = B.calls(spark, d)
    wanted = ["src1", "src2", "src3"]
    calls.where(F.col("source_id").isin(wanted)).select("call_id", "transcript", F.col("source_id").alias("folder")) \
        .write.partitionBy("folder").option("compression", "none").json(f"{root}/calls")
    entries = ",".join(f'{{"source_id":"{s}","source_type":"file_system","name":"{s}","config":{{"directory":"{root}/calls/folder={s}",'
                       f'"patterns":"*.json"}},"enabled":{str(s != "src3").lower()}}}' for s in wanted)
    spark.range(1).select(F.lit(f'{{"sources":[{entries}]}}').alias("value")).write.text(f"{root}/registry")
    registry = C.source_registry(spark, f"{root}/registry").where("enabled")
    parts = [(r["source_id"], C.load_calls(spark, r["config"]["directory"], "jsonl")) for r in registry.collect()]
    return C.combine_sources(parts, B.as_of()).groupBy("source_id").agg(F.count("*").alias("calls"))


@query("combine_sources", "SELECT source_id, CAST(n AS BIGINT) AS calls, CAST(0 AS BIGINT) AS without_duration FROM (SELECT 'documents' AS source_id, count(*) AS n FROM documents) "
       "UNION ALL SELECT 'conversations', count(DISTINCT conv_id), count(DISTINCT conv_id) FROM conversations")
def combine_sources(spark, d):
    parts = [("documents", B.calls(spark, d).select("call_id", "transcript", "duration")),
             ("conversations", CV.concat_segments(B.chunks(spark, d)).select("call_id", "transcript"))]
    both = C.combine_sources(parts, B.as_of())
    return both.groupBy("source_id").agg(F.count("*").alias("calls"), F.count_if(F.col("duration").isNull()).alias("without_duration"))


# --- sinks -------------------------------------------------------------------------------------

@query("append_insights", f"WITH {B.INSIGHTS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) AS BIGINT) AS ids FROM insights GROUP BY 1")
def append_insights(spark, d):
    """Half of the rows, then all of them: ids stay unique and every row is stored once."""
    path = scratch_path(spark, "insights")
    i = B.insights(spark, d)
    sinks.append_insights(i.where(F.col("call_id").cast("bigint") % 2 == 0), path)
    sinks.append_insights(i, path)
    return sinks.read_insights(spark, path).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("calls"), F.count_distinct("call_id").alias("ids"))


@query("append_insights_atomic", f"WITH {B.INSIGHTS} SELECT 'refused' AS second_batch, CAST(count(*) AS BIGINT) AS stored FROM insights WHERE CAST(call_id AS BIGINT) % 2 = 0")
def append_insights_atomic(spark, d):
    """A batch with a stored call is refused as a whole."""
    path = scratch_path(spark, "atomic")
    i = B.insights(spark, d)
    sinks.append_insights(i.where(F.col("call_id").cast("bigint") % 2 == 0), path, "atomic")
    try:
        sinks.append_insights(i, path, "atomic")
        outcome = "written"
    except sinks.DuplicateCalls:
        outcome = "refused"
    return sinks.read_insights(spark, path).agg(F.count("*").alias("stored")).select(F.lit(outcome).alias("second_batch"), "stored")


@query("insights_of_days", f"WITH {B.INSIGHTS} SELECT call_id FROM insights WHERE ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-07 06:00:00'")
def insights_of_days(spark, d):
    """A period read from the stored table, with whole days pruned."""
    path = scratch_path(spark, "by-day")
    sinks.write_by_day(B.insights(spark, d), path)
    start, end = (F.to_timestamp(F.lit(t)) for t in ("2024-01-05 06:00:00", "2024-01-07 06:00:00"))
    return sinks.insights_of_days(spark, path, start, end).select("call_id")


_EXPORT = (f"WITH {B.INSIGHTS} SELECT call_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS \"timestamp\", primary_intent, array_to_string(pain_points, ', ') AS pain_points, "
           "array_to_string(service_requests, ', ') AS service_requests, CAST(urgency_level AS BIGINT) AS urgency_level FROM insights")


@query("export_json", _EXPORT)
def export_json(spark, d):
    path = scratch_path(spark, "export-json")
    sinks.export_json(B.insights(spark, d), path)
    back = spark.read.schema("call_id string, timestamp string, primary_intent string, pain_points array<string>, service_requests array<string>, urgency_level long").json(path)
    return back.withColumns({"pain_points": F.array_join("pain_points", ", "), "service_requests": F.array_join("service_requests", ", ")})


@query("export_csv", _EXPORT)
def export_csv(spark, d):
    path = scratch_path(spark, "export-csv")
    sinks.export_csv(B.insights(spark, d), path)
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("call_id", "timestamp", "primary_intent", F.coalesce("pain_points", F.lit("")).alias("pain_points"),
                       F.coalesce("service_requests", F.lit("")).alias("service_requests"), big("urgency_level").alias("urgency_level"))


@query("write_results", f"WITH {B.INSIGHTS} SELECT call_id, primary_intent FROM insights")
def write_results(spark, d):
    path = scratch_path(spark, "results")
    sinks.write_results(B.insights(spark, d), path)
    return spark.read.schema("call_id string, primary_intent string").json(path)


@query("predictions", "WITH p AS (SELECT CAST(ts AS DATE) AS day, count(*)::DOUBLE AS v FROM events GROUP BY 1) SELECT 'call_volume' AS prediction_type, CAST(day AS VARCHAR) AS prediction_date, v AS predicted_value, 0.8::DOUBLE AS confidence_score, 'v1.0' AS model_version FROM p")
def predictions(spark, d):
    from switchboard.operators import daily as D

    path = scratch_path(spark, "predictions")
    daily = D.daily_rollup(B.insights(spark, d)).select(F.col("day").alias("date"), "call_volume", F.col("sentiment_mean").alias("sentiment"), F.col("revenue_sum").alias("revenue"))
    sinks.write_predictions(sinks.prediction_rows(daily, {"call_volume": 0.8}), path)
    back = spark.read.parquet(path).where("prediction_type = 'call_volume'")
    return back.select("prediction_type", F.col("prediction_date").cast("string").alias("prediction_date"), "predicted_value", "confidence_score", "model_version")
