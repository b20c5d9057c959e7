"""Queries that run a stream over a table to its end; the SQL is that of the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T
from switchboard.operators import coaching as CO
from switchboard.operators import insights as IN
from switchboard.operators import monitoring as M
from switchboard.plans import tables as B
from switchboard.plans.coaching import _FOLD, _G, _ID, _OVERALL, _TOTAL, X
from switchboard.plans.monitoring import KEPT, WINDOW_HOURS
from switchboard.plans.registry import ORACLES, big, joined, num, query
from switchboard.session import scratch_path
from switchboard.sources import sinks
from switchboard.sources.files import Folder
from switchboard.streaming import calls as SC
from switchboard.streaming import coaching as SCO
from switchboard.streaming import monitoring as SM
from switchboard.streaming import tables as ST


def _events(spark, d):
    return ST.table_stream(spark, f"{d}/events.parquet", B.EVENT_SCHEMA)


def _chunks(spark, d):
    return B.chunks_of(ST.table_stream(spark, f"{d}/conversations.parquet", B.CONVERSATION_SCHEMA))


def _calls(spark, d):
    docs = ST.table_stream(spark, f"{d}/documents.parquet", B.DOCUMENT_SCHEMA)
    return docs.select(F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript"), "lang",
                       F.lit(False).alias("needs_transcription"), F.lit(None).cast("string").alias("audio_file"))


#: calls in a landed file
FILE_CALLS = 250


def _landed_files(spark, d):
    """A folder of JSON files, each a list of calls."""
    path = scratch_path(spark, "landing")
    one = B.read(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / FILE_CALLS)).agg(F.to_json(F.collect_list(F.struct(
        F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript")))).alias("value"))
    one.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


def _consumed(spark, path, root, archive=None):
    """Reads the landed files in several batches, every batch written twice as after a lost commit."""
    sink = ST.landed_sink(root, archive)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    stream = ST.call_stream(spark, path, "part-*", "landing", archive=archive, max_files=100)
    checkpoint = scratch_path(spark, "calls-state")
    ST.run_batches(stream.select("call_id", "transcript", "source_id", "source_file"), twice, "calls", checkpoint)
    if archive is not None:
        ST.archive_last_batch(spark, root, checkpoint)


@query("call_stream", f"WITH {B.CALLS} SELECT call_id, md5(transcript) AS digest, 'landing' AS source_id, CAST((SELECT count(*) FROM documents p WHERE p.doc_id // {FILE_CALLS} = CAST(call_id AS BIGINT) // {FILE_CALLS}) AS BIGINT) AS calls_of_file FROM calls")
def call_stream(spark, d):
    """Call files read by the polling stream, and the ledger of the files they came from."""
    path, root = _landed_files(spark, d), scratch_path(spark, "consumed")
    _consumed(spark, path, root)
    files = ST.landed(spark, root, "files").select("source_file", F.col("calls").alias("calls_of_file"))
    return ST.landed(spark, root, "calls").join(files, "source_file").select("call_id", F.md5("transcript").alias("digest"), "source_id", "calls_of_file")


@query("analyse_stream", ORACLES["call_insight_rules"])
def analyse_stream(spark, d):
    from switchboard.plans.text import RULES

    stream = SC.analyse_stream(_calls(spark, d), spread=spark.sparkContext.defaultParallelism, lexicon=B.SENTIMENT, topics=B.TOPICS, intents=RULES, terms=B.TERMS)
    out = ST.run_available(stream.select("call_id", "priority", "dominant_topic", "primary_intent", "key_insights"), "analysed")
    return out.select("call_id", "priority", F.col("dominant_topic").alias("topic"), F.col("primary_intent").alias("intent"),
                      joined("key_insights").alias("key_insights"))


@query("insights_sink", f"WITH {B.INSIGHTS} SELECT primary_intent, CAST(count(*) AS BIGINT) AS calls FROM insights GROUP BY 1")
def insights_sink(spark, d):
    path = scratch_path(spark, "streamed-insights")
    ST.run_batches(B.insights_of(_events(spark, d)), SC.insights_sink(path), "insights")
    return sinks.read_insights(spark, path).groupBy("primary_intent").agg(F.count("*").alias("calls"))


@query("coach_stream", _FOLD + f" SELECT {_ID}, stage, CAST(n AS BIGINT) AS n, CAST(res AS BIGINT) AS resolutions, round(s, 6) AS sentiment, "
       + ", ".join(f"round({s}, 6) AS {s}" for s in R.SCORES) + " FROM f")
def coach_stream(spark, d):
    r = ST.run_available(SCO.coach_stream(_chunks(spark, d), X), "coached").where(~F.col("session_ended"))
    return r.select("call_id", big("seq").alias("seq"), "stage", big("interaction_count").alias("n"), big("resolution_attempts").alias("resolutions"),
                    num("sentiment").alias("sentiment"), *[num(s).alias(s) for s in R.SCORES])


@query("session_start", "WITH s AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1) SELECT CAST(conv_id AS VARCHAR) AS call_id, 'staff_' || CAST(conv_id % 7 AS VARCHAR) AS staff_id, "
       "CASE WHEN conv_id % 7 = 3 THEN 0.9 ELSE 0.7 END::DOUBLE AS baseline_empathy, CASE WHEN c_acctbal < 1000 THEN 'new' ELSE 'known' END AS customer FROM s "
       "LEFT JOIN (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) ON c_custkey = conv_id + 1")
def session_start(spark, d):
    """The first chunk of a call opens its session: stream-static joins with staff and customers, who are known from their first order on."""
    staff = B.read(spark, d, "supplier").select(F.concat(F.lit("staff_"), F.col("s_suppkey") % 7).alias("staff_id")).distinct()
    baseline = staff.where("staff_id = 'staff_3'").withColumn("empathy", F.lit(0.9))
    known = B.read(spark, d, "customer").join(B.read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    customers = known.select((F.col("c_custkey") - 1).cast("string").alias("call_id"), (F.col("c_acctbal") < 1000).alias("is_new_patient"))
    first = _chunks(spark, d).where("seq = 0").select("call_id", "staff_id", "ts")
    out = ST.run_available(CO.session_start(first, customers, baseline).select("call_id", "staff_id", "baseline_empathy", "opening_tips"), "opened")
    return out.select("call_id", "staff_id", "baseline_empathy", F.when(F.size("opening_tips") > 3, "new").otherwise("known").alias("customer"))


def _ended_sessions(spark, d):
    """Folder of what the stream writes when an end marker after its last chunk closes every call."""
    talks = B.read(spark, d, "conversations")
    ends = talks.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).select("conv_id", "turn", F.lit("end").alias("role"), F.lit("").alias("text"))
    path, root = scratch_path(spark, "chunks-with-ends"), SCO.sink_root(spark)
    talks.unionByName(ends).write.parquet(path)
    staff = B.chunks(spark, d).groupBy("call_id").agg(F.min("staff_id").alias("staff_id"))
    stream = SCO.coach_stream(B.chunks_of(ST.table_stream(spark, path, B.CONVERSATION_SCHEMA)), X)
    ST.run_batches(stream, SCO.coaching_sink(root, staff), "coaching")
    return root


@query("session_end", _G + f" SELECT call_id, CAST(chunks AS BIGINT) AS chunks, round({_OVERALL}, 6) AS overall, CAST({_TOTAL} AS BIGINT) AS alerts FROM g")
def session_end(spark, d):
    """The reports of sessions as they end."""
    r = SCO.written(spark, _ended_sessions(spark, d), "reports")
    return r.select("call_id", big("interaction_count").alias("chunks"), num("overall").alias("overall"), big("total_alerts").alias("alerts"))


@query("session_end_rows", ORACLES["coaching_sessions"])
def session_end_rows(spark, d):
    """The stored rows of sessions as they end."""
    r = SCO.written(spark, _ended_sessions(spark, d), "sessions")
    return r.select("call_id", joined("alerts_triggered").alias("alerts_triggered"), num("final_performance_score").alias("final_performance_score"))


@query("session_end_performance", ORACLES["staff_performance"])
def session_end_performance(spark, d):
    """Scores of the staff as their sessions end."""
    r = SCO.written(spark, _ended_sessions(spark, d), "performance")
    return r.select("staff_id", "call_id", *[num(f"{s}_score").alias(f"{s}_score") for s in R.SCORES], num("overall_score").alias("overall_score"), "coaching_notes")


@query("metric_threshold_stream", ORACLES["metric_thresholds"])
def metric_threshold_stream(spark, d):
    return ST.run_available(M.metric_thresholds(B.metrics_of(_events(spark, d))).select("reading_id", "name", "value", "severity"), "thresholds")


@query("alert_stream", KEPT + " SELECT alert_id, component, message FROM kept")
def alert_stream(spark, d):
    return ST.run_available(SM.alert_stream(B.alerts_of(_events(spark, d)), WINDOW_HOURS * 3600), "alerts").select("alert_id", "component", "message")


#: the stream's watermark is ten seconds behind its last event
_WATERMARK = "(SELECT max(ts) - INTERVAL 10 SECOND FROM events)"


@query("stale_component_stream", "SELECT 'user_' || CAST(user_id AS VARCHAR) AS component, epoch_us(max(ts)) AS last_seen, 'high' AS severity FROM events "
       f"GROUP BY user_id HAVING max(ts) + INTERVAL 1 DAY <= {_WATERMARK}")
def stale_component_stream(spark, d):
    """Components silent for a day before the stream's watermark."""
    out = ST.run_available(SM.stale_component_stream(B.beats_of(_events(spark, d)), 86_400), "stale")
    return out.select("component", F.unix_micros("last_seen").alias("last_seen"), "severity")


@query("stalled_run_stream", "WITH r AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS place FROM events) "
       f"SELECT 'run_' || CAST(user_id AS VARCHAR) AS run_id, epoch_us(ts) AS last_seen, 'high' AS severity FROM r WHERE place = 1 AND event_type <> 'purchase' AND ts + INTERVAL 1 DAY <= {_WATERMARK}")
def stalled_run_stream(spark, d):
    """Every event starts a run of its user; purchases end it."""
    status = F.when(F.col("event_type") == "purchase", "ended").otherwise("started")
    runs = _events(spark, d).select(F.concat(F.lit("run_"), F.col("user_id")).alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))
    out = ST.run_available(SM.stalled_run_stream(runs, 86_400), "stalled")
    return out.select("run_id", F.unix_micros("last_seen").alias("last_seen"), "severity")


@query("insight_stream", ORACLES["fallback_insight"].replace("round(", "round(").split(" AS middle")[0] + " AS middle FROM calls")
def insight_stream(spark, d):
    calls = _calls(spark, d).withColumns({"ts": F.lit(None).cast("timestamp"), "acquired_at": F.current_timestamp()})
    profile = {"sentiment": B.SENTIMENT, "intents": B.INTENTS, "urgency": B.URGENCY}
    out = ST.run_available(SC.insight_stream(calls, profile=profile), "fallback")
    return out.select("call_id", "primary_intent", num("sentiment_score").alias("sentiment"), big("urgency_level").alias("urgency"),
                      num(F.element_at("emotional_journey", F.lit("middle"))).alias("middle"))


@query("archive_processed", f"WITH {B.CALLS} SELECT call_id, md5(transcript) AS digest, TRUE AS in_ledger FROM calls")
def archive_processed(spark, d):
    """Consumed files lie in the archive, where the ledger says, with all their calls; none is left in the inbox."""
    path, root, archive = _landed_files(spark, d), scratch_path(spark, "consumed"), scratch_path(spark, "archive")
    _consumed(spark, path, root, archive)
    left = [n for n in Folder(spark, path).names() if n.startswith("part-")]
    if left:
        raise ValueError(f"{len(left)} consumed files were not archived")
    ledger = ST.landed(spark, root, "files").select(F.col("archived_as").alias("place"), F.lit(True).alias("in_ledger"))
    files = spark.read.schema("call_id string, transcript string").option("multiLine", True).option("recursiveFileLookup", True).json(archive)
    place = F.regexp_replace("_metadata.file_path", r"^\w+:(//[^/]*)?", "")
    return files.select("call_id", F.md5("transcript").alias("digest"), place.alias("place")).join(
        ledger.withColumn("place", F.regexp_replace("place", r"^\w+:(//[^/]*)?", "")), "place", "left").select(
        "call_id", "digest", F.coalesce("in_ledger", F.lit(False)).alias("in_ledger"))
