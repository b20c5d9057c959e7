"""The star-schema tables in the roles of calls, chunks, insights, alerts and metrics.

The prose in these tables is invented and holds almost none of the default
lexicon words, so the queries bring lexicons of words that do occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T
from switchboard.session import spread

EPOCH = 1_704_067_200  # 2024-01-01
TURN_SECONDS = 150
STAFF = 7

SENTIMENT = {"positive": ["the", "and", "with", "est ", "ción"], "negative": ["der", "und", "no", "que", "los "]}
INTENTS = {"appointment_booking": ["thing", "eaux la"], "emergency": ["keit", "zu der"], "pricing": ["que el", "re the"],
           "complaint": ["est ", "dans", "von"]}
URGENCY = {"critical": ["wh the", "chver"], "elevated": ["ing", "ment "]}
URGENCY_LABELS = {"high": ["whsh", "pfver", "eauch"], "medium": ["of the", "der", "la "], "low": ["tion", "that"]}
TERMS = ["tion", "the", "keit", "eaux", "que la", "und der", "zzz"]
TOPICS = {"english": ["the", "and", "with", "that"], "french": ["les", "des", "une", "dans"],
          "german": ["der", "die", "und"], "spanish": ["los", "las", "una", "por"]}
CONCERNS = {"first": ["that", "dans"], "second": ["keit", "with"], "third": ["los ", "ou la"], "fourth": ["this"]}
RULES = {
    **R.COACHING, "sentiment": SENTIMENT, "concerns": CONCERNS, "urgency": URGENCY,
    "closing": ["shha", "in the", "bezu"], "responding": ["this", "eaux"],
    "empathy": ["on", "er", "ti"], "unprofessional": ["um", "uh", "ou"], "knowledge": ["an", "que"],
    "emotion": ["en", "th"], "satisfied": ["the", "la"], "dissatisfied": ["der", "el "],
    "alert_words": {"customer_emotion": ["that", "auf"], "emergency": ["of the", "de la"], "legal": ["thst", "chau"]},
    "upsell": ["ing", "ment"], "resolution": ["the ", "of a", "la "], "frustration": ["er", "qu"],
    "legal_risk": ["whi", "tz"], "supervisor": ["nd the", "das "],
    "sentiment_drop": -0.1, "sentiment_critical": -0.6, "duration_warning": 300, "duration_critical": 700,
    "upsell_after_chunks": 2, "upsell_sentiment": 0.1, "resolution_limit": 4, "resolution_after_chunks": 3,
    "frustration_limit": 20,
}


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def calls(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript"),
        F.col("source").alias("source_id"), F.col("n_chars").cast("double").alias("duration"), "lang")


CALLS = ("calls AS (SELECT CAST(doc_id AS VARCHAR) AS call_id, text AS transcript, source AS source_id, "
         "CAST(n_chars AS DOUBLE) AS duration, lang, lower(text) AS low FROM documents)")


def chunks_of(df: DataFrame) -> DataFrame:
    seconds = F.lit(EPOCH) + F.col("conv_id") * 3600 + F.col("turn") * TURN_SECONDS
    return df.select(
        F.col("conv_id").cast("string").alias("call_id"), F.col("turn").cast("int").alias("seq"),
        F.timestamp_seconds(seconds).alias("ts"),
        F.when(F.col("role") == "assistant", "staff").when(F.col("role") == "user", "customer")
         .otherwise(F.col("role")).alias("speaker"),
        "text", F.concat(F.lit("staff_"), F.col("conv_id") % STAFF).alias("staff_id"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks_of(spread(read(spark, d, "conversations"), "conv_id"))


CHUNKS = (f"chunks AS (SELECT CAST(conv_id AS VARCHAR) AS call_id, CAST(turn AS INT) AS seq, "
          f"{EPOCH} + conv_id * 3600 + turn * {TURN_SECONDS} AS t, "
          "CASE role WHEN 'assistant' THEN 'staff' WHEN 'user' THEN 'customer' ELSE role END AS speaker, text, "
          f"lower(text) AS low, 'staff_' || CAST(conv_id % {STAFF} AS VARCHAR) AS staff_id FROM conversations)")


def event_number() -> Column:
    return F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("int")


def insights_of(df: DataFrame) -> DataFrame:
    k = F.col("k")
    return df.withColumn("k", event_number()).select(
        F.col("event_id").cast("string").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.lit("unknown").alias("clinic_mentioned"), F.col("event_type").alias("primary_intent"),
        T.compact_strings([F.when(k % 4 == 0, F.lit("follow_up"))]).alias("secondary_intents"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 25 - 1)).alias("sentiment_score"),
        (k % 5 + 1).alias("urgency_level"),
        F.when(k % 3 == 0, "resolved").otherwise("pending").alias("resolution_status"),
        F.col("value").alias("revenue_opportunity"),
        T.compact_strings([F.when(k % 7 == 0, F.lit("cleaning")), F.when(k % 5 == 0, F.lit("crown"))]).alias("service_requests"),
        T.compact_strings([F.when(k % 2 == 0, F.lit("wait_time")), F.when(k % 3 == 0, F.lit("pricing")),
                           F.when(k % 11 == 0, F.concat(F.lit("type_"), "event_type"))]).alias("pain_points"),
        F.array().cast("array<string>").alias("success_factors"),
        F.array().cast("array<string>").alias("next_actions"),
        (k / 100).alias("confidence_score"),
        F.concat(F.lit("staff_"), F.col("user_id")).alias("staff_id"))


def insights(spark: SparkSession, d: str) -> DataFrame:
    return insights_of(read(spark, d, "events"))


INSIGHTS = """ev AS (SELECT *, CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS INT) AS k FROM events),
insights AS (SELECT CAST(event_id AS VARCHAR) AS call_id, ts, 'unknown' AS clinic_mentioned, event_type AS primary_intent,
 list_filter([CASE WHEN k % 4 = 0 THEN 'follow_up' END], lambda x: x IS NOT NULL) AS secondary_intents,
 greatest(-1.0, least(1.0, value / 25 - 1)) AS sentiment_score, k % 5 + 1 AS urgency_level,
 CASE WHEN k % 3 = 0 THEN 'resolved' ELSE 'pending' END AS resolution_status, value AS revenue_opportunity,
 list_filter([CASE WHEN k % 7 = 0 THEN 'cleaning' END, CASE WHEN k % 5 = 0 THEN 'crown' END], lambda x: x IS NOT NULL) AS service_requests,
 list_filter([CASE WHEN k % 2 = 0 THEN 'wait_time' END, CASE WHEN k % 3 = 0 THEN 'pricing' END,
  CASE WHEN k % 11 = 0 THEN 'type_' || event_type END], lambda x: x IS NOT NULL) AS pain_points,
 CAST([] AS VARCHAR[]) AS success_factors, CAST([] AS VARCHAR[]) AS next_actions,
 k / 100.0::DOUBLE AS confidence_score, 'staff_' || CAST(user_id AS VARCHAR) AS staff_id FROM ev)"""


def orders_as_insights(spark: SparkSession, d: str) -> DataFrame:
    """A long daily series: orders as calls, priority as urgency."""
    priority = F.left("o_orderpriority", F.lit(1)).cast("int")
    return read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("call_id"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        ((F.col("o_custkey") % 201 - 100) / 100).alias("sentiment_score"), (6 - priority).alias("urgency_level"),
        F.col("o_totalprice").alias("revenue_opportunity"), (F.col("o_orderkey") % 101 / 100).alias("confidence_score"),
        F.col("o_orderstatus").alias("resolution_status"), F.col("o_orderpriority").alias("primary_intent"))


ORDERS = """insights AS (SELECT CAST(o_orderkey AS VARCHAR) AS call_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
 (o_custkey % 201 - 100) / 100.0::DOUBLE AS sentiment_score, 6 - CAST(left(o_orderpriority, 1) AS INT) AS urgency_level,
 o_totalprice AS revenue_opportunity, (o_orderkey % 101) / 100.0::DOUBLE AS confidence_score FROM orders)"""


def alerts_of(df: DataFrame) -> DataFrame:
    k = event_number()
    return df.where(F.col("event_type").isin("error", "signup")).select(
        F.col("event_id").cast("string").alias("alert_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(k % 10 == 0, "critical").when(k % 2 == 0, "high").otherwise("medium").alias("severity"),
        F.concat(F.lit("part_"), F.col("user_id") % 10).alias("component"),
        F.concat(F.col("event_type"), F.lit(" reported")).alias("message"),
        F.lit(False).alias("acknowledged"), (k % 9 == 0).alias("resolved"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts_of(read(spark, d, "events"))


ALERTS = """ev AS (SELECT *, CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS INT) AS k FROM events),
alerts AS (SELECT CAST(event_id AS VARCHAR) AS alert_id, event_id, ts,
 CASE WHEN k % 10 = 0 THEN 'critical' WHEN k % 2 = 0 THEN 'high' ELSE 'medium' END AS severity,
 'part_' || CAST(user_id % 10 AS VARCHAR) AS component, event_type || ' reported' AS message, FALSE AS acknowledged,
 k % 9 = 0 AS resolved FROM ev WHERE event_type IN ('error', 'signup'))"""

METRIC_NAMES = ["cpu_usage", "memory_usage", "disk_usage"]


def metrics_of(df: DataFrame) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(n) for n in METRIC_NAMES]), (F.col("event_id") % 3 + 1).cast("int"))
    return df.select(F.col("event_id").alias("reading_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("host_"), F.col("user_id") % 5).alias("component"), name.alias("name"),
                     event_number().cast("double").alias("value"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics_of(read(spark, d, "events"))


METRICS = """metrics AS (SELECT event_id AS reading_id, ts, 'host_' || CAST(user_id % 5 AS VARCHAR) AS component,
 list_extract(['cpu_usage', 'memory_usage', 'disk_usage'], CAST(event_id % 3 + 1 AS INT)) AS name,
 CAST(regexp_extract(props, '"k": ?(\\d+)', 1) AS DOUBLE) AS value FROM events)"""


def runs_of(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.concat(F.lit("agent_"), F.col("user_id") % 12).alias("component"),
                     F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
                     F.col("value").alias("duration"))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return runs_of(read(spark, d, "events"))


RUNS = """runs AS (SELECT CAST(event_id AS VARCHAR) AS run_id, event_id, ts, 'agent_' || CAST(user_id % 12 AS VARCHAR) AS component,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value AS duration FROM events)"""


def beats_of(df: DataFrame) -> DataFrame:
    status = (F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "stopped")
              .when(F.col("event_type") == "view", "idle").otherwise("running"))
    return df.select(F.concat(F.lit("user_"), F.col("user_id")).alias("component"),
                     F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))


def beats(spark: SparkSession, d: str) -> DataFrame:
    return beats_of(read(spark, d, "events"))


BEATS = """beats AS (SELECT 'user_' || CAST(user_id AS VARCHAR) AS component, ts, CASE event_type WHEN 'error' THEN 'error'
 WHEN 'signup' THEN 'stopped' WHEN 'view' THEN 'idle' ELSE 'running' END AS status FROM events)"""

AS_OF = "2024-01-30 12:00:00"


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
CONVERSATION_SCHEMA = "conv_id long, turn long, role string, text string"
DOCUMENT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
