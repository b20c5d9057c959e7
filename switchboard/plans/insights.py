"""Queries over structured insights and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard.functions import intents as I
from switchboard.functions import topics as TP
from switchboard.operators import insights as IN
from switchboard.plans import tables as B
from switchboard.plans.registry import (big, joined, num, q, query, sql_any, sql_best, sql_first, sql_hits, sql_matched,
                                        sql_sentiment, sql_urgency)
from switchboard.plans.text import RULES as INTENT_RULES
from switchboard.plans.text import _PRIMARY, _SCORED  # the same scored intents

PROFILE = {"sentiment": B.SENTIMENT, "intents": B.INTENTS, "urgency": B.URGENCY}


def _checked(df):
    return df.select(
        "call_id", "primary_intent", num("sentiment_score").alias("sentiment"), big("urgency_level").alias("urgency"),
        num(F.element_at("emotional_journey", F.lit("middle"))).alias("middle"), "revenue_opportunity", "confidence_score",
        joined("pain_points").alias("pain_points"), joined("next_actions").alias("next_actions"))


@query("fallback_insight", f"WITH {B.CALLS} SELECT call_id, {sql_first('low', B.INTENTS, 'inquiry')} AS primary_intent, "
       f"round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment, CAST({sql_urgency('low', B.URGENCY)} AS BIGINT) AS urgency, "
       f"round({sql_sentiment('low', B.SENTIMENT)}, 6) AS middle, 100.0::DOUBLE AS revenue_opportunity, 0.2::DOUBLE AS confidence_score, "
       "'analysis_failed' AS pain_points, 'manual_review_needed' AS next_actions FROM calls")
def fallback_insight(spark, d):
    return _checked(IN.fallback_insight(B.calls(spark, d), PROFILE))


@query("fallback_insight_legacy", f"WITH {B.CALLS} SELECT call_id, 'inquiry' AS primary_intent, round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment, "
       "CAST(1 AS BIGINT) AS urgency, 0.0::DOUBLE AS middle, 100.0::DOUBLE AS revenue_opportunity, 0.1::DOUBLE AS confidence_score, '' AS pain_points, '' AS next_actions FROM calls")
def fallback_insight_legacy(spark, d):
    return _checked(IN.fallback_insight(B.calls(spark, d), {**IN.LEGACY_PROFILE, "sentiment": B.SENTIMENT}))


_TALKS = f"{B.CHUNKS}, talks AS (SELECT call_id, string_agg(low, chr(10) ORDER BY seq) AS low FROM chunks GROUP BY call_id)"


@query("fallback_insight_of_chunks", f"WITH {_TALKS} SELECT call_id, {sql_first('low', B.INTENTS, 'inquiry')} AS primary_intent, "
       f"round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment, CAST({sql_urgency('low', B.URGENCY)} AS BIGINT) AS urgency, "
       f"round({sql_sentiment('low', B.SENTIMENT)}, 6) AS middle, 100.0::DOUBLE AS revenue_opportunity, 0.2::DOUBLE AS confidence_score, "
       "'analysis_failed' AS pain_points, 'manual_review_needed' AS next_actions FROM talks")
def fallback_insight_of_chunks(spark, d):
    """Flagship: insights of whole conversations from their separate turns."""
    return _checked(IN.fallback_insight_of_chunks(B.chunks(spark, d), PROFILE))


_ANSWER = ("CASE doc_id % 4 WHEN 0 THEN a WHEN 1 THEN 'Here you are:' || chr(10) || '```json' || chr(10) || a || chr(10) || '```' "
           "WHEN 2 THEN 'no json at all' ELSE '{{\"primary_intent\": ' END")


def _answers(spark, d):
    """Model answers derived from the documents: strict, fenced, prose and broken."""
    df = B.read(spark, d, "documents")
    body = F.to_json(F.struct(F.col("lang").alias("primary_intent"), (F.col("n_chars") % 200 / 100 - 1).alias("sentiment_score"),
                              (F.col("n_chars") % 5 + 1).alias("urgency_level")))
    answer = F.when(F.col("doc_id") % 4 == 0, body) \
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Here you are:\n```json\n"), body, F.lit("\n```"))) \
        .when(F.col("doc_id") % 4 == 2, F.lit("no json at all")).otherwise(F.lit('{"primary_intent": '))
    return df.select(F.col("doc_id").cast("string").alias("call_id"), F.col("text").alias("transcript"), answer.alias("answer"))


_GOOD = "doc_id % 4 < 2"


@query("parse_model_json", f"SELECT CAST(doc_id AS VARCHAR) AS call_id, CAST({_GOOD} AS INT) AS parsed, CASE WHEN {_GOOD} THEN lang END AS intent, "
       f"CASE WHEN {_GOOD} THEN round(n_chars % 200 / 100.0 - 1, 6)::DOUBLE END AS sentiment FROM documents")
def parse_model_json(spark, d):
    p = IN.parse_model_json(_answers(spark, d))
    return p.select("call_id", F.col("parsed").isNotNull().cast("int").alias("parsed"), F.col("parsed.primary_intent").alias("intent"),
                    num("parsed.sentiment_score").alias("sentiment"))


@query("apply_defaults", f"SELECT CAST(doc_id AS VARCHAR) AS call_id, lang AS primary_intent, 'unknown' AS clinic_mentioned, "
       f"CAST(n_chars % 5 + 1 AS BIGINT) AS urgency, 0.0::DOUBLE AS confidence, CAST(0 AS BIGINT) AS n_pain FROM documents WHERE {_GOOD}")
def apply_defaults(spark, d):
    p = IN.parse_model_json(_answers(spark, d)).where("parsed is not null").select("call_id", "parsed.*")
    return IN.apply_defaults(p).select("call_id", "primary_intent", "clinic_mentioned", big("urgency_level").alias("urgency"),
                                       F.col("confidence_score").alias("confidence"), big(F.size("pain_points")).alias("n_pain"))


@query("insights_from_answers", f"WITH c AS (SELECT *, lower(text) AS low FROM documents) SELECT CAST(doc_id AS VARCHAR) AS call_id, "
       f"CASE WHEN {_GOOD} THEN lang ELSE {sql_first('low', B.INTENTS, 'inquiry')} END AS primary_intent, "
       f"CASE WHEN {_GOOD} THEN 0.0 ELSE 0.2 END::DOUBLE AS confidence FROM c")
def insights_from_answers(spark, d):
    out = IN.insights_from_answers(_answers(spark, d), profile=PROFILE)
    return out.select("call_id", "primary_intent", F.col("confidence_score").alias("confidence"))


# some values leave their range, so that there is something to reject
_WILD = f"WITH {B.INSIGHTS}, w AS (SELECT call_id, sentiment_score * 1.2 AS s, urgency_level + CASE WHEN k17 THEN 3 ELSE 0 END AS u, revenue_opportunity - 3 AS r, confidence_score + 0.05 AS c FROM (SELECT *, CAST(call_id AS BIGINT) % 17 = 0 AS k17 FROM insights))"


@query("validate_insight", _WILD + ", b AS (SELECT call_id, concat_ws('|', CASE WHEN NOT s BETWEEN -1 AND 1 THEN 'sentiment_score range' END, "
       "CASE WHEN NOT u BETWEEN 1 AND 5 THEN 'urgency_level range' END, CASE WHEN r < 0 THEN 'revenue_opportunity range' END, "
       "CASE WHEN NOT c BETWEEN 0 AND 1 THEN 'confidence_score range' END) AS broken FROM w) SELECT * FROM b WHERE broken <> ''")
def validate_insight(spark, d):
    i = B.insights(spark, d).withColumns({
        "sentiment_score": F.col("sentiment_score") * 1.2,
        "urgency_level": F.col("urgency_level") + F.when(F.col("call_id").cast("bigint") % 17 == 0, 3).otherwise(0),
        "revenue_opportunity": F.col("revenue_opportunity") - 3, "confidence_score": F.col("confidence_score") + 0.05})
    _, rejected = IN.validate_insights(i)
    return rejected.select("call_id", joined("broken").alias("broken"))


@query("acceptable_call", "SELECT CASE WHEN doc_id % 5 = 0 AND doc_id % 10 <> 0 THEN 'error' WHEN doc_id % 10 = 0 THEN 'skipped' ELSE 'accepted' END AS status, "
       "CAST(count(*) AS BIGINT) AS calls FROM documents GROUP BY 1")
def acceptable_call(spark, d):
    calls = B.calls(spark, d).withColumn("n", F.col("call_id").cast("bigint")).withColumns({
        "transcript": F.when(F.col("n") % 5 != 0, F.col("transcript")),
        "needs_transcription": F.col("n") % 10 == 0, "audio_file": F.when(F.col("n") % 10 == 0, F.lit("a.wav"))})
    return IN.acceptable_call(calls).groupBy("status").agg(F.count("*").alias("calls"))


@query("partial_update", f"WITH {B.INSIGHTS} SELECT call_id, CASE WHEN CAST(call_id AS BIGINT) % 3 = 0 THEN 'changed' ELSE primary_intent END AS primary_intent, "
       "CAST(CASE WHEN CAST(call_id AS BIGINT) % 6 = 0 THEN 5 ELSE urgency_level END AS BIGINT) AS urgency, "
       "CAST(CAST(call_id AS BIGINT) % 3 = 0 AS INT) AS updated FROM insights")
def partial_update(spark, d):
    base = B.insights(spark, d)
    n = F.col("call_id").cast("bigint")
    changes = base.where(n % 3 == 0).select("call_id", F.lit("changed").alias("primary_intent"),
                                            F.when(n % 6 == 0, F.lit(5)).alias("urgency_level"))
    out = IN.partial_update(base, changes, B.as_of())
    return out.select("call_id", "primary_intent", big("urgency_level").alias("urgency"),
                      F.col("updated_at").isNotNull().cast("int").alias("updated"))


@query("dedupe_analyses", f"SELECT source AS call_id, CAST(doc_id AS BIGINT) AS doc_id, round({sql_sentiment('lower(first_text)', B.SENTIMENT)}, 6) AS sentiment FROM "
       "(SELECT source, doc_id, min(text COLLATE C) OVER (PARTITION BY source, left(text, 200)) AS first_text FROM documents)")
def dedupe_analyses(spark, d):
    """Copies within a source share one analysis."""
    from switchboard.functions import text as T

    docs = B.read(spark, d, "documents").select(F.col("source").alias("call_id"), "doc_id", F.col("text").alias("transcript"))

    def analyse(c):
        return c.withColumn("analysis", num(T.sentiment(F.lower("transcript"), B.SENTIMENT)))

    return IN.dedupe_analyses(docs, analyse).select("call_id", "doc_id", F.col("analysis").alias("sentiment"))


@query("insight_json", f"WITH {B.INSIGHTS} SELECT call_id, primary_intent, round(sentiment_score, 6) AS sentiment, "
       "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, array_to_string(pain_points, '|') AS pain_points FROM insights")
def insight_json(spark, d):
    """To JSON and back."""
    text = IN.insight_json(B.insights(spark, d))
    back = IN.insight_from_json(text)
    return back.select("call_id", "primary_intent", num("sentiment_score").alias("sentiment"),
                       F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("iso"), joined("pain_points").alias("pain_points"))


_TS = {n: f"t_{n}" for n in B.TOPICS}
_TL, _TT = sql_best(_TS)


@query("call_insight_rules", _SCORED + ", t AS (SELECT call_id, transcript, low, " + ", ".join(
    f"{sql_hits('low', w)}::DOUBLE / {len(w)} AS t_{n}" for n, w in B.TOPICS.items()) + " FROM calls), "
    f"a AS (SELECT t.call_id, {sql_sentiment('t.low', B.SENTIMENT)} AS s, regexp_matches(transcript, '\\(\\d{{3}}\\)\\s*\\d{{3}}[-.]?\\d{{4}}|\\b\\d{{3}}[-.]?\\d{{3}}[-.]?\\d{{4}}\\b|\\b\\d{{3}}\\s\\d{{3}}\\s\\d{{4}}\\b') AS phone, "
    f"{_TL} AS topic, t.low AS low, p.primary_intent AS intent FROM t JOIN (SELECT call_id, {_PRIMARY} FROM scored) p USING (call_id)) "
    f"SELECT call_id, CASE WHEN s < -0.5 THEN 'high' WHEN s > 0.5 THEN 'medium' ELSE 'low' END AS priority, topic, intent, "
    f"concat_ws('|', CASE WHEN phone THEN 'Customer contact information captured' END, CASE WHEN {sql_any('low', B.TERMS)} THEN "
    f"'Medical concerns mentioned: ' || array_to_string(list_slice(string_split({sql_matched('low', B.TERMS)}, '|'), 1, 3), ', ') END) AS key_insights FROM a")
def call_insight_rules(spark, d):
    out = IN.analyse_calls(B.calls(spark, d), lexicon=B.SENTIMENT, topics=B.TOPICS, intents=INTENT_RULES, terms=B.TERMS)
    return out.select("call_id", "priority", F.col("dominant_topic").alias("topic"), F.col("primary_intent").alias("intent"),
                      joined("key_insights").alias("key_insights"))


@query("analyse_engines", f"WITH {B.CALLS} SELECT call_id, round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment, 'none' AS topic, CAST(length(transcript) AS BIGINT) AS own FROM calls")
def analyse_engines(spark, d):
    """Two engines chosen by name and one of the caller's own; the others stay null."""
    out = IN.analyse_calls(B.calls(spark, d), engines=["sentiment", "entities"], lexicon=B.SENTIMENT, terms=B.TERMS,
                           extra={"own": lambda c: F.length(c)})
    return out.select("call_id", num("sentiment_score").alias("sentiment"),
                      F.coalesce("dominant_topic", F.lit("none")).alias("topic"), big("own").alias("own"))


@query("analysis_confidence", "SELECT CAST(doc_id AS VARCHAR) AS call_id, round(CASE doc_id % 4 WHEN 0 THEN (0.9 + n_chars % 100 / 100.0) / 2 WHEN 1 THEN "
       "(n_chars % 100 / 100.0 + n_chars % 50 / 50.0) / 2 WHEN 2 THEN 0.3 ELSE (0.9 + n_chars % 50 / 50.0) / 2 END, 6)::DOUBLE AS confidence FROM documents")
def analysis_confidence(spark, d):
    m, n = F.col("doc_id") % 4, F.col("n_chars")
    c = IN.analysis_confidence(m.isin(0, 3), F.when(m.isin(0, 1), n % 100 / 100), F.when(m.isin(1, 3), n % 50 / 50))
    return B.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("call_id"), num(c).alias("confidence"))


@query("empty_nlp_row", f"WITH {B.CALLS} SELECT call_id, CASE WHEN lang = 'en' THEN 'found' ELSE 'unknown' END AS dominant_topic, "
       "CASE WHEN lang = 'en' THEN 0.9 ELSE 0.1 END::DOUBLE AS confidence FROM calls")
def empty_nlp_row(spark, d):
    calls = B.calls(spark, d)
    analysed = calls.where("lang = 'en'").select("call_id", F.lit("found").alias("dominant_topic"), F.lit(0.9).alias("analysis_confidence"))
    return IN.empty_nlp_rows(calls, analysed).select("call_id", "dominant_topic", F.col("analysis_confidence").alias("confidence"))


# --- reports ----------------------------------------------------------------------------------

_FROM, _TO = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
_PERIOD = f"WITH {B.INSIGHTS}, p AS (SELECT * FROM insights WHERE ts BETWEEN TIMESTAMP '{_FROM}' AND TIMESTAMP '{_TO}')"


def _period(spark, d):
    return IN.insights_between(B.insights(spark, d), F.to_timestamp(F.lit(_FROM)), F.to_timestamp(F.lit(_TO)))


@query("insights_between", _PERIOD + " SELECT call_id, primary_intent FROM p")
def insights_between(spark, d):
    return _period(spark, d).select("call_id", "primary_intent")


@query("insight_by_id", f"WITH {B.INSIGHTS} SELECT call_id, primary_intent, round(sentiment_score, 6) AS sentiment FROM insights WHERE call_id = '77'")
def insight_by_id(spark, d):
    return IN.insight_by_id(B.insights(spark, d), "77").select("call_id", "primary_intent", num("sentiment_score").alias("sentiment"))


@query("insights_page", f"WITH {B.INSIGHTS} SELECT call_id, primary_intent FROM insights ORDER BY ts DESC, call_id LIMIT 50 OFFSET 25")
def insights_page(spark, d):
    return IN.insights_page(B.insights(spark, d), 50, 25).select("call_id", "primary_intent")


@query("newest_first", _PERIOD + " SELECT call_id, epoch_us(ts) AS us FROM p ORDER BY ts DESC, call_id")
def newest_first(spark, d):
    return IN.newest_first(_period(spark, d)).select("call_id", F.unix_micros("ts").alias("us"))


@query("overview", _PERIOD + " SELECT CAST(count(*) AS BIGINT) AS total_calls, round(avg(sentiment_score), 6) AS average_sentiment, round(sum(revenue_opportunity), 2) AS revenue_opportunities FROM p")
def overview(spark, d):
    o = IN.overview(_period(spark, d))
    return o.select("total_calls", num("average_sentiment").alias("average_sentiment"), num("revenue_opportunities", 2).alias("revenue_opportunities"))


@query("top_intents", _PERIOD + " SELECT primary_intent AS intent, CAST(count(*) AS BIGINT) AS \"count\" FROM p GROUP BY 1 ORDER BY 2 DESC, 1")
def top_intents(spark, d):
    return IN.top_intents(_period(spark, d))


@query("common_pain_points", _PERIOD + " SELECT pain_point, CAST(count(*) AS BIGINT) AS \"count\" FROM (SELECT unnest(pain_points) AS pain_point FROM p) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def common_pain_points(spark, d):
    return IN.common_pain_points(_period(spark, d))


@query("batch_summary", f"WITH {B.INSIGHTS} SELECT CAST(count(*) AS BIGINT) AS total_calls, round(avg(confidence_score), 6) AS average_confidence, "
       "round(avg(sentiment_score), 6) AS average_sentiment FROM insights")
def batch_summary(spark, d):
    s = IN.batch_summary(B.insights(spark, d))
    return s.select("total_calls", num("average_confidence").alias("average_confidence"), num("average_sentiment").alias("average_sentiment"))


@query("batch_top_intents", f"WITH {B.INSIGHTS} SELECT primary_intent AS intent, CAST(count(*) AS BIGINT) AS \"count\" FROM insights GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def batch_top_intents(spark, d):
    return IN.top_intents(B.insights(spark, d), 5)
