"""Queries over coached calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.operators import coaching as CO
from switchboard.plans import tables as B
from switchboard.plans.registry import (big, joined, num, q, query, sql_any, sql_hits, sql_matched, sql_sentiment, sql_urgency,
                                        sql_word_count)
from switchboard.sources import sinks

X = B.RULES
LEGACY = {**R.LEGACY_COACHING, **{k: X[k] for k in (
    "sentiment", "concerns", "closing", "responding", "empathy", "unprofessional", "upsell", "frustration", "legal_risk")},
    "alert_words": {k: X["alert_words"][k] for k in ("customer_emotion", "emergency")}, "resolution": ["the "],
    "sentiment_drop": -0.1, "duration_critical": 700, "frustration_limit": 1, "resolution_limit": 8}


def _count(t, ws):
    return "(" + " + ".join(f"((length({t}) - length(replace({t}, {q(w)}, ''))) // {len(w)})" for w in ws) + ")"


def _score(x):
    return (f"(SELECT 0.5 * power(0.8, c.ns) + coalesce(sum(0.2 * p.{x} * power(0.8, c.ns - p.ns)), 0) FROM c p "
            f"WHERE p.call_id = c.call_id AND p.seq <= c.seq AND p.speaker = 'staff')")


_OVER = "OVER (PARTITION BY call_id ORDER BY seq)"
_FOLD = (f"WITH {B.CHUNKS}, c AS MATERIALIZED (SELECT *, ' ' || string_agg(low, ' ') {_OVER} AS buf, ' ' || string_agg(text, ' ') {_OVER} AS raw, "
         f"row_number() {_OVER} AS n, count(*) FILTER (speaker = 'staff') {_OVER} AS ns, t - min(t) {_OVER} AS elapsed, "
         f"{sql_sentiment('low', X['sentiment'])} AS s, "
         f"least(1.0, {sql_hits('low', X['empathy'])} / 3.0::DOUBLE) AS xe, CASE WHEN {sql_word_count('text')} > 10 THEN 0.8 ELSE 0.5 END::DOUBLE AS xf, "
         f"least(1.0, {sql_hits('low', X['knowledge'])} / 2.0::DOUBLE) AS xk, 1.0 - least(1.0, {sql_hits('low', X['unprofessional'])} / 5.0::DOUBLE) AS xp, "
         "concat_ws('|', " + ", ".join(f"CASE WHEN {sql_any('low', w)} THEN {q(k)} END" for k, w in X["concerns"].items()) + ") AS concerns FROM chunks), "
         f"f AS (SELECT *, {_score('xe')} AS empathy, {_score('xf')} AS efficiency, {_score('xk')} AS knowledge, {_score('xp')} AS professionalism, "
         f"{_count('buf', X['resolution'])} AS res, {_count('buf', X['frustration'])} AS fru, "
         f"coalesce(bool_or(s < 0) OVER (PARTITION BY call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS neg, "
         f"CASE WHEN length(raw) < 50 THEN 'opening' WHEN {sql_any('buf', X['closing'])} THEN 'closing' WHEN contains(right(raw, 100), '?') THEN 'customer_inquiry' "
         f"WHEN {sql_any('buf', X['responding'])} THEN 'staff_responding' ELSE 'discussion' END AS stage FROM c)")
_AREAS = ("concat_ws('; ', " + ", ".join(f"CASE WHEN {s} < 0.7 THEN {q(R.SCORE_TEXTS[s][0])} END" for s in R.SCORES)
          + f", CASE WHEN a_sentiment > 0 THEN {q(R.SENTIMENT_AREA[0])} END)")
_COURSES = ("concat_ws('; ', " + ", ".join(f"CASE WHEN {s} < 0.7 THEN {q(R.SCORE_TEXTS[s][2])} END" for s in R.SCORES)
            + f", CASE WHEN a_sentiment > 0 THEN {q(R.SENTIMENT_AREA[1])} END)")
_LISTED = {
    "a_sentiment": "CAST(s < -0.1 AS INT)", "a_duration": "CAST(elapsed > 300 AS INT)",
    "a_customer_emotion": f"CAST({sql_any('buf', X['alert_words']['customer_emotion'])} AS INT)",
    "a_emergency": f"CAST({sql_any('buf', X['alert_words']['emergency'])} AS INT)",
    "a_legal": f"CAST({sql_any('buf', X['alert_words']['legal'])} AS INT)",
}
_UPSELL = f"s > 0.1 AND {sql_any('buf', X['upsell'])} AND n > 2"
_G = (_FOLD + ", g AS (SELECT call_id, count(*) AS chunks, max(t) - min(t) AS duration, " + ", ".join(
    f"sum({e}) AS {a}" for a, e in _LISTED.items()) + ", sum(CAST(s < 0 AND NOT neg AS INT) + CAST(" + _UPSELL + " AS INT)) AS interventions, "
    + ", ".join(f"arg_max({s}, seq) AS {s}" for s in R.SCORES)
    + ", arg_min(s, seq) AS s0, arg_max(s, seq) AS s1, min(s) AS lo, max(s) AS hi, stddev_pop(s) AS sd, min(staff_id) AS staff_id FROM f GROUP BY call_id)")
_TOTAL = "a_sentiment + a_duration + a_customer_emotion + a_emergency + a_legal"
_OVERALL = "(empathy + efficiency + knowledge + professionalism) / 4"
_ID = "call_id, CAST(seq AS BIGINT) AS seq"


def responses(spark, d, profile=X):
    return CO.coach_batch(B.chunks(spark, d), profile)


def reports(spark, d):
    return CO.final_report(responses(spark, d))


def _id():
    return ["call_id", big("seq").alias("seq")]


@query("interaction_count", _FOLD + f" SELECT {_ID}, CAST(n AS BIGINT) AS n FROM f")
def interaction_count(spark, d):
    return responses(spark, d).select(*_id(), big("interaction_count").alias("n"))


@query("cumulative_buffer", _FOLD + f" SELECT {_ID}, CAST(length(raw) AS BIGINT) AS chars, CAST(res AS BIGINT) AS resolutions, CAST(fru AS BIGINT) AS frustrations FROM f")
def cumulative_buffer(spark, d):
    return responses(spark, d).select(*_id(), big("buffer_chars").alias("chars"), big("resolution_attempts").alias("resolutions"),
                                      big("frustration_count").alias("frustrations"))


@query("cumulative_buffer_in_blocks", _FOLD + f" SELECT {_ID}, CAST(length(raw) AS BIGINT) AS chars, CAST(res AS BIGINT) AS resolutions, stage, round(empathy, 6) AS empathy FROM f")
def cumulative_buffer_in_blocks(spark, d):
    """The same fold with calls cut into blocks of three rows, as very long calls are."""
    r = CO.coach_batch(B.chunks(spark, d), X, long_calls=True, block_rows=3)
    return r.select(*_id(), big("buffer_chars").alias("chars"), big("resolution_attempts").alias("resolutions"), "stage",
                    num("empathy").alias("empathy"))


@query("running_score", _FOLD + f" SELECT {_ID}, " + ", ".join(f"round({s}, 6) AS {s}" for s in R.SCORES) + f", round({_OVERALL}, 6) AS overall FROM f")
def running_score(spark, d):
    return responses(spark, d).select(*_id(), *[num(s).alias(s) for s in [*R.SCORES, "overall"]])


@query("conversation_stage", _FOLD + f" SELECT {_ID}, stage FROM f")
def conversation_stage(spark, d):
    return responses(spark, d).select(*_id(), "stage")


@query("immediate_alerts", _FOLD + f" SELECT {_ID}, concat_ws('|', CASE WHEN s < -0.6 THEN 'critical:sentiment' WHEN s < -0.1 THEN 'warning:sentiment' END, "
       "CASE WHEN elapsed > 700 THEN 'critical:duration' WHEN elapsed > 300 THEN 'warning:duration' END, "
       "CASE WHEN " + sql_any("buf", X["alert_words"]["customer_emotion"]) + " THEN 'warning:customer_emotion' END, "
       "CASE WHEN " + sql_any("buf", X["alert_words"]["emergency"]) + " THEN 'critical:emergency' END, "
       "CASE WHEN " + sql_any("buf", X["alert_words"]["legal"]) + " THEN 'critical:legal' END) AS alerts FROM f")
def immediate_alerts(spark, d):
    return responses(spark, d).select(*_id(), joined(F.transform("alerts", lambda a: F.concat(a["type"], F.lit(":"), a["category"]))).alias("alerts"))


_OLD = (f"WITH {B.CHUNKS}, c AS (SELECT *, ' ' || string_agg(low, ' ') {_OVER} AS buf, ' ' || string_agg(text, ' ') {_OVER} AS raw, "
        f"t - min(t) {_OVER} AS elapsed FROM chunks), f AS (SELECT *, {sql_sentiment('buf', LEGACY['sentiment'])} AS s, "
        f"CASE WHEN contains(right(raw, 100), '?') THEN 'question' WHEN {sql_any('buf', LEGACY['closing'])} THEN 'resolution' WHEN length(raw) < 100 THEN 'opening' ELSE 'discussion' END AS stage FROM c)")


@query("immediate_alerts_legacy", _OLD + f" SELECT {_ID}, concat_ws('|', CASE WHEN s < -0.1 THEN 'sentiment' END, CASE WHEN elapsed > 700 THEN 'duration' END, "
       "CASE WHEN " + sql_any("buf", LEGACY["alert_words"]["customer_emotion"]) + " THEN 'customer_emotion' END, "
       "CASE WHEN " + sql_any("buf", LEGACY["alert_words"]["emergency"]) + " THEN 'emergency' END) AS alerts, stage, round(s, 6) AS sentiment FROM f")
def immediate_alerts_legacy(spark, d):
    r = responses(spark, d, LEGACY)
    return r.select(*_id(), joined(F.transform("alerts", lambda a: a["category"])).alias("alerts"), "stage", num("sentiment").alias("sentiment"))


@query("coaching_advice_legacy", _OLD + f" SELECT {_ID}, concat_ws('|', CASE WHEN s < 0 THEN 'empathy' END, CASE WHEN stage = 'question' THEN 'active_listening' END, "
       f"CASE WHEN stage = 'resolution' THEN 'closing' END, CASE WHEN s > 0.3 AND {sql_any('buf', LEGACY['upsell'])} THEN 'upsell' END) AS suggestions, "
       f"concat_ws('|', CASE WHEN {_count('buf', LEGACY['resolution'])} > 8 THEN 'resolution_difficulty' END, CASE WHEN {sql_hits('buf', LEGACY['frustration'])} > 1 THEN 'customer_frustration' END, "
       f"CASE WHEN {sql_any('buf', LEGACY['legal_risk'])} THEN 'legal_risk' END) AS flags, CASE WHEN {sql_word_count('buf')} > 50 THEN 0.7 ELSE 0.4 END::DOUBLE AS information_provided, "
       f"CASE WHEN s > 0.3 THEN 0.9 ELSE 0.4 END::DOUBLE AS resolution_likelihood FROM f")
def coaching_advice_legacy(spark, d):
    r = responses(spark, d, LEGACY)
    return r.select(*_id(), joined(F.transform("suggestions", lambda a: a["type"])).alias("suggestions"),
                    joined(F.transform("escalation_flags", lambda a: a["type"])).alias("flags"), "information_provided", "resolution_likelihood")


@query("coaching_suggestions", _FOLD + f" SELECT {_ID}, concat_ws('|', CASE WHEN s < 0 AND NOT neg THEN 'empathy' END, CASE WHEN {_UPSELL} THEN 'upsell' END) AS suggestions FROM f")
def coaching_suggestions(spark, d):
    return responses(spark, d).select(*_id(), joined(F.transform("suggestions", lambda a: a["type"])).alias("suggestions"))


_NAMED = {"pricing": ["that"], "availability": ["keit"], "insurance": ["los "], "pain": ["this"]}
_SCRIPTED = {**X, "concerns": _NAMED}


@query("script_recommendations", f"WITH {B.CHUNKS} SELECT {_ID}, concat_ws('|', " + ", ".join(
    f"CASE WHEN {sql_any('low', w)} THEN {q(R.SCRIPT_TEXTS[k][0])} END" for k, w in _NAMED.items()) + ") AS scripts FROM chunks")
def script_recommendations(spark, d):
    return responses(spark, d, _SCRIPTED).select(*_id(), joined(F.transform("scripts", lambda a: a["category"])).alias("scripts"))


@query("escalation_flags", _FOLD + f" SELECT {_ID}, concat_ws('|', CASE WHEN res > 4 AND n > 3 THEN 'resolution_difficulty' END, CASE WHEN fru > 20 THEN 'customer_frustration' END, "
       f"CASE WHEN {sql_any('buf', X['legal_risk'])} THEN 'legal_risk' END, CASE WHEN {sql_any('buf', X['supervisor'])} THEN 'supervisor_requested' END) AS flags FROM f")
def escalation_flags(spark, d):
    return responses(spark, d).select(*_id(), joined(F.transform("escalation_flags", lambda a: a["type"])).alias("flags"))


@query("urgency_of_chunks", f"WITH {B.CHUNKS} SELECT {_ID}, CAST({sql_urgency('low', X['urgency'])} AS BIGINT) AS urgency FROM chunks")
def urgency_of_chunks(spark, d):
    return responses(spark, d).select(*_id(), big("urgency").alias("urgency"))


@query("alert_summary", _G + f" SELECT call_id, CAST({_TOTAL} AS BIGINT) AS total_alerts, " + ", ".join(
    f"CAST(a_{c} AS BIGINT) AS alerts_{c}" for c in CO.ALERT_CATEGORIES) + ", CAST(a_emergency + a_legal AS BIGINT) AS critical_alerts FROM g")
def alert_summary(spark, d):
    return CO.alert_summary(responses(spark, d))


@query("coaching_effectiveness", _G + f" SELECT call_id, round(s1 - s0, 6) AS sentiment_improvement, round({_OVERALL} - 0.5, 6) AS performance_improvement, CAST(interventions AS BIGINT) AS coaching_interventions FROM g")
def coaching_effectiveness(spark, d):
    r = reports(spark, d)
    return r.select("call_id", num("sentiment_improvement").alias("sentiment_improvement"),
                    num("performance_improvement").alias("performance_improvement"), big("coaching_interventions").alias("coaching_interventions"))


@query("improvement_areas", _G + f" SELECT call_id, {_AREAS} AS areas FROM g")
def improvement_areas(spark, d):
    return reports(spark, d).select("call_id", joined("areas_for_improvement", "; ").alias("areas"))


@query("strengths", _FOLD + f" SELECT {_ID}, concat_ws('; ', " + ", ".join(
    f"CASE WHEN {x} > 0.8 THEN {q(R.SCORE_TEXTS[s][1])} END" for s, x in zip(R.SCORES, ("xe", "xf", "xk", "xp"))) + ") AS strengths FROM f WHERE speaker = 'staff'")
def strengths(spark, d):
    """Strengths shown by each staff turn on its own."""
    signals = CO.chunk_signals(B.chunks(spark, d), X).where("is_staff")
    found = CO.strengths({s: F.col(f"x_{s}") for s in R.SCORES})
    return signals.select(*_id(), joined(found, "; ").alias("strengths"))


@query("recommend_training", _G + f" SELECT call_id, {_COURSES} AS courses FROM g")
def recommend_training(spark, d):
    return reports(spark, d).select("call_id", joined("recommended_training", "; ").alias("courses"))


@query("final_report", _G + f" SELECT call_id, CAST(duration AS DOUBLE) AS duration, CAST(chunks AS BIGINT) AS chunks, " + ", ".join(
    f"round({s}, 6) AS {s}" for s in R.SCORES) + f", round({_OVERALL}, 6) AS overall, CAST({_TOTAL} AS BIGINT) AS alerts, round(lo, 6) AS lowest_point, "
    f"round(hi, 6) AS highest_point, round(sd, 6) AS volatility, {_AREAS} AS areas, {_COURSES} AS courses FROM g")
def final_report(spark, d):
    r = reports(spark, d)
    return r.select("call_id", F.col("call_duration").alias("duration"), big("interaction_count").alias("chunks"),
                    *[num(s).alias(s) for s in [*R.SCORES, "overall"]], big("total_alerts").alias("alerts"),
                    *[num(c).alias(c) for c in ("lowest_point", "highest_point", "volatility")],
                    joined("areas_for_improvement", "; ").alias("areas"), joined("recommended_training", "; ").alias("courses"))


# --- staff, sessions and customers -----------------------------------------------------------

def _performance(spark, d):
    staff = B.chunks(spark, d).select("call_id", "staff_id").distinct()
    rows = sinks.staff_performance_rows(reports(spark, d), staff)
    return rows.select("staff_id", "call_id", "ended_at", *[F.col(f"{s}_score").alias(s) for s in R.SCORES])


@query("staff_performance", _G + f" SELECT staff_id, call_id, " + ", ".join(f"round({s}, 6) AS {s}_score" for s in R.SCORES)
       + f", round({_OVERALL}, 6) AS overall_score, {_AREAS} AS coaching_notes FROM g")
def staff_performance(spark, d):
    staff = B.chunks(spark, d).select("call_id", "staff_id").distinct()
    rows = sinks.staff_performance_rows(reports(spark, d), staff)
    return rows.select("staff_id", "call_id", *[num(f"{s}_score").alias(f"{s}_score") for s in R.SCORES],
                       num("overall_score").alias("overall_score"), "coaching_notes")


_LAST = (_G + ", e AS (SELECT g.*, (SELECT max(t) FROM chunks c WHERE c.call_id = g.call_id) AS ended FROM g), "
         "r AS (SELECT *, row_number() OVER (PARTITION BY staff_id ORDER BY ended DESC, call_id DESC) AS rk FROM e), "
         "b AS (SELECT staff_id, " + ", ".join(f"avg({s}) AS {s}" for s in R.SCORES) + ", count(*) AS sessions FROM r WHERE rk <= 10 GROUP BY 1)")


@query("staff_baseline", _LAST + " SELECT staff_id, " + ", ".join(f"round({s}, 6) AS {s}" for s in R.SCORES) + ", CAST(sessions AS BIGINT) AS sessions FROM b")
def staff_baseline(spark, d):
    return CO.staff_baseline(_performance(spark, d)).select("staff_id", *[num(s).alias(s) for s in R.SCORES], "sessions")


@query("with_staff_baseline", _LAST + ", s AS (SELECT DISTINCT call_id, CASE WHEN CAST(call_id AS INT) % 3 = 0 THEN 'unknown' ELSE staff_id END AS staff_id FROM chunks) "
       "SELECT call_id, " + ", ".join(f"round(coalesce(b.{s}, {R.STAFF_BASELINE[s]}), 6)::DOUBLE AS baseline_{s}" for s in R.SCORES)
       + ", 0.5::DOUBLE AS baseline_avg_sentiment FROM s LEFT JOIN b USING (staff_id)")
def with_staff_baseline(spark, d):
    unknown = F.when(F.col("call_id").cast("int") % 3 == 0, "unknown").otherwise(F.col("staff_id"))
    sessions = B.chunks(spark, d).select("call_id", unknown.alias("staff_id")).distinct()
    out = CO.with_staff_baseline(sessions, CO.staff_baseline(_performance(spark, d)))
    return out.select("call_id", *[num(f"baseline_{s}").alias(f"baseline_{s}") for s in R.SCORES], "baseline_avg_sentiment")


_OPEN = "(SELECT CAST(doc_id AS VARCHAR) AS call_id FROM documents WHERE doc_id % 3 = 0)"


def _sessions(spark, d):
    return B.calls(spark, d).where(F.col("call_id").cast("bigint") % 3 == 0).select("call_id")


@query("chunks_with_session", f"WITH {B.CHUNKS} SELECT {_ID} FROM chunks WHERE call_id IN {_OPEN}")
def chunks_with_session(spark, d):
    return CO.chunks_with_session(B.chunks(spark, d), _sessions(spark, d)).select(*_id())


@query("orphan_chunks", f"WITH {B.CHUNKS} SELECT {_ID} FROM chunks WHERE call_id NOT IN {_OPEN}")
def orphan_chunks(spark, d):
    return CO.orphan_chunks(B.chunks(spark, d), _sessions(spark, d)).select(*_id())


_FLAGS = {"is_returning_patient": "c_acctbal > 8000", "is_new_patient": "c_acctbal < 1000", "previous_complaints": "c_custkey % 5 = 0", "high_value": "c_acctbal > 7000"}


@query("opening_tips", "SELECT CAST(c_custkey AS BIGINT) AS customer_id, CAST(3 + " + " + ".join(
    f"CAST({_FLAGS[f]} AS INT)" for f in R.CONTEXT_TIPS) + " AS BIGINT) AS tips, CASE WHEN c_custkey % 11 = 0 THEN " + q(R.OPENING_APPROACH_UNKNOWN) + " " + " ".join(
    f"WHEN {_FLAGS[f]} THEN {q(t)}" for f, t in R.OPENING_APPROACH.items()) + f" ELSE {q(R.OPENING_APPROACH_OTHER)} END AS approach FROM customer")
def opening_tips(spark, d):
    c = B.read(spark, d, "customer").withColumns({**{f: F.expr(e) for f, e in _FLAGS.items()}, "known": F.expr("c_custkey % 11 <> 0")})
    return CO.opening_advice(c, known="known").select(big("c_custkey").alias("customer_id"), big(F.size("opening_tips")).alias("tips"),
                                                      F.col("opening_approach").alias("approach"))


@query("customer_insights", "WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT CAST(c_custkey AS BIGINT) AS customer_id, "
       "CASE WHEN n > 3 THEN 'Regular patient' WHEN n > 0 THEN 'Occasional patient' END AS visit_pattern, CASE WHEN n > 0 THEN c_mktsegment END AS preferred_services, "
       "CASE WHEN n > 0 AND c_acctbal < 0 THEN 'prefers short answers' END AS communication_notes FROM customer LEFT JOIN v ON c_custkey = o_custkey")
def customer_insights(spark, d):
    """Visits are the orders of a customer, whose profile is known if there is any."""
    visits = B.read(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    known = visits.join(B.read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("customer_id"), F.sequence(F.lit(1), F.col("n").cast("int")).alias("visit_history"), F.col("c_mktsegment").alias("service_preferences"),
        F.when(F.col("c_acctbal") < 0, "prefers short answers").otherwise("").alias("communication_style"))
    sessions = B.read(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"))
    return CO.customer_insights(sessions, known).select(big("customer_id").alias("customer_id"), "visit_pattern", "preferred_services", "communication_notes")


@query("coaching_sessions", _G + ", k AS (SELECT call_id, concat_ws('|', CASE WHEN a_customer_emotion > 0 THEN 'customer_emotion' END, CASE WHEN a_duration > 0 THEN 'duration' END, "
       "CASE WHEN a_emergency > 0 THEN 'emergency' END, CASE WHEN a_legal > 0 THEN 'legal' END, CASE WHEN a_sentiment > 0 THEN 'sentiment' END) AS alerts_triggered, "
       f"round({_OVERALL}, 6) AS final_performance_score FROM g) SELECT * FROM k")
def coaching_sessions(spark, d):
    rows = sinks.coaching_session_rows(responses(spark, d))
    return rows.select("call_id", joined("alerts_triggered").alias("alerts_triggered"), num("final_performance_score").alias("final_performance_score"))
