import datetime as dt

import pytest
from pyspark.sql import functions as F

from switchboard import schema as S
from switchboard.operators import insights as IN
from tests.conftest import rows
from tests.talks import BILLING, EMERGENCY, calls, chunks

def when():
    return F.to_timestamp(F.lit("2024-05-01 10:00:00"))


@pytest.mark.parametrize("text, intent, urgency, sentiment", [
    ("I have a dental emergency", "emergency", 5, 0.0), ("Hello, I need an appointment", "appointment_booking", 1, 0.0),
    ("What are your office hours?", "inquiry", 1, 0.0), ("great, thank you, but bad", "inquiry", 1, 1 / 3)])
def test_fallback_insight(spark, text, intent, urgency, sentiment):
    r = IN.fallback_insight(calls(spark, text)).first()
    assert (r["primary_intent"], r["urgency_level"], r["confidence_score"]) == (intent, urgency, 0.2)
    assert r["sentiment_score"] == pytest.approx(sentiment) and r["emotional_journey"]["end"] == r["sentiment_score"]
    assert r["pain_points"] == ["analysis_failed"] and r["next_actions"] == ["manual_review_needed"]


def test_legacy_profile(spark):
    r = IN.fallback_insight(calls(spark, "a rude wait, emergency"), "legacy").first()
    assert (r["primary_intent"], r["urgency_level"], r["confidence_score"], r["sentiment_score"]) == ("inquiry", 1, 0.1, -1.0)
    assert r["pain_points"] == [] and r["emotional_journey"]["middle"] == 0.0


def test_chunk_form_equals_the_joined_form(spark):
    talk = chunks(spark, BILLING)
    whole = calls(spark, "\n".join(t for *_, t in BILLING)).withColumn("call_id", F.lit("c1"))
    drop = ["ts"]
    for profile in ("default", "legacy"):
        a = IN.fallback_insight_of_chunks(talk, profile).drop(*drop).first()
        b = IN.fallback_insight(whole, profile).drop(*drop).first()
        assert a == b


def test_parse_answers(spark):
    good = '{"primary_intent": "pricing", "urgency_level": 4, "emotional_journey": {"end": 0.5}, "pain_points": ["pricing"]}'
    answers = {"a": good, "b": f"Sure:\n```json\n{good}\n```\nBye", "c": "sorry", "d": '{"primary_intent": ', "e": None}
    df = spark.createDataFrame([(k, v, "I need an appointment") for k, v in answers.items()], "call_id string, answer string, transcript string")
    out = {r["call_id"]: r for r in IN.insights_from_answers(df, ts=when()).collect()}
    for k in ("a", "b"):
        assert (out[k]["primary_intent"], out[k]["urgency_level"], out[k]["pain_points"]) == ("pricing", 4, ["pricing"])
        assert out[k]["clinic_mentioned"] == "unknown" and out[k]["confidence_score"] == 0.0
    for k in ("c", "d", "e"):
        assert (out[k]["primary_intent"], out[k]["confidence_score"]) == ("appointment_booking", 0.2)


def insight(**change):
    base = dict(call_id="ring-7", ts=dt.datetime(2019, 11, 23), clinic_mentioned="Harbour Street", primary_intent="insurance_question",
                secondary_intents=["opening_hours"], sentiment_score=0.5, emotional_journey={"end": -0.1}, urgency_level=4,
                resolution_status="pending", staff_performance={"knowledge": 0.35}, revenue_opportunity=40.0, service_requests=["veneer"],
                pain_points=["waiting"], success_factors=["quick_reply"], next_actions=["send_letter"], confidence_score=0.6)
    return {**base, **change}


def table(spark, *items):
    return spark.createDataFrame([tuple(i.values()) for i in items], S.INSIGHT)


def test_validation(spark):
    df = table(spark, insight(), insight(call_id="b", sentiment_score=2.0), insight(call_id="c", urgency_level=10, revenue_opportunity=-1.0),
               insight(call_id="d", primary_intent=None))
    good, bad = IN.validate_insights(df)
    assert rows(good, "call_id") == [("ring-7",)]
    assert {r["call_id"]: r["broken"] for r in bad.collect()} == {
        "b": ["sentiment_score range"], "c": ["urgency_level range", "revenue_opportunity range"], "d": ["primary_intent missing"]}


def test_json_round_trip(spark):
    df = table(spark, insight(), insight(call_id="b", clinic_mentioned=None))
    assert rows(IN.insight_from_json(IN.insight_json(df))) == rows(df)


def test_partial_update(spark):
    df = table(spark, insight(), insight(call_id="b"))
    changes = spark.createDataFrame([("b", "complaint", None)], "call_id string, primary_intent string, urgency_level int")
    out = {r["call_id"]: r for r in IN.partial_update(df, changes, when()).collect()}
    assert (out["b"]["primary_intent"], out["b"]["urgency_level"]) == ("complaint", 4) and out["b"]["updated_at"] is not None
    assert out["ring-7"]["updated_at"] is None


def test_reports(spark):
    df = table(spark, insight(pain_points=["a", "b"]), insight(call_id="b", pain_points=["a"], sentiment_score=0.2, primary_intent="x"),
               insight(call_id="c", pain_points=None, primary_intent="x"))
    o = IN.overview(df).first()
    assert (o["total_calls"], o["revenue_opportunities"]) == (3, 120.0) and o["average_sentiment"] == pytest.approx(0.4)
    assert [tuple(r) for r in IN.top_intents(df).collect()] == [("x", 2), ("insurance_question", 1)]
    assert [tuple(r) for r in IN.common_pain_points(df).collect()] == [("a", 2), ("b", 1)]
    empty = IN.overview(df.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0)


def test_acceptable_calls(spark):
    df = spark.createDataFrame([("a", "text", None, None), ("b", None, True, "x.wav"), ("c", "", None, None)],
                               "call_id string, transcript string, needs_transcription boolean, audio_file string")
    assert rows(IN.acceptable_call(df), "call_id", "status") == [("a", "accepted"), ("b", "skipped"), ("c", "error")]


def test_analysis_of_a_call(spark):
    r = IN.analyse_calls(calls(spark, EMERGENCY)).first()
    assert r["priority"] == "high" and r["primary_intent"] == "emergency_dental" and r["dominant_topic"] == "emergency_dental"
    assert r["risk_factors"] == ["Emergency dental situation identified"]
    assert r["key_insights"][0] == "Customer contact information captured"
    assert "Insurance information discussed" in r["key_insights"]
    part = IN.analyse_calls(calls(spark, EMERGENCY), engines=["intent"]).first()
    assert part["sentiment_score"] is None and part["dominant_topic"] is None and part["primary_intent"] == "emergency_dental"


def test_one_analysis_per_opening(spark):
    same = "x" * 200
    df = spark.createDataFrame([("a", same + "1"), ("a", same + "2"), ("a", "other"), ("b", same + "3")], "call_id string, transcript string")
    out = IN.dedupe_analyses(df, lambda c: c.withColumn("analysis", F.right("transcript", F.lit(1))))
    assert rows(out, "call_id", "transcript", "analysis") == sorted([
        ("a", same + "1", "1"), ("a", same + "2", "1"), ("a", "other", "r"), ("b", same + "3", "3")], key=str)


def test_confidence(spark):
    c = IN.analysis_confidence(F.lit(True), F.lit(0.5), F.lit(None).cast("double"))
    assert spark.range(1).select(c.alias("c")).first()["c"] == pytest.approx(0.7)
    none = F.lit(None).cast("double")
    assert spark.range(1).select(IN.analysis_confidence(F.lit(False), none, none).alias("c")).first()["c"] == 0.3
