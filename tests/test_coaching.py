import random

import pytest
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.operators import coaching as CO
from switchboard.operators import conversation as CV
from tests.conftest import rows
from tests.talks import BORDER, BILLING, chunks

PARTS = ["the", "severe pain", "let me", "i'll check", "one moment", "frustrated", "?", "x" * 30, "higher", "up", "can't", "wait",
         "legal", "action", "better business", "bureau", "good", "bad", "sorry", "um", "sue", "cleaning", "have a", "great"]


def by_seq(df, call, column):
    return [r[column] for r in df.where(F.col("call_id") == call).orderBy("seq").collect()]


def test_four_chunks(spark):
    out = CO.coach_batch(chunks(spark, BILLING))
    assert by_seq(out, "c1", "sentiment") == [1.0, -1.0, 0.0, 1.0]
    assert by_seq(out, "c1", "stage") == ["customer_inquiry", "customer_inquiry", "discussion", "discussion"]
    assert by_seq(out, "c1", "empathy") == pytest.approx([0.4, 0.4, 0.386667, 0.386667], abs=1e-6)
    assert [[a["category"] for a in x] for x in by_seq(out, "c1", "alerts")] == [
        [], ["sentiment", "customer_emotion"], ["customer_emotion"], ["customer_emotion"]]
    assert by_seq(out, "c1", "alerts")[1][0]["type"] == "critical"
    assert "(-1.00)" in by_seq(out, "c1", "alerts")[1][0]["message"]
    assert [[a["type"] for a in x] for x in by_seq(out, "c1", "suggestions")] == [[], ["empathy"], [], []]


def test_phrases_reach_over_chunk_borders(spark):
    out = CO.coach_batch(chunks(spark, BORDER))
    assert [[a["category"] for a in x] for x in by_seq(out, "c2", "alerts")] == [[], ["emergency"], ["emergency"], ["emergency"]]
    assert by_seq(out, "c2", "resolution_attempts") == [0, 0, 0, 1]


def random_talk(seed, calls=3, turns=40):
    rng = random.Random(seed)
    return [(f"r{c}", t, rng.choice(["staff", "customer"]), " ".join(rng.choice(PARTS) for _ in range(rng.randint(1, 4))))
            for c in range(calls) for t in range(turns)]


def buffer_facts(listed):
    """The same facts from the whole text so far, by brute force."""
    out, text, score = {}, {}, {}
    for c, t, who, chunk in listed:
        buf = text[c] = text.get(c, "") + " " + chunk
        low = buf.lower()
        if who == "staff":
            x = min(1.0, sum(w in chunk.lower() for w in R.EMPATHY_WORDS) / 3)
            score[c] = score.get(c, 0.5) * 0.8 + x * 0.2
        alerts = sorted(n for n, ws in R.ALERT_WORDS.items() if any(w in low for w in ws))
        flags = sorted(n for n, ws in (("legal_risk", R.LEGAL_RISK_WORDS), ("supervisor_requested", R.SUPERVISOR_WORDS))
                       if any(w in low for w in ws))
        stage = ("opening" if len(buf) < 50 else "closing" if any(w in low for w in R.CLOSING_WORDS) else
                 "customer_inquiry" if "?" in buf[-100:] else
                 "staff_responding" if any(w in low for w in R.RESPONDING_WORDS) else "discussion")
        out[c, t] = (len(buf), sum(low.count(p) for p in R.RESOLUTION_PHRASES), sum(low.count(p) for p in R.REPEATED_FRUSTRATION),
                     alerts, flags, stage, round(score.get(c, 0.5), 9))
    return out


@pytest.mark.parametrize("seed, block", [(1, 0), (2, 0), (1, 1), (2, 3), (3, 7)])
def test_fold_equals_brute_force(spark, seed, block):
    talk = random_talk(seed)
    shuffled = random.Random(seed).sample(talk, len(talk))
    df = chunks(spark, shuffled).repartition(3)
    out = CO.coach_batch(df, long_calls=True, block_rows=block) if block else CO.coach_batch(df, long_calls=False)
    got = {(r["call_id"], r["seq"]): (
        r["buffer_chars"], r["resolution_attempts"], r["frustration_count"],
        sorted(a["category"] for a in r["alerts"] if a["category"] in R.ALERT_WORDS),
        sorted(f["type"] for f in r["escalation_flags"] if f["type"] in ("legal_risk", "supervisor_requested")),
        r["stage"], round(r["empathy"], 9)) for r in out.collect()}
    assert got == buffer_facts(talk)


def test_long_calls_are_noticed(spark):
    talk = [("long", t, "staff", "sorry") for t in range(1100)] + BILLING
    df = chunks(spark, talk)
    out = CO.coach_batch(df)
    assert out.where("call_id = 'long'").agg(F.max("interaction_count")).first()[0] == 1100
    assert "_block" in out._jdf.queryExecution().optimizedPlan().toString()
    report = {r["call_id"]: r for r in CO.final_report(out).collect()}
    assert report["long"]["empathy"] == pytest.approx(1 / 3)
    assert report["c1"]["interaction_count"] == 4


def test_scores_survive_hundreds_of_blocks_without_staff(spark):
    talk = [("quiet", t, "staff", "sorry, I understand") for t in range(3)] + [("quiet", t, "customer", "well") for t in range(3, 460)]
    talk += [("quiet", t, "staff", "um") for t in range(460, 470)]
    df = chunks(spark, talk)
    want = {r["seq"]: r["empathy"] for r in CO.coach_batch(df, long_calls=False).collect()}
    got = {r["seq"]: r["empathy"] for r in CO.coach_batch(df, long_calls=True, block_rows=1).collect()}
    assert got == pytest.approx(want, abs=1e-12)
    assert got[459] == pytest.approx(got[2]) and got[469] < got[459]


def test_final_report(spark):
    r = CO.final_report(CO.coach_batch(chunks(spark, BILLING))).first()
    assert (r["interaction_count"], r["call_duration"], r["total_alerts"], r["alerts_sentiment"]) == (4, 180.0, 4, 1)
    assert (r["initial_sentiment"], r["final_sentiment"], r["lowest_point"], r["coaching_interventions"]) == (1.0, 1.0, -1.0, 1)
    assert r["areas_for_improvement"][-1] == R.SENTIMENT_AREA[0]
    assert r["recommended_training"][-1] == R.SENTIMENT_AREA[1] and len(r["recommended_training"]) == len(r["areas_for_improvement"])


def test_legacy_profile_looks_at_the_whole_buffer(spark):
    out = CO.coach_batch(chunks(spark, BILLING), "legacy")
    assert by_seq(out, "c1", "sentiment") == pytest.approx([1.0, -1 / 3, -1 / 3, 0.2])
    assert by_seq(out, "c1", "stage") == ["question", "question", "discussion", "discussion"]
    assert [[a["type"] for a in x] for x in by_seq(out, "c1", "suggestions")][:2] == [["active_listening"], ["empathy", "active_listening"]]


def test_counted_phrases_must_not_overlap_themselves(spark):
    with pytest.raises(ValueError):
        CO.chunk_signals(chunks(spark, BILLING), {"resolution": ["abab"]})


def test_staff_baseline_takes_the_last_ten(spark):
    sessions = [("s", f"c{i:02d}", i, float(i)) for i in range(15)]
    df = spark.createDataFrame(sessions, "staff_id string, call_id string, t long, v double").selectExpr(
        "staff_id", "call_id", "timestamp_seconds(t) AS ended_at", *[f"v AS {s}" for s in R.SCORES])
    assert CO.staff_baseline(df).first()["empathy"] == pytest.approx(sum(range(5, 15)) / 10)
    known = CO.with_staff_baseline(spark.createDataFrame([("x", "s"), ("y", "new")], "call_id string, staff_id string"), CO.staff_baseline(df))
    got = {r["call_id"]: (r["baseline_empathy"], r["baseline_professionalism"], r["baseline_known"]) for r in known.collect()}
    assert got == {"x": (9.5, 9.5, True), "y": (0.7, 0.8, False)}


def test_opening_advice(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, False)], "id int, is_new_patient boolean, high_value boolean")
    out = {r["id"]: r for r in CO.opening_advice(df).collect()}
    assert len(out[1]["opening_tips"]) == 5 and out[1]["opening_approach"] == R.OPENING_APPROACH["is_new_patient"]
    assert len(out[2]["opening_tips"]) == 3 and out[2]["opening_approach"] == R.OPENING_APPROACH_OTHER


def test_turns(spark):
    talk = [("a", 0, "staff", "hello there friend"), ("a", 1, "staff", "yes"), ("a", 2, "customer", "no problem at all"), ("a", 3, "customer", "bye")]
    df = chunks(spark, talk)
    s = CV.turn_stats(df).first()
    assert (s["total_turns"], s["segments"], s["average_turn_length"]) == (2, 4, 9 / 4)
    assert rows(CV.interruptions(df), "seq") == [(1,)]
    assert rows(CV.turn_distribution(df), "speaker", "share") == [("customer", 0.5), ("staff", 0.5)]
    assert rows(CV.turn_stats(df, long_calls=True)) == rows(CV.turn_stats(df))
    p = CV.sentiment_progression(df).first()
    assert (p["first_sentiment"], p["last_sentiment"], p["overall_trend"]) == (0.0, 0.0, "declining")


@pytest.mark.parametrize("long_calls", [False, True])
def test_topic_shifts(spark, long_calls):
    talk = [("a", 0, "x", "one two three"), ("a", 1, "x", "One two four"), ("a", 2, "x", "five six"), ("a", 3, "x", " "), ("a", 4, "x", " ")]
    out = CV.topic_shifts(chunks(spark, talk), long_calls=long_calls)
    assert rows(out, "seq", "similarity", "shift_type") == [(2, 0.0, "major"), (3, 0.0, "major")]


def test_segments_round_trip_in_parts(spark):
    talk = [("a", t, "x", f"line {t}") for t in range(25)]
    parts = CV.concat_segments(chunks(spark, talk), part_rows=10)
    assert parts.count() == 3
    lines = CV.split_segments(parts.orderBy("part"))
    assert sorted(r["text"] for r in lines.collect()) == sorted(f"line {t}" for t in range(25))


def test_key_themes(spark):
    df = spark.createDataFrame([("a", "banana banana apple pain cherry apple banana zebra")], "call_id string, transcript string")
    assert rows(CV.key_themes(df), "theme_rank", "token", "n") == [(1, "banana", 3), (2, "apple", 2), (3, "pain", 1)]


def test_customer_notes_need_not_be_there(spark):
    sessions = spark.createDataFrame([(1,), (2,), (3,)], "customer_id long")
    known = spark.createDataFrame([(1, ["a"] * 4, ["whitening"], "brief"), (2, [], [], "")],
                                  "customer_id long, visit_history array<string>, service_preferences array<string>, communication_style string")
    got = {r["customer_id"]: tuple(r)[-3:] for r in CO.customer_insights(sessions, known).select("customer_id", "visit_pattern", "preferred_services", "communication_notes").collect()}
    assert got == {1: ("Regular patient", ["whitening"], "brief"), 2: (None, None, None), 3: (None, None, None)}
    bare = CO.customer_insights(sessions, known.select("customer_id")).first()
    assert (bare["visit_pattern"], bare["preferred_services"], bare["communication_notes"]) == (None, None, None)


def test_key_themes_shuffle_texts_only(spark):
    df = spark.createDataFrame([("a", "pear plum pear"), ("a", "plum pear fig"), ("b", "fig fig"), (None, "kiwi kiwi")], "call_id string, transcript string")
    themes = CV.key_themes(df, stop_words=[])
    assert rows(themes, "call_id", "theme_rank", "token", "n") == sorted([("a", 1, "pear", 3), ("a", 2, "plum", 2), ("b", 1, "fig", 2), (None, 1, "kiwi", 2)], key=str)
    plan = themes._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(call_id") == 1 and plan.index("Generate") < plan.index("Exchange")  # printed from the top
