import datetime as dt

from pyspark.sql import functions as F

from switchboard.operators import engines as G
from switchboard.operators import insights as IN
from switchboard.sources import sinks as K
from tests.conftest import rows


def broken(text):
    if "boom" in text:
        raise KeyError("boom")
    return len(text)


def table(spark):
    return spark.createDataFrame([("a", "thank you, 555-123-4567"), ("b", "boom terrible pain"), ("c", None), ("d", "")], "call_id string, transcript string")


def test_a_failing_engine_leaves_the_others(spark):
    plain = IN.analyse_calls(table(spark))
    own = {"size": G.Engine(broken, "long"), "first": G.Engine(lambda t: t.split()[0], "string")}
    out = IN.analyse_calls(table(spark), guarded=own)
    same = [c for c in plain.columns]
    assert rows(out, *same) == rows(plain, *same)
    got = {r["call_id"]: r for r in out.collect()}
    assert (got["a"]["size"], got["a"]["first"], got["a"]["engine_errors"]) == (23, "thank", [])
    assert got["b"]["size"] is None and [tuple(e) for e in got["b"]["engine_errors"]] == [("size", "KeyError: 'boom'")]
    assert got["c"]["size"] is None and got["c"]["engine_errors"] == []
    assert got["d"]["size"] == 0 and [e["engine"] for e in got["d"]["engine_errors"]] == ["first"]


def test_a_replaced_engine_that_fails_leaves_three(spark):
    """The four built-in results with the sentiment engine replaced by one that fails on a row."""
    out = IN.analyse_calls(table(spark), guarded={"sentiment_score": G.Engine(lambda t: broken(t) * -1.0, "double")})
    got = {r["call_id"]: r for r in out.collect()}
    assert got["b"]["sentiment_score"] is None and got["b"]["medical_terms"] and got["b"]["primary_intent"] and got["b"]["dominant_topic"]
    assert got["a"]["sentiment_score"] == -23.0 and "high" == got["a"]["priority"]  # insights follow the replaced value


def test_errors_add_up_and_split(spark):
    once = G.with_engines(table(spark), {"one": G.Engine(broken, "long")})
    twice = G.with_engines(once, {"two": G.Engine(broken, "long")})
    good, bad = G.failed_calls(twice)
    assert rows(bad.select("call_id", G.error_text().alias("e"))) == [("b", "one: KeyError: 'boom'; two: KeyError: 'boom'")] and good.count() == 3
    assert "_attempt_0" not in twice.columns


def test_wrong_types_are_an_engines_own_error(spark):
    out = G.with_engines(table(spark).where("call_id = 'a'"), {"n": G.Engine(lambda t: {"x": len(t)}["x"], "long")})
    assert out.first()["n"] == 23


def test_dead_letters_last_a_day(spark, tmp_path):
    path, now = str(tmp_path / "dead"), dt.datetime(2024, 5, 2, 12, 30)
    at = [now - dt.timedelta(hours=h) for h in (0, 1, 23.9, 24, 24.4, 30, 100)]
    df = spark.createDataFrame([(f"c{k}", "x" * 300, t) for k, t in enumerate(at)], "call_id string, transcript string, at timestamp")
    K.append_dead_letters(K.quarantine_rows(df, F.lit("bad"), F.col("at")), path)
    when = F.lit(now)
    assert rows(K.dead_letters(spark, path, when), "call_id", F.length("transcript"), "error") == [("c0", 203, "bad"), ("c1", 203, "bad"), ("c2", 203, "bad")]
    assert K.expire_dead_letters(spark, path, when) == 2
    assert rows(K.dead_letters(spark, path, when), "call_id") == [("c0",), ("c1",), ("c2",)]
    assert rows(K.dead_letters(spark, path, when, hours=48), "call_id") == [("c0",), ("c1",), ("c2",), ("c3",), ("c4",)]
