import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchboard.operators import coaching as CO
from switchboard.plans.catalogue import QUERIES
from switchboard.sources import sinks as K
from switchboard.streaming import calls as SC
from switchboard.streaming import coaching as SCO
from switchboard.streaming import monitoring as SM
from switchboard.streaming import tables as ST
from tests.conftest import TESTDATA, rows
from tests.talks import BILLING, chunks
from tests.test_coaching import random_talk

CHUNK = "call_id string, seq int, ts timestamp, speaker string, text string, staff_id string"
SHOWN = ["call_id", "seq", "stage", "interaction_count", "buffer_chars", "resolution_attempts", "frustration_count"]


def shown(df):
    kinds = [F.array_join(F.transform(c, lambda a: a["message"]), "|").alias(c) for c in ("alerts", "suggestions", "escalation_flags")]
    return rows(df, *SHOWN, *[F.round(s, 9).alias(s) for s in ("sentiment", "empathy", "knowledge", "overall")], *kinds)


@pytest.mark.parametrize("profile", ["default", "legacy"])
def test_stream_equals_batch_over_several_batches(spark, tmp_path, profile):
    talk = chunks(spark, random_talk(11, calls=3, turns=12))
    path = str(tmp_path / "chunks")
    for low, high in ((0, 4), (4, 9), (9, 12)):  # three files, read one per micro-batch
        talk.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = SCO.coach_stream(ST.table_stream(spark, path, CHUNK, max_files=1), profile, delay="2 hours")
    out = ST.run_available(stream, "coach").where(~F.col("session_ended"))
    assert shown(out) == shown(CO.coach_batch(talk, profile))


def test_end_marker_writes_the_report(spark, tmp_path):
    talk = chunks(spark, BILLING + [("c1", 4, "end", ""), ("c9", 0, "staff", "hello")])
    path, root = str(tmp_path / "chunks"), str(tmp_path / "out")
    talk.coalesce(1).write.parquet(path)
    sink = SCO.coaching_sink(root, spark.createDataFrame([("c1", "staff_1")], "call_id string, staff_id string"))
    ST.run_batches(SCO.coach_stream(ST.table_stream(spark, path, CHUNK)), sink, "end")
    assert SCO.written(spark, root, "responses").count() == 5
    report = SCO.written(spark, root, "reports").collect()
    want = CO.final_report(CO.coach_batch(chunks(spark, BILLING))).first()
    assert [r["call_id"] for r in report] == ["c1"] and report[0]["overall"] == pytest.approx(want["overall"])
    assert SCO.written(spark, root, "performance").first()["staff_id"] == "staff_1"
    assert [r["call_id"] for r in SCO.open_sessions(spark, root).collect()] == ["c9"]


def approx_rows(df, by):
    return {tuple(r[c] for c in by): {k: pytest.approx(v, abs=1e-9) if isinstance(v, float) else v for k, v in r.asDict(recursive=True).items() if k not in by} for r in df.collect()}


def test_reports_add_up_over_batches(spark, tmp_path):
    """Reports and session rows from parts equal those of all responses at once; no batch reads the responses of another."""
    talks = random_talk(17, calls=5, turns=15)
    ends = [(f"r{c}", 99, "end", "") for c in range(3)]
    talk = chunks(spark, talks + ends)
    path, root = str(tmp_path / "chunks"), str(tmp_path / "out")
    for low, high in ((0, 5), (5, 6), (6, 15), (99, 100)):
        talk.where(F.col("seq").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    stream = SCO.coach_stream(ST.table_stream(spark, path, CHUNK, max_files=1), delay="2 hours")
    plain, sink = [], SCO.coaching_sink(root)

    def write(batch, number):
        for old in (tmp_path / "out" / "responses").glob("*"):  # gone, so nothing can read them again
            old.rename(tmp_path / f"moved-{old.name}")
        sink(batch, number)
        plain.append(number)

    ST.run_batches(stream, write, "parts")
    assert len(plain) >= 4 and len(list((tmp_path / "out" / "open").glob("batch_id=*"))) <= 2
    whole = CO.coach_batch(chunks(spark, talks))
    ended = [e[0] for e in ends]
    want = CO.final_report(whole).where(F.col("call_id").isin(ended))
    got = SCO.written(spark, root, "reports")
    assert set(got.columns) == set(want.columns) and len(ended) == 3
    assert {k: v for k, v in approx_rows(got, ["call_id"]).items()} == approx_rows(want, ["call_id"])
    assert approx_rows(SCO.written(spark, root, "sessions"), ["call_id"]) == approx_rows(K.coaching_session_rows(whole).where(F.col("call_id").isin(ended)), ["call_id"])


def test_a_call_may_have_several_sessions(spark, tmp_path):
    talk = chunks(spark, [("c1", 0, "staff", "hello"), ("c1", 1, "end", ""), ("c1", 2, "staff", "sorry again"), ("c1", 3, "customer", "fine"), ("c1", 4, "end", ""), ("c1", 5, "staff", "x")])
    path, root = str(tmp_path / "chunks"), str(tmp_path / "out")
    talk.coalesce(1).write.parquet(path)
    ST.run_batches(SCO.coach_stream(ST.table_stream(spark, path, CHUNK)), SCO.coaching_sink(root), "twice")
    assert rows(SCO.written(spark, root, "reports"), "call_id", "interaction_count") == [("c1", 1), ("c1", 2)]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path, root = str(tmp_path / "chunks"), str(tmp_path / "out")
    chunks(spark, BILLING).coalesce(1).write.parquet(path)
    chunks(spark, [("c1", 4, "end", "")]).coalesce(1).write.mode("append").parquet(path)
    sink = SCO.coaching_sink(root)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    ST.run_batches(SCO.coach_stream(ST.table_stream(spark, path, CHUNK, max_files=1), delay="2 hours"), twice, "repeat")
    assert rows(SCO.written(spark, root, "reports"), "call_id", "interaction_count") == [("c1", 4)]
    assert SCO.written(spark, root, "responses").count() == 4


def test_scores_of_long_calls_stay_exact():
    rng = np.random.default_rng(1)
    x, s, want = rng.random(5000), 0.5, [0.5]
    for v in x:
        s = 0.8 * s + 0.2 * v
        want.append(s)
    assert np.allclose(SCO.decayed(x, 0.5, 0.8), want, rtol=0, atol=1e-12)


def test_silence_ends_a_session(spark, tmp_path):
    path = str(tmp_path / "chunks")
    late = chunks(spark, [("c3", 0, "staff", "much later")]).withColumn("ts", F.col("ts") + F.expr("interval 5 hours"))
    chunks(spark, BILLING).coalesce(1).write.parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    stream = SCO.coach_stream(ST.table_stream(spark, path, CHUNK, max_files=1), gap_seconds=1800)
    out = ST.run_available(stream, "silence")
    assert rows(out.where("session_ended"), "call_id", "interaction_count") == [("c1", 4)]


def test_repeated_batches_add_nothing(spark, tmp_path):
    from tests.test_insights import insight, table

    path = str(tmp_path / "stored")
    write = SC.insights_sink(path)
    batch = table(spark, insight(), insight(call_id="b"))
    write(batch, 0)
    write(batch, 0)
    assert K.read_insights(spark, path).count() == 2


def test_files_become_calls_and_are_archived(spark, tmp_path):
    inbox, done = tmp_path / "in", tmp_path / "done"
    inbox.mkdir()
    (inbox / "a.txt").write_text("severe pain\nemergency")
    (inbox / "b.json").write_text(json.dumps({"call_id": "b", "transcript": "hello"}))
    texts = ST.call_stream(spark, str(inbox), "*.txt", "desk", archive=str(done))
    out = ST.run_available(SC.analyse_stream(texts).select("call_id", "source_id", "priority"), "texts")
    assert rows(out) == [("a", "desk", "high")]
    records = ST.run_available(ST.call_stream(spark, str(inbox), "*.json").select("call_id", "transcript"), "records")
    assert rows(records) == [("b", "hello")]


def test_alert_state_spans_batches(spark, tmp_path):
    path = str(tmp_path / "alerts")
    for t in (0, 3000, 4000, 7700):
        spark.createDataFrame([(f"a{t}", 1_700_000_000 + t)], "alert_id string, t long").select(
            "alert_id", F.timestamp_seconds("t").alias("ts"), F.lit("high").alias("severity"), F.lit("c").alias("component"),
            F.lit("m").alias("message"), F.lit(False).alias("resolved")).coalesce(1).write.mode("append").parquet(path)
    schema = "alert_id string, ts timestamp, severity string, component string, message string, resolved boolean"
    out = ST.run_available(SM.alert_stream(ST.table_stream(spark, path, schema, max_files=1)), "alerts")
    assert rows(out, "alert_id") == [("a0",), ("a4000",), ("a7700",)]


def test_silent_components_and_stalled_runs(spark, tmp_path):
    path = str(tmp_path / "beats")
    base = 1_700_000_000
    for listed in ([("a", 0), ("b", 0)], [("a", 60)], [("a", 400)]):
        spark.createDataFrame([(c, base + t) for c, t in listed], "component string, t long").select(
            "component", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    out = ST.run_available(SM.stale_component_stream(ST.table_stream(spark, path, "component string, ts timestamp", max_files=1), 120), "beats")
    assert ("b",) in rows(out, "component")
    runs = str(tmp_path / "runs")
    for listed in ([("r1", 0, "started"), ("r2", 0, "started")], [("r1", 50, "ended")], [("r3", 9000, "started")]):
        spark.createDataFrame([(r, base + t, s) for r, t, s in listed], "run_id string, t long, status string").select(
            "run_id", F.timestamp_seconds("t").alias("ts"), "status").coalesce(1).write.mode("append").parquet(runs)
    stalled = ST.run_available(SM.stalled_run_stream(ST.table_stream(spark, runs, "run_id string, ts timestamp, status string", max_files=1)), "runs")
    assert rows(stalled, "run_id") == [("r2",)]


@pytest.mark.skipif(not os.path.isdir(TESTDATA), reason="needs the conversation tables")
def test_session_start_query_runs_the_operator(spark, monkeypatch):
    seen, operator = [], CO.session_start
    monkeypatch.setattr(CO, "session_start", lambda first, *given: seen.append(first.isStreaming) or operator(first, *given))
    assert QUERIES["session_start"](spark, TESTDATA).count() > 0 and seen == [True]


def test_ledger_tells_files_batches_and_places(spark, tmp_path):
    """Files are archived where the ledger says, the last batch's too; a repeated batch and a later run tell nothing twice."""
    inbox, archive, root, state = (str(tmp_path / n) for n in ("in", "done", "out", "state"))
    os.makedirs(inbox)
    for k in range(5):
        with open(f"{inbox}/f{k}.json", "w") as f:
            json.dump([{"call_id": f"{k}-{c}", "transcript": f"text {c}"} for c in range(k + 1)], f)
    sink = ST.landed_sink(root, archive)

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    def run():
        stream = ST.call_stream(spark, inbox, "*.json", "desk", archive=archive, max_files=2)
        ST.run_batches(stream.select("call_id", "transcript", "source_file"), twice, "calls", state)

    run()
    assert 0 < ST.archive_last_batch(spark, root, state) <= 2 and os.listdir(inbox) == []
    assert ST.archive_last_batch(spark, root, state) == 0
    files = ST.landed(spark, root, "files").collect()
    assert sorted((os.path.basename(r["source_file"]), r["calls"]) for r in files) == [(f"f{k}.json", k + 1) for k in range(5)]
    assert len({r["batch_id"] for r in files}) == 3 and all(os.path.isfile(r["archived_as"]) for r in files)
    assert ST.landed(spark, root, "calls").count() == 15
    with open(f"{inbox}/late.json", "w") as f:
        json.dump({"call_id": "late", "transcript": "x"}, f)
    run()
    assert ST.landed(spark, root, "calls").count() == 16 and ST.landed(spark, root, "files").count() == 6
