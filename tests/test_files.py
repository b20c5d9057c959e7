import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from switchboard.operators import insights as IN
from switchboard.sources import calls as C
from switchboard.sources import sinks as K
from tests.conftest import rows
from tests.test_insights import insight, table

BATCH = [{"call_id": "call_001", "transcript": "Hello, I need an appointment"},
         {"call_id": "call_002", "transcript": 'He said "ouch",\nthen left'}, {"call_id": "call_003"}]


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "calls.json").write_text(json.dumps(BATCH))
    df = C.load_calls(spark, str(tmp_path / "calls.json"))
    good, bad = C.require_fields(df)
    assert rows(good, "call_id") == [("call_001",), ("call_002",)] and rows(bad, "call_id") == [("call_003",)]
    with pytest.raises(PySparkException):
        C.require_fields(df, mode="fail").collect()
    (tmp_path / "calls.csv").write_text('transcript,call_id,duration\n"a ""quoted"", text\nsecond line",x,1.5\nplain,y,\n')
    csv = C.load_calls(spark, str(tmp_path / "calls.csv"), "csv")
    assert rows(csv, "call_id", "transcript", "duration") == [("x", 'a "quoted", text\nsecond line', 1.5), ("y", "plain", None)]
    with pytest.raises(ValueError):
        C.load_calls(spark, "x", "xml")


def test_folder_of_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("first\nsecond")
    (tmp_path / "two.json").write_text(json.dumps(BATCH[0]))
    (tmp_path / "three.wav").write_bytes(b"\x00\x01")
    (tmp_path / "four.pdf").write_bytes(b"x")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "five.txt").write_text("deep")
    df = C.scan_call_dir(spark, str(tmp_path), ["*.txt", "*.json", "*.wav", "*.pdf"])
    got = {r["call_id"]: r for r in df.collect()}
    assert set(got) == {"one", "call_001", "three"}
    assert got["one"]["transcript"] == "first\nsecond" and got["one"]["file_type"] == "text"
    assert got["three"]["needs_transcription"] and got["three"]["transcript"] is None
    assert C.scan_call_dir(spark, str(tmp_path), ["*.txt"], recursive=True).count() == 2
    assert C.scan_call_dir(spark, str(tmp_path), ["*.txt"], modified_after="2100-01-01T00:00:00").count() == 0
    assert rows(IN.acceptable_call(df), "call_id", "status") == [("call_001", "accepted"), ("one", "accepted"), ("three", "skipped")]


def test_registry(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("hello")
    sources = [{"source_id": "s1", "source_type": "file_system", "name": "one", "config": {"directory": str(tmp_path / "in"), "patterns": "*.txt"}},
               {"source_id": "s2", "source_type": "file_system", "name": "two", "config": {"directory": "/nowhere"}, "enabled": False}]
    (tmp_path / "sources.json").write_text(json.dumps({"sources": sources}))
    registry = C.source_registry(spark, str(tmp_path / "sources.json"))
    assert rows(registry, "source_id", "enabled", "polling_interval") == [("s1", True, 300), ("s2", False, 300)]
    assert rows(C.load_registered(spark, registry), "call_id", "source_id") == [("a", "s1")]


def test_api_pages(spark):
    call = {"id": "x1", "transcript": "hi", "duration": 3, "caller": {"phone": "1"}, "timestamp": "2024-05-01T10:00:00"}
    pages = spark.createDataFrame([(json.dumps({"calls": [call, {"transcript": "no id"}]}),), (json.dumps([{**call, "id": "x2"}]),)], "value string")
    out = C.normalise_api_calls(pages).collect()
    ids = sorted(r["call_id"] for r in out)
    assert ids[1:] == ["x1", "x2"] and ids[0].startswith("api_call_")
    assert all(json.loads(r["api_data"]) for r in out)
    assert {r["caller"].get("phone") for r in out if r["call_id"] != ids[0]} == {"1"}


def test_landed_files(spark):
    files = spark.createDataFrame([("a.txt", "l1\r\nl2\n"), ("b.wav", "x"), ("c.pdf", "x")], "file_name string, content string") \
        .withColumn("modified", F.to_timestamp(F.lit("2024-01-02 03:04:05")))
    assert rows(C.normalise_landed_files(files), "call_id", "transcript", "file_type") == [
        ("ftp_a.txt_20240102_030405", "l1\nl2", "text"), ("ftp_b.wav_20240102_030405", "", "audio")]


def test_history(spark, tmp_path):
    good = {"call_id": "a", "timestamp": "2024-05-01T10:00:00", "sentiment_score": 0.5, "pain_points": ["x"]}
    (tmp_path / "h.json").write_text(json.dumps([good, {**good, "call_id": "b"}]))
    h = C.load_history(spark, str(tmp_path / "h.json")).orderBy("call_id").collect()
    assert [r["call_id"] for r in h] == ["a", "b"] and h[0]["ts"].year == 2024
    (tmp_path / "mixed.json").write_text(json.dumps([good, {"call_id": "b", "sentiment_score": "many"}]))
    assert C.load_history(spark, str(tmp_path / "mixed.json")).count() == 0
    (tmp_path / "broken.json").write_text("[{")
    assert C.load_history(spark, str(tmp_path / "broken.json")).count() == 0


def test_stored_insights_stay_unique(spark, tmp_path):
    path = str(tmp_path / "insights")
    first = table(spark, insight(), insight(call_id="b"))
    K.append_insights(first, path)
    K.append_insights(table(spark, insight(), insight(call_id="c"), insight(call_id="c")), path)
    assert rows(K.read_insights(spark, path), "call_id") == [("b",), ("c",), ("ring-7",)]
    with pytest.raises(K.DuplicateCalls):
        K.append_insights(table(spark, insight(call_id="d"), insight(call_id="b")), path, "atomic")
    with pytest.raises(K.DuplicateCalls):
        K.append_insights(table(spark, insight(call_id="e"), insight(call_id="e")), path, "atomic")
    assert K.read_insights(spark, path).count() == 3
    K.append_insights(table(spark, insight(call_id="d")), path, "atomic")
    assert K.read_insights(spark, path).count() == 4


def test_exports(spark, tmp_path):
    df = table(spark, insight(pain_points=["a", "b"]), insight(call_id="b", clinic_mentioned='say "hi", now'))
    K.export_json(df, str(tmp_path / "j"))
    j = spark.read.json(str(tmp_path / "j"))
    assert set(j.columns) == {"call_id", "timestamp", "clinic_mentioned", "primary_intent", "secondary_intents", "sentiment_score", "urgency_level",
                              "resolution_status", "revenue_opportunity", "service_requests", "pain_points", "success_factors", "next_actions", "confidence_score"}
    K.export_csv(df, str(tmp_path / "c"))
    c = {r["call_id"]: r for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).collect()}
    assert c["ring-7"]["pain_points"] == "a, b" and c["b"]["clinic_mentioned"] == 'say "hi", now'
    assert c["b"]["timestamp"].startswith("2019-11-23T00:00:00")


def test_quarantine_excerpt(spark):
    df = spark.createDataFrame([("a", "x" * 300), ("b", "short")], "call_id string, transcript string")
    out = K.quarantine_rows(df, F.lit("bad"), F.current_timestamp())
    assert rows(out, "call_id", F.length("transcript"), "error") == [("a", 203, "bad"), ("b", 5, "bad")]
