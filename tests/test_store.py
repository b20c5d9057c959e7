import json
import re

import pytest
from pyspark.sql import functions as F

from switchboard.sources import sinks as K
from switchboard.sources import store
from switchboard.sources.files import Folder
from switchboard.streaming import calls as SC
from tests.conftest import rows
from tests.test_insights import insight, table


def ids_of(spark, path):
    return sorted(r["call_id"] for r in K.read_insights(spark, path).collect())


def batch_of(spark, *ids):
    return table(spark, *(insight(call_id=i) for i in ids))


def test_publish_never_replaces(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    assert folder.publish("a/x", "one é") and not folder.publish("a/x", "two") and folder.read("a/x") == "one é"
    assert folder.names("a") == ["x"] and folder.names("none") == [] and not [n for n in folder.names() if n.startswith("_draft")]
    folder.delete("a")
    assert not folder.exists("a/x")


def test_files_read_do_not_grow_with_history(spark, tmp_path, monkeypatch):
    """An append opens the id files of its own buckets only, at most MERGE - 1 of each, however many appends came before."""
    path, opened = str(tmp_path / "s"), []
    plain = store.stored_ids

    def watched(spark, path, commit, buckets):
        found = plain(spark, path, commit, buckets)
        opened.append((len(buckets), 0 if found is None else len(found.inputFiles())))
        return found

    monkeypatch.setattr(store, "stored_ids", watched)
    monkeypatch.setattr(store, "MERGE", 3)
    for k in range(9):
        store.append(batch_of(spark, f"call-{k}", f"other-{k}"), path, buckets=4)
    assert len(ids_of(spark, path)) == 18
    assert all(files <= 2 * n for n, files in opened) and max(files for _, files in opened) <= 8
    commit = store.last_commit(Folder(spark, path))
    assert all(len(v) < 3 for v in commit.ids.values()) and commit.version == 9 and commit.buckets == 4
    assert len(Folder(spark, path).names("commits")) == store.KEPT_COMMITS + 1
    before = len(list((tmp_path / "s" / "ids").rglob("*.parquet")))
    store.tidy(spark, path)
    after = list((tmp_path / "s" / "ids").rglob("*.parquet"))
    assert len(after) < before and len(ids_of(spark, path)) == 18
    store.append(batch_of(spark, "call-3", "new"), path)
    assert len(ids_of(spark, path)) == 19


def test_an_id_of_another_bucket_opens_no_file(spark, tmp_path):
    path = str(tmp_path / "s")
    store.append(batch_of(spark, "a"), path, buckets=1000)
    commit = store.last_commit(Folder(spark, path))
    (stored,) = commit.ids
    other = next(f"x{k}" for k in range(99) if spark.range(1).select(store.bucket_of(F.lit(f"x{k}"), 1000)).first()[0] != stored)
    hit = [r[0] for r in batch_of(spark, other).select(store.bucket_of(F.col("call_id"), 1000)).collect()]
    assert store.stored_ids(spark, path, commit, hit) is None and store.stored_ids(spark, path, commit, [stored]).count() == 1


def test_a_cut_off_append_leaves_the_table(spark, tmp_path, monkeypatch):
    """Killed between writing and the commit: readers see the table as it was, and the next append is whole."""
    path = str(tmp_path / "s")
    K.append_insights(batch_of(spark, "a", "b"), path)
    before = rows(K.read_insights(spark, path), "call_id", "ts", "day")
    for mode in ("skip", "atomic"):
        with monkeypatch.context() as m:
            m.setattr(Folder, "publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                K.append_insights(batch_of(spark, "lost", "c"), path, mode)
        assert rows(K.read_insights(spark, path), "call_id", "ts", "day") == before
    assert Folder(spark, path).names("rows") == ["version=1", "version=2"]
    K.append_insights(batch_of(spark, "c", "d"), path, "atomic")
    assert ids_of(spark, path) == ["a", "b", "c", "d"]
    (tmp_path / "s" / "rows" / "version=7").mkdir()
    store.tidy(spark, path)
    assert Folder(spark, path).names("rows") == ["version=1", "version=2"] and ids_of(spark, path) == ["a", "b", "c", "d"]


def test_of_two_appends_at_a_time_one_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    K.append_insights(batch_of(spark, "a"), path)
    plain, first = store.write_days, []

    def interrupted(df, *args):
        plain(df, *args)
        if not first:
            first.append(1)
            Folder(spark, path).publish("commits/000000000002", json.dumps({"buckets": 64, "ids": {}, "batches": {}, "fields": []}))

    monkeypatch.setattr(store, "write_days", interrupted)
    with pytest.raises(store.ConcurrentAppend):
        K.append_insights(batch_of(spark, "b"), path)


def test_repeats_are_resolved_in_a_stated_order(spark, tmp_path):
    early, late = "2024-01-01 00:00:00", "2024-01-02 00:00:00"
    df = batch_of(spark, *["hot"] * 6, "b", None, None).withColumn("n", F.monotonically_increasing_id() % 97)
    order = spark.createDataFrame([(early, "z"), (late, "a"), (early, "y"), (None, "a")], "at string, clinic string")
    df = df.where("call_id = 'hot'").limit(1).drop("ts", "clinic_mentioned", "n").join(order.withColumns(
        {"ts": F.to_timestamp("at"), "clinic_mentioned": F.col("clinic")}).drop("at", "clinic")).unionByName(df.where("call_id is null or call_id = 'b'").drop("n"))
    for seed in range(3):
        path = str(tmp_path / str(seed))
        K.append_insights(df.orderBy(F.rand(seed)), path)
        kept = {r["call_id"]: r for r in K.read_insights(spark, path).collect()}
        assert set(kept) == {"hot", "b", None} and (kept["hot"]["clinic_mentioned"], str(kept["hot"]["ts"])) == ("y", early)
    K.append_insights(df, path)
    assert len(ids_of_or_null(spark, path)) == 3


def ids_of_or_null(spark, path):
    return K.read_insights(spark, path).select("call_id").collect()


def test_repeated_micro_batches_are_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    write = SC.insights_sink(path)
    write(batch_of(spark, "a", "b"), 0)
    write(batch_of(spark, "c"), 1)
    write(batch_of(spark, "never"), 1)  # the numbers say that it was stored
    write(batch_of(spark, "never"), 0)
    assert ids_of(spark, path) == ["a", "b", "c"]
    SC.insights_sink(path, writer="second")(batch_of(spark, "c", "d"), 0)
    assert ids_of(spark, path) == ["a", "b", "c", "d"]
    assert store.last_commit(Folder(spark, path)).batches == {"stream": 1, "second": 0}


def test_empty_batches_and_stores(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    K.append_insights(batch_of(spark, "a").limit(0), path, writer="w", batch=4)
    assert ids_of(spark, path) == [] and store.last_commit(Folder(spark, path)).batches == {"w": 4}
    K.append_insights(batch_of(spark, "a"), path, "atomic")
    assert ids_of(spark, path) == ["a"]
    with pytest.raises(ValueError):
        K.append_insights(batch_of(spark, "a"), path, "other")


def test_days_are_pruned(spark, tmp_path):
    path = str(tmp_path / "s")
    df = spark.range(40).select(F.concat(F.lit("c"), F.col("id")).alias("call_id"), F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id), 0, 0, 0)").alias("ts"))
    K.append_insights(df, path)
    some = K.insights_of_days(spark, path, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-07").cast("timestamp"))
    assert sorted(r["call_id"] for r in some.collect()) == ["c4", "c5", "c6"]
    plan = some._sc._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[.*day", plan)
