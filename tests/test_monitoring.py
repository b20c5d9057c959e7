import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchboard.operators import monitoring as M
from tests.conftest import rows


def alerts(spark, listed):
    return spark.createDataFrame([(f"a{i:04d}", t, "high", c, "m", False, r) for i, (c, t, r) in enumerate(listed)],
                                 "alert_id string, t long, severity string, component string, message string, acknowledged boolean, resolved boolean"
                                 ).withColumn("ts", F.timestamp_seconds("t"))


def test_suppression_compares_with_the_last_kept(spark):
    df = alerts(spark, [("c", t, False) for t in (0, 3000, 4000, 7700)])
    assert rows(M.suppress_repeats(df), "t") == [(0,), (4000,), (7700,)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suppression_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    listed = [(rng.choice("cdd"), rng.randint(0, 200_000), rng.random() < 0.2) for _ in range(400)]
    df = alerts(spark, listed)
    last, kept = {}, set()
    for i, (c, t, resolved) in sorted(enumerate(listed), key=lambda x: (x[1][1], x[0])):
        if c not in last or t - last[c] >= 3600:
            kept.add(f"a{i:04d}")
            if not resolved:
                last[c] = t
    out = M.suppress_repeats(df.repartition(5))
    assert {r["alert_id"] for r in out.collect()} == kept


def test_trend_needs_a_full_window(spark):
    values = [90] * 9 + [95, 10] + [90] * 12
    df = spark.createDataFrame([("h", "cpu_usage", i, i * 1000, float(v)) for i, v in enumerate(values)],
                               "component string, name string, n int, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    want = [i for i in range(9, len(values)) if sum(values[i - 9:i + 1]) / 10 > 80]
    assert [r["n"] for r in M.metric_trend(df, tie="n").orderBy("n").collect()] == want


def test_thresholds_and_health(spark):
    metrics = spark.createDataFrame([("m", "cpu_usage", 1, 95.0), ("m", "memory_usage", 1, 60.0), ("m", "disk_usage", 1, 95.5)],
                                    "component string, name string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    assert rows(M.metric_thresholds(metrics), "name", "severity") == [("cpu_usage", "high"), ("disk_usage", "critical")]
    beats = spark.createDataFrame([("a", 900, "idle"), ("b", 100, "running"), ("c", 950, "error")], "component string, t long, status string").withColumn("ts", F.timestamp_seconds("t"))
    as_of = F.timestamp_seconds(F.lit(1000))
    none = alerts(spark, [("c", 1, True)])
    issues = M.health_issues(metrics, beats, none, as_of)
    assert rows(issues, "issue") == [("Agent b is not responding",), ("Agent c is in error state",), ("High CPU usage",), ("High disk usage",)]
    assert M.overall_health(issues).first()["overall_status"] == "degraded"
    assert M.overall_health(issues, "manager").first()["overall_status"] == "critical"
    assert M.overall_health(issues.limit(0)).first()["overall_status"] == "healthy"
    assert rows(M.stale_components(beats, as_of), "component") == [("b",)]
    assert M.active_components(beats).first()["active_components"] == 2


def test_retention(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("call_id"), F.timestamp_seconds("id").alias("ts"))
    assert M.keep_latest(df, limit=40, keep=5).count() == 30
    assert rows(M.keep_latest(df, limit=20, keep=3), "call_id") == [("27",), ("28",), ("29",)]


def test_sources(spark):
    df = spark.createDataFrame([("a", True, 100, 950), ("b", True, 10, 900), ("c", True, 10, None), ("d", False, 10, None), ("e", True, 1000, 990)],
                               "source_id string, enabled boolean, polling_interval int, t long").withColumn("last_check", F.timestamp_seconds("t"))
    errors = spark.createDataFrame([("e", 900 + i) for i in range(6)], "source_id string, t long").withColumn("ts", F.timestamp_seconds("t"))
    health = M.source_health(df, errors, F.timestamp_seconds(F.lit(1000)))
    assert rows(health, "source_id", "status") == [("a", "healthy"), ("b", "stale"), ("c", "not_checked"), ("d", "disabled"), ("e", "error")]
    assert M.overall_source_health(health).first()["overall_status"] == "degraded"


def test_runs(spark):
    runs = spark.createDataFrame([("1", 0, "success", 10.0), ("2", 1, "error", 40.0), ("3", 2, "success", 20.0)],
                                 "run_id string, t long, status string, duration double").withColumn("ts", F.timestamp_seconds("t"))
    s = M.run_stats(runs).first()
    assert (s["successful"], s["failed"], s["total"], s["average_duration"]) == (2, 1, 3, 15.0)
    assert rows(M.slow_runs(runs), "run_id") == [("2",)]
    assert rows(M.stalled_runs(runs, runs.where("run_id = '1'"), F.timestamp_seconds(F.lit(3602))), "run_id") == [("2",)]


def test_quality_gate_compares(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.6), ("c", 0.4)], "call_id string, quality_score double")
    assert rows(M.quality_gate(df), "call_id", "outcome") == [("b", "feedback"), ("c", "alert"), ("c", "feedback")]


def plain_walk(alerts, window):
    """(id) of the kept alerts of one key, one after the other."""
    last, kept = None, []
    for us, number, resolved in sorted(alerts):
        if last is None or us >= last + window:
            kept.append(number)
            last = last if resolved else us
    return kept


def test_passages_lead_through_blocks():
    """Blocks followed by their step functions keep what a walk over all alerts keeps."""
    rng = random.Random(5)
    for dense in (1, 5, 60):
        window, slots = 100, 4
        span = window * slots
        times = sorted(rng.randrange(span * 12) for _ in range(12 * slots * dense))
        times = [t for t in times if not span * 5 <= t < span * 6 + 30]  # a gap, too
        last, previous, kept = M.NEVER, None, []
        for block in sorted({t // span for t in times}):
            own = np.array([t for t in times if t // span == block])
            last = last if previous == block - 1 else M.NEVER
            keep, _ = M.keep_greedily(own, np.zeros(len(own), bool), None if last == M.NEVER else last, window)
            kept += own[keep].tolist()
            bounds, exits = M.passage(own, block * span, (block + 1) * span - window, window)
            last = exits[int(np.searchsorted(bounds, last)) if last != M.NEVER else 0]
            previous = block
        assert kept == plain_walk_times(times, window)


def plain_walk_times(times, window):
    kept = []
    for t in times:
        if not kept or t >= kept[-1] + window:
            kept.append(t)
    return kept


def test_one_key_that_never_stops_is_many_tasks(spark):
    """A key with alerts in every slot, some resolved, a key with gaps and a null key, against a walk; blocks are walked apart."""
    rng = random.Random(6)
    hour = 3_600_000_000
    rows, number = [], 0
    for key, spread in (("hot", 200 * hour), ("gaps", 4000 * hour), (None, 50 * hour)):
        for _ in range(2500 if key == "hot" else 300):
            number += 1
            rows.append((f"a{number:05d}", rng.randrange(spread), rng.random() < 0.1, key, "m", "high"))
    df = spark.createDataFrame(rows, "alert_id string, us long, resolved boolean, component string, message string, severity string").withColumn(
        "ts", F.timestamp_micros("us"))
    want = sorted(x for key in ("hot", "gaps", None) for x in plain_walk([(us, i, r) for i, us, r, c, *_ in rows if c == key], hour))
    for slots in (1, 3, 64):
        kept = M.suppress_repeats(df, 3600, block_slots=slots)
        assert kept.columns == df.columns and sorted(r["alert_id"] for r in kept.collect()) == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = M.suppress_repeats(df.where("component = 'hot'"), 3600, block_slots=8).select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tasks > 1
    assert M.suppress_repeats(df.limit(0), 3600).count() == 0
