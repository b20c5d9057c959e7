"""Times the headline queries and prints one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times; the median counts.  The
result goes to Spark's no-op sink, so that every column is computed and nothing
is collected.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from switchboard.plans.catalogue import QUERIES  # noqa: E402
from switchboard.session import build_session  # noqa: E402

HEADLINE = [
    # one insight per call or conversation
    "fallback_insight", "fallback_insight_of_chunks", "primary_intent", "call_insight_rules", "insights_from_answers",
    "medical_terms", "phone_entities", "predefined_topic_scores", "dedupe_analyses",
    # reports
    "overview", "top_intents", "common_pain_points", "insights_page", "export_csv",
    # conversation structure
    "turn_stats", "topic_shifts", "sentiment_journey", "key_themes", "key_phrases", "semantic_similarity",
    # coaching
    "running_score", "escalation_flags", "final_report", "staff_baseline",
    # daily series
    "daily_rollup", "rolling_features", "forecast_recommendations",
    # monitoring
    "metric_trend", "suppress_repeats", "health_report", "run_stats",
    # stored tables and streams
    "append_insights", "analyse_stream", "coach_stream",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-")})
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times = {}
    for name in chosen:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    sf = re.search(r"sf([\d.]+)", folder)
    calls = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else None, "cpus": int(cpus),
        "calls": calls,
        "calls_analysed_per_sec": round(calls / times["call_insight_rules"], 1) if times.get("call_insight_rules") else None,
    }))


if __name__ == "__main__":
    main()
