"""Queries over alerts, metrics, heartbeats and run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard.operators import engines, insights
from switchboard.operators import monitoring as M
from switchboard.plans import tables as B
from switchboard.plans.registry import big, num, q, query, sql_sentiment
from switchboard.session import scratch_path
from switchboard.sources import sinks

A = f"WITH {B.ALERTS}"
NOW = f"TIMESTAMP '{B.AS_OF}'"
WINDOW_HOURS = 6


@query("filter_alerts", A + " SELECT alert_id, severity, component FROM alerts WHERE severity = 'high' AND NOT resolved")
def filter_alerts(spark, d):
    return M.filter_alerts(B.alerts(spark, d), "high").select("alert_id", "severity", "component")


@query("acknowledge_alerts", A + " SELECT alert_id, CAST(severity = 'critical' AS INT) AS acknowledged FROM alerts")
def acknowledge_alerts(spark, d):
    a = B.alerts(spark, d)
    return M.acknowledge(a, a.where("severity = 'critical'")).select("alert_id", F.col("acknowledged").cast("int").alias("acknowledged"))


KEPT = (f"WITH RECURSIVE {B.ALERTS}, u AS (SELECT * FROM alerts WHERE NOT resolved), k AS (SELECT component, message, min(ts) AS ts FROM u GROUP BY 1, 2 "
        f"UNION ALL SELECT k.component, k.message, min(u.ts) AS ts FROM k JOIN u ON u.component = k.component AND u.message = k.message AND u.ts >= k.ts + INTERVAL {WINDOW_HOURS} HOUR GROUP BY 1, 2), "
        f"kept AS (SELECT a.* FROM alerts a WHERE NOT resolved AND EXISTS (SELECT 1 FROM k WHERE k.component = a.component AND k.message = a.message AND k.ts = a.ts) "
        f"UNION ALL SELECT a.* FROM alerts a WHERE resolved AND NOT EXISTS (SELECT 1 FROM k WHERE k.component = a.component AND k.message = a.message AND k.ts <= a.ts AND a.ts < k.ts + INTERVAL {WINDOW_HOURS} HOUR))")


@query("suppress_repeats", KEPT + " SELECT alert_id, component, message FROM kept")
def suppress_repeats(spark, d):
    return M.suppress_repeats(B.alerts(spark, d), WINDOW_HOURS * 3600).select("alert_id", "component", "message")


@query("metric_thresholds", f"WITH {B.METRICS} SELECT CAST(reading_id AS BIGINT) AS reading_id, name, value, CASE name WHEN 'disk_usage' THEN 'critical' ELSE 'high' END AS severity FROM metrics "
       "WHERE (name = 'cpu_usage' AND value > 80) OR (name = 'memory_usage' AND value > 85) OR (name = 'disk_usage' AND value > 90)")
def metric_thresholds(spark, d):
    return M.metric_thresholds(B.metrics(spark, d)).select("reading_id", "name", "value", "severity")


@query("metric_trend", f"WITH {B.METRICS}, w AS (SELECT *, count(*) OVER x AS n, avg(value) OVER x AS m FROM metrics WINDOW x AS (PARTITION BY component, name ORDER BY ts, reading_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) "
       "SELECT component, name, CAST(reading_id AS BIGINT) AS reading_id, round(m, 6) AS mean_value FROM w WHERE n = 10 AND m > CASE name WHEN 'cpu_usage' THEN 55 WHEN 'memory_usage' THEN 60 ELSE 1000 END")
def metric_trend(spark, d):
    t = M.metric_trend(B.metrics(spark, d), {"cpu_usage": 55.0, "memory_usage": 60.0}, tie="reading_id")
    return t.select("component", "name", "reading_id", num("mean_value").alias("mean_value"))


@query("slow_runs", f"WITH {B.RUNS} SELECT run_id, duration, 'medium' AS severity FROM runs WHERE duration > 30")
def slow_runs(spark, d):
    return M.slow_runs(B.runs(spark, d)).select("run_id", "duration", "severity")


@query("quality_gate", "WITH s AS (SELECT CAST(l.doc_id AS VARCHAR) AS call_id, l.quality * 0.4 + d.n_chars % 60 / 100.0 AS s FROM labels l JOIN documents d USING (doc_id)) "
       "SELECT call_id, 'feedback' AS outcome, NULL AS severity FROM s WHERE s < 0.7 UNION ALL SELECT call_id, 'alert', 'medium' FROM s WHERE s < 0.5")
def quality_gate(spark, d):
    score = (F.col("quality") * 4000 + (F.col("n_chars") % 60) * 100) / 10000
    scored = B.read(spark, d, "labels").join(B.read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(
        F.col("doc_id").cast("string").alias("call_id"), score.alias("quality_score"))
    return M.quality_gate(scored).select("call_id", "outcome", "severity")


@query("keep_latest", f"WITH {B.INSIGHTS}, r AS (SELECT call_id, row_number() OVER (ORDER BY ts DESC, call_id DESC) AS rk, count(*) OVER () AS n FROM insights) SELECT call_id FROM r WHERE n <= 1000 OR rk <= 500")
def keep_latest(spark, d):
    return M.keep_latest(B.insights(spark, d)).select("call_id")


@query("keep_recent", f"WITH {B.METRICS} SELECT CAST(reading_id AS BIGINT) AS reading_id FROM metrics WHERE ts > {NOW} - INTERVAL 24 HOUR")
def keep_recent(spark, d):
    return M.keep_recent(B.metrics(spark, d), B.as_of(), 24).select("reading_id")


@query("drop_old_resolved_alerts", A + f" SELECT alert_id FROM alerts WHERE NOT resolved OR ts > {NOW} - INTERVAL 48 HOUR")
def drop_old_resolved_alerts(spark, d):
    return M.keep_recent(B.alerts(spark, d), B.as_of(), 48, only=F.col("resolved")).select("alert_id")


@query("run_stats", f"WITH {B.RUNS} SELECT component, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS successful, CAST(count(*) FILTER (status <> 'success') AS BIGINT) AS failed, CAST(count(*) AS BIGINT) AS total, "
       "round(avg(duration) FILTER (status = 'success'), 6) AS average_duration, epoch_us(max(ts)) AS last_run FROM runs GROUP BY 1")
def run_stats(spark, d):
    s = M.run_stats(B.runs(spark, d), ["component"])
    return s.select("component", "successful", "failed", "total", num("average_duration").alias("average_duration"), F.unix_micros("last_run").alias("last_run"))


@query("batch_status_counts", f"WITH {B.RUNS} SELECT CAST(count(*) AS BIGINT) AS total_calls, CAST(count(*) FILTER (status = 'success') AS BIGINT) AS successful, CAST(count(*) FILTER (status <> 'success') AS BIGINT) AS failed FROM runs")
def batch_status_counts(spark, d):
    return M.batch_status_counts(B.runs(spark, d))


_LATEST = f"WITH {B.BEATS}, l AS (SELECT component, arg_max(status, ts) AS status, max(ts) AS last_seen FROM beats GROUP BY 1)"


@query("active_components", _LATEST + " SELECT CAST(count(*) FILTER (status IN ('idle', 'running', 'busy')) AS BIGINT) AS active_components, CAST(count(*) AS BIGINT) AS components FROM l")
def active_components(spark, d):
    return M.active_components(B.beats(spark, d))


@query("stale_components", _LATEST + f" SELECT component, epoch_us(last_seen) AS last_seen, 'high' AS severity FROM l WHERE {NOW} - last_seen > INTERVAL 12 HOUR")
def stale_components(spark, d):
    s = M.stale_components(B.beats(spark, d), B.as_of(), 12 * 3600)
    return s.select("component", F.unix_micros("last_seen").alias("last_seen"), "severity")


@query("stalled_runs", f"WITH {B.RUNS} SELECT run_id FROM runs WHERE status = 'success' AND event_id % 7 <> 0 AND {NOW} - ts > INTERVAL 1 HOUR")
def stalled_runs(spark, d):
    runs = B.runs(spark, d)
    ends = runs.where(F.col("run_id").cast("bigint") % 7 == 0)
    return M.stalled_runs(runs.where("status = 'success'"), ends, B.as_of()).select("run_id")


@query("period_report", f"WITH {B.ALERTS}, {B.BEATS} SELECT 864000.0::DOUBLE AS uptime_seconds, CAST(count(*) AS BIGINT) AS alerts_raised, CAST(count(*) FILTER (NOT resolved) AS BIGINT) AS active_alerts, "
       f"CAST((SELECT count(DISTINCT component) FROM beats WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20') AS BIGINT) AS components_monitored FROM alerts WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def period_report(spark, d):
    return M.period_report(B.alerts(spark, d), B.beats(spark, d), F.to_timestamp(F.lit("2024-01-10")), F.to_timestamp(F.lit("2024-01-20")))


def _sources(spark, d):
    beats = B.read(spark, d, "events").groupBy((F.col("user_id") % 40).alias("s")).agg(F.max(F.col("ts").cast("timestamp")).alias("last"))
    s = F.col("s")
    return beats.select(F.concat(F.lit("source_"), s).alias("source_id"), F.concat(F.lit("Source "), s).alias("name"),
                        (s % 9 != 0).alias("enabled"), (F.lit(60) * (s + 1)).alias("polling_interval"),
                        F.when(s % 8 != 0, F.col("last")).alias("last_check"))


def _source_errors(spark, d):
    return B.read(spark, d, "events").where("event_type = 'error'").select(
        F.concat(F.lit("source_"), F.col("user_id") % 40).alias("source_id"), F.col("ts").cast("timestamp").alias("ts"))


_HEALTH = (f"WITH s AS (SELECT user_id % 40 AS s, max(ts) AS last, count(*) FILTER (event_type = 'error' AND ts > {NOW} - INTERVAL 24 HOUR) AS e FROM events GROUP BY 1), "
           f"h AS (SELECT 'source_' || CAST(s AS VARCHAR) AS source_id, CASE WHEN s % 9 = 0 THEN 'disabled' WHEN s % 8 = 0 THEN 'not_checked' WHEN epoch_us({NOW}) - epoch_us(last) > 2000000 * 60 * (s + 1) THEN 'stale' "
           "WHEN e > 1 THEN 'error' ELSE 'healthy' END AS status FROM s)")


@query("source_health", _HEALTH + " SELECT * FROM h")
def source_health(spark, d):
    return M.source_health(_sources(spark, d), _source_errors(spark, d), B.as_of(), max_errors=1).select("source_id", "status")


@query("overall_source_health", _HEALTH + " SELECT CAST(count(*) FILTER (status IN ('stale', 'error')) AS BIGINT) AS issues, CASE WHEN count(*) FILTER (status IN ('stale', 'error')) = 0 THEN 'healthy' "
       "WHEN count(*) FILTER (status IN ('stale', 'error')) < 3 THEN 'degraded' ELSE 'unhealthy' END AS overall_status FROM h")
def overall_source_health(spark, d):
    return M.overall_source_health(M.source_health(_sources(spark, d), _source_errors(spark, d), B.as_of(), max_errors=1))


_ISSUES = (f"WITH {B.METRICS}, {B.ALERTS.replace('ev AS', 'ev AS')}, {B.BEATS}, lm AS (SELECT name, arg_max(value, ts) AS v FROM metrics GROUP BY 1), l AS (SELECT component, arg_max(status, ts) AS status, max(ts) AS last_seen FROM beats GROUP BY 1), "
           "i AS (SELECT CASE name WHEN 'cpu_usage' THEN 'High CPU usage' WHEN 'memory_usage' THEN 'High memory usage' ELSE 'High disk usage' END AS issue FROM lm "
           "WHERE (name = 'cpu_usage' AND v > 70) OR (name = 'memory_usage' AND v > 80) OR (name = 'disk_usage' AND v > 85) "
           f"UNION ALL SELECT 'Agent ' || component || CASE WHEN {NOW} - last_seen > INTERVAL 6 HOUR THEN ' is not responding' ELSE ' is in error state' END FROM l WHERE {NOW} - last_seen > INTERVAL 6 HOUR OR status = 'error' "
           "UNION ALL SELECT CAST(count(*) AS VARCHAR) || ' critical alerts active' FROM alerts WHERE severity = 'critical' AND NOT resolved HAVING count(*) > 0)")


def _issues(spark, d):
    return M.health_issues(B.metrics(spark, d), B.beats(spark, d), B.alerts(spark, d), B.as_of(), stale_minutes=360)


@query("health_report", _ISSUES + " SELECT issue, CASE WHEN contains(lower(issue), 'high cpu') THEN 'cpu' WHEN contains(lower(issue), 'high memory') THEN 'memory' WHEN contains(lower(issue), 'high disk') THEN 'disk' "
       "WHEN contains(lower(issue), 'not responding') THEN 'restart' WHEN contains(lower(issue), 'critical alert') THEN 'alerts' ELSE 'none' END AS advice FROM i")
def health_report(spark, d):
    r = F.coalesce("recommendation", F.lit(""))
    advice = (F.when(r.contains("CPU-intensive"), "cpu").when(r.contains("memory leaks"), "memory").when(r.contains("old files"), "disk")
              .when(r.contains("restart"), "restart").when(r.contains("critical alerts"), "alerts").otherwise("none"))
    return _issues(spark, d).select("issue", advice.alias("advice"))


@query("overall_health", _ISSUES + " SELECT 'system' AS rule, CASE WHEN count(*) = 0 THEN 'healthy' WHEN bool_or(contains(lower(issue), 'critical')) THEN 'critical' ELSE 'degraded' END AS overall_status FROM i "
       "UNION ALL SELECT 'manager', CASE WHEN count(*) = 0 THEN 'healthy' WHEN count(*) >= 3 THEN 'critical' ELSE 'degraded' END FROM i "
       "UNION ALL SELECT 'engines', CASE WHEN count(*) = 0 THEN 'healthy' WHEN count(*) < 3 THEN 'degraded' ELSE 'unhealthy' END FROM i")
def overall_health(spark, d):
    issues = _issues(spark, d)
    parts = [M.overall_health(issues, r).select(F.lit(r).alias("rule"), "overall_status") for r in ("system", "manager", "engines")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("backlog_issues", f"WITH {B.RUNS} SELECT 'Agent ' || component || ' has large queue: ' || CAST(count(*) AS VARCHAR) AS issue FROM runs GROUP BY component HAVING count(*) > 800")
def backlog_issues(spark, d):
    queues = B.runs(spark, d).groupBy("component").agg(F.count("*").alias("backlog"))
    return M.backlog_issues(queues, 800)


def _the_share(text):
    """An engine that fails on texts without its word."""
    return len(text) / text.count("the ")


_FAILED = (f"WITH {B.CALLS}, f AS (SELECT call_id, transcript, CAST(call_id AS BIGINT) % 48 AS age FROM calls WHERE NOT contains(transcript, 'the ')) ")


@query("quarantine", _FAILED + "SELECT call_id, 'share: ZeroDivisionError: division by zero' AS error, "
       "CASE WHEN length(transcript) > 200 THEN left(transcript, 200) || '...' ELSE transcript END AS transcript FROM f WHERE age < 24")
def quarantine(spark, d):
    """Calls on which an engine really failed, stored with excerpt and error for a day; older ones are over."""
    path = scratch_path(spark, "dead-letters")
    share = {"share": engines.Engine(_the_share, "double")}
    analysed = insights.analyse_calls(B.calls(spark, d), engines=["sentiment"], lexicon=B.SENTIMENT, terms=B.TERMS, guarded=share)
    _, failed = engines.failed_calls(analysed)
    at = B.as_of() - F.make_interval(hours=(F.col("call_id").cast("bigint") % 48).cast("int"))
    sinks.append_dead_letters(sinks.quarantine_rows(failed, engines.error_text(), at), path)
    sinks.expire_dead_letters(spark, path, B.as_of())
    return sinks.dead_letters(spark, path, B.as_of()).select("call_id", "error", "transcript")


@query("engine_failures", f"WITH {B.CALLS} SELECT call_id, 0.0::DOUBLE AS nothing, "
       f"round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment, CASE WHEN contains(transcript, 'the ') THEN round(length(transcript)::DOUBLE / ((length(transcript) - length(replace(transcript, 'the ', ''))) / 4), 6) END AS share, "
       "CASE WHEN contains(transcript, 'the ') THEN '' ELSE 'share: ZeroDivisionError: division by zero' END AS errors FROM calls")
def engine_failures(spark, d):
    """A call that breaks one engine keeps what the others found."""
    own = {"share": engines.Engine(_the_share, "double"), "nothing": engines.Engine(lambda _: 0.0, "double")}
    out = insights.analyse_calls(B.calls(spark, d), lexicon=B.SENTIMENT, terms=B.TERMS, topics=B.TOPICS, guarded=own)
    return out.select("call_id", "nothing", num("sentiment_score").alias("sentiment"), num("share").alias("share"), engines.error_text().alias("errors"))


@query("latest_results", f"WITH {B.INSIGHTS} SELECT call_id, primary_intent FROM insights ORDER BY ts DESC, call_id DESC LIMIT 100")
def latest_results(spark, d):
    return sinks.latest_results(B.insights(spark, d)).select("call_id", "primary_intent")
