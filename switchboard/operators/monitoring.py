"""Alerts, metrics, heartbeats and run logs: thresholds, suppression, health."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.operators import ordered as O

ACTIVE = ["idle", "running", "busy"]


# --- alerts ------------------------------------------------------------------------------

def filter_alerts(alerts: DataFrame, severity: str | None = None, resolved: bool = False) -> DataFrame:
    """Optionally one severity; resolved alerts only when asked for."""
    out = alerts if severity is None else alerts.where(F.col("severity") == severity)
    return out if resolved else out.where(~F.col("resolved"))


def acknowledge(alerts: DataFrame, acknowledged: DataFrame) -> DataFrame:
    """Sets the flag of the alerts listed by ``alert_id``."""
    marked = acknowledged.select("alert_id", F.lit(True).alias("_ack")).distinct()
    return alerts.join(marked, "alert_id", "left").withColumn(
        "acknowledged", F.coalesce(F.col("_ack"), F.col("acknowledged"))).drop("_ack")


def keep_greedily(times: np.ndarray, resolved: np.ndarray, last: int | None, window: int) -> tuple[np.ndarray, int | None]:
    """Marks the times at least ``window`` after the last kept, unresolved one."""
    keep = np.zeros(len(times), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(times, last + window, "left"))
    while i < len(times):
        keep[i] = True
        if resolved[i]:
            i += 1
            continue
        last = int(times[i])
        i = int(np.searchsorted(times, last + window, "left"))
    return keep, last


#: time slots of the window's length in a block
BLOCK_SLOTS = 64
#: a time before all others
NEVER = -(1 << 62)


def last_of_chain(times: np.ndarray, window: int) -> np.ndarray:
    """For each alert, the last one that is kept if it is kept itself.

    Every alert points to the next one at least ``window`` later; pointers are doubled until they leave the array.
    """
    m = len(times)
    after = np.append(np.searchsorted(times, times + window, "left"), m)
    end = np.arange(m)
    while (inside := after[:m] < m).any():
        end[inside] = end[after[:m][inside]]
        after = after[after]
    return end


def passage(times: np.ndarray, first: int, last: int, window: int) -> tuple[list[int], list[int]]:
    """What an alert kept before a block does to the block, as a step function (bounds, exits).

    ``times`` are those of the block's unresolved alerts in order; ``first`` and ``last`` are where its first and last slots begin.  If the
    last alert before the block was kept at a, and ``bounds[i]`` is the first bound that isn't below a, the last slot's kept alert
    comes at ``exits[i]``, ``NEVER`` if it has none; the last exit is for later a, the first one for none.
    """
    inside = int(np.searchsorted(times, first + window, "left"))
    exits = np.append(times[last_of_chain(times, window)], NEVER)[:inside + 1]
    exits = np.where(exits >= last, exits, NEVER)
    new = np.flatnonzero(exits[1:] != exits[:-1])
    return (times[new] - window).tolist(), exits[np.append(new, inside)].tolist()


def suppress_repeats(alerts: DataFrame, seconds: int = 3600,
                     keys: Sequence[str] = ("component", "message"), block_slots: int = BLOCK_SLOTS) -> DataFrame:
    """Drops an alert that follows a kept equal one within ``seconds``.

    Whether an alert is kept depends on the last kept one.  Time is cut into slots of ``seconds``, of which each has at most
    one kept alert, and a key into blocks of ``block_slots`` slots.  What an alert before a block does to it is a step
    function with few steps (``passage``), since chains that start at different alerts soon meet.  A first pass over the blocks gives
    one small row for each, these rows are followed through a key, and a second pass walks every block from the alert
    before it.  A key that raises alerts for ever is as many tasks as it has blocks.
    """
    keys = list(keys)
    window = seconds * 1_000_000
    span = window * block_slots
    cut = alerts.withColumns({"_us": F.unix_micros("ts"), "_block": F.floor(F.unix_micros("ts") / span)})
    unit = [*keys, "_block"]
    types = dict(cut.dtypes)
    kinds = ", ".join(f"`{c}` {types[c]}" for c in unit)

    def passages(group: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(group["_us"].to_numpy()[~group["resolved"].to_numpy(dtype=bool)])
        block = int(group["_block"].iloc[0])
        bounds, exits = passage(times, block * span, (block + 1) * span - window, window)
        return group[unit].iloc[:1].assign(_bounds=[bounds], _exits=[exits])

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        group, entries = group.sort_values("_block"), []
        last, previous = NEVER, None
        for block, bounds, exits in zip(group["_block"], group["_bounds"], group["_exits"], strict=True):
            if previous is None or block != previous + 1:  # an alert doesn't reach beyond the next slot
                last = NEVER
            entries.append(last)
            last, previous = int(exits[int(np.searchsorted(np.asarray(bounds, np.int64), last, "left")) if last != NEVER else 0]), block
        return group[unit].assign(_entry=entries)

    steps = cut.select(*unit, "_us", "resolved").groupBy(*unit).applyInPandas(passages, f"{kinds}, _bounds array<long>, _exits array<long>")
    entries = steps.groupBy(*keys).applyInPandas(follow, f"{kinds}, _entry long")  # a row for each block
    known = entries.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(unit)], "_entry")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(unit)])
    rows = cut.join(known, same).drop(*[f"_k{i}" for i in range(len(unit))])
    laid = rows.repartition(*unit).sortWithinPartitions(*unit, "ts", "alert_id")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for b in batches:
            if not len(b):
                continue
            new = np.ones(len(b), dtype=bool)
            new[1:] = ~np.logical_and.reduce([(v[1:] == v[:-1]) | (pd.isna(v[1:]) & pd.isna(v[:-1])) for v in (b[c].to_numpy() for c in unit)])
            edges = [*np.flatnonzero(new), len(b)]
            times, resolved, entry = b["_us"].to_numpy(), b["resolved"].to_numpy(dtype=bool), b["_entry"].to_numpy()
            keep = np.zeros(len(b), dtype=bool)
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                name = tuple(None if pd.isna(v) else v for v in (b[c].iloc[s] for c in unit))
                if name != current:
                    current, last = name, None if entry[s] == NEVER else int(entry[s])
                keep[s:e], last = keep_greedily(times[s:e], resolved[s:e], last, window)
            yield b[keep]

    return laid.mapInPandas(walk, laid.schema).drop("_block", "_us", "_entry")


def metric_thresholds(metrics: DataFrame, thresholds: Mapping[str, tuple] = R.THRESHOLDS) -> DataFrame:
    """Readings above their threshold with the severity; a projection, also for streams."""
    limit, severity = None, None
    for name, (value, level) in thresholds.items():
        test = F.col("name") == name
        limit = F.when(test, F.lit(value)) if limit is None else limit.when(test, F.lit(value))
        severity = F.when(test, F.lit(level)) if severity is None else severity.when(test, F.lit(level))
    return (metrics.where(F.col("name").isin(list(thresholds)) & (F.col("value") > limit))
            .withColumns({"severity": severity, "threshold": limit}))


def metric_trend(metrics: DataFrame, thresholds: Mapping[str, float] = R.TREND_THRESHOLDS, last: int = 10,
                 keys: Sequence[str] = ("component", "name"), tie: str | None = None,
                 block_seconds: int = 3600) -> DataFrame:
    """Readings whose mean with the ``last - 1`` readings before exceeds the threshold."""
    keys = list(keys)
    limit = None
    for name, value in thresholds.items():
        test = F.col("name") == name
        limit = F.when(test, F.lit(value)) if limit is None else limit.when(test, F.lit(value))
    order = ["ts"] if tie is None else ["ts", tie]
    watched = metrics.where(F.col("name").isin(list(thresholds))).select(*dict.fromkeys([*keys, "name", *order, "value"]))
    rows = O.with_halo(O.cut_time(watched, "ts", block_seconds), keys, order, last - 1, ["value"])
    frame = O.window(keys, order).rowsBetween(-(last - 1), 0)
    rows = rows.withColumns({"_n": F.count("value").over(frame), "mean_value": F.avg("value").over(frame)})
    hit = rows.where(~F.col(O.HALO) & (F.col("_n") == last) & (F.col("mean_value") > limit))
    return hit.select(*keys, *order, "mean_value", F.lit("medium").alias("severity"))


def slow_runs(runs: DataFrame, limit: float = 30.0) -> DataFrame:
    return runs.where(F.col("duration") > limit).withColumn("severity", F.lit("medium"))


def quality_gate(scored: DataFrame, score: str = "quality_score", feedback: float = 0.7,
                 alert: float = 0.5) -> DataFrame:
    """A feedback row below ``feedback`` and an alert row below ``alert``."""
    outcome = F.when(F.col(score) < alert, F.array(F.lit("feedback"), F.lit("alert"))) \
        .when(F.col(score) < feedback, F.array(F.lit("feedback")))
    out = scored.where(F.col(score) < max(feedback, alert)).withColumn("outcome", F.explode(outcome))
    return out.withColumn("severity", F.when(F.col("outcome") == "alert", F.lit("medium")))


# --- retention -----------------------------------------------------------------------------

def keep_latest(df: DataFrame, ts: str = "ts", tie: str = "call_id", limit: int = 1000, keep: int = 500) -> DataFrame:
    """All rows up to ``limit`` of them, else the newest ``keep`` (a retention rule)."""
    n = df.agg(F.count("*")).scalar()
    newest = df.orderBy(F.desc(ts), F.desc(tie)).limit(keep)
    return newest.where(n > limit).unionByName(df.where(n <= limit))


def keep_recent(df: DataFrame, as_of: Column, hours: int, ts: str = "ts", only: Column | None = None) -> DataFrame:
    """Rows younger than ``hours``; ``only`` restricts the rule to some rows."""
    young = F.col(ts) > as_of - F.expr(f"interval {hours} hours")
    return df.where(young if only is None else young | ~only)


# --- runs and components ----------------------------------------------------------------------

def run_stats(runs: DataFrame, keys: Sequence[str] = (), success: Sequence[str] = ("success", "completed")) -> DataFrame:
    good = F.col("status").isin(list(success))
    return runs.groupBy(*keys).agg(
        F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"), F.count("*").alias("total"),
        F.avg(F.when(good, F.col("duration"))).alias("average_duration"), F.max("ts").alias("last_run"))


def batch_status_counts(results: DataFrame, success: Sequence[str] = ("success",)) -> DataFrame:
    good = F.col("status").isin(list(success))
    return results.agg(F.count("*").alias("total_calls"), F.count_if(good).alias("successful"),
                       F.count_if(~good).alias("failed"))


def latest_status(beats: DataFrame) -> DataFrame:
    """Newest status and time per component."""
    return beats.groupBy("component").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("last_seen"))


def active_components(beats: DataFrame) -> DataFrame:
    latest = latest_status(beats)
    return latest.agg(F.count_if(F.col("status").isin(ACTIVE)).alias("active_components"),
                      F.count("*").alias("components"))


def stale_components(beats: DataFrame, as_of: Column, seconds: int = 120) -> DataFrame:
    """Components silent for more than ``seconds`` as a high alert each."""
    latest = latest_status(beats)
    silent = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 1_000_000
    return (latest.withColumn("silent_seconds", silent).where(F.col("silent_seconds") > seconds)
            .select("component", "last_seen", "silent_seconds", F.lit("high").alias("severity")))


def stalled_runs(starts: DataFrame, ends: DataFrame, as_of: Column, seconds: int = 3600) -> DataFrame:
    """Runs started, not ended, and older than the limit."""
    open_runs = starts.join(ends.select("run_id").distinct(), "run_id", "left_anti")
    age = (F.unix_micros(as_of) - F.unix_micros("ts")) / 1_000_000
    return open_runs.withColumn("runtime_seconds", age).where(F.col("runtime_seconds") > seconds)


def period_report(alerts: DataFrame, beats: DataFrame, start: Column, end: Column) -> DataFrame:
    """Elapsed seconds, alerts raised and still open, components seen in a period."""
    raised = alerts.where(F.col("ts").between(start, end)).agg(
        F.count("*").alias("alerts_raised"), F.count_if(~F.col("resolved")).alias("active_alerts"))
    seen = beats.where(F.col("ts").between(start, end)).agg(F.count_distinct("component")).scalar()
    return raised.select(
        ((F.unix_micros(end) - F.unix_micros(start)) / 1_000_000).alias("uptime_seconds"),
        "alerts_raised", "active_alerts", seen.alias("components_monitored"))


def source_health(sources: DataFrame, errors: DataFrame, as_of: Column, max_errors: int = 5,
                  error_hours: int = 24) -> DataFrame:
    """State of every call source: disabled, not_checked, stale, error or healthy."""
    recent = keep_recent(errors, as_of, error_hours).groupBy("source_id").agg(F.count("*").alias("n_errors"))
    joined = sources.join(recent, "source_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    age = (F.unix_micros(as_of) - F.unix_micros("last_check")) / 1_000_000
    return joined.withColumn("status", F.when(~F.col("enabled"), "disabled")
                             .when(F.col("last_check").isNull(), "not_checked")
                             .when(age > F.col("polling_interval") * 2, "stale")
                             .when(F.col("n_errors") > max_errors, "error").otherwise("healthy"))


def overall_source_health(health: DataFrame) -> DataFrame:
    return health.agg(F.count_if(F.col("status").isin("stale", "error")).alias("issues")).select(
        "issues", F.when(F.col("issues") == 0, "healthy").when(F.col("issues") < 3, "degraded")
        .otherwise("unhealthy").alias("overall_status"))


# --- health report ------------------------------------------------------------------------------

def metric_bands(metrics: DataFrame, bands: Mapping[str, tuple] = R.HEALTH_BANDS) -> DataFrame:
    """Newest reading per watched metric and its band."""
    latest = metrics.where(F.col("name").isin(list(bands))).groupBy("name").agg(F.max_by("value", "ts").alias("value"))
    band, issue = None, None
    for name, (warn, critical, text) in bands.items():
        here = F.col("name") == name
        level = F.when(F.col("value") > critical, "critical").when(F.col("value") > warn, "warning").otherwise("healthy")
        said = F.when(F.col("value") > warn, F.lit(text))
        band = F.when(here, level) if band is None else band.when(here, level)
        issue = F.when(here, said) if issue is None else issue.when(here, said)
    return latest.withColumns({"band": band, "issue": issue})


def health_issues(metrics: DataFrame, beats: DataFrame, alerts: DataFrame, as_of: Column,
                  stale_minutes: float = 5.0, bands: Mapping[str, tuple] = R.HEALTH_BANDS) -> DataFrame:
    """One row per issue with its recommendation."""
    from_metrics = metric_bands(metrics, bands).where("issue is not null").select("issue")
    quiet = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 60_000_000 > stale_minutes
    agent = F.concat(F.lit("Agent "), F.col("component"))
    from_beats = latest_status(beats).select(
        F.when(quiet, F.concat(agent, F.lit(" is not responding")))
        .when(F.col("status") == "error", F.concat(agent, F.lit(" is in error state"))).alias("issue")
    ).where("issue is not null")
    critical = filter_alerts(alerts, "critical").agg(F.count("*").alias("n")).where("n > 0").select(
        F.concat(F.col("n").cast("string"), F.lit(" critical alerts active")).alias("issue"))
    low = F.lower("issue")
    advice = None
    for part, text in R.HEALTH_ADVICE.items():
        test = F.contains(low, F.lit(part))
        advice = F.when(test, F.lit(text)) if advice is None else advice.when(test, F.lit(text))
    return from_metrics.unionByName(from_beats).unionByName(critical).withColumn("recommendation", advice)


def overall_health(issues: DataFrame, rule: str = "system") -> DataFrame:
    """healthy without issues, else by rule: wording (system) or number of issues."""
    g = issues.agg(F.count("*").alias("issues"),
                   F.coalesce(F.bool_or(F.contains(F.lower("issue"), F.lit("critical"))), F.lit(False)).alias("_critical"))
    status = {
        "system": F.when(F.col("_critical"), "critical").otherwise("degraded"),
        "manager": F.when(F.col("issues") >= 3, "critical").otherwise("degraded"),
        "engines": F.when(F.col("issues") < 3, "degraded").otherwise("unhealthy"),
    }[rule]
    return g.select("issues", F.when(F.col("issues") == 0, "healthy").otherwise(status).alias("overall_status"))


def backlog_issues(queues: DataFrame, limit: int = 50) -> DataFrame:
    """Components whose backlog exceeds ``limit``."""
    return queues.where(F.col("backlog") > limit).select(F.concat(
        F.lit("Agent "), F.col("component"), F.lit(" has large queue: "), F.col("backlog").cast("string")).alias("issue"))
