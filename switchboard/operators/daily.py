"""Daily series: rollups, rolling features, totals and forecast advice.

The rollup is the only step that sees raw calls.  Everything after it works on
one row per day (and series), so a window over a whole series is a few thousand
rows; ``partition_by`` keeps many series apart.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T

ROLLED = {"call_volume": "call_volume_avg", "sentiment_mean": "sentiment_avg",
          "revenue_sum": "revenue_avg"}


def daily_rollup(insights: DataFrame, profile: str = "default",
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """Per calendar day: sentiment, volume, urgency, revenue, confidence and the first call's calendar flags."""
    day = F.to_date("ts").alias("day")
    if profile == "legacy":
        return insights.groupBy(*partition_by, day).agg(
            F.count("call_id").alias("call_volume"), F.avg("urgency_level").alias("urgency_mean"),
            F.avg("sentiment_score").alias("sentiment_mean"),
            F.sum("revenue_opportunity").alias("revenue_sum"))
    flags = T.calendar_features(F.col("first_ts"))
    rolled = insights.groupBy(*partition_by, day).agg(
        F.avg("sentiment_score").alias("sentiment_mean"),
        F.stddev_samp("sentiment_score").alias("sentiment_std"),
        F.count("sentiment_score").alias("call_volume"),
        F.avg("urgency_level").alias("urgency_mean"),
        F.sum("revenue_opportunity").alias("revenue_sum"),
        F.avg("confidence_score").alias("confidence_mean"),
        F.min("ts").alias("first_ts"))
    return rolled.select(
        *partition_by, "day", "sentiment_mean", "sentiment_std", "call_volume", "urgency_mean",
        "revenue_sum", "confidence_mean", flags["hour"].alias("hour_first"),
        flags["day_of_week"].alias("dow_first"), flags["month"].alias("month_first"),
        flags["is_weekend"].alias("is_weekend_first"),
        flags["is_business_hours"].alias("is_business_hours_first"))


def rolling_features(daily: DataFrame, windows: Sequence[int] = R.FEATURE_WINDOWS,
                     columns: Mapping[str, str] = ROLLED, partition_by: Sequence[str] = (),
                     profile: str = "default") -> DataFrame:
    """Trailing means over whole windows of rows; null until a window is full.

    A window is only filled if the series has more days than the window is
    long.  The legacy profile leaves revenue out and fills gaps forwards, then
    backwards.
    """
    if profile == "legacy":
        columns = {k: v for k, v in columns.items() if k != "revenue_sum"}
    series = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy()
    ordered = series.orderBy("day")
    whole = series.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = daily.withColumn("_days", F.count("*").over(whole))
    added = {}
    for n in windows:
        frame = ordered.rowsBetween(-(n - 1), 0)
        for source, name in columns.items():
            full = (F.count(source).over(frame) == n) & (F.col("_days") > n)
            added[f"{name}_{n}d"] = F.when(full, F.avg(source).over(frame))
    out = out.withColumns(added)
    if profile == "legacy":
        past = ordered.rowsBetween(Window.unboundedPreceding, 0)
        future = ordered.rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(past),
                                             F.first(c, ignorenulls=True).over(future)) for c in added})
    return out.drop("_days")


def usable_windows(daily_count: int, windows: Sequence[int] = R.FEATURE_WINDOWS) -> list[int]:
    """Windows shorter than the series."""
    return [n for n in windows if daily_count > n]


def drop_incomplete(daily: DataFrame) -> DataFrame:
    """Days without any null; a day with one call has no sample deviation and goes too."""
    return daily.na.drop()


def recent_means(insights: DataFrame, last: int = 30) -> DataFrame:
    """Mean sentiment and revenue of the newest calls and the rough daily volume."""
    newest = insights.orderBy(F.desc("ts"), F.desc("call_id")).limit(last)
    return newest.agg(F.avg("sentiment_score").alias("sentiment_avg"),
                      F.avg("revenue_opportunity").alias("revenue_avg"),
                      (F.count("*") / 7).alias("call_volume_avg"))


def weekly_totals(forecast: DataFrame) -> DataFrame:
    """Totals of a forecast period and its label."""
    return forecast.agg(
        F.sum("call_volume").alias("total_calls"), F.avg("sentiment").alias("avg_sentiment"),
        F.sum("revenue").alias("total_revenue_opportunity"),
        F.concat_ws(" to ", F.min("date").cast("string"), F.max("date").cast("string")).alias("prediction_period"))


def peak_day(forecast: DataFrame, high: float = R.FORECAST["high_volume"]) -> DataFrame:
    """The busiest day among those above ``high`` times the mean; the first one on ties."""
    mean = forecast.agg(F.avg("call_volume")).scalar()
    busy = forecast.where(F.col("call_volume") > high * mean)
    return busy.orderBy(F.desc("call_volume"), "date").limit(1).select("date", "call_volume")


def forecast_recommendations(forecast: DataFrame, profile: str | Mapping = "default") -> DataFrame:
    """Advice on a forecast, one row per recommendation.

    One pass: volumes are compared with the period's mean inside the aggregated
    list of days, which holds one entry per forecast day.
    """
    legacy = profile == "legacy"
    limits = R.LEGACY_FORECAST if legacy else R.FORECAST if profile == "default" else {**R.FORECAST, **profile}
    g = forecast.agg(
        F.sum("call_volume").cast("double").alias("calls"), F.count("*").alias("days"),
        F.avg("sentiment").alias("sentiment"), F.sum("revenue").alias("revenue"),
        F.sort_array(F.collect_list(F.struct(
            F.col("date").cast("string").alias("date"),
            F.col("call_volume").cast("double").alias("volume")))).alias("by_day"))
    g = g.withColumn("mean", F.col("calls") / (F.lit(7) if legacy else F.col("days")))
    high = F.filter("by_day", lambda d: d["volume"] > limits["high_volume"] * F.col("mean"))
    low = F.filter("by_day", lambda d: d["volume"] < limits["low_volume"] * F.col("mean"))
    g = g.withColumns({"high": high, "low": low})
    peak_volume = F.array_max(F.transform("high", lambda d: d["volume"]))
    g = g.withColumn("peak", F.get(F.filter("high", lambda d: d["volume"] == peak_volume), F.lit(0)))
    above = F.format_string("%.0f", (F.col("peak.volume") / F.col("mean") - 1) * 100)
    volume = F.format_string("%.0f", F.col("peak.volume"))
    busy, quiet = (F.col("calls") > 0) & (F.size("high") > 0), (F.col("calls") > 0) & (F.size("low") > 0)
    score = F.format_string("%.2f", F.col("sentiment"))
    revenue = F.format_string("%,.0f", F.col("revenue"))

    def dates(c: str) -> Column:
        return F.array_join(F.transform(c, lambda d: d["date"]), ", ")

    if legacy:
        items = [
            ("high_volume", busy, F.concat(
                F.lit("HIGH CALL VOLUME ALERT: Schedule extra reception staff on "), dates("high"),
                F.lit(". Expected "), volume, F.lit(" calls on peak day (+"), above, F.lit("% above average)."))),
            ("low_volume", quiet, F.concat(
                F.lit("MARKETING OPPORTUNITY: Lower call volume predicted on "), dates("low"),
                F.lit(". Consider launching promotional campaigns to drive appointment bookings."))),
            ("bad_sentiment", F.col("sentiment") < limits["bad_sentiment"], F.concat(
                F.lit("QUALITY ALERT: Below-average customer satisfaction predicted (score: "), score,
                F.lit("). Review staff training materials and consider customer service refresher sessions."))),
            ("revenue", F.col("revenue") > limits["revenue"], F.concat(
                F.lit("REVENUE OPPORTUNITY: $"), revenue,
                F.lit(" in potential revenue identified. Focus on conversion training and follow-up "
                      "procedures to maximize bookings."))),
        ]
    else:
        items = [
            ("high_volume", busy, F.concat(
                F.lit("📈 HIGH VOLUME ALERT: Expected "), volume, F.lit(" calls on "), F.col("peak.date"),
                F.lit(". Schedule additional reception staff (+"), above, F.lit("% above average)."))),
            ("low_volume", quiet, F.concat(
                F.lit("📊 MARKETING OPPORTUNITY: "), F.size("low").cast("string"),
                F.lit(" days with lower call volume predicted. Consider promotional campaigns or outreach activities."))),
            ("bad_sentiment", F.col("sentiment") < limits["bad_sentiment"], F.concat(
                F.lit("😕 QUALITY CONCERN: Below-average customer satisfaction predicted (score: "), score,
                F.lit("). Review staff training and customer service procedures."))),
            ("good_sentiment", F.col("sentiment") > limits["good_sentiment"], F.concat(
                F.lit("😊 EXCELLENT OUTLOOK: High customer satisfaction predicted (score: "), score,
                F.lit("). Great opportunity to gather testimonials and referrals."))),
            ("revenue", F.col("revenue") > limits["revenue"], F.concat(
                F.lit("💰 REVENUE OPPORTUNITY: $"), revenue,
                F.lit(" in potential revenue identified. Focus on conversion optimization and follow-up procedures."))),
        ]
    rows = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(kind).alias("kind"), text.alias("recommendation"))) for kind, test, text in items])
    return g.select(F.inline(F.array_compact(rows)))


def score_predictions(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Error per prediction type against later actuals (type, date, value)."""
    known = actuals.select("prediction_type", "prediction_date", F.col("value").alias("actual_value"))
    joined = predictions.drop("actual_value").join(known, ["prediction_type", "prediction_date"])
    error = F.col("predicted_value") - F.col("actual_value")
    return joined.groupBy("prediction_type").agg(F.avg(F.abs(error)).alias("mae"),
                                                 F.count("*").alias("matched"))


def backfill_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Predictions with ``actual_value`` filled where it has become known."""
    known = actuals.select("prediction_type", "prediction_date", F.col("value").alias("_actual"))
    joined = predictions.join(known, ["prediction_type", "prediction_date"], "left")
    return joined.withColumn("actual_value", F.coalesce("_actual", "actual_value")).drop("_actual")


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """MAE and R2 from sums alone: one pass, partially aggregated."""
    e = F.col(predicted) - F.col(actual)
    return df.agg(F.avg(F.abs(e)).alias("mae"),
                  (1 - F.sum(e * e) / F.nullif(F.var_pop(actual) * F.count(actual), F.lit(0.0))).alias("r2"),
                  F.count("*").alias("n"))


def forecast_confidence(models: DataFrame) -> DataFrame:
    """clip((r2 + min(n / 1000, 1)) / 2, 0.1, 0.9) per model."""
    size = F.least(F.col("training_samples") / 1000, F.lit(1.0))
    return models.withColumn("confidence", F.greatest(F.lit(0.1), F.least(F.lit(0.9), (F.col("r2") + size) / 2)))


def outlier_ratio(flagged: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    return flagged.agg(F.avg(F.col(flag).cast("int")).alias("outlier_ratio"), F.count("*").alias("days"))
