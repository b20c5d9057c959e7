"""Queries over daily series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard.operators import daily as D
from switchboard.plans import tables as B
from switchboard.plans.registry import big, num, query
from switchboard.sources import sinks

_DAILY = ("daily AS (SELECT CAST(ts AS DATE) AS day, avg(sentiment_score) AS sentiment_mean, stddev_samp(sentiment_score) AS sentiment_std, count(*) AS call_volume, "
          "avg(urgency_level) AS urgency_mean, sum(revenue_opportunity) AS revenue_sum, avg(confidence_score) AS confidence_mean, min(ts) AS f FROM insights GROUP BY 1)")
_EV = f"WITH {B.INSIGHTS}, {_DAILY}"
_OR = f"WITH {B.ORDERS}, {_DAILY}"


def _day():
    return F.col("day").cast("string").alias("day")


@query("daily_rollup", _EV + " SELECT CAST(day AS VARCHAR) AS day, round(sentiment_mean, 6) AS sentiment_mean, round(sentiment_std, 6) AS sentiment_std, CAST(call_volume AS BIGINT) AS call_volume, "
       "round(urgency_mean, 6) AS urgency_mean, round(revenue_sum, 2) AS revenue_sum, round(confidence_mean, 6) AS confidence_mean, CAST(hour(f) AS BIGINT) AS hour_first, CAST(isodow(f) - 1 AS BIGINT) AS dow_first, "
       "CAST(month(f) AS BIGINT) AS month_first, CAST(isodow(f) >= 6 AS BIGINT) AS is_weekend_first, CAST(hour(f) BETWEEN 8 AND 17 AS BIGINT) AS is_business_hours_first FROM daily")
def daily_rollup(spark, d):
    r = D.daily_rollup(B.insights(spark, d))
    return r.select(_day(), *[num(c).alias(c) for c in ("sentiment_mean", "sentiment_std", "urgency_mean", "confidence_mean")],
                    num("revenue_sum", 2).alias("revenue_sum"), *[big(c).alias(c) for c in r.columns if c.endswith("_first") or c == "call_volume"])


@query("daily_rollup_legacy", _EV + " SELECT CAST(day AS VARCHAR) AS day, CAST(call_volume AS BIGINT) AS call_volume, round(urgency_mean, 6) AS urgency_mean, round(sentiment_mean, 6) AS sentiment_mean, round(revenue_sum, 2) AS revenue_sum FROM daily")
def daily_rollup_legacy(spark, d):
    r = D.daily_rollup(B.insights(spark, d), "legacy")
    return r.select(_day(), "call_volume", num("urgency_mean").alias("urgency_mean"), num("sentiment_mean").alias("sentiment_mean"), num("revenue_sum", 2).alias("revenue_sum"))


@query("daily_rollup_by_staff", f"WITH {B.INSIGHTS} SELECT staff_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(count(*) AS BIGINT) AS call_volume, round(avg(sentiment_score), 6) AS sentiment_mean FROM insights GROUP BY 1, 2")
def daily_rollup_by_staff(spark, d):
    r = D.daily_rollup(B.insights(spark, d), partition_by=["staff_id"])
    return r.select("staff_id", _day(), "call_volume", num("sentiment_mean").alias("sentiment_mean"))


def _win(c, n):
    return f"CASE WHEN count(*) OVER w{n} = {n} THEN avg({c}) OVER w{n} END"


def _places(name):
    return 3 if name.startswith("revenue") else 8


_COLS = [(c, f"{a}_{n}d", n) for n in (7, 14, 30) for c, a in D.ROLLED.items()]
_WINDOWS = " WINDOW " + ", ".join(f"w{n} AS (ORDER BY day ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 30))


@query("rolling_features", _OR + " SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(f"round({_win(c, n)}, {_places(a)}) AS {a}" for c, a, n in _COLS) + " FROM daily" + _WINDOWS)
def rolling_features(spark, d):
    r = D.rolling_features(D.daily_rollup(B.orders_as_insights(spark, d)))
    return r.select(_day(), *[num(a, _places(a)).alias(a) for _, a, _ in _COLS])


@query("rolling_features_short_series", _EV + " SELECT CAST(day AS VARCHAR) AS day, round(" + _win("call_volume", 7) + ", 4) AS call_volume_avg_7d, CAST(NULL AS DOUBLE) AS call_volume_avg_30d FROM daily" + _WINDOWS)
def rolling_features_short_series(spark, d):
    """Thirty days do not fill a thirty-day window."""
    r = D.rolling_features(D.daily_rollup(B.insights(spark, d)))
    return r.select(_day(), num("call_volume_avg_7d", 4).alias("call_volume_avg_7d"), "call_volume_avg_30d")


_LCOLS = [(c, a, n) for c, a, n in _COLS if c != "revenue_sum"]


@query("rolling_features_legacy", _OR + ", r AS (SELECT day, " + ", ".join(f"{_win(c, n)} AS {a}" for c, a, n in _LCOLS) + " FROM daily" + _WINDOWS
       + ") SELECT CAST(day AS VARCHAR) AS day, " + ", ".join(
    f"round(coalesce(last_value({a} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    f"first_value({a} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), {_places(a)}) AS {a}" for _, a, _ in _LCOLS) + " FROM r")
def rolling_features_legacy(spark, d):
    r = D.rolling_features(D.daily_rollup(B.orders_as_insights(spark, d), "legacy"), profile="legacy")
    return r.select(_day(), *[num(a, _places(a)).alias(a) for _, a, _ in _LCOLS])


@query("drop_incomplete", _OR + " SELECT CAST(day AS VARCHAR) AS day, CAST(call_volume AS BIGINT) AS call_volume FROM daily WHERE sentiment_std IS NOT NULL")
def drop_incomplete(spark, d):
    return D.drop_incomplete(D.daily_rollup(B.orders_as_insights(spark, d))).select(_day(), "call_volume")


@query("recent_means", f"WITH {B.INSIGHTS}, r AS (SELECT * FROM insights ORDER BY ts DESC, call_id DESC LIMIT 30) SELECT round(avg(sentiment_score), 6) AS sentiment_avg, round(avg(revenue_opportunity), 6) AS revenue_avg, round(count(*) / 7.0, 6)::DOUBLE AS call_volume_avg FROM r")
def recent_means(spark, d):
    r = D.recent_means(B.insights(spark, d))
    return r.select(*[num(c).alias(c) for c in r.columns])


def as_forecast(spark, d):
    """The daily rollup in the shape of a forecast."""
    return D.daily_rollup(B.insights(spark, d)).select(
        F.col("day").alias("date"), (F.col("call_volume") * (F.dayofmonth("day") % 4 + 1)).alias("call_volume"),
        F.col("sentiment_mean").alias("sentiment"), F.col("revenue_sum").alias("revenue"))


_FC = _EV + ", fc AS (SELECT day AS date, call_volume * (day(day) % 4 + 1) AS call_volume, sentiment_mean AS sentiment, revenue_sum AS revenue FROM daily)"


@query("weekly_totals", _FC + " SELECT CAST(sum(call_volume) AS BIGINT) AS total_calls, round(avg(sentiment), 6) AS avg_sentiment, round(sum(revenue), 2) AS total_revenue_opportunity, "
       "CAST(min(date) AS VARCHAR) || ' to ' || CAST(max(date) AS VARCHAR) AS prediction_period FROM fc")
def weekly_totals(spark, d):
    w = D.weekly_totals(as_forecast(spark, d))
    return w.select(big("total_calls").alias("total_calls"), num("avg_sentiment").alias("avg_sentiment"),
                    num("total_revenue_opportunity", 2).alias("total_revenue_opportunity"), "prediction_period")


@query("peak_day", _FC + " SELECT CAST(date AS VARCHAR) AS date, CAST(call_volume AS BIGINT) AS call_volume FROM fc WHERE call_volume > 1.3 * (SELECT avg(call_volume) FROM fc) ORDER BY call_volume DESC, date LIMIT 1")
def peak_day(spark, d):
    return D.peak_day(as_forecast(spark, d)).select(F.col("date").cast("string").alias("date"), big("call_volume").alias("call_volume"))


_MEAN = "(SELECT avg(call_volume) FROM fc)"
_PEAK = f"(SELECT date FROM fc WHERE call_volume > 1.3 * {_MEAN} ORDER BY call_volume DESC, date LIMIT 1)"
_REV = "format('{:,.0f}', (SELECT sum(revenue) FROM fc))"


@query("forecast_recommendations", _FC + f", r AS (SELECT 'high_volume' AS kind, '📈 HIGH VOLUME ALERT: Expected ' || format('{{:.0f}}', max(call_volume)::DOUBLE) || ' calls on ' || CAST({_PEAK} AS VARCHAR) || "
       f"'. Schedule additional reception staff (+' || format('{{:.0f}}', (max(call_volume) / {_MEAN} - 1) * 100) || '% above average).' AS recommendation FROM fc HAVING max(call_volume) > 1.3 * {_MEAN} "
       f"UNION ALL SELECT 'low_volume', '📊 MARKETING OPPORTUNITY: ' || CAST(count(*) FILTER (call_volume < 0.7 * {_MEAN}) AS VARCHAR) || ' days with lower call volume predicted. Consider promotional campaigns or outreach activities.' FROM fc "
       f"UNION ALL SELECT 'bad_sentiment', '😕 QUALITY CONCERN: Below-average customer satisfaction predicted (score: ' || format('{{:.2f}}', avg(sentiment)) || '). Review staff training and customer service procedures.' FROM fc HAVING avg(sentiment) < -0.1 "
       f"UNION ALL SELECT 'revenue', '💰 REVENUE OPPORTUNITY: $' || {_REV} || ' in potential revenue identified. Focus on conversion optimization and follow-up procedures.') SELECT * FROM r")
def forecast_recommendations(spark, d):
    return D.forecast_recommendations(as_forecast(spark, d))


@query("forecast_recommendations_legacy", _FC + f", m AS (SELECT sum(call_volume) / 7.0 AS m FROM fc), r AS ("
       "SELECT 'low_volume' AS kind, 'MARKETING OPPORTUNITY: Lower call volume predicted on ' || string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) || '. Consider launching promotional campaigns to drive appointment bookings.' AS recommendation "
       "FROM fc, m WHERE call_volume < 0.7 * m HAVING count(*) > 0 "
       "UNION ALL SELECT 'bad_sentiment', 'QUALITY ALERT: Below-average customer satisfaction predicted (score: ' || format('{:.2f}', avg(sentiment)) || '). Review staff training materials and consider customer service refresher sessions.' FROM fc HAVING avg(sentiment) < -0.2 "
       f"UNION ALL SELECT 'revenue', 'REVENUE OPPORTUNITY: $' || {_REV} || ' in potential revenue identified. Focus on conversion training and follow-up procedures to maximize bookings.') SELECT * FROM r")
def forecast_recommendations_legacy(spark, d):
    return D.forecast_recommendations(as_forecast(spark, d), "legacy")


def predictions(spark, d):
    """Each day's forecast is the value of the day before, by type."""
    rows = sinks.prediction_rows(as_forecast(spark, d), {"call_volume": 0.8})
    return rows.withColumn("prediction_date", F.date_add("prediction_date", 1))


def actuals(spark, d):
    return sinks.prediction_rows(as_forecast(spark, d), {}).select("prediction_type", "prediction_date", F.col("predicted_value").alias("value"))


_LONG = (", v AS (SELECT 'call_volume' AS prediction_type, date, call_volume::DOUBLE AS value FROM fc UNION ALL SELECT 'sentiment', date, sentiment FROM fc UNION ALL SELECT 'revenue', date, revenue FROM fc)")


@query("score_predictions", _FC + _LONG + " SELECT p.prediction_type, round(avg(abs(p.value - a.value)), 4) AS mae, CAST(count(*) AS BIGINT) AS matched FROM v p JOIN v a ON p.prediction_type = a.prediction_type AND a.date = p.date + 1 GROUP BY 1")
def score_predictions(spark, d):
    return D.score_predictions(predictions(spark, d), actuals(spark, d)).select("prediction_type", num("mae", 4).alias("mae"), "matched")


@query("backfill_actuals", _FC + _LONG + " SELECT p.prediction_type, CAST(p.date + 1 AS VARCHAR) AS prediction_date, round(p.value, 4) AS predicted_value, round(a.value, 4) AS actual_value FROM v p LEFT JOIN v a ON p.prediction_type = a.prediction_type AND a.date = p.date + 1")
def backfill_actuals(spark, d):
    b = D.backfill_actuals(predictions(spark, d), actuals(spark, d))
    return b.select("prediction_type", F.col("prediction_date").cast("string").alias("prediction_date"), num("predicted_value", 4).alias("predicted_value"),
                    num("actual_value", 4).alias("actual_value"))


@query("regression_metrics", "SELECT round(avg(abs(o_totalprice - p)), 4) AS mae, round(1 - sum((o_totalprice - p) ^ 2) / (var_pop(o_totalprice) * count(*)), 6) AS r2, CAST(count(*) AS BIGINT) AS n FROM (SELECT o_totalprice, o_totalprice * 0.9 + o_custkey % 100 AS p FROM orders)")
def regression_metrics(spark, d):
    o = B.read(spark, d, "orders").select("o_totalprice", (F.col("o_totalprice") * 0.9 + F.col("o_custkey") % 100).alias("p"))
    return D.regression_metrics(o, "o_totalprice", "p").select(num("mae", 4).alias("mae"), num("r2").alias("r2"), "n")


@query("forecast_confidence", "SELECT o_orderstatus AS name, round(greatest(0.1, least(0.9, (avg(o_custkey % 100) / 100 + least(count(*) / 1000.0, 1.0)) / 2)), 6) AS confidence FROM orders GROUP BY 1")
def forecast_confidence(spark, d):
    models = B.read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("name")).agg(
        (F.avg(F.col("o_custkey") % 100) / 100).alias("r2"), F.count("*").alias("training_samples"))
    return D.forecast_confidence(models).select("name", num("confidence").alias("confidence"))
