"""Queries that train and apply models; most have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard.operators import daily as D
from switchboard.operators import forecast as FC
from switchboard.operators import topics as TO
from switchboard.plans import tables as B
from switchboard.plans.registry import ORACLES, big, num, query
from switchboard.session import materialise, scratch_path


def _forecasters(spark, d):
    return FC.train_forecasters(B.orders_as_insights(spark, d))


@query("train_forecasters")
def train_forecasters(spark, d):
    return _forecasters(spark, d).report(spark).select("name", num("mae").alias("mae"), num("r2").alias("r2"), "training_samples")


@query("forecast")
def forecast(spark, d):
    insights = B.orders_as_insights(spark, d)
    last = insights.agg(F.to_date(F.max("ts"))).scalar()
    return FC.forecast(_forecasters(spark, d), insights, last, 7)


@query("model_report")
def model_report(spark, d):
    """Models saved, loaded again and reported."""
    path = scratch_path(spark, "forecasters")
    _forecasters(spark, d).save(spark, path)
    report = FC.Forecasters.load(spark, path).report(spark)
    return D.forecast_confidence(report).select("name", "training_samples", "features_count", "confidence")


_FEATURES = ["sentiment_mean", "call_volume", "urgency_mean", "revenue_sum", "confidence_mean"]


def _flagged(spark, d):
    return FC.anomalous_days(D.daily_rollup(B.orders_as_insights(spark, d)), _FEATURES)


@query("anomalous_days")
def anomalous_days(spark, d):
    return _flagged(spark, d).select(F.col("day").cast("string").alias("day"), num("anomaly_score").alias("anomaly_score"), "is_anomaly")


@query("saved_anomaly_model", ORACLES["drop_incomplete"].replace(", CAST(call_volume AS BIGINT) AS call_volume", ", TRUE AS same_score, TRUE AS same_flag").replace(" WHERE sentiment_std IS NOT NULL", ""))
def saved_anomaly_model(spark, d):
    """Isolation trees saved as a versioned table: every day's score after loading is that of before."""
    path, days = scratch_path(spark, "anomaly-model"), D.daily_rollup(B.orders_as_insights(spark, d))
    model = FC.train_anomaly_model(days, _FEATURES)
    model.save(path)
    before = model.score(days).select("day", F.col("anomaly_score").alias("score"), F.col("is_anomaly").alias("flag"))
    after = FC.load_anomaly_model(spark, path).score(days)
    return after.join(before, "day").select(F.col("day").cast("string").alias("day"), (F.col("anomaly_score") == F.col("score")).alias("same_score"),
                                            (F.col("is_anomaly") == F.col("flag")).alias("same_flag"))


@query("outlier_ratio")
def outlier_ratio(spark, d):
    return D.outlier_ratio(_flagged(spark, d))


@query("robust_outliers", f"WITH {B.ORDERS}, d AS (SELECT CAST(ts AS DATE) AS day, sum(revenue_opportunity) AS r FROM insights GROUP BY 1), m AS (SELECT median(r) AS m FROM d), "
       "a AS (SELECT median(abs(r - m)) AS a FROM d, m) SELECT CAST(day AS VARCHAR) AS day, round(0.6745 * (r - m) / a, 5) AS robust_z, CAST(abs(0.6745 * (r - m) / a) > 2.5 AS INT) AS is_outlier FROM d, m, a")
def robust_outliers(spark, d):
    r = FC.robust_outliers(D.daily_rollup(B.orders_as_insights(spark, d)), "revenue_sum", 2.5)
    return r.select(F.col("day").cast("string").alias("day"), num("robust_z", 5).alias("robust_z"), F.col("is_outlier").cast("int").alias("is_outlier"))


def _tokenised(spark, d):
    return TO.tokenise(B.calls(spark, d)).select("call_id", "tokens")


def _topic_model(spark, d):
    return TO.train_topics(_tokenised(spark, d))


@query("train_topics")
def train_topics(spark, d):
    model = _topic_model(spark, d)
    return TO.topic_labels(model, B.TOPICS).select("topic", F.array_join("terms", ",").alias("terms"), "label")


@query("top_terms")
def top_terms(spark, d):
    return TO.top_terms(_topic_model(spark, d), 5)


@query("document_topics")
def document_topics(spark, d):
    tokens = _tokenised(spark, d)
    return TO.document_topics(_topic_model(spark, d), tokens).select("call_id", "dominant_topic_id", num("dominant_topic_probability").alias("probability"))


@query("topic_coherence")
def topic_coherence(spark, d):
    tokens = _tokenised(spark, d)
    stored = materialise(tokens.select("tokens"), "topic-tokens")  # texts are tokenised once, for the model and for the masks
    return TO.topic_coherence(stored, TO.top_terms(TO.train_topics(tokens, stored=stored), 8))


@query("topic_coherence_of_fixed_terms", f"WITH {B.CALLS}, t AS (SELECT call_id, list_distinct(list_filter(string_split_regex(low, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '[\\p{{N}}_]'))) AS k FROM calls), "
       "w AS (SELECT * FROM (VALUES (0, 0, 'the'), (0, 1, 'and'), (0, 2, 'with'), (1, 0, 'der'), (1, 1, 'und'), (1, 2, 'die')) v(topic, i, term)), "
       "p AS (SELECT a.topic, a.term AS x, b.term AS y FROM w a JOIN w b ON a.topic = b.topic AND a.i < b.i), "
       "c AS (SELECT topic, count(*)::DOUBLE AS n, count(*) FILTER (list_contains(k, x))::DOUBLE AS nx, count(*) FILTER (list_contains(k, y))::DOUBLE AS ny, "
       "count(*) FILTER (list_contains(k, x) AND list_contains(k, y))::DOUBLE AS nxy FROM p, t GROUP BY topic, x, y) "
       "SELECT CAST(topic AS BIGINT) AS topic, round(avg(CASE WHEN nxy = 0 THEN -1 WHEN nxy = n THEN 1 ELSE ln(nxy * n / (nx * ny)) / -ln(nxy / n) END), 6) AS npmi FROM c WHERE nx > 0 AND ny > 0 GROUP BY 1")
def topic_coherence_of_fixed_terms(spark, d):
    terms = spark.createDataFrame([(t, i, w) for t, ws in ((0, ("the", "and", "with")), (1, ("der", "und", "die"))) for i, w in enumerate(ws)],
                                  "topic int, rank int, term string")
    c = TO.topic_coherence(TO.tokenise(B.calls(spark, d), stop_words=[]), terms)
    return c.select(big("topic").alias("topic"), num("npmi").alias("npmi"))


@query("per_call_topics")
def per_call_topics(spark, d):
    """One model for all calls, then predefined and model topics combined per call."""
    from switchboard.functions import topics as TP

    tokens = TO.tokenise(B.calls(spark, d), stop_words=[])
    predefined = TO.call_topics(B.calls(spark, d), topics=B.TOPICS, stop_words=[])
    shares = TO.document_topics(_topic_model(spark, d), tokens.select("call_id", "tokens"))
    both = predefined.join(shares.select("call_id", "dominant_topic_id", "dominant_topic_probability"), "call_id")
    return both.select("call_id", TP.dominant_topic(F.col("predefined_topic"), F.col("predefined_score"), F.lit(0.4),
                                                    F.col("dominant_topic_id")).alias("dominant_topic"))


@query("save_and_load_topics")
def save_and_load_topics(spark, d):
    path = scratch_path(spark, "topic-model")
    TO.save_topics(_topic_model(spark, d), path)
    return TO.top_terms(TO.load_topics(path), 3)


@query("intent_model")
def intent_model(spark, d):
    """A classifier trained on four fifths of the labelled documents, held against the rest."""
    labelled = TO.tokenise(B.calls(spark, d)).join(
        B.read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("call_id"), F.col("quality").cast("double").alias("quality")), "call_id")
    labelled = labelled.select("call_id", "tokens", "quality")
    held_out = F.pmod(F.xxhash64("call_id"), F.lit(5)) == 0
    model = TO.train_intent_model(labelled.where(~held_out), "quality")
    predicted = TO.predict_intent(model, labelled.where(held_out))
    return predicted.groupBy("quality", "prediction").agg(F.count("*").alias("calls"))
