import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from switchboard.operators import daily as D
from switchboard.operators import forecast as FC
from switchboard.operators import topics as TO
from tests.conftest import rows


def history(spark, days=60, per_day=3):
    items = [(f"{d}-{i}", dt.datetime(2024, 1, 1, 9 + i) + dt.timedelta(days=d), ((d * 7 + i * 3) % 11 - 5) / 5, d % 5 + 1, 100.0 + d % 7 * 10, 0.8)
             for d in range(days) for i in range(per_day + d % 3)]
    return spark.createDataFrame(items, "call_id string, ts timestamp, sentiment_score double, urgency_level int, revenue_opportunity double, confidence_score double")


def test_rollup_and_windows(spark):
    daily = D.daily_rollup(history(spark))
    first = daily.orderBy("day").first()
    assert (first["call_volume"], first["hour_first"], first["dow_first"], first["is_weekend_first"], first["is_business_hours_first"]) == (3, 9, 0, 0, 1)
    rolled = D.rolling_features(daily).orderBy("day").collect()
    assert rolled[5]["call_volume_avg_7d"] is None and rolled[6]["call_volume_avg_7d"] == pytest.approx(sum(3 + d % 3 for d in range(7)) / 7)
    short = D.rolling_features(daily.where("day < '2024-01-08'")).collect()
    assert all(r["call_volume_avg_7d"] is None for r in short)


def test_days_with_one_call_are_dropped(spark):
    one = history(spark, 1, 1)
    assert D.daily_rollup(one).first()["sentiment_std"] is None
    assert D.drop_incomplete(D.daily_rollup(one)).count() == 0


def forecast_table(spark, volumes, sentiment=0.6, revenue=3000.0):
    return spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i), v, sentiment, revenue) for i, v in enumerate(volumes)],
                                 "date date, call_volume int, sentiment double, revenue double")


def test_advice(spark):
    out = {r["kind"]: r["recommendation"] for r in D.forecast_recommendations(forecast_table(spark, [10, 10, 30, 2])).collect()}
    assert set(out) == {"high_volume", "low_volume", "good_sentiment", "revenue"}
    assert "Expected 30 calls on 2024-01-03" in out["high_volume"] and "(+131% above average)" in out["high_volume"]
    assert "1 days" in out["low_volume"] and "$12,000" in out["revenue"] and "0.60" in out["good_sentiment"]
    legacy = {r["kind"]: r["recommendation"] for r in D.forecast_recommendations(forecast_table(spark, [10] * 6 + [2], -0.3, 1.0), "legacy").collect()}
    assert set(legacy) == {"low_volume", "bad_sentiment"} and "on 2024-01-07." in legacy["low_volume"]
    assert D.forecast_recommendations(forecast_table(spark, [], 0.0)).count() == 0
    assert rows(D.peak_day(forecast_table(spark, [10, 30, 30, 2])), "call_volume", F.col("date").cast("string")) == [(30, "2024-01-02")]


def test_prediction_errors(spark):
    p = spark.createDataFrame([("v", "2024-01-01", 10.0), ("v", "2024-01-02", 20.0)], "prediction_type string, d string, predicted_value double") \
        .withColumn("prediction_date", F.to_date("d")).withColumn("actual_value", F.lit(None).cast("double"))
    a = p.select("prediction_type", "prediction_date", F.when(F.col("predicted_value") == 10, 12.0).otherwise(18.0).alias("value"))
    assert D.score_predictions(p, a).first()["mae"] == 2.0
    assert rows(D.backfill_actuals(p, a), "actual_value") == [(12.0,), (18.0,)]


def test_forecasters(spark, tmp_path):
    h = history(spark)
    models = FC.train_forecasters(h, trees=10, depth=4)
    assert set(models.models) == {"call_volume", "sentiment", "revenue"} and len(models.features) == 9
    out = FC.forecast(models, h, F.lit("2024-02-29").cast("date"), 7).orderBy("date").collect()
    assert [str(r["date"]) for r in out][::6] == ["2024-03-01", "2024-03-07"]
    assert all(r["call_volume"] >= 0 and -1 <= r["sentiment"] <= 1 and r["revenue"] >= 0 for r in out)
    models.save(spark, str(tmp_path / "m"))
    again = FC.Forecasters.load(spark, str(tmp_path / "m"))
    assert rows(FC.forecast(again, h, F.lit("2024-02-29").cast("date"), 3)) == [tuple(r) for r in out[:3]]
    assert FC.train_forecasters(h.limit(20)) is None
    with pytest.raises(ValueError):
        FC.forecast(models, h, F.lit("2024-02-29").cast("date"), 31)


def test_anomalies(spark):
    days = [(f"d{i:03d}", math.sin(i), float(i % 7)) for i in range(200)] + [("odd", 50.0, -90.0)]
    df = spark.createDataFrame(days, "day string, a double, b double")
    out = FC.anomalous_days(df, ["a", "b"], trees=40)
    assert out.orderBy(F.desc("anomaly_score")).first()["day"] == "odd"
    assert 0 < D.outlier_ratio(out).first()["outlier_ratio"] <= 0.1
    again = FC.anomalous_days(df.repartition(7), ["a", "b"], trees=40)
    assert rows(out, "day", "anomaly_score") == rows(again, "day", "anomaly_score")
    assert rows(FC.robust_outliers(df, "a").where("is_outlier"), "day") == [("odd",)]


def test_topics(spark, tmp_path):
    texts = ["apple pear plum apple grape cherry melon"] * 12 + ["hammer nail saw drill hammer wrench screw"] * 12
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "call_id string, transcript string")
    tokens = TO.tokenise(df)
    model = TO.train_topics(tokens, 2, 10)
    shares = TO.document_topics(model, tokens)
    groups = {r["call_id"]: r["dominant_topic_id"] for r in shares.collect()}
    assert len({groups[str(i)] for i in range(12)}) == 1 and groups["0"] != groups["12"]
    assert TO.top_terms(model, 3).count() == 6
    assert all(r["npmi"] is not None for r in TO.topic_coherence(tokens, TO.top_terms(model, 3)).collect())
    TO.save_topics(model, str(tmp_path / "t"))
    assert rows(TO.top_terms(TO.load_topics(str(tmp_path / "t")), 3)) == rows(TO.top_terms(model, 3))
    assert TO.train_topics(tokens.limit(2)) is None


def test_key_phrases_with_hot_tokens(spark):
    texts = [f"common word{i} word{i} other{i % 5}" for i in range(40)]
    df = spark.createDataFrame([(str(i), t.replace(str(i), "abcdefghij"[i % 10] * (i // 10 + 3))) for i, t in enumerate(texts)],
                               "call_id string, transcript string")
    tokens = TO.tokenise(df, stop_words=[])
    listed = {r["call_id"]: r["tokens"] for r in tokens.collect()}
    seen: dict[str, int] = {}
    for ts in listed.values():
        for t in set(ts):
            seen[t] = seen.get(t, 0) + 1
    want = {(c, t): ts.count(t) * math.log(41 / (seen[t] + 1)) for c, ts in listed.items() for t in set(ts)}
    for hot in (3, 1000):
        TO.HOT_TOKENS, before = hot, TO.HOT_TOKENS
        try:
            got = {(r["call_id"], r["token"]): r["score"] for r in TO.key_phrases(tokens).collect()}
        finally:
            TO.HOT_TOKENS = before
        assert got == pytest.approx(want)


def test_topics_of_more_terms_than_a_matrix_holds(spark, tmp_path, monkeypatch):
    fruit, tools = "apple pear plum grape cherry melon quince".split(), "hammer nail saw drill wrench screw chisel".split()
    rng = random.Random(8)
    texts = [" ".join(rng.choices(ws, k=12)) for ws in (fruit, tools) for _ in range(40)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("empty", "unknownword"), ("null", None)], "call_id string, transcript string")
    tokens = TO.tokenise(df)
    monkeypatch.setattr(TO, "MOST_TERMS", 5)
    model = TO.train_topics(tokens, 2, 20)
    assert len(model.terms) == 5 and {*model.terms, *(r["term"] for r in model.rest.collect())} == {*fruit, *tools}
    shares = {r["call_id"]: r for r in TO.document_topics(model, tokens).collect()}
    assert len(shares) == 82 and list(shares["empty"]["topic_distribution"]) == list(shares["null"]["topic_distribution"]) == [0, 0]
    assert all(sum(shares[str(i)]["topic_distribution"]) == pytest.approx(1) for i in range(80))
    top = {}
    for r in TO.top_terms(model, 14).collect():
        top.setdefault(r["topic"], {})[r["term"]] = r["weight"]
    assert all(sum(x.values()) == pytest.approx(1) for x in top.values()) and len(top[0]) == len(top[1]) == 14
    groups = [[shares[str(i)]["dominant_topic_id"] for i in part] for part in (range(40), range(40, 80))]
    assert max(g.count(0) for g in groups) >= 36 and min(g.count(0) for g in groups) <= 4
    TO.save_topics(model, str(tmp_path / "t"))
    again = TO.load_topics(str(tmp_path / "t"))
    assert rows(TO.top_terms(again, 3)) == rows(TO.top_terms(model, 3)) and again.terms == model.terms
    assert all(r["npmi"] is not None for r in TO.topic_coherence(tokens.where("tokens is not null"), TO.top_terms(model, 3)).collect())


def test_a_batch_reads_the_weights_of_its_own_terms(spark, monkeypatch):
    from switchboard.operators import topic_table

    rng, common = random.Random(3), "apple pear plum grape cherry".split()
    rare = [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    texts = [rng.choices(common, k=8) + rng.sample(rare, 3) for _ in range(80)]
    tokens = TO.tokenise(spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "call_id string, transcript string"))
    read, written, learned = [], [], []

    def with_rare(counted, pairs, rest, f=topic_table._with_rare):
        read.append(tuple({r["term"] for r in x.select("term").collect()} for x in (pairs, rest)))
        return f(counted, pairs, rest)

    monkeypatch.setattr(TO, "MOST_TERMS", 5)
    monkeypatch.setattr(topic_table, "_with_rare", with_rare)
    monkeypatch.setattr(topic_table, "_learned", lambda *a, f=topic_table._learned: (learned.append(f(*a)), learned[-1])[1])
    stored = TO.materialise(tokens.select("tokens"), "stored")
    monkeypatch.setattr(TO, "materialise", lambda df, label, f=TO.materialise: (written.append(label), f(df, label))[1])
    model = TO.train_topics(tokens, 2, 8, max_share=1.0, stored=stored)
    rest = {r["term"]: r["weights"] for r in model.rest.collect()}
    assert len(read) == 8 and all(batch == weights for batch, weights in read) and min(len(batch) for batch, _ in read) < len(rest)
    assert set(rest) | set(model.terms) == {t for t in {*common, *rare} if sum(t in x for x in texts) > 1}
    assert list(model.totals) == pytest.approx([model.matrix[:, j].sum() + sum(w[j] for w in rest.values()) for j in range(2)], rel=1e-5)
    assert list(learned[-1].totals) == pytest.approx(list(model.totals), rel=1e-6)  # carried from batch to batch
    weights = {**rest, **dict(zip(model.terms, model.matrix.tolist(), strict=True))}
    for n in (3, 40):
        want = [(j, i, t) for j in range(2) for i, t in enumerate(sorted(weights, key=lambda t: (-weights[t][j], t))[:n])]  # noqa: B023
        assert sorted((r["topic"], r["rank"], r["term"]) for r in TO.top_terms(model, n).collect()) == want
    assert "topic-documents" not in written  # the texts of a stored table aren't written again


def test_topic_tables_are_saved_without_arrow(spark, tmp_path):
    import numpy as np

    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        rest = spark.createDataFrame([("c", [1.5, 2.5])], "term string, weights array<float>")
        TO.save_topics(TO.TopicTable(["a", "b"], np.array([[1.0, 2.0], [3.0, 4.0]]), rest, np.array([0.5, 0.5])), str(tmp_path / "t"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    again = TO.load_topics(str(tmp_path / "t"))
    assert again.terms == ["a", "b"] and again.matrix.tolist() == [[1, 2], [3, 4]] and rows(again.rest) == [("c", [1.5, 2.5])]


def test_coherence_tests_words_in_a_loop(spark):
    rng, words = random.Random(5), [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(90)]
    docs = [rng.sample(words, rng.randint(0, 40)) * rng.randint(1, 2) for _ in range(60)] + [None, []]
    chosen = {0: words[:8], 1: words[4:12], 2: words[20:83], 3: ["nowhere", "never"]}
    tokens = spark.createDataFrame([(t,) for t in docs], "tokens array<string>")
    terms = spark.createDataFrame([(t, i, w) for t, ws in chosen.items() for i, w in enumerate(ws)], "topic int, rank int, term string")
    found = TO.topic_coherence(tokens, terms)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_contains") == 1  # one for each word is a method too long for the compiler
    have, want = [set(t or ()) for t in docs], {}
    for topic, ws in chosen.items():
        scores = []
        for i, a in enumerate(ws):
            for b in ws[i + 1:]:
                n_a, n_b, n_ab = (sum(all(w in h for w in x) for h in have) for x in ((a,), (b,), (a, b)))
                if n_a and n_b:
                    scores.append(math.log(n_ab * len(docs) / (n_a * n_b)) / -math.log(n_ab / len(docs)) if n_ab else -1)
        if scores:
            want[topic] = sum(scores) / len(scores)
    assert {r["topic"]: r["npmi"] for r in found.collect()} == pytest.approx(want) and set(want) == {0, 1, 2}
    with pytest.raises(ValueError):
        TO.topic_coherence(tokens, spark.createDataFrame([(0, i, w) for i, w in enumerate(words[:64])], "topic int, rank int, term string"))


def test_key_phrases_count_tokens_where_their_call_is(spark, monkeypatch):
    df = spark.createDataFrame([("a", "pear plum pear"), ("a", "plum pear fig"), ("b", "fig kiwi"), ("c", None), (None, "kiwi kiwi")], "call_id string, transcript string")
    written = []
    monkeypatch.setattr(TO, "materialise", lambda df, label, f=TO.materialise: (written.append(df), f(df, label))[1])
    got = {(r["call_id"], r["token"]): r["score"] for r in TO.key_phrases(TO.tokenise(df, stop_words=[])).collect()}
    idf = lambda n: math.log(6 / (n + 1))
    assert got == pytest.approx({("a", "pear"): 3 * idf(1), ("a", "plum"): 2 * idf(1), ("a", "fig"): idf(2), ("b", "fig"): idf(2), ("b", "kiwi"): idf(2), (None, "kiwi"): 2 * idf(2)})
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange")  # printed from the top


def test_saved_anomaly_models_score_alike(spark, tmp_path):
    rng = random.Random(4)
    df = spark.createDataFrame([(f"d{k}", rng.random(), rng.random()) for k in range(80)] + [("odd", 9.0, -9.0)], "day string, a double, b double")
    path = str(tmp_path / "model")
    with pytest.raises(FileNotFoundError):
        FC.load_anomaly_model(spark, path)
    first = FC.train_anomaly_model(df, ["a", "b"], trees=20)
    second = FC.train_anomaly_model(df, ["b"], trees=5, seed=7)
    assert (first.save(path), second.save(path)) == (1, 2)
    shown = lambda m: rows(m.score(df), "day", "anomaly_score", "is_anomaly")
    assert shown(FC.load_anomaly_model(spark, path, 1)) == shown(first) == rows(FC.anomalous_days(df, ["a", "b"], trees=20), "day", "anomaly_score", "is_anomaly")
    assert shown(FC.load_anomaly_model(spark, path)) == shown(second)
    unseen = spark.createDataFrame([("new", 50.0, 50.0)], "day string, a double, b double")
    assert FC.load_anomaly_model(spark, path, 1).score(unseen).first()["is_anomaly"]
    with pytest.raises(FileNotFoundError):
        FC.load_anomaly_model(spark, path, 3)
