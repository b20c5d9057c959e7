"""Forecast models of daily volume, sentiment and revenue, and anomalous days."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.operators import daily as D
from switchboard.session import materialise
from switchboard.sources.files import Folder

TARGETS = {"call_volume": "call_volume", "sentiment": "sentiment_mean", "revenue": "revenue_sum"}
CALENDAR = {"hour": "hour_first", "day_of_week": "dow_first", "month": "month_first",
            "is_weekend": "is_weekend_first", "is_business_hours": "is_business_hours_first"}
MIN_INSIGHTS = 50
MIN_DAYS = 10


@dataclass
class Forecasters:
    """Trained models by target, their features and their held-out scores."""

    models: dict[str, PipelineModel] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    metadata: list[tuple] = field(default_factory=list)

    META = "name string, mae double, r2 double, training_samples long, features_count int, features array<string>"

    def report(self, spark: SparkSession) -> DataFrame:
        """mae, r2, samples and number of features of every model."""
        return spark.createDataFrame(self.metadata, self.META)

    def save(self, spark: SparkSession, path: str) -> None:
        for name, model in self.models.items():
            model.write().overwrite().save(f"{path}/{name}")
        self.report(spark).write.mode("overwrite").parquet(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Forecasters":
        rows = spark.read.parquet(f"{path}/metadata").collect()  # one row per model
        out = cls(metadata=[tuple(r) for r in rows], features=list(rows[0]["features"]))
        out.models = {r["name"]: PipelineModel.load(f"{path}/{r['name']}") for r in rows}
        return out


def training_days(insights: DataFrame) -> tuple[DataFrame, list[str]]:
    """Complete days with rolling features, and the names of those features."""
    rolled = D.daily_rollup(insights)
    windows = D.usable_windows(rolled.count())
    days = D.drop_incomplete(D.rolling_features(rolled, windows))
    names = [f"{c}_{w}d" for w in windows for c in D.ROLLED.values()]
    return days, names


def _held_out(share: float) -> Column:
    return F.pmod(F.xxhash64("day"), F.lit(1000)) < int(share * 1000)


def train_forecasters(insights: DataFrame, calendar: bool = False, trees: int = 100, depth: int = 10,
                      seed: int = 42, test_share: float = 0.2) -> Forecasters | None:
    """Random forests on standardised features; None without enough data.

    The split is a hash of the day, so it does not depend on partitioning.
    """
    days, features = training_days(insights)
    if calendar:
        features = features + list(CALENDAR.values())
    days = days.select("day", *TARGETS.values(), *[f for f in features if f not in TARGETS.values()])
    days = days.persist()
    try:
        size = days.agg(F.count("*").alias("n"), F.sum("call_volume").alias("calls")).first()
        if (size["calls"] or 0) < MIN_INSIGHTS or size["n"] < MIN_DAYS or not features:
            return None
        train, test = days.where(~_held_out(test_share)), days.where(_held_out(test_share))
        n_train = train.count()
        out = Forecasters(features=features)
        for name, target in TARGETS.items():
            stages = [VectorAssembler(inputCols=features, outputCol="raw_features"),
                      StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
                      RandomForestRegressor(labelCol=target, featuresCol="features", numTrees=trees,
                                            maxDepth=depth, seed=seed)]
            model = Pipeline(stages=stages).fit(train)
            score = D.regression_metrics(model.transform(test), target, "prediction").first()
            out.models[name] = model
            out.metadata.append((name, score["mae"], score["r2"], n_train, len(features), list(features)))
        return out
    finally:
        days.unpersist()


def future_days(spark: SparkSession, start: Column, days: int) -> DataFrame:
    """The ``days`` days after ``start`` with their calendar features at noon."""
    one = spark.range(1).select(F.explode(F.sequence(F.date_add(start, 1), F.date_add(start, days))).alias("date"))
    return one.select(
        "date", F.lit(12).alias("hour_first"), F.weekday("date").alias("dow_first"),
        F.month("date").alias("month_first"), (F.weekday("date") >= 5).cast("int").alias("is_weekend_first"),
        F.lit(1).alias("is_business_hours_first"))


def forecast(models: Forecasters, insights: DataFrame, start: Column, days: int = 7) -> DataFrame:
    """date, call_volume (half-even, >= 0), sentiment (clipped), revenue (>= 0)."""
    if not 1 <= days <= 30:
        raise ValueError("a forecast covers 1 to 30 days")
    spark = insights.sparkSession
    recent = D.recent_means(insights)
    means = {name: recent.select(name).scalar() for name in D.ROLLED.values()}
    frame = future_days(spark, start, days).withColumns(
        {f"{name}_{w}d": F.coalesce(mean.cast("double"), F.lit(0.0))
         for w in R.FEATURE_WINDOWS for name, mean in means.items()})
    for name, model in models.models.items():
        frame = model.transform(frame).withColumnRenamed("prediction", f"_p_{name}") \
            .drop("raw_features", "features")
    return frame.select(
        "date",
        F.greatest(F.lit(0), F.bround("_p_call_volume", 0).cast("int")).alias("call_volume"),
        F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("_p_sentiment"))).alias("sentiment"),
        F.greatest(F.lit(0.0), F.col("_p_revenue")).alias("revenue"))


# --- anomalous days --------------------------------------------------------------------

SAMPLE_ROWS = 256  # rows of an isolation tree, unless the caller asks for others
EULER = 0.5772156649015329
NODE = "tree int, node int, feature int, split double, left int, right int, size int"


def _average_path(n: float) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def _grow(tree: int, data: np.ndarray, seed: int) -> list[tuple]:
    """Random isolation splits of one sample; a leaf has feature -1."""
    rng = np.random.default_rng(seed + tree)
    limit = math.ceil(math.log2(max(len(data), 2)))
    nodes: list[list] = []
    todo = [(np.arange(len(data)), 0, None, None)]
    while todo:
        rows, depth, parent, side = todo.pop()
        me = len(nodes)
        nodes.append([tree, me, -1, 0.0, -1, -1, len(rows)])
        if parent is not None:
            nodes[parent][side] = me
        if depth >= limit or len(rows) <= 1:  # a cut at the lowest value leaves one side empty
            continue
        low, high = data[rows].min(axis=0), data[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if len(usable) == 0:
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        nodes[me][2], nodes[me][3] = f, cut
        mask = data[rows, f] < cut
        todo += [(rows[mask], depth + 1, me, 4), (rows[~mask], depth + 1, me, 5)]
    return [tuple(n) for n in nodes]


def isolation_trees(df: DataFrame, key: str, features: Sequence[str], trees: int = 100,
                    seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Trees over independent samples of at most ``sample_rows`` rows each.

    Sampling is the operator itself: every tree has its own hash order of all rows and takes
    the first of it; the rank limit is applied before the shuffle.
    """
    candidates = df.select(F.xxhash64(F.lit(seed), key).alias("_h"),
                           F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"))
    per_tree = candidates.select("_h", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    drawn = Window.partitionBy("tree").orderBy(F.xxhash64("_h", "tree"))
    samples = per_tree.withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= sample_rows)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(group.sort_values("_h")["x"].to_numpy())
        return pd.DataFrame(_grow(int(group["tree"].iloc[0]), data, seed),
                            columns=[c.split()[0] for c in NODE.split(", ")])

    return samples.select("tree", "_h", "x").groupBy("tree").applyInPandas(grow, NODE)


def anomaly_scores(df: DataFrame, trees: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds ``anomaly_score`` in (0, 1]; higher is more unusual."""
    # a model of at most trees * 511 nodes, bounded by its parameters
    nodes = trees.toPandas().sort_values(["tree", "node"])
    forest = [g[["feature", "split", "left", "right", "size"]].to_numpy(dtype=float)
              for _, g in nodes.groupby("tree")]
    sample = max(int(t[0, 4]) for t in forest)
    shared = df.sparkSession.sparkContext.broadcast(forest)
    norm = _average_path(sample) or 1.0

    @F.pandas_udf("double")
    def score(xs: pd.Series) -> pd.Series:
        data = np.stack(xs.to_numpy()) if len(xs) else np.empty((0, 1))
        total = np.zeros(len(data))
        for t in shared.value:
            at = np.zeros(len(data), dtype=int)
            depth = np.zeros(len(data))
            live = t[at, 0] >= 0
            while live.any():
                here = at[live]
                go_left = data[live, t[here, 0].astype(int)] < t[here, 1]
                at[live] = np.where(go_left, t[here, 2], t[here, 3]).astype(int)
                depth[live] += 1
                live = t[at, 0] >= 0
            leaf = {n: _average_path(n) for n in np.unique(t[:, 4])}
            total += depth + np.array([leaf[n] for n in t[at, 4]])
        return pd.Series(np.power(2.0, -total / max(len(shared.value), 1) / norm))

    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return df.withColumn("anomaly_score", score(x))


def anomalous_days(daily: DataFrame, features: Sequence[str], contamination: float = 0.1,
                   trees: int = 100, seed: int = 42, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Days with their isolation score and whether they are among the most unusual."""
    scored = anomaly_scores(daily, isolation_trees(daily, "day", features, trees, seed, sample_rows), features)
    cut = scored.agg(F.percentile_approx("anomaly_score", 1 - contamination, 10000))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut.scalar())


class AnomalyModel(NamedTuple):
    """Isolation trees with the features they were grown on and the score above which a day is unusual."""

    trees: DataFrame
    features: list[str]
    cut: float

    def score(self, daily: DataFrame) -> DataFrame:
        """Adds ``anomaly_score`` and ``is_anomaly``, also to days the trees haven't seen."""
        return anomaly_scores(daily, self.trees, self.features).withColumn("is_anomaly", F.col("anomaly_score") > self.cut)

    def save(self, path: str) -> int:
        """Writes a new version: the nodes as a table, then one small file that makes them a version; its number."""
        folder = Folder(self.trees.sparkSession, path)
        version = max(saved_versions(folder), default=0) + 1
        self.trees.coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes/version={version}")  # trees times 511 nodes at most
        if not folder.publish(f"versions/{version}", json.dumps({"features": self.features, "cut": self.cut})):
            raise RuntimeError(f"version {version} was saved by another job")
        return version


def saved_versions(folder: Folder) -> list[int]:
    return sorted(int(n) for n in folder.names("versions"))


def load_anomaly_model(spark: SparkSession, path: str, version: int | None = None) -> AnomalyModel:
    """A saved version, the latest if none is named."""
    folder = Folder(spark, path)
    known = saved_versions(folder)
    version = version if version is not None else max(known, default=0)
    if version not in known:
        raise FileNotFoundError(f"{path} has no anomaly model of version {version or 1}")
    told = json.loads(folder.read(f"versions/{version}"))
    return AnomalyModel(spark.read.schema(NODE).parquet(f"{path}/nodes/version={version}"), told["features"], told["cut"])


def train_anomaly_model(daily: DataFrame, features: Sequence[str], contamination: float = 0.1, trees: int = 100, seed: int = 42,
                        sample_rows: int = SAMPLE_ROWS) -> AnomalyModel:
    """The model behind ``anomalous_days``, to be saved; its trees are written once."""
    grown = materialise(isolation_trees(daily, "day", features, trees, seed, sample_rows), "isolation-trees")
    cut = anomaly_scores(daily, grown, features).agg(F.percentile_approx("anomaly_score", 1 - contamination, 10000)).first()[0]
    return AnomalyModel(grown, list(features), cut)


def robust_outliers(daily: DataFrame, column: str, limit: float = 3.5) -> DataFrame:
    """Robust z-score per day from the median and the median absolute deviation."""
    centred = daily.withColumn("_off", F.col(column) - daily.agg(F.median(column)).scalar())
    mad = centred.agg(F.median(F.abs("_off"))).scalar()
    z = 0.6745 * F.col("_off") / F.nullif(mad, F.lit(0.0))
    return (centred.withColumn("robust_z", z)
            .withColumn("is_outlier", F.coalesce(F.abs("robust_z") > limit, F.lit(False))).drop("_off"))
