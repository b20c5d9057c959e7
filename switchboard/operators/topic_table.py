"""Topic models with more terms than one matrix should hold: the most frequent in a matrix, all others in a table.

Learning is online variational Bayes, with the priors, rates and updates of Spark's LDA.  Every document is dealt
to one batch.  Weights of frequent terms are broadcast; those of all other terms are joined to the few places where
they occur.  What a batch adds to the weights is summed by term on the cluster.  A batch reads and writes the other terms that
occur in it only: their weights wait in the folder of the next batch that has them, and what the batches between would do to them is one factor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard.session import materialise, scratch_path
from switchboard.sources.files import Folder

BATCHES = 20
#: terms of the matrix, which is broadcast for each batch
FREQUENT = 50_000
LATE, DECAY = 1024, 0.51  # a batch weighs (LATE + its number) ** -DECAY
SLICE = 512  # documents folded at a time
CELLS = 32_768  # terms of documents of about the same length that are followed together
MOST_STEPS, CLOSE = 100, 1e-3
PRIOR, COUNT, OTHERS = -1, -2, -3  # rows beside those of the frequent terms


class TopicTable:
    """``terms`` and their ``matrix`` of weights by topic, and ``rest``, a table (term, weights) of all others."""

    def __init__(self, terms: list[str], matrix: np.ndarray, rest: DataFrame, prior: np.ndarray, rest_totals: np.ndarray | None = None) -> None:
        self.terms, self.matrix, self.rest, self.prior = terms, matrix, rest, prior
        self.rest_totals = _totals(rest, len(prior))[0] if rest_totals is None else rest_totals
        self.totals = matrix.sum(0) + self.rest_totals

    def top_terms(self, n: int) -> DataFrame:
        """(topic, rank, term, weight) of each topic's ``n`` heaviest terms."""
        spark, shares = self.rest.sparkSession, self.matrix / self.totals
        best = [(j, self.terms[i], float(shares[i, j])) for j in range(len(self.prior)) for i in np.lexsort((self.terms, -shares[:, j]))[:n]]
        divided = F.transform("weights", lambda w, j: w / F.element_at(F.array(*map(F.lit, self.totals.tolist())), j + 1))
        rare = self.rest.select("term", F.posexplode_outer(divided).alias("topic", "weight")).select("topic", "term", "weight")
        if n <= len(self.terms):  # lighter ones than the last of the frequent terms have no place
            least = F.array(*[F.lit(x[-1][-1]) for j in range(len(self.prior)) if (x := [b for b in best if b[0] == j])])
            rare = rare.where(F.col("weight") >= F.element_at(least, F.col("topic") + 1))
        both = spark.createDataFrame(best, "topic int, term string, weight double").unionByName(rare)
        place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
        return both.withColumn("rank", place).where(F.col("rank") <= n).select("topic", (F.col("rank") - 1).alias("rank"), "term", "weight")

    def shares(self, tokenised: DataFrame) -> DataFrame:
        """The rows with their ``topic_distribution``, all zeros if no term is known."""
        rows = materialise(tokenised.withColumn("_row", F.monotonically_increasing_id()), "topic-rows")
        counted = materialise(_counted(rows.select("_row", "tokens"), self.terms), "topic-counts")
        found = _with_rare(counted, _pairs(counted), self.rest).mapInArrow(_inference(_shared(self, rows.sparkSession)), "_row long, topic_distribution array<double>")
        return rows.join(found, "_row").drop("_row")

    def save(self, path: str) -> None:
        spark = self.rest.sparkSession
        Folder(spark, path).delete("")
        frequent = [(i, t, w) for i, (t, w) in enumerate(zip(self.terms, self.matrix.tolist(), strict=True))]
        rows = spark.createDataFrame(frequent, "place int, term string, weights array<double>").unionByName(self.rest.select(F.lit(None).cast("int").alias("place"), "term", F.col("weights").cast("array<double>")))
        rows.write.parquet(f"{path}/topic-terms")
        spark.createDataFrame([(self.prior.tolist(),)], "prior array<double>").write.parquet(f"{path}/topic-prior")

    @staticmethod
    def saved(spark: SparkSession, path: str) -> bool:
        return Folder(spark, path).exists("topic-terms")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TopicTable:
        rows, prior = spark.read.parquet(f"{path}/topic-terms"), np.array(spark.read.parquet(f"{path}/topic-prior").first()["prior"])
        known = rows.where("place is not null").orderBy("place").collect()  # bounded when the model was trained
        matrix = np.array([r["weights"] for r in known]).reshape(len(known), len(prior))
        return cls([r["term"] for r in known], matrix, rows.where("place is null").drop("place"), prior)


def train(usable: DataFrame, vocabulary: DataFrame, frequent: int, num_topics: int, passes: int, seed: int) -> TopicTable:
    """A model of every term of ``vocabulary`` (term, docs); ``frequent`` of them are held in the matrix."""
    spark, batches = usable.sparkSession, max(1, min(passes, BATCHES))
    terms = [r["term"] for r in vocabulary.orderBy(F.desc("docs"), "term").limit(frequent).select("term").collect()]
    known = spark.createDataFrame(pd.DataFrame({"place": np.arange(len(terms)), "term": terms}), "place int, term string")
    first = known.select("place", _start("term", num_topics, seed).alias("weights")).toPandas().sort_values("place")
    matrix = np.stack(first["weights"].to_numpy())
    rare = vocabulary.select("term").join(F.broadcast(known.select("term")), "term", "left_anti")
    rows = usable.select(F.monotonically_increasing_id().alias("_row"), "tokens")
    counts_at, pairs_at, weights_at = (scratch_path(spark, label) for label in ("topic-counts", "topic-pairs", "topic-weights"))
    batch = F.pmod(F.xxhash64("_row"), F.lit(batches)).cast("int").alias("batch")
    _counted(rows, terms).select("*", batch).write.partitionBy("batch").parquet(counts_at)
    counted = spark.read.schema("_row long, ids array<int>, ns array<int>, rare array<string>, rare_ns array<int>, batch int").parquet(counts_at)
    _pairs(counted).join(rare, "term").select("_row", "term", "n", batch).write.partitionBy("batch").parquet(pairs_at)
    pairs = spark.read.schema("_row long, term string, n int, batch int").parquet(pairs_at)
    sizes = {r["batch"]: r["count"] for r in counted.groupBy("batch").count().collect()}
    held = _Weights(spark, weights_at, num_topics, passes, batches)
    held.put(pairs.groupBy("term").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("batch"))).alias("batches"))
             .withColumn("weights", _start("term", num_topics, seed)), 0)
    rest_totals, others = _totals(held.all(), num_topics)
    model = TopicTable(terms, matrix, held.all(), np.full(num_topics, 1 / num_topics), rest_totals)
    for step in range(1, passes + 1):
        at, rate = (step - 1) % batches, (LATE + step) ** -DECAY
        held.left.append(held.left[-1] * (1 - rate if at in sizes else 1))
        if at in sizes:
            now = F.col("batch") == at
            model = _learned(model, counted.where(now), pairs.where(now), held, step, others, sum(sizes.values()) / sizes[at], rate)
    return TopicTable(terms, model.matrix, held.all(), model.prior)  # summed anew, as when it is loaded


class _Weights:
    """Weights of the terms that are not in the matrix, below a folder: by the step that wrote them and the next one that has the term.

    A step without a term only moves its weights towards ``eta``; ``left[k]`` of the way to there is left after step ``k``.
    """

    schema = "term string, weights array<float>, batches int, since int"

    def __init__(self, spark: SparkSession, path: str, topics: int, passes: int, batches: int) -> None:
        self.spark, self.path, self.eta, self.passes, self.batches = spark, path, 1 / topics, passes, batches
        self.left, self.folder = [1.0], Folder(spark, path)

    def put(self, weights: DataFrame, step: int) -> None:
        """Writes (term, batches, weights) as they are after a step; bit ``b`` of ``batches`` is set where batch ``b`` has the term."""
        after = [step + 1 + (b - step) % self.batches for b in range(self.batches)]
        coming = [F.when(F.col("batches").bitwiseAND(F.lit(1 << b)) != 0, F.lit(s)) for b, s in enumerate(after) if s <= self.passes]
        rows = weights.select("term", F.col("weights").cast("array<float>").alias("weights"), "batches", F.lit(step).alias("since"),
                              F.least(*coming, F.lit(self.passes + 1), F.lit(self.passes + 1)).alias("next"))
        rows.write.partitionBy("next").parquet(f"{self.path}/step-{step}")

    def _read(self, names: list[str], step: int) -> DataFrame:
        """The weights of some folders as they are before a step."""
        if not names:
            return self.spark.createDataFrame([], self.schema)
        left = F.element_at(F.array(*[F.lit(self.left[step - 1] / x) for x in self.left[:step]]), F.col("since") + 1)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])
        return rows.withColumn("weights", F.transform("weights", lambda w: self.eta + left * (w - self.eta)).cast("array<float>"))

    def of(self, step: int) -> tuple[list[str], DataFrame]:
        names = [n for k in range(step) if self.folder.exists(n := f"step-{k}/next={step}")]
        return names, self._read(names, step)

    def all(self) -> DataFrame:
        """(term, weights) of all terms after the last step so far."""
        steps = [f"step-{k}" for k in range(len(self.left)) if self.folder.exists(f"step-{k}")]
        names = [f"{k}/{n}" for k in steps for n in self.folder.names(k) if n.startswith("next=")]
        return self._read(names, len(self.left)).select("term", "weights")


def _totals(rest: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """Sums of the weights by topic, and how many terms there are."""
    *sums, n = rest.agg(*[F.coalesce(F.sum(F.col("weights")[j]), F.lit(0.0)) for j in range(k)], F.count("*")).first()
    return np.array(sums), n


def _learned(model: TopicTable, counted: DataFrame, pairs: DataFrame, held: _Weights, step: int, others: int, scale: float, rate: float) -> TopicTable:
    """The model after one more batch, a ``scale``-th of the documents; ``others`` terms aren't in its matrix."""
    spark, k = counted.sparkSession, len(model.prior)
    names, weights = held.of(step)
    dealt = _with_rare(counted, pairs, weights.select("term", "weights")).coalesce(spark.sparkContext.defaultParallelism)  # a sum for each frequent term and task
    shared = _shared(model, spark)
    added = materialise(dealt.mapInArrow(_learning(shared), "place int, term string, weights array<double>"), "topic-sums")
    shared.destroy()
    sums = [F.sum(F.col("weights")[j]) for j in range(k)]
    eta = 1 / k
    sums_of = added.where("place is not null").groupBy("place").agg(F.array(*sums).alias("weights")).toPandas()
    matrix, places = np.zeros_like(model.matrix), sums_of["place"].to_numpy()
    terms = places >= 0
    if terms.any():
        matrix[places[terms]] = np.stack(sums_of["weights"].to_numpy()[terms])
    matrix = (1 - rate) * model.matrix + rate * (scale * matrix + eta)
    if names:
        other = added.where("term is not null").groupBy("term").agg(F.array(*sums).alias("added"))
        add = F.zip_with("weights", F.coalesce("added", F.array_repeat(F.lit(0.0), k)), lambda w, x: (1 - rate) * w + rate * (scale * x + eta))
        held.put(weights.join(other, "term", "left").withColumn("weights", add), step)
    beside = dict(zip(places.tolist(), sums_of["weights"], strict=True))
    prior = _prior(model.prior, np.array(beside[PRIOR]), beside[COUNT][0], rate) if PRIOR in beside else model.prior
    rest_totals = (1 - rate) * model.rest_totals + rate * (scale * np.array(beside.get(OTHERS, np.zeros(k))) + eta * others)
    for name in names:
        held.folder.delete(name)
    for file in added.inputFiles()[:1]:
        Folder(spark, file.rpartition("/")[0]).delete("")
    return TopicTable(model.terms, matrix, model.rest, prior, rest_totals)


def _start(term: str, k: int, seed: int) -> Column:
    """Weights near 1, drawn from the term itself."""
    def uniform(j: Column) -> Column:
        return (F.pmod(F.xxhash64(F.col(term), F.lit(seed), j), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def near_one(j: Column) -> Column:
        return F.greatest(1 + 0.1 * (F.sqrt(-2 * F.ln(uniform(2 * j))) * F.cos(2 * np.pi * uniform(2 * j + 1))), F.lit(0.01))

    return F.transform(F.array(*[F.lit(j) for j in range(k)]), near_one)  # written out for each topic it is a method too long to be compiled


def _counted(rows: DataFrame, terms: list[str]) -> DataFrame:
    """(_row, ids, ns, rare, rare_ns): places and counts of the frequent terms of each row, and all its other tokens with theirs."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sizes = _flat(b.column("tokens"))
            coded = words.dictionary_encode()
            known = pc.index_in(coded.dictionary, value_set=pa.array(shared.value, coded.dictionary.type)).fill_null(-1).to_numpy()
            wide = max(1, len(known))
            seen, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * wide + coded.indices.to_numpy(), return_counts=True)
            row, code = seen // wide, seen % wide
            out = []
            for some, values in ((known[code] >= 0, lambda c: pa.array(known[c])), (known[code] < 0, lambda c: coded.dictionary.take(pa.array(c)))):
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row[some], minlength=len(sizes)))), pa.int32())
                out += [pa.ListArray.from_arrays(ends, values(code[some])), pa.ListArray.from_arrays(ends, pa.array(n[some], pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *out], ["_row", "ids", "ns", "rare", "rare_ns"])

    return rows.mapInArrow(count, "_row long, ids array<int>, ns array<int>, rare array<string>, rare_ns array<int>")


def _pairs(counted: DataFrame) -> DataFrame:
    return counted.select("_row", F.inline(F.arrays_zip("rare", "rare_ns"))).withColumnsRenamed({"rare": "term", "rare_ns": "n"})


def _with_rare(counted: DataFrame, pairs: DataFrame, rest: DataFrame) -> DataFrame:
    """Rows with the counts and weights of their rare terms, as far as the model has them."""
    weighed = pairs.join(rest, "term").groupBy("_row").agg(F.collect_list(F.struct("term", "n", "weights")).alias("found"))
    return counted.select("_row", "ids", "ns").join(weighed, "_row", "left")


def _digamma(x: np.ndarray) -> np.ndarray:
    u = x * (x + 5)
    low = (2 * x + 5) * (1 / u + 1 / (u + 4) + 1 / (u + 6))  # 1 / x + ... + 1 / (x + 5)
    y = x + 6
    f = 1 / (y * y)
    return np.log(y) - 0.5 / y - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240))) - low


def _trigamma(x: np.ndarray) -> np.ndarray:
    low = sum(1 / (x + i) ** 2 for i in range(6))
    y = x + 6
    f = 1 / (y * y)
    return 1 / y + f / 2 + f / y * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30))) + low


def _prior(prior: np.ndarray, logs: np.ndarray, docs: float, rate: float) -> np.ndarray:
    """A Newton step of the prior of a document's topics towards the mean of their logarithms."""
    gradient = docs * (logs / docs - (_digamma(prior) - _digamma(prior.sum())))
    c, q = docs * _trigamma(prior.sum()), -docs * _trigamma(prior)
    moved = prior - rate * (gradient - (gradient / q).sum() / (1 / c + (1 / q).sum())) / q
    return moved if (moved > 0).all() else prior


def _topics_of(beta: np.ndarray, n: np.ndarray, sizes: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Topic weights of documents with ``sizes`` terms each, none 0; each is followed until it stands still."""
    out, starts, order = np.empty((len(sizes), len(prior))), np.cumsum(sizes) - sizes, np.argsort(sizes, kind="stable")
    while len(order):
        wide = sizes[order[-1]]
        live, order = np.split(order, [-max(1, CELLS // wide)])[::-1] if CELLS // wide < len(order) else (order, order[:0])
        filled = np.arange(wide) < sizes[live][:, None]
        at = (starts[live][:, None] + np.arange(wide))[filled]
        b, c = np.zeros((len(live), wide, len(prior))), np.zeros((len(live), wide))
        b[filled], c[filled] = beta[at], n[at]
        b = np.ascontiguousarray(b.transpose(0, 2, 1))  # terms of a topic side by side
        gamma, done = np.ones((len(live), len(prior))), np.zeros(len(live), bool)
        for _ in range(MOST_STEPS):
            theta = np.exp(_digamma(gamma) - _digamma(gamma.sum(1, keepdims=True)))
            share = c / ((theta[:, None, :] @ b)[:, 0] + 1e-100)
            new = prior + theta * (b @ share[:, :, None])[:, :, 0]
            still = (np.abs(new - gamma).mean(1) < CLOSE) & ~done
            gamma = new
            out[live[~done]] = new[~done]  # a document that stands still keeps its weights
            done |= still
            if done.all():
                break
            if done.mean() > 0.5:
                b, c, live, gamma, done = b[~done], c[~done], live[~done], gamma[~done], np.zeros((~done).sum(), bool)
    return out


def _slices(batches: Iterator[pa.RecordBatch], logs: np.ndarray, log_totals: np.ndarray):
    """(rows, sizes, place or -1 of each term, term if rare, count, weight by topic), a few documents at a time."""
    for whole in batches:
        for lo in range(0, whole.num_rows, SLICE):
            b = whole.slice(lo, SLICE)
            (ids, size), (ns, _), (found, rare) = (_flat(b.column(c)) for c in ("ids", "ns", "found"))
            words = found.field("term")
            order = np.argsort(np.concatenate([np.repeat(np.arange(len(x)), x) for x in (size, rare)]), kind="stable")
            weights = found.field("weights").flatten().to_numpy().astype(float).reshape(-1, len(log_totals))
            beta = np.concatenate([logs[ids.to_numpy()], np.exp(_digamma(weights) - log_totals)] if len(words) else [logs[ids.to_numpy()]])[order]
            place = np.concatenate([ids.to_numpy(), np.full(len(words), -1)])[order]
            counts = np.concatenate([ns.to_numpy(), found.field("n").to_numpy()])[order].astype(float)
            yield b.column("_row"), size + rare, place, words, counts, beta


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All items one after the other, and how many each list has."""
    return lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()


def _shared(model: TopicTable, spark: SparkSession) -> Broadcast:
    totals = _digamma(model.totals)
    return spark.sparkContext.broadcast((np.exp(_digamma(model.matrix) - totals), totals, model.prior))


def _inference(shared: Broadcast):
    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, totals, prior = shared.value
        for row, sizes, _, _, n, beta in _slices(batches, logs, totals):
            out, full = np.zeros((len(sizes), len(prior))), sizes > 0
            if full.any():
                gamma = _topics_of(beta, n, sizes[full], prior)
                out[full] = gamma / gamma.sum(1, keepdims=True)
            yield pa.RecordBatch.from_arrays([row, pa.array(list(out), pa.list_(pa.float64()))], ["_row", "topic_distribution"])

    return infer


def _learning(shared: Broadcast):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs, totals, prior = shared.value
        added, mean, rest, docs = np.zeros_like(logs), np.zeros(len(prior)), np.zeros(len(prior)), 0

        def told(places, words, weights: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.arange(len(weights) + 1) * len(prior), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(words, pa.string()), pa.ListArray.from_arrays(ends, pa.array(weights.ravel()))], ["place", "term", "weights"])

        for _, sizes, place, words, n, beta in _slices(batches, logs, totals):
            sizes = sizes[sizes > 0]
            if not len(sizes):
                continue
            gamma = _topics_of(beta, n, sizes, prior)
            expected = _digamma(gamma) - _digamma(gamma.sum(1, keepdims=True))
            part = beta * np.repeat(np.exp(expected), sizes, axis=0)
            part *= (n / (part.sum(1) + 1e-100))[:, None]
            frequent = np.flatnonzero(place >= 0)
            frequent = frequent[np.argsort(place[frequent], kind="stable")]
            seen, starts = np.unique(place[frequent], return_index=True)
            if len(seen):
                added[seen] += np.add.reduceat(part[frequent], starts)
            mean, docs = mean + expected.sum(0), docs + len(sizes)
            if len(words):
                others = part[place < 0]
                rest += others.sum(0)
                yield told([None] * len(words), words, others)
        seen = np.flatnonzero(added.any(1))
        for lo in range(0, len(seen), 10_000):
            some = seen[lo:lo + 10_000]
            yield told(some, [None] * len(some), added[some])
        if docs:
            yield told([PRIOR, COUNT, OTHERS], [None] * 3, np.stack([mean, np.full(len(prior), float(docs)), rest]))

    return learn
