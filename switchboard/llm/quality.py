"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is put into one of at most 32 bins.  Boosting goes round the
features in turn: a tree of at most four leaves over one feature's bins is fitted to the residuals and
added, damped, to that feature's lookup table.  Then the pairs with the strongest
remaining interaction get two-dimensional tables in the same way.  A score is the sigmoid
of the sum of the table entries of a text's bins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W

FEATURES = ("log_words", "word_bytes", "symbols", "digits", "capitals", "marks", "beyond_ascii", "distinct_words", "top_word",
            "line_words", "repeated_lines", "repeated_grams", "symbol_words", "long_words", "log_bytes")
#: labelled rows used for training at most: those with the smallest hash of their id
MOST_LABELLED = 20_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 32, 150, 60, 6, 0.1, 5.0
REJECT_BELOW = 0.3
FIXED_SYMBOLS = b"#*$%&|<>~^{}[]\\@=+_"


def share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def repeats(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: distinct values, and occurrences of the most frequent one."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(row)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, row[begin], count)
    return W.row_counts(row[begin], n), top


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; an empty text has zeros."""
    n = len(at) - 1
    size = np.diff(at)
    kinds = np.zeros(256, np.uint8)  # one bit for each kind of byte
    kinds[48:58] |= 1
    kinds[65:91] |= 2
    for c in b".,;:!?'\"()-":
        kinds[c] |= 4
    kinds[128:192] |= 8  # the bytes after the first of a character
    for c in FIXED_SYMBOLS:
        kinds[c] |= 16
    of = kinds[data]
    # each text's bytes of each kind, from one histogram
    row_of = np.repeat(np.arange(n), size)
    hist = np.bincount(row_of * 32 + of, minlength=n * 32).reshape(n, 32)
    number = lambda bit: hist[:, (np.arange(32) & bit) > 0].sum(axis=1)
    w = W.words(data, at)
    count = W.row_counts(w.row, n)
    length = w.end - w.start
    distinct, top = repeats(w.row, w.hash, n)
    symbols = np.concatenate([[0], np.cumsum((of & 16) > 0)])
    with_symbol = W.row_counts(w.row[symbols[w.end] > symbols[w.start]], n)
    long = W.row_counts(w.row[length > 20], n)
    grams = W.gram_hashes(w.hash, 3)
    inside = w.row[:len(grams)] == w.row[2:] if len(grams) else np.zeros(0, bool)
    gram_row = w.row[:len(grams)][inside]
    gram_count, (gram_distinct, _) = W.row_counts(gram_row, n), repeats(gram_row, grams[inside], n)
    line_row, start, end = W.spans(data == 10, at)
    line_distinct, _ = repeats(line_row, W.hash_spans(data, start, end), n)
    lines = W.row_counts(line_row, n)
    letters = np.bincount(w.row, length, n)
    return np.column_stack([
        np.log1p(count), share(letters, count), share(number(16), size), share(number(1), size), share(number(2), size), share(number(4), size),
        share(number(8), size), share(distinct, count), share(top, count), share(count, lines), share(lines - line_distinct, lines),
        share(gram_count - gram_distinct, gram_count), share(with_symbol, count), share(long, count), np.log1p(size)]).astype(np.float64)


class Model(NamedTuple):
    """Bin bounds and lookup tables; ``pairs`` are (i, j), with a table of bins x bins each."""

    bounds: list
    base: float
    tables: np.ndarray
    pairs: list
    pair_tables: np.ndarray

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, x[:, k], "right") for k, b in enumerate(self.bounds)])

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for k in range(bins.shape[1]):
            total += self.tables[k, bins[:, k]]
        for k, (i, j) in enumerate(self.pairs):
            total += self.pair_tables[k, bins[:, i], bins[:, j]]
        return 1 / (1 + np.exp(-total))


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + SMOOTH)


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """The cut of a histogram of gradients that gains most; 0 means none."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0, 0.0
    value = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
    k = int(value.argmax())
    return (k + 1, float(value[k])) if value[k] > 1e-9 else (0, 0.0)


def small_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over bins, as one step for each bin."""
    cut, _ = best_cut(g, h)
    parts = [(0, cut), (cut, len(g))] if cut else [(0, len(g))]
    ends = []
    for a, b in parts:
        inner, _ = best_cut(g[a:b], h[a:b])
        ends += [(a, a + inner), (a + inner, b)] if inner else [(a, b)]
    step = np.zeros(len(g))
    for a, b in ends:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return step


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """One cut of either feature: four quadrants of a table, and the gain over no cut."""
    best, step = 0.0, np.zeros_like(g)
    whole = gain(g.sum(), h.sum())
    cum_g, cum_h = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cum_g[:-1, :-1], cum_h[:-1, :-1]
    parts = [(a_g, a_h), (cum_g[:-1, -1:] - a_g, cum_h[:-1, -1:] - a_h), (cum_g[-1:, :-1] - a_g, cum_h[-1:, :-1] - a_h)]
    parts.append((cum_g[-1, -1] - sum(p[0] for p in parts), cum_h[-1, -1] - sum(p[1] for p in parts)))
    total = sum(gain(*p) for p in parts) - whole
    i, j = np.unravel_index(total.argmax(), total.shape)
    best = float(total[i, j])
    for rows, cols, (pg, ph) in zip((slice(None, i + 1), slice(None, i + 1), slice(i + 1, None), slice(i + 1, None)),
                                    (slice(None, j + 1), slice(j + 1, None), slice(None, j + 1), slice(j + 1, None)), parts, strict=True):
        step[rows, cols] = pg[i, j] / (ph[i, j] + SMOOTH)
    return step, best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting; with no rows, or labels of one kind only, the model gives the smoothed rate."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    width = x.shape[1]
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for k in range(width)]
    model = Model(bounds, base, np.zeros((width, BINS)), [], np.zeros((0, BINS, BINS)))
    if len(np.unique(y)) < 2:
        return model
    bins = model.bins(x)
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for k in range(width):
            g, h = slopes()
            step = RATE * small_tree(np.bincount(bins[:, k], g, BINS), np.bincount(bins[:, k], h, BINS))
            model.tables[k] += step
            total += step[bins[:, k]]
    grid = lambda i, j, v: np.bincount(bins[:, i] * BINS + bins[:, j], v, BINS * BINS).reshape(BINS, BINS)
    g, h = slopes()
    found = sorted(((-pair_tree(grid(i, j, g), grid(i, j, h))[1], i, j) for i in range(width) for j in range(i)))[:PAIRS]
    pairs = [(i, j) for _, i, j in found]
    tables = np.zeros((len(pairs), BINS, BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (i, j) in enumerate(pairs):
            g, h = slopes()
            step = RATE * pair_tree(grid(i, j, g), grid(i, j, h))[0]
            tables[k] += step
            total += step[bins[:, i], bins[:, j]]
    return model._replace(pairs=pairs, pair_tables=tables)


def with_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, label, text) as (id, label, features)."""
    for batch in batches:
        for i, j, data, at in W.slices(batch.column(2)):
            lists = pa.FixedSizeListArray.from_arrays(pa.array(features(data, at).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
          most: int = MOST_LABELLED) -> Model:
    """Fits the model to at most ``most`` labelled documents.

    Rows without id or label, or without a document, are not used.  Of several labels of an
    id the smallest counts, of several texts the one with the smallest features.
    """
    chosen = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(
        F.min(label_column).cast("int").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(most)
    texts = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("text"))
    rows = texts.join(F.broadcast(chosen), "_id").select(F.col("_id").alias("id"), "label", "text")
    rows = rows.mapInArrow(with_features, "id long, label int, x array<double>").groupBy("id").agg(F.min(F.struct("x", "label")).alias("r"))
    rows = rows.orderBy("id").select("r.x", "r.label").toPandas()  # at most ``most``
    x = np.array(rows["x"].tolist(), float).reshape(-1, len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, score) of every row; a null text counts as empty, repeated rows and null ids stay rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(model.score(features(data, at)))], ["id", "score"])

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, model: Model, text_column: str = "text", least: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, in one pass and without a join."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(batch.schema.get_field_index(text_column))):
                yield batch.slice(i, j - i).filter(pa.array(model.score(features(data, at)) >= least))

    return docs.mapInArrow(run, docs.schema)
