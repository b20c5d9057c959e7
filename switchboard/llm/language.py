"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

Every language has a distribution over hashed byte n-grams.  A document's n-grams are a
mixture of these; EM estimates the weights.  Sets of languages (the best one, the best
two, ...) are compared by their likelihood less a penalty for each further language.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W

GRAM, BUCKETS = 4, 8192
#: documents whose n-grams are counted together
TOGETHER = 128
STEPS = 12
#: a further language must raise the mean log-likelihood of an n-gram by this much, besides half the logarithm of their number
LEAST_GAIN = 0.02
SMOOTH = 0.5
NO_LETTERS = "und"


class Model(NamedTuple):
    languages: list[str]
    probability: np.ndarray  # languages x buckets


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all n-grams: lower-cased, ASCII that isn't a letter as a space, two spaces around each text."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    padded = np.full(len(data) + 4 * n, 32, np.uint8)
    padded[np.arange(len(data)) + 4 * row + 2] = table[data]
    row = np.repeat(np.arange(n), np.diff(at) + 4)
    count = max(len(padded) - GRAM + 1, 0)
    value = np.zeros(count, np.uint32)
    for k in range(GRAM):
        value = value << np.uint32(8) | padded[k:k + count]
    some = (row[:count] == row[GRAM - 1:]) & (value != 0x20202020)
    mixed = value[some] * np.uint32(0x9E3779B1)
    return row[:count][some], (mixed >> np.uint32(32 - 13)).astype(np.int64)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (lang, text) as (lang, bucket, seen) over an input partition."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for i, j, data, at in W.slices(batch.column(1)):
            row, bucket = grams(data, at)
            kinds, of = np.unique(names[i:j].astype(str), return_inverse=True)
            total = np.bincount(of[row] * BUCKETS + bucket, minlength=len(kinds) * BUCKETS).reshape(-1, BUCKETS)
            for name, part in zip(kinds.tolist(), total, strict=True):
                seen[name] = seen[name] + part if name in seen else part
    for name, total in seen.items():
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own), pa.array(total[own])], ["lang", "bucket", "seen"])


def train(docs: DataFrame, text_column: str = "text", lang_column: str = "lang") -> Model:
    """Counts the n-grams of all rows with a language; the driver gets one number for each language and bucket."""
    texts = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))
    rows = texts.mapInArrow(counted, "lang string, bucket long, seen long").groupBy("lang", "bucket").agg(F.sum("seen").alias("seen")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    count = np.zeros((len(languages), BUCKETS))
    place = {name: k for k, name in enumerate(languages)}
    count[rows["lang"].map(place).to_numpy(int), rows["bucket"].to_numpy(int)] = rows["seen"].to_numpy(float)
    return Model(languages, (count + SMOOTH) / (count.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS))


def maximise(p: np.ndarray, row: np.ndarray, count: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM from the weights ``start`` (rows x languages; 0 stays 0): weights and log-likelihoods of the rows."""
    weight, rows = start, len(n)
    begin = np.searchsorted(row, np.arange(rows))
    some = n > 0
    for step in range(STEPS + 1):
        part = weight[row] * p
        whole = part.sum(axis=1)
        if step == STEPS:
            break
        part *= (count / whole)[:, None]
        weight = start.copy()
        if some.any():
            weight[some] = np.add.reduceat(part, begin[some], axis=0) / n[some, None]
    return weight, np.bincount(row, count * np.log(whole), rows)


def proportions(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of the selected languages of each text (rows x languages); zeros without n-grams."""
    rows, kinds = len(at) - 1, len(model.languages)
    row, bucket = grams(data, at)
    table = np.bincount(row * BUCKETS + bucket, minlength=rows * BUCKETS)
    entry = np.flatnonzero(table)
    row, bucket, count = entry // BUCKETS, entry % BUCKETS, table[entry].astype(float)
    n = np.bincount(row, count, rows)
    p = model.probability.T[bucket]
    alone = np.column_stack([np.bincount(row, count * np.log(p[:, k]), rows) for k in range(kinds)])
    best = np.zeros((rows, kinds))
    best[np.arange(rows), alone.argmax(axis=1)] = 1.0
    value = alone.max(axis=1)
    price = 0.5 * np.log(np.maximum(n, 1)) + LEAST_GAIN * n
    weight, full = maximise(p, row, count, n, np.full((rows, kinds), 1.0 / kinds))
    order = np.argsort(-weight, axis=1, kind="stable")
    # texts that even all languages together explain hardly better than one are settled
    unsettled = full - value > price
    for size in range(2, kinds + 1):
        if not unsettled.any():
            break
        own = np.flatnonzero(unsettled)
        keep = unsettled[row]
        start = np.zeros((len(own), kinds))
        np.put_along_axis(start, order[own, :size], 1.0 / size, axis=1)
        found, likely = maximise(p[keep], np.searchsorted(own, row[keep]), count[keep], n[own], start)
        likely -= (size - 1) * price[own]
        better = likely > value[own]
        best[own[better]], value[own[better]] = found[better], likely[better]
    best[n == 0] = 0
    return best


def has_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Texts with a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[at[1:]] > total[at[:-1]]
    for k in np.flatnonzero(~found & (at[1:] > at[:-1])):
        found[k] = any(c.isalpha() for c in data[at[k]:at[k + 1]].tobytes().decode())
    return found


def languages_of(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, lang_pred, score, languages) of every row of ``docs``.

    ``languages`` maps each selected language to its share; ``lang_pred`` has the largest
    (of equals the first by name) and ``score`` is that share.  A text that is null or has
    no letter, or any text if no language was learned, gives ``und``, 0 and an empty map.  Repeated
    rows and null ids stay rows of their own; other columns are ignored.
    """
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                predicted, score, shares = [], [], []
                letters = has_letter(data, at) & (len(names) > 0)
                for lo in range(0, j - i, TOGETHER):
                    hi = min(lo + TOGETHER, j - i)
                    if not letters[lo:hi].any():
                        weight = np.zeros((hi - lo, max(len(names), 1)))
                    else:
                        weight = proportions(model, data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                    weight[~letters[lo:hi]] = 0
                    top = weight.argmax(axis=1)
                    some = weight[np.arange(len(top)), top] > 0
                    predicted += [names[k] if s else NO_LETTERS for k, s in zip(top, some, strict=True)]
                    score.append(np.clip(weight.max(axis=1), 0, 1))
                    shares += [[(names[k], float(w[k])) for k in np.flatnonzero(w)] for w in weight]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(predicted, pa.string()), pa.array(np.concatenate(score)),
                     pa.array(shares, pa.map_(pa.string(), pa.float64()))], ["id", "lang_pred", "score", "languages"])

    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(run, "id long, lang_pred string, score double, languages map<string,double>").withColumnRenamed("id", id_column)
