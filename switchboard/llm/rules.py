"""Quality rules as a short-circuit cascade.

Each rule's cost and share of rejections are measured on a bounded sample of the documents;
rules then run in the order of rejections per cost, each only on the texts that no rule before
it rejected.  A text is kept if no rule rejects it, so the verdict doesn't depend on the order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W

#: documents of the sample: those with the smallest hash of their id
SAMPLE = 1_000
SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?'\"()-"


def per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Marked bytes of each text."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def is_one_of(data: np.ndarray, characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table[data]


def count_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    row, _, _ = W.spans(W.space(data), at)
    return W.row_counts(row, len(at) - 1)


def word_characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return per_row(~W.space(data) & ((data & 0xC0) != 0x80), at)


def group_sizes(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (row, value), where each group begins in it, and the group's size."""
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    begin = np.flatnonzero(new)
    return order, begin, np.diff(np.append(begin, len(r)))


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and how many of them equal an earlier line."""
    row, start, end = W.spans(data == 10, at)
    filled = np.concatenate([[0], np.cumsum(~W.space(data))])
    own = filled[end] > filled[start]
    row, value = row[own], W.hash_spans(data, start[own], end[own])
    order, begin, _ = group_sizes(row, value)
    n = len(at) - 1
    return W.row_counts(row, n), W.row_counts(row, n) - W.row_counts(row[order][begin], n)


def repeated_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words in three-word windows that the text has twice or more."""
    w, n = W.words(data, at), len(at) - 1
    grams = W.gram_hashes(w.hash, 3)
    if not len(grams):
        return np.zeros(n, np.int64)
    place = np.flatnonzero(w.row[:-2] == w.row[2:])
    order, _, size = group_sizes(w.row[place], grams[place])
    twice = place[order[np.repeat(size > 1, size)]]
    cover = np.zeros(len(w.row) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 3, -1)
    return W.row_counts(w.row[np.cumsum(cover)[:-1] > 0], n)


def odd_word_length(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of less than 3 or more than 10 characters on average."""
    n, chars = count_words(data, at), word_characters(data, at)
    return (chars < 3 * n) | (chars > 10 * n)


def many_symbols(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """More symbols than a tenth of the words."""
    return 10 * per_row(is_one_of(data, SYMBOLS), at) > count_words(data, at)


def many_marks(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Punctuation is over 15 % of the characters of words."""
    return 100 * per_row(is_one_of(data, MARKS), at) > 15 * word_characters(data, at)


def many_capitals(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Letters A-Z are over 30 % of the characters of words."""
    return 100 * per_row((data >= 65) & (data <= 90), at) > 30 * word_characters(data, at)


def many_digits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Digits are over 20 % of the characters of words."""
    return 100 * per_row((data >= 48) & (data <= 57), at) > 20 * word_characters(data, at)


def repeated_lines(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Over half of the lines with a word equal an earlier one."""
    total, again = lines(data, at)
    return 2 * again > total


def one_word_dominates(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One word is over 30 % of all."""
    w, n = W.words(data, at), len(at) - 1
    order, begin, size = group_sizes(w.row, w.hash)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, w.row[order][begin], size)
    return 100 * top > 30 * W.row_counts(w.row, n)


Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: rules get the bytes and bounds of texts and tell which they reject
RULES: tuple[Rule, ...] = (odd_word_length, many_symbols, many_marks, many_capitals, many_digits, repeated_lines, one_word_dominates)


def selected(data: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of some rows."""
    if len(rows) == len(at) - 1:
        return data, at
    keep = np.zeros(len(at) - 1, bool)
    keep[rows] = True
    size = np.diff(at)
    return data[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[rows])])


def cascade(rules: Sequence[Rule], data: np.ndarray, at: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Those of the rows ``alive`` that no rule rejects; later rules see only what is left."""
    for rule in rules:
        if not len(alive):
            break
        alive = alive[~rule(*selected(data, at, alive))]
    return alive


def trial(rules: Sequence[Rule]):
    """Batches of (text) as (rule, seconds, rejected, seen) of each rule on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(0)):
                took, rejected = [], []
                for rule in rules:
                    begin = time.perf_counter()
                    rejected.append(int(rule(data, at).sum()))
                    took.append(time.perf_counter() - begin)
                n = len(rules)
                yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array(took), pa.array(rejected, pa.int64()), pa.array([j - i] * n, pa.int64())],
                                                 ["rule", "seconds", "rejected", "seen"])

    return run


def ordered_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> list[Rule]:
    """The rules by falling rejections per second on ``sample`` rows, equal ones once; unmeasured rules keep their order."""
    texts = docs.select(F.xxhash64(F.col(id_column), F.col(text_column)).alias("key"), F.col(text_column).alias("text"))
    chosen = texts.select("key").orderBy("key").limit(sample).distinct()
    texts = texts.join(F.broadcast(chosen), "key", "left_semi").dropDuplicates(["key"]).select("text")
    found = texts.mapInArrow(trial(rules), "rule long, seconds double, rejected long, seen long").groupBy("rule").agg(
        (F.sum("rejected") / F.sum("seconds")).alias("rate")).collect()  # a row for each rule
    rate = {r["rule"]: r["rate"] or 0.0 for r in found}
    return [rules[k] for k in sorted(range(len(rules)), key=lambda k: (-rate.get(k, 0.0), k))]


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def measured(rules: Sequence[Rule]):
    """Batches of (id, text) as the id with ``METRICS``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                n, again = count_words(data, at), repeated_words(data, at)
                failed = (n < 50) | (100 * again > 50 * n)
                kept = np.zeros(j - i, bool)
                kept[cascade(rules, data, at, np.flatnonzero(~failed))] = True
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *map(pa.array, (n, word_characters(data, at), per_row(is_one_of(data, SYMBOLS), at), lines(data, at)[1], again, failed, kept))],
                    ["id", *(c.split()[0] for c in METRICS.split(", "))])

    return run


def apply_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: Sequence[Rule] = RULES, sample: int = SAMPLE) -> DataFrame:
    """(id, metrics, base_failed, kept) of every row of ``docs``.

    ``base_failed``: fewer than 50 words, or over half of them in repeated three-word windows; such texts
    skip the cascade and aren't kept.  A null text has no words.  Repeated rows and null ids stay rows of
    their own; an empty table gives none; other columns are ignored.
    """
    order = ordered_rules(docs, id_column, text_column, rules, sample)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return texts.mapInArrow(measured(order), f"id long, {METRICS}").withColumnRenamed("id", id_column)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY doc_id),
line AS (
  SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
lined AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS again FROM line GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x FROM d) GROUP BY doc_id, x) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lined.again, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    length(text) - length(regexp_replace(text, '[.,;:!?''"()-]', '', 'g')) AS marks,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
    length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
    coalesce(lined.n, 0) AS n_lines, coalesce(top.n, 0) AS top
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lined USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
    OR 100 * marks > 15 * word_chars OR 100 * capitals > 30 * word_chars OR 100 * digits > 20 * word_chars
    OR 2 * n_dup_lines > n_lines OR 100 * top > 30 * n_words) AS kept
FROM b
"""
