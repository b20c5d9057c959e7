"""Removal of repeated passages by seed and extend over winnowed anchors.

A window of ``WINDOW`` words is repeated if a document with a smaller id has it too.  Of the
word ``ANCHOR``-grams in a window the one with the smallest hash is its anchor, so equal windows
have equal anchors and only anchors need to meet.

1. Every document gives its anchors, each with its context: the words that any window with
   this anchor can reach.  Occurrences with equal context are extended at once: all
   but those of the smallest id are repeats over the whole context.
2. Where one anchor has several contexts, one document for each context is extended window by
   window.
3. Overlapping repeats merge to maximal ones, and their words go.

Occurrences that repeat one of the same input partition are settled there, so a passage that
a third of all documents share reaches a bucket once for each partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W
from switchboard.session import materialise

WINDOW, ANCHOR = 13, 7
SIDE = WINDOW - ANCHOR
#: occurrences compared inside an input partition at a time
TOGETHER = 1_000_000
#: bytes of text for each bucket of anchors, and the least number of buckets
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 32


def anchors(w: W.Words, at_row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Whole windows' starts, each one's anchor (an index), and the anchors' first words and hashes.

    ``at_row``: the number of words before each text, and of all.  Of equal hashes the last counts.
    """
    hashes = W.gram_hashes(w.hash, ANCHOR)
    count = len(w.hash) - WINDOW + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    start = np.flatnonzero(w.row[:count] == w.row[WINDOW - 1:])
    place, best = start.copy(), hashes[start]
    for k in range(1, SIDE + 1):
        other = hashes[start + k]
        better = other <= best
        place[better] = start[better] + k
        best = np.minimum(best, other)
    first, of = np.unique(place, return_inverse=True)
    return start, of, first, hashes[first]


def contexts(w: W.Words, at_row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of the words around each anchor, with a mark for places beyond the text."""
    low, high = at_row[w.row[first]], at_row[w.row[first] + 1]
    total = np.zeros(len(first), np.uint64)
    for k in range(-SIDE, ANCHOR + SIDE):
        place = first + k
        inside = (place >= low) & (place < high)
        word = np.where(inside, w.hash[np.clip(place, 0, len(w.hash) - 1)], np.uint64(0))
        total = total * np.uint64(W.ODD) + word
    return W.mix(total ^ np.uint64(W.STEP))


def window_hashes(w: W.Words, start: np.ndarray) -> np.ndarray:
    total = np.zeros(len(start), np.uint64)
    for k in range(WINDOW):
        total = total * np.uint64(W.STEP) + w.hash[start + k]
    return W.mix(total)


def words_before(w: W.Words, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(W.row_counts(w.row, n))])


class Pool:
    """Occurrences (seed, code, doc) of an input partition; repeats inside it are settled at once."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, seed: np.ndarray, code: np.ndarray, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((seed, code, doc))
        self.size += len(seed)
        if self.size >= TOGETHER:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        seed, code, doc = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        order = np.lexsort((doc, code, seed))
        s, c, d = seed[order], code[order], doc[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
        lead = np.ones(len(s), bool)
        lead[1:] = new[1:] | (d[1:] != d[:-1])
        own = order[lead]
        sure = np.zeros(len(seed), bool)
        sure[own] = ~new[lead]
        own = np.sort(own)  # in order of the documents, which packs well
        seed, code, doc, sure = seed[own], code[own], doc[own], sure[own]
        spread = np.where(sure, W.mix(code ^ doc.view(np.uint64)), seed)
        bucket = (spread >> np.uint64(11)) % np.uint64(self.buckets)
        for lo in range(0, len(own), 100_000):
            cut = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut].astype(np.int64)), W.signed(seed[cut]), W.signed(code[cut]), pa.array(doc[cut]), pa.array(sure[cut])],
                ["bucket", "seed", "code", "doc", "sure"])


OCCURRENCE = "bucket long, seed long, code long, doc long, sure boolean"


def anchor_occurrences(buckets: int):
    """Batches of (id, text) as anchor occurrences: seed is the anchor's hash, code its context's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, at in W.slices(batch.column(1)):
                w = W.words(data, at)
                before = words_before(w, j - i)
                _, _, first, seed = anchors(w, before)
                yield from pool.add(seed, contexts(w, before, first), ids[i:j][w.row[first]])
        yield from pool.flush()

    return run


FULL, OPEN, COVERED = 0, 1, 2
HIT = "doc long, code long, kind int"


def met(open_kind: bool):
    """A bucket of occurrences as hits: codes that a smaller document has, and, if asked for, one document
    for each of several codes of a seed that stay open."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        seed, code, doc = (table[c].to_numpy() for c in ("seed", "code", "doc"))
        sure = table["sure"].to_numpy(zero_copy_only=False)
        out = [(doc[sure], code[sure], FULL)]
        seed, code, doc = seed[~sure], code[~sure], doc[~sure]
        order = np.lexsort((doc, code, seed))
        seed, code, doc = seed[order], code[order], doc[order]
        new = np.ones(len(seed), bool)
        new[1:] = (seed[1:] != seed[:-1]) | (code[1:] != code[:-1])
        if len(seed):
            least = doc[new][np.cumsum(new) - 1]
            again = doc > least
            out.append((doc[again], code[again], FULL))
        if open_kind and len(seed):
            s, c, d = seed[new], code[new], doc[new]
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            apart = np.minimum.reduceat(d, begin) < np.maximum.reduceat(d, begin)
            some = np.repeat(apart, np.diff(np.append(begin, len(s))))
            out.append((d[some], c[some], OPEN))
        return pa.table({"doc": np.concatenate([o[0] for o in out]), "code": np.concatenate([o[1] for o in out]),
                         "kind": np.concatenate([np.full(len(o[0]), o[2], np.int32) for o in out])})

    return run


def list_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column of longs, as hashes; null is an empty list."""
    bounds = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(bounds), 0)
    return np.repeat(np.arange(len(column)), size), column.flatten().to_numpy().view(np.uint64)


def among(row: np.ndarray, code: np.ndarray, listed: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the list of a value's row has the value."""
    of, value = listed
    both = np.concatenate([code, value])
    _, number = np.unique(both, return_inverse=True)
    kinds = int(number.max()) + 1 if len(number) else 1
    return np.isin(row * kinds + number[:len(code)], of * kinds + number[len(code):])


def open_windows(buckets: int):
    """Batches of (id, text, full, open) as occurrences of the windows whose anchor is open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, j, data, at in W.slices(batch.column(1)):
                w = W.words(data, at)
                before = words_before(w, j - i)
                start, of, first, seed = anchors(w, before)
                if not len(start):
                    continue
                is_open = among(w.row[first], contexts(w, before, first), list_rows(batch.column(2).slice(i, j - i)))
                own = is_open[of]
                yield from pool.add(seed[of[own]], window_hashes(w, start[own]), ids[i:j][w.row[start[own]]])
        yield from pool.flush()

    return run


def cleaned(with_text: bool):
    """Batches of (id, text, full contexts, covered windows) as the result row of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                w = W.words(data, at)
                before = words_before(w, j - i)
                change = np.zeros(len(w.row) + 1, np.int64)
                start, of, first, _ = anchors(w, before)
                if len(start):
                    full = first[among(w.row[first], contexts(w, before, first), list_rows(batch.column(2).slice(i, j - i)))]
                    np.add.at(change, np.maximum(full - SIDE, before[w.row[full]]), 1)
                    np.add.at(change, np.minimum(full + WINDOW, before[w.row[full] + 1]), -1)
                    listed = list_rows(batch.column(3).slice(i, j - i))
                    some = np.isin(w.row[start], listed[0])
                    start = start[some]
                    covered = start[among(w.row[start], window_hashes(w, start), listed)]
                    np.add.at(change, covered, 1)
                    np.add.at(change, covered + WINDOW, -1)
                gone = np.cumsum(change)[:-1] > 0
                removed = W.row_counts(w.row[gone], j - i)
                raw, texts = data.tobytes(), []
                for k in range(j - i):
                    own = raw[at[k]:at[k + 1]].split()
                    if removed[k]:
                        own = compress(own, (~gone[before[k]:before[k + 1]]).tolist())
                    texts.append(b" ".join(own))
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(before)), pa.array(removed), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                names = ["doc", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array([t.decode() for t in texts]))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row of ``docs``.

    A word goes if it lies in a window of thirteen words that also starts in a document with a
    smaller id; windows are those of the input.  Words are runs without the six ASCII white
    spaces, unchanged; kept words are joined by one space.  A null or short text loses nothing.  Rows that repeat an id
    don't remove each other's words; a null id neither removes nor loses words.  Other columns are ignored.

    Windows are compared by two 64-bit hashes.  The texts are shuffled once, by id; lists
    of a document's repeats are no longer than the document.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(size) // BUCKET_BYTES + 1)
    seen = texts.where("doc is not null").mapInArrow(anchor_occurrences(buckets), OCCURRENCE)
    hits = materialise(seen.groupBy("bucket").applyInArrow(met(True), HIT), "repeat-hits")

    def listed(rows: DataFrame, kind: int, name: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).groupBy(F.col("doc").alias("of")).agg(F.collect_set("code").alias(name))

    by_doc = lambda left, right, how: left.join(right.hint("merge"), left.doc == right.of, how).drop("of")
    opened = by_doc(texts, listed(hits, OPEN, "open"), "inner")
    windows = opened.mapInArrow(open_windows(buckets), OCCURRENCE).groupBy("bucket").applyInArrow(met(False), HIT)
    lists = hits.where(F.col("kind") == FULL).unionByName(windows.withColumn("kind", F.lit(COVERED)))
    lists = lists.groupBy(F.col("doc").alias("of")).agg(
        F.collect_set(F.when(F.col("kind") == FULL, F.col("code"))).alias("full"),
        F.collect_set(F.when(F.col("kind") == COVERED, F.col("code"))).alias("covered"))
    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return by_doc(texts, lists, "left").mapInArrow(cleaned(with_text), schema).withColumnRenamed("doc", id_column)


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows) WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM repeated, range(13) t(o)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT word.doc_id, count(*) AS n, count(gone.p) AS r, string_agg(CASE WHEN gone.p IS NULL THEN x END, ' ' ORDER BY word.p) AS k
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(r, 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
