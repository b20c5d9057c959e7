"""Harmonic packing of tokenised documents into sequences of one capacity.

Lengths fall into classes by the reciprocals of the capacity: a length in (C / (k + 1), C / k] belongs to
class k, and C // (C // k) of its pieces fill a sequence.  A document longer than the capacity gives whole
sequences first.  What is left of it stays one piece if it nearly fills its place; otherwise the largest
length of the next class is cut off, which leaves less than its k-th part, so a document has few pieces and they fit
their class's places nearly without padding.

Every worker fills the sequences of its classes on its own, in the order of its rows; nothing is shuffled.  Of each class
less than one sequence is left over at its end: those pieces are laid end to end,
cut at the capacity, and the last of them at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.llm import words as W
from switchboard.llm.token_ids import Encoder, ranges

CAPACITY = 4096
#: a remainder stays whole if the padding behind it is at most this part of its document
SLACK = 128
#: sequences of a worker are numbered from its partition's number times this
WORKER_IDS = 1 << 40


class Pieces(NamedTuple):
    """Pieces of documents: row of the document in ``docs``, first id there, length, longest length of the class."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    place: np.ndarray

    def take(self, rows: np.ndarray) -> Pieces:
        return Pieces(*(column[rows] for column in self))


def cut(n: np.ndarray, capacity: int, slack: int = SLACK) -> Pieces:
    """Pieces of documents of ``n`` ids each, with the lengths of their classes."""
    whole = n // capacity
    doc = np.repeat(np.arange(len(n)), whole)
    found = [Pieces(doc, ranges(np.zeros(len(n), np.int64), whole) * capacity, np.full(len(doc), capacity), np.full(len(doc), capacity))]
    doc = np.flatnonzero(n % capacity)
    start, left = whole[doc] * capacity, n[doc] % capacity
    while len(doc):
        k = capacity // left
        fits = (capacity // k - left) * slack <= n[doc]
        length = np.where(fits, left, capacity // np.minimum(k + 1, capacity))
        found.append(Pieces(doc, start, length, np.where(fits, capacity // k, length)))
        open_ = ~fits
        doc, start, left = doc[open_], (start + length)[open_], (left - length)[open_]
    return Pieces(*map(np.concatenate, zip(*found, strict=True)))


def borders(total: int, capacity: int) -> np.ndarray:
    """First places of the sequences that ``total`` leftover ids are laid into; the last one's end is ``total``."""
    at = list(range(0, total - total % capacity + 1, capacity))
    rest = total % capacity
    while rest:
        at.append(at[-1] + (1 << rest.bit_length() - 1))
        rest &= ~(1 << rest.bit_length() - 1)
    return np.array(at, np.int64)


class Worker:
    """The open sequences of one task: at most one of each class, so less than ``capacity`` ids for each class."""

    def __init__(self, capacity: int, slack: int, first: int) -> None:
        self.capacity, self.slack, self.next = capacity, slack, first
        none = np.zeros(0, np.int64)
        self.pieces, self.ids = Pieces(none, none, none, none), np.zeros(0, np.uint32)
        self.names, self.sizes = None, none  # id and length of each open piece's document

    def add(self, names: pa.Array, ids: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        """Takes documents in; gives the pieces of the sequences that are now full."""
        new = cut(n, self.capacity, self.slack)
        held, kept = len(self.pieces.doc), len(self.ids)
        begin = np.concatenate([np.cumsum(self.pieces.length) - self.pieces.length, kept + (np.cumsum(n) - n)[new.doc] + new.start])
        ids = np.concatenate([self.ids, ids])
        names = names if self.names is None else pa.concat_arrays([self.names, names])
        pieces = Pieces(*(np.concatenate(x) for x in zip(self.pieces._replace(doc=np.arange(held)), new._replace(doc=new.doc + held), strict=True)))
        sizes = np.concatenate([self.sizes, n])
        # by class, in order of arrival
        order = np.argsort(-pieces.place, kind="stable")
        pieces, begin = pieces.take(order), begin[order]
        first = np.flatnonzero(np.diff(pieces.place, prepend=-1))
        count = np.diff(np.append(first, len(order)))
        fill = self.capacity // pieces.place
        rank = np.arange(len(order)) - np.repeat(first, count)
        full = rank < np.repeat(count, count) // fill * fill
        if full.any():
            starts = np.flatnonzero(full & (rank % fill == 0))
            chosen = np.flatnonzero(full)
            sequence = np.searchsorted(starts, chosen, "right") - 1
            yield self.laid(pieces.take(chosen), begin[chosen], sequence, names, sizes, ids)
        rest = np.flatnonzero(~full)
        pieces, begin = pieces.take(rest), begin[rest]
        self.ids = ids[ranges(begin, pieces.length)]
        self.names, self.sizes, self.pieces = names.take(pa.array(pieces.doc)), sizes[pieces.doc], pieces

    def finish(self) -> Iterator[tuple]:
        """The leftover pieces, cut where sequences end."""
        total = int(self.pieces.length.sum())
        if not total:
            return
        ends = borders(total, self.capacity)
        begin = np.cumsum(self.pieces.length) - self.pieces.length
        at = np.unique(np.concatenate([begin, ends[:-1]]))
        of = np.searchsorted(begin, at, "right") - 1
        length = np.diff(np.append(at, total))
        pieces = Pieces(of, self.pieces.start[of] + at - begin[of], length, length)
        yield self.laid(pieces, at, np.searchsorted(ends, at, "right") - 1, self.names, self.sizes, self.ids)

    def laid(self, pieces: Pieces, begin: np.ndarray, sequence: np.ndarray, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> tuple:
        """Columns of pieces that lie in sequences 0, 1, ... one behind the other."""
        place = np.cumsum(pieces.length) - pieces.length
        offset = place - place[np.flatnonzero(np.diff(sequence, prepend=-1))][sequence]
        flat = ids[ranges(begin, pieces.length)].astype("<u4")
        raw = memoryview(flat).cast("B") if len(flat) else memoryview(b"")
        crc = [zlib.crc32(raw[4 * a:4 * (a + b)]) for a, b in zip(place.tolist(), pieces.length.tolist(), strict=True)]
        number = self.next + sequence
        self.next += int(sequence[-1]) + 1
        return names.take(pa.array(pieces.doc)), pieces.start, pieces.length, crc, sizes[pieces.doc], number, offset, flat


def encoded(encoder: Encoder, data: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with ``end`` behind each, and their numbers; a single long text is encoded in runs of whole words."""
    if len(at) == 2 and encoder.by_word and len(data) > W.SLICE_BYTES:
        found, lo = [], 0
        while lo < len(data):
            hi = min(len(data), lo + W.SLICE_BYTES)
            while hi < len(data) and not W.space(data[hi:hi + 1])[0]:
                step = np.flatnonzero(W.space(data[hi:hi + W.SLICE_BYTES]))
                hi = hi + int(step[0]) if len(step) else min(len(data), hi + W.SLICE_BYTES)
            found.append(encoder.encode(data[lo:hi], np.array([0, hi - lo]))[0])
            lo = hi
        ids = np.concatenate(found)
        n = np.array([len(ids)])
    else:
        ids, n = encoder.encode(data, at)
    return np.insert(ids, np.cumsum(n), np.uint32(end)), n + 1


COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed(tokenizer: str, end: int, capacity: int, slack: int, by_word: bool, with_ids: bool):
    """Batches of (id, text) as rows of pieces."""
    def rows(found: tuple) -> pa.RecordBatch:
        names, *numbers, flat = found
        arrays = [names, *(pa.array(x, pa.int64()) for x in numbers)]
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(numbers[1])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64))))
        return pa.RecordBatch.from_arrays(arrays, ["id", *(c.split()[0] for c in COLUMNS.split(", ")), *(["ids"] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, worker = Encoder(tokenizer, by_word), Worker(capacity, slack, TaskContext.get().partitionId() * WORKER_IDS)
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                yield from map(rows, worker.add(batch.column(0).slice(i, j - i), *encoded(encoder, data, at, end)))
        yield from map(rows, worker.finish())

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, slack: int = SLACK, by_word: bool = False, with_ids: bool = True,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece of every row.

    Each document's ids, ``end`` behind them, lie in exactly one piece; pieces lie in their sequence without gaps.
    Sequences hold at most ``capacity`` ids.  A null text is empty, so its document is the end id alone.  Rows with null or
    repeated ids are documents of their own; an empty table gives no rows; other columns are ignored.
    Sequence ids are unlike, not consecutive.  Rows packed together depend on the input's partitions: write the result before
    using it twice if the input's order isn't fixed.
    """
    if capacity < 1:
        raise ValueError("a sequence holds at least one id")
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    schema = f"id long, {COLUMNS}" + ", ids array<long>" * with_ids
    return texts.mapInArrow(packed(tokenizer, end, capacity, slack, by_word, with_ids), schema).withColumnRenamed("id", id_column)


def stored_length(length: Column, capacity: int = CAPACITY) -> Column:
    """Length of a sequence with its padding: none at a power of two, else up to the capacity."""
    return F.when(F.bit_count(length) == 1, length).otherwise(F.lit(capacity).cast("long"))


def sequences(pieces: DataFrame, pad: int, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, ids) of the padded sequences that pieces with their ids lie in."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # at most ``capacity`` ids
    parts = parts.select("sequence_id", F.flatten("parts.ids").alias("ids")).withColumn("length", F.size("ids").cast("long"))
    padding = F.array_repeat(F.lit(pad).cast("long"), (stored_length(F.col("length"), capacity) - F.col("length")).cast("int"))
    return parts.select("sequence_id", "length", F.concat("ids", padding).alias("ids"))
