"""Token ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank of frequency over the whole corpus, so frequent ids take one
byte.  Four ranks share a control byte of four 2-bit lengths (1 to 4 bytes); the data
bytes follow in a column of their own.  Decoding is a lookup of each control byte in
tables of lengths and byte places.

A written corpus is a folder with two Parquet tables: ``ranks`` (rank, id) and ``blocks``
(shard, block, document ids, sizes, control bytes, data bytes), uncompressed.
Shards are ranges of ascending ids; so are the blocks of a shard.  Spark's writer
commits each task's files once, so a lost executor leaves no part of a block behind.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard.llm import words as W

#: distinct pieces whose ids a worker remembers before it drops those not seen again, about 26 bytes each
KNOWN_PIECES = 2_000_000
#: pieces of letters that the library gets as one string
JOINED_PIECES = 512
#: bytes of a span up to which it is hashed by itself
SHORT_BYTES = 64
#: bytes of text encoded together, but for a single longer one; a worker's arrays take some thirty times as much
SLICE_BYTES = 512 << 10
#: rows that an executor hands to a worker together: the batch lies in the memory of both
BATCH_ROWS = 2000
#: ids of a block, but for a single longer document
BLOCK_IDS = 1 << 18
#: bytes of text of a shard
SHARD_BYTES = 32 << 20


class Known:
    """Ids of pieces of text seen before, by the piece's hash.

    ``main`` and the small ``recent`` are sorted (hash, first id, number of ids, found again); the ids themselves are only
    appended, in 16 bits while all fit.
    """

    def __init__(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32), np.zeros(0, bool))
        self.main, self.recent = none, none
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0

    def __len__(self) -> int:
        return len(self.main[0]) + len(self.recent[0])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id and number of ids of each hash, hashes in order; -1 if it isn't known."""
        begin, size = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for part in (self.main, self.recent):
            if len(part[0]):
                place = np.minimum(np.searchsorted(part[0], hashes), len(part[0]) - 1)
                has = part[0][place] == hashes
                own = place[has]
                begin[has], size[has], part[3][own] = part[1][own], part[2][own], True
        return begin, size

    def add(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """New pieces in order of their hashes."""
        if len(ids) and ids.max() > np.iinfo(self.ids.dtype).max:
            self.ids = self.ids.astype(np.uint32)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) // 4 + len(ids), self.ids.dtype)])
        self.ids[self.used:self.used + len(ids)] = ids
        self.recent = inserted(self.recent, (hashes, self.used + np.cumsum(size) - size, size, False))
        self.used += len(ids)
        if len(self.recent[0]) > 100_000:
            self.main, self.recent = inserted(self.main, self.recent), tuple(x[:0] for x in self.recent)

    def make_room(self, new: int) -> None:
        """Before ``new`` pieces come: if there is no room for them, keeps pieces that were found again since the last time, at most half of all."""
        if len(self) + new <= KNOWN_PIECES and self.used <= 8 * KNOWN_PIECES:
            return
        hashes, begin, size, again = inserted(self.main, self.recent)
        kept = np.flatnonzero(again)[:KNOWN_PIECES // 2]
        kept = kept[np.cumsum(size[kept], dtype=np.int64) <= 4 * KNOWN_PIECES]
        size = size[kept].astype(np.int64)
        ids = self.ids[ranges(begin[kept].astype(np.int64), size)]
        self.__init__()
        self.add(hashes[kept], size, ids)


def inserted(table: tuple, rows: tuple) -> tuple:
    place = np.searchsorted(table[0], rows[0]) + np.arange(len(rows[0]))
    old = np.ones(len(table[0]) + len(rows[0]), bool)
    old[place] = False
    both = tuple(np.empty(len(old), a.dtype) for a in table)
    for to, a, b in zip(both, table, rows, strict=True):
        to[old], to[place] = a, b
    return both


def of_this_process(name: str, make):
    """One object for all tasks that a worker process runs."""
    shelf = sys.modules.setdefault("switchboard_worker_shelf", types.ModuleType("switchboard_worker_shelf"))
    if not hasattr(shelf, name):
        setattr(shelf, name, make())
    return getattr(shelf, name)


def forget_pieces() -> None:
    """Drops what the encoders of this process remember."""
    for kept in vars(sys.modules.get("switchboard_worker_shelf", types)).values():
        if isinstance(kept, Known):
            kept.__init__()


class Encoder:
    """Whole texts to ids; with ``by_word`` one library call encodes the new distinct pieces of many texts.

    That is only for tokenizers that split at white space and drop it, ignore case, and
    split between a letter and another ASCII character that isn't an apostrophe (``word_bpe_49k``): there the ids of a
    text are those of its pieces.  Others encode text by text.  A worker keeps the ids of
    ``KNOWN_PIECES`` pieces between its tasks; when they are full, those found again stay.
    """

    def __init__(self, path: str, by_word: bool) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        self.by_word, self.name = by_word, f"known {path}"
        self.tokenizer = of_this_process(f"tokenizer {path}", lambda: Tokenizer.from_file(path))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends_word = of_this_process(f"word ends {path}", lambda: word_ends(self.tokenizer))

    def ids_of(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings and the number of each; a few thousand at a time, as the library's results are large."""
        ids, size = [np.zeros(0, np.uint32)], []
        for lo in range(0, len(strings), 4096):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(strings[lo:lo + 4096], add_special_tokens=False)]
            size += map(len, found)
            ids.append(np.fromiter((i for x in found for i in x), np.uint32))
        return np.concatenate(ids), np.array(size, np.int64)

    def ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``ids_of``, but pieces of letters alone are joined by spaces, as the library takes most of its time for a string, not for its length.

        Each gives one word or more, so if a string has as many ids that end a word as it has pieces, they end its pieces; else its pieces go one by one.
        """
        letters = np.array([p.isalpha() for p in pieces], bool) & self.ends_word.any()
        alone, joined, ids, size = np.flatnonzero(~letters).tolist(), np.flatnonzero(letters).tolist(), [], []
        order = []
        for lo in range(0, len(joined), JOINED_PIECES):
            own = joined[lo:lo + JOINED_PIECES]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[k] for k in own])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends_word[found]) + 1
            if len(ends) == len(own) and ends[-1] == len(found):
                ids.append(found)
                size.append(np.diff(ends, prepend=0))
                order += own
            else:
                alone += own
        found, n = self.ids_of([pieces[k] for k in alone])
        ids, size = np.concatenate([*ids, found]), np.concatenate([*size, n])
        place = np.argsort(order + alone)
        return ids[ranges((np.cumsum(size) - size)[place], size[place])], size[place]

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids of each text."""
        if not self.by_word:
            raw = data.tobytes()
            return self.ids_of([raw[i:j].decode() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        row, back, begin, size, known = self.pieces(data, at)
        size = size[back]
        return known[ranges(begin[back], size)].astype(np.uint32), np.bincount(row, size, len(at) - 1).astype(np.int64)

    def count(self, data: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """How often each id is in the texts, for ``least`` ids at least."""
        if not self.by_word:
            return np.bincount(self.encode(data, at)[0], minlength=least)
        _, back, begin, size, known = self.pieces(data, at)
        times = np.bincount(back, minlength=len(size))
        return np.bincount(known[ranges(begin, size)], np.repeat(times, size), least).astype(np.int64)

    def pieces(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row and distinct piece of each piece; first id and number of ids of each distinct piece; the array these ids are in."""
        raw, cuts = data.tobytes(), None
        if b"<|" not in raw:  # else there may be special tokens, which are case-sensitive
            data = W.lower(data)
            raw, cuts = data.tobytes(), piece_borders(data)
        row, start, end = W.spans(W.space(data), at, cuts)
        hashes, some, back = distinct(span_hashes(data, start, end))
        known = of_this_process(self.name, Known)
        known.make_room(len(hashes))
        begin, size = known.find(hashes)
        new = begin < 0
        if new.any():
            own = some[new]
            ids, count = self.ids_of_pieces([raw[i:j].decode() for i, j in zip(start[own].tolist(), end[own].tolist(), strict=True)])
            begin[new], size[new] = known.used + np.cumsum(count) - count, count
            known.add(hashes[new], count, ids)
        return row, back, begin, size, known.ids


def word_ends(tokenizer) -> np.ndarray:
    """Whether an id ends a word, by id; of none if the tokenizer doesn't mark them."""
    vocabulary, mark = tokenizer.get_vocab(with_added_tokens=True), getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
    if mark:
        ends[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
    return ends


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, read eight at a time; long spans take ``words.hash_spans``."""
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the bytes from each place
    some = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    size = end - start
    found = W.mix(W.mix(size.astype(np.uint64)) ^ eight[start] & some[np.minimum(size, 8)])
    for lo in range(8, SHORT_BYTES, 8):
        more = np.flatnonzero(size > lo)
        found[more] = W.mix(found[more] ^ eight[start[more] + lo] & some[np.minimum(size[more] - lo, 8)])
    long = size > SHORT_BYTES
    if long.any():
        found[long] = W.hash_spans(data, start[long], end[long])
    return found


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, a place of each, and where among them each given hash is."""
    coded = pa.array(hashes).dictionary_encode()
    found, back = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    some = np.empty(len(found), np.int64)
    some[back] = np.arange(len(back))
    order = np.argsort(found)
    rank = np.empty(len(found), np.int64)
    rank[order] = np.arange(len(found))
    return found[order], some[order], rank[back]


def piece_borders(data: np.ndarray) -> np.ndarray:
    """Places between an ASCII letter and an ASCII character that is neither letter nor apostrophe."""
    kind = np.full(256, 2, np.uint8)
    kind[97:123] = 1
    kind[65:91] = 1
    kind[ord("'")] = 0
    kind[128:] = 0
    of = kind[data]
    return np.flatnonzero((of[1:] | of[:-1]) == 3) + 1


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for ``size[0]`` places, then those of the next."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)


def pack(ranks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Control bytes and data bytes of several documents' ranks, and the data bytes of each document.

    Every document is padded with rank 0 to whole groups of four, so it has control bytes of its own.
    """
    padded = -(-n // 4) * 4
    full = np.zeros(int(padded.sum()), "<u4")
    full[ranges(np.cumsum(padded) - padded, n)] = ranks
    length = 1 + (full > 0xFF).astype(np.uint8) + (full > 0xFFFF) + (full > 0xFFFFFF)
    after = np.cumsum(length, dtype=np.int64)
    begin = after - length
    data = np.empty(int(after[-1]) if len(after) else 0, np.uint8)
    data[begin] = full & 0xFF
    for byte in range(1, 4):
        has = np.flatnonzero(length > byte)
        data[begin[has] + byte] = full[has] >> 8 * byte & 0xFF
    code = (length - 1).reshape(-1, 4)
    ends = np.append(0, after)[np.append(0, np.cumsum(padded))]
    return (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).astype(np.uint8), data, np.diff(ends)


def unpack(control: np.ndarray, data: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranks of documents of ``n`` ids each: the control bytes' lengths come from a table of 256 rows."""
    table = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
    length = table[control].reshape(-1)
    begin = np.cumsum(length) - length
    ranks = data[begin].astype(np.uint32)
    for byte in range(1, 4):
        has = np.flatnonzero(length > byte)
        ranks[has] |= data[begin[has] + byte].astype(np.uint32) << np.uint32(8 * byte)
    padded = -(-n // 4) * 4
    return ranks[ranges(np.cumsum(padded) - padded, n)]


def count_ids(path: str, by_word: bool, end: int):
    """Batches of (text) as (id, seen) over an input partition; id -1 has the bytes of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, by_word)
        seen, size = np.zeros(max(encoder.vocabulary, end + 1), np.int64), 0
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(0), SLICE_BYTES):
                seen += encoder.count(data, at, len(seen))
                seen[end] += j - i
                size += len(data)
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(seen[own], size))], ["id", "seen"])

    return run


BLOCKS = "shard long, block long, docs array<long>, sizes array<long>, control binary, data binary"


def coded_blocks(path: str, by_word: bool, end: int, rank: np.ndarray):
    """Sorted batches of (doc, text, shard) as blocks of coded documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = Encoder(path, by_word), 0
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1), SLICE_BYTES):
                ids, n = encoder.encode(data, at)
                ranks, n = np.insert(rank[ids], np.cumsum(n), rank[end]), n + 1
                lo, ends = 0, np.cumsum(n)
                while lo < len(n):
                    before = ends[lo - 1] if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(ends, before + BLOCK_IDS, "right")))
                    control, coded, _ = pack(ranks[before:ends[hi - 1]], n[lo:hi])
                    docs = batch.column(0).slice(i + lo, hi - lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(2).slice(i, 1).cast(pa.int64()), pa.array([number], pa.int64()), one_list(docs), one_list(pa.array(n[lo:hi])),
                         pa.array([control.tobytes()], pa.binary()), pa.array([coded.tobytes()], pa.binary())],
                        ["shard", "block", "docs", "sizes", "control", "data"])
                    number, lo = number + 1, hi

    return run


def one_list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside hand whole texts to their workers ``BATCH_ROWS`` at a time, or fewer if the session says so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_corpus(docs: DataFrame, folder: str, tokenizer: str, end: int, by_word: bool = False,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes every whole text, adds the id ``end`` to each, and writes the corpus in ascending order of the document id.

    Null is an empty text: its document is the end id alone.  A null document id comes
    first.  Rows that repeat an id are ordered by a hash of their text, equal rows are all written.  An empty table
    gives a corpus without blocks.  Texts are encoded twice, once to count and once to code,
    which takes less room than storing ids twice.  Ids that never occur rank last, by id.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("text"))
    counted = texts.select("text").mapInArrow(count_ids(tokenizer, by_word, end), "id long, seen long").groupBy("id").agg(F.sum("seen").alias("seen"))
    with small_batches(spark):
        seen = {r["id"]: r["seen"] for r in counted.collect()}  # at most the vocabulary
    size = seen.pop(-1, 0)
    ids = np.array(sorted(range(max([Encoder(tokenizer, by_word).vocabulary - 1, end, *seen]) + 1), key=lambda i: (-seen.get(i, 0), i)), np.uint32)
    rank = np.empty(len(ids), np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    spark.createDataFrame([(i, int(v)) for i, v in enumerate(ids)], "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    order = [F.col("doc").asc_nulls_first(), F.xxhash64("text").asc()]
    shards = max(1, size // SHARD_BYTES + 1)
    ranged = texts.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    with small_batches(spark):
        ranged.mapInArrow(coded_blocks(tokenizer, by_word, end, rank), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def decoded(ids: np.ndarray, with_ids: bool):
    """Blocks as one row for each document: doc, shard, block, place in the block, n_tokens, crc32 and, if asked for, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()  # the worker may have encoded before
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                docs, n = one.column(2).flatten(), one.column(3).flatten().to_numpy()
                control, data = (np.frombuffer(one.column(c)[0].as_buffer(), np.uint8) for c in (4, 5))
                found = ids[unpack(control, data, n)].astype("<u4")
                begin, raw = np.cumsum(n) - n, memoryview(found).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * (a + b)]) for a, b in zip(begin.tolist(), n.tolist(), strict=True)]
                columns = [docs, *(pa.array(np.full(len(n), one.column(c)[0].as_py(), np.int64)) for c in (0, 1)), pa.array(begin), pa.array(n), pa.array(crc, pa.int64())]
                names = ["doc", "shard", "block", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, n.sum()).astype(np.int32)), pa.array(found.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_corpus(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document of a written corpus.

    ``start`` is the number of ids of all documents before it; the checksum covers the
    decoded ids as little-endian unsigned 32-bit integers.
    """
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()  # at most the vocabulary
    ids = np.array([r["id"] for r in ranks], np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("shard", "block", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    # a window over one row for each shard
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = sizes.select("shard", "block", inside.alias("inside")).join(shards, "shard").select(
        "shard", "block", (F.col("base") + F.col("inside")).alias("base"))
    schema = "doc long, shard long, block long, place long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    rows = blocks.mapInArrow(decoded(ids, with_ids), schema).join(starts, ["shard", "block"])
    return rows.select(F.col("doc").alias("doc_id"), (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
