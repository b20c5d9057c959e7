"""Jaccard join of documents on word n-grams by T-occurrence search (DivideSkip).

A document is the set of its distinct shingles; two link when
``100 * |A & B| >= percent * |A | B|``.  Linked sets share at least ``T = ceil(t * |A|)``
shingles, so they meet in the ``|A| - T + 1`` shortest inverted lists of either.

1. Documents with equal sets form a class; only one document of a class is searched.
2. Every class is sent, with its rarest shingles, to the buckets of these shingles' short
   lists.  A long list is cut into blocks, and every two of them meet in a bucket of their own.  Pairs in a list whose sizes and parity sketches allow a link are united.  The
   sketch has one parity bit for each residue of the shingle hashes, so the number of
   differing bits never exceeds the number of differing shingles: no link is lost.
3. In each group of united classes DivideSkip merges the short lists of a document and
   probes its long lists by binary search, which gives exact overlaps and all links.
4. Connected components of the links name each document's component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchboard.llm import words as W
from switchboard.llm.components import connected_components
from switchboard.llm.names import unused
from switchboard.session import materialise

#: a shingle is frequent if this share of the documents of an input partition has it
FREQUENT = 1 / 400
#: so many of the most frequent shingles are ordered behind all others; the order never changes the result
KNOWN_FREQUENT = 50_000
#: shingles of short lists in a bucket (there are at least so many buckets), and shingles of a block of a group
BUCKET, LEAST_BUCKETS, BLOCK = 1_000_000, 64, 1_000_000
#: sets of a block of a frequent shingle's list; every two blocks meet in a bucket of their own
LIST = 20_000


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle) of the distinct shingles by row and value, and their number by row."""
    w = W.words(W.lower(data), at)
    rows = len(at) - 1
    per_row = W.row_counts(w.row, rows)
    grams = W.gram_hashes(w.hash, size)
    row = w.row[:len(grams)]
    whole = row == w.row[size - 1:] if len(grams) else np.zeros(0, bool)
    few = np.flatnonzero((per_row > 0) & (per_row < size))
    first = np.cumsum(per_row) - per_row
    short = np.zeros(len(few), np.uint64)
    for k in range(1, size):
        own = np.flatnonzero(per_row[few] == k)
        if len(own):
            total = np.full(len(own), np.uint64(k))
            for i in range(k):
                total = total * np.uint64(W.ODD) + w.hash[first[few[own]] + i]
            short[own] = W.mix(total)
    row = np.concatenate([row[whole], few])
    value = np.concatenate([grams[whole], short])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[new], value[new]
    return row, value, W.row_counts(row, rows)


def set_keys(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit key of each row's set; equal sets have equal keys."""
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(W.mix(value ^ np.uint64(W.ODD)), out=total[1:])
    end = np.cumsum(n)
    return W.mix(total[end] - total[end - n] + n.astype(np.uint64))


def most_differing(n: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets whose sizes add up to ``n``."""
    return (100 - percent) * n // (100 + percent)


def sketch_words(n: np.ndarray, percent: int) -> np.ndarray:
    """64-bit words of the parity sketch, a power of two.

    Unrelated sets differ in nearly half the bits, and 2.6 to 5.2 bits for each shingle in which
    linked sets may differ leave about one unrelated pair in a thousand or fewer.
    """
    bits = np.maximum(2.6 * most_differing(2 * n, percent), 64)
    return (1 << np.ceil(np.log2(bits)).astype(np.int64)) // 64


def sketches(row: np.ndarray, value: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All rows' sketches as 64-bit words, and the number of words of each."""
    size = sketch_words(n, percent)
    begin = np.cumsum(size) - size
    bit = begin[row] * 64 + (value & (size[row] * 64 - 1).astype(np.uint64)).astype(np.int64)
    parity = (np.bincount(bit, minlength=int(size.sum()) * 64) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.uint64), size


def measure(size: int, percent: int):
    """Batches of (id, text, digest) as (id, digest, n, key) of each document and (token, seen) of frequent shingles.

    ``seen`` counts the different sets of an input partition, as only these get entries in lists.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "digest", "n", "key", "token", "seen"]
        docs, heavy, done = 0, [], np.zeros(0, np.uint64)
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(1)):
                row, value, n = shingle_sets(data, at, size)
                docs += j - i
                key = set_keys(row, value, n)
                first, done = unseen(key, n, done)
                token, seen = np.unique(value[first[row]], return_counts=True)
                heavy.append((token[seen > 1], seen[seen > 1]))
                if len(heavy) == 16:
                    heavy = [merge_counts(heavy)]
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), W.signed(key), none, none], names)
        if heavy:
            token, seen = merge_counts(heavy)
            often = seen >= max(8, docs * FREQUENT)
            none = pa.nulls(int(often.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, W.signed(token[often]), pa.array(seen[often])], names)

    return run


def unseen(key: np.ndarray, n: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a set that is not empty and neither in ``done`` nor in an earlier row, and ``done`` with their keys."""
    first = np.zeros(len(n), bool)
    first[np.unique(key, return_index=True)[1]] = True
    first &= ~np.isin(key, done) & (n > 0)
    return first, np.concatenate([done, key[first]])


def block_pairs(value: np.ndarray, key: np.ndarray, blocks: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, bucket): the buckets that the entry of set ``key`` in the list of shingle ``value`` goes to.

    An uncut list has one bucket.  In a list of several blocks an entry goes to the pairs of its own block with
    every block, so any two entries meet.
    """
    entry = np.repeat(np.arange(len(value)), blocks)
    other = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    of, own = blocks[entry], (W.mix(key ^ np.uint64(W.STEP)) % blocks.astype(np.uint64)).astype(np.int64)[entry]
    pair = np.minimum(own, other) * of + np.maximum(own, other)
    spread = np.where(of > 1, W.mix(value[entry] + pair.astype(np.uint64) * np.uint64(W.ODD)), value[entry])
    return entry, ((spread >> np.uint64(17)) % np.uint64(buckets)).astype(np.int64)


def merge_counts(parts: list) -> tuple[np.ndarray, np.ndarray]:
    token, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return token, np.bincount(back, np.concatenate([p[1] for p in parts]), len(token)).astype(np.int64)


def prefixes(size: int, percent: int, buckets: int, frequent: np.ndarray, blocks: np.ndarray):
    """Batches of (text) as the short-list entries of each set: bucket, key, n, tokens, sketch.

    ``frequent``: shingles in ascending order, with the number of ``blocks`` of their lists.
    A set seen before in the same input partition gives no more entries.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, data, at in W.slices(batch.column(0)):
                row, value, n = shingle_sets(data, at, size)
                key = set_keys(row, value, n)
                first, done = unseen(key, n, done)
                flat, words = sketches(row, value, n, percent)
                bounds = np.concatenate([[0], np.cumsum(words * 8)])
                sketch = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(flat)])
                place = np.minimum(np.searchsorted(frequent, value), max(len(frequent) - 1, 0))
                often = frequent[place] == value if len(frequent) else np.zeros(len(value), bool)
                cut = np.where(often, blocks[place], 1) if len(frequent) else np.ones(len(value), np.int64)
                order = np.lexsort((value, often, row))
                row, value, cut = row[order], value[order], cut[order]
                start = np.cumsum(n) - n
                short = n - (-(-percent * n // 100)) + 1
                take = (np.arange(len(row)) - start[row] < short[row]) & first[row]
                row, value, cut = row[take], value[take], cut[take]
                if not len(row):
                    continue
                entry, bucket = block_pairs(value, key[row], cut, buckets)
                row, value = row[entry], value[entry]
                order = np.lexsort((value, bucket, row))
                row, value, bucket = row[order], value[order], bucket[order]
                # two pairs of blocks of a list may have one bucket
                once = np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1]) | (value[1:] != value[:-1])])
                row, value, bucket = row[once], value[once], bucket[once]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (bucket[1:] != bucket[:-1])]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)).astype(np.int32)), W.signed(value))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[new]), W.signed(key[row[new]]), pa.array(n[row[new]]), lists, sketch.take(pa.array(row[new]))],
                    ["bucket", "key", "n", "tokens", "sketch"])

    return run


class Union:
    """Sets of integers that are united pair by pair."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, words: np.ndarray, begin: np.ndarray, flat: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sketches of pairs (a, b) allow a link; a longer sketch is folded to the shorter one."""
    good = np.zeros(len(a), bool)
    least = np.minimum(words[a], words[b])
    for w in np.unique(least):
        for lo in range(0, int((least == w).sum()), max(1, (1 << 20) // int(w))):
            own = np.flatnonzero(least == w)[lo:lo + max(1, (1 << 20) // int(w))]
            sides = []
            for side in (a[own], b[own]):
                got = np.zeros((len(own), w), np.uint64)
                for fold in range(int((words[side] // w).max())):
                    has = words[side] > fold * w
                    got[has] ^= flat[(begin[side[has]] + fold * w)[:, None] + np.arange(w)]
                sides.append(got)
            differ = np.bitwise_count(sides[0] ^ sides[1]).sum(axis=1, dtype=np.int64)
            good[own] = differ <= most_differing(n[a[own]] + n[b[own]], percent)
    return good


def coarse_links(percent: int):
    """All entries of a bucket as edges between classes that may be linked: a forest, not pairs."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, first = np.unique(table["key"].to_numpy(), return_index=True)
        table = table.take(pa.array(first))
        n = table["n"].to_numpy()
        lists = table["tokens"].combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy()
        doc = np.repeat(np.arange(len(n)), size)
        data, bounds = W.text_bytes(table["sketch"].combine_chunks().cast(pa.large_binary()))
        flat, words = data.copy().view(np.uint64), np.diff(bounds) // 8
        begin = bounds[:-1] // 8
        order = np.lexsort((n[doc], token))
        token, doc = token[order], doc[order]
        sets = Union(len(n))
        at = np.arange(len(token))
        begin_of = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else at
        list_of = np.repeat(np.arange(len(begin_of)), np.diff(np.append(begin_of, len(token))))
        step = 0
        while len(at):
            step += 1
            if step & (step - 1) == 0:  # lists whose entries are all united are done
                root = sets.roots()[doc]
                open_list = np.minimum.reduceat(root, begin_of) < np.maximum.reduceat(root, begin_of)
                at = at[open_list[list_of[at]]]
            at = at[at + step < len(token)]
            at = at[token[at] == token[at + step]]
            a, b = doc[at], doc[at + step]
            near = 100 * n[a] >= percent * n[b]
            at, a, b = at[near], a[near], b[near]
            roots = sets.roots()
            apart = roots[a] != roots[b]
            pair = np.unique(np.minimum(a, b)[apart] * len(n) + np.maximum(a, b)[apart])
            a, b = pair // len(n), pair % len(n)
            good = may_link(a, b, n, words, begin, flat, percent)
            sets.unite(a[good], b[good])
        roots = sets.roots()
        own = np.flatnonzero(roots != np.arange(len(n)))
        return pa.table({"a": key[own], "b": key[roots[own]]})

    return run


class Lists:
    """Inverted lists of a block of documents."""

    def __init__(self, values: np.ndarray, n: np.ndarray) -> None:
        _, rank = np.unique(values, return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((owner, rank))
        self.doc = owner[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(rank))])
        self.entries = rank[order].astype(np.int64) * len(n) + self.doc
        self.own = np.split(rank, np.cumsum(n)[:-1])


def divide_skip(n: np.ndarray, lists: Lists, q: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents before ``q`` that share at least T shingles with it, and how many.

    The L longest lists of ``q`` are probed, the others merged; L is T / (ln M + 1)
    where M is the longest list's length.
    """
    own = lists.own[q]
    begin, end = lists.begin[own], lists.begin[own + 1]
    length = end - begin
    need = -(-percent * int(n[q]) // 100)
    longest = min(need - 1, int(need / (math.log(max(int(length.max()), 1)) + 1)))
    order = np.argsort(length, kind="stable")
    cut = len(order) - longest
    short, long = order[:cut], order[cut:]
    # merge: documents are counted over all entries of the short lists
    total = int(length[short].sum())
    shift = np.repeat(begin[short] - (np.cumsum(length[short]) - length[short]), length[short])
    merged = np.bincount(lists.doc[np.arange(total) + shift], minlength=len(n))[:q]
    found = np.flatnonzero(merged >= max(need - longest, 1))
    found = found[(100 * n[found] >= percent * n[q]) & (100 * n[q] >= percent * n[found])]
    count = merged[found]
    if len(found) and len(long):
        probe = own[long][:, None] * len(n) + found[None, :]
        place = np.minimum(np.searchsorted(lists.entries, probe), len(lists.entries) - 1)
        count = count + (lists.entries[place] == probe).sum(axis=0)
    return found, count


def exact_links(percent: int):
    """A group, or a pair of its blocks, as (a, b, links): forest edges and each class's linked documents."""
    def run(table: pa.Table) -> pa.Table:
        both = table["i"][0].as_py() != table["j"][0].as_py()
        # a repeated row with the id of a class's document comes twice
        table = table.combine_chunks()
        table = table.take(pa.array(np.unique(table["key"].to_numpy(), return_index=True)[1])).sort_by([("n", "ascending"), ("key", "ascending")])
        key, n, copies = (table[c].to_numpy() for c in ("key", "n", "copies"))
        side = table["block"].to_numpy()
        data, _ = W.text_bytes(table["tokens"].combine_chunks().cast(pa.large_binary()))
        lists = Lists(data.copy().view(np.uint64), n)
        sets, links = Union(len(n)), np.zeros(len(n), np.int64)
        for q in range(len(n)):
            found, count = divide_skip(n, lists, q, percent)
            linked = 100 * count >= percent * (n[found] + n[q] - count)
            if both:  # pairs inside one block are another group's
                linked &= side[found] != side[q]
            found = found[linked]
            links[found] += copies[q]
            links[q] += copies[found].sum()
            sets.unite(found, np.full(len(found), q))
        roots = sets.roots()
        some = np.flatnonzero(links)
        return pa.table({"a": key[some], "b": key[roots[some]], "links": links[some]})

    return run


def set_bytes(size: int):
    """Batches of (text, ...) with the text replaced by its sorted shingles, for sets with the expected key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names[1:]
            for i, j, data, at in W.slices(batch.column(0)):
                row, value, n = shingle_sets(data, at, size)
                rest = batch.slice(i, j - i)
                same = rest.column("key").to_numpy() == set_keys(row, value, n).view(np.int64)
                bounds = np.concatenate([[0], np.cumsum(n * 8)]).astype(np.int32)
                sets = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(value)])
                whole = pa.RecordBatch.from_arrays([sets, *(rest.column(c) for c in names)], ["tokens", *names])
                yield whole.filter(pa.array(same))

    return run


def ngram_jaccard_join(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id",
                       text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row of ``docs``.

    ``size``: words in a shingle; ``percent``: least Jaccard similarity.  Letters A-Z are
    lower-cased, words are runs without the six ASCII white spaces.  A text with fewer words is one
    shingle; null or blank texts have none and link with nothing.  ``component_id`` is the
    smallest id reachable over links, ``n_links`` the number of other rows linked directly.
    Repeated rows and ids stay separate rows; a null id counts as a link but names no component
    (a component of null ids alone has a null name).  Other columns are ignored.  Sets are
    compared by 64-bit shingle hashes.

    No frame holds pairs of a group: buckets and blocks give forests.  A group larger than
    ``BLOCK`` shingles is compared block by block, which bounds the memory of a task of
    ``exact_links`` and sends every set to all blocks of its group.  The list of a frequent shingle is cut into
    blocks of about ``LIST`` sets, and an entry goes to the pairs of its block with each block; a list is left once all its
    entries are united.  A list of many unlike sets still takes about L * L / 2 comparisons for L classes, on many tasks.
    """
    sets, named = named_classes(docs, size, percent, id_column, text_column)
    return sets.join(named, (F.col("key") == F.col("of")) & (F.col("n") > 0), "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def named_classes(docs: DataFrame, size: int, percent: int, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(id, n, key) of every row, and (of, component, component_id, n_links) of every class (key) of equal sets."""
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("digest"))
    measured = materialise(texts.mapInArrow(measure(size, percent), "id long, digest long, n long, key long, token long, seen long"), "ngram-sets")
    sets = measured.where("n is not null").select("id", "digest", "n", "key")
    often = measured.where("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    known = often.orderBy(F.desc("seen"), "token").limit(KNOWN_FREQUENT).collect()
    frequent, length = np.array([r["token"] for r in known], np.int64).view(np.uint64), np.array([r["seen"] for r in known], np.int64)
    order = np.argsort(frequent)
    frequent, length = frequent[order], length[order]
    blocks = -(-length // LIST)
    short = F.expr(f"n - ceil({percent} * n / 100) + 1")
    entries = sets.where("n > 0").agg(F.sum(short)).first()[0] or 0
    again = int((length * (blocks - 1)).sum())  # entries of cut lists beyond one for each set
    buckets = max(LEAST_BUCKETS, (int(entries) + again) // BUCKET + 1)
    lists = texts.select("text").mapInArrow(prefixes(size, percent, buckets, frequent, blocks),
                                            "bucket long, key long, n long, tokens array<long>, sketch binary")
    coarse = lists.groupBy("bucket").applyInArrow(coarse_links(percent), "a long, b long")
    groups = connected_components(coarse, "ngram-groups")

    # a class is shown by one of its texts: the row is told by an id that is never null, and its text's digest
    row = [F.col("id").isNull(), F.coalesce("id", F.lit(0).cast("long")), F.col("digest")]
    shown = F.min(F.struct(*(c.alias(name) for c, name in zip(row, ("no_id", "number", "digest"), strict=True))))
    classes = sets.where("n > 0").groupBy("key").agg(F.min("id").alias("id"), shown.alias("row"), F.max("n").alias("n"), F.count("*").alias("copies"))
    members = materialise(groups.join(classes, groups.node == classes.key).select("key", "component", "row.*", "n", "copies"), "ngram-members")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    members = members.join(blocks, "component").withColumn("block", F.pmod(F.hash("key"), F.col("blocks").cast("int")).cast("long"))
    # the texts are shuffled once, at any size; equal rows give their text once
    same = ["no_id", "number", "digest"]
    found = texts.select("text", *(c.alias(name) for c, name in zip(row, same, strict=True))).join(members.hint("merge"), same)
    found = found.groupBy(*same, "key", "component", "n", "copies", "block", "blocks").agg(F.first("text").alias("text")).select(
        "text", "key", "component", "n", "copies", "block", "blocks")
    found = found.mapInArrow(set_bytes(size), "tokens binary, key long, component long, n long, copies long, block long, blocks long")
    found = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")).select(
        "tokens", "key", "component", "n", "copies", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = materialise(found.groupBy("component", "i", "j").applyInArrow(exact_links(percent), "a long, b long, links long"), "ngram-links")
    joined = connected_components(links.select("a", "b"), "ngram-components")
    counted = links.groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    named = classes.join(joined, classes.key == joined.node, "left").select(
        "key", "id", "copies", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(least, "component").join(counted, "key", "left").select(
        F.col("key").alias("of"), "component", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return sets, named


def text_keys(size: int):
    """Batches of (..., text) with the text replaced by the key of its set, null for an empty one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in W.slices(batch.column(batch.num_columns - 1)):
                row, value, n = shingle_sets(data, at, size)
                key = pa.array(set_keys(row, value, n).view(np.int64), mask=n == 0)
                rest = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], key], [*rest.schema.names[:-1], "key of a text"])

    return run


def one_per_component(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, of rows that repeat it the smallest text.

    Rows that repeat an id stay, each in its own group, if their texts don't link; blank texts of one id are one group.
    Rows with a null id cannot name a component and are all kept.
    """
    sets, named = named_classes(docs, size, percent, id_column, text_column)
    found = sets.join(named, (F.col("key") == F.col("of")) & (F.col("n") > 0), "left").where("id is not null").where("n = 0 or id = component_id")
    # the component's row is looked for among the rows of its smallest id
    name, text, key, of, component, place = unused(docs, "_kept", "_text", "_key", "_of", "_component", "_place")
    kept = found.select(F.col("id").alias(name), F.when(F.col("n") > 0, F.col("key")).alias(of), F.col("component").alias(component)).distinct()
    kept = materialise(kept, "ngram-kept")
    few = docs.join(kept.select(name).distinct(), F.col(id_column).cast("long") == F.col(name), "left_semi")
    keyed = few.withColumn(text, F.col(text_column))
    keyed = keyed.mapInArrow(text_keys(size), few.withColumn(key, F.lit(None).cast("long")).schema)
    once = keyed.join(kept, (F.col(id_column).cast("long") == F.col(name)) & F.col(key).eqNullSafe(F.col(of)))
    ranked = F.row_number().over(Window.partitionBy(id_column, component).orderBy(F.col(text_column).asc_nulls_last()))
    once = once.withColumn(place, ranked).where(F.col(place) == 1).select(*docs.columns)
    return once.union(docs.where(F.col(id_column).isNull()))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
half AS (
  SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
link AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other),
named AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id),
degree AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN named ON named.doc_id = d.doc_id LEFT JOIN degree ON degree.doc_id = d.doc_id
"""
