"""Compression of vectors to one code byte a part, trained exactly on integers with metric trees.

Vectors are cut into equal parts, and each part position has a codebook.  Blocks of vectors get, once, a tree of balls
over each part: the anchors hierarchy.  About sqrt(n) anchors are chosen, each the point farthest from its
anchor so far; a new anchor takes over points nearer to it, and by the triangle inequality only points farther from
their anchor than half the anchors' distance are looked at.  Anchors' balls are then merged upwards, the
closest fitting pair first, and split downwards in the same way: the tree is built from the middle out.
Every ball caches the sum and count of its points.

A round walks the trees with a list of candidate entries for each ball, inherited from its parent.  An entry that
is farther from every point of the ball than another one leaves the list; a ball with one entry left is owned,
and its cached sum and count are all that is read of it.  Points are only compared in leaves that several entries share, in exact
arithmetic.  Trees are written to the shared folder; a round sends back sums of the entries, never points.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.llm.lookup import with_facts
from switchboard.llm.token_ids import ranges
from switchboard.session import materialise

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: vectors of a block, which has a tree for each part
BLOCK = 4096
#: a ball of more points is split if its points aren't all equal
LEAF = 48


class Forest(NamedTuple):
    """Balls of all parts of a block, children behind their parents; the first balls are the roots."""

    part: np.ndarray
    left: np.ndarray  # -1: a leaf
    right: np.ndarray
    first: np.ndarray  # of a leaf: its points are ``points[first:first + count]``
    count: np.ndarray
    total: np.ndarray
    radius: np.ndarray
    points: np.ndarray


#: types of the stored columns of a forest
KINDS = Forest(np.int32, np.int32, np.int32, np.int64, np.int64, np.int64, np.float64, np.int32)


def anchored(x: np.ndarray, start: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The anchor (0, 1, ...) that owns each point; groups of points are runs of ``x``, with up to ``wanted`` anchors each."""
    group = np.repeat(np.arange(len(start)), size)
    pivots = np.zeros((len(start), int(wanted.max())), np.int64)
    pivots[:, 0] = start
    owner = np.zeros(len(x), np.int64)
    far = np.sqrt(((x - x[start][group]) ** 2).sum(1))
    for k in range(1, pivots.shape[1]):
        top = np.maximum.reduceat(far, start)
        at = np.flatnonzero((far == top[group]) & (top > 0)[group] & (wanted > k)[group])
        if not len(at):
            break
        grown, first = np.unique(group[at], return_index=True)
        new = at[first]
        pivots[grown, k] = new
        half = np.full((len(start), k), np.inf)
        half[grown] = np.sqrt(((x[pivots[grown, :k]] - x[new][:, None]) ** 2).sum(2)) / 2
        near = np.flatnonzero(far >= half[group, owner])
        now = np.sqrt(((x[near] - x[pivots[group[near], k]]) ** 2).sum(1))
        taken = now < far[near]
        far[near[taken]], owner[near[taken]] = now[taken], k
    return owner


def merged(center: np.ndarray, count: np.ndarray, radius: np.ndarray, valid: np.ndarray) -> list[tuple]:
    """Pairs of balls to merge, for many groups at once: (group, kept ball, merged ball, radius of both) arrays, step by step."""
    g, k = count.shape
    every, steps = np.arange(g), []
    count, radius, center = count.astype(float), radius.copy(), center.copy()

    def together(i: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Radius of the ball of ``i`` and each other ball around their common centre."""
        apart = np.sqrt(((center[rows] - center[rows, i][:, None]) ** 2).sum(2))
        n, other = count[rows, i][:, None], count[rows]
        reach = np.maximum(apart * other / (n + other) + radius[rows, i][:, None], apart * n / (n + other) + radius[rows])
        reach[~valid[rows]] = np.inf
        reach[np.arange(len(rows)), i] = np.inf
        return reach

    count[~valid] = 1.0
    cost = np.stack([together(np.full(g, i), every) for i in range(k)], 1)
    cost[~valid] = np.inf
    alive = valid.sum(1)
    for _ in range(k - 1):
        rows = np.flatnonzero(alive > 1)
        if not len(rows):
            break
        best = cost[rows].reshape(len(rows), -1).argmin(1)
        i, j = best // k, best % k
        reach = cost[rows, i, j]
        steps.append((rows, i, j, reach))
        n, m = count[rows, i], count[rows, j]
        center[rows, i] = (center[rows, i] * n[:, None] + center[rows, j] * m[:, None]) / (n + m)[:, None]
        count[rows, i], radius[rows, i] = n + m, reach
        valid[rows, j] = False
        cost[rows, j, :] = np.inf
        cost[rows, :, j] = np.inf
        again = together(i, rows)
        cost[rows, i, :], cost[rows, :, i] = again, again
        alive[rows] -= 1
    return steps


def plant(values: np.ndarray) -> Forest:
    """The trees over the parts of (rows, parts, width) integers."""
    n, parts, width = values.shape
    flat = values.transpose(1, 0, 2).reshape(-1, width)
    points = np.arange(parts * n)
    node_part, left, right = list(range(parts)), [-1] * parts, [-1] * parts
    leaf_first, leaf_count, radius = [0] * parts, [0] * parts, [np.inf] * parts
    # groups of points yet to be split: their ball, and the run of ``points``
    balls, start, size = np.arange(parts), np.arange(parts) * n, np.full(parts, n)
    leaves = []

    def add(part: int) -> int:
        for column, value in ((node_part, part), (left, -1), (right, -1), (leaf_first, 0), (leaf_count, 0), (radius, np.inf)):
            column.append(value)
        return len(left) - 1

    while len(balls):
        own = points[ranges(start, size)]
        x = flat[own].astype(float)
        at = np.cumsum(size) - size
        group = np.repeat(np.arange(len(size)), size)
        wanted = np.where(size > LEAF, np.ceil(np.sqrt(size)).astype(int), 1)
        owner = anchored(x, at, size, wanted)
        order = np.lexsort((owner, group))
        own, x, owner, group = own[order], x[order], owner[order], group[order]
        points[ranges(start, size)] = own
        first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0))
        count = np.diff(np.append(first, len(own)))
        center = np.add.reduceat(x, first) / count[:, None]
        reach = np.maximum.reduceat(np.sqrt(((x - np.repeat(center, count, 0)) ** 2).sum(1)), first)
        of, slot = group[first], owner[first]
        held = np.bincount(of, minlength=len(size))
        run = start[of] + first - at[of]
        for b in np.flatnonzero(held[of] == 1):  # a ball that isn't split
            ball = balls[of[b]]
            radius[ball] = reach[b]
            leaves.append((ball, run[b], count[b]))
        split = np.flatnonzero(held > 1)
        if not len(split):
            break
        rank = np.cumsum(held > 1) - 1
        inside = held[of] > 1
        shape = (len(split), int(slot.max()) + 1)
        grid = np.full(shape, -1)
        grid[rank[of[inside]], slot[inside]] = np.flatnonzero(inside)
        valid = grid >= 0
        node = np.full(shape, -1)
        for g, s in zip(*np.nonzero(valid), strict=True):
            node[g, s] = add(node_part[balls[split[g]]])
            radius[node[g, s]] = reach[grid[g, s]]
        anchors = node[rank[of[inside]], slot[inside]]
        remaining = held[split] - 1
        for rows, i, j, both in merged(center[grid], count[grid], reach[grid], valid):
            remaining[rows] -= 1
            for g, a, b, r in zip(rows.tolist(), i.tolist(), j.tolist(), both.tolist(), strict=True):
                parent = balls[split[g]] if not remaining[g] else add(node_part[balls[split[g]]])
                left[parent], right[parent], radius[parent] = node[g, a], node[g, b], r
                node[g, a] = parent
        balls, start, size = anchors, run[inside], count[inside]
    for ball, lo, c in leaves:
        leaf_first[ball], leaf_count[ball] = lo, c
    return cached(flat, points, *(np.array(c) for c in (node_part, left, right, leaf_first, leaf_count)), np.array(radius, float), n)


def cached(flat: np.ndarray, points: np.ndarray, part: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, count: np.ndarray,
           radius: np.ndarray, n: int) -> Forest:
    """The forest with the sums and counts of all balls: those of leaves from their points, others' from their children."""
    total = np.zeros((len(part), flat.shape[1]), np.int64)
    leaf = np.flatnonzero(left < 0)
    leaf = leaf[np.argsort(first[leaf])]
    total[leaf] = np.add.reduceat(flat[points], first[leaf])
    done = left < 0
    while not done.all():
        ready = np.flatnonzero(~done & done[left] & done[right])
        total[ready], count[ready] = total[left[ready]] + total[right[ready]], count[left[ready]] + count[right[ready]]
        done[ready] = True
    return Forest(*(c.astype(k) for c, k in zip((part, left, right, first, count, total, radius, points % n), KINDS, strict=True)))


def exact_kind(most: int, dims: int) -> type:
    """A type whose squared distances of integers up to ``most`` are exact."""
    if 4 * dims * most * most < 1 << 53:
        return np.float64
    if 4 * dims * most * most < 1 << 62:
        return np.int64
    raise ValueError("a component is too large: squared distances would not fit 64 bits")


def owned(forest: Forest, values: np.ndarray, books: np.ndarray, every_point: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums (part, entry, width) and counts of the points nearest to each entry, and with ``every_point`` the entry of each point and part."""
    parts, entries, width = books.shape
    kind = exact_kind(int(max(np.abs(values).max(initial=0), np.abs(books).max(initial=0))), parts * width)
    near, apart = books.astype(float), np.sqrt(((books[:, :, None].astype(float) - books[:, None]) ** 2).sum(3))
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    codes = np.zeros((len(values), parts), np.uint8) if every_point else None
    node, listed = np.arange(parts), np.ones((parts, entries), bool)
    shared: list[tuple[np.ndarray, np.ndarray]] = []
    settled: list[tuple[np.ndarray, np.ndarray]] = []
    while len(node):
        part, row = forest.part[node], np.arange(len(node))
        center = forest.total[node] / forest.count[node][:, None]
        away = ((center[:, None] - near[part]) ** 2).sum(2)
        away[~listed] = np.inf
        best = away.argmin(1)
        # over the whole ball, an entry's squared distance exceeds the best one's by at least its excess at the centre less ``swing``
        swing = 2 * forest.radius[node][:, None] * apart[part, best]
        nearest = away[row, best][:, None]
        listed = listed & ~(away - nearest - swing > 1e-9 * (away + nearest + swing) + 1e-3)
        single = listed.sum(1) == 1
        if single.any():
            at = node[single]
            entry = part[single] * entries + best[single]
            np.add.at(sums, entry, forest.total[at])
            np.add.at(counts, entry, forest.count[at])
            settled.append((at, best[single]))
        leaf = ~single & (forest.left[node] < 0)
        shared.append((node[leaf], listed[leaf]))
        inner = ~single & ~leaf
        node, listed = np.concatenate([forest.left[node[inner]], forest.right[node[inner]]]), np.concatenate([listed[inner]] * 2)
    leaves, lists = (np.concatenate(x) for x in zip(*shared, strict=True))
    size = forest.count[leaves]
    point, of = forest.points[ranges(forest.first[leaves], size)], np.repeat(np.arange(len(leaves)), size)
    for p in range(parts):
        mine = np.flatnonzero(forest.part[leaves][of] == p)
        if not len(mine):
            continue
        x, e = values[point[mine], p].astype(kind), books[p].astype(kind)
        away = (e * e).sum(1) - 2 * (x @ e.T)  # plus the square of the point, which all entries share
        away[~lists[of[mine]]] = np.inf if kind is np.float64 else np.iinfo(np.int64).max
        best = away.argmin(1)  # the first of equals
        counts[p * entries:(p + 1) * entries] += np.bincount(best, minlength=entries)
        np.add.at(sums, p * entries + best, values[point[mine], p])
        if every_point:
            codes[point[mine], p] = best
    if every_point and settled:
        at, entry = (np.concatenate(x) for x in zip(*settled, strict=True))
        while len(at):
            leaf = forest.left[at] < 0
            size = forest.count[at[leaf]]
            codes[forest.points[ranges(forest.first[at[leaf]], size)], np.repeat(forest.part[at[leaf]], size)] = np.repeat(entry[leaf], size)
            at, entry = np.concatenate([forest.left[at[~leaf]], forest.right[at[~leaf]]]), np.concatenate([entry[~leaf]] * 2)
    return sums.reshape(parts, entries, width), counts.reshape(parts, entries), codes


BLOCKS = "ids array<long>, labels array<string>, vectors binary, " + ", ".join(f"{name} binary" for name in Forest._fields)


def quantised(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) integers of lists of finite numbers."""
    found = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(found):
        exact_kind(int(np.abs(found).max()), dims)
    return found.astype(np.int32).reshape(-1, dims)


def planted(dims: int, parts: int):
    """Batches of (id, label, vector) as blocks with their trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                some = batch.slice(lo, BLOCK)
                values = quantised(some.column(2), dims)
                forest = plant(values.reshape(len(values), parts, dims // parts))
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in (0, 1)]
                binary = [pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in (values, *forest)]
                yield pa.RecordBatch.from_arrays([*lists, *binary], ["ids", "labels", "vectors", *Forest._fields])

    return run


def stored(batch: pa.RecordBatch, k: int, parts: int, width: int) -> tuple[Forest, np.ndarray]:
    """Trees and vectors of a block."""
    raw = lambda name, kind: np.frombuffer(batch.column(batch.schema.get_field_index(name))[k].as_buffer(), kind)
    forest = Forest(*(raw(name, kind) for name, kind in zip(Forest._fields, KINDS, strict=True)))
    return forest._replace(total=forest.total.reshape(-1, width)), raw("vectors", np.int32).reshape(-1, parts, width)


def entry_sums(books: np.ndarray):
    """Blocks as (part, entry, place, total, n), once for each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.shape
        sums, counts = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                more, n, _ = owned(*stored(batch, k, parts, width), books, False)
                sums += more
                counts += n
        if counts.any():
            part, entry, place = (x.ravel() for x in np.indices(books.shape))
            yield pa.RecordBatch.from_arrays([*map(pa.array, (part, entry, place, sums.ravel(), np.repeat(counts.ravel(), width)))],
                                             ["part", "entry", "place", "total", "n"])

    return run


def coded(books: np.ndarray):
    """Blocks as (id, label, code, error) of each vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = books.shape
        for batch in batches:
            for k in range(batch.num_rows):
                forest, values = stored(batch, k, parts, width)
                codes = owned(forest, values, books, True)[2]
                error = ((values.astype(np.int64) - books[np.arange(parts), codes]) ** 2).sum((1, 2))
                digits = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1).flatten(), batch.column(1).slice(k, 1).flatten(),
                     pa.array([digits[a:a + 2 * parts] for a in range(0, len(digits), 2 * parts)], pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return run


class Codebooks(NamedTuple):
    """Trained (part, entry, width) integer codebooks and the blocks they were trained on."""

    books: np.ndarray
    blocks: DataFrame

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id",
          vector_column: str = "embedding", label_column: str = "label") -> Codebooks:
    """Codebooks of all usable vectors: not null, without null or non-finite components, and of the first vector's length.

    The first ``entries`` vectors by id (null ids last, equal ids by their components) start the codebooks; fewer vectors give fewer entries.
    A length that ``parts`` doesn't divide, a codebook of over 256 entries, or a component whose square wouldn't fit, is an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.coalesce(F.concat(F.lit("="), F.col(label_column).cast("string")), F.lit(""))  # null has the empty name
    kept = vectors.where(v.isNotNull() & finite & (F.size(v) > 0)).select(F.col(id_column).cast("long").alias("id"), label.alias("label"), v.alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    head = kept.orderBy(*order).limit(1).collect()
    dims = len(head[0]["v"]) if head else parts
    if dims % parts:
        raise ValueError(f"{dims} components can't be cut into {parts} equal parts")
    kept = kept.where(F.size("v") == dims)
    first = [r["v"] for r in kept.orderBy(*order).limit(entries).collect()]
    books = quantised(pa.array(first, pa.list_(pa.float64())), dims).astype(np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2)
    blocks = materialise(kept.mapInArrow(planted(dims, parts), BLOCKS), "vector-trees")
    for _ in range(rounds if len(first) else 0):
        found = blocks.drop("ids", "labels").mapInArrow(entry_sums(books), "part long, entry long, place long, total long, n long").groupBy(
            "part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # a row for each component of the codebooks
        books = books.copy()
        for r in found:
            if r["n"]:
                books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return Codebooks(books, blocks)


def codes_of(trained: Codebooks, id_column: str = "vec_id") -> DataFrame:
    """(id, label, code, error) of every vector the codebooks were trained on; a label is "=" and its text, a null one is empty."""
    found = trained.blocks.mapInArrow(coded(trained.books), "id long, label string, code string, error long")
    return found.withColumnRenamed("id", id_column)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_column: str = "vec_id",
             vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every usable vector.

    ``label_error`` sums the errors of all rows with the same label, null labels together.  Rows with null or
    repeated ids stay rows of their own; unusable vectors (see ``train``) and empty tables give no rows; other columns are ignored.
    """
    trained = train(vectors, parts, entries, rounds, id_column, vector_column, label_column)
    codes = materialise(codes_of(trained, id_column), "vector-codes")
    per = materialise(codes.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("held")), "vector-labels")
    return with_facts(codes, per, "label", "held").select(
        id_column, "code", "error", "label_error", F.lit(trained.sha256()).alias("codebooks_sha256"))


def _rounds_sql(rounds: int) -> str:
    nearest = """
a{r} AS MATERIALIZED (
  SELECT x.vec_id, x.p, min(list_sum(list_transform(list_zip(x.s, e.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 16 + e.k) AS m
  FROM x JOIN e{r} AS e ON e.p = x.p GROUP BY x.vec_id, x.p)"""
    # sums divided downwards
    mean = """
n{r} AS (
  SELECT p, k, list((t - ((t % n) + n) % n) // n ORDER BY i) AS s
  FROM (SELECT p, (m % 16)::INT AS k, i, sum(s[i])::BIGINT AS t, count(*) AS n
    FROM a{r} JOIN x USING (vec_id, p), range(1, 65) AS r(i) WHERE i <= len(s) GROUP BY ALL)
  GROUP BY p, k),
e{q} AS MATERIALIZED (SELECT p, k, coalesce(n.s, e.s) AS s FROM e{r} AS e LEFT JOIN n{r} AS n USING (p, k))"""
    return ",".join((nearest + "," + mean).format(r=r, q=r + 1) for r in range(rounds)) + "," + nearest.format(r=rounds)


ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, p::INT AS p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS s FROM kept, range({PARTS}) AS r(p)),
e0 AS MATERIALIZED (
  SELECT p, k, s FROM x JOIN (
    SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1)::INT AS k FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{_rounds_sql(ROUNDS)},
book AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM e{ROUNDS}),
coded AS (
  SELECT vec_id, string_agg(printf('%02x', (m % 16)::INT), '' ORDER BY p) AS code, sum(m // 16)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""
