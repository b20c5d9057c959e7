"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A mask looks at seven of eleven consecutive words and ignores the others.  The hashes of
all masks at all places of the benchmark are joined with those of the documents; around
each hit the two texts are compared word by word on the hit's diagonal.  A match counts 1, a substitution
-1, and the best stretch must score at least ``MIN_SCORE``: thirteen equal words do, or fifteen with
two substitutions.  The three masks hit every 15-word passage with two substitutions
wherever they lie, and 99.5 % of 18-word passages with three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard.session import materialise

MASKS = ((0, 1, 2, 3, 6, 8, 10), (0, 1, 6, 7, 8, 9, 10), (0, 2, 3, 5, 6, 9, 10))
SPAN = 11
MIN_SCORE = 10
#: words of benchmark items that are broadcast together; a larger benchmark goes in several blocks
BLOCK_WORDS = 200_000
#: an item of fewer words is too common a phrase to be looked for inside texts
LEAST_RUN = 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Lower-cased words; all ASCII but letters and digits separates."""
    return F.array_remove(F.split(F.lower(text), SEPARATORS), "")


def word_hashes(text: Column) -> Column:
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def seeds(hashes: str, place: str) -> Column:
    """One hash for each mask, of the selected words from ``place`` on."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.get(F.col(hashes), F.col(place) + i) for i in mask)) for k, mask in enumerate(MASKS)))


def at_all_places(df: DataFrame, hashes: str, place: str, seed: str) -> DataFrame:
    """A row for each place and mask; a row without ``SPAN`` words gives nulls.

    The outer generators stay in one stage of generated code with the join behind them, so the
    array of a long text isn't copied to its rows.
    """
    places = F.when(F.size(hashes) >= SPAN, F.sequence(F.lit(0), F.size(hashes) - SPAN))
    placed = df.select("*", F.explode_outer(places).alias(place))
    return placed.select("*", F.explode_outer(seeds(hashes, place)).alias(seed))


def best_stretch(doc: str, item: str, shift: Column) -> Column:
    """The best sum of +1 (equal) and -1 (substituted) over a stretch of the diagonal ``doc[k + shift] ~ item[k]``,
    with the item's words in it: struct(score, first, last)."""
    low = F.greatest(F.lit(0), -shift)
    high = F.least(F.size(item), F.size(doc) - shift) - 1
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("since"), F.lit(0).alias("score"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(s: Column, k: Column) -> Column:
        gain = F.when(F.get(F.col(doc), k + shift) == F.get(F.col(item), k), 1).otherwise(-1)
        since = F.when(s.now > 0, s.since).otherwise(k)
        now = F.greatest(s.now, F.lit(0)) + gain
        better = now > s.score
        return F.struct(now.alias("now"), since.alias("since"), F.when(better, now).otherwise(s.score).alias("score"),
                        F.when(better, since).otherwise(s.first).alias("first"), F.when(better, k).otherwise(s.last).alias("last"))

    return F.aggregate(F.sequence(low, high), zero, step)


def row_key(id_column: str | Column, text_column: str | Column) -> list[Column]:
    """What tells a row by its id and text, never null: rows with equal keys are equal in both."""
    number = F.col(id_column) if isinstance(id_column, str) else id_column
    return [F.coalesce(number.cast("long"), F.lit(0).cast("long")), number.isNull(), F.xxhash64(text_column)]


KEY = ["_id", "_no_id", "_sum"]


def short_hits(hashed: DataFrame, items: DataFrame) -> DataFrame:
    """(key, item, score, first, last) of rows that hold all words of an item of fewer than ``SPAN`` words, one behind the other; with fewer than ``LEAST_RUN``, nothing else."""
    lengths = sorted(r[0] for r in items.select("_n").distinct().collect())  # fewer than SPAN
    run = lambda words, place, n: F.xxhash64(F.lit(n), *(F.get(F.col(words), place + i) for i in range(n)))
    keys = items.select("_item", "_n", F.coalesce(*(F.when(F.col("_n") == n, run("_words", F.lit(0), n)) for n in lengths)).alias("_seed"))
    found = None
    for n in lengths:
        own = keys.where(F.col("_n") == n).select("_item", "_seed")
        fits = F.size("_h") >= n if n >= LEAST_RUN else F.size("_h") == n
        places = hashed.where(fits).select(*KEY, "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - n)).alias("_i"))
        hits = places.select(*KEY, run("_h", F.col("_i"), n).alias("_seed")).join(own, "_seed").select(
            *KEY, "_item", F.lit(n).alias("score"), F.lit(0).alias("first"), F.lit(n - 1).alias("last")).distinct()
        found = hits if found is None else found.unionByName(hits)
    return found


def overlaps(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
             item_column: str = "item_id", item_text: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """(``KEY``, _item, b: struct of score, -first, last) of each row and item that overlap; ``KEY`` is ``row_key``."""
    own = benchmark.select(F.col(item_column).cast("long").alias("_item"), word_hashes(F.col(item_text)).alias("_words"))
    own = own.where(F.size("_words") > 0).groupBy("_words").agg(F.min("_item").alias("_item"))
    own = materialise(own.withColumn("_n", F.size("_words").cast("long")), "benchmark-items")
    small, own = own.where(F.col("_n") < SPAN), own.where(F.col("_n") >= SPAN)
    total = own.agg(F.sum("_n")).first()[0] or 0
    blocks = max(1, -(-total * 2 // BLOCK_WORDS)) if total > BLOCK_WORDS else 1
    texts = docs.select(*(c.alias(name) for c, name in zip(row_key(id_column, text_column), KEY, strict=True)), F.col(text_column).alias("_text"))
    hashed = texts.select(*KEY, word_hashes(F.col("_text")).alias("_h"))
    found = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("_words"), F.lit(blocks)) == block) if blocks > 1 else own
        keys = at_all_places(part.select("_item", "_words"), "_words", "_j", "_seed").select("_item", "_j", "_seed")
        hits = at_all_places(hashed, "_h", "_i", "_seed").join(F.broadcast(keys), "_seed").select(
            *KEY, "_item", (F.col("_i") - F.col("_j")).alias("_shift")).distinct()
        found = hits if found is None else found.unionByName(hits)
    # diagonals with a hit come with the item's words; the texts are shuffled once, at any size
    found = found.join(own.select("_item", "_words"), "_item")
    near = texts.join(found.hint("merge"), KEY).select(*KEY, "_item", "_words", "_shift", word_hashes(F.col("_text")).alias("_h"))
    found = near.select(*KEY, "_item", best_stretch("_h", "_words", F.col("_shift")).alias("_b"))
    # the least score is asked for behind the aggregation: a filter before it would move into the join and hash the text anew for every word
    each = found.groupBy(*KEY, "_item").agg(F.max(F.struct(F.col("_b.score").alias("score"), (-F.col("_b.first")).alias("first"), F.col("_b.last").alias("last"))).alias("b")).where(
        F.col("b.score") >= min_score)
    if small.isEmpty():
        return each
    whole = short_hits(hashed, small).select(*KEY, "_item", F.struct("score", (-F.col("first")).alias("first"), "last").alias("b"))
    return each.select(*KEY, "_item", F.struct(*(F.col(f"b.{c}").cast("int").alias(c) for c in ("score", "first", "last"))).alias("b")).unionByName(whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text", min_score: int = MIN_SCORE) -> DataFrame:
    """(id, item_id, score, first_word, last_word, n_items) of each document that overlaps a benchmark item.

    ``item_id`` is the item with the best score (of equals the smallest id); the words are
    those of the item, from 0, that the overlap covers.  An item of fewer than eleven words has no seed: it counts
    where all its words stand one behind the other, with its number of words as score; one of fewer than five words only if the text has no
    other words.  Texts and items without words (null: none)
    match nothing; items with equal words count once, under their
    smallest id.  Rows that repeat a document id give one row, the best of them all; null ids give one row together.  An
    empty benchmark gives no rows.  Other columns are ignored.

    The benchmark is cut into blocks of at most ``BLOCK_WORDS`` words (or one item), each
    broadcast to one pass over the documents, so what is sent never grows with either table.
    """
    each = overlaps(docs, benchmark, id_column, text_column, item_column, item_text, min_score).groupBy("_id", "_no_id", "_item").agg(F.max("b").alias("b"))
    best = each.groupBy("_id", "_no_id").agg(
        F.max(F.struct(F.col("b.score").alias("score"), (-F.col("_item")).alias("item"), "b.first", "b.last")).alias("m"),
        F.count("*").alias("n_items"))
    return best.select(F.when(~F.col("_no_id"), F.col("_id")).alias(id_column), (-F.col("m.item")).alias("item_id"), F.col("m.score").cast("long").alias("score"),
                       (-F.col("m.first")).cast("long").alias("first_word"), F.col("m.last").cast("long").alias("last_word"), "n_items")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item; every row is judged by its own text, whatever its id."""
    bad = overlaps(docs, benchmark, id_column, text_column).select(*KEY).distinct()
    same = [c == bad[name] for c, name in zip(row_key(docs[id_column], docs[text_column]), KEY, strict=True)]
    return docs.join(bad, same, "left_anti")


def _seed_sql(words: str, place: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {{id}}, {place}, {k} AS mask, " + " || ' ' || ".join(f"{words}[{place} + {i}]" for i in mask) + " AS seed FROM {table}" for k, mask in enumerate(MASKS))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT min(item_id) AS item_id, w FROM (
    SELECT item_id, list_filter(string_split_regex(lower(text), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark)
  WHERE len(w) > 0 GROUP BY w),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS i FROM d WHERE len(w) >= {SPAN}),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - {SPAN - 2})) AS j FROM b WHERE len(w) >= {SPAN}),
ds AS ({_seed_sql("w", "i").format(id="doc_id", table="dp")}),
bs AS ({_seed_sql("w", "j").format(id="item_id", table="bp")}),
hit AS (SELECT DISTINCT doc_id, item_id, i - j AS shift FROM ds JOIN bs ON ds.mask = bs.mask AND ds.seed = bs.seed),
step AS (
  SELECT hit.*, k, CASE WHEN d.w[k + shift] = b.w[k] THEN 1 ELSE -1 END AS gain
  FROM hit JOIN d ON d.doc_id = hit.doc_id JOIN b ON b.item_id = hit.item_id,
    LATERAL (SELECT unnest(range(greatest(1, 1 - shift), least(len(b.w), len(d.w) - shift) + 1)) AS k)),
total AS (SELECT *, sum(gain) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k) AS p FROM step),
low AS (
  SELECT *, least(0, coalesce(min(p) OVER (PARTITION BY doc_id, item_id, shift ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS m,
    min(k) OVER (PARTITION BY doc_id, item_id, shift) AS k0 FROM total),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p - m DESC, k) AS r FROM low),
stretch AS (
  SELECT t.doc_id, t.item_id, (t.p - t.m)::BIGINT AS score, t.k - 1 AS last,
    coalesce(max(s.k) FILTER (WHERE s.p = t.m), t.k0 - 1) AS first
  FROM top t LEFT JOIN total s ON s.doc_id = t.doc_id AND s.item_id = t.item_id AND s.shift = t.shift AND s.k < t.k
  WHERE t.r = 1 AND t.p - t.m >= {MIN_SCORE} GROUP BY t.doc_id, t.item_id, t.shift, t.p, t.m, t.k, t.k0),
short AS (
  SELECT doc_id, item_id, len(b.w)::BIGINT AS score, len(b.w) - 1 AS last, 0 AS first
  FROM d JOIN b ON len(b.w) < {SPAN} AND (len(b.w) >= {LEAST_RUN} OR len(b.w) = len(d.w)) AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')),
each AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, first, last DESC) AS r
  FROM (SELECT doc_id, item_id, score, last, first FROM stretch UNION ALL SELECT * FROM short)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_items, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id, first, last DESC) AS q
  FROM each WHERE r = 1)
SELECT doc_id, item_id, score, first::BIGINT AS first_word, last::BIGINT AS last_word, n_items FROM best WHERE q = 1
"""
