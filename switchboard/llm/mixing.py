"""Mixing sources to target weights, in DataFrame operations only.

Words are aggregated by source, targets follow from the weights, and a document of a source
with repetition rate r is emitted floor(r) times, plus once more if its hash-seeded uniform
number is below the fraction of r.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard.llm.names import unused
from switchboard.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
#: columns that a plan of copies adds
COPIES = ("_size", "_source", "_source_size", "_target", "_copies")
#: a source table of more rows is joined by a shuffle
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source_column: str, size_column: str, weights: Sequence[int] = (5, 2, 1),
                   share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) of every source.

    Sources in ascending order by code point, null last, have the ``weights`` in turn and share
    ``share`` (a fraction) of all words.  No target exceeds ``most`` times its source's
    words; the excess is shared again by weight until none is above.  That fixed point is
    found at once: by rising cap per weight, the first source whose cap exceeds its share of
    what the sources before it leave ends the capped ones.
    """
    per = sizes.groupBy(F.col(source_column).alias("source")).agg(F.sum(size_column).cast("long").alias("source_size"))
    # windows over the whole source table: one small row for each source
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("long")
    per = per.select("*", turn.alias("turn"), weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "turn")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    num, den = share
    per = per.select("*", F.row_number().over(rising).alias("k"),
                     (num * F.sum("source_size").over(every) - den * F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
                     (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("weights"))
    open_ = F.col("cap") * 1.0 * den * F.col("weights") > F.col("w") * 1.0 * F.col("left")
    first = F.min(F.when(open_, F.col("k"))).over(every)
    per = per.select("*", first.alias("first"))
    at_first = lambda c: F.max(F.when(F.col("k") == F.col("first"), F.col(c))).over(every)
    shared = F.col("w") * at_first("left") / (F.lit(den).cast("double") * at_first("weights"))
    target = F.when(F.col("k") >= F.col("first"), F.least(shared, F.col("cap").cast("double"))).otherwise(F.col("cap").cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def uniform(id_column: str, text_column: str) -> Column:
    """A number in [0, 1) that only depends on the id (or, without one, on the text)."""
    what = F.coalesce(F.col(id_column).cast("string"), F.col(text_column), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(what, F.lit(":" + SEED))), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``docs`` with _size, _source_size, _target and _copies, the number of times each row is emitted.

    Where ``docs`` has a column of such a name, the new one has an underscore more at its end.

    A null text has no words.  A source without words has target 0 and rate 0: its rows are
    not emitted.  Null is a source of its own.  Rows that repeat an id share its random number.  Reruns
    agree, whatever the partitioning.
    """
    size, source, source_size, target, copies = unused(docs, *COPIES)
    sized = docs.withColumn(size, size_of(F.col(text_column)))
    targets = materialise(source_targets(sized, source_column, size), "mix-targets").withColumnsRenamed(
        {"source": source, "source_size": source_size, "target": target})
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(source_column).eqNullSafe(F.col(source))).drop(source)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    extra = uniform(id_column, text_column) < rate - F.floor(rate)
    return joined.withColumn(copies, (F.floor(rate) + extra.cast("long")).cast("long"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as its source's repetition rate asks."""
    copies = F.col(unused(docs, *COPIES)[-1])
    (copy,) = unused(docs, "_copy")
    planned = copies_of(docs, id_column, text_column, source_column).where(copies > 0)
    return planned.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy)).drop(copy)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn
  FROM sized GROUP BY source),
weighted AS (SELECT *, CASE (turn - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2 * source_size AS cap FROM per),
ranked AS (
  SELECT *, row_number() OVER rising AS k,
    3 * sum(source_size) OVER () - 2 * coalesce(sum(cap) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (rising ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights
  FROM weighted WINDOW rising AS (ORDER BY cap::DOUBLE / w, turn)),
firsts AS (
  SELECT min(k) AS first FROM ranked WHERE cap::DOUBLE * 2 * weights > w::DOUBLE * rest),
level AS (SELECT k, rest, weights FROM ranked, firsts WHERE k = first),
targets AS (
  SELECT source, source_size, CASE WHEN r.k >= l.k
    THEN least((w * l.rest)::DOUBLE / (2::DOUBLE * l.weights::DOUBLE), cap::DOUBLE) ELSE cap::DOUBLE END AS target
  FROM ranked r LEFT JOIN level l ON true),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':mix-1'), 1, 13))::BIGINT / 4503599627370496::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
