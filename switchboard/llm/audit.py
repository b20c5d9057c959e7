"""Filter interaction audit over failing-id relations.

Every filter has one table of the rows that fail it.  The rows of a set of filters are derived from those
of the set without its last filter: what a left-anti join with that filter's table keeps survives, what a
left-semi join finds is removed.  One such step for each filter doubles the sets, so n filters take 2 n joins for
the survivors of all sets; n more left-semi joins tell what every set leaves to each filter and what it took from it.
Orders of filters are chains of sets.

All tables have the same buckets of row ids, so that after the one shuffle that writes them no join
moves a row.  A row id is, unlike a document id, never null or repeated.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard.llm.lookup import with_facts
from switchboard.session import materialise, scratch_path

BLANK = r"[\x20\x09-\x0D]+"
#: rows of a bucket, so the size of a task of every join
BUCKET_ROWS = 1_000_000
LEAST_BUCKETS = 8
#: n filters have n! orders, each of n rows for every part
MOST_FILTERS = 7


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def few_words(text: Column) -> Column:
    return F.size(word_list(text)) < 100


def few_distinct_words(text: Column) -> Column:
    words = word_list(text)
    return 100 * F.size(F.array_distinct(words)) < 80 * F.size(words)


def many_capitals(text: Column) -> Column:
    return 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.length(text)


def has_marks(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


#: name of a filter and the condition on which a text (never null) fails it
FILTERS: Mapping[str, Callable[[Column], Column]] = {"A": few_words, "B": few_distinct_words, "C": many_capitals, "D": has_marks}
#: the filter that rows fail if a row with a smaller document id has the same text
COPIES = "E"


def verdicts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]], copies: str | None,
             id_column: str, text_column: str, part_column: str) -> DataFrame:
    """(rid, part, good, toxic, fails: the names of the filters a row fails) of every row."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    failed = F.array_compact(F.array(*(F.when(test(text), F.lit(name)) for name, test in filters.items()), F.lit(None).cast("string")))
    rows = materialise(docs.select(
        F.col(id_column).cast("long").alias("doc"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
        failed.alias("fails"), *([F.sha2(text, 256).alias("digest")] if copies else [])).withColumn("rid", F.monotonically_increasing_id()), "audit-rows")
    if copies:
        firsts = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count("*").alias("held")).where("held > 1")
        rows = with_facts(rows, materialise(firsts, "audit-copies"), "digest", "held").withColumn(
            "fails", F.when(F.col("doc") > F.col("first"), F.array_append("fails", F.lit(copies))).otherwise(F.col("fails")))
    # null ids have no label; they are spread over values that no label has
    known = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("doc")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("side", F.lit(0).cast("long"))
    rows = rows.withColumn("side", F.when(F.col("doc").isNull(), F.col("rid") + 1).otherwise(F.lit(0)))
    return rows.join(known, ["doc", "side"], "left").select(
        "rid", "part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "fails")


class Relations:
    """Bucketed tables of row ids in the session's catalog, over files in the shared folder; ``close`` drops their names."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets, self.paths = spark, buckets, {}

    def add(self, rows: DataFrame, name: str | None = None, by: str | None = None) -> str:
        """Writes a new relation, or more rows of a known one."""
        name = name or f"audit_{uuid.uuid4().hex}"
        path = self.paths.setdefault(name, scratch_path(self.spark, name))
        writer = rows.write.bucketBy(self.buckets, "rid").sortBy("rid").option("path", path).mode("append")
        (writer.partitionBy(by) if by else writer).saveAsTable(name)
        return name

    def close(self) -> None:
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def counted_sets(rows: DataFrame, names: list[str]) -> DataFrame:
    """(before, filter, alive, part, n, good, toxic): rows that survive a set of filters, or that it removed.

    ``before`` has bit k if the k-th filter is in the set.  With a filter, which isn't in the set, only rows that
    fail it are counted; without one, all survivors.  Rows that fail no filter survive every set; they stay out of the joins and
    are counted once, under a null ``before``.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "audit-verdicts")
    relations = Relations(spark, max(LEAST_BUCKETS, -(-rows.count() // BUCKET_ROWS)))
    failing = rows.where(F.size("fails") > 0).repartition(relations.buckets, "rid")
    columns = ["rid", "part", "good", "toxic"]
    try:
        tables = spark.table(relations.add(failing.select("rid", F.explode("fails").alias("filter")), by="filter"))
        # buckets are merged: a broadcast would bring ids to the driver
        failing_ids = {name: tables.where(F.col("filter") == name).select("rid").hint("merge") for name in names}
        sets = relations.add(failing.select(*columns, F.lit(0).alias("before"), F.lit(True).alias("alive")))
        for k, name in enumerate(names):
            alive, gone = spark.table(sets).where("alive"), spark.table(sets).where("not alive")
            after = union([alive.join(failing_ids[name], "rid", "left_anti"),
                           alive.join(failing_ids[name], "rid", "left_semi").withColumn("alive", F.lit(False)), gone])
            relations.add(after.withColumn("before", F.col("before").bitwiseOR(F.lit(1 << k))), sets)
        every = spark.table(sets)
        found = [every.where(F.col("before").bitwiseAND(F.lit(1 << k)) == 0).join(failing_ids[name], "rid", "left_semi").withColumn("filter", F.lit(name))
                 for k, name in enumerate(names)]
        whole = [every.where("alive"), rows.where(F.size("fails") == 0).select(*columns, F.lit(None).cast("int").alias("before"), F.lit(True).alias("alive"))]
        found += [part.withColumn("filter", F.lit(None).cast("string")) for part in whole]
        counts = union(found).groupBy("before", "filter", "alive", "part").agg(
            F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        return materialise(counts, "audit-counts")
    finally:
        relations.close()


def audit_filters(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column]] = FILTERS, copies: str | None = COPIES,
                  id_column: str = "doc_id", text_column: str = "text", part_column: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders of the filters.

    Filters have names of one character.  A null text is empty, a null part is the empty string's.  Every row
    is audited: rows that repeat an id count each, under the id's labels (of several label rows the larger value);
    rows with a null id have no labels and are no copies nor originals of others.  Labels without a
    document are ignored, null labels are 0.  An empty table has no parts, so gives no rows.  Other columns are ignored.
    """
    names = [*filters, *([copies] if copies else [])]
    if not 0 < len(set(names)) == len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"1 to {MOST_FILTERS} filters with different names of one character")
    counts = counted_sets(verdicts(docs, labels, filters, copies, id_column, text_column, part_column), names)
    steps, bit = [], {name: 1 << k for k, name in enumerate(names)}
    for order in itertools.permutations(names):
        before = 0
        for k, name in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": k + 1, "filter": name, "before": before, "after": before | bit[name], "others": sum(bit.values()) - bit[name]})
            before |= bit[name]
    kind = "array<struct<filter_order string, step int, filter string, before int, after int, others int>>"
    parts = counts.groupBy("part").agg(F.sum(F.when(F.col("before").isNull(), F.col("n"))).alias("clean"))
    grid = parts.select("part", "clean", F.inline(F.from_json(F.lit(json.dumps(steps)), kind)))
    cells = counts.where("before is not null")
    grid = grid.join(cells.where("filter is null").select("part", F.col("before").alias("after"), F.col("n").alias("left")), ["part", "after"], "left")
    with_filter = lambda alive, before, **names: cells.where(F.col("filter").isNotNull() & (F.col("alive") == alive)).select(
        "part", F.col("before").alias(before), "filter", *(F.col(c).alias(n) for c, n in names.items()))
    for found, key in ((with_filter(True, "before", n="removed", good="good_lost", toxic="toxic_lost"), "before"),
                       (with_filter(False, "before", n="redundant"), "before"), (with_filter(True, "others", n="unique_fails"), "others")):
        grid = grid.join(found, ["part", key, "filter"], "left")
    grid = grid.na.fill(0, ["clean", "left", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]).withColumn("kept", F.col("clean") + F.col("left"))
    return grid.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                       F.sum("removed").over(Window.partitionBy("part", "filter")).alias("shapley"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask
  FROM d LEFT JOIN l USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
b AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order
  FROM b AS a, b, b AS c, b AS d, b AS e
  WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (
  SELECT filter_order, step::INT AS step, b.bit,
    coalesce((SELECT sum(x.bit) FROM b AS x WHERE position(x.name IN filter_order) < step), 0)::INT AS before
  FROM o, range(1, 6) AS r(step) JOIN b ON b.name = substr(filter_order, step::INT, 1)),
g AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM g
"""
