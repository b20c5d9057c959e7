"""Connected components of an edge table, by repeated star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchboard.session import materialise


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); a component is named by its smallest node.

    Nulls and loops are dropped.  A node's smallest neighbour is a map-side combined
    minimum, so a hub is never one task; every round is written to the shared folder,
    and rounds end when the edges stop changing (about log n rounds).
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs, label)
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node join the node's minimum
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, label)
        # small star: neighbours below a node, and the node, join the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a <> b").distinct()
        pairs = materialise(small, label)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b"), F.col("b"))).distinct()
