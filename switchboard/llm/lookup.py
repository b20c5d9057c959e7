"""A left join with facts about keys, for rows of which one key may hold any share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys with at least one part in ``MOST_HOT`` of all counted rows are broadcast; there can't be more of them
MOST_HOT = 1000


def with_facts(rows: DataFrame, facts: DataFrame, key: str, held: str) -> DataFrame:
    """``rows`` with the columns of ``facts`` but ``held``; rows whose key has no fact get nulls.

    ``facts`` has one row for each key and says in ``held`` how many rows have it.  Frequent
    keys are broadcast, at most ``MOST_HOT`` of them, and never shuffled; the others are joined as Spark likes.  Keys
    aren't null.  Both tables are read twice, so they should be written ones.
    """
    total = facts.agg(F.sum(held)).first()[0] or 0
    hot = facts.where(F.col(held) * MOST_HOT >= total).drop(held)
    rest = facts.where(F.col(held) * MOST_HOT < total).drop(held)
    frequent = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left")
    return frequent.unionByName(others)
