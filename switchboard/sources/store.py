"""Stored insights: one row for each call, appended in whole batches.

A store is a folder with

* ``rows/version=N/day=D``: the rows of the N-th append,
* ``ids/version=N/bucket=K``: ids by the hash of the id; an append reads and writes only the buckets its own ids fall into, and a
  bucket has few files at any time, since the ``MERGE``-th makes one of them,
* ``commits/N``: one small file, which makes the N-th append visible.  It has the versions of each bucket that
  hold its ids, and for every writer the last micro-batch it has stored.

Rows and ids are written first; until their commit file appears readers don't see them, and an append that was cut off is written anew
by the next one.  A commit file is never replaced, so of two appends at a time one fails and leaves nothing.
"""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from switchboard.sources.files import Folder

#: hash buckets of a new store
BUCKETS = 64
#: so many files of a bucket become one
MERGE = 8
#: commit files that are kept behind the last one, for readers that have just looked it up
KEPT_COMMITS = 2


class DuplicateCalls(ValueError):
    """A batch holds a call that is stored already, or twice."""


class ConcurrentAppend(RuntimeError):
    """Another append was committed in the meantime; this one is not visible."""


class Commit(NamedTuple):
    """What the last commit file says; version 0 is an empty store."""

    version: int
    buckets: int
    ids: dict[int, list[int]]  # versions with ids of a bucket
    batches: dict[str, int]  # the last micro-batch of each writer
    fields: list[dict]  # columns of all appends so far


def last_commit(folder: Folder, buckets: int = BUCKETS) -> Commit:
    names = folder.names("commits")
    if not names:
        return Commit(0, buckets, {}, {}, [])
    found = json.loads(folder.read(f"commits/{names[-1]}"))
    return Commit(int(names[-1]), found["buckets"], {int(k): v for k, v in found["ids"].items()}, found["batches"], found["fields"])


def bucket_of(call_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(call_id), F.lit(buckets)).cast("int")


def one_per_call(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Of rows with one ``call_id`` the earliest, then the one that comes first as JSON text; null ids are one call.

    An aggregation with partial results, so an id may have any share of all rows.
    """
    order = F.struct(F.col(ts).isNull(), F.col(ts), F.to_json(F.struct("*")))
    return df.groupBy("call_id").agg(F.min_by(F.struct(*df.columns), order).alias("row")).select("row.*")


def stored_ids(spark: SparkSession, path: str, commit: Commit, buckets: list[int]) -> DataFrame | None:
    """(call_id, bucket) of all stored calls in some buckets, from the files of these buckets alone."""
    paths = [f"{path}/ids/version={v}/bucket={k}" for k in buckets for v in commit.ids.get(k, [])]
    if not paths:
        return None
    return spark.read.schema("call_id string").parquet(*paths).withColumn("bucket", bucket_of(F.col("call_id"), commit.buckets))


def append(df: DataFrame, path: str, mode: str = "skip", ts: str = "ts", writer: str | None = None, batch: int | None = None,
           buckets: int = BUCKETS, rows_per_file: int = 1_000_000) -> int:
    """Appends rows with ``call_id`` unique; the version that has them, or the present one if there is nothing to add.

    ``skip`` leaves out calls stored already, and all but one of repeats within the batch (``one_per_call``);
    ``atomic`` writes nothing and raises if there is any such call.  With a ``writer`` and its micro-batch's number, a batch that
    was stored before is left out whole, unread.  ``buckets`` counts for a new store.
    """
    if mode not in ("skip", "atomic"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, path = df.sparkSession, path.rstrip("/")
    folder = Folder(spark, path)
    now = last_commit(folder, buckets)
    if writer is not None and batch is not None and batch <= now.batches.get(writer, -1):
        return now.version
    bucket = bucket_of(F.col("call_id"), now.buckets)
    # a row for each bucket; of the batch only ids are read here
    found = df.groupBy("call_id").agg(F.count("*").alias("n")).groupBy(bucket.alias("bucket")).agg(F.max("n").alias("n")).collect()
    hit, repeats = sorted(r["bucket"] for r in found), any(r["n"] > 1 for r in found)
    known = stored_ids(spark, path, now, hit)
    same = None if known is None else df["call_id"].eqNullSafe(known["call_id"])
    if mode == "atomic" and (repeats or known is not None and not df.select("call_id").join(known, same, "left_semi").isEmpty()):
        raise DuplicateCalls("call_id is not unique; nothing was written")
    fresh = one_per_call(df, ts) if repeats else df
    if mode == "skip" and known is not None:
        fresh = fresh.join(known, fresh["call_id"].eqNullSafe(known["call_id"]), "left_anti")
    version = now.version + 1
    rows, ids = f"{path}/rows/version={version}", f"{path}/ids/version={version}"
    write_days(fresh, rows, ts, rows_per_file, "overwrite")
    added = spark.read.schema("call_id string").parquet(rows).select("call_id", bucket.alias("bucket"))
    merged = [k for k in hit if len(now.ids.get(k, [])) >= MERGE - 1]
    old = stored_ids(spark, path, now, merged)
    added = added if old is None else added.unionByName(old)
    width = max(1, min(len(hit), spark.sparkContext.defaultParallelism))
    added.repartition(width, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(ids)
    written = {int(n.split("=")[1]) for n in folder.names(f"ids/version={version}") if n.startswith("bucket=")}
    versions = now.ids | {k: ([] if k in merged else now.ids.get(k, [])) + [version] for k in written}
    batches = now.batches if writer is None or batch is None else now.batches | {writer: batch}
    fields = now.fields + [f for f in df.schema.jsonValue()["fields"] if f["name"] not in {g["name"] for g in now.fields}]
    if not folder.publish(f"commits/{version:012d}", json.dumps({"buckets": now.buckets, "ids": versions, "batches": batches, "fields": fields})):
        raise ConcurrentAppend(f"version {version} was committed by another append")
    for name in folder.names("commits")[:-KEPT_COMMITS - 1]:
        folder.delete(f"commits/{name}")
    return version


def write_days(df: DataFrame, path: str, ts: str = "ts", rows_per_file: int = 1_000_000, mode: str = "append") -> None:
    """Parquet partitioned by day.

    The rebalance hint brings a day's rows together so that few files are
    written, and lets adaptive execution split a day that is too large.
    """
    dated = df.withColumn("day", F.to_date(ts)).hint("rebalance", "day")
    dated.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed appends, with their ``day``; columns that an append didn't have are null."""
    now = last_commit(Folder(spark, path))
    if not now.version:
        raise FileNotFoundError(f"no insights are stored in {path}")
    schema = StructType.fromJson({"fields": now.fields}).add("day", "date").add("version", "integer")
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/rows").where(F.col("version") <= now.version).drop("version")


def tidy(spark: SparkSession, path: str) -> None:
    """Deletes id files that no bucket needs any longer, and what cut-off appends have left."""
    folder = Folder(spark, path)
    now = last_commit(folder)
    number = lambda name: int(name.split("=")[1])
    for name in folder.names("ids"):
        for part in folder.names(f"ids/{name}"):
            if part.startswith("bucket=") and number(name) not in now.ids.get(number(part), []):
                folder.delete(f"ids/{name}/{part}")
    for kind in ("rows", "ids"):
        for name in folder.names(kind):
            if number(name) > now.version:
                folder.delete(f"{kind}/{name}")
