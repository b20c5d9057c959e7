"""Reading tables and files as streams, and running streams to the end of what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard import schema as S
from switchboard.session import scratch_path
from switchboard.sources import calls as C
from switchboard.sources.files import Folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State larger than memory, with changelog checkpoints."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def table_stream(spark: SparkSession, path: str, schema: str, max_files: int | None = 16) -> DataFrame:
    """A parquet folder or file as a stream of its files, ``max_files`` to a batch, which bounds what a key gets at once.

    The stream source takes a single file only through a pattern, so the path
    is given as one that matches itself; that suits folders as well.
    """
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    bare = path.rstrip("/")
    return reader.parquet(f"{bare[:-1]}[{bare[-1]}]")


def call_stream(spark: SparkSession, directory: str, pattern: str = "*.json", source_id: str = "default",
                recursive: bool = False, archive: str | None = None, max_age: str | None = None,
                max_files: int | None = None) -> DataFrame:
    """New call files of a folder as call records.

    ``archive`` moves the files of a finished batch away, below the folder's own path, and ``max_age`` skips stale ones; the
    stream's checkpoint remembers what has been read.  Files are moved before the next batch begins, not beside it.
    """
    reader = spark.readStream.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    if archive is not None:
        spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "0")
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_age is not None:
        reader = reader.option("maxFileAge", max_age)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    path = F.col("_metadata.file_path")
    if pattern.lower().endswith(".txt"):
        stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
        rows = reader.text(directory, wholetext=True)
        calls = C.as_calls(rows, call_id=stem, transcript=F.col("value"), file_type=F.lit("text"), source_file=path)
    else:
        rows = reader.schema(S.CALL).option("multiLine", True).json(directory)
        calls = C.as_calls(rows, **{c: F.col(c) for c in rows.columns if c != "source_file"}, source_file=path)
    return calls.withColumns({"source_id": F.lit(source_id), "acquired_at": F.current_timestamp()})


def landed_sink(root: str, archive: str | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer of calls read from files, with a ledger of the files.

    ``calls`` has the rows and ``files`` one row for each file: the file, its batch, its calls and its place in the
    archive.  A repeated batch overwrites its own folders, so neither calls nor files are told twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        at = lambda kind: f"{root}/{kind}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(at("calls"))
        stored = batch.sparkSession.read.schema(batch.schema).parquet(at("calls"))
        place = F.lit(None).cast("string") if archive is None else F.concat(F.lit(archive.rstrip("/")), F.regexp_replace("source_file", r"^\w+:(//[^/]*)?", ""))
        stored.groupBy("source_file").agg(F.count("*").alias("calls")).withColumn("archived_as", place).write.mode("overwrite").parquet(at("files"))

    return write


def archive_last_batch(spark: SparkSession, root: str, checkpoint: str) -> int:
    """Moves the files of the last finished batch to their places in the archive; how many.

    The source archives a batch when the next one begins, so a stream that has ended leaves its last files.  Only a batch
    that the checkpoint calls finished is moved; the ledger names at most ``max_files`` of it.
    """
    done = [int(n) for n in Folder(spark, checkpoint).names("commits") if n.isdigit()]
    if not done:
        return 0
    files = spark.read.parquet(f"{root}/files/batch_id={max(done)}").where("archived_as is not null").collect()
    folder = Folder(spark, root)
    return sum(folder.move(r["source_file"], r["archived_as"]) for r in files)


def landed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All rows of one kind that a ``landed_sink`` has written, with their ``batch_id``."""
    return spark.read.parquet(f"{root}/{kind}")


def run_available(stream: DataFrame, label: str, output_mode: str = "append") -> DataFrame:
    """Runs a stream over all data present and returns the table it wrote.

    The result stays in files on the shared folder; nothing passes through the driver.
    """
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    query = (stream.writeStream.format("parquet").outputMode(output_mode).trigger(availableNow=True)
             .option("path", out).option("checkpointLocation", checkpoint).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], label: str, checkpoint: str | None = None) -> None:
    """Runs a stream over all data present through ``foreachBatch``; with a ``checkpoint`` of its own it goes on from there."""
    checkpoint = checkpoint or scratch_path(stream.sparkSession, f"{label}-state")
    query = (stream.writeStream.foreachBatch(write).trigger(availableNow=True)
             .option("checkpointLocation", checkpoint).start())
    query.awaitTermination()


def continuous_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                       interval: str = "30 seconds"):
    """The same, polling every ``interval`` until stopped; returns the query."""
    return (stream.writeStream.foreachBatch(write).trigger(processingTime=interval)
            .option("checkpointLocation", checkpoint).start())
