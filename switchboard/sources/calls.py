"""Readers that turn landed files, pages and tables into call records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard import schema as S

AUDIO = ["wav", "mp3", "m4a"]
_PAGE = ("id string, transcript string, timestamp timestamp, duration double, "
         "caller map<string,string>")


def load_calls(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Call records from a JSON array (or lines) or CSV with a header; the schema is given, not inferred."""
    if format == "json":
        return spark.read.schema(S.CALL).option("multiLine", True).json(path)
    if format == "jsonl":
        return spark.read.schema(S.CALL).json(path)
    if format == "csv":
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        given = {c: F.col(c) for c in _call_columns() if c in rows.columns and c != "caller"}
        if "timestamp" in rows.columns:
            given["ts"] = F.col("timestamp")
        return as_calls(rows, **given)
    if format == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown format {format!r}")


def require_fields(df: DataFrame, fields: Sequence[str] = ("call_id", "transcript"), mode: str = "split"):
    """(complete, rejected); with ``mode="fail"`` one bad record fails the whole run."""
    bad = F.lit(False)
    for f in fields:
        bad = bad | F.col(f).isNull()
    if mode == "fail":
        message = F.concat(F.lit(f"missing one of {list(fields)} in record "), F.coalesce(F.col(fields[0]), F.lit("?")))
        return df.withColumn(fields[0], F.when(bad, F.raise_error(message)).otherwise(F.col(fields[0])))
    return df.where(~bad), df.where(bad)


def scan_call_dir(spark: SparkSession, directory: str, patterns: Sequence[str] = ("*.txt", "*.json"),
                  recursive: bool = False, modified_after: str | None = None) -> DataFrame:
    """One call per file: text and JSON files, and audio files by name only.

    ``modified_after`` keeps fresh files; it is applied while listing, so older
    files are never opened.
    """
    out = None
    for pattern in patterns:
        part = file_to_call(spark, directory, pattern, recursive, modified_after)
        if part is not None:
            out = part if out is None else out.unionByName(part)
    return out


def file_to_call(spark: SparkSession, directory: str, pattern: str, recursive: bool = False,
                 modified_after: str | None = None) -> DataFrame | None:
    """Calls of the files matching one pattern; None for suffixes that carry no call."""
    suffix = pattern.rsplit(".", 1)[-1].lower()
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    file = F.col("_metadata.file_name")
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    path = F.col("_metadata.file_path")
    if suffix == "json":
        return reader.schema(S.CALL).option("multiLine", True).json(directory).select(
            *[F.col(c) for c in _call_columns() if c != "source_file"], path.alias("source_file")) \
            .select(*_call_columns())
    if suffix == "txt":
        rows = reader.text(directory, wholetext=True)
        return as_calls(rows, call_id=stem, transcript=F.col("value"), file_type=F.lit("text"), source_file=path)
    if suffix in AUDIO:
        rows = reader.format("binaryFile").load(directory)  # only names are used; contents are pruned
        return as_calls(rows, call_id=stem, file_type=F.lit("audio"), audio_file=path, source_file=path,
                        needs_transcription=F.lit(True))
    return None


def _call_columns() -> list[str]:
    return [f.split(" ")[0] for f in S.CALL.split(", ")]


def as_calls(df: DataFrame, **given: Column) -> DataFrame:
    """The call columns, taken from ``given`` or null."""
    types = dict(f.split(" ", 1) for f in S.CALL.split(", "))
    return df.select(*[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def normalise_api_calls(pages: DataFrame, column: str = "value") -> DataFrame:
    """Calls of landed API pages: an object with ``calls`` or a bare array."""
    raw = F.col(column)
    listed = F.coalesce(F.from_json(F.get_json_object(raw, "$.calls"), "array<string>"),
                        F.from_json(raw, "array<string>"))
    items = pages.select(F.explode(listed).alias("raw"))
    parsed = items.select("raw", F.from_json("raw", _PAGE).alias("c"))
    return parsed.select(
        F.coalesce("c.id", F.concat(F.lit("api_call_"), F.uuid())).alias("call_id"),
        F.coalesce("c.transcript", F.lit("")).alias("transcript"),
        F.col("c.timestamp").alias("ts"), F.col("c.duration").alias("duration"),
        F.coalesce("c.caller", F.create_map().cast("map<string,string>")).alias("caller"),
        F.col("raw").alias("api_data"))


def incremental_since(df: DataFrame, mark, ts: str = "ts") -> DataFrame:
    """Rows newer than the high-water mark (a value or column)."""
    return df.where(F.col(ts) > mark)


def high_water_mark(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The one-row table to store as the next mark."""
    return df.agg(F.max(ts).alias("high_water_mark"))


def normalise_landed_files(files: DataFrame, extensions: Sequence[str] = (".txt", ".wav")) -> DataFrame:
    """Files landed from a remote server (file_name, modified, content) as calls."""
    wanted = F.lit(False)
    for e in extensions:
        wanted = wanted | F.endswith(F.col("file_name"), F.lit(e))
    text = F.endswith(F.col("file_name"), F.lit(".txt"))
    stamp = F.date_format("modified", "yyyyMMdd_HHmmss")
    joined = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"\n$", "")
    return files.where(wanted).select(
        F.concat(F.lit("ftp_"), F.col("file_name"), F.lit("_"), stamp).alias("call_id"),
        F.when(text, joined).otherwise(F.lit("")).alias("transcript"),
        F.col("file_name").alias("source_file"),
        F.when(text, "text").otherwise("audio").alias("file_type"))


def load_history(spark: SparkSession, path: str) -> DataFrame:
    """Stored insights from JSON arrays, times parsed; a file that cannot be read whole adds nothing."""
    schema = S.INSIGHT.replace("ts timestamp", "timestamp timestamp") + ", _corrupt_record string"
    rows = (spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))
    # names every field, so that a bad value is noticed whatever is selected later
    read_whole = F.to_json(F.struct(*[c for c in rows.columns if c != "_corrupt_record"])) != ""
    return rows.where(F.col("_corrupt_record").isNull() & F.col("call_id").isNotNull() & read_whole) \
        .drop("_corrupt_record").withColumnRenamed("timestamp", "ts")


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """Enabled and disabled sources of a registry file (an object with ``sources`` or a bare array)."""
    text = spark.read.text(path, wholetext=True)
    schema = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in S.SOURCE.split(', '))}>>"
    listed = F.coalesce(F.from_json(F.get_json_object("value", "$.sources"), schema), F.from_json("value", schema))
    return text.select(F.inline(listed)).withColumns({
        "enabled": F.coalesce("enabled", F.lit(True)),
        "polling_interval": F.coalesce("polling_interval", F.lit(300))})


def load_registered(spark: SparkSession, registry: DataFrame, acquired_at: Column | None = None) -> DataFrame:
    """Calls of every enabled file-system source, stamped with source and time.

    The registry is configuration: one row per source decides which readers
    take part in the plan.
    """
    parts = []
    for row in registry.where("enabled and source_type = 'file_system'").collect():
        config = row["config"] or {}
        patterns = [p.strip() for p in config.get("patterns", "*.txt,*.json").split(",")]
        calls = scan_call_dir(spark, config["directory"], patterns, config.get("recursive", "false") == "true")
        if calls is not None:
            parts.append((row["source_id"], calls))
    return combine_sources(parts, acquired_at)


def combine_sources(parts: Sequence[tuple[str, DataFrame]], acquired_at: Column | None = None) -> DataFrame:
    """Calls of several sources, each stamped ``source_id`` and ``acquired_at``."""
    when = acquired_at if acquired_at is not None else F.current_timestamp()
    out = None
    for source_id, df in parts:
        stamped = df.withColumns({"source_id": F.lit(source_id), "acquired_at": when})
        out = stamped if out is None else out.unionByName(stamped, allowMissingColumns=True)
    return out
