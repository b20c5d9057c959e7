"""Live coaching: the running state of a call kept between micro-batches.

Text is reduced to signals before the stateful step and turned into advice
after it, both by the same JVM expressions as in batch.  The state function folds the
chunks of a call that a micro-batch brought as numpy arrays.  What the report of a session needs is
kept for open sessions only, in parts that add up, so no response is read twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from switchboard import rules as R
from switchboard.operators import coaching as C
from switchboard.session import scratch_path
from switchboard.sources import sinks
from switchboard.sources.files import Folder
from switchboard.streaming.tables import use_rocksdb

_PASSED = ["seq", "us", "speaker", "sentiment", "concerns", "urgency", "is_staff", "emotion", "satisfaction", "engagement"]
_COUNTERS = ["interaction_count", "buffer_chars", "buffer_words", "resolution_attempts", "frustration_count"]
#: staff chunks whose scores are summed at a time; their weights stay within a double's range
SCAN = 512


def decayed(x: np.ndarray, start: float, keep: float) -> np.ndarray:
    """``start`` and the values after each x of ``s = keep * s + (1 - keep) * x``."""
    out = np.empty(len(x) + 1)
    out[0] = start
    for lo in range(0, len(x), SCAN):
        part = x[lo:lo + SCAN]
        weight = keep ** np.arange(1, len(part) + 1)
        out[lo + 1:lo + 1 + len(part)] = weight * (out[lo] + (1 - keep) * np.cumsum(part / weight))
    return out


class Session:
    """Folds the chunks of one call into its session; ends it on a marker or after silence."""

    def __init__(self, masks: list[str], phrases: list[tuple[str, str, int]], edge: int, gap_ms: int, columns: list[str], scores: list[str], keep: float, start: float):
        self.masks, self.phrases, self.edge = masks, phrases, edge
        self.gap_ms, self.columns, self.scores = gap_ms, columns, scores
        self.keep, self.start = keep, start

    def state_type(self) -> str:
        return ", ".join(["n long, chars long, words long, res long, fru long, neg long, start_us long, last_us long, opened_us long, mark long",
                          *[f"{m} long" for m in self.masks], *[f"{s} double" for s in self.scores], "tail string"])

    def fresh(self) -> dict:
        return {"n": 0, "chars": 0, "words": 0, "res": 0, "fru": 0, "neg": 0, "start_us": None, "last_us": None, "opened_us": None,
                "mark": None, **{m: 0 for m in self.masks}, **{s: self.start for s in self.scores}, "tail": ""}

    def borders(self, s: dict, heads: list[str], tails: list[str]) -> dict[str, np.ndarray]:
        """What phrases across the border to each chunk add to its masks and counts."""
        tail, texts = s["tail"], []
        for head, own in zip(heads, tails, strict=True):
            texts.append((tail, head))
            tail = f"{tail} {own}"[-self.edge:]
        s["tail"] = tail
        added: dict[str, np.ndarray] = {}
        for phrase, kind, bit in self.phrases:
            n = len(phrase) - 1
            hit = [phrase in f"{tail[-n:]} {head[:n]}" for tail, head in texts]
            if any(hit):
                value = np.array(hit, np.int64) * bit
                before = added.get(kind)
                added[kind] = value if before is None else before + value if kind.startswith("n_") else before | value
        return added

    def fold(self, s: dict, rows: dict[str, np.ndarray]) -> pd.DataFrame:
        """Adds chunks in order to ``s``; the running values after each of them."""
        m = len(rows["us"])
        added = self.borders(s, rows["head"].tolist(), rows["tail"].tolist()) if self.edge else {}
        total = lambda key, x: s[key] + np.cumsum(x.astype(np.int64))
        out: dict[str, np.ndarray] = {c: rows[c] for c in [*_PASSED, *(f"x_{n}" for n in self.scores)]}
        out["interaction_count"] = s["n"] + np.arange(1, m + 1)
        out["buffer_chars"] = total("chars", rows["n_chars"] + 1)
        out["buffer_words"] = total("words", rows["n_words"])
        out["resolution_attempts"] = total("res", rows["n_resolution"] + added.get("n_resolution", 0))
        out["frustration_count"] = total("fru", rows["n_frustration"] + added.get("n_frustration", 0))
        negative = rows["sentiment"] < 0
        seen = total("neg", negative)
        out["negative_before"] = seen - negative > 0
        out["start_us"] = np.minimum.accumulate(rows["us"] if s["start_us"] is None else np.append(s["start_us"], rows["us"]))[-m:]
        mark = np.where(np.isnan(rows["last_mark"]), -1, out["buffer_chars"] - np.nan_to_num(rows["last_mark"])).astype(np.int64)
        mark = np.maximum.accumulate(np.append(-1 if s["mark"] is None else s["mark"], mark))[1:]
        out["last_mark_at"] = np.where(mark < 0, np.nan, mark)
        for name in self.masks:
            hits = rows[name].astype(np.int64) | added.get(name, 0)
            out[name] = np.bitwise_or.accumulate(np.append(s[name], hits))[1:]
        staff = rows["is_staff"].astype(bool)
        turn = np.cumsum(staff)
        for name in self.scores:
            out[name] = decayed(rows[f"x_{name}"][staff].astype(float), s[name], self.keep)[turn]
        s["opened_us"] = int(rows["us"][0]) if s["opened_us"] is None else s["opened_us"]
        out["opened_us"] = np.full(m, s["opened_us"])
        out["session_ended"] = np.zeros(m, bool)
        s["last_us"] = int(max(rows["us"].max(), rows["us"][0] if s["last_us"] is None else s["last_us"]))
        s["start_us"], s["neg"], s["mark"] = int(out["start_us"][-1]), int(seen[-1]), int(mark[-1]) if mark[-1] >= 0 else None
        for key, column in zip(("n", "chars", "words", "res", "fru"), _COUNTERS, strict=True):
            s[key] = int(out[column][-1])
        s |= {name: int(out[name][-1]) for name in self.masks} | {name: float(out[name][-1]) for name in self.scores}
        return out

    def frame(self, key: tuple, out: dict) -> pd.DataFrame:
        return pd.DataFrame({c: key[0] if c == "call_id" else out[c] for c in self.columns})

    def closing(self, key: tuple, s: dict) -> pd.DataFrame:
        row = {c: [None] for c in self.columns}
        row |= {"call_id": [key[0]], "interaction_count": [s["n"]], "start_us": [s["start_us"]], "us": [s["last_us"]], "opened_us": [s["opened_us"]], "session_ended": [True]}
        return pd.DataFrame(row, columns=self.columns, dtype=object)

    def __call__(self, key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = dict(zip(self.fresh(), state.get, strict=True)) if state.exists else self.fresh()
        if state.hasTimedOut:
            state.remove()
            yield self.closing(key, s)
            return
        parts = [{c: f[c].to_numpy() for c in f.columns} for f in frames]
        rows = parts[0] if len(parts) == 1 else {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        order = np.lexsort((rows["seq"], rows["us"]))
        rows = {c: x[order] for c, x in rows.items()}
        rows["last_mark"] = rows["last_mark"].astype(float)
        lo = 0
        for hi in [*np.flatnonzero(rows["speaker"] == "end").tolist(), len(order)]:
            if hi > lo:
                yield self.frame(key, self.fold(s, {c: x[lo:hi] for c, x in rows.items()}))
            if hi < len(order):
                yield self.closing(key, s)
                s = self.fresh()
            lo = hi + 1
        if s["n"]:
            state.update(tuple(s.values()))
            state.setTimeoutTimestamp(max(s["last_us"] // 1000 + self.gap_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()


def coach_stream(chunks: DataFrame, profile: str | Mapping = "default", delay: str = "10 minutes",
                 gap_seconds: int = 1800) -> DataFrame:
    """One response per arriving chunk, and a ``session_ended`` row per finished call.

    A chunk spoken by ``end`` closes its call, and so do ``gap_seconds`` of
    silence in event time.  Chunks later than ``delay`` are dropped.  The chunks
    of one call within a micro-batch are sorted in memory; ``max_files`` of the
    source bounds how many those can be.
    """
    spark = chunks.sparkSession
    use_rocksdb(spark)
    rules = C.profile_rules(profile)
    masks = C.mask_names(rules)
    signals = C.chunk_signals(chunks.withWatermark("ts", delay), rules)
    slim = signals.withColumn("us", F.unix_micros("ts")).withColumn("concerns", F.concat_ws("\x1f", "concerns"))
    place = {w: i for i, w in enumerate(C.buffer_words(rules))}
    spanning = [w for w in place if " " in w]
    phrases = [(w, masks[place[w] // C.GROUP], 1 << (place[w] % C.GROUP)) for w in spanning]
    phrases += [(w, kind, 1) for kind, ws in C.counted_phrases(rules).items() for w in ws if " " in w]
    types = {
        "call_id": "string", "seq": "int", "us": "long", "speaker": "string", "sentiment": "double",
        "concerns": "string", "urgency": "int", "is_staff": "boolean", "emotion": "string",
        "satisfaction": "string", "engagement": "string", **{f"x_{s}": "double" for s in R.SCORES},
        **{c: "long" for c in _COUNTERS}, "negative_before": "boolean", "start_us": "long",
        "last_mark_at": "long", **{m: "long" for m in masks}, **{s: "double" for s in R.SCORES},
        "opened_us": "long", "session_ended": "boolean"}
    session = Session(masks, phrases, C.edge_length(rules), gap_seconds * 1000, list(types), list(R.SCORES), R.SCORE_KEEP, R.START_SCORE)
    state = slim.groupBy("call_id").applyInPandasWithState(
        session.__call__, ", ".join(f"{n} {t}" for n, t in types.items()), session.state_type(), "append", GroupStateTimeout.EventTimeTimeout)
    folded = state.withColumns({
        "ts": F.timestamp_micros("us"), "start_ts": F.timestamp_micros("start_us"), "opened": F.timestamp_micros("opened_us"),
        "concerns": F.when(F.col("concerns") == "", F.array().cast("array<string>"))
                     .otherwise(F.split("concerns", "\x1f"))}).drop("us", "start_us", "opened_us")
    return C.coaching_responses(folded, rules)


def coaching_sink(root: str, staff: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer below ``root``: ``responses``, and of every session that ended its report in ``reports``, its stored row
    in ``sessions`` and, with ``staff`` (call_id, staff_id), its scores in ``performance``.

    ``open`` has one row for each session that hasn't ended, with the parts of its report (``C.report_parts``) so far; a batch
    reads what the one before it wrote there and its own responses, so its cost doesn't grow with the stream.
    Each batch overwrites its own folders, so a repeated batch changes nothing; ``open`` keeps those of the last two.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = Folder(spark, root)
        at = lambda kind, number=batch_id: f"{root}/{kind}/batch_id={number}"
        batch = batch.persist()
        try:
            responses = batch.where(~F.col("session_ended")).drop("session_ended")
            responses.write.mode("overwrite").parquet(at("responses"))
            parts = C.report_parts(responses, C.SESSION)
            before = [n for n in _numbers(folder, "open") if n < batch_id]
            if before:
                parts = parts.unionByName(spark.read.schema(parts.schema).parquet(at("open", before[-1])))
            parts = C.merged_parts(parts, C.SESSION)
            ended = batch.where("session_ended").select(*C.SESSION, F.lit(True).alias("ended")).distinct()
            told = parts.join(ended, C.SESSION, "left").persist()
            try:
                told.where("ended is null").drop("ended").write.mode("overwrite").parquet(at("open"))
                closed = told.where("ended").drop("ended")
                reports = C.report_of_parts(closed)
                reports.write.mode("overwrite").parquet(at("reports"))
                sinks.coaching_session_rows_of_parts(closed).write.mode("overwrite").parquet(at("sessions"))
                if staff is not None:
                    sinks.staff_performance_rows(reports, staff).write.mode("overwrite").parquet(at("performance"))
            finally:
                told.unpersist()
            for number in before[:-1]:
                folder.delete(f"open/batch_id={number}")
        finally:
            batch.unpersist()

    return write


def _numbers(folder: Folder, kind: str) -> list[int]:
    return sorted(int(n.split("=")[1]) for n in folder.names(kind) if n.startswith("batch_id="))


def written(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """All rows of one kind that a ``coaching_sink`` has written."""
    return spark.read.parquet(f"{root}/{kind}").drop("batch_id")


def open_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Report parts of the sessions that haven't ended, after the last batch."""
    return spark.read.parquet(f"{root}/open/batch_id={_numbers(Folder(spark, root), 'open')[-1]}")


def sink_root(spark: SparkSession, label: str = "coaching") -> str:
    return scratch_path(spark, label)
