"""Turn-level structure of a conversation: speakers, shifts, progression, themes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T
from switchboard.functions import topics as TP
from switchboard.functions import vectors as V
from switchboard.operators import ordered as O
from switchboard.session import by_key

KEY = ["call_id"]


def turn_distribution(chunks: DataFrame) -> DataFrame:
    """Share of the segments of a call spoken by each speaker."""
    counts = chunks.groupBy("call_id", "speaker").agg(F.count("*").alias("segments"))
    total = F.sum("segments").over(Window.partitionBy("call_id"))
    return counts.select("call_id", "speaker", "segments", (F.col("segments") / total).alias("share"))


def turn_stats(chunks: DataFrame, long_calls: bool | None = None) -> DataFrame:
    """Speaker changes (the first one counts) and mean words per segment."""
    slim = chunks.select("call_id", "seq", "speaker", T.word_count(F.col("text")).alias("n_words"))
    rows = O.sequence_rows(slim, KEY, "seq", 1, ["speaker"], long_calls)
    rows = rows.withColumn("_previous", F.lag("speaker").over(O.window(KEY, ["seq"])))
    return (rows.where(~F.col(O.HALO)).groupBy("call_id").agg(
        F.count_if(~F.col("speaker").eqNullSafe(F.col("_previous"))).alias("total_turns"),
        F.avg("n_words").alias("average_turn_length"),
        F.count("*").alias("segments")))


def interruptions(chunks: DataFrame, min_words: int = 3) -> DataFrame:
    """Segments of fewer than ``min_words`` words that do not end their call."""
    slim = chunks.select("call_id", "seq", "speaker", "text", T.word_count(F.col("text")).alias("n_words"))
    short = slim.where(F.col("n_words") < min_words)
    last = chunks.groupBy("call_id").agg(F.max("seq").alias("last_seq"))
    return (short.join(last, "call_id").where(F.col("seq") < F.col("last_seq"))
            .select("call_id", "seq", "speaker", "text"))


def topic_shifts(chunks: DataFrame, minor: float = 0.3, major: float = 0.1,
                 long_calls: bool | None = None) -> DataFrame:
    """Adjacent segments whose word sets overlap less than ``minor`` (Jaccard)."""
    slim = chunks.select("call_id", "seq", "text")
    rows = O.sequence_rows(slim, KEY, "seq", 1, ["text"], long_calls)
    rows = rows.withColumn("_previous", F.lag("text").over(O.window(KEY, ["seq"])))
    # the pair is the argument of a lambda, so that its words are split once per use of the result
    pair = F.array(F.struct(T.words(F.lower("text")).alias("now"), T.words(F.lower("_previous")).alias("before")))
    overlap = F.transform(pair, lambda p: F.try_divide(
        F.size(F.array_intersect(p["now"], p["before"])), F.size(F.array_union(p["now"], p["before"]))))
    shifts = (rows.where(~F.col(O.HALO) & F.col("_previous").isNotNull())
              .select("call_id", "seq", overlap[0].alias("similarity"))
              .where(F.col("similarity") < minor))
    return shifts.withColumn("shift_type", F.when(F.col("similarity") < major, "major").otherwise("minor"))


def sentiment_progression(chunks: DataFrame, lexicon: Mapping = R.SEGMENT_SENTIMENT) -> DataFrame:
    """Per-segment sentiment summed up per call: trend and population deviation."""
    scored = chunks.select("call_id", "seq", F.lower("text").alias("_low")).select(
        "call_id", "seq", T.sentiment(F.col("_low"), lexicon).alias("s"))
    return scored.groupBy("call_id").agg(
        F.min_by("s", "seq").alias("first_sentiment"),
        F.max_by("s", "seq").alias("last_sentiment"),
        F.stddev_pop("s").alias("volatility"),
        F.count("*").alias("segments"),
    ).select("call_id", "first_sentiment", "last_sentiment", "volatility", "segments",
             F.when(F.col("last_sentiment") > F.col("first_sentiment"), "improving")
              .otherwise("declining").alias("overall_trend"))


def sentiment_journey(scored: DataFrame, sentiment: str = "sentiment") -> DataFrame:
    """First, last, change, extremes and population deviation of a timeline."""
    g = scored.groupBy("call_id").agg(
        F.min_by(sentiment, "seq").alias("initial_sentiment"),
        F.max_by(sentiment, "seq").alias("final_sentiment"),
        F.min(sentiment).alias("lowest_point"),
        F.max(sentiment).alias("highest_point"),
        F.stddev_pop(sentiment).alias("volatility"))
    return g.withColumn("sentiment_change", F.col("final_sentiment") - F.col("initial_sentiment"))


def conversation_coherence(segments: DataFrame, key: str, seq: str, vector: str,
                           long_keys: bool | None = None) -> DataFrame:
    """Mean cosine of adjacent segment vectors per conversation."""
    rows = O.sequence_rows(segments.select(key, seq, vector), [key], seq, 1, [vector], long_keys)
    rows = rows.withColumn("_previous", F.lag(vector).over(O.window([key], [seq])))
    pairs = rows.where(~F.col(O.HALO) & F.col("_previous").isNotNull()).select(
        key, V.cosine(F.col(vector), F.col("_previous")).alias("similarity"))
    return pairs.groupBy(key).agg(F.avg("similarity").alias("coherence_score"),
                                  F.count("similarity").alias("adjacent_pairs"))


def concern_counts(chunks: DataFrame, concerns: Mapping[str, Sequence[str]] = R.CONCERNS) -> DataFrame:
    """How many chunks of a call raised each concern."""
    low = chunks.select("call_id", F.lower("text").alias("_low"))
    raised = low.select("call_id", F.explode_outer(T.compact_strings(
        [F.when(T.any_of(F.col("_low"), words), F.lit(name)) for name, words in concerns.items()]
    )).alias("concern")).where(F.col("concern").isNotNull())
    return raised.groupBy("call_id", "concern").agg(F.count("*").alias("mentions"))


def key_themes(calls: DataFrame, key: str = "call_id", text: str = "transcript",
               topics: Mapping[str, Sequence[str]] = R.TOPICS, most: int = 10, keep: int = 5,
               stop_words: Sequence[str] | None = None) -> DataFrame:
    """Of a call's ``most`` frequent tokens, those known or repeated; at most ``keep``.

    Only the texts are shuffled: tokens are counted and ranked where the rows of their call are.
    """
    stop = TP.stop_words() if stop_words is None else stop_words
    # the outer form, because the inner one would tokenise once more to test for emptiness
    words = by_key(calls.select(key, text), key).select(key, F.posexplode_outer(T.tokens(F.col(text), stop)).alias("pos", "token")) \
        .where(F.col("token").isNotNull())
    counted = words.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))
    frequent = Window.partitionBy(key).orderBy(F.desc("n"), "first_pos")
    top = counted.withColumn("rank", F.row_number().over(frequent)).where(F.col("rank") <= most)
    vocabulary = TP.vocabulary(topics)
    themes = top.where(F.col("token").isin(vocabulary) | (F.col("n") >= 2))
    kept = themes.withColumn("theme_rank", F.row_number().over(Window.partitionBy(key).orderBy("rank")))
    return kept.where(F.col("theme_rank") <= keep).select(key, "theme_rank", "token", "n")


def split_segments(calls: DataFrame, key: str = "call_id", text: str = "transcript") -> DataFrame:
    """One row per line of a transcript."""
    return calls.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("seq", "text"))


def concat_segments(chunks: DataFrame, part_rows: int | None = None, separator: str = "\n") -> DataFrame:
    """Segments joined in order: one row per call, or ``part_rows`` lines to a part if given.

    A whole transcript has to fit a task, as any text column does; ask for parts where calls may be longer.
    """
    lines = chunks.select("call_id", "seq", "text")
    parts = O.cut(lines, "seq", part_rows) if part_rows else lines.withColumn(O.BLOCK, F.lit(0).cast("bigint"))
    return (parts.groupBy("call_id", F.col(O.BLOCK).alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("_lines"))
            .select("call_id", "part",
                    F.array_join(F.transform("_lines", lambda x: x["text"]), separator).alias("transcript")))
