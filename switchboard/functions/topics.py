"""Predefined-topic expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T

MIN_TOKENS = 10
PREDEFINED_FLOOR = 0.3


def stop_words() -> list[str]:
    """Spark's English list plus conversational fillers."""
    return sorted(set(StopWordsRemover.loadDefaultStopWords("english")) | set(R.FILLER_STOP_WORDS))


def vocabulary(topics: Mapping[str, Sequence[str]] = R.TOPICS) -> list[str]:
    return sorted({w for group in topics.values() for w in group})


def token_overlap(tokens: Column, words: Sequence[str]) -> Column:
    """Share of the topic words that occur among the tokens."""
    known = F.array(*[F.lit(w) for w in sorted(set(words))])
    return F.size(F.array_intersect(tokens, known)) / len(words)


def topic_scores(tokens: Column, topics: Mapping[str, Sequence[str]] = R.TOPICS) -> dict[str, Column]:
    return {name: token_overlap(tokens, words) for name, words in topics.items()}


def fallback_topic_scores(low: Column, topics: Mapping[str, Sequence[str]] = R.TOPICS) -> dict[str, Column]:
    """Share of the topic words that occur as substrings (short texts)."""
    return {name: T.keyword_hits(low, words) / len(words) for name, words in topics.items()}


def dominant_topic(predefined: Column, predefined_score: Column, coherence: Column,
                   model_topic: Column) -> Column:
    """Predefined topic if convincing, else the model topic, else the predefined one."""
    return (F.when((predefined_score > PREDEFINED_FLOOR) & (predefined_score > coherence), predefined)
            .when(model_topic.isNotNull(), F.concat(F.lit("lda_topic_"), model_topic.cast("string")))
            .otherwise(predefined))


def topic_label(top_words: Column, topics: Mapping[str, Sequence[str]] = R.TOPICS) -> Column:
    """Title of the first topic sharing two words, else the words joined."""
    chain = None
    for name, words in topics.items():
        known = F.array(*[F.lit(w) for w in sorted(set(words))])
        test = F.size(F.array_intersect(top_words, known)) >= 2
        title = F.lit(name.replace("_", " ").title())
        chain = F.when(test, title) if chain is None else chain.when(test, title)
    return chain.otherwise(F.array_join(top_words, " + "))
