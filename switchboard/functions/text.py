"""Lexicon, sentiment, urgency and normalisation expressions.

Arguments named ``low`` are lower-cased text columns: lower-case once in a
projection and pass that column on, so that a row is folded a single time
however many words are tested.  Word tests are sums of ``contains`` calls
rather than higher-order functions, which keeps them inside whole-stage
code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
# any run of white space but a single blank: rare, so that few replacements are made
ODD_SPACE = r"(?:[\s\x0b\x1c-\x1f\x85\p{Z}&&[^ ]]| [\s\x0b\x1c-\x1f\x85\p{Z}])[\s\x0b\x1c-\x1f\x85\p{Z}]*"
NOT_KEPT = r"[^\p{L}\p{N}_ .,!?-]"
OMITTED = "\n\n[... middle of conversation omitted for length ...]\n\n"
_SEP = "\x1f"


def found(low: Column, word: str, match: str = "substring") -> Column:
    """True where ``word`` occurs; ``match="word"`` asks for whole words."""
    if match == "word":
        quoted = "\\Q" + word + "\\E"
        return F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])"))
    return F.contains(low, F.lit(word))


def any_of(low: Column, words: Sequence[str], match: str = "substring") -> Column:
    return reduce(or_, [found(low, w, match) for w in words], F.lit(False))


def keyword_hits(low: Column, words: Sequence[str], match: str = "substring") -> Column:
    """Number of distinct lexicon entries that occur in the text."""
    return reduce(add, [found(low, w, match).cast("int") for w in words], F.lit(0))


def word_mask(low: Column, words: Sequence[str]) -> Column:
    """Bit ``i`` is set where entry ``i`` occurs (at most 63 entries)."""
    if len(words) > 63:
        raise ValueError("a mask holds at most 63 words")
    bits = [F.when(found(low, w), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
            for i, w in enumerate(words)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits, F.lit(0).cast("bigint"))


def matched(low: Column, words: Sequence[str], match: str = "substring") -> Column:
    """The entries found, in lexicon order, as an array."""
    return compact_strings([F.when(found(low, w, match), F.lit(w)) for w in words])


def compact_strings(items: Sequence[Column]) -> Column:
    """Array of the non-null strings among ``items``."""
    joined = F.concat_ws(_SEP, *items)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, _SEP))


def sentiment(low: Column, lexicon: Mapping[str, Sequence[str]], match: str = "substring") -> Column:
    """(p - n) / (p + n) over distinct lexicon hits, 0 without any."""
    p = keyword_hits(low, lexicon["positive"], match)
    n = keyword_hits(low, lexicon["negative"], match)
    return F.when(p + n == 0, F.lit(0.0)).otherwise((p - n) / (p + n))


def keyword_intent(low: Column, intents: Mapping[str, Sequence[str]], default: str = "inquiry",
                   match: str = "substring") -> Column:
    """First intent, in declaration order, with any word present."""
    chain = None
    for name, words in intents.items():
        test = any_of(low, words, match)
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return F.lit(default) if chain is None else chain.otherwise(F.lit(default))


def urgency_level(low: Column, lexicon: Mapping[str, Sequence[str]], match: str = "substring") -> Column:
    """5 for any critical word, 3 for any elevated word, else 1."""
    return (F.when(any_of(low, lexicon["critical"], match), F.lit(5))
            .when(any_of(low, lexicon["elevated"], match), F.lit(3))
            .otherwise(F.lit(1)))


def urgency_label(low: Column, lexicon: Mapping[str, Sequence[str]], match: str = "substring") -> Column:
    high = any_of(low, lexicon["high"], match)
    medium = any_of(low, lexicon["medium"], match)
    low_words = any_of(low, lexicon["low"], match)
    return (F.when(high, F.lit("high"))
            .when(medium & ~low_words, F.lit("medium"))
            .when(low_words, F.lit("low"))
            .otherwise(F.lit("medium")))


def normalise_text(text: Column) -> Column:
    """Lower case, single spaces, trimmed, only word characters and . , ! ? - kept."""
    return F.regexp_replace(single_spaced(F.lower(text)), NOT_KEPT, "")


def single_spaced(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, ODD_SPACE, " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words, 0 for blank text."""
    bare = single_spaced(text)
    return F.when(bare == "", F.lit(0)).otherwise(
        F.length(bare) - F.length(F.replace(bare, F.lit(" "), F.lit(""))) + 1)


def words(text: Column) -> Column:
    """Whitespace-separated words without empty ones."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def count_occurrences(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of ``phrase``."""
    without = F.replace(text, F.lit(phrase), F.lit(""))
    return ((F.length(text) - F.length(without)) / F.lit(len(phrase))).cast("int")


def trim_transcript(text: Column, max_words: int = 3000) -> Column:
    """Strip; a text of more than ``max_words`` keeps its first and last half."""
    half = max_words // 2
    stripped = F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")
    parts = words(text)
    return F.when(word_count(text) <= max_words, stripped).otherwise(
        F.concat(F.array_join(F.slice(parts, 1, half), " "), F.lit(OMITTED),
                 F.array_join(F.slice(parts, -half, half), " ")))


def best_label(scores: Mapping[str, Column]) -> tuple[Column, Column]:
    """(label, score) of the highest score; the first declared label wins ties."""
    top = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    chain = None
    for name, score in scores.items():
        chain = F.when(score == top, F.lit(name)) if chain is None else chain.when(score == top, F.lit(name))
    return chain, top


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday = 0), month, weekend and business-hours flags."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_business_hours": F.hour(ts).between(8, 17).cast("int"),
    }


def tokens(text: Column, stop_words: Sequence[str] = ()) -> Column:
    """Purely alphabetic lower-case tokens longer than 2, minus stop words."""
    raw = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    stop = sorted(set(stop_words))

    def keep(t: Column) -> Column:
        test = (F.length(t) > 2) & ~F.rlike(t, F.lit(r"[\p{N}_]"))
        return test & ~t.isin(stop) if stop else test

    return F.filter(raw, keep)
