"""Registration of queries, their SQL counterparts and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from switchboard.functions import text as T

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a (spark, folder) -> DataFrame function, with its SQL if it has one."""
    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# --- shared output conventions -----------------------------------------------------------

def num(c: Column | str, digits: int = 6) -> Column:
    """A double rounded on both sides of the comparison."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def joined(c: Column | str, sep: str = "|") -> Column:
    """An array column as one string."""
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


def named(**cols: Column) -> list[Column]:
    return [c.alias(n) for n, c in cols.items()]


# --- SQL fragments -------------------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_hits(t: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({t}, {q(w)}) AS INT)" for w in words) + ")" if words else "0"


def sql_any(t: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")" if words else "FALSE"


def sql_sentiment(t: str, lexicon: Mapping[str, Sequence[str]]) -> str:
    p, n = sql_hits(t, lexicon["positive"]), sql_hits(t, lexicon["negative"])
    return f"(CASE WHEN {p} + {n} = 0 THEN 0.0 ELSE ({p} - {n})::DOUBLE / ({p} + {n}) END)"


def sql_matched(t: str, words: Sequence[str], sep: str = "|") -> str:
    return "concat_ws(" + q(sep) + ", " + ", ".join(
        f"CASE WHEN contains({t}, {q(w)}) THEN {q(w)} END" for w in words) + ")"


def sql_first(t: str, groups: Mapping[str, Sequence[str]], default: str) -> str:
    return "(CASE " + " ".join(f"WHEN {sql_any(t, ws)} THEN {q(n)}" for n, ws in groups.items()) \
        + f" ELSE {q(default)} END)"


def sql_urgency(t: str, lexicon: Mapping[str, Sequence[str]]) -> str:
    return (f"(CASE WHEN {sql_any(t, lexicon['critical'])} THEN 5 "
            f"WHEN {sql_any(t, lexicon['elevated'])} THEN 3 ELSE 1 END)")


def sql_bare(t: str) -> str:
    return f"trim(regexp_replace({t}, {q(T.SPACE)}, ' ', 'g'))"


def sql_word_count(t: str) -> str:
    b = sql_bare(t)
    return f"(CASE WHEN {b} = '' THEN 0 ELSE length({b}) - length(replace({b}, ' ', '')) + 1 END)"


def sql_words(t: str) -> str:
    b = sql_bare(t)
    return f"(CASE WHEN {b} = '' THEN [] ELSE string_split({b}, ' ') END)"


def sql_best(scores: Mapping[str, str]) -> tuple[str, str]:
    top = "greatest(" + ", ".join(scores.values()) + ")"
    label = "(CASE " + " ".join(f"WHEN {s} = {top} THEN {q(n)}" for n, s in scores.items()) + " END)"
    return label, top
