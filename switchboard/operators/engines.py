"""Engines of a caller's own that may fail on some texts.

A guarded engine is a Python function from a text to a value.  It runs over Arrow batches; an exception
becomes the error of that row and engine, and all other values stay.  Rows with errors can go to a dead-letter
table (``sinks.append_dead_letters``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ERRORS = "engine_errors"
ERROR = "array<struct<engine:string,error:string>>"


class Engine(NamedTuple):
    """A function of a text, never null, and the Spark type of its values."""

    run: Callable[[str], Any]
    type: str


def guarded(engine: Engine) -> Callable[[Column], Column]:
    """The engine as a column of (value, error), one of them null; a null text gives neither."""
    def attempt(text: str | None) -> tuple:
        if text is None:
            return None, None
        try:
            return engine.run(text), None
        except Exception as e:  # whatever a caller's engine raises is the row's error
            return None, f"{type(e).__name__}: {e}"

    @F.pandas_udf(f"value {engine.type}, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = [attempt(t) for t in texts]
        return pd.DataFrame({"value": pd.Series([v for v, _ in found], dtype=object), "error": pd.Series([e for _, e in found], dtype=object)})

    return run


def with_engines(calls: DataFrame, engines: Mapping[str, Engine], text: str = "transcript") -> DataFrame:
    """Adds the value of each engine under its name, null where it failed, and ``engine_errors`` in the engines' order.

    A column of that name, such as one of a built-in engine, is replaced; errors of earlier engines are kept.
    """
    attempts = {f"_attempt_{k}": guarded(e)(F.col(text)) for k, e in enumerate(engines.values())}
    out = calls.withColumns(attempts)
    failed = [F.when(F.col(f"_attempt_{k}.error").isNotNull(), F.struct(F.lit(name).alias("engine"), F.col(f"_attempt_{k}.error").alias("error")))
              for k, name in enumerate(engines)]
    errors = F.array_compact(F.array(*failed)).cast(ERROR)
    if ERRORS in calls.columns:
        errors = F.concat(F.col(ERRORS), errors)
    return out.withColumns({**{name: F.col(f"_attempt_{k}.value") for k, name in enumerate(engines)}, ERRORS: errors}).drop(*attempts)


def failed_calls(analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that no engine failed on, rows with an error)."""
    bad = F.size(ERRORS) > 0
    return analysed.where(~bad), analysed.where(bad)


def error_text() -> Column:
    """The errors of a row as one text: engine and error, in order."""
    return F.array_join(F.transform(ERRORS, lambda e: F.concat(e["engine"], F.lit(": "), e["error"])), "; ")
