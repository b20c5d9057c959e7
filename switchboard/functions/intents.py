"""Rule-scored intents, context gains and the entities each intent asks for."""

from __future__ import annotations

import copy
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T


def pattern_found(norm: Column, pattern: str) -> Column:
    """Whether a pattern occurs.

    ``first.*last`` rescans the rest of the text from every ``first``; a text
    without any ``last`` is sorted out before, in one pass.
    """
    head, gap, last = pattern.rpartition(".*")
    test = F.rlike(norm, F.lit(pattern))
    if gap:
        try:
            re.compile(last)
        except re.error:
            return test
        return F.rlike(norm, F.lit(last)) & test
    return test


def intent_score(norm: Column, rule: Mapping) -> Column:
    """Weighted share of keywords, phrases and patterns found, plus the boost."""
    score = F.lit(0.0)
    for part in ("keywords", "phrases"):
        entries = rule.get(part) or []
        if entries:
            score = score + T.keyword_hits(norm, entries) / len(entries) * R.INTENT_WEIGHTS[part]
    patterns = rule.get("patterns") or []
    if patterns:
        hits = reduce(add, [pattern_found(norm, p).cast("int") for p in patterns])
        score = score + hits / len(patterns) * R.INTENT_WEIGHTS["patterns"]
    return score


def score_intents(df: DataFrame, text: str, rules: Mapping = R.INTENTS, prefix: str = "score_",
                  context: Mapping[str, tuple] | None = None) -> DataFrame:
    """One ``score_<intent>`` column per intent.

    ``context`` maps boolean columns of ``df`` to (intent, gain).
    """
    base = df.withColumn("_norm", T.normalise_text(F.col(text)))
    raw = base.withColumns({f"_raw_{n}": intent_score(F.col("_norm"), r) for n, r in rules.items()})
    scored = {}
    for name, rule in rules.items():
        s = F.col(f"_raw_{name}")
        s = F.when(s > 0, F.least(F.lit(1.0), s + F.lit(float(rule.get("boost", 0.0))))).otherwise(s)
        if context:
            for flag, (target, gain) in context.items():
                if target == name:
                    s = s + F.when(F.coalesce(F.col(flag), F.lit(False)), F.lit(gain)).otherwise(F.lit(0.0))
            s = F.least(F.lit(1.0), s)
        scored[prefix + name] = s
    return raw.withColumns(scored).drop("_norm", *[f"_raw_{n}" for n in rules])


def classify_intents(df: DataFrame, text: str, rules: Mapping = R.INTENTS,
                     context: Mapping[str, tuple] | None = None,
                     threshold: float = R.INTENT_THRESHOLD,
                     urgency: Mapping = R.URGENCY_LABELS, keep_scores: bool = False) -> DataFrame:
    """Adds ``primary_intent``, ``intent_confidence`` and ``urgency``.

    The best intent wins if it reaches the threshold; otherwise the default
    intent is reported with the default intent's own score.
    """
    scored = score_intents(df, text, rules, context=context)
    scores = {n: F.col(f"score_{n}") for n in rules}
    label, top = T.best_label(scores)
    out = scored.withColumns({
        "_top": top,
        "_best": label,
        "urgency": T.urgency_label(F.lower(F.col(text)), urgency),
    })
    own = scores.get(R.DEFAULT_INTENT, F.lit(0.0))
    out = out.withColumns({
        "primary_intent": F.when(F.col("_top") >= threshold, F.col("_best"))
                           .otherwise(F.lit(R.DEFAULT_INTENT)),
        "intent_confidence": F.when(F.col("_top") >= threshold, F.col("_top")).otherwise(own),
    }).drop("_top", "_best")
    return out if keep_scores else out.drop(*[f"score_{n}" for n in rules])


def update_rules(rules: Mapping, changes: Mapping) -> dict:
    """Rules with the keys of known intents replaced and new intents added."""
    merged = copy.deepcopy(dict(rules))
    for name, change in changes.items():
        merged[name] = {**merged.get(name, {}), **change}
    return merged


def describe_rules(spark, rules: Mapping = R.INTENTS) -> DataFrame:
    """The rule set as a table: intent, part, entry."""
    rows = [(i, name, part, entry)
            for i, (name, rule) in enumerate(rules.items())
            for part in ("keywords", "phrases", "patterns") for entry in rule.get(part, [])]
    return spark.createDataFrame(rows, "position int, intent string, part string, entry string")


def _all_hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def scheduling_entities(text: Column) -> dict[str, Column]:
    return {
        "preferred_times": F.concat(_all_hits(text, R.CLOCK_TIME), _all_hits(text, R.DAY_PART)),
        "preferred_days": _all_hits(text, "(?i)" + R.WEEKDAY_OR_RELATIVE),
    }


def emergency_entities(text: Column, patterns: Sequence[str] = R.PAIN_PATTERNS,
                       symptoms: Sequence[str] = R.SYMPTOM_WORDS) -> dict[str, Column]:
    return {
        "pain_description": F.concat(*[_all_hits(text, "(?i)" + p) for p in patterns]),
        "symptoms": T.matched(F.lower(text), symptoms),
    }


def insurance_entities(text: Column, providers: Sequence[str] = R.INTENT_PROVIDERS,
                       terms: Sequence[str] = R.INTENT_COVERAGE_TERMS) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "insurance_providers": T.matched(low, providers),
        "coverage_terms": T.matched(low, terms),
    }


def treatment_entities(text: Column, treatments: Sequence[str] = R.TREATMENTS) -> dict[str, Column]:
    return {"treatments_mentioned": T.matched(F.lower(text), treatments)}


_BY_INTENT = {
    "appointment_booking": scheduling_entities,
    "emergency_dental": emergency_entities,
    "insurance_inquiry": insurance_entities,
    "treatment_inquiry": treatment_entities,
}


def intent_entities(text: Column, intent: Column) -> Column:
    """Map of the non-empty entity lists that the intent asks for."""
    empty = F.create_map().cast("map<string,array<string>>")
    chain = None
    for name, extract in _BY_INTENT.items():
        pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                          for k, v in extract(text).items()])
        entry = F.map_from_entries(F.filter(pairs, lambda p: F.size(p["value"]) > 0))
        test = intent == name
        chain = F.when(test, entry) if chain is None else chain.when(test, entry)
    return chain.otherwise(empty)
