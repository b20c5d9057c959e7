"""Entity expressions: appointment, insurance, phone, e-mail, token-shape and medical terms."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T

ENTITY = "struct<text:string,label:string,start:int,end:int,confidence:double,context:string>"


def hits(text: Column, pattern: str) -> Column:
    """All matches; word classes follow Unicode."""
    return F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0))


def appointment_info(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "times": F.concat(hits(text, "(?i)" + R.CLOCK_TIME), hits(text, "(?i)" + R.DAY_PART)),
        "days": F.concat(hits(low, R.WEEKDAY), hits(low, R.RELATIVE_DAY)),
        "dates": F.concat(hits(text, "(?i)" + R.MONTH_DAY), hits(text, R.SLASH_DATE)),
        "has_scheduling_intent": T.any_of(low, R.SCHEDULING_WORDS),
    }


def insurance_info(text: Column, providers: Sequence[str] = R.INSURANCE_PROVIDERS,
                   terms: Sequence[str] = R.INSURANCE_TERMS) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "insurance_providers": T.matched(low, providers),
        "insurance_terms": T.matched(low, terms),
        "has_insurance_inquiry": T.any_of(low, list(providers) + list(terms)),
    }


def phone_numbers(text: Column) -> Column:
    """Pattern by pattern, so one number may be listed twice."""
    return F.concat(*[hits(text, p) for p in R.PHONE_PATTERNS])


def email_addresses(text: Column) -> Column:
    return hits(text, R.EMAIL_PATTERN)


def all_terms(vocabularies: Mapping[str, Sequence[str]] = R.MEDICAL_TERMS) -> list[str]:
    """The union of the vocabularies, without repeats, in declaration order."""
    return list(dict.fromkeys(t for group in vocabularies.values() for t in group))


def _context(text: Column, start: Column, end: Column, window: int) -> Column:
    first = F.greatest(start - window, F.lit(0))
    return F.substring(text, first + 1, end + window - first)


def medical_terms(text: Column, terms: Sequence[str] | None = None,
                  window: int = R.CONTEXT_CHARS) -> Column:
    """Terms found as substrings of the folded text, at their first position."""
    def found(low: Column) -> Column:
        out = []
        for term in terms if terms is not None else all_terms():
            start = F.instr(low, term) - 1
            end = start + len(term)
            out.append(F.when(F.contains(low, F.lit(term)), F.struct(
                F.lit(term).alias("text"), F.lit("MEDICAL_TERM").alias("label"),
                start.alias("start"), end.alias("end"),
                F.lit(R.ENTITY_CONFIDENCE["TERM"]).alias("confidence"),
                _context(text, start, end, window).alias("context"))))
        return F.array_compact(F.array(*out)).cast(f"array<{ENTITY}>")

    # a lambda's argument is computed once, however many terms look at it
    return F.transform(F.array(F.lower(text)), found)[0]


def phrase_patterns(terms: Sequence[str] | None = None) -> list[str]:
    """One regex for the terms of several words and one for single words, on word edges."""
    terms = list(terms if terms is not None else all_terms())
    groups = [[t for t in terms if " " in t], [t for t in terms if " " not in t]]
    bodies = ["|".join(re.escape(t) for t in sorted(group, key=len, reverse=True)) for group in groups if group]
    return [rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])" for body in bodies]


def phrase_terms(text: Column, terms: Sequence[str] | None = None) -> Column:
    """Terms on word edges, every occurrence, case kept; longer terms first."""
    return F.concat(*[hits(text, p) for p in phrase_patterns(terms)])


def token_entities(text: Column, patterns: Mapping[str, str] = R.TOKEN_PATTERNS) -> Column:
    """Label and text of every token-shape match."""
    def labelled(name: str, pattern: str) -> Column:
        return F.transform(hits(text, pattern),
                           lambda h: F.struct(h.alias("text"), F.lit(name).alias("label")))

    return F.concat(*[labelled(name, p) for name, p in patterns.items()])


def located(text: Column, pattern: str, label: str, confidence: float, window: int = R.CONTEXT_CHARS) -> Column:
    """Every match of one regex with its offsets and surroundings.

    A second regex takes each match together with what lies before it, so a match ends where
    the pieces so far end: one fold, without leaving the JVM.  Word classes follow Unicode; as that makes a scan
    slow, ASCII texts are scanned without where it can make no difference.
    """
    def entities(flag: str, pattern: str) -> Column:
        pieces, found = (F.regexp_extract_all(text, F.lit(rf"{flag}\G(?s:.*?)({pattern})"), F.lit(k)) for k in (0, 1))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{ENTITY}>").alias("out"))

        def add(state: Column, pair: Column) -> Column:
            end = state["at"] + F.length(pair["piece"])
            start = end - F.length(pair["hit"])
            entity = F.struct(pair["hit"].alias("text"), F.lit(label).alias("label"), start.alias("start"), end.alias("end"),
                              F.lit(confidence).alias("confidence"), _context(text, start, end, window).alias("context"))
            return F.struct(end.alias("at"), F.concat(state["out"], F.array(entity)).cast(f"array<{ENTITY}>").alias("out"))

        pairs = F.arrays_zip(found.alias("hit"), pieces.alias("piece"))
        # most texts match nothing and are only scanned once
        return F.when(F.rlike(text, F.lit(flag + pattern)), F.aggregate(pairs, empty, add, lambda state: state["out"])).otherwise(
            F.array().cast(f"array<{ENTITY}>"))

    if not same_in_ascii(pattern):
        return entities("(?U)", pattern)
    plain = pattern.replace(r"[\p{L}\p{N}_]", r"\w")
    return F.when(F.octet_length(text) == F.length(text), entities("", plain)).otherwise(entities("(?U)", pattern))


def same_in_ascii(pattern: str) -> bool:
    """True if a regex matches the same in ASCII texts whether or not its classes and cases follow Unicode."""
    return pattern.isascii() and not re.search(r"\\[uxN0cpP]|\(\?\w*[uU]", re.sub(r"\\p\{[LN]\}", "", pattern))


def located_entities(text: Column, patterns: Iterable[tuple[str, str, float]], window: int = R.CONTEXT_CHARS) -> Column:
    """Matches of several (label, regex, confidence), pattern by pattern."""
    return F.concat(*[located(text, pattern, label, confidence, window) for label, pattern, confidence in patterns])


def phone_entities(text: Column) -> Column:
    return located_entities(text, [("PHONE", p, R.ENTITY_CONFIDENCE["PHONE"]) for p in R.PHONE_PATTERNS])


def email_entities(text: Column) -> Column:
    return located_entities(text, [("EMAIL", R.EMAIL_PATTERN, R.ENTITY_CONFIDENCE["EMAIL"])])


def contact_entities(text: Column) -> Column:
    """Phones, then e-mails."""
    return F.concat(phone_entities(text), email_entities(text))


def located_tokens(text: Column, patterns: Mapping[str, str] = R.TOKEN_PATTERNS) -> Column:
    """Token-shape matches with offsets and surroundings."""
    return located_entities(text, [(name, p, R.ENTITY_CONFIDENCE["TOKEN"]) for name, p in patterns.items()])


def located_phrases(text: Column, terms: Sequence[str] | None = None) -> Column:
    """Terms on word edges with offsets and surroundings; longer terms first."""
    return located_entities(text, [("PHRASE", p, R.ENTITY_CONFIDENCE["PHRASE"]) for p in phrase_patterns(terms)])


def all_entities(text: Column) -> Column:
    """Contacts, medical terms, token shapes and phrases of a text, repeats kept."""
    return F.concat(contact_entities(text), medical_terms(text), located_tokens(text), located_phrases(text))


def entity_rows(df: DataFrame, key: str, text: str, entities: Column | None = None) -> DataFrame:
    """One row per entity; ``listed`` is its place in the list of its text, so matchers' order."""
    found = all_entities(F.col(text)) if entities is None else entities
    rows = df.select(key, F.posexplode_outer(found).alias("listed", "e")).where(F.col("e").isNotNull())
    return rows.select(key, "e.*", "listed")


def merged_entities(rows: DataFrame, key: str) -> DataFrame:
    """One entity of each run of overlapping spans: the longest, then the first, then the one listed first.

    Spans that touch don't overlap; a run goes on as long as each next span begins before the farthest end so far, so it may hold spans
    that only others connect.  Runs are found by a running maximum and ordered by windows over one text's entities.
    """
    along = Window.partitionBy(key).orderBy("start", "end", "listed")
    farthest = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    runs = rows.withColumn("_new", F.coalesce(F.col("start") >= farthest, F.lit(True)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    best = Window.partitionBy(key, "_run").orderBy(F.desc(F.col("end") - F.col("start")), "start", "listed")
    return runs.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_new", "_run", "_place", "listed")
