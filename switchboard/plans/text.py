"""Queries over single texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import entities as E
from switchboard.functions import intents as I
from switchboard.functions import text as T
from switchboard.functions import topics as TP
from switchboard.operators import coaching as CO
from switchboard.operators import insights as IN
from switchboard.operators import topics as TO
from switchboard.plans import tables as B
from switchboard.plans.registry import (big, joined, num, q, query, sql_any, sql_best, sql_bare, sql_first, sql_hits,
                                        sql_matched, sql_sentiment, sql_urgency, sql_word_count, sql_words)


def _low(spark, d):
    return B.calls(spark, d).select("call_id", F.lower("transcript").alias("low"))


WORDS = B.TERMS + ["no", "um"]


@query("keyword_hits", f"WITH {B.CALLS} SELECT call_id, CAST({sql_hits('low', WORDS)} AS BIGINT) AS hits FROM calls")
def keyword_hits(spark, d):
    return _low(spark, d).select("call_id", big(T.keyword_hits(F.col("low"), WORDS)).alias("hits"))


@query("lexicon_sentiment", f"WITH {B.CALLS} SELECT call_id, round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment FROM calls")
def lexicon_sentiment(spark, d):
    return _low(spark, d).select("call_id", num(T.sentiment(F.col("low"), B.SENTIMENT)).alias("sentiment"))


@query("quick_sentiment", f"WITH {B.CHUNKS} SELECT call_id, CAST(seq AS BIGINT) AS seq, round({sql_sentiment('low', B.SENTIMENT)}, 6) AS sentiment FROM chunks")
def quick_sentiment(spark, d):
    return B.chunks(spark, d).select("call_id", big("seq").alias("seq"),
                                     num(T.sentiment(F.lower("text"), B.SENTIMENT)).alias("sentiment"))


@query("segment_sentiment", f"WITH {B.CHUNKS} SELECT call_id, CAST(seq AS BIGINT) AS seq, round({sql_sentiment('low', R.SEGMENT_SENTIMENT)}, 6) AS sentiment FROM chunks")
def segment_sentiment(spark, d):
    return B.chunks(spark, d).select("call_id", big("seq").alias("seq"),
                                     num(T.sentiment(F.lower("text"), R.SEGMENT_SENTIMENT)).alias("sentiment"))


@query("keyword_intent", f"WITH {B.CALLS} SELECT call_id, {sql_first('low', B.INTENTS, 'inquiry')} AS intent FROM calls")
def keyword_intent(spark, d):
    return _low(spark, d).select("call_id", T.keyword_intent(F.col("low"), B.INTENTS).alias("intent"))


@query("urgency_level", f"WITH {B.CALLS} SELECT call_id, CAST({sql_urgency('low', B.URGENCY)} AS BIGINT) AS urgency FROM calls")
def urgency_level(spark, d):
    return _low(spark, d).select("call_id", big(T.urgency_level(F.col("low"), B.URGENCY)).alias("urgency"))


def _sql_label(t, lex):
    return (f"(CASE WHEN {sql_any(t, lex['high'])} THEN 'high' WHEN {sql_any(t, lex['medium'])} AND NOT {sql_any(t, lex['low'])} "
            f"THEN 'medium' WHEN {sql_any(t, lex['low'])} THEN 'low' ELSE 'medium' END)")


@query("urgency_label", f"WITH {B.CALLS} SELECT call_id, {_sql_label('low', B.URGENCY_LABELS)} AS label FROM calls")
def urgency_label(spark, d):
    return _low(spark, d).select("call_id", T.urgency_label(F.col("low"), B.URGENCY_LABELS).alias("label"))


def sql_norm(t):
    return f"regexp_replace(trim(regexp_replace(lower({t}), {q(T.SPACE)}, ' ', 'g')), {q(T.NOT_KEPT)}, '', 'g')"


@query("normalise_text", f"WITH {B.CALLS} SELECT call_id, {sql_norm('transcript')} AS text FROM calls")
def normalise_text(spark, d):
    return B.calls(spark, d).select("call_id", T.normalise_text(F.col("transcript")).alias("text"))


RULES = {
    "opening": {"keywords": ["the", "that", "thing"], "phrases": ["of the", "in the"],
                "patterns": [r"(?:the|that).*whi", r"(?:of|from).*(?:ing|tion)"], "boost": 0.1},
    "middle": {"keywords": ["der", "keit", "zu", "auf"], "phrases": ["und der"],
               "patterns": [r"(?:und|die).*keit", r"(?:sch|ver).*(?:pf|tz)"], "boost": 0.05},
    "closing": {"keywords": ["que", "eaux", "los", "ment"], "phrases": ["de la", "en el"],
                "patterns": [r"(?:les|las).*ou"], "boost": 0.02},
    "general_inquiry": {"keywords": ["no", "um"], "phrases": [], "patterns": [r"(?:www|http)"], "boost": 0.0},
}


def _sql_score(t, rule):
    parts = []
    for part in ("keywords", "phrases"):
        if rule[part]:
            parts.append(f"{sql_hits(t, rule[part])}::DOUBLE / {len(rule[part])} * {R.INTENT_WEIGHTS[part]}")
    if rule["patterns"]:
        found = " + ".join(f"CAST(regexp_matches({t}, {q(p)}) AS INT)" for p in rule["patterns"])
        parts.append(f"({found})::DOUBLE / {len(rule['patterns'])} * {R.INTENT_WEIGHTS['patterns']}")
    s = "(0.0::DOUBLE + " + " + ".join(parts) + ")"
    return f"(CASE WHEN {s} > 0 THEN least(1.0, {s} + {rule['boost']}) ELSE {s} END)"


_NORMED = f"WITH {B.CALLS}, normed AS (SELECT call_id, low, lang, {sql_norm('transcript')} AS norm FROM calls)"
_SCORED = _NORMED + ", scored AS (SELECT call_id, low, lang, " + ", ".join(
    f"{_sql_score('norm', r)} AS score_{n}" for n, r in RULES.items()) + " FROM normed)"


@query("intent_scores", _SCORED + " SELECT call_id, " + ", ".join(f"round(score_{n}, 6) AS score_{n}" for n in RULES) + " FROM scored")
def intent_scores(spark, d):
    scored = I.score_intents(B.calls(spark, d), "transcript", RULES)
    return scored.select("call_id", *[num(f"score_{n}").alias(f"score_{n}") for n in RULES])


_LABEL, _TOP = sql_best({n: f"score_{n}" for n in RULES})
_PRIMARY = (f"CASE WHEN {_TOP} >= 0.3 THEN {_LABEL} ELSE 'general_inquiry' END AS primary_intent, "
            f"round(CASE WHEN {_TOP} >= 0.3 THEN {_TOP} ELSE score_general_inquiry END, 6) AS confidence")


@query("primary_intent", _SCORED + f" SELECT call_id, {_PRIMARY}, {_sql_label('low', B.URGENCY_LABELS)} AS urgency FROM scored")
def primary_intent(spark, d):
    out = I.classify_intents(B.calls(spark, d), "transcript", RULES, urgency=B.URGENCY_LABELS)
    return out.select("call_id", "primary_intent", num("intent_confidence").alias("confidence"), "urgency")


_GAINS = {"is_english": ("opening", 0.1), "is_german": ("middle", 0.15), "is_french": ("middle", 0.1), "is_spanish": ("closing", 0.1)}
_CTX = {"opening": "+ (CASE WHEN lang = 'en' THEN 0.1 ELSE 0 END)",
        "middle": "+ (CASE WHEN lang = 'de' THEN 0.15 ELSE 0 END) + (CASE WHEN lang = 'fr' THEN 0.1 ELSE 0 END)",
        "closing": "+ (CASE WHEN lang = 'es' THEN 0.1 ELSE 0 END)", "general_inquiry": ""}


@query("with_context", _SCORED + " SELECT call_id, " + ", ".join(
    f"round(least(1.0, score_{n} {_CTX[n]}), 6) AS score_{n}" for n in RULES) + " FROM scored")
def with_context(spark, d):
    calls = B.calls(spark, d)
    context = calls.select("call_id", *[(F.col("lang") == code).alias(f"is_{name}") for name, code in (
        ("english", "en"), ("german", "de"), ("french", "fr"), ("spanish", "es"))])
    scored = I.score_intents(calls.join(context, "call_id", "left"), "transcript", RULES, context=_GAINS)
    return scored.select("call_id", *[num(f"score_{n}").alias(f"score_{n}") for n in RULES])


@query("rule_sets", "SELECT CAST(n AS BIGINT) AS intents, part, CAST(e AS BIGINT) AS entries, CAST(docs AS BIGINT) AS matching_docs FROM "
       "(SELECT 10 AS n, 'keywords' AS part, %d AS e) CROSS JOIN (SELECT count(*) AS docs FROM documents WHERE contains(lower(text), 'the'))"
       % (sum(len(r["keywords"]) for n, r in R.INTENTS.items() if n != "complaint") + 3))
def rule_sets(spark, d):
    """Rules replaced and added, then the new keyword looked up in the corpus."""
    changed = I.update_rules(R.INTENTS, {"complaint": {"keywords": ["the", "bad"]}, "new_one": {"keywords": ["the"]}})
    table = I.describe_rules(spark, changed).where("part = 'keywords'")
    docs = _low(spark, d).where(T.any_of(F.col("low"), changed["new_one"]["keywords"])).agg(F.count("*")).scalar()
    return table.groupBy("part").agg(F.count_distinct("intent").alias("intents"), F.count("*").alias("entries")).select(
        big("intents").alias("intents"), "part", big("entries").alias("entries"), big(docs).alias("matching_docs"))


# texts in which the dates and times of the table are spelled out, derived from the orders
_ORDER_TEXT = ("Order on {m} {d} or {mm}/{dd}/{yyyy} at {h} pm, monday next week. Call 555-{k4}-{k4b}.")


def _spelled(spark, d):
    ts = F.col("o_orderdate").cast("timestamp")
    hour = (F.col("o_orderkey") % 12 + 1).cast("string")
    return B.read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("call_id"),
        F.concat(F.lit("Order on "), F.date_format(ts, "MMMM d"), F.lit(" or "), F.date_format(ts, "MM/dd/yyyy"),
                 F.lit(" at "), hour, F.lit(" pm, Monday next week. Call 555-"),
                 F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit("-"),
                 F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"), F.lit(" now, aetna covered.")).alias("transcript"))


_SPELLED = ("spelled AS (SELECT CAST(o_orderkey AS VARCHAR) AS call_id, 'Order on ' || strftime(o_orderdate, '%B %-d') || ' or ' || "
            "strftime(o_orderdate, '%m/%d/%Y') || ' at ' || CAST(o_orderkey % 12 + 1 AS VARCHAR) || ' pm, Monday next week. Call 555-' || "
            "lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || "
            "' now, aetna covered.' AS transcript FROM orders)")


def _sql_all(t, pattern):
    return f"regexp_extract_all({t}, {q(pattern)})"


def _sql_lists(*parts):
    return "array_to_string(list_concat(" + ", ".join(parts) + "), '|')"


@query("scheduling_entities", f"WITH {_SPELLED} SELECT call_id, "
       f"{_sql_lists(_sql_all('transcript', R.CLOCK_TIME), _sql_all('transcript', R.DAY_PART))} AS preferred_times, "
       f"array_to_string({_sql_all('transcript', '(?i)' + R.WEEKDAY_OR_RELATIVE)}, '|') AS preferred_days FROM spelled")
def scheduling_entities(spark, d):
    e = I.scheduling_entities(F.col("transcript"))
    return _spelled(spark, d).select("call_id", *[joined(c).alias(n) for n, c in e.items()])


_PAIN = [r"(?:the|der)\s*(?:of|die)", r"de\s*(?:la|los)"]


@query("emergency_entities", f"WITH {B.CALLS} SELECT call_id, {_sql_lists(*[_sql_all('transcript', '(?i)' + p) for p in _PAIN])} AS pain_description, "
       f"{sql_matched('low', B.TERMS)} AS symptoms FROM calls")
def emergency_entities(spark, d):
    e = I.emergency_entities(F.col("transcript"), _PAIN, B.TERMS)
    return B.calls(spark, d).select("call_id", *[joined(c).alias(n) for n, c in e.items()])


@query("insurance_entities", f"WITH {B.CALLS} SELECT call_id, {sql_matched('low', B.TERMS)} AS insurance_providers, "
       f"{sql_matched('low', B.TOPICS['german'])} AS coverage_terms FROM calls")
def insurance_entities(spark, d):
    e = I.insurance_entities(F.col("transcript"), B.TERMS, B.TOPICS["german"])
    return B.calls(spark, d).select("call_id", *[joined(c).alias(n) for n, c in e.items()])


@query("treatment_entities", f"WITH {B.CALLS} SELECT call_id, {sql_matched('low', B.TERMS)} AS treatments_mentioned FROM calls")
def treatment_entities(spark, d):
    e = I.treatment_entities(F.col("transcript"), B.TERMS)
    return B.calls(spark, d).select("call_id", *[joined(c).alias(n) for n, c in e.items()])


@query("intent_entities", f"WITH {_SPELLED} SELECT call_id, CASE CAST(call_id AS BIGINT) % 3 WHEN 0 THEN "
       f"{_sql_lists(_sql_all('transcript', R.CLOCK_TIME), _sql_all('transcript', R.DAY_PART))} WHEN 1 THEN "
       f"{sql_matched('lower(transcript)', R.INTENT_PROVIDERS)} ELSE '' END AS found FROM spelled")
def intent_entities(spark, d):
    kind = F.col("call_id").cast("bigint") % 3
    intent = F.when(kind == 0, "appointment_booking").when(kind == 1, "insurance_inquiry").otherwise("complaint")
    found = _spelled(spark, d).select("call_id", I.intent_entities(F.col("transcript"), intent).alias("m"))
    listed = F.coalesce(F.element_at("m", F.lit("preferred_times")), F.element_at("m", F.lit("insurance_providers")))
    return found.select("call_id", F.coalesce(joined(listed), F.lit("")).alias("found"))


@query("appointment_info", f"WITH {_SPELLED} SELECT call_id, "
       f"array_to_string(list_concat({_sql_all('transcript', '(?i)' + R.CLOCK_TIME)}, {_sql_all('transcript', '(?i)' + R.DAY_PART)}), '|') AS times, "
       f"array_to_string(list_concat({_sql_all('lower(transcript)', R.WEEKDAY)}, {_sql_all('lower(transcript)', R.RELATIVE_DAY)}), '|') AS days, "
       f"array_to_string(list_concat({_sql_all('transcript', '(?i)' + R.MONTH_DAY)}, {_sql_all('transcript', R.SLASH_DATE)}), '|') AS dates, "
       f"CAST({sql_any('lower(transcript)', R.SCHEDULING_WORDS)} AS INT) AS scheduling FROM spelled")
def appointment_info(spark, d):
    e = E.appointment_info(F.col("transcript"))
    return _spelled(spark, d).select("call_id", *[joined(e[n]).alias(n) for n in ("times", "days", "dates")],
                                     e["has_scheduling_intent"].cast("int").alias("scheduling"))


_PROVIDERS = ["aetna", "12/", "january", "june"]


@query("insurance_info", f"WITH {_SPELLED} SELECT call_id, {sql_matched('lower(transcript)', _PROVIDERS)} AS insurance_providers, "
       f"{sql_matched('lower(transcript)', R.INSURANCE_TERMS)} AS insurance_terms, "
       f"CAST({sql_any('lower(transcript)', _PROVIDERS + R.INSURANCE_TERMS)} AS INT) AS has_insurance_inquiry FROM spelled")
def insurance_info(spark, d):
    e = E.insurance_info(F.col("transcript"), _PROVIDERS)
    return _spelled(spark, d).select("call_id", joined(e["insurance_providers"]).alias("insurance_providers"),
                                     joined(e["insurance_terms"]).alias("insurance_terms"),
                                     e["has_insurance_inquiry"].cast("int").alias("has_insurance_inquiry"))


@query("phone_entities", f"WITH {B.CALLS} SELECT call_id, array_to_string(list_concat(" + ", ".join(
    _sql_all("transcript", p) for p in R.PHONE_PATTERNS) + "), '|') AS phones FROM calls WHERE " + " OR ".join(
    f"regexp_matches(transcript, {q(p)})" for p in R.PHONE_PATTERNS))
def phone_entities(spark, d):
    """Phone numbers with positions; the listed texts are checked."""
    found = B.calls(spark, d).select("call_id", E.phone_entities(F.col("transcript")).alias("e"))
    return found.where(F.size("e") > 0).select("call_id", joined(F.transform("e", lambda x: x["text"])).alias("phones"))


_EMAIL = R.EMAIL_PATTERN
_EMAIL_AT = "(coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))"


@query("email_entities", f"WITH {B.CALLS}, m AS (SELECT call_id, transcript, regexp_extract_all(transcript, {q(_EMAIL)}) AS hits, string_split_regex(transcript, {q(_EMAIL)}) AS gaps "
       f"FROM calls WHERE regexp_matches(transcript, {q(_EMAIL)})), e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM m), "
       f"p AS (SELECT call_id, transcript, hits[i] AS text, CAST({_EMAIL_AT} AS INT) AS start FROM e) "
       f"SELECT call_id, text, 'EMAIL' AS label, start, CAST(start + length(text) AS INT) AS \"end\", CAST({R.ENTITY_CONFIDENCE['EMAIL']} AS DOUBLE) AS confidence, "
       "substring(transcript, greatest(start - 50, 0) + 1, start + length(text) + 50 - greatest(start - 50, 0)) AS context FROM p")
def email_entities(spark, d):
    found = B.calls(spark, d).select("call_id", E.email_entities(F.col("transcript")).alias("e"))
    return found.where(F.size("e") > 0).select("call_id", F.inline("e"))


@query("medical_terms", f"WITH {B.CALLS} SELECT call_id, term, CAST(strpos(low, term) - 1 AS BIGINT) AS start, "
       f"CAST(strpos(low, term) - 1 + length(term) AS BIGINT) AS \"end\", 0.5 AS confidence, "
       f"substring(transcript, CAST(greatest(strpos(low, term) - 1 - 50, 0) + 1 AS BIGINT), "
       f"CAST(strpos(low, term) - 1 + length(term) + 50 - greatest(strpos(low, term) - 1 - 50, 0) AS BIGINT)) AS context "
       f"FROM calls, (SELECT unnest([{', '.join(q(t) for t in B.TERMS)}]) AS term) WHERE contains(low, term)")
def medical_terms(spark, d):
    rows = B.calls(spark, d).select("call_id", F.inline(E.medical_terms(F.col("transcript"), B.TERMS)))
    return rows.select("call_id", F.col("text").alias("term"), big("start").alias("start"), big("end").alias("end"),
                       "confidence", "context")


@query("entity_context", f"WITH {B.CALLS} SELECT call_id, substring(transcript, CAST(greatest(strpos(low, 'tion') - 1 - 10, 0) + 1 AS BIGINT), "
       "CAST(strpos(low, 'tion') - 1 + 4 + 10 - greatest(strpos(low, 'tion') - 1 - 10, 0) AS BIGINT)) AS context FROM calls WHERE contains(low, 'tion')")
def entity_context(spark, d):
    rows = B.calls(spark, d).select("call_id", F.inline(E.medical_terms(F.col("transcript"), ["tion"], window=10)))
    return rows.select("call_id", "context")


def _sql_located(name, table, pattern, label, confidence, window=R.CONTEXT_CHARS, rank=0, only=None):
    """CTE of every match of a pattern with its offsets and surroundings: offsets are running lengths of matches and of what lies between them."""
    label = q(label)
    return (f"{name}_m AS (SELECT call_id, transcript, regexp_extract_all(transcript, {q(pattern)}) AS hits, string_split_regex(transcript, {q(pattern)}) AS gaps FROM {table}), "
            f"{name}_u AS (SELECT call_id, transcript, unnest(hits) AS text, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM {name}_m WHERE len(hits) > 0), "
            f"{name}_s AS (SELECT call_id, transcript, text, {rank} AS rank, i, CAST(sum(length(gap)) OVER (PARTITION BY call_id ORDER BY i) + sum(length(text)) OVER (PARTITION BY call_id ORDER BY i) - length(text) AS BIGINT) AS start FROM {name}_u), "
            f"{name} AS (SELECT call_id, {label} AS label, text, start, start + length(text) AS stop, CAST({confidence} AS DOUBLE) AS confidence, "
            f"substring(transcript, greatest(start - {window}, 0) + 1, start + length(text) + {window} - greatest(start - {window}, 0)) AS context, rank, i FROM {name}_s"
            + (f" WHERE {only}" if only else "") + ")")


_SHOWN = "call_id, label, text, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, confidence, context"
_TOKENS = [("PHONE_0", R.TOKEN_PATTERNS["PHONE_0"]), ("TIME_0", r"(?i)\b\d\s?(?:am|pm)\b"), ("TIME_1", r"(?i)\b\d{2}\s?(?:am|pm)\b"), ("INSURANCE_1", R.TOKEN_PATTERNS["INSURANCE_1"])]


def _sql_tokens(first_rank=0):
    return ", ".join(_sql_located(f"x{k}", "spelled", p, label, R.ENTITY_CONFIDENCE["TOKEN"], rank=first_rank + k) for k, (label, p) in enumerate(_TOKENS))


def _shown(rows):
    return rows.select("call_id", "label", "text", big("start").alias("start"), big("end").alias("stop"), "confidence", "context")


@query("pattern_entities", f"WITH {_SPELLED}, {_sql_tokens()} SELECT {_SHOWN} FROM (" + " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(len(_TOKENS))) + ")")
def pattern_entities(spark, d):
    """Token shapes with their places, confidence and surroundings."""
    return _shown(E.entity_rows(_spelled(spark, d), "call_id", "transcript", E.located_tokens(F.col("transcript"))))


_TERMS = ["the", "die", "les", "por"]


@query("phrase_entities", f"WITH {B.CALLS}, {_sql_located('w', 'calls', '[\\p{L}\\p{N}_]+', 'PHRASE', R.ENTITY_CONFIDENCE['PHRASE'], only='text IN (' + ', '.join(map(q, _TERMS)) + ')')} SELECT {_SHOWN} FROM w")
def phrase_entities(spark, d):
    """Every occurrence of some words in every call, with places, confidence and surroundings."""
    return _shown(E.entity_rows(B.calls(spark, d), "call_id", "transcript", E.located_phrases(F.col("transcript"), _TERMS)))


_ENTITY_RUNS = ("e AS (SELECT * FROM ph UNION ALL " + " UNION ALL ".join(f"SELECT * FROM x{k}" for k in range(len(_TOKENS))) + "), "
                "n AS (SELECT *, CAST(coalesce(start >= max(stop) OVER (PARTITION BY call_id ORDER BY start, stop, rank, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), TRUE) AS INT) AS fresh FROM e), "
                "r AS (SELECT *, sum(fresh) OVER (PARTITION BY call_id ORDER BY start, stop, rank, i ROWS UNBOUNDED PRECEDING) AS run FROM n), "
                "b AS (SELECT *, row_number() OVER (PARTITION BY call_id, run ORDER BY stop - start DESC, start, rank, i) AS place FROM r)")


@query("all_entities", f"WITH {_SPELLED}, {_sql_located('ph', 'spelled', R.PHONE_PATTERNS[0], 'PHONE', R.ENTITY_CONFIDENCE['PHONE'])}, {_sql_tokens(1)}, {_ENTITY_RUNS} SELECT {_SHOWN} FROM b WHERE place = 1")
def all_entities(spark, d):
    """All matchers over one text, of overlapping entities the longest."""
    rows = E.entity_rows(_spelled(spark, d), "call_id", "transcript")
    return _shown(E.merged_entities(rows, "call_id"))


# --- topics -----------------------------------------------------------------------------------

_TOK = (r"list_filter(string_split_regex(low, '[^\p{L}\p{N}_]+'), lambda x: length(x) > 2 AND NOT regexp_matches(x, '[\p{N}_]'))")


@query("tokenise", f"WITH {B.CALLS} SELECT call_id, CAST(len({_TOK}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOK})) AS BIGINT) AS n_distinct FROM calls")
def tokenise(spark, d):
    t = TO.tokenise(B.calls(spark, d), stop_words=[])
    return t.select("call_id", big(F.size("tokens")).alias("n_tokens"), big(F.size(F.array_distinct("tokens"))).alias("n_distinct"))


@query("topic_vocabulary", f"WITH {B.CALLS}, u AS (SELECT call_id, {_TOK} AS tok FROM calls), k AS (SELECT * FROM u WHERE len(tok) > {TO.MIN_DOC_TOKENS}), "
       "t AS (SELECT term, CAST(count(*) AS BIGINT) AS docs FROM (SELECT unnest(list_distinct(tok)) AS term FROM k) GROUP BY 1) "
       "SELECT term, docs FROM t WHERE docs >= 3 AND docs <= 0.5 * (SELECT count(*) FROM k)")
def topic_vocabulary(spark, d):
    """Terms that a topic model may have, counted and pruned on the cluster."""
    return TO.topic_vocabulary(TO.usable_documents(TO.tokenise(B.calls(spark, d), stop_words=[])), 3, 0.5)


_VOCABULARY = 200


@query("vocabulary_loss", f"WITH {B.CALLS}, u AS (SELECT call_id, {_TOK} AS tok FROM calls), k AS (SELECT * FROM u WHERE len(tok) > {TO.MIN_DOC_TOKENS}), "
       "t AS (SELECT term, count(DISTINCT call_id) AS docs, count(*) AS tokens FROM (SELECT call_id, unnest(tok) AS term FROM k) GROUP BY 1), "
       "v AS (SELECT *, row_number() OVER (ORDER BY docs DESC, term) AS place FROM t WHERE docs >= 2 AND docs <= 0.7 * (SELECT count(*) FROM k)) "
       f"SELECT CAST(count(*) AS BIGINT) AS terms, CAST(count(*) FILTER (WHERE place <= {_VOCABULARY}) AS BIGINT) AS kept, CAST(sum(tokens) AS BIGINT) AS tokens, "
       f"CAST(coalesce(sum(tokens) FILTER (WHERE place > {_VOCABULARY}), 0) AS BIGINT) AS lost FROM v")
def vocabulary_loss(spark, d):
    """What a topic model of the most frequent terms leaves out."""
    usable = TO.usable_documents(TO.tokenise(B.calls(spark, d), stop_words=[]))
    return TO.vocabulary_loss(usable, TO.topic_vocabulary(usable), _VOCABULARY)


def _sql_overlap(words):
    return f"len(list_intersect({_TOK}, [{', '.join(q(w) for w in words)}]))::DOUBLE / {len(words)}"


@query("token_overlap", f"WITH {B.CALLS} SELECT call_id, round({_sql_overlap(B.TOPICS['english'])}, 6) AS overlap FROM calls")
def token_overlap(spark, d):
    t = TO.tokenise(B.calls(spark, d), stop_words=[])
    return t.select("call_id", num(TP.token_overlap(F.col("tokens"), B.TOPICS["english"])).alias("overlap"))


_OV = {n: f"t_{n}" for n in B.TOPICS}
_OVL, _OVT = sql_best(_OV)


@query("predefined_topic_scores", f"WITH {B.CALLS}, s AS (SELECT call_id, " + ", ".join(
    f"{_sql_overlap(w)} AS t_{n}" for n, w in B.TOPICS.items()) + f" FROM calls) SELECT call_id, {_OVL} AS topic, round({_OVT}, 6) AS score FROM s")
def predefined_topic_scores(spark, d):
    t = TO.tokenise(B.calls(spark, d), stop_words=[])
    scored = t.select("call_id", *[c.alias(f"t_{n}") for n, c in TP.topic_scores(F.col("tokens"), B.TOPICS).items()])
    label, top = T.best_label({n: F.col(f"t_{n}") for n in B.TOPICS})
    return scored.select("call_id", label.alias("topic"), num(top).alias("score"))


@query("fallback_topics", f"WITH {B.CALLS}, s AS (SELECT call_id, " + ", ".join(
    f"{sql_hits('low', w)}::DOUBLE / {len(w)} AS t_{n}" for n, w in B.TOPICS.items())
    + f" FROM calls) SELECT call_id, {_OVL} AS topic, replace({_OVL}, '_', ' ') AS theme, round({_OVT}, 6) AS score FROM s")
def fallback_topics(spark, d):
    scored = _low(spark, d).select("call_id", *[c.alias(f"t_{n}") for n, c in TP.fallback_topic_scores(F.col("low"), B.TOPICS).items()])
    label, top = T.best_label({n: F.col(f"t_{n}") for n in B.TOPICS})
    return scored.select("call_id", label.alias("topic"), F.replace(label, F.lit("_"), F.lit(" ")).alias("theme"), num(top).alias("score"))


@query("best_label", f"WITH {B.CALLS}, s AS (SELECT call_id, " + ", ".join(
    f"length(low) - length(replace(low, {q(w[0])}, '')) AS t_{n}" for n, w in B.TOPICS.items())
    + f" FROM calls) SELECT call_id, {_OVL} AS label, CAST({_OVT} AS BIGINT) AS score FROM s")
def best_label(spark, d):
    scored = _low(spark, d).select("call_id", *[
        (F.length("low") - F.length(F.replace("low", F.lit(w[0]), F.lit("")))).alias(f"t_{n}") for n, w in B.TOPICS.items()])
    label, top = T.best_label({n: F.col(f"t_{n}") for n in B.TOPICS})
    return scored.select("call_id", label.alias("label"), big(top).alias("score"))


@query("dominant_topic", f"WITH {B.CALLS}, s AS (SELECT call_id, duration, " + ", ".join(
    f"{sql_hits('low', w)}::DOUBLE / {len(w)} AS t_{n}" for n, w in B.TOPICS.items())
    + f" FROM calls) SELECT call_id, CASE WHEN {_OVT} > 0.3 AND {_OVT} > duration / 2000 THEN {_OVL} WHEN duration > 300 THEN "
      f"'lda_topic_' || CAST(CAST(duration AS BIGINT) % 6 AS VARCHAR) ELSE {_OVL} END AS topic FROM s")
def dominant_topic(spark, d):
    scored = B.calls(spark, d).withColumn("low", F.lower("transcript")).select("call_id", "duration", *[
        c.alias(f"t_{n}") for n, c in TP.fallback_topic_scores(F.col("low"), B.TOPICS).items()])
    label, top = T.best_label({n: F.col(f"t_{n}") for n in B.TOPICS})
    model = F.when(F.col("duration") > 300, F.col("duration").cast("bigint") % 6)
    return scored.select("call_id", TP.dominant_topic(label, top, F.col("duration") / 2000, model).alias("topic"))


_LBL = f"list_slice({_TOK}, 1, 3)"


@query("topic_label", f"WITH {B.CALLS} SELECT call_id, CASE " + " ".join(
    f"WHEN len(list_intersect({_LBL}, [{', '.join(q(w) for w in ws)}])) >= 2 THEN {q(n.title())}" for n, ws in B.TOPICS.items())
    + f" ELSE array_to_string({_LBL}, ' + ') END AS label FROM calls")
def topic_label(spark, d):
    t = TO.tokenise(B.calls(spark, d), stop_words=[])
    return t.select("call_id", TP.topic_label(F.slice("tokens", 1, 3), B.TOPICS).alias("label"))


@query("vocabulary", "SELECT word, CAST((SELECT count(*) FROM documents WHERE contains(lower(text), word)) AS BIGINT) AS docs FROM "
       f"(SELECT unnest([{', '.join(q(w) for w in sorted({w for g in B.TOPICS.values() for w in g}))}]) AS word)")
def vocabulary(spark, d):
    """Topic words with the number of documents that hold them, from one scan."""
    words = TP.vocabulary(B.TOPICS)
    counts = _low(spark, d).agg(*[F.count_if(F.contains("low", F.lit(w))).alias(w) for w in words])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(w).alias("word"), F.col(f"`{w}`").alias("docs")) for w in words])))


# --- whole-text helpers -------------------------------------------------------------------------

_LONG = 120


@query("trim_transcript", f"WITH {B.CALLS} SELECT call_id, md5(CASE WHEN {sql_word_count('transcript')} <= {_LONG} THEN "
       f"regexp_replace(transcript, {q('^' + T.SPACE + '|' + T.SPACE + '$')}, '', 'g') ELSE "
       f"array_to_string(list_slice({sql_words('transcript')}, 1, {_LONG // 2}), ' ') || {q(T.OMITTED)} || "
       f"array_to_string(list_slice({sql_words('transcript')}, -{_LONG // 2}, -1), ' ') END) AS digest FROM calls")
def trim_transcript(spark, d):
    return B.calls(spark, d).select("call_id", F.md5(T.trim_transcript(F.col("transcript"), _LONG)).alias("digest"))


@query("count_occurrences", f"WITH {B.CALLS} SELECT call_id, CAST((length(low) - length(replace(low, 'of the', ''))) / 6 AS BIGINT) AS n FROM calls")
def count_occurrences(spark, d):
    return _low(spark, d).select("call_id", big(T.count_occurrences(F.col("low"), "of the")).alias("n"))


@query("calendar_features", "SELECT CAST(event_id AS VARCHAR) AS call_id, CAST(hour(ts) AS BIGINT) AS hour, CAST(isodow(ts) - 1 AS BIGINT) AS day_of_week, "
       "CAST(month(ts) AS BIGINT) AS month, CAST(isodow(ts) >= 6 AS BIGINT) AS is_weekend, CAST(hour(ts) BETWEEN 8 AND 17 AS BIGINT) AS is_business_hours FROM events")
def calendar_features(spark, d):
    return B.insights(spark, d).select("call_id", *[big(c).alias(n) for n, c in T.calendar_features(F.col("ts")).items()])


_SIG = {"urgency_indicators": ["that", "keit"], "satisfaction_predictors": ["the", "und", "los "], "conversion_signals": ["of the", "de la"]}


@query("business_signals", f"WITH {B.CALLS} SELECT call_id, " + ", ".join(f"{sql_matched('low', w)} AS {n}" for n, w in _SIG.items()) + " FROM calls")
def business_signals(spark, d):
    out = IN.business_signals(B.calls(spark, d), urgency=_SIG["urgency_indicators"],
                              satisfaction=_SIG["satisfaction_predictors"], conversion=_SIG["conversion_signals"])
    return out.select("call_id", *[joined(n).alias(n) for n in _SIG])


@query("concerns", f"WITH {B.CHUNKS} SELECT call_id, CAST(seq AS BIGINT) AS seq, concat_ws('|', " + ", ".join(
    f"CASE WHEN {sql_any('low', w)} THEN {q(n)} END" for n, w in B.CONCERNS.items()) + ") AS concerns FROM chunks")
def concerns(spark, d):
    return B.chunks(spark, d).select("call_id", big("seq").alias("seq"),
                                     joined(CO.concerns_of(F.lower("text"), B.CONCERNS)).alias("concerns"))


_X = B.RULES


@query("staff_indicators", f"WITH {B.CHUNKS} SELECT call_id, CAST(seq AS BIGINT) AS seq, round(least(1.0, {sql_hits('low', _X['empathy'])} / 3.0), 6) AS empathy, "
       f"CASE WHEN {sql_word_count('text')} > 10 THEN 0.8 ELSE 0.5 END::DOUBLE AS efficiency, round(least(1.0, {sql_hits('low', _X['knowledge'])} / 2.0), 6)::DOUBLE AS knowledge, "
       f"round(1.0 - least(1.0, {sql_hits('low', _X['unprofessional'])} / 5.0), 6)::DOUBLE AS professionalism FROM chunks WHERE speaker = 'staff'")
def staff_indicators(spark, d):
    rows = B.chunks(spark, d).where("speaker = 'staff'")
    x = CO.staff_indicators(F.lower("text"), F.col("text"), _X)
    return rows.select("call_id", big("seq").alias("seq"), *[num(c).alias(n) for n, c in x.items()])


@query("customer_state", f"WITH {B.CHUNKS} SELECT call_id, CAST(seq AS BIGINT) AS seq, CASE WHEN {sql_any('low', _X['emotion'])} THEN 'high' ELSE 'normal' END AS emotion, "
       f"CASE WHEN {sql_any('low', _X['satisfied'])} THEN 'positive' WHEN {sql_any('low', _X['dissatisfied'])} THEN 'negative' ELSE 'neutral' END AS satisfaction, "
       f"CASE WHEN contains(text, '?') THEN 'high' ELSE 'normal' END AS engagement FROM chunks WHERE speaker = 'customer'")
def customer_state(spark, d):
    x = CO.customer_state(F.lower("text"), F.col("text"), _X)
    return B.chunks(spark, d).where("speaker = 'customer'").select("call_id", big("seq").alias("seq"), *[c.alias(n) for n, c in x.items()])
