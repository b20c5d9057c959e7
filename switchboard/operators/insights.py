"""Structured insights: building, checking, storing-side updates and reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard import schema as S
from switchboard.functions import entities as E
from switchboard.functions import intents as I
from switchboard.functions import text as T
from switchboard.functions import topics as TP
from switchboard.operators.engines import Engine, with_engines

DEFAULT_PROFILE = {
    "sentiment": R.FALLBACK_SENTIMENT, "intents": R.FALLBACK_INTENTS, "urgency": R.FALLBACK_URGENCY,
    "confidence": 0.2, "journey_follows": True,
    "pain_points": ["analysis_failed"], "next_actions": ["manual_review_needed"],
}
LEGACY_PROFILE = {
    "sentiment": R.LEGACY_SENTIMENT, "intents": {}, "urgency": None,
    "confidence": 0.1, "journey_follows": False, "pain_points": [], "next_actions": [],
}
PROFILES = {"default": DEFAULT_PROFILE, "legacy": LEGACY_PROFILE}
FALLBACK_REVENUE = 100.0
ANSWER_FENCE = r"(?s)```json(.*?)```"


def _strings(items: Sequence[str]) -> Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def _doubles(**pairs) -> Column:
    flat = []
    for k, v in pairs.items():
        flat += [F.lit(k), v if isinstance(v, Column) else F.lit(float(v))]
    return F.create_map(*flat)


def _from_signals(sentiment: Column, intent: Column, urgency: Column, profile: Mapping) -> dict[str, Column]:
    later = sentiment if profile["journey_follows"] else F.lit(0.0)
    none = _strings([])
    return {
        "clinic_mentioned": F.lit("unknown"),
        "primary_intent": intent,
        "secondary_intents": none,
        "sentiment_score": sentiment,
        "emotional_journey": _doubles(beginning=0.0, middle=later, end=later),
        "urgency_level": urgency,
        "resolution_status": F.lit("unknown"),
        "staff_performance": _doubles(empathy=0.5, efficiency=0.5, knowledge=0.5, professionalism=0.5),
        "revenue_opportunity": F.lit(FALLBACK_REVENUE),
        "service_requests": none,
        "pain_points": _strings(profile["pain_points"]),
        "success_factors": none,
        "next_actions": _strings(profile["next_actions"]),
        "confidence_score": F.lit(profile["confidence"]),
    }


def _profile(profile: str | Mapping) -> Mapping:
    return PROFILES[profile] if isinstance(profile, str) else {**DEFAULT_PROFILE, **profile}


def fallback_insight(calls: DataFrame, profile: str | Mapping = "default", ts: Column | None = None,
                     text: str = "transcript") -> DataFrame:
    """Rule-only insight of every call; a pure projection."""
    p = _profile(profile)
    when = ts if ts is not None else F.current_timestamp()
    low = calls.select("call_id", when.alias("ts"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    signals = low.select(
        "call_id", "ts",
        T.sentiment(F.col("_low"), p["sentiment"]).alias("_sentiment"),
        T.keyword_intent(F.col("_low"), p["intents"]).alias("_intent"),
        (T.urgency_level(F.col("_low"), p["urgency"]) if p["urgency"] else F.lit(1)).alias("_urgency"))
    fields = _from_signals(F.col("_sentiment"), F.col("_intent"), F.col("_urgency"), p)
    return signals.select("call_id", "ts", *[c.alias(n) for n, c in fields.items()])


def fallback_insight_of_chunks(chunks: DataFrame, profile: str | Mapping = "default") -> DataFrame:
    """The same insight of a call given as separate lines.

    A word never spans two lines, so the words of a call are the union of the
    words of its lines: each line becomes one bit mask and the masks are
    or-ed per call.  Nothing is concatenated or collected, and a call of any
    length is combined on the map side first.
    """
    p = _profile(profile)
    urgency = p["urgency"] or {"critical": [], "elevated": []}
    lexicon = list(dict.fromkeys(
        [*p["sentiment"]["positive"], *p["sentiment"]["negative"],
         *[w for ws in p["intents"].values() for w in ws], *urgency["critical"], *urgency["elevated"]]))
    groups = [lexicon[i:i + 60] for i in range(0, len(lexicon), 60)]
    low = chunks.select("call_id", "ts", F.lower("text").alias("_low"))
    masked = low.select("call_id", "ts", *[T.word_mask(F.col("_low"), g).alias(f"_m{i}")
                                          for i, g in enumerate(groups)])
    merged = masked.groupBy("call_id").agg(
        F.max("ts").alias("ts"), *[F.bit_or(f"_m{i}").alias(f"_m{i}") for i in range(len(groups))])
    place = {w: (i, j) for i, g in enumerate(groups) for j, w in enumerate(g)}

    def bits(words: Sequence[str]) -> list[tuple[int, int]]:
        per: dict[int, int] = {}
        for w in dict.fromkeys(words):
            i, j = place[w]
            per[i] = per.get(i, 0) | (1 << j)
        return list(per.items())

    def n_hits(words: Sequence[str]) -> Column:
        out = F.lit(0)
        for i, m in bits(words):
            out = out + F.bit_count(F.col(f"_m{i}").bitwiseAND(F.lit(m)))
        return out

    pos, neg = n_hits(p["sentiment"]["positive"]), n_hits(p["sentiment"]["negative"])
    intent = F.lit("inquiry")
    for name, words in reversed(list(p["intents"].items())):
        intent = F.when(n_hits(words) > 0, F.lit(name)).otherwise(intent)
    level = F.lit(1) if not p["urgency"] else (
        F.when(n_hits(urgency["critical"]) > 0, F.lit(5))
        .when(n_hits(urgency["elevated"]) > 0, F.lit(3)).otherwise(F.lit(1)))
    signals = merged.select(
        "call_id", "ts",
        F.when(pos + neg == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg)).alias("_sentiment"),
        intent.alias("_intent"), level.alias("_urgency"))
    fields = _from_signals(F.col("_sentiment"), F.col("_intent"), F.col("_urgency"), p)
    return signals.select("call_id", "ts", *[c.alias(n) for n, c in fields.items()])


# --- stored model answers ------------------------------------------------------

def parse_model_json(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds ``parsed``: the answer as JSON, else the text inside a json fence, else null."""
    raw = F.col(column)

    def strict(c: Column) -> Column:
        parsed = F.from_json(c, S.ANSWER, {"mode": "PERMISSIVE"})
        valid = F.get_json_object(c, "$").isNotNull() & F.rlike(c, F.lit(r"(?s)^\s*\{.*\}\s*$"))
        return F.when(valid, parsed)

    fenced = F.trim(F.regexp_extract(raw, ANSWER_FENCE, 1))
    return answers.withColumn("parsed", F.coalesce(strict(raw), strict(fenced)))


def apply_defaults(df: DataFrame) -> DataFrame:
    """Absent insight fields take their defaults; numbers are cast."""
    no_map = F.create_map().cast("map<string,double>")
    defaults = {
        "clinic_mentioned": F.lit("unknown"), "primary_intent": F.lit("inquiry"),
        "secondary_intents": _strings([]), "sentiment_score": F.lit(0.0), "emotional_journey": no_map,
        "urgency_level": F.lit(1), "resolution_status": F.lit("unknown"), "staff_performance": no_map,
        "revenue_opportunity": F.lit(0.0), "service_requests": _strings([]),
        "pain_points": _strings([]), "success_factors": _strings([]), "next_actions": _strings([]),
        "confidence_score": F.lit(0.0),
    }
    casts = {"sentiment_score": "double", "urgency_level": "int", "revenue_opportunity": "double",
             "confidence_score": "double"}
    out = {}
    for name, default in defaults.items():
        if name in df.columns:
            c = F.col(name).cast(casts[name]) if name in casts else F.col(name)
            out[name] = F.coalesce(c, default)
        else:
            out[name] = default
    return df.withColumns(out)


def insights_from_answers(calls: DataFrame, column: str = "answer", ts: Column | None = None,
                          profile: str | Mapping = "default") -> DataFrame:
    """Parsed answers with defaults; calls whose answer cannot be read fall back to rules."""
    when = (ts if ts is not None else F.current_timestamp())
    parsed = parse_model_json(calls.withColumn("ts", when), column)
    good = apply_defaults(parsed.where(F.col("parsed").isNotNull()).select("call_id", "ts", "parsed.*"))
    bad = fallback_insight(parsed.where(F.col("parsed").isNull()), profile, ts=F.col("ts"))
    return good.unionByName(bad)


# --- checks ----------------------------------------------------------------------

def broken_rules() -> Column:
    """Names of the constraints an insight violates."""
    required = ["call_id", "primary_intent", "sentiment_score", "urgency_level", "resolution_status",
                "confidence_score"]
    tests = [F.when(F.col(c).isNull(), F.lit(f"{c} missing")) for c in required]
    tests += [
        F.when(~F.col("sentiment_score").between(-1.0, 1.0), F.lit("sentiment_score range")),
        F.when(~F.col("urgency_level").between(1, 5), F.lit("urgency_level range")),
        F.when(F.col("revenue_opportunity") < 0, F.lit("revenue_opportunity range")),
        F.when(~F.col("confidence_score").between(0.0, 1.0), F.lit("confidence_score range")),
    ]
    return T.compact_strings(tests)


def validate_insights(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``broken``)."""
    checked = df.withColumn("broken", broken_rules())
    return checked.where(F.size("broken") == 0).drop("broken"), checked.where(F.size("broken") > 0)


def acceptable_call(df: DataFrame) -> DataFrame:
    """Adds ``status``: error without transcript and audio, skipped for audio, else accepted."""
    has_text = F.coalesce(F.col("transcript"), F.lit("")) != ""
    audio = F.coalesce(F.col("needs_transcription"), F.lit(False))
    return df.withColumn("status", F.when(~has_text & ~audio, "error")
                         .when(audio & F.col("audio_file").isNotNull(), "skipped")
                         .otherwise("accepted"))


def partial_update(base: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Non-null change fields replace stored ones; changed rows get ``updated_at``."""
    fields = [c for c in changes.columns if c != "call_id"]
    renamed = changes.select("call_id", *[F.col(c).alias(f"_new_{c}") for c in fields],
                             F.lit(True).alias("_changed"))
    joined = base.join(renamed, "call_id", "left")
    old = F.col("updated_at") if "updated_at" in base.columns else F.lit(None).cast("timestamp")
    return joined.withColumns({
        **{c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields},
        "updated_at": F.when(F.col("_changed"), now).otherwise(old),
    }).select(*dict.fromkeys([*base.columns, "updated_at"]))


def dedupe_analyses(calls: DataFrame, analyse: Callable[[DataFrame], DataFrame],
                    text: str = "transcript", prefix: int = 200) -> DataFrame:
    """Runs an expensive step once per (call_id, opening) and shares its result.

    Equal openings of one call_id are one unit of work by definition; the first in text order is
    analysed.  Finding it sorts and shuffles the texts of each input partition's first ones; the join
    back needs the texts by key once more unless the analyses are small enough to broadcast.
    """
    keyed = calls.withColumn("_opening", F.sha2(F.substring(F.col(text), 1, prefix), 256))
    chosen = keyed.groupBy("call_id", "_opening").agg(F.min(text).alias(text))
    analysed = analyse(chosen).select("call_id", "_opening", "analysis")
    return keyed.join(analysed, ["call_id", "_opening"], "left").drop("_opening")


# --- JSON ------------------------------------------------------------------------

def insight_json(df: DataFrame) -> DataFrame:
    """(call_id, json): the full row with an ISO time."""
    row = F.struct(*[F.date_format(F.col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
                     if c == "ts" else F.col(c) for c in df.columns])
    return df.select("call_id", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))


def insight_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    schema = S.INSIGHT.replace("ts timestamp", "timestamp string")
    row = df.select(F.from_json(F.col(column), schema).alias("r")).select("r.*")
    return row.withColumn("timestamp", F.to_timestamp("timestamp")).withColumnRenamed("timestamp", "ts")


# --- whole-call analysis -----------------------------------------------------------

def call_insight_rules(sentiment: Column, has_phone: Column, medical: Column, has_insurance: Column,
                       topic: Column, intent: Column) -> dict[str, Column]:
    """Risks, opportunities, follow-ups, key facts, summary and priority of a call."""
    text = R.CALL_INSIGHTS
    negative, positive = sentiment < -0.5, sentiment > 0.5
    topic_low = F.lower(topic)
    emergency = F.contains(topic_low, F.lit("emergency"))
    appointment = F.contains(topic_low, F.lit("appointment")) & ~emergency
    complaint, booking = intent == "complaint", intent == "booking"

    def lit_when(test: Column, value: str) -> Column:
        return F.when(test, F.lit(value))

    any_risk = (F.coalesce(negative, F.lit(False)) | F.coalesce(emergency, F.lit(False))
                | F.coalesce(complaint, F.lit(False)))
    any_chance = (F.coalesce(positive, F.lit(False)) | F.coalesce(appointment, F.lit(False))
                  | F.coalesce(booking, F.lit(False)))
    priority = F.when(any_risk, "high").when(any_chance, "medium").otherwise("low")
    summary = F.when(any_risk, text["summary"]["high"]).when(any_chance, text["summary"]["medium"]) \
        .otherwise(text["summary"]["low"])
    return {
        "risk_factors": T.compact_strings([
            lit_when(negative, text["negative"][0]), lit_when(emergency, text["emergency"][0]),
            lit_when(complaint, text["complaint"][0])]),
        "opportunities": T.compact_strings([
            lit_when(positive, text["positive"]), lit_when(appointment, text["appointment"]),
            lit_when(booking, text["booking"][0])]),
        "follow_up_actions": T.compact_strings([
            lit_when(negative, text["negative"][1]), lit_when(emergency, text["emergency"][1]),
            lit_when(complaint, text["complaint"][1])]),
        "recommendations": T.compact_strings([lit_when(booking, text["booking"][1])]),
        "key_insights": T.compact_strings([
            lit_when(has_phone, text["phone"]),
            F.when(F.size(medical) > 0, F.concat(F.lit(text["medical"]),
                                                 F.array_join(F.slice(medical, 1, 3), ", "))),
            lit_when(has_insurance, text["insurance"])]),
        "summary": summary,
        "priority": priority,
    }


ENGINES = ("sentiment", "entities", "topics", "intent")


def analyse_calls(calls: DataFrame, engines: Sequence[str] = ENGINES, text: str = "transcript",
                  lexicon: Mapping = R.FALLBACK_SENTIMENT, topics: Mapping = R.TOPICS,
                  intents: Mapping = R.INTENTS, terms: Sequence[str] | None = None,
                  extra: Mapping[str, Callable[[Column], Column]] | None = None,
                  guarded: Mapping[str, Engine] | None = None) -> DataFrame:
    """Runs the chosen engines over each call and derives the call's insights.

    A projection without shuffles, usable on streams.  An engine left out, like
    one that failed, leaves its columns null and the others untouched; ``extra``
    adds engines of the caller's own, each a function from text to a column.  Engines that may fail on some texts
    go into ``guarded``, by the column they give (a built-in one is replaced): where one fails its value is null,
    ``engine_errors`` tells why, and the call's other values and insights are as ever.
    """
    terms = list(terms if terms is not None else E.all_terms())
    base = calls.withColumn("_low", F.lower(F.col(text)))
    low, raw = F.col("_low"), F.col(text)
    cols: dict[str, Column] = {}
    null_s, null_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    cols["sentiment_score"] = T.sentiment(low, lexicon) if "sentiment" in engines else null_d
    if "entities" in engines:
        cols["phone_numbers"] = E.phone_numbers(raw)
        cols["email_addresses"] = E.email_addresses(raw)
        cols["medical_terms"] = T.matched(low, terms)
        cols["has_insurance"] = T.any_of(low, R.INSURANCE_PROVIDERS)
    else:
        for c in ("phone_numbers", "email_addresses", "medical_terms"):
            cols[c] = F.lit(None).cast("array<string>")
        cols["has_insurance"] = F.lit(None).cast("boolean")
    if "topics" in engines:
        for n, c in TP.fallback_topic_scores(low, topics).items():
            cols[f"_topic_{n}"] = c
    out = base.withColumns(cols)
    if "topics" in engines:
        label, top = T.best_label({n: F.col(f"_topic_{n}") for n in topics})
        out = out.withColumns({"dominant_topic": label, "topic_score": top})
    else:
        out = out.withColumns({"dominant_topic": null_s, "topic_score": null_d})
    if "intent" in engines:
        out = I.classify_intents(out, text, intents)
    else:
        out = out.withColumns({"primary_intent": null_s, "intent_confidence": null_d, "urgency": null_s})
    if extra:
        out = out.withColumns({n: f(raw) for n, f in extra.items()})
    if guarded:
        out = with_engines(out, guarded, text)
    rules = call_insight_rules(F.col("sentiment_score"), F.size("phone_numbers") > 0, F.col("medical_terms"),
                               F.col("has_insurance"), F.col("dominant_topic"), F.col("primary_intent"))
    out = out.withColumns(rules)
    return out.drop("_low", *[f"_topic_{n}" for n in topics])


def business_signals(calls: DataFrame, text: str = "transcript",
                     urgency: Sequence[str] = R.URGENCY_PHRASES,
                     satisfaction: Sequence[str] = R.SATISFACTION_PHRASES,
                     conversion: Sequence[str] = R.CONVERSION_PHRASES) -> DataFrame:
    """Urgency, satisfaction and conversion phrases of a whole call."""
    low = calls.select("call_id", F.lower(F.col(text)).alias("_low"))
    return low.select("call_id", T.matched(F.col("_low"), urgency).alias("urgency_indicators"),
                      T.matched(F.col("_low"), satisfaction).alias("satisfaction_predictors"),
                      T.matched(F.col("_low"), conversion).alias("conversion_signals"))


def analysis_confidence(has_entities: Column, coherence: Column, sentiment_confidence: Column) -> Column:
    """Mean of the parts present, 0.3 when there is none."""
    parts = [F.when(has_entities, F.lit(0.9)), coherence, sentiment_confidence]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    n = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(n > 0, total / n).otherwise(F.lit(0.3))


def empty_nlp_rows(calls: DataFrame, analysed: DataFrame) -> DataFrame:
    """Exactly one row per call: a call without analysis gets the empty one."""
    marked = analysed.withColumn("_done", F.lit(True))
    joined = calls.select("call_id").join(marked, "call_id", "left")
    none = F.array().cast("array<string>")
    fill = {"phone_numbers": none, "email_addresses": none, "medical_terms": none,
            "dominant_topic": F.lit("unknown"), "topic_score": F.lit(0.0),
            "analysis_confidence": F.lit(0.1)}
    return joined.withColumns({
        c: F.when(F.col("_done").isNull(), d).otherwise(F.col(c))
        for c, d in fill.items() if c in analysed.columns}).drop("_done")


# --- reports -------------------------------------------------------------------------

def insights_between(df: DataFrame, start, end) -> DataFrame:
    """Both ends inclusive; the comparison reaches the scan."""
    return df.where(F.col("ts").between(start, end))


def insight_by_id(df: DataFrame, call_id: str) -> DataFrame:
    return df.where(F.col("call_id") == call_id)


def insights_page(df: DataFrame, limit: int = 100, offset: int = 0, by: str = "ts") -> DataFrame:
    return df.orderBy(F.desc(by), "call_id").offset(offset).limit(limit)


def newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("ts"), "call_id")


def overview(df: DataFrame) -> DataFrame:
    """Count, mean sentiment and summed revenue; zeros for an empty period."""
    return df.agg(F.count("*").alias("total_calls"),
                  F.coalesce(F.avg("sentiment_score"), F.lit(0.0)).alias("average_sentiment"),
                  F.coalesce(F.sum("revenue_opportunity"), F.lit(0.0)).alias("revenue_opportunities"))


def top_intents(df: DataFrame, limit: int | None = None) -> DataFrame:
    counts = df.groupBy(F.col("primary_intent").alias("intent")).agg(F.count("*").alias("count"))
    ranked = counts.orderBy(F.desc("count"), "intent")
    return ranked if limit is None else ranked.limit(limit)


def common_pain_points(df: DataFrame, limit: int = 10) -> DataFrame:
    points = df.select(F.explode("pain_points").alias("pain_point"))
    counts = points.groupBy("pain_point").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "pain_point").limit(limit)


def batch_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total_calls"), F.avg("confidence_score").alias("average_confidence"),
                  F.avg("sentiment_score").alias("average_sentiment"))
