"""Staff coaching over transcript chunks: signals, running session state, advice, reports.

Three steps, of which only the middle one differs between batch and stream:

1. ``chunk_signals`` reduces every chunk to a few numbers (word masks, counts,
   sentiment, staff scores).  It is a projection; the text goes no further than
   this, except for short edges needed to see phrases across a chunk border.
2. ``running_state`` folds the signals of a call in order.  In batch these are
   windows over blocks of a call; the stream keeps the same values as state.
3. ``coaching_responses`` turns each folded row into alerts, suggestions,
   scripts and escalation flags.  It is a projection again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T
from switchboard.operators import ordered as O
from switchboard.session import materialise

KEY = ["call_id"]
GROUP = 60
KEEP = R.SCORE_KEEP
GAIN = 1.0 - R.SCORE_KEEP


def profile_rules(profile: str | Mapping) -> Mapping:
    return R.COACHING_PROFILES[profile] if isinstance(profile, str) else {**R.COACHING, **profile}


# --- word masks ---------------------------------------------------------------------

def buffer_words(rules: Mapping) -> list[str]:
    """Words whose presence anywhere in the call so far matters."""
    groups: list[Sequence[str]] = [*rules["alert_words"].values(), rules["upsell"], rules["legal_risk"],
                                   rules["supervisor"], rules["closing"], rules["responding"],
                                   rules["frustration"]]
    if rules["scope"] == "buffer":
        groups += [rules["sentiment"]["positive"], rules["sentiment"]["negative"],
                   *rules["concerns"].values(), rules["empathy"], rules["unprofessional"], ["?"]]
    return list(dict.fromkeys(w for g in groups for w in g))


def counted_phrases(rules: Mapping) -> dict[str, Sequence[str]]:
    return {"n_resolution": rules["resolution"], "n_frustration": rules["frustration"]}


def _spanning(rules: Mapping) -> list[str]:
    """Entries with a blank: only these can lie across a chunk border."""
    every = [*buffer_words(rules), *(w for ws in counted_phrases(rules).values() for w in ws)]
    return [w for w in dict.fromkeys(every) if " " in w]


def edge_length(rules: Mapping) -> int:
    return max([len(w) for w in _spanning(rules)], default=1) - 1


def mask_names(rules: Mapping) -> list[str]:
    return [f"mask{i}" for i in range((len(buffer_words(rules)) + GROUP - 1) // GROUP)]


def mask_test(rules: Mapping, words: Sequence[str], prefix: str = "") -> Column:
    """True where any of ``words`` has been seen."""
    place = {w: i for i, w in enumerate(buffer_words(rules))}
    need: dict[int, int] = {}
    for w in words:
        need[place[w] // GROUP] = need.get(place[w] // GROUP, 0) | (1 << (place[w] % GROUP))
    return reduce(or_, [F.col(f"{prefix}mask{g}").bitwiseAND(F.lit(m)) != 0 for g, m in need.items()],
                  F.lit(False))


def mask_hits(rules: Mapping, words: Sequence[str]) -> Column:
    """How many distinct ``words`` have been seen."""
    return reduce(add, [mask_test(rules, [w]).cast("int") for w in dict.fromkeys(words)], F.lit(0))


def overlaps_itself(phrase: str) -> bool:
    return any(phrase.startswith(phrase[i:]) for i in range(1, len(phrase)))


# --- step 1: signals of one chunk --------------------------------------------------

def staff_indicators(low: Column, text: Column, rules: Mapping) -> dict[str, Column]:
    """Empathy, response speed, accuracy and professional language of a staff chunk."""
    return {
        "empathy": F.least(F.lit(1.0), T.keyword_hits(low, rules["empathy"]) / 3),
        "efficiency": F.when(T.word_count(text) > 10, 0.8).otherwise(0.5),
        "knowledge": F.least(F.lit(1.0), T.keyword_hits(low, rules["knowledge"]) / 2),
        "professionalism": 1.0 - F.least(F.lit(1.0), T.keyword_hits(low, rules["unprofessional"]) / 5),
    }


def customer_state(low: Column, text: Column, rules: Mapping) -> dict[str, Column]:
    """Emotion, satisfaction and engagement of a customer chunk."""
    return {
        "emotion": F.when(T.any_of(low, rules["emotion"]), "high").otherwise("normal"),
        "satisfaction": F.when(T.any_of(low, rules["satisfied"]), "positive")
                         .when(T.any_of(low, rules["dissatisfied"]), "negative").otherwise("neutral"),
        "engagement": F.when(F.contains(text, F.lit("?")), "high").otherwise("normal"),
    }


def concerns_of(low: Column, concerns: Mapping[str, Sequence[str]]) -> Column:
    return T.compact_strings([F.when(T.any_of(low, ws), F.lit(n)) for n, ws in concerns.items()])


def chunk_signals(chunks: DataFrame, profile: str | Mapping = "default") -> DataFrame:
    """Everything the rules need from one chunk, without the chunk's text."""
    rules = profile_rules(profile)
    for phrase in [w for ws in counted_phrases(rules).values() for w in ws]:
        if overlaps_itself(phrase):
            raise ValueError(f"counted phrase {phrase!r} overlaps itself")
    words = buffer_words(rules)
    edge = edge_length(rules)
    base = chunks.select("call_id", "seq", "ts", "speaker", "text", F.lower("text").alias("_low"))
    low, text = F.col("_low"), F.col("text")
    staff = F.lower(F.col("speaker")) == "staff"
    customer = F.lower(F.col("speaker")) == "customer"
    last_mark = F.instr(F.reverse(text), "?")
    cols: dict[str, Column] = {
        **{name: T.word_mask(low, words[i * GROUP:(i + 1) * GROUP])
           for i, name in enumerate(mask_names(rules))},
        **{n: reduce(add, [T.count_occurrences(low, w) for w in ws], F.lit(0))
           for n, ws in counted_phrases(rules).items()},
        "n_chars": F.length(text),
        "n_words": T.word_count(text),
        "last_mark": F.when(last_mark > 0, last_mark),
        "head": F.left(low, F.lit(edge)),
        "tail": F.right(low, F.lit(edge)),
        "sentiment": T.sentiment(low, rules["sentiment"]),
        "concerns": concerns_of(low, rules["concerns"]),
        "urgency": T.urgency_level(low, rules["urgency"]),
        "is_staff": F.coalesce(staff, F.lit(False)),
        **{f"x_{n}": F.when(staff, c) for n, c in staff_indicators(low, text, rules).items()},
        **{n: F.when(customer, c) for n, c in customer_state(low, text, rules).items()},
    }
    return base.select("call_id", "seq", "ts", "speaker", *[c.alias(n) for n, c in cols.items()])


# --- step 2: running state ------------------------------------------------------------

def with_border_hits(rows: DataFrame, rules: Mapping, before: Column) -> DataFrame:
    """Adds what phrases lying across the border to this chunk contribute."""
    place = {w: i for i, w in enumerate(buffer_words(rules))}
    rows = rows.withColumn("_before", before)

    def border(phrase: str) -> Column:
        n = F.lit(len(phrase) - 1)
        return F.concat(F.right("_before", n), F.lit(" "), F.left("head", n))

    spanning = _spanning(rules)
    masks = {}
    for g, name in enumerate(mask_names(rules)):
        bits = [F.when(F.contains(border(w), F.lit(w)), F.lit(1 << (place[w] % GROUP)).cast("bigint"))
                .otherwise(F.lit(0).cast("bigint"))
                for w in spanning if w in place and place[w] // GROUP == g]
        masks[name] = reduce(lambda a, b: a.bitwiseOR(b), bits, F.col(name))
    counts = {name: reduce(add, [F.contains(border(w), F.lit(w)).cast("int") for w in ws if " " in w],
                           F.col(name))
              for name, ws in counted_phrases(rules).items()}
    return rows.withColumns({**masks, **counts}).drop("_before")


def folded_blocks(ends: DataFrame, values: Sequence[str], blocks: int) -> DataFrame:
    """Scores after each block of a call, from what the blocks add on their own.

    A block maps a score to ``decay * score + value``.  Such maps are composed with the
    one 1, 2, 4, ... blocks before until every block has all earlier ones: exact for any
    number of blocks, with a fixed number of columns for each.
    """
    per_call = Window.partitionBy(*KEY).orderBy(O.BLOCK)
    ends = ends.withColumn("_decay", F.pow(F.lit(KEEP), F.col("_staff")))
    step = 1
    while step < blocks:
        ends = ends.withColumns({
            "_decay": F.col("_decay") * F.lag("_decay", step, 1.0).over(per_call),
            **{v: F.col(v) + F.col("_decay") * F.lag(v, step, 0.0).over(per_call) for v in values}})
        step *= 2
    return ends


def running_state(signals: DataFrame, profile: str | Mapping = "default",
                  long_calls: bool | None = None, block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """Folds the chunks of each call in order; one row per chunk."""
    rules = profile_rules(profile)
    edge = edge_length(rules)
    if long_calls is None:
        long_calls = O.has_long_keys(signals, "seq", block_rows)
    order = ["seq"]
    rows = O.sequence_rows(signals, KEY, "seq", edge, ["tail"], long_calls, block_rows)
    w = O.window(KEY, order)
    if edge > 0:
        # every chunk adds at least the joining blank, so `edge` chunks reach far enough
        near = F.collect_list("tail").over(w.rowsBetween(-edge, -1))
        rows = with_border_hits(rows, rules, F.right(F.array_join(near, " "), F.lit(edge)))
    rows = rows.where(~F.col(O.HALO)).drop(O.HALO)

    run = O.running(KEY, order)
    masks = mask_names(rules)
    negative = (F.col("sentiment") < 0).cast("int")
    rows = rows.withColumns({
        "_n": F.count("*").over(run),
        "_chars": F.sum(F.col("n_chars") + 1).over(run),
        "_words": F.sum("n_words").over(run),
        "_res": F.sum("n_resolution").over(run),
        "_fru": F.sum("n_frustration").over(run),
        "_neg": F.sum(negative).over(run),
        "_start": F.min("ts").over(run),
        "_staff": F.count_if("is_staff").over(run),
        **{f"_{m}": F.bit_or(m).over(run) for m in masks},
    })
    rows = rows.withColumns({
        "_mark": F.max(F.col("_chars") - F.col("last_mark")).over(run),
        **{f"_v_{s}": F.pow(F.lit(KEEP), F.col("_staff")) * F.coalesce(F.sum(
            F.when(F.col("is_staff"), GAIN * F.col(f"x_{s}") * F.pow(F.lit(KEEP), -F.col("_staff")))
        ).over(run), F.lit(0.0)) for s in R.SCORES},
    })
    local = ["_n", "_chars", "_words", "_res", "_fru", "_neg", "_start", "_staff", "_mark",
             *[f"_{m}" for m in masks], *[f"_v_{s}" for s in R.SCORES]]
    zero = F.lit(0).cast("bigint")
    if long_calls:
        block_end = rows.groupBy(*KEY, O.BLOCK).agg(F.max_by(F.struct(*local), "seq").alias("_end"))
        ends = block_end.select(*KEY, O.BLOCK, "_end.*")
        earlier = O.earlier_blocks(KEY)
        offset = F.coalesce(F.sum("_chars").over(earlier), zero)
        ends = ends.withColumn("_mark_at", offset + F.col("_mark"))

        per_call = Window.partitionBy(*KEY).orderBy(O.BLOCK)
        last = signals.agg(F.max("seq")).first()[0] or 0
        ends = folded_blocks(ends, [f"_v_{score}" for score in R.SCORES], last // block_rows + 1)
        carry = ends.select(
            *KEY, O.BLOCK,
            *[F.sum(c).over(earlier).alias("c" + c) for c in ("_n", "_chars", "_words", "_res", "_fru", "_neg")],
            F.min("_start").over(earlier).alias("c_start"),
            F.max("_mark_at").over(earlier).alias("c_mark"),
            *[F.bit_or(f"_{m}").over(earlier).alias(f"c_{m}") for m in masks],
            *[(R.START_SCORE * F.lag("_decay", 1, 1.0).over(per_call) + F.lag(f"_v_{s}", 1, 0.0).over(per_call)).alias(f"c_v_{s}")
              for s in R.SCORES])
        rows = rows.join(carry, [*KEY, O.BLOCK], "left")
    else:
        rows = rows.withColumns({
            **{"c" + c: zero for c in ("_n", "_chars", "_words", "_res", "_fru", "_neg")},
            "c_start": F.lit(None).cast("timestamp"), "c_mark": F.lit(None).cast("bigint"),
            **{f"c_{m}": zero for m in masks},
            **{f"c_v_{s}": F.lit(R.START_SCORE) for s in R.SCORES}})

    def total(c: str) -> Column:
        return F.col(c) + F.coalesce(F.col("c" + c), zero)

    scores = {s: F.pow(F.lit(KEEP), F.col("_staff")) * F.coalesce(F.col(f"c_v_{s}"), F.lit(R.START_SCORE))
              + F.col(f"_v_{s}") for s in R.SCORES}
    return rows.select(
        "call_id", "seq", "ts", "speaker", "sentiment", "concerns", "urgency", "is_staff",
        "emotion", "satisfaction", "engagement", *[f"x_{s}" for s in R.SCORES],
        total("_n").alias("interaction_count"),
        total("_chars").alias("buffer_chars"),
        total("_words").alias("buffer_words"),
        total("_res").alias("resolution_attempts"),
        total("_fru").alias("frustration_count"),
        ((total("_neg") - negative) > 0).alias("negative_before"),
        F.least("_start", "c_start").alias("start_ts"),
        F.greatest(F.col("_mark") + F.coalesce(F.col("c_chars"), zero), F.col("c_mark")).alias("last_mark_at"),
        *[F.col(f"_{m}").bitwiseOR(F.coalesce(F.col(f"c_{m}"), zero)).alias(m) for m in masks],
        *[c.alias(s) for s, c in scores.items()])


# --- step 3: responses -----------------------------------------------------------------

def stage_column(rules: Mapping) -> Column:
    """Stage of the conversation, judged by the text so far."""
    asked = F.coalesce(F.col("buffer_chars") - F.col("last_mark_at") <= 100, F.lit(False))
    closing = mask_test(rules, rules["closing"])
    if rules["scope"] == "buffer":
        return (F.when(asked, "question").when(closing, "resolution")
                .when(F.col("buffer_chars") < 100, "opening").otherwise("discussion"))
    return (F.when(F.col("buffer_chars") < 50, "opening").when(closing, "closing")
            .when(asked, "customer_inquiry")
            .when(mask_test(rules, rules["responding"]), "staff_responding").otherwise("discussion"))


ALERT = "struct<type:string,category:string,priority:string,message:string,suggested_action:string>"
SUGGESTION = "struct<type:string,message:string,script_example:string,timing:string>"
SCRIPT = "struct<category:string,situation:string,script:string,follow_up:string>"
FLAG = "struct<type:string,message:string,reason:string,urgency:string>"


def _kept(items: Sequence[tuple[Column, Column]], kind: str) -> Column:
    """Array of the structs whose condition holds."""
    return F.array_compact(F.array(*[F.when(test, value) for test, value in items])).cast(f"array<{kind}>")


def _record(**values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def alerts_column(rules: Mapping) -> Column:
    s, elapsed = F.col("sentiment"), F.col("elapsed")
    drop, critical = rules["sentiment_drop"], rules["sentiment_critical"]
    warn, late = rules["duration_warning"], rules["duration_critical"]
    texts = R.ALERT_TEXTS

    def alert(name: str, value: Column | None = None) -> Column:
        kind, category, priority, message, action = texts[name]
        shown = F.lit(message) if value is None else F.format_string(message, value)
        return _record(type=kind, category=category, priority=priority, message=shown,
                       suggested_action=action)

    items = []
    if critical is not None:
        items.append((s < critical, alert("sentiment_critical", s)))
        items.append(((s < drop) & (s >= critical), alert("sentiment_warning", s)))
    else:
        items.append((s < drop, alert("sentiment_warning", s)))
    items.append((elapsed > late, alert("duration_critical", elapsed / 60)))
    if warn is not None:
        items.append(((elapsed > warn) & (elapsed <= late), alert("duration_warning", elapsed / 60)))
    for category, words in rules["alert_words"].items():
        items.append((mask_test(rules, words), alert(category)))
    return _kept(items, ALERT)


def suggestions_column(rules: Mapping) -> Column:
    s, n, stage = F.col("sentiment"), F.col("interaction_count"), F.col("stage")
    negative = s < 0
    if rules["empathy_once"]:
        negative = negative & ~F.col("negative_before")
    tests = {
        "empathy": negative,
        "active_listening": (stage == rules["listening_stage"]) & (n % rules["listening_every_chunks"] == 0),
        "solution_focus": F.array_contains("concerns", rules["solving_concern"])
        & (stage == rules["solving_stage"]),
        "closing": (stage == rules["resolution_stage"]) & (n > rules["closing_after_chunks"]),
        "upsell": (s > rules["upsell_sentiment"]) & mask_test(rules, rules["upsell"])
        & (n > rules["upsell_after_chunks"]),
    }
    return _kept([(test, _record(type=kind, message=R.SUGGESTION_TEXTS[kind][0],
                                 script_example=R.SUGGESTION_TEXTS[kind][1],
                                 timing=R.SUGGESTION_TEXTS[kind][2]))
                  for kind, test in tests.items()], SUGGESTION)


def scripts_column(rules: Mapping) -> Column:
    tests = {name: F.array_contains("concerns", name) for name in ("pricing", "availability", "insurance", "pain")}
    if "deescalation_sentiment" in rules:
        tests["upset"] = F.col("sentiment") < rules["deescalation_sentiment"]
    else:
        tests["upset"] = F.coalesce(F.col("emotion") == rules["upset_emotion"], F.lit(False))
    return _kept([(test, _record(category=R.SCRIPT_TEXTS[k][0], situation=R.SCRIPT_TEXTS[k][1],
                                 script=R.SCRIPT_TEXTS[k][2], follow_up=R.SCRIPT_TEXTS[k][3]))
                  for k, test in tests.items()], SCRIPT)


def flags_column(rules: Mapping) -> Column:
    frustration = (mask_hits(rules, rules["frustration"]) if rules["scope"] == "buffer"
                   else F.col("frustration_count"))
    tests = {
        "resolution_difficulty": (F.col("resolution_attempts") > rules["resolution_limit"])
        & (F.col("interaction_count") > rules["resolution_after_chunks"]),
        "customer_frustration": frustration > rules["frustration_limit"],
        "legal_risk": mask_test(rules, rules["legal_risk"]),
        "supervisor_requested": mask_test(rules, rules["supervisor"]),
    }

    def record(kind: str) -> Column:
        message, reason, urgency = R.ESCALATION_TEXTS[kind]
        shown = (F.format_string(message, F.col("resolution_attempts")) if "%d" in message
                 else F.lit(message))
        return _record(type=kind, message=shown, reason=reason, urgency=urgency)

    return _kept([(test, record(kind)) for kind, test in tests.items()], FLAG)


def coaching_responses(state: DataFrame, profile: str | Mapping = "default") -> DataFrame:
    """One response per chunk."""
    rules = profile_rules(profile)
    out = state
    if rules["scope"] == "buffer":
        pos = mask_hits(rules, rules["sentiment"]["positive"])
        neg = mask_hits(rules, rules["sentiment"]["negative"])
        out = out.withColumns({
            "sentiment": F.when(pos + neg == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg)),
            "concerns": T.compact_strings([F.when(mask_test(rules, ws), F.lit(n))
                                           for n, ws in rules["concerns"].items()]),
        })
        out = out.withColumns({
            "empathy_shown": F.when(mask_test(rules, rules["empathy"]), 0.8).otherwise(0.3),
            "information_provided": F.when(F.col("buffer_words") > 50, 0.7).otherwise(0.4),
            "professional_tone": F.when(mask_test(rules, rules["unprofessional"]), 0.6).otherwise(0.9),
            "engagement_level": F.when(mask_test(rules, ["?"]), 0.8).otherwise(0.5),
            "resolution_likelihood": F.when(F.col("sentiment") > 0.3, 0.9).otherwise(0.4),
        })
    out = out.withColumns({
        "elapsed": (F.unix_micros("ts") - F.unix_micros("start_ts")) / 1_000_000,
        "stage": stage_column(rules),
        "overall": reduce(add, [F.col(s) for s in R.SCORES]) / len(R.SCORES),
    })
    out = out.withColumns({
        "alerts": alerts_column(rules),
        "suggestions": suggestions_column(rules),
        "scripts": scripts_column(rules),
        "escalation_flags": flags_column(rules),
    })
    return out.drop(*mask_names(rules), "negative_before", "last_mark_at")


def coach_batch(chunks: DataFrame, profile: str | Mapping = "default", long_calls: bool | None = None,
                block_rows: int = O.BLOCK_ROWS) -> DataFrame:
    """All coaching responses of recorded calls.

    With long calls the signals are used by the rows, by the rows repeated
    before each block and by the block totals.  They are written once then, so
    that the texts are scanned once; without text they are small.
    """
    if long_calls is None:
        long_calls = O.has_long_keys(chunks, "seq", block_rows)
    signals = chunk_signals(chunks, profile)
    if long_calls:
        signals = materialise(signals, "chunk-signals")
    return coaching_responses(running_state(signals, profile, long_calls, block_rows), profile)


# --- reports ---------------------------------------------------------------------------

ALERT_CATEGORIES = ["sentiment", "duration", "customer_emotion", "emergency", "legal"]


def alert_summary(responses: DataFrame) -> DataFrame:
    """Alerts of a call: total, per category, number with priority critical."""
    raised = responses.select("call_id", F.explode_outer("alerts").alias("a"))
    return raised.groupBy("call_id").agg(
        F.count("a").alias("total_alerts"),
        *[F.count_if(F.col("a.category") == c).alias(f"alerts_{c}") for c in ALERT_CATEGORIES],
        F.count_if(F.col("a.priority") == "critical").alias("critical_alerts"))


def improvement_areas(scores: Mapping[str, Column], any_sentiment_alert: Column) -> Column:
    items = [F.when(scores[s] < R.LOW_SCORE, F.lit(R.SCORE_TEXTS[s][0])) for s in R.SCORES]
    return T.compact_strings([*items, F.when(any_sentiment_alert, F.lit(R.SENTIMENT_AREA[0]))])


def strengths(scores: Mapping[str, Column]) -> Column:
    return T.compact_strings([F.when(scores[s] > R.HIGH_SCORE, F.lit(R.SCORE_TEXTS[s][1])) for s in R.SCORES])


def training_courses() -> dict[str, str]:
    """Improvement area -> course."""
    courses = {R.SCORE_TEXTS[s][0]: R.SCORE_TEXTS[s][2] for s in R.SCORES}
    return {**courses, R.SENTIMENT_AREA[0]: R.SENTIMENT_AREA[1]}


def recommend_training(areas: Column, courses: Mapping[str, str] | None = None) -> Column:
    """Courses for the areas given; unknown areas are dropped."""
    known = courses if courses is not None else training_courses()
    return T.compact_strings([F.when(F.array_contains(areas, a), F.lit(c)) for a, c in known.items()])


def final_report(responses: DataFrame) -> DataFrame:
    """One row per call, from a single partially aggregated grouping."""
    def n_alerts(field: str, value: str) -> Column:
        return F.size(F.filter("alerts", lambda a: a[field] == value))

    slim = responses.select(
        "call_id", "seq", "ts", "sentiment", *R.SCORES, "overall",
        F.size("alerts").alias("_alerts"), F.size("suggestions").alias("_suggestions"),
        n_alerts("priority", "critical").alias("_critical"),
        *[n_alerts("category", c).alias(f"_{c}") for c in ALERT_CATEGORIES])
    g = slim.groupBy("call_id").agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"),
        F.count("*").alias("interaction_count"),
        *[F.max_by(s, "seq").alias(s) for s in [*R.SCORES, "overall"]],
        F.sum("_alerts").alias("total_alerts"), F.sum("_critical").alias("critical_alerts"),
        *[F.sum(f"_{c}").alias(f"alerts_{c}") for c in ALERT_CATEGORIES],
        F.sum("_suggestions").alias("coaching_interventions"),
        F.min_by("sentiment", "seq").alias("initial_sentiment"),
        F.max_by("sentiment", "seq").alias("final_sentiment"),
        F.min("sentiment").alias("lowest_point"), F.max("sentiment").alias("highest_point"),
        F.stddev_pop("sentiment").alias("volatility"))
    return with_findings(g)


def with_findings(told: DataFrame) -> DataFrame:
    """Durations, improvements and advice that follow from the counted columns of a report."""
    scores = {s: F.col(s) for s in R.SCORES}
    out = told.withColumns({
        "call_duration": (F.unix_micros("end_time") - F.unix_micros("start_time")) / 1_000_000,
        "sentiment_improvement": F.col("final_sentiment") - F.col("initial_sentiment"),
        "performance_improvement": F.col("overall") - R.START_SCORE,
        "areas_for_improvement": improvement_areas(scores, F.col("alerts_sentiment") > 0),
        "strengths_demonstrated": strengths(scores),
    })
    return out.withColumn("recommended_training", recommend_training(F.col("areas_for_improvement")))


#: key of a live session: a call may have several, one after the other
SESSION = ["call_id", "opened"]
KINDS = {"alerts_triggered": ("alerts", "category"), "coaching_suggestions": ("suggestions", "type"), "scripts_used": ("scripts", "category"), "escalation_flags": ("escalation_flags", "type")}


def report_parts(responses: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a report needs of some responses of a session, in a form that adds up (``merged_parts``).

    Counts, sums and extremes, the first and last values with their places, and the distinct kinds of advice.  Sentiments are
    kept as number, sum and sum of squares of their differences from 0.
    """
    def n_alerts(field: str, value: str) -> Column:
        return F.size(F.filter("alerts", lambda a: a[field] == value))

    # distinct kinds are a handful of rule names, so the sets stay small
    kinds = {name: F.flatten(F.collect_set(F.array_distinct(F.transform(column, lambda a: a[field])))) for name, (column, field) in KINDS.items()}  # noqa: B023
    return responses.groupBy(*key).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n"),
        F.min(F.struct("seq", "sentiment")).alias("first"), F.max(F.struct("seq", "sentiment", *R.SCORES, "overall")).alias("last"),
        F.sum(F.size("alerts")).alias("total_alerts"), F.sum(n_alerts("priority", "critical")).alias("critical_alerts"),
        *[F.sum(n_alerts("category", c)).alias(f"alerts_{c}") for c in ALERT_CATEGORIES],
        F.sum(F.size("suggestions")).alias("coaching_interventions"),
        F.min("sentiment").alias("lowest_point"), F.max("sentiment").alias("highest_point"),
        F.sum("sentiment").alias("sentiment_sum"), F.sum(F.col("sentiment") * F.col("sentiment")).alias("sentiment_squares"),
        *[F.array_distinct(c).alias(name) for name, c in kinds.items()])


def merged_parts(parts: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """One row of parts for each session from any number of them."""
    by = {"start_time": F.min, "end_time": F.max, "first": F.min, "last": F.max, "lowest_point": F.min, "highest_point": F.max}
    return parts.groupBy(*key).agg(*[
        F.array_distinct(F.flatten(F.collect_set(c))).alias(c) if c in KINDS else by.get(c, F.sum)(c).alias(c) for c in parts.columns if c not in key])


def report_of_parts(parts: DataFrame) -> DataFrame:
    """The columns of ``final_report`` from merged parts."""
    mean = F.col("sentiment_sum") / F.col("n")
    spread = F.greatest(F.col("sentiment_squares") / F.col("n") - mean * mean, F.lit(0.0))
    told = parts.select(
        "call_id", "start_time", "end_time", F.col("n").alias("interaction_count"), *[F.col(f"last.{s}").alias(s) for s in [*R.SCORES, "overall"]],
        "total_alerts", "critical_alerts", *[f"alerts_{c}" for c in ALERT_CATEGORIES], "coaching_interventions",
        F.col("first.sentiment").alias("initial_sentiment"), F.col("last.sentiment").alias("final_sentiment"), "lowest_point", "highest_point", F.sqrt(spread).alias("volatility"))
    return with_findings(told)


# --- sessions, staff and customers ---------------------------------------------------------

def chunks_with_session(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    return chunks.join(sessions.select("call_id"), "call_id", "left_semi")


def orphan_chunks(chunks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Chunks of calls without an open session."""
    return chunks.join(sessions.select("call_id"), "call_id", "left_anti")


def staff_baseline(performance: DataFrame, last: int = 10) -> DataFrame:
    """Mean of each score over a staff member's ``last`` sessions.

    The rank limit is applied before the shuffle as well as after it, so a staff
    member with very many sessions sends only the newest ones.
    """
    newest = Window.partitionBy("staff_id").orderBy(F.desc("ended_at"), F.desc("call_id"))
    recent = performance.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= last)
    return recent.groupBy("staff_id").agg(*[F.avg(s).alias(s) for s in R.SCORES],
                                          F.count("*").alias("sessions"))


def with_staff_baseline(sessions: DataFrame, baseline: DataFrame) -> DataFrame:
    """Known baselines, else the defaults; one row per staff member is joined."""
    fields = [c for c in R.STAFF_BASELINE if c in baseline.columns]
    known = baseline.select("staff_id", *[F.col(c).alias(f"_b_{c}") for c in fields], F.lit(True).alias("_known"))
    joined = sessions.join(known, "staff_id", "left")
    cols = {}
    for name, default in R.STAFF_BASELINE.items():
        value = F.coalesce(F.col(f"_b_{name}"), F.lit(float(default))) if name in fields else F.lit(float(default))
        cols[f"baseline_{name}"] = value
    return joined.withColumns({**cols, "baseline_known": F.coalesce(F.col("_known"), F.lit(False))}) \
        .drop("_known", *[f"_b_{c}" for c in fields])


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def opening_advice(sessions: DataFrame, known: str | None = None) -> DataFrame:
    """Adds ``opening_tips`` and ``opening_approach`` from the customer flags."""
    tips = [F.lit(t) for t in R.OPENING_TIPS]
    tips += [F.when(_flag(sessions, f), F.lit(t)) for f, t in R.CONTEXT_TIPS.items()]
    approach = None
    for flag, text in R.OPENING_APPROACH.items():
        test = _flag(sessions, flag)
        approach = F.when(test, F.lit(text)) if approach is None else approach.when(test, F.lit(text))
    approach = approach.otherwise(F.lit(R.OPENING_APPROACH_OTHER))
    if known is not None:
        approach = F.when(_flag(sessions, known), approach).otherwise(F.lit(R.OPENING_APPROACH_UNKNOWN))
    return sessions.withColumns({"opening_tips": T.compact_strings(tips), "opening_approach": approach})


def customer_insights(sessions: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Visit pattern, preferred services and communication notes of the caller.

    ``customers`` may have visit_history (a list), service_preferences and communication_style; what
    it lacks, like what is empty or unknown of a customer, gives null.
    """
    joined = sessions.join(customers, key, "left")
    told = lambda name: F.col(name) if name in customers.columns else F.lit(None).cast("string")
    visits = F.coalesce(F.size("visit_history"), F.lit(0)) if "visit_history" in customers.columns else F.lit(0)
    filled = lambda c, kind: F.when(F.size(c) > 0, c) if kind.startswith("array") else F.when(c != "", c)
    kinds = {**dict.fromkeys(("service_preferences", "communication_style"), "string"), **dict(customers.dtypes)}
    return joined.withColumns({
        "visit_pattern": F.when(visits > 3, "Regular patient").when(visits > 0, "Occasional patient"),
        **{new: filled(told(old), kinds[old]) for new, old in (("preferred_services", "service_preferences"), ("communication_notes", "communication_style"))}})


def session_start(first_chunks: DataFrame, staff: DataFrame, baseline: DataFrame) -> DataFrame:
    """Opening row of a session: baseline and advice (works stream-static)."""
    return opening_advice(with_staff_baseline(first_chunks.join(staff, "call_id", "left"), baseline))
