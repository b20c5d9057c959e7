import random
import re

import pytest
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import entities as E
from switchboard.functions import intents as I
from switchboard.functions import text as T
from switchboard.functions import topics as TP
from tests.conftest import rows
from tests.talks import EMERGENCY, calls


def one(spark, text, column):
    return calls(spark, text).select(column.alias("x")).first()["x"]


def test_keyword_hits_are_substrings_and_distinct(spark):
    low = F.lower("transcript")
    assert one(spark, "I know the answer, no?", T.keyword_hits(low, ["no"])) == 1
    assert one(spark, "I know the answer", T.keyword_hits(low, ["no"], match="word")) == 0
    assert one(spark, "good good GREAT", T.keyword_hits(low, ["good", "great", "thank"])) == 2


@pytest.mark.parametrize("text, expected", [
    ("Hello, thank you for calling our office.", 1.0), ("I'm really frustrated", -1.0),
    ("I understand your frustration.", 0.0), ("good and bad", 0.0), ("good great bad", 1 / 3)])
def test_sentiment(spark, text, expected):
    assert one(spark, text, T.sentiment(F.lower("transcript"), R.QUICK_SENTIMENT)) == pytest.approx(expected)


def test_normalise_keeps_letters_of_all_languages(spark):
    assert one(spark, "  Été à\n\tLyon, can't we? #1 (ok) x ", T.normalise_text(F.col("transcript"))) == "été à lyon, cant we? 1 ok x"


def test_words_and_counts(spark):
    text = " a \n b c  "
    assert one(spark, text, T.words(F.col("transcript"))) == ["a", "b", "c"]
    assert one(spark, text, T.word_count(F.col("transcript"))) == 3
    assert one(spark, " \n ", T.word_count(F.col("transcript"))) == 0
    assert one(spark, "let me, let me see", T.count_occurrences(F.col("transcript"), "let me")) == 2


def test_trim_marks_the_omission(spark):
    out = one(spark, "This is a test transcript. " * 1000, T.trim_transcript(F.col("transcript"), 1000))
    assert "middle of conversation omitted" in out
    assert len(out.split("\n\n")[0].split()) == 500
    assert one(spark, "  short text ", T.trim_transcript(F.col("transcript"), 1000)) == "short text"


def test_urgency(spark):
    low = F.lower("transcript")
    assert one(spark, "non-urgent checkup", T.urgency_label(low, R.URGENCY_LABELS)) == "high"  # holds "urgent"
    assert one(spark, "I am worried, routine", T.urgency_label(low, R.URGENCY_LABELS)) == "low"
    assert one(spark, "I can't wait", T.urgency_level(low, R.COACHING_URGENCY)) == 5
    assert one(spark, "hello", T.urgency_level(low, R.COACHING_URGENCY)) == 1


def test_intents(spark):
    df = calls(spark, "Can I book an appointment for tomorrow?", "dental emergency, severe pain", "nothing here")
    out = {r["call_id"]: r for r in I.classify_intents(df, "transcript", keep_scores=True).collect()}
    first = out["call_001"]
    assert first["primary_intent"] == "appointment_booking"
    # keywords appointment, book; phrase book an appointment; patterns 1 and 4
    assert first["score_appointment_booking"] == pytest.approx(2 / 11 * 0.4 + 1 / 8 * 0.5 + 2 / 4 * 0.6 + 0.3)
    assert out["call_002"]["primary_intent"] == "emergency_dental"
    assert out["call_003"]["primary_intent"] == "general_inquiry" and out["call_003"]["intent_confidence"] == 0.0


def test_context_and_rule_updates(spark):
    df = calls(spark, "hello").withColumn("previous_appointment", F.lit(True)).withColumn("recent_treatment", F.lit(True))
    gains = {k: R.CONTEXT_GAINS[k] for k in ("previous_appointment", "recent_treatment")}
    assert I.score_intents(df, "transcript", context=gains).first()["score_follow_up"] == pytest.approx(0.25)
    changed = I.update_rules(R.INTENTS, {"complaint": {"boost": 0.0}, "new": {"keywords": ["x"]}})
    assert changed["complaint"]["boost"] == 0.0 and changed["complaint"]["keywords"] == R.INTENTS["complaint"]["keywords"]
    assert list(changed)[-1] == "new" and R.INTENTS["complaint"]["boost"] == 0.3


def test_pattern_prefilter_changes_nothing(spark):
    texts = ["when are you available", "available when", "what time can we visit", "nothing", "come when"]
    df = calls(spark, *texts)
    for rule in R.INTENTS.values():
        for p in rule["patterns"]:
            same = df.where(I.pattern_found(F.col("transcript"), p) != F.rlike("transcript", F.lit(p)))
            assert same.count() == 0


def test_entities(spark):
    df = calls(spark, EMERGENCY)
    phones = df.select(F.inline(E.phone_entities(F.col("transcript")))).collect()
    assert [p["text"] for p in phones] == ["555-123-4567"]
    assert EMERGENCY[phones[0]["start"]:phones[0]["end"]] == "555-123-4567"
    assert phones[0]["context"] == EMERGENCY[max(0, phones[0]["start"] - 50):phones[0]["end"] + 50]
    assert one(spark, EMERGENCY, E.email_addresses(F.col("transcript"))) == ["jo.doe@mail.example.com"]
    info = {k: one(spark, EMERGENCY, c) for k, c in E.appointment_info(F.col("transcript")).items()}
    assert info == {"times": ["morning"], "days": ["today", "tomorrow"], "dates": [], "has_scheduling_intent": False}
    assert one(spark, EMERGENCY, E.insurance_info(F.col("transcript"))["insurance_providers"]) == ["blue cross", "blue shield"]


def test_every_match_has_its_own_offset(spark):
    text = "(017) 555-7713 and 5551234567 and 555 123 4567, 555 123 4567"
    found = calls(spark, text).select(F.inline(E.phone_entities(F.col("transcript")))).collect()
    assert len(found) == 4 and len({f["start"] for f in found}) == 4
    assert all(text[f["start"]:f["end"]] == f["text"] for f in found)


def test_medical_terms_and_phrases(spark):
    terms = one(spark, "Pain in a molar; the root canal", E.medical_terms(F.col("transcript")))
    assert {t["text"] for t in terms} == {"pain", "molar", "root canal", "root"}
    assert next(t for t in terms if t["text"] == "pain")["start"] == 0
    assert one(spark, "sharp pain, painful root canal", E.phrase_terms(F.col("transcript"))) == ["sharp pain", "root canal", "pain", "root"]


def test_token_shapes(spark):
    out = one(spark, "at 3 pm or 11:30 AM with Delta Dental", E.token_entities(F.col("transcript")))
    assert [(e["label"], e["text"]) for e in out] == [("TIME_0", "3 pm"), ("TIME_3", "11:30 AM"), ("INSURANCE_5", "Delta Dental")]


def test_intent_entities_follow_the_intent(spark):
    entities = I.intent_entities(F.col("transcript"), F.lit("appointment_booking"))
    assert one(spark, "Monday at 3 pm", entities) == {"preferred_times": ["3 pm"], "preferred_days": ["Monday"]}
    pain = I.intent_entities(F.col("transcript"), F.lit("emergency_dental"))
    assert one(spark, "Severe pain, throbbing ache, bleeding", pain) == {
        "pain_description": ["Severe pain", "throbbing ache"], "symptoms": ["bleeding"]}
    assert one(spark, "Monday at 3 pm", I.intent_entities(F.col("transcript"), F.lit("complaint"))) == {}


def test_best_label_prefers_the_first_declared(spark):
    label, top = T.best_label({"b": F.lit(0.5), "a": F.lit(0.5), "c": F.lit(0.1)})
    assert one(spark, "", label) == "b" and one(spark, "", top) == 0.5


def test_topic_label(spark):
    assert one(spark, "x", TP.topic_label(F.array(*map(F.lit, ["pain", "urgent", "x"])))) == "Emergency Dental"
    assert one(spark, "x", TP.topic_label(F.array(*map(F.lit, ["x", "y", "z"])))) == "x + y + z"


def test_tokens(spark):
    assert one(spark, "Um, the Tooth-ache x2 is really um bad été", T.tokens(F.col("transcript"), TP.stop_words())) == [
        "tooth", "ache", "really", "bad", "été"]


def test_offsets_equal_a_regex_walk(spark):
    rng = random.Random(1)
    parts = ["555-123-4567", "(555) 123-4567", "1555-123-4567", "jo@x.org", "a.b@c-d.co", "call", "é", "at 10 am", "root canal", "crown", " ", "x", "."]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 12))) for _ in range(120)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    specs = [("PHONE", p) for p in R.PHONE_PATTERNS] + [("EMAIL", R.EMAIL_PATTERN)]
    for r in df.select("i", E.contact_entities(F.col("t")).alias("e"), E.all_entities(F.col("t")).alias("a")).collect():
        t = texts[r["i"]]
        want = [] if t is None else [(m.group(), label, m.start(), m.end(), t[max(0, m.start() - 50):m.end() + 50])
                                     for label, p in specs for m in re.finditer(p, t)]
        assert [(x["text"], x["label"], x["start"], x["end"], x["context"]) for x in r["e"]] == want
        phrases = [(x["text"], x["start"]) for x in r["a"] if x["label"] == "PHRASE" and x["text"] in ("root canal", "crown")]
        assert phrases == ([] if t is None else [(m.group(), m.start()) for w in ("root canal", "crown") for m in re.finditer(rf"(?<!\w){w}(?!\w)", t)])


def test_overlapping_entities_are_merged(spark):
    listed = [("a", 0, 5, 0), ("a", 3, 9, 1), ("a", 8, 10, 2), ("a", 10, 12, 3), ("a", 20, 23, 4), ("a", 20, 23, 5), ("a", 21, 22, 6), ("b", 0, 5, 0), (None, 1, 2, 0), (None, 0, 3, 1)]
    rows_ = spark.createDataFrame([(k, "t", f"L{n}", s, e, 0.5, "c", n) for k, s, e, n in listed],
                                  "id string, text string, label string, start int, end int, confidence double, context string, listed int")
    got = E.merged_entities(rows_, "id")
    assert got.columns == ["id", "text", "label", "start", "end", "confidence", "context"]
    assert rows(got, "id", "label", "start") == sorted([("a", "L1", 3), ("a", "L3", 10), ("a", "L4", 20), ("b", "L0", 0), (None, "L1", 0)], key=str)
    texts = spark.createDataFrame([("x", "Call 555-123-4567 or (555) 123-4567, aetna at 5 pm; a@b.com. Severe pain"), ("y", None), ("z", "")], "id string, t string")
    every = E.entity_rows(texts, "id", "t")
    spans = {(r["start"], r["end"]): (r["label"], r["text"]) for r in E.merged_entities(every, "id").collect()}
    text = texts.first()["t"]
    assert all(text[a:b].lower() == t.lower() for (a, b), (_, t) in spans.items()) and len(spans) < every.count()
    ends = sorted(spans)
    assert all(b[0] >= a[1] for a, b in zip(ends[:-1], ends[1:], strict=True))
    assert {"PHONE", "EMAIL", "INSURANCE_1", "TIME_0"} <= {label for label, _ in spans.values()}


def test_topic_vocabularies_are_bounded(spark):
    from switchboard.operators import topics as TO

    rng = random.Random(3)
    words = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(60)]
    df = spark.createDataFrame([(str(k), " ".join(rng.choices(words, k=30))) for k in range(40)], "call_id string, transcript string")
    tokenised = TO.tokenise(df, stop_words=[])
    passed = {r["term"]: r["docs"] for r in TO.topic_vocabulary(tokenised, 10, 0.4).collect()}
    texts = [set(r["transcript"].split()) for r in df.collect()]
    assert passed == {w: n for w in words if 10 <= (n := sum(w in t for t in texts)) <= 16} and 0 < len(passed) < len(set(words))
    with pytest.raises(TO.VocabularyTooLarge):
        TO.train_topics(tokenised, 2, 2, most_terms=5)
    model = TO.train_topics(tokenised, 2, 2, vocabulary=7)
    every = TO.topic_vocabulary(tokenised)
    assert model.stages[0].vocabulary == [r["term"] for r in TO.most_frequent(every, 7).collect()]
    loss = TO.vocabulary_loss(tokenised, every, 7).first()
    assert loss["kept"] == 7 and loss["terms"] == every.count() and 0 < loss["lost"] < loss["tokens"] <= 1200
    assert TO.top_terms(model, 3).count() == 6


def test_entities_scan_ascii_and_fold_once(spark, capsys):
    assert not E.same_in_ascii(r"\p{Punct}") and not E.same_in_ascii("é") and not E.same_in_ascii("(?iu)a") and E.same_in_ascii(R.EMAIL_PATTERN)
    texts = ["cigna 5 pm", "c\u0131gna AETNA", "met\u0131ife 5\u00a0pm", "x.cigna_ cigna", "\u0661 pm 7 pm", "a\ncigna\r\ncigna", "crown\u0301 crown", "1555-123-4567 555-123-4567", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for pattern in [R.TOKEN_PATTERNS["INSURANCE_2"], R.TOKEN_PATTERNS["TIME_0"], R.TOKEN_PATTERNS["PHONE_0"], *E.phrase_patterns()]:
        for r in df.select("t", E.located(F.col("t"), pattern, "L", 0.5).alias("e"), E.hits(F.col("t"), pattern).alias("h")).collect():
            assert [x["text"] for x in r["e"]] == (r["h"] or [])
            assert all(r["t"][x["start"]:x["end"]] == x["text"] for x in r["e"])
    df.select(E.medical_terms(F.col("t")).alias("m")).explain(True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("lower(t") == 1
