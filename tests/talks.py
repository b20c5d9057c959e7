"""Transcripts and chunks used by several tests."""

# an invented talk: a wrong bill upsets a caller, is corrected, and the caller leaves content
BILLING = [
    ("c1", 0, "staff", "Good evening, the billing desk is listening, how may I be of service?"),
    ("c1", 1, "customer", "My invoice lists a crown nobody fitted and I am frustrated, this is terrible"),
    ("c1", 2, "staff", "I understand, we struck out that line and a fresh invoice is on its way."),
    ("c1", 3, "customer", "Great, excellent, then everything matches again"),
]
BORDER = [("c2", 0, "customer", "it is severe"), ("c2", 1, "customer", "pain really"), ("c2", 2, "staff", "let"),
          ("c2", 3, "staff", "me see")]
EMERGENCY = ("Hello, I have severe tooth pain and need help today or tomorrow morning. "
             "My insurance is Blue Cross Blue Shield, call 555-123-4567 or write to jo.doe@mail.example.com")


def chunks(spark, listed):
    rows = [(c, s, 1_700_000_000 + 60 * s, who, text) for c, s, who, text in listed]
    return spark.createDataFrame(rows, "call_id string, seq int, t long, speaker string, text string").selectExpr(
        "call_id", "seq", "timestamp_seconds(t) AS ts", "speaker", "text", "'staff_1' AS staff_id")


def calls(spark, *texts):
    return spark.createDataFrame([(f"call_{i:03d}", t) for i, t in enumerate(texts, 1)], "call_id string, transcript string")
