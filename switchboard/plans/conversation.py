"""Queries over the turns of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from switchboard.operators import conversation as CV
from switchboard.operators import topics as TO
from switchboard.functions import vectors as V
from switchboard.plans import tables as B
from switchboard.plans.registry import big, num, q, query, sql_any, sql_sentiment, sql_word_count, sql_words
from switchboard.plans.text import _TOK

W = f"WITH {B.CHUNKS}"


@query("turn_distribution", W + " SELECT call_id, speaker, CAST(count(*) AS BIGINT) AS segments, round(count(*) / sum(count(*)) OVER (PARTITION BY call_id), 6)::DOUBLE AS share FROM chunks GROUP BY call_id, speaker")
def turn_distribution(spark, d):
    return CV.turn_distribution(B.chunks(spark, d)).select("call_id", "speaker", "segments", num("share").alias("share"))


@query("turn_stats", W + f", l AS (SELECT *, lag(speaker) OVER (PARTITION BY call_id ORDER BY seq) AS p FROM chunks) SELECT call_id, "
       f"CAST(count(*) FILTER (p IS DISTINCT FROM speaker) AS BIGINT) AS total_turns, round(avg({sql_word_count('text')}), 6) AS average_turn_length, CAST(count(*) AS BIGINT) AS segments FROM l GROUP BY call_id")
def turn_stats(spark, d):
    s = CV.turn_stats(B.chunks(spark, d))
    return s.select("call_id", "total_turns", num("average_turn_length").alias("average_turn_length"), "segments")


@query("interruptions", W + f" SELECT call_id, CAST(seq AS BIGINT) AS seq, speaker, text FROM (SELECT *, max(seq) OVER (PARTITION BY call_id) AS m FROM chunks) WHERE {sql_word_count('text')} < 12 AND seq < m")
def interruptions(spark, d):
    return CV.interruptions(B.chunks(spark, d), 12).select("call_id", big("seq").alias("seq"), "speaker", "text")


_JAC = "len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b)))"


@query("topic_shifts", W + f", l AS (SELECT call_id, seq, {sql_words('low')} AS a, lag({sql_words('low')}) OVER (PARTITION BY call_id ORDER BY seq) AS b FROM chunks), "
       f"s AS (SELECT call_id, seq, {_JAC} AS j FROM l WHERE b IS NOT NULL AND len(list_concat(a, b)) > 0) "
       "SELECT call_id, CAST(seq AS BIGINT) AS seq, round(j, 6) AS similarity, CASE WHEN j < 0.02 THEN 'major' ELSE 'minor' END AS shift_type FROM s WHERE j < 0.06")
def topic_shifts(spark, d):
    s = CV.topic_shifts(B.chunks(spark, d), minor=0.06, major=0.02)
    return s.select("call_id", big("seq").alias("seq"), num("similarity").alias("similarity"), "shift_type")


_SC = W + f", s AS (SELECT call_id, seq, {sql_sentiment('low', B.SENTIMENT)} AS s FROM chunks)"


@query("sentiment_progression", _SC + " SELECT call_id, round(arg_min(s, seq), 6) AS first_sentiment, round(arg_max(s, seq), 6) AS last_sentiment, round(stddev_pop(s), 6) AS volatility, "
       "CAST(count(*) AS BIGINT) AS segments, CASE WHEN arg_max(s, seq) > arg_min(s, seq) THEN 'improving' ELSE 'declining' END AS overall_trend FROM s GROUP BY call_id")
def sentiment_progression(spark, d):
    p = CV.sentiment_progression(B.chunks(spark, d), B.SENTIMENT)
    return p.select("call_id", *[num(c).alias(c) for c in ("first_sentiment", "last_sentiment", "volatility")], "segments", "overall_trend")


@query("sentiment_journey", _SC + " SELECT call_id, round(arg_min(s, seq), 6) AS initial_sentiment, round(arg_max(s, seq), 6) AS final_sentiment, round(min(s), 6) AS lowest_point, "
       "round(max(s), 6) AS highest_point, round(stddev_pop(s), 6) AS volatility, round(arg_max(s, seq) - arg_min(s, seq), 6) AS sentiment_change FROM s GROUP BY call_id")
def sentiment_journey(spark, d):
    from switchboard.functions import text as T

    scored = B.chunks(spark, d).withColumn("sentiment", T.sentiment(F.lower("text"), B.SENTIMENT))
    j = CV.sentiment_journey(scored)
    return j.select("call_id", *[num(c).alias(c) for c in j.columns if c != "call_id"])


@query("concern_counts", W + ", c AS (" + " UNION ALL ".join(f"SELECT call_id, {q(n)} AS concern FROM chunks WHERE {sql_any('low', w)}" for n, w in B.CONCERNS.items())
       + ") SELECT call_id, concern, CAST(count(*) AS BIGINT) AS mentions FROM c GROUP BY 1, 2")
def concern_counts(spark, d):
    return CV.concern_counts(B.chunks(spark, d), B.CONCERNS)


@query("key_themes", f"WITH {B.CALLS}, t AS (SELECT call_id, unnest({_TOK}) AS token, generate_subscripts({_TOK}, 1) AS pos FROM calls), "
       "n AS (SELECT call_id, token, count(*) AS n, min(pos) AS p FROM t GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY n DESC, p) AS rk FROM n), "
       f"k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rk) AS tr FROM r WHERE rk <= 10 AND (n >= 2 OR token IN ({', '.join(q(w) for ws in B.TOPICS.values() for w in ws)}))) "
       "SELECT call_id, CAST(tr AS BIGINT) AS theme_rank, token, CAST(n AS BIGINT) AS n FROM k WHERE tr <= 5")
def key_themes(spark, d):
    t = CV.key_themes(B.calls(spark, d), topics=B.TOPICS, stop_words=[])
    return t.select("call_id", big("theme_rank").alias("theme_rank"), "token", "n")


_COS = "list_sum(list_transform(list_zip(a, b), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(a, lambda x: x::DOUBLE * x)) * list_sum(list_transform(b, lambda x: x::DOUBLE * x)))"


@query("conversation_coherence", f"WITH l AS (SELECT label, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings), "
       f"s AS (SELECT label, {_COS} AS c FROM l WHERE b IS NOT NULL) SELECT CAST(label AS BIGINT) AS label, round(avg(c), 5) AS coherence_score, CAST(count(*) AS BIGINT) AS adjacent_pairs FROM s GROUP BY 1")
def conversation_coherence(spark, d):
    c = CV.conversation_coherence(B.read(spark, d, "embeddings"), "label", "vec_id", "embedding")
    return c.select(big("label").alias("label"), num("coherence_score", 5).alias("coherence_score"), "adjacent_pairs")


@query("semantic_similarity", f"WITH p AS (SELECT e.vec_id, x.vec_id AS anchor, e.embedding AS a, x.embedding AS b FROM embeddings e, embeddings x WHERE x.vec_id < 6) "
       f"SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(anchor AS BIGINT) AS anchor, round({_COS}, 5) AS similarity FROM p")
def semantic_similarity(spark, d):
    """Cosine with six context vectors; the context set is a fixed-size parameter."""
    e = B.read(spark, d, "embeddings")
    anchors = {r["vec_id"]: r["embedding"] for r in e.where("vec_id < 6").collect()}
    pairs = F.array(*[F.struct(F.lit(k).cast("bigint").alias("anchor"), V.cosine_with(F.col("embedding"), v).alias("s"))
                      for k, v in sorted(anchors.items())])
    return e.select("vec_id", F.inline(pairs)).select("vec_id", "anchor", num("s", 5).alias("similarity"))


@query("split_segments", f"WITH {B.CALLS}, s AS (SELECT call_id, unnest(string_split(transcript, chr(10))) AS text FROM calls) SELECT call_id, CAST(count(*) AS BIGINT) AS segments, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY 1")
def split_segments(spark, d):
    s = CV.split_segments(B.calls(spark, d))
    return s.groupBy("call_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))


@query("concat_segments", W + " SELECT call_id, CAST(0 AS BIGINT) AS part, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM chunks GROUP BY 1")
def concat_segments(spark, d):
    c = CV.concat_segments(B.chunks(spark, d))
    return c.select("call_id", "part", F.md5("transcript").alias("digest"))


@query("key_phrases", f"WITH {B.CALLS}, t AS (SELECT call_id, unnest({_TOK}) AS token FROM calls), tf AS (SELECT call_id, token, count(*) AS tf FROM t GROUP BY 1, 2), "
       "df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), w AS (SELECT call_id, token, tf * ln(((SELECT count(*) FROM calls) + 1)::DOUBLE / (df + 1)) AS s FROM tf JOIN df USING (token)), "
       "r AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(s, 9) DESC, token COLLATE C) AS rk FROM w) SELECT call_id, token, round(s, 6) AS score, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 10")
def key_phrases(spark, d):
    k = TO.key_phrases(TO.tokenise(B.calls(spark, d), stop_words=[]))
    return k.select("call_id", "token", num("score").alias("score"), big("rank").alias("rank"))
