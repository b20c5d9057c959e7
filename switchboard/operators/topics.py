"""Topic models over a corpus of calls, and term weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import IDF, CountVectorizerModel, HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from switchboard import rules as R
from switchboard.functions import text as T
from switchboard.functions import topics as TP
from switchboard.operators import topic_table
from switchboard.operators.topic_table import TopicTable
from switchboard.session import by_key, materialise

MIN_DOC_TOKENS = 5
MIN_DOCS = 3
#: parts of all (call, token) pairs of which a hot token holds one, so the most tokens that are broadcast
HOT_TOKENS = 100_000
#: terms of a topic model's matrix
MOST_TERMS = 200_000


def tokenise(calls: DataFrame, text: str = "transcript", stop_words: Sequence[str] | None = None) -> DataFrame:
    stop = TP.stop_words() if stop_words is None else stop_words
    return calls.withColumn("tokens", T.tokens(F.col(text), stop))


def call_topics(calls: DataFrame, text: str = "transcript", topics: Mapping = R.TOPICS,
                stop_words: Sequence[str] | None = None) -> DataFrame:
    """Predefined topic of every call: token overlap, or substrings for short calls."""
    tokens = tokenise(calls.select("call_id", text), text, stop_words).withColumn("_low", F.lower(F.col(text)))
    short = F.size("tokens") < TP.MIN_TOKENS
    by_tokens = TP.topic_scores(F.col("tokens"), topics)
    by_text = TP.fallback_topic_scores(F.col("_low"), topics)
    scored = tokens.select("call_id", short.alias("short"), F.size("tokens").alias("n_tokens"), *[
        F.when(short, by_text[n]).otherwise(by_tokens[n]).alias(f"topic_{n}") for n in topics])
    label, top = T.best_label({n: F.col(f"topic_{n}") for n in topics})
    return scored.withColumns({"predefined_topic": label, "predefined_score": top})


class VocabularyTooLarge(ValueError):
    """More terms pass the document frequencies than a topic model may have."""


def usable_documents(tokenised: DataFrame) -> DataFrame:
    """Documents with enough tokens for a topic model."""
    return tokenised.where(F.size("tokens") > MIN_DOC_TOKENS)


def topic_vocabulary(usable: DataFrame, min_docs: int = 2, max_share: float = 0.7) -> DataFrame:
    """(term, docs) of the terms that at least ``min_docs`` documents have, and at most ``max_share`` of all."""
    docs = usable.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("docs"))
    return docs.where((F.col("docs") >= min_docs) & (F.col("docs") <= max_share * usable.agg(F.count("*")).scalar()))


def vocabulary_loss(usable: DataFrame, vocabulary: DataFrame, kept: int) -> DataFrame:
    """(terms, kept, tokens, lost): terms of the vocabulary, those a model of ``kept`` terms has, their tokens and how many of these it leaves out."""
    seen = usable.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("tokens"))
    chosen = most_frequent(vocabulary, kept).select("term", F.lit(True).alias("chosen"))
    every = vocabulary.select("term").join(seen, "term").join(F.broadcast(chosen), "term", "left")
    return every.agg(F.count("*").alias("terms"), F.count("chosen").alias("kept"), F.sum("tokens").alias("tokens"),
                     F.coalesce(F.sum(F.when(F.col("chosen").isNull(), F.col("tokens"))), F.lit(0)).alias("lost"))


def most_frequent(vocabulary: DataFrame, n: int) -> DataFrame:
    return vocabulary.orderBy(F.desc("docs"), "term").limit(n)


def train_topics(tokenised: DataFrame, num_topics: int = 10, passes: int = 20, seed: int = 42,
                 min_docs: int = 2, max_share: float = 0.7, vocabulary: int | None = None, most_terms: int | None = None,
                 stored: DataFrame | None = None) -> PipelineModel | TopicTable | None:
    """Term counts and an LDA model; None for fewer than three usable documents.

    Terms are pruned by document frequency on the cluster.  Spark's LDA keeps a matrix of topics times terms and a list of
    terms on the driver, so it is used for up to ``MOST_TERMS``; with more, the model is a ``TopicTable``, which has
    all of them.  ``most_terms`` asks for an error if more pass.  ``vocabulary`` asks for
    so many of the most frequent ones only; ``vocabulary_loss`` tells what that leaves out.  ``stored`` are the same rows
    as a table, if they have been written already.
    """
    usable = usable_documents(tokenised)
    if usable_documents(tokenised if stored is None else stored).select("tokens").limit(MIN_DOCS).count() < MIN_DOCS:
        return None
    # texts are tokenised once for what follows
    written = materialise(usable.select("tokens"), "topic-documents") if stored is None else usable_documents(stored).select("tokens")
    passed = materialise(topic_vocabulary(written, min_docs, max_share), "topic-terms")
    if vocabulary is None:
        n = passed.count()
        if most_terms is not None and n > most_terms:
            raise VocabularyTooLarge(f"{n} terms pass, the model may have at most {most_terms}: raise min_docs or ask for a vocabulary")
        if n > MOST_TERMS:
            return topic_table.train(written, passed, min(MOST_TERMS, topic_table.FREQUENT), num_topics, passes, seed)
    chosen = [r["term"] for r in most_frequent(passed, min(vocabulary or MOST_TERMS, most_terms or MOST_TERMS)).collect()]
    counts = CountVectorizerModel.from_vocabulary(chosen or [""], inputCol="tokens", outputCol="counts")
    lda = LDA(k=num_topics, maxIter=passes, seed=seed, optimizer="online", featuresCol="counts").fit(counts.transform(usable))
    return PipelineModel([counts, lda])


def top_terms(model: PipelineModel | TopicTable, n: int = 10) -> DataFrame:
    """(topic, rank, term, weight); as many rows as topics times ``n``."""
    if isinstance(model, TopicTable):
        return model.top_terms(n)
    vectoriser, lda = model.stages
    described = lda.describeTopics(n).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "t"))
    flat = described.select("topic", "rank", F.col("t.termIndices").alias("i"), F.col("t.termWeights").alias("weight"))
    spark = flat.sparkSession
    used = {r["i"] for r in flat.select("i").distinct().collect()}  # topics * n at most
    names = spark.createDataFrame([(i, vectoriser.vocabulary[i]) for i in sorted(used)], "i int, term string")
    return flat.join(F.broadcast(names), "i").select("topic", "rank", "term", "weight")


def topic_labels(model: PipelineModel | TopicTable, topics: Mapping = R.TOPICS, n: int = 3) -> DataFrame:
    """Readable label of every topic from its heaviest terms."""
    ranked = top_terms(model, n).groupBy("topic").agg(
        F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_t"))
    terms = ranked.select("topic", F.transform("_t", lambda x: x["term"]).alias("terms"))
    return terms.withColumn("label", TP.topic_label(F.col("terms"), topics))


def document_topics(model: PipelineModel | TopicTable, tokenised: DataFrame) -> DataFrame:
    """Topic distribution and the most likely topic of each document."""
    if isinstance(model, TopicTable):
        shares = model.shares(tokenised)
    else:
        shares = model.transform(tokenised).withColumn("topic_distribution", vector_to_array("topicDistribution"))
    best = F.array_max("topic_distribution")
    return shares.drop("counts", "topicDistribution").withColumns({
        "dominant_topic_id": (F.array_position("topic_distribution", best) - 1).cast("int"),
        "dominant_topic_probability": best})


def topic_coherence(tokenised: DataFrame, terms: DataFrame) -> DataFrame:
    """Document-level NPMI of each topic's terms.

    A document is reduced to the topics' words it has, then to one bit mask per topic, and equal masks are
    counted first; pairs are only formed on the few distinct masks.  The words are tested in a loop over a
    literal: a test written out for each makes a method too long to be compiled.
    """
    listed = terms.select("topic", "rank", "term").collect()  # topics * terms per topic
    by_topic: dict[int, list[str]] = {}
    for r in sorted(listed, key=lambda r: (r["topic"], r["rank"])):
        by_topic.setdefault(r["topic"], []).append(r["term"])
    if max(len(w) for w in by_topic.values()) > 63:
        raise ValueError("a bit mask holds at most 63 terms of a topic")
    words = F.array(*[F.lit(w) for w in sorted({r["term"] for r in listed})])
    present = tokenised.select(F.array_intersect("tokens", words).alias("present"))
    of_topics = F.array(*[F.struct(F.lit(t).alias("topic"), F.array(*map(F.lit, words)).alias("terms")) for t, words in by_topic.items()])
    per_doc = F.transform(of_topics, lambda t: F.struct(t["topic"].alias("topic"), _presence(t["terms"]).alias("mask")))
    masks = (present.select(F.inline_outer(per_doc)).groupBy("topic", "mask").agg(F.count("*").alias("docs")))
    n = max(len(w) for w in by_topic.values())
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                      for i in range(n) for j in range(i + 1, n)])
    counted = masks.select("topic", "mask", "docs", F.inline(pairs)).groupBy("topic", "i", "j").agg(
        F.sum("docs").alias("all_docs"),
        F.sum(F.when(_bit("mask", "i"), F.col("docs")).otherwise(0)).alias("n_i"),
        F.sum(F.when(_bit("mask", "j"), F.col("docs")).otherwise(0)).alias("n_j"),
        F.sum(F.when(_bit("mask", "i") & _bit("mask", "j"), F.col("docs")).otherwise(0)).alias("n_ij"))
    p_i, p_j, p_ij = (F.col(c) / F.col("all_docs") for c in ("n_i", "n_j", "n_ij"))
    npmi = (F.when(F.col("n_ij") == 0, F.lit(-1.0)).when(p_ij == 1, F.lit(1.0))
            .otherwise(F.log(p_ij / (p_i * p_j)) / -F.log(p_ij)))
    return counted.where("n_i > 0 and n_j > 0").groupBy("topic").agg(F.avg(npmi).alias("npmi"))


def _presence(terms: Column) -> Column:
    """Bit ``i`` is set where the document has term ``i``."""
    bits = F.transform(terms, lambda w, i: F.when(F.array_contains("present", w), F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
                       .otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda mask, bit: mask.bitwiseOR(bit))


def _bit(mask: str, position: str):
    return F.call_function("shiftright", F.col(mask), F.col(position)).bitwiseAND(F.lit(1)) == 1


def key_phrases(tokenised: DataFrame, key: str = "call_id", n: int = 10) -> DataFrame:
    """The ``n`` heaviest tokens of each call by TF-IDF.

    Texts are shuffled once and their tokens counted where the rows of their call are.  A token holding one of
    ``HOT_TOKENS`` parts of all pairs or more is hot; there can be no more than so many of those, so their document
    frequencies are broadcast and their pairs stay in place, where all but the ``n`` heaviest of a call are dropped
    before the last shuffle.  Only the pairs of all other tokens are joined on the token.
    """
    tokens = by_key(tokenised.select(key, "tokens"), key).select(key, F.explode_outer("tokens").alias("token"))
    # texts are tokenised once: what follows reads the written counts
    counts = materialise(tokens.groupBy(key, "token").agg(F.count("*").alias("tf")), "key-phrases")
    tf = counts.where(F.col("token").isNotNull())
    df = materialise(tf.groupBy("token").agg(F.count("*").alias("df")), "key-phrase-documents")
    n_docs = tokenised.agg(F.count("*")).scalar()
    is_hot = F.col("df") * HOT_TOKENS >= tf.agg(F.count("*")).scalar()
    hot = F.broadcast(df.where(is_hot))
    found = tf.join(hot, "token").unionByName(tf.join(hot, "token", "left_anti").join(df, "token"))
    idf = F.log((n_docs + 1) / (F.col("df") + 1))
    scored = found.select(key, "token", "tf", (F.col("tf") * idf).alias("score"))
    heaviest = Window.partitionBy(key).orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(heaviest)).where(F.col("rank") <= n)


def train_intent_model(labelled: DataFrame, label: str, features: int = 1000, iterations: int = 20) -> PipelineModel:
    """Uni- and bigram TF-IDF with logistic regression on a labelled table."""
    stages = [NGram(n=2, inputCol="tokens", outputCol="bigrams"),
              HashingTF(inputCol="grams", outputCol="tf", numFeatures=features),
              IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(labelCol=label, featuresCol="features", maxIter=iterations)]
    pairs = stages[0].transform(labelled)
    joined = pairs.withColumn("grams", F.concat("tokens", "bigrams"))
    return Pipeline(stages=stages[1:]).fit(joined)


def predict_intent(model: PipelineModel, tokenised: DataFrame) -> DataFrame:
    pairs = NGram(n=2, inputCol="tokens", outputCol="bigrams").transform(tokenised)
    out = model.transform(pairs.withColumn("grams", F.concat("tokens", "bigrams")))
    return out.drop("bigrams", "grams", "tf", "features", "rawPrediction")


def save_topics(model: PipelineModel | TopicTable, path: str) -> None:
    if isinstance(model, TopicTable):
        model.save(path)
    else:
        model.write().overwrite().save(path)


def load_topics(path: str) -> PipelineModel | TopicTable:
    spark = SparkSession.active()
    return TopicTable.load(spark, path) if TopicTable.saved(spark, path) else PipelineModel.load(path)
