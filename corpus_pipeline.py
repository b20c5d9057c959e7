"""A corpus from raw documents to token ids, in five stages.

Every stage reads what the one before it wrote, works on all of it, and returns the columns
of ``documents``; the last returns one row for each written document.  ``run`` writes the tables
between the stages to the folder the cluster shares, so a lost executor costs a stage's tasks, not the run.
Nulls, empty texts and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from switchboard.llm import decontamination, mixing, ngram_join, quality, queries, token_ids
from switchboard.session import materialise, scratch_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, scores 0.3 or more."""
    return quality.accepted(docs, queries.quality_model(docs, queries.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return ngram_join.one_per_component(docs, size=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_benchmark(docs, queries.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that the sources come near their target words."""
    return mixing.mix_sources(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the file format, read back: doc_id, start, n_tokens, ids_crc32."""
    written = scratch_path(spark, "pipeline-ids")
    token_ids.write_corpus(docs, written, queries.tokenizer_path(), end=2, by_word=True)
    return token_ids.read_corpus(spark, written, with_ids=False)


STAGES = [
    ("quality_classifier", good_quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixing_sources", mixed),
    ("token_ids", encoded),
]

#: stages 1, 2 and 5 use a trained model, a graph and a tokenizer, which SQL can't express; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
