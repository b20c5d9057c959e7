"""Queries of the numbered operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchboard.llm import audit, decontamination, language, licenses, mixing, ngram_join, packing, quality, rules, substrings, templates, token_ids, vector_codes
from switchboard.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(fn: Callable) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, folder, "documents"), size=3, percent=90)


ORACLES["op8_ngram_jaccard_join"] = ngram_join.ORACLE


@query
def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op1_benchmark_decontamination"] = decontamination.ORACLE


@query
def op6_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    planned = mixing.copies_of(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return planned.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                          F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


ORACLES["op6_mixing_sources"] = mixing.ORACLE


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op10_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    written = scratch_path(spark, "token-ids")
    token_ids.write_corpus(table(spark, folder, "documents"), written, tokenizer_path(), end=2, by_word=True)
    return token_ids.read_corpus(spark, written, with_ids=False)


def remainder(id_column: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % by


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    return quality.train(docs, labels.where(remainder("doc_id", 5) != 0))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality.score_quality(docs, quality_model(docs, table(spark, folder, "labels")))
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score",
                        (F.col("score") >= quality.REJECT_BELOW).cast("int").alias("predicted"))


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.apply_rules(table(spark, folder, "documents"))


ORACLES["op9_quality_rules"] = rules.ORACLE


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.license_summary(licenses.license_spans(table(spark, folder, "documents"))).drop("spans")


@query
def op4_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(docs.where(remainder("doc_id", 4) != 2))
    return language.languages_of(docs, model).select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents"), with_text=False)


ORACLES["op2_substring_dedup"] = substrings.ORACLE


@query
def op5_html_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.extract_pages(table(spark, folder, "pages"))


@query
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op11_filter_audit"] = audit.ORACLE


@query
def op12_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path(), end=2, by_word=True, with_ids=False)


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings"))


ORACLES["op13_vector_codes"] = vector_codes.ORACLE
