"""The registered queries of the operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import (
    decontam, html_text, importance, licenses, line_dedup, lm_score, mixing, quality, quality_qda, simhash, token_counts,
    toxicity, vector_codes,
)
from corpusflow.llm.common import read, stored
from corpusflow.llm.oracle import ORACLE  # noqa: F401

BATCHES = 8


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents", "doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.detect(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rules are evaluated once, into the stored ledger; the policy and its ablation read only that
    led = stored(quality.ledger(read(spark, sf_dir, "documents", "doc_id", "text")))
    led = quality.with_sole_rule(quality.apply_policy(led))
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      "kept", "fail_bits", "only_rule", "n_only_rule")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_windows(read(spark, sf_dir, "documents", "doc_id", "text"),
                                  read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter("q = 1 and t = 0")
    return lm_score.cross_entropy_difference(read(spark, sf_dir, "documents", "doc_id", "text"), good)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents", "doc_id", "text"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(read(spark, sf_dir, "documents", "doc_id", "text", "source")).documents
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    runs = line_dedup.LineRuns(spark)
    runs.add(docs, batch=line_dedup.batch_of(F.col("doc_id"), BATCHES), n_batches=BATCHES)
    found = line_dedup.drop_repeated_lines(docs, runs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "text"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op13_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality_qda.classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_simhash, op4_quality, op5_decontam, op6_lm_score,
                                   op7_licenses, op8_html_text, op9_mixing, op10_line_dedup,
                                   op11_importance, op12_vector_codes, op13_quality_qda)}
