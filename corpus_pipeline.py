"""The corpus pipeline: five stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import decontam, line_dedup, mixing, simhash, toxicity
from corpusflow.llm.common import read, shared_dir, text_key

BATCHES = 8


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; all columns as they are, whatever
    their names. Null and empty texts have the bias's score alone and stay unless nearly all
    training rows are toxic; a score of exactly the threshold goes; repeated rows go or stay
    together; no documents, no rows."""
    model = toxicity.train(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.scored(model, docs).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines found in ten or more of them; n_chars follows the text.
    A text that was null stays null."""
    runs = line_dedup.LineRuns(spark)
    runs.add(docs, batch=line_dedup.batch_of(F.col("doc_id"), BATCHES), n_batches=BATCHES)
    cut = line_dedup.drop_repeated_lines(docs, runs)
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("row.text")),
           "n_chars": F.when(changed, F.char_length("kept")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row")[f.name]).alias(f.name)
                        for f in docs.schema])


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id (of rows with that id,
    the smallest text key)."""
    return simhash.keep_one(docs)


def decontam_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item; all columns as they are, whatever their
    names. Null and empty texts hold no window and stay, rows of one id and text go or stay
    together, and without benchmark items all stay."""
    found = decontam.find_windows(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), text_key("text").alias("key"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("key") == F.col("bad_key"))
    return whole.join(bad, same, "left_anti").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's plan, one row per document: doc_id, size, source, source_size, target, taken. Null
    and empty texts have size 0 and are not taken; a null source is one of its own; the order
    within a source is by hash, id and size, so repeated rows lie side by side; no documents, no rows."""
    return mixing.mix(docs).documents


STAGES = [
    ("toxicity", toxic_filter),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dup_stage),
    ("decontamination", decontam_stage),
    ("mixing", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each one's result being written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        out = f"{shared_dir(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


# A trained classifier and SimHash are not expressible in SQL: tests/llm/test_pipeline.py holds every stage
# against plain Python on its own input.
ORACLE_SQL = None
