"""Readers for the input tables. Explicit column lists keep Parquet pruning visible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


# Tables whose rows carry long text (per-row work on them is CPU-heavy), with their key.
TEXT_TABLES = {"pages": "page_id", "documents": "doc_id"}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df, key=TEXT_TABLES[name]) if name in TEXT_TABLES else df
