"""Column helpers and lineage cuts shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"          # what separates words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 500_000             # a narrow key frame of this many rows stays below about 16 MB
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 48


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def text_of(col: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column, sep: str = SPACE) -> Column:
    """Maximal runs outside ``sep``, in order (empty for an empty text)."""
    return F.array_remove(F.split(text, sep), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is. Pure ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def text_key(col: str | Column) -> Column:
    """A 64-bit key of the text: with doc_id it tells rows of one id with different texts apart."""
    return F.xxhash64(text_of(col))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share."""
    from corpusflow.session import work_dir

    return f"{work_dir(spark)}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back.

    Unlike a local checkpoint it survives lost executors, and Parquet keeps it small.
    ``files``: at most so many, for tables that do not grow with the documents."""
    path = shared_dir(df.sparkSession)
    (df.coalesce(files) if files else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a narrow, stored frame for broadcast if a count shows at most ``max_rows`` rows;
    else leave it, so that the join shuffles both sides."""
    return F.broadcast(df) if df.count() <= max_rows else df


def broadcast_checked(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a stored frame for broadcast if its values take at most ``max_bytes``, with an allowance
    per row; else leave it, so that the join shuffles both sides."""
    return F.broadcast(df) if frame_bytes(df) <= max_bytes else df


def frame_bytes(df: DataFrame) -> int:
    """Bytes of all values as strings and ``ROW_BYTES`` per row, summed in the cluster."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(ROW_BYTES))
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0]
