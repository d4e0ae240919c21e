"""Batch embedding: a deterministic hashing embedder by default, any model as a plug-in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.functions.text import _c
from corpusflow.operators.joins import BROADCAST_MAX_BYTES, ROW_OVERHEAD
from corpusflow.session import materialize

DEFAULT_DIM = 64
MAX_TOKENS = 256  # input limit of a sentence encoder; only where it is asked for
TOKEN_RE = "[a-z0-9]+"


def tokens(text, max_tokens: int | None = None) -> Column:
    """Lower-cased alphanumeric tokens of the whole text, or its first ``max_tokens``."""
    found = F.regexp_extract_all(F.lower(F.coalesce(_c(text), F.lit(""))), F.lit(TOKEN_RE), 0)
    return found if max_tokens is None else F.slice(found, 1, max_tokens)


def token_bucket(tok: Column, dim: int) -> Column:
    h = F.md5(tok)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def token_sign(tok: Column) -> Column:
    return F.when(F.conv(F.substring(F.md5(tok), 9, 1), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))


def token_codes(text, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> Column:
    """Per token ``2 * bucket + (1 if the sign is negative)``, hashed on the JVM."""
    return F.transform(
        tokens(text, max_tokens),
        lambda t: token_bucket(t, dim) * 2 + F.when(token_sign(t) < 0, F.lit(1)).otherwise(F.lit(0)),
    )


def _scatter_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def scatter(codes: pd.Series) -> pd.Series:
        # one vectorised scatter-add for the whole Arrow batch
        n = len(codes)
        lens = codes.map(len).to_numpy() if n else np.zeros(0, dtype=np.int64)
        flat = np.concatenate([np.asarray(c, dtype=np.int64) for c in codes]) if lens.sum() else np.zeros(0, np.int64)
        rows = np.repeat(np.arange(n), lens)
        counts = np.bincount(rows * (2 * dim) + flat, minlength=n * 2 * dim).reshape(n, dim, 2)
        w = (counts[:, :, 0] - counts[:, :, 1]).astype(np.float64)
        norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
        out = np.divide(w, norm, out=np.zeros_like(w), where=norm > 0).astype(np.float32)
        return pd.Series(list(out))

    return scatter


def hashing_vector(text, dim: int = DEFAULT_DIM, max_tokens: int | None = None) -> Column:
    """Signed feature hashing of the tokens into ``dim`` buckets, L2-normalised.

    Tokens are extracted and hashed on the JVM; the scatter-add and normalisation run as
    one NumPy pass per Arrow batch. No shuffle. Text without tokens gives a zero vector.
    """
    # a fresh UDF object per use: a reused one fed by another Python UDF's output is not
    # always split into its own Arrow evaluation node by the planner
    return _scatter_udf(dim)(token_codes(text, dim, max_tokens))


# makes the model; the model maps a pandas Series of texts to one vector per text, in order
Embedder = Callable[[], Callable[[pd.Series], "list[list[float]]"]]


def embed(df: DataFrame, text_col: str, out: str = "embedding", embedder: Embedder | None = None,
          dim: int = DEFAULT_DIM) -> DataFrame:
    """Add an ``array<float>`` embedding of ``text_col``.

    With no ``embedder`` the native hashing embedder runs. A model plugs in as a factory,
    called once per task, so that a large model is opened from its own files rather than
    shipped. Only the texts reach Python, in Arrow batches; a null is an empty text.
    """
    if embedder is None:
        return df.withColumn(out, hashing_vector(F.col(text_col), dim))

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = embedder()
        for texts in batches:
            vectors = model(texts) if len(texts) else []
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vectors], dtype=object)

    return df.withColumn(out, run(F.coalesce(F.col(text_col), F.lit(""))))


def mean_pool(token_vectors: Column, mask: Column) -> Column:
    """``sum(tok * mask) / max(sum(mask), 1e-9)`` per dimension over an array of token
    vectors (``array<array<float>>``) and a parallel 0/1 mask."""
    pairs = F.arrays_zip(token_vectors.alias("v"), mask.alias("m"))
    first = F.get(token_vectors, 0)
    zero = F.transform(first, lambda x: F.lit(0.0))
    total = F.aggregate(
        pairs, zero, lambda acc, p: F.zip_with(acc, p["v"], lambda a, b: a + b.cast("double") * p["m"].cast("double"))
    )
    denom = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / denom)


MAX_SLICES = 8  # of a table of vectors that is broadcast a slice at a time


def _run_means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, embedding) to (key, w, mean): neighbouring rows of one key become the sum of
    their ``m`` and the mean of their vectors weighted by it. A vector that is null, has nulls or
    is of another length stays a row of its own."""
    names, vectors = ["key", "w", "mean"], pa.list_(pa.float64())
    for b in batches:
        lists = b.column("embedding")
        width = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        dim = width.max(initial=0)
        plain = width == dim
        flat = lists.flatten()
        if flat.null_count:
            of = np.repeat(np.arange(len(lists)), np.maximum(width, 0))
            plain[of[flat.is_null().to_numpy(zero_copy_only=False)]] = False
        if not dim or not plain.all():
            odd = b.filter(pa.array(~plain | (dim == 0)))
            yield pa.RecordBatch.from_arrays([odd.column("key"), odd.column("m"), odd.column("embedding").cast(vectors)], names)
            b = b.filter(pa.array(plain & (dim > 0)))
        if not b.num_rows:
            continue
        key = b.column("key")
        code = key.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        m = b.column("m").to_numpy(zero_copy_only=False)
        x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        w = np.add.reduceat(m, first)
        mean = np.add.reduceat(x * m[:, None], first) / w[:, None]
        starts = pa.array(np.arange(len(first) + 1, dtype=np.int32) * np.int32(dim))
        yield pa.RecordBatch.from_arrays([pc.take(key, pa.array(first)), pa.array(w), pa.ListArray.from_arrays(starts, pa.array(mean.ravel()))], names)


def pool_tokens(toks: DataFrame, vectors: DataFrame, key: str, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(key, p)``: the mean of the vectors of every key's tokens, by ``m > 0``, the tokens' weight.

    ``toks`` (key, id_col, m) has the tokens of one key next to each other, as ``explode`` makes
    them. The vectors are broadcast, a slice of ``BROADCAST_MAX_BYTES`` at a time, and every
    task adds them up as it reads the tokens: what is shuffled is a vector per key and slice,
    not one per token. A table of more than ``MAX_SLICES`` slices is joined by shuffling the distinct tokens
    of each key, with their vectors."""
    v = vectors.select(id_col, F.col(vec_col).alias("embedding"))
    size = F.greatest(F.size("embedding"), F.lit(0)).cast("long") * 8 + ROW_OVERHEAD
    slices = max(1, -(-(v.agg(F.sum(size)).first()[0] or 0) // BROADCAST_MAX_BYTES))
    if slices > MAX_SLICES:
        counts = toks.groupBy(key, id_col).agg(F.sum("m").alias("w"))
        part = counts.join(v, id_col).select(F.col(key).alias("key"), "w", F.col("embedding").cast("array<double>").alias("mean"))
    else:
        # the texts are read once, whatever the number of slices
        toks = materialize(toks) if slices > 1 else toks
        schema = T.StructType([T.StructField("key", toks.schema[key].dataType), T.StructField("w", T.DoubleType()),
                               T.StructField("mean", T.ArrayType(T.DoubleType()))])
        part = None
        for i in range(slices):
            some = v.filter(F.pmod(F.xxhash64(id_col), F.lit(slices)) == i) if slices > 1 else v
            hit = toks.join(F.broadcast(some), id_col).select(F.col(key).alias("key"), F.col("m").cast("double").alias("m"), "embedding")
            means = hit.mapInArrow(_run_means, schema)
            part = means if part is None else part.unionByName(means)
    per = part.groupBy("key").agg(F.collect_list(F.struct("w", "mean")).alias("t"))
    return per.select(F.col("key").alias(key), mean_pool(F.transform("t", lambda x: x["mean"]), F.transform("t", lambda x: x["w"])).alias("p"))
