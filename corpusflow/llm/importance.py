"""Resampling documents by how much more likely they are under a target set than at random.

A word's CRC-32 is computed once per dictionary: the distinct words of a group of texts, bounded
by spaces, are keys of an Aho-Corasick automaton whose payload packs the word's CRC and its
length. One scan over the texts emits the payloads in order; the CRC of a run of words is composed
from its neighbours' payloads, since CRC(a + b) is a linear function of CRC(a), CRC(b) and the
length of b. A feature's bucket is its CRC modulo the number of buckets, the bucket counts of all
documents and of the target set give each bucket's gain, and a document's weight is the sum of its
features' gains. Weights with Gumbel noise drawn from the id make the highest scores a sample
without replacement in proportion to exp(weight / 1000).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import stored, text_of

BUCKETS = 10_000
MAX_WORDS = 1               # longest run of words that is a feature
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
DICTIONARY_BYTES = 4 << 20  # texts that share a dictionary hold about so many bytes
RANGE_ROWS = 1_000_000      # rows that one running rank goes over, about
FOUND = "n_words long, buckets array<int>"

# A-Z to lower case; every other ASCII character but digits and a-z parts words; UTF-8 bytes above stay
_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


def dictionary(words: set[bytes]) -> ahocorasick.Automaton:
    """Each distinct word between spaces, with the payload length << 32 | CRC. The words' UTF-8
    bytes are the automaton's alphabet."""
    found = ahocorasick.Automaton()
    for w in words:
        found.add_word(f" {w.decode('latin-1')} ", len(w) << 32 | zlib.crc32(w))
    found.make_automaton()
    return found


def _advance() -> np.ndarray:
    """Row k: what 2**k zero bytes after a text make of each single bit of its CRC."""
    one = np.array([0xEDB88320] + [1 << i for i in range(31)], dtype=np.uint64)   # one zero bit
    rows = []
    for k in range(3 + 32):
        if k >= 3:
            rows.append(one)
        one = _linear(one, one)
    return np.array(rows)


def _linear(images: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The linear map with the given images of the 32 bits, applied to each CRC."""
    out = np.zeros_like(crc)
    for bit in range(32):
        out ^= images[bit] * (crc >> np.uint64(bit) & np.uint64(1))
    return out


ADVANCE = _advance()


def compose(crc_a: np.ndarray, crc_b: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    """CRC(a + b) from both CRCs and the length of b, for whole columns of pairs."""
    out = crc_a.copy()
    for k in range(int(len_b.max()).bit_length() if len(len_b) else 0):
        turn = (len_b >> np.uint64(k) & np.uint64(1)).astype(bool)
        out[turn] = _linear(ADVANCE[k], out[turn])
    return out ^ crc_b


def feature_crcs(payloads: np.ndarray, max_words: int) -> np.ndarray:
    """CRCs of all runs of 1 to ``max_words`` neighbours, joined by one space, runs of one first."""
    crc, length = payloads & np.uint64(0xFFFFFFFF), payloads >> np.uint64(32)
    spaced = compose(np.full(len(crc), zlib.crc32(b" "), np.uint64), crc, length)     # " " + word
    runs = [crc]
    for _ in range(1, max_words):
        n = len(runs)
        runs.append(compose(runs[-1][:-1], spaced[n:], length[n:] + np.uint64(1)))
    return np.concatenate(runs)


def scan(texts: list[bytes], max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and the features' buckets of each text. Neighbours share the space between
    them, so the automaton reports every word of a line, in order, and nothing else."""
    lines = [words_of(t) for t in texts]
    known = set().union(*lines) if lines else set()
    automaton = dictionary(known) if known else None
    for ws in lines:
        if not ws:
            yield 0, np.zeros(0, np.int32)
            continue
        line = f" {b' '.join(ws).decode('latin-1')} "
        payloads = np.fromiter((p for _, p in automaton.iter(line)), np.uint64, len(ws))
        yield len(ws), (feature_crcs(payloads, max_words) % np.uint64(buckets)).astype(np.int32)


def grouped(texts: list[bytes], size: int = DICTIONARY_BYTES) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``size`` bytes; a longer text is a group of its own."""
    group, held = [], 0
    for t in texts:
        if group and held + len(t) > size:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def features(df: DataFrame, text: Column, max_words: int = MAX_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``df`` with a struct column ``found`` of n_words and the buckets of all features of the
    whole text. A dictionary holds the words of a few megabytes, whatever the corpus holds."""

    @F.pandas_udf(FOUND)
    def scanned(t: pd.Series) -> pd.DataFrame:
        rows = [r for group in grouped(list(t)) for r in scan(group, max_words, buckets)]
        return pd.DataFrame({"n_words": [n for n, _ in rows], "buckets": [b for _, b in rows]})

    return df.withColumn("found", scanned(text_of(text).cast("binary")))


def bucket_counts(feats: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows per bucket: at most ``buckets`` rows reach the driver."""
    counts = feats.select(F.explode("found.buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in counts:
        out[r["b"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p_target / p_source)) per bucket, add-one smoothed, in doubles."""
    n = float(len(source))
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(1000 g) of a standard Gumbel value g drawn from the id; a null id counts as 'null'."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``scored`` (stored; id, score) with ``rank``: 1, 2, ... for the floor(percent N / 100) of the N
    eligible rows that have the highest scores, ties to the smaller id; null for all others.

    The rows are range-partitioned by (score, id), so one score may fill many ranges, and each
    range is numbered on its own. Only the ranges' sizes reach the driver, and only ranges that
    begin above the cut are numbered at all."""
    spark = scored.sparkSession
    n = scored.filter(eligible).count()
    draw = n * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    ranges = max(spark.sparkContext.defaultParallelism, -(-n // range_rows))
    inside = stored(scored.filter(eligible).repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in inside.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], 0
    for part, size in sizes:
        if at < draw:
            offsets.append((part, at))
        at += size
    starts = F.broadcast(spark.createDataFrame(offsets, "part int, start long"))      # one row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("start")
    drawn = inside.join(starts, "part").withColumn("rank", place)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long")).drop("part", "start")
    unranked = inside.join(starts, "part", "left_anti").drop("part").unionByName(scored.filter(~eligible))
    return drawn.unionByName(unranked.withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, percent: int = PERCENT,
             min_words: int = MIN_WORDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank (null if not drawn).

    Null and empty texts have no features and weight 0; texts of fewer than ``min_words`` words are
    scored but never drawn. Whole texts count, however long. Equal scores go to the smaller id,
    null ids last (they share one noise value); repeated rows are scored and ranked row by row, so
    rows equal in id and score take neighbouring ranks. Without documents the result is empty, and
    without target texts all buckets are judged by the smoothing alone. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # the texts are scanned once: 2 bytes or so per feature are kept for counting and for scoring
    feats = stored(features(slim, F.col("text"), max_words, buckets).drop("text"))
    wanted = features(target.select(F.col(target_col).alias("text")), F.col("text"), max_words, buckets)
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(feats, buckets), bucket_counts(wanted, buckets)))

    @F.pandas_udf("long")
    def weight(b: pd.Series) -> pd.Series:
        return pd.Series([int(gain.value[x].sum()) for x in b], dtype="int64")

    scored = feats.select("id", F.size("found.buckets").cast("long").alias("n_features"), F.col("found.n_words").alias("n_words"),
                          weight("found.buckets").alias("weight"))
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    return ranked(scored, F.col("n_words") >= min_words, percent).select(
        F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
