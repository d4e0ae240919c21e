"""Quality by a regularised quadratic discriminant over document statistics.

Each whole text becomes a short vector of statistics (sizes, shares, repetition), transformed so
that good texts are roughly normal: logarithms of counts, arcsine roots of shares. Each label has
a mean and a covariance, gathered over all training rows as sums of outer products, never from a
sample. A covariance is shrunk first towards the pooled one and then towards its own mean variance
times the identity. The score is the probability of label 1: the sigmoid of the difference of the
log densities, whose Mahalanobis parts come from each label's cached Cholesky factor.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import stored, text_of

POOL, RIDGE = 0.1, 0.02     # shares of the pooled covariance and of the identity
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0      # rows whose crc32(doc_id) mod 5 is 0 are never trained on
SHIFT = 20                  # sums are exact integers of 2 ** -SHIFT steps
STATISTICS = ("words", "word_length", "line_words", "spread", "distinct", "top_word", "repeats", "dup_lines", "upper_words",
              "plain_words", "symbols", "exclaims", "pauses", "digits", "spaces", "other_bytes")

# which statistic a byte counts for
_KIND = np.zeros(256, np.int64)
_KIND[[ord(c) for c in "!?"]] = 1
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 2
_KIND[ord("0"):ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 5
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and _KIND[c] == 0]] = 6


def share(part: float, whole: float) -> float:
    """Variance-stabilised share; nothing of nothing is 0."""
    return float(np.arcsin(np.sqrt(part / whole))) if whole else 0.0


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole UTF-8 text; all 0 for an empty one."""
    ws = text.split()
    n, size = len(ws), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 7)
    used = counts[counts > 0] / size
    words = Counter(w.lower() for w in ws)
    lines = [x.strip() for x in text.split(b"\n")]
    lines = [x for x in lines if x]
    letters = size - kinds[4]
    return [
        np.log1p(n), np.log1p(letters / n), np.log1p(n / len(lines)), float(-(used * np.log(used)).sum()),
        np.log1p(n) - np.log1p(len(words)), share(max(words.values()) - 1, n),
        share(sum(a == b for a, b in zip(ws, ws[1:])), n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(len(w) > 1 and w.isupper() for w in ws), n), share(sum(w.isalpha() for w in ws), n),
        np.log1p(kinds[6] / n), np.log1p(kinds[1] / n), np.log1p(kinds[2] / n), share(kinds[3], size), share(kinds[4], size),
        share(kinds[5], size),
    ]


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([statistics(t or b"") for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


def held_out(id_col: str = "doc_id") -> Column:
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(FOLDS)) == HELD_OUT


@dataclass
class Moments:
    """Number of rows, their sum and the sum of their outer products, per label."""

    n: np.ndarray
    total: np.ndarray
    outer: np.ndarray


@dataclass
class Discriminant:
    """Per label: mean, lower Cholesky factor of the covariance, log prior minus half its log determinant."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x, 1) - log p(x, 0)."""
        logs = []
        for k in (0, 1):
            z = np.linalg.solve(self.factors[k], (x - self.means[k]).T)
            logs.append(self.offsets[k] - 0.5 * (z * z).sum(0))
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.difference(x), -500, 500)))


def fit(m: Moments, pool: float = POOL, ridge: float = RIDGE) -> Discriminant:
    """A label without rows borrows the other's moments with a prior of half a row, so that one
    label alone scores near itself; without any rows every score is 0.5."""
    d = m.total.shape[1]
    n = np.maximum(m.n, 0).astype(float)
    both = n.sum()
    if not both:
        return Discriminant(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2))
    means, covs = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        of = k if n[k] else 1 - k
        means[k] = m.total[of] / n[of]
        covs[k] = m.outer[of] / n[of] - np.outer(means[k], means[k])
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / both
    factors, offsets = np.zeros((2, d, d)), np.zeros(2)
    for k in (0, 1):
        c = (1 - pool) * covs[k] + pool * pooled
        c = (1 - ridge) * c + (ridge * np.trace(c) / d + 1e-6) * np.eye(d)
        factors[k] = np.linalg.cholesky(c)
        offsets[k] = np.log((n[k] + 0.5) / (both + 1)) - np.log(np.diag(factors[k])).sum()
    return Discriminant(means, factors, offsets)


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): the statistics of every whole text, measured once and stored."""

    @F.pandas_udf("array<double>")
    def x(t: pd.Series) -> pd.Series:
        return pd.Series(list(matrix(list(t))))

    return stored(docs.select(F.col(id_col).alias("id"), x(text_of(text_col).cast("binary")).alias("x")))


def moments(rows: DataFrame) -> Moments:
    """Exact moments of ``rows`` (y int, x array<double>). Each task adds up its own rows in integers,
    so the result does not depend on the order of tasks; one row per label, task and cell is
    shuffled, and one per label and cell reaches the driver."""
    d = len(STATISTICS)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = np.zeros(2, np.int64), np.zeros((2, d), object), np.zeros((2, d, d), object)
        for b in batches:
            y = np.asarray(b.column("y"))
            x = np.rint(np.asarray(b.column("x").flatten()).reshape(-1, d) * (1 << SHIFT)).astype(np.int64)
            for k in (0, 1):
                of = x[y == k].astype(object)
                if len(of):
                    n[k] += len(of)
                    total[k] += of.sum(0)
                    outer[k] += of.T @ of
        cells = [(k, i, str(v)) for k in (0, 1) if n[k]
                 for i, v in enumerate([n[k], *total[k], *outer[k].ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array([c[j] for c in cells], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.string()))],
                                         ["k", "i", "v"])

    cells = rows.mapInArrow(add_up, "k int, i int, v string").groupBy("k", "i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    found = np.zeros((2, 1 + d + d * d))
    for r in cells.collect():
        found[r["k"], r["i"]] = float(r["v"])
    return Moments(found[:, 0], found[:, 1:1 + d] / 2.0**SHIFT, found[:, 1 + d:].reshape(2, d, d) / 4.0**SHIFT)


def labelled(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(y, x) of the training rows: an id labelled twice counts with its smallest label, and every
    row that carries a labelled id counts. Held-out ids are left out on both sides of the join,
    which moves statistics, not texts."""
    known = (labels.select(F.col(id_col).alias("of"), F.col(label_col).cast("int").alias("y")).filter("of is not null and y in (0, 1)")
             .filter(~held_out("of")).groupBy("of").agg(F.min("y").alias("y")))
    return stats.filter(~held_out("id")).join(known, F.col("id") == F.col("of")).select("y", "x")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             pool: float = POOL, ridge: float = RIDGE) -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (probability of label 1), predicted.

    Null and empty texts have statistics of 0 and a score like any other; very long texts are read
    whole, one at a time. Equal texts score alike, and a score of exactly ``THRESHOLD`` is predicted
    1. Null ids are scored, never trained on. Without usable labels every score is 0.5, and with one
    label only all scores lean to it. Other columns of either table are not read.
    """
    stats = measured(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(fit(moments(labelled(stats, labels, id_col, label_col)), pool, ridge))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(np.stack(x)) if len(x) else [])

    return stats.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int"))
