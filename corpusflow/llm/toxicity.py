"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + 1/2 sum_f c_f ((sum_i v_if)^2 - sum_i v_if^2)) over the k distinct
known terms of a text, so pairs of terms add their own evidence. The first half of the factors
belongs to terms that tell the labels apart alone (c = 1), the second to all frequent terms, so
that pairs of terms that alone say nothing count too; there c = 1 / sqrt(k) keeps the many pairs
of a long text from adding up. Terms are lower-cased runs of
letters or digits and their beginnings (which carries inflected and compounded forms),
hashed on the JVM; a task scores a batch with a few NumPy reductions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import let, stored, text_of

STEMS = (3, 4, 5, 6, 7)  # lengths of the beginnings that count as terms
SLOTS = 1 << 20          # hash slots
FACTORS = 4              # of either half
TRAIN_ROWS = 4_000       # bound of the training sample, per label
SAMPLE_FILES = 8         # the sample's terms are stored in so many files
MIN_DF = 5               # a term in fewer training texts gets neither a weight nor factors
MIN_Z, MIN_RATIO = 3.0, 2.0     # terms that differ less between the labels get no weight and half of the factors
THRESHOLD = 0.3
HELD_OUT = 2             # rows whose crc32(doc_id) mod 4 is this are never trained on


def terms(text: Column, slots: int = SLOTS) -> Column:
    """Sorted distinct hash slots of the whole text's terms.

    Terms are the distinct words, their beginnings of ``STEMS`` letters, each once more where
    two and where three or more words share it, and the order of magnitude of the number of
    words, which pairs with the others. An empty text has only the latter."""
    ws = F.array_distinct(F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), ""))

    def slot(*x: Column) -> Column:
        return F.pmod(F.xxhash64(*x), F.lit(slots)).cast("int")

    def hashes(w: Column) -> Column:
        stems = [F.transform(F.filter(w, lambda x, n=n: F.char_length(x) > n),
                             lambda x, n=n: F.xxhash64(F.lit(n), F.substring(x, 1, n))) for n in STEMS]
        return F.sort_array(F.concat(F.transform(w, lambda x: F.xxhash64(x)), *stems))

    def counted(h: Column) -> Column:
        times = lambda x, i: F.when(F.get(h, i - 2) == x, 3).when(F.get(h, i - 1) == x, 2).otherwise(1)
        return F.transform(h, lambda x, i: slot(x, times(x, i)))

    def both(w: Column) -> Column:
        size = slot(F.lit("length"), F.floor(F.log2(F.size(w) + 1)).cast("int"))
        return F.sort_array(F.array_distinct(F.concat(let(hashes(w), counted), F.array(size))))

    return let(ws, both)


def held_out(id_col: str = "doc_id") -> Column:
    crc = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(crc, F.lit(4)) == HELD_OUT


@dataclass
class FactorizationMachine:
    """``index`` maps a hash slot to a row of ``w`` and ``v`` (-1: neither)."""

    index: np.ndarray
    b: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(rows), self.b)
        for i, slots in enumerate(rows):
            k = self.index[np.asarray(slots, dtype=np.int64)]
            k = k[k >= 0]
            if len(k):
                v = self.v[k]
                out[i] += self.w[k].sum(dtype=np.float64) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)) @ halves(len(k), v.shape[1]))
        return out


def halves(k: int, width: int) -> np.ndarray:
    """c of each factor, for a text of k known terms."""
    return np.repeat((1.0, 1 / np.sqrt(max(k, 1))), width // 2)


def informative(df: np.ndarray, n: np.ndarray, min_df: int = MIN_DF, z: float = MIN_Z, ratio: float = MIN_RATIO) -> np.ndarray:
    """Slots that tell the labels apart alone: ``df[y]`` counts the texts of label y that hold a
    slot. A slot is one if its shares differ by ``z`` standard errors and by the factor ``ratio``;
    all others' weights would only add the noise of a long text's many words."""
    p0, p1 = (df[0] + 0.5) / (n[0] + 1), (df[1] + 0.5) / (n[1] + 1)
    p = (df.sum(0) + 1) / (n.sum() + 2)
    error = np.sqrt(p * (1 - p) * (1 / max(n[0], 1) + 1 / max(n[1], 1)))
    return np.flatnonzero((df.sum(0) >= min_df) & (np.abs(p1 - p0) >= z * error) & (np.abs(np.log(p1 / p0)) >= np.log(ratio)))


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, slots: int = SLOTS, factors: int = FACTORS,
        epochs: int = 12, rate: float = 0.1, l2: float = 2e-3, min_df: int = MIN_DF, seed: int = 7,
        pair_rate: float = 0.015) -> FactorizationMachine:
    """AdaGrad on the logistic loss, over a bounded sample. Every term of ``min_df`` texts has
    the second half of the factors, informative ones the first and a weight too. ``prior`` is the share of label 1 among all training
    labels; the bias is shifted from the sample's share to it."""
    df = np.zeros((2, slots))
    for r, y in zip(rows, labels):
        df[int(y), np.asarray(r, dtype=np.int64)] += 1
    used = np.flatnonzero(df.sum(0) >= min_df)
    alone = np.isin(used, informative(df, np.array([(labels == 0).sum(), (labels == 1).sum()]), min_df))
    index = np.full(slots, -1, np.int32)
    index[used] = np.arange(len(used), dtype=np.int32)
    rng = np.random.default_rng(seed)
    w = np.zeros(len(used))
    own = np.concatenate((np.repeat(alone[:, None], factors, 1), np.ones((len(used), factors), bool)), 1)
    v = rng.normal(0, 0.01, own.shape) * own
    step = np.repeat((rate, pair_rate), factors)
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    b = float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(len(used), 1e-3), np.full(v.shape, 1e-3), 1e-3
    data = [index[np.asarray(r, dtype=np.int64)] for r in rows]
    data = [d[d >= 0] for d in data]
    for _ in range(epochs if len(used) and 0 < labels.sum() < len(labels) else 0):
        for i in rng.permutation(len(data)):
            k = data[i]
            vk = v[k]
            s = vk.sum(0)
            c = halves(len(k), v.shape[1])
            m = b + w[k].sum() + 0.5 * float((s * s - (vk * vk).sum(0)) @ c)
            g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - labels[i]
            gb += g * g
            b -= rate * g / np.sqrt(gb)
            if len(k):
                # a long text has many terms: its step is shared among them, in either half
                told = alone[k]
                scale = g / np.sqrt(max(told.sum(), 1))
                d = (scale + l2 * w[k]) * told
                gw[k] += d * d
                w[k] -= rate * d / np.sqrt(gw[k])
                scale = np.repeat((scale, g / np.sqrt(len(k))), factors)
                d = (scale * c * (s - vk) + l2 * vk) * own[k]
                gv[k] += d * d
                v[k] = vk - step * d / np.sqrt(gv[k])
    p = float(np.clip(prior, 1e-6, 1 - 1e-6))
    b += float(np.log(p / (1 - p)) - np.log(share / (1 - share)))
    return FactorizationMachine(index, b, w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          rows_per_label: int = TRAIN_ROWS) -> FactorizationMachine:
    """Fit on at most ``rows_per_label`` rows of either label, the smallest by a hash of their
    id; held-out rows are never read. An id labelled twice counts with its largest label, and one
    with several texts with the text of the smallest hash."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)")
             .filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y")))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for y in (0, 1):
        # hashes below this bound hold about twice as many rows as are wanted: every partition
        # sends the driver a few candidates, not rows_per_label of them
        share = min(1.0, 2.0 * rows_per_label / max(n.get(y, 0), 1) + 1000.0 / max(n.get(y, 0), 1))
        near = F.shiftrightunsigned(F.xxhash64("id"), 33) <= int(share * (1 << 31))
        picked += known.filter((F.col("y") == y) & near).orderBy(
            F.shiftrightunsigned(F.xxhash64("id"), 33), "id").limit(rows_per_label).collect()
    kind = known.schema["id"].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame([(r["id"], int(r["y"])) for r in picked], f"id {kind}, y int")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # at most 2 * rows_per_label ids: a proven bound
    feats = texts.join(F.broadcast(sample), "id").select("id", "y", F.xxhash64("text").alias("k"), terms(F.col("text")).alias("t"))
    # one row per id, whatever number of rows carries it: at most 2 * rows_per_label rows
    feats = stored(feats.groupBy("id", "y").agg(F.min_by("t", "k").alias("t")), SAMPLE_FILES)
    # texts may be long: the terms are counted in the cluster, and only the frequent ones are sent
    per_slot = feats.select(F.explode("t").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= MIN_DF).toArrow()
    wanted = np.zeros(SLOTS, bool)
    wanted[np.asarray(per_slot["s"], dtype=np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    @F.pandas_udf("array<int>")
    def frequent(t: pd.Series) -> pd.Series:
        return t.map(lambda s: s[shared.value[s]])

    feats = feats.select("id", "y", frequent("t").alias("t")).toArrow()
    ids = feats["id"].to_pylist()
    order = sorted(range(len(ids)), key=ids.__getitem__)
    rows = [np.asarray(x.values, dtype=np.int32) for x in feats["t"]]
    y = np.asarray(feats["y"], dtype=np.float64)
    total = sum(n.values())
    return fit([rows[i] for i in order], y[order], n.get(1, 0) / total if total else 0.0)


def scored(model: FactorizationMachine, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (struct of all columns of ``docs``, whatever their names) and ``score`` of each whole
    text, 0 to 1. Only the term slots reach Python; the model has at most ``SLOTS`` rows and is
    broadcast once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def margin(t: pd.Series) -> pd.Series:
        return pd.Series(1 / (1 + np.exp(-np.clip(shared.value.margin(list(t)), -500, 500))))

    # an outer explode of one array keeps the terms' expression out of the Python node's inputs
    slots = docs.select(F.struct("*").alias("row"), F.explode_outer(F.array(terms(text_of(text_col)))).alias("terms"))
    return slots.select("row", margin("terms").alias("score"))


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score, predicted.

    Null and empty texts have no terms and score the bias alone. Without usable labels every
    score is near 0. Labels, languages and sources never enter a score; equal texts score
    alike, repeated rows each get a row, and a score of exactly ``THRESHOLD`` is predicted 1.
    Very long texts are read whole, and only their distinct terms reach Python. Ids may be of any
    type that sorts. Extra columns are not read.
    """
    model = train(docs, labels, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return scored(model, slim).select(F.col("row.id").alias(id_col), held_out("row.id").alias("held_out"), "score",
                                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
