"""Vector compression by product codes, with the nearest entry found in a GNAT.

A vector is cut into equal parts; each part is coded as the number of its nearest entry in the
part's codebook, and codebooks are refined by rounds of assigning and averaging in integers. The
entries of a part are kept in a geometric near-neighbour access tree: a node has a few split
points, every other entry belongs to its nearest split point's child, and the node stores the
range of distances from each split point to the members of each child. A query's distance to a
split point plus or minus the best distance so far then rules out whole children whose range it
misses. The ranges and the query's distances are rounded outwards and only strict misses count, so
ties survive and are settled by exact integer distances, the lower entry winning. A search runs
over a whole batch of queries at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow.llm.common import broadcast_bounded, stored

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256                # a component x becomes floor(SCALE * x)
LIMIT = 1 << 27            # integers beyond this have squared distances that may not fit a long
SPLITS, LEAF = 6, 4        # split points per node; nodes of at most LEAF entries are scanned


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of ``a`` to the one row ``b``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def below(squares: np.ndarray) -> np.ndarray:
    """A float that is certainly not above the square root."""
    return np.maximum(np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), -np.inf), -np.inf), 0.0)


def above(squares: np.ndarray) -> np.ndarray:
    """A float that is certainly not below the square root."""
    return np.nextafter(np.nextafter(np.sqrt(squares.astype(np.float64)), np.inf), np.inf)


@dataclass
class Node:
    """``low[i, j]``, ``high[i, j]``: bounds of the distances from split point i to child j's entries."""

    splits: list[int]
    children: list[Node] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None


class Gnat:
    """A tree over the rows of ``entries`` (integers)."""

    def __init__(self, entries: np.ndarray, splits: int = SPLITS, leaf: int = LEAF):
        self.entries, self.n_splits, self.leaf = np.asarray(entries, dtype=np.int64), splits, max(leaf, splits)
        self.compared = 0      # distances computed by searches, for reports
        self.root = self._build(list(range(len(self.entries))))

    def _build(self, ids: list[int]) -> Node:
        if len(ids) <= self.leaf:
            return Node(ids)
        e = self.entries[ids]
        # split points far apart: each is the entry farthest from those before it
        picked, far = [0], squared(e, e[0])
        while len(picked) < self.n_splits and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, squared(e, e[picked[-1]]))
        if len(picked) == 1:           # equal entries: the first one wins every tie
            return Node(ids[:1])
        d = np.stack([squared(e, e[p]) for p in picked])
        home = d.argmin(0)
        node = Node([ids[p] for p in picked], low=np.full((len(picked),) * 2, np.inf), high=np.full((len(picked),) * 2, -np.inf))
        for j in range(len(picked)):
            mine = [k for k in np.flatnonzero(home == j) if k not in picked]
            node.children.append(self._build([ids[k] for k in mine]))
            if mine:
                node.low[:, j], node.high[:, j] = below(d[:, mine].min(1)), above(d[:, mine].max(1))
        return node

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and the squared distance, per query."""
        queries = np.asarray(queries, dtype=np.int64)
        best, index = np.full(len(queries), np.iinfo(np.int64).max), np.full(len(queries), len(self.entries))
        self._search(self.root, queries, np.arange(len(queries)), best, index)
        return index, best

    def _search(self, node: Node, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        q, dists = queries[rows], []
        for s in node.splits:
            d = squared(q, self.entries[s])
            better = (d < best[rows]) | ((d == best[rows]) & (s < index[rows]))
            best[rows[better]], index[rows[better]] = d[better], s
            dists.append(d)
        self.compared += len(rows) * len(node.splits)
        if not node.children:
            return
        near, far = [below(d) for d in dists], [above(d) for d in dists]
        for j, child in enumerate(node.children):
            if not child.splits:
                continue
            reach = above(best[rows])                # shrinks from child to child
            alive = np.ones(len(rows), bool)
            for i in range(len(node.splits)):
                out = (np.nextafter(near[i] - reach, -np.inf) > node.high[i, j]) | (np.nextafter(far[i] + reach, np.inf) < node.low[i, j])
                alive &= ~out
            if alive.any():
                self._search(child, queries, rows[alive], best, index)


@dataclass
class Codebooks:
    """``entries[p][k]``: entry k of part p, integers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def trees(self) -> list[Gnat]:
        return [Gnat(e) for e in self.entries]


def integers(df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(id, label, v): vectors without null or non-finite components, each floored to ``SCALE`` steps.
    A component beyond ``LIMIT`` steps counts as not finite."""
    v = F.col("raw")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LIMIT / SCALE), F.lit(False)))
    kept = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("raw")).filter(
        v.isNotNull() & (F.size(v) > 0) & finite)
    return kept.select("id", "label", F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.asarray(batch.column("v").flatten(), dtype=np.int64).reshape(-1, width)


def first_entries(vectors: DataFrame, n: int, parts: int) -> Codebooks | None:
    """The parts of the ``n`` vectors with the smallest ids (null ids last, equal ids by vector).
    Their first one fixes the width: see :func:`compress`."""
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = vectors.filter(F.size("v") % parts == 0).orderBy(*order).limit(1).collect()
    if not first:
        return None
    rows = vectors.filter(F.size("v") == len(first[0]["v"])).orderBy(*order).limit(n).collect()
    v = np.array([r["v"] for r in rows], dtype=np.int64)
    return Codebooks(v.reshape(len(rows), parts, -1).transpose(1, 0, 2).copy())


def refine(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, then every entry to the floored mean of its parts.

    Each task adds up its own parts, so a shuffle moves one row per task, part, entry and position
    at most, and one row per position of the codebooks reaches the driver."""
    parts, n, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees()
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for b in batches:
            m = matrix(b, parts * width)
            for p, tree in enumerate(trees):
                sub = m[:, p * width:(p + 1) * width]
                index, _ = tree.nearest(sub)
                np.add.at(sums[p], index, sub)
                counts[p] += np.bincount(index, minlength=n)
        p, k = np.nonzero(counts)
        at = [np.repeat(p, width), np.repeat(k, width), np.tile(np.arange(width), len(p))]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in (
            (at[0], pa.int32()), (at[1], pa.int32()), (at[2], pa.int32()), (sums[p, k].ravel(), pa.int64()),
            (np.repeat(counts[p, k], width), pa.int64()))], ["p", "k", "i", "total", "n"])

    added = vectors.select("v").mapInArrow(add_up, "p int, k int, i int, total long, n long")
    means = added.groupBy("p", "k", "i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = books.entries.copy()
    for r in means.collect():
        out[r["p"], r["k"], r["i"]] = int(r["total"]) // r["n"]
    return Codebooks(out)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(id, label, code, error) of every vector."""
    parts, _, width = books.entries.shape
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType([vectors.schema["id"], vectors.schema["label"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value.trees()
        for b in batches:
            m = matrix(b, parts * width)
            codes, error = np.zeros((len(m), parts), np.int64), np.zeros(len(m), np.int64)
            for p, tree in enumerate(trees):
                codes[:, p], d = tree.nearest(m[:, p * width:(p + 1) * width])
                error += d
            text = ["".join(f"{k:02x}" for k in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             ["id", "label", "code", "error"])

    return vectors.mapInArrow(coded, schema)


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id",
             vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per usable vector: id, code, error, label_error, codebooks_sha256.

    Not usable, and dropped: null and empty vectors, those with null or non-finite components, and
    those whose length differs from that of the usable vector with the smallest id whose length
    ``parts`` divides. With fewer than ``entries`` usable vectors the codebooks have as many entries.
    Equal distances go to the lower entry; repeated rows are coded alike, each with a row of its own,
    and equal ids are ordered by their vectors. Null labels make one group. No usable vector, no
    rows. Vectors of any length take one row's memory; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry number must fit two hex digits")
    vectors = integers(df, vec_col, id_col, label_col)
    books = first_entries(vectors, entries, parts)
    if books is None:
        return vectors.limit(0).select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                       F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    vectors = vectors.filter(F.size("v") == books.entries.shape[0] * books.entries.shape[2])
    for _ in range(rounds):
        books = refine(vectors, books)
    coded = stored(encode(vectors, books))
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error"))
    return coded.join(broadcast_bounded(sums), F.col("label").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
