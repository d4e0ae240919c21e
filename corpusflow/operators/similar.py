"""Cosine k-nearest neighbours: one subject, all subjects (exact), and LSH (approximate).

Exact all-pairs is O(N^2) work by definition; it is blocked so that no task holds more
than two blocks and no pair is ever materialised as a row. The LSH path is the one that
scales to very large tables: candidates come only from shared buckets, and hot buckets
are split into sub-blocks like the exact path. Vectors move in their own element type (as
floats, if they are stored so) and are normalised where they are compared.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.vectors import cosine_distance, norm, similarity
from corpusflow.operators.articles import check_k
from corpusflow.operators.joins import broadcast_if_small
from corpusflow.session import materialize

BLOCK_ROWS = 32_768      # rows of a block: a row is copied once per block
TILE = 2048              # rows and columns of the distances that a task holds at a time
MIN_BLOCKS = 6           # of a table that has as many tiles, to keep the tasks of a small one busy
DISTANCE_STEP = 1e-12    # distances that differ by less are ties
POSITION_BITS = 22
TOPK_SCHEMA = "subject_id long, id long, distance double"


def similar_to(articles: DataFrame, subject_id: int, k: int = 5, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """Exact top-k for one subject: the subject vector is a scalar subquery (run once and
    shipped with the plan), so the table is scanned once with no join or shuffle."""
    check_k(k)
    subj = articles.filter(F.col(id_col) == subject_id).select(vec_col).scalar()
    cand = articles.filter(F.col(id_col) != subject_id).withColumn("_subject", subj)
    cand = cand.withColumn("distance", cosine_distance(F.col(vec_col), F.col("_subject"))).drop("_subject")
    top = cand.filter(F.col("distance").isNotNull()).orderBy("distance", id_col).limit(k)
    # rank over at most k rows
    return top.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col))).withColumn(
        "similarity", similarity(F.col("distance"))
    )


def unit_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(id, u)`` with ``u`` the L2-normalised vector in double; zero vectors dropped."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("_v"), norm(F.col(vec_col)).alias("_n"))
    return v.filter(F.col("_n") > 0).select("id", F.transform("_v", lambda x: x.cast("double") / F.col("_n")).alias("u"))


def raw_vectors(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """``(id, u)`` with ``u`` the vector as stored; those that :func:`unit_vectors` drops are dropped."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("u"))
    return v.filter(norm(F.col("u")) > 0)


def _matrix(lists: pa.Array) -> np.ndarray:
    """The rows of a list column as one matrix of doubles."""
    n = len(lists)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if n and not (lists.value_lengths().to_numpy(zero_copy_only=False) * n == len(flat)).all():
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


class _Side:
    """Ids and unit vectors of a block in the order of their ids, null ids last."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("id").combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy()
        order = np.lexsort((ids, ~known))
        self.ids, self.known = ids[order], known[order]
        m = _matrix(rows.column("u").combine_chunks())[order]
        self.u = m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def _nearest(left: _Side, right: _Side, k: int) -> pa.Table:
    """The k nearest rows of ``right`` for every row of ``left``, ties by id, tile by tile."""
    if len(right.ids) >> POSITION_BITS:
        raise ValueError("a block holds too many rows")
    none = np.iinfo(np.int64).max
    best = np.full((len(left.ids), k), none)
    named = right.ids[right.known]
    # where the subject itself stands among the candidates
    lo, hi = np.searchsorted(named, left.ids, "left"), np.searchsorted(named, left.ids, "right")
    hi[~left.known] = lo[~left.known]
    for i in range(0, len(left.ids), TILE):
        rows = slice(i, min(i + TILE, len(left.ids)))
        scaled = left.u[rows] / -DISTANCE_STEP
        for j in range(0, len(right.ids), TILE):
            cos = scaled @ right.u[j:j + TILE].T
            width = cos.shape[1]
            # (distance in steps, column) as one number below 2 ** 53
            key = np.rint(cos, out=cos)
            key *= TILE
            key += TILE / DISTANCE_STEP + np.arange(width)
            for r in np.flatnonzero((lo[rows] < j + width) & (hi[rows] > np.maximum(j, lo[rows]))):
                key[r, max(0, lo[i + r] - j):hi[i + r] - j] = np.inf
            if k < width:
                key = np.partition(key, k - 1, axis=1)[:, :k]
            found = np.isfinite(key)
            key = np.where(found, key, 0).astype(np.int64)
            key = np.where(found, (key // TILE << POSITION_BITS) + key % TILE + j, none)
            best[rows] = np.sort(np.concatenate([best[rows], key], axis=1), axis=1)[:, :k]
    subject, _ = np.nonzero(best != none)
    best = best[best != none]
    at = best & ((1 << POSITION_BITS) - 1)
    return pa.table({
        "subject_id": pa.array(left.ids[subject], mask=~left.known[subject]),
        "id": pa.array(right.ids[at], mask=~right.known[at]),
        "distance": (best >> POSITION_BITS) * DISTANCE_STEP,
    })


def _blocks(units: DataFrame, block_rows: int) -> Column:
    """The number of blocks of ``units`` as a scalar subquery (no join against a constant key)."""
    n = F.count(F.lit(1))
    few = F.least(F.lit(MIN_BLOCKS), F.ceil(n / F.lit(TILE)))
    return units.select(F.greatest(F.lit(1), F.ceil(n / F.lit(block_rows)), few).cast("int")).scalar()


def blocked_topk(units: DataFrame, k: int, group_col: str | None = None, block_rows: int = BLOCK_ROWS,
                 subjects: DataFrame | None = None) -> DataFrame:
    """Top-k candidates per subject among rows of the same group (all rows when
    ``group_col`` is None) as ``(subject_id, id, distance)``, possibly several per
    subject per group block; callers merge them.

    Each group is split into ``ceil(n_group / block_rows)`` hash blocks; pairs of blocks are
    reduced with a NumPy matmul, a tile at a time, to a local top-k. A pair of blocks is compared
    once for both, so that a row is copied once per block. Without groups, ``subjects`` (``id, u``
    as well) are the rows to search for, else every row is one; each side is then copied once per
    block of the other.
    """
    both = subjects is None
    at = F.col("at")

    def pair(left: Column, right: Column, side: Column) -> Column:
        return F.struct(left.alias("_l"), right.alias("_r"), side.alias("_side"))

    def placed(rows: DataFrame, others: Column, place) -> DataFrame:
        """A copy of every row per block ``0 .. others - 1`` it meets."""
        # by the whole row: null ids don't fill one block
        rows = rows.withColumn("_b", F.pmod(F.xxhash64("id", "u"), F.col("_nb")).cast("int"))
        meets = F.transform(F.sequence(F.lit(0), others - 1), place)
        return rows.withColumn("at", F.explode(meets)).select("_g", at["_l"].alias("_l"), at["_r"].alias("_r"), at["_side"].alias("_side"), "id", "u")

    if both:
        if group_col is None:
            rows = units.select("id", "u", F.lit(0).alias("_g"), _blocks(units, block_rows).alias("_nb"))
        else:
            u = units.select("id", "u", F.col(group_col).alias("_g")).filter("_g is not null")
            n = u.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows)
            # only the groups of several blocks; their number grows with the table, so the broadcast is checked
            n = broadcast_if_small(n.select("_g", F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_nb")))
            rows = u.join(n, "_g", "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
        b = F.col("_b")
        rows = placed(rows, F.col("_nb"), lambda o: pair(F.least(b, o), F.greatest(b, o), (b > o).cast("int")))
    else:
        nr, nl = _blocks(units, block_rows), _blocks(subjects, block_rows)
        left = subjects.select("id", "u", F.lit(0).alias("_g"), nl.alias("_nb"), nr.alias("_no"))
        right = units.select("id", "u", F.lit(0).alias("_g"), nr.alias("_nb"), nl.alias("_no"))
        rows = placed(left, F.col("_no"), lambda o: pair(F.col("_b"), o, F.lit(0))).unionByName(
            placed(right, F.col("_no"), lambda o: pair(o, F.col("_b"), F.lit(1))))

    def kernel(table: pa.Table) -> pa.Table:
        side = table.column("_side").to_numpy()
        left, right = _Side(table.filter(pa.array(side == 0))), _Side(table.filter(pa.array(side == 1)))
        if not both:
            return _nearest(left, right, k)
        if not len(right.ids):
            # a block and itself, or a block whose partner has no rows: that one meets itself elsewhere
            return _nearest(left, left if table.column("_l")[0] == table.column("_r")[0] else right, k)
        return pa.concat_tables([_nearest(left, right, k), _nearest(right, left, k)])

    return rows.groupBy("_g", "_l", "_r").applyInArrow(kernel, TOPK_SCHEMA)


def rank_topk(cands: DataFrame, k: int) -> DataFrame:
    """Keep the k best ``(distance, id)`` per subject; plans with a partial
    WindowGroupLimit before the shuffle."""
    w = Window.partitionBy("subject_id").orderBy("distance", "id")
    return cands.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(
        "similarity", similarity(F.col("distance"))
    )


def all_pairs_topk(vectors: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """V4: exact top-k neighbours of every row."""
    check_k(k)
    return rank_topk(blocked_topk(raw_vectors(vectors, id_col, vec_col), k, None, block_rows), k)


def topk_for(vectors: DataFrame, subject_ids: DataFrame, k: int = 5, id_col: str = "id", vec_col: str = "embedding",
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact top-k neighbours of the rows named in ``subject_ids`` (column ``id_col``), among
    all rows. Ids without a (non-zero) vector have no row in the result."""
    check_k(k)
    units = raw_vectors(vectors, id_col, vec_col)
    wanted = broadcast_if_small(subject_ids.select(F.col(id_col).cast("long").alias("id")).distinct())
    return rank_topk(blocked_topk(units, k, None, block_rows, units.join(wanted, "id", "left_semi")), k)


def hyperplanes(dim: int, n_tables: int, n_bits: int, seed: int) -> np.ndarray:
    """Sign-random (+1/-1) hyperplane normals, a parameter of the index, not data.

    Entry (table t, bit b, dimension i) is +1 when the first hex digit of
    md5("seed:t:b:i") is even, else -1; reproducible by any engine with md5.
    """
    out = np.empty((n_tables * n_bits, dim))
    for t in range(n_tables):
        for b in range(n_bits):
            for i in range(dim):
                h = hashlib.md5(f"{seed}:{t}:{b}:{i}".encode()).hexdigest()
                out[t * n_bits + b, i] = 1.0 if int(h[0], 16) % 2 == 0 else -1.0
    return out


SIGN_ROWS = 1024         # vectors whose signs a task holds at a time


def lsh_signatures(units: DataFrame, dim: int, n_tables: int = 6, n_bits: int = 8, seed: int = 17) -> DataFrame:
    """``(id, u, buckets)``: one row per vector, with its bucket in every hash table (sign bits packed)."""
    planes = hyperplanes(dim, n_tables, n_bits, seed)
    weights = (1 << np.arange(n_bits)).astype(np.int32)

    def sign_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SIGN_ROWS):
                rows = b.slice(i, SIGN_ROWS)
                bits = (_matrix(rows.column("u")) @ planes.T >= 0).reshape(rows.num_rows, n_tables, n_bits)
                codes = pa.array((bits @ weights).astype(np.int32).ravel())
                starts = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * n_tables)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("u"), pa.ListArray.from_arrays(starts, codes)], ["id", "u", "buckets"])

    element = units.schema["u"].dataType.elementType.simpleString()
    return units.select("id", "u").mapInArrow(sign_bits, f"id long, u array<{element}>, buckets array<int>")


def _by_table(signatures: DataFrame) -> DataFrame:
    """One row per vector and hash table. The rows are made on the JVM, a row at a time: a batch of
    them in Python would hold its vectors once per table."""
    return signatures.select("id", "u", F.posexplode("buckets").alias("table", "bucket")).withColumn("bucket", F.col("bucket").cast("long"))


def lsh_buckets(units: DataFrame, dim: int, n_tables: int = 6, n_bits: int = 8, seed: int = 17) -> DataFrame:
    """``(id, u, table, bucket)``: one row per vector and hash table (sign bits packed)."""
    return _by_table(lsh_signatures(units, dim, n_tables, n_bits, seed))


SAMPLE_SUBJECTS = 128    # subjects whose exact neighbours tell how far a neighbour is
TABLE_COST = 64          # what a row costs per table (hashing, shuffle), in candidates compared
MAX_BITS = 30


def subject_sample(units: DataFrame, n: int = SAMPLE_SUBJECTS) -> DataFrame:
    """At most ``n`` subjects, the first by md5 of their id."""
    return units.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)


def neighbour_angle(units: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> float | None:
    """Mean angle between the sampled subjects and their k-th neighbour among all rows; None
    when there are fewer than k others."""
    sample = materialize(subject_sample(units))
    exact = rank_topk(blocked_topk(units, k, None, block_rows, sample), k).filter(F.col("rank") == k)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), 1 - F.col("distance")))
    return exact.agg(F.avg(F.acos(cos))).first()[0]


def lsh_shape(n_rows: int, angle: float, recall: float = 0.9) -> tuple[int, int]:
    """(bits, tables) of the index with the least work whose expected recall at ``angle``
    reaches ``recall``.

    A sign bit of two vectors agrees with probability p = 1 - angle / pi, so T tables of b bits
    find a neighbour with probability 1 - (1 - p^b)^T; of far rows (p = 1/2) a table
    compares n / 2^b. The closer neighbours are, the more bits pay off."""
    p = min(1 - 1e-9, max(0.5, 1 - angle / math.pi))

    def tables(b: int) -> int:
        return math.ceil(math.log(1 - recall) / math.log(1 - p**b))

    return min(((b, tables(b)) for b in range(1, MAX_BITS + 1)), key=lambda x: (x[1] * (n_rows / 2 ** x[0] + TABLE_COST), x[0]))


def lsh_topk(vectors: DataFrame, k: int = 5, dim: int | None = None, id_col: str = "id", vec_col: str = "embedding",
             n_tables: int | None = None, n_bits: int | None = None, seed: int = 17, block_rows: int = BLOCK_ROWS,
             recall: float = 0.9) -> DataFrame:
    """V5: approximate top-k from candidates that share an LSH bucket in any table,
    re-ranked by exact cosine distance.

    ``dim`` is the vectors' length (read from the data when not given). Bits and tables, where not given, follow from the number of rows, the target ``recall`` and
    the angle of the k-th neighbours of a bounded sample of subjects, measured against all
    rows. On vectors without near neighbours the shape comes close to comparing all pairs: no
    other would reach the recall."""
    check_k(k)
    units = raw_vectors(vectors, id_col, vec_col)
    if n_bits is None or n_tables is None:
        units = materialize(units)
        angle = neighbour_angle(units, k, block_rows)
        shape = lsh_shape(units.count(), angle, recall) if angle is not None else (1, 8)
        n_bits, n_tables = n_bits or shape[0], n_tables or shape[1]
    if dim is None:
        first = units.select(F.size("u")).first()
        dim = first[0] if first else 1
    # the signature table is the index: materialised once, a row per vector, read for bucket sizes and pairs
    b = _by_table(materialize(lsh_signatures(units, dim, n_tables, n_bits, seed)))
    b = b.withColumn("_tb", F.col("table").cast("long") * F.lit(1 << n_bits) + F.col("bucket"))
    cands = blocked_topk(b, k, "_tb", block_rows)
    # the same candidate can come from several tables
    cands = cands.groupBy("subject_id", "id").agg(F.min("distance").alias("distance"))
    return rank_topk(cands, k)


def recall_at_k(approx: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """V6: mean over subjects of |approx top-k  intersect  exact top-k| / k."""
    # one read of either side: the exact neighbours are not searched twice
    hits = approx.select("subject_id", "id", F.lit(1).alias("_hit"))
    per = exact.select("subject_id", "id").join(hits, ["subject_id", "id"], "left").groupBy("subject_id").agg(F.count("_hit").alias("h"))
    return per.agg(
        (F.avg(F.coalesce("h", F.lit(0)) / F.lit(k))).alias("recall_at_k"), F.count(F.lit(1)).alias("subjects")
    )

