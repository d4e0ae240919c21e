"""Cross-entropy difference of two n-gram models that share one vocabulary.

Target (texts labelled as good) and background (all texts) are bigram models of the same
form over the same vocabulary: Dirichlet-smoothed bigrams over add-one unigrams,
p(w | u) = (c(u, w) + K p(w)) / (c(u) + K). Every distinct word, context and bigram of the
corpus is counted under a key of its own (a 61-bit hash), so the model grows with the input.
A text's score is the mean over its tokens of -ln p_target + ln p_background: below zero the
text is nearer to the target.

Texts are dealt into blocks of bounded length. A block sends its distinct keys with their
counts, cut by key range into shards; a shard adds them up and sends each block what the
other blocks counted for its keys. A very common word is thus one entry per block. No
model is ever in one place, and nothing of it passes through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import broadcast_bounded, stored

STRENGTH = 50.0         # K above
CACHE = 400_000         # words whose hash a task remembers
BLOCK_CHARS = 6_000_000  # characters of a block's texts, about
SHARDS = 256            # least number of key ranges; with many blocks there is one for every two
WORD, CONTEXT, PAIR = 0, 1, 2   # kinds of keys
PART = "block int, shard int, keys binary, background binary, target binary"
OTHERS = "block int, shard int, at binary, background binary, target binary, n_words long, n_background long, n_target long"


class Hashes:
    """64-bit hashes of a text's words, behind a bounded cache."""

    def __init__(self):
        self._seen = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        from xxhash import xxh64_intdigest

        ws = text.lower().split() if text else []
        seen = self._seen
        if len(seen) > CACHE:
            seen.clear()
        for w in set(ws).difference(seen):
            seen[w] = xxh64_intdigest(w, 0)
        return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_keys(texts: pa.ChunkedArray, hashes: Hashes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(tokens per text, the keys of all tokens by kind); a text's first word follows the start."""
    each = [hashes(t) for t in texts.cast(pa.binary()).to_pylist()]
    n = np.fromiter(map(len, each), np.int64, len(each))
    w = np.concatenate(each) if each else np.zeros(0, np.uint64)
    before = np.zeros_like(w)
    before[1:] = w[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = 0
    left = mixed(before + np.uint64(0x9E3779B97F4A7C15))
    kinds = (mixed(w), left, mixed(left * np.uint64(3) + w))
    return n, [(h & ~np.uint64(7)) >> np.uint64(1) | np.uint64(kind) for kind, h in enumerate(kinds)]


def block_counts(texts: pa.ChunkedArray, good: np.ndarray, hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's sorted distinct keys with their counts in all its texts and in its target texts."""
    n, kinds = token_keys(texts, hashes)
    in_target = np.repeat(good, n).astype(np.uint64)
    every = np.sort(np.concatenate([k << np.uint64(1) | in_target for k in kinds]))
    keys = every >> np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    target = np.add.reduceat((every & np.uint64(1)).astype(np.int64), first) if len(first) else first
    return keys[first], np.diff(np.append(first, len(keys))), target


def cut(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the shards' ranges begin and end in sorted keys (63 bits)."""
    step = (1 << 63) // shards
    inner = np.searchsorted(keys, np.arange(1, shards, dtype=np.uint64) * np.uint64(step))
    return np.concatenate(([0], inner, [len(keys)]))


def blobs(values: list[np.ndarray], rising: bool = False) -> pa.Array:
    """Each array as compressed bytes: (differences of rising) values, plane of bytes by plane."""
    out = []
    for v in values:
        v = np.diff(v, prepend=v.dtype.type(0)) if rising else v
        planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), v.itemsize).T)
        out.append(len(v).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(v) else b"")
    return pa.array(out, pa.binary())


def unpacked(column: pa.ChunkedArray, kind: type, rising: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, values per row) of a column of blobs."""
    size, rows = np.dtype(kind).itemsize, []
    for x in column.to_pylist():
        n = int.from_bytes(x[:4], "little")
        v = np.zeros(0, kind)
        if n:
            planes = np.frombuffer(pa.decompress(x[4:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
            v = np.ascontiguousarray(planes.T).view(kind)[:, 0]
        rows.append(np.cumsum(v, dtype=kind) if rising else v)
    return np.concatenate(rows) if rows else np.zeros(0, kind), np.fromiter(map(len, rows), np.int64, len(rows))


def shard_others(rows: pa.Table) -> pa.Table:
    """For each block of a shard: the positions of its keys that other blocks hold too, with the
    others' counts, and the shard's distinct words and tokens (the same in every row)."""
    keys, n = unpacked(rows["keys"], np.uint64, True)
    counts = [unpacked(rows[c], np.uint32)[0].astype(np.int64) for c in ("background", "target")]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(keys) else np.zeros(0, bool)
    group = np.empty(len(keys), np.int64)
    group[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    sums = [np.add.reduceat(c[order], first) if len(first) else c for c in counts]
    words = ranked[first] & np.uint64(3) == WORD
    shared = np.diff(np.append(first, len(keys)))[group] > 1
    begin = np.cumsum(n) - n
    kept = [np.flatnonzero(shared[b:b + m]) for b, m in zip(begin, n)]
    others = [[(s[group[b + k]] - c[b + k]).astype(np.uint64) for b, k in zip(begin, kept)] for s, c in zip(sums, counts)]
    scalars = [int(words.sum()), *(int(s[words].sum()) for s in sums)]
    return pa.table([rows["block"], rows["shard"], blobs([k.astype(np.uint32) for k in kept], True), blobs(others[0]), blobs(others[1]),
                     *[pa.array([x] * len(n), pa.int64()) for x in scalars]],
                    ["block", "shard", "at", "background", "target", "n_words", "n_background", "n_target"])


def block_losses(texts: pa.ChunkedArray, good: np.ndarray, rows: pa.Table, shards: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """(tokens, target loss, background loss) of a block's texts: mean loss per token, 0 for an
    empty text. A text's own counts are taken out of every model that holds it, so none is
    scored by itself."""
    n, kinds = token_keys(texts, hashes)
    text_of = np.repeat(np.arange(len(n)), n)
    every = np.concatenate(kinds)
    order = np.argsort(every, kind="stable")               # a key's tokens stay in the texts' order
    ranked, texts_ranked = every[order], np.tile(text_of, len(kinds))[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1])) if len(every) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    keys = ranked[first]
    place = np.empty(len(every), np.int64)
    place[order] = np.cumsum(new) - 1
    run = np.flatnonzero(new | np.concatenate(([True], texts_ranked[1:] != texts_ranked[:-1]))) if len(every) else first
    times = np.diff(np.append(run, len(every)))
    own = np.empty(len(every), np.int64)
    own[order] = np.repeat(times, times)
    place, own = place.reshape(len(kinds), -1), own.reshape(len(kinds), -1)

    ends = cut(keys, shards)
    at, n_at = unpacked(rows["at"], np.uint32, True)
    at = at + np.repeat(ends[rows["shard"].to_numpy()], n_at)
    vocabulary = int(rows["n_words"].to_numpy().sum()) + 1         # the corpus's distinct words, and one for all others
    losses = []
    for name, held in (("target", good), ("background", np.ones(len(n), bool))):
        mine = np.repeat(held, n).astype(np.int64)
        counted = np.add.reduceat(held[texts_ranked].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        counted[at] += unpacked(rows[name], np.uint64)[0].astype(np.int64)
        total = int(rows["n_" + name].to_numpy().sum())
        uni = (counted[place[WORD]] - own[WORD] * mine + 1.0) / (np.repeat(total - held * n, n) + vocabulary)
        seen = counted[place[PAIR]] - own[PAIR] * mine
        over = counted[place[CONTEXT]] - own[CONTEXT] * mine
        each = -np.log((seen + STRENGTH * uni) / (over + STRENGTH))
        losses.append(np.bincount(text_of, each, len(n)) / np.maximum(n, 1))
    return n, losses[0], losses[1]


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, target_loss, background_loss, difference.

    ``targets`` holds the ids of target texts (repeats and nulls ignored). Null and empty
    texts have no tokens and score 0. Repeated rows count as often as they occur. Other
    columns are not read. Without any target text both models still share the vocabulary and
    the target model is uniform.
    """
    spark = docs.sparkSession
    good = stored(targets.select(F.col(id_col).alias("gid")).filter("gid is not null").distinct())
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chars = slim.agg(F.sum(F.char_length("text").cast("long"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // BLOCK_CHARS))
    shards = max(SHARDS, 1 << (blocks // 2).bit_length())
    marked = slim.join(broadcast_bounded(good), F.col("id") == F.col("gid"), "left").select(
        "id", "text", F.col("gid").isNotNull().alias("is_target"),
        F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("block"))
    hashes = Hashes()

    def flags(rows: pa.Table) -> np.ndarray:
        return rows["is_target"].to_numpy().astype(bool)

    def count(rows: pa.Table) -> pa.Table:
        found = block_counts(rows["text"], flags(rows), hashes)
        ends = cut(found[0], shards)
        parts = [blobs(np.split(x.astype(t), ends[1:-1]), r)
                 for x, t, r in zip(found, (np.uint64, np.uint32, np.uint32), (True, False, False))]
        return pa.table([pa.array([rows["block"][0].as_py()] * shards, pa.int32()), pa.array(range(shards), pa.int32()), *parts],
                        ["block", "shard", "keys", "background", "target"])

    def score(rows: pa.Table, others: pa.Table) -> pa.Table:
        n, target, background = block_losses(rows["text"], flags(rows), others, shards, hashes)
        return pa.table([rows["id"], pa.array(n), pa.array(target), pa.array(background)],
                        ["id", "n_tokens", "target_loss", "background_loss"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    # the texts' shuffle is the same for both readers, so Spark does it once
    others = marked.groupBy("block").applyInArrow(count, PART).groupBy("shard").applyInArrow(shard_others, OTHERS)
    scored = marked.groupBy("block").cogroup(others.groupBy("block")).applyInArrow(
        score, f"id {kind}, n_tokens long, target_loss double, background_loss double")
    return scored.select(F.col("id").alias(id_col), "n_tokens", "target_loss", "background_loss",
                         (F.col("target_loss") - F.col("background_loss")).alias("difference"))
