"""Training-pair preparation: load, check, weighted dataset draws, epoch shuffle, batch
packing, in-batch de-duplication, in-batch score matrices and the contrastive loss.

Everything is keyed by deterministic hashes (md5 of seed and position), so a run is
reproducible and the same numbers can be computed by any SQL engine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.embed import hashing_vector
from corpusflow.operators.ids import assign_ids


@dataclass(frozen=True)
class BatchSpec:
    batch_size: int = 4          # samples per device batch
    nprocs: int = 2              # devices
    datasets_per_batch: int = 2  # dataset draws per iteration
    seed: int = 42
    epoch: int = 0
    scale: float = 20.0          # similarity scale in the loss

    @property
    def num_same_dataset(self) -> int:
        global_batch = self.batch_size * self.nprocs
        if global_batch % self.datasets_per_batch:
            raise ValueError("batch_size * nprocs must be divisible by datasets_per_batch")
        return (global_batch // self.datasets_per_batch) // self.batch_size

    @property
    def samples_per_draw(self) -> int:
        return self.num_same_dataset * self.nprocs * self.batch_size


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform in [0, 1) from md5 of the parts joined by ':'."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_key(*parts: Column) -> Column:
    """Deterministic 60-bit sort key from md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def read_pair_lines(spark: SparkSession, paths: list[str], by_folder: bool = False) -> DataFrame:
    """``(dataset, line)`` from gzipped or plain JSON-lines files; dataset = file stem, or with
    ``by_folder`` the name of the file's folder (after a ``=`` if it has one). Plain files are split
    by Spark; a gzipped file is one task, so a large corpus should land as many of them."""
    df = spark.read.text(paths).withColumnRenamed("value", "line")
    stem, folder = r"([^/]+?)(\.jsonl?)?(\.gz)?$", r"([^/=]+)/[^/]+$"
    return df.select(F.regexp_extract(F.input_file_name(), folder if by_folder else stem, 1).alias("dataset"), "line")


def _texts(reddit_datasets: tuple[str, ...]) -> Column:
    as_list = F.from_json("line", "array<string>")
    as_dict = F.from_json("line", "struct<texts: array<string>>")["texts"]
    red = F.from_json("line", "struct<response: string, context: string>")
    red_arr = F.when(red["response"].isNotNull() & red["context"].isNotNull(), F.array(red["response"], red["context"]))
    is_reddit = F.col("dataset").isin(*reddit_datasets) if reddit_datasets else F.lit(False)
    return F.when(is_reddit, red_arr).otherwise(F.coalesce(as_list, as_dict))


def parse_pairs(lines: DataFrame, reddit_datasets: tuple[str, ...] = ()) -> DataFrame:
    """A JSON list, ``{"texts": [...]}``, or (reddit) ``{"response", "context"}``
    -> ``texts array<string>``; reddit rows need both keys and become [response, context].
    Lines that are none of these are left out: :func:`split_pairs` reports them."""
    return lines.select("*", _texts(reddit_datasets).alias("texts")).drop("line").filter(F.col("texts").isNotNull())


def split_pairs(lines: DataFrame, reddit_datasets: tuple[str, ...] = ()) -> DataFrame:
    """S9/P11 with nothing lost: every line with ``texts`` or with a ``reject_reason``.

    ``empty`` (null or white space), ``not_json``, ``missing_key`` (an object without the keys of
    its dataset's format, which the reference passes over for reddit and fails on elsewhere),
    ``no_texts`` (another JSON value, or an empty list) and ``null_text`` (a null among the texts)."""
    texts = F.col("texts")
    value = F.try_parse_json("line")
    reason = (
        F.when(F.col("line").isNull() | ~F.col("line").rlike(r"\S"), "empty").when(value.isNull(), "not_json")
        .when(texts.isNull() & F.schema_of_variant(value).startswith("OBJECT"), "missing_key")
        .when(texts.isNull() | (F.size(texts) == 0), "no_texts").when(F.exists(texts, lambda t: t.isNull()), "null_text"))
    out = lines.withColumn("texts", _texts(reddit_datasets)).withColumn("reject_reason", reason)
    return out.withColumn("texts", F.when(F.col("reject_reason").isNull(), texts))


def arity(pairs: DataFrame) -> DataFrame:
    """Rows per dataset and their width; a dataset must be all pairs or all triplets."""
    return pairs.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(F.size("texts")).alias("min_cols"),
        F.max(F.size("texts")).alias("max_cols"),
    ).withColumn("consistent", F.col("min_cols") == F.col("max_cols"))


def check_arity(pairs: DataFrame) -> DataFrame:
    """A7 as a contract: ``pairs``, or an error that names the datasets whose rows are not all
    pairs or all triplets (a few names; datasets are configuration)."""
    widths = arity(pairs)
    bad = widths.filter(~F.col("consistent") | ~F.col("max_cols").isin(2, 3)).select("dataset").orderBy("dataset").collect()
    if bad:
        raise ValueError(f"datasets of mixed or unsupported width: {', '.join(str(r['dataset']) for r in bad)}")
    return pairs


def epoch_order(pairs: DataFrame, spec: BatchSpec, key_col: str = "pair_id") -> DataFrame:
    """Per-dataset stream position ``r`` (0-based) of the epoch's shuffle."""
    return assign_ids(pairs, hash_key(F.lit(spec.seed), F.lit(spec.epoch), F.col(key_col)), -1, "r",
                      partition_col="dataset")


def weighted_draws(spark: SparkSession, pairs: DataFrame, weights: tuple[tuple[str, int], ...], spec: BatchSpec) -> DataFrame:
    """``(batch_id, draw, dataset, width)``. Draw 0 of an iteration picks a dataset
    with probability proportional to its weight (uniform over the repeated index list);
    later draws pick among datasets of the same width, which equals the reference's
    redraw-until-same-format loop."""
    names = [n for n, _ in weights]
    # one row per configured dataset
    widths = {r["dataset"]: r["max_cols"] for r in arity(pairs.filter(F.col("dataset").isin(names))).collect()}
    # the manifest as given, less the datasets without rows: their draws go to the others
    entries = [(n, w) for n, w in weights if n in widths]
    if not entries:
        return spark.createDataFrame([], "batch_id long, draw int, dataset string, width int")

    def pick(u: Column, among: list[tuple[str, int]]) -> Column:
        """The dataset whose interval of the repeated index list holds floor(u * sum of weights)."""
        idx, end, out = F.floor(u * F.lit(sum(w for _, w in among))), 0, []
        for name, w in among:
            end += w
            out.append(F.when(idx < end, F.lit(name)))
        return F.coalesce(*out)

    def u(draw: Column) -> Column:
        return hash_uniform(F.lit(spec.seed), F.col("batch_id"), draw)

    width_of = F.create_map(*[F.lit(x) for n, _ in entries for x in (n, widths[n])])
    total = pairs.count()
    n_iter = max(1, -(-total // (spec.datasets_per_batch * spec.samples_per_draw)))
    draws = spark.range(n_iter * spec.datasets_per_batch).select(
        (F.col("id") / spec.datasets_per_batch).cast("long").alias("batch_id"),
        (F.col("id") % spec.datasets_per_batch).cast("int").alias("draw"),
    )
    # the first draw fixes the width; its hash is computed anew for every draw, so nothing is joined
    draws = draws.withColumn("width", F.element_at(width_of, pick(u(F.lit(0)), entries)))
    same = [F.when(F.col("width") == k, pick(u(F.col("draw")), [e for e in entries if widths[e[0]] == k])) for k in sorted(set(widths.values()))]
    dataset = F.when(F.col("draw") == 0, pick(u(F.lit(0)), entries)).otherwise(F.coalesce(*same))
    return draws.select("batch_id", "draw", dataset.alias("dataset"), "width")


def pack_batches(ordered: DataFrame, draws: DataFrame, spec: BatchSpec) -> DataFrame:
    """The q-th draw of a dataset takes stream rows [q*S, (q+1)*S) (wrapping into the
    next pass), split into device batches. Returns
    ``(batch_id, draw, chunk, slot, dataset, pair_id, texts)``."""
    s = spec.samples_per_draw
    q = assign_ids(draws, F.col("batch_id") * F.lit(spec.datasets_per_batch) + F.col("draw"), -1, "q",
                   partition_col="dataset")
    sizes = ordered.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_ds"))
    slots = q.join(F.broadcast(sizes), "dataset").select(
        "batch_id", "draw", "dataset", "n_ds", "q", F.explode(F.sequence(F.lit(0), F.lit(s - 1))).alias("j")
    )
    slots = slots.withColumn("r", F.pmod(F.col("q") * F.lit(s) + F.col("j"), F.col("n_ds")))
    packed = slots.join(ordered, ["dataset", "r"])
    return packed.select(
        "batch_id", "draw", (F.col("j") / spec.batch_size).cast("int").alias("chunk"),
        (F.col("j") % spec.batch_size).cast("int").alias("slot"), "dataset", "pair_id", "texts",
    )


def dedupe_batches(packed: DataFrame, spec: BatchSpec) -> DataFrame:
    """Within an iteration, a sample is dropped unless it is the first holder of each
    of its texts (first = lowest draw, chunk, slot). This is stricter than the reference's
    greedy scan (a dropped sample still claims its texts); survivors are re-numbered."""
    s = spec.samples_per_draw
    pos = F.col("draw") * F.lit(s) + F.col("chunk") * F.lit(spec.batch_size) + F.col("slot")
    p = packed.withColumn("pos", pos)
    owners = p.select("batch_id", "pos", F.explode(F.array_distinct("texts")).alias("t")).groupBy("batch_id", "t").agg(
        F.min("pos").alias("owner")
    )
    lost = p.select("batch_id", "pos", F.explode(F.array_distinct("texts")).alias("t")).join(owners, ["batch_id", "t"]).filter(
        F.col("owner") != F.col("pos")
    ).select("batch_id", "pos").distinct()
    keep = p.join(lost, ["batch_id", "pos"], "left_anti")
    # an iteration holds datasets_per_batch * S samples: a bounded window
    w = Window.partitionBy("batch_id").orderBy("pos")
    return keep.withColumn("new_pos", (F.row_number().over(w) - 1).cast("int")).drop("pos")


def shard_slices(ordered: DataFrame, draws: DataFrame, spec: BatchSpec, shard_iterations: int) -> DataFrame:
    """``(shard, dataset, lo, n, n_ds)``: the ``n`` stream rows from ``lo`` on (modulo the ``n_ds`` rows
    of the dataset) that a shard reads, over and over. Slices follow each other in the epoch's order
    and are as long as the shard's share of the dataset's draws, but never shorter than the shard's
    need, as far as the dataset has rows."""
    need = draws.groupBy((F.col("batch_id") / shard_iterations).cast("long").alias("shard"), "dataset").agg(
        F.count(F.lit(1)).alias("need"))
    # one row per shard and dataset: far fewer than samples
    before = Window.partitionBy("dataset").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ordered.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_ds"))
    s = need.withColumn("before", F.coalesce(F.sum("need").over(before), F.lit(0))).withColumn(
        "all", F.sum("need").over(Window.partitionBy("dataset"))).join(sizes, "dataset")
    cut = lambda x: F.floor(F.col("n_ds") * x / F.col("all"))
    share = cut(F.col("before") + F.col("need")) - cut(F.col("before"))
    least = F.least("n_ds", F.col("need") * spec.samples_per_draw)
    return s.select("shard", "dataset", cut(F.col("before")).alias("lo"), F.greatest(share, least).alias("n"), "n_ds")


def refill_shard(draws: list[tuple[int, int, str]], streams: dict[str, list[tuple]], per_draw: int) -> list[tuple]:
    """The reference's scan for the iterations of one shard: every draw takes samples from where its
    dataset's stream stands until it has ``per_draw`` of them; one that shares a text with a sample
    taken before in the iteration is passed over and claims nothing. ``streams`` holds the samples'
    text keys. Rows (batch_id, draw, j, dataset, i). A draw that finds no sample in a whole pass
    over its stream stays short, where the reference would look for ever."""
    at = dict.fromkeys(streams, 0)
    out, current, taken = [], None, set()
    for batch_id, draw, dataset in draws:
        if batch_id != current:
            current, taken = batch_id, set()
        stream = streams.get(dataset, [])
        j = passed = 0
        while j < per_draw and passed < len(stream):
            i = at[dataset] % len(stream)
            at[dataset] += 1
            if taken.isdisjoint(stream[i]):
                taken.update(stream[i])
                out.append((batch_id, draw, j, dataset, i))
                j, passed = j + 1, 0
            else:
                passed += 1
    return out


def greedy_batches(ordered: DataFrame, draws: DataFrame, spec: BatchSpec, shard_iterations: int = 256) -> DataFrame:
    """D4/D5 by the reference's greedy scan: device batches in which no text occurs twice in one
    iteration, every skipped sample being replaced by the next of its dataset's stream. Same columns
    as :func:`pack_batches`.

    Where a draw starts depends on what all earlier draws of its dataset skipped. So the iterations
    are dealt to shards of ``shard_iterations``, each with its own slice of every dataset's epoch
    order; within a shard the scan is sequential, over text keys only (16 bytes a text), and shards
    run in parallel. With one shard it is the reference's single producer."""
    slices = shard_slices(ordered, draws, spec, shard_iterations)
    rows = slices.select("shard", "dataset", "n_ds", "lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    rows = rows.withColumn("r", F.pmod(F.col("lo") + F.col("i"), F.col("n_ds"))).select("shard", "dataset", "i", "r")
    keys = ordered.select("dataset", "r", F.transform(F.array_distinct("texts"), lambda t: F.unhex(F.md5(t.cast("binary")))).alias("keys"))
    # names of their own: the two sides of the cogroup come from the same frames
    streams = rows.join(keys, ["dataset", "r"]).select(*[F.col(c).alias(f"s_{c}") for c in ("shard", "dataset", "i", "r", "keys")])
    per_draw = spec.samples_per_draw

    def scan(key: tuple, d: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["batch_id", "draw"])
        s = s.sort_values(["s_dataset", "s_i"])
        by_dataset = {name: [tuple(k) for k in g["s_keys"]] for name, g in s.groupby("s_dataset")}
        place = {(name, i): r for name, i, r in zip(s["s_dataset"], s["s_i"], s["s_r"])}
        got = refill_shard(list(zip(d["batch_id"], d["draw"], d["d_dataset"])), by_dataset, per_draw)
        return pd.DataFrame([(b, w, j, n, place[n, i]) for b, w, j, n, i in got], columns=["batch_id", "draw", "j", "dataset", "r"])

    shard = draws.select((F.col("batch_id") / shard_iterations).cast("long").alias("shard"), "batch_id", "draw", F.col("dataset").alias("d_dataset"))
    taken = shard.groupBy("shard").cogroup(streams.groupBy("s_shard")).applyInPandas(
        scan, "batch_id long, draw int, j int, dataset string, r long")
    return taken.join(ordered, ["dataset", "r"]).select(
        "batch_id", "draw", (F.col("j") / spec.batch_size).cast("int").alias("chunk"),
        (F.col("j") % spec.batch_size).cast("int").alias("slot"), "dataset", "pair_id", "texts")


def step_key(spec: BatchSpec) -> Column:
    """One training step gathers ``nprocs`` consecutive device batches of one draw."""
    return (F.col("chunk") / spec.nprocs).cast("int")


def _steps(packed: DataFrame, spec: BatchSpec, dim: int) -> DataFrame:
    """Anchor, positive and negative vectors of every sample with its place ``i`` in its step."""
    rows = packed.withColumn("step", step_key(spec)).withColumn(
        "i", ((F.col("chunk") % spec.nprocs) * spec.batch_size + F.col("slot")).cast("int")
    )
    return rows.select(
        "batch_id", "draw", "step", "i", F.size("texts").alias("width"),
        hashing_vector(F.get("texts", 0), dim).alias("a"),
        hashing_vector(F.get("texts", 1), dim).alias("p"),
        F.when(F.size("texts") > 2, hashing_vector(F.get("texts", 2), dim)).alias("n"),
    )


def _step_scores(step: pd.DataFrame, spec: BatchSpec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors i, candidates j, scores) of one step: positives first, then the negatives there are."""
    step = step.sort_values("i", kind="stable")
    i, neg = step["i"].to_numpy(), step["n"].notna().to_numpy()
    a, p = np.stack(step["a"]).astype(np.float64), np.stack(step["p"]).astype(np.float64)
    c = np.vstack([p, np.stack(step["n"][neg]).astype(np.float64)]) if neg.any() else p
    return i, np.concatenate([i, spec.nprocs * spec.batch_size + i[neg]]), spec.scale * (a @ c.T)


def inbatch_scores(packed: DataFrame, spec: BatchSpec, dim: int = 64) -> DataFrame:
    """``scale * cos(anchor_i, candidate_j)`` for every anchor and every positive (and
    negative) of the same step: one matmul per step of at most ``nprocs * batch_size`` samples.
    The scores are the result here; ``inbatch_loss`` never emits them."""

    def scores(key: tuple, step: pd.DataFrame) -> pd.DataFrame:
        i, j, m = _step_scores(step, spec)
        return pd.DataFrame({"batch_id": key[0], "draw": key[1], "step": key[2], "i": np.repeat(i, len(j)),
                             "j": np.tile(j, len(i)), "score": m.ravel()})

    return _steps(packed, spec, dim).groupBy("batch_id", "draw", "step").applyInPandas(
        scores, "batch_id long, draw int, step int, i int, j int, score double")


def _log_sum_exp(m: np.ndarray, axis: int) -> np.ndarray:
    """The maximum is taken out first, so that no scale overflows."""
    top = m.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(m - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def inbatch_loss(packed: DataFrame, spec: BatchSpec, dim: int = 64) -> DataFrame:
    """Cross-entropy of a step's scores with the own positive as label. Pairs: mean of the
    row-wise and the column-wise loss (symmetric); triplets: row-wise only. One row per step,
    which one task computes from at most ``nprocs * batch_size`` samples."""

    def loss(key: tuple, step: pd.DataFrame) -> pd.DataFrame:
        i, _, m = _step_scores(step, spec)
        own = np.diagonal(m)
        value = float(np.mean(_log_sum_exp(m, 1) - own))
        if step["width"].max() == 2:
            value = (value + float(np.mean(_log_sum_exp(m[:, :len(i)], 0) - own))) / 2
        return pd.DataFrame({"batch_id": [key[0]], "draw": [key[1]], "step": [key[2]], "loss": [value]})

    return _steps(packed, spec, dim).groupBy("batch_id", "draw", "step").applyInPandas(
        loss, "batch_id long, draw int, step int, loss double")
