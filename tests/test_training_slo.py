import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from corpusflow.operators import slo as SLO
from corpusflow.operators import training as TR
from corpusflow.plans import q_training as QT
from corpusflow.sources import fixtures as FX


def test_parse_three_formats(spark):
    lines = spark.createDataFrame([
        ("d1", '["a", "b"]'), ("d2", '{"texts": ["a", "b", "c"]}'), ("reddit_x", '{"response": "r", "context": "c"}'),
        ("reddit_x", '{"response": "r"}')], "dataset string, line string")
    got = [(r.dataset, list(r.texts)) for r in TR.parse_pairs(lines, ("reddit_x",)).collect()]
    assert got == [("d1", ["a", "b"]), ("d2", ["a", "b", "c"]), ("reddit_x", ["r", "c"])]


def test_read_pair_files(spark, scratch):
    import gzip

    with gzip.open(f"{scratch}/ds_a.jsonl.gz", "wt") as f:
        f.write('["x", "y"]\n["z", "w"]\n')
    df = TR.read_pair_lines(spark, [f"{scratch}/ds_a.jsonl.gz"])
    got = TR.parse_pairs(df).collect()
    assert {r.dataset for r in got} == {"ds_a"} and len(got) == 2


def test_arity_and_weighted_draws(spark):
    pairs = QT.loaded(spark, SF_SMALL)
    a = {r.dataset: r for r in TR.arity(pairs).collect()}
    assert all(r.consistent for r in a.values()) and a["conv2"].max_cols == 3
    spec = TR.BatchSpec(batch_size=2, nprocs=2, datasets_per_batch=2)
    draws = TR.weighted_draws(spark, pairs, FX.PAIR_WEIGHTS, spec).collect()
    by_batch = {}
    for d in draws:
        by_batch.setdefault(d.batch_id, []).append(d)
    # all draws of an iteration have the width of its first draw
    assert all(len({d.width for d in v}) == 1 for v in by_batch.values())


def test_batch_dedupe_keeps_first_holder(spark):
    spec = TR.BatchSpec(batch_size=2, nprocs=1, datasets_per_batch=1)
    packed = spark.createDataFrame(
        [(0, 0, 0, 0, "d", 1, ["a", "b"]), (0, 0, 0, 1, "d", 2, ["b", "c"]), (0, 0, 1, 0, "d", 3, ["d", "e"])],
        "batch_id long, draw int, chunk int, slot int, dataset string, pair_id long, texts array<string>")
    got = [(r.pair_id, r.new_pos) for r in TR.dedupe_batches(packed, spec).orderBy("new_pos").collect()]
    assert got == [(1, 0), (3, 1)]


def test_loss_matches_numpy(spark):
    d = QT.undoubled(spark, SF_SMALL)
    scores = TR.inbatch_scores(d, QT.SPEC)
    widths = d.groupBy("batch_id", "draw", TR.step_key(QT.SPEC).alias("step")).agg(F.max(F.size("texts")).alias("width"))
    loss = {(r.batch_id, r.draw, r.step): r.loss for r in TR.inbatch_loss(d, QT.SPEC).collect()}
    w = {(r.batch_id, r.draw, r.step): r.width for r in widths.collect()}
    mats = {}
    for r in scores.collect():
        mats.setdefault((r.batch_id, r.draw, r.step), {})[(r.i, r.j)] = r.score
    for key, cells in list(mats.items())[:5]:
        anchors = sorted({i for i, _ in cells})
        cols = sorted({j for _, j in cells})
        assert len(cells) == len(anchors) * len(cols)
        m = np.array([[cells[(i, j)] for j in cols] for i in anchors])
        lse_r = np.log(np.exp(m).sum(axis=1))
        diag = np.array([cells[(i, i)] for i in anchors])
        row = float(np.mean(lse_r - diag))
        if w[key] == 2:
            lse_c = np.log(np.exp(m).sum(axis=0))
            exp = (row + float(np.mean(lse_c - diag))) / 2
        else:
            exp = row
        assert math.isclose(loss[key], exp, rel_tol=1e-9)


def test_loss_of_a_large_scale_does_not_overflow(spark):
    spec = TR.BatchSpec(batch_size=2, nprocs=1, scale=5000.0)
    packed = spark.createDataFrame(
        [(0, 0, 0, 0, "d", 1, ["red fox", "red fox"]), (0, 0, 0, 1, "d", 2, ["blue sky", "blue sky"])],
        "batch_id long, draw int, chunk int, slot int, dataset string, pair_id long, texts array<string>")
    loss = TR.inbatch_loss(packed, spec).first().loss
    assert math.isfinite(loss) and abs(loss) < 1e-6


def test_mixed_widths_fail(spark):
    pairs = spark.createDataFrame([("a", ["x", "y"]), ("a", ["x", "y", "z"]), ("b", ["x", "y"])], "dataset string, texts array<string>")
    with pytest.raises(ValueError, match=": a$"):
        TR.check_arity(pairs)
    assert TR.check_arity(pairs.filter("dataset = 'b'")).count() == 1


@pytest.mark.parametrize("n", [1, 2, 3, 10, 21, 1000, 30_000])
def test_percentile_bracket_holds_both_ranks(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.lognormal(3, 1, n), 3)
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("only nulls", None)], "g string, v double")
    got = {r.g: r for r in SLO.exact_percentile(df, "g", "v", 0.95).collect()}
    assert got["a"].n == n + 1 and math.isclose(got["a"].p, np.quantile(values, 0.95), rel_tol=1e-12)
    assert got["only nulls"].p is None
    if n == 30_000:   # the exact pass keeps the values near the rank only
        assert SLO.bracketed(df, "g", "v", 0.95)[1].count() < n / 100


def test_exact_percentile_skewed(spark):
    rng = np.random.default_rng(3)
    hot = rng.exponential(100, 5000)  # one group holds most rows
    rows = [("hot", float(x)) for x in hot] + [("a", float(x)) for x in rng.normal(50, 5, 37)] + [("one", 7.0)]
    df = spark.createDataFrame(rows, "operation string, latency_ms double")
    got = {r.operation: r.p for r in SLO.exact_percentile(df, "operation", "latency_ms", 0.95).collect()}
    for g in ("hot", "a", "one"):
        vals = np.array([v for k, v in rows if k == g])
        assert math.isclose(got[g], float(np.percentile(vals, 95)), rel_tol=1e-12)
    ref = df.groupBy("operation").agg(F.percentile("latency_ms", 0.95).alias("p")).collect()
    assert all(math.isclose(got[r.operation], r.p, rel_tol=1e-12) for r in ref)


def one_producer(streams, draws, per_draw):
    """Samples (batch_id, draw, j, pair) of endless streams, as the rule reads."""
    at, out, seen, now = {d: 0 for d in streams}, [], set(), None
    for batch, draw, d in draws:
        if batch != now:
            now, seen = batch, set()
        got, looked = 0, 0
        while got < per_draw and looked < len(streams[d]):
            pair, texts = streams[d][at[d] % len(streams[d])]
            at[d] += 1
            looked += 1
            if not any(t in seen for t in texts):
                seen.update(texts)
                out.append((batch, draw, got, pair))
                got, looked = got + 1, 0
    return out


@pytest.mark.parametrize("shards", [1, 3])
def test_greedy_refill_equals_one_producer(spark, shards):
    import random

    r = random.Random(shards)
    spec = TR.BatchSpec(batch_size=3, nprocs=2, datasets_per_batch=2)
    sizes = {"a": 50, "b": 23, "c": 9}
    rows = [(d, i, 1000 * n + i, [f"t{r.randrange(60)}" for _ in range(2)]) for n, (d, k) in enumerate(sizes.items()) for i in range(k)]
    rows[3] = ("a", 3, 3, ["same", "same"])
    ordered = spark.createDataFrame(rows, "dataset string, r long, pair_id long, texts array<string>").repartition(5)
    draws = [(b, w, r.choice("aaabbc")) for b in range(12) for w in range(2)]
    df = spark.createDataFrame(draws, "batch_id long, draw int, dataset string").repartition(4)
    per_shard = -(-12 // shards)
    got = TR.greedy_batches(ordered, df, spec, per_shard).collect()
    slices = {(x.shard, x.dataset): x for x in TR.shard_slices(ordered, df, spec, per_shard).collect()}
    want = []
    for k in range(shards):
        mine = [d for d in draws if d[0] // per_shard == k]
        streams = {d: [next((p, t) for e, i, p, t in rows if e == d and i == (s.lo + j) % s.n_ds) for j in range(s.n)]
                   for d in {m[2] for m in mine} for s in [slices[k, d]]}
        if shards == 1:
            assert all(s.lo == 0 and s.n == sizes[s.dataset] for s in slices.values())      # the whole dataset
        want += one_producer(streams, mine, spec.samples_per_draw)
    assert sorted((x.batch_id, x.draw, x.chunk * 3 + x.slot, x.pair_id) for x in got) == sorted(want)


def test_refilled_iterations_are_full_and_without_repeats(spark):
    got = QT.refilled(spark, SF_MID).collect()
    by = {}
    for x in got:
        by.setdefault(x.batch_id, []).append(x)
    full = QT.SPEC.datasets_per_batch * QT.SPEC.samples_per_draw
    assert by and all(len(v) == full for v in by.values())
    for v in by.values():
        texts = [t for x in v for t in set(x.texts)]
        assert len(texts) == len(set(texts))


def test_a_stream_without_new_texts_leaves_its_draw_short(spark):
    got = TR.refill_shard([(0, 0, "a"), (0, 1, "none"), (1, 0, "a")], {"a": [("x",), ("x",), ("y",)]}, 4)
    assert got == [(0, 0, 0, "a", 0), (0, 0, 1, "a", 2), (1, 0, 0, "a", 0), (1, 0, 1, "a", 2)]


def test_merged_sketches_stay_within_the_rank_error(spark):
    from corpusflow.streaming import slo as SS

    rng = np.random.default_rng(8)
    values = np.concatenate([rng.lognormal(3, 1, 60_000), rng.normal(500, 5, 20_000)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i long, latency_ms double").select(
        F.timestamp_seconds(F.col("i") * 5).alias("ts"), F.lit("read").alias("operation"), "latency_ms", F.lit(0).alias("is_error"))
    hours = SS.rolling_sketches(df)
    assert hours.count() > 100
    got = SS.roll_up(hours, F.lit("all")).first()
    assert got.n == len(values)
    for p in (0.05, 0.5, 0.95, 0.99):
        v = SS.roll_up(hours, F.lit("all"), p).first().p95_ms
        assert abs((values <= v).mean() - p) <= SS.RANK_ERROR
    assert SS.roll_up(hours.limit(0), F.lit("all")).collect() == []


def test_every_line_has_texts_or_a_reason(spark):
    rows = [("d", '["a", "b"]', None), ("d", '{"texts": ["a", "b", "c"]}', None), ("r", '{"response": "r", "context": "c", "x": 1}', None),
            ("r", '{"response": "r"}', "missing_key"), ("d", '{"text": 1}', "missing_key"), ("d", '["a", "b"', "not_json"), ("d", "plain", "not_json"),
            ("d", "", "empty"), ("d", " \t", "empty"), ("d", None, "empty"), ("d", "[]", "no_texts"), ("d", "7", "no_texts"),
            ("d", '["a", null]', "null_text"), ("d", '{"texts": null}', "missing_key")]
    df = spark.createDataFrame(rows, "dataset string, line string, want string")
    got = TR.split_pairs(df, ("r",)).collect()
    assert [(r.line, r.reject_reason) for r in got] == [(r[1], r[2]) for r in rows]
    assert all((r.texts is None) == (r.reject_reason is not None) for r in got)
    kept = [list(r.texts) for r in got if r.texts]
    assert kept == [["a", "b"], ["a", "b", "c"], ["r", "c"]]
    assert TR.split_pairs(df.limit(0)).collect() == []
