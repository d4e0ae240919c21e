import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpusflow.functions.vectors import cosine_distance, similarity
from corpusflow.operators import similar as SIM


def test_similarity_from_distance(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (1.5,)], "d double")
    out = [round(r[0], 9) for r in df.select(similarity(F.col("d"))).collect()]
    assert out == [0.9, 0.8, 0.0]


def test_zero_identical_opposite_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0])], "id long, embedding array<double>")
    r = SIM.similar_to(df, 1, 20).collect()
    assert [x.id for x in r] == [2, 3]  # zero vector excluded, k larger than the table
    assert r[0].similarity == 1.0 and r[1].similarity == 0.0  # opposite clamps to 0
    d = df.select(cosine_distance(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0)))).collect()
    assert all(x[0] is None for x in d)


def brute_force(vecs, ids, k):
    u = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    d = 1 - u @ u.T
    np.fill_diagonal(d, np.inf)
    out = {}
    for i, sid in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[:k]
        out[sid] = [ids[j] for j in order]
    return out


def test_all_pairs_blocked_matches_brute_force(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    rows = emb.collect()
    ids = [r.vec_id for r in rows]
    vecs = np.array([r.embedding for r in rows], dtype=np.float64)
    exp = brute_force(vecs, ids, 5)
    got = {}
    # several blocks per side, so the block-pair path is exercised
    for r in SIM.all_pairs_topk(emb, 5, "vec_id", "embedding", block_rows=64).collect():
        got.setdefault(r.subject_id, []).append((r.rank, r.id))
    got = {k: [i for _, i in sorted(v)] for k, v in got.items()}
    assert got == exp


def test_lsh_recall(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    approx = SIM.lsh_topk(emb, 5, 64, "vec_id", "embedding", recall=0.9)
    exact = SIM.all_pairs_topk(emb, 5, "vec_id", "embedding")
    rec = SIM.recall_at_k(approx, exact, 5).first()
    assert rec.subjects == 500 and rec.recall_at_k >= 0.9


def test_lsh_shape_reaches_the_recall_with_fewer_candidates(spark):
    # groups of near vectors: 30 rows around each of 100 centres
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((100, 32))
    vecs = np.repeat(centres, 30, axis=0) + 0.25 * rng.standard_normal((3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, embedding array<double>")
    units = SIM.unit_vectors(df).checkpoint()
    bits, tables = SIM.lsh_shape(3000, SIM.neighbour_angle(units, 5))
    res = SIM.lsh_topk(df, 5, 32, recall=0.9)
    assert res.count() == 5 * 3000
    assert SIM.recall_at_k(res, SIM.all_pairs_topk(df, 5), 5).first().recall_at_k >= 0.9
    b = SIM.lsh_buckets(units, 32, tables, bits).groupBy("table", "bucket").count()
    assert b.agg(F.sum(F.col("count") * (F.col("count") - 1))).first()[0] / 3000 < 0.1 * 3000


def test_lsh_shape_follows_rows_and_angle():
    near = [SIM.lsh_shape(n, 0.4) for n in (10**3, 10**6, 10**9)]
    assert [b for b, _ in near] == sorted(b for b, _ in near) and near[0][0] < near[2][0]
    for bits, tables in near:
        p = 1 - 0.4 / np.pi
        assert 1 - (1 - p**bits) ** tables >= 0.9
    # no neighbours: few bits, which is close to comparing everything
    assert SIM.lsh_shape(10**6, np.pi / 2)[0] <= 2


def test_topk_for_a_set_of_subjects(spark):
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").select("vec_id", "embedding")
    ids = spark.createDataFrame([(3,), (77,), (77,), (-1,), (None,)], "vec_id long")
    got = [tuple(r) for r in SIM.topk_for(emb, ids, 5, "vec_id", "embedding", block_rows=64).orderBy("subject_id", "rank").collect()]
    exp = SIM.all_pairs_topk(emb, 5, "vec_id", "embedding").filter("subject_id in (3, 77)").orderBy("subject_id", "rank").collect()
    assert [g[:2] for g in got] == [tuple(e)[:2] for e in exp] and len(got) == 10


def test_floats_move_as_floats_and_small_blocks_are_exact_over_ties_and_null_ids(spark):
    # ten copies of each of 30 vectors over blocks smaller than the copies; a null id is never a subject's own
    rng = np.random.default_rng(3)
    vecs = np.round(rng.standard_normal((30, 4)), 2).astype(np.float32)
    rows = [(i, vecs[i % 30].tolist()) for i in range(300)] + [(None, vecs[0].tolist()), (900, [0.0] * 4), (901, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>")
    res = SIM.all_pairs_topk(df, 5, block_rows=8)
    got = {}
    for r in res.filter("subject_id is not null").collect():
        got.setdefault(r.subject_id, []).append((r.rank, r.id, r.distance))
    assert sorted(got) == list(range(300))
    for s, found in got.items():
        same = [i for i in range(s % 30, 300, 30) if i != s][:5]
        ids = [i for _, i, _ in sorted(found)]
        assert ids == same or s % 30 == 0 and set(ids) <= {None, *same}
        assert all(d < 1e-12 for _, _, d in found)
    assert SIM.raw_vectors(df).schema["u"].dataType.simpleString() == "array<float>"


def test_a_row_is_shuffled_once_per_block(spark):
    # before: once per block of either side, 32 rows of a vector for 16 blocks
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(256)], "id long, embedding array<float>")
    cands = SIM.blocked_topk(SIM.raw_vectors(df), 1, block_rows=16)
    assert cands.groupBy("subject_id").count().agg(F.max("count")).first()[0] <= 16
    plan = cands._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode") == 1 and "CoGroup" not in plan


def test_signatures_hold_a_vector_once(spark):
    df = spark.createDataFrame([(i, [1.0 + i, 2.0, -1.0]) for i in range(20)], "id long, embedding array<float>")
    sig = SIM.lsh_signatures(SIM.raw_vectors(df), 3, 50, 4)
    assert sig.count() == 20 and sig.schema["u"].dataType.simpleString() == "array<float>"
    assert {len(r.buckets) for r in sig.collect()} == {50}
    flat = SIM.lsh_buckets(SIM.raw_vectors(df), 3, 50, 4)
    assert flat.count() == 20 * 50
    planes = SIM.hyperplanes(3, 50, 4, 17)
    for r in flat.filter("id = 7").collect():
        bits = np.array(r.u) @ planes[r.table * 4:r.table * 4 + 4].T >= 0
        assert r.bucket == int((bits * (1 << np.arange(4))).sum())
