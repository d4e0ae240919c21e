import numpy as np

from corpusflow.operators.embed import embed, hashing_vector


def test_plugin_embedder_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, None), (3, "ccc")], "id long, text string")

    def make():  # stand-in for a real model: one vector per text, order kept
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    embedded = embed(df, "text", embedder=make)
    out = {r.id: list(r.embedding) for r in embedded.collect()}
    assert out == {1: [4.0, 1.0], 2: [0.0, 1.0], 3: [3.0, 1.0]}
    assert embedded.columns == ["id", "text", "embedding"]
    assert embed(df.limit(0), "text", embedder=make).count() == 0


def test_hashing_embedder_is_deterministic_and_unit_length(spark):
    df = spark.createDataFrame([(1, "Hello hello world"), (2, ""), (3, None)], "id long, text string")
    rows = {r.id: np.array(r.v) for r in df.select("id", hashing_vector("text", 16).alias("v")).collect()}
    assert abs(np.linalg.norm(rows[1]) - 1) < 1e-6
    assert not rows[2].any() and not rows[3].any() and len(rows[2]) == 16
    again = {r.id: np.array(r.v) for r in df.select("id", hashing_vector("text", 16).alias("v")).collect()}
    assert np.array_equal(rows[1], again[1])


def test_pooled_tokens_are_added_up_before_they_are_shuffled(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from corpusflow.operators import embed as EM

    rng = np.random.default_rng(8)
    vecs = rng.standard_normal((40, 3)).astype(np.float32)
    # 41 is not in the table, 40 has no vector: a key that meets it has none either; keys may be null or come again
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(40, None)], "vec_id long, embedding array<float>")
    docs = {1: [3, 3, 5], 2: list(range(40)), None: [7, 41], 4: [41], 5: [1, 40, 2]}
    rows = [(k, t) for k, ts in docs.items() for t in ts] + [(1, 9), (1, 3)]
    toks = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, vec_id long, m double").coalesce(1)
    want = {k: vecs[[t for d, t in rows if d == k and t < 40]].astype(float).mean(axis=0) for k in (1, 2, None)}

    def check(pooled):
        got = {r.doc_id: r.p for r in pooled.filter("p is not null").collect()}
        assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)

    check(EM.pool_tokens(toks, table, "doc_id"))
    plan = EM.pool_tokens(toks, table, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "strategy=broadcast" in plan
    # several slices, and a table too large for them
    monkeypatch.setattr(EM, "BROADCAST_MAX_BYTES", 1000)
    check(EM.pool_tokens(toks, table, "doc_id"))
    monkeypatch.setattr(EM, "MAX_SLICES", 1)
    check(EM.pool_tokens(toks, table, "doc_id"))
