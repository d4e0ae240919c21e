"""Resampling, vector codes and the quality discriminant: brute force and awkward rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from tests.llm.cases import LONG, TEXTS, collected, docs

SF = "/root/testdata/sf0.001"


def words(text):
    return [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ord(c) > 127 or c.isdigit() or "a" <= c <= "z" else " "
                               for c in text or "").split(" ") if w]


@pytest.mark.parametrize("max_words", [1, 2, 3])
def test_buckets_are_crcs_of_runs(max_words):
    from corpusflow.llm.importance import scan

    r = random.Random(1)
    texts = ["".join(r.choice("abcé日\U0001f600 Z-_9") for _ in range(r.randrange(60))).encode() for _ in range(200)]
    for t, (n, found) in zip(texts, scan(texts, max_words, 10_000)):
        ws = words(t.decode())
        runs = [" ".join(ws[i:i + k]) for k in range(1, max_words + 1) for i in range(len(ws) - k + 1)]
        assert n == len(ws) and found.tolist() == [zlib.crc32(x.encode()) % 10_000 for x in runs]


def test_crc_composition():
    from corpusflow.llm.importance import compose

    r = random.Random(2)
    pairs = [(r.randbytes(r.randrange(9)), r.randbytes(n)) for n in [0, 1, 2, 7, 255, 256, 70_000]]
    got = compose(*(np.array(x, np.uint64) for x in ([zlib.crc32(a) for a, _ in pairs], [zlib.crc32(b) for _, b in pairs],
                                                     [len(b) for _, b in pairs])))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]


def resampled(rows, target, max_words, buckets, percent, min_words):
    def feats(t):
        ws = words(t)
        return [zlib.crc32(" ".join(ws[i:i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(ws) - k + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, x in rows:
        np.add.at(s, feats(x), 1)
    for x in target:
        np.add.at(t, feats(x), 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in feats(x))
        out.append([i, len(feats(x)), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("max_words,buckets", [(1, 10_000), (2, 97)])
def test_resampling_equals_brute_force(spark, max_words, buckets):
    from corpusflow.llm.importance import resample

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = [*rows, *TEXTS, *[(5000, "same words " * 20)] * 7]       # repeated rows, equal scores
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collected(resample(df, spark.createDataFrame([(t,) for t in target], "text string"), max_words, buckets))
    assert got == resampled(rows, target, max_words, buckets, 10, 20)


def test_ranks_over_many_ranges(spark):
    from corpusflow.llm.importance import ranked
    from pyspark.sql import functions as F

    # one score holds most rows: its ties still fill many ranges
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).alias("score"))
    got = ranked(df, F.col("id") >= 100, 50, range_rows=50).filter("rank is not null").orderBy("rank").collect()
    want = sorted(((-r.score, r.id) for r in df.filter("id >= 100").collect()))[:1450]
    assert [(r["rank"], -r.score, r.id) for r in got] == [(k + 1, *x) for k, x in enumerate(want)]


def test_resampling_edges(spark):
    from corpusflow.llm.importance import resample

    items = spark.createDataFrame([("alpha beta",), (None,)], "text string")
    assert resample(docs(spark, []), items).collect() == []
    got = resample(docs(spark), items.limit(0))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, resample(docs(spark, extra=False), items.limit(0)).collect()))
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[3].n_features == by_id[4].n_features == by_id[5].n_features == 0 and by_id[3].weight == 0
    assert by_id[6].n_features == len(words(LONG))
    assert by_id[8]["rank"] is None


@pytest.mark.parametrize("n,dim,span", [(64, 4, 100), (64, 4, 2), (64, 1, 1), (1, 3, 9), (200, 2, 1000), (7, 4, 0)])
def test_tree_finds_the_nearest_lowest_entry(n, dim, span):
    from corpusflow.llm.vector_codes import Gnat

    r = np.random.default_rng(n + span)
    entries, queries = r.integers(-span, span + 1, (n, dim)), r.integers(-span - 2, span + 3, (2000, dim))
    tree = Gnat(entries)
    d = ((queries[:, None] - entries[None]) ** 2).sum(-1)
    index, best = tree.nearest(queries)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
    if (n, span) == (200, 1000):
        assert tree.compared < 0.5 * n * len(queries)       # whole children are passed over


def test_tree_with_large_integers_keeps_ties():
    from corpusflow.llm.vector_codes import LIMIT, Gnat

    r = np.random.default_rng(3)
    entries = r.integers(-2, 3, (64, 4)) + LIMIT - 10       # distances far smaller than the coordinates
    queries = np.concatenate([entries, -entries, r.integers(-LIMIT, LIMIT, (500, 4))])
    d = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(q, e)) for e in entries] for q in queries], dtype=object)
    index, best = Gnat(entries).nearest(queries)
    assert index.tolist() == [min(range(64), key=lambda k: (row[k], k)) for row in d] and best.tolist() == [min(row) for row in d]


def compressed(rows, parts, entries, rounds):
    rows = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    w = len(rows[0][1]) // parts
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = [[r[1][p * w:(p + 1) * w] for p in range(parts)] for r in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    total = {}
    for r, f in zip(rows, found):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in f)
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[r[2]], sha) for r, f in zip(rows, found)), key=repr)


def test_codes_equal_brute_force(spark):
    from corpusflow.llm.vector_codes import compress

    r = random.Random(5)
    rows = [(i, [round(r.gauss(0, 1), 2) for _ in range(12)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, rows[3][1], 1)] * 5 + [(None, rows[4][1], None), (900, None, 1), (901, [None] * 12, 1),
                                        (902, [float("nan")] * 12, 1), (903, [float("inf")] + [0.0] * 11, 2), (904, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(7)
    for clash in ("id", "v", "raw", "code", "of", "error"):
        df = df.withColumn(clash, df["label"])
    assert collected(compress(df, parts=4, entries=20)) == compressed(rows, 4, 20, 2)
    few = spark.createDataFrame(rows[:9], "vec_id long, embedding array<double>, label int")
    assert collected(compress(few, parts=4, entries=20)) == compressed(rows[:9], 4, 20, 2)
    assert compress(df.filter("vec_id >= 900")).collect() == [] and compress(df.limit(0)).collect() == []


def test_vectors_of_another_length_are_left_out(spark):
    from corpusflow.llm.vector_codes import compress

    df = spark.createDataFrame([(1, [1.0] * 3, 0), (2, [1.0] * 4, 0), (3, [1.0] * 8, 0), (4, [1e30] * 4, 0)],
                               "vec_id long, embedding array<double>, label int")
    assert [(r.vec_id, r.code, r.error) for r in compress(df, parts=4).collect()] == [(2, "00000000", 0)]


def test_density_differences_equal_the_formula():
    from corpusflow.llm import quality_qda as q

    r = np.random.default_rng(4)
    x = [r.normal(0, 1, (50, 5)) @ r.normal(0, 1, (5, 5)) + k for k in (0, 1)]
    m = q.Moments(np.array([50.0, 50.0]), np.stack([a.sum(0) for a in x]), np.stack([a.T @ a for a in x]))
    new = r.normal(0, 2, (20, 5))
    pooled = sum(np.cov(a.T, bias=True) for a in x) / 2
    logs = []
    for a in x:
        c = 0.7 * np.cov(a.T, bias=True) + 0.3 * pooled
        c = 0.9 * c + (0.1 * np.trace(c) / 5 + 1e-6) * np.eye(5)
        d = new - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    assert np.allclose(q.fit(m, 0.3, 0.1).difference(new), logs[1] - logs[0])


def test_moments_are_exact_and_leave_held_out_rows(spark):
    from corpusflow.llm import quality_qda as q

    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = q.moments(q.labelled(q.measured(d.repartition(5), "doc_id", "text"), labels))
    text = {r.doc_id: r.text for r in d.collect()}
    for k in (0, 1):
        x = q.matrix([text[r.doc_id].encode() for r in labels.collect()
                      if r.quality == k and zlib.crc32(str(r.doc_id).encode()) % 5 != 0])
        assert got.n[k] == len(x) and np.allclose(got.total[k], x.sum(0), atol=1e-3)
        assert np.allclose(got.outer[k], x.T @ x, atol=1e-2)
    again = q.moments(q.labelled(q.measured(d, "doc_id", "text"), labels))
    assert (again.outer == got.outer).all()          # whatever the partitions


def test_quality_on_held_out_rows(spark):
    from corpusflow.llm import quality_qda as q

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = q.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert min(len(good), len(bad)) > 5
    assert sum(a > b for a in good for b in bad) > 0.97 * len(good) * len(bad)
    assert sum(r.predicted for r in rows if r.quality == 1) > 0.93 * len(good)


def test_quality_edges(spark):
    from corpusflow.llm import quality_qda as q

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (99, 1)], "doc_id long, quality int")
    for known in (labels, labels.limit(0), labels.filter("quality = 1")):
        got = q.classify(docs(spark), known).collect()
        assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 for r in got)
        by_id = {r.doc_id: r for r in got}
        assert by_id[3].score == by_id[4].score == by_id[5].score and by_id[1].score == by_id[2].score
    assert {r.score for r in q.classify(docs(spark), labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in q.classify(docs(spark), labels.limit(0)).collect()} == {1}
    assert q.classify(docs(spark, []), labels).collect() == []
    assert collected(q.classify(docs(spark), labels)) == collected(q.classify(docs(spark, extra=False), labels))
    # ids may be strings
    text_ids = docs(spark, extra=False).selectExpr("cast(doc_id as string) as doc_id", "text")
    assert q.classify(text_ids, labels.selectExpr("cast(doc_id as string) as doc_id", "quality")).count() == len(TEXTS)
