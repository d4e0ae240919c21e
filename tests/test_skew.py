"""Hot keys: a third (or more) of all rows under one key must still be split across tasks
and give exact results."""

import numpy as np
from pyspark.sql import functions as F

from corpusflow.operators import entries as E
from corpusflow.operators import similar as SIM
from corpusflow.operators.ids import assign_ids


def test_hot_guid_dedupe_keeps_last(spark):
    n = 3000
    rows = [(i % 7, i, "hot" if i % 3 == 0 else f"g{i}", f"https://l/{i}") for i in range(n)]
    df = spark.createDataFrame(rows, "feed_pos long, entry_pos long, guid string, link string")
    out = E.dedupe_entries(df)
    hot = out.filter("guid = 'hot'").collect()
    assert len(hot) == 1
    exp = max((r for r in rows if r[2] == "hot"), key=lambda r: (r[0], r[1]))
    assert (hot[0].feed_pos, hot[0].entry_pos) == (exp[0], exp[1])
    assert out.count() == 1 + sum(1 for r in rows if r[2] != "hot")
    # the aggregation combines partially before the shuffle
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


def test_hot_lsh_bucket_is_split_and_exact(spark):
    rng = np.random.default_rng(5)
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(400)]          # one hot bucket in every table
    other = [(400 + i, rng.standard_normal(4).tolist()) for i in range(200)]
    df = spark.createDataFrame(same + other, "id long, embedding array<double>")
    res = SIM.lsh_topk(df, 5, 4, n_tables=4, block_rows=32)
    hot = res.filter("subject_id < 400").collect()
    assert len(hot) == 400 * 5
    assert all(r.id < 400 and abs(r.distance) < 1e-12 for r in hot)
    # ties are broken by id: the neighbours of subject s are the 5 smallest other ids
    got = {}
    for r in hot:
        got.setdefault(r.subject_id, []).append((r.rank, r.id))
    for s, lst in got.items():
        assert [i for _, i in sorted(lst)] == [i for i in range(7) if i != s][:5]


def test_hot_partition_ranking_is_dense(spark):
    rows = [("hot" if i % 2 else f"d{i % 5}", i * 7 % 10007) for i in range(4000)]
    df = spark.createDataFrame(rows, "dataset string, k long")
    out = assign_ids(df, F.col("k"), 0, "r", buckets=16, partition_col="dataset")
    got = {}
    for r in out.collect():
        got.setdefault(r.dataset, []).append((r.k, r.r))
    for ds, pairs in got.items():
        pairs.sort()
        assert [r for _, r in pairs] == list(range(1, len(pairs) + 1)), ds


def test_hot_article_detail_rows(spark):
    from corpusflow.operators.articles import detail_rows

    arts = spark.createDataFrame([(i, "s", f"g{i}", "t", f"u{i}", "c", None) for i in range(10)],
                                 "id long, source string, rss_guid string, title string, url string, content string, "
                                 "published_at timestamp")
    com = spark.createDataFrame([(j, 0 if j % 3 else 1 + j % 5, None, "b", None) for j in range(900)],
                                "id long, article_id long, author_name string, body string, created_at timestamp")
    d = detail_rows(arts, com)
    assert d.count() == 900 + 4  # articles 6..9 have no comments: one row each
    assert d.filter("id = 0").count() == 600 and d.filter("comment_id is null").count() == 4


def test_clustered_keys_and_an_outlier_fill_many_ranges(spark):
    # one hot feed whose positions lie close together, and one far key
    rows = [(3 * 2**32 + i,) for i in range(3000)] + [(i * 2**32,) for i in range(3)] + [(2**52,)]
    df = spark.createDataFrame(rows, "k long")
    out = assign_ids(df, F.col("k"), 100, "r", buckets=16)
    got = sorted((r.k, r.r) for r in out.collect())
    assert [r for _, r in got] == list(range(101, 101 + len(rows)))
    from pyspark.ml.feature import Bucketizer  # the ranges that assign_ids draws

    d = df.withColumn("d", F.col("k").cast("double"))
    cuts = sorted(set(d.stat.approxQuantile("d", [i / 16 for i in range(1, 16)], 0.1 / 16)))
    sizes = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="d", outputCol="b").transform(d).groupBy("b").count()
    assert sizes.count() >= 15 and sizes.agg(F.max("count")).first()[0] < 400
