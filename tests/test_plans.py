"""Plan assertions: the physical strategies the design relies on."""

from conftest import SF_SMALL
from corpusflow.operators import articles as A
from corpusflow.operators import similar as SIM
from corpusflow.operators import upsert as U
from corpusflow.plans.q_ingest import deduped, existing_articles
from corpusflow.sources import fixtures as FX


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_match_uses_equi_joins_not_nested_loops(spark):
    m = U.match_existing(deduped(spark, SF_SMALL), existing_articles(spark, SF_SMALL))
    p = plan(m)
    assert "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_listing_is_a_top_n_with_pruned_scan(spark):
    df = A.list_articles(FX.articles(spark, SF_SMALL), None, 20, 40)
    p = plan(df)
    assert "TakeOrderedAndProject" in p
    docs_scan = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "documents.parquet" in line]
    assert docs_scan and all("n_chars" not in line and "lang" not in line for line in docs_scan)


def test_single_subject_knn_scans_once_without_join(spark):
    df = SIM.similar_to(FX.articles(spark, SF_SMALL), 7, 5)
    p = plan(df)
    assert "TakeOrderedAndProject" in p and "NestedLoopJoin" not in p and "CartesianProduct" not in p


def test_source_filter_is_pushed_to_the_scan(spark):
    df = A.list_articles(FX.articles(spark, SF_SMALL), "src3", 20, 0)
    scans = [line for line in plan(df).splitlines() if "documents.parquet" in line]
    assert scans and all("EqualTo(source,src3)" in line for line in scans)


def test_chained_python_udfs_are_extracted(spark):
    from pyspark.sql import functions as F

    from corpusflow.functions import text as X
    from corpusflow.operators.embed import hashing_vector

    for _ in range(2):
        a = FX.articles(spark, SF_SMALL)
        df = a.select("id", hashing_vector(X.embedding_text(F.col("title"), F.col("content"))).alias("v"))
        p = plan(df)
        assert "ArrowEvalPython [scatter" in p and "ArrowEvalPython [_unescape_series" in p


def test_broadcast_only_below_the_bound(spark):
    from corpusflow.operators.joins import broadcast_if_small

    big = spark.range(0, 5000).withColumnRenamed("id", "k")
    keys = spark.range(0, 50).withColumnRenamed("id", "k")
    small_plan = plan(big.join(broadcast_if_small(keys, max_bytes=100_000), "k", "left_semi"))
    assert "BroadcastHashJoin" in small_plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        over = plan(big.join(broadcast_if_small(keys, max_bytes=100), "k", "left_semi"))
        assert "BroadcastHashJoin" not in over and "SortMergeJoin" in over
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
