import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpusflow.operators import articles as A
from corpusflow.operators import comments as C
from corpusflow.sources import fixtures as FX
from corpusflow.sources.store import SnapshotStore


def test_listing_filter_and_facet(spark):
    arts = FX.articles(spark, SF_SMALL)
    page = A.list_articles(arts, "src3", 20, 0).collect()
    assert page and all(r.source == "src3" for r in page)
    ts = [(r.published_at, r.id) for r in page]
    assert ts == sorted(ts, reverse=True)
    facet = [r.source for r in A.sources(arts).collect()]
    assert facet == sorted(facet) and len(facet) > 1  # the facet ignores the filter
    assert A.list_articles(arts, "", 5, 0).count() == 5  # empty source = no filter


def test_page_bounds():
    with pytest.raises(ValueError):
        A.check_page(0, 0)
    with pytest.raises(ValueError):
        A.check_page(201, 0)
    with pytest.raises(ValueError):
        A.check_page(20, -1)
    with pytest.raises(ValueError):
        A.check_k(21)


def test_lookup_and_detail(spark):
    arts = FX.articles(spark, SF_SMALL)
    ids = spark.createDataFrame([(1,), (10 ** 9,)], "article_id long")
    found = {r.article_id: r.found for r in A.lookup(arts, ids).collect()}
    assert found == {1: True, 10 ** 9: False}


def test_nested_payload_of_requested_articles(spark):
    arts = FX.articles(spark, SF_SMALL)
    body = "id long, article_id long, author_name string, body string, created_at timestamp"
    many = [(i, 1, None, "x", None) for i in range(A.PAGE_IDS - 3, A.PAGE_IDS + 4)]     # over the end of one list
    coms = spark.createDataFrame([*many, (5, 2, "amy", "b", None), (6, 4, "bob", "c", None)], body)
    ids = spark.createDataFrame([(1,), (1,), (2,), (3,), (10 ** 9,), (None,)], "article_id long")
    got = {(r.id, r.page): [c.id for c in r.comments] for r in A.nest_comments(arts, coms, ids).collect()}
    assert got == {(1, 0): [9997, 9998, 9999], (1, 1): [10000, 10001, 10002, 10003], (2, 0): [5], (3, 0): []}
    assert {r.article_id for r in A.missing_ids(arts, ids.dropna(), "article_id").collect()} == {10 ** 9}


def test_quarantine_reasons(spark):
    rows = [("s", "g", "t", "u", [0.0] * 4), ("s", None, "t", "u", [0.0] * 4), ("s" * 256, "g", "t" * 600, "u", [0.0] * 4),
            ("s", "g" * 1024, "t" * 512, "u" * 1024, [0.0] * 4), ("s", "g", "t", "u" * 1025, [0.0] * 4),
            ("s", "g", "t", "u", [0.0] * 3), ("s", "g", "t", "u", None)]
    df = spark.createDataFrame(rows, "source string, rss_guid string, title string, url string, embedding array<double>")
    good, bad = A.quarantine(df, dim=4)
    assert good.count() == 2 and "reason" not in good.columns
    assert sorted(r.reason for r in bad.collect()) == ["null_key", "source_too_long", "url_too_long", "vector_length", "vector_length"]


def test_stored_comments_keep_their_ids_and_replays_add_nothing(spark, scratch):
    arts = FX.articles(spark, SF_SMALL).select("id")
    store = SnapshotStore(spark, f"{scratch}/comments", part_rows=2, schema=C.COMMENT_SCHEMA)
    req = spark.createDataFrame([(1, 1, "", " hi "), (2, 2, "amy", "b"), (3, 1, None, " "), (4, 10 ** 9, "bob", "ok")],
                                "request_id long, article_id long, author_name string, body string")
    bad = C.append_to(store, req, arts, FX.ingest_ts(), ("q", 0))
    assert {r.request_id: r.reject_reason for r in bad.collect()} == {3: "body_blank", 4: "article_not_found"}
    assert C.append_to(store, req, arts, FX.ingest_ts(), ("q", 0)).count() == 0      # a replay
    C.append_to(store, req, arts, FX.ingest_ts(), ("q", 1))
    rows = [(r.id, r.article_id, r.author_name, r.body) for r in store.read().orderBy("id").collect()]
    assert rows == [(1, 1, None, "hi"), (2, 2, "amy", "b"), (3, 1, None, "hi"), (4, 2, "amy", "b")]


def test_comment_rules(spark):
    req = spark.createDataFrame(
        [(1, 1, "", "  hi  "), (2, 1, None, "   "), (3, 1, "x" * 121, "ok"), (4, 10 ** 9, "bob", "ok"), (5, 2, "amy", "b")],
        "request_id long, article_id long, author_name string, body string")
    v = {r.request_id: r for r in C.validate(req).collect()}
    assert v[1].author_name is None and v[1].body == "hi" and v[1].reject_reason is None
    assert v[2].reject_reason == "body_blank" and v[3].reject_reason == "author_too_long"
    arts = FX.articles(spark, SF_SMALL)
    rows, rejected = C.append(FX.comments(spark, SF_SMALL), req, arts, FX.ingest_ts())
    got = {r.article_id: r.id for r in rows.collect()}
    base = FX.comments(spark, SF_SMALL).agg(F.max("id")).first()[0]
    assert sorted(got.values()) == [base + 1, base + 2]
    reasons = {r.request_id: r.reject_reason for r in rejected.collect()}
    assert reasons == {2: "body_blank", 3: "author_too_long", 4: "article_not_found"}


def test_cascade_delete(spark):
    arts = FX.articles(spark, SF_SMALL)
    com = FX.comments(spark, SF_SMALL)
    kept_a, kept_c = A.cascade_delete(arts, com, arts.filter("id < 5").select("id"))
    assert kept_a.filter("id < 5").count() == 0
    assert kept_c.filter("article_id < 5").count() == 0
    assert kept_c.count() == com.filter("article_id >= 5").count()
