"""Article and comment read/write paths over the stored-article fixture."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusflow.functions import text as X
from corpusflow.operators import articles as A
from corpusflow.operators import comments as C
from corpusflow.operators import similar as SIM
from corpusflow.plans import sqltext as S
from corpusflow.plans.common import sql_ts, ts_str
from corpusflow.plans.q_ingest import sql_hash_weights
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import INGEST_TS, cte, with_ctes
from corpusflow.session import materialize, scratch_path
from corpusflow.sources import fixtures as FX
from corpusflow.sources.store import SnapshotStore

PAGE_LIMIT, PAGE_OFFSET = 50, 20
FILTER_SOURCE = "src3"
DELETE_SOURCE = "src1"
VIEW_ID = 42


def _list_out(df):
    return df.select("id", "source", "title", "url", "content_preview", ts_str("published_at", True).alias("published_at"))


LIST_SQL = f"select id, source, title, url, content_preview, {sql_ts('published_at', True)} as published_at from articles"


@query("articles_list", sql=with_ctes(f"{LIST_SQL} order by published_at desc, id desc limit {PAGE_LIMIT} offset {PAGE_OFFSET}"))
def q_articles_list(spark, sf_dir):
    """Newest-first page with offset, pruned to the listing columns."""
    return _list_out(A.list_articles(FX.articles(spark, sf_dir), None, PAGE_LIMIT, PAGE_OFFSET))


@query("articles_list_by_source",
       sql=with_ctes(f"{LIST_SQL} where source = '{FILTER_SOURCE}' order by published_at desc, id desc limit 20"))
def q_articles_by_source(spark, sf_dir):
    """The same listing restricted to one source."""
    return _list_out(A.list_articles(FX.articles(spark, sf_dir), FILTER_SOURCE, 20, 0))


@query("home_feed", sql=with_ctes(f"""
select id, source, title, url,
       left(content_preview, 240) || case when length(content_preview) > 240 then '...' else '' end as excerpt,
       strftime(published_at, '%Y-%m-%d %H:%M') as published
from articles order by published_at desc, id desc limit 50"""))
def q_home_feed(spark, sf_dir):
    """50 newest with the 240-character excerpt and display time."""
    return A.home_feed(FX.articles(spark, sf_dir))


@query("sources_distinct", sql=with_ctes("select distinct source from articles"))
def q_sources(spark, sf_dir):
    """A2/L3: the source facet."""
    return A.sources(FX.articles(spark, sf_dir))


@query("articles_lookup", sql=with_ctes("""
select r.article_id, a.id is not null as found, a.title, a.source
from (select distinct article_id from comment_requests) r left join articles a on a.id = r.article_id"""))
def q_lookup(spark, sf_dir):
    """Batch point lookup with a found flag (the 404 path)."""
    df = A.lookup(FX.articles(spark, sf_dir), FX.comment_requests(spark, sf_dir))
    return df.select("article_id", "found", "title", "source")


@query("article_detail", sql=with_ctes(f"""
select a.id, a.source, a.rss_guid, a.title, a.url, a.content, {sql_ts('a.published_at', True)} as published_at,
       c.id as comment_id, c.author_name as comment_author_name, c.body as comment_body,
       case when c.id is not null then coalesce(nullif(c.author_name, ''), 'Anonymous') end as comment_author_display
from articles a left join comments c on c.article_id = a.id"""))
def q_article_detail(spark, sf_dir):
    """Article detail with its comments (flat, one row per comment)."""
    d = A.detail_rows(FX.articles(spark, sf_dir), FX.comments(spark, sf_dir))
    return d.select("id", "source", "rss_guid", "title", "url", "content", ts_str("published_at", True).alias("published_at"),
                    "comment_id", "comment_author_name", "comment_body",
                    F.when(F.col("comment_id").isNotNull(), X.display_author("comment_author_name")).alias("comment_author_display"))


@query("articles_quality", sql=with_ctes("""
select count(*) as n_articles,
       count(*) filter (where source is null or rss_guid is null or title is null or url is null or content is null or published_at is null) as null_violations,
       count(*) filter (where length(source) > 255) as source_too_long,
       count(*) filter (where length(rss_guid) > 1024) as rss_guid_too_long,
       count(*) filter (where length(title) > 512) as title_too_long,
       count(*) filter (where length(url) > 1024) as url_too_long,
       (select count(*) from (select rss_guid from articles group by 1 having count(*) > 1)) as duplicate_guids,
       (select count(*) from (select url from articles group by 1 having count(*) > 1)) as duplicate_urls,
       count(*) filter (where embedding is null or len(embedding) <> 64) as bad_vectors,
       (select count(*) from comments where article_id not in (select id from articles)) as orphan_comments
from articles"""))
def q_quality(spark, sf_dir):
    """P10: NOT NULL / length / UNIQUE / FK / vector length report."""
    return A.quality_report(FX.articles(spark, sf_dir), FX.comments(spark, sf_dir), dim=64)


@query("article_payload", sql=with_ctes(f"""
select a.id, a.title, coalesce(c.id // {A.PAGE_IDS}, 0) as page, count(c.id) as n_comments,
       coalesce(string_agg(c.id || ':' || coalesce(c.author_name, '-') || ':' || md5(c.body), '|' order by c.id), '') as comments
from articles a left join comments c on c.article_id = a.id
where a.id in (select article_id from comment_requests) group by a.id, a.title, coalesce(c.id // {A.PAGE_IDS}, 0)"""))
def q_article_payload(spark, sf_dir):
    """A3: the requested articles with their comments nested (shown as one digest per list)."""
    p = A.nest_comments(FX.articles(spark, sf_dir), FX.comments(spark, sf_dir), FX.comment_requests(spark, sf_dir))
    line = F.transform("comments", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), F.coalesce(c["author_name"], F.lit("-")),
                                                     F.lit(":"), F.md5(c["body"])))
    return p.select("id", "title", "page", F.size("comments").cast("long").alias("n_comments"), F.array_join(line, "|").alias("comments"))


@query("cascade_delete", sql=with_ctes(f"""
select id, article_id from comments where article_id not in (select id from articles where source = '{DELETE_SOURCE}')"""))
def q_cascade(spark, sf_dir):
    """Deleting the articles of one source deletes their comments."""
    arts = FX.articles(spark, sf_dir)
    _, kept = A.cascade_delete(arts, FX.comments(spark, sf_dir), arts.filter(F.col("source") == DELETE_SOURCE).select("id"))
    return kept.select("id", "article_id")


@query("preview_backfill", sql=with_ctes(f"""
select id, left(trim(regexp_replace(content, '{S.ASCII_WS}+', ' ', 'g')), 280) as content_preview from articles"""))
def q_preview_backfill(spark, sf_dir):
    """The migration's preview (no ellipsis, no word boundary)."""
    return A.backfill_previews(FX.articles(spark, sf_dir)).select("id", "content_preview")


cte("reindex_set", "select distinct a.id from articles a join comment_requests r on r.article_id = a.id")
cte("reindex_todo", f"""
select id, {S.make_preview('c')} as content_preview, {S.embedding_text('title', 'c')} as etext
from (select id, title, {S.strip_html('content')} as c from articles where id in (select id from reindex_set))""")
cte("reindex_emb", sql_hash_weights("reindex_todo", "id", "etext"))


@query("reindex_articles", sql=with_ctes("""
select t.id, t.content_preview, round((select sum(weight) from reindex_emb w where w.k = t.id), 6) + 0.0 as embedding_sum, true as reindexed
from reindex_todo t
union all
select id, content_preview, round(list_sum(cast(embedding as double[])), 6) + 0.0, false
from articles where id not in (select id from reindex_set)"""))
def q_reindex(spark, sf_dir):
    """U4: re-clean, re-embed and refresh the preview of the articles that got comments."""
    arts = FX.articles(spark, sf_dir)
    ids = materialize(arts.join(FX.comment_requests(spark, sf_dir), F.col("id") == F.col("article_id"), "left_semi").select("id"))
    out = A.reindex(arts, ids)
    flag = out.join(ids.withColumn("reindexed", F.lit(True)), "id", "left")
    return flag.select(
        "id", "content_preview",
        (F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6) + F.lit(0.0)).alias("embedding_sum"),
        F.coalesce("reindexed", F.lit(False)).alias("reindexed"),
    )


@query("reindex_missing", sql=with_ctes("select distinct article_id from comment_requests where article_id not in (select id from articles)"))
def q_reindex_missing(spark, sf_dir):
    """U4: requested ids that no article has are reported."""
    return A.missing_ids(FX.articles(spark, sf_dir), FX.comment_requests(spark, sf_dir), "article_id")


cte("comments_valid", f"""
select request_id, article_id, nullif(author_name, '') as author_name, {S.py_strip('body')} as body,
       case when body is null or {S.py_strip('body')} = '' then 'body_blank'
            when length(nullif(author_name, '')) > 120 then 'author_too_long' end as reject_reason
from comment_requests""")


@query("comments_validate", sql=with_ctes("select request_id, article_id, author_name, body, reject_reason from comments_valid"))
def q_comments_validate(spark, sf_dir):
    """Strip body, reject blank, '' author -> NULL, author <= 120."""
    return C.validate(FX.comment_requests(spark, sf_dir)).select("request_id", "article_id", "author_name", "body", "reject_reason")


@query("comments_fk_reject", sql=with_ctes("""
select request_id, article_id from comments_valid where reject_reason is null and article_id not in (select id from articles)"""))
def q_comments_fk(spark, sf_dir):
    """Comments on a missing article are rejected (the 404 path)."""
    ok = C.validate(FX.comment_requests(spark, sf_dir)).filter(F.col("reject_reason").isNull())
    _, rejected = C.split_fk(ok, FX.articles(spark, sf_dir))
    return rejected.select("request_id", "article_id")


@query("comments_append", sql=with_ctes(f"""
select (select max(id) from comments) + row_number() over (order by request_id) as id, article_id, author_name, body,
       {sql_ts(INGEST_TS)} as created_at
from comments_valid where reject_reason is null and article_id in (select id from articles)"""))
def q_comments_append(spark, sf_dir):
    """Validated, FK-checked comments appended with new ids."""
    rows, _ = C.append(FX.comments(spark, sf_dir), FX.comment_requests(spark, sf_dir), FX.articles(spark, sf_dir), FX.ingest_ts())
    return rows.select("id", "article_id", "author_name", "body", ts_str("created_at").alias("created_at"))


def _sql_dist(a: str, b: str) -> str:
    return (f"1 - list_dot_product(cast({a} as double[]), cast({b} as double[])) / "
            f"(sqrt(list_dot_product(cast({a} as double[]), cast({a} as double[]))) * sqrt(list_dot_product(cast({b} as double[]), cast({b} as double[]))))")


@query("article_view", sql=with_ctes(f"""
select rank, r.id, r.source, r.title, printf('%.3f', greatest(0, 1 - distance)) as similarity_display,
       s.title as subject_title, strftime(s.published_at, '%Y-%m-%d %H:%M') as subject_published,
       {S.strip_html('s.content')} as subject_body
from (select row_number() over (order by distance, id) as rank, * from (
        select a.id, a.source, a.title, {_sql_dist('a.embedding', 's.embedding')} as distance
        from articles a, (select embedding from articles where id = {VIEW_ID}) s where a.id <> {VIEW_ID})
      where distance is not null and not isnan(distance) order by distance, id limit 5) r,
     (select * from articles where id = {VIEW_ID}) s"""))
def q_article_view(spark, sf_dir):
    """T12/T14 + V3: the article page: cleaned body, display time, 5 recommendations."""
    arts = FX.articles(spark, sf_dir)
    subj = arts.filter(F.col("id") == VIEW_ID)
    recs = SIM.similar_to(arts, VIEW_ID, 5)
    # the page header in one scalar subquery (one row)
    head = subj.select(F.struct(F.col("title").alias("t"), X.display_time("published_at").alias("p"),
                                X.strip_html("content").alias("b"))).scalar()
    out = recs.select("rank", "id", "source", "title", X.display_similarity("similarity").alias("similarity_display"),
                      head.alias("_h"))
    return out.select(F.col("rank").cast("long").alias("rank"), "id", "source", "title", "similarity_display",
                      F.col("_h.t").alias("subject_title"), F.col("_h.p").alias("subject_published"),
                      F.col("_h.b").alias("subject_body"))


cte("comments_new", f"""
select (select max(id) from comments) + row_number() over (order by article_id % 2, request_id) as id, article_id, author_name, body,
       {INGEST_TS} as created_at
from comments_valid where reject_reason is null and article_id in (select id from articles)""")


@query("comments_store", sql=with_ctes(f"""
select id, article_id, author_name, body, {sql_ts('created_at')} as created_at
from (select * from comments union all select * from comments_new)"""))
def q_comments_store(spark, sf_dir):
    """The stored comment table after two batches of requests (even article ids, then odd)."""
    store = SnapshotStore(spark, scratch_path(spark, "runs", f"comments-{uuid.uuid4().hex[:12]}"), schema=C.COMMENT_SCHEMA)
    store.commit(FX.comments(spark, sf_dir))
    requests, arts = FX.comment_requests(spark, sf_dir), FX.articles(spark, sf_dir).select("id")
    for odd in (0, 1):
        C.append_to(store, requests.filter(F.col("article_id") % 2 == odd), arts, FX.ingest_ts(), ("requests", odd))
    return store.read().select("id", "article_id", "author_name", "body", ts_str("created_at").alias("created_at"))
