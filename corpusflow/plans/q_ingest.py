"""Feed ingest: sources, entry normalisation, change detection, snapshot upsert, counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.text import py_strip
from corpusflow.operators import entries as E
from corpusflow.operators import upsert as U
from corpusflow.operators.embed import hashing_vector
from corpusflow.functions.text import embedding_text
from corpusflow.plans import sqltext as S
from corpusflow.plans.common import sql_ts, ts_str
from corpusflow.plans.registry import query
from corpusflow.plans.sqlfixtures import INGEST_TS, cte, cte_fold, derived, with_ctes
from corpusflow.sources import fixtures as FX
from corpusflow.sources.tables import table
from corpusflow.session import materialize

EXISTING_CREATED = "2025-12-31 00:00:00"


# ---------------------------------------------------------------- Spark-side shared stages
def normalized(spark, sf_dir, strict_rfc=False) -> DataFrame:
    return E.normalize_entries(FX.raw_entries(spark, sf_dir), FX.ingest_ts(), strict_rfc)


def deduped(spark, sf_dir) -> DataFrame:
    # the landed batch after cleaning: read by the stored-table fixture and by the upsert
    return materialize(E.dedupe_entries(E.valid_entries(normalized(spark, sf_dir))))


def existing_articles(spark, sf_dir, batch: DataFrame | None = None) -> DataFrame:
    """The upsert target: half of the de-duplicated entries, some with an older title
    (changed by guid) and some with an older guid (matched by url only). Pass the
    already-materialised ``batch`` to derive it without cleaning the entries again."""
    d = (batch if batch is not None else deduped(spark, sf_dir)).filter(F.col("entry_pos") % 2 == 0)
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    d = d.join(v, v.vec_id == d.entry_pos % FX.row_count(spark, sf_dir, "embeddings"))
    pos = F.col("entry_pos")
    created = F.to_timestamp(F.lit(EXISTING_CREATED))
    return (d.select(
        pos.alias("id"),
        "source",
        F.when(pos % 6 == 0, F.concat(F.lit("old-"), F.col("guid"))).otherwise(F.col("guid")).alias("rss_guid"),
        F.when(pos % 4 == 0, F.concat(F.col("title"), F.lit(" (old)"))).otherwise(F.col("title")).alias("title"),
        F.col("link").alias("url"),
        F.col("content_clean").alias("content"),
        "content_preview",
        "published_at",
        "embedding",
        created.alias("created_at"),
        created.alias("updated_at"),
    ))


def upserted(spark, sf_dir):
    batch = deduped(spark, sf_dir)
    return U.upsert(existing_articles(spark, sf_dir, batch), batch, FX.ingest_ts())


def classified(spark, sf_dir):
    """Per-entry actions only (no embedding or numbering of the changes)."""
    batch = deduped(spark, sf_dir)
    return U.classify_batch(existing_articles(spark, sf_dir, batch), batch)


def chained(spark, sf_dir) -> DataFrame:
    """Valid entries of which many share a guid or a link, cleaned once."""
    return materialize(E.valid_entries(E.normalize_entries(FX.chained_entries(spark, sf_dir), FX.ingest_ts())))


def chained_upsert(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The stored articles and the batch of :func:`chained`. The articles come from the landed
    entries in it, which are not cleaned again."""
    batch = chained(spark, sf_dir)
    landed = batch.filter(F.col("feed_pos") < FX.CHAINED_FEED)
    return existing_articles(spark, sf_dir, materialize(E.dedupe_entries(landed))), batch


def failed_feeds(spark, sf_dir) -> DataFrame:
    expected = feed_list(spark, sf_dir).filter(F.col("feed_url").startswith(FX.FEED_BASE)).select("feed_url").distinct()
    landed = FX.raw_entries(spark, sf_dir).groupBy("feed_url").agg(F.count(F.lit(1)).alias("n_entries"))
    return expected.join(landed, "feed_url", "left").select(
        "feed_url", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.col("n_entries").isNull().alias("failed")
    )


def feed_list(spark, sf_dir) -> DataFrame:
    cfg = FX.feed_config(spark, sf_dir)
    feeds = F.filter(F.transform(F.split("rss_feeds", ","), py_strip), lambda x: x != "")
    return cfg.select("config_id", F.posexplode(feeds).alias("pos", "feed_url"))


# ---------------------------------------------------------------- SQL-side shared stages
cte("feed_list", f"""
select config_id, unnest(range(len(f))) as pos, unnest(f) as feed_url from (
  select page_id as config_id,
         list_filter(list_transform(string_split(' ' || url || ' ,, https://feeds.example.invalid/' || cast(page_id % 7 as varchar) || ' , ', ','),
                     lambda x: {S.py_strip('x')}), lambda x: x <> '') as f
  from pages)""")

cte("failed_feeds", """
select x.feed_url, coalesce(l.n, 0) as n_entries, l.n is null as failed
from (select distinct feed_url from feed_list where starts_with(feed_url, 'https://feeds.example.invalid/')) x
left join (select feed_url, count(*) as n from raw_entries group by feed_url) l on l.feed_url = x.feed_url""")

cte("existing_articles", f"""
select d.entry_pos as id, d.source,
       case when d.entry_pos % 6 = 0 then 'old-' || d.guid else d.guid end as rss_guid,
       case when d.entry_pos % 4 = 0 then d.title || ' (old)' else d.title end as title,
       d.link as url, d.content_clean as content, d.content_preview, d.published_at, v.embedding,
       TIMESTAMP '{EXISTING_CREATED}' as created_at, TIMESTAMP '{EXISTING_CREATED}' as updated_at
from entries_dedup d cross join (select count(*) as n from embeddings) nv join embeddings v on v.vec_id = d.entry_pos % nv.n
where d.entry_pos % 2 = 0""")

cte("upsert_m", """
select i.*, g.id as g_id, u.id as u_id,
       case when g.id is not null then 'guid' when u.id is not null then 'url' end as match_by,
       coalesce(g.id, u.id) as ex_id,
       case when g.id is not null then g.source else u.source end as ex_source,
       case when g.id is not null then g.rss_guid else u.rss_guid end as ex_rss_guid,
       case when g.id is not null then g.title else u.title end as ex_title,
       case when g.id is not null then g.url else u.url end as ex_url,
       case when g.id is not null then g.content else u.content end as ex_content,
       case when g.id is not null then g.content_preview else u.content_preview end as ex_content_preview,
       case when g.id is not null then g.published_at else u.published_at end as ex_published_at,
       case when g.id is not null then g.embedding else u.embedding end as ex_embedding,
       case when g.id is not null then g.created_at else u.created_at end as ex_created_at,
       (g.id is not null and u.id is not null and g.id <> u.id)
         or (g.id is null and u.id is not null and t.guid is not null) as conflict
from entries_dedup i
left join existing_articles g on g.rss_guid = i.guid
left join existing_articles u on u.url = i.link
left join (select guid from entries_dedup) t on t.guid = u.rss_guid""")

cte("upsert_c", """
select *,
       case when conflict then 'conflict' when ex_id is null then 'insert'
            when not (ex_source is not distinct from source and ex_title is not distinct from title
                      and ex_url is not distinct from link and ex_content is not distinct from content_clean
                      and ex_published_at is not distinct from pub and ex_content_preview is not distinct from content_preview)
            then 'update' else 'unchanged' end as action
from (select *, case when not published_ok and ex_id is not null then ex_published_at else published_at end as pub from upsert_m)""")

cte("upsert_e", f"""
select *, action = 'insert' or (action = 'update' and not (ex_title is not distinct from title and ex_content is not distinct from content_clean)) as needs_embedding,
       {S.embedding_text('title', 'content_clean')} as etext
from upsert_c""")


def sql_hash_weights(rel: str, key: str, text: str, dim: int = 64) -> str:
    """(key, dim, weight) rows of the hashing embedder, weights as float32 like Spark."""
    return f"""
select {key} as k, b as dim, cast(cast(w / sqrt(sum(w * w) over (partition by {key})) as float) as double) as weight from (
  select {key}, b, sum(s) as w from (
    select {key}, ((('0x' || substr(md5(tok), 1, 8))::bigint) % {dim})::int as b,
           case when (('0x' || substr(md5(tok), 9, 1))::int) % 2 = 0 then 1.0 else -1.0 end as s
    from (select {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+')) as tok from {rel}))
  group by all)"""


cte("upsert_emb", sql_hash_weights("(select * from upsert_e where needs_embedding)", "entry_pos", "etext"))

cte("upsert_changes", f"""
select (select coalesce(max(id), 0) from existing_articles) + row_number() over (order by feed_pos, entry_pos) as id,
       source, guid as rss_guid, title, link as url, content_clean as content, content_preview, pub as published_at,
       (select sum(weight) from upsert_emb w where w.k = e.entry_pos) as emb_sum,
       {INGEST_TS} as created_at, {INGEST_TS} as updated_at
from upsert_e e where action = 'insert'
union all
select ex_id as id, source, ex_rss_guid as rss_guid, title, link as url, content_clean as content, content_preview, pub as published_at,
       case when needs_embedding then (select sum(weight) from upsert_emb w where w.k = e.entry_pos)
            else list_sum(cast(ex_embedding as double[])) end as emb_sum,
       ex_created_at as created_at, {INGEST_TS} as updated_at
from upsert_e e where action = 'update'""")


# the ordered upsert: the same stages over what the fold comes to
cte_fold("ordered_fold", "chained_valid", "existing_articles")
cte("ordered_m", """
select f.* exclude (art), f.art as ex_id, x.source as ex_source, x.rss_guid as ex_rss_guid, x.title as ex_title, x.url as ex_url,
       x.content as ex_content, x.content_preview as ex_content_preview, x.published_at as ex_published_at, x.embedding as ex_embedding,
       x.created_at as ex_created_at
from ordered_fold f left join existing_articles x on x.id = f.art""")
_ORDERED = {n: n.replace("upsert_", "ordered_") for n in ("upsert_m", "upsert_c", "upsert_e", "upsert_emb", "upsert_changes")}
for _name in ("upsert_c", "upsert_e", "upsert_emb"):
    derived(_ORDERED[_name], _name, _ORDERED)
derived("ordered_changes", "upsert_changes", {**_ORDERED, "order by feed_pos, entry_pos": "order by ins_feed, ins_entry"})


# ---------------------------------------------------------------- registered queries
@query("feed_list_explode", sql=with_ctes("select config_id, pos, feed_url from feed_list"))
def q_feed_list(spark, sf_dir):
    """Comma-separated feed settings -> one trimmed, non-empty URL per row."""
    return feed_list(spark, sf_dir)


@query("feed_source_resolve", sql=with_ctes("select distinct feed_url, coalesce(feed_title, feed_url) as source from raw_entries"))
def q_feed_source(spark, sf_dir):
    """The source of a feed is its title, or its URL when the title is missing."""
    raw = FX.raw_entries(spark, sf_dir)
    return raw.select("feed_url", E.resolve_source(F.col("feed_title"), F.col("feed_url")).alias("source")).distinct()


@query("entries_flatten", sql="""
select doc_id, feed_url, 0 as entry_pos, 'guid-' || cast(page_id as varchar) as id, url as link,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title
from (select page_id as doc_id, 'https://feeds.example.invalid/' || cast(page_id % 5 as varchar) as feed_url, * from pages)
union all
select page_id, 'https://feeds.example.invalid/' || cast(page_id % 5 as varchar), 1, 'guid-' || cast(page_id as varchar), url,
       regexp_extract(html, '<title>([^<]*)</title>', 1) || ' (rev)'
from pages where page_id % 4 = 0""")
def q_entries_flatten(spark, sf_dir):
    """S3: one row per entry of every parsed feed document, in document then entry order."""
    flat = E.flatten_feeds(FX.feed_documents(spark, sf_dir))
    return flat.select("doc_id", "feed_url", F.col("entry_pos").cast("int").alias("entry_pos"), "id", "link", "title")


@query("ingest_failed_feeds", sql=with_ctes("select feed_url, n_entries, failed from failed_feeds"))
def q_failed_feeds(spark, sf_dir):
    """Configured feeds that produced nothing are reported as failed."""
    return failed_feeds(spark, sf_dir)


@query("entries_normalize", sql=with_ctes(f"""
select entry_pos, feed_url, source, guid, link, title, content_clean, content_preview,
       {sql_ts('published_at')} as published_at, published_ok, reject_reason
from entries_norm"""))
def q_entries_normalize(spark, sf_dir):
    """Keys, title and content defaults, cleaned content, preview, date."""
    n = normalized(spark, sf_dir)
    return n.select("entry_pos", "feed_url", "source", "guid", "link", "title", "content_clean", "content_preview",
                    ts_str("published_at").alias("published_at"), "published_ok", "reject_reason")


@query("entries_rejected", sql=with_ctes("select entry_pos, feed_url, reject_reason from entries_norm where reject_reason is not null"))
def q_entries_rejected(spark, sf_dir):
    """P5: entries without a guid or a link are rejected, with the reason."""
    return E.rejected_entries(normalized(spark, sf_dir)).select("entry_pos", "feed_url", "reject_reason")


@query("entries_dedupe", sql=with_ctes("select entry_pos, guid, link, source from entries_dedup"))
def q_entries_dedupe(spark, sf_dir):
    """One entry per guid and per link; the last occurrence wins."""
    return deduped(spark, sf_dir).select("entry_pos", "guid", "link", "source")


@query("upsert_match", sql=with_ctes("select entry_pos, guid, link, match_by, ex_id, conflict from upsert_m"))
def q_upsert_match(spark, sf_dir):
    """Stored row matched by guid first, then by url; conflicting matches flagged."""
    batch = deduped(spark, sf_dir)
    m = U.match_existing(batch, existing_articles(spark, sf_dir, batch))
    return m.select("entry_pos", "guid", "link", "match_by", "ex_id", "conflict")


@query("upsert_classify", sql=with_ctes("select entry_pos, action, needs_embedding from upsert_e"))
def q_upsert_classify(spark, sf_dir):
    """Insert, update, unchanged or conflict per incoming entry."""
    c = classified(spark, sf_dir)
    return c.select("entry_pos", "action", "needs_embedding")


def _emb_sum(col):
    return F.round(F.aggregate(col, F.lit(0.0), lambda a, x: a + x.cast("double")), 6) + F.lit(0.0)


@query("upsert_snapshot", sql=with_ctes(f"""
select id, source, rss_guid, title, url, content, content_preview, {sql_ts('published_at', True)} as published_at,
       {sql_ts('created_at')} as created_at, {sql_ts('updated_at')} as updated_at, round(emb_sum, 6) + 0.0 as embedding_sum
from (select * from upsert_changes
      union all
      select id, source, rss_guid, title, url, content, content_preview, published_at,
             list_sum(cast(embedding as double[])) as emb_sum, created_at, updated_at
      from existing_articles where id not in (select id from upsert_changes))"""))
def q_upsert_snapshot(spark, sf_dir):
    """Next article snapshot = untouched + updated + inserted rows."""
    snap, _ = upserted(spark, sf_dir)
    return snap.select("id", "source", "rss_guid", "title", "url", "content", "content_preview",
                       ts_str("published_at", True).alias("published_at"), ts_str("created_at").alias("created_at"),
                       ts_str("updated_at").alias("updated_at"), _emb_sum(F.col("embedding")).alias("embedding_sum"))


@query("upsert_ordered", sql=with_ctes(f"""
select id, source, rss_guid, title, url, content, content_preview, {sql_ts('published_at', True)} as published_at,
       {sql_ts('created_at')} as created_at, {sql_ts('updated_at')} as updated_at, round(emb_sum, 6) + 0.0 as embedding_sum
from (select * from ordered_changes
      union all
      select id, source, rss_guid, title, url, content, content_preview, published_at,
             list_sum(cast(embedding as double[])) as emb_sum, created_at, updated_at
      from existing_articles where id not in (select id from ordered_changes))"""))
def q_upsert_ordered(spark, sf_dir):
    """The next snapshot after entries that share keys, applied in feed order."""
    existing, batch = chained_upsert(spark, sf_dir)
    snap, _ = U.upsert(existing, batch, FX.ingest_ts(), ordered=True)
    return snap.select("id", "source", "rss_guid", "title", "url", "content", "content_preview",
                       ts_str("published_at", True).alias("published_at"), ts_str("created_at").alias("created_at"),
                       ts_str("updated_at").alias("updated_at"), _emb_sum(F.col("embedding")).alias("embedding_sum"))


@query("upsert_ordered_actions", sql=with_ctes("""
select entry_pos, guid, link, match_by, ex_id, action, ins_entry as first_entry_pos from ordered_c"""))
def q_upsert_ordered_actions(spark, sf_dir):
    """What each article touched by the batch comes to, and each conflicting entry."""
    c = U.classify_batch(*chained_upsert(spark, sf_dir), ordered=True)
    return c.select("entry_pos", "guid", "link", "match_by", "ex_id", "action", "first_entry_pos")


@query("embed_changed_only", sql=with_ctes("select k as entry_pos, dim, round(weight, 6) + 0.0 as weight from upsert_emb where weight <> 0"))
def q_embed_changed_only(spark, sf_dir):
    """Embeddings are computed only for inserted rows and rows whose text changed."""
    c = classified(spark, sf_dir)
    e = c.filter("needs_embedding").select("entry_pos", hashing_vector(embedding_text(F.col("title"), F.col("content_clean"))).alias("v"))
    # posexplode_outer: a plain posexplode infers a size(v) > 0 filter that Catalyst pushes
    # below the join, evaluating the embedding UDFs a second time
    e = e.select("entry_pos", F.posexplode_outer("v").alias("dim", "weight")).filter(F.col("weight") != 0)
    return e.select("entry_pos", F.col("dim").cast("int").alias("dim"), (F.round(F.col("weight").cast("double"), 6) + F.lit(0.0)).alias("weight"))


@query("ingest_metrics", sql=with_ctes("""
select count(*) filter (where action = 'insert') as ingested, count(*) filter (where action = 'update') as updated,
       count(*) filter (where action = 'unchanged') as unchanged, count(*) filter (where action = 'conflict') as conflicts,
       (select count(*) from entries_norm where reject_reason is not null) as skipped,
       (select string_agg(feed_url, ',' order by feed_url) from failed_feeds where failed) as failed_feeds
from upsert_c"""))
def q_ingest_metrics(spark, sf_dir):
    """A1: ingested / updated / unchanged / conflicts / skipped counters and failed feeds."""
    c = classified(spark, sf_dir)
    rejected = E.rejected_entries(normalized(spark, sf_dir))
    failed = failed_feeds(spark, sf_dir).filter("failed")
    m = U.ingest_metrics(c, rejected, failed)
    return m.withColumn("failed_feeds", F.array_join("failed_feeds", ","))


@query("feed_xml_read", sql=f"""
select 'Feed ' || cast(page_id % 5 as varchar) as source, 'guid-' || cast(page_id as varchar) as guid, url as link,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title, {S.strip_html('html')} as content_clean
from pages""")
def q_feed_xml(spark, sf_dir):
    """RSS files (written from the pages table) read back with an explicit
    schema, flattened and normalised."""
    import uuid

    from corpusflow.session import scratch_path
    from corpusflow.sources.feeds import read_rss

    base = scratch_path(spark, "runs", f"feed_xml-{uuid.uuid4().hex[:12]}")
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    item = F.struct(
        F.concat(F.lit("guid-"), F.col("page_id").cast("string")).alias("guid"),
        F.col("url").alias("link"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("description"),
    )
    docs = p.select(F.concat(F.lit("Feed "), (F.col("page_id") % 5).cast("string")).alias("title"), F.array(item).alias("item"))
    docs.write.format("xml").option("rootTag", "rss").option("rowTag", "channel").mode("overwrite").save(f"{base}/rss")
    flat = E.flatten_feeds(read_rss(spark, f"{base}/rss").withColumn("feed_pos", F.lit(0)))
    n = E.normalize_entries(flat, FX.ingest_ts())
    return n.select("source", "guid", "link", "title", "content_clean")


PER_FEED = 16        # pages in a file of several, below


def _land(rows: DataFrame, by: str, out: str) -> None:
    """One text file per value of ``by``, its lines in page order. The files are short, and their
    number grows with the pages."""
    rows.repartition(by).sortWithinPartitions(by, "page_id").select(by, "value").write.partitionBy(by).text(out)


def _feed_dir(spark, name: str) -> str:
    import uuid

    from corpusflow.session import scratch_path

    return f"{scratch_path(spark, 'runs', f'{name}-{uuid.uuid4().hex[:12]}')}/feeds"


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def _page_fields(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "url", "html").select(
        "page_id", "url", "html", F.concat(F.lit("guid-"), F.col("page_id").cast("string")).alias("guid"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


@query("feed_atom_read", sql=f"""
select 'Feed ' || cast(page_id % 7 as varchar) as source, 'guid-' || cast(page_id as varchar) as guid, url as link,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title, {S.strip_html('html')} as content_clean
from pages""")
def q_feed_atom(spark, sf_dir):
    """Every page as an Atom document, read back, flattened and normalised; the alternate
    link is the entry's."""
    from corpusflow.sources.feeds import feed_documents

    out = _feed_dir(spark, "feed_atom")
    entry = F.struct(
        F.col("guid").alias("id"),
        F.array(F.struct(F.lit("https://example.invalid/self").alias("_href"), F.lit("self").alias("_rel")),
                F.struct(F.col("url").alias("_href"), F.lit("alternate").alias("_rel"))).alias("link"),
        "title", F.col("html").alias("summary"))
    docs = _page_fields(spark, sf_dir).select(F.concat(F.lit("Feed "), (F.col("page_id") % 7).cast("string")).alias("title"),
                                              F.array(entry).alias("entry"))
    docs.write.format("xml").option("rootTag", "feeds").option("rowTag", "feed").save(out)
    n = E.normalize_entries(E.flatten_feeds(feed_documents(spark, atom_path=out)), FX.ingest_ts())
    return n.select("source", "guid", "link", "title", "content_clean")


@query("feed_rdf_read", sql=f"""
select 'Feed ' || cast(page_id % 7 as varchar) as source, url as guid, url as link,
       regexp_extract(html, '<title>([^<]*)</title>', 1) as title, {S.strip_html('html')} as content_clean,
       {sql_ts('ts')} as published_at
from pages join events on event_id = page_id""")
def q_feed_rdf(spark, sf_dir):
    """Every page as an RSS 1.0 document: its item stands beside the channel, is named by
    ``rdf:about`` and dated by ``dc:date`` in ISO-8601."""
    from corpusflow.sources.feeds import feed_documents

    out = _feed_dir(spark, "feed_rdf")
    p = _page_fields(spark, sf_dir)
    ev = table(spark, sf_dir, "events", "event_id", "ts")
    doc = F.concat(
        F.lit('<rdf:RDF xmlns="http://purl.org/rss/1.0/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
              'xmlns:dc="http://purl.org/dc/elements/1.1/"><channel rdf:about="https://example.invalid"><title>Feed '),
        (F.col("page_id") % 7).cast("string"), F.lit('</title></channel><item rdf:about="'), _escaped("url"), F.lit('"><title>'), _escaped("title"),
        F.lit("</title><link>"), _escaped("url"), F.lit("</link><description>"), _escaped("html"), F.lit("</description><dc:date>"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</dc:date></item></rdf:RDF>"))
    # one feed per page, several in a file below one root
    rows = p.join(ev, p.page_id == ev.event_id).select(F.floor(F.col("page_id") / PER_FEED).alias("file"), "page_id", doc.alias("value"))
    ends = [F.col("page_id") == f("page_id").over(Window.partitionBy("file")) for f in (F.min, F.max)]
    rows = rows.withColumn("value", F.concat(F.when(ends[0], F.lit("<feeds>")).otherwise(""), "value", F.when(ends[1], F.lit("</feeds>")).otherwise("")))
    _land(rows, "file", out)
    n = E.normalize_entries(E.flatten_feeds(feed_documents(spark, rdf_path=f"{out}/*")), FX.ingest_ts())
    return n.select("source", "guid", "link", "title", "content_clean", ts_str("published_at").alias("published_at"))


# what is wrong with a feed, by its number modulo the number of kinds
WHOLE, AMPERSAND, CUT, NESTING, LOST, ABSENT = range(6)


def _damaged_feeds(spark, sf_dir) -> str:
    """RSS files of ``PER_FEED`` pages each: whole ones, and ones with a bare ampersand and an
    undeclared entity in titles, cut within the last item, with wrong nesting and a control
    character, cut within the first item, and absent ones."""
    p = _page_fields(spark, sf_dir).withColumn("feed", F.floor(F.col("page_id") / PER_FEED)).withColumn("kind", F.col("feed") % 6)
    k = F.col("kind")
    spoiled = F.when(k == AMPERSAND, F.lit(" & R&D caf&eacute;")).when(k == NESTING, F.lit(" <b>x</i>\x0b")).otherwise(F.lit(""))
    # of a cut-off feed the last item loses its end, and of a lost one every item but the first is gone
    last = F.col("page_id") == F.max("page_id").over(Window.partitionBy("feed"))
    first = F.col("page_id") == F.min("page_id").over(Window.partitionBy("feed"))
    cut = ((k == CUT) & last) | ((k == LOST) & first)
    item = F.concat(F.lit("<item><guid>"), "guid", F.lit("</guid><link>"), _escaped("url"), F.lit("</link><title>"), _escaped("title"), spoiled,
                    F.lit("</title><description>"), _escaped("html"), F.when(cut, F.lit("")).otherwise(F.lit("</description></item>")))
    head = F.when(first, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>Feed '), F.col("feed").cast("string"),
                                  F.lit("</title>"))).otherwise("")
    tail = F.when(last & (k != CUT), F.lit("</channel></rss>")).otherwise("")
    lines = p.withColumn("keep", (k != ABSENT) & ((k != LOST) | first)).withColumn("value", F.concat(head, item, tail)).filter("keep")
    out = _feed_dir(spark, "feed_damaged")
    _land(lines, "feed", out)
    return out


def _damaged_documents(spark, sf_dir) -> DataFrame:
    from corpusflow.sources.feeds import feed_documents

    docs = feed_documents(spark, rss_path=f"{_damaged_feeds(spark, sf_dir)}/*")
    return docs.withColumn("feed_url", F.concat(F.lit(FX.FEED_BASE), F.regexp_extract("feed_url", "feed=([0-9]+)", 1)))


cte("damaged", f"""
select *, page_id // {PER_FEED} as feed, (page_id // {PER_FEED}) % 6 as kind,
       page_id = max(page_id) over (partition by page_id // {PER_FEED}) as last
from pages""")


@query("feed_recovered", sql=with_ctes(f"""
select 'Feed ' || cast(feed as varchar) as source, 'guid-' || cast(page_id as varchar) as guid, url as link,
       regexp_extract(html, '<title>([^<]*)</title>', 1)
         || case kind when {AMPERSAND} then ' & R&D café' when {NESTING} then ' <b>x</i>' || chr(11) else '' end as title,
       {S.strip_html('html')} as content_clean
from damaged where kind in ({WHOLE}, {AMPERSAND}, {NESTING}) or (kind = {CUT} and not last)"""))
def q_feed_recovered(spark, sf_dir):
    """Whole entries before and after the errors of malformed feeds."""
    n = E.normalize_entries(E.flatten_feeds(_damaged_documents(spark, sf_dir)), FX.ingest_ts())
    return n.select("source", "guid", "link", "title", "content_clean")


@query("feed_failures", sql=with_ctes(f"""
select '{FX.FEED_BASE}' || cast(feed as varchar) as feed_url,
       count(*) filter (where kind in ({WHOLE}, {AMPERSAND}, {NESTING}) or (kind = {CUT} and not last)) as n_entries,
       n_entries = 0 and any_value(kind) in ({CUT}, {LOST}, {ABSENT}) as failed
from damaged group by feed"""))
def q_feed_failures(spark, sf_dir):
    """Feeds without a whole entry, cut off or absent, fail; malformed ones with entries don't."""
    from corpusflow.sources.feeds import failed_feeds as failures

    feed = F.floor(F.col("page_id") / PER_FEED)
    expected = _page_fields(spark, sf_dir).select(F.concat(F.lit(FX.FEED_BASE), feed.cast("string")).alias("feed_url")).distinct()
    return failures(_damaged_documents(spark, sf_dir), expected).select("feed_url", "n_entries", "failed")
