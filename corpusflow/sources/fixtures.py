"""Domain-shaped views derived from the input tables (see FIXTURES.md).

The input tables are generic; these views give them the shapes the operators
consume: landed feed entries, stored articles, comments, a request log and
training pairs. They are plain projections and equi-joins, so every operator
that reads them scales with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.text import make_preview
from corpusflow.sources.tables import table

# Fixed ingest instant used wherever the reference would read the wall clock.
INGEST_TS = "2026-01-01 00:00:00"
FEED_BASE = "https://feeds.example.invalid/"
ARTICLE_BASE = "https://example.invalid/"
CHAINED_FEED = 5  # the landed entries' feeds are before it, those that chained_entries adds are not


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Rows of a table whose keys run from 0 (from the Parquet footers)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").count()


def ingest_ts() -> Column:
    return F.to_timestamp(F.lit(INGEST_TS))


def _rfc(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def raw_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per landed feed entry, with every missing or dirty case present."""
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    e = table(spark, sf_dir, "events", "event_id", "ts")
    j = p.join(e, p.page_id == e.event_id)
    pid = F.col("page_id")
    feed_no = pid % 5
    content_value = F.when(pid % 3 == 0, F.lit(None)).otherwise(F.col("html"))
    return j.select(
        F.concat(F.lit(FEED_BASE), feed_no.cast("string")).alias("feed_url"),
        F.when(feed_no == 4, F.lit(None)).otherwise(F.concat(F.lit("Feed "), feed_no.cast("string"))).alias("feed_title"),
        feed_no.alias("feed_pos"),
        pid.alias("entry_pos"),
        F.when(pid % 7 == 0, F.lit(None))
        .when(pid % 13 == 0, F.concat(F.lit("guid-"), (pid - 1).cast("string")))
        .otherwise(F.concat(F.lit("guid-"), pid.cast("string")))
        .alias("id"),
        F.lit(None).cast("string").alias("guid"),
        F.when(pid % 11 == 0, F.lit("")).otherwise(F.col("url")).alias("link"),
        F.when(pid % 17 == 0, F.lit(None))
        .when(pid % 37 == 0, F.rpad(F.regexp_extract("html", "<title>([^<]*)</title>", 1), 513, "x"))
        .otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
        .alias("title"),
        F.when(content_value.isNull(), F.array().cast("array<struct<value:string>>"))
        .otherwise(F.array(F.struct(content_value.alias("value"))))
        .alias("content"),
        F.when(pid % 19 == 0, F.lit(None)).otherwise(F.col("html")).alias("summary"),
        F.when(pid % 23 == 0, F.lit(None))
        .when(pid % 29 == 0, F.lit("not a date"))
        .when(pid % 31 == 0, F.concat(_iso(F.col("ts")), F.lit("Z")))
        .otherwise(F.concat(_rfc(F.col("ts")), F.when(pid % 2 == 0, F.lit(" GMT")).otherwise(F.lit(" +0200"))))
        .alias("published"),
        F.concat(_rfc(F.col("ts")), F.lit(" GMT")).alias("updated"),
    )


def chained_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The landed entries, and for every tenth page with a link up to four more in two later feeds that
    share its keys: another guid on its link (1), its guid on a new link (2), the freed link under
    the other guid (3), and then either that guid on the new link, which is a conflict (4), or a third
    guid on the new link (5)."""
    raw = raw_entries(spark, sf_dir)
    base = raw.filter((F.col("entry_pos") % 10 == 3) & (F.col("link") != ""))
    more = base.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f).alias("feed"))
                                                 for k, f in ((1, 5), (2, 5), (3, 6), (4, 6), (5, 6))])).alias("x")).select("*", "x.k", "x.feed")
    more = more.filter((F.col("k") <= 3) | ((F.col("k") == 4) == (F.col("entry_pos") % 20 == 3)))
    number, feed, k = F.col("entry_pos").cast("string"), F.col("feed").cast("string"), F.col("k")
    dated = lambda c: F.when(k != 2, F.col(c))
    changed = {
        "feed_url": F.concat(F.lit(FEED_BASE), feed), "feed_title": F.concat(F.lit("Feed "), feed), "feed_pos": F.col("feed").cast("long"),
        "entry_pos": F.col("entry_pos") + k * 1_000_000,
        "id": F.concat(F.when(k == 2, F.lit("guid-")).when(k == 5, F.lit("late-")).otherwise(F.lit("alt-")), number),
        "link": F.when(k.isin(2, 4, 5), F.concat("link", F.lit("#moved"))).otherwise(F.col("link")),
        "title": F.concat("title", F.lit(" ("), k.cast("string"), F.lit(")")), "published": dated("published"), "updated": dated("updated"),
    }
    return raw.unionByName(more.select(*[changed.get(c, F.col(c)).alias(c) for c in raw.columns]))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored article table: documents joined to an event time and a vector."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    e = table(spark, sf_dir, "events", "event_id", "ts")
    v = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    j = d.join(e, d.doc_id == e.event_id).join(v, v.vec_id == d.doc_id % row_count(spark, sf_dir, "embeddings"))
    return j.select(
        F.col("doc_id").alias("id"),
        F.col("source"),
        F.concat(F.lit("guid-"), F.col("doc_id").cast("string")).alias("rss_guid"),
        F.substring("text", 1, 60).alias("title"),
        F.concat(F.lit(ARTICLE_BASE), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("content"),
        make_preview(F.col("text")).alias("content_preview"),
        F.col("ts").cast("timestamp").alias("published_at"),
        F.col("embedding"),
        ingest_ts().alias("created_at"),
        ingest_ts().alias("updated_at"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("article_id"),
        F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("role")).alias("author_name"),
        F.col("text").alias("body"),
        ingest_ts().alias("created_at"),
    )


def comment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming comment payloads: one per conversation turn, aimed at a spread of article
    ids (some beyond the table, for the missing-article path), with raw author and body."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("request_id"),
        (F.col("conv_id") * 13 + F.col("turn")).alias("article_id"),
        F.when(F.col("role") == "system", F.lit(""))
        .when(F.col("role") == "user", F.lit(None))
        .otherwise(F.concat(F.col("role"), F.lit("-"), F.col("conv_id").cast("string")))
        .alias("author_name"),
        F.when(F.col("turn") % 5 == 4, F.when(F.col("conv_id") % 2 == 0, F.lit("   ")).otherwise(F.lit("\n\t\u00a0 ")))
        .when(F.col("conv_id") % 3 == 1, F.concat(F.lit("\t\u00a0"), F.col("text"), F.lit("\r\n")))
        .otherwise(F.concat(F.lit(" "), F.col("text"), F.lit(" ")))
        .alias("body"),
    )


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    return ev.select(
        "event_id",
        "ts",
        F.when(F.col("event_type").isin("view", "click"), F.lit("read"))
        .when(F.col("event_type") == "purchase", F.lit("comment"))
        .when(F.col("event_type") == "signup", F.lit("reindex"))
        .otherwise(F.lit("ingest"))
        .alias("operation"),
        (F.col("value") * 10).alias("latency_ms"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("is_error"),
    )


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(dataset, pair_id, texts)``: consecutive user -> assistant turns. Datasets
    ``conv0`` and ``conv1`` are pairs; ``conv2`` rows are triplets with a benchmark
    passage as the negative."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    b = table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("text", "neg")
    q = c.filter(F.col("role") == "user").alias("q")
    a = c.filter(F.col("role") == "assistant").alias("a")
    qa = q.join(a, (F.col("q.conv_id") == F.col("a.conv_id")) & (F.col("a.turn") == F.col("q.turn") + 1))
    qa = qa.select(
        F.col("q.conv_id").alias("conv_id"),
        F.col("q.turn").alias("turn"),
        F.col("q.text").alias("anchor"),
        F.col("a.text").alias("positive"),
    )
    qa = qa.join(b, b.item_id == qa.conv_id % row_count(spark, sf_dir, "benchmark"), "left")
    ds = F.concat(F.lit("conv"), (F.col("conv_id") % 3).cast("string"))
    return qa.select(
        ds.alias("dataset"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.when(F.col("conv_id") % 3 == 2, F.array("anchor", "positive", "neg"))
        .otherwise(F.array("anchor", "positive"))
        .alias("texts"),
    )


# Dataset weights of the training manifest (name, weight), in order.
PAIR_WEIGHTS = (("conv0", 5), ("conv1", 3), ("conv2", 1))


def feed_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated feed-list settings, with blanks and padding, one per page row."""
    p = table(spark, sf_dir, "pages", "page_id", "url")
    return p.select(
        F.col("page_id").alias("config_id"),
        F.concat(F.lit(" "), F.col("url"), F.lit(" ,, "), F.lit(FEED_BASE), (F.col("page_id") % 7).cast("string"), F.lit(" , "))
        .alias("rss_feeds"),
    )


def feed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed feed documents: one fetch per page row, holding one or two entries."""
    p = table(spark, sf_dir, "pages", "page_id", "url", "html")
    pid = F.col("page_id")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)

    def entry(t):
        return F.struct(
            F.concat(F.lit("guid-"), pid.cast("string")).alias("id"),
            F.lit(None).cast("string").alias("guid"),
            F.col("url").alias("link"),
            t.alias("title"),
        )

    return p.select(
        pid.alias("doc_id"),
        F.concat(F.lit(FEED_BASE), (pid % 5).cast("string")).alias("feed_url"),
        F.when(pid % 4 == 0, F.array(entry(title), entry(F.concat(title, F.lit(" (rev)"))))).otherwise(F.array(entry(title))).alias(
            "entries"
        ),
    )
