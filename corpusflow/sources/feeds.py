"""Landed RSS / Atom feed files -> feed documents with nested entries.

One row per feed file (``rowTag`` ``channel`` for RSS, ``feed`` for Atom, ``rdf:RDF`` for RSS 1.0), read with an
explicit schema (never inferred) so the entry struct is stable. RSS ``item`` and Atom
``entry`` are mapped to the entry fields the normaliser reads:
``id, guid, link, title, content array<struct<value>>, summary, published, updated``.
A file with an XML error is read again by a scanner that recovers its whole entries
(:mod:`corpusflow.sources.recover`); one without any becomes a feed with ``failed = true``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.operators.joins import broadcast_if_small
from corpusflow.session import materialize
from corpusflow.sources.recover import recover

RSS_SCHEMA = (
    "title string, item array<struct<guid: string, link: string, title: string, description: string, "
    "`content:encoded`: string, pubDate: string>>, _corrupt_record string"
)
ATOM_SCHEMA = (
    "title string, entry array<struct<id: string, link: array<struct<_href: string, _rel: string>>, title: string, "
    "summary: string, content: string, published: string, updated: string>>, _corrupt_record string"
)
RDF_SCHEMA = (
    "channel struct<title: string>, item array<struct<`_rdf:about`: string, link: string, title: string, "
    "description: string, `content:encoded`: string, `dc:date`: string>>, _corrupt_record string"
)
ENTRY_TYPE = (
    "array<struct<id: string, guid: string, link: string, title: string, content: array<struct<value: string>>, "
    "summary: string, published: string, updated: string>>"
)


def _read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("mode", "PERMISSIVE")
        .option("ignoreSurroundingSpaces", "false")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(schema)
        .load(path)
        .withColumn("feed_url", F.input_file_name())
    )


DOCUMENT_SCHEMA = f"feed_url string, feed_title string, entries {ENTRY_TYPE}, failed boolean"


def _documents(df: DataFrame, title, entries) -> DataFrame:
    """Feed documents of parsed files, parsed once. For a file with an error the reader keeps the
    whole text as the corrupt record; what it had read before the error is read again from there."""
    parsed = materialize(df.select("feed_url", title.alias("feed_title"), entries.cast(ENTRY_TYPE).alias("entries"),
                                   F.col("_corrupt_record").alias("text")))
    whole = parsed.filter("text is null").select("feed_url", "feed_title", "entries", F.lit(False).alias("failed"))
    damaged = parsed.filter("text is not null").select("feed_url", "text")
    if damaged.isEmpty():
        return whole
    damaged = damaged.groupBy("feed_url").agg(F.max_by("text", F.char_length("text")).alias("text"))
    whole = whole.join(broadcast_if_small(damaged.select("feed_url")), "feed_url", "left_anti")
    return whole.unionByName(damaged.mapInArrow(recover, DOCUMENT_SCHEMA))


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """``(feed_url, length)`` of the files below ``path``, without reading contents. Spark passes over
    files of no bytes; like absent ones they only show against a list of the feeds that should land."""
    return spark.read.format("binaryFile").load(path).select(F.input_file_name().alias("feed_url"), "length")


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, "channel", RSS_SCHEMA)
    entries = F.transform(
        F.coalesce("item", F.array()),
        lambda i: F.struct(
            F.lit(None).cast("string").alias("id"),
            i["guid"].alias("guid"),
            i["link"].alias("link"),
            i["title"].alias("title"),
            F.when(i.getField("content:encoded").isNotNull(), F.array(F.struct(i.getField("content:encoded").alias("value"))))
            .otherwise(F.array().cast("array<struct<value:string>>")).alias("content"),
            i["description"].alias("summary"),
            i["pubDate"].alias("published"),
            F.lit(None).cast("string").alias("updated"),
        ),
    )
    return _documents(df, F.col("title"), entries)


def read_rdf(spark: SparkSession, path: str) -> DataFrame:
    """RSS 1.0: items stand beside the channel, are named by ``rdf:about`` and dated by ``dc:date``."""
    df = _read(spark, path, "rdf:RDF", RDF_SCHEMA)
    entries = F.transform(
        F.coalesce("item", F.array()),
        lambda i: F.struct(
            i.getField("_rdf:about").alias("id"),
            F.lit(None).cast("string").alias("guid"),
            i["link"].alias("link"),
            i["title"].alias("title"),
            F.when(i.getField("content:encoded").isNotNull(), F.array(F.struct(i.getField("content:encoded").alias("value"))))
            .otherwise(F.array().cast("array<struct<value:string>>")).alias("content"),
            i["description"].alias("summary"),
            F.lit(None).cast("string").alias("published"),
            i.getField("dc:date").alias("updated"),
        ),
    )
    return _documents(df, F.col("channel.title"), entries)


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path, "feed", ATOM_SCHEMA)

    def href(links):
        alt = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        return F.get(F.coalesce(alt, F.array()), 0)["_href"]

    entries = F.transform(
        F.coalesce("entry", F.array()),
        lambda e: F.struct(
            e["id"].alias("id"),
            F.lit(None).cast("string").alias("guid"),
            href(e["link"]).alias("link"),
            e["title"].alias("title"),
            # escaped html, plain text, or the markup of an XHTML body
            F.when(e["content"].isNotNull(), F.array(F.struct(e["content"].alias("value"))))
            .otherwise(F.array().cast("array<struct<value:string>>")).alias("content"),
            e["summary"].alias("summary"),
            e["published"].alias("published"),
            e["updated"].alias("updated"),
        ),
    )
    return _documents(df, F.col("title"), entries)


def feed_documents(spark: SparkSession, rss_path: str | None = None, atom_path: str | None = None,
                   feed_order: DataFrame | None = None, rdf_path: str | None = None) -> DataFrame:
    """All landed feed documents with ``feed_pos``: the position in ``feed_order``
    (``feed_url, pos``, e.g. the exploded feed list) or, without it, file-name order."""
    parts = []
    if rss_path:
        parts.append(read_rss(spark, rss_path))
    if atom_path:
        parts.append(read_atom(spark, atom_path))
    if rdf_path:
        parts.append(read_rdf(spark, rdf_path))
    if not parts:
        raise ValueError("no feed path given")
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    if feed_order is not None:
        order = feed_order.select("feed_url", F.col("pos").alias("feed_pos"))
        return docs.join(broadcast_if_small(order), "feed_url", "left")
    # file order over the distinct names only: one short row per feed, not the documents
    names = docs.select("feed_url").distinct().withColumn("feed_pos", F.row_number().over(Window.orderBy("feed_url")) - 1)
    return docs.join(broadcast_if_small(names), "feed_url", "left")


def failed_feeds(docs: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """A feed fails when its file holds no feed and no whole entry, or (with ``expected`` feed
    URLs: the feed list or :func:`landed_files`) when nothing was read for it: its file is
    absent, empty or no feed at all. A feed without entries, or one whose entries before and after
    an error could be read, does not fail."""
    per = docs.groupBy("feed_url").agg(
        F.sum(F.size("entries")).alias("n_entries"), F.max(F.col("failed").cast("int")).alias("_bad")
    ).withColumn("failed", (F.col("_bad") == 1) & (F.col("n_entries") == 0)).drop("_bad")
    if expected is None:
        return per
    exp = expected.select("feed_url").distinct()
    return exp.join(per, "feed_url", "left").select(
        "feed_url", F.coalesce("n_entries", F.lit(0)).alias("n_entries"), F.coalesce("failed", F.lit(True)).alias("failed")
    )
