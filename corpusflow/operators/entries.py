"""Feed entries: flatten, normalise, split valid / rejected, de-duplicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.dates import parse_published
from corpusflow.functions.text import make_preview, strip_html
from corpusflow.operators.articles import length_reason

ENTRY_FIELDS = ("id", "guid", "link", "title", "content", "summary", "published", "updated")


def flatten_feeds(feeds: DataFrame, entries_col: str = "entries") -> DataFrame:
    """One row per entry of every feed document, keeping feed order then entry order.

    ``feeds`` holds ``feed_url, feed_pos, feed_title`` and an ``array<struct>`` of entries.
    """
    keep = [c for c in feeds.columns if c != entries_col]
    return feeds.select(*keep, F.posexplode(entries_col).alias("entry_pos", "entry")).select(
        *keep, "entry_pos", "entry.*"
    )


def resolve_source(feed_title, feed_url) -> Column:
    """The feed title, or the feed URL when the feed has none."""
    return F.coalesce(feed_title, feed_url)


def resolve_guid(id_col, guid_col, link_col) -> Column:
    """``id or guid or link``: empty strings fall through like Python's ``or``."""
    return F.coalesce(F.nullif(id_col, F.lit("")), F.nullif(guid_col, F.lit("")), F.nullif(link_col, F.lit("")))


def entry_content(content_col, summary_col) -> Column:
    """First content value when the entry has content, else the summary."""
    return F.when(F.size(content_col) > 0, F.coalesce(F.get(content_col, 0)["value"], F.lit(""))).otherwise(
        F.coalesce(summary_col, F.lit(""))
    )


def normalize_entries(raw: DataFrame, ingest_ts: Column, strict_rfc: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Resolve keys, title, content, preview and publication time for every entry.

    ``raw`` has ``feed_url, feed_title, feed_pos, entry_pos`` and the entry fields
    ``id, guid, link, title, content array<struct<value>>, summary, published, updated``.
    Output keeps all rows with a ``reject_reason`` (NULL when valid); ``keep`` names extra
    input columns carried through unchanged (e.g. a landing time).
    """
    guid = resolve_guid(F.col("id"), F.col("guid"), F.col("link"))
    reason = (
        F.when(guid.isNull(), F.lit("no_guid"))
        .when(F.col("link").isNull() | (F.col("link") == ""), F.lit("no_link"))
    )
    source = resolve_source(F.col("feed_title"), F.col("feed_url"))
    stored = {"source": "source", "rss_guid": "guid", "title": "title", "url": "link"}
    parsed = parse_published(F.col("published"), F.col("updated"), strict_rfc=strict_rfc)
    base = raw.select(
        *keep,
        "feed_url",
        "feed_pos",
        "entry_pos",
        source.alias("source"),
        guid.alias("guid"),
        F.col("link"),
        F.coalesce(F.col("title"), F.lit("Untitled")).alias("title"),
        strip_html(entry_content(F.col("content"), F.col("summary"))).alias("clean"),
        parsed.alias("published_parsed"),
        reason.alias("reject_reason"),
    )
    return base.select(
        *keep,
        "feed_url",
        "feed_pos",
        "entry_pos",
        "source",
        "guid",
        "link",
        "title",
        F.coalesce(F.nullif(F.col("clean"), F.lit("")), F.lit("No content")).alias("content_clean"),
        # the preview is taken before the 'No content' default, so it stays ''
        make_preview(F.col("clean")).alias("content_preview"),
        F.coalesce(F.col("published_parsed"), ingest_ts).alias("published_at"),
        F.col("published_parsed").isNotNull().alias("published_ok"),
        # longer than the stored column: kept out of the table, with a reason
        F.coalesce("reject_reason", length_reason(stored)).alias("reject_reason"),
    )


def valid_entries(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_entries(normalized: DataFrame) -> DataFrame:
    return normalized.filter(F.col("reject_reason").isNotNull())


def _last_per_key(df: DataFrame, key: str) -> DataFrame:
    """Keep the last occurrence (highest ``feed_pos, entry_pos``) of each key.

    ``max_by`` aggregates partially before the shuffle, so a key that holds a third of
    all rows is reduced to one row per input partition before it moves.
    """
    others = [c for c in df.columns if c != key]
    order = F.struct("feed_pos", "entry_pos")
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_r")).select(key, "_r.*").select(*df.columns)


def dedupe_entries(valid: DataFrame) -> DataFrame:
    """Last write wins, first by guid and then by link (two entries must not share either)."""
    return _last_per_key(_last_per_key(valid, "guid"), "link")
