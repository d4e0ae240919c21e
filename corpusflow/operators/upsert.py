"""Keyed change detection and snapshot upsert of normalised entries into the article table.

Flow: match (guid first, then url) -> classify (insert / update / unchanged / conflict)
-> embed only what changed -> new snapshot = untouched + updated + inserted. With
``ordered`` a batch may hold several entries of one article: they are applied in feed order
(:mod:`corpusflow.operators.ordered`); without it the batch must be de-duplicated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import embedding_text
from corpusflow.operators.embed import Embedder, embed
from corpusflow.operators.ids import assign_ids
from corpusflow.operators.joins import broadcast_if_small
from corpusflow.operators.ordered import resolve_entries
from corpusflow.session import materialize

ARTICLE_COLUMNS = (
    "id", "source", "rss_guid", "title", "url", "content", "content_preview",
    "published_at", "embedding", "created_at", "updated_at",
)
_MATCH_COLS = ("id", "source", "rss_guid", "title", "url", "content", "content_preview", "published_at",
               "embedding", "created_at")
ACTIONS = ("insert", "update", "unchanged", "conflict")


Lookup = Callable[[DataFrame], DataFrame]


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in _MATCH_COLS])


def stored_hits(keys: DataFrame, existing: DataFrame, lookup: Lookup | None = None, by_key: Lookup | None = None) -> DataFrame:
    """The stored rows that have one of the batch's guids or links: through ``by_key``
    (``KeyIndex.lookup``), which reads the index buckets of these keys and the parts they name, or
    else by one scan of the stored table's key columns."""
    if by_key is not None:
        return materialize(by_key(keys.select("guid", "link")).select(*_MATCH_COLS))
    # the incoming batch is usually far smaller than the stored table: broadcast its keys
    # (size-checked) so the stored table is filtered in place instead of shuffled
    keys = materialize(keys.select("guid", "link"))
    guids = broadcast_if_small(keys.select(F.col("guid").alias("_g")).distinct(), ready=True)
    links = broadcast_if_small(keys.select(F.col("link").alias("_l")).distinct(), ready=True)
    slim = existing.select("id", "rss_guid", "url")
    slim = slim.join(guids, slim.rss_guid == guids._g, "left").join(links, slim.url == links._l, "left")
    ids = materialize(slim.filter("_g is not null or _l is not null").select("id"))
    if lookup is None:
        found = existing.join(broadcast_if_small(ids, ready=True), "id", "left_semi")
    else:
        found = lookup(ids)
    return materialize(found.select(*_MATCH_COLS))


def match_existing(entries: DataFrame, existing: DataFrame, lookup: Lookup | None = None) -> DataFrame:
    """Attach the stored row matched by guid, else by url.

    One scan of the stored table's three key columns finds the ids that the incoming keys
    hit (filtered in place, not shuffled, while the key sets are small). Whole rows are read
    for those ids only: ``lookup`` maps a frame of ids to them, as ``SnapshotStore.rows``
    does from the touched parts; without it the stored table is semi-joined. Two equi left
    joins follow; an ``OR`` join condition would plan as a nested loop. Adds ``ex_*``
    columns, ``match_by`` and ``conflict``.
    """
    found = stored_hits(entries, existing, lookup)
    by_guid, by_url = _prefixed(found, "g_"), _prefixed(found, "u_")
    # a url match whose stored guid is also claimed by another incoming entry cannot be applied
    taken = entries.select(F.col("guid").alias("_taken_guid"))
    by_url = by_url.join(taken, by_url.u_rss_guid == taken._taken_guid, "left").withColumn(
        "u_guid_taken", F.col("_taken_guid").isNotNull()
    ).drop("_taken_guid")
    m = entries.join(by_guid, entries.guid == by_guid.g_rss_guid, "left").join(by_url, entries.link == by_url.u_url, "left")
    g = F.col("g_id").isNotNull()
    u = F.col("u_id").isNotNull()
    cols = [F.when(g, F.col("g_" + c)).otherwise(F.col("u_" + c)).alias("ex_" + c) for c in _MATCH_COLS]
    conflict = (g & u & (F.col("g_id") != F.col("u_id"))) | (~g & u & F.col("u_guid_taken"))
    return m.select(
        *entries.columns,
        *cols,
        F.when(g, F.lit("guid")).when(u, F.lit("url")).alias("match_by"),
        conflict.alias("conflict"),
    )


def match_ordered(entries: DataFrame, existing: DataFrame, lookup: Lookup | None = None, strict_rfc: bool = False,
                  by_key: Lookup | None = None) -> DataFrame:
    """Entries that may share keys, applied in feed order: one row per touched article and
    per conflicting entry, with the columns of :func:`match_existing`."""
    hits = []

    def found_for(keys: DataFrame) -> DataFrame:
        hits.append(stored_hits(keys, existing, lookup, by_key))
        return hits[0]

    resolved = resolve_entries(entries, found_for, strict_rfc)
    return resolved.join(_prefixed(hits[0], "ex_").withColumnRenamed("ex_id", "_id"), F.col("ex_id") == F.col("_id"), "left").drop("_id")


def classify(matched: DataFrame, strict_rfc: bool = False) -> DataFrame:
    """``action`` in insert / update / unchanged / conflict.

    Compared: source, title, url, content, published_at, preview (null-safe). Unless
    ``strict_rfc``, an unparsable date on an existing row keeps the stored date instead of
    the ingest time, so re-ingesting does not rewrite the row.
    """
    matched_row = F.col("ex_id").isNotNull()
    pub = F.col("published_at")
    if not strict_rfc:
        pub = F.when(~F.col("published_ok") & matched_row, F.col("ex_published_at")).otherwise(pub)
    same = (
        F.col("ex_source").eqNullSafe(F.col("source"))
        & F.col("ex_title").eqNullSafe(F.col("title"))
        & F.col("ex_url").eqNullSafe(F.col("link"))
        & F.col("ex_content").eqNullSafe(F.col("content_clean"))
        & F.col("ex_published_at").eqNullSafe(pub)
        & F.col("ex_content_preview").eqNullSafe(F.col("content_preview"))
    )
    action = (
        F.when(F.col("conflict"), F.lit("conflict"))
        .when(~matched_row, F.lit("insert"))
        .when(~same, F.lit("update"))
        .otherwise(F.lit("unchanged"))
    )
    # re-embed only when the embedding text (title + content) changed
    text_changed = ~(F.col("ex_title").eqNullSafe(F.col("title")) & F.col("ex_content").eqNullSafe(F.col("content_clean")))
    return matched.withColumn("published_at", pub).withColumn("action", action).withColumn(
        "needs_embedding", (action == "insert") | ((action == "update") & text_changed)
    )


def changed_rows(classified: DataFrame, ingest_ts: Column, base_id: Column, embedder: Embedder | None = None,
                 dim: int = 64) -> DataFrame:
    """The inserted and updated article rows, with new ids and embeddings where needed."""
    work = classified.filter(F.col("action").isin("insert", "update"))
    to_embed = work.filter("needs_embedding").withColumn("_etext", embedding_text(F.col("title"), F.col("content_clean")))
    embedded = embed(to_embed, "_etext", "_new_embedding", embedder, dim).drop("_etext")
    kept = work.filter(~F.col("needs_embedding")).withColumn("_new_embedding", F.col("ex_embedding"))
    work = embedded.unionByName(kept)
    ins = work.filter(F.col("action") == "insert")
    upd = work.filter(F.col("action") == "update")
    at = ("first_feed_pos", "first_entry_pos") if "first_feed_pos" in classified.columns else ("feed_pos", "entry_pos")
    ins = assign_ids(ins, F.col(at[0]).cast("long") * F.lit(1 << 32) + F.col(at[1]), base_id, out="_new_id")
    ins = ins.select(
        F.col("_new_id").alias("id"), "source", F.col("guid").alias("rss_guid"), "title", F.col("link").alias("url"),
        F.col("content_clean").alias("content"), "content_preview", "published_at",
        F.col("_new_embedding").alias("embedding"), ingest_ts.alias("created_at"), ingest_ts.alias("updated_at"),
    )
    # a url match keeps the stored guid
    upd = upd.select(
        F.col("ex_id").alias("id"), "source", F.col("ex_rss_guid").alias("rss_guid"), "title", F.col("link").alias("url"),
        F.col("content_clean").alias("content"), "content_preview", "published_at",
        F.col("_new_embedding").alias("embedding"), F.col("ex_created_at").alias("created_at"), ingest_ts.alias("updated_at"),
    )
    return ins.unionByName(upd)


def classify_batch(existing: DataFrame, entries: DataFrame, strict_rfc: bool = False,
                   materialize_batch: bool = True, lookup: Lookup | None = None, ordered: bool = False,
                   by_key: Lookup | None = None) -> DataFrame:
    """Match and classify a batch; checkpointed because the changes, the untouched-row
    filter and the counters all read it."""
    matched = match_ordered(entries, existing, lookup, strict_rfc, by_key) if ordered else match_existing(entries, existing, lookup)
    # what was compared is not stored again: the stored text stays out of the checkpoint
    classified = classify(matched, strict_rfc).drop(*[f"ex_{c}" for c in ("source", "title", "url", "content", "content_preview", "published_at")])
    return materialize(classified) if materialize_batch else classified


def plan_upsert(existing: DataFrame, entries: DataFrame, ingest_ts: Column, embedder: Embedder | None = None,
                strict_rfc: bool = False, dim: int = 64, materialize_batch: bool = True,
                max_id: int | None = None, lookup: Lookup | None = None, ordered: bool = False,
                by_key: Lookup | None = None) -> tuple[DataFrame, DataFrame]:
    """Returns ``(classified, changes)``: per-entry actions and the full inserted/updated rows.

    The classified batch feeds the changes, the untouched-row filter and the counters, so
    it is checkpointed once (``materialize_batch``) instead of being recomputed per use.
    """
    classified = classify_batch(existing, entries, strict_rfc, materialize_batch, lookup, ordered, by_key)
    # the highest stored id: from the store's manifest when known, else one pruned scan
    base = F.lit(max_id).cast("long") if max_id is not None else existing.select(
        F.coalesce(F.max("id"), F.lit(0)).cast("long")).scalar()
    changes = changed_rows(classified, ingest_ts, base, embedder, dim).select(*ARTICLE_COLUMNS)
    # read by the size check, the untouched-row filter, the union and the store commit:
    # embed and number once
    return classified, (materialize(changes) if materialize_batch else changes)


def apply_changes(existing: DataFrame, changes: DataFrame) -> DataFrame:
    """Next snapshot = untouched stored rows + changed rows."""
    untouched = existing.join(broadcast_if_small(changes.select("id"), ready=True), "id", "left_anti")
    return untouched.select(*ARTICLE_COLUMNS).unionByName(changes.select(*ARTICLE_COLUMNS))


def upsert(existing: DataFrame, entries: DataFrame, ingest_ts: Column, embedder: Embedder | None = None,
           strict_rfc: bool = False, dim: int = 64, materialize_batch: bool = True,
           ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """Returns ``(snapshot, classified)``: the full next snapshot and the per-entry actions."""
    classified, changes = plan_upsert(existing, entries, ingest_ts, embedder, strict_rfc, dim, materialize_batch, ordered=ordered)
    return apply_changes(existing, changes), classified


def ingest_metrics(classified: DataFrame, rejected: DataFrame, failed_feeds: DataFrame) -> DataFrame:
    """A1: one row of counters. ``skipped`` counts rejected entries (always 0 in the
    reference, a bug we fix); ``unchanged`` and ``conflicts`` are reported too."""
    counts = classified.agg(
        F.count_if(F.col("action") == "insert").alias("ingested"),
        F.count_if(F.col("action") == "update").alias("updated"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if(F.col("action") == "conflict").alias("conflicts"),
    )
    skipped = rejected.agg(F.count(F.lit(1)).alias("skipped"))
    failed = failed_feeds.agg(F.sort_array(F.collect_list("feed_url")).alias("failed_feeds"))
    return counts.select(
        "*", skipped.select("skipped").scalar().alias("skipped"), failed.select("failed_feeds").scalar().alias("failed_feeds")
    )
