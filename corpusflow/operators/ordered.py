"""Ordered upsert of entries that share keys.

Entries are applied one after the other, in feed order then entry order, to the stored articles:
an entry finds its article by guid, else by link, and gives it its link and its content; the
article keeps its first guid. Without an article it becomes a new one. An entry whose guid and
link belong to two different articles is a conflict and changes nothing. Every entry sees what
those before it did, also within one batch.

Only entries that share a guid or a link with others need that order. All entries are first
reduced to distinct (guid, link) pairs; a pair whose guid and link occur in no other pair, of the
batch or of a stored article, is settled by its last entry alone. The others fall into connected
components over guids and links, and each component is folded in order on narrow rows (keys and
positions). Before the fold, every task replaces runs of neighbouring entries that differ only in
a link (or a guid) of their own by the first and the last of the run, so one guid or link that
holds a large part of the batch reaches the fold as a few rows per task. The fold streams sorted
rows and keeps the keys of one component at a time. The joins are left to adaptive execution, which
broadcasts a side once its size is known and splits hot keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.components import connected_components
from corpusflow.session import materialize

POS = "struct<feed_pos: bigint, entry_pos: bigint, h: bigint>"
RUN_SCHEMA = f"comp long, id long, first {POS}, last {POS}, ok {POS}, guid string, link string, guid2 string, link2 string, n long"
OUTCOME_SCHEMA = f"id long, guid string, link string, first {POS}, last {POS}, ok {POS}, conflict boolean"


def _node(kind: str, key: Column) -> Column:
    return F.xxhash64(F.lit(kind), key)


def _shared(edges: DataFrame, key: str) -> DataFrame:
    """Keys that occur in more than one distinct pair."""
    n = edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.select(F.col(key).alias(f"_{key}"))


def _flagged(df: DataFrame, guids: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``gs`` and ``ls``: whether the row's guid and link occur in several pairs."""
    j = df.join(guids, F.col("guid") == F.col("_guid"), "left").join(links, F.col("link") == F.col("_link"), "left")
    return j.withColumn("gs", F.col("_guid").isNotNull()).withColumn("ls", F.col("_link").isNotNull()).drop("_guid", "_link")


def _components(flagged_edges: DataFrame) -> DataFrame:
    """Components over the keys that occur in several pairs: ``(_node, _comp)``. Pairs with a key
    of their own join nothing, so only pairs of two shared keys are edges."""
    edges = flagged_edges.filter("gs and ls").select(_node("g", F.col("guid")).alias("a"), _node("l", F.col("link")).alias("b"))
    return connected_components(edges).select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))


def _with_comp(flagged: DataFrame, comps: DataFrame) -> DataFrame:
    node = F.when(F.col("gs"), _node("g", F.col("guid"))).otherwise(_node("l", F.col("link")))
    j = flagged.withColumn("_key", node).join(comps, F.col("_key") == F.col("_node"), "left")
    return j.withColumn("comp", F.coalesce("_comp", "_key")).drop("_key", "_node", "_comp")


def compress_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (comp, pos) to runs of one component and one ``run_key``: the first and the
    last entry, and the last with a date of its own. A run cut by the end of a batch is two runs."""
    for b in batches:
        if not b.num_rows:
            continue
        comp = np.asarray(b.column("comp"))
        key = np.asarray(b.column("run_key").to_pylist(), dtype=object)
        new = np.ones(b.num_rows, bool)
        new[1:] = (comp[1:] != comp[:-1]) | (key[1:] != key[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], b.num_rows) - 1
        ok = np.maximum.accumulate(np.where(np.asarray(b.column("published_ok").to_pylist(), dtype=bool), np.arange(b.num_rows), -1))[last]
        none = pa.array([None] * len(first), pa.int64())
        pos, guid, link = b.column("pos"), b.column("guid"), b.column("link")
        yield pa.RecordBatch.from_arrays(
            [pa.array(comp[first]), none, pos.take(pa.array(first)), pos.take(pa.array(last)), pos.take(pa.array(ok, mask=ok < first)),
             guid.take(pa.array(first)), link.take(pa.array(first)), guid.take(pa.array(last)), link.take(pa.array(last)),
             pa.array(last - first + 1)],
            ["comp", "id", "first", "last", "ok", "guid", "link", "guid2", "link2", "n"])


class Fold:
    """Articles of one component while its entries are applied."""

    def __init__(self) -> None:
        self.by_guid: dict[str, dict] = {}
        self.by_link: dict[str, dict] = {}
        self.conflicts: list[dict] = []

    def store(self, row: dict) -> None:
        a = {"id": row["id"], "guid": row["guid"], "link": row["link"], "first": None, "last": None, "ok": None}
        self.by_guid[a["guid"]] = self.by_link[a["link"]] = a

    def _article(self, guid: str, link: str) -> dict | None:
        """The article that takes the entry, with its link; None if the keys are two articles'."""
        a, other = self.by_guid.get(guid), self.by_link.get(link)
        if a is None and other is None:
            a = {"id": None, "guid": guid, "link": link, "first": None, "last": None, "ok": None}
            self.by_guid[guid] = self.by_link[link] = a
        elif a is None:
            a = other
        elif other is None:
            del self.by_link[a["link"]]
            a["link"] = link
            self.by_link[link] = a
        elif other is not a:
            return None
        return a

    def apply(self, run: dict) -> None:
        a = self._article(run["guid"], run["link"])
        if a is None:
            # only equal pairs make a run with a shared guid and a shared link: all of it conflicts
            self.conflicts.append({**run, "id": None, "ok": None, "conflict": True})
            return
        a["first"] = a["first"] or run["first"]
        if run["n"] > 1:
            a = self._article(run["guid2"], run["link2"])
        a["last"], a["ok"] = run["last"], run["ok"] or a["ok"]

    def outcomes(self) -> Iterator[dict]:
        for a in self.by_guid.values():
            if a["last"] is not None:
                yield {**a, "conflict": False}
        yield from self.conflicts


def fold_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (comp, first), stored articles (no position) before entries, to outcomes."""
    schema = pa.schema([("id", pa.int64()), ("guid", pa.string()), ("link", pa.string()),
                        *[(c, pa.struct([("feed_pos", pa.int64()), ("entry_pos", pa.int64()), ("h", pa.int64())])) for c in ("first", "last", "ok")],
                        ("conflict", pa.bool_())])
    names = schema.names
    comp, fold, out = None, Fold(), []

    def flush(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema)

    for b in batches:
        for row in b.to_pylist():
            if row["comp"] != comp:
                out += fold.outcomes()
                comp, fold = row["comp"], Fold()
            if row["first"] is None:
                fold.store(row)
            else:
                fold.apply(row)
            if len(out) >= 10_000:
                yield flush(out)
                out = []
    yield flush([*out, *fold.outcomes()])


def _settled(rows: DataFrame, pairs: DataFrame, strict_rfc: bool) -> DataFrame:
    """The last entry of each of ``pairs``, which share no key; without a date of its own, with the
    date of the last entry that has one."""
    last = rows.join(pairs, ["guid", "link"]).filter(F.col("pos") == F.col("last")).dropDuplicates(["guid", "link"])
    if not strict_rfc:
        # a later entry without a readable date keeps the date that an earlier one gave
        last = last.withColumn("published_at", F.when(F.col("published_ok"), F.col("published_at")).otherwise(
            F.coalesce("ok_date.published_at", "published_at"))).withColumn("published_ok", F.col("ok_date").isNotNull())
    return last.drop("ok_date", "last", "pos")


def resolve_entries(valid: DataFrame, found_for: Callable[[DataFrame], DataFrame], strict_rfc: bool = False) -> DataFrame:
    """What a batch of valid entries comes to: one row per touched article and per conflicting entry.

    The rows have the entries' columns, with the article's own guid, its last link and the content of
    the entry applied last, then ``ex_id`` (the stored article, null for a new one), ``match_by`` (how
    the last entry found it), ``conflict``, ``first_feed_pos`` and ``first_entry_pos`` (of the entry
    applied first, which orders new ids). ``found_for`` maps a frame of (guid, link) to the stored
    rows (id, rss_guid, url) that have one of the guids or links.

    Equal rows count once; rows at one position are ordered by a hash of their fields. Without
    ``strict_rfc`` an entry whose date can't be read leaves the article's date as it is. Null positions
    come first. An empty batch gives no rows.
    """
    columns = valid.columns
    pos = F.struct(F.col("feed_pos").cast("long").alias("feed_pos"), F.col("entry_pos").cast("long").alias("entry_pos"),
                   F.xxhash64(*columns).alias("h"))
    rows = valid.withColumn("pos", pos)
    # keys and positions only: the rows themselves are joined again at the end
    pairs = materialize(rows.groupBy("guid", "link").agg(
        F.max("pos").alias("last"), F.min("pos").alias("first"),
        F.max(F.when(F.col("published_ok"), F.struct("pos", "published_at"))).alias("ok_date")))
    found = materialize(found_for(pairs.select("guid", "link")).select("id", F.col("rss_guid").alias("guid"), F.col("url").alias("link")))
    edges = pairs.select("guid", "link").unionByName(found.select("guid", "link")).distinct()
    edges = materialize(_flagged(edges, _shared(edges, "guid"), _shared(edges, "link")))
    pair = ["guid", "link"]
    tied = edges.filter("gs or ls")
    none_tied = tied.isEmpty()
    # settled by the last entry: the pair's guid and link are nobody else's
    same = found.select(F.col("guid").alias("_g"), F.col("link").alias("_l"), F.col("id").alias("ex_id"))
    alone = _settled(rows, pairs if none_tied else pairs.join(tied, pair, "left_anti"), strict_rfc)
    alone = alone.join(same, (F.col("guid") == F.col("_g")) & (F.col("link") == F.col("_l")), "left")
    alone = alone.withColumn("match_by", F.when(F.col("ex_id").isNotNull(), F.lit("guid"))).withColumn("conflict", F.lit(False))
    out = [*columns, "ex_id", "match_by", "conflict", F.col("first.feed_pos").alias("first_feed_pos"),
           F.col("first.entry_pos").alias("first_entry_pos")]
    alone = alone.select(*out)
    if none_tied:
        return alone

    tied = materialize(_with_comp(tied, _components(edges)))
    shared = rows.select("pos", "guid", "link", "published_ok").join(tied, pair)
    # an entry with a link of its own changes nothing that its guid's next entry does not change
    # again, and one with a guid of its own nothing that its link's next one does not
    run_key = F.when(~F.col("ls"), F.concat(F.lit("g"), F.col("guid"))).when(~F.col("gs"), F.concat(F.lit("l"), F.col("link"))).otherwise(
        F.concat(F.lit("p"), F.char_length("guid").cast("string"), F.lit(":"), F.col("guid"), F.col("link")))
    slim = materialize(shared.select("comp", run_key.alias("run_key"), "pos", "guid", "link", "published_ok"))
    runs = slim.repartitionByRange("pos").sortWithinPartitions("comp", "pos").mapInArrow(compress_runs, RUN_SCHEMA)
    nothing = F.lit(None)
    stored = found.join(tied, pair).select(
        "comp", "id", *[nothing.cast(POS).alias(c) for c in ("first", "last", "ok")], "guid", "link",
        nothing.cast("string").alias("guid2"), nothing.cast("string").alias("link2"), F.lit(0).cast("long").alias("n"))
    outcomes = materialize(runs.unionByName(stored).repartition("comp").sortWithinPartitions("comp", "first").mapInArrow(
        fold_components, OUTCOME_SCHEMA))

    # back to the whole rows: those applied last, their dates, and the conflicting ones
    done = outcomes.filter("not conflict").select(F.col("id").alias("ex_id"), F.col("guid").alias("_g"), "first", "last", "ok")
    whole = rows.join(done, F.col("pos") == F.col("last")).dropDuplicates(["_g", "pos"])
    if not strict_rfc:
        dates = rows.select(F.col("pos").alias("_p"), F.col("published_at").alias("_date"))
        dates = dates.join(outcomes.select("ok").filter("ok is not null").distinct(),
                           F.col("_p") == F.col("ok"), "left_semi").distinct()
        whole = whole.join(dates, F.col("ok") == F.col("_p"), "left")
        whole = whole.withColumn("published_at", F.coalesce("_date", "published_at")).withColumn("published_ok", F.col("_p").isNotNull())
    match_by = F.when(F.col("ex_id").isNotNull(), F.when(F.col("guid") == F.col("_g"), F.lit("guid")).otherwise(F.lit("url")))
    whole = whole.withColumn("match_by", match_by).withColumn("guid", F.col("_g")).withColumn("conflict", F.lit(False)).select(*out)
    bad = outcomes.filter("conflict").select(F.col("guid").alias("_g"), F.col("link").alias("_l"), F.col("first").alias("_first"), F.col("last").alias("_last"))
    refused = rows.join(bad, (F.col("guid") == F.col("_g")) & (F.col("link") == F.col("_l"))
                        & (F.col("pos") >= F.col("_first")) & (F.col("pos") <= F.col("_last"))).dropDuplicates(["guid", "link", "pos"])
    refused = refused.withColumn("ex_id", nothing.cast("long")).withColumn("match_by", nothing.cast("string")).withColumn(
        "conflict", F.lit(True)).withColumn("first", F.col("pos")).select(*out)
    return alone.unionByName(whole).unionByName(refused)
