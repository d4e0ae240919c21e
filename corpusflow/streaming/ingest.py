"""Incremental ingest with Structured Streaming.

Landed feed-entry files are read as a stream; each micro-batch is normalised and its entries
are upserted in feed order into the snapshot store inside ``foreachBatch``. The commit
is keyed by the query's id and the batch number: a batch replayed after a failure is a
no-op, and a second query with a checkpoint of its own never looks like a replay.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow.operators import entries as E
from corpusflow.operators import upsert as U
from corpusflow.operators.embed import Embedder
from corpusflow.session import materialize
from corpusflow.sources.keyindex import KeyIndex
from corpusflow.sources.store import SnapshotStore

RAW_ENTRY_SCHEMA = (
    "feed_url string, feed_title string, feed_pos long, entry_pos long, id string, guid string, link string, "
    "title string, content array<struct<value:string>>, summary string, published string, updated string"
)


ISSUE_COLUMNS = ("feed_url", "feed_pos", "entry_pos", "guid", "link")


def entry_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None,
                 recursive: bool = False) -> DataFrame:
    """Landed entry files as a stream, with ``_landed_at`` (the file's modification time)."""
    r = spark.readStream.schema(RAW_ENTRY_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if recursive:
        r = r.option("recursiveFileLookup", "true")
    return r.parquet(landing).withColumn("_landed_at", F.col("_metadata.file_modification_time"))


def upsert_batch_fn(store: SnapshotStore, ingest_ts: Callable[[], Column], embedder: Embedder | None = None,
                    strict_rfc: bool = False, query_id: Callable[[], str] = lambda: "ingest",
                    key_bits: int = 8, expected: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """``expected`` (feed_url): the feeds that should land entries in every batch; those that
    don't are the batch's failed feeds. ``query_id`` names the streaming query, whose batch numbers start at 0 with its checkpoint.

    Every batch also writes its counters and its rejected and conflicting entries below the
    store (``store.runs("counters")``, ``store.runs("issues")``). They are written before the
    commit: a batch that is lost in between is planned again and writes them again. Stored articles
    are found through the key index below the store; a store that was filled without a stream needs
    ``KeyIndex.add(store.read())`` once."""

    index = KeyIndex(store.spark, f"{store.root}/_keys", key_bits)

    def run(batch: DataFrame, batch_id: int) -> None:
        number = (query_id(), batch_id)
        if store.committed(number):
            return
        norm = E.normalize_entries(batch, ingest_ts(), strict_rfc)
        # cleaned once: matching reads the entries' keys and rows several times
        entries = materialize(E.valid_entries(norm))
        existing = store.read()
        classified, changes = U.plan_upsert(existing, entries, ingest_ts(), embedder, strict_rfc, max_id=store.max_id(),
                                            ordered=True, by_key=index.lookup(store.rows))
        rejected = materialize(E.rejected_entries(norm).select(*ISSUE_COLUMNS, F.col("reject_reason").alias("reason")))
        conflicts = classified.filter("action = 'conflict'").select(*ISSUE_COLUMNS, F.lit("conflict").alias("reason"))
        rejected.unionByName(conflicts).write.mode("overwrite").parquet(store.run_log(number, "issues"))
        landed = batch.select("feed_url").distinct()
        failed = landed.limit(0) if expected is None else expected.select("feed_url").distinct().join(landed, "feed_url", "left_anti")
        counters = U.ingest_metrics(classified, rejected, failed)
        counters.coalesce(1).write.mode("overwrite").parquet(store.run_log(number, "counters"))
        # the keys first: a lost batch leaves keys that lead nowhere, never articles without keys
        index.add(changes)
        # an empty change set writes nothing (the reference skips the commit too)
        store.commit(changes, batch=number)

    return run


def checkpoint_id(store: SnapshotStore, checkpoint: str) -> str:
    """The id that Spark gave the query when it created this checkpoint."""
    return json.loads(store._read_text(f"{checkpoint.rstrip('/')}/metadata"))["id"]


def run_ingest_stream(spark: SparkSession, landing: str, store: SnapshotStore, checkpoint: str,
                      ingest_ts: Callable[[], Column], embedder: Embedder | None = None, strict_rfc: bool = False,
                      max_files_per_trigger: int | None = None, processing_time: str | None = None, key_bits: int = 8,
                      expected: DataFrame | None = None):
    """Start the ingest stream; ``key_bits`` sizes the key index (see ``KeyIndex``). By default it processes what has landed and stops
    (``availableNow``); pass ``processing_time='30 minutes'`` for a standing query."""
    w = entry_stream(spark, landing, max_files_per_trigger).writeStream.foreachBatch(
        upsert_batch_fn(store, ingest_ts, embedder, strict_rfc, lambda: checkpoint_id(store, checkpoint), key_bits, expected)
    ).option("checkpointLocation", checkpoint)
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    return w.start()


def content_hash() -> Column:
    """md5 of a normalised entry's published fields."""
    # the time as published: an unparsable date must not hash the run's own time
    published = F.when(F.col("published_ok"), F.date_format("published_at", "yyyy-MM-dd HH:mm:ss")).otherwise("")
    fields = [F.col(c) for c in ("source", "title", "link", "content_clean", "content_preview")] + [published]
    # each field with its length in front, so that no two rows share a joined form
    return F.md5(F.concat(*[F.concat(F.char_length(f).cast("string"), F.lit(":"), f) for f in fields]))


CHANGED_SCHEMA = "guid string, feed_pos long, entry_pos long, content_hash string"
# what a session needs when a query on changed_entries starts: the state store with time-to-live, and,
# for a query that ends when it has read all there is, no batches without data (they would never end)
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class LastState(StatefulProcessor):
    """Keeps the hash of the last state of one guid, for ``ttl_ms`` after its last change."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "content_hash string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # positions and hashes of one guid in one micro-batch, in the order of delivery; nulls last
        got = sorted(rows, key=lambda r: [(v is None, 0 if v is None else v) for v in (r["landed"], r["feed_pos"], r["entry_pos"], r["content_hash"])])
        state = self.last.get()
        before = state[0] if state else None
        for r in got:
            if r["content_hash"] is None or r["content_hash"] != before:
                yield Row(guid=key[0], feed_pos=r["feed_pos"], entry_pos=r["entry_pos"], content_hash=r["content_hash"])
            before = r["content_hash"]
        self.last.update((before,))

    def close(self) -> None:
        pass


def changed_entries(stream: DataFrame, ingest_ts: Column, ttl: str = "30 days", strict_rfc: bool = False,
                    time_col: str = "_landed_at") -> DataFrame:
    """The deliveries that change their entry: (guid, feed_pos, entry_pos, content_hash).

    State holds one hash per guid, of the last delivery, so A, B, A passes three times and A, A once,
    also over restarts; a guid not delivered for ``ttl`` is forgotten and passes again. Deliveries of
    one micro-batch are taken in the order of landing time, feed and entry position; of equal rows
    the first passes. Only keys, positions and hashes go through the state, so a guid with many
    deliveries in one micro-batch takes some 60 bytes for each. The session needs ``STATE_CONF`` when the
    query starts."""
    norm = E.valid_entries(E.normalize_entries(stream, ingest_ts, strict_rfc, keep=(time_col,)))
    slim = norm.select("guid", F.col("feed_pos").cast("long").alias("feed_pos"), F.col("entry_pos").cast("long").alias("entry_pos"),
                       F.unix_micros(F.col(time_col).cast("timestamp")).alias("landed"), content_hash().alias("content_hash"))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return slim.groupBy("guid").transformWithState(LastState(ttl_ms), CHANGED_SCHEMA, "Append", "ProcessingTime")


def dedupe_stream(stream: DataFrame, ingest_ts: Column, watermark: str = "1 day", strict_rfc: bool = False,
                  time_col: str = "_landed_at") -> DataFrame:
    """Drop identical re-deliveries of an entry while letting new states through: the key is
    the guid plus a hash of the normalised content. An update back to a state that was delivered
    within the watermark is dropped as well; :func:`changed_entries` passes it.

    The watermark is on the landing time, not the publication date: a stream drops rows
    older than its watermark, and an old article re-delivered or updated today must not be
    discarded as late. State is kept for ``watermark`` of landing time.
    """
    norm = E.valid_entries(E.normalize_entries(stream, ingest_ts, strict_rfc, keep=(time_col,)))
    return norm.withColumn("content_hash", content_hash()).withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(
        ["guid", "content_hash"]
    )
