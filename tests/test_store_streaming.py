from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpusflow.operators import entries as E
from corpusflow.operators import upsert as U
from corpusflow.plans.q_ingest import deduped
from corpusflow.sources import fixtures as FX
from corpusflow.sources.store import SnapshotStore
from corpusflow.streaming.ingest import run_ingest_stream


def test_commit_rewrites_only_touched_parts(spark, scratch):
    store = SnapshotStore(spark, f"{scratch}/s", part_rows=10)
    ent = deduped(spark, SF_SMALL)
    _, changes = U.plan_upsert(store.read(), ent, FX.ingest_ts())
    v1 = store.commit(changes, batch=("q", 0))
    n = store.read().count()
    assert n == ent.count()
    parts_v1 = store.manifest()["parts"]
    assert len(parts_v1) > 1
    # change one title: only its part gets a new version
    one = ent.orderBy("entry_pos").limit(1).withColumn("title", F.lit("changed"))
    _, ch2 = U.plan_upsert(store.read(), one, FX.ingest_ts())
    v2 = store.commit(ch2, batch=("q", 1))
    parts_v2 = store.manifest()["parts"]
    moved = [k for k in parts_v2 if parts_v2[k] != parts_v1[k]]
    assert v2 == v1 + 1 and len(moved) == 1
    assert store.read().count() == n
    assert store.read().filter(F.col("title") == "changed").count() == 1
    # a replayed batch id is a no-op
    assert store.commit(ch2, batch=("q", 1)) == v2


def test_stream_equals_batch_and_is_idempotent(spark, scratch):
    FX.raw_entries(spark, SF_SMALL).write.parquet(f"{scratch}/landing")
    store = SnapshotStore(spark, f"{scratch}/store", part_rows=16)
    q = run_ingest_stream(spark, f"{scratch}/landing", store, f"{scratch}/ckpt", FX.ingest_ts)
    q.awaitTermination()
    snap_stream = store.read()
    valid = E.valid_entries(E.normalize_entries(FX.raw_entries(spark, SF_SMALL), FX.ingest_ts())).checkpoint()
    batch, _ = U.upsert(store.read().limit(0), valid, FX.ingest_ts(), ordered=True)
    cols = ["id", "rss_guid", "url", "title", "content", "content_preview", "published_at"]
    assert snap_stream.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(snap_stream.select(cols)).count() == 0
    v = store.current_version()
    # the same files again under a new stream: every entry is unchanged, no new version
    q2 = run_ingest_stream(spark, f"{scratch}/landing", store, f"{scratch}/ckpt2", FX.ingest_ts)
    q2.awaitTermination()
    assert store.current_version() == v


def test_stream_dedupe_drops_redeliveries(spark, scratch):
    from corpusflow.streaming.ingest import dedupe_stream, entry_stream

    raw = FX.raw_entries(spark, SF_SMALL)
    raw.write.parquet(f"{scratch}/land/a")
    raw.write.parquet(f"{scratch}/land/b")
    src = entry_stream(spark, f"{scratch}/land", recursive=True)
    q = (dedupe_stream(src, FX.ingest_ts()).select("entry_pos", "guid").writeStream.format("parquet")
         .option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{scratch}/out")
    valid = E.valid_entries(E.normalize_entries(raw, FX.ingest_ts()))
    assert out.count() == valid.count()


def test_multi_batch_stream_keeps_keys_unique(spark, scratch):
    raw = FX.raw_entries(spark, SF_SMALL)
    # land each feed separately so the stream sees several micro-batches
    for k in range(5):
        raw.filter(F.col("feed_pos") == k).coalesce(1).write.parquet(f"{scratch}/landing/feed={k}")
    store = SnapshotStore(spark, f"{scratch}/store", part_rows=8)
    q = run_ingest_stream(spark, f"{scratch}/landing", store, f"{scratch}/ckpt", FX.ingest_ts, max_files_per_trigger=1)
    q.awaitTermination()
    snap = store.read()
    n = snap.count()
    assert n > 0 and store.current_version() >= 2
    for key in ("id", "rss_guid", "url"):
        assert snap.select(key).distinct().count() == n, key
    assert snap.agg(F.max("id")).first()[0] == store.max_id()
    v = store.current_version()
    q2 = run_ingest_stream(spark, f"{scratch}/landing", store, f"{scratch}/ckpt2", FX.ingest_ts)
    q2.awaitTermination()
    assert store.current_version() == v


def test_old_dated_entry_in_a_later_batch_is_not_dropped(spark, scratch):
    import time

    from corpusflow.streaming.ingest import RAW_ENTRY_SCHEMA, dedupe_stream, entry_stream

    def land(name, rows):
        spark.createDataFrame(rows, RAW_ENTRY_SCHEMA).coalesce(1).write.parquet(f"{scratch}/land/{name}")

    def row(pos, guid, published):
        return ("https://f", "F", 0, pos, guid, None, f"https://l/{guid}", "t", [], "s", published, None)

    land("a", [row(0, "new", "Tue, 06 May 2026 10:00:00 GMT")])
    time.sleep(1.1)
    land("b", [row(1, "old", "Mon, 06 May 2019 10:00:00 GMT"), row(0, "new", "Tue, 06 May 2026 10:00:00 GMT")])
    src = entry_stream(spark, f"{scratch}/land", max_files_per_trigger=1, recursive=True)
    q = (dedupe_stream(src, F.to_timestamp(F.lit("2026-06-01 00:00:00"))).select("guid").writeStream.format("parquet")
         .option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(r.guid for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == ["new", "old"]  # the re-delivered 'new' is dropped, the old-dated 'old' is kept


def test_two_checkpoints_feed_one_store(spark, scratch):
    raw = FX.raw_entries(spark, SF_SMALL)
    store = SnapshotStore(spark, f"{scratch}/store", part_rows=8)
    for n, keep in enumerate(("feed_pos = 0", "feed_pos <> 0")):
        raw.filter(keep).coalesce(1).write.parquet(f"{scratch}/landing{n}")
        run_ingest_stream(spark, f"{scratch}/landing{n}", store, f"{scratch}/ckpt{n}", FX.ingest_ts).awaitTermination()
    valid = E.dedupe_entries(E.valid_entries(E.normalize_entries(raw, FX.ingest_ts())))
    urls = {r.url for r in store.read().select("url").collect()}
    assert urls >= {r.link for r in valid.filter("feed_pos <> 0").select("link").collect()}
    assert len(store.manifest()["batches"]) == 2
    counters = store.runs("counters").collect()
    assert len(counters) == 2 and sum(r.ingested for r in counters) == len(urls)
    assert store.runs("issues").count() == E.rejected_entries(E.normalize_entries(raw, FX.ingest_ts())).count()


def test_store_never_reads_as_empty_nor_overwrites(spark, scratch):
    import os

    import pytest

    from corpusflow.sources.store import CommitConflict

    ent = deduped(spark, SF_SMALL)
    a, b = (SnapshotStore(spark, f"{scratch}/s", part_rows=1000) for _ in range(2))
    _, changes = U.plan_upsert(a.read(), ent, FX.ingest_ts())
    a.commit(changes)
    n = a.read().count()
    # a writer that was lost while it wrote its manifest: readers keep the last whole one
    open(f"{scratch}/s/_manifests/v2.json", "w").close()
    assert b.current_version() == 1 and b.read().count() == n
    folders = set(os.listdir(f"{scratch}/s/data"))
    one = ent.orderBy("entry_pos").limit(1).withColumn("title", F.lit("changed"))
    _, more = U.plan_upsert(b.read(), one, FX.ingest_ts())
    assert b.commit(more) == 3 and folders < set(os.listdir(f"{scratch}/s/data"))
    # two writers for the same version: the second fails, the first one's rows stay
    with pytest.raises(CommitConflict):
        a._create_text(f"{scratch}/s/_manifests/v3.json", "{}")
    assert a.current_version() == 3 and a.read().filter("title = 'changed'").count() == 1


def test_upsert_reads_keys_of_all_parts_and_rows_of_the_touched_ones(spark, scratch):
    from corpusflow.operators import upsert as module

    store = SnapshotStore(spark, f"{scratch}/s", part_rows=5)
    ent = deduped(spark, SF_SMALL)
    store.commit(U.plan_upsert(store.read(), ent, FX.ingest_ts())[1])
    assert len(store.manifest()["parts"]) > 3
    scans, real = [], module.materialize

    def watch(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    module.materialize = watch
    try:
        one = ent.orderBy("entry_pos").limit(1).withColumn("title", F.lit("changed"))
        classified, _ = U.plan_upsert(store.read(), one, FX.ingest_ts(), max_id=store.max_id(), lookup=store.rows)
    finally:
        module.materialize = real
    assert [r.action for r in classified.collect()] == ["update"]
    files = [p for p in scans if "FileScan parquet" in p]
    keys = [p for p in files if "content:string" not in p]
    rows = [p for p in files if "content:string" in p]
    assert len(keys) == 1 and "embedding" not in keys[0] and "InMemoryFileIndex(1 paths)" not in keys[0]
    assert len(rows) == 1 and "InMemoryFileIndex(1 paths)" in rows[0]


def _index(spark, scratch, n=400, bits=8):
    from corpusflow.sources.keyindex import KeyIndex

    store = SnapshotStore(spark, f"{scratch}/s", part_rows=20)
    arts = spark.range(1, n + 1).selectExpr("id", "'F' as source", "concat('g', id) as rss_guid", "'t' as title", "concat('u', id) as url",
                                            "'c' as content", "'c' as content_preview", "timestamp'2025-01-01' as published_at",
                                            "array(cast(0.5 as float)) as embedding", "timestamp'2025-01-01' as created_at",
                                            "timestamp'2025-01-01' as updated_at")
    index = KeyIndex(spark, f"{scratch}/s/_keys", bits)
    index.add(arts)
    store.commit(arts)
    return store, index


def test_key_index_opens_only_the_buckets_and_parts_of_a_batch(spark, scratch):
    from corpusflow.operators import upsert as module
    from corpusflow.sources import keyindex

    store, index = _index(spark, scratch)
    keys = spark.createDataFrame([("g7", "nowhere"), ("new", "u8"), ("none", "none")], "guid string, link string")
    opened, real = [], keyindex.materialize

    def watch(df):
        opened.extend(df.inputFiles())
        return real(df)

    keyindex.materialize = module.materialize = watch
    try:
        found = module.stored_hits(keys, store.read(), by_key=index.lookup(store.rows))
    finally:
        keyindex.materialize = module.materialize = real
    assert sorted(r.id for r in found.collect()) == [7, 8]
    buckets = {f.split("bucket=")[1].split("/")[0] for f in opened if "/_keys/" in f}
    parts = {f.split("part=")[1].split("/")[0] for f in opened if "/data/" in f}
    assert 0 < len(buckets) <= 6 < 200 < len(index.read().select("bucket").distinct().collect())
    assert parts == {"0"} and len(store.manifest()["parts"]) == 21


def test_key_index_survives_stale_and_repeated_rows_and_equal_hashes(spark, scratch):
    store, index = _index(spark, scratch, n=30, bits=3)
    index.add(store.read())                                                         # a replayed batch
    index.add(spark.createDataFrame([(9999, "g1", "u1")], "id long, rss_guid string, url string"))      # a lost one
    moved = store.read().filter("id = 5").withColumn("url", F.lit("u5-new"))
    index.add(moved)
    store.commit(moved)
    index._rows = lambda a: a.select(F.lit(0).cast("long").alias("h"), "id", F.lit(0).alias("bucket"))  # every key alike
    hits = index.lookup(store.rows)
    ask = lambda *k: sorted(r.id for r in hits(spark.createDataFrame(list(k), "guid string, link string")).collect())
    assert ask(("g1", "x")) == [1] and ask(("x", "u5")) == [] and ask(("x", "u5-new")) == [5] and ask(("g5", "u6")) == [5, 6]
    assert ask(("x", None)) == []
    from corpusflow.sources.keyindex import KeyIndex

    assert KeyIndex(spark, f"{scratch}/none").candidates(spark.createDataFrame([("a", "b")], "guid string, link string")).count() == 0


def test_stream_over_several_batches_equals_one_ordered_batch(spark, scratch):
    raw = FX.chained_entries(spark, SF_SMALL)
    for k in range(7):
        raw.filter(F.col("feed_pos") == k).coalesce(1).write.parquet(f"{scratch}/landing/feed={k}")
        run_ingest_stream(spark, f"{scratch}/landing/feed={k}", SnapshotStore(spark, f"{scratch}/store", part_rows=8), f"{scratch}/ckpt{k}",
                          FX.ingest_ts).awaitTermination()
    valid = E.valid_entries(E.normalize_entries(raw, FX.ingest_ts())).checkpoint()
    none = spark.createDataFrame([], SnapshotStore(spark, f"{scratch}/x").schema)
    want, _ = U.upsert(none, valid, FX.ingest_ts(), ordered=True)
    cols = ["id", "rss_guid", "url", "title", "content", "published_at"]
    got = SnapshotStore(spark, f"{scratch}/store", part_rows=8).read()
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_changed_entries_over_restarts(spark, scratch):
    from corpusflow.streaming.ingest import RAW_ENTRY_SCHEMA, STATE_CONF, changed_entries, entry_stream

    def row(pos, guid, title):
        return ("https://f", "F", 0, pos, guid, None, f"https://l/{guid}", title, [], "s", None, None)

    # a run of the query per list: a goes A, B, A; b stays A; c changes twice within one batch
    runs = [[row(0, "a", "A"), row(1, "b", "A"), row(2, "c", "A"), row(3, "c", "A"), row(4, "c", "B"), row(5, "c", "A")],
            [row(0, "a", "B"), row(1, "b", "A"), row(2, "c", "A")], [row(0, "a", "A"), row(1, "b", "A"), row(2, "c", "B")]]
    before = {k: spark.conf.get(k) for k in STATE_CONF}
    try:
        for k, v in STATE_CONF.items():
            spark.conf.set(k, v)
        for n, rows in enumerate(runs):
            spark.createDataFrame(rows, RAW_ENTRY_SCHEMA).coalesce(1).write.parquet(f"{scratch}/land/{n}")
            src = entry_stream(spark, f"{scratch}/land", recursive=True)
            out = changed_entries(src, F.to_timestamp(F.lit("2026-06-01 00:00:00"))).withColumn("run", F.lit(n))
            (out.writeStream.format("parquet").option("path", f"{scratch}/out").option("checkpointLocation", f"{scratch}/ck")
             .trigger(availableNow=True).start()).awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r.guid, r.run, r.entry_pos) for r in spark.read.parquet(f"{scratch}/out").collect())
    assert got == [("a", 0, 0), ("a", 1, 0), ("a", 2, 0), ("b", 0, 1), ("c", 0, 2), ("c", 0, 4), ("c", 0, 5), ("c", 2, 2)]


def test_a_guid_reads_its_state_once_and_orders_its_deliveries():
    from pyspark.sql import Row

    from corpusflow.streaming.ingest import LastState

    class Value:
        kept, reads = ("a",), 0

        def get(self):
            self.reads += 1
            return self.kept

        def update(self, value):
            self.kept = value

    rows = [Row(landed=n, feed_pos=None if p is None else 0, entry_pos=p, content_hash=h)
            for n, p, h in ((2, 1, "b"), (1, 5, "a"), (2, None, "c"), (2, 1, "b"), (None, 3, "c"), (1, 6, "b"))]
    state = LastState(1000)
    state.last = Value()
    got = [(r.guid, r.entry_pos, r.content_hash) for r in state.handleInputRows(("g",), iter(rows), None)]
    assert got == [("g", 6, "b"), ("g", None, "c")] and state.last.kept == ("c",) and state.last.reads == 1
    state.last.kept = None
    assert [r.entry_pos for r in state.handleInputRows(("g",), iter(rows[:1]), None)] == [1]
