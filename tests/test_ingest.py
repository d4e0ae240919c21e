from pyspark.sql import functions as F

from corpusflow.operators import entries as E
from corpusflow.operators import upsert as U
from corpusflow.sources.store import ARTICLE_SCHEMA, SnapshotStore
from corpusflow.streaming.ingest import RAW_ENTRY_SCHEMA


def ts():
    return F.to_timestamp(F.lit("2026-01-01 00:00:00"))



def raw(spark, rows):
    """rows: dicts with entry fields; feed fields default to one feed."""
    full = []
    for i, r in enumerate(rows):
        full.append((
            r.get("feed_url", "https://feed/a"), r.get("feed_title", "Feed A"), r.get("feed_pos", 0), r.get("entry_pos", i),
            r.get("id"), r.get("guid"), r.get("link"), r.get("title"),
            [(c,) for c in r.get("content", [])], r.get("summary"), r.get("published"), r.get("updated"),
        ))
    return spark.createDataFrame(full, RAW_ENTRY_SCHEMA)


def run_upsert(spark, existing, entries_raw):
    norm = E.normalize_entries(entries_raw, ts())
    ent = E.dedupe_entries(E.valid_entries(norm))
    snap, cls = U.upsert(existing, ent, ts())
    return snap, cls


def counts(cls):
    return {r["action"]: r["count"] for r in cls.groupBy("action").count().collect()}


def empty(spark):
    return spark.createDataFrame([], ARTICLE_SCHEMA)


ENTRY = dict(id="guid-1", link="https://example.com/1", title="Title", summary="<p>Hello world</p>",
             published="Tue, 06 May 2026 10:00:00 GMT")


def test_new_entry_is_inserted(spark):
    snap, cls = run_upsert(spark, empty(spark), raw(spark, [ENTRY]))
    assert counts(cls) == {"insert": 1}
    row = snap.first()
    assert row.rss_guid == "guid-1" and row.content == "Hello world" and row.source == "Feed A" and row.id == 1


def test_changed_entry_is_updated_and_identical_is_skipped(spark, scratch):
    store = SnapshotStore(spark, f"{scratch}/store", part_rows=10)
    snap, cls = run_upsert(spark, store.read(), raw(spark, [ENTRY]))
    v1 = store.commit(U.plan_upsert(store.read(), E.dedupe_entries(E.valid_entries(E.normalize_entries(raw(spark, [ENTRY]), ts()))), ts())[1])
    assert v1 == 1 and store.read().count() == 1
    changed = dict(ENTRY, title="New title", summary="Other text", published="Wed, 07 May 2026 10:00:00 GMT", feed_title="Feed B")
    _, cls2 = run_upsert(spark, store.read(), raw(spark, [changed]))
    assert counts(cls2) == {"update": 1}
    # identical: nothing to write, no new version
    ent = E.dedupe_entries(E.valid_entries(E.normalize_entries(raw(spark, [ENTRY]), ts())))
    cls3, changes = U.plan_upsert(store.read(), ent, ts())
    assert counts(cls3) == {"unchanged": 1}
    assert store.commit(changes) == v1


def test_url_match_keeps_guid_and_conflicts_are_quarantined(spark):
    existing = spark.createDataFrame(
        [(1, "Feed A", "old-guid", "T", "https://x/1", "c", "c", None, [0.0], None, None),
         (2, "Feed A", "guid-2", "T", "https://x/2", "c", "c", None, [0.0], None, None)], ARTICLE_SCHEMA)
    rows = [dict(id="new-guid", link="https://x/1", title="T2", summary="c"),       # url match -> update, keeps old guid
            dict(id="guid-2", link="https://x/1b", title="T", summary="c"),        # guid match, url differs -> update
            dict(id="guid-3", link="https://x/2", title="T", summary="c")]         # url of row 2 whose guid is taken -> conflict
    snap, cls = run_upsert(spark, existing, raw(spark, rows))
    acts = {r.guid: r.action for r in cls.collect()}
    assert acts == {"new-guid": "update", "guid-2": "update", "guid-3": "conflict"}
    by_id = {r.id: r for r in snap.collect()}
    assert by_id[1].rss_guid == "old-guid" and by_id[1].title == "T2"
    assert by_id[2].url == "https://x/1b"


def test_keys_defaults_and_rejections(spark):
    rows = [dict(id="", guid="g", link="https://l/1"), dict(link="https://l/2"), dict(id="only-id", link=""),
            dict(id="x", link=None), dict(id="t", link="https://l/3", title="", content=["<b>c</b>"], summary="s"),
            dict(title="no keys at all")]
    n = {r.entry_pos: r for r in E.normalize_entries(raw(spark, rows), ts()).collect()}
    assert n[0].guid == "g" and n[1].guid == "https://l/2" and n[1].title == "Untitled"
    assert n[2].reject_reason == "no_link" and n[3].reject_reason == "no_link"
    assert n[4].title == "" and n[4].content_clean == "c"
    assert n[1].content_clean == "No content" and n[1].content_preview == ""
    assert n[5].reject_reason == "no_guid"


def test_overlong_keys_are_rejected_with_the_column(spark):
    rows = [dict(id="g" * 1024, link="l" * 1024, title="t" * 512), dict(id="g" * 1025, link="l"), dict(id="g", link="l", title="t" * 513),
            dict(id="g", link="l" * 1025), dict(id="g" * 1025, link="")]
    n = {r.entry_pos: r.reject_reason for r in E.normalize_entries(raw(spark, rows), ts()).collect()}
    assert n == {0: None, 1: "rss_guid_too_long", 2: "title_too_long", 3: "url_too_long", 4: "no_link"}


def test_dedupe_last_occurrence_wins(spark):
    rows = [dict(id="g", link="https://l/1", title="first", feed_pos=0, entry_pos=0),
            dict(id="g", link="https://l/1", title="second", feed_pos=1, entry_pos=0),
            dict(id="h", link="https://l/1", title="third", feed_pos=1, entry_pos=5)]
    d = E.dedupe_entries(E.valid_entries(E.normalize_entries(raw(spark, rows), ts()))).collect()
    assert [r.title for r in d] == ["third"]


def test_second_run_is_idempotent(spark):
    from corpusflow.plans.q_ingest import deduped

    from conftest import SF_SMALL

    ent = deduped(spark, SF_SMALL)
    snap, _ = U.upsert(empty(spark), ent, ts())
    snap = snap.checkpoint()
    snap2, cls2 = U.upsert(snap, ent, ts())
    assert set(counts(cls2)) == {"unchanged"}
    assert snap2.exceptAll(snap).count() == 0 and snap.exceptAll(snap2).count() == 0
