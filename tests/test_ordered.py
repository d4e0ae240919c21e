"""Entries that share keys: the ordered upsert against applying them one after the other."""

import random

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import entries as E
from corpusflow.operators import ordered as O
from corpusflow.operators import upsert as U
from corpusflow.operators.components import connected_components
from corpusflow.sources.store import ARTICLE_SCHEMA
from test_ingest import raw, ts


def test_components_of_paths_stars_and_single_nodes(spark):
    r = random.Random(4)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, 1000 + i) for i in range(200)]
    loose = [(r.randrange(2000, 2400), r.randrange(2000, 2400)) for _ in range(250)]
    edges = [*path, *star, *loose, (5, 5), (-9, 9), (9, -9)]
    group = {}

    def top(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in edges:
        lo, hi = sorted((top(a), top(b)))
        group[hi] = lo
    got = {x.node: x.comp for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in group}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def one_by_one(stored, rows):
    """Articles (id, guid, link, content, date, first) and conflicting positions, by the rule itself."""
    arts = [dict(id=i, guid=g, link=l, title="stored", date="stored", first=None, touched=False) for i, g, l in stored]
    bad = []
    for r in sorted(rows, key=lambda r: (r["feed_pos"], r["entry_pos"])):
        a = next((x for x in arts if x["guid"] == r["id"]), None)
        b = next((x for x in arts if x["link"] == r["link"]), None)
        if a is None and b is None:
            arts.append(dict(id=None, guid=r["id"], link=r["link"], title=r["title"], date=r["published"] or "run", first=None, touched=False))
            a = arts[-1]
        elif a is not None and b is not None and a is not b:
            bad.append((r["feed_pos"], r["entry_pos"]))
            continue
        a = a or b
        a.update(link=r["link"], title=r["title"], date=r["published"] or a["date"], touched=True)
        a["first"] = a["first"] or (r["feed_pos"], r["entry_pos"])
    return [a for a in arts if a["touched"]], sorted(bad)


def check(spark, stored, rows, parts=6):
    valid = E.valid_entries(E.normalize_entries(raw(spark, rows).repartition(parts), ts()))
    existing = spark.createDataFrame([(i, "Feed A", g, "t", l, "c", "c", None, [0.0], None, None) for i, g, l in stored], ARTICLE_SCHEMA)
    got = O.resolve_entries(valid, lambda keys: U.stored_hits(keys, existing)).collect()
    arts, bad = one_by_one(stored, [{"feed_pos": 0, "published": None, **r} for r in rows])
    assert sorted((r.feed_pos, r.entry_pos) for r in got if r.conflict) == bad

    def date(r):
        return r.published_at.strftime("%a, %d %b %Y %H:%M:%S GMT") if r.published_ok else ("stored" if r.ex_id else "run")

    assert sorted((r.guid, r.link, r.title, r.ex_id or 0, date(r), r.first_feed_pos, r.first_entry_pos) for r in got if not r.conflict) == sorted(
        (a["guid"], a["link"], a["title"], a["id"] or 0, a["date"], *a["first"]) for a in arts)


DATES = [None, "Tue, 06 May 2025 10:00:00 GMT", "Wed, 07 May 2025 10:00:00 GMT"]


@pytest.mark.parametrize("keys,n,n_stored", [(3, 60, 0), (12, 80, 5), (60, 90, 20), (400, 60, 10)])
def test_equals_one_by_one(spark, keys, n, n_stored):
    r = random.Random(keys)
    stored = [(i + 1, f"g{k}", f"l{m}") for i, (k, m) in enumerate(zip(r.sample(range(keys + 20), n_stored), r.sample(range(keys + 20), n_stored)))]
    rows = [dict(id=f"g{r.randrange(keys)}", link=f"l{r.randrange(keys)}", title=f"t{i}", summary="s", feed_pos=r.randrange(3), entry_pos=i,
                 published=r.choice(DATES)) for i in range(n)]
    check(spark, stored, rows)


def test_first_guid_last_content_and_freed_links(spark):
    rows = [("g1", "a"), ("g2", "a"), ("g3", "a"),          # three guids of one link
            ("g1", "b"), ("g9", "a"),                       # the article moves on, the link is free again
            ("g9", "b"),                                    # now the keys are two articles'
            ("s", "x1"), ("s", "x2"), ("s", "x3")]          # a stored guid with three links
    rows = [dict(id=g, link=u, title=f"t{i}", summary="s", entry_pos=i) for i, (g, u) in enumerate(rows)]
    check(spark, [(1, "s", "x0"), (2, "old", "x2")], rows)


def test_one_guid_and_one_link_hold_most_entries(spark):
    """Constant guids and constant links reach the fold as a few runs per task."""
    rows = [dict(id="hot", link=f"l{i}", title=f"t{i}", summary="s", feed_pos=0, entry_pos=i) for i in range(400)]
    rows += [dict(id=f"g{i}", link="home", title=f"t{i}", summary="s", feed_pos=1, entry_pos=i) for i in range(400)]
    rows += [dict(id="hot", link="home", title="both", summary="s", feed_pos=2, entry_pos=0)]
    check(spark, [(1, "old", "home")], rows)
    slim = spark.createDataFrame([(1, "ghot", (0, i, 0), "hot", f"l{i}", True) for i in range(400)],
                                 f"comp long, run_key string, pos {O.POS}, guid string, link string, published_ok boolean")
    seen = slim.coalesce(1).mapInArrow(O.compress_runs, O.RUN_SCHEMA).collect()
    assert len(seen) == 1 and seen[0].n == 400 and (seen[0].link, seen[0].link2) == ("l0", "l399")


def test_repeated_rows_count_once_and_empty_batches_pass(spark):
    row = dict(id="g", link="l", title="t", summary="s", entry_pos=3)
    check(spark, [], [row])
    valid = E.valid_entries(E.normalize_entries(raw(spark, [row, row, dict(row, link="m", entry_pos=4), dict(row, link="m", entry_pos=4)]), ts()))
    none = spark.createDataFrame([], ARTICLE_SCHEMA)
    got = O.resolve_entries(valid, lambda keys: U.stored_hits(keys, none)).collect()
    assert [(r.guid, r.link, r.first_entry_pos) for r in got] == [("g", "m", 3)]
    assert O.resolve_entries(valid.limit(0), lambda keys: U.stored_hits(keys, none)).collect() == []


def test_snapshot_numbers_new_articles_by_their_first_entry(spark):
    rows = [dict(id="a", link="1", title="a0", summary="s"), dict(id="b", link="2", title="b0", summary="s"),
            dict(id="a", link="3", title="a1", summary="s"), dict(id="c", link="1", title="c0", summary="s")]
    valid = E.valid_entries(E.normalize_entries(raw(spark, rows), ts()))
    none = spark.createDataFrame([], ARTICLE_SCHEMA)
    snap, _ = U.upsert(none, valid, ts(), ordered=True)
    snap = snap.checkpoint()
    assert [(r.id, r.rss_guid, r.url, r.title) for r in snap.orderBy("id").collect()] == [
        (1, "a", "3", "a1"), (2, "b", "2", "b0"), (3, "c", "1", "c0")]
    # the last states again: nothing changes
    again = valid.filter(F.col("entry_pos") > 0)
    _, cls = U.upsert(snap, again, ts(), ordered=True)
    assert {r.action for r in cls.collect()} == {"unchanged"}


def test_the_chained_entries_are_cleaned_once(spark, monkeypatch):
    from conftest import SF_SMALL
    from corpusflow.plans import q_ingest as Q

    want = Q.existing_articles(spark, SF_SMALL)
    calls, real = [], E.normalize_entries
    monkeypatch.setattr(E, "normalize_entries", lambda *a, **k: calls.append(1) or real(*a, **k))
    got, batch = Q.chained_upsert(spark, SF_SMALL)
    assert len(calls) == 1 and batch.count() > got.count() > 0
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
