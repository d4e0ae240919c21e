"""Operators against brute force on small tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import docs

SF = "/root/testdata/sf0.001"


def words(n, seed, size=40):
    r = random.Random(seed)
    return [f"{chr(97 + r.randrange(26))}{r.randrange(size)}" for _ in range(n)]


def test_token_counts_are_the_cheapest_segmentation():
    from corpusflow.llm.token_counts import terminal_counts

    costs = {b"a": 5, b"b": 5, b"c": 5, b"ab": 7, b"bc": 6, b"abc": 13, b"ca": 4, b"cab": 9}
    r = random.Random(1)
    texts = [bytes(r.choice(b"abcx") for _ in range(r.randrange(0, 9))) for _ in range(400)]

    def brute(w):
        if not w:
            return (0, 0)
        found = []
        for n in range(1, len(w) + 1):
            cost = costs.get(w[:n], 100_000_000 if n == 1 else None)
            if cost is not None:
                c, k = brute(w[n:])
                found.append((cost + c, k + 1))
        return min(found)

    got = terminal_counts(list(dict.fromkeys(texts)), costs, max(map(len, costs)))
    assert got == {w: brute(w)[1] for w in texts}


def test_token_counts_cover_the_whole_text(spark):
    from corpusflow.llm import token_counts as t

    import regex

    costs = t.load_costs()
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in t.count_tokens(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    longest = max(map(len, costs))
    for r in rows[:40]:
        pre = regex.findall(t.PRE_TOKEN, r.text)
        assert "".join(pre) == r.text
        each = {p: t.terminal_counts([p.encode()], costs, longest)[p.encode()] for p in set(pre)}
        assert got[r.doc_id] == (len(pre), sum(each[p] for p in pre))


def test_simhash_components(spark):
    from xxhash import xxh64_intdigest

    from corpusflow.llm import simhash

    base = words(120, 3)
    texts = []
    for i in range(240):
        w = list(base) if i % 3 == 0 else words(30 + i % 50, i // 5)
        if i % 4 == 0:
            w[i % len(w)] = "changed"
        texts.append((i, " ".join(w)))
    texts += [(900, None), (901, ""), (902, " ")]

    def fp(t):
        ws = (t or "").lower().split()
        grams = [" ".join(ws[k:k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
        hs = [xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = {i: fp(t) for i, t in texts}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = simhash.near_duplicates(docs(spark, texts)).select("doc_id", simhash.hex_print(F.col("fp")), "component_id").collect()
    assert {tuple(r) for r in got} == {(i, f"{prints[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("shard", [8, 64])
def test_hot_shards_are_divided_exactly(spark, shard):
    from corpusflow.llm import simhash

    r = random.Random(5)
    codes = {r.getrandbits(64) for _ in range(50)}
    center = r.getrandbits(64)
    for _ in range(300):
        codes.add(center ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) & (2**64 - 1))
    codes = sorted(codes)
    df = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    edges = simhash.links(df, 2, shard)
    got = {simhash._signed(c): simhash._signed(c) for c in codes}
    for x in simhash.components(edges).collect():
        got[x.node] = x.root
    near = {c: [d for d in codes if (c ^ d).bit_count() <= 2] for c in codes}
    seen = {}
    for c in codes:
        if c not in seen:
            todo, comp = [c], {c}
            while todo:
                for d in near[todo.pop()]:
                    if d not in comp:
                        comp.add(d)
                        todo.append(d)
            low = min(map(simhash._signed, comp))
            seen.update(dict.fromkeys(comp, low))
    assert got == {simhash._signed(c): v for c, v in seen.items()}


def test_components_of_a_long_chain_and_a_hub(spark):
    from corpusflow.llm.simhash import components

    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + k) for k in range(1, 150)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + k: 1000 for k in range(150)}}


def test_quality_counts(spark):
    from corpusflow.llm import quality

    r = random.Random(2)
    texts = [(i, " ".join(r.choice(["a", "b", "c", "dd"]) for _ in range(r.randrange(0, 60)))) for i in range(80)]

    def repeated(ws):
        wins = [tuple(ws[k:k + 8]) for k in range(len(ws) - 7)]
        return len({k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(8)})

    got = {x.doc_id: (x.n_words, x.n_repeat_words) for x in quality.ledger(docs(spark, texts)).collect()}
    assert got == {i: (len(t.split()), repeated(t.split())) for i, t in texts}


def test_ledger_policies_and_ablation(spark):
    from corpusflow.llm import quality

    texts = [(1, "short"), (2, " ".join(words(40, 1, 900))), (3, " ".join(f"{w}!!" for w in words(40, 2, 900))),
             (4, " ".join(f"{w} ###" for w in words(40, 3, 900))), (5, "same " * 40)]
    led = quality.ledger(docs(spark, texts)).cache()
    kept = lambda v: {r.doc_id for r in quality.apply_policy(led, v).filter("kept").collect()}
    assert kept("base") == {2, 3, 4} and kept("v1") == {2, 3} and kept("v2") == {2}
    only = {r.rule: (r.n_failed, r.n_only) for r in quality.ablation(led, "v2").collect()}
    assert only["too_short"] == (1, 1) and only["exclamation"][1] == 1 and only["symbols"][1] == 1
    assert quality.ablation(led.limit(0), "v2").collect()[0].n_failed == 0


def test_decontam_in_blocks_equals_one_pass(spark, monkeypatch):
    from corpusflow.llm import decontam

    r = random.Random(4)
    items = [(i, " ".join(r.choice("abcde") for _ in range(r.randrange(0, 16)))) for i in range(30)]
    texts = [(i, " ".join(r.choice("abcdeF") for _ in range(r.randrange(0, 80)))) for i in range(60)]
    got = lambda: sorted(map(tuple, decontam.find_windows(
        docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).drop("text_key").collect()))
    whole = got()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 2000)
    assert got() == whole
    want = []
    for i, t in texts:
        ws, hit, ids = t.lower().split(), set(), set()
        for j, it in items:
            iw = it.split()
            for k in range(max(1, len(iw) - 9)) if iw else ():
                w = iw[k:k + 10]
                for s in range(len(ws) - len(w) + 1):
                    if ws[s:s + len(w)] == w:
                        hit.update(range(s, s + len(w)))
                        ids.add(str(j))
        want.append((i, len(ws), len(hit), sorted(ids)))
    assert whole == sorted(want)


def test_line_runs_compact_and_add_up(spark):
    from corpusflow.llm.line_dedup import LineRuns, drop_repeated_lines

    runs = LineRuns(spark, fanout=2)
    for b in range(5):
        runs.add(docs(spark, [(10 * b + i, f"Common line \nonly {b} {i}\n\nCOMMON LINE") for i in range(3)]))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(r.n_docs for r in runs.counts().collect()) == [1] * 15 + [15]
    cut = drop_repeated_lines(docs(spark, [(1, " common line\nonly 1 1\n\ncommon line"), (2, "common line")]), runs).collect()
    assert {r["row"].doc_id: (r.kept, r.n_lines, r.n_dropped) for r in cut} == {1: ("only 1 1\n", 4, 2), 2: ("", 1, 1)}
    again = LineRuns(spark, fanout=2, levels=runs.levels)
    assert [tuple(r) for r in again.unseen(docs(spark, [(7, "new line\ncommon line")])).collect()] == [(7, 0, "new line")]


def test_lm_score_against_plain_counts(spark):
    from corpusflow.llm import lm_score as m

    texts = [(1, "a b a c"), (2, "a b b"), (3, "c c a"), (4, "a b a b"), (5, "")]
    good = spark.createDataFrame([(1,), (2,)], "doc_id long")
    got = {r.doc_id: (r.target_loss, r.background_loss) for r in m.cross_entropy_difference(docs(spark, texts), good).collect()}

    vocabulary = len({w for _, t in texts for w in t.split()}) + 1

    def loss(own, held):
        uni, ctx, pair, total = {}, {}, {}, 0
        for i, t in held:
            if i == own[0]:
                continue
            ws = t.split()
            for u, w in zip(["^", *ws], ws):
                uni[w], ctx[u], pair[u, w] = uni.get(w, 0) + 1, ctx.get(u, 0) + 1, pair.get((u, w), 0) + 1
            total += len(ws)
        ws = own[1].split()
        each = [-math.log((pair.get((u, w), 0) + m.STRENGTH * (uni.get(w, 0) + 1) / (total + vocabulary)) / (ctx.get(u, 0) + m.STRENGTH))
                for u, w in zip(["^", *ws], ws)]
        return sum(each) / len(each) if each else 0.0

    for x in texts:
        assert got[x[0]] == pytest.approx((loss(x, [t for t in texts if t[0] in (1, 2)]), loss(x, texts)), abs=1e-9)


def test_license_forms(spark):
    from corpusflow.llm import licenses

    mit = licenses.MIT.replace("<year> <copyright holders>", "2031 Someone Else").replace("sublicense", "SUB-LICENCE".replace("-", "")).upper()
    texts = [(1, mit), (2, mit + " extra"), (3, "some text\nreleased UNDER the MIT licence\nmore"), (4, "Copyright 2020 Me"), (5, None)]
    got = {r.doc_id: (r.license_id, r.notices) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got[1][0] == "MIT" and got[2][0] is None and got[3] == (None, ["MIT"]) and got[4] == got[5] == (None, [])


def test_mixing_targets_and_takes(spark):
    from corpusflow.llm import mixing

    r = random.Random(9)
    texts = [(i, " ".join(["w"] * r.randrange(0, 90))) for i in range(400)]
    df = docs(spark, texts, extra=False).withColumn(
        "source", F.when(F.col("doc_id") % 3 == 0, "big").when(F.col("doc_id") % 50 == 1, "tiny").when(F.col("doc_id") % 50 == 2, None).otherwise("mid"))
    m = mixing.mix(df, block=16)
    rows = m.documents.collect()
    sizes = {}
    for x in rows:
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while True:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] >= 2 * sizes[s]}
        if not over:
            target.update({s: unit * weight[s] for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    took = {}
    for x in rows:
        assert x.source_size == sizes[x.source] and x.target == pytest.approx(target[x.source])
        assert 0 <= x.taken <= 2 * x["size"]
        took[x.source] = took.get(x.source, 0) + x.taken
    assert all(abs(took[s] - target[s]) < 1 for s in order)
    again = sorted(map(tuple, mixing.mix(df, block=16).documents.collect()), key=repr)
    assert again == sorted(map(tuple, rows), key=repr)
    pieces = m.pieces.collect()
    assert sum(p.n_words for p in pieces) == sum(took.values())
    slots = {}
    for p in pieces:
        slots.setdefault(p.slot, [p.source, 0])[1] += p.n_words
        assert slots[p.slot][0] == p.source
    short = [v for v in slots.values() if v[1] != 16]
    assert len(short) <= len(order)                       # equal blocks but for each source's last


def test_schedule_spreads_sources_evenly(spark):
    from corpusflow.llm.mixing import schedule

    plan = spark.createDataFrame([(1, 500, 0), (2, 300, 500), (3, 1, 800), (4, 0, 801), (5, 199, 801)], "si int, slots long, first long")
    rows = sorted(map(tuple, schedule(plan).collect()))
    assert len({r[0] for r in rows}) == len(rows) == 1000
    for si, n in ((1, 500), (2, 300), (3, 1), (5, 199)):
        mine = [r for r in rows if r[1] == si]
        assert [r[2] for r in mine] == list(range(n))
        for cut in (250, 500, 750):
            assert abs(sum(r[0] < cut for r in mine) - n * cut / 1000) <= 4


def test_toxicity_learns_pairs_and_keeps_ids_out(spark):
    import numpy as np

    from corpusflow.llm import toxicity

    r = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(1500):                                # label 1 only where both terms meet
        a, b = r.random(2) < 0.4
        rows.append(np.array(sorted({10 if a else 11, 20 if b else 21, *r.integers(100, 400, 8)}), dtype=np.int32))
        y.append(float(a and b))
    model = toxicity.fit(rows, np.array(y), np.mean(y), slots=512)
    p = 1 / (1 + np.exp(-model.margin(rows)))
    assert ((p >= 0.3) == (np.array(y) == 1)).mean() > 0.97

    def data(shift):
        texts = [(i + shift, ("you idiotic fool " if i % 5 == 0 else "") + " ".join(words(40, i))) for i in range(300)]
        return docs(spark, texts, extra=False), spark.createDataFrame([(i + shift, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")

    got = toxicity.detect(*data(0)).collect()
    right = [x.predicted == int(x.doc_id % 5 == 0) for x in got if x.held_out]
    assert len(right) > 30 and sum(right) / len(right) > 0.95


def test_held_out_accuracy_on_the_labelled_table(spark):
    from corpusflow.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.01"
    rows = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(clean) / len(clean) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_main_text_of_the_pages(spark):
    import html
    import re

    from corpusflow.llm.html_text import extract

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}

    def plain(p):
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", p, re.S)[1]
        body = re.sub(r"<[^>]*$", "", body)
        parts = re.split(r"</?(?:p|h1|h2|h3|li|ul|ol|div|blockquote)[^>]*>", body)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split()) for x in parts]
        return "\n".join(x for x in lines if x)

    rows = pages.collect()
    same = sum(got[r.page_id] == plain(r.html) for r in rows)
    assert same / len(rows) > 0.99


def test_queries_match_sql(spark):
    import duckdb

    from corpusflow.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLE.items():
        cur = con.execute(sql)
        cols = [d[0] for d in cur.description]
        got = QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(cols)
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(cur.fetchall())


def test_batches_anti_join_the_runs_and_add_up(spark):
    """New keys of the runs never meet, and the counts are those of one pass, at any fan-out."""
    from collections import Counter

    from corpusflow.llm.line_dedup import LineRuns, batch_of

    r = random.Random(11)
    rows = [(i, "\n".join(f"line {int(r.paretovariate(0.7))}" for _ in range(r.randrange(6)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(Counter(k for _, t in rows for k in set(t.split("\n")) if k).values())
    for fanout, n in ((4, 8), (2, 5), (9, 3)):
        runs = LineRuns(spark, fanout=fanout)
        runs.add(df, batch=batch_of(F.col("doc_id"), n), n_batches=n)
        assert Counter(x.n_docs for x in runs.counts().collect()) == want
        new = runs._read("new").select("h1", "h2")
        assert new.count() == new.distinct().count() and runs._read("again").count() > 0


def test_line_batches_are_anti_joined_in_the_plan(spark, monkeypatch):
    from corpusflow.llm.line_dedup import LineRuns

    frame = type(spark.range(1))
    plans, real = [], frame.sortWithinPartitions
    monkeypatch.setattr(frame, "sortWithinPartitions", lambda self, *a, **k: (plans.append(self._jdf.queryExecution().toString()), real(self, *a, **k))[1])
    runs = LineRuns(spark)
    for b in range(2):
        runs.add(docs(spark, [(b, f"same\nonly {b}")]))
    assert sum("SortMergeJoin" in p and "LeftAnti" in p for p in plans) >= 1


def test_sole_rules_equal_the_ablation(spark):
    from corpusflow.llm import quality

    led = quality.ledger(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = quality.with_sole_rule(led, "v1").collect()
    for x in quality.ablation(led, "v1").collect():
        mine = [r for r in rows if r.only_rule == x.rule]
        assert len(mine) == x.n_only and all(r.n_only_rule == x.n_only for r in mine)


def test_template_of_a_third_of_the_benchmark(spark, monkeypatch):
    """One passage in many items stands once in the index, and documents that quote it name them all."""
    from corpusflow.llm import decontam

    shared = " ".join(f"s{i}" for i in range(40))
    items = [(i, f"{shared} own{i} " + " ".join(f"x{i}y{k}" for k in range(12))) for i in range(60)] + [(100 + i, " ".join(f"q{i}z{k}" for k in range(11))) for i in range(90)]
    texts = [(1, f"before {shared} after"), (2, " ".join(f"x7y{k}" for k in range(12))), (3, "nothing of it"), (4, shared + " own9 x9y0")]
    it = spark.createDataFrame(items, "item_id long, text string")
    wins, lists = decontam._groups(decontam.item_windows(it))
    assert lists.filter("items_key.n = 60").count() == 60 and wins.filter("items_key.n = 60").count() == 31
    want = {1: (40, 60), 2: (12, 1), 3: (0, 0), 4: (42, 60)}
    for size in (decontam.BLOCK_BYTES, 4000):            # one broadcast, or several passes
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {r.doc_id: (r.n_hit, len(r["items"])) for r in decontam.find_windows(docs(spark, texts), it).collect()}
        assert got == want
