"""Every pipeline stage against plain Python on what the stage before it kept."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ("__terms", "__score", "__bad_id", "row", "score", "key", "id", "bad_id", "kept", "h1")


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A small corpus with its labels and benchmark: documents of sf0.001 and planted cases."""
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(x.doc_id, x.text, x.lang, x.source, x.n_chars) for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    plain = lambda n: " ".join(r.choice("abcdefghij") + str(r.randrange(400)) for _ in range(n))
    rows += [(10_000 + i, f"{plain(60)}\nseen in every one\n{plain(5)}", "en", "made", 0) for i in range(12)]
    rows += [(11_000, f"{plain(20)} {passage} {plain(20)}", "en", "made", 0), (11_001, None, None, None, None), (11_002, "", "en", "made", 0)]
    rows += [(11_003 + i, plain(1) + " the very same words", None, "made", 0) for i in range(2)] + [rows[5]] * 2
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, f"{passage} tail"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_equal_plain_python(spark, table, monkeypatch):
    import corpus_pipeline as p

    from corpusflow.llm import toxicity

    seen, real = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda *a, **k: seen.append(real(*a, **k)) or seen[-1])
    docs = spark.read.parquet(f"{table}/documents.parquet")
    key = lambda x: tuple((v is None, v) for v in x)
    inputs = {}
    for name, stage in p.STAGES:
        inputs[name] = sorted(map(tuple, docs.collect()), key=key)
        stage(spark, docs, table).write.parquet(f"{table}/{name}")
        docs = spark.read.parquet(f"{table}/{name}")
    names = [n for n, _ in p.STAGES]
    out = {n: inputs.get(names[i + 1]) if i + 1 < len(names) else docs.collect() for i, n in enumerate(names)}

    # toxicity: the model's own terms and weights, scored one text at a time
    df = spark.createDataFrame([(x[1],) for x in inputs["toxicity"]], "text string")
    slots = [r.t for r in df.select(toxicity.terms(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    scores = 1 / (1 + 2.718281828459045 ** -seen[0].margin(slots))
    order = [r.text for r in df.collect()]
    score = dict(zip(order, scores))
    assert out["toxicity"] == [x for x in inputs["toxicity"] if score[x[1]] < toxicity.THRESHOLD]

    # line dedup
    def line_key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    counts = {}
    for x in inputs["line_dedup"]:
        for k in {line_key(line) for line in (x[1] or "").split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    want = []
    for i, t, lang, source, n in inputs["line_dedup"]:
        stay = [line for line in (t or "").split("\n") if not line_key(line) or counts[line_key(line)] < 10]
        cut = len(stay) < len((t or "").split("\n"))
        want.append((i, "\n".join(stay) if cut else t, lang, source, len("\n".join(stay)) if cut else n))
    assert out["line_dedup"] == sorted(want, key=key) and any("seen in every one" in (x[1] or "") for x in inputs["line_dedup"])

    # SimHash near duplicates: one document of each group of linked fingerprints
    from xxhash import xxh64_intdigest

    def print_of(text):
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
        hs = [xxh64_intdigest(" ".join(ws[i:i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
        bits = np.array(hs, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)
        return sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(hs))

    docs_in = inputs["simhash_near_dedup"]
    prints = [print_of(x[1]) for x in docs_in]
    group = list(range(len(docs_in)))
    for a in range(len(docs_in)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2 or docs_in[a][0] == docs_in[b][0]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    first = {}
    for g, x in zip(group, docs_in):
        first[g] = min(first.get(g, x[0]), x[0])
    kept = out["simhash_near_dedup"]
    assert sorted(x[0] for x in kept) == sorted(first.values()) and set(kept) <= set(docs_in)

    # decontamination
    def ws5(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w]

    items = [ws5(r.text) for r in spark.read.parquet(f"{table}/benchmark.parquet").collect()]
    wins = {tuple(w[i:i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    lengths = {len(w) for w in wins}

    def clean(t):
        ws = ws5(t)
        return not any(tuple(ws[i:i + n]) in wins for n in lengths for i in range(len(ws) - n + 1))

    assert out["decontamination"] == [x for x in inputs["decontamination"] if clean(x[1])]
    assert len(out["decontamination"]) < len(inputs["decontamination"])

    # mixing: every document once, sizes and sources' sizes right, targets met
    rows = {r.doc_id: r for r in out["mixing"]}
    size = lambda t: len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
    assert len(rows) == len(inputs["mixing"])
    assert all(rows[x[0]]["size"] == size(x[1]) and rows[x[0]].source == x[3] for x in inputs["mixing"])
    for s in {r.source for r in rows.values()}:
        mine = [r for r in rows.values() if r.source == s]
        assert {r.source_size for r in mine} == {sum(r["size"] for r in mine)}
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 1 and all(r.taken <= 2 * r["size"] for r in mine)


def test_stages_keep_columns_of_any_name(spark, table):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{table}/documents.parquet").select("*", *[F.lit(f"{c}!").alias(c) for c in CLASHES])
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, table)
        assert got.columns == docs.columns, name
        row = got.first()
        assert all(row[c] == f"{c}!" for c in CLASHES), name


def test_string_ids_and_empty_labels(spark):
    from corpusflow.llm import toxicity

    docs = spark.createDataFrame([(f"d{i}", f"word{i % 7} you are an idiot" if i % 3 == 0 else f"word{i % 7} is fine") for i in range(200)],
                                 "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 == 0)) for i in range(200)], "doc_id string, toxic int")
    got = toxicity.detect(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert got and all(r.predicted == r.toxic for r in got)
    assert {r.predicted for r in toxicity.detect(docs, labels.limit(0)).collect()} == {0}
