
import math
import random

import pytest

from .cases import docs


def test_lm_score_counts_more_bigrams_than_any_fixed_table(spark, monkeypatch):
    from corpusflow.llm import lm_score as m

    monkeypatch.setattr(m, "BLOCK_CHARS", 20_000, raising=False)
    r = random.Random(3)
    texts = [(i, " ".join(f"w{int(r.paretovariate(0.4)) % 9_000}" for _ in range(r.randrange(1, 120)))) for i in range(600)]
    texts += [(i + 600, texts[i][1]) for i in range(50)]
    chosen = {i for i, _ in texts if i % 7 == 0}
    good = spark.createDataFrame([(i,) for i in chosen], "doc_id long")
    got = {x.doc_id: x for x in m.cross_entropy_difference(docs(spark, texts, extra=False), good).collect()}

    def counts(held):
        uni, ctx, pair = {}, {}, {}
        for _, t in held:
            ws = t.split()
            for u, w in zip(["^", *ws], ws):
                uni[w], ctx[u], pair[u, w] = uni.get(w, 0) + 1, ctx.get(u, 0) + 1, pair.get((u, w), 0) + 1
        return uni, ctx, pair

    models = [(counts([t for t in texts if t[0] in chosen]), chosen), (counts(texts), {i for i, _ in texts})]
    vocabulary = len(models[1][0][0]) + 1
    assert vocabulary > 2_000 and len(models[1][0][2]) > 10_000
    for i, t in texts:
        ws = t.split()
        for (held, members), loss in zip(models, (got[i].target_loss, got[i].background_loss)):
            own = counts([(i, t)]) if i in members else ({}, {}, {})
            n = sum(held[0].values()) - (len(ws) if i in members else 0)
            c = [lambda k, h=h, o=o: h.get(k, 0) - o.get(k, 0) for h, o in zip(held, own)]
            each = [-math.log((c[2]((u, w)) + m.STRENGTH * (c[0](w) + 1) / (n + vocabulary)) / (c[1](u) + m.STRENGTH))
                    for u, w in zip(["^", *ws], ws)]
            assert loss == pytest.approx(sum(each) / len(each), abs=1e-9)


def test_toxicity_learns_pairs_of_terms_that_say_nothing_alone(spark):
    import numpy as np

    from corpusflow.llm import toxicity

    r = np.random.default_rng(1)
    texts, labels = [], []
    for i in range(3_000):                  # toxic only where both meet or neither is there
        a, b = r.random(2) < 0.5
        filler = " ".join(f"{'abcdefghij'[x % 10]}{'klmnopqrst'[x // 10 % 10]}" for x in r.integers(0, 100, 6))
        texts.append((i, f"{'ux' if a else 'uy'} {'vx' if b else 'vy'} {filler}"))
        labels.append((i, int(a == b)))
    got = toxicity.detect(docs(spark, texts, extra=False), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    held = [(x.score >= 0.5, labels[x.doc_id][1]) for x in got if x.held_out]
    toxic = [p for p, y in held if y == 1]
    clean = [p for p, y in held if y == 0]
    assert len(toxic) > 200 and sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.1


def test_toxicity_held_out_recall(spark):
    from corpusflow.llm.queries import op2_toxicity

    sf = "/root/testdata/sf0.1"
    rows = op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [x.predicted for x in rows if x.toxic == 1]
    clean = [x.predicted for x in rows if x.toxic == 0]
    print(f"held out: {sum(toxic)} of {len(toxic)} toxic, {sum(clean)} of {len(clean)} clean")
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.01


def test_licenses_known_as_whole_wrapped_texts(spark):
    import re
    import textwrap

    from corpusflow.llm import licenses

    def wrapped(text, width):
        """Paragraphs without a copyright notice, wrapped anew."""
        out = []
        for para in re.split(r"\n\s*\n", text):
            notice = re.search(r"(?im)^\s*copyright\W*(\(c\)|\[|<)", para)
            out.append(para if notice else textwrap.fill(" ".join(para.split()), width, break_long_words=False, break_on_hyphens=False))
        return "\n\n".join(out)

    from pathlib import Path

    texts = {p.stem: p.read_text() for p in (Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    texts |= {"MIT": licenses.MIT, "ISC": licenses.ISC, "0BSD": licenses.ZERO_BSD, "BSD-2-Clause": licenses.BSD_2, "BSD-3-Clause": licenses.BSD_3}
    rows = [(name, w, wrapped(t, w)) for name, t in texts.items() for w in (40, 50, 60, 66, 72, 76, 80, 100)]
    rows += [(name, 0, t) for name, t in texts.items()]
    isc = licenses.ISC.replace("the above copyright notice", "the above\ncopyright notice")
    rows += [("ISC", 1, isc), ("MIT", 1, licenses.MIT.replace("(c) <year> <copyright holders>", "Jane Doe")),
             ("Apache-2.0", 1, texts["Apache-2.0"].split("APPENDIX")[0]), ("GPL-3.0", 1, texts["GPL-3.0"].split("How to Apply These")[0])]
    found = {r.doc_id: r.license_id for r in licenses.scan(docs(spark, [(i, t) for i, (_, _, t) in enumerate(rows)], extra=False)).collect()}
    assert [(n, w) for i, (n, w, _) in enumerate(rows) if found[i] != n] == []
    assert licenses.canonical("copyright notice and this permission notice appear") and licenses.canonical("(c) You must retain")
    assert not licenses.canonical("Copyright (C) 2007 Free Software Foundation") and not licenses.canonical("(c) 2020 Me")


@pytest.mark.parametrize("attrs, shown", [
    ('title="A hidden gem"', True), ('class="grid hidden lg:block"', True), ("data-x='aria-hidden=\"true\"'", True),
    ("hidden", False), ('hidden=""', False), ("class=a aria-hidden=true", False), ('style="color:red; display: none"', False)])
def test_html_text_reads_hiding_attributes_by_name(spark, attrs, shown):
    from corpusflow.llm.html_text import extract

    story = "The river rose in the night and the town woke to water in every street of the old quarter. " * 4
    page = f"<html><body><nav><a>Home</a></nav><article {attrs}><h1>Flood</h1><p>{story}</p></article></body></html>"
    df = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert ("water in every street" in extract(df).first().text) == shown


def test_html_text_keeps_math(spark):
    from corpusflow.llm.html_text import extract

    story = "The energy of a body at rest follows from its mass by the relation that is shown here in the text. " * 3
    math = "<math><mi>E</mi><mo>=</mo><mi>mcc</mi><annotation>TeXsource</annotation></math>"
    page = f"<html><body><article><p>{story}{math} {story}</p></article></body></html>"
    text = extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text
    assert "E=mcc" in text and "TeXsource" not in text
