"""Every operator and stage on awkward rows, on empty tables and on clashing columns."""

import pytest

from tests.llm.cases import TEXTS, docs


def operators(spark):
    from corpusflow.llm import decontam, licenses, line_dedup, lm_score, mixing, quality, simhash, token_counts, toxicity

    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    items = spark.createDataFrame([(1, None), (None, "x y"), (2, ""), (3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")],
                                  "item_id long, text string")

    def dedup(df):
        runs = line_dedup.LineRuns(spark)
        runs.add(df)
        return line_dedup.drop_repeated_lines(df, runs).select("row.doc_id", "kept", "n_lines", "n_dropped")

    return {
        "token_counts": token_counts.count_tokens,
        "toxicity": lambda df: toxicity.detect(df, labels),
        "simhash": simhash.near_duplicates,
        "quality": lambda df: quality.apply_policy(quality.ledger(df)),
        "decontam": lambda df: decontam.find_windows(df, items),
        "decontam_no_items": lambda df: decontam.find_windows(df, items.limit(0)),
        "lm_score": lambda df: lm_score.cross_entropy_difference(df, labels.select("doc_id")),
        "licenses": licenses.scan,
        "mixing": lambda df: mixing.mix(df).documents,
        "line_dedup": dedup,
    }


NAMES = ["token_counts", "toxicity", "simhash", "quality", "decontam", "decontam_no_items", "lm_score", "licenses", "mixing",
         "line_dedup"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_rows_give_one_row_each(spark, name):
    got = operators(spark)[name](docs(spark)).select("doc_id").collect()
    key = lambda x: (x is None, x)
    assert sorted((r[0] for r in got), key=key) == sorted((i for i, _ in TEXTS), key=key)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](docs(spark, [])).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_extra_columns_change_nothing(spark, name):
    op = operators(spark)[name]
    texts = [t for t in TEXTS if t[0] != 6]
    slim = sorted(map(repr, op(docs(spark, texts, extra=False)).drop("root", "text_key").collect()))
    assert sorted(map(repr, op(docs(spark, texts)).drop("root", "text_key").collect())) == slim


def test_pages_edges(spark):
    from corpusflow.llm import html_text

    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (None, "u", "<p>one two three four five six seven</p>"),
            (4, "u", "no markup at all"), (4, "u", "no markup at all"), (5, "u", "<div " + "x" * 200_000),
            (6, "u", "<p>a &lt;b&gt; &amp;amp; " + "word " * 50_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, text string, n_chars string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html_text.extract(df).collect()}
    assert got[1, "u"] == got[2, None] == got[3, "u"] == ("", 0)
    assert got[None, "u"][0] == "one two three four five six seven"
    assert got[4, "u"] == ("no markup at all", 16)
    assert got[6, "u"][0].startswith("a <b> &amp; word word") and got[6, "u"][1] == len("a <b> &amp; " + "word " * 50_000) - 1
    assert html_text.extract(df.limit(0)).collect() == []


def test_stages_keep_columns_and_survive_edges(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(3, "alpha beta gamma delta epsilon zeta eta theta iota kappa")],
                          "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows in (TEXTS, []):
        df = docs(spark, rows)
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{n}-{len(rows)}")
            df = spark.read.schema(df.schema).parquet(f"{tmp_path}/{n}-{len(rows)}")
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == df.count()
        if rows:
            kept = [r.doc_id for r in df.select("doc_id").collect()]
            assert 7 not in kept and len(kept) == len(set(kept))
            assert 1 in kept and 2 not in kept          # exact copies: one stays
