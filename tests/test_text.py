import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL
from corpusflow.functions import text as X
from corpusflow.plans import sqltext as S


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c")).alias("r")).first()["r"]


def test_strip_html_exact(spark):
    assert one(spark, "<ul><li>Tide&nbsp;tables</li><li>for   May</li></ul>", X.strip_html) == "Tide tables for May"
    assert one(spark, "4 &lt;i&gt;knots&lt;/i&gt; &amp; falling", X.strip_html) == "4 knots & falling"
    assert one(spark, "Pier<!-- map\nof the <b>pier</b> -->7", X.strip_html) == "Pier 7"


def test_sentence_chunks_pack_and_stop(spark):
    text = "Low water at six. High water at noon! Will it hold? It will."
    assert one(spark, text, lambda c: X.sentence_chunks(c, 40, 2)) == ["Low water at six. High water at noon!", "Will it hold? It will."]
    assert one(spark, text, lambda c: X.sentence_chunks(c, 20, 2)) == ["Low water at six.", "High water at noon!"]
    assert one(spark, text, lambda c: X.sentence_chunks(c, 20, None)) == ["Low water at six.", "High water at noon!", "Will it hold?", "It will."]


def test_embedding_text_holds_the_whole_content(spark):
    body = " ".join(f"Buoy {i} reports {i * 7} metres of fog." for i in range(400))
    df = spark.createDataFrame([("<i>Fog</i> log", body)], "t string, c string")
    whole, cut, bare = df.select(X.embedding_text(F.col("t"), F.col("c")), X.embedding_text(F.col("t"), F.col("c"), 2),
                                 X.embedding_text(F.col("t"), F.lit(""))).first()
    assert whole.startswith("Fog log\n\nBuoy 0 ") and whole.split("\n", 2)[2].split() == body.split()
    assert len(cut.split("\n")) == 4 and bare == "Fog log"


def test_make_preview_backs_off_to_a_word(spark):
    assert one(spark, "harbour lights go out at two", lambda c: X.make_preview(c, 17)) == "harbour lights…"
    assert one(spark, "at anchor", X.make_preview) == "at anchor"


# (input, expected) worked out by hand from the cleaning rules
STRIP_CASES = [
    (None, ""), ("", ""), ("<b></b><i></i>", ""), ("unclosed <b", "unclosed <b"),
    ("a <!-- x > y --> b", "a b"), ("<script>var t=1;</script>kept", "var t=1; kept"),
    ("a&nbsp;b c　d\x1ce f", "a b c d e f"), ("&amp;lt;p&amp;gt;x", "x"), ("&amp b", "& b"),
    ("1 &lt; 2 &gt; 0", "1 0"), ("&copy &middot; &quot;q&quot;", "© · \"q\""),
]
PREVIEW_CASES = [
    ("x" * 280, "x" * 280), ("x" * 281, "x" * 280 + "…"), (" " + "z" * 300, "z" * 279 + "…"),
    ("w" * 279 + " " + "v" * 5, "w" * 279 + "…"), ("a b " * 80, ("a b " * 70)[:279] + "…"),
    ("\U0001F600" * 290, "\U0001F600" * 280 + "…"), ("", ""),
]
CHUNK_CASES = [
    ("s" * 800 + ". tail.", ["s" * 800 + ".", "tail."]),
    ("Short. " * 300, [("Short. " * 100).strip()] * 3),
    ("Short. " * 1000, [("Short. " * 100).strip()] * 8),
    ("no end punctuation at all", ["no end punctuation at all"]),
    ("p" * 700, ["p" * 700]), ("", []), ("a! b? c. d", ["a! b? c. d"]),
]


def test_edge_rows(spark):
    for value, expected in STRIP_CASES:
        assert one(spark, value, X.strip_html) == expected, value
    for value, expected in PREVIEW_CASES:
        assert one(spark, value, X.make_preview) == expected, value[:20]
    for value, expected in CHUNK_CASES:
        assert list(one(spark, value, X.sentence_chunks)) == expected, value[:20]


def test_pages_agree_with_duckdb(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: (r.clean, r.prev, list(r.ch)) for r in pages.select(
        "page_id", X.strip_html("html").alias("clean")).select(
        "page_id", "clean", X.make_preview("clean").alias("prev"), X.sentence_chunks("clean").alias("ch")).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{SF_SMALL}/pages.parquet')")
    rows = con.execute(f"select page_id, c, {S.make_preview('c')}, {S.sentence_chunks('c')} from "
                       f"(select page_id, {S.strip_html('html')} as c from pages)").fetchall()
    assert len(rows) == len(got)
    for pid, clean, prev, chunks in rows:
        assert got[pid] == (clean, prev, list(chunks)), pid
        assert "<" not in clean or ">" not in clean.split("<", 1)[1]  # no tag-like run survives
        assert clean.startswith(chunks[0][:40]) if chunks else clean == ""


def test_excerpt_and_backfill(spark):
    assert one(spark, "e" * 250, X.excerpt) == "e" * 240 + "..."
    assert one(spark, "short", X.excerpt) == "short"
    assert one(spark, "  a \n\t b  ", X.preview_backfill) == "a b"
    assert one(spark, None, X.display_author) == "Anonymous"
    assert one(spark, "", X.display_author) == "Anonymous"


def test_unescape_is_sent_the_entities_only(spark, monkeypatch):
    from html import unescape

    from corpusflow.functions import text as X

    cases = ["", "plain", None, "&amp;lt;b&amp;gt; x &lt; y", "a&b&c d", "&", "&&amp;&", "R&D &notit; &ampamp; &#38;#60; &#x26;amp;",
             "x&#32;y&#10;z &amp;\tq&lt\n&gt;\f&copy", "<a href='?a=1&amp;b=2&copy=3'>q</a>&nbsp;&eacute", "tail &amp;amp;", "&#0;&#128;&#xD800; &#99999999;",
             "é&eacute;\U0001f600&amp;\U0001f600 &" + "x" * 40 + ";", "&\u00a0amp; &am\rp; &lt;!--&amp;--&gt;", "w" * 50_000 + " &amp; " + "v" * 50_000]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", X.html_unescape2("t").alias("x")).collect()}
    assert got == {i: unescape(unescape(c or "")) for i, c in enumerate(cases)}

    # before: whole texts crossed to Python
    def short(s):
        assert all(len(r) < 100 for runs in s if runs is not None for r in runs)
        return s.map(lambda runs: None if runs is None else [unescape(unescape(r)) for r in runs])

    monkeypatch.setattr(X, "_unescape_series", short)
    assert df.filter("i = 14").select(X.html_unescape2("t").alias("x")).first().x == "w" * 50_000 + " & " + "v" * 50_000
