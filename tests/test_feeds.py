from pyspark.sql import functions as F

from corpusflow.operators import entries as E
from corpusflow.sources import feeds as FD

RSS = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>Feed One</title>
<item><guid isPermaLink="false">g1</guid><link>https://x/1</link><title>T1</title><description>&lt;p&gt;Hi&lt;/p&gt;</description>
<content:encoded><![CDATA[<p>Full <b>one</b></p>]]></content:encoded><pubDate>Tue, 06 May 2026 10:00:00 GMT</pubDate></item>
<item><link>https://x/2</link><title>T2</title><description>Two</description><pubDate>Wed, 07 May 2026 10:00:00 +0200</pubDate></item>
</channel></rss>"""
ATOM = """<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>Atom Two</title>
<entry><id>tag:a,1</id><link href="https://y/1"/><title>A1</title><summary>S1</summary><content type="html">&lt;b&gt;C1&lt;/b&gt;</content>
<published>2026-05-06T10:00:00Z</published><updated>2026-05-06T11:00:00Z</updated></entry></feed>"""


def test_rss_and_atom_to_normalised_entries(spark, scratch):
    import os

    os.makedirs(f"{scratch}/rss")
    os.makedirs(f"{scratch}/atom")
    open(f"{scratch}/rss/one.xml", "w").write(RSS)
    open(f"{scratch}/atom/two.xml", "w").write(ATOM)
    docs = FD.feed_documents(spark, f"{scratch}/rss/*.xml", f"{scratch}/atom/*.xml")
    flat = E.flatten_feeds(docs)
    norm = {r.link: r for r in E.normalize_entries(flat, F.to_timestamp(F.lit("2026-01-01 00:00:00"))).collect()}
    assert norm["https://x/1"].guid == "g1" and norm["https://x/1"].content_clean == "Full one"
    assert norm["https://x/1"].source == "Feed One"
    assert norm["https://x/2"].guid == "https://x/2" and norm["https://x/2"].content_clean == "Two"
    assert str(norm["https://x/2"].published_at) == "2026-05-07 08:00:00"
    assert norm["https://y/1"].guid == "tag:a,1" and norm["https://y/1"].content_clean == "C1"
    assert norm["https://y/1"].source == "Atom Two" and norm["https://y/1"].published_ok
    fails = FD.failed_feeds(docs).collect()
    assert not any(r.failed for r in fails)


def test_missing_or_broken_feed_is_failed(spark, scratch):
    import os

    os.makedirs(f"{scratch}/rss")
    open(f"{scratch}/rss/good.xml", "w").write(RSS)
    open(f"{scratch}/rss/broken.xml", "w").write("<rss><channel><title>Broken</title><item><link>x</item></chan")
    docs = FD.feed_documents(spark, f"{scratch}/rss/*.xml")
    good = [r.feed_url for r in docs.collect() if r.feed_url.endswith("good.xml")][0]
    expected = spark.createDataFrame([(good,), ("file:/never/landed.xml",)], "feed_url string")
    got = {r.feed_url: r.failed for r in FD.failed_feeds(docs, expected).collect()}
    assert got == {good: False, "file:/never/landed.xml": True}
    per_file = {r.feed_url.rsplit("/", 1)[-1]: r for r in FD.failed_feeds(docs).collect()}
    assert per_file["good.xml"].n_entries == 2 and not per_file["good.xml"].failed
    if "broken.xml" in per_file:  # a corrupt document parses to a corrupt record with no entries
        assert per_file["broken.xml"].failed


def test_rdf_items_and_xhtml_content(spark, scratch):
    import os

    from corpusflow.sources.feeds import feed_documents

    for name, text in (
        ("rdf", '''<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"
            xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">
            <channel rdf:about="https://c"><title>Old feed</title></channel>
            <item rdf:about="https://l/1"><title>one</title><link>https://l/1</link><description>d &lt;b&gt;e&lt;/b&gt;</description>
            <dc:date>2024-01-02T03:04:05Z</dc:date></item><item rdf:about="https://l/2"><title>two</title><link>https://l/2</link></item>
            </rdf:RDF>'''),
        ("atom", '''<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>New feed</title>
            <entry><id>x</id><link href="https://l/3"/><title>three</title>
            <content type="xhtml"><div xmlns="http://www.w3.org/1999/xhtml"><p>Hello <b>bold</b> text</p></div></content></entry>
            <entry><id>y</id><link href="https://l/4"/><title>four</title><content type="html">&lt;p&gt;a &amp;amp; b&lt;/p&gt;</content></entry>
            </feed>'''),
    ):
        os.makedirs(f"{scratch}/{name}")
        with open(f"{scratch}/{name}/f.xml", "w") as f:
            f.write(text)
    docs = feed_documents(spark, rdf_path=f"{scratch}/rdf", atom_path=f"{scratch}/atom")
    n = {r.link: r for r in E.normalize_entries(E.flatten_feeds(docs), F.lit("2020-01-01").cast("timestamp")).collect()}
    assert (n["https://l/1"].guid, n["https://l/1"].source, n["https://l/1"].content_clean) == ("https://l/1", "Old feed", "d e")
    assert str(n["https://l/1"].published_at) == "2024-01-02 03:04:05" and not n["https://l/2"].published_ok
    assert n["https://l/3"].content_clean == "Hello bold text" and n["https://l/4"].content_clean == "a & b"


HEAD = '<?xml version="1.0"?>\n<rss version="2.0"><channel><title>Feed</title><image><title>logo</title></image>\n'
TAIL = "</channel></rss>"


def item(k, title="T", body="&lt;p&gt;d&lt;/p&gt;"):
    return f"<item><guid>g{k}</guid><link>https://x/{k}</link><title>{title}</title><description>{body}</description></item>\n"


# name -> (file, guids, titles): whole entries before and after each error
DAMAGED = {
    "bare_amp": (HEAD + item(1) + item(2, "A & B") + item(3) + TAIL, ["g1", "g2", "g3"], ["T", "A & B", "T"]),
    "entity": (HEAD + item(1, "caf&eacute;") + item(2) + TAIL, ["g1", "g2"], ["café", "T"]),
    "bare_lt": (HEAD + item(1) + item(2, "a < b") + item(3) + TAIL, ["g1", "g2", "g3"], ["T", "a < b", "T"]),
    "nesting": (HEAD + item(1) + item(2, "T", "<b>x</i>") + item(3) + TAIL, ["g1", "g2", "g3"], ["T"] * 3),
    "control": (HEAD + item(1) + item(2, "a\x0bb") + item(3) + TAIL, ["g1", "g2", "g3"], ["T", "a\x0bb", "T"]),
    "cut": (HEAD + item(1) + item(2) + item(3)[:45], ["g1", "g2"], ["T"] * 2),
    "open_item": (HEAD + item(1) + item(2).replace("</item>", "") + item(3) + TAIL, ["g1", "g2", "g3"], ["T"] * 3),
    "open_field": (HEAD + item(1) + item(2).replace("</description>", "") + item(3) + TAIL, ["g1", "g2", "g3"], ["T"] * 3),
    "cdata": (HEAD + item(1, "<![CDATA[x & <item> y]]>") + item(2, "&") + TAIL, ["g1", "g2"], ["x & <item> y", "&"]),
}


def test_whole_entries_of_damaged_feeds_are_recovered(spark, scratch):
    import os

    os.makedirs(f"{scratch}/rss")
    for name, (text, _, _) in DAMAGED.items():
        open(f"{scratch}/rss/{name}.xml", "w").write(text)
    extra = {"good": HEAD + item(1) + TAIL, "no_items": HEAD + TAIL, "empty": "", "page": "<html><body>404</body></html>",
             "no_entry": HEAD + item(1)[:30]}
    for name, text in extra.items():
        open(f"{scratch}/rss/{name}.xml", "w").write(text)
    docs = FD.feed_documents(spark, f"{scratch}/rss/*.xml").collect()
    got = {r.feed_url.rsplit("/", 1)[-1][:-4]: r for r in docs}
    assert len(docs) == len(got)
    for name, (_, guids, titles) in DAMAGED.items():
        assert [e.guid for e in got[name].entries] == guids, name
        assert [e.title for e in got[name].entries] == titles, name
        assert got[name].feed_title == "Feed" and not got[name].failed, name
    assert got["nesting"].entries[1].summary == "<b>x</i>" and got["bare_amp"].entries[0].summary == "<p>d</p>"
    landed = FD.landed_files(spark, f"{scratch}/rss/*.xml")
    folder = got["good"].feed_url.rsplit("/", 1)[0]
    absent = spark.createDataFrame([("file:/never/landed.xml", 0), (f"{folder}/empty.xml", 0)], "feed_url string, length long")
    fails = FD.failed_feeds(FD.feed_documents(spark, f"{scratch}/rss/*.xml"), landed.unionByName(absent)).collect()
    assert {r.feed_url.rsplit("/", 1)[-1][:-4] for r in fails if r.failed} == {"empty", "page", "no_entry", "landed"}


def test_damaged_atom_and_rdf_and_files_with_several_channels(spark, scratch):
    import os

    atom = ATOM.replace("<title>A1</title>", "<title>A1 & more</title><source><title>other</title><id>no</id></source>")
    rdf = ('<rdf:RDF xmlns:rdf="r"><channel rdf:about="https://c"><title>Old & feed</title></channel><item rdf:about="https://l/1">'
           "<title>one</title><link>https://l/1</link><dc:date>2024-01-02T03:04:05Z</dc:date></item></rdf:RDF>")
    two = "<feeds><channel><title>One</title>" + item(1) + "</channel><channel><title>Two</title>" + item(2, "&") + item(3) + "</channel></feeds>"
    for name, text in (("atom", atom), ("rdf", rdf), ("rss", two)):
        os.makedirs(f"{scratch}/{name}")
        open(f"{scratch}/{name}/f.xml", "w").write(text)
    a = FD.read_atom(spark, f"{scratch}/atom").collect()
    assert [(e.id, e.link, e.title, e.summary, e.content[0].value, e.published) for r in a for e in r.entries] == [
        ("tag:a,1", "https://y/1", "A1 & more", "S1", "<b>C1</b>", "2026-05-06T10:00:00Z")]
    r = FD.read_rdf(spark, f"{scratch}/rdf").collect()
    assert [(x.feed_title, e.id, e.link, e.updated) for x in r for e in x.entries] == [
        ("Old & feed", "https://l/1", "https://l/1", "2024-01-02T03:04:05Z")]
    # the first channel was whole: its entry is not read twice
    assert [(x.feed_title, [e.guid for e in x.entries]) for x in FD.read_rss(spark, f"{scratch}/rss").collect()] == [
        ("One", ["g1"]), ("Two", ["g2", "g3"])]
