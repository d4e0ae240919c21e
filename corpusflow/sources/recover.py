"""Entries of a feed document that is not well-formed XML.

A scanner over tags, CDATA and text that never stops at an error: unknown entities, bare ``&`` and
``<``, wrong nesting and control characters are text or ignored, and an entry ends at its end tag,
at the next entry's start or at the feed's end tag. A field without its
end tag is lost, and an entry that the file's end cuts off is dropped, since its fields may be
cut too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa

TOKEN = re.compile(
    r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>"
    r"|<(?P<end>/)?(?P<name>[A-Za-z_][\w:.\-]*)(?P<attrs>(?:\s+[\w:.\-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'))*)\s*(?P<empty>/)?>", re.S)
ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
FEEDS, ENTRIES = {"channel", "feed", "rdf:rdf"}, {"item", "entry"}
# elements whose titles, links and ids are not the feed's or the entry's
OTHERS = {"image", "textinput", "source", "author", "contributor"}
# element -> entry field, for RSS (1.0 and 2.0) items and for Atom entries
ITEM = {"guid": "guid", "link": "link", "title": "title", "description": "summary", "content:encoded": "content", "pubdate": "published"}
ENTRY = {"id": "id", "title": "title", "summary": "summary", "content": "content", "published": "published", "updated": "updated"}
FIELDS = ("id", "guid", "link", "title", "content", "summary", "published", "updated")

ENTRY_ARROW = pa.list_(pa.struct([(f, pa.list_(pa.struct([("value", pa.string())])) if f == "content" else pa.string()) for f in FIELDS]))
RECOVERED = pa.schema([("feed_url", pa.string()), ("feed_title", pa.string()), ("entries", ENTRY_ARROW), ("failed", pa.bool_())])


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] if m[2] is not None else m[3]) for m in ATTR.finditer(text)}


class Scanner:
    """``feeds``: title and whole entries of each feed of a file, in order."""

    def __init__(self) -> None:
        self.feeds: list[tuple[str | None, list[dict]]] = []
        self.title: str | None = None
        self.entries: list[dict] = []
        self.entry: dict | None = None
        self.rdf = False
        self.skip: str | None = None                  # inside one of OTHERS
        self.field: str | None = None                 # element being read
        self.depth, self.raw, self.plain, self.marked = 0, [], [], False

    def read(self, text: str) -> None:
        at = 0
        for m in TOKEN.finditer(text):
            self.text(text[at:m.start()])
            at = m.end()
            if m["cdata"] is not None:
                self.text(m["cdata"], False)
            elif m["name"]:
                self.tag(m["name"].lower(), bool(m["end"]), bool(m["empty"]), m["attrs"] or "", m[0])
        self.entry = None               # cut off by the end of the file
        self.next_feed()

    def next_feed(self) -> None:
        if self.title is not None or self.entries:
            self.feeds.append((self.title, self.entries))
        self.title, self.entries, self.rdf = None, [], False

    def text(self, text: str, escaped: bool = True) -> None:
        if self.field:
            self.raw.append(text)
            self.plain.append(html.unescape(text) if escaped else text)

    def tag(self, name: str, end: bool, empty: bool, attrs: str, source: str) -> None:
        if name in ENTRIES or (end and name in FEEDS | {"rss"}):
            self.close()
            if name in ENTRIES and not end:
                self.entry = {"kind": name}
                if self.rdf:
                    self.entry["id"] = attributes(attrs).get("rdf:about")
        elif self.field:
            self.inside(name, end, empty, source)
        elif self.skip:
            if end and name == self.skip:
                self.skip = None
        elif not end:
            if name in FEEDS and self.entry is None and not (self.rdf and name == "channel"):
                self.next_feed()
            self.rdf |= name == "rdf:rdf"
            if name in OTHERS and not empty:
                self.skip = name
            elif self.entry is not None and self.entry["kind"] == "entry" and name == "link":
                self.link(attributes(attrs))
            elif not empty and name in self.wanted():
                self.field, self.depth, self.raw, self.plain, self.marked = name, 0, [], [], False

    def wanted(self) -> set[str]:
        if self.entry is None:
            return {"title"} if self.title is None else set()
        return set(ITEM) | {"dc:date"} if self.entry["kind"] == "item" else set(ENTRY)

    def inside(self, name: str, end: bool, empty: bool, source: str) -> None:
        if end and name == self.field and self.depth == 0:
            value = "".join(self.raw if self.marked else self.plain)
            if self.entry is None:
                self.title = value
            else:
                kind = ITEM | ({"dc:date": "updated"} if self.rdf else {}) if self.entry["kind"] == "item" else ENTRY
                if name in kind:
                    self.entry.setdefault(kind[name], value)
            self.field = None
            return
        if name == self.field and not empty:
            self.depth += -1 if end else 1
        self.raw.append(source)          # markup inside a field is its text
        self.marked = True

    def link(self, attrs: dict[str, str]) -> None:
        if attrs.get("rel", "alternate") == "alternate" and "href" in attrs:
            self.entry.setdefault("link", attrs["href"])

    def close(self) -> None:
        if self.entry is not None and len(self.entry) > 1:        # it has a field
            e = {f: self.entry.get(f) for f in FIELDS}
            e["content"] = [] if e["content"] is None else [{"value": e["content"]}]
            self.entries.append(e)
        self.entry = self.field = self.skip = None


def recover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feed_url, text of the damaged file) to its feed documents, at least one per file."""
    for b in batches:
        for url, text in zip(b.column("feed_url").to_pylist(), b.column("text").to_pylist()):
            found = Scanner()
            found.read(text)
            yield pa.RecordBatch.from_pylist([{"feed_url": url, "feed_title": title, "entries": entries, "failed": not entries}
                                              for title, entries in found.feeds or [(None, [])]], RECOVERED)
