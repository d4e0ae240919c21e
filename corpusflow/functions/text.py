"""Text cleaning, previews and sentence chunks as Spark Column expressions.

Everything here is a JVM built-in except entity decoding, which has no Spark
built-in and runs as one Arrow-batched pandas UDF around the stdlib decoder.
"""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's behaviour.
# Python's ``\s`` for str patterns: U+0009-000D, U+001C-001F, U+0020, U+0085, U+00A0,
# U+1680, U+2000-200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Java's plain ``\s`` covers only the ASCII part, so the rest is listed.
PY_WS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
ASCII_WS = r"[\t\n\x0b\f\r ]"
COMMENT_RE = r"(?s)<!--.*?-->"
TAG_RE = r"<[^>]+>"
SENTENCE_BREAK_RE = r"(?<=[.!?])" + PY_WS + "+"
PREVIEW_LENGTH = 280
CHUNK_MAX_CHARS = 700
CHUNK_MAX_COUNT = 8
NO_LIMIT = 2**31 - 1
ELLIPSIS = "…"
EXCERPT_LENGTH = 240


# from an ampersand to the end of its word: no entity goes past white space or a tag's start
ENTITY_RUN_RE = r"&[^\t\n\f <]*"


def _unescape_twice(runs):
    return None if runs is None else [unescape(unescape(r)) for r in runs]


def _unescape_series(s: pd.Series) -> pd.Series:
    return s.map(_unescape_twice)


def html_unescape2(col) -> Column:
    """``html.unescape`` applied twice; NULL becomes ''. One Arrow-batched pandas UDF, which is sent
    the words that have an ``&`` only, from there on: the texts around them stay on the JVM, so that a batch
    in Python is small however long the texts are.

    A fresh UDF object per use: a reused one whose output feeds another Python UDF is not
    always split into its own Arrow evaluation node by the planner.
    """
    text = _c(col)
    coded = text.contains("&")
    runs = F.when(coded, F.regexp_extract_all(text, F.lit(ENTITY_RUN_RE), 0))
    decoded = F.pandas_udf(_unescape_series, T.ArrayType(T.StringType()))(runs)
    # one more piece than runs
    pieces = F.zip_with(F.split(text, ENTITY_RUN_RE, -1), decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
    return F.when(coded, F.array_join(pieces, "")).otherwise(F.coalesce(text, F.lit("")))


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(_c(col), f"^{PY_WS}+|{PY_WS}+$", "")


def collapse_ws(col) -> Column:
    """Python ``re.sub(r'\\s+', ' ', x).strip()``."""
    return F.trim(F.regexp_replace(_c(col), PY_WS + "+", " "))


def clean_markup(col) -> Column:
    """Comment removal, tag removal and whitespace collapse, on already decoded text."""
    x = F.regexp_replace(_c(col), COMMENT_RE, " ")
    x = F.regexp_replace(x, TAG_RE, " ")
    return collapse_ws(x)


def strip_html(col) -> Column:
    """Decode entities twice, drop comments and tags, collapse whitespace. NULL -> ''."""
    return clean_markup(html_unescape2(_c(col)))


def make_preview(col, max_chars: int = PREVIEW_LENGTH) -> Column:
    """Cut to ``max_chars`` code points, back off to the last space if it is not at
    index 0, strip and add an ellipsis; short text is returned unchanged."""
    c = _c(col)
    cut = F.substring(c, 1, max_chars)
    tail = F.substring_index(cut, " ", -1)
    space_at = F.length(cut) - F.length(tail) - 1  # 0-based index of the last space, -1 if none
    cut = F.when(space_at > 0, F.left(cut, space_at)).otherwise(cut)
    return F.when(F.length(c) <= max_chars, c).otherwise(F.concat(py_strip(cut), F.lit(ELLIPSIS)))


def sentence_split(col) -> Column:
    return F.split(_c(col), SENTENCE_BREAK_RE, -1)


def sentence_chunks(col, max_chars: int = CHUNK_MAX_CHARS, max_chunks: int | None = CHUNK_MAX_COUNT) -> Column:
    """Greedy packing of sentences into at most ``max_chunks`` chunks of about
    ``max_chars``; a single long sentence is never split; overflow is dropped. With
    ``max_chunks=None`` there is no limit and nothing is dropped."""
    max_chunks = NO_LIMIT if max_chunks is None else max_chunks
    # The split consumes whole whitespace runs, so only the text's own edges can carry
    # whitespace: stripping the text once equals stripping every sentence.
    sents = F.filter(sentence_split(py_strip(F.coalesce(_c(col), F.lit("")))), lambda s: s != "")
    init = F.struct(F.array().cast("array<string>").alias("o"), F.lit("").alias("u"))

    def merge(acc, s):
        full = F.size(acc["o"]) >= max_chunks
        fits = F.length(acc["u"]) + F.length(s) + 1 <= max_chars
        joined = F.when(acc["u"] == "", s).otherwise(F.concat(acc["u"], F.lit(" "), s))
        flushed = F.when(acc["u"] != "", F.array_append(acc["o"], acc["u"])).otherwise(acc["o"])
        return (
            F.when(full, acc)
            .when(fits, F.struct(acc["o"].alias("o"), joined.alias("u")))
            .otherwise(F.struct(flushed.alias("o"), s.alias("u")))
        )

    def finish(acc):
        return F.when((acc["u"] != "") & (F.size(acc["o"]) < max_chunks), F.array_append(acc["o"], acc["u"])).otherwise(
            acc["o"]
        )

    return F.aggregate(sents, init, merge, finish)


def embedding_text(title, content_clean, max_chunks: int | None = None) -> Column:
    """Clean title, then a blank line and the chunks one per line; title alone if no chunks.
    The whole content goes in unless ``max_chunks`` limits it."""
    # strip_html output has no edge whitespace, so with no chunks this strips back to the title
    t = strip_html(title)
    return py_strip(F.concat(t, F.lit("\n\n"), F.array_join(sentence_chunks(content_clean, max_chunks=max_chunks), "\n")))


def excerpt(col, n: int = EXCERPT_LENGTH) -> Column:
    """Listing excerpt: first ``n`` characters, plus '...' when longer."""
    c = _c(col)
    return F.concat(F.substring(c, 1, n), F.when(F.length(c) > n, F.lit("...")).otherwise(F.lit("")))


def preview_backfill(col, n: int = PREVIEW_LENGTH) -> Column:
    """The data-migration preview: collapse ``\\s`` runs, trim, first ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(_c(col), ASCII_WS + "+", " ")), 1, n)


def display_time(col) -> Column:
    return F.date_format(_c(col), "yyyy-MM-dd HH:mm")


def display_similarity(col) -> Column:
    return F.format_string("%.3f", _c(col))


def display_author(col) -> Column:
    c = _c(col)
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("Anonymous"))
