"""DuckDB SQL text for the same semantics, used as the independent correctness oracle.

These builders return SQL expressions over a column expression ``x``. They mirror
the Spark Column functions but are written against DuckDB's RE2 regex dialect
(no lookbehind) and list lambdas.
"""

from __future__ import annotations

# Python's \s as an RE2 class (RE2's own \s lacks \x0b and everything non-ASCII).
WS = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ASCII_WS = r"[\t\n\x0b\f\r ]"
EMPTY = "''"


def unescape_once(x: str) -> str:
    # The named entities that occur in the data, decoded left to right; names legal
    # without ';' are matched with an optional ';' like Python's decoder does.
    # '&amp;' goes last so that what it produces is only decoded by the next round.
    for ent, ch in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"),
                    ("nbsp", "\u00a0"), ("amp", "&")):
        x = f"regexp_replace({x}, '&{ent};?', '{ch}', 'g')"
    return x


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def strip_html(x: str) -> str:
    u = unescape_once(unescape_once(f"coalesce({x}, '')"))
    u = f"regexp_replace({u}, '(?s)<!--.*?-->', ' ', 'g')"
    u = f"regexp_replace({u}, '<[^>]+>', ' ', 'g')"
    return f"trim(regexp_replace({u}, '{WS}+', ' ', 'g'))"


def make_preview(x: str, n: int = 280) -> str:
    cut = f"left({x}, {n})"
    backed = (f"case when regexp_matches({cut}, '(?s)^.+ ') then regexp_extract({cut}, '(?s)^(.+) ', 1) "
              f"else {cut} end")
    return f"(case when length({x}) <= {n} then {x} else {py_strip(backed)} || '…' end)"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1))"


def sentence_chunks(x: str, max_chars: int = 700, max_chunks: int = 8) -> str:
    sents = f"list_filter(list_transform({sentences(f'coalesce({x}, {EMPTY})')}, lambda s: {py_strip('s')}), lambda s: s <> '')"
    items = f"list_transform({sents}, lambda s: {{'o': []::varchar[], 'u': s}})"
    step = (
        "lambda a, e: case when len(a.o) >= {mc} then a "
        "when length(a.u) + length(e.u) + 1 <= {mx} then {{'o': a.o, 'u': case when a.u = '' then e.u else a.u || ' ' || e.u end}} "
        "else {{'o': case when a.u <> '' then list_append(a.o, a.u) else a.o end, 'u': e.u}} end"
    ).format(mc=max_chunks, mx=max_chars)
    red = f"list_reduce({items}, {step}, {{'o': []::varchar[], 'u': ''}})"
    return f"(select case when r.u <> '' and len(r.o) < {max_chunks} then list_append(r.o, r.u) else r.o end from (select unnest([{red}]) as r))"


def embedding_text(title: str, content_clean: str, max_chunks: int = 2**31 - 1) -> str:
    return py_strip(f"{strip_html(title)} || chr(10) || chr(10) || array_to_string({sentence_chunks(content_clean, max_chunks=max_chunks)}, chr(10))")
