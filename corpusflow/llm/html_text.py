"""Main text of web pages by the maximum-scoring subsequence of their words and tags.

A page is read as a sequence of words and tags. Tags score negative; a word scores positive or
negative by the block that holds it (its tag, length and share of links) and by its surroundings
(section tags, class and id names of the open elements). All weights are log ratios counted on
labelled pages. One linear scan finds the best contiguous region, and the page's text is taken from
there; within it, elements whose surroundings score clearly negative are left out.

Names only shift scores, and those of the elements around the region say little: many sites put a
story into an element named after its tags, its topic or its comments. So a first scan without
surroundings finds the densest text, and if surroundings take nearly all of a page's score away, the
scan is repeated without those of the elements around that text.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.html_pages import LABELLED_PAGES

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_MAY_HIDE = re.compile(r"hidden|display", re.I)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
_SHOWN_ON = re.compile(r"[\w-]+:(?:block|flex|grid|inline[\w-]*|table[\w-]*|contents)")   # shown from some width on
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

RAW = frozenset(("script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "object"))
DROP = frozenset(("head", "select", "button", "option", "label", "input", "dialog", "datalist", "canvas", "video", "audio", "annotation", "annotation-xml"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "head", "tr", "tbody", "thead", "tfoot", "caption"}
SECTION = frozenset(("nav", "aside", "footer", "header", "menu", "form", "article", "main"))     # tags that count as surroundings
LENGTHS, LINKS = (4, 10, 25), (0.01, 0.3, 0.7)       # bounds of the classes of block lengths and link shares
NAME_LOW, NAME_HIGH = -2.0, 1.0      # one element's surroundings score within these
OUT = -1.0               # text whose surroundings score lower is left out of the region
BLANKED = 0.05           # surroundings that leave less than this share of the score are judged wrong


@dataclass
class Weights:
    block: dict[str, float]      # by feature of the block that holds a word
    tag: dict[str, float]        # of a start or end tag by name
    other_tag: float
    name: dict[str, float]       # by section tag and by class, id or role name and its parts


@dataclass
class _Run:
    """A stretch of text or a tag, in page order."""

    kind: str                    # "text", "open", "close"
    value: str
    names: tuple[tuple[str, ...], ...]       # names of the open elements, outermost first
    path: tuple[int, ...]        # their numbers
    hard: bool = False           # inside an element that never holds text


def _names(tag: str, attrs: str) -> tuple[str, ...]:
    """The tag, then class, id and role values in lower case with their parts joined by "-"."""
    out = [tag]
    if tag not in ("html", "body") and "=" in attrs:
        for a, b, c in _NAMES.findall(attrs):
            values = (a or b or c).split()
            if "hidden" in values and any(map(_SHOWN_ON.fullmatch, values)):
                values = [x for x in values if x != "hidden"]
            for value in values:
                parts = _PART.findall(_HUMP.sub("-", value).lower())
                if parts:
                    out.append("." + "-".join(parts))
    return tuple(dict.fromkeys(out))


def _hides(attrs: str) -> bool:
    """Whether the attributes hidden, aria-hidden or style hide the element; the words in other
    attributes' values say nothing."""
    if not attrs or not _MAY_HIDE.search(attrs):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def read_page(page: str) -> list[_Run]:
    """The page's runs in order."""
    runs: list[_Run] = []
    n, stack = 0, [("", (), (), False)]       # tag, names of the path, numbers of the path, hard
    at, low = 0, None

    def text(upto: int) -> None:
        if upto > at:
            runs.append(_Run("text", page[at:upto], *stack[-1][1:]))

    def close(tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return

    pos = 0
    while m := _TAG.search(page, pos):
        text(m.start())
        at = pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, end, attrs = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if end:
            close(tag)
            runs.append(_Run("close", tag, *stack[-1][1:]))
            continue
        if tag in CLOSES_P and any(x[0] == "p" for x in stack[1:]):
            close("p")
        if tag == "li" and stack[-1][0] == "li":
            close("li")
        runs.append(_Run("open", tag, *stack[-1][1:]))
        if tag in RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{tag}", pos)
            at = pos = len(page) if stop < 0 else stop
        if tag in VOID or attrs.endswith("/") or tag in RAW:
            continue
        mark = ("@main",) if "data-main" in attrs else ()
        n += 1
        _, names, path, hard = stack[-1]
        stack.append((tag, (*names, _names(tag, attrs) + mark), (*path, n), hard or tag in DROP or _hides(attrs)))
    text(len(page))
    return runs


def block_features(runs: list[_Run]) -> list[tuple[str, ...]]:
    """Per run the features of its block: block tag, class of length and of link share. A block is
    the text between two tags that break lines."""
    out: list[tuple[str, ...]] = [()] * len(runs)
    at, words, linked = [], 0, 0

    def flush() -> None:
        if at:
            share = linked / words if words else 0.0
            tag = next((e[0] for e in reversed(runs[at[0]].names) if e[0] in BLOCK or e[0] == "td"), "body")
            found = (f"<{tag}>", f"length {sum(words >= x for x in LENGTHS)}", f"links {sum(share >= x for x in LINKS)}")
            for i in at:
                out[i] = found

    for i, r in enumerate(runs):
        if r.kind == "text":
            if not r.hard and r.value.strip():
                k = len(r.value.split())
                at.append(i)
                words += k
                linked += k * any(e[0] == "a" for e in r.names)
        elif r.value in BLOCK or r.value in ("br", "td", "th"):
            flush()
            at, words, linked = [], 0, 0
    flush()
    return out


def _surroundings(names: tuple[tuple[str, ...], ...]) -> list[list[str]]:
    """Per open element the names that count; a header or footer of an article or main is another
    thing than the page's."""
    out, inside = [], False
    for element in names:
        tag = element[0]
        own = [f"in {tag}" if inside and tag in ("header", "footer") else tag] if tag in SECTION else []
        out.append(own + [x for x in element[1:] if x != "@main"])
        inside = inside or tag in ("article", "main")
    return out


def _parts(name: str) -> list[str]:
    return [f".{x}" for x in name[1:].split("-")] if name.startswith(".") and "-" in name else []


def learn(pages: list[str]) -> Weights:
    """Smoothed log ratios of main and other text, per block and per page."""
    main, other = defaultdict(float), defaultdict(float)
    tags_main, tags_other = defaultdict(float), defaultdict(float)
    name_main, name_other = defaultdict(float), defaultdict(float)
    for page in pages:
        runs = read_page(page)
        features = block_features(runs)
        marked = [any("@main" in e for e in r.names) for r in runs]
        first = next((i for i, x in enumerate(marked) if x), len(runs))
        last = max((i for i, x in enumerate(marked) if x), default=-1)
        seen = set()          # a name counts once per page and role
        for i, r in enumerate(runs):
            if r.kind != "text":
                (tags_main if first <= i <= last else tags_other)[r.value] += 1
            elif r.value.strip() and not r.hard:
                for f in features[i]:
                    (main if marked[i] else other)[f] += 1
                for element in _surroundings(r.names):
                    for name in element:
                        seen |= {(marked[i], x) for x in (name, *_parts(name))}
        # an element that holds main text is not boilerplate, whatever else it holds
        for is_main, name in seen:
            if is_main:
                name_main[name] += 1
            elif (True, name) not in seen:
                name_other[name] += 1
    n_main, n_other = sum(main.values()) / 3 + 1, sum(other.values()) / 3 + 1
    block = {x: max(-1.0, min(1.0, 0.5 * math.log((main[x] + 0.5) / n_main / ((other[x] + 0.5) / n_other)))) for x in {*main, *other}}
    t_main, t_other = sum(tags_main.values()) + 1, sum(tags_other.values()) + 1
    tag = {x: -min(4.0, max(0.2, math.log((tags_other[x] + 0.5) / t_other / ((tags_main[x] + 0.5) / t_main)) + 0.5))
           for x in {*tags_main, *tags_other}}
    name = {x: math.log((name_main[x] + 0.7) / (name_other[x] + 0.7)) for x in {*name_main, *name_other}}
    return Weights(block, tag, -0.5, name)


def _name_weight(name: str, w: Weights) -> float:
    """A name's log ratio; an unknown compound has the mean of its parts', other names have 0."""
    if name in w.name:
        return w.name[name]
    if name.startswith("in "):
        return 0.0
    parts = _parts(name)
    return sum(w.name.get(x, 0.0) for x in parts) / len(parts) if parts else 0.0


def surrounding_score(r: _Run, w: Weights, spared: frozenset[int], memo: dict) -> float:
    """What the open elements' names say, each within bounds: the sum of the bad, or the best if
    there is none. Nothing bad is said of ``spared`` elements."""
    key = (r.names, r.path[:len(spared)] if spared else ())
    if key not in memo:
        total = 0.0
        for number, element in zip(r.path, _surroundings(r.names)):
            if element:
                score = max(NAME_LOW, min(NAME_HIGH, sum(_name_weight(x, w) for x in element)))
                if score < 0 and number not in spared:
                    total = min(total, 0.0) + score
                elif total >= 0:
                    total = max(total, score)
        memo[key] = total
    return memo[key]


def best_region(scores: list[float]) -> tuple[float, int, int]:
    """(sum, first, last) of the contiguous stretch with the largest positive sum, the first of
    equals, in one pass; (0, 0, -1) if there is none."""
    best, total, first, last, start = 0.0, 0.0, 0, -1, 0
    for i, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, first, last = total, start, i
    return best, first, last


def run_scores(runs: list[_Run], base: list[float], around: list[float], w: Weights) -> list[float]:
    """Score of each run: a tag's weight, or the number of words times their weight, between -1 and
    1; words that would be left out of the region score -1."""
    return [w.tag.get(r.value, w.other_tag) if r.kind != "text" else 0.0 if r.hard else
            len(r.value.split()) * (-1.0 if around[i] < OUT else max(-1.0, min(1.0, base[i] + around[i]))) for i, r in enumerate(runs)]


def main_text(page: str | None, w: Weights) -> str:
    """The page's main text: blocks in page order, one per line (empty if there is none)."""
    if not page:
        return ""
    runs = read_page(page)
    features = block_features(runs)
    base = [0.5 + sum(w.block.get(f, 0.0) for f in fs) if fs else 0.0 for fs in features]
    nothing = [0.0] * len(runs)

    def judged(spared: frozenset[int]) -> list[float]:
        memo: dict = {}
        return [surrounding_score(r, w, spared, memo) if r.kind == "text" else 0.0 for r in runs]

    dense, d_first, d_last = best_region(run_scores(runs, base, nothing, w))
    around = judged(frozenset())
    best, first, last = best_region(run_scores(runs, base, around, w))
    if best < BLANKED * dense:
        common = _common([r for r in runs[d_first:d_last + 1] if r.kind == "text" and not r.hard and r.value.strip()])
        around = judged(frozenset(common))
        best, first, last = best_region(run_scores(runs, base, around, w))
    if last < 0:
        # nothing but short text between many tags: the whole page, without boilerplate and links
        around = [OUT - 1 if fs and fs[2] == f"links {len(LINKS)}" else x for fs, x in zip(features, around)]
        first, last = 0, len(runs) - 1
    return _text_of(runs, around, _taken(runs, around, first, last))


def _common(runs: list[_Run]) -> tuple[int, ...]:
    """Numbers of the elements that are open around all of the runs, outermost first."""
    paths = [r.path for r in runs]
    if not paths:
        return ()
    low, high = min(paths), max(paths)
    return low[:next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))]


def _taken(runs: list[_Run], around: list[float], first: int, last: int) -> list[int]:
    """The runs of the page's text: the region, widened to the smallest element around it (or the
    article, where it lies in one), without other articles in there, and a heading of first rank
    that stands before it."""
    region = [i for i in range(first, last + 1) if runs[i].kind == "text" and not runs[i].hard and runs[i].value.strip()]
    kept = [i for i in region if around[i] >= OUT] or region
    common = _common([runs[i] for i in kept])
    out = set(range(first, last + 1))
    if common:
        names = runs[kept[0]].names
        articles = [k for k in range(len(common)) if names[k][0] == "article"]
        depth = articles[-1] if articles else len(common) - 1
        # articles further in are other texts, cards or comments, if most of the region is outside of
        # them or if they hold nothing of it
        inner = lambda r: {n for e, n in zip(r.names[depth + 1:], r.path[depth + 1:]) if e[0] == "article"}
        size = lambda ids: sum(len(runs[i].value.split()) for i in ids)
        beside = [i for i in kept if not inner(runs[i])]
        own = set() if 2 * size(beside) >= size(kept) else {n for i in kept for n in inner(runs[i])}
        if names[depth][0] not in ("html", "body", "main"):
            out |= {i for i, r in enumerate(runs) if len(r.path) > depth and r.path[depth] == common[depth]}
        out = {i for i in out if inner(runs[i]) <= own}
    is_title = lambda r: r.kind == "text" and any(e[0] == "h1" for e in r.names)
    low = min(out, default=0)
    if not any(is_title(runs[i]) for i in out):
        title = [i for i in range(low) if is_title(runs[i]) and not runs[i].hard and around[i] >= OUT and runs[i].value.strip()]
        if title:
            # with its tags, so that it is a block of its own
            out |= set(range(max(title[0] - 1, 0), min(title[-1] + 2, low)))
    return sorted(out)


def _text_of(runs: list[_Run], around: list[float], taken: list[int]) -> str:
    blocks, cur = [], []

    def flush() -> None:
        if cur:
            line = _SPACE.sub(" ", entities.unescape("".join(cur))).strip()
            if line:
                blocks.append(line)
            cur.clear()

    for i in taken:
        r = runs[i]
        if r.kind == "text":
            if not r.hard and around[i] >= OUT:
                cur.append(r.value)
        elif r.value in BLOCK:
            flush()
        elif r.value in ("br", "td", "th"):
            cur.append(" ")
    flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            labelled: list[str] | None = None) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Of equally good regions the first is taken. Null and empty html give the empty text. Cut-off pages are read to their end. Character
    references are decoded after the markup is read; white space inside a block becomes one
    space. Repeated rows each get a row; extra columns are not read. Narrow: no shuffle.
    """
    weights = learn(LABELLED_PAGES if labelled is None else labelled)

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda p: main_text(p, weights), na_action=None)

    out = pages.select(F.col(id_col), F.col(url_col), text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
