"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element; text inside links does not count towards a
line's length. The lengths are summed over a sliding window of ``WINDOW`` lines: where the sum rises from
zero the text surges, where it falls back to zero it dives. The densest window says where the text is, and
``SHARE`` of it is the page's threshold. Where a marked element (article, main) holds that window, all the
element's lines are kept, links and short lines included, and so are other marked elements but for those
that are short and mostly links. Elsewhere what lies between the first and the last surge that reaches the
threshold is kept, with all lines in the same container below the body as theirs.

Tags and names are hints: menus, headers, footers, sidebars, notices, adverts, forms and reader comments
leave a gap of empty lines. Names that also occur in articles (``_WEAK``) do so only where their lines are
sparse: below the threshold, or more links than text.

Edge cases: null or empty pages have no text; a page whose text is all links has that of its marked
elements; markup that is cut off or never closed ends with the page; comments, scripts and styles that are
never closed reach to its end; text of any length is kept whole; rows that repeat an id are rows of their
own; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, strings

WINDOW, SHARE = 3, 0.2

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|object|svg|math|title|textarea|select|canvas|audio|video)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_AWAY = frozenset("nav header footer aside form button menu dialog head".split())
_UNCLOSED = frozenset("p li dt dd option tr td th".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NAMED = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_NOISE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertise\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|popups?|modal|overlay|newsletter|subscri\w*|side-?bars?|"
    r"nav\w*|menus?|breadcrumbs?|footers?|mastheads?|toolbars?|pagination|pager|sharing|comments?|respond|replies|disqus|complementary|contentinfo|login)(?![a-z])",
    re.I,
)
_WEAK = re.compile(r"(?:^|[^a-z])(?:headers?|alerts?|widgets?|share|social|related|recommended|search)(?![a-z])", re.I)


class Line(NamedTuple):
    text: str
    plain: int  # length outside links
    marked: int  # the outermost article or main around it, by place; 0: none
    within: frozenset[int]  # own block and its parent below the body
    weak: int  # the element of a doubtful name around it


_GAP = Line("", 0, 0, frozenset(), 0)


def lines_of(page: str) -> list[Line]:
    """The lines of each block; boilerplate leaves WINDOW empty ones."""
    gap = [_GAP] * WINDOW
    out: list[Line] = []
    blocks: list[tuple[str, int]] = []  # open blocks and their places
    text: list[str] = []
    plain, links, article, away, depth, marked, outer, weak = 0, 0, 0, "", 0, False, 0, 0

    def flush() -> None:
        nonlocal plain
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append(Line(line, plain and max(1, plain), outer if article > 0 else 0, frozenset(n for b, n in blocks[-2:] if b not in ("html", "body")), weak))
            text.clear()
        plain = 0

    def add(raw: str) -> None:
        nonlocal plain
        if raw and not away:
            s = html.unescape(raw) if "&" in raw else raw
            text.append(s)
            if not links:
                plain += len(s.strip())

    at = 0
    for m in _TAG.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            if m[1] and not away:
                text.append(" ")
            continue
        closing, attrs = (m[2], m[4]) if m[3] else (m[5], m[7])
        if away == "p" and name in _BLOCK and name != "br" and not (closing and name == "p"):  # any other block ends a paragraph
            away, depth = "", 0
            out += gap
        if away and name in ("article", "main") and not closing and not marked and not _noise(attrs):  # no boilerplate holds the page's article
            away, depth = "", 0
        if away:
            if name == away and name not in _VOID:
                depth += -1 if closing else not attrs.endswith("/")
            if depth <= 0:
                away, depth = "", 0
                out += gap
            continue
        if name in _BLOCK:
            flush()
            if closing:
                at_open = next((i for i in range(len(blocks) - 1, -1, -1) if blocks[i][0] == name), len(blocks))
                del blocks[at_open:]
                if weak and all(n != weak for _, n in blocks):
                    weak = 0
            elif blocks and blocks[-1][0] in _UNCLOSED and (blocks[-1][0] == "p" or name == blocks[-1][0]) and name not in _VOID:
                if blocks.pop()[1] == weak:
                    weak = 0
        if name == "a":
            links = 0 if closing else 1
        elif name in ("article", "main"):
            noisy = not closing and _noise(attrs)
            marked = marked or not noisy
            if not noisy:
                article = max(0, article + (-1 if closing else 1))
                outer = at if article == 1 and not closing else outer
        if closing or name in _VOID:
            continue
        inner_header = name == "header" and article > 0 and not _noise(attrs)
        if name in _AWAY and not inner_header or attrs and name not in ("html", "body") and _noise(attrs):
            flush()
            away, depth = name, 1
        elif name in _BLOCK:
            blocks.append((name, at))
            if not weak and attrs and _named(_WEAK, attrs):
                weak = at
    add(page[at:])
    flush()
    return out


def _named(names: re.Pattern, attrs: str) -> bool:
    return any(names.search(a or b or c) for a, b, c in _NAMED.findall(attrs))


def _noise(attrs: str) -> bool:
    return _named(_NOISE, attrs)


def main_text(page: str) -> str:
    lines = _without_weak(lines_of(page))
    size = [x.plain for x in lines]
    block = [sum(size[i : i + WINDOW]) for i in range(len(size))]
    surges = _surges(size, block)
    if not surges:
        return " ".join(x.text for x in lines if x.marked and x.text)
    threshold = SHARE * max(block)
    large = [(i, j) for i, j in surges if max(block[i:j]) >= threshold]
    densest = max(range(len(lines)), key=lambda k: (block[k], -k))
    top = max(range(densest, min(len(lines), densest + WINDOW)), key=lambda k: (size[k], -k))
    kept = _kept_elements(lines, lines[top].marked, threshold)
    if lines[top].marked:
        return " ".join(x.text for x in lines if x.marked in kept and x.text)
    inside = {k for i, j in surges if large[0][0] <= i <= large[-1][0] for k in range(i, j)}
    own = frozenset().union(*(lines[k].within for i, j in large for k in range(i, j)))
    return " ".join(x.text for k, x in enumerate(lines) if x.text and (k in inside or x.within & own) and (not x.marked or x.marked in kept))


def _surges(size: list[int], block: list[int]) -> list[tuple[int, int]]:
    """Runs of lines from where the window sum rises above zero to where it falls back."""
    out, i = [], 0
    while i < len(size):
        if not size[i]:
            i += 1
            continue
        j = i
        while j < len(size) and block[j]:
            j += 1
        out.append((i, j))
        i = j
    return out


def _without_weak(lines: list[Line]) -> list[Line]:
    """Blocks of a doubtful name become gaps, but for those of as dense text as the page's: windows of at least SHARE of its largest, more text than links."""
    names = {x.weak for x in lines} - {0}
    if not names:
        return lines
    peak = lambda rows: max((sum(x.plain for x in rows[i : i + WINDOW]) for i in range(len(rows))), default=0)
    threshold = SHARE * peak([x if not x.weak else _GAP for x in lines])
    own = {n: [x for x in lines if x.weak == n] for n in names}
    dense = {n for n, rows in own.items() if peak(rows) >= max(1, threshold) and 2 * sum(x.plain for x in rows) >= sum(len(x.text) for x in rows)}
    out: list[Line] = []
    for x in lines:
        if not x.weak or x.weak in dense:
            out.append(x)
        elif not out or out[-1] is not _GAP:
            out += [_GAP] * WINDOW
    return out


def _kept_elements(lines: list[Line], first: int, threshold: float) -> set[int]:
    """The element that has the densest window, and marked ones but for those that are short and mostly links."""
    plain, whole = Counter(), Counter()
    for x in lines:
        plain[x.marked] += x.plain
        whole[x.marked] += len(x.text)
    return {first} | {k for k in whole if k and (plain[k] >= threshold or 2 * plain[k] >= whole[k])}


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [main_text(t) for t in strings(b, html_col)]
            yield pa.RecordBatch.from_pydict({id_col: b.column(id_col), url_col: b.column(url_col), "text": pa.array(got, pa.string()), "n_chars": pa.array([len(t) for t in got], pa.int64())})

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"{id_col} {kinds[id_col]}, {url_col} {kinds[url_col]}, text string, n_chars bigint")
