"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and path, so that each page's partner is the page next to it on its host. The text lines of
the two are aligned by a longest common subsequence. Shared lines are the template's and go, with one exception: lines
inside an ``article`` or ``main`` element are the page's own words even if a neighbour repeats them (copied articles).
Where a page marks its parts, the marks decide as well: menus, headers, footers, side bars, notices, adverts, forms and
reader comments go although no neighbour has the same.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequill.llm.staging import ship
from pagequill.llm.urlrules import url_host, url_path

SCHEMA = "page_id long, url string, text string"
PAGES_A_TASK = 1000
MATCHES = 32  # pairs of equal lines for each line of two pages, up to which pairs are walked
MASK_BYTES = 16 << 20  # of the places of repeated lines that are kept as bits
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>", re.S)
NAMED = re.compile(r"(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
# Element and attribute names that mark parts of a page.
UNREAD = frozenset("script style noscript template iframe object svg canvas audio video select textarea button title head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
OWN = frozenset("article main".split())
OTHER = frozenset("nav header footer aside form menu dialog".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsored sponsor promo banner cookie cookies consent notice notices alert menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus newsletter subscribe signup share sharing social related popup modal contentinfo complementary".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
IMPLIED_END = {"p": "p", "li": "li", "td": "td", "tr": "tr", "dt": "dt", "dd": "dd"}

MINE, FREE, TEMPLATE, SKIPPED = 0, 1, 2, 3


def page_lines(source: str) -> list[tuple[int, str]]:
    """The page's text blocks in order, each with the kind of region it lies in."""
    lines: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []
    kind, at = FREE, 0

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text and kind != SKIPPED:
                lines.append((kind, text))

    while found := TAG.search(source, at):
        if found.start() > at:
            pieces.append(source[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in BLOCK or name in UNREAD:
            flush()
        if found[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            kind = stack[-1][1] if stack else FREE
            continue
        if name in VOID or found[3].endswith("/"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            at = close.start() if close else len(source)
            continue
        if name not in BLOCK and name not in UNREAD and not found[3]:
            continue
        if name in IMPLIED_END and stack and stack[-1][0] == name:
            stack.pop()
            kind = stack[-1][1] if stack else FREE
        inside = kind
        if inside != SKIPPED:
            if name in UNREAD:
                inside = SKIPPED
            elif name in OWN:
                inside = MINE
            elif name in OTHER and not (name == "header" and kind == MINE):
                inside = TEMPLATE
            elif found[3] and name not in ("body", "html"):
                words = {w for m in NAMED.finditer(found[3]) for w in re.split(r"[\s_-]+", (m[1] or m[2] or m[3] or "").lower())}
                if words & MARKS:
                    flush()
                    inside = TEMPLATE
        if name in BLOCK or name in UNREAD or inside != kind:
            stack.append((name, inside))
            kind = inside
    pieces.append(source[at:])
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Walks the pairs of equal lines. Where lines repeat so often that there are over MATCHES pairs a line, rows of bits
    are walked in place of pairs: as exact, but of equally long subsequences it takes the one that comes first in ``a``.
    """
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if sum(len(places.get(line, ())) for line in a) > MATCHES * (len(a) + len(b)):
        return _shared_by_bits(a, b)
    ends: list[int] = []
    before: list[tuple[int, tuple] | None] = []  # of each length's best end: place in a, and the pair before it
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, before[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                before.append(link)
            else:
                ends[k], before[k] = j, link
    out: set[int] = set()
    link = before[-1] if before else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def _shared_by_bits(a: list[str], b: list[str]) -> set[int]:
    """:func:`shared_lines` by bits. Bit j of a row's number is set if some length has its first end at place j of ``b``.

    A row follows from the one before it in a few steps on whole numbers. Every so many rows one is kept; those between
    are made again on the way back, so memory grows with the square root of ``a`` times ``b`` in bits.
    """
    kept = set(a)
    b = [line for line in b if line in kept]  # no other line bears on the ends
    kept = set(b)
    rows = [i for i, line in enumerate(a) if line in kept]
    size = len(b)
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)

    @lru_cache(max(1, MASK_BYTES // (size // 8 + 1)))
    def mask(line: str) -> int:
        bits = np.zeros(size, np.uint8)
        bits[places[line]] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    def after(ends: int, line: str) -> int:
        """In each stretch up to an old end the first place with this line is the new end, else the old one."""
        all_ends = ends | mask(line)
        return all_ends & ((all_ends - (ends << 1 | 1)) ^ all_ends)

    step = isqrt(len(rows)) + 1
    starts, ends = [], 0
    for at, i in enumerate(rows):
        if at % step == 0:
            starts.append(ends)
        ends = after(ends, a[i])
    out: set[int] = set()
    end = ends.bit_length() - 1  # of the length looked for
    for chunk in range(len(starts) - 1, -1, -1):
        if end < 0:
            break
        own = rows[chunk * step : (chunk + 1) * step]
        before = [starts[chunk]]
        for i in own[:-1]:
            before.append(after(before[-1], a[i]))
        for i, earlier in zip(reversed(own), reversed(before), strict=True):
            if end >= 0 and not earlier >> end & 1:  # this end was set here
                out.add(i)
                end = (earlier & ((1 << end) - 1)).bit_length() - 1
    return out


def main_text(lines: list[tuple[int, str]], partner: list[tuple[int, str]] | None) -> str:
    """What is left of a page: its marked article, or else its lines without those of the template.

    If the partner has all its free lines too, the pages are copies and the comparison tells nothing.
    """
    shared = shared_lines([t for _, t in lines], [t for _, t in partner]) if partner else set()
    mine = [t for k, t in lines if k == MINE]
    if not mine:
        free = [(i, t) for i, (k, t) in enumerate(lines) if k == FREE]
        mine = [t for i, t in free if i not in shared] or [t for _, t in free]
    return "\n\n".join(mine)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text)`` for each row of ``pages``; ``text`` is empty if the page has none.

    Null html is empty; null URLs have an empty host and path. The partner is the page before on the same host, in
    order of path and id; the first page of a host, or of a task's range, takes the one after. A page without either
    keeps its marks alone. Other columns are ignored.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    tasks = max(1, -(-rows.count() // PAGES_A_TASK))
    near = rows.repartitionByRange(tasks, "host", "path", "page_id").sortWithinPartitions("host", "path", "page_id")
    return near.select("page_id", "url", "host", "html").mapInArrow(_extract, SCHEMA)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last_host, last, waiting = None, None, None
    for batch in batches:
        out: list[tuple] = []
        for page, url, host, source in zip(*(batch.column(c) for c in ("page_id", "url", "host", "html")), strict=True):
            page, url, host = page.as_py(), url.as_py(), host.as_py()
            lines = page_lines(source.as_py() or "")
            if waiting is not None:
                out.append((*waiting[:2], main_text(waiting[2], lines if host == last_host else None)))
                waiting = None
            if host == last_host:
                out.append((page, url, main_text(lines, last)))
            else:
                waiting = (page, url, lines)
            last_host, last = host, lines
        if out:
            yield _rows(out)
    if waiting is not None:
        yield _rows([(*waiting[:2], main_text(waiting[2], None))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["page_id", "url", "text"])
