"""Operator 6: main text of HTML pages by line-block distribution.

Markup is stripped to lines, one a block element.  A line's weight comes from its
text length without links; structure only changes weights:

- lines in menus, headers, footers, sidebars, notices, adverts, forms and reader
  comments (by element, or by a whole class, id or role that names one) weigh 0;
- lines in an ``article`` or ``main`` element that holds at least ``TRUST`` of the
  page's other text weigh over the threshold each, lines outside it 0;
- elsewhere paragraphs and headings weigh three times, list items half.

Sums of the weights over sliding windows of ``width`` lines pass ``threshold`` at surge
points and fall below it at dive points; the text between them is kept.  At
a span's ends up to ``width`` - 1 lines that a window only reached over (under half the threshold) are cut off,
but headings and paragraphs stay where they adjoin it; lines without weight never stay.

Marks in classes are guesses: an element that holds an ``article`` or ``main`` is
not marked, and where marks leave no text at all, none holds.

Defined cases: null and empty pages give an empty text; character references
are decoded once; white space inside a block becomes one space; unclosed
elements end with their parent; unclosed scripts and comments run to the end; an
attribute's value may hold any quote but its own; repeated rows all stay; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.util import columns

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|canvas|math|textarea|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements that break lines, elements that hold no main text, and class names that mark it.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("head title nav header footer aside form menu dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARKED = frozenset("ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu nav navbar navigation newsletter notice notices popup promo related respond share sharing sidebar social sponsor sponsored subscribe widget".split())
#: Words that may stand beside a mark in a compound name such as ``site-footer`` or ``comment-list``.
PLACES = frozenset("site main page top left right bottom list box wrapper wrap container area section bar block item items links inner outer slot global primary secondary content posts post unit group panel".split())
#: Elements whose short lines belong to the text beside them; headings and paragraphs also count three times, the last half.
BEFORE, AFTER = frozenset("h1 h2 h3 h4 h5 h6 hgroup p blockquote pre".split()), frozenset("p blockquote pre".split())
HALF = frozenset("li dt dd td th option".split())
TRUST = 0.5


class Line(NamedTuple):
    text: str
    plain: int  # length without links
    tag: str
    article: bool
    skipped: bool  # by its element
    marked: bool  # by a class


def _marked(attributes: str) -> bool:
    for names in _NAMES.findall(attributes):
        for name in names.strip("\"'").lower().split():
            parts = [p for p in re.split(r"[^a-z]+", name) if p]
            if name in MARKED or (any(p in MARKED for p in parts) and all(p in MARKED or p in PLACES for p in parts)):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The page's lines of text, one a block."""
    lines: list[Line] = []
    part: list[str] = []
    linked = articles = links = at = 0
    skip: list[str] = []  # open elements from the one that holds no main text
    marks: list[list] = []  # open elements from one that a class marks: name, its number
    ignored: set[int] = set()  # marked elements that hold an article
    under: list[int] = []  # the marked element of each line, 0 for none
    number, block = 0, ""

    def end() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(part)).split())
        if text:
            lines.append(Line(text, max(0, len(text) - linked), block, articles > 0, bool(skip), False))
            under.append(marks[0][1] if marks else 0)
        part.clear()
        linked = 0

    for m in _MARKUP.finditer(page):
        if at < m.start():
            part.append(page[at : m.start()])
            if links:
                linked += len(" ".join(entities.unescape(part[-1]).split()))
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name == "br":
            part.append(" ")
            continue
        if name in BLOCKS:
            end()
            block = "" if m[2] else name
        if m[2]:
            links -= name == "a" and links > 0
            if name in skip:
                del skip[len(skip) - 1 - skip[::-1].index(name) :]
            open_marks = [k for k, x in enumerate(marks) if x[0] == name]
            if open_marks:
                del marks[open_marks[-1] :]
            elif name in ("article", "main"):
                articles = max(0, articles - 1)
            continue
        if name in VOID or m[4].rstrip().endswith("/"):
            continue
        links += name == "a"
        marked = name in BLOCKS and name not in ("body", "html") and _marked(m[4])
        if name in ("article", "main") and not marked and not (skip and articles):
            skip.clear()
            ignored.update(x[1] for x in marks)
            marks.clear()
            articles += 1
        elif skip:
            skip.append(name)
        elif name in SKIPPED and not (name == "header" and articles):
            skip.append(name)
        elif marks or marked:
            number += not marks
            marks.append([name, number])
    part.append(page[at:])
    end()
    return [x._replace(marked=n > 0 and n not in ignored) for x, n in zip(lines, under, strict=True)]


def line_weights(lines: list[Line], threshold: int) -> list[float]:
    """What each line counts in the windows."""
    plain = [0 if x.skipped else x.plain for x in lines]
    clear = [0 if x.marked else n for x, n in zip(lines, plain, strict=True)]
    if not any(clear):
        clear = plain
    whole = [0 if x.skipped or (x.marked and clear is not plain) else len(x.text) for x in lines]
    inside = sum(n for x, n in zip(lines, whole, strict=True) if x.article)
    if inside and inside >= TRUST * sum(n for x, n in zip(lines, clear, strict=True) if not x.article):
        return [n + threshold if x.article and n else 0 for x, n in zip(lines, whole, strict=True)]
    return [n * (3 if x.tag in BEFORE else 0.5 if x.tag in HALF else 1) for x, n in zip(lines, clear, strict=True)]


def line_blocks(weights: list[float], width: int, threshold: int) -> list[tuple[int, int]]:
    """Spans of lines from a surge to a dive of the window sums; cut where only a window reached over."""
    n = len(weights)
    total = [0.0]
    for w in weights:
        total.append(total[-1] + w)
    spans, i = [], 0
    while i < n:
        if total[min(n, i + width)] - total[i] <= threshold:
            i += 1
            continue
        surge = i
        while i < n and (total[min(n, i + width)] - total[i] > threshold or weights[i] > threshold):
            i += 1
        dive = min(n, i + width - 1)  # the last window over the threshold reaches to here
        i = max(i, dive)
        first, last = surge, dive
        while surge < min(dive, first + width - 1) and weights[surge] < threshold / 2:
            surge += 1
        while dive > max(surge, last - width + 1) and weights[dive - 1] < threshold / 2:
            dive -= 1
        if surge < dive:
            spans.append((surge, dive))
    return spans


def main_text(page: str, width: int = 3, threshold: int = 86) -> str:
    lines = lines_of(page)
    weights = line_weights(lines, threshold)
    kept, done = [], 0
    for surge, dive in line_blocks(weights, width, threshold):
        while surge > done and weights[surge - 1] and lines[surge - 1].tag in BEFORE:
            surge -= 1
        while dive < len(lines) and weights[dive] and lines[dive].tag in AFTER:
            dive += 1
        kept += [lines[k].text for k in range(max(done, surge), dive) if weights[k]]
        done = max(done, dive)
    return "\n".join(kept)


def extract_text(pages: DataFrame, width: int = 3, threshold: int = 86) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p or "", width, threshold) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return columns(pages, page_id="long", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")
