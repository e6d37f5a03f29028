"""The main text of web pages by line-block distribution.

A page becomes lines: the text of one block element each, in page order, with character references
decoded and white space collapsed. What cannot be article text (menus, page footers, sidebars, forms,
scripts, styles, elements of a class such as ``ad``) is stripped like markup. Every border of a container
and every stripped element outside an article leaves a blank line, as it does in a page's source.

A line weighs its characters outside links. Marks are weights among others: a line in ``<article>`` or
``<main>`` and a heading weigh 30 more, one in an element whose class merely contains a suspicious word (``ad-free``)
a quarter. Weights are summed over a window of three lines from each line on; text surges where the sum
reaches 86 and dives where it falls to zero, and the lines between are a block. Of all blocks, those of
the heaviest one's own article are kept, and those that weigh at least a quarter of it. Where the text
never surges, the heaviest run of lines counts as the only block.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
WINDOW, THRESHOLD = 3, 86
BONUS, SCOPED, SUSPECT, SHARE = 30, 4, 0.25, 0.25
SCOPE = {"article", "main"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes"}
GONE = {"nav", "footer", "aside", "form", "template", "svg", "math", "canvas", "object", "select", "button", "dialog", "menu", "head", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CONTAINER = {"div", "section", "article", "main", "header", "table", "ul", "ol", "dl", "fieldset", "hr", "center"}
SIGNS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies", "footer", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "popup", "promo", "promotion", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NEVER_SIGNED = {"html", "body", "article", "main", *HEADINGS}
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|</[^>]*(?:>|\Z)", re.S)
MARK = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[^a-z0-9]+")
WHOLE, HINT = 2, 1


class Line(NamedTuple):
    """A block's text and its characters outside links; the article it is in (0: none); how far its element's class speaks against it; whether it is a heading."""

    text: str
    own: int
    scope: int = 0
    sign: int = 0
    heading: bool = False


BLANK = Line("", 0)


def lines_of(page: str) -> list[Line]:
    """The lines of a page; blank ones stand for borders of containers and for what was stripped."""
    out: list[Line] = []
    parts: list[str] = []
    linked, at, link = 0, 0, 0
    scope, scopes, heading = 0, 0, False
    gone, depth = "", 0
    marks: list[list] = []  # [element, how many of its name are open, sign]

    def close(blanks: int = 0) -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Line(text, max(0, len(text) - linked), scopes if scope else 0, max((m[2] for m in marks), default=0), heading))
        out.extend([BLANK] * blanks)
        parts.clear()
        linked = 0

    size = len(page)
    while at < size:
        token = TOKEN.search(page, at)
        text = page[at : token.start() if token else size]
        if text and not gone:
            parts.append(text)
            linked += len(text) if link else 0
        if not token:
            break
        at = token.end()
        ends, name, attributes = token[1], (token[2] or "").lower(), token[3] or ""
        if not name or not token[0].endswith(">"):
            continue
        if gone:
            if name == gone and name not in VOID:
                depth += -1 if ends else 1
                if not depth:
                    gone = ""
            elif not ends and name in RAW:
                at = _after(page, name, at)
            continue
        if not ends and name in RAW:
            at = _after(page, name, at)
            continue
        if name not in INLINE:
            close(1 if name in CONTAINER and not scope else 0)
            heading = name in HEADINGS and not ends
        if name == "a":
            link = 0 if ends else 1
            continue
        if name in SCOPE:
            if not ends:
                scopes += 0 if scope else 1
                out.extend([] if scope else [BLANK] * WINDOW)
                scope += 1
            elif scope:
                scope -= 1
                out.extend([] if scope else [BLANK] * WINDOW)
            continue
        if name in VOID:
            continue
        for i in range(len(marks) - 1, -1, -1):
            if marks[i][0] == name:
                marks[i][1] += -1 if ends else 1
                if not marks[i][1]:
                    del marks[i:]
                    out.extend([BLANK] * WINDOW)
                break
        if ends:
            continue
        sign = 0 if name in NEVER_SIGNED else _sign(attributes)
        if name in GONE or name == "header" and not scope or sign == WHOLE and name in INLINE:
            if name not in INLINE:
                close(0 if scope else 1)
            gone, depth = name, 1
        elif sign and name not in INLINE:
            out.extend([BLANK] * WINDOW)
            marks.append([name, 1, sign])
    close()
    return out


def _after(page: str, name: str, at: int) -> int:
    """Where the element ``name``, whose content is not markup, is over."""
    end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
    return end.end() if end else len(page)


def _sign(attributes: str) -> int:
    """Whether a class, id or role is a word of ``SIGNS`` (WHOLE) or has one as a part (HINT)."""
    found = 0
    if "=" in attributes:
        for m in MARK.finditer(attributes):
            for word in (m[1] or m[2] or m[3] or "").lower().split():
                found = max(found, WHOLE if word in SIGNS else HINT if SIGNS.intersection(PART.split(word)) else 0)
    return found


def weights(lines: list[Line]) -> np.ndarray:
    """What each line weighs.

    Lines of elements named as a whole like a menu or an advert weigh nothing, unless they hold most of the page's text.
    """
    signed, total = sum(x.own for x in lines if x.sign == WHOLE), sum(x.own for x in lines)
    spared = 2 * signed > total and signed >= THRESHOLD
    factor = (1.0, SUSPECT, 1.0 if spared else 0.0)
    return np.array([x.own * factor[x.sign] + (BONUS if (x.scope or x.heading) and x.own and not x.sign else 0) for x in lines], float)


def blocks_of(weight: np.ndarray) -> list[tuple[int, int]]:
    """(surge, dive) of each block: from a window sum of the threshold on until the sum is zero."""
    sums = np.convolve(weight, np.ones(WINDOW))[WINDOW - 1 :] if len(weight) else weight  # the window that begins at each line
    edge = np.flatnonzero(np.diff(np.concatenate([[False], sums > 0, [False]]).astype(int)))
    runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
    found = [(a + int(np.argmax(sums[a:b] >= THRESHOLD)), b) for a, b in runs if sums[a:b].max() >= THRESHOLD]
    return found or ([max(runs, key=lambda r: weight[r[0] : r[1]].sum())] if runs else [])


def main_text(page: str | None) -> str:
    """The lines of the kept blocks, joined by newlines; empty if there are none."""
    lines = lines_of(page or "")
    weight = weights(lines)
    blocks = blocks_of(weight)
    if not blocks:
        return ""
    scope = [max((x.scope for x in lines[a:b]), default=0) for a, b in blocks]
    mass = [weight[a:b].sum() * (SCOPED if s else 1) for (a, b), s in zip(blocks, scope)]
    best = int(np.argmax(mass))
    kept = [ab for ab, s, m in zip(blocks, scope, mass) if m >= SHARE * mass[best] or s and s == scope[best]]
    return "\n".join(lines[i].text for a, b in kept for i in range(a, b) if lines[i].text and (weight[i] or lines[i].sign < WHOLE))


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars (code points).

    * Null or empty html, or a page without text: empty text. Null page_id and url are kept.
    * Unclosed tags, comments and elements reach to the end of the page; a tag cut off at the end is
      dropped. Pages of any length are read whole; a task holds one page's lines at a time.
    * Of blocks that weigh the same, the first one is the heaviest.
    * Repeated rows are each extracted; extra columns are ignored; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
