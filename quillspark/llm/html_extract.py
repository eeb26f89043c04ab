"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block-level stretch of text; what stands in elements for menus, headers,
footers, asides, forms, scripts and styles is markup too and leaves no line. Each line weighs as many characters as it
has outside links; lines in an element whose whole class or id names a page part (a sidebar, a notice, an advert) weigh
nothing, unless most of the page hangs on that element. Sums of weights over a sliding window of lines surge where a
stretch of text begins and dive to nothing where it ends. How high a surge has to come is read off the page's own
lines. The stretches between surge and dive are the article's candidates, and their weights say whether it is in the
page's article elements or, where these hold teasers only, in the stretches beside them.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
#: A surge has to come up to this share of the median weight of the page's lines with weight, or to one printed line if that is less.
SURGE, PRINTED_LINE = 0.25, 80
#: The article elements are the article if their lines weigh at least this share of the stretches outside.
ARTICLE = 0.5

# Names of HTML elements and of page parts that are not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
NOT_ARTICLE = frozenset(
    "applet aside audio button canvas datalist dialog footer form frame frameset head header iframe input map menu nav noscript object "
    "script select style svg template textarea title video".split()
)
BOXES = frozenset("article blockquote div dl main ol section table td ul".split())
SELF_CLOSING = frozenset("p li dt dd tr td th option".split())
#: Whole class names and ids; a last s is dropped before they are looked up.
PART_NAMES = frozenset(
    "ad adbox advert advertisement advertising ad-box ad-banner adsense banner breadcrumb byline comment commentlist cookie cookie-banner cookie-notice "
    "cookie-consent consent copyright disclaimer disqu footer footnav form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice "
    "notification pager pagination popup promo promoted promotion recommended related related-post related-article replie respond search "
    "share share-bar share-button sharing sidebar side-bar signup site-footer site-header site-nav skip skyscraper social social-share sponsor sponsored subscribe "
    "subscription teaser toolbar topbar tracking widget".split()
)
#: What readers write may be longer than the article.
READERS = frozenset("comment commentlist comment-list comments-section comment-section comments-area disqu disqus_thread replie".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(source)}


def _left_out(name: str, source: str) -> bool:
    """Whether the element is no part of an article whatever it holds."""
    if name in NOT_ARTICLE:
        return True
    if "=" not in source and "hidden" not in source:
        return False
    a = _attributes(source)
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in ROLES or bool(_HIDDEN.search(a.get("style", "")))


def _called(name: str, source: str) -> str:
    """What class and id say of an element: "part" if one of them as a whole names a page part, "readers" if that is reader comments."""
    if "=" not in source:
        return ""
    a = _attributes(source)
    said = {x.rstrip("s") for x in (a.get("class", "") + " " + a.get("id", "")).lower().split()}
    if not said.isdisjoint(READERS):
        return "readers"
    if name in ("html", "body", "article", "main"):
        return ""
    if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        said -= {"header", "banner"}
    return "" if said.isdisjoint(PART_NAMES) else "part"


def _is_main(name: str, source: str) -> bool:
    return name in ("article", "main") or "articlebody" in source.lower() or bool(re.search(r"role\s*=\s*[\"']?main\b", source, re.I))


class Line(NamedTuple):
    text: str
    own: int  # characters outside links
    main: int  # number of the outermost article element, or 0
    parts: tuple[int, ...]  # numbers of the elements around it that are called a page part; below 0 for reader comments
    paragraph: bool  # in a p element, which weighs a printed line by itself
    box: int  # number of the innermost element around it that groups lines, or 0


def lines_of(page: str) -> list[Line]:
    """The lines of the page, in order."""
    lines: list[Line] = []
    parts: list[str] = []
    linked = skipped = link = number = 0
    mains: list[int] = []
    called: list[int] = []
    boxes: list[int] = []
    open_: list[tuple[str, bool, bool, bool, bool]] = []  # name, left out, is main, called a part, groups lines
    names: dict[str, int] = {}

    def end_line() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, max(0, len(text) - linked), mains[0] if mains else 0, tuple(called), bool(names.get("p")), boxes[-1] if boxes else 0))
            parts.clear()
        linked = 0

    def close(upto: int) -> None:
        nonlocal skipped
        while len(open_) > upto:
            name, out, main, part, box = open_.pop()
            names[name] -= 1
            if name in BLOCK or main or part:
                end_line()
            skipped -= out
            for stack, was in ((mains, main), (called, part), (boxes, box)):
                if was:
                    stack.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not skipped:
            parts.append(text)
            if link:
                linked += len(entities.unescape(text).strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "a":
                link = 0
            if name in BLOCK:
                end_line()
            if names.get(name):
                k = len(open_) - 1
                while open_[k][0] != name:
                    k -= 1
                close(k)
            continue
        source = m[3] if m[2] else m[6] or ""
        if name in BLOCK:
            end_line()
        elif name == "br":
            parts.append(" ")
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if name in VOID:
            continue
        if name == "a":
            link = 1
        if name in SELF_CLOSING and open_ and open_[-1][0] == name:
            close(len(open_) - 1)
        out = not skipped and _left_out(name, source)
        main = not skipped and not out and _is_main(name, source)
        said = "" if skipped or out else _called(name, source)
        box = not skipped and not out and name in BOXES
        if source.endswith("/") and name in ("svg", "path"):
            continue
        if out or main or said or skipped or name in BLOCK:
            if out or main or said:
                end_line()
            open_.append((name, out, main, bool(said), box))
            names[name] = names.get(name, 0) + 1
            skipped += out
            number += 1
            if main:
                mains.append(number)
            if said:
                called.append(-number if said == "readers" else number)
            if box:
                boxes.append(number)
    end_line()
    return lines


def _without_parts(lines: list[Line]) -> list[Line]:
    """The lines without the elements that are called a page part, but for those on which most of the page hangs.

    That is all around the largest article element, or else more than half of the page's weight. Reader comments may
    be more than half; they stay only if there is nothing else.
    """
    if not any(x.parts for x in lines):
        return lines
    text: dict[int, int] = {}
    for x in lines:
        text[x.main] = text.get(x.main, 0) + (len(x.text) if x.main else 0)
    weight = [(len(x.text) if x.main else 0) if max(text) else x.own for x in lines]
    own: dict[int, int] = {}
    for x, w in zip(lines, weight, strict=True):
        for p in x.parts:
            own[p] = own.get(p, 0) + w
    total, largest = sum(weight), max(text, key=lambda k: text[k])
    around = set.intersection(*(set(x.parts) for x in lines if x.main == largest)) if largest else set()
    gone = {p for p, w in own.items() if p not in around and (w < total if p < 0 else 2 * w <= total)}
    return [x for x in lines if gone.isdisjoint(x.parts)]


def stretches(weight: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """(first line, end) between each surge and dive of the window sums: their windows all hold weight, one comes up to the page's bound."""
    if not weight.any():
        return []
    sums = np.convolve(weight, np.ones(window, np.int64))
    bound = min(PRINTED_LINE, SURGE * float(np.median(weight[weight > 0])))
    # a line is inside if all windows of the lines up to it, or of those from it on, have weight
    inside = np.maximum(sums[: len(weight)], sums[window - 1 :]) > 0
    change = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(change > 0).tolist(), np.flatnonzero(change < 0).tolist(), strict=True):
        has = np.flatnonzero(weight[a:b]) + a
        if sums[has[0] : has[-1] + window].max() >= bound:
            out.append((int(has[0]), int(has[-1]) + 1))
    return out


def main_text(page: str | None) -> str:
    """The article's lines joined by a blank line."""
    lines = _without_parts(lines_of(page or ""))
    weight = np.array([x.own + PRINTED_LINE * (x.paragraph and x.own > 0) for x in lines], np.int64)
    main = np.array([x.main > 0 for x in lines], bool)
    kept = np.zeros(len(lines), bool)
    for a, b in stretches(np.where(main, 0, weight)):
        kept[a:b] = True
    kept &= ~main
    inside = sum(len(x.text) for x in lines if x.main)
    if inside and inside >= ARTICLE * sum(x.own for x, k in zip(lines, kept.tolist(), strict=True) if k):
        return "\n\n".join(x.text for x in lines if x.main)
    for a, b in stretches(weight):  # teasers beside it may belong to the text
        kept[a:b] = True
    # lines of links alone stay too where they stand in one element with text that stays
    boxes = {x.box for x, k in zip(lines, kept, strict=True) if k and x.own} - {0}
    return "\n\n".join(x.text for x, k in zip(lines, kept, strict=True) if k or (x.box in boxes and not x.own))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html).

    The text is the article's blocks in page order, character references decoded, white space inside a block made
    one space, joined by two line feeds. Where a page's article or main elements hold its text, all their lines and no
    others are the article. A
    null or empty page, or one without text, gives an empty text; rows repeat if they do in the input; ids and
    urls may be null. Other columns are not read.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select("page_id", "url", "html").mapInArrow(told, "page_id long, url string, text string, n_chars long")
