"""Main text of web pages by line-block distribution.

Markup is stripped into blocks (the lines). A block weighs its characters outside links; menus, forms, footers, adverts,
comments and the like weigh nothing. Weights are summed over sliding windows of WINDOW blocks: a stretch of text runs from
where its sums leave zero to where they dive to zero again, and it counts if they surge to SURGE within it. The
stretch with the most text is the body. The others are kept that lie in the same article or, where the page has no
article, in the same content box, as a text is that adverts cut in pieces; the text between surge and dive is all kept.

Class and id words only weigh a box down: as whole words (or compounds of nothing but such words and neutral ones,
so not in "with-sidebar" or "related-work"), and never a box with more than half of the page's text. Where a page has
nothing else, its boilerplate is its text.

Defined results: a null or empty page has an empty text; a page without a surge gives its densest stretch;
unclosed and stray tags are tolerated, an unclosed script or style hides the rest of the page as in a browser; depth of
nesting costs nothing; repeated rows get a result each; other columns play no part.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

WINDOW, SURGE = 3, 86

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+))?""")
#: Their content is no text at all.
_RAW = {"script", "style", "noscript", "template", "textarea", "svg", "math", "iframe", "select", "button", "object", "canvas", "video", "audio", "head", "map"}
#: Of these, all that follows an unclosed one is its content.
_WHOLE = {"script", "style", "textarea", "iframe"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOX = set("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split())
_DROP = {"nav", "aside", "footer", "form", "dialog", "menu", "fieldset"}
_NAMES = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha consent cookie cookies copyright disclaimer dropdown footer gdpr login masthead menu"
    " modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination paywall popup promo promoted promotion recommendations recommended related search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe subscription tagcloud taboola toolbar topbar widget widgets".split()
)
_REPLIES = {"comment", "comments", "disqus", "replies", "respond"}
#: Words that say nothing about what a box holds.
_NEUTRAL = set("site page main area list box block left right top bottom wrapper wrap container section sections post posts article articles link links bar global primary secondary form item items slot unit inner outer content header head thread title us your the".split())
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
_LASTING = {"aside", "footer", "dialog"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_FLOW = _HEADING | {"p", "li", "blockquote", "pre", "dd", "dt", "td", "th", "figcaption", "caption"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_BODY = re.compile(r"<body[\s>]", re.I)
_NEXT_BLOCK = re.compile("</?(?:" + "|".join(sorted(_BLOCK)) + r")[\s>/]", re.I)


class _Box:
    __slots__ = ("drop", "hard", "header", "index", "inside", "kind", "last", "lasting", "named", "own", "replies", "tag", "total", "up")

    def __init__(self, tag: str, attributes: str, up, index: int):
        self.tag, self.up, self.index, self.last, self.own, self.total, self.drop = tag, up, index, index, 0, 0, False
        self.inside = tag in ("article", "main") or up is not None and up.inside
        self.hard = tag in _DROP or tag == "header" and not self.inside
        self.named = self.replies = self.header = self.lasting = False
        self.kind = (tag, "")
        if "=" in attributes or "hidden" in attributes:
            a = _attributes(attributes)
            self.kind = (tag, a.get("class", ""))
            if tag not in ("html", "body"):
                self.lasting = "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")) is not None
                self.hard = self.hard or a.get("role") in _ROLES
                for token in f"{a.get('class', '')} {a.get('id', '')}".split():
                    parts = {x for x in re.split(r"[^a-z0-9]+", token) if x}
                    if parts and parts <= _NAMES | _REPLIES | _NEUTRAL:
                        self.named = self.named or bool(parts & _NAMES)
                        self.replies = self.replies or bool(parts & _REPLIES)
                        self.header = self.header or "header" in parts
        self.lasting = self.lasting or tag in _LASTING


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(text)}


def blocks(page: str) -> tuple[list[tuple[str, int, str, _Box]], list[_Box]]:
    """(text, characters in links, tag, box) of each block with text, in page order; and all boxes, outer ones first."""
    box = _Box("", "", None, 0)
    out, parts, boxes, tag, unclosed, open_tags = [], [], [box], "", set(), {}
    own = box  # of the block: the box, or one for a block with attributes of its own
    links, in_link, at = 0, False, 0

    def flush():
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, links, tag, own))
            parts, links = [], 0

    def raw_end(name: str) -> int | None:
        if name in unclosed:  # it wasn't found further up
            return None
        m = _RAW_END[name].search(page, at)
        if not m:
            unclosed.add(name)
        return m and m.end()

    while True:
        m = _TAG.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            parts.append(piece)
            if in_link:
                links += len(piece.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(html.escape(m[0][9:-3]))
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in _RAW and not closing:
            if not attributes.endswith("/") or name in _WHOLE:
                end = raw_end(name)
                body = _BODY.search(page, at) if name == "head" else None
                if body and (end is None or body.start() < end):
                    at = body.start()
                elif end is not None:
                    at = end
                elif name in _WHOLE:
                    at = len(page)
                elif name != "head":
                    follow = _NEXT_BLOCK.search(page, at)
                    at = follow.start() if follow else len(page)
            continue
        if name == "a":
            in_link = not closing
        elif name == "br":
            parts.append(" ")
        elif name in ("td", "th") and not closing and parts:
            parts.append(" ")
        elif name in _BLOCK:
            flush()
            tag = "" if closing else name
            in_link = False
            if name in _BOX:
                if closing:
                    if open_tags.get(name):
                        while box.tag != name:
                            open_tags[box.tag] -= 1
                            box = box.up
                        open_tags[name] -= 1
                        box = box.up
                else:
                    box = _Box(name, attributes, box, len(boxes))
                    boxes.append(box)
                    open_tags[name] = open_tags.get(name, 0) + 1
            own = box
            if not closing and name not in _BOX and attributes:
                own = _Box(name, attributes, box, len(boxes))
                boxes.append(own)
    flush()
    return out, boxes


def _weigh(lines, boxes: list[_Box], believe: bool) -> list[int | None]:
    """Each block's weight; None: it is boilerplate. believe: whether class and id words count."""
    total = boxes[0].total
    for b in boxes:
        up = b.up
        if up is None:
            b.drop = False
            continue
        lasting = b.lasting or up.lasting or believe and b.replies
        if b.tag in ("article", "main"):  # ends whatever boilerplate was left open
            b.drop = lasting
        else:
            named = believe and (b.named or b.header and not b.inside) and 2 * b.total <= total
            b.drop = lasting or up.drop or b.hard or named
        b.lasting = lasting
    out = []
    for text, links, tag, box in lines:
        if box.drop or box.tag == "header" and tag not in _HEADING:
            out.append(None)
        else:
            out.append(max(len(text) - links, 1 if box.inside and tag in _FLOW else 0))
    return out


def stretches(weights: list[int], forced: list[bool] | None = None) -> list[tuple[int, int]]:
    """(begin, end) of the runs between dives to zero whose sliding sums surge, or that hold a forced block."""
    n = len(weights)
    if not any(weights):
        return []
    upto = [0]
    for w in weights:
        upto.append(upto[-1] + w)
    window = [upto[min(n, i + WINDOW)] - upto[i] for i in range(n)]
    limit = min(SURGE, max(window))
    out, i = [], 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        j, end, surge = i, i + 1, False
        while j < n and window[j]:  # until the sum dives
            if weights[j]:
                end = j + 1
                surge = surge or window[j] >= limit or forced is not None and forced[j]
            j += 1
        if surge:
            out.append((i, end))
        i = max(j, end)
    return out


def main_text(page: str | None) -> str:
    lines, boxes = blocks(page) if page else ([], [])
    if not lines:
        return ""
    for text, links, _, box in lines:
        box.own += max(0, len(text) - links)
    for b in reversed(boxes):
        b.total += b.own
        if b.up is not None:
            b.up.total += b.total
            b.up.last = max(b.up.last, b.last)
    marks = _weigh(lines, boxes, True)
    if not any(marks):
        for b in boxes:
            b.lasting = b.tag in _LASTING
        marks = _weigh(lines, boxes, False)
    weight = [w or 0 for w in marks]
    runs = stretches(weight, [box.inside and tag in _FLOW for _, _, tag, box in lines])
    if not runs:
        return ""
    start, end = max(runs, key=lambda r: (sum(weight[r[0] : r[1]]), -r[0]))
    # The nearest box that holds most of the body.
    held = [0] * len(boxes)
    for k in range(start, end):
        held[lines[k][3].index] += weight[k]
    for b in reversed(boxes):
        if b.up is not None:
            held[b.up.index] += held[b.index]
    total = held[0]
    best = lines[max(range(start, end), key=weight.__getitem__)][3]
    while best.up and (held[best.index] * 10 < total * 9 or best.tag not in _BOX or best.tag in ("blockquote", "ul", "ol", "dl", "table", "figure")):
        best = best.up
    whole = best
    while whole and whole.tag not in ("article", "main"):
        whole = whole.up
    keep: list[int] = []
    if whole:
        within = lambda k: whole.index <= lines[k][3].index <= whole.last
        for a, z in runs:
            got = [k for k in range(a, z) if marks[k] is not None and within(k)]
            k = got[0] - 1 if got and not keep else -1
            while k >= a and marks[k] is not None and lines[k][2] in _HEADING:  # the heading above the article
                got.insert(0, k)
                k -= 1
            keep += got
    else:
        solid = lambda k: lines[k][2] in _FLOW or weight[k] >= SURGE
        inside = [k for k in range(start, end) if best.index <= lines[k][3].index <= best.last]
        first, last = inside[0], inside[-1]
        first = next((k for k in range(start, first) if weight[k] and solid(k)), first)
        last = next((k for k in range(end - 1, last, -1) if weight[k] and solid(k)), last)
        for a, z in runs:
            if (a, z) == (start, end):
                keep += [k for k in range(first, last + 1) if marks[k] is not None]
            elif _alike(best, lines, weight, a, z):
                keep += [k for k in range(a, z) if marks[k] is not None]
    return "\n\n".join(lines[k][0] for k in keep)


def _alike(best: _Box, lines, weight: list[int], a: int, z: int) -> bool:
    """Whether another stretch's heaviest block lies in the content box: the box around best, or best's twin directly in the body."""
    box = lines[max(range(a, z), key=weight.__getitem__)][3]
    around = best.up
    if best.tag in ("", "html", "body"):
        return True
    if around is None or around.tag not in ("", "html", "body"):
        return best.index <= box.index <= best.last or around is not None and around.index <= box.index <= around.last
    while box.up and box.up is not around and box.up.index > around.index:
        box = box.up
    return box.up is around and box.kind == best.kind


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                text = [main_text(x) for x in c.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.selectExpr("cast(page_id as long) as page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
