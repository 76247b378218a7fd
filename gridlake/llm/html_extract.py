"""Main text of web pages from streaming parser events and smoothed text-to-tag ratios.

The standard library's parser is fed the page; each block of text becomes a line with its characters and its tags. A line's
ratio is the number of its characters a tag; text inside menus, footers, adverts, forms and the like has none, unless such an
element holds most of the page's text or was never closed. The ratios are smoothed with a Gaussian over neighbouring lines, and
runs of lines at or over the threshold (the standard deviation of the smoothed ratios) are the clusters. The content region is
the smallest container that holds all clusters; of it the clusters are returned, and the lines around them that have a ratio
and don't lie in a container of links without a cluster.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from gridlake.llm.text import fresh

#: Elements whose text is never looked at.
NEVER_TAGS = frozenset("head script style template iframe textarea".split())
#: Elements whose text has no ratio; those of HOLDERS have one when they hold most of a page's text.
SKIP_TAGS = frozenset("noscript svg math object canvas nav footer header aside form button select dialog menu".split())
HOLDERS = frozenset("nav footer header aside form dialog menu".split())
#: Elements that may stand in a head; any other one ends it.
HEAD_TAGS = frozenset("title base link meta script style noscript template".split())
#: Words that, alone or joined by - or _ in a class, id or role, mark elements without a ratio ...
_SURE = (
    "nav|navbar|subnav|topbar|navigation|menu|sidebar|footer|masthead|ad|ads|advert|adverts|advertisement|advertising|promo|sponsor|sponsored|cookie|cookies|consent|gdpr|popup|modal|"
    "newsletter|subscribe|signup|login|comment|comments|commentlist|disqus|sharing|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|complementary|contentinfo"
)
#: ... and those that do so only as a whole name outside of articles and sections; NOTICES and lists of links do so inside too.
_ALONE = "side|aside|rail|header|banner|copyright|overlay|discussion|replies|reply|respond|share|social|related|recommended|tags|search|skip|hidden|notice|notices|alert|alerts|related-posts|related-articles|cookie-notice"
SURE = re.compile(rf"(?:^|\s|(?<!with)(?<!has)(?<!no)[_-])(?:{_SURE})(?:$|[\s_-])", re.I)
ALONE = re.compile(rf"(?:^|\s)(?:{_ALONE})(?:$|\s)", re.I)
NOTICES = re.compile(r"(?:^|\s)(?:notices?|alerts?|cookie-notice)(?:$|\s)", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol "
    "p pre section summary table tbody td tfoot th thead tr ul aside".split()
)
CONTAINERS = frozenset("article main section div body html nav footer header aside form ul ol".split())
BARRIERS = frozenset("article main body".split())
#: Opening one of these ends an open element of the same kind.
CLOSES = frozenset("p li td th tr dd dt option".split())


class Lines(HTMLParser):
    """Collects each block of text as a line: its parts with the innermost candidate around each, its tags, its container.

    Elements are nodes with a parent, so that neither depth nor length of a page costs more than its size. A candidate is
    an element that may have no ratio.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, int, bool]] = []  # tag, candidate and container around it, own candidate or -1, text never looked at
        self.places: dict[str, list[int]] = {}  # open elements of each tag
        self.barriers: list[int] = []
        self.candidate, self.container = -1, 0
        self.parent = [-1]  # of containers; 0 is the page
        self.why: list[tuple[int, str, str]] = []  # of candidates: candidate around it, tag, reason
        self.closed: set[int] = set()  # candidates that met their own end tag
        self.lines: list[tuple[list[tuple[str, int, bool]], int, int]] = []  # (data, candidate, in a link), tags, container
        self.parts: list[tuple[str, int, bool]] = []
        self.tags = self.skipping = self.links = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't used

    def end_line(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.container))
            self.tags = 0
        self.parts = []

    def leave(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        while len(self.open) > at:
            tag, self.candidate, self.container, _, never = self.open.pop()
            self.places[tag].pop()
            self.skipping -= never
            self.links -= tag == "a"
            if tag in BARRIERS:
                self.barriers.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if self.open and self.open[-1][0] == "head" and tag not in HEAD_TAGS:
            self.leave(len(self.open) - 1)  # </head> may be left out
        if tag in BLOCK:
            self.end_line()
        if tag in VOID:
            return
        if tag in CLOSES and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)
        never, reason = tag in NEVER_TAGS, ""
        if not never:
            inside = bool(self.places.get("article"))
            if tag in SKIP_TAGS and not (tag == "header" and (inside or self.places.get("main"))):
                reason = "tag"
            elif attrs and tag not in ("html", "body", "main", "article"):
                names = [v for k, v in attrs if k in ("class", "id", "role") and v]
                if any(k == "hidden" or (k == "style" and v and _UNSEEN.search(v)) for k, v in attrs):
                    reason = "unseen"
                elif any(SURE.search(v) for v in names) or any(map(NOTICES.search, names)):
                    reason = "name"
                elif any(map(ALONE.search, names)):
                    reason = "links" if inside or tag == "section" else "name"
        own = -1
        self.open.append((tag, self.candidate, self.container, len(self.why) if reason else -1, never))
        if reason:
            own = len(self.why)
            self.why.append((self.candidate, tag, reason))
            self.candidate = own
        if tag in CONTAINERS:
            self.parent.append(self.container)
            self.container = len(self.parent) - 1
        self.places.setdefault(tag, []).append(len(self.open) - 1)
        if tag in BARRIERS:
            self.barriers.append(len(self.open) - 1)
        self.skipping += never
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.end_line()
        at = self.places.get(tag)
        # a stray end tag doesn't close the article
        if at and (tag in BARRIERS or tag == "html" or not self.barriers or at[-1] > self.barriers[-1]):
            if self.open[at[-1]][3] >= 0:
                self.closed.add(self.open[at[-1]][3])
            self.leave(at[-1])

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and not data.isspace():
            self.leave(len(self.open) - 1)
        if not self.skipping:
            self.parts.append((data, self.candidate, self.links > 0))

    def dead(self, only: frozenset[str] = frozenset(("tag", "name", "unseen", "links"))) -> list[bool]:
        """For each candidate whether its text has no ratio: all but those that hold over half of the page's text, not mostly
        links, and those without an end tag, as what follows would be lost with them (a footer's end may be missing: little follows it)."""
        total, held, linked = 0, [0] * len(self.why), [0] * len(self.why)
        for parts, _, _ in self.lines:
            for data, c, link in parts:
                n = sum(map(len, data.split()))
                total += n
                if c >= 0:
                    held[c] += n
                    linked[c] += n * link
        for c in range(len(self.why) - 1, -1, -1):
            up = self.why[c][0]
            if up >= 0:
                held[up] += held[c]
                linked[up] += linked[c]
        out = []
        for c, (up, tag, reason) in enumerate(self.why):
            mostly_links = 2 * linked[c] > held[c]
            free = reason not in only or (c not in self.closed and tag != "footer" and reason != "unseen")
            free = free or (2 * held[c] > total and (tag == "form" or not mostly_links) and (reason == "name" or tag in HOLDERS)) or (reason == "links" and not mostly_links)
            out.append(not free or (up >= 0 and out[up]))
        return out


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines; the window is cut at the ends and weighted anew."""
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    middle = slice(len(reach) // 2, len(reach) // 2 + len(ratio))
    return np.convolve(ratio, kernel)[middle] / np.convolve(np.ones(len(ratio)), kernel)[middle]


def clusters(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """True for the lines whose smoothed ratio reaches the threshold. Lines without a ratio smooth nothing and belong to none."""
    smoothed = np.where(ratio > 0, smooth(ratio, sigma), 0.0)
    return (smoothed > 0) & (smoothed >= min(smoothed.std(), smoothed.max()))


def _text(parts: list[tuple[str, int, bool]], dead: list[bool] | None) -> str:
    """One line's text: what has a ratio (all of it if dead is None), white space turned into single spaces."""
    return " ".join("".join(data for data, c, _ in parts if dead is None or c < 0 or not dead[c]).split())


def main_text(html: str | None) -> str:
    """Main text of one page; empty for null, empty or textless pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    everything = frozenset(("tag", "name", "unseen", "links"))
    for only in (everything, frozenset(("tag",))):  # if names would leave nothing, only elements count
        dead = parser.dead(only)
        texts, ratio, node, linked, tags = [], [], [], [], 0
        for parts, n, container in parser.lines:
            tags += n
            live = _text(parts, dead)
            text = live or _text(parts, None)
            if text:
                texts.append(text)
                ratio.append(len(live) / max(tags, 1))
                linked.append(sum(len(data) for data, _, link in parts if link))
                node.append(container)
                tags = 0
        chosen = clusters(np.array(ratio)) if texts else np.zeros(0, bool)
        if chosen.any():
            break
    else:
        return ""
    # by container: lines of clusters in it and below, characters, and those in links
    held, size, links = [0] * len(parser.parent), [0] * len(parser.parent), [0] * len(parser.parent)
    for c, t, k, use in zip(node, texts, linked, chosen.tolist(), strict=True):
        held[c] += use
        size[c] += len(t)
        links[c] += k
    for c in range(len(parser.parent) - 1, 0, -1):
        up = parser.parent[c]
        held[up], size[up], links[up] = held[up] + held[c], size[up] + size[c], links[up] + links[c]
    region = max(c for c in range(len(held)) if held[c] == held[0])  # the innermost: children come after their parents
    inside = [False] * len(held)
    for c in range(region, len(held)):
        open_to = c == region or inside[parser.parent[c]]
        inside[c] = open_to and (held[c] > 0 or 2 * links[c] <= size[c])
    return " ".join(t for t, r, c, use in zip(texts, ratio, node, chosen.tolist(), strict=True) if use or (r > 0 and inside[c]))


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of pages but ``html``, plus ``text`` and ``n_chars`` (its code points); own ones are replaced.

    Null and empty pages, and those without any text, give the empty text. A page per row, repeated rows too; columns of any
    name come through; no shuffle. A page is read whole in a Python worker, in time and memory proportional to its length
    however deep its elements nest or how many are never closed.
    """
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    (body,) = fresh(pages.columns, "html")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            text = [main_text(h) for h in frame.pop(body)]
            yield frame.assign(text=text, n_chars=[len(t) for t in text])

    source = pages.select(*keep, F.col(html).alias(body))
    return source.mapInPandas(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
