"""Pages as trees of block elements, and the features of their nodes."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

# Fixed values of HTML: elements that make blocks, that have no end, whose content is no text of the page, and what ends an open element.
BLOCKS = frozenset("""address article aside blockquote button center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BREAKS = frozenset(["br", "hr", "wbr"])
UNSEEN = frozenset("script style title noscript template iframe object svg math canvas audio video select textarea noframes".split())
CLOSES = {"li": (["li"], ["ul", "ol", "menu", "dir"]), "dd": (["dd", "dt"], ["dl"]), "dt": (["dd", "dt"], ["dl"]), "tr": (["tr"], ["table"]),
          "td": (["td", "th"], ["tr", "table"]), "th": (["td", "th"], ["tr", "table"])}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.X)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]*))?""", re.I | re.S)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SENTENCE = re.compile(r"[.!?](?:\s|$)")

#: What parts of class, id and role names say about an element.
KINDS = {
    "content": "content article post entry story main text body page blog single prose markdown document",
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager skip toc",
    "header": "header masthead topbar top hero branding logo site",
    "footer": "footer foot bottom copyright colophon legal",
    "side": "sidebar side aside widget widgets rail column secondary complementary",
    "notice": "cookie cookies consent gdpr notice notices notification banner popup modal overlay alert toast disclaimer warning message",
    "ad": "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted promotion commercial dfp",
    "social": "share sharing social follow twitter facebook like likes",
    "comment": "comment comments reply replies respond discussion disqus reader feedback thread",
    "related": "related recommended recommendations more popular trending latest teaser teasers read",
    "form": "form search login signup signin subscribe newsletter register contact input email",
    "meta": "meta byline author date time tag tags category published",
    "hidden": "hidden invisible none sr",
}
KIND_BITS = {word: 1 << i for i, words in enumerate(KINDS.values()) for word in words.split()}
TAG_GROUPS = ["p", "h1", "h2 h3 h4 h5 h6", "li dd dt", "ul ol dl menu dir", "article main", "section", "div", "nav", "header", "footer", "aside",
              "form button fieldset", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html"]
TAG_GROUP = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group.split()}


@dataclass
class Page:
    """Block elements in page order; the first is the root. A text run names its element."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    kinds: list[int] = field(default_factory=lambda: [0])
    links: list[int] = field(default_factory=lambda: [0])  # characters inside links
    inline: list[int] = field(default_factory=lambda: [0])  # inline tags
    runs: list[tuple[int, str]] = field(default_factory=list)


_KINDS: dict[str, int] = {}


def kinds_of(attrs: str) -> int:
    """Bits of the kinds that an element's names speak of."""
    known = _KINDS.get(attrs)
    if known is None:
        known = 0
        for name, value in NAMES.findall(attrs):
            name = name.lower()
            if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                known |= KIND_BITS["hidden"]
            elif name != "style":
                for part in NAME_PART.findall(value):
                    known |= KIND_BITS.get(part.lower(), 0)
        if len(_KINDS) > 100_000:
            _KINDS.clear()
        _KINDS[attrs] = known
    return known


def parse(source: str | None) -> Page:
    """The blocks of a page, however broken its markup; a null or empty one has only a root without text.

    An open paragraph ends where a block begins, list items and cells end at the
    next one, end tags without a start are passed over, and what is open at the
    end is closed there. Character references are decoded.
    """
    page, source = Page(), source or ""
    stack, text, link, at = [0], [], False, 0

    def flush() -> None:
        if text:
            run = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if run:
                page.runs.append((stack[-1], run))

    def close(depth: int) -> None:
        nonlocal link
        flush()
        link = False
        del stack[depth:]

    while at < len(source):
        m = TOKEN.search(source, at)
        stop = m.start() if m else len(source)
        if stop > at:
            text.append(source[at:stop])
            if link:
                page.links[stack[-1]] += stop - at
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<!") or m[0].startswith("<?") or m[0].startswith("</"):
                continue
        end = m["end"] or m["end2"]
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in UNSEEN:
            if not end and not (attrs.endswith("/") and tag in ("svg", "math")):
                closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = closing.end() if closing else len(source)
        elif tag in BREAKS:
            text.append("\n")
        elif tag == "a":
            link = not end
        elif tag in ("body", "html"):
            pass  # both are the root
        elif tag not in BLOCKS:
            page.inline[stack[-1]] += not end
        elif end:
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] == tag or tag in HEADINGS and page.tag[stack[depth]] in HEADINGS:
                    close(depth)
                    break
        else:
            flush()
            if tag in HEADINGS and page.tag[stack[-1]] in HEADINGS:
                close(len(stack) - 1)
            if tag in CLOSES:
                ends, inside = CLOSES[tag]
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[depth]] in inside:
                        break
                    if page.tag[stack[depth]] in ends:
                        close(depth)
                        break
            for depth in range(len(stack) - 1, 0, -1):
                if page.tag[stack[depth]] in ("td", "th", "table", "button"):
                    break
                if page.tag[stack[depth]] == "p":
                    close(depth)
                    break
            page.parent.append(stack[-1])
            page.tag.append(tag)
            page.kinds.append(kinds_of(attrs) if attrs else 0)
            page.links.append(0)
            page.inline.append(0)
            stack.append(len(page.parent) - 1)
            link = False
    close(1)
    return page


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for every block of all pages, and where each page's blocks begin."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    n = int(first[-1])
    base = np.repeat(first[:-1], sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages])
    parent = np.where(parent < 0, -1, parent + base)
    group = np.array([TAG_GROUP.get(t, 7) for p in pages for t in p.tag])
    kinds = np.array([k for p in pages for k in p.kinds])
    chars, words, stops, runs = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    start = np.zeros(n)
    for page, offset in zip(pages, first, strict=False):
        for node, run in page.runs:
            i = offset + node
            chars[i] += len(run)
            words[i] += run.count(" ") + 1
            stops[i] += len(SENTENCE.findall(run))
            runs[i] += 1
    links = np.minimum(np.array([x for p in pages for x in p.links], float), chars + 1)
    inline = np.array([x for p in pages for x in p.inline], float)

    depth, up = np.zeros(n, int), kinds.copy()
    for i in range(n):  # parents come first
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
            up[i] |= up[parent[i]]
    own = np.stack([chars, words, stops, links, inline, np.ones(n)], axis=1)
    whole = own.copy()
    for d in range(int(depth.max(initial=0)), 0, -1):
        level = np.flatnonzero(depth == d)
        np.add.at(whole, parent[level], whole[level])
    total = whole[np.repeat(first[:-1], sizes)]
    up_group = np.zeros((n, len(TAG_GROUPS)), bool)
    for d in range(1, int(depth.max(initial=0)) + 1):
        level = np.flatnonzero(depth == d)
        up_group[level] = up_group[parent[level]]
        up_group[level, group[parent[level]]] = True

    order = np.lexsort((np.arange(n), parent))
    place, siblings, alike = np.zeros(n), np.ones(n), np.ones(n)
    before, after = np.zeros(n), np.zeros(n)
    bounds = np.flatnonzero(np.diff(parent[order], prepend=-2))
    for a, b in zip(bounds, [*bounds[1:], n]):
        if parent[order[a]] < 0:
            continue
        own_place = order[a:b]
        place[own_place], siblings[own_place] = np.arange(b - a), b - a
        alike[own_place] = np.bincount(group[own_place], minlength=len(TAG_GROUPS))[group[own_place]]
        before[own_place[1:]], after[own_place[:-1]] = whole[own_place[:-1], 0], whole[own_place[1:], 0]
    cumulated = np.cumsum(chars) - chars
    start = (cumulated - cumulated[np.repeat(first[:-1], sizes)]) / np.maximum(total[:, 0], 1)
    safe = np.maximum(whole, 1)
    up_whole = whole[np.maximum(parent, 0)]
    numbers = [
        depth, place, siblings, place / siblings, alike / siblings, start,
        np.log1p(chars), np.log1p(whole[:, 0]), whole[:, 0] / np.maximum(total[:, 0], 1), whole[:, 0] / np.maximum(up_whole[:, 0], 1),
        whole[:, 3] / safe[:, 0], whole[:, 0] / safe[:, 5], whole[:, 2] / safe[:, 1] * 100, whole[:, 1] / safe[:, 2], np.log1p(whole[:, 2]),
        np.log1p(before), np.log1p(after), np.log1p(whole[:, 5]), whole[:, 4] / safe[:, 1], up_whole[:, 3] / np.maximum(up_whole[:, 0], 1), runs,
    ]
    bits = 1 << np.arange(len(KINDS))
    tags = np.arange(len(TAG_GROUPS))
    columns = [np.stack(numbers, axis=1), group[:, None] == tags, up_group, (kinds[:, None] & bits) > 0, ((up & ~kinds)[:, None] & bits) > 0]
    return np.concatenate([c.astype(np.float32) for c in columns], axis=1), first
