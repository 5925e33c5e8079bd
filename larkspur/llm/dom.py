"""A tolerant HTML reader: block nodes in page order, their text runs, and features of each node."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|aria-label|itemprop|style|hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")

#: Tags that begin a block of their own.
BLOCKS = frozenset(
    "html body main article section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "form fieldset legend label blockquote pre figure figcaption address details summary hr center dialog menu hgroup search".split()
)
VOID = frozenset(["hr"])
#: Tags whose content is no text of the page, and those of them that may hold themselves.
SKIPPED = frozenset("noscript template svg iframe textarea select title button object".split())
NESTING = frozenset(["svg", "object", "template"])
#: An opening tag of the first kind ends an open one of the second, up to a block that holds such tags.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

#: Families of words in class, id and role.
FAMILIES = (
    ("content", "content article post entry story main text body articlebody prose blog news detail"),
    ("navigation", "nav navigation menu navbar breadcrumb breadcrumbs tabs toc pagination pager links sitemap topics tags categories"),
    ("header", "header head masthead banner top topbar logo branding hero"),
    ("footer", "footer foot bottom copyright legal colophon imprint"),
    ("sidebar", "sidebar side aside rail widget widgets related recommended more trending popular teaser teasers complementary"),
    ("notice", "cookie cookies consent gdpr notice alert modal popup overlay privacy banner toast dialog announcement"),
    ("advert", "ad ads advert advertisement adverts sponsor sponsored promo promotion banner dfp adsense outbrain taboola"),
    ("form", "form search login signin signup subscribe subscription newsletter register contact email"),
    ("comments", "comment comments reply replies respond discussion disqus thread responses reviews"),
    ("social", "social share sharing follow facebook twitter buttons"),
)
_FAMILY = {w: 0 for _, words in FAMILIES for w in words.split()}
for _k, (_, _words) in enumerate(FAMILIES):
    for _w in _words.split():
        _FAMILY[_w] |= 1 << _k
_HIDDEN = 1 << len(FAMILIES)
#: Marks of made-up training pages; no feature looks at them.
KEPT, LEFT = 1 << 13, 1 << 14
_FAMILY |= {"xkept": KEPT, "xleft": LEFT}
TAG_GROUPS = (("p",), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dt", "dd"), ("ul", "ol", "dl", "menu"), ("div", "section"), ("article", "main"), ("nav",), ("header",), ("footer",), ("aside",), ("form", "fieldset", "label", "legend"), ("table", "tr", "td", "th", "tbody"), ("blockquote", "pre", "figure", "figcaption"), ("html", "body"))
_TAG = {t: k for k, group in enumerate(TAG_GROUPS) for t in group}


@dataclass
class Page:
    """Nodes in page order, and the text runs (node, text) between block boundaries."""

    tags: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    family: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def _families(attributes: str) -> int:
    out = 0
    for name, value in _ATTRIBUTE.findall(attributes):
        if name.lower() == "hidden":
            out |= _HIDDEN
        elif name.lower() == "style":
            if "none" in value and "display" in value:
                out |= _HIDDEN
        else:
            for part in _PART.findall(value):
                out |= _FAMILY.get(part.lower(), 0)
    return out


def _skipped_to(source: str, at: int, tag: str, around: set[str]) -> int:
    """Where an element without text of the page ends: at its end tag, if that comes before the end of a block in ``around``.

    Without such an end tag it ends where the next block begins or ends.
    """
    inner: list[str] = []
    nested, boundary = 0, None
    for m in _TOKEN.finditer(source, at):
        name = (m[3] or "").lower()
        if name == tag:
            if m[2]:
                if not nested:
                    return m.end()
                nested -= 1
            elif tag not in NESTING:
                return m.start() if boundary is None else boundary
            elif not (tag == "svg" and m[4].rstrip().endswith("/")):
                nested += 1
        elif name in BLOCKS:
            boundary = m.start() if boundary is None else boundary
            if not m[2]:
                inner.append(name)
            elif name in inner:
                while inner.pop() != name:
                    pass
            elif name in around:
                return boundary
    return len(source) if boundary is None else boundary


def read_page(source: str | None) -> Page:
    page = Page()
    tags, parent, depth, end, family, inline, links = page.tags, page.parent, page.depth, page.end, page.family, page.inline, page.links

    def open_node(tag: str, attributes: str) -> None:
        up = stack[-1] if stack else -1
        stack.append(len(tags))
        tags.append(tag)
        parent.append(up)
        depth.append(len(stack))
        end.append(0)
        family.append(_families(attributes) if attributes else 0)
        inline.append(0)
        links.append(0)

    def flush() -> None:
        if run:
            raw = "".join(run)
            run.clear()
            if "&" in raw:
                raw = html.unescape(raw)
            text = _BLANK.sub(" ", raw).strip()
            if text:
                page.runs.append((stack[-1], text))

    stack: list[int] = []
    run: list[str] = []
    open_node("html", "")
    if not source:
        end[0] = 1
        return page
    at, in_link = 0, False
    while m := _TOKEN.search(source, at):
        first = m.start()
        if first > at:
            run.append(source[at:first])
            if in_link:
                links[stack[-1]] += first - at
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] is not None:
                inline[stack[-1]] += 1
            continue
        tag = tag.lower()
        if tag in SKIPPED and not m[2]:
            inline[stack[-1]] += 1
            if not (tag == "svg" and m[4].rstrip().endswith("/")):
                at = _skipped_to(source, at, tag, {tags[k] for k in stack})
            continue
        if tag not in BLOCKS:
            if tag == "a":
                in_link = not m[2]
            elif tag in ("br", "img", "input"):
                run.append(" ")
            inline[stack[-1]] += 1
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if tags[stack[k]] == tag:
                    for node in stack[k:]:
                        end[node] = len(tags)
                    del stack[k:]
                    break
            in_link = False
            continue
        if tag == "html":
            family[0] |= _families(m[4])
            continue
        if tags[stack[-1]] == "p" or tag in _ENDS:
            ends, within = _ENDS.get(tag, ({"p"}, None))
            for k in range(len(stack) - 1, 0, -1):
                name = tags[stack[k]]
                if within and name in within:
                    break
                if name in ends or name == "p":
                    for node in stack[k:]:
                        end[node] = len(tags)
                    del stack[k:]
                    if name != "p":
                        break
                elif not within:
                    break
        open_node(tag, m[4])
        if tag in VOID:
            end[stack.pop()] = len(tags)
    if at < len(source):
        run.append(source[at:])
    flush()
    for node in stack:
        end[node] = len(tags)
    return page


_N = len(FAMILIES)
_STOPS = re.compile(r"[.!?;:,]")


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """(features of every node of all pages, own characters of each): densities, tags, attribute words, place."""
    counts = np.array([len(p.tags) for p in pages])
    base = np.cumsum(counts) - counts
    n = int(counts.sum())
    cat = lambda name: np.array([v for p in pages for v in getattr(p, name)], np.int64)
    parent, end = cat("parent"), cat("end")
    shift = np.repeat(base, counts)
    parent = np.where(parent >= 0, parent + shift, -1)
    end = end + shift
    depth, inline, links, family = cat("depth"), cat("inline"), cat("links"), cat("family")
    tag = np.array([_TAG.get(t, len(TAG_GROUPS)) for p in pages for t in p.tags], np.int64)
    owner = np.array([b + node for p, b in zip(pages, base, strict=True) for node, _ in p.runs], np.int64)
    chars = np.bincount(owner, [len(t) for p in pages for _, t in p.runs], n) if len(owner) else np.zeros(n)
    stops = np.bincount(owner, [len(_STOPS.findall(t)) for p in pages for _, t in p.runs], n) if len(owner) else np.zeros(n)
    rows = np.arange(n)

    def below(x: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(x))
        return total[end] - total[rows]

    all_chars, all_links, all_stops = below(chars), below(links), below(stops)
    nodes, all_inline, paragraphs = end - rows, below(inline), below((tag == 0).astype(float))
    page_chars = np.repeat(all_chars[base], counts) if n else all_chars
    has_up = parent >= 0
    up = np.where(has_up, parent, rows)
    children = np.bincount(parent[has_up], minlength=n)
    # place among siblings: nodes in page order, so a stable sort by parent lists siblings in order
    by = np.argsort(parent, kind="stable")
    group = parent[by]
    first = np.ones(n, bool)
    first[1:] = group[1:] != group[:-1]
    place = np.empty(n, np.int64)
    place[by] = rows - np.maximum.accumulate(np.where(first, rows, 0))
    twins_key = parent * 64 + tag
    _, which, twins = np.unique(twins_key, return_inverse=True, return_counts=True)
    # words and tags of ancestors, level by level
    kind = family | (np.left_shift(1, tag + 16))
    above = np.zeros(n, np.int64)
    for level in range(2, int(depth.max()) + 1 if n else 0):
        here = np.flatnonzero(depth == level)
        above[here] = above[up[here]] | kind[up[here]]
    columns = [
        np.log1p(chars), np.log1p(all_chars), all_chars / np.maximum(page_chars, 1), all_links / np.maximum(all_chars, 1), all_chars / nodes, all_chars / (nodes + all_inline),
        np.log1p(nodes), all_stops / np.maximum(all_chars, 1), np.log1p(paragraphs), paragraphs / nodes, depth, children, place, place / np.maximum(children[up], 1), twins[which] / np.maximum(children[up], 1),
        all_chars[up] / np.maximum(page_chars, 1), all_links[up] / np.maximum(all_chars[up], 1), rows - shift, chars / np.maximum(all_chars, 1),
    ]
    columns += [(family >> k) & 1 for k in range(_N + 1)] + [(above >> k) & 1 for k in range(_N + 1)]
    columns += [tag == k for k in range(len(TAG_GROUPS))] + [(above >> (k + 16)) & 1 for k in range(5, 13)]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1), chars


def decode(pages: list[Page], log_odds: np.ndarray, chars: np.ndarray) -> list[str]:
    """The kept text of each page.

    Keeping is decided for the whole tree at once: the kept nodes' weighted log odds are the largest possible where no
    node is kept under one that is left out.
    """
    out, base = [], 0
    worth = log_odds * np.sqrt(chars + 1.0)
    for page in pages:
        n = len(page.tags)
        value = worth[base : base + n].tolist()
        for k in range(n - 1, 0, -1):  # children stand after their parents
            if value[k] > 0:
                value[page.parent[k]] += value[k]
        kept = [value[0] > 0] + [False] * (n - 1)
        for k in range(1, n):
            kept[k] = value[k] > 0 and kept[page.parent[k]]
        out.append("\n".join(t for node, t in page.runs if kept[node]))
        base += n
    return out
