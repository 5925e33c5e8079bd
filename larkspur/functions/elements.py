"""The element tree of one page, as far as its blocks need it: a small helper for tasks over pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

#: Elements without an end tag, and those that a new block or a sibling ends. Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDED_BY = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"})}
#: What is no content, by tag, role, id and hook; words that mark a page's ends; what holds the content. Fixed values.
DROPPED = frozenset("script style noscript svg iframe template nav footer header".split())
DROPPED_ROLES, DROPPED_IDS, DROPPED_HOOKS = {"navigation", "contentinfo", "banner"}, {"SITE_HEADER", "SITE_FOOTER"}, {"header", "footer"}
MARKERS = ("top of page", "bottom of page")
LEAST_CONTENT, LONGEST_HEADING = 50, 80
HEADINGS, MAYBE_HEADING, NOT_IN_HEADING = {f"h{k}" for k in range(1, 7)}, {"p", "div", "span", "li"}, {"div", "p", "section", "article", "ul", "ol", "li"}


class Node:
    __slots__ = ("tag", "attrs", "inner", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.inner: list[Node | str] = []

    @property
    def children(self) -> list[Node]:
        return [x for x in self.inner if isinstance(x, Node)]

    def walk(self) -> Iterator[Node]:
        """The node and all below it, in the order of the page."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += reversed(node.children)

    def text(self, longest: int | None = None) -> str:
        """Text with single spaces, blocks and line breaks set off; cut soon after ``longest`` characters."""
        parts, n, todo = [], 0, [self]
        while todo and (longest is None or n <= 2 * longest + 2):
            x = todo.pop()
            if isinstance(x, str):
                words = " ".join(x.replace("\xa0", " ").split())
                parts += [" " if x[:1].isspace() or x[:1] == "\xa0" else "", words, " " if x[-1:].isspace() or x[-1:] == "\xa0" else ""]
                n += len(words) + (words != "")
            else:
                space = x.tag in BLOCKS or x.tag == "br"
                todo += ([" "] if space else []) + list(reversed(x.inner)) + ([" "] if space else [])
        return " ".join("".join(parts).split())


class Reader(HTMLParser):
    """A page's tree; end tags that open nothing are skipped, and what a new element can't be in ends before it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS and tag not in ("html", "body"):
            self._end({"p"}, BLOCKS - {"p"})
        if tag in ENDED_BY:
            self._end(*ENDED_BY[tag])
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at)
        self.at.inner.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._end({tag}, set())

    def handle_data(self, data: str) -> None:
        self.at.inner.append(data)

    def _end(self, tags: set[str], within: set[str] | frozenset[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in within:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent


def _dropped(node: Node) -> bool:
    a = node.attrs
    if node.tag in DROPPED or a.get("role") in DROPPED_ROLES or a.get("id") in DROPPED_IDS or a.get("data-hook") in DROPPED_HOOKS:
        return True
    own = " ".join("".join(x for x in node.inner if isinstance(x, str)).split()).lower()
    return own in MARKERS


def _content(root: Node) -> Node:
    """The first element that holds enough, by the ways in which pages mark their content, else the body."""
    named = lambda n: set(n.attrs.get("class", "").split())
    ways = (
        lambda n: n.tag == "main", lambda n: n.attrs.get("role") == "main", lambda n: n.attrs.get("id") == "PAGES_CONTAINER", lambda n: n.attrs.get("id") == "SITE_PAGES", lambda n: n.attrs.get("id") == "content", lambda n: "site-content" in named(n),
        lambda n: n.attrs.get("data-elementor-type") == "single", lambda n: "entry-content" in named(n), lambda n: n.tag == "article" and "elementor-post" not in named(n), lambda n: n.tag == "article", lambda n: n.tag == "body",
    )
    first: dict[int, Node] = {}
    for node in root.walk():
        for k, way in enumerate(ways):
            if k not in first and way(node):
                first[k] = node
    for k in range(len(ways)):
        if k in first and len(first[k].text(LEAST_CONTENT)) >= LEAST_CONTENT:
            return first[k]
    return first.get(len(ways) - 1, root)


def _heading(node: Node) -> bool:
    if node.tag in HEADINGS:
        return True
    if node.tag not in MAYBE_HEADING or any(c.tag in NOT_IN_HEADING and c.text(0) for c in node.children):
        return False
    text = node.text(LONGEST_HEADING)
    if not text or len(text) > LONGEST_HEADING:
        return False
    letters = [c for c in text if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return True
    strong = next((n for n in node.walk() if n is not node and n.tag in ("strong", "b")), None)
    return strong is not None and strong.text() == text


def segments(html: str | None) -> list[tuple[str, str, str | None]]:
    """(kind, text, href) of a page's headings, texts and links in order; texts are those of innermost elements."""
    reader = Reader()
    reader.feed(html or "")
    reader.close()
    for node in list(reader.root.walk()):
        node.inner = [x for x in node.inner if isinstance(x, str) or not _dropped(x)]
    out: list[tuple[str, str, str | None]] = []
    todo = [_content(reader.root)]
    while todo:
        node = todo.pop()
        hook = node.attrs.get("data-hook")
        if hook == "item-description":
            continue
        if hook == "item-title" or _heading(node):
            if title := node.text():
                out.append(("heading", title, None))
                if hook == "item-title" and (said := _description(node)):
                    out.append(("text", said, None))
        elif node.tag == "a":
            href = node.attrs.get("href", "")
            out.append(("link", node.text() or href, href))
        elif node.children:
            todo += reversed(node.children)
        elif text := node.text():
            out.append(("text", text, None))
    return out


def _description(title: Node) -> str:
    """The description that goes with an item's title: the next element, else the first one within its parent."""
    if title.parent is None:
        return ""
    mates = title.parent.children
    after = mates[mates.index(title) + 1 : mates.index(title) + 2]
    if after and after[0].attrs.get("data-hook") == "item-description" and (text := after[0].text()):
        return text
    return next((n.text() for n in title.parent.walk() if n is not title.parent and n.attrs.get("data-hook") == "item-description"), "")
