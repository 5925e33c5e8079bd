"""Main text of web pages: boosted trees over DOM nodes, decoded over the whole tree."""

from __future__ import annotations

import functools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dom
from .boosting import BoostedTrees

#: Made-up pages that the trees are fitted on.
TRAINING_PAGES = 500
#: Characters of html whose nodes are scored together.
CHUNK = 2 << 20


class PageMaker:
    """Made-up pages in many layouts, with marks for what is main text.

    Parts are written with semantic tags, with named blocks, or with both; some names are missing or say nothing.
    Notices, adverts, forms and link lists also stand inside articles, and comments look like paragraphs.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def text(self, low: int, high: int, stops: bool = True) -> str:
        words = ["".join(self.r.choice("abcdeilmnorstu") for _ in range(self.r.randint(2, 9))) for _ in range(self.r.randint(low, high))]
        if stops:
            words = [w + self.r.choice(",..") if self.r.random() < 0.15 else w for w in words]
            return (" ".join(words) + ".").capitalize()
        return " ".join(words)

    def wrap(self, tag: str, names: list[str], inner: str, mark: str) -> str:
        """A part of the page: semantic, named or both; a mark says whether it is kept."""
        how = self.r.random()
        name = self.r.choice(names)
        where = self.r.choice(("class", "id"))
        mark = f' role="{mark}"' if mark else ""
        if how < 0.35:
            return f"<{tag}{mark}>{inner}</{tag}>"
        if how < 0.6:
            return f'<{tag} {where}="{name}"{mark}>{inner}</{tag}>'
        if how < 0.92:
            return f'<div {where}="{name}"{mark}>{inner}</div>'
        return f'<div class="{self.r.choice(("block", "box", "col", "row", "x1"))}"{mark}>{inner}</div>'

    def links(self, low: int, high: int) -> str:
        names = [self.text(1, 4, False) for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.75:
            return "<ul>" + "".join(f'<li><a href="/{k}">{n}</a></li>' for k, n in enumerate(names)) + "</ul>"
        return self.r.choice((" | ", " ")).join(f'<a href="/{k}">{n}</a>' for k, n in enumerate(names))

    def para(self, low: int = 8, high: int = 90) -> str:
        t = self.text(low, high)
        if self.r.random() < 0.15:
            t += f' <a href="/x">{self.text(1, 4, False)}</a> ' + self.text(3, 20)
        if self.r.random() < 0.1:
            t = f"<b>{t}</b>" if self.r.random() < 0.5 else f"<b>{t}<br>"
        return f"<p>{t}" + ("</p>" if self.r.random() < 0.85 else "")

    def advert(self) -> str:
        return self.wrap(self.r.choice(("div", "aside", "section")), ["ad", "advert", "ads", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"], self.text(2, 30) if self.r.random() < 0.6 else f"<p>{self.text(3, 25)}</p>", "xleft")

    def notice(self) -> str:
        return self.wrap(self.r.choice(("div", "section", "aside")), ["cookie-notice", "cookie-banner", "notice", "consent", "gdpr", "alert", "privacy-notice"], f"<p>{self.text(6, 40)}</p>" if self.r.random() < 0.6 else self.text(6, 40), "xleft")

    def form(self) -> str:
        inner = f"<label>{self.text(1, 4, False)}</label><input name=q>" + (f"<p>{self.text(3, 15)}</p>" if self.r.random() < 0.5 else "") + f"<button>{self.text(1, 2, False)}</button>"
        return f'<form role="xleft" action="/s">{inner}</form>' if self.r.random() < 0.7 else self.wrap("form", ["newsletter", "search-form", "subscribe", "signup", "login"], inner, "xleft")

    def sidebar(self) -> str:
        parts = [self.links(2, 8)] + ([f"<h3>{self.text(1, 4, False)}</h3>"] if self.r.random() < 0.6 else []) + ([f"<p>{self.text(5, 40)}</p>"] if self.r.random() < 0.5 else [])
        self.r.shuffle(parts)
        return self.wrap("aside", ["sidebar", "side", "related", "widget", "rail", "recommended", "more-stories"], "".join(parts), "xleft")

    def comments(self) -> str:
        one = lambda: self.wrap(self.r.choice(("div", "li", "article")), ["comment", "reply", "response"], (f"<b>{self.text(1, 2, False)}</b>" if self.r.random() < 0.5 else "") + f"<p>{self.text(4, 60)}</p>", "")
        head = f"<h{self.r.randint(2, 4)}>{self.text(1, 3, False)}</h2>" if self.r.random() < 0.6 else ""
        inner = head + "".join(one() for _ in range(self.r.randint(1, 6)))
        name = self.r.choice(("comments", "discussion", "responses", "comment-list", "replies"))
        return f'<{self.r.choice(("section", "div", "ol", "aside"))} {self.r.choice(("class", "id"))}="{name}" role="xleft">{inner}</section>' if self.r.random() < 0.4 else self.wrap("section", [name], inner, "xleft")

    def article(self) -> str:
        parts = [f"<h1>{self.text(2, 12, False)}</h1>"] if self.r.random() < 0.85 else []
        for _ in range(self.r.choice((1, 1, 2, 3, 5, 8, 13))):
            k = self.r.random()
            if k < 0.72:
                parts.append(self.para(1, 6) if self.r.random() < 0.3 else self.para())
            elif k < 0.8:
                parts.append(f"<h{(h := self.r.randint(2, 4))}>{self.text(1, 8, False)}</h{h}>")
            elif k < 0.86:
                parts.append("<ul>" + "".join(f"<li>{self.text(2, 18)}</li>" for _ in range(self.r.randint(2, 6))) + "</ul>")
            elif k < 0.9:
                parts.append(f"<blockquote>{self.para()}</blockquote>")
            elif k < 0.93:
                parts.append("<table>" + "".join("<tr>" + "".join(f"<td>{self.text(1, 4, False)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            elif k < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{self.text(2, 12)}</figcaption></figure>")
            else:
                parts.append(f"<div>{self.para()}{self.para()}</div>")
        for maker in (self.advert, self.form, self.notice, self.sidebar):
            if self.r.random() < 0.12:
                parts.insert(self.r.randint(1, len(parts)), maker())
        if self.r.random() < 0.08:
            parts.append(self.comments())
        body = "".join(parts)
        if self.r.random() < 0.2:
            body = f"<div>{body}</div>"
        return self.wrap("article", ["content", "post", "article-body", "entry-content", "main-text", "story", "post-content"], body, "xkept")

    def page(self) -> str:
        r = self.r
        top = []
        if r.random() < 0.6:
            top.append(self.wrap("header", ["header", "site-header", "masthead", "top-bar"], f"<h2>{self.text(1, 4, False)}</h2>" + (self.links(2, 6) if r.random() < 0.5 else "") + (f"<p>{self.text(2, 12)}</p>" if r.random() < 0.4 else ""), "xleft"))
        if r.random() < 0.85:
            top.append(self.wrap("nav", ["nav", "menu", "navbar", "breadcrumbs", "main-menu"], self.links(2, 10), "xleft"))
        middle = [self.article()]
        if r.random() < 0.45:
            middle.insert(r.randint(0, 1), self.sidebar())
        if r.random() < 0.4:
            middle.append(self.comments())
        if r.random() < 0.3:
            middle.append(self.wrap("section", ["related", "recommended", "more"], f"<h3>{self.text(1, 3, False)}</h3>" + self.links(2, 6), "xleft"))
        for maker, chance in ((self.advert, 0.6), (self.notice, 0.35), (self.form, 0.3)):
            if r.random() < chance:
                (top if r.random() < 0.6 else middle).append(maker())
        body = "".join(middle)
        body = f"<main>{body}</main>" if r.random() < 0.3 else f'<div class="{r.choice(("wrapper", "container", "page", "layout"))}">{body}</div>' if r.random() < 0.4 else body
        foot = self.wrap("footer", ["footer", "site-footer", "bottom", "colophon"], (self.links(1, 5) if r.random() < 0.4 else "") + (f"<p>{self.text(3, 25)}</p>" if r.random() < 0.5 else f"&copy; {self.text(3, 20)}"), "xleft") if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html><head><title>{self.text(2, 8)}</title><style>p{{}}</style></head><body>{''.join(top)}<!-- x -->{body}{foot}<script>var a;</script></body></html>"


def labels(page: dom.Page) -> np.ndarray:
    """1 for a made-up page's nodes that are main text or hold some."""
    n = len(page.tags)
    inside, y = [False] * n, [False] * n
    for k in range(n):
        mark = page.family[k]
        inside[k] = bool(mark & dom.KEPT) or (not mark & dom.LEFT and page.parent[k] >= 0 and inside[page.parent[k]])
    y = inside[:]
    for k in range(n - 1, 0, -1):
        if y[k]:
            y[page.parent[k]] = True
    return np.array(y, float)


@functools.cache
def main_text_model(pages: int = TRAINING_PAGES, seed: int = 11) -> BoostedTrees:
    """Trees fitted on ``pages`` made-up pages; the same for every call."""
    maker = PageMaker(seed)
    read = [dom.read_page(maker.page()) for _ in range(pages)]
    x, chars = dom.features(read)
    return BoostedTrees.fit(x, np.concatenate([labels(p) for p in read]), np.sqrt(chars + 1.0) + 1.0)


def main_texts(sources: list[str | None], model: BoostedTrees) -> list[str]:
    pages = [dom.read_page(s) for s in sources]
    x, chars = dom.features(pages)
    return dom.decode(pages, model.log_odds(x), chars)


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page.

    The whole html is read into block nodes. Boosted trees over node features (densities of the subtree, words of
    class, id and role, depth, siblings, tags and ancestors) give each node log odds, and the best set of nodes without
    one kept below one left out is kept. White space within a block becomes one space; kept blocks are joined by \\n.

    A null or empty html has the text ''; so has a page on which nothing is kept. Repeated rows are read each; other
    columns are ignored; an empty table gives an empty result.
    """
    model = main_text_model()
    slim = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first = batch.column("html"), 0
            while first < len(column):
                last, room, sources = first, CHUNK, []
                while last < len(column) and (last == first or room > 0):
                    sources.append(column[last].as_py())
                    room -= len(sources[-1] or "")
                    last += 1
                texts = main_texts(sources, model)
                yield pa.RecordBatch.from_arrays([batch.column("page_id")[first:last], batch.column("url")[first:last], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                first = last

    kinds = [slim.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return slim.mapInArrow(extract, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL: dict[str, str] = {}  # trees over a DOM can't be expressed in SQL; tested on pages with known text
QUERIES = {"op2_html_text": op2_html_text}
