"""Links of pages: resolved against the page, same origin, and which of them are worth following."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .deal_text import has_keyword
from .parsing import _let, days
from .text import normalise_url, source_type

#: An anchor with a quoted target and its text; Java and RE2 read it alike.
ANCHOR = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def resolve_url(href: Column, page: Column) -> Column:
    """The address that a link leads to, normalised; null for fragments of the page, other schemes and blank ones."""
    return _let(F.struct(F.trim(href).alias("h"), F.regexp_replace(page, "[?#].*$", "").alias("p"), F.regexp_replace(page, "#.*$", "").alias("q")), _resolve)


def _resolve(x: Column) -> Column:
    h, page = x["h"], x["p"]
    scheme, origin = F.regexp_extract(page, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(page, r"^([a-zA-Z]+://[^/]*)", 1)
    folder = F.concat(origin, F.regexp_extract(page, r"^[a-zA-Z]+://[^/]*(/(?:.*/)?)", 1))
    folder = F.when(folder == origin, F.concat(origin, F.lit("/"))).otherwise(folder)
    whole = (
        F.when((h == "") | h.startswith("#"), None)
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("/"), F.concat(origin, _no_dots(h)))
        .when(h.startswith("?"), F.concat(page, h))
        .otherwise(F.concat(origin, _no_dots(F.concat(F.substr(folder, F.length(origin) + 1), h))))
    )
    return normalise_url(whole)


def _no_dots(path: Column) -> Column:
    """A path without its steps '.' and '..'; what follows a question mark or number sign stays as it is."""
    plain, rest = F.regexp_extract(path, "^([^?#]*)", 1), F.regexp_extract(path, "([?#].*)$", 1)
    steps = F.split(F.regexp_replace(plain, r"/\.{1,2}$", "$0/"), "/")
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
    return F.concat(F.when(plain.rlike(r"(?:^|/)\.{1,2}(?:/|$)"), F.array_join(kept, "/")).otherwise(plain), rest)


def same_origin(a: Column, b: Column) -> Column:
    """Whether both have the same host, "www." and http or https aside."""
    host = lambda u: F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i)https?://([^/?#]*)", 1)), r"^www\.", "")
    return (host(a) != "") & (host(a) == host(b))


def worth_following(url: Column, context: Column, keywords: list[str], excluded: list[str]) -> Column:
    """Documents, and pages whose link names a day or a keyword; nothing with an excluded word, no pictures."""
    kind = source_type(url)
    said = (kind == "pdf") | (F.size(days(context)) > 0) | has_keyword(context, keywords)
    return F.coalesce((kind != "image") & ~has_keyword(context, excluded, squeezed=True) & said, F.lit(False))


#: A link element, and one attribute of a tag. Fixed values.
LINK_TAG = r"(?is)<link\s[^>]*>"


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])


def canonical_url(html: Column, page: Column) -> Column:
    """The first address that a page gives as its own, if it is of the page's origin; else null."""
    tags = F.filter(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(LINK_TAG), F.lit(0)), lambda t: F.array_contains(F.split(F.lower(F.coalesce(_attribute(t, "rel"), F.lit(""))), r"\s+"), "canonical"))
    urls = F.transform(tags, lambda t: resolve_url(_attribute(t, "href"), page))
    return F.get(F.filter(urls, lambda u: same_origin(u, page)), F.lit(0))


#: Months in a path. Fixed values.
MONTH_STEPS = "january|jan|february|feb|march|mar|april|apr|may|june|jun|july|jul|august|aug|september|sept|sep|october|oct|november|nov|december|dec"


def of_a_date(url: Column) -> Column:
    """Whether a path names a month as a step or as a part of one, or a year after 'events'."""
    path = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1))
    return path.rlike(rf"(?:^|[/-])(?:{MONTH_STEPS})(?:$|[/-])") | path.rlike(r"/events?/20\d\d(?:$|/)")
