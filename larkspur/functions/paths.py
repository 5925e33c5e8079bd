"""Paths of search pages, read and written: /suburb/day-product-product/map, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsing import _let
from .text import compact_slug, slugify, suburb_slug

#: Days of the week from 1, the place that is where one stands, and the page that is a map. Fixed values.
WEEK = ("sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday")
NEARBY, MAP, UNKNOWN = "nearby", "map", "unknown"
_SUFFIX = rf"^(.+)-({'|'.join(WEEK)})$"
_NO_NAMES = "array<string>"


def day_number(slug: Column) -> Column:
    """1 to 7 of a weekday's full name, Sunday first; else null."""
    return F.nullif(F.array_position(F.array(*[F.lit(d) for d in WEEK]), F.lower(F.trim(slug))), F.lit(0).cast("long")).cast("int")


def day_slug(day: Column) -> Column:
    return F.when(day.between(1, 7), F.get(F.array(*[F.lit(d) for d in WEEK]), day - 1))


def product_names(catalogue: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """A map from the compact slug of each name and synonym to the name; of equal slugs the first entry's counts.

    The catalogue is the library's own, of a few hundred entries, so the map is a literal.
    """
    known: dict[str, str] = {}
    for name, others in catalogue:
        for written in (name, *others):
            known.setdefault("".join(c for c in unicodedata.normalize("NFKD", written).lower() if c.isascii() and c.isalnum()), name)
    known.pop("", None)
    return F.create_map(*[F.lit(x) for pair in known.items() for x in pair]) if known else F.create_map().cast("map<string,string>")


def what_token(slug: Column, names: Column) -> Column:
    """The product that a slug stands for, or null."""
    return F.try_element_at(names, compact_slug(slug))


def split_what(what: Column, names: Column) -> Column:
    """(path_tokens, query_tokens): products by name, and the other words as they are; blank ones go."""
    tokens = F.filter(F.transform(what, lambda t: F.trim(t)), lambda t: t != "")
    known = F.transform(tokens, lambda t: F.struct(t.alias("t"), what_token(t, names).alias("n")))
    part = lambda a, keep, field: F.transform(F.filter(a, keep), lambda x: x[field])
    return _let(known, lambda a: F.struct(part(a, lambda x: x["n"].isNotNull(), "n").alias("path_tokens"), part(a, lambda x: x["n"].isNull(), "t").alias("query_tokens")))


def what_tokens(query: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(query, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def filter_segment(segment: Column, names: Column) -> Column:
    """(day, what) of 'day-product-…' or 'product-…', of which every part must be known; else null."""
    parts = F.filter(F.split(F.lower(F.trim(segment)), "-"), lambda p: p != "")

    def read(p: Column) -> Column:
        day = day_number(F.get(p, F.lit(0)))
        rest = F.when(day.isNotNull(), F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p)
        what = F.transform(rest, lambda x: what_token(x, names))
        return F.when((F.size(p) > 0) & ~F.exists(what, lambda x: x.isNull()), F.struct(day.alias("day"), what.alias("what")))

    return _let(parts, read)


def write_segment(day: Column, what: Column) -> Column:
    """'wednesday-beer-happyhour'; null if there is neither day nor product."""
    slugs = F.filter(F.transform(F.coalesce(what, F.array().cast(_NO_NAMES)), compact_slug), lambda s: s != "")
    return F.nullif(F.array_join(F.concat(F.array_compact(F.array(day_slug(day))), slugs), "-"), F.lit(""))


def strip_day(segment: Column) -> Column:
    """(base, day): a segment in lower case without the weekday behind its last dash."""
    t = F.lower(F.trim(segment))
    return F.struct(F.when(t.rlike(_SUFFIX), F.regexp_extract(t, _SUFFIX, 1)).otherwise(t).alias("base"), F.when(t.rlike(_SUFFIX), day_number(F.regexp_extract(t, _SUFFIX, 2))).alias("day"))


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _rest(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def parse_where(path: Column, names: Column) -> Column:
    """(kind, slug, map, day, what) of a list's or map's path; kind is suburb, nearby or anywhere.

    The first segment is the place, from whose end a weekday may hang; a filter may follow, and 'map' may be the last. A
    path with anything else is anywhere, without filters.
    """
    none = F.array().cast(_NO_NAMES)

    def where(kind: str, slug: Column, on_map: Column, day: Column, what: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), slug.cast("string").alias("slug"), on_map.alias("map"), day.cast("int").alias("day"), what.alias("what"))

    anywhere = where("anywhere", F.lit(None), F.lit(False), F.lit(None), none)

    def read(x: Column) -> Column:
        s, first, filters = x["s"], x["first"], x["filters"]
        rest = F.when(filters.isNotNull(), _rest(_rest(s))).otherwise(_rest(s))
        day, what = F.coalesce(filters["day"], first["day"]), F.coalesce(filters["what"], none)
        on_map = F.coalesce(F.get(rest, F.lit(0)) == MAP, F.lit(False))
        whole = (F.size(rest) == 0) | ((F.size(rest) == 1) & on_map)
        return (
            F.when(F.size(s) == 0, anywhere)
            .when((F.size(s) == 1) & (first["base"] == MAP), where("anywhere", F.lit(None), F.lit(True), first["day"], none))
            .when(whole & (first["base"] == NEARBY), where("nearby", F.lit(None), on_map, day, what))
            .when(whole, where("suburb", first["base"], on_map, day, what))
            .otherwise(anywhere)
        )

    parts = lambda s: F.struct(s.alias("s"), strip_day(F.get(s, F.lit(0))).alias("first"), filter_segment(F.get(s, F.lit(1)), names).alias("filters"))
    return _let(_segments(path), lambda s: _let(parts(s), read))


def strip_filters(path: Column, names: Column) -> Column:
    """(base, day, what): a path without the filter that ends it and without weekdays behind its segments' last dashes.

    A path's only segment is its place and never a filter.
    """

    def read(s: Column) -> Column:
        last = F.when(F.size(s) > 1, filter_segment(F.element_at(s, -1), names))

        def cut(f: Column) -> Column:
            kept = F.transform(F.when(f.isNotNull(), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s), strip_day)
            hung = F.get(F.filter(F.transform(kept, lambda k: k["day"]), lambda d: d.isNotNull()), F.lit(0))
            base = F.concat(F.lit("/"), F.array_join(F.transform(kept, lambda k: k["base"]), "/"))
            return F.struct(base.alias("base"), F.coalesce(f["day"], hung).alias("day"), F.coalesce(f["what"], F.array().cast(_NO_NAMES)).alias("what"))

        return F.when(F.size(s) == 0, F.struct(F.lit("/").alias("base"), F.lit(None).cast("int").alias("day"), F.array().cast(_NO_NAMES).alias("what"))).otherwise(_let(last, cut))

    return _let(_segments(path), read)


def append_filters(path: Column, day: Column, what: Column, names: Column) -> Column:
    """The path with a filter of the day and those words that are products in place of any that it had.

    '/' and '/map' take none; a query or fragment stays behind the path.
    """
    cut = F.struct(F.regexp_extract(path, r"^[^?#]*", 0).alias("p"), F.regexp_extract(path, r"[?#].*$", 0).alias("t"))

    def write(x: Column) -> Column:
        segment = write_segment(day, split_what(F.coalesce(what, F.array().cast(_NO_NAMES)), names)["path_tokens"])
        base = strip_filters(x["p"], names)["base"]
        with_filter = lambda b: F.when(b == f"/{MAP}", b).otherwise(F.concat_ws("/", b, segment))
        return F.concat(F.when(x["p"].isin("", "/"), "/").otherwise(_let(base, with_filter)), x["t"])

    return _let(cut, write)


def days_param(value: Column) -> Column:
    """Days 1 to 7 of a comma-separated list; what is no such number goes."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda d: F.trim(d).try_cast("int")), lambda d: d.between(1, 7))


def time_range(start: Column, end: Column) -> Column:
    """(start, end) of two parameters, either of which may be missing; null if neither is there or one is out of place."""
    given = lambda v: F.coalesce(v, F.lit("")) != ""
    s, e = F.trim(start).try_cast("int"), F.trim(end).try_cast("int")
    bad = (given(start) & ~F.coalesce(s.between(0, 1439), F.lit(False))) | (given(end) & ~F.coalesce(e.between(1, 1440), F.lit(False))) | (given(start) & given(end) & F.coalesce(e < s, F.lit(False)))
    return F.when((given(start) | given(end)) & ~bad, F.struct(F.when(given(start), s).alias("start"), F.when(given(end), e).alias("end")))


def suburb_path(name: Column, postcode: Column) -> Column:
    return F.concat(F.lit("/"), suburb_slug(name, postcode))


def venue_path(suburb: Column, venue: Column) -> Column:
    place = F.when(F.coalesce(suburb, F.lit("")) == "", UNKNOWN).otherwise(slugify(suburb))
    return F.concat(F.lit("/"), place, F.lit("/"), slugify(venue))
