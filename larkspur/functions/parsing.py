"""Days and times that people wrote, links in pages and words to search for, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .weekly import DAY

#: Days in the order in which they are listed, with their short forms. Fixed values.
DAYS = {
    "monday": "mon",
    "tuesday": "tue|tues",
    "wednesday": "wed",
    "thursday": "thu|thur|thurs",
    "friday": "fri|friyay|friyays",
    "saturday": "sat",
    "sunday": "sun",
}
WORKING, WEEKEND = ("monday", "tuesday", "wednesday", "thursday", "friday"), ("saturday", "sunday")
#: Any name of a day, long ones first, and a range of days. Fixed values.
NAME = "|".join(sorted([*DAYS, *(s for short in DAYS.values() for s in short.split("|"))], key=lambda s: (-len(s), s)))
RANGE = rf"\b({NAME})\s*(?:-|–|—|to|til|till|'til|until|through|thru)\s*({NAME})\b"

#: A time without am or pm is read as one between these minutes, the later one if there are two.
EARLIEST, LATEST = 7 * 60, 21 * 60
#: An end before its start is on the next day if it is before this minute.
MORNING = 10 * 60
HREF = r"""<a\s[^>]*?href\s*=\s*["']([^"'#]+)"""


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value's expression once in the plan however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _number(name: Column) -> Column:
    """0 to 6 of any name of a day: their first three letters differ."""
    return F.array_position(F.array(*[F.lit(d[:3]) for d in DAYS]), F.substring(name, 1, 3)) - 1


def days(text: Column) -> Column:
    """The days that a text names, from Monday on: names within words, short forms, ranges, weekdays, weekends.

    A range may wrap around the week. 'Every day' gives ['everyDay'] alone; null and texts without days give none.
    """
    return _let(F.lower(F.trim(F.coalesce(text, F.lit("")))), _days)


def _days(t: Column) -> Column:
    starts, ends = (F.transform(F.regexp_extract_all(t, F.lit(RANGE), F.lit(k)), _number) for k in (1, 2))
    # the days of each range, counted on from its start
    ranged = F.flatten(F.zip_with(starts, ends, lambda a, b: F.transform(F.sequence(a, a + F.pmod(b - a, F.lit(7))), lambda k: F.pmod(k, F.lit(7)))))

    def listed(r: Column) -> Column:
        group = lambda day: r"\bweekdays?\b" if day in WORKING else r"\bweekends?\b"
        named = [F.when(t.contains(day) | t.rlike(rf"\b(?:{short})\b") | t.rlike(group(day)) | F.array_contains(r, F.lit(k).cast("long")), F.lit(day)) for k, (day, short) in enumerate(DAYS.items())]
        return F.array_compact(F.array(*named))

    every = t.contains("every day") | (F.replace(t, F.lit(" "), F.lit("")) == "everyday")
    return F.when(every, F.array(F.lit("everyDay"))).otherwise(_let(ranged, listed))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\p{P}\p{S}]+$", "")


def minutes(text: Column) -> Column:
    """Minutes after midnight of '5pm', '17.30'-like clock times on twelve hours, '630pm', noon and midnight; else null."""
    return _let(_plain(text), _minutes)


def _minutes(t: Column) -> Column:
    clock, compact = r"^(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm)?$", r"^(\d{1,2})(\d{2})\s*(am|pm)$"
    parts = lambda pattern: F.array(*[F.regexp_extract(t, pattern, k) for k in (1, 2, 3)])

    def read(p: Column) -> Column:
        hour, minute = p[0].try_cast("int"), F.when(p[1] == "", F.lit(0)).otherwise(p[1].try_cast("int"))
        known = hour.between(1, 12) & minute.between(0, 59)
        return F.when(known, _let(F.pmod(hour, F.lit(12)) * 60 + minute, lambda am: _half(am, p[2])))

    return F.when(t.isin("noon", "midday"), 720).when(t == "midnight", 0).otherwise(_let(F.when(t.rlike(clock), parts(clock)).otherwise(parts(compact)), read)).cast("int")


def _half(am: Column, half: Column) -> Column:
    fits = lambda m: m.between(EARLIEST, LATEST)
    return F.when(half == "am", am).when(half == "pm", am + 720).when(fits(am + 720), am + 720).when(fits(am), am)


def between(start: Column, end: Column) -> Column:
    """A stretch as (kind, start, end); an end in the early morning that comes before the start is on the next day."""
    return F.struct(F.lit("between").alias("kind"), start.cast("int").alias("start"), F.when((end < start) & (end < MORNING), end + DAY).otherwise(end).cast("int").alias("end"))


def hours(text: Column) -> Column:
    """(kind, start, end) of written hours: allDay, between, or from (end is null); null if they can't be read.

    'from' and 'available' in front are skipped; 'open' as a start is midnight; 'lunch' is noon to two.
    """
    t = _plain(F.regexp_replace(text, "[–—]", "-"))
    return _let(F.trim(F.regexp_replace(t, r"^(available from |available |from )", "")), _hours)


def _hours(t: Column) -> Column:
    time = r"\d{1,2}(?:[:.]\d{2})?\s*(?:am|pm)?"

    def stretch(start: Column, end: Column) -> Column:
        return _let(F.struct(start.alias("a"), end.alias("b")), lambda x: F.when(x["a"].isNotNull() & x["b"].isNotNull(), between(x["a"], x["b"])))

    def parted(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        return F.when(F.size(p) == 2, stretch(F.when(_plain(first).isin("open", "opening"), F.lit(0)).otherwise(minutes(first)), minutes(F.get(p, F.lit(1)))))

    booked = stretch(minutes(F.regexp_extract(t, rf"^({time})\s+rego(?:\s*(?:for|,)\s*{time}\s+start)?$", 1)), F.lit(0))
    ranges = [_let(F.filter(F.transform(F.split(t, s), lambda x: F.trim(x)), lambda p: p != ""), parted) for s in (" - ", "-", " to ")]
    alone = _let(minutes(t), lambda m: F.when(m.isNotNull(), F.struct(F.lit("from").alias("kind"), m.alias("start"), F.lit(None).cast("int").alias("end"))))
    whole = F.struct(F.lit("allDay").alias("kind"), F.lit(0).alias("start"), F.lit(DAY).alias("end"))
    return F.when(t.isin("all day", "all-day", "allday"), whole).when(t == "lunch", between(F.lit(720), F.lit(840))).otherwise(F.coalesce(booked, *ranges, alone))


def covers(outer: Column, inner: Column) -> Column:
    """Whether hours cover others; 'from' counts as a point."""
    inside = (outer["kind"] == "between") & (inner["kind"] != "allDay") & (outer["start"] <= inner["start"]) & (F.coalesce(inner["end"], inner["start"]) <= outer["end"])
    return (outer["kind"] == "allDay") | inside | ((outer["kind"] == inner["kind"]) & (outer["start"] == inner["start"]) & outer["end"].eqNullSafe(inner["end"]))


def distinct_hours(listed: Column) -> Column:
    """An array of hours without those that another one covers, in order; of equal ones the first stays."""
    return F.filter(listed, lambda x, i: ~F.exists(F.transform(listed, lambda y, j: (j != i) & covers(y, x) & (~covers(x, y) | (j < i))), lambda hit: hit))


def links(html: Column) -> Column:
    """Distinct targets of a page's anchors, without fragments, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1)))


def search_words(text: Column) -> Column:
    """The lower-cased words of a text, set off by single spaces, so that a phrase is a substring."""
    return F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""), " "), F.lit(" "))


def matches_query(words: Column, query: str) -> Column:
    """Whether search_words() hold one of the comma-separated terms; a term of several words is a phrase."""
    terms = ["".join(c if c.isascii() and c.isalnum() else " " for c in term.lower()).split() for term in query.split(",")]
    out = F.lit(False)
    for term in filter(None, terms):
        out = out | words.contains(f" {' '.join(term)} ")
    return out


def expand_terms(terms: list[str], groups: dict[str, list[str]], synonyms: dict[str, list[str]] | None = None) -> list[str]:
    """Terms with the members of their groups, breadth first and each once whatever its case, each followed by its synonyms."""
    queue, seen, out = list(terms), set(), []
    members = {name.lower(): found for name, found in groups.items()}
    also = {name.lower(): found for name, found in (synonyms or {}).items()}
    while queue:
        term = queue.pop(0)
        if term.lower() not in seen:
            seen.add(term.lower())
            out.append(term)
            queue += members.get(term.lower(), [])
    return [x for term in out for x in (term, *also.get(term.lower(), []))]
