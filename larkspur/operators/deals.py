"""From what was read off a page to deals: mapping, merging within a source, processing, condensing within a venue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import deal_text as T
from ..functions.parsing import DAYS, _let, days, distinct_hours
from ..functions.phrases import clean_phrase, parse_times, phrase_hours
from .folds import FirstFit, Row, first_fit, merged

#: Line ends of any kind. Fixed value.
LINE_END = "[\n\r  \u0085\u000b\u000c]"
#: Minutes at which dinner starts, and those of lunch. Fixed values.
DINNER, LUNCH = 17 * 60, (12 * 60, 14 * 60)
_STRINGS = "array<string>"


def _strings(listed: Column) -> Column:
    return F.coalesce(listed, F.array().cast(_STRINGS))


def _trim(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def _step(rows: DataFrame, **values: Column) -> DataFrame:
    """The rows with new values of columns, read from a generator.

    The planner neither copies what a generator makes into filters and projections above it nor merges steps into one
    expression, which would grow with each use of a column.
    """
    made = F.explode(F.array(F.struct(*[v.alias(c) for c, v in values.items()]))).alias("_made")
    return rows.select(*[c for c in rows.columns if c not in values], made).select(*[c for c in rows.columns if c not in values], "_made.*")


def _popped(details: Column) -> Column:
    """(line, rest): the first line of the details, and the details without it; null if there is none."""
    lines = F.split(F.get(details, F.lit(0)), LINE_END)
    after = _trim(F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), "\n"))
    rest = F.slice(details, 2, F.greatest(F.size(details) - 1, F.lit(0)))
    return F.when(F.size(details) > 0, F.struct(_trim(F.get(lines, F.lit(0))).alias("line"), F.when(after != "", F.concat(F.array(after), rest)).otherwise(rest).alias("rest")))


def _said(title: Column, line: Column) -> Column:
    """The title, and the line behind it unless the title holds it already."""
    holds = F.contains(T.comparison_key(title), T.comparison_key(line))
    return F.when(title == "", line).when(holds, title).otherwise(F.concat_ws(" ", title, line))


def _lines(listed: Column, excluded: Column) -> Column:
    """The lines that are not blank nor excluded, each once whatever its case and spaces."""
    keyed = F.transform(listed, lambda s: F.struct(T.comparison_key(s).alias("k"), s.alias("s")))
    fresh = lambda x, i: (x["k"] != "") & ~F.array_contains(excluded, x["k"])
    kept = F.filter(keyed, fresh)
    return _let(kept, lambda a: F.transform(F.filter(a, lambda x, i: ~F.exists(F.slice(a, 1, i), lambda y: y["k"] == x["k"])), lambda x: x["s"]))


def map_deals(raw: DataFrame, excluded: Sequence[str] = ()) -> DataFrame:
    """Rows of (title, details, conditions, days, times, ...) as cleaned deals; days are names, times (kind, start, end).

    A title that is a day gives way to the first line of the details, without which the row goes. A price that is all of
    a title, or of the first detail, is joined with the other. Then days and times go from the title's ends, cases are
    evened, and lines that say what came before them go. A row with an excluded word in its title goes, as does one
    of which nothing is left. Other columns stay. Nulls count as empty.
    """
    title, details = F.col("title"), F.col("details")
    d = _step(raw, title=_trim(F.regexp_replace(F.coalesce(title, F.lit("")), LINE_END, " ")), details=F.filter(F.transform(_strings(details), _trim), lambda s: s != ""), _keep=F.lit(True))
    is_day, price = F.lower(title).isin(T.NAME.split("|")), T.is_price_line(title)
    d = _step(d, _day=is_day, _p=F.when(is_day | price, _popped(details)))
    line, rest = F.col("_p.line"), F.coalesce("_p.rest", "details")
    d = _step(d, _keep=~F.col("_day") | line.isNotNull(), title=F.when(line.isNull(), title).when(F.col("_day"), line).otherwise(_said(title, line)), details=rest)
    # a line that came in place of a day may be a price itself
    d = _step(d, _p=F.when(F.col("_day") & price, _popped(details)))
    d = _step(d, title=F.when(line.isNull(), title).otherwise(_said(title, line)), details=rest)
    first = F.get(details, F.lit(0))
    d = _step(d, _day=F.coalesce(T.is_price_line(first), F.lit(False)))
    d = _step(d, title=F.when(F.col("_day"), _said(title, first)).otherwise(title), details=F.when(F.col("_day"), F.slice(details, 2, F.size(details))).otherwise(details))
    d = _step(d, title=T.trim_title(title))
    d = _step(d, title=T.format_title(title), details=F.transform(details, T.sentence_case), conditions=F.array_compact(F.transform(_strings(F.col("conditions")), T.condition)))
    said = F.array_join(F.filter(F.transform(_strings(F.col("days")), lambda s: _trim(F.regexp_replace(s, r"(?i)\bthrough\b", "to"))), lambda s: s != ""), " ")
    key = F.array(T.comparison_key(title))
    left = (title != "") | (F.size(details) > 0) | (F.size("conditions") > 0)
    keep = F.col("_keep") & left & ((title == "") | ~T.has_keyword(title, excluded, squeezed=True))
    d = _step(d, _keep=keep, _p=key, details=_lines(details, key), days=days(said))
    d = _step(d, conditions=_lines(F.col("conditions"), F.concat("_p", F.transform(details, T.comparison_key))), times=parse_times(F.col("times")))
    return d.filter("_keep").drop("_keep", "_day", "_p")


def supplement_times(deals: DataFrame, texts: str) -> DataFrame:
    """Deals without times take those of the texts (an array column), or are on all day."""
    found = _let(F.flatten(F.transform(_strings(F.col(texts)), lambda s: phrase_hours(clean_phrase(s)))), distinct_hours)
    whole = F.array(F.struct(F.lit("allDay").alias("kind"), F.lit(0).alias("start"), F.lit(1440).alias("end")))
    other = _let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(whole))
    return _step(deals, times=F.when(F.size("times") > 0, F.col("times")).otherwise(other))


def _key(line: str) -> str:
    return " ".join(line.lower().split())


def _fresh(lines: list[str], said: list[str]) -> list[str]:
    seen = {_key(x) for x in said}
    out = []
    for line in lines:
        if _key(line) and _key(line) not in seen:
            seen.add(_key(line))
            out.append(line)
    return out


def _covers(a: Row, b: Row) -> bool:
    if a == b or a["kind"] == "allDay":
        return True
    return a["kind"] == "between" and b["kind"] != "allDay" and a["start"] <= b["start"] and (b["start"] if b["end"] is None else b["end"]) <= a["end"]


def _widest(hours: list[Row]) -> list[Row]:
    return [h for i, h in enumerate(hours) if not any(_covers(g, h) and (j < i or not _covers(h, g)) for j, g in enumerate(hours) if j != i)]


def _source_fold() -> FirstFit:
    texts = lambda r: {("text", s.lower()) for s in [r["title"], *r["details"]] if s}
    on = lambda r, timed: {("day", d, timed) for d in r["days"]}

    def merge(a: Row, b: Row) -> Row:
        title = a["title"] or b["title"]
        details = _fresh(a["details"] + b["details"], [title])
        conditions = _fresh(a["conditions"] + b["conditions"], [title, *details])
        times = a["times"] if a["times"] == b["times"] else _widest(a["times"] + b["times"])
        return a | {"title": title, "details": details, "conditions": conditions, "days": merged(a["days"], b["days"]), "times": times}

    return FirstFit(lambda r: texts(r) | on(r, bool(r["times"])), lambda r: texts(r) | on(r, False) | (on(r, True) if not r["times"] else set()), merge)


def merge_source(mapped: DataFrame, source: str, order: str) -> DataFrame:
    """Mapped deals of each source, in order, merged into the first one with a text in common, or with a day in common
    where one of the two has no times. Of other columns the first deal's stay."""
    return first_fit(mapped, [source], [order], _source_fold, mapped.schema)


def widest_dates(lines: Column, year: int) -> Column:
    """(start, end) of the earliest start and the latest end that written lines name."""
    each = F.transform(_strings(lines), lambda s: T.promotion_dates(s, year))
    return _let(each, lambda a: F.struct(F.array_min(F.transform(a, lambda x: x["start"])).alias("start"), F.array_max(F.transform(a, lambda x: x["end"])).alias("end")))


def prose_dates(texts: Column, year: int) -> Column:
    """(start, end) of the first and the last date, such as '12th September' or 'July 26, 2026', anywhere in texts."""
    month, day = "|".join(T.MONTHS), r"(\d{1,2})(?:st|nd|rd|th)?"
    forms = rf"(?i)(?:(?:{'|'.join(DAYS)}),?\s+)?(?:({month})\s+{day}(?:,?\s+(\d{{4}}))?|{day}\s+({month})(?:,?\s+(\d{{4}}))?)"
    whole = F.flatten(F.transform(_strings(texts), lambda s: F.regexp_extract_all(s, F.lit(forms), F.lit(0))))
    return _let(F.transform(whole, lambda s: T.written_date(s, F.lit(year))), lambda a: F.struct(F.array_min(a).alias("start"), F.array_max(a).alias("end")))


def process_deals(raw: DataFrame, year: int, excluded: Sequence[str] = ()) -> DataFrame:
    """Raw rows (with promotion_dates and source (type, url, source_url)) as deals that can be stored.

    Dates come from the lines for them, else from the text. Deals of one day only, and of an nth weekday of months, come
    rejected, others new. Each day has each time; dinners that start at midnight start at five, and lunches that last
    all day are from noon to two. A deal without schedule and dates goes. Details and conditions are joined by lines.
    """
    with_raw = raw.withColumn("_raw", F.struct("title", "details", "conditions", "days"))
    d = map_deals(with_raw, excluded)
    join = lambda c: F.nullif(F.array_join(F.filter(F.transform(c, _trim), lambda s: s != ""), "\n"), F.lit(""))
    texts = F.concat(F.array(F.coalesce("_raw.title", F.lit(""))), _strings(F.col("_raw.details")), _strings(F.col("_raw.conditions")))
    d = _step(d, _lines=widest_dates(F.col("promotion_dates"), year), _prose=prose_dates(texts, year))
    lines = F.col("_lines.start").isNotNull() | F.col("_lines.end").isNotNull()
    dates = {f"{x}_date": F.when(lines, F.col(f"_lines.{x}")).otherwise(F.col(f"_prose.{x}")) for x in ("start", "end")}
    nth = F.exists(F.concat(texts, F.col("details"), F.col("conditions")), T.nth_weekday) | F.exists(_strings(F.col("_raw.days")), T.nth_weekday)
    status = F.when(F.col("_nth") | F.coalesce(F.col("start_date") == F.col("end_date"), F.lit(False)), "rejected").otherwise("new")
    number = F.array(*[F.lit(x) for x in DAYS])
    numbered = F.flatten(F.transform("days", lambda x: F.when(x == "everyDay", F.sequence(F.lit(1), F.lit(7))).otherwise(F.array(F.pmod(F.array_position(number, x), F.lit(7)).cast("int") + 1))))
    d = _step(d, **dates, _nth=nth, details=join(F.col("details")), conditions=join(F.col("conditions")))
    text = F.lower(F.concat_ws(" ", "title", "details"))
    lunch, night = F.contains(text, F.lit("lunch")), text.rlike("dinner|evening|night")
    meal = F.when(F.contains(text, F.lit("all day")), None).when(night & ~lunch, "dinner").when(lunch & ~night, "lunch")

    def stretch(day: Column, t: Column, m: Column) -> Column:
        end = F.coalesce(t["end"], F.lit(1440))
        midday = (m == "lunch") & (t["start"] == 0) & end.isin(0, 1440)
        start = F.when((m == "dinner") & (t["start"] == 0), DINNER).when(midday, LUNCH[0]).otherwise(t["start"])
        return F.struct(day.alias("day"), start.cast("int").alias("start"), F.when(midday, LUNCH[1]).otherwise(end).cast("int").alias("end"))

    whole = F.array(F.struct(F.lit("allDay").alias("kind"), F.lit(0).alias("start"), F.lit(1440).alias("end")))
    times = F.when(F.size("times") > 0, F.col("times")).otherwise(whole)
    d = _step(d, _meal=meal, _days=numbered, _times=times)
    d = _step(d, schedules=F.flatten(F.transform("_days", lambda x: F.transform("_times", lambda t: stretch(x, t, F.col("_meal"))))))
    drawn = F.col("source.type").isin("image", "pdf")
    kept = d.filter((F.size("schedules") > 0) | F.col("start_date").isNotNull() | F.col("end_date").isNotNull())
    made = {"title": F.nullif("title", F.lit("")), "creative_url": F.when(drawn, F.col("source.url")), "source_url": F.coalesce("source.source_url", "source.url"), "status": status}
    gone = {"days", "times", "promotion_dates", "source", *[c for c in d.columns if c.startswith("_")]}
    return kept.withColumns(made).drop(*gone)


#: What condense() reads and gives; other columns of a deal can be joined by deal_id.
CONDENSED = "venue_id long, deal_id long, title string, details string, conditions string, status string, creative_url string, source_url string, schedules array<struct<day:int,start:int,end:int>>, products array<string>, source_ids array<long>"


def _narrowest(schedules: list[Row]) -> list[Row]:
    """Schedules, each once, without those that hold another one of their day and more."""
    spans = merged([(s["day"], s["start"], s["end"]) for s in schedules])
    of_day: dict[int | None, list[tuple]] = {}
    for s in spans:
        of_day.setdefault(s[0], []).append(s)
    return [{"day": s[0], "start": s[1], "end": s[2]} for s in spans if not any(t != s and s[1] <= t[1] and t[2] <= s[2] for t in of_day[s[0]])]


def _venue_fold(keywords: Sequence[str]) -> FirstFit:
    def offer(r: Row) -> str:
        return " ".join(s.strip() for s in (r["title"], r["details"]) if s and s.strip())

    def length(r: Row) -> int:
        return len(" ".join(s for s in (offer(r), (r["conditions"] or "").strip()) if s))

    def keys(r: Row) -> set:
        lines = lambda s: frozenset(_key(x) for x in (s or "").split("\n") if x.strip())
        text, on = offer(r).lower(), frozenset(s["day"] for s in r["schedules"] or ())
        return {("same", _key(r["title"] or ""), lines(r["details"]), lines(r["conditions"]))} | {("product", on, w) for w in keywords if w in text}

    def merge(a: Row, b: Row) -> Row:
        best, other = (a, b) if length(a) >= length(b) else (b, a)
        return best | {
            "creative_url": best["creative_url"] or other["creative_url"],
            "schedules": _narrowest((best["schedules"] or []) + (other["schedules"] or [])),
            "products": merged(best["products"], other["products"]),
            "source_ids": merged(best["source_ids"], other["source_ids"]),
        }

    return FirstFit(keys, keys, merge)


def condense(deals: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """Each venue's deals (columns of CONDENSED) in order of deal_id, merged into the first that says the same, or that
    is on the same weekdays and names a product of ``keywords`` too.

    The longer text stays with its id and addresses, the shorter one's picture where it has none; products and sources
    unite; schedules unite, and of two on one day the wider goes if it holds the narrower. Products are found within
    words. Nulls count as empty. Null venues are one venue. Ties in deal_id have no order between them.
    """
    schema = StructType.fromDDL(CONDENSED)
    words = [w.lower() for w in keywords]
    return first_fit(deals.select(*schema.names).to(schema), ["venue_id"], ["deal_id"], lambda: _venue_fold(words), schema)
