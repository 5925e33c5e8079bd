"""Titles and labels that pages and posters show, and the end minutes that editors take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import WEEK
from .parsing import MORNING
from .weekly import DAY


def day_label(day: Column) -> Column:
    """A weekday's name, Sunday first."""
    return F.coalesce(F.when(day.between(1, 7), F.get(F.array(*[F.lit(d.capitalize()) for d in WEEK]), day - 1)), F.concat(F.lit("Day "), day))


def _title_words(s: Column) -> Column:
    words = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), " ")


def specials_title(days: Column, what: Column, place: Column) -> Column:
    """'Monday Beer and Wine Specials in Place': a day if there is one alone, products if there are one or two; no place is nearby."""
    named = F.transform(what, _title_words)
    products = F.when(F.size(what).between(1, 2), F.concat(F.array_join(named, " and "), F.lit(" Specials"))).otherwise("Pub Specials")
    day = F.when((F.size(days) == 1) & F.get(days, F.lit(0)).between(1, 7), day_label(F.get(days, F.lit(0))))
    return F.concat(F.concat_ws(" ", day, products), F.coalesce(F.concat(F.lit(" in "), place), F.lit(" Nearby")))


def day_selection(days: Column) -> Column:
    """'Any day' for none or all seven, 'Mon, Sun' for up to two, from Monday on, '4 days' for more."""
    by_week = F.array_sort(F.transform(days, lambda d: F.struct(F.pmod(d + 5, F.lit(7)).alias("place"), d.alias("day"))))
    short = F.transform(by_week, lambda x: F.substring(day_label(x["day"]), 1, 3))
    return F.when(F.size(days).isin(0, 7), "Any day").when(F.size(days) <= 2, F.array_join(short, ", ")).otherwise(F.concat(F.size(days), F.lit(" days")))


def edited_end(end: Column, start: Column) -> Column:
    """An end as an editor's clock gives it: midnight is the day's end, and one before its start in the morning is the next day's."""
    of_day = F.when(end == 0, DAY).otherwise(end)
    within = F.when(of_day == DAY, 0).when(of_day > DAY, of_day % DAY).otherwise(of_day)
    return F.when((within < start) & (within < MORNING), within + DAY).otherwise(within)


def hour_label(hour: Column) -> Column:
    h = F.pmod(F.floor(hour), F.lit(24))
    return F.concat(F.when(h % 12 == 0, 12).otherwise(h % 12), F.when(h >= 12, "pm").otherwise("am"))


def count_label(n: Column) -> Column:
    return F.format_number(n, 0)


def per_sqkm_label(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit(" deals/km²"))


def per_thousand_label(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit(" deals per 1,000 people"))


def percent_label(value: Column) -> Column:
    return F.concat(F.floor(value + 0.5), F.lit("%"))
