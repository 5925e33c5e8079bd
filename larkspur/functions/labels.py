"""Short labels for schedules, dates, counts and ratios, and opening hours as intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .weekly import DAY

#: Hours that a time filter offers, as minutes. Fixed values.
FILTER_FIRST, FILTER_LAST = 600, 1440


def time_input(text: Column) -> Column:
    """Minutes of 'h', 'h:mm' with or without am or pm, hours up to 12; else null."""
    t = F.lower(F.trim(text))
    part = lambda k: F.regexp_extract(t, r"^(\d{1,2})(?::(\d{2}))?\s*(am|pm)?$", k)
    hour, minute = part(1).try_cast("int"), F.when(part(2) == "", F.lit(0)).otherwise(part(2).try_cast("int"))
    on_clock = F.when(part(3) == "am", hour % 12).when(part(3) == "pm", hour % 12 + 12).otherwise(hour)
    return F.when(hour.between(0, 12) & minute.between(0, 59), on_clock * 60 + minute).cast("int")


def snap_to_hour(minute: Column) -> Column:
    """The nearest full hour among those that a time filter offers."""
    return F.greatest(F.lit(FILTER_FIRST), F.least(F.lit(FILTER_LAST), F.floor(minute / 60 + 0.5).cast("int") * 60))


def compact_clock(minute: Column, half: Column | None = None) -> Column:
    """'5pm', '5:30pm'; without am or pm where ``half`` is false."""
    m = F.pmod(minute, F.lit(DAY))
    hour, rest = F.floor(m / 60).cast("int"), (m % 60).cast("int")
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    time = F.when(rest == 0, twelve.cast("string")).otherwise(F.format_string("%d:%02d", twelve, rest))
    suffix = F.when(hour < 12, "am").otherwise("pm")
    return F.concat(time, suffix if half is None else F.when(half, suffix).otherwise(""))


def compact_range(start: Column, end: Column) -> Column:
    """'5-7pm', '11am-2pm', 'Until 6pm' from midnight on, 'From 7:30pm' up to midnight."""
    a, b = F.pmod(start, F.lit(DAY)), F.pmod(end, F.lit(DAY))
    return F.when(a == 0, F.concat(F.lit("Until "), compact_clock(b))).when(b == 0, F.concat(F.lit("From "), compact_clock(start))).otherwise(F.concat(compact_clock(start, (start >= 720) != (b >= 720)), F.lit("-"), compact_clock(b)))


def time_badges(schedules: DataFrame, key: str) -> DataFrame:
    """(key, badge): the times of a key whose days all have the same ones; 'Various' if they differ; '' for all day alone."""
    text = F.when((F.col("start") == 0) & (F.col("end") >= DAY), F.lit("")).otherwise(compact_range(F.col("start"), F.col("end")))
    days = schedules.select(key, "day", "start", "end", text.alias("text")).groupBy(key, "day").agg(F.sort_array(F.collect_set(F.struct("start", "end", "text"))).alias("times"))
    label = F.array_join(F.filter(F.transform("times", lambda t: t["text"]), lambda t: t != ""), ", ")
    return days.groupBy(key).agg(F.min("times").alias("times"), F.max("times").alias("_most")).select(key, F.when(F.col("times") == F.col("_most"), label).otherwise("Various").alias("badge"))


def date_range(start: Column, end: Column) -> Column:
    """'14 Nov 2025 – 1 Dec 2025', one date if both are equal, 'From …', 'Until …', null without dates."""
    day = lambda d: F.date_format(d, "d MMM yyyy")
    return F.when(start == end, day(start)).when(start.isNotNull() & end.isNotNull(), F.concat_ws(" – ", day(start), day(end))).when(start.isNotNull(), F.concat(F.lit("From "), day(start))).when(end.isNotNull(), F.concat(F.lit("Until "), day(end)))


PERIODS = "struct<regularOpeningHours:struct<periods:array<struct<open:struct<day:int,hour:int,minute:int>,close:struct<day:int,hour:int,minute:int>>>>>"


def opening_hours(payload: Column) -> Column:
    """Array of (day, start, end) from a place's JSON, days from 1; null if it has none that can be used.

    A period without a close lasts to midnight; a close on a later day counts on past midnight; one before its opening
    is dropped, and so is what has no such hour, minute or day.
    """
    periods = F.from_json(payload, PERIODS)["regularOpeningHours"]["periods"]
    valid = lambda p: p["day"].between(0, 6) & p["hour"].between(0, 23) & F.coalesce(p["minute"], F.lit(0)).between(0, 59)
    at = lambda p: p["hour"] * 60 + F.coalesce(p["minute"], F.lit(0))
    end = lambda p: F.when(p["close"].isNull(), F.lit(DAY)).when(valid(p["close"]), F.pmod(p["close"]["day"] - p["open"]["day"], F.lit(7)) * DAY + at(p["close"]))
    read = F.transform(periods, lambda p: F.struct((p["open"]["day"] + 1).alias("day"), F.when(valid(p["open"]), at(p["open"])).alias("start"), end(p).alias("end")))
    return F.get(F.filter(F.array(F.array_sort(F.filter(read, lambda x: x["end"] > x["start"]))), lambda x: F.size(x) > 0), F.lit(0))
