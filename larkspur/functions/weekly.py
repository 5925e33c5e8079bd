"""Weekly schedules as Column expressions. Days are 1 (Sunday) to 7; an end over 1440 is on the next day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440
NAMES = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")


def display_order(day: Column) -> Column:
    """0 for Monday to 6 for Sunday."""
    return F.pmod(day + 5, F.lit(7))


def day_name(day: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in NAMES]), day.cast("int"))


def in_window(start: Column, end: Column, low: int | None, high: int | None) -> Column | None:
    """Half-open overlap with [low, high); a point if both are equal; None (no filter) if high comes before low."""
    if low is None and high is None:
        return None
    if low is None:
        return start < high
    if high is None:
        return end > low
    if high < low:
        return None
    return (start <= low) & (end > low) if low == high else (start < high) & (end > low)


def active_at(day: Column, start: Column, end: Column, on: int, minute: int) -> Column:
    """Running on day ``on`` at ``minute``, also from the day before past midnight."""
    before = 7 if on == 1 else on - 1
    return ((day == on) & (start <= minute) & (end > minute)) | ((day == before) & (end > DAY) & (F.lit(minute) < end - DAY))


def covered_hours(start: Column, end: Column, first: int = 12, last: int = 23) -> Column:
    """Whole hours from first to last that begin within the schedule; none for an all-day one."""
    hours = F.filter(F.array(*[F.lit(h) for h in range(first, last + 1)]), lambda h: (h * 60 >= start) & (h * 60 < end))
    return F.when((start == 0) & (end >= DAY), F.array().cast("array<int>")).otherwise(hours)


def clock(minute: Column) -> Column:
    """h:mmam or h:mmpm."""
    m = F.pmod(minute, F.lit(DAY))
    hour = F.floor(m / 60)
    twelve = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.format_string("%d:%02d%s", twelve.cast("int"), (m % 60).cast("int"), F.when(hour < 12, "am").otherwise("pm"))
