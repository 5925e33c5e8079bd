"""Deal search: filters as semi joins, top-k before the nested join, complements, fuzzy names."""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, text, weekly
from ..sources.stored import spread, tasks
from . import edits

#: Names of a group that are a part of one side of a comparison of all with all.
PART = 1 << 13


def approved(deals: DataFrame) -> DataFrame:
    return deals.filter(F.col("status") == "approved")


def with_schedule(deals: DataFrame, schedules: DataFrame, where: Column) -> DataFrame:
    """Deals with a schedule row that ``where`` holds for."""
    return deals.join(schedules.filter(where), "deal_id", "left_semi")


def on_days(deals: DataFrame, schedules: DataFrame, days: list[int]) -> DataFrame:
    return with_schedule(deals, schedules, F.col("day").isin(days))


def in_time(deals: DataFrame, schedules: DataFrame, low: int | None, high: int | None, days: list[int] | None = None) -> DataFrame:
    """Deals in a time window, on one of ``days`` in the same schedule row; a window that ends before it begins is no filter."""
    window = weekly.in_window(F.col("start"), F.col("end"), low, high)
    parts = [x for x in (window, F.col("day").isin(days) if days else None) if x is not None]
    if not parts:
        return deals
    return with_schedule(deals, schedules, parts[0] if len(parts) == 1 else parts[0] & parts[1])


def active_now(deals: DataFrame, schedules: DataFrame, day: int, minute: int) -> DataFrame:
    return with_schedule(deals, schedules, weekly.active_at(F.col("day"), F.col("start"), F.col("end"), day, minute))


def venues_without(venues: DataFrame, deals: DataFrame) -> DataFrame:
    """Venues with none of the deals."""
    return venues.join(deals.select("venue_id").distinct(), "venue_id", "left_anti")


def overlapping_schedules(schedules: DataFrame) -> DataFrame:
    """(deal_id, day, schedule_id, start, end, other_id, other_start, other_end): schedule rows of a deal and day that
    overlap, equal ones too, each pair once by id."""
    slots = schedules.select("deal_id", "day", "schedule_id", "start", "end")
    other = slots.select("deal_id", "day", F.col("schedule_id").alias("other_id"), F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    apart = (F.col("schedule_id") < F.col("other_id")) & (F.col("start") < F.col("other_end")) & (F.col("end") > F.col("other_start"))
    return slots.join(other, ["deal_id", "day"]).filter(apart)


def search(deals: DataFrame, venues: DataFrame, schedules: DataFrame, order: list[Column], limit: int = 100) -> DataFrame:
    """The first ``limit`` deals with venue and nested schedules, ordered by day and start; the limit comes before the join to schedules."""
    top = deals.join(venues.drop("rating"), "venue_id").orderBy(*order).limit(limit)
    nested = schedules.join(top.select("deal_id"), "deal_id", "left_semi").groupBy("deal_id").agg(F.sort_array(F.collect_list(F.struct("day", "start", "end"))).alias("schedules"))
    return top.join(nested, "deal_id", "left").orderBy(*order)


def clamp_to_hours(schedules: DataFrame, hours: DataFrame) -> DataFrame:
    """The parts of schedules (venue_id, deal_id, day, start, end) within opening hours (venue_id, day, open, close).

    Schedules of a venue and day without known hours stay as they are. Both are dealt to as many tasks as shuffles have,
    so that no task sorts a core's share, and hours, of which the planner knows a venue's size alone, are not broadcast.
    """
    schedules, hours = spread(schedules, "venue_id", "day"), spread(hours, "venue_id", "day").hint("merge")
    low, high = F.greatest("start", "open"), F.least("end", "close")  # nulls are passed over: without hours all stays
    return schedules.join(hours, ["venue_id", "day"], "left").select("venue_id", "deal_id", "day", low.alias("start"), high.alias("end")).filter(F.col("end") > F.col("start"))


def weekday_ranges(days: DataFrame, key: str) -> DataFrame:
    """(key, badge): 'Mon-Wed, Fri' from rows of (key, day); '7 Days' for all. Runs of two days or more are ranges."""
    d = days.select(key, weekly.display_order(F.col("day")).alias("k"), "day").distinct()
    island = F.col("k") - F.row_number().over(Window.partitionBy(key).orderBy("k"))
    runs = d.withColumn("island", island).groupBy(key, "island").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count(F.lit(1)).alias("n"), F.min_by("day", "k").alias("first"), F.max_by("day", "k").alias("last"))
    a, b = weekly.day_name(F.col("first")), weekly.day_name(F.col("last"))
    label = F.when(F.col("n") == 1, a).otherwise(F.concat_ws("-", a, b))
    joined = runs.groupBy(key).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("lo", label.alias("label")))).alias("r"))
    return joined.select(key, F.when(F.col("n") == 7, "7 Days").otherwise(F.array_join(F.transform("r", lambda x: x["label"]), ", ")).alias("badge"))


def fuzzy_names(names: DataFrame, key: str, name: str, query: str, least: float = 0.2, limit: int = 20) -> DataFrame:
    """Names that hold the query or whose trigram similarity is over ``least``, most similar first."""
    wanted = text.trigrams(F.lit(query))
    score = F.round(text.trigram_similarity(text.trigrams(F.col(name)), wanted), 6)
    # behind a generator the score is made once, and not by the task that reads the names, where the filter would go
    found = names.select(key, name, F.explode(F.array(score)).alias("score")).filter((F.col("score") > least) | F.col(name).ilike(f"%{query}%"))
    return found.orderBy(F.col("score").desc(), name, key).limit(limit)


def name_pairs(asked: DataFrame, others: DataFrame, group: str) -> DataFrame:
    """(id, other_id, similarity): names (id, name, group) of ``asked`` with those of ``others`` of their group and a greater id.

    Parts of at most about PART rows of a group meet parts of the other side, so a large group is dealt to many tasks. What all
    names begin with is left out of the edit distance, which it doesn't change.
    """
    asked, others = (x.filter(F.col(group).isNotNull() & F.col("id").isNotNull()) for x in (asked, others))
    ends = asked.select("name").unionByName(others.select("name")).agg(F.min("name"), F.max("name")).first()
    shared = len(os.path.commonprefix([x or "" for x in ends]))
    sizes = [x.groupBy(group).count().agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.sum("count"), F.lit(0))).first() for x in (asked, others)]
    parts, wide = (max(1, math.ceil(most / PART)) for most, _ in sizes)
    n = max(tasks(asked.sparkSession), math.ceil(sizes[1][1] / PART))
    place = lambda k: F.pmod(F.xxhash64("id", "name"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rest = F.substring("name", shared + 1, 2**31 - 1 - shared).alias("name")
    columns = [F.col("id").cast("long").alias("id"), rest, F.char_length("name").alias("size"), F.col(group).alias("kind"), F.pmod(F.xxhash64(group), F.lit(n)).cast("int").alias("_group")]
    mine = asked.select(*columns, F.lit(True).alias("asks"), place(parts).alias("_a"), every(wide).alias("_b"))
    rows = others.select(*columns, F.lit(False).alias("asks"), every(parts).alias("_a"), place(wide).alias("_b"))
    keys = ["_group", "_a", "_b"]
    dealt = mine.unionByName(rows).repartition(n, *keys)
    return dealt.groupBy(*keys).applyInArrow(edits.later_names, "id long, other_id long, similarity double")


def radius_join(points: DataFrame, others: DataFrame, km: float, cell_km: float | None = None) -> DataFrame:
    """Pairs of (id, lat, lng) and (other_id, other_lat, other_lng) within ``km``, with their distance.

    Points go to cells of a grid that are as wide as the radius or wider; each point looks into the nine cells around
    it, so the join is on equal cells, and the exact distance decides.
    """
    size = F.lit((cell_km or km) / geo.DEGREE_KM)
    # the strip of a cell decides how wide its cells are, from its edge that is nearer to the pole
    row = lambda lat: F.floor(lat / size)
    width = lambda r: size / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(r * size), F.abs((r + 1) * size))))))
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = points.filter("lat is not null and lng is not null").withColumn("_row", F.explode(F.transform(steps, lambda k: row(F.col("lat")) + k)))
    around = around.withColumn("_col", F.explode(F.transform(steps, lambda k: F.floor(F.col("lng") / width(F.col("_row"))) + k)))
    placed = others.filter("other_lat is not null and other_lng is not null").withColumn("_row", row(F.col("other_lat"))).withColumn("_col", F.floor(F.col("other_lng") / width(F.col("_row"))))
    distance = geo.great_circle_km(F.col("lat"), F.col("lng"), F.col("other_lat"), F.col("other_lng"))
    return around.join(placed, ["_row", "_col"]).withColumn("km", distance).filter(F.col("km") <= km).drop("_row", "_col")
