"""Composable deal search: optional filters with their precedence, projection, order and limit; suburbs by name and near."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import english, geo
from . import search

#: Most ids in an id list, and the radius of a search without one. Fixed values.
MAX_IDS, NEAR_KM = 200, 10.0


def parse_ids(text: str | None) -> list[int]:
    """Positive whole numbers from a list with commas; an empty list for no text.

    Raises ValueError for an empty part, for anything else, or for more than MAX_IDS.
    """
    parts = [p.strip() for p in (text or "").split(",")] if (text or "").strip() else []
    if any(not (p.isascii() and p.isdigit() and int(p) > 0) for p in parts):
        raise ValueError("Invalid ids")
    if len(parts) > MAX_IDS:
        raise ValueError(f"Too many ids (max {MAX_IDS})")
    return [int(p) for p in parts]


@dataclass(frozen=True)
class DealFilter:
    """What a search asks for; what is None or empty is no filter.

    ``days`` comes before ``day``; both apply to the schedule row that the minutes apply to, and alone if the minutes are
    no window. ``bounds`` (north, south, east, west) comes before ``suburb_id``, which comes before ``region_id``, and turns
    ``near`` off. ``query`` holds terms with commas between them, found by their stems in title, details and conditions.
    """

    day: int | None = None
    days: list[int] = field(default_factory=list)
    start_minute: int | None = None
    end_minute: int | None = None
    active_at: tuple[int, int] | None = None
    query: str | None = None
    ids: list[int] = field(default_factory=list)
    venue_id: int | None = None
    suburb_id: int | None = None
    region_id: int | None = None
    exclude_suburb_id: int | None = None
    bounds: tuple[float, float, float, float] | None = None
    near: tuple[float, float] | None = None
    radius_km: float = NEAR_KM
    limit: int = 100


#: Columns of a deal that searches read. Fixed values.
SEARCHED = ("title", "details", "conditions")


def with_terms(deals: DataFrame) -> DataFrame:
    """Deals with ``terms``, the search vector of those of their columns that are searched; stored, it serves every search."""
    return deals.withColumn("terms", english.search_vector(F.concat_ws(" ", *[c for c in SEARCHED if c in deals.columns])))


def matching_deals(deals: DataFrame, schedules: DataFrame, f: DealFilter, today: Column | None = None) -> DataFrame:
    """Approved deals that pass the filters on deals and schedules."""
    found = search.approved(deals)
    days = f.days or ([f.day] if f.day is not None else [])
    timed = search.in_time(found, schedules, f.start_minute, f.end_minute, days or None)
    window = f.start_minute is not None or f.end_minute is not None
    backwards = f.start_minute is not None and f.end_minute is not None and f.end_minute < f.start_minute
    if days and (backwards or not window):
        timed = search.on_days(found, schedules, days)
    elif not window or backwards:
        timed = found
    if f.active_at:
        timed = search.active_now(timed, schedules, *f.active_at)
    if f.query and f.query.strip():
        read = timed if "terms" in timed.columns else with_terms(timed)
        timed = read.filter(english.matches(F.col("terms"), f.query)).select(*timed.columns)
    if f.ids:
        timed = timed.filter(F.col("deal_id").isin(f.ids))
    return timed if f.venue_id is None else timed.filter(F.col("venue_id") == f.venue_id)


def search_deals(deals: DataFrame, venues: DataFrame, suburbs: DataFrame, schedules: DataFrame, f: DealFilter) -> DataFrame:
    """The first ``limit`` deals: deal_id, title, venue_id, venue, suburb, schedules, and with a place nearby, distance_km.

    Nearest first with a place, then by venue, title and id. Venues without a suburb stay.
    """
    placed = venues
    if f.bounds:
        placed = placed.filter(geo.in_bounds(F.col("lat"), F.col("lng"), *f.bounds))
    elif f.suburb_id is not None:
        placed = placed.filter(F.col("suburb_id") == f.suburb_id)
    elif f.region_id is not None:
        placed = placed.join(suburbs.filter(F.col("region_id") == f.region_id).select("suburb_id"), "suburb_id", "left_semi")
    if f.exclude_suburb_id is not None:
        placed = placed.filter(F.col("suburb_id").isNull() | (F.col("suburb_id") != f.exclude_suburb_id))
    order, columns = [F.col("venue"), F.col("title"), F.col("deal_id")], ["deal_id", "title", "venue_id", "venue", "suburb", "schedules"]
    if f.near and not f.bounds:
        placed = placed.filter(geo.near(F.col("lat"), F.col("lng"), *f.near, f.radius_km))
        placed = placed.withColumn("distance_km", geo.great_circle_km(F.col("lat"), F.col("lng"), *(F.lit(x) for x in f.near)))
        order, columns = [F.col("distance_km"), *order], [*columns, "distance_km"]
    named = placed.join(suburbs.select("suburb_id", "suburb"), "suburb_id", "left")
    return search.search(matching_deals(deals, schedules, f), named, schedules, order, f.limit).select(*columns)


def complement_venues(venues: DataFrame, deals: DataFrame, schedules: DataFrame, f: DealFilter, limit: int = 200) -> DataFrame:
    """Venues with none of the deals that the same filters find, by name."""
    return search.venues_without(venues, matching_deals(deals, schedules, f)).orderBy("venue", "venue_id").limit(limit)


def find_suburbs(suburbs: DataFrame, venues: DataFrame, deals: DataFrame, text: str | None = None, region_id: int | None = None, limit: int = 20) -> DataFrame:
    """Suburbs whose name or postcode holds the text (else those of a region), with the most deals first, then by name."""
    wanted = (text or "").strip()
    if wanted:
        like = "%" + wanted.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
        suburbs = suburbs.filter(F.col("suburb").ilike(like) | F.col("postcode").ilike(like))
    elif region_id is not None:
        suburbs = suburbs.filter(F.col("region_id") == region_id)
    by_venue = deals.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    by_suburb = venues.select("venue_id", "suburb_id").join(by_venue, "venue_id").groupBy("suburb_id").agg(F.sum("n").alias("deal_count"))
    counted = suburbs.join(by_suburb, "suburb_id", "left").select("suburb_id", "suburb", "postcode", F.coalesce("deal_count", F.lit(0)).alias("deal_count"))
    return counted.orderBy(F.col("deal_count").desc(), "suburb", "suburb_id").limit(limit)


def nearby_suburbs(counts: DataFrame, lat: float, lng: float, exclude_id: int, limit: int = 5) -> DataFrame:
    """The nearest other suburbs with a place, with their counts (as of stats.suburb_counts with lat and lng)."""
    km = geo.great_circle_km(F.col("lat"), F.col("lng"), F.lit(lat), F.lit(lng))
    others = counts.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.col("suburb_id") != exclude_id))
    return others.withColumn("distance_km", km).orderBy("distance_km", "suburb", "suburb_id").limit(limit)


def by_ratio(rows: DataFrame, ratio: str, name: str = "suburb") -> DataFrame:
    """Rows with a ratio first, the highest first, then by name; the rest by name."""
    return rows.orderBy(F.col(ratio).isNull(), F.col(ratio).desc_nulls_last(), name)


def schedule_rows(deals: DataFrame, venues: DataFrame, suburbs: DataFrame, schedules: DataFrame, region_id: int, query: str | None = None) -> DataFrame:
    """Every schedule row of a region's approved deals with the deal's text, uncapped, newest deals first."""
    found = matching_deals(deals, schedules, DealFilter(query=query))
    placed = venues.select("venue_id", "suburb_id").join(suburbs.filter(F.col("region_id") == region_id).select("suburb_id"), "suburb_id", "left_semi")
    rows = schedules.join(found.join(placed, "venue_id", "left_semi").select("deal_id", "title"), "deal_id")
    return rows.select("deal_id", "title", "day", "start", "end").orderBy(F.col("deal_id").desc(), "day", "start")
