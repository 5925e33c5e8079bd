"""The engine's queries by name, over the provided tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, parsing, text, weekly
from ..operators import apportion, deal_search, near, search, sets, stats, sync
from ..sources.stored import spread
from ..sources.tables import ROLES, Catalogue
from ..streaming import events as ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A place, a box and a moment that searches are bound to.
LAT, LNG, KM = -33.6, 150.9, 12.0
BOX = (-33.4, -33.7, 151.2, 150.8)
DAY, MINUTE = 6, 1200


def _rounded(x: Column, digits: int) -> Column:
    """Values that are not negative, rounded; with very many rows round() costs more than what is rounded."""
    return F.floor(x * 10.0**digits + 0.5) / 10.0**digits


def query(sql: str | None = None, ctes: str = ""):
    """Registers a function of a Catalogue under its name; ``ctes`` come after the roles."""

    def add(f: Callable[[Catalogue], DataFrame]) -> Callable[[Catalogue], DataFrame]:
        QUERIES[f.__name__] = lambda spark, folder: f(Catalogue(spark, folder))
        if sql:
            SQL[f.__name__] = f"WITH {ROLES}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


KM_SQL = "6371.0 * acos(least(1.0, greatest(-1.0, cos(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})) + sin(radians({a})) * sin(radians({c})))))"
_km = lambda a, b, c, d: KM_SQL.format(a=a, b=b, c=c, d=d)


@query("SELECT suburb_id, suburb, count(*) AS deal_count, count(DISTINCT venue_id) AS venue_count FROM suburb_ JOIN venue_ USING (suburb_id) JOIN deal_ USING (venue_id) WHERE status = 'approved' GROUP BY ALL")
def popular_suburbs(c):
    return stats.popular_suburbs(c.suburb, c.venue, c.deal)


@query("SELECT suburb_id, suburb, count(deal_id) AS deal_count, count(DISTINCT v.venue_id) AS venue_count FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id GROUP BY ALL")
def all_suburbs(c):
    return stats.suburb_counts(c.suburb.select("suburb_id", "suburb"), c.venue, c.deal).drop("venues_with_deals")


_COUNTS = "counts AS (SELECT suburb_id, suburb, region_id, sqkm, population, count(deal_id) AS deal_count, count(DISTINCT v.venue_id) AS venue_count, count(DISTINCT d.venue_id) AS venues_with_deals FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id AND status = 'approved' GROUP BY ALL)"


@query("SELECT suburb_id, suburb, deal_count, venue_count, round(CASE WHEN sqkm > 0 THEN deal_count / sqkm END, 6) AS deals_per_sqkm, round(CASE WHEN sqkm > 0 THEN venue_count / sqkm END, 6) AS venues_per_sqkm, round(CASE WHEN population > 0 THEN deal_count * 1000.0::DOUBLE / population END, 6) AS deals_per_1000, round(CASE WHEN population > 0 THEN venue_count * 1000.0::DOUBLE / population END, 6) AS venues_per_1000 FROM counts", _COUNTS)
def suburb_statistics(c):
    return stats.suburb_statistics(stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal)))


@query("SELECT r.region_id, region, lower(replace(region, ' ', '-')) AS slug, count(DISTINCT suburb_id) AS suburbs, coalesce(sum(venue_count), 0)::BIGINT AS venues, coalesce(sum(deal_count), 0)::BIGINT AS deals FROM region_ r LEFT JOIN counts USING (region_id) GROUP BY ALL", _COUNTS)
def region_listing(c):
    counts = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal)).groupBy("region_id").agg(F.count(F.lit(1)).alias("suburbs"), F.sum("venue_count").alias("venues"), F.sum("deal_count").alias("deals"))
    zeros = [F.coalesce(x, F.lit(0)).alias(x) for x in ("suburbs", "venues", "deals")]
    return c.region.join(counts, "region_id", "left").select("region_id", "region", text.slugify(F.col("region")).alias("slug"), *zeros)


@query("SELECT region_id, count(DISTINCT venue_id) AS venues FROM suburb_ JOIN venue_ USING (suburb_id) JOIN deal_ USING (venue_id) WHERE status = 'approved' GROUP BY ALL")
def venues_with_deals(c):
    return c.venue.join(search.approved(c.deal), "venue_id", "left_semi").join(c.suburb, "suburb_id").groupBy("region_id").agg(F.count(F.lit(1)).alias("venues"))


@query("SELECT day, count(*) AS n FROM schedule_ JOIN deal_ USING (deal_id) WHERE status = 'approved' GROUP BY ALL")
def deal_day_counts(c):
    return c.schedule.join(search.approved(c.deal).select("deal_id"), "deal_id").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT day, count(*) AS n FROM event_ WHERE day IS NULL OR day BETWEEN 1 AND 7 GROUP BY ALL")
def searches_by_day(c):
    return c.event.filter(F.col("day").isNull() | F.col("day").between(1, 7)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN day IS NULL THEN 0 ELSE (day + 5) % 7 + 1 END AS place, day, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 4) AS share FROM event_ WHERE day IS NULL OR day BETWEEN 1 AND 7 GROUP BY ALL")
def search_day_buckets(c):
    place = F.when(F.col("day").isNull(), 0).otherwise(weekly.display_order(F.col("day")) + 1)
    return searches_by_day(c).select(place.cast("int").alias("place"), "day", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4).alias("share")).orderBy("place")


_HEAT = "hours AS (SELECT unnest(range(12, 24))::INT AS hour), heat AS (SELECT day, hour, count(*) AS n FROM schedule_, hours WHERE NOT (s = 0 AND e >= 1440) AND hour * 60 >= s AND hour * 60 < e GROUP BY ALL), grid AS (SELECT d::INT AS day, hour, coalesce(n, 0) AS count FROM (SELECT unnest(range(1, 8)) AS d), hours LEFT JOIN heat USING (hour) WHERE heat.day = d OR heat.day IS NULL)"


@query("SELECT day, hour, n AS count FROM heat", _HEAT)
def day_hour_heat(c):
    return stats.hour_heat(c.schedule)


@query("SELECT d::INT AS day, h.hour, coalesce(n, 0) AS count, round(sqrt(coalesce(n, 0) / max(coalesce(n, 0)) OVER ()), 6) AS intensity, coalesce(n, 0) = max(coalesce(n, 0)) OVER () AS peak FROM (SELECT unnest(range(1, 8)) AS d) CROSS JOIN hours h LEFT JOIN heat ON heat.day = d AND heat.hour = h.hour", _HEAT)
def heat_grid_dense(c):
    return stats.dense_heat(stats.hour_heat(c.schedule))


@query("SELECT day, hour, n AS count FROM heat ORDER BY n DESC, (day + 5) % 7, hour LIMIT 1", _HEAT)
def peak_cell(c):
    return stats.hour_heat(c.schedule).orderBy(F.col("count").desc(), weekly.display_order(F.col("day")), "hour").limit(1)


@query("SELECT day, count(*) AS n FROM schedule_ JOIN deal_ USING (deal_id) WHERE status = 'approved' GROUP BY ALL ORDER BY n DESC, day LIMIT 1")
def busiest_day(c):
    return deal_day_counts(c).orderBy(F.col("n").desc(), "day").limit(1)


@query("SELECT deal_id, venue_id FROM deal_ d WHERE status = 'approved' AND EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND day IN (1, 7))")
def deals_on_days(c):
    return search.on_days(search.approved(c.deal), c.schedule, [1, 7]).select("deal_id", "venue_id")


@query("SELECT deal_id, venue_id FROM deal_ d WHERE status = 'approved' AND EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND s < 1140 AND e > 1020 AND day IN (5, 6))")
def deals_in_window(c):
    return search.in_time(search.approved(c.deal), c.schedule, 1020, 1140, [5, 6]).select("deal_id", "venue_id")


@query("SELECT deal_id, venue_id FROM deal_ d WHERE status = 'approved' AND EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND s <= 720 AND e > 720)")
def deals_point_in_time(c):
    return search.in_time(search.approved(c.deal), c.schedule, 720, 720).select("deal_id", "venue_id")


@query("SELECT deal_id, venue_id FROM deal_ d WHERE status = 'approved' AND EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND ((day = 1 AND s <= 30 AND e > 30) OR (day = 7 AND e > 1440 AND 30 < e - 1440)))")
def deals_active_at(c):
    return search.active_now(search.approved(c.deal), c.schedule, 1, 30).select("deal_id", "venue_id")


@query("SELECT deal_id, bool_or((day = 6 AND s <= 1200 AND e > 1200) OR (day = 5 AND e > 1440 AND 1200 < e - 1440)) AS active, count(*) AS slots FROM schedule_ GROUP BY deal_id")
def active_first(c):
    now = weekly.active_at(F.col("day"), F.col("start"), F.col("end"), DAY, MINUTE)
    return c.schedule.groupBy("deal_id").agg(F.bool_or(now).alias("active"), F.count(F.lit(1)).alias("slots")).orderBy(F.col("active").desc(), "deal_id")


@query("SELECT venue_id, venue FROM venue_ v WHERE NOT EXISTS (SELECT 1 FROM deal_ d JOIN schedule_ x USING (deal_id) WHERE d.venue_id = v.venue_id AND status = 'approved' AND day = 6)")
def venues_without_matching_deals(c):
    return search.venues_without(c.venue.select("venue_id", "venue"), search.on_days(search.approved(c.deal), c.schedule, [6]))


@query("SELECT deal_id, venue_id FROM deal_ WHERE status = 'approved' AND deal_id NOT IN (SELECT deal_id FROM schedule_)")
def deals_without_schedules(c):
    return search.approved(c.deal).join(c.schedule, "deal_id", "left_anti").select("deal_id", "venue_id")


@query(
    "SELECT a.deal_id, a.day, a.schedule_id, a.s AS start, a.e AS \"end\", b.schedule_id AS other_id, b.s AS other_start, b.e AS other_end FROM slots a JOIN slots b ON a.deal_id = b.deal_id AND a.day = b.day AND a.schedule_id < b.schedule_id AND a.s < b.e AND a.e > b.s",
    "slots AS (SELECT x.* FROM schedule_ x JOIN deal_ USING (deal_id) WHERE status = 'approved')",
)
def overlapping_schedules(c):
    return search.overlapping_schedules(c.schedule.join(search.approved(c.deal).select("deal_id"), "deal_id", "left_semi"))


@query("SELECT deal_id FROM deal_ d WHERE title ILIKE '%urgent%' AND EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND e - s > 150)")
def long_windows(c):
    return search.with_schedule(c.deal.filter(F.col("title").ilike("%urgent%")), c.schedule, F.col("end") - F.col("start") > 150).select("deal_id")


@query(f"SELECT deal_id, venue_id, round({_km('lat', 'lng', LAT, LNG)}, 6) AS km FROM deal_ JOIN venue_ USING (venue_id) WHERE status = 'approved' AND {_km('lat', 'lng', LAT, LNG)} <= {KM}")
def deals_near_point(c):
    close = c.venue.filter(geo.near(F.col("lat"), F.col("lng"), LAT, LNG, KM)).select("venue_id", F.round(geo.great_circle_km(F.col("lat"), F.col("lng"), F.lit(LAT), F.lit(LNG)), 6).alias("km"))
    return search.approved(c.deal).join(close, "venue_id").select("deal_id", "venue_id", "km")


@query(f"SELECT deal_id, venue_id FROM deal_ JOIN venue_ USING (venue_id) WHERE status = 'approved' AND lat BETWEEN {BOX[1]} AND {BOX[0]} AND lng BETWEEN {BOX[3]} AND {BOX[2]}")
def deals_in_bounds(c):
    return search.approved(c.deal).join(c.venue.filter(geo.in_bounds(F.col("lat"), F.col("lng"), *BOX)).select("venue_id"), "venue_id").select("deal_id", "venue_id")


@query(f"SELECT suburb_id, suburb, round({_km('lat', 'lng', LAT, LNG)}, 6) AS km FROM suburb_ WHERE {_km('lat', 'lng', LAT, LNG)} <= 50 ORDER BY round({_km('lat', 'lng', LAT, LNG)}, 6), suburb LIMIT 1")
def nearest_suburb(c):
    return c.suburb.filter(geo.near(F.col("lat"), F.col("lng"), LAT, LNG, 50.0)).select("suburb_id", "suburb", F.round(geo.great_circle_km(F.col("lat"), F.col("lng"), F.lit(LAT), F.lit(LNG)), 6).alias("km")).orderBy("km", "suburb").limit(1)


@query(f"SELECT a.suburb_id, b.suburb_id AS other_id, round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 6) AS km FROM suburb_ a JOIN suburb_ b ON a.suburb_id <> b.suburb_id WHERE {_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 30")
def nearby_suburbs(c):
    other = c.suburb.select(F.col("suburb_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    return search.radius_join(c.suburb.select("suburb_id", "lat", "lng"), other, 30.0).filter("suburb_id <> other_id").select("suburb_id", "other_id", F.round("km", 6).alias("km"))


_MINIMUM = f"least_ AS (SELECT suburb_id, min({_km('a.lat', 'a.lng', 'v.lat', 'v.lng')}) AS km FROM suburb_ a JOIN venue_ v USING (suburb_id) WHERE {_km('a.lat', 'a.lng', 'v.lat', 'v.lng')} <= 100 GROUP BY suburb_id)"


@query(f"SELECT a.suburb_id, round(min({_km('a.lat', 'a.lng', 'v.lat', 'v.lng')}), 6) AS km, count(*) AS venues FROM suburb_ a JOIN venue_ v ON {_km('a.lat', 'a.lng', 'v.lat', 'v.lng')} <= 20 GROUP BY a.suburb_id")
def min_venue_distance(c):
    venues = c.venue.select("venue_id", F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    return search.radius_join(c.suburb.select("suburb_id", "lat", "lng"), venues, 20.0).groupBy("suburb_id").agg(F.round(F.min("km"), 6).alias("km"), F.count(F.lit(1)).alias("venues"))


@query("SELECT suburb_id, list_min(list_filter([2, 5, 10, 15, 20, 25, 35, 50, 75, 100], lambda x: x >= km)) AS radius FROM least_", _MINIMUM)
def radius_tuning(c):
    own = c.venue.select("suburb_id", F.col("lat").alias("vlat"), F.col("lng").alias("vlng")).join(c.suburb, "suburb_id").withColumn("km", geo.great_circle_km(F.col("lat"), F.col("lng"), F.col("vlat"), F.col("vlng")))
    return own.filter("km <= 100").groupBy("suburb_id").agg(F.min("km").alias("km")).select("suburb_id", geo.snap_radius(F.col("km")).alias("radius"))


@query("SELECT region_id, region, round((s + n) / 2, 6) AS lat, round((w + e) / 2, 6) AS lng, round(pi() * h * h, 4) AS sqkm FROM (SELECT *, greatest((n - s) / 2 * 111.0::DOUBLE, (e - w) / 2 * 111.0::DOUBLE * cos(radians((s + n) / 2))) + 2.0::DOUBLE AS h FROM (SELECT region_id, min(lat) AS s, max(lat) AS n, min(lng) AS w, max(lng) AS e FROM suburb_ GROUP BY region_id) JOIN region_ USING (region_id))")
def region_frames(c):
    return stats.region_frames(c.region, c.suburb)


@query("SELECT suburb_id, round(sqrt(greatest(coalesce(sqkm, 0), 0) / pi()) + 0.5::DOUBLE, 6) AS radius, round(CASE WHEN sqkm > 0 THEN sqrt(sqkm / pi()) ELSE 0 END, 6) AS map_radius FROM suburb_")
def place_radii(c):
    return c.suburb.select("suburb_id", F.round(geo.suburb_radius_km(F.col("sqkm")), 6).alias("radius"), F.round(geo.region_radius_km(F.col("sqkm")), 6).alias("map_radius"))


_SHARE = "SELECT {key}, n, (base + CASE WHEN row_number() OVER (ORDER BY rest DESC, {key}) <= 100 - sum(base) OVER () THEN 1 ELSE 0 END)::BIGINT AS percent FROM (SELECT *, n * 100 // sum(n) OVER () AS base, (n * 100) % sum(n) OVER () AS rest FROM shares)"


@query(_SHARE.format(key="day"), "shares AS (SELECT day, count(*) AS n FROM schedule_ GROUP BY day)")
def weekday_shares(c):
    return apportion.largest_remainder(c.schedule.groupBy("day").agg(F.count(F.lit(1)).alias("n")), "n", F.col("day"))


@query(_SHARE.format(key="brand") + " ORDER BY n DESC, brand LIMIT 5", "shares AS (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand)")
def top_product_shares(c):
    counts = c.table("part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return apportion.largest_remainder(counts, "n", F.col("brand")).orderBy(F.col("n").desc(), "brand").limit(5)


@query("SELECT sum(deal_count)::BIGINT AS deals, sum(venue_count)::BIGINT AS venues, count(*) FILTER (venue_count > 0) AS suburbs_with_venues, count(*) FILTER (deal_count > 0) AS suburbs_with_deals, round(CASE WHEN sum(venue_count) > 0 THEN 100.0::DOUBLE * least(sum(venues_with_deals), sum(venue_count)) / sum(venue_count) ELSE 0 END, 6) AS coverage FROM counts", _COUNTS)
def coverage_rings(c):
    counts = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal))
    v = F.sum("venue_count")
    return counts.agg(F.sum("deal_count").alias("deals"), v.alias("venues"), F.count_if(F.col("venue_count") > 0).alias("suburbs_with_venues"), F.count_if(F.col("deal_count") > 0).alias("suburbs_with_deals"), F.round(F.when(v > 0, 100.0 * F.least(F.sum("venues_with_deals"), v) / v).otherwise(0.0), 6).alias("coverage"))


@query("SELECT suburb, round(deal_count / sqkm, 6) AS density, round(deal_count / sqkm / max(deal_count / sqkm) OVER () * 100, 4) AS width FROM counts WHERE sqkm > 0 ORDER BY deal_count / sqkm DESC, suburb LIMIT 5", _COUNTS)
def density_top5(c):
    counts = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal)).filter("sqkm > 0").withColumn("d", F.col("deal_count") / F.col("sqkm"))
    top = counts.orderBy(F.col("d").desc(), "suburb").limit(5)
    return top.select("suburb", F.round("d", 6).alias("density"), F.round(F.col("d") / F.max("d").over(Window.partitionBy()) * 100, 4).alias("width"))


@query("SELECT region_id, count(DISTINCT suburb_id) AS suburbs, count(DISTINCT v.venue_id) AS venues, count(DISTINCT v.venue_id) FILTER (rating < 0) AS broken, count(deal_id) FILTER (status = 'approved') AS approved, count(deal_id) FILTER (status = 'new') AS fresh, count(deal_id) FILTER (status = 'rejected') AS rejected FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id GROUP BY region_id")
def region_dashboard(c):
    by_venue = c.deal.groupBy("venue_id").agg(*[F.count_if(F.col("status") == s).alias(a) for s, a in (("approved", "approved"), ("new", "fresh"), ("rejected", "rejected"))])
    by_suburb = c.venue.join(by_venue, "venue_id", "left").groupBy("suburb_id").agg(F.count(F.lit(1)).alias("venues"), F.count_if(F.col("rating") < 0).alias("broken"), *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("approved", "fresh", "rejected")])
    zeros = [F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("venues", "broken", "approved", "fresh", "rejected")]
    return c.suburb.join(by_suburb, "suburb_id", "left").groupBy("region_id").agg(F.count(F.lit(1)).alias("suburbs"), *zeros)


@query("SELECT (SELECT count(*) FROM venue_) AS venues, (SELECT count(*) FROM deal_) AS deals, (SELECT count(*) FROM venue_ WHERE rating >= 0) AS ready_venues, (SELECT count(DISTINCT suburb_id) FROM venue_ JOIN deal_ USING (venue_id)) AS suburbs_with_deals")
def global_stats(c):
    deals = c.deal.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    return c.venue.join(deals, "venue_id", "left").agg(F.count(F.lit(1)).alias("venues"), F.coalesce(F.sum("n"), F.lit(0)).alias("deals"), F.count_if(F.col("rating") >= 0).alias("ready_venues"), F.countDistinct(F.when(F.col("n") > 0, F.col("suburb_id"))).alias("suburbs_with_deals"))


@query("SELECT venue_id, count(*) AS deals, count(*) FILTER (status <> 'rejected') AS open_deals FROM deal_ GROUP BY venue_id")
def counts_by_venue(c):
    return c.deal.groupBy("venue_id").agg(F.count(F.lit(1)).alias("deals"), F.count_if(F.col("status") != "rejected").alias("open_deals"))


@query(
    "SELECT deal_id, venue, (SELECT string_agg(day || ':' || s || '-' || e, ',' ORDER BY day, s, e) FROM schedule_ x WHERE x.deal_id = t.deal_id) AS schedules FROM top_ t",
    "top_ AS (SELECT deal_id, venue FROM deal_ JOIN venue_ USING (venue_id) WHERE status = 'approved' ORDER BY venue, title, deal_id LIMIT 100)",
)
def deal_search_nested(c):
    found = search.search(search.approved(c.deal), c.venue, c.schedule, [F.col("venue"), F.col("title"), F.col("deal_id")])
    flat = F.transform("schedules", lambda s: F.concat_ws("", s["day"].cast("string"), F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("deal_id", "venue", F.array_join(flat, ",").alias("schedules"))


@query("SELECT conv_id, count(*) AS turns, md5(string_agg(role || ': ' || text, chr(10) ORDER BY turn)) AS thread FROM conversations GROUP BY conv_id")
def conversation_threads(c):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"]))
    return c.table("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.md5(F.array_join(lines, "\n")).alias("thread"))


@query(
    "SELECT venue_id, deal_id, day, greatest(s, open) AS start, least(e, close) AS \"end\" FROM schedule_ JOIN deal_ USING (deal_id) LEFT JOIN hours_ USING (venue_id, day) WHERE least(e, close) > greatest(s, open)",
    "hours_ AS (SELECT venue_id, d::INT AS day, (600 + 30 * (venue_id % 5))::INT AS open, (1200 + 60 * d)::INT AS close FROM venue_, (SELECT unnest(range(1, 7)) AS d))",
)
def clamp_to_hours(c):
    days = F.explode(F.sequence(F.lit(1), F.lit(6)))
    hours = c.venue.select("venue_id", days.alias("day")).select("venue_id", "day", (600 + 30 * (F.col("venue_id") % 5)).cast("int").alias("open"), (1200 + 60 * F.col("day")).cast("int").alias("close"))
    placed = spread(c.schedule, "deal_id").join(spread(c.deal.select("deal_id", "venue_id"), "deal_id"), "deal_id")
    return search.clamp_to_hours(placed, hours)


_ISLANDS = "ds AS (SELECT DISTINCT deal_id, (day + 5) % 7 AS k FROM schedule_), isl AS (SELECT *, k - row_number() OVER (PARTITION BY deal_id ORDER BY k) AS g FROM ds), runs AS (SELECT deal_id, g, min(k) AS lo, max(k) AS hi, count(*) AS n FROM isl GROUP BY ALL), nm AS (SELECT *, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][lo + 1] AS a, ['Mon','Tue','Wed','Thu','Fri','Sat','Sun'][hi + 1] AS b FROM runs)"


@query("SELECT deal_id, CASE WHEN sum(n) = 7 THEN '7 Days' ELSE string_agg(CASE n WHEN 1 THEN a ELSE a || '-' || b END, ', ' ORDER BY lo) END AS badge FROM nm GROUP BY deal_id", _ISLANDS)
def weekday_ranges(c):
    return search.weekday_ranges(c.schedule, "deal_id")


@query("SELECT deal_id, s AS start, e AS \"end\", string_agg(DISTINCT day::VARCHAR, ',' ORDER BY day::VARCHAR) AS days FROM schedule_ GROUP BY ALL")
def schedule_summary(c):
    return c.schedule.groupBy("deal_id", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_set("day")), lambda d: d.cast("string")), ",").alias("days"))


_GRAMS = "pg AS (SELECT c_custkey, c_name, list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(c_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3))))) AS g FROM customer), qg AS (SELECT list_distinct(flatten(list_transform(['customer', '000000012'], lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3))))) AS q), sc AS (SELECT c_custkey, c_name, round(len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS score FROM pg, qg)"


@query("SELECT c_custkey, c_name, score FROM sc WHERE score > 0.2 OR c_name ILIKE '%customer 000000012%' ORDER BY score DESC, c_name, c_custkey LIMIT 20", _GRAMS)
def venue_fuzzy_search(c):
    return search.fuzzy_names(spread(c.table("customer").select("c_custkey", "c_name")), "c_custkey", "c_name", "customer 000000012")


@query("SELECT lower(regexp_replace(c_name, '[^A-Za-z0-9]+', '-', 'g')) AS slug, min(c_custkey) AS venue_id FROM customer GROUP BY 1 HAVING count(*) = 1")
def unique_slugs(c):
    return spread(c.venue.select("venue_id", "venue")).groupBy(text.slugify(F.col("venue")).alias("slug")).agg(F.min("venue_id").alias("venue_id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")


_MAIL = r"""em AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda e: lower(e)),
  lambda e: NOT regexp_matches(e, '@[0-9]+x\.') AND NOT regexp_matches(e, '[@.](wixpress\.com|sentry\.io)$')) AS e FROM documents)"""


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(e)), ',') AS emails FROM em WHERE len(e) > 0", _MAIL)
def email_extract(c):
    return c.table("documents").filter(F.col("text").contains("@")).select("doc_id", text.emails(F.col("text")).alias("e")).filter(F.size("e") > 0).select("doc_id", F.array_join(F.sort_array("e"), ",").alias("emails"))


_ADDRESS = r"""parts_ AS (SELECT page_id, lower(regexp_extract(u, '^(?i)(https?://[^/?]*)', 1)) AS host, regexp_extract(u, '^(?i)https?://[^/?]*([^?]*)', 1) AS path, regexp_extract(u, '(\?.*)$', 1) AS search
  FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)),
address_ AS (SELECT page_id, CASE WHEN host <> '' THEN host || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END END AS base, search,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(search, '([?&])(?i:utm_(?:source|medium|campaign|term|content))=[^&]*', '\1', 'g'), '&{2,}', '&', 'g'), '\?&+', '?', 'g'), '[?&]+$', '') AS kept FROM parts_)"""


@query("SELECT page_id, base || search AS address, sha256(base || search) AS identity FROM address_", _ADDRESS)
def url_normalize(c):
    address = text.normalise_url(F.col("url"))
    return c.table("pages").select("page_id", address.alias("address"), F.sha2(address, 256).alias("identity"))


@query("SELECT page_id, base || kept AS address, sha256(base || kept) AS identity FROM address_", _ADDRESS)
def url_normalize_all(c):
    """Addresses without their tracking parameters."""
    address = text.strip_tracking(text.normalise_url(F.col("url")))
    return c.table("pages").select("page_id", address.alias("address"), F.sha2(address, 256).alias("identity"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1")
def page_dedupe(c):
    return c.table("documents").groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


def _distances(rows):
    """Rows (id, vector, kind) whose id is divisible by 20 with those of their kind that are at most 6 away."""
    pairs = near.pairs_within(rows.filter("id % 20 = 0"), rows, 6.0)
    return pairs.select(F.col("id").alias("vec_id"), "other_id", _rounded(F.col("distance"), 5).alias("distance"))


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.vec_id % 20 = 0 AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 6.0")
def vector_neighbours(c):
    """Distances of a stated query set (ids divisible by 20) to later vectors of their label."""
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("kind"))
    return _distances(rows).filter("vec_id < other_id")


@query("SELECT a.vec_id, b.vec_id AS other_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 6.0")
def vector_neighbours_all(c):
    """Distances of a stated query set (ids divisible by 20) to all other vectors, of any label and id."""
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(0).alias("kind"))
    return _distances(rows).filter("vec_id <> other_id")


_NEXT = "cur AS (SELECT row_number() OVER (ORDER BY c_custkey) AS id, c_custkey AS key, c_name AS name, c_acctbal AS rating FROM customer WHERE c_custkey % 3 <> 0), inc AS (SELECT c_custkey AS key, upper(c_name) AS name, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal + 1 END AS rating FROM customer WHERE c_custkey % 2 = 0)"


@query("SELECT coalesce(cur.id, (SELECT max(id) FROM cur) + row_number() OVER (PARTITION BY cur.id IS NULL ORDER BY inc.key)) AS id, coalesce(cur.key, inc.key) AS key, CASE WHEN inc.key IS NOT NULL THEN inc.name ELSE cur.name END AS name, coalesce(inc.rating, cur.rating) AS rating FROM cur FULL OUTER JOIN inc ON cur.key = inc.key", _NEXT)
def sync_upsert(c):
    t = c.table("customer")
    current = sync.numbered(t.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("rating")), ["key"], "id")
    incoming = t.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") + 1).alias("rating"))
    return sync.upsert(current, incoming, ["key"], "id", keep_if_null=("rating",))


@query("SELECT deal_id, venue_id, creation_source FROM (SELECT *, CASE WHEN deal_id % 10 = 0 THEN 'user' ELSE 'scraper' END AS creation_source FROM deal_) WHERE creation_source = 'user' OR deal_id IN (SELECT deal_id FROM deal_ WHERE status = 'approved')")
def orphan_prune(c):
    published = c.deal.select("deal_id", "venue_id", F.when(F.col("deal_id") % 10 == 0, "user").otherwise("scraper").alias("creation_source"))
    return sync.prune_orphans(published, search.approved(c.deal), "deal_id")


@query("SELECT deal_id, start_date::VARCHAR AS start_date FROM deal_ WHERE start_date > (SELECT max(start_date) FROM deal_ WHERE status = 'rejected') - INTERVAL 30 DAY")
def watermark_increment(c):
    runs = c.deal.filter("status = 'rejected'").select(F.date_sub("start_date", 30).alias("started_at"), F.col("start_date").alias("finished_at"))
    return sync.changed_since(c.deal.select("deal_id", "start_date"), "start_date", sync.watermark(runs)).select("deal_id", F.col("start_date").cast("string").alias("start_date"))


@query("SELECT event_type, CASE WHEN event_type NOT IN ('view', 'click', 'purchase', 'signup', 'search') THEN 'type' END AS problem, count(*) AS n FROM event_ GROUP BY ALL")
def event_validation(c):
    return ingest.validated(c.table("events")).groupBy("event_type", "problem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, user_id, event_type, day, (hour(ts) * 60 + minute(ts))::INT AS minute FROM event_ WHERE day IS NULL OR day BETWEEN 1 AND 7")
def event_projection(c):
    return ingest.projected(c.table("events"))


@query("SELECT suburb_id, venue_id, rating FROM (SELECT suburb_id, venue_id, rating, row_number() OVER (PARTITION BY suburb_id ORDER BY rating DESC, venue_id) AS k FROM venue_) WHERE k = 1")
def best_venue(c):
    return stats.first_in_group(c.venue.select("suburb_id", "venue_id", "rating"), ["suburb_id"], F.col("rating").desc_nulls_last(), F.col("venue_id"))


@query("SELECT title, day, count(*) AS n FROM deal_ JOIN schedule_ USING (deal_id) WHERE status = 'approved' GROUP BY ALL HAVING count(*) > 1")
def titles_by_day(c):
    return c.schedule.join(search.approved(c.deal).select("deal_id", "title"), "deal_id").groupBy("title", "day").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("SELECT deal_id, s AS start, CASE WHEN e % 1440 < s AND e % 1440 < 600 THEN e % 1440 + 1440 ELSE e % 1440 END AS \"end\", count(*) AS n FROM schedule_ GROUP BY ALL")
def parse_times(c):
    """Hours written as people do, read back."""
    written = F.concat_ws(" - ", weekly.clock(F.col("start")), weekly.clock(F.col("end")))
    times = c.schedule.groupBy("deal_id", written.alias("written")).agg(F.count(F.lit(1)).alias("n"))
    # each way of writing is parsed once
    parsed = times.select("written").distinct().select("written", parsing.hours(F.col("written")).alias("h"))
    return times.join(parsed, "written").groupBy("deal_id", "h").agg(F.sum("n").alias("n")).select("deal_id", "h.start", "h.end", "n")


_DAY_SQL = "array_to_string(list_filter(['monday','tuesday','wednesday','thursday','friday','saturday','sunday'], lambda d: contains(t, d) OR regexp_matches(t, '\\b(?:' || CASE d WHEN 'tuesday' THEN 'tue|tues' WHEN 'thursday' THEN 'thu|thur|thurs' WHEN 'friday' THEN 'fri|friyay|friyays' ELSE d[1:3] END || ')\\b') OR regexp_matches(t, CASE WHEN d IN ('saturday', 'sunday') THEN '\\bweekends?\\b' ELSE '\\bweekdays?\\b' END)), ',')"


@query(f"SELECT conv_id, turn, CASE WHEN contains(t, 'every day') OR replace(t, ' ', '') = 'everyday' THEN 'everyDay' ELSE {_DAY_SQL} END AS days FROM (SELECT conv_id, turn, lower(trim(coalesce(text, ''))) AS t FROM conversations)")
def parse_days(c):
    return c.table("conversations").select("conv_id", "turn", F.array_join(parsing.days(F.col("text")), ",").alias("days"))


@query("SELECT page_id, link, min(k) AS place FROM (SELECT page_id, unnest(l) AS link, unnest(range(1, len(l) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\\s[^>]*?href\\s*=\\s*[\"'']([^\"''#]+)', 1) AS l FROM pages)) GROUP BY ALL")
def page_links(c):
    every = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(parsing.HREF), F.lit(1))
    return c.table("pages").select("page_id", F.posexplode(every).alias("k", "link")).groupBy("page_id", "link").agg((F.min("k") + 1).cast("long").alias("place"))


_WORDS = "(SELECT doc_id, ' ' || array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> ''), ' ') || ' ' AS w FROM documents)"


@query(f"SELECT doc_id FROM {_WORDS} WHERE contains(w, ' license ') OR contains(w, ' email ')")
def text_search_term(c):
    return c.table("documents").filter(parsing.matches_query(parsing.search_words(F.col("text")), "license, email")).select("doc_id")


@query(f"SELECT doc_id FROM {_WORDS} WHERE contains(w, ' under the mit license ')")
def text_search_phrase(c):
    return c.table("documents").filter(parsing.matches_query(parsing.search_words(F.col("text")), "under the MIT License")).select("doc_id")


def _found(c, **wanted):
    """The flat form of a search: nested schedules as text."""
    rows = deal_search.search_deals(c.deal, c.venue, c.suburb, c.schedule, deal_search.DealFilter(**wanted))
    flat = F.transform("schedules", lambda s: F.concat(s["day"].cast("string"), F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    km = [F.round("distance_km", 6).alias("distance_km")] if "distance_km" in rows.columns else []
    return rows.select("deal_id", "title", "venue", "suburb", F.array_join(flat, ",").alias("schedules"), *km)


def _found_sql(where: str, order: str = "venue, title, deal_id", extra: str = "", limit: int = 100) -> tuple[str, str]:
    """SQL of a search over the chain of deals, venues and suburbs."""
    top = f"top_ AS (SELECT d.deal_id, title, venue, suburb, v.lat, v.lng{extra} FROM deal_ d JOIN venue_ v USING (venue_id) LEFT JOIN suburb_ u ON u.suburb_id = v.suburb_id WHERE status = 'approved' AND {where} ORDER BY {order} LIMIT {limit})"
    rounded = ", round(distance_km, 6) AS distance_km" if extra else ""
    return f"SELECT deal_id, title, venue, suburb, (SELECT string_agg(day || ':' || s || '-' || e, ',' ORDER BY day, s, e) FROM schedule_ x WHERE x.deal_id = t.deal_id) AS schedules{rounded} FROM top_ t", top


_ON = "EXISTS (SELECT 1 FROM schedule_ x WHERE x.deal_id = d.deal_id AND {0})"


@query(*_found_sql(_ON.format("day IN (2, 3) AND s < 1140 AND e > 1020") + " AND v.suburb_id = 4"))
def search_days_before_day(c):
    """Days come before the day, and hold in the row that the window holds in."""
    return _found(c, days=[2, 3], day=6, start_minute=1020, end_minute=1140, suburb_id=4)


@query(*_found_sql(_ON.format("day = 6") + " AND (v.suburb_id IS NULL OR v.suburb_id <> 4)"))
def search_backward_window(c):
    """A window that ends before it begins is no filter; the day stays."""
    return _found(c, day=6, start_minute=1140, end_minute=1020, exclude_suburb_id=4)


@query(*_found_sql(_ON.format("e > 1300") + " AND v.lat BETWEEN -33.7 AND -33.4 AND v.lng BETWEEN 150.8 AND 151.2"))
def search_bounds_before_place(c):
    """Bounds come before the suburb and turn the place nearby off."""
    return _found(c, start_minute=1300, bounds=BOX, suburb_id=4, near=(LAT, LNG))


@query(*_found_sql(f"{_km(LAT, LNG, 'v.lat', 'v.lng').replace('v.lng - 150.9', 'v.lng - 150.9')} <= 12.0 AND regexp_matches(lower(title), '(^|[^a-z0-9])urgent([^a-z0-9]|$)')", "distance_km, venue, title, deal_id", f", {_km(LAT, LNG, 'v.lat', 'v.lng')} AS distance_km"))
def search_near_with_text(c):
    return _found(c, near=(LAT, LNG), radius_km=KM, query="urgent")


@query(*_found_sql("d.deal_id IN (1, 2, 3, 4, 5, 6, 7, 32, 33, 34, 35)"))
def search_by_ids(c):
    return _found(c, ids=deal_search.parse_ids("1, 2,3,4,5,6,7,32,33,34,35"))


@query(*_found_sql(_ON.format("(day = 6 AND s <= 1200 AND e > 1200) OR (day = 5 AND e > 1440 AND 1200 < e - 1440)")))
def search_active_now(c):
    return _found(c, active_at=(DAY, MINUTE))


@query("SELECT venue_id, venue FROM venue_ v WHERE NOT EXISTS (SELECT 1 FROM deal_ d WHERE d.venue_id = v.venue_id AND status = 'approved' AND " + _ON.format("day = 2 AND s < 900") + ") ORDER BY venue, venue_id LIMIT 200")
def complement_venues(c):
    return deal_search.complement_venues(c.venue, c.deal, c.schedule, deal_search.DealFilter(day=2, end_minute=900)).select("venue_id", "venue")


@query("SELECT suburb_id, suburb, postcode, count(deal_id) AS deal_count FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id WHERE suburb ILIKE '%ion_1%' ESCAPE '!' OR postcode ILIKE '%ion_1%' ESCAPE '!' GROUP BY ALL ORDER BY deal_count DESC, suburb, suburb_id LIMIT 5")
def suburb_search(c):
    return deal_search.find_suburbs(c.suburb, c.venue, c.deal, " ION_1 ", region_id=1, limit=5)


@query("SELECT suburb_id, suburb, postcode, count(deal_id) AS deal_count FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id WHERE suburb ILIKE '%201%' OR postcode ILIKE '%201%' GROUP BY ALL ORDER BY deal_count DESC, suburb, suburb_id LIMIT 20")
def suburb_postcode_search(c):
    return deal_search.find_suburbs(c.suburb, c.venue, c.deal, "201")


@query("SELECT suburb_id, suburb, postcode, count(deal_id) AS deal_count FROM suburb_ LEFT JOIN venue_ v USING (suburb_id) LEFT JOIN deal_ d ON d.venue_id = v.venue_id WHERE region_id = 1 GROUP BY ALL ORDER BY deal_count DESC, suburb, suburb_id LIMIT 3")
def suburbs_of_region(c):
    return deal_search.find_suburbs(c.suburb, c.venue, c.deal, "  ", region_id=1, limit=3)


@query(f"SELECT suburb_id, suburb, deal_count, venue_count, round({_km(LAT, LNG, 'lat', 'lng')}, 6) AS distance_km FROM counts JOIN suburb_ USING (suburb_id, suburb) WHERE suburb_id <> 3 ORDER BY {_km(LAT, LNG, 'lat', 'lng')}, suburb, suburb_id LIMIT 5", _COUNTS)
def nearby_suburbs_with_counts(c):
    counts = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal))
    return deal_search.nearby_suburbs(counts, LAT, LNG, 3).select("suburb_id", "suburb", "deal_count", "venue_count", F.round("distance_km", 6).alias("distance_km"))


@query("SELECT suburb, deal_count, row_number() OVER (ORDER BY CASE WHEN sqkm > 0 THEN deal_count / sqkm END IS NULL, CASE WHEN sqkm > 0 THEN deal_count / sqkm END DESC NULLS LAST, suburb) AS place FROM counts ORDER BY place LIMIT 10", _COUNTS)
def densest_suburbs(c):
    """A report of ten: valid densities first, then names."""
    rows = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal)).withColumn("ratio", stats.ratio(F.col("deal_count"), F.col("sqkm")))
    top = deal_search.by_ratio(rows, "ratio").limit(10)
    place = F.row_number().over(Window.orderBy(F.col("ratio").isNull(), F.col("ratio").desc_nulls_last(), "suburb"))  # ten rows
    return top.select("suburb", "deal_count", place.cast("long").alias("place"))


@query("SELECT deal_id, title, day, s AS start, e AS \"end\" FROM schedule_ JOIN deal_ USING (deal_id) JOIN venue_ USING (venue_id) JOIN suburb_ USING (suburb_id) WHERE region_id = 2 AND status = 'approved' AND regexp_matches(lower(title), '(^|[^a-z0-9])urgent([^a-z0-9]|$)')")
def schedule_rows_for_matching(c):
    return deal_search.schedule_rows(c.deal, c.venue, c.suburb, c.schedule, 2, "urgent")


@query("SELECT c_custkey AS venue_id, c_nationkey::BIGINT AS suburb_id, 'live' AS source FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT DISTINCT c_custkey, c_nationkey::BIGINT, 'deals' FROM customer JOIN deal_ d ON d.venue_id = c_custkey WHERE c_acctbal < 0 AND status = 'approved'")
def live_and_other_venues(c):
    """All live venues and those of the others that have an approved deal; where both meet, the live one."""
    live = c.venue.filter("rating >= 0").select("venue_id", "suburb_id", F.lit("live").alias("source"))
    other = c.venue.join(search.approved(c.deal), "venue_id", "left_semi").select("venue_id", "suburb_id", F.lit("deals").alias("source"))
    return sets.union_later_wins(other, live, ["venue_id"])


@query("SELECT id, min(place) AS place FROM (SELECT c_custkey AS id, c_custkey AS place FROM customer WHERE c_custkey <= 50 UNION ALL SELECT o_custkey, 51 + min(o_orderkey) FROM orders WHERE o_custkey > 50 GROUP BY o_custkey) GROUP BY id")
def append_results(c):
    """Results of a second page after those of the first; what is there already keeps its place."""
    have = c.venue.filter("venue_id <= 50").select(F.col("venue_id").alias("id"), F.col("venue_id").alias("place"))
    return sets.append_first_seen(have, c.deal.select(F.col("venue_id").alias("id"), F.col("deal_id").alias("place")), ["id"], "place")


@query("SELECT deal_id, min(start) AS start FROM (SELECT *, max(n) OVER (PARTITION BY deal_id) AS most FROM (SELECT deal_id, s AS start, count(*) AS n FROM schedule_ GROUP BY ALL)) WHERE n = most GROUP BY deal_id")
def usual_start(c):
    return sets.smallest_mode(c.schedule, ["deal_id"], "start")


@query("SELECT deal_id, cluster, count(*) AS n, min(s) AS start FROM (SELECT *, sum(far) OVER (PARTITION BY deal_id ORDER BY s RANGE UNBOUNDED PRECEDING)::BIGINT AS cluster FROM (SELECT *, coalesce((s - lag(s) OVER (PARTITION BY deal_id ORDER BY s) > 120)::INT, 0) AS far FROM schedule_)) GROUP BY ALL")
def start_clusters(c):
    """Starts of a deal that are two hours apart at most, one after the other."""
    return sets.gap_clusters(c.schedule, ["deal_id"], "start", 120).groupBy("deal_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))


@query("SELECT p_partkey AS row_id, first_value(p_partkey) OVER (PARTITION BY p_type, p_size ORDER BY p_retailprice DESC, p_partkey) AS keeper FROM part QUALIFY count(*) OVER (PARTITION BY p_type, p_size) > 1")
def duplicate_keepers(c):
    return sets.duplicate_mapping(c.table("part"), ["p_type", "p_size"], "p_partkey", F.col("p_retailprice").desc()).select(F.col("p_partkey").alias("row_id"), "keeper")


@query("SELECT suburb_id, suburb, deal_count, deal_count = max(deal_count) OVER () AS most FROM counts WHERE region_id = 1 OR suburb ILIKE '%ia' ", _COUNTS)
def scoped_suburbs(c):
    """Suburbs of a region or of a name, the busiest marked."""
    rows = stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal)).filter((F.col("region_id") == 1) | F.col("suburb").ilike("%ia"))
    return rows.select("suburb_id", "suburb", "deal_count", (F.col("deal_count") == F.max("deal_count").over(Window.partitionBy())).alias("most"))  # suburbs are few


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(png|jpe?g|gif|webp|avif)$') OR contains(lower(url), 'image') THEN 'image' ELSE 'webpage' END AS kind FROM pages")
def page_kinds(c):
    return c.table("pages").select("page_id", text.source_type(F.col("url")).alias("kind"))


@query("SELECT a.c_custkey AS venue_id, b.c_custkey AS other_id, round(1 - levenshtein(a.c_name, b.c_name)::DOUBLE / greatest(length(a.c_name), length(b.c_name)), 6) AS similarity FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey WHERE a.c_custkey % 20 = 0")
def name_similarity(c):
    """Names of a stated query set (ids divisible by 20) against later ones of their suburb."""
    names = c.venue.select(F.col("venue_id").alias("id"), F.col("venue").alias("name"), "suburb_id")
    pairs = search.name_pairs(names.filter("id % 20 = 0"), names, "suburb_id")
    return pairs.select(F.col("id").alias("venue_id"), "other_id", _rounded(F.col("similarity"), 6).alias("similarity"))


@query("SELECT venue_id, round(2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(-33.6::DOUBLE - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-33.6::DOUBLE)) * pow(sin(radians(150.9::DOUBLE - lng) / 2), 2)))), 6) AS km FROM venue_")
def haversine_distances(c):
    return c.venue.select("venue_id", F.round(geo.haversine_km(F.col("lat"), F.col("lng"), F.lit(LAT), F.lit(LNG)), 6).alias("km"))


@query("SELECT o_orderkey AS deal_id FROM orders WHERE o_orderdate::DATE <= DATE '1996-06-30' AND o_orderdate::DATE + 200 >= DATE '1996-06-30'")
def deals_in_season(c):
    return c.deal.filter(sync.in_season(F.col("start_date"), F.date_add("start_date", 200), F.lit("1996-06-30").cast("date"))).select("deal_id")


@query("SELECT l_orderkey AS deal_id, 9 AS day FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 7 = 0")
def replace_schedules(c):
    """Schedules of the deals that come in are replaced."""
    have = c.schedule.select("deal_id", F.lit(9).alias("day"))
    return sync.replace_children(have, c.deal.filter("deal_id % 7 = 0").select("deal_id", F.lit(1).alias("day")), "deal_id")


@query("SELECT c_custkey AS id, 'have' AS source FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey % 3 = 0")
def insert_missing(c):
    have = c.venue.filter("venue_id % 3 <> 0").select(F.col("venue_id").alias("id"), F.lit("have").alias("source"))
    return sync.insert_new(have, c.deal.select(F.col("venue_id").alias("id"), F.lit("new").alias("source")), ["id"])


@query("SELECT a.c_custkey AS venue_id, bool_or(b.l_returnflag IN ('R', 'X')) AS shared, list_sort(list(DISTINCT b.day)) = [1, 7] AS weekend FROM customer a JOIN orders o ON o.o_custkey = a.c_custkey JOIN (SELECT l_orderkey, l_returnflag, (dayofweek(l_shipdate) + 1)::INT AS day FROM lineitem) b ON b.l_orderkey = o.o_orderkey GROUP BY 1")
def shared_days(c):
    """Whether lists of a venue meet a wanted one, and whether its days are just the weekend."""
    rows = c.deal.select("deal_id", "venue_id").join(c.table("lineitem").select(F.col("l_orderkey").alias("deal_id"), "l_returnflag", F.dayofweek("l_shipdate").alias("day")), "deal_id")
    lists = rows.groupBy("venue_id").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("day").alias("days"))
    return lists.select("venue_id", F.arrays_overlap("flags", F.array(F.lit("R"), F.lit("X"))).alias("shared"), sets.same_days(F.col("days"), F.array(F.lit(7), F.lit(1), F.lit(7))).alias("weekend"))


@query("SELECT l_orderkey AS deal_id, l_partkey AS product, (min({'p': l_linenumber, 'x': l_extendedprice}) FILTER (l_discount > 0)).x AS price, min(l_linenumber) AS place FROM lineitem GROUP BY ALL")
def priced_products(c):
    rows = c.table("lineitem").select(F.col("l_orderkey").alias("deal_id"), F.col("l_partkey").alias("product"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("price"), F.col("l_linenumber").alias("place"))
    return sets.merge_priced(rows, "deal_id", "product", "price", "place")
