"""Queries over records: answers of a model, addresses, titles, facts of regions, catalogues, relations, lists and filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import deal_text, links, payloads, titles
from ..operators import catalogue, deal_search, facts, search, sets, stats, sync
from .queries import _COUNTS, _found_sql, query


@query(
    "SELECT p_partkey, title, details, days, dates FROM (SELECT p_partkey, p_name AS title, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || '|' || p_brand ELSE '' END AS details, 'Mon' AS days, CASE WHEN p_partkey % 2 = 0 THEN 'until May' END AS dates FROM part WHERE p_partkey % 10 < 8 UNION ALL SELECT p_partkey, 'two', '', '', NULL FROM part WHERE p_partkey % 10 IN (2, 5))"
)
def extraction_payloads(c):
    """Deals out of models' answers about parts: fenced or bare, a list or an object, strings or lists, broken ones."""
    k = F.col("p_partkey")
    text_ = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    details = F.when(k % 3 == 0, text_(F.col("p_type"))).when(k % 3 == 1, F.concat(F.lit("["), text_(F.col("p_type")), F.lit(", 7, "), text_(F.col("p_brand")), F.lit("]"))).otherwise("null")
    one = F.concat(F.lit('{"title": '), text_(F.col("p_name")), F.lit(', "details": '), details, F.lit(', "days": ["Mon"], "times": {}, "promotionDates": '), F.when(k % 2 == 0, '["until May"]').otherwise("null"), F.lit("}"))
    listed = F.concat(F.lit("["), one, F.when(k % 10 == 2, ', {"title": "two"}, {"title": 3}, "x"').when(k % 10 == 5, ', {"title": "two"}').otherwise(""), F.lit("]"))
    whole = F.when(k % 10 < 4, listed).when(k % 10 < 8, F.concat(F.lit('{"deals": '), listed, F.lit("}"))).when(k % 10 == 8, F.concat(F.lit('{"other": '), listed, F.lit("}"))).otherwise(F.concat(F.lit("Sorry: "), listed))
    content = F.when(k % 4 == 1, F.concat(F.lit(" ```json\n"), whole, F.lit("\n```\n"))).otherwise(whole)
    rows = c.table("part").select("p_partkey", F.explode(payloads.deals_of(content)).alias("d"))
    join = lambda a: F.array_join(a, "|")
    return rows.select("p_partkey", "d.title", join("d.details").alias("details"), join("d.days").alias("days"), join("d.promotion_dates").alias("dates"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 3 THEN 'Some Town' WHEN c_custkey % 7 < 6 THEN n_name END AS suburb, CASE WHEN c_custkey % 7 < 6 THEN CASE c_custkey % 7 WHEN 0 THEN 'Bay of Plenty' WHEN 1 THEN 'Otago' WHEN 4 THEN 'Manawatū-Whanganui' WHEN 5 THEN 'Waikato' ELSE '' END END AS state, CASE WHEN c_custkey % 7 < 6 THEN (1000 + c_custkey % 8999)::VARCHAR END AS postcode FROM customer JOIN nation ON c_nationkey = n_nationkey")
def nz_addresses(c):
    """Customers' addresses in seven forms, read back; the last form is Australian and none of these."""
    k, code = F.col("c_custkey"), (F.col("c_custkey") % 8999 + 1000).cast("string")
    rows = c.table("customer").join(c.table("nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    forms = ["1 High St, %s, Bay of Plenty %s, New Zealand", "2 High St, %s OTAGO %s", "3 High St, %s %s , New Zealand", "%s, Some Town %s", "%s manawatū-whanganui %s", "%s waikato %s, New Zealand", "4 High St, %s NSW %s"]
    address = F.get(F.array(*[F.format_string(f, "n_name", code) for f in forms]), (k % 7).cast("int"))
    return rows.select("c_custkey", deal_text.address_parts_nz(address).alias("a")).select("c_custkey", "a.suburb", "a.state", "a.postcode")


_CAP = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_WEEK = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"


@query(
    f"SELECT p_partkey, CASE WHEN len(days) = 1 THEN {_WEEK}[days[1]] || ' ' ELSE '' END || CASE p_partkey % 4 WHEN 1 THEN {_CAP} || ' Specials' WHEN 2 THEN {_CAP} || ' and Beer Specials' ELSE 'Pub Specials' END || CASE WHEN p_partkey % 5 = 0 THEN ' Nearby' ELSE ' in ' || p_brand END AS title, "
    f"CASE WHEN len(days) IN (0, 7) THEN 'Any day' WHEN len(days) <= 2 THEN array_to_string(list_transform(list_sort(list_transform(days, lambda d: (d + 5) % 7)), lambda p: substr({_WEEK}[(p + 1) % 7 + 1], 1, 3)), ', ') ELSE len(days) || ' days' END AS days FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN []::BIGINT[] WHEN 1 THEN [p_size % 7 + 1] WHEN 2 THEN [1, p_size % 6 + 2] WHEN 3 THEN [7, 3, 1] WHEN 4 THEN [2] ELSE [1, 2, 3, 4, 5, 6, 7] END AS days FROM part)"
)
def page_titles(c):
    k, size = F.col("p_partkey"), F.col("p_size").cast("int")
    days = F.when(k % 6 == 0, F.array().cast("array<int>")).when(k % 6 == 1, F.array(size % 7 + 1)).when(k % 6 == 2, F.array(F.lit(1), size % 6 + 2)).when(k % 6 == 3, F.array(F.lit(7), F.lit(3), F.lit(1))).when(k % 6 == 4, F.array(F.lit(2))).otherwise(F.sequence(F.lit(1), F.lit(7)))
    name = F.upper("p_name")
    what = F.when(k % 4 == 1, F.array(name)).when(k % 4 == 2, F.array(name, F.lit("beer"))).when(k % 4 == 3, F.array(name, F.lit("beer"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return c.table("part").select("p_partkey", titles.specials_title(days, what, F.when(k % 5 != 0, F.col("p_brand"))).alias("title"), titles.day_selection(days).alias("days"))


@query("SELECT schedule_id, (CASE WHEN w < s AND w < 600 THEN w + 1440 ELSE w END)::INT AS \"end\", n FROM (SELECT schedule_id, s, n, CASE WHEN e = 0 OR e = 1440 THEN 0 WHEN e > 1440 THEN e % 1440 ELSE e END AS w FROM (SELECT schedule_id, s, CASE WHEN schedule_id % 3 = 0 THEN e % 1440 ELSE e END AS e, count(*) AS n FROM schedule_ GROUP BY ALL))")
def edited_ends(c):
    rows = c.schedule.withColumn("e", F.when(F.col("schedule_id") % 3 == 0, F.col("end") % 1440).otherwise(F.col("end"))).groupBy("schedule_id", "start", "e").agg(F.count("*").alias("n"))
    return rows.select("schedule_id", titles.edited_end(F.col("e"), F.col("start")).cast("int").alias("end"), "n")


_WIN = _COUNTS + ", own_ AS (SELECT *, CASE WHEN region_id = 2 THEN NULL ELSE sqkm END AS km2 FROM counts), met_ AS (SELECT region_id, suburb_id, suburb, m.metric, m.v AS value, m.most FROM own_, unnest([{'metric': 'density', 'v': CASE WHEN km2 > 0 THEN deal_count / km2 END, 'most': 1}, {'metric': 'per_thousand', 'v': CASE WHEN population > 0 THEN deal_count * 1000.0::DOUBLE / population END, 'most': 1}, {'metric': 'deals', 'v': CASE WHEN deal_count > 0 THEN deal_count::DOUBLE END, 'most': 1}, {'metric': 'top_density', 'v': CASE WHEN km2 > 0 THEN deal_count / km2 END, 'most': 5}, {'metric': 'top_deals', 'v': CASE WHEN deal_count > 0 THEN deal_count::DOUBLE END, 'most': 5}]) u(m))"


def _counts(c):
    return stats.suburb_counts(c.suburb, c.venue, search.approved(c.deal))


@query("SELECT region_id, metric, place, suburb_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY region_id, metric ORDER BY value DESC, suburb, suburb_id)::INT AS place, max(CASE WHEN metric = 'top_density' THEN 1 ELSE 0 END) OVER (PARTITION BY region_id) AS dense FROM met_ WHERE value IS NOT NULL) WHERE place <= most AND (metric <> 'top_deals' OR dense = 0)", _WIN)
def region_winners(c):
    """Winners of each region; one region has no areas, so its top list goes by deals."""
    counts = _counts(c).withColumn("sqkm", F.when(F.col("region_id") != 2, F.col("sqkm")))
    return facts.winners(counts).withColumn("value", F.round("value", 6))


@query("SELECT suburb_id, day, n, (base + CASE WHEN total > 0 AND row_number() OVER (PARTITION BY suburb_id ORDER BY rest DESC, day) <= 100 - sum(base) OVER (PARTITION BY suburb_id) THEN 1 ELSE 0 END)::BIGINT AS percent FROM (SELECT *, sum(n) OVER (PARTITION BY suburb_id) AS total, n * 100 // nullif(sum(n) OVER (PARTITION BY suburb_id), 0) AS base, (n * 100) % nullif(sum(n) OVER (PARTITION BY suburb_id), 0) AS rest FROM (SELECT suburb_id, d.day::INT AS day, count(x.deal_id) AS n FROM (SELECT DISTINCT suburb_id FROM venue_) CROSS JOIN range(1, 8) d(day) LEFT JOIN (SELECT suburb_id, deal_id, day FROM venue_ JOIN deal_ USING (venue_id) JOIN schedule_ USING (deal_id) WHERE status = 'approved' AND day % 3 > 0) x USING (suburb_id, day) GROUP BY ALL))")
def suburb_weekday_shares(c):
    """All seven days of each suburb with venues, those without deals too."""
    rows = c.schedule.filter("day % 3 > 0").join(search.approved(c.deal).select("deal_id", "venue_id"), "deal_id").join(c.venue.select("venue_id", "suburb_id"), "venue_id").groupBy("suburb_id", "day").agg(F.count("*").alias("n"))
    none = c.venue.select("suburb_id").distinct().select("suburb_id", F.lit(0).alias("day"), F.lit(0).cast("long").alias("n"))
    return facts.weekday_shares(rows.unionByName(none), "suburb_id")


@query("SELECT region_id, r.ring, r.part, r.w AS whole, round(CASE WHEN r.w > 0 THEN 100.0::DOUBLE * r.part / r.w ELSE 0 END, 6) AS percent FROM (SELECT region_id, count(*) AS s, count(*) FILTER (venue_count > 0) AS a, count(*) FILTER (deal_count > 0) AS b, least(sum(venues_with_deals), sum(venue_count))::BIGINT AS d, sum(venue_count)::BIGINT AS v FROM counts GROUP BY region_id), unnest([{'ring': 'suburbs_with_venues', 'part': a, 'w': s}, {'ring': 'suburbs_with_deals', 'part': b, 'w': s}, {'ring': 'venues_with_deals', 'part': d, 'w': v}]) u(r)", _COUNTS)
def coverage_triads(c):
    return facts.coverage_triad(_counts(c)).withColumn("percent", F.round("percent", 6))


@query("SELECT p_brand, p_name, n, place, round(100.0::DOUBLE * n / max(n) OVER (PARTITION BY p_brand), 6) AS width, greatest(1, floor(100.0::DOUBLE * n / max(n) OVER (PARTITION BY p_brand) / 100 * 12 + 0.5))::INT AS icons FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name)::INT AS place FROM (SELECT p_brand, p_name, sum(l_quantity)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)) WHERE place <= 5")
def product_bars(c):
    """The five names that sell most of each brand, as bars of icons."""
    sold = c.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").cast("long").alias("q"))
    counts = sold.join(c.table("part").select("p_partkey", "p_brand", "p_name"), "p_partkey").groupBy("p_brand", "p_name").agg(F.sum("q").alias("n"))
    return facts.bars(counts, "p_brand", "p_name").withColumn("width", F.round("width", 6))


@query("SELECT o_orderkey, CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END || CASE WHEN h >= 12 THEN 'pm' ELSE 'am' END AS hour, format('{:,}', o_orderkey * 1000) AS n, format('{:.1f} deals/km²', (o_orderkey % 400) / 8.0 + 0.03) AS per_km, format('{:.1f} deals per 1,000 people', (o_orderkey % 70) / 7.0) AS per_thousand, (floor((o_orderkey % 1000) / 10.0 + 0.5))::BIGINT || '%' AS percent FROM (SELECT o_orderkey, o_orderkey % 24 AS h FROM orders)")
def fact_labels(c):
    k = F.col("o_orderkey")
    return c.table("orders").select("o_orderkey", titles.hour_label(k % 24 + 48).alias("hour"), titles.count_label(k * 1000).alias("n"), titles.per_sqkm_label((k % 400) / 8.0 + 0.03).alias("per_km"), titles.per_thousand_label((k % 70) / 7.0).alias("per_thousand"), titles.percent_label((k % 1000) / 10.0).alias("percent"))


_ALL_COUNTS = "s_ AS (SELECT suburb_id, region_id, suburb_id % 3 = 0 AS crawled FROM suburb_), v_ AS (SELECT venue_id, suburb_id, CASE WHEN rating < 0 THEN 'broken' ELSE 'normal' END AS status, venue_id % 4 = 0 AS crawled, CASE WHEN venue_id % 5 > 0 THEN 'w' END AS website FROM venue_), src_ AS (SELECT deal_id, venue_id, status FROM deal_ WHERE deal_id % 2 = 0)"


@query(
    "SELECT region_id, count(*) AS suburbs, count(*) FILTER (crawled) AS crawled_suburbs, " + ", ".join(f"coalesce(sum({x}), 0)::BIGINT AS {x}" for x in ("venues", "sound_venues", "broken_venues", "ready_venues", "crawled_venues", "venues_with_sources", "extracted_venues", "sources", "approved_deals"))
    + " FROM s_ LEFT JOIN (SELECT suburb_id, count(*) AS venues, count(*) FILTER (status = 'normal') AS sound_venues, count(*) FILTER (status = 'broken') AS broken_venues, count(*) FILTER (status = 'normal' AND website IS NOT NULL) AS ready_venues, count(*) FILTER (status = 'normal' AND crawled) AS crawled_venues, count(*) FILTER (EXISTS (SELECT 1 FROM src_ x WHERE x.venue_id = v_.venue_id AND x.status = 'approved')) AS venues_with_sources, count(*) FILTER (EXISTS (SELECT 1 FROM deal_ d WHERE d.venue_id = v_.venue_id)) AS extracted_venues, sum((SELECT count(*) FROM src_ x WHERE x.venue_id = v_.venue_id)) AS sources, sum((SELECT count(*) FROM deal_ d WHERE d.venue_id = v_.venue_id AND d.status = 'approved')) AS approved_deals FROM v_ GROUP BY suburb_id) USING (suburb_id) GROUP BY region_id",
    _ALL_COUNTS,
)
def region_counts(c):
    """All eleven counts of a region's dashboard."""
    k = F.col("venue_id")
    suburbs = c.suburb.select("suburb_id", "region_id", (F.col("suburb_id") % 3 == 0).alias("crawled"))
    venues = c.venue.select("venue_id", "suburb_id", F.when(F.col("rating") < 0, "broken").otherwise("normal").alias("status"), (k % 4 == 0).alias("crawled"), F.when(k % 5 > 0, "w").alias("website"))
    deals = c.deal.select("deal_id", "venue_id", "status")
    return facts.region_counts(suburbs, venues, deals.filter("deal_id % 2 = 0"), deals)


_PLACES = f"""cat_ AS (SELECT suburb_id AS row_id, suburb AS name, CASE WHEN suburb_id % 6 > 0 THEN postcode END AS postcode, lat, lng, CASE WHEN suburb_id % 2 = 0 THEN 'A' || suburb_id END AS area FROM suburb_ WHERE suburb_id % 4 <> 1),
new_ AS (SELECT venue_id AS place_id, suburb AS name, CASE WHEN venue_id % 5 = 0 THEN -40.0::DOUBLE ELSE s.lat + (venue_id % 3) * 0.1::DOUBLE END AS lat, s.lng + (venue_id % 7) * 0.1::DOUBLE AS lng, CASE WHEN venue_id % 3 > 0 THEN 'P' || venue_id END AS area FROM venue_ v JOIN suburb_ s USING (suburb_id)),
near_ AS (SELECT place_id, row_id, area FROM (SELECT n.place_id, c.row_id, n.area, row_number() OVER (PARTITION BY place_id ORDER BY 6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(n.lat)) * cos(radians(c.lat)) * cos(radians(c.lng - n.lng)) + sin(radians(n.lat)) * sin(radians(c.lat))))), row_id) AS r, 6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(n.lat)) * cos(radians(c.lat)) * cos(radians(c.lng - n.lng)) + sin(radians(n.lat)) * sin(radians(c.lat))))) AS km FROM new_ n JOIN cat_ c ON lower(n.name) = lower(c.name)) WHERE r = 1 AND km <= 50),
free_ AS (SELECT * FROM new_ n WHERE place_id NOT IN (SELECT place_id FROM near_) AND lower(name) NOT IN (SELECT lower(name) FROM cat_ WHERE postcode IS NULL)),
first_ AS (SELECT *, lower(name) AS k FROM free_ QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY place_id) = 1),
join_ AS (SELECT n.place_id, f.place_id AS first_id, n.area FROM free_ n JOIN first_ f ON lower(n.name) = f.k AND n.place_id <> f.place_id WHERE 6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(n.lat)) * cos(radians(f.lat)) * cos(radians(f.lng - n.lng)) + sin(radians(n.lat)) * sin(radians(f.lat))))) <= 50)"""


def _merged(c):
    k, v = F.col("suburb_id"), F.col("venue_id")
    have = c.suburb.filter(k % 4 != 1).select(k.alias("row_id"), F.col("suburb").alias("name"), F.when(k % 6 > 0, F.col("postcode")).alias("postcode"), "lat", "lng", F.when(k % 2 == 0, F.concat(F.lit("A"), k)).alias("area"))
    at = c.venue.select("venue_id", "suburb_id").join(c.suburb.select("suburb_id", "suburb", "lat", "lng"), "suburb_id")
    places = at.select(v.alias("place_id"), F.col("suburb").alias("name"), F.when(v % 5 == 0, -40.0).otherwise(F.col("lat") + (v % 3) * 0.1).alias("lat"), (F.col("lng") + (v % 7) * 0.1).alias("lng"), F.when(v % 3 > 0, F.concat(F.lit("P"), v)).alias("area"))
    return catalogue.merge_places(have, places)


@query("SELECT name, postcode, round(lat, 6) AS lat, round(lng, 6) AS lng, coalesce(area, (SELECT arg_min(n.area, n.place_id) FROM near_ n WHERE n.row_id = c.row_id AND n.area IS NOT NULL)) AS area FROM cat_ c UNION ALL SELECT name, NULL, round(lat, 6), round(lng, 6), coalesce(area, (SELECT arg_min(j.area, j.place_id) FROM join_ j WHERE j.first_id = f.place_id AND j.area IS NOT NULL)) FROM first_ f", _PLACES)
def places_merged(c):
    """Suburbs after places of another source: the nearest of a name is enriched, places far from all of theirs are added."""
    return _merged(c)[0].withColumns({x: F.round(x, 6) for x in ("lat", "lng")})


@query("SELECT place_id, CASE WHEN place_id IN (SELECT place_id FROM near_) OR place_id IN (SELECT place_id FROM join_) THEN 'matched' WHEN place_id IN (SELECT place_id FROM first_) THEN 'added' ELSE 'skipped' END AS outcome FROM new_", _PLACES)
def places_outcomes(c):
    return _merged(c)[1]


@query("SELECT region FROM region_ WHERE region_id % 2 = 0 UNION ALL SELECT lower(region) FROM region_ WHERE region_id % 2 = 1 UNION ALL SELECT 'Elsewhere'")
def regions_seeded(c):
    have = c.region.filter("region_id % 2 = 0").select("region")
    seeds = c.region.select(F.lower("region").alias("region")).unionByName(c.spark.range(1).select(F.lit("Elsewhere").alias("region")))
    return catalogue.seeded(have, seeds, "region")


@query("SELECT venue_id, CASE WHEN venue_id % 4 = 0 THEN DATE '2026-01-01' ELSE DATE '1995-01-01' END AS last_update, (SELECT count(*) FROM deal_ d WHERE d.venue_id = v.venue_id AND (v.venue_id % 4 > 0)) + CASE WHEN venue_id % 8 = 0 THEN 2 ELSE 0 END AS deals, (SELECT count(*) FROM deal_ d JOIN schedule_ s USING (deal_id) WHERE d.venue_id = v.venue_id AND v.venue_id % 4 > 0) AS schedules FROM venue_ v")
def deals_replaced(c):
    """Every fourth venue's deals are replaced: half of those get two, the others none; schedules go with their deals."""
    v = F.col("venue_id")
    venues = c.venue.select("venue_id", F.lit("1995-01-01").cast("date").alias("last_update"))
    given = c.venue.filter((v % 8 == 0) | (v % 8 == 3)).select(F.explode(F.array(v * 10 + 10**9, v * 10 + 10**9 + 1)).alias("deal_id"), "venue_id")
    after, deals, children = catalogue.replace_deals(venues, c.deal.select("deal_id", "venue_id"), {"schedules": c.schedule.join(c.deal.select("deal_id", "venue_id"), "deal_id")}, venues.filter(v % 4 == 0), given, F.lit("2026-01-01").cast("date"))
    count = lambda t, a: t.groupBy("venue_id").agg(F.count("*").alias(a))
    joined = after.join(count(deals, "deals"), "venue_id", "left").join(count(children["schedules"], "schedules"), "venue_id", "left")
    return joined.select("venue_id", "last_update", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("deals", "schedules")])


@query("SELECT deal_id, (SELECT string_agg(day || ':' || s || '-' || e, ',' ORDER BY day, s, e) FROM schedule_ x WHERE x.deal_id = d.deal_id) AS schedules, (SELECT string_agg(p_brand, ',' ORDER BY p_brand) FROM (SELECT DISTINCT p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = d.deal_id)) AS products, (SELECT string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) FROM (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_orderkey = d.deal_id)) AS sources FROM deal_ d WHERE status = 'approved'")
def deal_relations(c):
    """Each approved deal with its schedules, products and sources, each gathered by deal before they meet."""
    line = F.concat("day", F.lit(":"), "start", F.lit("-"), "end")
    schedules = c.schedule.groupBy("deal_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("day", "start", "end", line.alias("t")))), lambda x: x["t"]), ",").alias("schedules"))
    lines = c.table("lineitem").select(F.col("l_orderkey").alias("deal_id"), "l_partkey", "l_suppkey")
    products = lines.join(c.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("deal_id").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("products"))
    sources = lines.groupBy("deal_id").agg(F.array_join(F.transform(F.sort_array(F.collect_set("l_suppkey")), lambda s: s.cast("string")), ",").alias("sources"))
    out = search.approved(c.deal).select("deal_id")
    for t in (schedules, products, sources):
        out = out.join(t, "deal_id", "left")
    return out


@query("SELECT event_id, d.title, v.venue, s.suburb, 'user ' || (e.user_id % 50) AS reporter FROM event_ e JOIN deal_ d ON d.deal_id = e.user_id * 4 + 1 JOIN venue_ v ON v.venue_id = d.venue_id LEFT JOIN suburb_ s ON s.suburb_id = v.suburb_id AND s.suburb_id % 2 = 0 WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC")
def open_reports(c):
    """Reports of deals, newest first, with deal, venue, suburb where known, and who reported."""
    suburbs = c.suburb.filter("suburb_id % 2 = 0").select("suburb_id", "suburb")
    reports = c.event.filter("event_type = 'error'").select("event_id", "ts", (F.col("user_id") * 4 + 1).alias("deal_id"), F.concat(F.lit("user "), F.col("user_id") % 50).alias("reporter"))
    joined = reports.join(c.deal.select("deal_id", "title", "venue_id"), "deal_id").join(c.venue.select("venue_id", "venue", "suburb_id"), "venue_id").join(suburbs, "suburb_id", "left")
    return joined.orderBy(F.col("ts").desc(), F.col("event_id").desc()).select("event_id", "title", "venue", "suburb", "reporter")


_OWN = "own_ AS (SELECT DISTINCT user_id, 1 + (user_id * 7 + event_id % 3) % 150 AS venue_id FROM event_ WHERE event_type = 'signup')"


@query("SELECT venue_id, venue, count(user_id) AS owners, count(*) FILTER (user_id = 7) > 0 AS mine FROM venue_ LEFT JOIN own_ USING (venue_id) GROUP BY ALL", _OWN)
def venue_owners(c):
    """Each venue's number of owners, and whether one user is among them."""
    u = F.col("user_id")
    owned = c.event.filter("event_type = 'signup'").select("user_id", ((u * 7 + F.col("event_id") % 3) % 150 + 1).alias("venue_id")).distinct()
    by = owned.groupBy("venue_id").agg(F.count("*").alias("owners"), F.max(u == 7).alias("mine"))
    return c.venue.select("venue_id", "venue").join(by, "venue_id", "left").select("venue_id", "venue", F.coalesce("owners", F.lit(0)).alias("owners"), F.coalesce("mine", F.lit(False)).alias("mine"))


@query("SELECT suburb_id, row_number() OVER (ORDER BY venue_count DESC, lower(suburb), coalesce(postcode_, ''), suburb_id)::INT AS place FROM (SELECT suburb_id, suburb, CASE WHEN suburb_id % 3 > 0 THEN postcode END AS postcode_, count(venue_id) AS venue_count FROM suburb_ LEFT JOIN venue_ USING (suburb_id) WHERE (region_id IS NULL OR region_id = 1 OR suburb_id % 2 = 0) AND (contains(lower(suburb), 'ion_1') OR contains(postcode, '00') OR contains(lower('S' || suburb_id % 3), 's1')) GROUP BY ALL)")
def suburb_list(c):
    """Suburbs that hold a text in name, postcode or state, with the most venues first, then by name and postcode."""
    k = F.col("suburb_id")
    rows = c.suburb.withColumn("state", F.concat(F.lit("S"), (k % 3).cast("string"))).filter(F.col("region_id").isNull() | (F.col("region_id") == 1) | (k % 2 == 0))
    has = lambda column, part: F.contains(F.lower(column), F.lit(part))
    found = rows.filter(has("suburb", "ion_1") | has("postcode", "00") | has("state", "s1"))
    counted = found.join(c.venue.groupBy("suburb_id").agg(F.count("*").alias("n")), "suburb_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    keyed = counted.select("suburb_id", (-F.col("n")).alias("less"), F.lower("suburb").alias("low"), F.coalesce(F.when(k % 3 > 0, F.col("postcode")), F.lit("")).alias("code"))
    return sync.numbered(keyed, ["less", "low", "code", "suburb_id"], "place").select("suburb_id", F.col("place").cast("int").alias("place"))


@query("SELECT event_type, event_id, place FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC)::INT AS place FROM event_) WHERE place <= 5")
def recent_runs(c):
    """The five latest runs of each kind."""
    order = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return c.event.withColumn("place", F.row_number().over(order)).filter("place <= 5").select("event_type", "event_id", "place")


@query("SELECT l_orderkey, string_agg(p_brand, ',' ORDER BY pos, p_brand) AS features FROM (SELECT DISTINCT l_orderkey, p_brand, coalesce(list_position(['Brand#9', 'Brand#4', 'Brand#1', 'Brand#20'], p_brand), 99) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY l_orderkey")
def feature_order(c):
    """Features in the catalogue's order, unknown ones behind them by name."""
    known = F.array(*[F.lit(x) for x in ("Brand#9", "Brand#4", "Brand#1", "Brand#20")])
    lines = c.table("lineitem").select("l_orderkey", "l_partkey").join(c.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").select("l_orderkey", "p_brand").distinct()
    place = F.coalesce(F.nullif(F.array_position(known, F.col("p_brand")), F.lit(0).cast("long")), F.lit(99).cast("long"))
    return lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("k"), "p_brand"))), lambda x: x["p_brand"]), ",").alias("features"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || '/own' WHEN 1 THEN lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || '/second' END AS canonical FROM pages")
def canonical_urls(c):
    """The address that a page gives as its own: the first one of its origin, not one of another site."""
    k = F.col("page_id")
    tag = F.when(k % 4 == 0, '<LINK href="/own#x" rel="Canonical next">').when(k % 4 == 1, "<link rel='canonical' href='https://other.example/own'><link rel=canonical href=/second>").when(k % 4 == 2, '<link rel="canonical" href="https://other.example/">').otherwise('<link rel="icon" href="/own">')
    return c.table("pages").select("page_id", links.canonical_url(F.concat(tag, F.coalesce("html", F.lit(""))), F.col("url")).alias("canonical"))


@query("SELECT k AS p_partkey, CASE p % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN p_size % 2 = 1 ELSE false END AS dated FROM (SELECT p_partkey AS k, p_partkey AS p, p_size FROM part)")
def dated_links(c):
    """Links to a month's or a year's events, which aren't followed."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("/whats-on/march/"), n)).when(k % 6 == 1, F.concat(F.lit("/Best-of-SEPT-"), n)).when(k % 6 == 2, F.concat(F.lit("/maybe/decent/"), n)).when(k % 6 == 3, F.concat(F.lit("/event/2031/"), n)).when(k % 6 == 4, F.when(F.col("p_size") % 2 == 1, "/events/2029").otherwise("/events/1999")).otherwise(F.concat(F.lit("/events/x2031?may="), n))
    return c.table("part").select("p_partkey", links.of_a_date(F.concat(F.lit("https://a.example"), path)).alias("dated"))


@query(*_found_sql("regexp_matches(title, '^[25]-') AND v.suburb_id IN (SELECT suburb_id FROM suburb_ WHERE region_id = 1)"))
def search_stems_in_region(c):
    """Deals of a region by stems: 'rating' finds what is rated, 'low priorities' what is of low priority."""
    rows = c.deal.withColumn("details", F.when(F.col("title").startswith("2-"), "Prices are highly rated").when(F.col("title").startswith("5-"), "of low priority"))
    found = deal_search.search_deals(rows, c.venue, c.suburb, c.schedule, deal_search.DealFilter(region_id=1, query="rating, low priorities"))
    flat = F.transform("schedules", lambda s: F.concat(s["day"].cast("string"), F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return found.select("deal_id", "title", "venue", "suburb", F.array_join(flat, ",").alias("schedules"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'b,a,c' WHEN c_custkey % 3 = 1 THEN 'a,c' ELSE 'b,a' END AS ids, CASE c_custkey % 4 WHEN 0 THEN 'x@a.example' WHEN 1 THEN 'm' || c_custkey WHEN 2 THEN 'm' || c_custkey END AS email FROM customer")
def favourites_and_contacts(c):
    """Favourites of a device before those of the account, and contacts that are set where there are none."""
    k = F.col("c_custkey")
    own, other = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))
    none = F.lit(None).cast("array<string>")
    ids = F.array_join(sets.ordered_union(F.when(k % 3 != 1, own).otherwise(none), F.when(k % 3 != 2, other).otherwise(none)), ",")
    rows = c.table("customer").select("c_custkey", ids.alias("ids"), F.when(k % 4 == 0, "x@a.example").when(k % 4 == 1, " ").otherwise(F.lit(None)).alias("email"))
    given = c.table("customer").filter(k % 4 != 3).select("c_custkey", F.concat(F.lit(" m"), k).alias("email"))
    return catalogue.set_if_empty(rows, "c_custkey", "email", given)
