"""Queries over small rules: what is a deal, what covers what, labels, addresses of pictures, queues, pictures, sources, boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import deal_text, geo, parsing
from ..operators import review, search
from .queries import query

_KM = "(((p_partkey * 37) % 30000) / 1000.0::DOUBLE + 0.0004::DOUBLE)"


@query(
    f"SELECT p_partkey, CASE WHEN {_KM} < 1 THEN greatest(1, round({_KM} * 1000)::INT) || ' m' WHEN {_KM} < 10 THEN format('{{:.1f}} km', {_KM}) ELSE format('{{:.0f}} km', {_KM}) END AS distance, "
    "CASE p_partkey % 4 WHEN 0 THEN 'https://c.example/pics/' || p_partkey || '-thumb.jpg?x=1' WHEN 1 THEN 'https://c.example/pics/a' || p_partkey || '.jpg' WHEN 2 THEN 'https://c.example/other/' || p_partkey || '.jpg' END AS thumb, "
    "CASE p_partkey % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true ELSE true END AS current, CASE WHEN p_partkey % 3 = 0 THEN 'broken' ELSE 'normal' END AS import_status FROM part"
)
def small_labels(c):
    """Distances, pictures' small forms, documents of this year and the state of imports."""
    k = F.col("p_partkey")
    km = ((k * 37) % 30000) / 1000.0 + F.lit(0.0004)
    picture = F.when(k % 4 == 0, F.concat(F.lit("https://c.example/pics/"), k, F.lit(".JPEG?x=1"))).when(k % 4 == 1, F.concat(F.lit("https://c.example/pics/a"), k, F.lit(".jpg"))).when(k % 4 == 2, F.concat(F.lit("https://c.example/other/"), k, F.lit(".jpg"))).otherwise(" ")
    document = F.when(k % 5 == 0, "https://a.example/menu-2024.pdf?y=2031").when(k % 5 == 1, "https://a.example/2030/menu.pdf").when(k % 5 == 2, "https://a.example/menu.pdf?y=2001").when(k % 5 == 3, "https://a.example/menu-1999.pdf").otherwise("https://a.example/m2024x.pdf")
    site = F.when(k % 3 == 0, F.when(k % 2 == 0, " ")).otherwise("https://a.example")
    return c.table("part").select("p_partkey", geo.distance_label(km).alias("distance"), deal_text.thumbnail(picture, "pics").alias("thumb"), deal_text.current_document(document, 2030).alias("current"), deal_text.import_status(site).alias("import_status"))


_SHAPES = ["Monday steak $20", "TUESDAY 5pm half price {0}", "wings from 16:30 {0}", "Monday {0}", "steak $20 {0}", "Wed beer $5 on 3 March", "Friday beer trivia $5", "Sat beer sold out", "", "weekend beer {0}"]


@query("SELECT p_partkey, p_partkey % 10 IN (0, 1, 2, 9) AS deal FROM part")
def valid_deals(c):
    """Ten shapes of texts with parts' names, and which of them may be deals."""
    k = F.col("p_partkey")
    shapes = F.array(*[F.replace(F.lit(s), F.lit("{0}"), F.col("p_name")) for s in _SHAPES])
    said = F.get(shapes, (k % 10).cast("int"))
    return c.table("part").select("p_partkey", deal_text.is_deal(said, ["beer", "wings", "steak"], expired=["sold out"], excluded=["trivia"]).alias("deal"))


@query("SELECT a.schedule_id, b.schedule_id AS other_id, a.day, (b.s >= a.s AND b.e <= a.e) AS covers FROM (SELECT DISTINCT * FROM schedule_) a JOIN (SELECT DISTINCT * FROM schedule_) b ON a.deal_id = b.deal_id AND a.day = b.day AND a.schedule_id <> b.schedule_id")
def covering_hours(c):
    """Pairs of a deal's schedules of one day, and whether the first covers the second."""
    hours = lambda: F.struct(F.lit("between").alias("kind"), F.col("start"), F.col("end"))
    rows = c.schedule.distinct()
    a = rows.select("deal_id", "day", "schedule_id", hours().alias("a"))
    b = rows.select("deal_id", "day", F.col("schedule_id").alias("other_id"), hours().alias("b"))
    return a.join(b, ["deal_id", "day"]).filter("schedule_id <> other_id").select("schedule_id", "other_id", "day", parsing.covers(F.col("a"), F.col("b")).alias("covers"))


_SOUND = "v_ AS (SELECT venue_id FROM venue_ WHERE rating >= 0), over_ AS (SELECT DISTINCT a.deal_id FROM (SELECT DISTINCT * FROM schedule_) a JOIN (SELECT DISTINCT * FROM schedule_) b ON a.deal_id = b.deal_id AND a.day = b.day AND a.schedule_id < b.schedule_id AND a.s < b.e AND b.s < a.e JOIN deal_ d ON d.deal_id = a.deal_id WHERE status = 'approved')"


@query(
    "SELECT queue, id, venue_id FROM (SELECT 'sources' AS queue, deal_id AS id, venue_id FROM deal_ WHERE status = 'new' AND deal_id % 3 = 0 UNION ALL SELECT 'deals', deal_id, venue_id FROM deal_ WHERE status = 'new' UNION ALL SELECT 'deal_products', deal_id, venue_id FROM deal_ WHERE status = 'approved' AND deal_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 20) UNION ALL SELECT 'deal_review', deal_id, venue_id FROM deal_ WHERE deal_id IN (SELECT deal_id FROM over_)) WHERE venue_id IN (SELECT venue_id FROM v_)",
    _SOUND,
)
def review_queues(c):
    """All four queues; there are overlapping deals, so those of long hours are not asked for."""
    venues = c.venue.select("venue_id", F.when(F.col("rating") < 0, "broken").otherwise("normal").alias("status"))
    deals = c.deal.select("deal_id", "venue_id", "status")
    sources = deals.filter("deal_id % 3 = 0").withColumnRenamed("deal_id", "source_id")
    products = c.table("lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("deal_id"))
    rows = c.schedule.distinct()
    other = rows.select("deal_id", "day", F.col("schedule_id").alias("o"), F.col("start").alias("s"), F.col("end").alias("e"))
    apart = rows.join(other, ["deal_id", "day"]).filter("schedule_id < o AND start < e AND s < end").join(search.approved(c.deal).select("deal_id"), "deal_id", "left_semi")
    return review.review_queues(venues, sources, deals, products, apart, c.schedule.filter("end - start > 200"))


@query("SELECT p_partkey, p_size % 3 > 0 AND p_partkey % 6 IN (0, 1) AS readable FROM part")
def readable_pictures(c):
    """Pictures by size and lines: two of six ways of writing are deals, and two of three sizes are enough."""
    k = F.col("p_partkey")
    ways = [["Steak night", "every Tuesday", "$20"], ["HAPPY HOUR", "Friday 5pm", "half price beer"], ["Steak", "$20"], ["Steak Monday", "3rd of March $20"], ["Beer $5", "first Tuesday of each month"], ["Monday", "menu"]]
    lines = F.get(F.array(*[F.array(*[F.lit(x) for x in w]) for w in ways]), (k % 6).cast("int"))
    size = F.col("p_size") % 3
    return c.table("part").select("p_partkey", review.readable_picture(F.when(size == 0, 469).otherwise(470), F.when(size == 0, 900).otherwise(500), lines, ["steak", "beer"]).alias("readable"))


@query("SELECT venue_id, count(*) AS taken, count(error) AS failed, CASE WHEN count(error) = count(*) THEN arg_min(error, k) END AS error FROM (SELECT venue_id, deal_id AS k, CASE WHEN deal_id % 3 > 0 OR venue_id % 10 = 0 THEN 'E' || deal_id END AS error, row_number() OVER (PARTITION BY venue_id ORDER BY deal_id) AS r FROM deal_) WHERE r <= 5 GROUP BY venue_id")
def source_materials(c):
    k = F.col("deal_id")
    return review.materials(c.deal.select("venue_id", "deal_id", F.when((k % 3 > 0) | (F.col("venue_id") % 10 == 0), F.concat(F.lit("E"), k)).alias("error")), "deal_id", 5)


@query("SELECT c_custkey, state, CASE WHEN state = 'given' THEN n END AS north, CASE WHEN state = 'given' THEN -30.0::DOUBLE END AS south FROM (SELECT c_custkey, (c_custkey % 130)::DOUBLE - 40 AS n, CASE WHEN c_custkey % 5 = 0 THEN 'none' WHEN c_custkey % 5 = 1 THEN 'invalid' WHEN c_custkey % 130 - 40 > -30 AND c_custkey % 130 - 40 <= 90 AND c_custkey % 7 > 0 THEN 'given' ELSE 'invalid' END AS state FROM customer)")
def bounds_given(c):
    """Boxes as parameters: missing, partly missing, out of order, over the antimeridian, or given."""
    k = F.col("c_custkey")
    some = lambda v: F.when(k % 5 > 0, v)
    b = review.bounds_of(some((k % 130 - 40).cast("string")), some(F.lit(" -30 ")), some(F.when(k % 7 > 0, "151.5").otherwise("-170")), F.when(k % 5 > 1, "150"))
    return c.table("customer").select("c_custkey", b.alias("b")).select("c_custkey", "b.state", "b.north", "b.south")
