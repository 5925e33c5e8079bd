"""Queries over paths of search pages: places and products of the tables as paths, read and written back; site maps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import areas, crawl, site_maps, suggest
from ..sources.stored import spread
from .queries import query

#: Products that paths may name, by kinds and colours of the tables' parts, with other ways of writing them.
NAMES = [("Economy", ["cheap"]), ("Standard", []), ("Promo", ["promotion", "Pro-Mo"]), ("Small", ["petit"]), ("Medium", []), ("Large", ["big"])]
_SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_DAYS = "['sunday', 'monday', 'tuesday', 'wednesday', 'thursday', 'friday', 'saturday']"

#: The first segment of a path, by customer: a suburb with or without its postcode, or standing nearby; then a filter and what follows it.
_SHOWN = f"""
one_ AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 11 = 0 THEN 'nearby' ELSE {_SLUG.format('n_name')} || CASE WHEN c_custkey % 2 = 0 THEN '-' || (2000 + n_nationkey) ELSE '' END END AS place,
  CASE WHEN c_custkey % 5 = 1 THEN {_DAYS}[c_custkey % 7 + 1] END AS hung, CASE WHEN c_custkey % 3 = 0 THEN {_DAYS}[c_custkey % 6 + 1] END AS day,
  CASE c_custkey % 4 WHEN 1 THEN ['economy'] WHEN 2 THEN ['cheap', 'promo'] WHEN 3 THEN ['big', 'unheard'] ELSE [] END AS what, c_custkey % 9 = 4 AS map, c_custkey % 13 = 6 AS more FROM customer JOIN nation ON c_nationkey = n_nationkey),
path_ AS (SELECT *, '/' || upper(place) || coalesce('-' || hung, '') || CASE WHEN day IS NOT NULL OR len(what) > 0 THEN '/' || array_to_string(list_filter([day] || what, lambda x: x IS NOT NULL), '-') ELSE '' END || CASE WHEN map THEN '/map' ELSE '' END || CASE WHEN more THEN '/x' ELSE '' END AS path FROM one_)"""


def _placed(c):
    """Customers with their nation's name, dealt out before paths are written and read."""
    customers = spread(c.table("customer").select("c_custkey", "c_name", "c_nationkey"))
    return customers.join(F.broadcast(c.table("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few


def _shown(c):
    k = F.col("c_custkey")
    day = lambda n: F.get(F.array(*[F.lit(d) for d in paths.WEEK]), (k % n).cast("int"))
    rows = _placed(c)
    place = F.when(k % 11 == 0, paths.NEARBY).otherwise(text.suburb_slug(F.col("n_name"), F.when(k % 2 == 0, (F.col("n_nationkey") + 2000).cast("string"))))
    parts = F.array_compact(F.concat(F.array(F.when(k % 3 == 0, day(6))), F.when(k % 4 == 1, F.array(F.lit("economy"))).when(k % 4 == 2, F.array(F.lit("cheap"), F.lit("promo"))).when(k % 4 == 3, F.array(F.lit("big"), F.lit("unheard"))).otherwise(F.array().cast("array<string>"))))
    first = F.concat(F.lit("/"), F.upper(place), F.when(k % 5 == 1, F.concat(F.lit("-"), day(7))).otherwise(""))
    written = F.concat(first, F.when(F.size(parts) > 0, F.concat(F.lit("/"), F.array_join(parts, "-"))).otherwise(""), F.when(k % 9 == 4, "/map").otherwise(""), F.when(k % 13 == 6, "/x").otherwise(""))
    return rows.select(k.alias("k"), written.alias("path"))


_READ = "list_transform(list_filter(what, lambda w: w <> 'unheard'), lambda w: CASE w WHEN 'economy' THEN 'Economy' WHEN 'cheap' THEN 'Economy' WHEN 'promo' THEN 'Promo' ELSE 'Large' END)"


@query(
    f"SELECT k, path, CASE WHEN lost THEN 'anywhere' WHEN place = 'nearby' THEN 'nearby' ELSE 'suburb' END AS kind, CASE WHEN NOT lost AND place <> 'nearby' THEN place END AS slug, NOT lost AND map AS map, CASE WHEN NOT lost THEN coalesce(list_position({_DAYS}, day), list_position({_DAYS}, hung)) END::INT AS day, CASE WHEN lost THEN '' ELSE array_to_string({_READ}, ',') END AS what "
    "FROM (SELECT *, more OR list_contains(what, 'unheard') AS lost FROM path_)",
    _SHOWN,
)
def paths_read(c):
    """What the paths of customers' searches ask for; a path with an unknown product is no search."""
    names = paths.product_names(NAMES)
    read = _shown(c).select("k", "path", paths.parse_where(F.col("path"), names).alias("w"))
    return read.select("k", "path", "w.kind", "w.slug", "w.map", "w.day", F.array_join("w.what", ",").alias("what"))


@query(
    f"SELECT k, '/' || place || CASE WHEN list_contains(what, 'unheard') THEN '/' || array_to_string(list_filter([day] || what, lambda x: x IS NOT NULL), '-') WHEN (map OR more) AND (day IS NOT NULL OR len(what) > 0) THEN '/' || array_to_string(list_filter([day] || what, lambda x: x IS NOT NULL), '-') ELSE '' END || CASE WHEN map THEN '/map' ELSE '' END || CASE WHEN more THEN '/x' ELSE '' END || '/' || {_DAYS}[k % 7 + 1] || '-small-large?q=' || k AS path FROM path_",
    _SHOWN,
)
def paths_written(c):
    """The same paths with another filter in place of the one that ends them, and a query behind."""
    names = paths.product_names(NAMES)
    what = F.array(F.lit("petit"), F.lit("unheard"), F.lit(" LARGE"))
    given = F.concat("path", F.lit("?q="), "k")
    return _shown(c).select("k", paths.append_filters(given, (F.col("k") % 7 + 1).cast("int"), what, names).alias("path"))


@query(
    "SELECT suburb_id, name, slug FROM (SELECT *, count(*) OVER (PARTITION BY slug) AS n FROM mac_) WHERE n = 1",
    f"mac_ AS (SELECT suburb_id, translate(suburb, 'AEIOUC', 'ĀĒĪŌŪČ') AS name, {_SLUG.format('suburb')} || CASE WHEN suburb_id % 2 = 0 THEN '-' || postcode ELSE '' END AS slug FROM suburb_ UNION ALL SELECT suburb_id + 1000, suburb, {_SLUG.format('suburb')} FROM suburb_ WHERE suburb_id % 3 = 0)",
)
def unique_suburb_slugs(c):
    """Suburbs with macrons and carons by slug; slugs that two suburbs share go."""
    named = c.suburb.select("suburb_id", F.translate("suburb", "AEIOUC", "ĀĒĪŌŪČ").alias("name"), F.when(F.col("suburb_id") % 2 == 0, F.col("postcode")).alias("postcode"))
    more = c.suburb.filter("suburb_id % 3 = 0").select((F.col("suburb_id") + 1000).alias("suburb_id"), F.col("suburb").alias("name"), F.lit(None).cast("string").alias("postcode"))
    rows = named.unionByName(more).withColumn("slug", text.suburb_slug(F.col("name"), F.col("postcode")))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("slug"))).filter("n = 1").select("suburb_id", "name", "slug")


_VENUE_PATH = f"'https://s.example/' || {_SLUG.format('n_name')} || '/' || {_SLUG.format("CASE WHEN c_custkey % 4 = 0 THEN 'The Local ' || c_custkey % 50 ELSE c_name END")}"


@query(f"SELECT url, 1 AS depth FROM (SELECT url, count(*) OVER (PARTITION BY url) AS n FROM (SELECT {_VENUE_PATH} || '?a=' || c_custkey % 3 || '&b=<1>' AS url FROM customer JOIN nation ON c_nationkey = n_nationkey)) WHERE n = 1")
def site_map_round_trip(c):
    """Venues' addresses written to site maps of 40 each, with an index over them, and found again by a walk from the index."""
    k = F.col("c_custkey")
    rows = _placed(c)
    name = F.when(k % 4 == 0, F.concat(F.lit("The Local "), k % 50)).otherwise(F.col("c_name"))
    url = F.concat(F.lit("https://s.example"), paths.venue_path(F.col("n_name"), name), F.lit("?a="), k % 3, F.lit("&b=<1>"))
    listed = rows.select(url.alias("loc")).withColumn("n", F.count("*").over(Window.partitionBy("loc"))).filter("n = 1")
    entries = listed.select("loc", F.lit("2026-01-01").alias("lastmod"), F.lit("weekly").alias("changefreq"), F.lit("0.8").alias("priority"))
    files = site_maps.write_site_maps(entries, "https://s.example/maps", 40)
    roots = c.spark.createDataFrame([("s.example", "https://s.example/maps/index.xml")], "site string, url string")
    found = crawl.site_map_leaves(roots, site_maps.read_site_maps(files), most=10**9)
    return found.select("url", "depth")


@query(
    "SELECT t.typed_id, product, row_number() OVER (PARTITION BY t.typed_id ORDER BY rank NULLS LAST, product)::INT AS place FROM typed_ t JOIN prod_ p ON (t.typed = '' AND rank IS NOT NULL) OR (t.typed <> '' AND len(list_filter(names, lambda n: contains(lower(n), t.typed))) > 0) WHERE lower(product) <> coalesce(chosen, '')",
    "prod_ AS (SELECT p_name AS product, min(CASE WHEN p_size <= 30 THEN p_size END) AS rank, list_distinct(list(p_name) || list('Real ' || p_type)) AS names FROM part GROUP BY p_name), "
    "typed_ AS (SELECT p_partkey AS typed_id, trim(lower(substr(p_name, (1 + p_partkey % 5)::INT, (p_partkey % 6)::INT))) AS typed, CASE WHEN p_partkey % 3 = 0 THEN p_name END AS chosen FROM part)",
)
def typed_suggestions(c):
    """What each of many typed strings, cut from parts' names, suggests among all parts' names and kinds."""
    k = F.col("p_partkey")
    part = c.table("part")
    ranks = part.groupBy(F.col("p_name").alias("product")).agg(F.min(F.when(F.col("p_size") <= 30, F.col("p_size"))).alias("rank"))
    written = part.select(F.col("p_name").alias("product"), F.explode(F.array("p_name", F.concat(F.lit("Real "), "p_type"))).alias("written")).distinct()
    typed = part.select(k.alias("typed_id"), F.upper(F.col("p_name").substr((1 + k % 5).cast("int"), (k % 6).cast("int"))).alias("typed"))
    chosen = part.filter(k % 3 == 0).select(k.alias("typed_id"), F.upper("p_name").alias("product"))
    return suggest.suggestions(typed, written.join(ranks, "product"), excluded=chosen)


#: A box over the suburbs' venues and the radius of its sweep's circles, in metres.
AREA, RADIUS = (-34.0, 150.5, -33.4, 151.2), 9000.0


def _levels() -> str:
    """CTEs cell0_ to cell3_ and in0_ to in3_, each level cut from the saturated cells of the one before."""
    up, parts = RADIUS * areas.OVERLAP / areas.METRES_PER_DEGREE, []
    right = f"({RADIUS} * {areas.OVERLAP} / ({areas.METRES_PER_DEGREE} * cos(radians({(AREA[0] + AREA[2]) / 2}))))"
    parts.append(
        f"cell0_ AS (SELECT i || '.' || j AS cell, {AREA[0]}::DOUBLE + {up / 2!r}::DOUBLE + i * {up!r}::DOUBLE AS lat, {AREA[1]}::DOUBLE + {right} / 2 + j * {right} AS lng, {RADIUS}::DOUBLE AS radius FROM range((floor(({AREA[2]} - ({AREA[0]})) / {up!r}) + 1)::BIGINT) a(i), range((floor(({AREA[3]} - {AREA[1]}) / {right}) + 1)::BIGINT) b(j))"
    )
    km = "6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(c.lat)) * cos(radians(v.lat)) * cos(radians(v.lng - c.lng)) + sin(radians(c.lat)) * sin(radians(v.lat)))))"
    for level in range(areas.DEPTH + 1):
        parts.append(f"in{level}_ AS MATERIALIZED (SELECT cell, venue_id FROM (SELECT cell, venue_id, row_number() OVER (PARTITION BY cell ORDER BY {km}, venue_id) AS n FROM cell{level}_ c JOIN venue_ v ON {km} * 1000 <= c.radius) WHERE n <= {areas.MOST})")
        parts.append(f"full{level}_ AS MATERIALIZED (SELECT c.*, count(venue_id) AS found FROM cell{level}_ c LEFT JOIN in{level}_ USING (cell) GROUP BY ALL)")
        off = f"(radius * {areas.OVERLAP} / 2 / {areas.METRES_PER_DEGREE})"
        parts.append(f"cell{level + 1}_ AS MATERIALIZED (SELECT cell || '/' || k AS cell, lat + a * {off} AS lat, lng + b * {off} / cos(radians(lat)) AS lng, radius / 2 AS radius FROM full{level}_, (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) q(k, a, b) WHERE found >= {areas.MOST})")
    return ", ".join(parts)


_FOUND = " UNION ALL ".join(f"SELECT venue_id, {k} AS depth, cell FROM in{k}_" for k in range(areas.DEPTH + 1))
_SEARCHES = " UNION ALL ".join(f"SELECT cell, {k} AS depth, found::INT AS found, found >= {areas.MOST} AND {k} = {areas.DEPTH} AS saturated FROM full{k}_" for k in range(areas.DEPTH + 1))


def _swept(c):
    return areas.sweep(areas.grid(c.spark, *AREA, RADIUS), c.venue.select(F.col("venue_id").alias("place_id"), "lat", "lng"), RADIUS)


@query(f"SELECT venue_id, min({{'d': depth, 'c': cell}}).d AS depth, min({{'d': depth, 'c': cell}}).c AS cell FROM ({_FOUND}) GROUP BY venue_id", _levels())
def area_sweep(c):
    """The venues that a sweep of the area finds, each by its first circle."""
    return _swept(c)[0].withColumnRenamed("place_id", "venue_id")


@query(_SEARCHES, _levels())
def area_searches(c):
    """The searches that the sweep takes, level by level."""
    return _swept(c)[1]
