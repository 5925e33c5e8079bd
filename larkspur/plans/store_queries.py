"""Queries that decide which row is meant, kept or shown: suburbs, contacts, pictures, sources, features, links, orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import links, text
from ..operators import resolve, sync
from .queries import query


def _places(c):
    k = F.col("c_custkey")
    name = F.when(k % 6 == 0, F.lit("Nowhere")).otherwise(F.upper("n_name"))
    code = F.when(k % 4 == 0, F.lit("0000")).when(k % 4 == 1, (2000 + (F.col("n_nationkey") + 3) % 25).cast("string")).when(k % 4 == 2, (2000 + F.col("n_nationkey")).cast("string"))
    nations = c.table("nation").select("n_nationkey", "n_name")
    state = F.when(k % 3 == 0, F.concat(F.lit("S"), (F.col("n_nationkey") % 3).cast("string")))
    return c.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("place_id"), name.alias("name"), code.alias("postcode"), state.alias("state"))


_PLACES = "place_ AS (SELECT c_custkey AS place_id, CASE WHEN c_custkey % 6 = 0 THEN 'Nowhere' ELSE upper(n_name) END AS name, CASE c_custkey % 4 WHEN 0 THEN '0000' WHEN 1 THEN (2000 + (n_nationkey + 3) % 25)::VARCHAR WHEN 2 THEN (2000 + n_nationkey)::VARCHAR END AS postcode, CASE WHEN c_custkey % 3 = 0 THEN 'S' || n_nationkey % 3 END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey), states_ AS (SELECT *, 'S' || suburb_id % 3 AS state FROM suburb_)"
_LADDER = "SELECT place_id, coalesce((SELECT min(suburb_id) FROM states_ s WHERE lower(s.suburb) = lower(p.name) AND s.postcode = p.postcode AND s.state = p.state), (SELECT min(suburb_id) FROM states_ s WHERE lower(s.suburb) = lower(p.name) AND s.postcode = p.postcode), (SELECT min(suburb_id) FROM states_ s WHERE lower(s.suburb) = lower(p.name) AND s.state = p.state), {0}, {1}) AS suburb_id FROM place_ p"
_NAME, _CODE = "(SELECT min(suburb_id) FROM states_ s WHERE lower(s.suburb) = lower(p.name))", "(SELECT min(suburb_id) FROM states_ s WHERE s.postcode = p.postcode)"


def _resolved(c, name_first):
    return resolve.resolve_suburbs(_places(c), c.suburb.withColumn("state", F.concat(F.lit("S"), (F.col("suburb_id") % 3).cast("string"))), name_first=name_first)


@query(_LADDER.format(_CODE, _NAME), _PLACES)
def resolve_suburbs(c):
    return _resolved(c, False)


@query(_LADDER.format(_NAME, _CODE), _PLACES)
def resolve_suburbs_by_name(c):
    return _resolved(c, True)


@query(
    "SELECT suburb_id, email FROM (SELECT *, row_number() OVER (PARTITION BY suburb_id ORDER BY score DESC, n DESC, email) AS r FROM (SELECT *, CASE WHEN email LIKE 'admin%' THEN 10 WHEN email LIKE 'manager%' THEN 7 WHEN email LIKE 'info%' OR email LIKE 'contact%' THEN 5 ELSE 0 END AS score FROM mail_ WHERE email NOT LIKE 'events%')) WHERE r = 1",
    "mail_ AS (SELECT suburb_id, ['events', 'info', 'contact', 'hello', 'manager', 'zoe'][(venue_id * 7 % 6 + 1)::INT] || (venue_id % 3) || '@a.example' AS email, count(*) AS n FROM venue_ WHERE venue_id % 6 < 4 GROUP BY ALL)",
)
def contact_emails(c):
    starts = F.array(*[F.lit(x) for x in ("events", "info", "contact", "hello", "manager", "zoe")])
    k = F.col("venue_id")
    email = F.concat(F.element_at(starts, ((k * 7) % 6 + 1).cast("int")), (k % 3).cast("string"), F.lit("@a.example"))
    found = c.venue.filter(k % 6 < 4).groupBy("suburb_id", email.alias("email")).agg(F.count(F.lit(1)).alias("n"))
    return resolve.contact_email(found, "suburb_id")


@query(
    "SELECT p_partkey, p_brand, round(score, 6) AS score, building > 0 OR score >= 0.3 AS usable, row_number() OVER (PARTITION BY p_brand ORDER BY (building > 0 OR score >= 0.3) DESC, score DESC, p_partkey)::INT AS rank FROM pic_",
    "pic_ AS (SELECT *, (least(w / h, 1.5) + 5 * greatest(0.2::DOUBLE - least(0.2::DOUBLE, c), 0) + building) / 3 AS score FROM (SELECT p_partkey, p_brand, p_size::DOUBLE AS w, (1 + p_partkey % 64)::DOUBLE AS h, (p_partkey % 32) / 128.0::DOUBLE AS c, CASE WHEN p_partkey % 5 = 0 THEN 0.5::DOUBLE ELSE 0 END AS building FROM part))",
)
def picture_ranks(c):
    k = F.col("p_partkey")
    rows = c.table("part").select("p_partkey", "p_brand", F.when(k % 5 == 0, 0.5).otherwise(0.0).alias("building"), resolve.picture_score(F.col("p_size").cast("double"), (1 + k % 64).cast("double"), (k % 32) / 128.0, F.when(k % 5 == 0, 0.5).otherwise(0.0)).alias("score"))
    return resolve.rank_pictures(rows, "p_brand", "p_partkey").select("p_partkey", "p_brand", F.round("score", 6).alias("score"), "usable", "rank")


def _links(c):
    # text of each pair of target and label, in the order of the page
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(links.ANCHOR), F.lit(1)).alias("h"), F.regexp_extract_all("html", F.lit(links.ANCHOR), F.lit(2)).alias("t"))
    rows = c.table("pages").select("page_id", F.col("url").alias("page"), F.posexplode(pairs).alias("place", "a"))
    label = F.trim(F.regexp_replace(F.regexp_replace("a.t", "<[^>]*>", " "), r"\s+", " "))
    return rows.select("page_id", "page", "place", links.resolve_url(F.col("a.h"), F.col("page")).alias("url"), label.alias("text")).filter("url IS NOT NULL")


_LINKS = (
    "a_ AS (SELECT page_id, page, unnest(range(len(h))) AS k, trim(unnest(h)) AS h, unnest(t) AS t FROM (SELECT page_id, url AS page, regexp_extract_all(html, '" + links.ANCHOR.replace("'", "''") + "', 1) AS h, regexp_extract_all(html, '" + links.ANCHOR.replace("'", "''") + "', 2) AS t FROM pages)), "
    "b_ AS (SELECT page_id, page, k, trim(regexp_replace(regexp_replace(t, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS t, CASE WHEN h = '' OR h[1] = '#' THEN NULL WHEN regexp_matches(h, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN h WHEN h[1] = '/' THEN regexp_extract(page, '^([a-zA-Z]+://[^/?#]*)', 1) || h ELSE regexp_extract(page, '^([a-zA-Z]+://[^?#]*/)', 1) || h END AS u FROM a_), "
    "link_ AS (SELECT page_id, page, k, t, lower(regexp_extract(u, '^(https?://[^/?#]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(u, '#.*$', ''), '^https?://[^/?]*([^?]*)', 1), '(.)/$', '\\1') || regexp_extract(regexp_replace(u, '#.*$', ''), '(\\?.*)$', 1) AS url FROM b_ WHERE regexp_matches(u, '^https?://'))"
)


@query("SELECT page_id, url, arg_min(t, k) AS text, min(k)::INT AS place FROM link_ GROUP BY ALL", _LINKS)
def resolved_links(c):
    """Each target once on a page, with the text of its first link."""
    return _links(c).groupBy("page_id", "url").agg(F.min_by("text", "place").alias("text"), F.min("place").alias("place"))


@query("SELECT page_id, arg_min(url, k) FILTER (regexp_extract(url, '^https?://(?:www\\.)?([^/?#]*)', 1) = regexp_extract(lower(page), '^https?://(?:www\\.)?([^/?#]*)', 1) AND regexp_matches(lower(t || ' ' || url), 'whats-on|what''s-on|what''s on|whats on|events|specials|promotions')) AS whats_on, arg_min(url, k) FILTER (regexp_matches(url, '^https?://[^/?#]*instagram\\.com')) AS instagram, arg_min(url, k) FILTER (regexp_matches(url, '^https?://[^/?#]*(facebook|fb)\\.com')) AS facebook FROM link_ GROUP BY page_id", _LINKS)
def venue_links(c):
    return resolve.venue_links(_links(c), "page_id", "page")


_SOURCES = "cur_ AS (SELECT o_custkey AS venue_id, 'u' || o_orderkey % 7 AS url, min('h' || o_orderkey % 11) AS content_hash, CASE WHEN o_custkey % 2 = 0 THEN 'new' ELSE 'rejected' END AS status, min(o_orderdate) AS date FROM orders WHERE o_orderkey % 3 = 0 GROUP BY ALL), inc_ AS (SELECT o_custkey AS venue_id, 'u' || o_orderkey % 7 AS url, CASE WHEN o_orderkey % 5 > 0 THEN 'h' || o_orderkey % 11 END AS content_hash, 'approved' AS status, o_orderdate AS date, o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 1), fresh_ AS (SELECT * FROM inc_ QUALIFY row_number() OVER (PARTITION BY venue_id, url ORDER BY k) = 1), kept_ AS (SELECT c.venue_id, c.url, coalesce(i.content_hash, c.content_hash) AS content_hash, CASE WHEN i.status = 'approved' AND c.status = 'new' THEN 'approved' ELSE c.status END AS status, coalesce(i.date, c.date) AS date FROM cur_ c LEFT JOIN fresh_ i USING (venue_id, url)), add_ AS (SELECT * FROM fresh_ f WHERE NOT EXISTS (SELECT 1 FROM cur_ c WHERE c.venue_id = f.venue_id AND c.url = f.url))"


@query("SELECT * FROM kept_ UNION ALL SELECT venue_id, url, content_hash, status, date FROM add_ WHERE content_hash IS NULL UNION ALL SELECT venue_id, url, content_hash, status, date FROM (SELECT * FROM add_ WHERE content_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY venue_id, content_hash ORDER BY k) = 1) a WHERE NOT EXISTS (SELECT 1 FROM (SELECT venue_id, content_hash FROM cur_ UNION ALL SELECT venue_id, content_hash FROM kept_) h WHERE h.venue_id = a.venue_id AND h.content_hash = a.content_hash)", _SOURCES)
def source_upsert(c):
    k = F.col("o_orderkey")
    rows = c.table("orders").select(F.col("o_custkey").alias("venue_id"), F.concat(F.lit("u"), (k % 7).cast("string")).alias("url"), F.concat(F.lit("h"), (k % 11).cast("string")).alias("content_hash"), F.col("o_orderdate").alias("date"), k.alias("k"))
    status = F.when(F.col("venue_id") % 2 == 0, "new").otherwise("rejected")
    current = rows.filter(F.col("k") % 3 == 0).groupBy("venue_id", "url").agg(F.min("content_hash").alias("content_hash"), F.min("date").alias("date")).withColumn("status", status)
    incoming = rows.filter(F.col("k") % 3 == 1).withColumn("content_hash", F.when(F.col("k") % 5 > 0, F.col("content_hash"))).withColumn("status", F.lit("approved"))
    return resolve.upsert_sources(current.select("venue_id", "url", "content_hash", "status", "date"), incoming, "k")


_FEATURES = "cat_ AS (SELECT DISTINCT p_brand AS feature FROM part), have_ AS (SELECT DISTINCT c_custkey AS venue_id, 'Brand#' || c_custkey % 5 AS feature FROM customer), want_ AS (SELECT c_custkey AS venue_id, ' BRAND#' || f AS feature FROM customer, unnest([c_custkey % 25, c_custkey % 40, 3]) u(f) WHERE c_custkey % 2 = 0), named_ AS (SELECT DISTINCT venue_id, c.feature FROM want_ w JOIN cat_ c ON lower(trim(w.feature)) = lower(c.feature))"


def _features(c):
    k = F.col("c_custkey")
    have = c.table("customer").select(k.alias("venue_id"), F.concat(F.lit("Brand#"), (k % 5).cast("string")).alias("feature")).distinct()
    wanted = c.table("customer").filter(k % 2 == 0).select(k.alias("venue_id"), F.explode(F.transform(F.array(k % 25, k % 40, F.lit(3).cast("long")), lambda f: F.concat(F.lit(" BRAND#"), f.cast("string")))).alias("feature"))
    return have, wanted, c.table("part").select(F.col("p_brand").alias("feature")).distinct()


@query("SELECT * FROM have_ WHERE venue_id % 2 = 1 UNION ALL SELECT * FROM named_", _FEATURES)
def features_replaced(c):
    return resolve.set_features(*_features(c))


@query("SELECT * FROM have_ UNION ALL SELECT * FROM named_ n WHERE NOT EXISTS (SELECT 1 FROM have_ h WHERE h.venue_id = n.venue_id AND lower(h.feature) = lower(n.feature))", _FEATURES)
def features_ensured(c):
    return resolve.set_features(*_features(c), keep=True)


@query("SELECT suburb_id, suburb FROM suburb_ s WHERE suburb_id % 3 = 0 OR EXISTS (SELECT 1 FROM venue_ v WHERE v.suburb_id = s.suburb_id AND rating > 9000)")
def suburbs_pruned(c):
    return sync.prune_childless(c.suburb.select("suburb_id", "suburb"), c.venue.filter("rating > 9000"), "suburb_id", F.col("suburb_id") % 3 == 0)


@query("SELECT venue_id, greatest(DATE '1995-01-01', max(start_date)) AS last_update FROM venue_ LEFT JOIN deal_ USING (venue_id) GROUP BY venue_id")
def venues_touched(c):
    venues = c.venue.select("venue_id", F.lit("1995-01-01").cast("date").alias("last_update"))
    return sync.touched(venues, c.deal.select("venue_id", F.col("start_date").alias("last_update")), "venue_id")


@query("SELECT deal_id, count(*) FILTER (day BETWEEN 1 AND 7 AND s BETWEEN 0 AND 1439 AND e BETWEEN 1 AND 1440) AS within_day, count(*) AS n FROM schedule_ GROUP BY deal_id")
def valid_schedules(c):
    ok = sync.valid_schedule(F.col("day"), F.col("start"), F.col("end")) & (F.col("end") <= 1440)
    return c.schedule.groupBy("deal_id").agg(F.count(F.when(ok, 1)).alias("within_day"), F.count(F.lit(1)).alias("n"))


@query("SELECT venue_id, deal_id, row_number() OVER (PARTITION BY venue_id ORDER BY start_date DESC, deal_id DESC)::INT AS place FROM deal_ WHERE status = 'new'")
def newest_first(c):
    """The review queue of each venue, newest first."""
    w = Window.partitionBy("venue_id").orderBy(F.col("start_date").desc(), F.col("deal_id").desc())
    return c.deal.filter("status = 'new'").select("venue_id", "deal_id", F.row_number().over(w).alias("place"))


@query("SELECT venue_id, suburb_id FROM (SELECT venue_id, suburb_id, row_number() OVER (PARTITION BY suburb_id ORDER BY last NULLS FIRST, venue_id) AS r FROM venue_ LEFT JOIN (SELECT venue_id, max(start_date) AS last FROM deal_ WHERE status = 'approved' GROUP BY 1) USING (venue_id)) WHERE r = 1")
def oldest_first(c):
    """The venue of each suburb to visit next: never visited ones first, then the longest ago."""
    last = c.deal.filter("status = 'approved'").groupBy("venue_id").agg(F.max("start_date").alias("last"))
    w = Window.partitionBy("suburb_id").orderBy(F.col("last").asc_nulls_first(), "venue_id")
    return c.venue.join(last, "venue_id", "left").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("venue_id", "suburb_id")


@query("SELECT page_id, CASE WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.pdf$') THEN 'pdf' WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(png|jpe?g|gif|webp|avif)$') OR contains(lower(url), 'image') THEN 'image' ELSE 'webpage' END AS kind, count(*) AS n FROM link_ GROUP BY ALL", _LINKS)
def link_kinds(c):
    return _links(c).groupBy("page_id", text.source_type(F.col("url")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
