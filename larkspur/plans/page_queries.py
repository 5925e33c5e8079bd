"""Queries over pages and what they hold: crawl frontiers, site maps, content blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import links, text
from ..operators import blocks, copies, crawl
from .queries import query
from .store_queries import _LINKS, _links

_HOST = r"^https?://([^/?#]*)"


def _walk(seeds: str, pages: str, links: str, out: str) -> tuple[str, str]:
    """SQL that walks site by site with lists as queues; the tables are (site, url, place, budget), (url, identity), (url, place, target)."""
    ctes = (
        f"seed_ AS MATERIALIZED ({seeds}), page_ AS MATERIALIZED ({pages}), go_ AS MATERIALIZED ({links}), "
        "start_ AS (SELECT site, max(budget) AS budget, list(url ORDER BY place, url) AS q FROM (SELECT site, url, min(place) AS place, max(budget) AS budget FROM seed_ GROUP BY ALL) GROUP BY site)"
    )
    step = """
WITH RECURSIVE walk AS (
  SELECT site, budget, 0 AS depth, q[1:budget] AS visited, []::VARCHAR[] AS idents, q[1:budget] AS front FROM start_
  UNION ALL
  SELECT site, budget, depth + 1, list_concat(visited, new), list_concat(idents, ids), new FROM (
    SELECT site, any_value(budget) AS budget, any_value(depth) AS depth, any_value(visited) AS visited, any_value(idents) AS idents, list_distinct(flatten(list(ids))) AS ids,
      coalesce(list(target ORDER BY o, target) FILTER (target IS NOT NULL AND NOT list_contains(visited, target)), [])[1:any_value(budget) - len(any_value(visited))] AS new
    FROM (
      SELECT site, b.budget, depth, visited, idents, list(DISTINCT identity) AS ids, target, min({'k': k, 'p': place}) AS o FROM (
        SELECT f.*, identity FROM (SELECT *, unnest(front) AS u, unnest(range(len(front))) AS k FROM walk) f JOIN page_ p ON p.url = u WHERE NOT list_contains(idents, identity)
        QUALIFY row_number() OVER (PARTITION BY site, identity ORDER BY k) = 1
      ) b LEFT JOIN go_ ON go_.url = u GROUP BY ALL
    ) GROUP BY site
  ) WHERE len(new) > 0
)"""
    return ctes, f"SELECT * FROM ({step} {out})"


_PAGE_CTES, _PAGE_SQL = _walk(
    "SELECT site, url, CASE WHEN page_id = least_ THEN -1 ELSE page_id END AS place, CASE WHEN site LIKE 'www.%' THEN 1 ELSE 20 END AS budget FROM (SELECT *, min(page_id) OVER (PARTITION BY site) AS least_ FROM known_) WHERE page_id = least_ OR page_id % 2 = 0",
    "SELECT url, min(identity) AS identity FROM known_ GROUP BY url",
    "SELECT k.url, l.k AS place, l.url AS target FROM link_ l JOIN known_ k USING (page_id) WHERE regexp_extract(l.url, '^https?://(?:www\\.)?([^/?#]*)', 1) = regexp_extract(k.url, '^https?://(?:www\\.)?([^/?#]*)', 1)",
    "SELECT site, depth, u AS url, (len(visited) - len(front) + k + 1)::INT AS visit FROM (SELECT *, unnest(front) AS u, unnest(range(len(front))) AS k FROM walk)",
)
_KNOWN = "known_ AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS site, url, regexp_replace(url, '\\?.*$', '') AS identity FROM (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_replace(regexp_extract(regexp_replace(url, '#.*$', ''), '^https?://[^/?]*([^?]*)', 1), '(.)/$', '\\1') || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS url FROM pages))"


@query(_PAGE_SQL, f"{_LINKS}, {_KNOWN}, {_PAGE_CTES}")
def crawl_pages(c):
    """Each host's walk from its first page and the even ones, over links within the host; one page of shared hosts.

    Pages that differ by their query alone are one page to the walk.
    """
    known = c.table("pages").select("page_id", text.normalise_url(F.col("url")).alias("url"))
    known = known.withColumn("site", F.regexp_extract("url", _HOST, 1)).withColumn("identity", F.regexp_replace("url", r"\?.*$", ""))
    first = known.groupBy("site").agg(F.min("page_id").alias("least"))
    seeds = known.join(first, "site").filter("page_id = least OR page_id % 2 = 0")
    seeds = seeds.select("site", "url", F.when(F.col("page_id") == F.col("least"), -1).otherwise(F.col("page_id")).alias("place"), F.when(F.col("site").startswith("www."), crawl.SHARED_PAGES).otherwise(crawl.PAGES).alias("budget"))
    ahead = _links(c).withColumnRenamed("url", "target").withColumn("url", text.normalise_url(F.col("page")))
    ahead = ahead.filter(links.same_origin(F.col("target"), F.col("url"))).select("url", "place", "target")
    return crawl.crawl(seeds, known.select("url", "identity"), ahead).select("site", "depth", "url", "visit")


_PART_CTES, _PART_SQL = _walk(
    "SELECT l_suppkey::VARCHAR AS site, 'p' || l_partkey AS url, min(l_orderkey) AS place, (3 + l_suppkey % 18)::INT AS budget FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 40 = 0 GROUP BY ALL",
    "SELECT 'p' || p_partkey AS url, 'i' || p_partkey // 2 AS identity FROM part WHERE p_partkey % 7 > 0",
    "SELECT 'p' || a.l_partkey AS url, min(a.l_orderkey * 10 + a.l_linenumber) AS place, 'p' || b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY ALL",
    "SELECT site, depth, u AS url, (len(visited) - len(front) + k + 1)::INT AS visit FROM (SELECT *, unnest(front) AS u, unnest(range(len(front))) AS k FROM walk)",
)


@query(_PART_SQL, _PART_CTES)
def crawl_parts(c):
    """The same walk where it goes deep: parts are pages, and each line of an order links to the next one's part."""
    lines = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit("p"), "l_partkey").alias("url"))
    seeds = lines.filter("l_linenumber = 1 AND l_orderkey % 40 = 0").select(F.col("l_suppkey").cast("string").alias("site"), "url", F.col("l_orderkey").alias("place"), (3 + F.col("l_suppkey") % 18).cast("int").alias("budget"))
    k = F.col("p_partkey")
    pages = c.table("part").filter(k % 7 > 0).select(F.concat(F.lit("p"), k).alias("url"), F.concat(F.lit("i"), (k / 2).cast("long")).alias("identity"))
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("url").alias("target"))
    ahead = lines.join(after, ["l_orderkey", "l_linenumber"]).groupBy("url", "target").agg(F.min(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return crawl.crawl(seeds, pages, ahead).select("site", "depth", "url", "visit")


@query()
def content_blocks(c):
    """Every page's blocks; SQL has no element tree, so written pages are held against them in the tests."""
    made = blocks.content_blocks(c.table("pages"))
    return made.select("page_id", "block", "title", "text", F.size("links").alias("n_links"))


_PICTURES = """
pic_ AS (SELECT id, (id * 37) % 101 AS area, v FROM (
  SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT vec_id + 1000000, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.02::DOUBLE * ((i - 1 + vec_id) % 3 - 1)) FROM embeddings WHERE vec_id % 3 = 0
  UNION ALL SELECT vec_id + 2000000, list_transform(embedding::DOUBLE[], lambda x, i: x + 0.03::DOUBLE * ((i - 1) % 3 - 1)) FROM embeddings WHERE vec_id % 9 = 0
  UNION ALL SELECT vec_id + 3000000, embedding::DOUBLE[] FROM embeddings WHERE vec_id % 5 = 0)),
rank_ AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY area DESC, id) AS k FROM pic_),
near_ AS MATERIALIZED (SELECT a.k, list(b.k ORDER BY b.k) AS before FROM rank_ a JOIN rank_ b ON b.k < a.k AND list_distance(a.v, b.v) <= 0.35 GROUP BY a.k),
all_ AS MATERIALIZED (SELECT rank_.k, id, coalesce(before, []) AS before FROM rank_ LEFT JOIN near_ ON near_.k = rank_.k)"""


@query(
    "SELECT * FROM (WITH RECURSIVE pick AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS at UNION ALL SELECT all_.k, CASE WHEN len(list_intersect(before, kept)) = 0 THEN list_append(kept, all_.k) ELSE kept END, coalesce(list_min(list_intersect(before, kept)), all_.k) FROM pick JOIN all_ ON all_.k = pick.k + 1) SELECT r.id, w.id AS keeper FROM pick JOIN rank_ r ON r.k = pick.k JOIN rank_ w ON w.k = pick.at)",
    _PICTURES,
)
def picture_copies(c):
    """Embeddings as pictures, with changed and equal copies of some: which one each is kept as."""
    base = c.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    shifted = lambda by, turn: F.transform("vector", lambda x, i: x + F.lit(by) * ((i + turn) % 3 - 1))
    rows = base.unionByName(base.filter("id % 3 = 0").select((F.col("id") + 1000000).alias("id"), shifted(0.02, F.col("id")).alias("vector")))
    rows = rows.unionByName(base.filter("id % 9 = 0").select((F.col("id") + 2000000).alias("id"), shifted(0.03, F.lit(0)).alias("vector")))
    rows = rows.unionByName(base.filter("id % 5 = 0").select((F.col("id") + 3000000).alias("id"), "vector"))
    return copies.best_copies(rows.withColumn("area", (F.col("id") * 37) % 101))
