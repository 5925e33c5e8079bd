"""Site maps as files of XML, written with an index over them and read back, nested ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Addresses of a file at most, by the protocol. Fixed values.
MOST = 50_000
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n'


def _written(entries: DataFrame, tag: str, fields: list[str]) -> DataFrame:
    """(url, xml) of files from (url, loc, ...): each file's entries in the order of loc, below ``tag``."""
    inner = {"urlset": "url", "sitemapindex": "sitemap"}[tag]
    one = F.to_xml(F.struct(*fields), {"rowTag": inner})
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("loc", one.alias("x")))), lambda e: e["x"]), "\n")
    return entries.groupBy("url").agg(F.concat(F.lit(f'{HEADER}<{tag} xmlns="{NAMESPACE}">\n'), body, F.lit(f"\n</{tag}>")).alias("xml"))


def write_site_maps(entries: DataFrame, folder: str, most: int = MOST) -> DataFrame:
    """(url, xml) of site maps below ``folder`` for entries (loc, lastmod, changefreq, priority), and of index.xml over them.

    Entries are dealt by a hash of loc, so that a file changes only with its own; a file holds ``most`` at most. An empty
    table gives an index without files. An index is one file and lists up to ``most`` others.
    """
    parts = max(1, -(-entries.count() * 5 // (4 * most)))
    dealt = entries.withColumn("part", F.pmod(F.xxhash64("loc"), F.lit(parts)))
    place = F.row_number().over(Window.partitionBy("part").orderBy("loc"))
    filed = dealt.withColumn("url", F.concat(F.lit(folder.rstrip("/") + "/"), "part", F.lit("-"), F.floor((place - 1) / most), F.lit(".xml")))
    files = _written(filed, "urlset", ["loc", "lastmod", "changefreq", "priority"])
    index = filed.groupBy(F.col("url").alias("loc")).agg(F.max("lastmod").alias("lastmod")).withColumn("url", F.lit(folder.rstrip("/") + "/index.xml"))
    listed = _written(index, "sitemapindex", ["loc", "lastmod"])
    empty = entries.sparkSession.range(1).select(F.lit(folder.rstrip("/") + "/index.xml").alias("url"), F.lit(f'{HEADER}<sitemapindex xmlns="{NAMESPACE}">\n</sitemapindex>').alias("xml"))
    return files.unionByName(listed).unionByName(empty.join(listed, "url", "left_anti"))


def read_site_maps(files: DataFrame) -> DataFrame:
    """(url, place, target, is_map) of what files (url, xml) list; what can't be read, or lists nothing, has no rows.

    Entries of an index are maps, and so are addresses that end in .xml.
    """
    one = "array<struct<loc:string>>"
    found = F.when(F.col("xml").contains("<sitemapindex"), F.struct(F.lit(True).alias("index"), F.from_xml("xml", f"sitemap {one}", {"mode": "PERMISSIVE"})["sitemap"].alias("e")))
    found = found.otherwise(F.struct(F.lit(False).alias("index"), F.from_xml("xml", f"url {one}", {"mode": "PERMISSIVE"})["url"].alias("e")))
    each = files.select("url", found.alias("f")).select("url", "f.index", F.posexplode("f.e").alias("place", "e"))
    target = F.trim("e.loc")
    return each.select("url", "place", target.alias("target"), (F.col("index") | F.lower(F.regexp_replace(target, "[?#].*$", "")).endswith(".xml")).alias("is_map")).filter("target <> ''")
