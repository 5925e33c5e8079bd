"""Walks over links in rounds: the crawl frontier of many sites at once, and nested site maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .sets import first_by

#: Pages of a site, and of one that several venues share; fetches of a site's maps. Fixed values.
PAGES, SHARED_PAGES, MAPS = 20, 1, 50


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """The pages that a breadth-first walk of each site visits: (site, url, depth, visit, identity, duplicate).

    ``seeds`` (site, url, place, budget) start the queues in the order of place, ``pages`` (url, identity) can be
    loaded, ``links`` (url, place, target) lead on. A site stops after ``budget`` visits, of which those that can't be
    loaded (identity null) and those whose identity was seen before (duplicate) count, but aren't followed.

    All sites go one step at a time. A queue that is served in order visits level by level, so a round is: the links of
    the last level, each target at its first place, without those visited, as many as the budget leaves. A round is a
    stored table; there are as many as the deepest site has levels, at most its budget. Only pages that are visited join
    with links, so nothing grows with links between pages that no site reaches. Ties in place go to the smaller url.
    """
    queued = seeds.groupBy("site", "url").agg(F.min("place").alias("place"), F.max("budget").alias("budget"))
    front = queued.select("site", "url", "budget", F.lit(0).alias("depth"), F.struct(F.lit(0).alias("visit"), F.col("place").cast("long").alias("place")).alias("found"), F.lit(0).alias("before"))
    visited: list[DataFrame] = []
    while True:
        in_order = Window.partitionBy("site").orderBy("found", "url")
        level = front.withColumn("visit", F.col("before") + F.row_number().over(in_order)).filter(F.col("visit") <= F.col("budget"))
        loaded = level.join(pages.groupBy("url").agg(F.min("identity").alias("identity")), "url", "left")
        again = F.row_number().over(Window.partitionBy("site", "identity").orderBy("visit")) > 1
        if visited:
            known = reduce(DataFrame.unionByName, (v.filter(F.col("identity").isNotNull() & ~F.col("duplicate")).select("site", "identity", F.lit(True).alias("seen")) for v in visited))
            loaded = loaded.join(known, ["site", "identity"], "left")
            again = again | F.col("seen").isNotNull()
        upto = F.max("visit").over(Window.partitionBy("site"))
        level = stored(loaded.select("site", "url", "budget", "depth", "visit", "identity", (F.col("identity").isNotNull() & again).alias("duplicate"), upto.alias("upto")), "crawl-level")
        visited.append(level)
        follow = level.filter(F.col("identity").isNotNull() & ~F.col("duplicate") & (F.col("upto") < F.col("budget")))
        ahead = follow.join(links.select("url", F.col("place").cast("long").alias("place"), "target"), "url")
        ahead = ahead.groupBy("site", F.col("target").alias("url")).agg(
            F.min(F.struct("visit", "place")).alias("found"), F.max("budget").alias("budget"), F.max("upto").alias("before"), (F.max("depth") + 1).alias("depth"),
        )
        front = reduce(lambda f, v: f.join(v.select("site", "url"), ["site", "url"], "left_anti"), visited, ahead)
        if follow.isEmpty() or (front := stored(front, "crawl-front")).isEmpty():
            return reduce(DataFrame.unionByName, visited).select("site", "url", "depth", "visit", "identity", "duplicate")


def site_map_leaves(roots: DataFrame, maps: DataFrame, most: int = MAPS) -> DataFrame:
    """(site, url, depth, visit) of what a site's maps list and is no map itself, each once at its first place.

    ``roots`` (site, url) are the first maps; ``maps`` (url, place, target, is_map) hold what each lists. Maps are opened
    breadth first, ``most`` for each site, and a map that can't be found counts; visit is the number of the map.
    """
    seeds = roots.select("site", "url", F.lit(0).alias("place"), F.lit(most).alias("budget"))
    opened = crawl(seeds, maps.select("url", F.col("url").alias("identity")).distinct(), maps.filter("is_map").select("url", "place", "target"))
    listed = opened.join(maps.filter("NOT is_map").select("url", "place", "target"), "url")
    return first_by(listed, ["site", "target"], F.col("visit"), F.col("place")).select("site", F.col("target").alias("url"), "depth", "visit", "place")
