"""Catalogues of places kept up to date: merged with another source, seeded, replaced, set where empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km
from .sets import first_by, nearest_of_name

#: Places of one name are the same within this distance. Fixed value.
SAME_KM = 50.0


def merge_places(catalogue: DataFrame, places: DataFrame, area: str = "area") -> tuple[DataFrame, DataFrame]:
    """(catalogue, outcome) after places of another source: each enriches the nearest row of its name, or is added.

    ``catalogue`` (row_id, name, postcode, lat, lng, area) and ``places`` (place_id, name, lat, lng, area). A row that has
    no area takes that of the first place that meets it. Places that are near none of their name's rows are added without
    a postcode, the first of each name alone; others of that name enrich it if they are near it, and are skipped if not.
    So the result does not hang on the order of the rows, but on place_id. Outcomes are matched, added and skipped.
    """
    key = F.lower(F.trim("name"))
    rows, named = catalogue.withColumn("_n", key), places.withColumn("_n", key)
    usable = rows.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & ~F.isnan("lat") & ~F.isnan("lng"))
    others = usable.select("_n", F.col("row_id").alias("other_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    km = lambda: great_circle_km(F.col("lat"), F.col("lng"), F.col("other_lat"), F.col("other_lng"))
    near = nearest_of_name(named, others, "_n", km(), SAME_KM, "place_id").select("place_id", "other_id", F.col(area).alias("given"))
    lost = named.join(near.select("place_id"), "place_id", "left_anti")
    blank = rows.filter("postcode IS NULL").select("_n").distinct()  # a row without a postcode that is far away takes the name
    free = lost.join(blank, "_n", "left_anti")
    first = first_by(free, ["_n"], F.col("place_id"))
    firsts = first.select("_n", F.col("place_id").alias("first_id"), F.col("lat").alias("other_lat"), F.col("lng").alias("other_lng"))
    later = free.join(firsts, "_n").filter("place_id <> first_id")
    joined = later.filter(km() <= SAME_KM)
    areas = near.filter("given IS NOT NULL").groupBy("other_id").agg(F.min_by("given", "place_id").alias("given"))
    kept = rows.join(areas, F.col("row_id") == F.col("other_id"), "left").select("name", "postcode", "lat", "lng", F.coalesce(area, "given").alias(area))
    more = joined.filter(F.col(area).isNotNull()).groupBy("first_id").agg(F.min_by(area, "place_id").alias("given"))
    added = first.join(more, F.col("place_id") == F.col("first_id"), "left").select("name", F.lit(None).cast("string").alias("postcode"), "lat", "lng", F.coalesce(area, "given").alias(area))
    label = lambda t, s: t.select("place_id", F.lit(s).alias("outcome"))
    matched = label(near, "matched").unionByName(label(joined, "matched"))
    outcome = matched.unionByName(label(first, "added"))
    return kept.unionByName(added), outcome.unionByName(label(places.join(outcome.select("place_id"), "place_id", "left_anti"), "skipped"))


def seeded(current: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """The rows, and those seeds whose key, in any case, they lack."""
    have = current.select(F.lower(key).alias("_k"))
    return current.unionByName(seeds.withColumn("_k", F.lower(key)).join(have, "_k", "left_anti").drop("_k"))


def replace_deals(venues: DataFrame, deals: DataFrame, children: dict[str, DataFrame], of_venues: DataFrame, given: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(venues, deals, children) once the venues in ``of_venues`` have the given deals in place of all that they had.

    Children of deals that go, by deal_id, go too; venues take ``at`` as their last_update. Venues that are given none
    lose all of theirs; deals given for other venues are not taken.
    """
    meant = of_venues.select("venue_id").distinct()
    stay = deals.join(meant, "venue_id", "left_anti")
    gone = deals.join(meant, "venue_id", "left_semi").select("deal_id")
    touched = venues.join(meant.withColumn("_t", F.lit(True)), "venue_id", "left").withColumn("last_update", F.when(F.col("_t"), at).otherwise(F.col("last_update"))).drop("_t")
    return touched, stay.unionByName(given.join(meant, "venue_id", "left_semi")), {name: t.join(gone, "deal_id", "left_anti") for name, t in children.items()}


def set_if_empty(rows: DataFrame, key: str, column: str, given: DataFrame) -> DataFrame:
    """Rows whose column is null or blank take the given value of their key, unless that is blank too."""
    value = given.groupBy(key).agg(F.min(F.nullif(F.trim(column), F.lit(""))).alias("_v"))
    return rows.join(value, key, "left").withColumn(column, F.coalesce(F.nullif(F.trim(column), F.lit("")), "_v")).drop("_v")
