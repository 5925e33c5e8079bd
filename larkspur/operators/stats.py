"""Counts and statistics of suburbs, regions, weekdays and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, weekly


def ratio(a: Column, b: Column) -> Column:
    """a / b, null unless b is above 0."""
    return F.when(b > 0, a / b)


def popular_suburbs(suburbs: DataFrame, venues: DataFrame, deals: DataFrame) -> DataFrame:
    """Suburbs with approved deals: deals and venues with deals. Deals are summed by venue before they meet the rest."""
    by_venue = deals.filter(F.col("status") == "approved").groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    joined = by_venue.join(venues.select("venue_id", "suburb_id"), "venue_id").groupBy("suburb_id").agg(F.sum("n").alias("deal_count"), F.count(F.lit(1)).alias("venue_count"))
    return joined.join(suburbs.select("suburb_id", "suburb"), "suburb_id").orderBy(F.col("deal_count").desc(), "suburb", "suburb_id")


def suburb_counts(suburbs: DataFrame, venues: DataFrame, deals: DataFrame) -> DataFrame:
    """All suburbs with their numbers of venues and of the given deals; zeros are kept."""
    by_venue = deals.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n"))
    by_suburb = venues.select("venue_id", "suburb_id").join(by_venue, "venue_id", "left").groupBy("suburb_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deal_count"), F.count(F.lit(1)).alias("venue_count"), F.count("n").alias("venues_with_deals"))
    zeros = [F.coalesce(c, F.lit(0)).alias(c) for c in ("deal_count", "venue_count", "venues_with_deals")]
    return suburbs.join(by_suburb, "suburb_id", "left").select(*suburbs.columns, *zeros)


def suburb_statistics(counts: DataFrame) -> DataFrame:
    d, v, area, people = F.col("deal_count"), F.col("venue_count"), F.col("sqkm"), F.col("population")
    return counts.select(
        "suburb_id", "suburb", d, v, F.round(ratio(d, area), 6).alias("deals_per_sqkm"), F.round(ratio(v, area), 6).alias("venues_per_sqkm"),
        F.round(ratio(d * 1000.0, people), 6).alias("deals_per_1000"), F.round(ratio(v * 1000.0, people), 6).alias("venues_per_1000"),
    )


def hour_heat(schedules: DataFrame) -> DataFrame:
    """(day, hour, count) of schedules that cover the start of an hour from 12 to 23."""
    slots = schedules.groupBy("day", "start", "end").agg(F.count(F.lit(1)).alias("n"))
    return slots.select("day", "n", F.explode(weekly.covered_hours(F.col("start"), F.col("end"))).alias("hour")).groupBy("day", "hour").agg(F.sum("n").alias("count"))


def dense_heat(heat: DataFrame) -> DataFrame:
    """The whole grid of 7 x 12 cells with zeros, intensity sqrt(count / largest) and all largest cells marked."""
    grid = heat.sparkSession.range(84).select((F.floor(F.col("id") / 12) + 1).cast("int").alias("day"), (F.col("id") % 12 + 12).cast("int").alias("hour"))
    full = grid.join(F.broadcast(heat.filter(F.col("day").between(1, 7) & F.col("hour").between(12, 23))), ["day", "hour"], "left").select("day", "hour", F.coalesce("count", F.lit(0)).alias("count"))
    most = F.max("count").over(Window.partitionBy())
    return full.withColumn("intensity", F.round(F.when(most > 0, F.sqrt(F.col("count") / most)).otherwise(0.0), 6)).withColumn("peak", (most > 0) & (F.col("count") == most))


def region_frames(regions: DataFrame, suburbs: DataFrame, margin_km: float = 2.0) -> DataFrame:
    """Midpoint and area of each region's suburb centres; centres that are null, NaN or out of range don't count."""
    valid = suburbs.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180) & ~F.isnan("lat") & ~F.isnan("lng"))
    frame = valid.groupBy("region_id").agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lng").alias("w"), F.max("lng").alias("e"))
    lat, lng = (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2
    half = F.greatest((F.col("n") - F.col("s")) / 2 * geo.DEGREE_KM, (F.col("e") - F.col("w")) / 2 * geo.DEGREE_KM * F.cos(F.radians(lat))) + margin_km
    return regions.join(frame, "region_id").select("region_id", "region", F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"), F.round(F.pi() * half * half, 4).alias("sqkm"))


def first_in_group(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")
