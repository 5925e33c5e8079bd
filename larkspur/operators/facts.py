"""Facts of a region for its page: winners, shares of weekdays, coverage, bars and all its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .apportion import largest_remainder

#: Winners of a list, and icons of the longest bar. Fixed values.
TOP, ICONS = 5, 12


def winners(statistics: DataFrame, region: str = "region_id") -> DataFrame:
    """(region, metric, place, suburb_id, value): the densest suburb, the most deals by people and by number, and the top list.

    ``statistics`` has suburb, deal_count, sqkm and population. The top list is by density, or by deals where no suburb of
    the region has an area. Ties go by name.
    """
    deals, area, people = F.col("deal_count"), F.col("sqkm"), F.col("population")
    metrics = [("density", F.when(area > 0, deals / area), 1), ("per_thousand", F.when(people > 0, deals * 1000.0 / people), 1), ("deals", F.when(deals > 0, deals.cast("double")), 1), ("top_density", F.when(area > 0, deals / area), TOP), ("top_deals", F.when(deals > 0, deals.cast("double")), TOP)]
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(n).alias("most")) for m, v, n in metrics])).alias("x")
    rows = statistics.select(region, "suburb_id", "suburb", each).select(region, "suburb_id", "suburb", "x.*").filter("value IS NOT NULL")
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(region, "metric").orderBy(F.col("value").desc(), "suburb", "suburb_id"))).filter(F.col("place") <= F.col("most"))
    dense = placed.filter("metric = 'top_density'").select(region).distinct().withColumn("dense", F.lit(True))
    kept = placed.join(dense, region, "left").filter((F.col("metric") != "top_deals") | F.col("dense").isNull())
    return kept.select(region, "metric", "place", "suburb_id", "value")


def weekday_shares(counts: DataFrame, key: str) -> DataFrame:
    """(key, day, n, percent): all seven days of each key, percentages that add up to 100; ties go to the smaller day.

    Days outside 1 to 7 don't count; a key with no others has seven zeros.
    """
    days = counts.select(key).distinct().withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(7))))
    summed = counts.filter(F.col("day").between(1, 7)).groupBy(key, "day").agg(F.sum("n").alias("n"))
    dense = days.join(summed, [key, "day"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return largest_remainder(dense, "n", F.col("day"), [key])


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * part / whole))).otherwise(0.0)


def coverage_triad(counts: DataFrame, region: str = "region_id") -> DataFrame:
    """(region, ring, part, whole, percent): suburbs with venues, suburbs with deals, venues with deals."""
    v = F.coalesce(F.sum("venue_count"), F.lit(0))
    sums = counts.groupBy(region).agg(F.count("*").alias("suburbs"), F.count_if(F.col("venue_count") > 0).alias("a"), F.count_if(F.col("deal_count") > 0).alias("b"), F.least(F.coalesce(F.sum("venues_with_deals"), F.lit(0)), v).alias("c"), v.alias("venues"))
    rings = [("suburbs_with_venues", "a", "suburbs"), ("suburbs_with_deals", "b", "suburbs"), ("venues_with_deals", "c", "venues")]
    each = F.array(*[F.struct(F.lit(name).alias("ring"), F.col(part).alias("part"), F.col(whole).alias("whole"), percent_of(F.col(part), F.col(whole)).alias("percent")) for name, part, whole in rings])
    return sums.select(region, F.inline(each))


def bars(counts: DataFrame, key: str, name: str, most: int = TOP) -> DataFrame:
    """(key, name, n, place, width, icons) of each key's largest counts: width in percent of the largest, icons at least one."""
    placed = counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), name))).filter(F.col("place") <= most)
    width = percent_of(F.col("n"), F.max("n").over(Window.partitionBy(key)))
    icons = F.when(F.col("width") > 0, F.greatest(F.lit(1), F.floor(F.col("width") / 100 * ICONS + 0.5))).otherwise(0).cast("int")
    return placed.withColumn("width", width).withColumn("icons", icons).select(key, name, "n", "place", "width", "icons")


def region_counts(suburbs: DataFrame, venues: DataFrame, sources: DataFrame, deals: DataFrame) -> DataFrame:
    """Eleven counts of each region: suburbs and crawled ones, venues by state, venues with sources, sources and deals by status.

    ``suburbs`` (region_id, suburb_id, crawled), ``venues`` (venue_id, suburb_id, status, crawled, website), ``sources`` and
    ``deals`` (venue_id, status). Sources and deals are counted by venue before they meet the rest.
    """
    by = lambda t, s, a: t.groupBy("venue_id").agg(F.count("*").alias(a), F.count_if(F.col("status") == s).alias(f"{a}_{s}"))
    at = venues.join(by(sources, "approved", "sources"), "venue_id", "left").join(by(deals, "approved", "deals"), "venue_id", "left")
    sound = F.col("status") != "broken"
    per_suburb = at.groupBy("suburb_id").agg(
        F.count("*").alias("venues"), F.count_if(sound).alias("sound_venues"), F.count_if(~sound).alias("broken_venues"), F.count_if(sound & F.col("website").isNotNull()).alias("ready_venues"), F.count_if(sound & F.col("crawled")).alias("crawled_venues"),
        F.count_if(F.col("sources_approved") > 0).alias("venues_with_sources"), F.count_if(F.col("deals") > 0).alias("extracted_venues"), F.sum("sources").alias("sources"), F.sum("deals_approved").alias("approved_deals"),
    )
    names = [c for c in per_suburb.columns if c != "suburb_id"]
    return suburbs.join(per_suburb, "suburb_id", "left").groupBy("region_id").agg(F.count("*").alias("suburbs"), F.count_if("crawled").alias("crawled_suburbs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
