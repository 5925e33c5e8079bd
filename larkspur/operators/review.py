"""What people are asked to look at, and what is given to a reader: queues, pictures worth reading, sources to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import deal_text as T
from ..functions.parsing import _let

#: Least width and height of a picture, words in it, and sources that are read at once. Fixed values.
LEAST_PICTURE, LEAST_WORDS, MOST_SOURCES = (470, 500), 3, 30


def review_queues(venues: DataFrame, sources: DataFrame, deals: DataFrame, products: DataFrame, overlapping: DataFrame, long_hours: DataFrame) -> DataFrame:
    """(queue, id, venue_id) of venues that are not broken: new sources, new deals, approved deals without products, and deals
    to look at again, which are those that overlap, or if there are none at all those of long hours.

    ``venues`` (venue_id, status), ``sources`` (source_id, venue_id, status), ``deals`` (deal_id, venue_id, status); the others
    hold deal_id.
    """
    sound = venues.filter("status <> 'broken'").select("venue_id")
    of = lambda t, queue, key: t.join(sound, "venue_id", "left_semi").select(F.lit(queue).alias("queue"), F.col(key).alias("id"), "venue_id")
    bare = deals.filter("status = 'approved'").join(products.select("deal_id").distinct(), "deal_id", "left_anti")
    apart = of(deals.join(overlapping.select("deal_id").distinct(), "deal_id", "left_semi"), "deal_review", "deal_id")
    other = of(deals.join(long_hours.select("deal_id").distinct(), "deal_id", "left_semi"), "deal_review", "deal_id")
    # one row says whether there are overlapping ones
    any_ = apart.agg((F.count("*") > 0).alias("some"))
    instead = other.join(F.broadcast(any_.filter(~F.col("some"))))
    return of(sources.filter("status = 'new'"), "sources", "source_id").unionByName(of(deals.filter("status = 'new'"), "deals", "deal_id")).unionByName(of(bare, "deal_products", "deal_id")).unionByName(apart).unionByName(instead.drop("some"))


def readable_picture(width: Column, height: Column, lines: Column, deal_words: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """Whether a picture is large enough and its lines may be a deal: three words, a day, nothing of one date or an nth weekday."""
    large = (width >= LEAST_PICTURE[0]) & (height >= LEAST_PICTURE[1])
    text = F.array_join(lines, "\n")

    def read(t: Column) -> Column:
        words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        return ~T.nth_weekday(t) & ~T.has_date(t) & (F.size(words) >= LEAST_WORDS) & F.contains(F.lower(t), F.lit("day")) & T.is_deal(t, deal_words, excluded=excluded)

    return F.coalesce(large & _let(text, read), F.lit(False))


def materials(sources: DataFrame, order: str, most: int = MOST_SOURCES) -> DataFrame:
    """(venue_id, taken, failed, error) of each venue's first ``most`` sources (venue_id, error, and ``order``).

    Sources that can't be read are counted; the first one's error is the venue's only if none can be read.
    """
    place = F.row_number().over(Window.partitionBy("venue_id").orderBy(order))
    first = sources.withColumn("_k", place).filter(F.col("_k") <= most)
    failed = F.count_if(F.col("error").isNotNull())
    return first.groupBy("venue_id").agg(F.count("*").alias("taken"), failed.alias("failed"), F.when(failed == F.count("*"), F.min_by("error", "_k")).alias("error"))


def bounds_of(north: Column, south: Column, east: Column, west: Column) -> Column:
    """(state, north, south, east, west) of four parameters: none where all are missing, invalid where some are or they are no
    box, else given. A box has finite numbers in order and in range, and no antimeridian."""
    values = [F.trim(v).try_cast("double") for v in (north, south, east, west)]
    there = [v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) for v in values]
    n, s, e, w = values
    any_, every = there[0] | there[1] | there[2] | there[3], there[0] & there[1] & there[2] & there[3]
    box = every & (s < n) & (w < e) & (s >= -90) & (n <= 90) & (w >= -180) & (e <= 180)
    state = F.when(~any_, "none").when(F.coalesce(box, F.lit(False)), "given").otherwise("invalid")
    return _let(state, lambda t: F.struct(t.alias("state"), *[F.when(t == "given", v).alias(a) for v, a in zip(values, ("north", "south", "east", "west"), strict=True)]))
