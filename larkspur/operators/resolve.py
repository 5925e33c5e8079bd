"""Which row is meant or wanted: places by name and postcode, contacts, pictures, sources, features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links as L
from .sets import first_by

#: Starts of addresses that are no contact, and of better ones with their score. Fixed values.
NO_CONTACT = ("res.", "reservations", "catering", "events")
BETTER_CONTACT = {"admin": 10, "manager": 7, "info": 5, "contact": 5}
#: A page is its venue's programme if its link says so. Fixed values.
PROGRAMME = ("whats-on", "what's-on", "what's on", "whats on", "events", "specials", "promotions")
#: Sum of scores that a picture without a building needs. Fixed value.
LEAST_PICTURE = 0.3


def resolve_suburbs(places: DataFrame, suburbs: DataFrame, place_id: str = "place_id", name_first: bool = False) -> DataFrame:
    """(place_id, suburb_id): by name, postcode and state, else name and postcode, else name and state, else the postcode
    alone, and last the name alone; the least id of equal ones. ``name_first`` puts the name alone before the postcode.

    Names meet in any case. Two joins on equal keys, each reduced to one row before they meet.
    """
    by_name = places.withColumn("_n", F.lower(F.trim("name"))).alias("p").join(suburbs.withColumn("_n", F.lower(F.trim("suburb"))).alias("s"), "_n")
    code, state = F.col("p.postcode") == F.col("s.postcode"), F.col("p.state") == F.col("s.state")
    rank = F.when(code & state, 0).when(code, 1).when(state, 2).otherwise(3 if name_first else 5)
    named = by_name.groupBy(F.col(f"p.{place_id}").alias(place_id)).agg(F.min(F.struct(rank.alias("rank"), F.col("s.suburb_id").alias("suburb_id"))).alias("c"))
    # one suburb stands for a postcode, so the second join can't multiply rows
    codes = suburbs.filter(F.col("postcode").isNotNull()).groupBy("postcode").agg(F.min("suburb_id").alias("suburb_id"))
    coded = places.join(codes, "postcode").select(place_id, F.struct(F.lit(4).alias("rank"), "suburb_id").alias("c"))
    both = named.unionByName(coded).groupBy(place_id).agg(F.min("c")["suburb_id"].alias("suburb_id"))
    return places.select(place_id).distinct().join(both, place_id, "left")


def contact_email(found: DataFrame, key: str, email: str = "email", n: str = "n") -> DataFrame:
    """(key, email): by the score of how it starts, then how often it was found, then by name."""
    local = F.lower(F.substring_index(email, "@", 1))
    score = F.greatest(F.lit(0), *[F.when(local.startswith(p), v).otherwise(0) for p, v in BETTER_CONTACT.items()])
    usable = F.lit(True)
    for p in NO_CONTACT:
        usable = usable & ~local.startswith(p)
    return first_by(found.filter(usable).withColumn("_s", score), [key], F.col("_s").desc(), F.col(n).desc(), F.col(email)).select(key, email)


def picture_score(width: Column, height: Column, covered: Column, building: Column, name_score: Column | None = None) -> Column:
    """Wide pictures with little text and a building on them score high."""
    shape, text = F.least(width / height, F.lit(1.5)), 5 * F.greatest(F.lit(0.2) - F.least(F.lit(0.2), covered), F.lit(0.0))
    return (shape + text + building) / 3 + (F.lit(0.0) if name_score is None else name_score)


def rank_pictures(pictures: DataFrame, key: str, row_id: str) -> DataFrame:
    """``rank`` of each key's pictures by ``building`` and ``score``: usable ones first, then the best, then by id."""
    usable = (F.col("building") > 0) | (F.col("score") >= LEAST_PICTURE)
    return pictures.withColumn("usable", usable).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.col("usable").desc(), F.col("score").desc(), row_id)))


def venue_links(links: DataFrame, page_id: str, home: str) -> DataFrame:
    """(page_id, whats_on, instagram, facebook): the first of each by place among rows of (page_id, home, place, url, text)."""
    host = F.lower(F.regexp_extract("url", r"^(?i)https?://([^/?#]*)", 1))
    context, said = F.lower(F.concat_ws(" ", "text", "url")), F.lit(False)
    for word in PROGRAMME:
        said = said | context.contains(word)
    first = lambda when: F.min(F.when(when, F.struct("place", "url")))["url"]
    return links.groupBy(page_id).agg(
        first(L.same_origin(F.col("url"), F.col(home)) & said).alias("whats_on"),
        first(host.contains("instagram.com")).alias("instagram"),
        first(host.contains("facebook.com") | host.contains("fb.com")).alias("facebook"),
    )


def upsert_sources(current: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Sources (venue_id, url, content_hash, status, date) after a run.

    Known addresses take the new date and hash and are approved if they were new and come in approved. Of new ones with
    equal contents the first by ``order`` stays, and none whose contents its venue has; null contents are never equal.
    """
    keys = ["venue_id", "url"]
    fresh = first_by(incoming, keys, F.col(order))
    known = current.alias("c").join(fresh.alias("i"), keys, "left")
    status = F.when((F.col("i.status") == "approved") & (F.col("c.status") == "new"), "approved").otherwise(F.col("c.status"))
    kept = known.select(*keys, F.coalesce("i.content_hash", "c.content_hash").alias("content_hash"), status.alias("status"), F.coalesce("i.date", "c.date").alias("date"))
    added = fresh.join(current.select(*keys), keys, "left_anti")
    hashed = first_by(added.filter("content_hash IS NOT NULL"), ["venue_id", "content_hash"], F.col(order), F.col("url"))
    # what is known of a venue before or after this run
    had = current.unionByName(kept).filter("content_hash IS NOT NULL").select("venue_id", "content_hash").distinct()
    new = hashed.join(had, ["venue_id", "content_hash"], "left_anti").unionByName(added.filter("content_hash IS NULL"), allowMissingColumns=True)
    return kept.unionByName(new.select(*kept.columns))


def set_features(current: DataFrame, wanted: DataFrame, catalogue: DataFrame, keep: bool = False) -> DataFrame:
    """(venue_id, feature) after venues' features are replaced, or with ``keep`` added to: catalogue spelling, each once.

    Features that the catalogue lacks go; test for them with unknown_features().
    """
    spelt = catalogue.select(F.col("feature").alias("_f"), F.lower("feature").alias("_k"))
    named = wanted.withColumn("_k", F.lower(F.trim("feature"))).join(spelt, "_k").select("venue_id", F.col("_f").alias("feature")).distinct()
    if keep:
        have = current.select("venue_id", F.lower("feature").alias("_k"))
        new = named.withColumn("_k", F.lower("feature")).join(have, ["venue_id", "_k"], "left_anti").drop("_k")
        return current.unionByName(new)
    return current.join(wanted.select("venue_id").distinct(), "venue_id", "left_anti").unionByName(named)


def unknown_features(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of features that are not blank and that the catalogue lacks."""
    known = catalogue.select(F.lower("feature").alias("_k"))
    return wanted.filter(F.trim("feature") != "").withColumn("_k", F.lower(F.trim("feature"))).join(known, "_k", "left_anti").drop("_k")
