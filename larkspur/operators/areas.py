"""Sweeps of an area by overlapping circles, cut into four where one holds more than a search gives."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import great_circle_km
from ..sources.stored import stored

#: Places that a search gives at most, how far apart circles are in radii, and how often one is cut. Fixed values.
MOST, OVERLAP, DEPTH = 20, 0.7, 3
METRES_PER_DEGREE = 111_320.0


def grid(spark: SparkSession, south: float, west: float, north: float, east: float, radius: float) -> DataFrame:
    """Circles (cell, lat, lng, radius) whose middles are OVERLAP radii apart, from half a step within the corner on."""
    if not (south < north and west < east and radius > 0):
        return spark.createDataFrame([], "cell string, lat double, lng double, radius double")
    up = radius * OVERLAP / METRES_PER_DEGREE
    right = radius * OVERLAP / (METRES_PER_DEGREE * math.cos(math.radians((south + north) / 2)))
    rows, columns = (math.floor((b - a) / step + 1e-9) + 1 for a, b, step in ((south, north, up), (west, east, right)))
    made = spark.range(rows * columns).select((F.col("id") / columns).cast("int").alias("i"), (F.col("id") % columns).cast("int").alias("j"))
    return made.select(F.concat_ws(".", "i", "j").alias("cell"), (south + up / 2 + F.col("i") * up).alias("lat"), (west + right / 2 + F.col("j") * right).alias("lng"), F.lit(float(radius)).alias("radius"))


def quarters(cells: DataFrame) -> DataFrame:
    """The four circles of half the radius within each one, north-east, north-west, south-east, south-west."""
    off = F.col("radius") * OVERLAP / 2 / METRES_PER_DEGREE
    across = off / F.cos(F.radians("lat"))
    four = F.array(*[F.struct(F.concat("cell", F.lit(f"/{k}")).alias("cell"), (F.col("lat") + a * off).alias("lat"), (F.col("lng") + b * across).alias("lng"), (F.col("radius") / 2).alias("radius")) for k, (a, b) in enumerate(((1, 1), (1, -1), (-1, 1), (-1, -1)))])
    return cells.select(F.inline(four))


def _within(cells: DataFrame, places: DataFrame, size: float, km: Column) -> DataFrame:
    """(cell, place_id, km) of places within each circle; both meet in squares of a circle's size, never all with all."""
    step_lat = 1.01 * size / METRES_PER_DEGREE  # a little more than the radius, as degrees are counted a little long
    row = lambda lat: F.floor(lat / step_lat)
    # a row of squares has its own width, by the latitude nearer to the equator, so that three columns cover a circle
    width = lambda r: F.lit(step_lat) / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.greatest(F.abs(r), F.abs(r + 1)) * step_lat, F.lit(89.0)))))
    there = places.withColumn("sq_row", row(F.col("place_lat"))).withColumn("sq_col", F.floor(F.col("place_lng") / width(F.col("sq_row"))))
    near = F.sequence(F.lit(-1), F.lit(1))
    here = cells.withColumn("sq_row", F.explode(F.transform(near, lambda d: row(F.col("lat")) + d))).withColumn("sq_col", F.explode(F.transform(near, lambda d: F.floor(F.col("lng") / width(F.col("sq_row"))) + d)))
    return here.join(there, ["sq_row", "sq_col"]).withColumn("km", km).filter(F.col("km") * 1000 <= F.col("radius")).select("cell", "place_id", "km")


def sweep(cells: DataFrame, places: DataFrame, radius: float, most: int = MOST, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(places found, searches): (place_id, depth, cell) of each place at its first level and cell, and (cell, depth, found, saturated).

    A search gives the ``most`` nearest places of its circle, ties by id. A circle that gives as many is cut into four,
    level by level, ``depth`` times at most; those of the last level that still give as many are saturated. Each level is
    a stored table.
    """
    at = places.select("place_id", F.col("lat").alias("place_lat"), F.col("lng").alias("place_lng"))
    km = great_circle_km(F.col("lat"), F.col("lng"), F.col("place_lat"), F.col("place_lng"))
    searches, hits = None, None
    for level in range(depth + 1):
        nearest = F.row_number().over(Window.partitionBy("cell").orderBy("km", "place_id"))
        inside = stored(_within(cells, at, radius / 2**level, km).withColumn("n", nearest).filter(F.col("n") <= most).select("cell", "place_id"), "sweep-places")
        done = stored(cells.join(inside.groupBy("cell").agg(F.count("*").cast("int").alias("found")), "cell", "left").withColumn("found", F.coalesce("found", F.lit(0))), "sweep-level")
        full = F.col("found") >= most
        here = done.select("cell", F.lit(level).alias("depth"), "found", (full & F.lit(level == depth)).alias("saturated"))
        got = inside.select("place_id", F.lit(level).alias("depth"), "cell")
        searches, hits = (here, got) if searches is None else (searches.unionByName(here), hits.unionByName(got))
        over = done.filter(full).select("cell", "lat", "lng", "radius")
        if level == depth or over.isEmpty():
            break
        cells = stored(quarters(over), "sweep-cells")
    return hits.groupBy("place_id").agg(F.min(F.struct("depth", "cell")).alias("first")).select("place_id", "first.depth", "first.cell"), searches
