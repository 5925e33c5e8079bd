"""Distances, boxes and radii as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres of a degree of latitude, as box filters count them.
DEGREE_KM = 111.0
#: Steps that a search radius snaps to. Fixed values.
RADIUS_LADDER = (2, 5, 10, 15, 20, 25, 35, 50, 75, 100)


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines; null if a coordinate is null."""
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    cosine = F.cos(a) * F.cos(b) * F.cos(turn) + F.sin(a) * F.sin(b)
    return F.when(cosine.isNotNull(), EARTH_KM * F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def box(lat: float, lng: float, km: float) -> tuple[float, float, float, float] | None:
    """(north, south, east, west) of a box around a point, within the poles and +-180; None for no valid point."""
    if not all(map(math.isfinite, (lat, lng, km))) or km <= 0 or abs(lat) > 90 or abs(lng) > 180:
        return None
    up = km / DEGREE_KM
    side = km / (DEGREE_KM * max(0.01, math.cos(math.radians(lat))))
    return min(90.0, lat + up), max(-90.0, lat - up), min(180.0, lng + side), max(-180.0, lng - side)


def valid_bounds(north: float, south: float, east: float, west: float) -> bool:
    """Finite, ordered, in range and without the antimeridian."""
    return all(map(math.isfinite, (north, south, east, west))) and south < north and west < east and -90 <= south and north <= 90 and -180 <= west and east <= 180


def in_bounds(lat: Column, lng: Column, north: float, south: float, east: float, west: float) -> Column:
    """Inclusive ranges, which reach the Parquet scan."""
    return lat.between(south, north) & lng.between(west, east)


def near(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """Within ``km`` of a point; the box comes first, as the optimizer can't derive it from the distance."""
    around = box(at_lat, at_lng, km * 1.01)
    exact = great_circle_km(lat, lng, F.lit(at_lat), F.lit(at_lng)) <= km
    return exact if around is None else in_bounds(lat, lng, *around) & exact


def suburb_radius_km(sqkm: Column, override: Column | None = None) -> Column:
    """An override above 0, else the radius of a circle of that area and half a kilometre."""
    own = F.sqrt(F.greatest(F.coalesce(sqkm, F.lit(0.0)), F.lit(0.0)) / math.pi) + 0.5
    return own if override is None else F.when(override > 0, override).otherwise(own)


def region_radius_km(sqkm: Column) -> Column:
    return F.when(sqkm > 0, F.sqrt(sqkm / math.pi)).otherwise(F.lit(0.0))


def snap_radius(km: Column) -> Column:
    """The first step of the ladder that is not below; null beyond the last."""
    return F.array_min(F.filter(F.array(*[F.lit(x) for x in RADIUS_LADDER]), lambda x: x >= km))


def distance_label(km: Column) -> Column:
    metres = F.greatest(F.lit(1), F.round(km * 1000)).cast("int")
    return F.when(km < 1, F.concat(metres.cast("string"), F.lit(" m"))).when(km < 10, F.format_string("%.1f km", km)).otherwise(F.format_string("%.0f km", km))
