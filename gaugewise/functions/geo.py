"""Spherical geometry expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Great-circle distance in metres (SQL text)."""
    return (
        f"2 * {EARTH_RADIUS_M}D * asin(least(1D, sqrt("
        f"power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"power(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def chord(distance_m: float) -> float:
    """Straight-line distance on the unit sphere for a great-circle distance."""
    import math

    return 2 * math.sin(min(distance_m / EARTH_RADIUS_M, math.pi) / 2)


def with_unit_vector(points: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Adds ``_x, _y, _z`` on the unit sphere: no special cases at the poles or the antimeridian."""
    return points.selectExpr(
        "*",
        f"cos(radians({lat})) * cos(radians({lon})) AS _x",
        f"cos(radians({lat})) * sin(radians({lon})) AS _y",
        f"sin(radians({lat})) AS _z",
    )


def longitude_ranges(min_lon: float, max_lon: float) -> list[tuple[float, float]]:
    """Longitude ranges within [-180, 180] that a box covers, wherever its limits lie.

    A box is a start on the circle and a width; one that runs over the antimeridian is two ranges.
    """
    width = max_lon - min_lon
    if width >= 360:
        return [(-180.0, 180.0)]
    start = min_lon if -180 <= min_lon <= 180 else (min_lon + 180) % 360 - 180
    end = start + width
    return [(start, end)] if end <= 180 else [(start, 180.0), (-180.0, end - 360)]


def in_bbox(min_lat, min_lon, max_lat, max_lon, lon: str = "lon", lat: str = "lat"):
    """Inclusive bounding-box predicate; always true unless all four limits are set."""
    if None in (min_lat, min_lon, max_lat, max_lon):
        return F.lit(True)
    in_lon = F.lit(False)
    for low, high in longitude_ranges(float(min_lon), float(max_lon)):
        in_lon = in_lon | F.col(lon).between(low, high)
    return F.col(lat).between(float(min_lat), float(max_lat)) & in_lon
