"""Spherical geometry as column expressions (degrees in, metres and degrees out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_378_137.0


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance (haversine)."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lng = F.sin(F.radians(lng2 - lng1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lng * half_lng
    # clamped for antipodes; least() would turn a NULL into 1
    return F.lit(2.0 * radius) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))


def heading_deg(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial heading from the first point to the second, in [-180, 180)."""
    d_lng = F.radians(lng2 - lng1)
    p1, p2 = F.radians(lat1), F.radians(lat2)
    deg = F.degrees(F.atan2(F.sin(d_lng) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d_lng)))
    return F.when(deg >= 180, deg - 360).otherwise(deg)


def side_heading_deg(heading: Column) -> Column:
    """Heading turned to the side of the line, kept in [-180, 180)."""
    return F.pmod(heading + F.lit(450.0), F.lit(360.0)) - F.lit(180.0)


def destination(lat: Column, lng: Column, metres: Column | float, heading: Column, radius: float = EARTH_RADIUS_M) -> tuple[Column, Column]:
    """Point reached from ``(lat, lng)`` after ``metres`` along ``heading``."""
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    d, h, p = metres / F.lit(radius), F.radians(heading), F.radians(lat)
    sin_to = F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(h)
    d_lng = F.atan2(F.sin(h) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * sin_to)
    return F.degrees(F.asin(sin_to)), lng + F.degrees(d_lng)


def midpoint(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> tuple[Column, Column]:
    """Point half way along the great circle between two points."""
    p1, p2, d_lng = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    bx, by = F.cos(p2) * F.cos(d_lng), F.cos(p2) * F.sin(d_lng)
    across = F.sqrt((F.cos(p1) + bx) * (F.cos(p1) + bx) + by * by)
    return (
        F.degrees(F.atan2(F.sin(p1) + F.sin(p2), across)),
        lng1 + F.degrees(F.atan2(by, F.cos(p1) + bx)),
    )


def line_middle(points: Column) -> Column:
    """Half-way point of a two-point line, else the middle vertex."""
    a, b = points[0], points[1]
    lat, lng = midpoint(a["latitude"], a["longitude"], b["latitude"], b["longitude"])
    vertex = points[F.floor(F.size(points) / 2).cast("int")]
    return F.when(F.size(points) == 2, F.struct(lat.alias("latitude"), lng.alias("longitude"))).otherwise(
        F.struct(vertex["latitude"].alias("latitude"), vertex["longitude"].alias("longitude"))
    )


def path_length_m(points: Column, radius: float = EARTH_RADIUS_M) -> Column:
    """Length of an array of ``{latitude, longitude}``; 0 when it has fewer than two points."""
    steps = F.zip_with(
        F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0))),
        F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))),
        lambda a, b: distance_m(a["latitude"], a["longitude"], b["latitude"], b["longitude"], radius),
    )
    return F.when(F.size(points) < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def sql_distance(lat1: str, lng1: str, lat2: str, lng2: str, radius: float = EARTH_RADIUS_M) -> str:
    """The same distance as SQL text, for checks in another engine."""
    return (
        f"(2 * {radius} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))))"
    )
