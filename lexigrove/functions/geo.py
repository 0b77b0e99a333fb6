"""Distances on the sphere, and boxes around circles."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS = 6_371_008.77
MAX_RADIUS = 40_000_000.0


def distance(lat: Column, lng: Column, lat0: float, lng0: float) -> Column:
    """Metres from a point by the haversine formula; null for a null location."""
    a = F.radians(lat)
    d_lat, d_lng = a - math.radians(lat0), F.radians(lng) - math.radians(lng0)
    h = F.pow(F.sin(d_lat / 2), 2) + F.cos(a) * math.cos(math.radians(lat0)) * F.pow(F.sin(d_lng / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def bounds(lat: float, lng: float, radius: float) -> tuple[float, float, float, float]:
    """(north, east, south, west) of a box that holds the circle; all longitudes if it reaches a pole or the date line."""
    if radius > MAX_RADIUS:
        raise ValueError("A radius cannot be more than 40 000 km.")
    angle = math.degrees(radius / EARTH_RADIUS) * (1 + 1e-9) + 1e-9
    north, south = min(90.0, lat + angle), max(-90.0, lat - angle)
    if north >= 90.0 or south <= -90.0 or angle >= 90.0:
        return north, 180.0, south, -180.0
    half = math.degrees(math.asin(min(1.0, math.sin(math.radians(angle)) / math.cos(math.radians(lat))))) + 1e-9
    if lng - half < -180.0 or lng + half > 180.0:
        return north, 180.0, south, -180.0
    return north, lng + half, south, lng - half


def within_box(lat: Column, lng: Column, north: float, east: float, south: float, west: float) -> Column:
    """Whether a location lies in the box; a box whose west lies east of its east holds nothing, a null location is in none."""
    return F.coalesce(lat.between(south, north) & lng.between(west, east), F.lit(False))


def within_radius(lat: Column, lng: Column, lat0: float, lng0: float, radius: float) -> Column:
    """Whether a location is at most radius metres away; plain comparisons with the circle's box go first, for pruning."""
    return within_box(lat, lng, *bounds(lat0, lng0, radius)) & F.coalesce(distance(lat, lng, lat0, lng0) <= radius, F.lit(False))
