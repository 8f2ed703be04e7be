"""Spherical geometry as column expressions. Angles in degrees, distances in metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three Earth radii are in use and stay apart.
MEAN_RADIUS = 6_371_008.8  # coverage tests and tour lengths
GRID_RADIUS = 6_371_000.0  # metres to degrees of candidate grids
MATRIX_RADIUS = 6_372_800.0  # rounded distance matrices
EQUATOR_RADIUS = 6_378_137.0  # areas, ellipsoid
POLAR_RADIUS = 6_356_752.314245179


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = MEAN_RADIUS) -> Column:
    """Great-circle distance."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.asin(F.least(F.lit(1.0), F.sqrt(a))) * F.lit(2.0 * radius)


def destination(lat: Column, lon: Column, bearing: Column, metres: Column, radius: float = MEAN_RADIUS) -> tuple[Column, Column]:
    """The point reached from (lat, lon) under a bearing: (lat, lon)."""
    d, b, p = metres / F.lit(radius), F.radians(bearing), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    east = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.degrees(q), F.degrees(F.radians(lon) + east)


def metres_to_degrees(lat: Column, metres: Column) -> Column:
    """The larger of the distance's latitude and longitude extents at a latitude."""
    deg = F.degrees(metres / F.lit(GRID_RADIUS))
    return F.greatest(deg, deg / F.cos(F.radians(lat)))


def midpoint(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Planar midpoint."""
    return (lat1 + lat2) / 2, (lon1 + lon2) / 2


def segment_distance(lat: Column, lon: Column, y1: Column, x1: Column, y2: Column, x2: Column) -> Column:
    """Metres from a point to a segment: planar foot on the segment, great-circle distance to it."""
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(((lon - x1) * dx + (lat - y1) * dy) / F.nullif(square, F.lit(0.0)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return haversine(lat, lon, y1 + t * dy, x1 + t * dx)


def ecef(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates on the WGS-84 ellipsoid at height zero."""
    a, b = EQUATOR_RADIUS, POLAR_RADIUS
    p, q = F.radians(lat), F.radians(lon)
    n = F.lit(a * a) / F.sqrt(F.lit(a * a) * F.cos(p) * F.cos(p) + F.lit(b * b) * F.sin(p) * F.sin(p))
    return n * F.cos(p) * F.cos(q), n * F.cos(p) * F.sin(q), n * F.lit(b * b / (a * a)) * F.sin(p)


def ray_crosses(lat: Column, lon: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether the eastward ray from a point crosses an edge; half-open in latitude."""
    return ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1)


def ring_area_term(x0: Column, x2: Column, y1: Column) -> Column:
    """A vertex's share of the spherical ring area: neighbours' longitudes and its own latitude."""
    return F.radians(x2 - x0) * F.sin(F.radians(y1)) * F.lit(EQUATOR_RADIUS * EQUATOR_RADIUS / 2)


def cos_deg(x: float) -> float:
    return math.cos(math.radians(x))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """x, y and z on the unit sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)
