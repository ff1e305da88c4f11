"""Distance, grid cells and boxes as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Miles.
EARTH_RADIUS = 3958.8
MILES_PER_DEGREE = 69.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def cell(lat: Column, lon: Column) -> Column:
    """The 0.1 degree grid cell of a point."""
    return (F.floor((lat + 90) * 10) * 3600 + F.floor((lon + 180) * 10)).cast("long")


def box(lat: float, lon: float, miles: float) -> tuple[float, float, float, float]:
    """South, west, north, east of a box that holds the circle."""
    dlat = miles / MILES_PER_DEGREE
    dlon = miles / (MILES_PER_DEGREE * max(0.01, math.cos(math.radians(lat))))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def within(lat: Column, lon: Column, at: tuple[float, float], miles: float) -> Column:
    """Box first (it reaches the scan), then the exact distance."""
    south, west, north, east = box(*at, miles)
    return lat.between(south, north) & lon.between(west, east) & (haversine(F.lit(at[0]), F.lit(at[1]), lat, lon) <= miles)
