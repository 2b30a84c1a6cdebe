"""Grid, distance and projection arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from climrisk.schemas import MESHES

# Kilometres per degree at the equator and along a meridian; mean Earth radius.
KM_PER_DEG_LON, KM_PER_DEG_LAT, EARTH_RADIUS_M = 111.320, 110.574, 6371008.8
# National transverse Mercator zone on the GRS80 ellipsoid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257222101
CENTRAL_MERIDIAN, SCALE, FALSE_EASTING = -84.0, 0.9999, 500000.0


def cell_centre(lon: Column, lat: Column, mesh: str = "power") -> tuple[Column, Column]:
    """Centre of the mesh cell holding a point, for meshes anchored at cell centres.

    Ties go to the even multiple, as the source's own rounding does.
    """
    dx, dy, anchor = MESHES[mesh]
    if anchor != "centre":
        raise ValueError(f"mesh {mesh!r} is anchored at cell edges")
    return F.bround(lon / dx) * dx, F.bround(lat / dy) * dy


def cell_number(lon: Column, lat: Column, mesh: str) -> tuple[Column, Column]:
    """Cell numbers counted from (-180, -90); edges round down, centres to the nearest."""
    dx, dy, anchor = MESHES[mesh]
    to_cell = F.floor if anchor == "edge" else F.bround
    x, y = to_cell((lon + 180) / dx), to_cell((lat + 90) / dy)
    return x.cast("int"), y.cast("int")


def crossing_right_of(x1, y1, x2, y2, px, py) -> Column:
    """Does an edge met by the line y = py cross it right of px?

    Decided by the sign of one cross product, so every caller asking about the same edge and
    point gets the same answer, whatever the rounding. A point on the edge counts as right of it.
    """
    turn = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    return (
        F.when(px >= F.greatest(x1, x2), False)
        .when(px < F.least(x1, x2), True)
        .otherwise(turn * (y2 - y1) > 0)
    )


def crossing_below(x1, y1, x2, y2, px, py) -> Column:
    """Does an edge met by the line x = px cross it at or below py? Same sign, same answer."""
    right = crossing_right_of(x1, y1, x2, y2, px, py)
    return (
        F.when(py >= F.greatest(y1, y2), True)
        .when(py < F.least(y1, y2), False)
        .when((x2 - x1) * (y2 - y1) > 0, right)
        .otherwise(~right)
    )


def haversine_m(lon1, lat1, lon2, lat2) -> Column:
    half = lambda a, b: F.sin(F.radians(b - a) / 2)
    h = F.pow(half(lat1, lat2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        half(lon1, lon2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(h))


def width_km(west: Column, east: Column, south: Column, north: Column) -> Column:
    return (east - west) * KM_PER_DEG_LON * F.cos(F.radians((south + north) / 2))


def height_km(south: Column, north: Column) -> Column:
    return (north - south) * KM_PER_DEG_LAT


def _mercator_constants() -> tuple[float, float, list[float]]:
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    return 2 * math.sqrt(n) / (1 + n), radius, alpha


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Easting and northing of the national zone (flattening series to the fourth order)."""
    e, radius, alpha = _mercator_constants()
    phi, lam = F.radians(lat), F.radians(lon - CENTRAL_MERIDIAN)
    sine = F.sin(phi)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, start=1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    k = SCALE * radius
    return k * east + FALSE_EASTING, k * north


def normalised_difference(a: Column, b: Column) -> Column:
    """Band index (a - b) / (a + b); NULL where the bands sum to zero."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))
