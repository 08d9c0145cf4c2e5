"""WGS84 to UTM north and back, after Snyder (1987), as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING, SCALE, FALSE_EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)


def zone_of(epsg: int) -> int:
    """The zone of EPSG:326zz; anything else is refused."""
    if not 32601 <= epsg <= 32660:
        raise ValueError(f"EPSG:{epsg} is not a northern UTM zone")
    return epsg - 32600


def _meridian(phi: Column) -> Column:
    e4, e6 = E2 * E2, E2**3
    return A * (
        (1 - E2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi
        - (3 * E2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi)
        - (35 * e6 / 3072) * F.sin(6 * phi)
    )


def to_utm(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon - (zone_of(epsg) * 6 - 183))
    n = A / F.sqrt(1 - E2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, EP2 * F.cos(phi) ** 2, lam * F.cos(phi)
    x = FALSE_EASTING + SCALE * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * EP2) * a**5 / 120)
    y = SCALE * (_meridian(phi) + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * EP2) * a**6 / 720))
    return x, y


def from_utm(x: Column, y: Column, epsg: int) -> tuple[Column, Column]:
    e1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
    mu = y / SCALE / (A * (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256))
    phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + (151 * e1**3 / 96) * F.sin(6 * mu) + (1097 * e1**4 / 512) * F.sin(8 * mu)
    s2 = F.sin(phi) ** 2
    n, r = A / F.sqrt(1 - E2 * s2), A * (1 - E2) / (1 - E2 * s2) ** 1.5
    t, c, d = F.tan(phi) ** 2, EP2 * F.cos(phi) ** 2, (x - FALSE_EASTING) / (n * SCALE)
    lat = phi - n * F.tan(phi) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * EP2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * EP2 - 3 * c * c) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * EP2 + 24 * t * t) * d**5 / 120) / F.cos(phi)
    return F.degrees(lon) + (zone_of(epsg) * 6 - 183), F.degrees(lat)
