"""WGS84 to and from the British National Grid: Helmert shift and Transverse Mercator, in numpy batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Airy 1830 and GRS80 axes, the grid's scale and origin, and the shift from WGS84 (metres, arc seconds, parts per million).
AIRY, GRS80 = (6377563.396, 6356256.909), (6378137.0, 6356752.314140)
F0, LAT0, LON0, E0, N0 = 0.9996012717, np.radians(49.0), np.radians(-2.0), 400000.0, -100000.0
SHIFT, TURN, SCALE = np.array([-446.448, 125.157, -542.060]), np.radians(np.array([-0.1502, -0.2470, -0.8421]) / 3600), 20.4894e-6
_M = np.array([[1 + SCALE, -TURN[2], TURN[1]], [TURN[2], 1 + SCALE, -TURN[0]], [-TURN[1], TURN[0], 1 + SCALE]])


def _cartesian(lat, lon, axes):
    a, b = axes
    e2 = 1 - (b / a) ** 2
    nu = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    return np.array([nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), (1 - e2) * nu * np.sin(lat)])


def _geodetic(xyz, axes):
    a, b = axes
    e2 = 1 - (b / a) ** 2
    x, y, z = xyz
    p = np.hypot(x, y)
    lat = np.arctan2(z, p * (1 - e2))
    for _ in range(4):
        nu = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(z + e2 * nu * np.sin(lat), p)
    return lat, np.arctan2(y, x)


def _arc(lat):
    a, b = AIRY
    n = (a - b) / (a + b)
    d, s = lat - LAT0, lat + LAT0
    terms = (1 + n + 1.25 * n**2 + 1.25 * n**3) * d - (3 * n + 3 * n**2 + 2.625 * n**3) * np.sin(d) * np.cos(s)
    return b * F0 * (terms + (1.875 * n**2 + 1.875 * n**3) * np.sin(2 * d) * np.cos(2 * s) - 35 / 24 * n**3 * np.sin(3 * d) * np.cos(3 * s))


def _radii(lat):
    a, b = AIRY
    e2 = 1 - (b / a) ** 2
    w = 1 - e2 * np.sin(lat) ** 2
    nu = a * F0 / np.sqrt(w)
    rho = a * F0 * (1 - e2) / w**1.5
    return nu, rho, nu / rho - 1


def to_grid(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eastings and northings in metres; NaN in, NaN out."""
    lat, lon = _geodetic(_M @ _cartesian(np.radians(lat), np.radians(lon), GRS80) + SHIFT[:, None], AIRY)
    nu, rho, eta2 = _radii(lat)
    s, c, t = np.sin(lat), np.cos(lat), np.tan(lat)
    d = lon - LON0
    n = _arc(lat) + N0 + nu / 2 * s * c * d**2 + nu / 24 * s * c**3 * (5 - t**2 + 9 * eta2) * d**4 + nu / 720 * s * c**5 * (61 - 58 * t**2 + t**4) * d**6
    e = E0 + nu * c * d + nu / 6 * c**3 * (nu / rho - t**2) * d**3 + nu / 120 * c**5 * (5 - 18 * t**2 + t**4 + 14 * eta2 - 58 * t**2 * eta2) * d**5
    return e, n


def from_grid(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longitudes and latitudes in degrees; a second pass takes off what the first, by series, is out by."""
    there = to_grid(*_inverse(e, n))
    return _inverse(2 * e - there[0], 2 * n - there[1])


def _inverse(e: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lat = LAT0 + (n - N0) / (AIRY[0] * F0)
    for _ in range(6):
        lat = lat + (n - N0 - _arc(lat)) / (AIRY[0] * F0)
    nu, rho, eta2 = _radii(lat)
    t, sec, x = np.tan(lat), 1 / np.cos(lat), e - E0
    out_lat = lat - t / (2 * rho * nu) * x**2 + t / (24 * rho * nu**3) * (5 + 3 * t**2 + eta2 - 9 * t**2 * eta2) * x**4 - t / (720 * rho * nu**5) * (61 + 90 * t**2 + 45 * t**4) * x**6
    out_lon = LON0 + sec / nu * x - sec / (6 * nu**3) * (nu / rho + 2 * t**2) * x**3 + sec / (120 * nu**5) * (5 + 28 * t**2 + 24 * t**4) * x**5 - sec / (5040 * nu**7) * (61 + 662 * t**2 + 1320 * t**4 + 720 * t**6) * x**7
    lat, lon = _geodetic(np.linalg.solve(_M, _cartesian(out_lat, out_lon, AIRY) - SHIFT[:, None]), GRS80)
    return np.degrees(lon), np.degrees(lat)


_GRID = T.StructType([T.StructField("e", T.DoubleType()), T.StructField("n", T.DoubleType())])
_DEGREES = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])


@F.pandas_udf(_GRID)
def to_bng(lon: pd.Series, lat: pd.Series) -> pd.DataFrame:
    e, n = to_grid(lon.to_numpy(float), lat.to_numpy(float))
    return pd.DataFrame({"e": e, "n": n})


@F.pandas_udf(_DEGREES)
def to_wgs84(e: pd.Series, n: pd.Series) -> pd.DataFrame:
    lon, lat = from_grid(e.to_numpy(float), n.to_numpy(float))
    return pd.DataFrame({"lon": lon, "lat": lat})


def in_gb(lon: Column, lat: Column) -> Column:
    """Inside the box that the grid covers, edges included."""
    return lon.between(-9.0, 2.5) & lat.between(49.5, 61.5)
