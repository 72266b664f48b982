"""Coordinate systems 4326, 3857 and UTM (326zz north, 327zz south) as column expressions.

Web Mercator is the spherical closed form; UTM is the Krueger series to fourth order in the third
flattening, which is accurate to well below a millimetre inside a zone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 semi-major axis and flattening, UTM scale and false origin.
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0

_N = WGS84_F / (2.0 - WGS84_F)
_ECC = math.sqrt(WGS84_F * (2.0 - WGS84_F))
_RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger coefficients, forward (conformal -> rectifying) and back.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
# Conformal latitude -> geodetic latitude series.
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def is_supported(srid: int) -> bool:
    return srid in (4326, 3857) or _utm_zone(srid) is not None


def _utm_zone(srid: int) -> tuple[int, bool] | None:
    """(zone, southern) for a UTM srid, else None."""
    for base, southern in ((32600, False), (32700, True)):
        if 1 <= srid - base <= 60:
            return srid - base, southern
    return None


class Numpy:
    """The functions that projections need, on arrays."""

    sin, cos, tan, sinh, cosh, exp, log, sqrt = np.sin, np.cos, np.tan, np.sinh, np.cosh, np.exp, np.log, np.sqrt
    asin, atan, atan2, atanh, radians, degrees = np.arcsin, np.arctan, np.arctan2, np.arctanh, np.radians, np.degrees


def _mercator_from_degrees(lon, lat, m: Any) -> tuple:
    x = m.radians(lon) * WGS84_A
    y = m.log(m.tan(math.pi / 4 + m.radians(lat) / 2)) * WGS84_A
    return x, y


def _degrees_from_mercator(x, y, m: Any) -> tuple:
    lon = m.degrees(x / WGS84_A)
    lat = m.degrees(m.atan(m.exp(y / WGS84_A)) * 2 - math.pi / 2)
    return lon, lat


def _central_meridian(zone: int) -> float:
    return zone * 6.0 - 183.0


def _utm_from_degrees(lon, lat, zone: int, southern: bool, m: Any) -> tuple:
    lam = m.radians(lon - _central_meridian(zone))
    sin_lat = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(sin_lat) - m.atanh(sin_lat * _ECC) * _ECC)
    xi = m.atan2(t, m.cos(lam))
    eta = m.atanh(m.sin(lam) / m.sqrt(t * t + 1))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
        north = north + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
    shift = UTM_FALSE_NORTHING_SOUTH if southern else 0.0
    return (
        east * (UTM_SCALE * _RECTIFYING) + UTM_FALSE_EASTING,
        north * (UTM_SCALE * _RECTIFYING) + shift,
    )


def _degrees_from_utm(x, y, zone: int, southern: bool, m: Any) -> tuple:
    shift = UTM_FALSE_NORTHING_SOUTH if southern else 0.0
    xi = (y - shift) / (UTM_SCALE * _RECTIFYING)
    eta = (x - UTM_FALSE_EASTING) / (UTM_SCALE * _RECTIFYING)
    xi_c, eta_c = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi_c = xi_c - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        eta_c = eta_c - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    chi = m.asin(m.sin(xi_c) / m.cosh(eta_c))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + m.sin(chi * (2 * j)) * d
    lon = m.degrees(m.atan2(m.sinh(eta_c), m.cos(xi_c))) + _central_meridian(zone)
    return lon, m.degrees(lat)


def transformer(source: int, target: int, m: Any = F) -> Callable[[Any, Any], tuple]:
    """Function (x, y) -> (x, y) from one srid to another; geographic pairs are (lon, lat).

    ``m`` does the mathematics: Spark's functions on columns, or ``Numpy`` on arrays.
    """
    for srid in (source, target):
        if not is_supported(srid):
            raise ValueError(f"unsupported srid {srid}; use 4326, 3857 or UTM 326zz / 327zz")

    def to_degrees(x: Any, y: Any) -> tuple:
        if source == 4326:
            return x, y
        if source == 3857:
            return _degrees_from_mercator(x, y, m)
        return _degrees_from_utm(x, y, *_utm_zone(source), m)

    def from_degrees(lon: Any, lat: Any) -> tuple:
        if target == 4326:
            return lon, lat
        if target == 3857:
            return _mercator_from_degrees(lon, lat, m)
        return _utm_from_degrees(lon, lat, *_utm_zone(target), m)

    if source == target:
        return lambda x, y: (x, y)
    return lambda x, y: from_degrees(*to_degrees(x, y))


def reproject_geometry(geom: Column, source: int, target: int) -> Column:
    """Reproject every vertex of a polygon array column."""
    if source == target:
        return geom
    move = transformer(source, target)

    def vertex(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(geom, lambda poly: F.transform(poly, lambda ring: F.transform(ring, vertex)))
