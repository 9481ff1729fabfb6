"""Geometry as Column expressions: haversine, unit-sphere grid keys, offsets,
bearings, compass directions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadpulse.constants import COMPASS, EARTH_RADIUS_KM, METERS_PER_DEGREE_LAT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, R = 6371 km."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def unit_xyz(lat, lon) -> tuple[Column, Column, Column]:
    """Point on the unit sphere."""
    la, lo = F.radians(_c(lat)), F.radians(_c(lon))
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def chord_for_km(d_km: float) -> float:
    """Chord length on the unit sphere of a great-circle distance."""
    return 2.0 * math.sin(min(d_km / (2.0 * EARTH_RADIUS_KM), math.pi / 2))



def grid_cell(lat, lon, cell: float) -> tuple[Column, Column, Column]:
    """C4: integer cell of the unit-sphere point at cube edge ``cell``.
    Two points within great-circle ``d`` have chord <= chord_for_km(d), so at
    ``cell = chord_for_km(d)`` they are in the same or adjacent cells."""
    x, y, z = unit_xyz(lat, lon)
    return tuple(F.floor(v / F.lit(cell)).cast("long") for v in (x, y, z))


def neighbour_offsets() -> Column:
    """The 27 (dx, dy, dz) offsets of a cell and its neighbours, as an array
    literal to ``explode`` (one SQL expression: cheap to build)."""
    items = ", ".join(f"named_struct('dx', {dx}L, 'dy', {dy}L, 'dz', {dz}L)"
                      for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1))
    return F.expr(f"array({items})")


def offset_point(lat, lon, distance_m, bearing_deg) -> tuple[Column, Column]:
    """Flat-earth move by metres along a compass bearing."""
    b = F.radians(_c(bearing_deg))
    d = _c(distance_m)
    dlat = d * F.cos(b) / F.lit(METERS_PER_DEGREE_LAT)
    dlon = d * F.sin(b) / (F.lit(METERS_PER_DEGREE_LAT) * F.cos(F.radians(_c(lat))))
    return _c(lat) + dlat, _c(lon) + dlon


def bearing_between(lat1, lon1, lat2, lon2) -> Column:
    """C11: initial bearing 0-360 from point 1 to point 2."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlon = F.radians(_c(lon2) - _c(lon1))
    x = F.sin(dlon) * F.cos(p2)
    y = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(x, y)) + F.lit(360.0), F.lit(360.0))


def compass_dir(bearing) -> Column:
    """8-way compass name, ``int((b + 22.5) / 45) % 8``."""
    idx = F.pmod((( _c(bearing) + F.lit(22.5)) / F.lit(45.0)).cast("int"), F.lit(8))
    return F.element_at(F.array(*[F.lit(c) for c in COMPASS]), idx + 1)
