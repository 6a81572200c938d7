"""Distances, projections and the cells used as equi-join keys."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tremorframe.constants import EARTH_RADIUS_KM, MERCATOR_RADIUS_M


def haversine_term(rise: Column, turn: Column, cos1: Column, cos2: Column) -> Column:
    """sin^2 of half the central angle, from coordinate differences in degrees and latitude cosines."""
    half_lat, half_lon = F.sin(F.radians(rise) / 2), F.sin(F.radians(turn) / 2)
    return half_lat * half_lat + cos1 * cos2 * half_lon * half_lon


def haversine_limit(km: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """The term at a distance: a pair is within ``km`` when its term is not larger."""
    half = F.sin(km / F.lit(2.0 * radius_km))
    return half * half


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                 radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; the square-root argument is kept at or below one."""
    a = haversine_term(lat2 - lat1, lon2 - lon1, F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    return F.lit(2.0 * radius_km) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def east_km(lat0: Column, lon0: Column, lon: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    """Local tangent-plane x; plain longitude difference, no wrap at the date line."""
    return F.lit(radius_km) * F.cos(F.radians(lat0)) * (F.radians(lon) - F.radians(lon0))


def north_km(lat0: Column, lat: Column, radius_km: float = EARTH_RADIUS_KM) -> Column:
    return F.lit(radius_km) * (F.radians(lat) - F.radians(lat0))


def mercator_x_m(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lon)


def mercator_y_m(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def point_segment_m(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment (a degenerate segment is a point)."""
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    along = F.when(squared > 0, ((px - ax) * dx + (py - ay) * dy) / squared).otherwise(F.lit(0.0))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex, ey = px - (ax + along * dx), py - (ay + along * dy)
    return F.sqrt(ex * ex + ey * ey)


class CellGrid:
    """Latitude bands split into longitude cells about as wide as the search radius.

    A band is one radius high. The number of cells in a band shrinks with the cosine
    of its pole-side edge, so a cell is never narrower than the radius and bands at the
    poles are one ring. Cells wrap at the date line.
    """

    def __init__(self, radius_km: float, earth_radius_km: float = EARTH_RADIUS_KM):
        self.angle = radius_km / earth_radius_km
        self.height = min(180.0, math.degrees(self.angle) * (1 + 1e-9))

    def band(self, lat: Column) -> Column:
        return F.floor((lat + F.lit(90.0)) / F.lit(self.height)).cast("int")

    def _pole_side_cos(self, band: Column) -> Column:
        south = band * F.lit(self.height) - F.lit(90.0)
        edge = F.greatest(F.abs(south), F.abs(south + F.lit(self.height)))
        return F.cos(F.radians(F.least(edge, F.lit(90.0))))

    def ring_size(self, band: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(F.lit(360.0 / self.height) * self._pole_side_cos(band)).cast("int"))

    def cell(self, lon: Column, ring: Column) -> Column:
        turned = F.pmod(lon + F.lit(180.0), F.lit(360.0)) / F.lit(360.0)
        return F.least(ring - 1, F.floor(turned * ring).cast("int"))

    def bands_near(self, lat: Column) -> Column:
        return F.sequence(self.band(lat - F.lit(self.height)), self.band(lat + F.lit(self.height)))

    def cells_near(self, lat: Column, lon: Column, band: Column, ring: Column) -> Column:
        """Every cell of ``band`` that can hold a point within the radius of (lat, lon)."""
        denominator = F.sqrt(F.greatest(F.lit(0.0), F.cos(F.radians(lat)) * self._pole_side_cos(band)))
        ratio = F.lit(math.sin(min(self.angle, math.pi) / 2)) / F.greatest(denominator, F.lit(1e-12))
        reach = F.degrees(2 * F.asin(F.least(F.lit(1.0), ratio))) * F.lit(1 + 1e-9)
        first = F.floor((lon - reach + 180.0) / 360.0 * ring).cast("int")
        last = F.floor((lon + reach + 180.0) / 360.0 * ring).cast("int")
        around = F.when(last - first + 1 >= ring, F.sequence(F.lit(0), ring - 1)).otherwise(F.sequence(first, last))
        return F.array_distinct(F.transform(around, lambda c: F.pmod(c, ring)))
