"""Geodesy and motion as column expressions, with the same formulas as DuckDB text for the reference queries.

Everything is double-typed. Angles are degrees, lengths metres, speeds metres a second unless a name says knots.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius, knot and nautical mile.
EARTH_RADIUS_M = 6371008.8
KNOT_MS = 1852.0 / 3600.0
NAUTICAL_MILE_M = 1852.0

M_PER_DEG = EARTH_RADIUS_M * math.pi / 180.0


def _d(x: float) -> Column:
    return F.lit(float(x))


def wrap360(deg: Column) -> Column:
    """Into [0, 360)."""
    return F.pmod(deg, _d(360))


def wrap180(dlon: Column) -> Column:
    """A difference of longitudes across the date line."""
    return F.when(dlon > 180, dlon - 360).when(dlon < -180, dlon + 360).otherwise(dlon)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), _d(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), _d(2)
    )
    # not least(1, ...), which would take a null for 1
    return 2 * EARTH_RADIUS_M * F.asin(F.when(half > 1, 1.0).otherwise(F.sqrt(half)))


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    half = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return f"(2 * {EARTH_RADIUS_M} * asin(CASE WHEN {half} > 1 THEN 1.0::DOUBLE ELSE sqrt({half}) END))"


def east_m(lat0: Column, lon0: Column, lon: Column) -> Column:
    return wrap180(lon - lon0) * M_PER_DEG * F.cos(F.radians(lat0))


def north_m(lat0: Column, lat: Column) -> Column:
    return (lat - lat0) * M_PER_DEG


def moved(lat: Column, lon: Column, v_east: Column, v_north: Column, dt: Column) -> tuple[Column, Column]:
    """Latitude and longitude after dt seconds at a constant velocity, in the frame of the start."""
    return lat + v_north * dt / M_PER_DEG, wrap180(lon + v_east * dt / (M_PER_DEG * F.cos(F.radians(lat))))


def v_east(sog_kn: Column, cog: Column) -> Column:
    return sog_kn * KNOT_MS * F.sin(F.radians(cog))


def v_north(sog_kn: Column, cog: Column) -> Column:
    return sog_kn * KNOT_MS * F.cos(F.radians(cog))


def speed_kn(east: Column, north: Column) -> Column:
    return F.hypot(east, north) / KNOT_MS


def course_deg(east: Column, north: Column) -> Column:
    return wrap360(F.degrees(F.atan2(east, north)))


def ecef(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates on the sphere."""
    p, q = F.radians(lat), F.radians(lon)
    return (
        EARTH_RADIUS_M * F.cos(p) * F.cos(q),
        EARTH_RADIUS_M * F.cos(p) * F.sin(q),
        EARTH_RADIUS_M * F.sin(p),
    )


def chord_m(radius_m: float) -> float:
    """Straight distance between points that are radius_m apart on the sphere; a diameter from half-way round on."""
    return 2 * EARTH_RADIUS_M * math.sin(min(math.pi / 2, radius_m / (2 * EARTH_RADIUS_M)))


@dataclass(frozen=True)
class Vehicle:
    """Columns of a moving vessel."""

    lat: Column
    lon: Column
    v_east: Column
    v_north: Column

    @staticmethod
    def of(prefix: str) -> Vehicle:
        return Vehicle(*(F.col(f"{prefix}.{n}") for n in ("lat", "lon", "v_east", "v_north")))


def rotated(x: Column, y: Column, z: Column, axis: tuple[float, float, float], angle: float) -> tuple[Column, Column, Column]:
    """A point of the sphere turned about a unit axis."""
    u, v, w = axis
    c, s = math.cos(angle), math.sin(angle)
    k = (x * u + y * v + z * w) * (1 - c)
    return (
        x * c + (z * v - y * w) * s + k * u,
        y * c + (x * w - z * u) * s + k * v,
        z * c + (y * u - x * v) * s + k * w,
    )


def lat_lon(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """The inverse of ecef."""
    return F.degrees(F.asin(F.greatest(_d(-1), F.least(_d(1), z / EARTH_RADIUS_M)))), F.degrees(F.atan2(y, x))


def offsets(a: Vehicle, b: Vehicle, across_dateline: bool = True) -> dict[str, Column]:
    """x, y, vx, vy: where b is, and how it moves, as seen from a, in a flat frame half-way between the vessels.

    across_dateline=False takes the plain mean of longitudes, which puts pairs across the date line far apart.
    """
    lat0 = (a.lat + b.lat) / 2
    dlon = wrap180(b.lon - a.lon) if across_dateline else b.lon - a.lon
    x, y = dlon * M_PER_DEG * F.cos(F.radians(lat0)), north_m(a.lat, b.lat)
    if not across_dateline:
        lon0 = (a.lon + b.lon) / 2
        x = east_m(lat0, lon0, b.lon) - east_m(lat0, lon0, a.lon)
    return {"x": x, "y": y, "vx": b.v_east - a.v_east, "vy": b.v_north - a.v_north}


def tcpa_s(x: Column, y: Column, vx: Column, vy: Column) -> Column:
    vv = vx * vx + vy * vy
    return F.when(vv < 1e-9, 0.0).otherwise(-(x * vx + y * vy) / F.greatest(vv, _d(1e-9)))


def dcpa_m(x: Column, y: Column, vx: Column, vy: Column, now: Column, tcpa: Column) -> Column:
    return F.when(tcpa <= 0, now).otherwise(F.hypot(x + vx * tcpa, y + vy * tcpa))


def closest_approach(a: Vehicle, b: Vehicle, across_dateline: bool = True) -> dict[str, Column]:
    """range_m, tcpa_s, dcpa_m of two constant velocities, in the frame of `offsets`.

    Vessels of the same velocity have tcpa_s 0; those that draw apart have a tcpa_s below 0 and are closest now.
    """
    x, y, vx, vy = offsets(a, b, across_dateline).values()
    now, tcpa = F.hypot(x, y), tcpa_s(x, y, vx, vy)
    return {"range_m": now, "tcpa_s": tcpa, "dcpa_m": dcpa_m(x, y, vx, vy, now, tcpa)}


def relative_bearing(origin: Vehicle, other: Vehicle) -> Column:
    """Of the other, clockwise from the origin's course, in the origin's frame."""
    return wrap360(true_bearing(origin, other) - course_deg(origin.v_east, origin.v_north))


def true_bearing(origin: Vehicle, other: Vehicle) -> Column:
    """Of the other, clockwise from north, in (-180, 180], in the origin's frame."""
    return F.degrees(F.atan2(east_m(origin.lat, origin.lon, other.lon), north_m(origin.lat, other.lat)))
