"""Geometry as column expressions; everything here stays inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius in metres for great circles; WGS84 semi-major
# axis and first eccentricity squared for geodesic lengths.
EARTH_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_E2 = 0.0066943799901413165
# Web-Mercator tile grid: cells per tile edge and clip margin in cells.
TILE_EXTENT = 4096
TILE_BUFFER = 64


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(chord))


def geodesic_segment_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Ellipsoidal length of a short segment from the two radii of curvature at
    its middle latitude; relative error under 1e-6 for segments up to some km."""
    mid = F.radians((lat1 + lat2) / 2)
    w2 = 1 - WGS84_E2 * F.sin(mid) * F.sin(mid)
    normal = WGS84_A / F.sqrt(w2)
    meridian = WGS84_A * (1 - WGS84_E2) / (w2 * F.sqrt(w2))
    north = meridian * F.radians(lat2 - lat1)
    east = normal * F.cos(mid) * F.radians(lon2 - lon1)
    return F.sqrt(north * north + east * east)


def planar_length(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.sqrt((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def mercator_unit_x(lon: Column) -> Column:
    """Web-Mercator x in [0, 1], west to east."""
    return lon / 360.0 + 0.5


def mercator_unit_y(lat: Column) -> Column:
    """Web-Mercator y in [0, 1], north to south."""
    return 0.5 - F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) / (2 * math.pi)


def geojson_point(lon: Column, lat: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def geojson_linestring(points: Column) -> Column:
    """``points``: ordered array of structs with lon and lat."""
    coordinates = F.transform(points, lambda p: F.array(p["lon"], p["lat"]))
    return F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")))


def linestring_points(wkt: Column) -> Column:
    """WKT ``LINESTRING(lon lat, ...)`` to an array of structs, NULL if malformed."""
    body = F.regexp_extract(F.trim(wkt), r"(?i)^LINESTRING\s*\(([^()]*)\)$", 1)
    points = F.transform(
        F.split(body, ","),
        lambda p, i: F.struct(
            (i + 1).alias("seq"),
            F.split(F.trim(p), r"\s+")[0].try_cast("double").alias("lon"),
            F.try_element_at(F.split(F.trim(p), r"\s+"), F.lit(2)).try_cast("double").alias("lat"),
        ),
    )
    complete = ~F.exists(points, lambda p: p["lon"].isNull() | p["lat"].isNull())
    return F.when((body != "") & complete, points)
