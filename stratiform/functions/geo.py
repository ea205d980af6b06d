"""Spherical and projected geometry as column expressions: everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Earth radius in metres, metres of a degree, ellipsoid of the shifted datum, its box.
EARTH = 6371000.0
METRES_LON, METRES_LAT = 111320.0, 110540.0
ELLIPSOID_A, ELLIPSOID_EE = 6378245.0, 0.00669342162296594323
CHINA = (73.66, 135.05, 3.86, 53.55)
MERCATOR = 20037508.342789244


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dl / 2), 2)
    return F.lit(EARTH) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def outside_china(lon: Column, lat: Column) -> Column:
    w, e, s, n = CHINA
    return ~((lon > w) & (lon < e) & (lat > s) & (lat < n))


def _shift(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y, pi = lon - 105.0, lat - 35.0, math.pi
    root = F.sqrt(F.abs(x))
    common = (20.0 * F.sin(6.0 * x * pi) + 20.0 * F.sin(2.0 * x * pi)) * 2.0 / 3.0
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root + common
    dlat = dlat + (20.0 * F.sin(y * pi) + 40.0 * F.sin(y / 3.0 * pi)) * 2.0 / 3.0 + (160.0 * F.sin(y / 12.0 * pi) + 320.0 * F.sin(y * pi / 30.0)) * 2.0 / 3.0
    dlon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root + common
    dlon = dlon + (20.0 * F.sin(x * pi) + 40.0 * F.sin(x / 3.0 * pi)) * 2.0 / 3.0 + (150.0 * F.sin(x / 12.0 * pi) + 300.0 * F.sin(x / 30.0 * pi)) * 2.0 / 3.0
    rad = lat / 180.0 * pi
    magic = 1 - ELLIPSOID_EE * F.pow(F.sin(rad), 2)
    root_magic = F.sqrt(magic)
    return dlon * 180.0 / (ELLIPSOID_A / root_magic * F.cos(rad) * pi), dlat * 180.0 / ((ELLIPSOID_A * (1 - ELLIPSOID_EE)) / (magic * root_magic) * pi)


def gcj_to_wgs(lon: Column, lat: Column) -> tuple[Column, Column]:
    """One-step removal of the datum shift; points outside the box stay."""
    dlon, dlat = _shift(lon, lat)
    out = outside_china(lon, lat)
    return F.when(out, lon).otherwise(lon - dlon), F.when(out, lat).otherwise(lat - dlat)


def wgs_to_gcj(lon: Column, lat: Column) -> tuple[Column, Column]:
    dlon, dlat = _shift(lon, lat)
    out = outside_china(lon, lat)
    return F.when(out, lon).otherwise(lon + dlon), F.when(out, lat).otherwise(lat + dlat)


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * MERCATOR / 180.0, F.ln(F.tan((90.0 + lat) * math.pi / 360.0)) * MERCATOR / math.pi


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x / MERCATOR * 180.0, (2.0 * F.atan(F.exp(y / MERCATOR * math.pi)) - math.pi / 2) * 180.0 / math.pi


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Slippy-map tile of a point."""
    n = float(1 << zoom)
    r = F.radians(lat)
    return F.floor((lon + 180.0) / 360.0 * n), F.floor((1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / math.pi) / 2.0 * n)


def tile_origin(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """North-west corner of a tile."""
    n = float(1 << zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * y / n))))


def bbox_around(lon: Column, lat: Column, km: float) -> tuple[Column, Column, Column, Column]:
    """West, south, east, north; a wide default where the centre is unknown."""
    d = km / 111.0
    return tuple(F.coalesce(v, F.lit(default)) for v, default in ((lon - d, 100.0), (lat - d, 20.0), (lon + d, 120.0), (lat + d, 40.0)))


def ring(lon: Column, lat: Column, radius: Column, points: int) -> Column:
    """A closed circle of ``points`` corners, in plane metres of a degree."""
    step = 2 * math.pi / points
    corner = lambda i: F.array(lon + radius * F.cos(i * step) / METRES_LON, lat + radius * F.sin(i * step) / METRES_LAT)
    return close_ring(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), corner))


def close_ring(points: Column) -> Column:
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    return F.when((F.size(points) > 0) & (first != last), F.concat(points, F.array(first))).otherwise(points)


def shoelace(points: Column) -> Column:
    """Area of a closed ring in the units of its coordinates, squared."""
    nxt = F.slice(points, F.lit(2), F.size(points) - 1)
    cross = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), nxt, lambda a, b: a[0] * b[1] - b[0] * a[1])
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2.0


def inside(lon: Column, lat: Column, points: Column) -> Column:
    """Even-odd rule: whether a point lies in a closed ring."""
    a = F.slice(points, F.lit(1), F.size(points) - 1)
    b = F.slice(points, F.lit(2), F.size(points) - 1)
    crosses = F.zip_with(
        a, b, lambda p, q: F.when(((p[1] > lat) != (q[1] > lat)) & (lon < (q[0] - p[0]) * (lat - p[1]) / F.nullif(q[1] - p[1], F.lit(0.0)) + p[0]), 1).otherwise(0)
    )
    return F.aggregate(crosses, F.lit(0), lambda s, v: s + v) % 2 == 1


def points_of_polyline(text: Column) -> Column:
    """Points of ``x,y;x,y|…``: an array of rings."""
    point = lambda p: F.array(F.split(p, ",")[0].cast("double"), F.split(p, ",")[1].cast("double"))
    return F.transform(F.split(text, r"\|"), lambda part: close_ring(F.transform(F.split(part, ";"), point)))


def wkt_points(text: Column) -> Column:
    """All numbers of a WKT text as one flat ring of points, as unsigned decimals."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)")), lambda v: v.cast("double"))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.floor(F.size(numbers) / 2).cast("int"), F.lit(1))), lambda i: F.array(F.try_element_at(numbers, i * 2 - 1), F.try_element_at(numbers, i * 2)))
