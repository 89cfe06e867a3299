"""Datum conversion, distances and grid cells as column expressions (code-generated, no Python)."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the GCJ-02 and BD-09 definitions.
AXIS = 6378245.0
ECCENTRICITY = 0.00669342162296594323
BD_ANGLE = math.pi * 3000.0 / 180.0
GCJ_BOX = (72.004, 137.8347, 0.8293, 55.8271)
EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111000.0
HALF_GLOBE_M = math.pi * EARTH_RADIUS_M


def _waves(x: Column, terms: list[tuple[float, float]]) -> Column:
    """Sum of amplitude * sin(x * pi * frequency), two thirds of it."""
    total = F.lit(0.0)
    for amplitude, frequency in terms:
        total = total + F.lit(amplitude) * F.sin(x * F.lit(frequency * math.pi))
    return total * 2.0 / 3.0


def out_of_china(lng: Column, lat: Column) -> Column:
    """Outside the box in which GCJ-02 differs from WGS-84."""
    west, east, south, north = GCJ_BOX
    return (lng < west) | (lng > east) | (lat < south) | (lat > north)


def _shift(lng: Column, lat: Column) -> tuple[Column, Column]:
    """Shift of GCJ-02 in degrees (east, north); all numbers are fixed values of its definition."""
    x, y = lng - 105.0, lat - 35.0
    shared = _waves(x, [(20.0, 6.0), (20.0, 2.0)])
    north = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + shared + _waves(y, [(20.0, 1.0), (40.0, 1 / 3)]) + _waves(y, [(160.0, 1 / 12), (320.0, 1 / 30)])
    east = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + shared + _waves(x, [(20.0, 1.0), (40.0, 1 / 3)]) + _waves(x, [(150.0, 1 / 12), (300.0, 1 / 30)])
    angle = F.radians(lat)
    m = 1 - ECCENTRICITY * F.sin(angle) * F.sin(angle)
    per_lat = AXIS * (1 - ECCENTRICITY) / (m * F.sqrt(m)) * math.pi / 180.0
    per_lng = AXIS / F.sqrt(m) * F.cos(angle) * math.pi / 180.0
    return east / per_lng, north / per_lat


def _point(lng: Column, lat: Column) -> Column:
    return F.struct(lng.alias("lng"), lat.alias("lat"))


def wgs84_to_gcj02(lng: Column, lat: Column) -> Column:
    """struct(lng, lat); unchanged outside the box; null where an input is null."""
    east, north = _shift(lng, lat)
    outside = out_of_china(lng, lat)
    return _point(F.when(outside, lng).otherwise(lng + east), F.when(outside, lat).otherwise(lat + north))


def gcj02_to_wgs84(lng: Column, lat: Column) -> Column:
    """One-step inverse of ``wgs84_to_gcj02``."""
    east, north = _shift(lng, lat)
    outside = out_of_china(lng, lat)
    return _point(F.when(outside, lng).otherwise(lng - east), F.when(outside, lat).otherwise(lat - north))


def gcj02_to_bd09(lng: Column, lat: Column) -> Column:
    radius = F.sqrt(lng * lng + lat * lat) + 0.00002 * F.sin(lat * BD_ANGLE)
    angle = F.atan2(lat, lng) + 0.000003 * F.cos(lng * BD_ANGLE)
    return _point(radius * F.cos(angle) + 0.0065, radius * F.sin(angle) + 0.006)


def bd09_to_gcj02(lng: Column, lat: Column) -> Column:
    x, y = lng - 0.0065, lat - 0.006
    radius = F.sqrt(x * x + y * y) - 0.00002 * F.sin(y * BD_ANGLE)
    angle = F.atan2(y, x) - 0.000003 * F.cos(x * BD_ANGLE)
    return _point(radius * F.cos(angle), radius * F.sin(angle))


def to_wgs84(lng: Column, lat: Column, system: Column) -> Column:
    """struct(lng, lat) by the row's coordinate system; an unknown system raises an error."""
    via = bd09_to_gcj02(lng, lat)
    bd = gcj02_to_wgs84(via["lng"], via["lat"])
    return F.when(system == "WGS84", _point(lng, lat)).when(system == "GCJ02", gcj02_to_wgs84(lng, lat)).when(system == "BD09", bd).when(system.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("unknown coordinate system: "), system)))


def with_wgs84(df: DataFrame, lng: str = "lng", lat: str = "lat", system: str = "coordinate_system") -> DataFrame:
    """``df`` with the coordinate columns converted by ``to_wgs84``'s rules, and the system set.

    The steps are columns of their own, so that no expression is repeated inside the next and the
    whole conversion compiles to one stage.
    """
    bd = F.col(system) == "BD09"
    known = F.col(system).isin("WGS84", "GCJ02", "BD09")
    out = df.withColumn("_bd", bd09_to_gcj02(F.col(lng), F.col(lat)))
    out = out.withColumns({"_x": F.when(bd, F.col("_bd.lng")).otherwise(F.col(lng)), "_y": F.when(bd, F.col("_bd.lat")).otherwise(F.col(lat))})
    east, north = _shift(F.col("_x"), F.col("_y"))
    out = out.withColumns({"_east": east, "_north": north})
    stay = (F.col(system) == "WGS84") | out_of_china(F.col("_x"), F.col("_y"))
    checked = F.when(known, F.lit(0.0)).when(F.col(system).isNotNull(), F.raise_error(F.concat(F.lit("unknown coordinate system: "), F.col(system))))
    moved = {c: F.when(stay, F.col(v)).otherwise(F.col(v) - F.col(d)) + checked for c, v, d in ((lng, "_x", "_east"), (lat, "_y", "_north"))}
    return out.withColumns(moved | {system: F.when(known, F.lit("WGS84"))}).drop("_bd", "_x", "_y", "_east", "_north")


def distance_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle (haversine) distance in metres."""
    dy, dx = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    h = F.sin(dy) * F.sin(dy) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dx) * F.sin(dx)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def band_height(radius_m: float) -> float:
    """Height in degrees of latitude bands such that points within the radius are at most one band apart."""
    return min(radius_m / METRES_PER_DEGREE, 200.0)


def band_of(lat: Column, radius_m: float) -> Column:
    return F.floor((lat + 90.0) / band_height(radius_m))


def band_width(band: Column, radius_m: float) -> Column:
    """Degrees of longitude that points within the radius are at most apart, if one is in the band and the other at most one band away."""
    height = band_height(radius_m)
    south = band * height - 90.0
    outer = F.greatest(F.abs(south - height), F.abs(south + 2 * height))
    if radius_m >= HALF_GLOBE_M / 2:
        return F.lit(360.0)
    ratio = math.sin(radius_m / (2 * EARTH_RADIUS_M)) / F.cos(F.radians(outer))
    return F.when((outer >= 90.0) | (ratio >= 1.0), 360.0).otherwise(F.degrees(2 * F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9))


def cell_in_band(lng: Column, width: Column) -> Column:
    """Number of the cell in its band, counted east from 180 degrees west."""
    return F.floor(F.pmod(lng + 180.0, F.lit(360.0)) / width)


def cells_around(lng: Column, width: Column) -> Column:
    """Numbers of all cells of a band that have points within a cell's width, across 180 degrees too."""
    at = F.pmod(lng + 180.0, F.lit(360.0))
    cell, last = F.floor(at / width), F.ceil(F.lit(360.0) / width) - 1
    near = F.sequence(F.greatest(cell - 1, F.lit(0)), F.least(cell + 1, last))
    west = F.when(at < width, F.sequence(F.least(F.floor((at - width + 360.0) / width), last), last))
    east = F.when(at + width >= 360.0, F.sequence(F.lit(0).cast("long"), F.least(F.floor((at + width - 360.0) / width), last)))
    none = F.expr("cast(array() as array<bigint>)")
    return F.array_distinct(F.concat(near, F.coalesce(west, none), F.coalesce(east, none)))


def thinning_step(west: float, south: float, east: float, north: float, most: int) -> float:
    """Grid step at which a box holds about ``most`` cells."""
    area = max(east - west, 0.001) * max(north - south, 0.001)
    return max(math.sqrt(area / most) * 0.9, 0.002)


def thinning_step_column(west: Column, south: Column, east: Column, north: Column, most: int) -> Column:
    area = F.greatest(east - west, F.lit(0.001)) * F.greatest(north - south, F.lit(0.001))
    return F.greatest(F.sqrt(area / most) * 0.9, F.lit(0.002))


def box_radius_for_stores(count: Column, widest: float = 0.35) -> Column:
    """Half width of a city's box by the number of stores expected there."""
    return F.when(count <= 3, 0.12).when(count <= 8, 0.18).when(count <= 20, 0.25).otherwise(widest)


def search_km(step: Column, most: float = 20.0) -> Column:
    """Search distance for a grid step: 250 km a degree, within 1 km and ``most``, to one decimal."""
    return F.floor(F.greatest(F.lit(1.0), F.least(F.lit(most), step * 250)) * 10 + 0.5) / 10


def round_half_even(x: Column, digits: int = 4) -> Column:
    return F.bround(x, digits)


def round_half_up(x: Column, digits: int = 4) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def cell_key(lat: Column, lng: Column, step: Column) -> Column:
    """lat|lng|step at four decimals."""
    return F.concat_ws("|", *(F.format_string("%.4f", round_half_up(x)) for x in (lat, lng, step)))


def visited_key(lat: Column, lng: Column, step: Column) -> Column:
    """lat,lng,step at four decimals, halves to the even digit, as a crawl remembers its cells."""
    return F.concat_ws(",", *(F.format_string("%.4f", round_half_even(x)) for x in (lat, lng, step)))


def point_geojson(lng: Column, lat: Column) -> Column:
    """GeoJSON Point at nine decimals, null without coordinates."""
    body = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lng, 9), F.round(lat, 9)).alias("coordinates")))
    return F.when(lng.isNotNull() & lat.isNotNull(), body)


def point_wkt(lng: Column, lat: Column) -> Column:
    return F.when(lng.isNotNull() & lat.isNotNull(), F.format_string("POINT(%.6f %.6f)", lng, lat))


def in_box(lng: Column, lat: Column, west, south, east, north) -> Column:
    """Inside a planar box, edges included."""
    return lng.between(west, east) & lat.between(south, north)
