"""A table of locations in space-filling order, of which a box reads few row groups; boxes with great-circle edges."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

BITS = 16  # of a coordinate; a cell is 0.0055 by 0.0027 degrees
KEY = "morton"
MOST_RANGES = 64


def _spread(x: Column) -> Column:
    """The bits of a number below 2**16, each followed by a 0."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = F.shiftleft(x, shift).bitwiseOR(x).bitwiseAND(F.lit(mask).cast("long"))
    return x


def _steps(x: Column, low: float, width: float) -> Column:
    return F.least(F.greatest(F.floor((x - low) / width * (1 << BITS)), F.lit(0)), F.lit((1 << BITS) - 1)).cast("long")


def morton(lng: Column, lat: Column) -> Column:
    """Place on the Z-order curve over all longitudes and latitudes: the bits of both, by turns; null without coordinates."""
    return F.shiftleft(_spread(_steps(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_steps(lng, -180.0, 360.0)))


def write_spatial(locations: DataFrame, path: str, block_bytes: int = 8 << 20) -> None:
    """Write the rows as Parquet in the order of the curve, in row groups of about ``block_bytes``.

    Files and row groups hold short stretches of the curve, so the statistics of the key that
    Parquet keeps tell which of them a box can meet.  Rows without coordinates come first.
    """
    keyed = locations.withColumn(KEY, morton(F.col("lng"), F.col("lat")))
    keyed.repartitionByRange(KEY).sortWithinPartitions(KEY).write.option("parquet.block.size", block_bytes).parquet(path)


def key_ranges(west: float, south: float, east: float, north: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, ends included, that cover a box: at most about ``most``, found by quartering squares that the box cuts."""
    size = 1 << BITS
    step = lambda x, low, width: min(max(math.floor((x - low) / width * size), 0), size - 1)
    if west > east or south > north:
        return []
    x0, x1, y0, y1 = step(west, -180.0, 360.0), step(east, -180.0, 360.0), step(south, -90.0, 180.0), step(north, -90.0, 180.0)
    whole, cut = [], [(0, 0, 0, BITS)]  # first key, x, y, bits of the side
    while cut:
        if len(whole) + len(cut) * 3 > most or cut[0][3] == 0:
            whole += cut
            break
        smaller = []
        for key, x, y, bits in cut:
            half = 1 << (bits - 1)
            for quarter in range(4):
                a, b = x + (quarter & 1) * half, y + (quarter >> 1) * half
                if a > x1 or b > y1 or a + half <= x0 or b + half <= y0:
                    continue
                inside = x0 <= a and a + half - 1 <= x1 and y0 <= b and b + half - 1 <= y1
                (whole if inside else smaller).append((key + quarter * half * half, a, b, bits - 1))
        cut = smaller
    out: list[tuple[int, int]] = []
    for first, last in sorted((k, k + (1 << 2 * bits) - 1) for k, _, _, bits in whole):
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    """Whether the key lies in one of the ranges; Spark hands the comparisons to Parquet."""
    hit = F.lit(False)
    for first, last in ranges:
        hit = hit | F.col(KEY).between(first, last)
    return hit


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a table of ``write_spatial`` in a planar box, edges included."""
    rows = spark.read.parquet(path).where(in_ranges(key_ranges(west, south, east, north)))
    return rows.where(geo.in_box(F.col("lng"), F.col("lat"), west, south, east, north)).drop(KEY)


def geodesic_bounds(west: float, south: float, east: float, north: float) -> tuple[float, float, float, float]:
    """The planar box around a box with great-circle edges: its edges bulge towards the nearer pole."""
    if not 0 <= east - west < 180:
        raise ValueError("a geodesic box has to be narrower than 180 degrees")
    bulge = lambda lat: math.degrees(math.atan(math.tan(math.radians(lat)) / math.cos(math.radians((east - west) / 2))))
    return west, min(south, bulge(south)), east, max(north, bulge(north))


def in_geodesic_box(lng: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Inside the spherical polygon of a box's corners.

    The sides are meridians.  A great circle through two points of one latitude has, at a longitude
    off the middle by d, the tangent of latitude tan(lat) cos(d) / cos(half the width).
    """
    if not 0 <= east - west < 180:
        raise ValueError("a geodesic box has to be narrower than 180 degrees")
    along = F.cos(F.radians(lng - (west + east) / 2)) / math.cos(math.radians((east - west) / 2))
    edge = lambda corner: math.tan(math.radians(corner)) * along
    own = F.tan(F.radians(lat))
    return lng.between(west, east) & (own >= edge(south)) & (own <= edge(north))


def read_geodesic_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """Rows of a table of ``write_spatial`` in a box with great-circle edges; the cells read include the bulge."""
    around = geodesic_bounds(west, south, east, north)
    rows = spark.read.parquet(path).where(in_ranges(key_ranges(*around)))
    return rows.where(in_geodesic_box(F.col("lng"), F.col("lat"), west, south, east, north)).drop(KEY)
