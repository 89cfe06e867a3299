"""Counts and first rows by cell at several levels, from which boxes of any size are answered."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.storage import materialise
from . import layout
from .search import MOST_FEATURES

FINEST = 0.002  # degrees; fixed value: no box is thinned finer
LEVELS = 14  # each of twice the step: up to 16.4 degrees
SIDE = 256  # cells on the longer side of a box at the level at which it is counted


def _cell(c: str) -> Column:
    return F.floor(F.col(c) / FINEST)


def write_pyramid(locations: DataFrame, path: str) -> None:
    """Write ``path/rows``, the locations (id, lng, lat, ...) in spatial order, and ``path/cells``, of each level and cell (x, y) the number n of rows and the one with the smallest id.

    A level is made from the one below it, so the rows are grouped once.  Rows without coordinates
    are in no cell.
    """
    layout.write_spatial(locations, f"{path}/rows")
    columns = locations.columns
    cells = locations.where("lng is not null and lat is not null").groupBy(_cell("lng").alias("x"), _cell("lat").alias("y")).agg(F.count("*").alias("n"), F.min_by(F.struct(*columns), "id").alias("first"))
    for level in range(LEVELS):
        if level:
            cells = cells.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("n").alias("n"), F.min_by("first", "first.id").alias("first"))
        cells = materialise(cells, "level")
        cells.repartitionByRange("x").sortWithinPartitions("x", "y").write.parquet(f"{path}/cells/level={level}")


class _Box:
    """A box in finest cells: x0..x1, y0..y1 are those that lie in it whole."""

    def __init__(self, west: float, south: float, east: float, north: float):
        self.box = (west, south, east, north)
        self.x0, self.x1 = math.floor(west / FINEST) + 1, math.floor(east / FINEST) - 1
        self.y0, self.y1 = math.floor(south / FINEST) + 1, math.floor(north / FINEST) - 1

    def whole(self, level: int) -> tuple[int, int, int, int]:
        """First and last cell of a level, by x and y, that lie in the box whole; the last is before the first if there is none."""
        size = 1 << level
        return -(-self.x0 // size), (self.x1 + 1) // size - 1, -(-self.y0 // size), (self.y1 + 1) // size - 1

    def inner(self, cells: DataFrame, level: int) -> DataFrame:
        x0, x1, y0, y1 = self.whole(level)
        return cells.where((F.col("level") == level) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))

    def rim(self, spark: SparkSession, path: str, level: int) -> DataFrame:
        """Rows of the box outside its whole cells, read from the strips along its edges; x, y are their cells."""
        west, south, east, north = self.box
        x0, x1, y0, y1 = self.whole(level)
        step = FINEST * (1 << level)
        if x0 > x1 or y0 > y1:
            strips = [self.box]
        else:
            left, right, low, high = x0 * step, (x1 + 1) * step, y0 * step, (y1 + 1) * step
            strips = [(west, south, left, north), (right, south, east, north), (west, south, east, low), (west, high, east, north)]
        ranges = [r for s in strips for r in layout.key_ranges(*s, most=layout.MOST_RANGES // len(strips))]
        rows = spark.read.parquet(path).where(layout.in_ranges(ranges)).where(geo.in_box(F.col("lng"), F.col("lat"), *self.box)).drop(layout.KEY)
        rows = rows.withColumns({"x": F.floor(_cell("lng") / (1 << level)), "y": F.floor(_cell("lat") / (1 << level))})
        return rows.where(~(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)))


def count_level(west: float, south: float, east: float, north: float) -> int:
    side = max(east - west, north - south) / FINEST
    return min(LEVELS - 1, max(0, math.ceil(math.log2(max(side / SIDE, 1)))))


def thin_level(west: float, south: float, east: float, north: float, most: int) -> int:
    """The first level whose step is the thinning step or more."""
    step = geo.thinning_step(west, south, east, north, most) / FINEST
    return min(LEVELS - 1, max(0, math.ceil(math.log2(step) - 1e-9)))


def count_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> int:
    """Rows in a box: whole cells from the table, the rest from the rows along its edges."""
    box, level = _Box(west, south, east, north), count_level(west, south, east, north)
    inner = box.inner(spark.read.parquet(f"{path}/cells"), level).agg(F.sum("n")).first()[0]
    return int(inner or 0) + box.rim(spark, f"{path}/rows", level).count()


def read_box(spark: SparkSession, path: str, west: float, south: float, east: float, north: float, most: int = MOST_FEATURES) -> DataFrame:
    """A box counted first, then whole, or above ``most`` the row with the smallest id of each cell.

    The cells are those of the first level that is as coarse as the box's thinning step or coarser.
    Only cells that the box cuts are answered from rows; edges are part of the box.
    """
    if count_box(spark, path, west, south, east, north) <= most:
        return layout.read_box(spark, f"{path}/rows", west, south, east, north)
    box, level = _Box(west, south, east, north), thin_level(west, south, east, north, most)
    inner = box.inner(spark.read.parquet(f"{path}/cells"), level).select("first.*")
    rim = box.rim(spark, f"{path}/rows", level)
    columns = [c for c in rim.columns if c not in ("x", "y")]
    return inner.unionByName(rim.groupBy("x", "y").agg(F.min_by(F.struct(*columns), "id").alias("r")).select("r.*"))
