"""Lattices, quad splits, adaptive tiles, city boxes and region plans."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, scope
from .stats import number_by

MEGA_RADIUS, CITY_RADIUS = 0.35, 0.18


def _count(low: float, high: float, step: float) -> int:
    """Cell centres low + step/2 + i * step up to high."""
    return max(0, math.floor((high - low - step / 2) / step + 1e-9) + 1)


def lattice(spark: SparkSession, west: float, south: float, east: float, north: float, step: float, holes: str = "none") -> DataFrame:
    """Cell centres (i, j, lat, lng, step) over a box, without those in the holes (none, scope, grid)."""
    nx, ny = _count(west, east, step), _count(south, north, step)
    index = spark.range(nx * ny).select(F.expr(f"id div {max(nx, 1)}").alias("i"), F.expr(f"id % {max(nx, 1)}").alias("j"))
    out = index.select("i", "j", (F.lit(south + step / 2) + F.col("i") * step).alias("lat"), (F.lit(west + step / 2) + F.col("j") * step).alias("lng"), F.lit(step).alias("step"))
    bad = {"none": F.lit(False), "scope": scope.out_of_coordinates(F.col("lng"), F.col("lat")), "grid": scope.out_of_grid(F.col("lng"), F.col("lat"))}[holes]
    return out.where(~bad)


def lattice_of(boxes: DataFrame, step: float, holes: str = "none") -> DataFrame:
    """As ``lattice``, for every row's own box (west, south, east, north); other columns stay."""
    steps = lambda low, high: F.greatest(F.lit(0), F.floor((F.col(high) - F.col(low) - step / 2) / step + 1e-9) + 1)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))
    grid = boxes.withColumn("i", F.explode(upto(steps("south", "north")))).withColumn("j", F.explode(upto(steps("west", "east"))))
    out = grid.withColumns({"lat": F.col("south") + step / 2 + F.col("i") * step, "lng": F.col("west") + step / 2 + F.col("j") * step, "step": F.lit(step)})
    bad = {"none": F.lit(False), "scope": scope.out_of_coordinates(F.col("lng"), F.col("lat")), "grid": scope.out_of_grid(F.col("lng"), F.col("lat"))}[holes]
    return out.where(~bad)


def chain_boxes(points: DataFrame, chain: str = "chain_id") -> DataFrame:
    """The box about each chain's located stores, at whole degrees."""
    located = points.where("lng is not null and lat is not null")
    edge = lambda f, c: f(c).cast("double")
    return located.groupBy(chain).agg(edge(F.floor, F.min("lng")).alias("west"), edge(F.floor, F.min("lat")).alias("south"), edge(F.ceil, F.max("lng")).alias("east"), edge(F.ceil, F.max("lat")).alias("north"))


def km_lattice(centres: DataFrame, span_km: float, step_km: float) -> DataFrame:
    """Points about each centre (lat, lng): rows and columns step_km apart out to span_km."""
    steps = max(int(span_km / step_km), 1)
    dlat = step_km / 111.0
    dlng = step_km / (111.0 * F.greatest(F.cos(F.radians(F.col("lat"))), F.lit(0.2)))
    span = F.sequence(F.lit(-steps), F.lit(steps))
    grid = centres.withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    return grid.withColumns({"point_lat": F.col("lat") + F.col("i") * dlat, "point_lng": F.col("lng") + F.col("j") * dlng})


def quad_split(cells: DataFrame, clip: tuple[float, float, float, float] | None = None, digits: int = 4) -> DataFrame:
    """The four half-step children of each cell (lat, lng, step), without those in grid holes or outside ``clip``."""
    quarter = F.col("step") / 4
    corners = F.array(*(F.struct((F.col("lat") + a * quarter).alias("lat"), (F.col("lng") + b * quarter).alias("lng")) for a in (-1, 1) for b in (-1, 1)))
    out = cells.select((F.col("step") / 2).alias("step"), F.explode(corners).alias("c")).select(geo.round_half_up(F.col("c.lat"), digits).alias("lat"), geo.round_half_up(F.col("c.lng"), digits).alias("lng"), "step")
    out = out.where(~scope.out_of_grid(F.col("lng"), F.col("lat")))
    return out.where(geo.in_box(F.col("lng"), F.col("lat"), *clip)) if clip else out


def subdivides(n: Column, step: Column, rule: str, limit: int, min_step: float, empty_min_step: float = 0.0, first_step: float = 0.0) -> Column:
    """Whether a cell with n hits is split: any (hit or large empty), saturated, or partial (saturated, or any hit in a first-level cell)."""
    inner = {"any": (n > 0) | (step > empty_min_step), "saturated": n >= limit, "partial": (n >= limit) | ((n > 0) & (step >= first_step))}[rule]
    return (step > min_step) & inner


def quadtree(points: DataFrame, west: float, south: float, step: float, levels: int, limit: int, rule: str = "saturated", **rules) -> DataFrame:
    """Active cells (level, x, y, n) of an adaptive tiling of points (lng, lat).

    One aggregation counts the finest cells, and each coarser level sums the four below, so points
    are read once.  A cell is active when its parent is active and splits; children of splitting
    parents stand also where they hold no point.
    """
    fine = step / 2 ** (levels - 1)
    base = points.where("lng is not null and lat is not null").groupBy(F.floor((F.col("lng") - west) / fine).alias("x"), F.floor((F.col("lat") - south) / fine).alias("y")).agg(F.count("*").alias("n"))
    counts = [base]
    for _ in range(levels - 1):
        c = counts[-1]
        counts.append(c.groupBy(F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y")).agg(F.sum("n").alias("n")))
    counts.reverse()
    active = counts[0].withColumn("level", F.lit(0))
    out = active
    for level in range(1, levels):
        size = step / 2 ** (level - 1)
        split = active.where(subdivides(F.col("n"), F.lit(size), rule, limit, rules.get("min_step", 0.0), rules.get("empty_min_step", 0.0), rules.get("first_step", 0.0)))
        child = split.select(F.explode(F.array(*(F.struct((F.col("x") * 2 + a).alias("x"), (F.col("y") * 2 + b).alias("y")) for a in (0, 1) for b in (0, 1)))).alias("c")).select("c.*")
        active = child.join(counts[level].hint("merge"), ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), F.lit(level).alias("level"))
        out = out.unionByName(active)
    return out.select("level", "x", "y", "n")


def city_order(centres: DataFrame, points: DataFrame, order: list[str], mega: list[str]) -> DataFrame:
    """Centres (city, lng, lat) with rank, stores and place (1, 2, ...): by rank, then stores near the city, most first, then name in Chinese order."""
    ranked = city_priority(centres, order, mega).join(box_counts(points, city_boxes(centres, mega)).hint("merge"), "city")
    keyed = ranked.withColumns({"_few": -F.col("stores"), "_name": F.collate("city", "zh")})
    return number_by(keyed, ["rank", "_few", "_name", "city"], "place").drop("_few", "_name")


def city_boxes(centres: DataFrame, mega: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Adds radius and west, south, east, north of each city's box; listed cities have the wide one."""
    radius = F.when(F.col("city").isin(*mega), MEGA_RADIUS).otherwise(CITY_RADIUS) if mega else F.lit(CITY_RADIUS)
    r = F.col("radius")
    return centres.withColumn("radius", radius).withColumns({"west": F.col("lng") - r, "south": F.col("lat") - r, "east": F.col("lng") + r, "north": F.col("lat") + r})


def box_counts(points: DataFrame, boxes: DataFrame, widest: float = MEGA_RADIUS) -> DataFrame:
    """city, stores: points inside each city's box (boxes overlap; none: 0).

    An equi-join on cells as wide as the widest box radius: a box covers at most 3 x 3 of them.
    """
    cell = lambda c: F.floor(F.col(c) / widest)
    spread = lambda c, low, high: F.explode(F.sequence(F.floor(F.col(low) / widest), F.floor(F.col(high) / widest))).alias(c)
    b = boxes.select("*", spread("cx", "west", "east")).select("*", spread("cy", "south", "north"))
    p = points.where("lng is not null and lat is not null").select(F.col("lng").alias("px"), F.col("lat").alias("py"), cell("lng").alias("cx"), cell("lat").alias("cy"))
    hit = p.join(b.hint("merge"), ["cx", "cy"]).where(F.col("px").between(F.col("west"), F.col("east")) & F.col("py").between(F.col("south"), F.col("north")))
    n = hit.groupBy("city").agg(F.count("*").alias("stores"))
    return boxes.select("city").join(n, "city", "left").select("city", F.coalesce("stores", F.lit(0)).alias("stores"))


def region_membership(points: DataFrame, boxes: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """A row for each named box (boxes may overlap) that a point lies in."""
    inside = F.array_compact(F.array(*(F.when(geo.in_box(F.col("lng"), F.col("lat"), *box), F.lit(name)) for name, box in boxes.items())))
    return points.select("*", F.explode(inside).alias("box"))


def city_priority(cities: DataFrame, order: list[str], mega: list[str]) -> DataFrame:
    """Adds rank: place in the list, then listed mega cities, then the rest."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("city"))
    return cities.withColumn("rank", F.when(place > 0, place - 1).when(F.col("city").isin(*mega), len(order) + 1).otherwise(len(order) + 100))


def region_plan(probes: DataFrame, variant: str = "province") -> DataFrame:
    """Regions to search from probe counts (province, n, cities array<struct<city, n>>).

    ``province``: nothing found: skipped; 1000 or more and cities known: its cities; else the province.
    ``city``: every city whose own probe found something.
    """
    if variant == "city":
        return probes.select("province", F.explode("cities").alias("c")).where("c.n > 0").select("province", F.col("c.city").alias("region"))
    whole = F.array(F.col("province"))
    regions = F.when(F.col("n") <= 0, F.array().cast("array<string>")).when((F.col("n") >= 1000) & (F.size("cities") > 0), F.transform("cities", lambda c: c["city"])).otherwise(whole)
    return probes.select("province", F.explode(regions).alias("region"))


def budgets(cities: DataFrame) -> DataFrame:
    """Adds the request budget of a city (targets) and of each of its districts."""
    per_city = F.greatest(F.lit(600), 150 * F.col("targets"))
    per_district = F.greatest(F.lit(400), 12 * F.expr("targets div greatest(districts, 1)"))
    return cities.withColumns({"city_budget": per_city, "district_budget": per_district})
