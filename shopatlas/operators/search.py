"""Queries over locations: boxes, radius, text, thinning, interleaving and caps."""
from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, scope
from ..plans.storage import materialise
from .stats import number_within


def with_chain(locations: DataFrame, chains: DataFrame, categories: DataFrame) -> DataFrame:
    """Locations with chain_slug and category_slug.  Both dimensions are a few dozen rows and left to Spark's size check."""
    dims = chains.select(F.col("id").alias("chain_id"), F.col("slug").alias("chain_slug"), "category_id").join(categories.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug")), "category_id").drop("category_id")
    return locations.join(dims, "chain_id")


def in_bbox(locations: DataFrame, west: float, south: float, east: float, north: float, categories: str | None = None, chains: str | None = None) -> DataFrame:
    """Locations in a planar box, within the query scope; slug lists are comma-separated, blank means all."""
    out = locations.where(geo.in_box(F.col("lng"), F.col("lat"), west, south, east, north) & scope.query_scope(F.col("province"), F.col("city")))
    for column, wanted in (("category_slug", scope.csv_list(categories)), ("chain_slug", scope.csv_list(chains))):
        if wanted:
            out = out.where(F.col(column).isin(*wanted))
    return out


def feature(*extra: str) -> Column:
    """GeoJSON feature of a location row (id, name, slugs, address, city, and extra properties)."""
    names = ("id", "name", "chain_slug", "category_slug", "address", "city", *extra)
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lng", 9), F.round("lat", 9)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.col("id").alias("id"), point.alias("geometry"), F.struct(*names).alias("properties")), {"ignoreNullFields": "false"})


def features(locations: DataFrame) -> DataFrame:
    """One GeoJSON feature a located row; rows without coordinates are left out."""
    return locations.where(F.col("lng").isNotNull() & F.col("lat").isNotNull()).select("id", "chain_slug", feature().alias("feature"))


def thin_by_cell(locations: DataFrame, step: float, how: str = "round", by: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """The row with the smallest id of each grid cell.

    ``how`` says how coordinates become cells (round or floor).  The smallest row is found by an
    aggregation, which works ahead of the shuffle, so a very full cell costs one row a task.
    ``most`` keeps the cells with the smallest ids for each ``by`` key.
    """
    cell = (lambda c: F.floor(F.col(c) / step + 0.5)) if how == "round" else (lambda c: F.floor(F.col(c) / step))
    rows = locations.where(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    columns = rows.columns
    best = rows.groupBy(*by, cell("lng").alias("_x"), cell("lat").alias("_y")).agg(F.min_by(F.struct(*columns), "id").alias("_row"))
    out = best.select("_row.*")
    if most is not None and by:
        out = out.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("id"))).where(F.col("_n") <= most).drop("_n")
    elif most is not None:
        out = out.orderBy("id").limit(most)
    return out


def chain_rank(locations: DataFrame, chain: str = "chain_slug") -> DataFrame:
    """Adds rn, the place of a row in its chain by id: sorting by (rn, chain) interleaves the chains."""
    numbered = number_within(locations, chain, ["id"], "rn")
    return numbered.withColumn("rn", F.col("rn").cast("int"))


def quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """Rows a chain may keep: shrunk in proportion (one at least) until the sum fits or nothing changes."""
    now = dict(counts)
    while (total := sum(now.values())) > most:
        smaller = {k: max(1, math.floor(n * (most / total))) if n else 0 for k, n in now.items()}
        if smaller == now:
            break
        now = smaller
    return now


def cap_combined(locations: DataFrame, most: int, chain: str = "chain_slug") -> DataFrame:
    """Interleaved rows (rn, chain) of all chains, at most ``most``; only one count a chain goes to the driver."""
    counts = {r[chain]: r["count"] for r in locations.groupBy(chain).count().collect()}
    keep = quotas(counts, most)
    if not keep:
        return chain_rank(locations, chain)
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in keep.items() for x in kv)), F.col(chain))
    out = chain_rank(locations, chain).where(F.col("rn") <= limit)
    return out if sum(keep.values()) <= most else out.orderBy("rn", chain).limit(most)


def nearby(locations: DataFrame, lng: float, lat: float, radius_m: float = 3000.0, limit: int | None = 500) -> DataFrame:
    """Locations within a radius of a point, with distance_m; nearest first where a limit is set."""
    if not 1 <= radius_m <= 100_000:
        raise ValueError("radius_m has to be within 1 and 100000")
    dlat = radius_m / geo.METRES_PER_DEGREE
    dlng = dlat / max(math.cos(math.radians(min(abs(lat) + dlat, 89.0))), 0.01)
    box = geo.in_box(F.col("lng"), F.col("lat"), lng - dlng, lat - dlat, lng + dlng, lat + dlat)
    out = locations.where(box).withColumn("distance_m", geo.distance_m(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat))).where(F.col("distance_m") <= radius_m)
    return out.orderBy("distance_m", "id").limit(limit) if limit else out


def cells(df: DataFrame, radius_m: float, around: bool = False) -> DataFrame:
    """Adds the grid cell (cx, cy) of each row, or with ``around`` a row for each cell that may hold points within the radius.

    A cell is part of a latitude band, and as wide as points of the band can be apart, so that at any
    latitude, across 180 degrees and at the poles three bands of about three cells are enough.
    """
    band = geo.band_of(F.col("lat"), radius_m)
    if not around:
        own = df.withColumn("cy", band)
        return own.withColumn("cx", geo.cell_in_band(F.col("lng"), geo.band_width(F.col("cy"), radius_m)))
    near = df.withColumn("cy", F.explode(F.transform(F.expr("array(-1L, 0L, 1L)"), lambda d: band + d)))
    return near.withColumn("cx", F.explode(geo.cells_around(F.col("lng"), geo.band_width(F.col("cy"), radius_m))))


def radius_pairs(left: DataFrame, right: DataFrame, radius_m: float, on: tuple[str, ...] = (), left_id: str = "id", right_id: str = "id") -> DataFrame:
    """Pairs (left_id, right_id, distance_m) within the radius and equal in the ``on`` columns.

    A cell join: the right side stands in all cells around it, so the join is an equi-join on cells and
    ``on`` with the distance as a residual; skewed cells are split by Spark's adaptive join.
    Rows without coordinates or with a null ``on`` column pair with nothing.
    """
    a = cells(left.where("lng is not null and lat is not null"), radius_m).select(F.col(left_id).alias("left_id"), "cx", "cy", *on, F.col("lng").alias("x1"), F.col("lat").alias("y1"))
    b = cells(right.where("lng is not null and lat is not null"), radius_m, around=True).select(F.col(right_id).alias("right_id"), "cx", "cy", *on, F.col("lng").alias("x2"), F.col("lat").alias("y2"))
    near = a.join(b.hint("merge"), ["cx", "cy", *on]).withColumn("distance_m", geo.distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))
    return near.where(F.col("distance_m") <= radius_m).select("left_id", "right_id", "distance_m", *on)


FAR_M = 100_000.0
DEGREE_HALF_DIAGONAL_M = 79_000.0  # no point of a one-degree cell is farther from the cell's middle


def nearest(queries: DataFrame, locations: DataFrame, k: int, radius_m: float, query_id: str = "id") -> DataFrame:
    """The k nearest locations of each query point (query_id, id, distance_m, rank), all if there are fewer.

    Each round takes four times the radius for the queries that have fewer than k within it.  Beyond
    FAR_M the rest is ranked by one-degree cells, of which there are at most 64,800: distances of cells,
    counted for all queries of a cell at once, bound that of a k-th location, and only cells that can
    hold nearer ones are joined.
    Rows without coordinates take no part.
    """
    located = locations.where("lng is not null and lat is not null")
    todo, done, radius = queries.where("lng is not null and lat is not null"), [], radius_m
    while radius < FAR_M:
        ranked = materialise(_ranked(radius_pairs(todo, located, radius, left_id=query_id), k), "nearest")
        full = ranked.where(F.col("rank") == k).select(F.col("left_id").alias(query_id))
        done.append(ranked.join(full.withColumnRenamed(query_id, "left_id").hint("merge"), "left_id", "left_semi"))
        todo = materialise(todo.join(full.hint("merge"), query_id, "left_anti"), "nearest")
        if todo.isEmpty():
            break
        radius *= 4
    else:
        done.append(_ranked(_far_pairs(todo, located, k, query_id), k))
    return reduce(DataFrame.unionByName, done).select(F.col("left_id").alias("query_id"), F.col("right_id").alias("id"), "distance_m", "rank")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    own = W.partitionBy("left_id").orderBy("distance_m", "right_id")
    return pairs.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("left_id", "right_id", "distance_m", "rank")


def _squares(points: DataFrame, lng: str = "lng", lat: str = "lat") -> DataFrame:
    """``points`` with the number of their one-degree cell."""
    gx = F.floor(F.pmod(F.col(lng) + 180.0, F.lit(360.0)))
    return points.withColumn("square", gx * 180 + F.least(F.floor(F.col(lat) + 90.0), F.lit(179)))


def _middles(squares: DataFrame) -> DataFrame:
    """``squares`` (one row a cell) with the point in their middle."""
    return squares.withColumns({"lng": F.expr("square div 180") - 179.5, "lat": F.col("square") % 180 - 89.5})


def _square_bounds(asked: DataFrame, full: DataFrame, k: int) -> DataFrame:
    """Pairs (square, other, bound): the cells that can hold one of the k nearest of any query in a cell.

    ``asked`` are cells with queries, ``full`` cells with locations and their number n, 64,800 at
    most of both.  Rounds take four times the radius for cells around which fewer than k are counted;
    ``bound`` is how far the middle of the cell that holds the k-th is from the own one.
    """
    todo, radius, out = asked, FAR_M, []
    while True:
        reach = radius_pairs(todo, full, radius, left_id="square", right_id="square").join(full.select(F.col("square").alias("right_id"), "n").hint("merge"), "right_id")
        along = F.sum("n").over(W.partitionBy("left_id").orderBy("distance_m", "right_id"))
        last = radius >= geo.HALF_GLOBE_M
        bound = F.min(F.when(F.col("held") >= k, F.col("distance_m")))
        bounds = reach.withColumn("held", along).groupBy(F.col("left_id").alias("square")).agg((F.coalesce(bound, F.lit(geo.HALF_GLOBE_M)) if last else bound).alias("bound"))
        done = materialise(todo.join(bounds.where("bound is not null").hint("merge"), "square"), "bounds")
        near = radius_pairs(done, full, min(radius, geo.HALF_GLOBE_M) + 4 * DEGREE_HALF_DIAGONAL_M, left_id="square", right_id="square").withColumnsRenamed({"left_id": "square", "right_id": "other"})
        out.append(near.join(done.select("square", "bound").hint("merge"), "square").where(F.col("distance_m") <= F.col("bound") + 4 * DEGREE_HALF_DIAGONAL_M).select("square", "other", "bound"))
        todo = materialise(todo.join(done.select("square").hint("merge"), "square", "left_anti"), "squares")
        if last or todo.isEmpty():
            return reduce(DataFrame.union, out)
        radius *= 4


def _far_pairs(queries: DataFrame, located: DataFrame, k: int, query_id: str) -> DataFrame:
    """Pairs among which the k nearest of each query are.

    What is near is settled for pairs of cells, once for all queries of a cell; then each query
    meets the rows of the cells that can matter to it.
    """
    gridded = _squares(located)
    full = _middles(materialise(gridded.groupBy("square").agg(F.count("*").alias("n")), "cells"))
    asked = _squares(queries.select(F.col(query_id).alias("left_id"), F.col("lng").alias("x1"), F.col("lat").alias("y1")), "x1", "y1")
    pairs = materialise(_square_bounds(_middles(materialise(asked.select("square").distinct(), "asked")), full, k), "cell-pairs")
    near = asked.join(pairs.hint("merge"), "square")
    middle = geo.distance_m(F.col("x1"), F.col("y1"), F.expr("other div 180") - 179.5, F.col("other") % 180 - 89.5)
    near = near.where(middle <= F.col("bound") + 3 * DEGREE_HALF_DIAGONAL_M).select("left_id", "x1", "y1", F.col("other").alias("square"))
    rows = gridded.select(F.col("id").alias("right_id"), F.col("lng").alias("x2"), F.col("lat").alias("y2"), "square")
    return near.join(rows.hint("merge"), "square").withColumn("distance_m", geo.distance_m(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


MOST_FEATURES = 50_000  # fixed value: features of a box above which it is thinned


def box_rows(locations: DataFrame, west: float, south: float, east: float, north: float, most: int = MOST_FEATURES, categories: str | None = None, chains: str | None = None) -> DataFrame:
    """A box as the API gives it: counted first, then whole, or above ``most`` thinned by a step from the box's size.

    Only the count comes to the driver.  Of a thinned box the row with the smallest id of each cell stays.
    """
    inside = in_bbox(locations, west, south, east, north, categories, chains)
    if inside.count() <= most:
        return inside
    return thin_by_cell(inside, geo.thinning_step(west, south, east, north, most))


def like_search(locations: DataFrame, pattern: str, limit: int | None = 100) -> DataFrame:
    """Case-insensitive LIKE %pattern% on name, address or city (% and _ are wildcards)."""
    hit = F.lit(False)
    for c in ("name", "address", "city"):
        hit = hit | F.col(c).ilike(f"%{pattern}%")
    out = locations.where(hit)
    return out.orderBy("id").limit(limit) if limit else out


def substring_search(locations: DataFrame, text: str, limit: int | None = 100) -> DataFrame:
    """Substring of name, address and city joined by spaces, lower-cased; blank text finds nothing."""
    wanted = text.strip().lower()
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in ("name", "address", "city"))))
    out = locations.where(joined.contains(wanted) if wanted else F.lit(False))
    return out.orderBy("chain_slug", "id").limit(limit) if limit else out


def chain_search(chains: DataFrame, text: str) -> DataFrame:
    wanted = text.strip().lower()
    return chains.where(F.lower("name").contains(wanted) | F.lower("slug").contains(wanted))
