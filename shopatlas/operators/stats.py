"""Counts, coverage and tallies over locations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scope
from ..plans.storage import materialise


def chain_counts(chains: DataFrame, locations: DataFrame, variant: str = "api") -> DataFrame:
    """Chains with location_count, chains without locations included.

    ``api``: rows in query scope, with or without coordinates; ``export``: rows with coordinates,
    whatever their scope.
    """
    if variant == "api":
        counted = locations.where(scope.query_scope(F.col("province"), F.col("city")))
    elif variant == "export":
        counted = locations.where(F.col("lng").isNotNull() & F.col("lat").isNotNull())
    else:
        raise ValueError(f"unknown variant: {variant}")
    n = counted.groupBy("chain_id").agg(F.count("*").alias("n"))
    return chains.join(n, chains.id == n.chain_id, "left").select("id", "name", "slug", "category_id", F.coalesce("n", F.lit(0)).alias("location_count"))


def manifest(chain_totals: DataFrame) -> DataFrame:
    """One row: the sorted slugs (a few dozen) and the total of all chains."""
    return chain_totals.agg(F.array_sort(F.collect_list("slug")).alias("chains"), F.coalesce(F.sum("location_count"), F.lit(0)).alias("location_count"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def coverage(expected: DataFrame, observed: DataFrame, least: int = 40, flag_below: float = 1.05) -> DataFrame:
    """city, expected, observed, ratio, flagged for cities expected to have at least ``least`` stores.

    ``expected`` and ``observed`` are rows of stores with a ``city``.
    """
    want, have = count_by(expected, "city").withColumnRenamed("n", "expected"), count_by(observed, "city").withColumnRenamed("n", "observed")
    out = want.where(F.col("expected") >= least).join(have, "city", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    ratio = F.col("observed") / F.col("expected")
    return out.select("city", "expected", "observed", ratio.alias("ratio"), (ratio < flag_below).alias("flagged"))


def tally(df: DataFrame, key: str, unknown: str = "unknown") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(key), F.lit(unknown)).alias(key)).agg(F.count("*").alias("n"))


def conditional_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def distinct_ids(df: DataFrame, key: str, by: str, approximate: bool = False) -> DataFrame:
    return df.groupBy(by).agg((F.approx_count_distinct(key) if approximate else F.count_distinct(key)).alias("distinct_ids"))


def fully_selected(categories: DataFrame, chains: DataFrame, selected: DataFrame) -> DataFrame:
    """Categories with whether all of their chains (none: yes) are among ``selected`` slugs."""
    marks = _marks(chains, selected).groupBy("category_id").agg(F.bool_and("sel").alias("every"))
    return categories.join(marks, categories.id == marks.category_id, "left").select("slug", F.coalesce("every", F.lit(True)).alias("selected"))


def _marks(chains: DataFrame, selected: DataFrame) -> DataFrame:
    mine = selected.select(F.col("slug"), F.lit(True).alias("sel")).distinct()
    return chains.join(mine, "slug", "left").withColumn("sel", F.coalesce("sel", F.lit(False)))


def selected_totals(categories: DataFrame, chain_totals: DataFrame, selected: DataFrame) -> DataFrame:
    """Per category the stores of its selected chains, and all / some / none (an empty category: none)."""
    marks = _marks(chain_totals, selected).groupBy("category_id").agg(F.sum(F.when(F.col("sel"), F.col("location_count")).otherwise(0)).alias("stores"), F.bool_and("sel").alias("every"), F.bool_or("sel").alias("any"))
    state = F.when(F.col("every"), "all").when(F.col("any"), "some").otherwise("none")
    return categories.join(marks, categories.id == marks.category_id, "left").select("slug", F.coalesce("stores", F.lit(0)).alias("stores"), state.alias("state"))


def toggle(selected: DataFrame, chains: DataFrame, category_id: int, on: bool) -> DataFrame:
    """Selected slugs after a category is switched on (union) or off (difference)."""
    own = chains.where(F.col("category_id") == category_id).select("slug")
    return selected.select("slug").union(own).distinct() if on else selected.select("slug").distinct().join(own, "slug", "left_anti")


def first_seen(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``; an aggregation ahead of the shuffle, no window."""
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(rest, F.struct(*order)).alias("_row")).select("_row.*")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    rest = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(rest, F.struct(*order)).alias("_row")).select("_row.*")


def plateau_windows(log: DataFrame, size: int, least_stores: int | str, most_new: int, queue: str | None = None, by: str | None = None) -> DataFrame:
    """New stores per ``size`` requests: window, requests, new_stores, store_count, stop, after ``by`` where that is given.

    ``log`` has ``seq`` (1, 2, ..., of each ``by`` on its own) and ``store``.  stop marks the first full window with at least
    ``least_stores`` so far (a number, or a column that holds it) and fewer than ``most_new`` new ones (and an empty queue
    where a column holds its length).  Only one row a window passes through the running sum.
    """
    own = [by] if by else []
    window = F.floor((F.col("seq") - 1) / size).alias("window")
    new = log.groupBy(*own, "store").agg(F.min("seq").alias("seq")).groupBy(*own, window).agg(F.count("*").alias("new_stores"))
    length = F.max_by(queue, "seq") if queue else F.lit(0)
    least = F.max(least_stores) if isinstance(least_stores, str) else F.lit(least_stores)
    every = log.groupBy(*own, window).agg(F.count("*").alias("requests"), length.alias("queue"), least.alias("least"))
    out = every.join(new.hint("merge"), [*own, "window"], "left").withColumn("new_stores", F.coalesce("new_stores", F.lit(0)))
    along = (W.partitionBy(*own) if by else W.partitionBy(F.lit(0))).orderBy("window")
    out = out.withColumn("store_count", F.sum("new_stores").over(along.rowsBetween(W.unboundedPreceding, 0)))
    hit = (F.col("requests") == size) & (F.col("store_count") >= F.col("least")) & (F.col("new_stores") < most_new) & (F.col("queue") <= 0)
    first = F.min(F.when(hit, F.col("window"))).over(along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return out.select(*own, "window", "requests", "new_stores", "store_count", F.coalesce(F.col("window") == first, F.lit(False)).alias("stop"))


def pending_small_first(counts: DataFrame, completed: DataFrame) -> DataFrame:
    """Cities (city, n) that are not completed, those with few expected stores first, each with its place."""
    left = counts.join(completed.select("city").distinct(), "city", "left_anti")
    return left.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("n", "city"))).orderBy("place")  # a row a city


def number_within(df: DataFrame, by: str, order: list[str], name: str = "seq") -> DataFrame:
    """Adds 1, 2, ... in the given order within each ``by``, of which one may hold most rows.

    Rows are cut into ranges of (by, order) and numbered within them.  What stands before a range's
    part of a key is a table of at most one row a range and key.
    """
    parts = materialise(df.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = materialise(parts.groupBy("_part", by).agg(F.count("*").alias("_n")), "sizes")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_part", by).orderBy(*order))
    offsets = sizes.select(F.col("_part").alias("_p"), F.col(by).alias("_c"), before.alias("_before"))
    joined = parts.withColumn("_rn", own).join(offsets.hint("merge"), (F.col("_part") == F.col("_p")) & F.col(by).eqNullSafe(F.col("_c")))
    return joined.select(*df.columns, (F.col("_rn") + F.col("_before")).cast("long").alias(name))


def number_by(df: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Adds 1, 2, ... in the given order without one task seeing all rows.

    Rows are range-partitioned and numbered within their part; the parts' counts (one number a
    part) are the only thing on the driver.  Ties in ``order`` are numbered arbitrarily, so give a
    unique one.
    """
    parts = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}
    before, total = [], 0
    for p in sorted(counts):
        before += [F.lit(p), F.lit(total).cast("long")]
        total += counts[p]
    own = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    offset = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0).cast("long")
    return parts.withColumn(name, own + offset).drop("_part")
