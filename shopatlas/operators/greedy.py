"""The order-dependent clean-up: stores in id order, each absorbing its surviving neighbours."""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.storage import materialise
from .components import connected_components
from .resolve import RADIUS_M, cell_edges, named_points, with_cell
from .search import radius_pairs
from .sphere import Grid

REPLAYED = 100_000  # places of the largest component that one task holds


def greedy_losers(locations: DataFrame, radius_m: float = RADIUS_M, chain: str = "chain_id") -> DataFrame:
    """Ids that the greedy rule drops.

    All rows at one place have the same neighbours, so the first store that takes one of them takes
    all: a place is a node that has its smallest id (the next to absorb) and its most complete row.
    Places that can touch each other form components.  One place alone is settled by an
    aggregation, a component of at most REPLAYED places is replayed in id order by one task, which
    holds one component at a time, and larger ones go by rounds of joins.
    """
    score = text.richness(F.col("address"), F.col("district"), F.col("city"))
    store = [chain, "norm_name"]
    rows = materialise(named_points(locations, chain).select("id", *store, "lng", "lat", score.alias("score")), "rows")
    places = materialise(with_cell(places_of(rows, store), radius_m, store), "places")
    roots = connected_components(cell_edges(places, radius_m, store))
    rooted = materialise(places.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")
    sizes = materialise(rooted.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    sized = rooted.join(sizes.hint("merge"), "root")
    alone = sized.where("n = 1").select(F.when(F.col("first_score") >= F.col("top_score"), F.col("place")).otherwise(F.col("top")).alias("id"))
    few = sized.where((F.col("n") > 1) & (F.col("n") <= REPLAYED)).select("root", "place", "lng", "lat", "top", F.array("top_score.*").alias("top_score"), F.array("first_score.*").alias("first_score"))
    replayed = few.repartition("root").sortWithinPartitions("root", "place").mapInArrow(_replayed(radius_m), "id long")
    kept = [alone, replayed]
    if not sizes.where(F.col("n") > REPLAYED).isEmpty():
        kept.append(survivors_by_rounds(materialise(sized.where(F.col("n") > REPLAYED).drop("root", "n"), "large"), radius_m, store))
    return rows.select("id").join(reduce(DataFrame.union, kept).hint("merge"), "id", "left_anti")


def places_of(rows: DataFrame, store: list[str]) -> DataFrame:
    """Per place: its smallest id and that row's score, its most complete row and the score."""
    rank = F.struct("score", -F.col("id"))
    return rows.groupBy(*store, "lng", "lat").agg(F.min("id").alias("place"), F.max_by("id", rank).alias("top"), F.max("score").alias("top_score"), F.min_by("score", "id").alias("first_score"))


def survivors(places: list[tuple], radius_m: float) -> list[int]:
    """Ids that stay, of (place, lng, lat, top, top score, score of the place's own row) of one component."""
    grid = Grid(radius_m)
    for k, (_, lng, lat, *_) in enumerate(places):
        grid.add(k, lng, lat)
    return absorb([p[0] for p in places], [p[3] for p in places], [tuple(p[4]) for p in places], [tuple(p[5]) for p in places], lambda k: grid.near(places[k][1], places[k][2]))


def absorb(ids: list[int], tops: list[int], top_scores: list[tuple], scores: list[tuple], near: Callable[[int], list[int]]) -> list[int]:
    """Ids that stay of places: their smallest ids, most complete rows, the scores of both, and the places near each (itself included)."""
    alive = [(s, -t) for s, t in zip(top_scores, tops, strict=True)]  # the most complete row of each place; None: gone
    score = list(scores)
    queue = list(zip(ids, range(len(ids)), strict=True))
    heapq.heapify(queue)
    waiting: list[int | None] = list(ids)
    while queue:
        seed, k = heapq.heappop(queue)
        if waiting[k] != seed:
            continue
        around = near(k)
        best, at = max((alive[j], -ids[j], j) for j in around if alive[j] is not None)[::2]
        winner = -best[1]
        if score[k] >= best[0]:  # the store that absorbs wins among equals
            best, at, winner = (score[k], -seed), k, seed
        for j in around:
            alive[j] = waiting[j] = None
        alive[at], score[at] = best, best[0]
        if winner > seed:  # it is still to act itself
            waiting[at] = winner
            heapq.heappush(queue, (winner, at))
    return [-a[1] for a in alive if a is not None]


def _replayed(radius_m: float):
    """``mapInArrow`` function: places in the order of their component to the ids that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for root, *place in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if root != now and held:
                    out += survivors(held, radius_m)
                    held = []
                now = root
                held.append(place)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["id"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(survivors(held, radius_m), pa.int64())], ["id"])

    return run


def survivors_by_rounds(places: DataFrame, radius_m: float, store: list[str]) -> DataFrame:
    """Ids that stay, found in rounds of joins.

    A place acts in a round when no other within two steps of it acts before it by id; those that
    act together can't touch each other's neighbours.  Places near which nothing is left to act
    leave the rounds.
    """
    pairs = radius_pairs(places, places, radius_m, on=tuple(store), left_id="place", right_id="place").where("left_id <> right_id")
    near = materialise(pairs.select(F.col("left_id").alias("place"), F.col("right_id").alias("other")).union(places.select("place", F.col("place").alias("other"))), "near")
    # next: the id that is still to act (null: none); alive: the row that still stands at a touched place
    state = places.select("place", F.col("place").alias("next"), F.col("top").alias("alive"), F.col("top_score").alias("alive_score"), F.col("first_score").alias("next_score"))
    settled = []
    while True:
        state = materialise(state, "state")
        waiting = state.where("next is not null").select("place", "next")
        if waiting.isEmpty():
            break
        one = materialise(near.join(waiting.withColumnRenamed("place", "other").hint("merge"), "other").groupBy("place").agg(F.min("next").alias("least")), "least")
        settled.append(state.join(one.hint("merge"), "place", "left_anti").where("alive is not null").select(F.col("alive").alias("id")))
        state = state.join(one.select("place").hint("merge"), "place", "left_semi")
        two = near.join(one.withColumnRenamed("place", "other").hint("merge"), "other").groupBy("place").agg(F.min("least").alias("least"))
        acting = waiting.join(two.hint("merge"), "place").where("next = least").select(F.col("place").alias("by"), F.col("next").alias("seed"))
        acting = acting.join(state.select(F.col("place").alias("by"), F.col("next_score").alias("seed_score")).hint("merge"), "by")
        reach = near.withColumnRenamed("place", "by").join(acting.hint("merge"), "by").select("by", "seed", "seed_score", F.col("other").alias("place"))
        touched = materialise(reach.join(state.select("place", "alive", "alive_score").hint("merge"), "place", "left"), "touched")
        best = touched.where("alive is not null").groupBy("by", "seed", "seed_score").agg(F.max(F.struct(F.col("alive_score").alias("score"), (-F.col("alive")).alias("minus"), F.col("place").alias("at"))).alias("b"))
        # the store that absorbs wins among equals
        own = F.col("seed_score") >= F.col("b.score")
        won = best.select("by", F.when(own, F.col("seed")).otherwise(-F.col("b.minus")).alias("winner"), F.when(own, F.col("by")).otherwise(F.col("b.at")).alias("at"), F.col("b.score").alias("won_score"), F.col("seed").alias("by_seed"))
        change = touched.select("by", "place").join(won.hint("merge"), "by").select("place", F.when(F.col("place") == F.col("at"), F.struct("winner", "won_score", "by_seed")).alias("c"), F.lit(True).alias("hit"))
        after = state.join(change.hint("merge"), "place", "left")
        hit = F.coalesce("hit", F.lit(False))
        # a winner with a larger id than the one that absorbed is still to act itself
        later = F.when(F.col("c.winner") > F.col("c.by_seed"), F.col("c.winner"))
        state = after.select("place", F.when(hit, later).otherwise(F.col("next")).alias("next"), F.when(hit, F.col("c.winner")).otherwise(F.col("alive")).alias("alive"), F.when(hit, F.col("c.won_score")).otherwise(F.col("alive_score")).alias("alive_score"), F.when(hit, F.col("c.won_score")).otherwise(F.col("next_score")).alias("next_score"))
    return reduce(DataFrame.union, [*settled, state.where("alive is not null").select(F.col("alive").alias("id"))])
