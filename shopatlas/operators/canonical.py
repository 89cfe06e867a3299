"""Known ids for a batch of stores, as if its records were resolved and upserted one after the other."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..plans.storage import materialise
from . import local
from .components import connected_components
from .resolve import RADIUS_M, cell_edges, with_cell
from .sphere import Grid

PLACE = ["chain_id", "norm_name", "lng", "lat"]
CELL = ["chain_id", "norm_name", "rx", "ry"]
CELL_REACH_M = 16.0  # two points of one cell of four decimals are not farther apart


def _named(store_name: str | None) -> Column:
    """The normalised name of a located record, else null."""
    name = F.col(store_name) if store_name else text.store_name(F.col("name"))
    return F.when((name != "") & F.col("lng").isNotNull() & F.col("lat").isNotNull(), name)


def _cell(c: str) -> Column:
    return geo.round_half_even(F.col(c), 4)


def _linked(rows: DataFrame, large: DataFrame | None, radius_m: float) -> DataFrame:
    """Edges (a, b) between nodes whose records may touch each other: cells of ``large`` stores near each other, and all nodes of one id."""
    key = ["chain_id", "external_id"]
    held = materialise(rows.where("external_id is not null").select(*key, "node").distinct(), "ids")
    several = held.groupBy(*key).agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").drop("z")
    recur = held.join(several.hint("merge"), key).select("a", F.col("node").alias("b"))
    return recur if large is None else cell_edges(large, radius_m, ["chain_id", "norm_name"]).union(recur)


class _Table:
    """The rows that a component's records see: where each id stands now, the first written first."""

    def __init__(self, radius_m: float):
        self.rows: dict[tuple, tuple] = {}
        self.grid = Grid(radius_m)
        self.known: dict[tuple, str] = {}

    def near(self, store: tuple, lng: float, lat: float):
        """The id of the first row of the same store within the radius."""
        found = self.grid.near(lng, lat, store)
        return min(found, key=lambda key: self.rows[key][0])[1] if found else None

    def write(self, key: tuple, store: tuple | None, lng: float, lat: float) -> None:
        """Insert or move a row; one without a place can't be found."""
        rank = len(self.rows)
        if key in self.rows:
            rank, old, at_lng, at_lat = self.rows[key]
            if old:
                self.grid.remove(key, at_lng, at_lat, old)
        self.rows[key] = (rank, store, lng, lat)
        if store:
            self.grid.add(key, lng, lat, store)


def _replayed(radius_m: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function: records in the order of (root, ordinal, external_id) to (ordinal, known_id) of the first of each cell.

    It holds the rows and cells of one component at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table = None, _Table(radius_m)
        for batch in batches:
            ordinals, ids = [], []
            for root, ordinal, chain, external_id, name, lng, lat, cx, cy in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if root != now:
                    now, table = root, _Table(radius_m)
                store, found = (chain, name) if name is not None else None, external_id
                if store and ordinal >= 0:
                    cell = (store, cx, cy)
                    if cell in table.known:
                        found = table.known[cell]
                    else:
                        near = table.near(store, lng, lat)
                        found = table.known[cell] = external_id if near is None else near
                        ordinals.append(ordinal)
                        ids.append(found)
                if found is not None:
                    table.write((chain, found), store, lng, lat)
            yield pa.RecordBatch.from_arrays([pa.array(ordinals, pa.int64()), pa.array(ids, pa.string())], ["ordinal", "known_id"])

    return run


def canonical_ids(snapshot: DataFrame, batch: DataFrame, radius_m: float = RADIUS_M, store_name: str | None = None) -> DataFrame:
    """``batch`` with the external id under which each store is known when its turn comes.

    Both have chain_id, external_id (string), name, lng, lat, and the batch a unique ``ordinal``
    (0 or more); other columns of the batch pass through.  ``store_name`` names a column of both that
    holds the normalised names already.  Records are taken by ordinal.  Each has
    the id that an earlier record of its cell (chain, normalised name, coordinates to four decimals)
    was given; else that of the first row of the table, as it is then, of its chain and normalised
    name within the radius (stored rows first, by id; then new ones in the order they came); else
    its own.  It then takes that id's row over: the row has its name and place from now on.  A
    record without name or coordinates keeps its own id and leaves that id's row without a place.

    Records that can touch each other form components: all of one name, or of a name with more than
    ``local.MOST`` records those of neighbouring cells; and by ids that recur.  A component of one place, however many copies it has, is settled by an aggregation.
    Of others only what comes before the last new cell can matter; that is replayed in order,
    component by component, in a stream whose memory is the component's ids.
    """
    key = ["chain_id", "external_id", _named(store_name).alias("norm_name"), "lng", "lat"]
    rows = snapshot.select(*key, F.lit(-1).cast("long").alias("ordinal")).unionByName(batch.select(*key, F.col("ordinal").cast("long").alias("ordinal")))
    rows = rows.withColumns({"rx": F.when(F.col("norm_name").isNotNull(), _cell("lng")), "ry": F.when(F.col("norm_name").isNotNull(), _cell("lat"))})
    reach = max(radius_m, CELL_REACH_M)
    apart = F.xxhash64(F.lit("id"), "chain_id", "external_id")
    rows = with_cell(rows, reach, ["chain_id", "norm_name"]).withColumns({"node": F.when(F.col("norm_name").isNotNull(), F.col("node")).otherwise(apart), "store": F.when(F.col("norm_name").isNotNull(), F.xxhash64("chain_id", "norm_name"))})
    rows = materialise(rows, "records")  # two nodes of one hash only make a component larger
    large = local.large_stores(rows)  # their cells are nodes; of a smaller store all records are one
    rows = rows.withColumn("_large", F.lit(False)) if large is None else rows.join(large.withColumn("_large", F.lit(True)), "store", "left")
    rows = rows.withColumn("node", F.when(F.coalesce("_large", F.lit(False)) | F.col("store").isNull(), F.col("node")).otherwise(F.col("store")))
    roots = connected_components(_linked(rows, rows.where("_large") if large is not None else None, reach))
    rows = rows.drop("store", "_large")
    rooted = materialise(rows.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node"), "rooted")
    placed = rooted.where("norm_name is not null")
    firsts = materialise(placed.where("ordinal >= 0").groupBy("root", *CELL).agg(F.min("ordinal").alias("ordinal")), "cells")
    last = firsts.groupBy("root").agg(F.max("ordinal").alias("last"))
    place = F.struct(*PLACE, F.when(F.col("norm_name").isNull(), F.col("external_id")))
    kinds = rooted.groupBy("root").agg(F.min(place).alias("low"), F.max(place).alias("high")).select("root", F.col("low").eqNullSafe(F.col("high")).alias("single"))
    kinds = materialise(kinds.join(last.hint("merge"), "root"), "components")
    single = placed.join(kinds.where("single").hint("merge"), "root", "left_semi").groupBy("root").agg(F.min(F.struct("ordinal", "external_id")).alias("best"))
    settled = firsts.join(single.hint("merge"), "root").select(*CELL, F.col("best.external_id").alias("known_id"))
    mixed = rooted.join(kinds.where("not single").drop("single").hint("merge"), "root").where(F.col("ordinal") <= F.col("last"))
    mixed = mixed.select("root", "ordinal", F.col("chain_id").cast("string").alias("chain_id"), "external_id", "norm_name", "lng", "lat", "rx", "ry").repartition("root").sortWithinPartitions("root", "ordinal", "external_id")
    answers = materialise(mixed.mapInArrow(_replayed(radius_m), "ordinal long, known_id string"), "replayed")
    known = settled.union(firsts.join(answers.hint("merge"), "ordinal").select(*CELL, "known_id")).toDF("_chain", "_norm", "_x", "_y", "known_id")
    own = batch.withColumn("_name", _named(store_name)).alias("b")
    same = (F.col("b.chain_id") == F.col("_chain")) & (F.col("b._name") == F.col("_norm")) & (_cell("b.lng") == F.col("_x")) & (_cell("b.lat") == F.col("_y"))
    found = own.join(known.hint("merge"), same, "left")
    return found.select(*(F.coalesce("known_id", "b.external_id").alias(c) if c == "external_id" else F.col(f"b.{c}") for c in batch.columns))
