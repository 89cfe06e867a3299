"""Stores of moderate size settled inside tasks: a store's rows lie together, and neighbours are found along the latitude."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.storage import materialise

MOST = 2_000  # rows of a store that are settled in one task's hands; larger stores go by joins
SLACK = 1e-9  # degrees, so that rounding loses no neighbour


def large_stores(rows: DataFrame, store: str = "store") -> DataFrame | None:
    """Hashes of stores of more than MOST rows, None without any; counted by hash, so a hot one is never moved to one task."""
    large = materialise(rows.where(F.col(store).isNotNull()).groupBy(store).agg(F.count("*").alias("n")).where(F.col("n") > MOST).select(store), "large-stores")
    return None if large.isEmpty() else large


def metres(lng1: np.ndarray, lat1: np.ndarray, lng2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Great-circle distances, as ``geo.distance_m``."""
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def near_pairs(store: np.ndarray, other: np.ndarray, lng: np.ndarray, lat: np.ndarray, radius_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of rows of one store within the radius; rows are in the order of store and latitude.

    ``store`` and ``other`` are two hashes of a store's chain and name.
    """
    reach = np.degrees(radius_m / geo.EARTH_RADIUS_M) + SLACK
    left, right = [], []
    i, step = np.arange(len(store)), 1
    while True:
        i = i[i + step < len(store)]
        i = i[(store[i + step] == store[i]) & (lat[i + step] - lat[i] <= reach)]
        if not len(i):
            break
        j = i + step
        hit = (other[i] == other[j]) & (metres(lng[i], lat[i], lng[j], lat[j]) <= radius_m)
        left.append(i[hit])
        right.append(j[hit])
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest position that pairs connect to it."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        apart = a != b
        if not apart.any():
            return root
        left, right, a, b = left[apart], right[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def by_store(rows: DataFrame, store: str, run: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``run`` over tables that hold whole stores, their rows in the order of store, place and id.

    A table is about an Arrow batch long; a store that goes on in the next batch waits for it.
    """

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in source:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(store)).to_numpy(zero_copy_only=False)
            starts = int(np.searchsorted(column, column[-1]))  # of the last store, which may go on
            if starts or (held and held[-1].column(batch.schema.get_field_index(store))[-1].as_py() != column[-1]):
                whole = [*held, batch.slice(0, starts)]
                held = []
                yield run(pa.Table.from_batches(whole).combine_chunks())
            held.append(batch.slice(starts))
        if held:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(store).sortWithinPartitions(store, "lat", "lng", "other", "id").mapInArrow(batches, schema)


class _Places:
    """The places of a table's rows, in which copies of one store lie together, and their components."""

    def __init__(self, table: pa.Table, radius_m: float):
        store, other, self.ids, lng, lat, *scores = (table.column(c).to_numpy() for c in ("store", "other", "id", "lng", "lat", "s1", "s2", "s3"))
        new = np.ones(len(store), bool)
        new[1:] = (store[1:] != store[:-1]) | (other[1:] != other[:-1]) | (lng[1:] != lng[:-1]) | (lat[1:] != lat[:-1])
        self.first, self.of_row, self.scores = np.flatnonzero(new), np.cumsum(new) - 1, scores
        self.left, self.right = near_pairs(*(x[self.first] for x in (store, other, lng, lat)), radius_m)
        self.root = components(len(self.first), self.left, self.right)[self.of_row]

    def best(self, group: np.ndarray) -> np.ndarray:
        """The most complete row of each group, of equals that with the smallest id; groups in ascending order."""
        order = np.lexsort((-self.ids, *reversed(self.scores), group))
        return order[np.append(group[order][1:] != group[order][:-1], True)]

    def result(self, keep: np.ndarray) -> pa.RecordBatch:
        least = np.full(len(self.ids), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.ids)
        stays = np.zeros(len(self.ids), bool)
        stays[keep] = True
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.array(least[self.root]), pa.array(stays)], ["id", "cluster", "keep"])


def clusters(radius_m: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """id, cluster, keep of rows (store, other, id, lng, lat, s1, s2, s3): the smallest id of a component, and its most complete row."""

    def run(table: pa.Table) -> pa.RecordBatch:
        places = _Places(table, radius_m)
        return places.result(places.best(places.root))

    return run


def greedy_clusters(radius_m: float) -> Callable[[pa.Table], pa.RecordBatch]:
    """As ``clusters``, but those rows stay that the greedy rule keeps."""
    from .greedy import absorb

    def run(table: pa.Table) -> pa.RecordBatch:
        p = _Places(table, radius_m)
        top = p.best(p.of_row)
        near: dict[int, list[int]] = {}
        for a, b in zip(p.left.tolist(), p.right.tolist(), strict=True):
            near.setdefault(a, [a]).append(b)
            near.setdefault(b, [b]).append(a)
        linked = np.fromiter(near, np.int64, len(near))
        at = {k: n for n, k in enumerate(near)}
        around = [[at[j] for j in found] for found in near.values()]
        score = lambda rows: list(zip(*(s[rows].tolist() for s in p.scores), strict=True))
        first, best = p.first[linked], top[linked]
        kept = absorb(p.ids[first].tolist(), p.ids[best].tolist(), score(best), score(first), around.__getitem__)
        alone = np.ones(len(top), bool)
        alone[linked] = False
        return p.result(np.append(top[alone], np.flatnonzero(np.isin(p.ids, np.array(kept, np.int64)))))

    return run
