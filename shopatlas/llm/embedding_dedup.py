"""Near-duplicate vectors by a robust-pruned graph built on overlapping cluster shards.

Equal vectors of a label are one node.  Each label is cut into shards by centroids (fitted on a
bounded sample; a shard that comes out too large is cut again by centroids of its own), every node goes to its
OVERLAP nearest shards, each shard prunes its nodes'
nearest candidates to a flat graph, and the lists of all shards make one graph: a node has its
neighbours in every shard that holds it.  Each node searches from itself and the medoids of its
shards and expands over everything in range; a search that reaches a node held by shards where it
has not been goes on there in the next round, entering at all such nodes, until none has anywhere
left to go.  What is found is verified in double precision.  A task gives each node's links in its shard as
one packed list and ties the nodes by a tree, so that a dense group costs no row a pair.  An audit compares hash samples of each label's rows with all of the label,
more of them where few have links; recall of the queries of any label below the target widens the
shards' overlap and the search, and a result that stays below what is promised is an error.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import bound_batches, hot_keys, materialise, salted_join

THRESHOLD = 0.93
SHARD, MOST_SHARDS, SAMPLE_PER_SHARD = 1500, 1024, 32
LARGE, CUTS = 6000, 4  # rows of a shard from which it is cut again; how often that is done
OVERLAP, CANDIDATES, DEGREE, ALPHA, BEAM = 2, 64, 24, 1.2, 16
SLACK = 0.06  # the search expands nodes whose cosine is at most this far below the threshold
AUDIT_DRAWS, AUDIT_LINKED = (200, 800, 3200), 50  # queries a label until so many have links
RECALL_TARGET, RECALL_LEAST, ATTEMPTS = 0.97, 0.9, 4
BLOCK = 512
GUESTS = 8192  # searches from elsewhere that a task runs in a shard; rows of a chunk
LINKS_AT_ONCE = 1 << 18  # links that a search holds before it hands them on, so that a dense shard does not hold all of its own


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision."""
    v = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def k_means(vectors: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids; the first ones are rows spread over the sample."""
    centres = vectors[np.linspace(0, len(vectors) - 1, k).astype(int)]
    for _ in range(rounds):
        nearest = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, vectors)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), centres)
    return centres


def robust_prune(vectors: np.ndarray) -> np.ndarray:
    """Neighbours of each row, -1 where there are fewer: nearest first, none that a chosen one makes needless."""
    n = len(vectors)
    width = min(CANDIDATES, n - 1)
    out = np.full((n, min(DEGREE, max(width, 0))), -1, np.int64)
    for lo in range(0, n if width > 0 else 0, BLOCK):
        own = np.arange(lo, min(lo + BLOCK, n))
        near = vectors[own] @ vectors.T
        near[np.arange(len(own)), own] = -2
        pick = np.argpartition(-near, width - 1, axis=1)[:, :width]
        order = np.argsort(-np.take_along_axis(near, pick, 1), axis=1, kind="stable")
        pick = np.take_along_axis(pick, order, 1)
        far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(near, pick, 1), 0))
        group = vectors[pick]
        between = np.sqrt(np.maximum(2 - 2 * np.matmul(group, group.transpose(0, 2, 1)), 0))
        alive = np.ones(pick.shape, bool)
        rows = np.arange(len(own))
        for d in range(out.shape[1]):
            first = alive.argmax(1)
            some = alive[rows, first]
            if not some.any():
                break
            out[own[some], d] = pick[rows[some], first[some]]
            gone = ALPHA * between[rows, first] <= far
            alive &= ~gone | ~some[:, None]
            alive[rows, first] = False
    return out


def medoid(vectors: np.ndarray) -> int:
    return int((vectors @ vectors.mean(0)).argmax())


def range_search(vectors: np.ndarray, neighbours: list[np.ndarray], q: np.ndarray, entries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that the graph leads to from the entries, and their cosines to the unit vector ``q``."""
    seen = np.zeros(len(vectors), bool)
    ids = np.unique(entries)
    seen[ids] = True
    sims = vectors[ids] @ q
    done = np.zeros(len(vectors), bool)
    while True:
        # the best ``beam`` rows are expanded, and however many more there are in range
        floor = min(threshold - SLACK, float(np.partition(sims, -beam)[-beam])) if len(sims) > beam else -2.0
        todo = ids[(sims >= floor) & ~done[ids]]
        if not len(todo):
            return ids, sims
        done[todo] = True
        new = np.unique(np.concatenate([neighbours[t] for t in todo.tolist()]))
        new = new[~seen[new]]
        seen[new] = True
        ids, sims = np.concatenate([ids, new]), np.concatenate([sims, vectors[new] @ q])


def _matrix(packed: pa.ChunkedArray | pa.Array | list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision of packed ones, which are as wide as the table's."""
    held = packed if isinstance(packed, list) else packed.to_pylist()
    if not held:
        return np.zeros((0, dim))
    return unit(np.frombuffer(b"".join(held), np.float32 if len(held[0]) == 4 * dim else np.float64).reshape(-1, dim).astype(np.float64))


def _build(table: pa.Table) -> pa.Table:
    """The rows of a shard in order of their nodes, with the places of their neighbours in it."""
    table = table.sort_by("node")
    lists = robust_prune(_matrix(table.column("vector"), table.column("dim")[0].as_py()))
    return table.append_column("near", pa.array([r[r >= 0].tolist() for r in lists], pa.list_(pa.int32())))


INDEX = "node long, label long, dim long, vector binary, n long, homes array<long>, shard long"
FOUND = "a long, b long, links binary, n long, label long, dim long, vector binary, visited array<long>, to array<long>, entries array<array<long>>"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.binary()), ("n", pa.int64()), ("label", pa.int64()), ("dim", pa.int64()), ("vector", pa.binary()), ("visited", pa.list_(pa.int64())), ("to", pa.list_(pa.int64())), ("entries", pa.list_(pa.list_(pa.int64())))])


def local_roots(u: np.ndarray, v: np.ndarray, size: int) -> np.ndarray:
    """The smallest number that each of 0..size-1 is connected to by the edges u, v."""
    root = np.arange(size)
    while True:
        low = root.copy()
        np.minimum.at(low, u, root[v])
        np.minimum.at(low, v, root[u])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def link_lists(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> pa.Table:
    """FOUND rows of links (a, b) of nodes that stand for n rows each: lists of (other, n) by node, and edges that connect the same nodes."""
    who, other, n = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([n_b, n_a])
    order = np.lexsort((other, who))
    who, other, n = who[order], other[order], n[order]
    new = np.ones(len(who), bool)
    new[1:] = (who[1:] != who[:-1]) | (other[1:] != other[:-1])
    who, other, n = who[new], other[new], n[new]
    names, at = np.unique(who, return_index=True)
    ends = np.append(at[1:], len(who))[: len(at)].tolist()
    packed = np.stack([other, n], 1)
    lists = [packed[x:y].tobytes() for x, y in zip(at.tolist(), ends, strict=True)]
    root = local_roots(np.searchsorted(names, who), np.searchsorted(names, other), len(names))
    tied = np.flatnonzero(root != np.arange(len(names)))
    none = lambda k, rows: [pa.nulls(rows, f.type) for f in list(_FOUND)[k:]]
    return pa.concat_tables([
        pa.table([pa.array(names), pa.nulls(len(names), pa.int64()), pa.array(lists, pa.binary()), *none(3, len(names))], _FOUND),
        pa.table([pa.array(names[tied]), pa.array(names[root[tied]]), *none(2, len(tied))], _FOUND),
    ])


def _search(threshold: float, beam: int):
    """Searches in a shard: of its own rows, or where there are guests (rows with entries) of these.

    Rows out are lists of links and edges (``link_lists``), or searches that go on: shards ``to`` and the nodes to enter at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        label, dim = (table.column(k)[0].as_py() for k in ("label", "dim"))
        guest = table.column("entries").is_valid()
        guests, table = table.filter(guest), table.filter(pc.invert(guest)).sort_by("node")
        vectors = _matrix(table.column("vector"), dim)
        names, counts = table.column("node").to_numpy(), table.column("n").to_numpy()
        held = table.column("homes").to_pylist()
        homes = np.full((len(held), max(map(len, held), default=0)), -1, np.int64)
        for i, x in enumerate(held):
            homes[i, : len(x)] = x
        links: list[list[int]] = [[] for _ in names]
        for i, near in enumerate(table.column("near").to_pylist()):
            links[i].extend(near)
            for j in near:
                links[j].append(i)
        neighbours = [np.unique(np.array(x, np.int64)) for x in links]
        asking = guests if len(guests) else table
        asks, many, packed, visited = asking.column("node").to_numpy(), asking.column("n").to_numpy(), asking.column("vector").to_pylist(), asking.column("homes").to_pylist()
        queries = _matrix(packed, dim)
        doors = [np.searchsorted(names, x) for x in guests.column("entries").to_pylist()] if len(guests) else [[i] for i in range(len(names))]
        start = medoid(vectors)
        a, b, waiting = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        on: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            who, other = np.concatenate(a), np.concatenate(b)
            del a[1:], b[1:]
            yield from link_lists(asks[who], names[other], many[who], counts[other]).to_batches()
            yield from pa.Table.from_pylist(on, _FOUND).to_batches()
            on.clear()

        for k, (q, own) in enumerate(zip(queries, asks.tolist(), strict=True)):
            found, sims = range_search(vectors, neighbours, q, np.concatenate([[start], doors[k]]).astype(np.int64), threshold - 1e-9, beam)
            near = found[(sims >= threshold - SLACK) & (names[found] != own)]
            exact = near[np.einsum("ij,j->i", vectors[near], q) >= threshold]
            a.append(np.full(len(exact), k))
            b.append(exact)
            there = homes[near]
            new = np.unique(there[(there >= 0) & ~np.isin(there, visited[k])]).tolist()
            if new:
                on.append({"a": own, "n": int(many[k]), "label": label, "dim": dim, "vector": packed[k], "visited": visited[k], "to": new, "entries": [names[near[(there == s).any(1)]].tolist() for s in new]})
            waiting += len(exact) + 1
            if waiting >= LINKS_AT_ONCE:
                yield from flush()
                waiting = 0
        yield from flush()

    return run


def search_graph(index: DataFrame, threshold: float, beam: int) -> DataFrame:
    """FOUND rows (lists of links, and edges) of searches of all rows over the graph of all shards; each round is written out."""
    keys = ["label", "dim", "shard"]
    columns = [*(c for c in index.columns if c not in keys), "entries", *keys]
    found = materialise(index.withColumn("entries", F.expr("cast(null as array<long>)")).select(columns).groupBy(*keys).applyInArrow(_search(threshold, beam), FOUND), "found")
    pairs = found
    while True:
        # a search enters a shard once, at every node of it that the last round reached
        merged = found.where("vector is not null").groupBy("a", "label", "dim").agg(F.first("vector").alias("vector"), F.first("n").alias("n"), F.first("visited").alias("visited"), F.flatten(F.collect_list("to")).alias("to"), F.flatten(F.collect_list("entries")).alias("entries"))
        asked = merged.select(F.col("a").alias("node"), "vector", "n", F.array_union("visited", "to").alias("homes"), "label", "dim", F.arrays_zip("to", "entries").alias("z"), F.explode(F.array_distinct("to")).alias("shard"))
        guests = asked.withColumn("entries", F.expr("array_distinct(flatten(transform(filter(z, x -> x.to = shard), x -> x.entries)))")).withColumn("near", F.expr("cast(null as array<int>)"))
        blocks = materialise(asked.groupBy(*keys).agg(F.expr(f"cast(ceil(count(*) / {GUESTS}) as int)").alias("blocks")), "blocks")
        if blocks.isEmpty():
            return pairs.where("vector is null").select("a", "b", "links")
        held = index.join(blocks.hint("merge"), keys).withColumn("entries", F.expr("cast(null as array<long>)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        dealt = guests.join(blocks.hint("merge"), keys).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        both = held.select(*columns, "block").unionAll(dealt.select(*columns, "block"))
        found = materialise(both.groupBy(*keys, "block").applyInArrow(_search(threshold, beam), FOUND), "found")
        pairs = pairs.unionAll(found)


VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def _pack_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("embedding"))
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)  # rows of nulls are gone, and so are nulls in rows
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())]) * flat.itemsize
        packed = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
        keep = [batch.column(k) for k in range(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*keep, packed.cast(pa.binary())], [*batch.schema.names[:-1], "vector"])


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray, overlap: int) -> np.ndarray:
    return np.argsort(-(vectors @ centroids.T), axis=1, kind="stable")[:, :overlap]


_KEYS = ["label", "dim", "shard"]


def _fit_inside(table: pa.Table) -> pa.Table:
    """Centroids of the sample of a large shard."""
    table = table.sort_by("node")
    want = int(table.column("want")[0].as_py())
    centres = k_means(_matrix(table.column("vector"), table.column("dim")[0].as_py()), min(want, len(table)))
    return pa.table({**{k: table.column(k)[:1] for k in _KEYS}, "centres": pa.array([centres.tobytes()], pa.binary()), "chunks": table.column("chunks")[:1]})


def _assign_inside(overlap: int):
    def run(rows: pa.Table, fitted: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py()
        centres = np.frombuffer(fitted.column("centres")[0].as_py(), np.float64).reshape(-1, dim)
        near = nearest_centroids(_matrix(rows.column("vector"), dim), centres, overlap)
        out = rows.take(pa.array(np.repeat(np.arange(len(rows)), near.shape[1])))
        shard = out.column("shard").to_numpy() * (MOST_SHARDS + 1) + near.ravel() + 1
        return pa.table({**{k: out.column(k) for k in ("node", "label", "dim", "vector", "n")}, "shard": pa.array(shard, pa.int64())})

    return run


def sharded(nodes: DataFrame, overlap: int) -> DataFrame:
    """INDEX rows: each node once in each of its shards, of which none has more than LARGE rows but where they can't be told apart.

    A label is a shard at first.  One of more than two times SHARD rows, and later any of more than LARGE, is
    cut by centroids of a sample of its own, in tasks, its rows in chunks of bounded size: nothing of a
    label reaches the driver, however many labels there are.
    """
    shape = "node long, label long, dim long, vector binary, n long, shard long"
    rows = nodes.select("node", "label", "dim", "vector", "n", F.lit(0).cast("long").alias("shard"))
    for turn in range(1 + CUTS):
        sizes = rows.groupBy(*_KEYS).agg(F.count("*").alias("rows")).where(F.col("rows") > (LARGE if turn else min(LARGE, 2 * SHARD)))
        sizes = materialise(sizes.withColumns({"want": F.least(F.lit(MOST_SHARDS), F.ceil(F.col("rows") / SHARD)), "chunks": F.ceil(F.col("rows") / GUESTS)}), "sizes")
        if sizes.isEmpty():
            break
        large = rows.join(sizes.hint("merge"), _KEYS)
        sample = large.where(F.pmod(F.xxhash64("node", F.lit("cut")), F.lit(1 << 20)) < F.col("want") * SAMPLE_PER_SHARD / F.col("rows") * (1 << 20))
        fitted = sample.select("node", *_KEYS, "vector", "want", "chunks").groupBy(*_KEYS).applyInArrow(_fit_inside, "label long, dim long, shard long, centres binary, chunks long")
        dealt = fitted.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
        chunked = large.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))).select("node", "label", "dim", "vector", "n", "shard", "chunk")
        cut = chunked.groupBy(*_KEYS, "chunk").cogroup(dealt.groupBy(*_KEYS, "chunk")).applyInArrow(_assign_inside(overlap), shape)
        rest = rows.join(sizes.select(*_KEYS).hint("merge"), _KEYS, "left_anti").select("node", "label", "dim", "vector", "n", "shard")
        rows = materialise(rest.union(cut).dropDuplicates(["node", "shard"]), "shards")
    homes = rows.groupBy("node").agg(F.sort_array(F.collect_set("shard")).cast("array<bigint>").alias("homes"))
    return rows.join(homes.hint("merge"), "node").select("node", "label", "dim", "vector", "n", "homes", "shard")


_TRUE = "label long, dim long, q long, other long, n_q long, n_other long"


def _exact(threshold: float):
    """All links of queries with a chunk of their label's rows."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        dim = rows.column("dim")[0].as_py() if len(rows) and len(queries) else 0
        out = [[np.zeros(0, np.int64)] * 4]
        if dim:
            asked = _matrix(queries.column("vector"), dim)
            names, many, ids, counts = (t.column(c).to_numpy() for t in (rows, queries) for c in ("node", "n"))
            for lo in range(0, len(rows), BLOCK):
                i, j = np.nonzero(_matrix(rows.column("vector").slice(lo, BLOCK), dim) @ asked.T >= threshold)
                i, j = i[names[lo + i] != ids[j]] + lo, j[names[lo + i] != ids[j]]
                out.append([ids[j], names[i], counts[j], many[i]])
        q, other, n_q, n_other = (np.concatenate(x) for x in zip(*out, strict=True))
        label = rows.column("label")[0].as_py() if dim else 0
        columns = [np.full(len(q), label), np.full(len(q), dim), q, other, n_q, n_other]
        return pa.table([pa.array(x, pa.int64()) for x in columns], ["label", "dim", "q", "other", "n_q", "n_other"])

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each link of the lists (q, links)."""
    for batch in batches:
        lists = batch.column(1).to_pylist()
        flat = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
        q = np.repeat(batch.column(0).to_numpy(), [len(x) // 16 for x in lists])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.ascontiguousarray(flat[:, 0]))], ["q", "other"])


def _sum_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, linked: rows that a node's different links stand for, from lists (node, links) in order of their nodes."""
    held: list[tuple[int, bytes]] = []

    def summed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(x for _, x in rows), np.int64).reshape(-1, 2)
        node = np.repeat(np.array([k for k, _ in rows], np.int64), [len(x) // 16 for _, x in rows])
        order = np.lexsort((flat[:, 0], node))
        node, other, n = node[order], flat[order, 0], flat[order, 1]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (other[1:] != other[:-1])
        names, at = np.unique(node[new], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.add.reduceat(n[new], at) if len(at) else np.zeros(0, np.int64))], ["node", "linked"])

    for batch in batches:
        for node, links in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and node != held[-1][0] and sum(len(x) for _, x in held) >= 4 << 20:
                yield summed(held)
                held = []
            held.append((node, links))
    if held:
        yield summed(held)


_LABEL = ["label", "dim"]


def _linked_of(nodes: DataFrame, queries: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """All links of the queries (label, dim, node, vector, n), written: each label's rows in chunks, every chunk with all its queries."""
    queries = materialise(queries, "queries")
    chunks = sizes.select(*_LABEL, F.ceil(F.col("rows") / GUESTS).alias("chunks")).hint("merge")
    dealt = queries.join(chunks, _LABEL).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = nodes.join(chunks, _LABEL).join(queries.select(*_LABEL).distinct().hint("merge"), _LABEL, "left_semi").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")))
    columns = [*_LABEL, "chunk", "node", "vector", "n"]
    return materialise(rows.select(columns).groupBy(*_LABEL, "chunk").cogroup(dealt.select(columns).groupBy(*_LABEL, "chunk")).applyInArrow(_exact(threshold), _TRUE), "audit")


def audit_links(nodes: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """All links (q, other) of sampled queries q: of each label (label, dim, rows) until AUDIT_LINKED of them have links."""
    out, todo = [], sizes
    for want in AUDIT_DRAWS:
        share = F.least(F.lit(1.0), want / F.col("rows")) * (1 << 20)
        queries = nodes.join(todo.hint("merge"), _LABEL).where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 20)) < share).select(*_LABEL, "node", "vector", "n")
        true = _linked_of(nodes, queries, todo, threshold)
        linked = true.groupBy(*_LABEL).agg(F.countDistinct("q").alias("linked"))
        told = todo.join(linked.hint("merge"), _LABEL, "left").withColumn("done", (F.coalesce("linked", F.lit(0)) >= AUDIT_LINKED) | (F.col("rows") <= want) | F.lit(want == AUDIT_DRAWS[-1]))
        told = materialise(told, "audited")
        out.append(true.join(told.where("done").select(*_LABEL).hint("merge"), _LABEL, "left_semi"))
        todo = told.where("not done").select(*_LABEL, "rows")
        if todo.isEmpty():
            break
    return reduce(DataFrame.unionAll, out)


def audited_recall(true: DataFrame, found: DataFrame, sizes: DataFrame) -> float | None:
    """The smallest recall of a label, a mean over its queries; labels of which too little is known count together; None: no link was audited."""
    asked = true.select(F.col("q").alias("a")).distinct()
    lists = found.where("links is not null").join(asked.hint("merge"), "a", "left_semi").select(F.col("a").alias("q"), "links")
    pairs = lists.mapInArrow(_unpacked, "q long, other long").distinct()
    hits = true.join(pairs.withColumn("hit", F.lit(1)).hint("merge"), ["q", "other"], "left").groupBy(*_LABEL, "q").agg((F.count("hit") / F.count("*")).alias("recall"))
    each = hits.groupBy(*_LABEL).agg(F.avg("recall").alias("recall"), F.count("*").alias("n")).join(sizes.hint("merge"), _LABEL)
    own = (F.col("n") >= AUDIT_LINKED) | (F.col("rows") <= AUDIT_DRAWS[-1])
    low, few, n = each.agg(F.min(F.when(own, F.col("recall"))), F.sum(F.when(~own, F.col("recall") * F.col("n"))), F.sum(F.when(~own, F.col("n")))).first()
    known = [x for x in (low, few / n if n else None) if x is not None]
    return min(known) if known else None


def recall_of(nodes: DataFrame, true: DataFrame, found: DataFrame, sizes: DataFrame, threshold: float) -> float:
    """The audited recall.  Where the audit met no link, rows that the search links are compared with all of their label instead.

    With no link on either side it is 1 if all labels were compared whole, else it is unknown, and an error.
    """
    recall = audited_recall(true, found, sizes)
    if recall is None:
        linked = found.where("links is not null").select(F.col("a").alias("node")).distinct()
        linked = linked.orderBy(F.xxhash64("node")).limit(AUDIT_DRAWS[-1])  # a bounded sample
        queries = nodes.join(linked.hint("merge"), "node", "left_semi").select(*_LABEL, "node", "vector", "n")
        recall = audited_recall(_linked_of(nodes, queries, sizes, threshold), found, sizes)
    if recall is None:
        if not sizes.where(F.col("rows") > AUDIT_DRAWS[-1]).isEmpty():
            raise ValueError("no link was found or audited in labels too large to compare whole: recall is unknown")
        return 1.0
    return recall


def _as_found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit's links as lists and edges."""
    for batch in batches:
        q, other, n_q, n_other = (batch.column(k).to_numpy() for k in (2, 3, 4, 5))
        yield from link_lists(q, other, n_q, n_other).select(["a", "b", "links"]).to_batches()


def find_links(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """Lists of links (a, links) and edges (a, b) of the nodes, and the audited recall; the audit's own links are among them."""
    sizes = materialise(nodes.groupBy(*_LABEL).agg(F.count("*").alias("rows")), "labels")
    true = audit_links(nodes, sizes, threshold)
    for attempt in range(ATTEMPTS):
        index = materialise(sharded(nodes, OVERLAP << attempt).groupBy("label", "dim", "shard").applyInArrow(_build, f"{INDEX}, near array<int>"), "index")
        found = search_graph(index, threshold, BEAM << attempt)
        recall = recall_of(nodes, true, found, sizes, threshold)
        if recall >= RECALL_TARGET:
            break
    if recall < RECALL_LEAST:
        raise ValueError(f"audited recall {recall:.3f} of the links is below {RECALL_LEAST}")
    return found.unionAll(true.mapInArrow(_as_found, "a long, b long, links binary")), recall


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``embeddings``: vec_id, n_links, component_id, kept.

    Rows link with rows of the same label (of any type, not null) and dimension at cosine >= ``threshold``;
    vectors that are null, empty, zero or hold null or non-finite numbers link with nothing.  Equal
    rows are counted one by one but compared once.  A null id counts in n_links only; a row that
    repeats an id is a row of its own.  component_id is the smallest id reachable, itself
    included.  An empty table gives no row; other columns are not read.
    """
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("named"), F.col(vector_col).alias("embedding"))
    for seed in range(8):  # another seed should two vectors ever share a hash
        own = rows.withColumn("label", F.xxhash64("named", F.lit(seed))).withColumn("node", F.when(F.expr(f"named is not null and ({VALID})"), F.xxhash64("named", "embedding", F.lit(seed))))
        grouped = own.where("node is not null").groupBy("node", "label", "named", "embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
        nodes = materialise(grouped.select("node", "label", "named", F.size("embedding").cast("long").alias("dim"), "n", "first", "embedding").mapInArrow(_pack_vectors, "node long, label long, named string, dim long, n long, first long, vector binary"), "nodes")
        if nodes.select("node").distinct().count() == nodes.count() and nodes.groupBy("label").agg((F.min("named") != F.max("named")).alias("clash")).where("clash").isEmpty():
            break
    else:
        raise ValueError("hashes of vectors or labels clash under every seed")
    found = find_links(nodes, threshold)[0]
    bound_batches(embeddings.sparkSession)
    lists = found.where("links is not null").select(F.col("a").alias("node"), "links").repartition("node").sortWithinPartitions("node")
    others = lists.mapInArrow(_sum_links, "node long, linked long")
    roots = connected_components(found.where("b is not null").select("a", "b"))
    known = nodes.select("node", "n", "first").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    per_node = known.join(least.hint("merge"), "root").join(others.hint("merge"), "node", "left").select("node", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id")
    out = salted_join(own.select("vec_id", "node"), materialise(per_node, "counted"), "node", hot_keys(nodes, "node", "n"))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), component.isNull()).alias("kept"))
