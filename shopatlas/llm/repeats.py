"""Removal of repeated 100-byte strings by prefix-free parsing.

A rolling hash of 16 bytes triggers phrases: the trigger of a 100-byte string is the smallest hash
among its first 75 places, so equal strings have it at the same place, and a phrase is the run of
string starts with one trigger.  The dictionary holds each extended phrase (all strings that start
in it) once; the parse says where a phrase stands first in corpus order (id, place).  Every later
occurrence of a dictionary phrase is repeated as a whole.  A string can also stand in two different
phrases, but only in phrases with equal 26 bytes at the trigger (the core).  The dictionary is dealt by core, and
the suffixes of a core's phrases are put in order by a suffix array (ranks of 8 bytes, doubled to 100).
Suffixes that share their first 100 bytes stand together there, and the parse's order says which of
them is first in the corpus.  The parse's own suffixes need no order: a 100-byte string lies whole in the
extended phrase that it starts in.  A core with very many phrases is dealt on by its single strings, which are
then grouped as they are.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, bloom_of, bound_batches, hash_partitions, in_bloom, materialise, ragged_arange, slices, text_bytes

LENGTH, GRAM, PLACES = 100, 16, 75
CORE = LENGTH - PLACES + 1
SLICE = 1 << 20  # bytes of text that a task has in hand
PART_BYTES = 32 << 20  # bytes of text whose phrases make a part
MOST_PARTS = 1 << 19
HOT = 8  # different phrases of one core in a slice, from which all of them go straight to the suffixes


def phrases(data: np.ndarray, offsets: np.ndarray, hashed: SpanHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts and trigger of every phrase of the buffer's texts."""
    n = len(data)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    key = hashed.windows(GRAM)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n - GRAM + 1, dtype=np.uint64)
    reach = 1
    while reach < 64:  # smallest of the 64 places from each place on, by doubling
        key = np.minimum(key[: len(key) - reach], key[reach:])
        reach *= 2
    key = np.minimum(key[: len(key) - (PLACES - reach)], key[PLACES - reach :])
    starts = offsets[:-1]
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    place = np.repeat(starts, count) + ragged_arange(count)
    trigger = (key[place] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(trigger)), bool), trigger[1:] != trigger[:-1]]))
    return place[head], np.diff(np.append(head, len(place))), trigger[head]


def _first_of(key: tuple[np.ndarray, ...], order_by: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows by key and order; the sorted places, and which of them share key but not order with the first of the key."""
    order = np.lexsort((*order_by[::-1], *key[::-1]))
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in key])
    group = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = ~new & np.logical_or.reduce([k[order] != k[order][group] for k in order_by])
    return order, later


_RUNS, _PHRASES, _STRINGS, _FRAGMENTS = range(4)
_DONE, _BY_FRAGMENT, _BY_STRING = range(3)  # what is left to do with a run
_NAMES = ["part", "kind", "first", "second", "ids", "sums", "counts", "places", "small", "text"]
_ROWS = "part long, kind long, " + ", ".join(f"{k} binary" for k in _NAMES[2:])
# Phrases have 174 bytes at most, so the clashes that polynomial hashes modulo 2**64 are known for (1,024 bytes and more) are out of their reach.
WIDE_CORE = 4096  # different phrases of one core, beyond which single strings travel instead of fragments


def _send(kind: int, part: np.ndarray, of: np.ndarray, ids: np.ndarray, sums: np.ndarray, place: np.ndarray, first=None, second=None, small=None, text=None) -> list[tuple]:
    """Rows of the shuffle, one for each part: sorted by text, whose id and sum stand there once."""
    if not len(part):
        return []
    order = np.lexsort((place, of, part))
    part, of = part[order], of[order]
    out = []
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for a, b in zip(edges.tolist(), np.append(edges[1:], len(part)).tolist(), strict=True):
        texts, counts = np.unique(of[a:b], return_counts=True)
        pick = order[a:b]
        body = [x[pick].tobytes() if x is not None else b"" for x in (first, second)]
        out.append((int(part[a]), kind, *body, ids[texts].tobytes(), sums[texts].tobytes(), counts.astype(np.uint32).tobytes(), place[pick].astype(np.uint32).tobytes(), small[pick].tobytes() if small is not None else b"", b"".join(text[k] for k in pick.tolist()) if text is not None else b""))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _text_part(ids: np.ndarray, sums: np.ndarray, parts: int) -> np.ndarray:
    return ((sums ^ ids) & 0x7FFFFFFF) % parts


def _send_runs(todo: int, pick: np.ndarray, of, ids, sums, place, count, reach, parts: int) -> list[tuple]:
    """Runs of string starts (first, how many, distance to the trigger) to the part of their text."""
    small = np.stack([np.full(len(pick), todo), count[pick], reach[pick]], 1).astype(np.uint8).view("V3").ravel()
    return _send(_RUNS, _text_part(ids, sums, parts)[of[pick]], of[pick], ids, sums, place[pick], small=small)


def _parse(parts: int):
    """Phrases of each slice by the part of their core; a phrase's later occurrences in the slice are repeats already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, SLICE):
            data, offsets = text_bytes(batch.column(1))
            ids, sums = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            hashed, again = SpanHasher(data), SpanHasher(data, 2, 1)
            start, count, trigger = phrases(data, offsets, hashed)
            if not len(start):
                continue
            of = np.searchsorted(offsets, start, side="right") - 1
            core = hashed.spans(trigger, trigger + CORE)
            whole = again.spans(start, start + count + LENGTH - 1)  # with the core 128 bits of two bases
            place, reach = start - offsets[of], trigger - start
            order, later = _first_of((core, whole), (ids[of], sums[of], place))
            found = _send_runs(_DONE, order[later], of, ids, sums, place, count, reach, parts)
            own = order[~later]
            same = np.zeros(len(own), bool)
            same[1:] = core[own][1:] == core[own][:-1]
            group = np.cumsum(~same) - 1
            hot = np.bincount(group)[group] >= HOT
            found += _send_runs(_BY_STRING, own[hot], of, ids, sums, place, count, reach, parts)
            sent = own[~hot | ~same]
            small = np.stack([count[sent], reach[sent], hot[~hot | ~same]], 1).astype(np.uint8).view("V3").ravel()
            found += _send(_PHRASES, (core[sent] % np.uint64(parts)).astype(np.int64), of[sent], ids, sums, place[sent], core[sent], whole[sent], small)
            yield _batch(found)

    return run


_OUT = "id long, sum long, todo long, runs binary"


def _by_text(ids, sums, place, count, reach, todo: int) -> pa.RecordBatch:
    """Rows (text, its runs as triples of 64-bit numbers: first start, how many, distance to the trigger)."""
    order = np.lexsort((place, sums, ids))
    ids, sums = ids[order], sums[order]
    runs = np.stack([place[order], count[order], reach[order]], 1).astype(np.int64)
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1])]))
    ends = np.append(head[1:], len(ids)) if len(head) else head
    return pa.RecordBatch.from_arrays([pa.array(ids[head]), pa.array(sums[head]), pa.array(np.full(len(head), todo)), pa.array([runs[x:y].tobytes() for x, y in zip(head.tolist(), ends.tolist(), strict=True)], pa.binary())], ["id", "sum", "todo", "runs"])


def _received(rows: list[tuple]) -> tuple[dict[str, np.ndarray], bytes]:
    """The rows of one part and kind, put together."""
    first, second, ids, sums, counts, places, small, text = (b"".join(x) for x in zip(*rows, strict=True))
    counts = np.frombuffer(counts, np.uint32)
    return {
        "first": np.frombuffer(first, np.uint64), "second": np.frombuffer(second, np.uint64),
        "ids": np.repeat(np.frombuffer(ids, np.int64), counts), "sums": np.repeat(np.frombuffer(sums, np.int64), counts),
        "place": np.frombuffer(places, np.uint32).astype(np.int64), "small": np.frombuffer(small, np.uint8).astype(np.int64),
    }, text


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each part decides: phrases, single strings or fragments that stand earlier elsewhere.

    Spark sorts a task's rows by part and kind; one part's rows of one kind at a time are in hand.
    """
    held: list[tuple] = []
    now = None
    for batch in batches:
        for part, kind, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (part, kind) != now and held:
                yield from _decide(now[1], *_received(held))
                held = []
            now = (part, kind)
            held.append(columns)
    if held:
        yield from _decide(now[1], *_received(held))


def _decide(kind: int, x: dict[str, np.ndarray], text: bytes) -> Iterator[pa.RecordBatch]:
    ids, sums, place = x["ids"], x["sums"], x["place"]
    small = x["small"] if kind == _STRINGS else x["small"].reshape(-1, 3)
    if kind == _RUNS:
        for todo in (_DONE, _BY_FRAGMENT, _BY_STRING):
            pick = np.flatnonzero(small[:, 0] == todo)
            yield _by_text(ids[pick], sums[pick], place[pick], small[pick, 1], small[pick, 2], todo)
    elif kind == _STRINGS:
        order, later = _first_of((x["first"], x["second"]), (ids, sums, place))
        yield _strings_done(ids, sums, place, order[later])
    elif kind == _FRAGMENTS:
        yield from _suffix_groups(x["first"], ids, sums, place, small[:, 0], text)
    else:
        core, whole, marked = x["first"], x["second"], small[:, 2]
        order, later = _first_of((core, whole, marked), (ids, sums, place))
        pick = order[later & (marked[order] == 0)]
        yield _by_text(ids[pick], sums[pick], place[pick], small[pick, 0], small[pick, 1], _DONE)
        own = order[~later]
        new = np.ones(len(own), bool)
        new[1:] = core[own][1:] != core[own][:-1]
        group = np.cumsum(new) - 1
        fresh = new.copy()
        fresh[1:] |= whole[own][1:] != whole[own][:-1]
        kinds = np.bincount(group, fresh) if len(own) else np.zeros(0)
        hot = (np.bincount(group, marked[own]) > 0) | (kinds > WIDE_CORE) if len(own) else new
        for todo, chosen in ((_BY_STRING, hot), (_BY_FRAGMENT, ~hot & (kinds > 1))):
            pick = own[chosen[group] & (marked[own] == 0)]
            yield _by_text(ids[pick], sums[pick], place[pick], small[pick, 0], small[pick, 1], todo)


def _strings_done(ids, sums, place, pick) -> pa.RecordBatch:
    return _by_text(ids[pick], sums[pick], place[pick], np.ones(len(pick)), np.zeros(len(pick)), _DONE)


def suffix_ranks(data: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of every suffix of the buffer by its first ``length`` bytes (8 or more); equal ones share a rank.

    Prefix doubling: ranks of 8 bytes give those of 16, and so on; the last step lays two ranks of the
    longest power of two over each other.  Behind the buffer stand zero bytes.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    value = np.zeros(n + length - 7, np.uint64)
    for k in range(8):
        value = (value << np.uint64(8)) | padded[k : k + len(value)]
    rank = np.unique(value, return_inverse=True)[1].reshape(-1)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        pair = rank[: len(rank) - step] * np.int64(len(value)) + rank[step:]
        rank = np.unique(pair, return_inverse=True)[1].reshape(-1)
        reach += step
    return rank[:n]


def _suffix_groups(core: np.ndarray, ids: np.ndarray, sums: np.ndarray, place: np.ndarray, count: np.ndarray, text: bytes) -> Iterator[pa.RecordBatch]:
    """Suffixes of the dictionary fragments in suffix order, some cores at a time; of equal ones the parse's first stays."""
    data = np.frombuffer(text, np.uint8)
    ends = np.cumsum(count + LENGTH - 1)
    begin = ends - (count + LENGTH - 1)
    order = np.argsort(core, kind="stable")
    core = core[order]
    bounds = np.append(np.flatnonzero(np.concatenate([np.ones(min(1, len(core)), bool), core[1:] != core[:-1]])), len(core))
    total = np.concatenate([[0], np.cumsum(count[order])])[bounds]
    lo = 0
    while lo < len(bounds) - 1:
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 18), side="right")) - 1)
        own = order[bounds[lo] : bounds[hi]]
        size = count[own] + LENGTH - 1
        ranks = suffix_ranks(data[np.repeat(begin[own], size) + ragged_arange(size)])
        at = np.repeat(np.cumsum(size) - size, count[own]) + ragged_arange(count[own])
        row = np.repeat(own, count[own])
        where = place[row] + ragged_arange(count[own])
        sort, later = _first_of((ranks[at],), (ids[row], sums[row], where))
        yield _strings_done(ids[row], sums[row], where, sort[later])
        lo = hi


def _look_up(parts: int):
    """Fragments (by core) or single strings (by their hash) of the runs that are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE):
            data, offsets = text_bytes(batch.column(2))
            ids, sums = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = []
            for todo, column in ((_BY_FRAGMENT, batch.column(3)), (_BY_STRING, batch.column(4))):
                runs = [np.frombuffer(b"".join(r or ()), np.int64).reshape(-1, 3) for r in column.to_pylist()]
                of = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
                place, count, reach = np.concatenate(runs).T
                if not len(of):
                    continue
                start = offsets[of] + place
                if todo == _BY_FRAGMENT:
                    core = SpanHasher(data).spans(start + reach, start + reach + CORE)
                    text = [data[a : a + n].tobytes() for a, n in zip(start.tolist(), (count + LENGTH - 1).tolist(), strict=True)]
                    found += _send(_FRAGMENTS, (core % np.uint64(parts)).astype(np.int64), of, ids, sums, place, core, small=np.stack([count, reach, reach], 1).astype(np.uint8).view("V3").ravel(), text=text)
                    continue
                at = np.repeat(start, count) + ragged_arange(count)
                of = np.repeat(of, count)
                place = at - offsets[of]
                one, two = (SpanHasher(data, 11 + k, k).spans(at, at + LENGTH) for k in (0, 1))
                order, later = _first_of((one, two), (ids[of], sums[of], place))
                found += _send_runs(_DONE, order[later], of, ids, sums, place, np.ones(len(of)), np.zeros(len(of)), parts)
                own = order[~later]
                found += _send(_STRINGS, (one[own] % np.uint64(parts)).astype(np.int64), of[own], ids, sums, place[own], one[own], two[own])
            if found:
                yield _batch(found)

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removed_spans(runs: np.ndarray) -> np.ndarray:
    """Byte spans covered by repeated strings, from runs of their starts (first, how many, ...)."""
    if not len(runs):
        return np.zeros((0, 2), np.int64)
    a, n = runs[np.argsort(runs[:, 0], kind="stable")].T[:2]
    b = np.maximum.accumulate(a + n + LENGTH - 1)
    head = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    return np.stack([a[head], b[np.append(head[1:] - 1, len(a) - 1)]], 1)


def cut(data: np.ndarray, spans: np.ndarray) -> bytes:
    """The bytes outside the spans."""
    edges = np.concatenate([[0], spans.ravel(), [len(data)]]).reshape(-1, 2)
    return b"".join(data[x:y].tobytes() for x, y in edges.tolist())


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, SLICE):
        data, offsets = text_bytes(batch.column(1))
        out = []
        for k, own in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]]
            spans = removed_spans(np.frombuffer(b"".join(own or ()), np.int64).reshape(-1, 3))
            out.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(cut(text, spans)).hexdigest()))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(),) * 3 + (pa.string(),), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes (null: empty); a byte goes if a 100-byte string that covers it also starts
    earlier, that is in a smaller id or before it in the same text.  Rows without id come
    before all others; rows that share an id are ordered by a hash of their text, and rows equal in
    both count as one.  An empty table gives no row; other columns are not read.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = hash_partitions(spark)
    parts = min(MOST_PARTS, max(tasks, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)))
    deal = lambda rows: rows.repartitionById(min(parts, 1 << 16), F.col("part").cast("int")).sortWithinPartitions("part", "kind").mapInArrow(_resolve, _OUT)
    texts = texts.withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("sum", F.xxhash64("text")).withColumn("k", F.xxhash64("id", "sum"))
    parsed = texts.select("id", "text", "sum").mapInArrow(_parse(parts), _ROWS)
    found = materialise(deal(parsed), "phrases")
    left = found.where(f"todo <> {_DONE}")
    runs_of = lambda todo: F.collect_list(F.when(F.col("todo") == todo, F.col("runs")))
    open_runs = left.groupBy("id", "sum").agg(runs_of(_BY_FRAGMENT).alias("fragments"), runs_of(_BY_STRING).alias("strings"))
    wanted = texts.mapInArrow(in_bloom(bloom_of(left.select(F.xxhash64("id", "sum").alias("k")), "k", left.count()), True), texts.schema)
    asked = wanted.select("id", "sum", "text").join(open_runs.hint("merge"), ["id", "sum"]).select("id", "sum", "text", "fragments", "strings")
    looked_up = deal(asked.mapInArrow(_look_up(parts), _ROWS))
    repeated = materialise(found.where(f"todo = {_DONE}").union(looked_up).groupBy("id", "sum").agg(F.collect_list("runs").alias("runs")), "repeats")
    bloom = bloom_of(repeated.select(F.xxhash64("id", "sum").alias("k")), "k", repeated.count())
    hit = texts.mapInArrow(in_bloom(bloom, True), texts.schema).join(repeated.hint("merge"), ["id", "sum"], "left").select("doc_id", "text", "runs")
    clean = texts.mapInArrow(in_bloom(bloom, False), texts.schema).select("doc_id", "text", F.lit(None).cast("array<binary>").alias("runs"))
    return hit.mapInArrow(_finish, _RESULT).union(clean.mapInArrow(_finish, _RESULT))
