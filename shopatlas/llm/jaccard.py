"""Near-duplicate texts by an exact Jaccard join of word shingle sets.

Pigeonhole over a partitioned universe.  Shingles are 64-bit hashes.  Set sizes fall into bands;
a band of sizes up to ``hi`` cuts the hash universe into hi/3 + 1 ranges ("segments").  Two sets
with Jaccard similarity 3/4 or more differ in at most H = (sum of sizes)/7 shingles, so if a set
allots each segment 0, 1 or 2 with a sum of H + 1, some segment differs from the other set's in fewer
shingles than it was allotted: in none (1: equal segments), or in at most one (2: equal, or equal
after one deletion on either side).  A set indexes all segments of its own band, and one-deletion
neighbours of a reserve of segments; it probes its own and the next smaller band with the segments
it has allotted.  The allotment takes the cheapest steps: a segment costs what a fixed-size count
sketch of all shingles says of its rarest shingle, a deletion neighbourhood its size besides.

Equal sets are one class, so copies never meet each other.  Signatures travel packed (six bytes
each) to the part that owns their hash; Spark sorts a task's parts, and one part at a time is in
hand.  Buckets of many classes (groups of near copies) are not paired off: where they are found
each class is paired with a few centres, the same ones wherever the same classes meet, and only
classes still apart are compared after that.  A signature that the sketch counts in very many
classes is dealt over several parts, whose centres are paired with each other.
A candidate pair first compares parity bit maps, an exact bound of half a byte to a byte
a shingle; what that leaves is verified on the words of the whole texts.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..operators.components import connected_components
from .common import bloom_hits, bloom_of, bound_batches, give_back, hash_partitions, hot_keys, lower_ascii, materialise, mix64, ragged_arange, salted_join, slices, text_bytes

WORDS = 5
CELLS, ROWS = 1 << 16, 2
RESERVE = 8  # one segment in so many has deletion neighbours; all have in small sets
SMALL_SET = 48
SMALL_BUCKET = 1024  # pairs of a probing and an indexed entry
CENTRES = 3
HOT = 1 << 20  # classes that the sketch counts, from which a signature is dealt over several parts
PART_SHINGLES = 1 << 21  # shingles whose signatures make a part
MOST_PARTS = 1 << 19
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20  # of a block of a large bucket: classes, and bytes of bit maps
MOST_DEALT = 1 << 20
_EMPTY_COST = 1 << 40


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word in the list of distinct words, that list, and the texts' offsets in the words."""
    low = lower_ascii(data)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    first = np.zeros(len(low) + 1, bool)
    first[offsets] = True
    begin = solid.copy()
    begin[1:] &= ~solid[:-1] | first[1:-1]
    start = np.flatnonzero(begin)
    edges = np.append(np.cumsum(solid)[start] - 1, np.count_nonzero(solid)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(edges), pa.py_buffer(low[solid])]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary, np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and offsets by text.

    A word counts by the first 64 bits of its keyed BLAKE2b digest.
    """
    n_texts = len(offsets) - 1
    index, distinct, bounds = split_words(data, offsets)
    key = seed.to_bytes(8, "little")
    codes = np.frombuffer(b"".join([hashlib.blake2b(w, digest_size=8, key=key).digest() for w in distinct.to_pylist()]), "<u8")
    word = codes[index] if len(index) else np.zeros(0, np.uint64)
    count = np.diff(bounds)
    with np.errstate(over="ignore"):
        weights = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        sets = np.zeros(0, np.uint64)
        if len(word) >= words:
            total = sum(word[k : len(word) - words + 1 + k] * weights[k] for k in range(words))
            sets = mix64(total + np.uint64(words))
        size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
        out_bounds = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(int(out_bounds[-1]), np.uint64)
        long = np.flatnonzero(count >= words)
        own = np.repeat(bounds[long], size[long]) + ragged_arange(size[long])
        out[np.repeat(out_bounds[long], size[long]) + ragged_arange(size[long])] = sets[own]
        for k in np.flatnonzero((count > 0) & (count < words)).tolist():
            n = int(count[k])
            out[out_bounds[k]] = mix64(np.array([(word[bounds[k] : bounds[k + 1]] * weights[:n]).sum() + np.uint64(n)]))[0]
    for a, b in zip(out_bounds[:-1].tolist(), out_bounds[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    text = np.repeat(np.arange(n_texts), size)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (text[1:] != text[:-1])
    return out[keep], np.concatenate([[0], np.cumsum(np.bincount(text[keep], minlength=n_texts))]).astype(np.int64)


def exact_shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of every shingle; numbers are equal where the words are, byte by byte."""
    index, _, bounds = split_words(data, offsets)
    count = np.diff(bounds)
    size = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    text = np.repeat(np.arange(len(count)), size)
    at = np.repeat(bounds[:-1], size) + ragged_arange(size)
    # the words of a shingle; places behind a short text hold -1
    padded, last = np.append(index, np.full(words, -1)), bounds[1:][text]
    columns = [padded[at + k] for k in range(words)]
    short = np.flatnonzero(at + words > last)
    for k in range(words):
        columns[k][short] = np.where(at[short] + k < last[short], columns[k][short], -1)
    with np.errstate(over="ignore"):
        weights = mix64(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
        rough = mix64(sum(c.astype(np.uint64) * w for c, w in zip(columns, weights, strict=True)))
    order = np.argsort(rough)
    sorted_ = rough[order]
    near = sorted_[1:] == sorted_[:-1]
    a, b = order[1:][near], order[:-1][near]
    if any((c[a] != c[b]).any() for c in columns):  # two different shingles have one rough number
        return text, np.unique(np.stack(columns, 1), axis=0, return_inverse=True)[1].reshape(-1)
    number = np.empty(len(order), np.int64)
    number[order] = np.concatenate([np.zeros(min(1, len(order)), np.int64), np.cumsum(~near)])
    return text, number


def set_classes(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set."""
    size = np.diff(bounds).astype(np.uint64)
    with np.errstate(over="ignore"):
        digests = []
        for k in (3, 5):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets + np.uint64(k << 40)))])
            digests.append(mix64(sums[bounds[1:]] - sums[bounds[:-1]] + size))
    return digests[0].view(np.int64), digests[1].view(np.int64)


def bitmaps(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """A parity bit map of each set: four times the next power of two from its size (256 bits at least).

    The bits in which two maps differ are at most the shingles in which the sets do.
    """
    size = np.diff(bounds)
    bits = 1 << np.maximum(8, np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64) + 2)
    first = np.cumsum(bits) - bits
    of = np.repeat(np.arange(len(size)), size)
    place = first[of] + (sets >> np.uint64(20)).astype(np.int64) % bits[of]
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a : a + n] for a, n in zip((first // 8).tolist(), (bits // 8).tolist(), strict=True)]


def maps_differ(x: bytes, y: bytes) -> int:
    """Differing bits of two maps; the longer one is folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if len(a) < len(b):
        a, b = b, a
    a = np.bitwise_xor.reduce(a.reshape(-1, len(b)), axis=0)
    return int(np.bitwise_count(a ^ b).sum())


def _cells(sets: np.ndarray) -> list[np.ndarray]:
    return [((sets >> np.uint64(16 * k)) & np.uint64(CELLS - 1)).astype(np.int64) for k in range(ROWS)]


def band_tops(most: int = 1 << 40) -> np.ndarray:
    """Largest size of each band; a set's partners are in its own band and its neighbours."""
    tops = [1]
    while tops[-1] < most:
        tops.append(max(tops[-1] + 1, -(-(tops[-1] + 1) * 4 // 3) - 1))
    return np.array(tops, np.int64)


TOPS = band_tops()


def _steps(sets: np.ndarray, bounds: np.ndarray, who: np.ndarray, band: np.ndarray, cost: np.ndarray, own: bool, everywhere: int) -> tuple[np.ndarray, ...]:
    """Signatures of the sets ``who`` in the given bands: (set, signature, code).

    A code is 1 for an entry of the index, plus 2 for a deletion neighbour, plus 4 times the
    allotment with which the entry probes (0: it doesn't).  The fourth result is in how many sets the signature
    may stand: what the sketch says of its rarest shingle, or ``everywhere`` for an empty segment.
    """
    size = np.diff(bounds)[who]
    hi = TOPS[band]
    m = hi // 3 + 1
    need = (size + np.minimum(size, hi)) // 7 + 1
    elements = np.repeat(bounds[who], size) + ragged_arange(size)
    of = np.repeat(np.arange(len(who)), size)
    u = sets[elements]
    segment = ((u >> np.uint64(32)) * m[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    head = np.ones(len(u), bool)
    head[1:] = (of[1:] != of[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(head)
    n_in = np.diff(np.append(at, len(u)))
    seg_of, seg = of[at], segment[at]
    with np.errstate(over="ignore"):
        value = mix64(u)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
        body = sums[at + n_in] - sums[at]
        place = mix64((seg.astype(np.uint64) << np.uint64(16)) + band[seg_of].astype(np.uint64)) if len(at) else body
        price = cost[elements]
        rare = np.minimum.reduceat(price, at) if len(at) else np.zeros(0, np.int64)
        reserve = (seg >= m[seg_of] - -(-m[seg_of] // RESERVE)) | (size[seg_of] <= SMALL_SET)
        # empty segments
        full = np.bincount(seg_of, minlength=len(who))
        holes = m - full
        h_of = np.repeat(np.arange(len(who)), holes)
        grid = np.ones(int(m.sum()), bool)
        first = np.cumsum(m) - m
        grid[first[seg_of] + seg] = False
        h_seg = np.flatnonzero(grid) - first[h_of]
        h_sign = mix64(mix64((h_seg.astype(np.uint64) << np.uint64(16)) + band[h_of].astype(np.uint64)))
        # allotment: the cheapest steps of each set; a segment's second step costs more than its first
        twice = np.flatnonzero(reserve & (n_in >= 2))
        step_of = np.concatenate([seg_of, seg_of[twice], h_of])
        weak = np.where(n_in == 1, 64, np.where(n_in == 2, 8, 1))  # few shingles meet by chance or in a shared passage
        step_cost = np.concatenate([rare * 1024 + weak, 2048 * rare[twice] + np.maximum(weak, n_in + 1)[twice], np.full(len(h_of), _EMPTY_COST)])
        order = np.lexsort((step_cost, step_of))
        counts = np.bincount(step_of, minlength=len(who))
        taken = np.zeros(len(step_of), bool)
        taken[order] = ragged_arange(counts) < np.repeat(need, counts)
        allotted = taken[: len(seg)].astype(np.int64)
        allotted[twice] += taken[len(seg) : len(seg) + len(twice)]
        h_allotted = taken[len(seg) + len(twice) :].astype(np.int64)
        base = 1 if own else 0
        sign = mix64(body + place)
        parts = [(seg_of, sign, base + 4 * allotted, rare), (h_of, h_sign, base + 4 * h_allotted, np.full(len(h_of), everywhere))]
        gone = np.flatnonzero((reserve if own else allotted == 2) & (n_in >= 2))
        e_at = np.repeat(at[gone], n_in[gone]) + ragged_arange(n_in[gone])
        back = np.repeat(gone, n_in[gone])
        lowest = price == rare[np.cumsum(head) - 1]
        alone = np.add.reduceat(lowest.astype(np.int64), at) == 1 if len(at) else np.zeros(0, bool)
        second = np.minimum.reduceat(np.where(lowest, everywhere, price), at) if len(at) else rare
        left = np.where(lowest[e_at] & alone[back], second[back], rare[back])
        parts.append((seg_of[back], mix64(body[back] - value[e_at] + place[back]), base + 2 + 4 * (allotted[back] == 2), left))
    if not own:
        parts[:2] = [tuple(x[p[2] > 0] for x in p) for p in parts[:2]]
    of, sign, code, rare = (np.concatenate(x) for x in zip(*parts, strict=True))
    return who[of], sign, code, rare


def signatures(sets: np.ndarray, bounds: np.ndarray, cost: np.ndarray, everywhere: int = 0) -> tuple[np.ndarray, ...]:
    """All signatures of all sets: (set, 64-bit signature, code, sets that may have it)."""
    size = np.diff(bounds)
    who = np.flatnonzero(size > 0)
    band = np.searchsorted(TOPS, size[who])
    found = [_steps(sets, bounds, who, band, cost, True, everywhere)]
    down = band > 0
    down &= 4 * TOPS[np.maximum(band - 1, 0)] >= 3 * size[who]
    if down.any():
        found.append(_steps(sets, bounds, who[down], band[down] - 1, cost, False, everywhere))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _classify(words: int, seed: int):
    """Of each row its set's size, digests and (once a class and task) bit map; at the end the task's count sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, schema = np.zeros((ROWS, CELLS), np.int64), set(), None
        for batch in slices(batches):
            kept = [batch.column(0), *batch.columns[2:]]
            if schema is None:
                schema = pa.schema([*(f for k, f in enumerate(batch.schema) if k != 1), pa.field("n", pa.int64()), pa.field("class", pa.int64()), pa.field("check", pa.int64()), pa.field("map", pa.binary()), pa.field("sketch", pa.binary())])
            sets, bounds = shingle_sets(*text_bytes(batch.column(1)), words, seed)
            a, b = set_classes(sets, bounds)
            size = np.diff(bounds)
            new = np.array([not (c in seen or seen.add(c)) for c in a.tolist()], bool) & (size > 0)
            own = np.repeat(new, size)
            for k, cell in enumerate(_cells(sets[own])):
                counts[k] += np.bincount(cell, minlength=CELLS)
            maps = pa.array([m if k else None for k, m in zip(new.tolist(), bitmaps(sets, bounds), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*kept, pa.array(size), pa.array(a, mask=size == 0), pa.array(b), maps, pa.nulls(len(size), pa.binary())], schema=schema)
        if schema is not None:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-1]), pa.array([zlib.compress(counts.tobytes(), 1)], pa.binary())], schema=schema)

    return run


def _add_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ROWS * CELLS, np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["sketch"])


SKETCH_FAN = 16


def added_sketches(rows: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches (one row each), added in a tree: at most SKETCH_FAN of them come to the driver."""
    while (n := rows.count()) > SKETCH_FAN:
        rows = materialise(rows.repartition(-(-n // SKETCH_FAN)).mapInArrow(_add_sketches, "sketch binary"), "sketch")
    total = sum((np.frombuffer(zlib.decompress(x), np.int64) for x in rows.toArrow().column(0).to_pylist()), np.zeros(ROWS * CELLS, np.int64))
    return total.reshape(ROWS, CELLS)


def _emit(words: int, seed: int, sketch: np.ndarray, classes: int, parts: int):
    """Packed signatures by part: classes, sizes, entry counts, and six bytes an entry.

    An entry is the rest of the signature, a bit that says whether it is dealt over several parts, and the code.
    """

    def packed(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        first = np.cumsum([0] + [len(h[0]) for h in held])
        names, table = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        of = np.concatenate([h[2] + f for h, f in zip(held, first[:-1].tolist(), strict=True)])
        part, entry = (np.concatenate([h[k] for h in held]) for k in (3, 4))
        order = np.argsort(part.astype(np.int64) * len(names) + of, kind="stable")
        of, part = of[order], part[order]
        six = np.ascontiguousarray(entry[order].view("u1").reshape(-1, 8)[:, :6])
        run_at = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (part[1:] != part[:-1])]))
        run_n = np.diff(np.append(run_at, len(of)))
        head = np.flatnonzero(np.concatenate([[True], part[run_at][1:] != part[run_at][:-1]]))
        columns = [[], [], [], []]
        for a, b in zip(head.tolist(), [*head[1:].tolist(), len(run_at)], strict=True):
            who = of[run_at[a:b]]
            for column, x in zip(columns, (names[who], table[who].astype(np.uint32), run_n[a:b].astype(np.uint32), six[run_at[a] : run_at[b - 1] + run_n[b - 1]]), strict=True):
                column.append(x.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(part[run_at[head]].astype(np.int64)), *(pa.array(c, pa.binary()) for c in columns)], ["part", "classes", "sizes", "counts", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, ...]] = []
        for batch in slices(batches):
            sets, bounds = shingle_sets(*text_bytes(batch.column(1)), words, seed)
            names = set_classes(sets, bounds)[0]
            size = np.diff(bounds)
            new = np.array([not (c in seen or seen.add(c)) for c in names.tolist()], bool) & (size > 0)
            if not new.any():
                continue
            sets, names = sets[np.repeat(new, size)], names[new]
            bounds = np.concatenate([[0], np.cumsum(size[new])]).astype(np.int64)
            cost = np.minimum.reduce([sketch[k][cell] for k, cell in enumerate(_cells(sets))])
            of, sign, code, rare = signatures(sets, bounds, cost, classes)
            hot = rare >= HOT
            entry = ((sign // np.uint64(parts)) << np.uint64(5)) | (hot.astype(np.uint64) << np.uint64(4)) | code.astype(np.uint64)
            part = sign % np.uint64(parts)
            if hot.any():  # by the class, over about as many parts as there are HOTs
                turns = np.minimum(rare[hot] // HOT + 1, MOST_DEALT).astype(np.uint64)
                with np.errstate(over="ignore"):
                    part[hot] = (part[hot] + mix64(mix64(names[of[hot]].view(np.uint64)) % turns)) % np.uint64(parts)
            held.append((names, np.diff(bounds), of, part.astype(np.uint32), entry.astype("<u8")))
            if sum(len(h[4]) for h in held) >= max(1 << 19, 8 * parts):
                yield packed(held)
                held = []
        if held:
            yield packed(held)

    return run


def _pairs(parts: int):
    """Candidates of the parts in this task, which come one after another: pairs (a, b), members of large buckets
    (bucket, a, n, code), or centres of buckets that are dealt over parts (bucket, a, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[bytes]] = []
        now = None
        for batch in batches:
            for part, *columns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now and held:
                    yield from _part_pairs(now, held, parts)
                    held = []
                now = part
                held.append(columns)
        if held:
            yield from _part_pairs(now, held, parts)
        give_back()

    return run


_CANDIDATE = "bucket long, a long, b long, n long, code long"


def _candidates(rows: int, **columns: np.ndarray) -> pa.RecordBatch:
    names = ["bucket", "a", "b", "n", "code"]
    return pa.RecordBatch.from_arrays([pa.array(columns[c].astype(np.int64, copy=False)) if c in columns else pa.nulls(rows, pa.int64()) for c in names], names)


def _part_pairs(part: int, held: list[list[bytes]], parts: int) -> Iterator[pa.RecordBatch]:
    classes, sizes, counts, entries = (b"".join(x) for x in zip(*held, strict=True))
    counts = np.frombuffer(counts, np.uint32)
    who = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    wide = np.zeros((len(who), 8), np.uint8)
    wide[:, :6] = np.frombuffer(entries, np.uint8).reshape(-1, 6)
    entry = wide.view("<u8").ravel()
    del wide, entries
    order = np.argsort(entry, kind="stable")
    sign = entry[order] >> np.uint64(4)
    same = sign[1:] == sign[:-1]
    shared = (sign & np.uint64(1)) > 0  # a part of a dealt bucket may hold one class of it
    shared[1:] |= same
    shared[:-1] |= same
    order, sign = order[shared], sign[shared]
    code = (entry[order] & np.uint64(15)).astype(np.int64)
    own = who[order]
    name, n = np.frombuffer(classes, np.int64)[own], np.frombuffer(sizes, np.uint32)[own].astype(np.int64)
    # the same class may come from several tasks
    order = np.lexsort((code, name, sign))
    sign, name, n, code = sign[order], name[order], n[order], code[order]
    keep = np.ones(len(sign), bool)
    keep[1:] = (sign[1:] != sign[:-1]) | (name[1:] != name[:-1]) | (code[1:] != code[:-1])
    sign, name, n, code = sign[keep], name[keep], n[keep], code[keep]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(sign)), bool), sign[1:] != sign[:-1]]))
    k = np.diff(np.append(at, len(sign)))
    bucket_of = np.repeat(np.arange(len(at)), k)
    dealt = (sign[at] & np.uint64(1)) > 0
    asks, told = np.flatnonzero(code >= 4), np.flatnonzero((code & 1) > 0)
    n_asks, n_told = np.bincount(bucket_of[asks], minlength=len(at)), np.bincount(bucket_of[told], minlength=len(at))
    first_ask, first_told = np.cumsum(n_asks) - n_asks, np.cumsum(n_told) - n_told
    product = n_asks * n_told
    small = (product <= SMALL_BUCKET) & ~dealt
    found = [np.zeros((0, 2), np.int64)]
    todo = np.flatnonzero(small & (product > 0))
    for t in np.split(todo, np.flatnonzero(np.diff(np.cumsum(product[todo]) >> 20)) + 1):
        inner = ragged_arange(product[t])
        wide = np.repeat(n_told[t], product[t])
        i = asks[np.repeat(first_ask[t], product[t]) + inner // wide]
        j = told[np.repeat(first_told[t], product[t]) + inner % wide]
        ok = may_link(n[i], n[j]) & (n[j] <= n[i]) & (name[i] != name[j]) & probes(code[i], code[j])
        found.append(_distinct_pairs(name[i][ok], name[j][ok]))
    # classes of a large bucket with its centres: the first ones in CENTRES orders of all classes
    big = np.flatnonzero(np.repeat(~small, k))
    big_at = np.flatnonzero(np.concatenate([np.ones(min(1, len(big)), bool), sign[big][1:] != sign[big][:-1]]))
    big_k = np.diff(np.append(big_at, len(big)))
    heads = []
    for c in range(CENTRES if len(big) else 0):
        with np.errstate(over="ignore"):
            rank = mix64(name[big].view(np.uint64) + np.uint64(c * 0x9E3779B97F4A7C15 % 2**64))
        best = np.flatnonzero(rank == np.repeat(np.minimum.reduceat(rank, big_at), big_k))
        _, one = np.unique(np.repeat(np.arange(len(big_at)), big_k)[best], return_index=True)
        centre = big[best[one]]
        heads.append(centre)
        x = np.repeat(centre, big_k)
        ok = may_link(n[x], n[big]) & (name[x] != name[big])
        found.append(_distinct_pairs(name[x][ok], name[big][ok]))
    pairs = _distinct_pairs(*np.concatenate(found).T)
    yield _candidates(len(pairs), a=pairs[:, 0], b=pairs[:, 1])
    origin = np.where((sign & np.uint64(1)) > 0, 0, part).astype(np.uint64)  # a dealt bucket has one name in all its parts
    with np.errstate(over="ignore"):
        bucket = mix64(sign * np.uint64(parts) + origin).view(np.int64)
    yield _candidates(len(big), bucket=bucket[big], a=name[big], n=n[big], code=code[big])
    if dealt.any():
        top = np.concatenate(heads)
        top = top[(sign[top] & np.uint64(1)) > 0]
        yield _candidates(len(top), bucket=bucket[top], a=name[top], n=n[top])


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pairs, smaller one first, without repeats."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]], 1)


def may_link(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(n, m) >= 3 * np.maximum(n, m)


def probes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an entry of code x finds one of code y."""
    deleted = (x & 2) > 0
    return ((y & 1) > 0) & (x >= 4) & (((y & 2) == 0) | (~deleted & (x >= 8)))


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bit maps differ in no more bits than linked sets may differ in shingles."""
    for batch in batches:
        most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // 7
        differ = [maps_differ(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
        mask = pa.array(np.array(differ, np.int64) <= most)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])


def _compare(table: pa.Table) -> pa.Table:
    """Likely pairs of a block's asking rows with its told ones, of different components only."""
    name, code, n, label = (table.column(k).to_numpy() for k in ("class", "code", "n", "label"))
    asks = table.column("asks").to_numpy()
    maps = table.column("map").to_pylist()
    told, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    length = np.array([len(m) // 8 for m in maps])
    stacks: dict[tuple[int, int], np.ndarray] = {}

    def folded(size: int, to: int) -> np.ndarray:
        """The maps of ``size`` words in the block, folded to ``to`` words."""
        if (size, to) not in stacks:
            whole = np.frombuffer(b"".join(maps[k] for k in told[length[told] == size].tolist()), np.uint64)
            stacks[size, to] = np.bitwise_xor.reduce(whole.reshape(-1, size // to, to), axis=1)
        return stacks[size, to]

    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for size in np.unique(length[told]).tolist():
        rows = told[length[told] == size]
        for r in asking.tolist():
            ok = (label[rows] != label[r]) & may_link(n[rows], n[r]) & (n[rows] <= n[r]) & probes(np.full(len(rows), code[r]), code[rows])
            pick = np.flatnonzero(ok)
            if not len(pick):
                continue
            to = min(size, int(length[r]))
            own = np.bitwise_xor.reduce(np.frombuffer(maps[r], np.uint64).reshape(-1, to), axis=0)
            differ = np.bitwise_count(folded(size, to)[pick] ^ own).sum(1)
            hit = rows[pick[differ <= (n[rows[pick]] + n[r]) // 7]]
            a.append(name[hit])
            b.append(np.full(len(hit), name[r]))
    pairs = _distinct_pairs(np.concatenate(a), np.concatenate(b))
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _verify(words: int, threshold: tuple[int, int]):
    """The pairs whose texts have sets of words' shingles that link."""
    num, den = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), 2):
                n = batch.num_rows
                both = pa.chunked_array([batch.column(2), batch.column(3)])
                text, number = exact_shingles(*text_bytes(both), words)
                kinds = int(number.max(initial=0)) + 1
                keys = np.unique(text * kinds + number)
                size = np.bincount(keys // kinds, minlength=2 * n)
                cut = int(size[:n].sum())  # the first texts' keys, then the second ones'
                common = np.bincount(np.intersect1d(keys[:cut], keys[cut:] - n * kinds, assume_unique=True) // kinds, minlength=n)
                mask = pa.array((common > 0) & (den * common >= num * (size[:n] + size[n:] - common)))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


def _held_texts(words: int, seed: int, bloom: np.ndarray):
    """Text of each class that may be wanted, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches):
            sets, bounds = shingle_sets(*text_bytes(batch.column(1)), words, seed)
            names = set_classes(sets, bounds)[0]
            hit = (np.diff(bounds) > 0) & bloom_hits(names, bloom)
            rows = [k for k in np.flatnonzero(hit).tolist() if not (int(names[k]) in seen or seen.add(int(names[k])))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(names[rows]), batch.column(1).take(pa.array(rows))], ["class", "text"])

    return run


def linked_rows(documents: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``near_duplicates``, with the ``carry`` columns of each row and its ``root``.

    Rows link with each other, directly or over others, just when they have the same root; it is null for
    texts without words.  Carried columns must not have names of the result's own.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    shape = StructType([*(f for f in texts.schema if f.name != "text"), *(StructField(c, LongType()) for c in ("n", "class", "check")), *(StructField(c, BinaryType()) for c in ("map", "sketch"))])
    for seed in range(1, 9):
        found = materialise(texts.mapInArrow(_classify(words, seed), shape), "classes")
        docs = found.where("sketch is null").drop("sketch")
        held = docs.where("class is not null").groupBy("class").agg(F.min("check").alias("a"), F.max("check").alias("b"), F.min("n").alias("m"), F.max("n").alias("n"), F.min("doc_id").alias("first"), F.count("*").alias("rows"), F.first("map", ignorenulls=True).alias("map"))
        known = materialise(held, "sets")
        seen = known.agg(F.max(F.expr("a <> b or m <> n")).alias("clash"), F.sum("n").alias("shingles"), F.count("*").alias("classes")).first()
        if not seen.clash:  # else two sets share a digest: take other hashes
            break
    else:
        raise ValueError("set digests clash under every seed")
    sketch = added_sketches(found.where("sketch is not null").select("sketch"))
    usual = np.median(sketch, axis=1, keepdims=True)
    sketch = np.maximum(sketch - usual - 4 * np.sqrt(usual) - 16, 0).astype(np.int64)  # what stands out of the noise

    tasks = hash_partitions(spark)
    parts = min(MOST_PARTS, max(tasks, -(-(seen.shingles or 0) // PART_SHINGLES)))
    packed = texts.select("doc_id", "text").mapInArrow(_emit(words, seed, sketch, seen.classes, parts), "part long, classes binary, sizes binary, counts binary, entries binary")
    sorted_parts = packed.repartitionById(parts if parts <= 1 << 16 else 1 << 16, F.col("part").cast("int")).sortWithinPartitions("part")
    candidates = materialise(sorted_parts.mapInArrow(_pairs(parts), _CANDIDATE), "candidates")
    pairs = candidates.where("bucket is null").select("a", "b")
    large = candidates.where("code is not null").select("bucket", F.col("a").alias("class"), "code", "n")
    heads = candidates.where("bucket is not null and code is null").select("bucket", "a", "n").distinct()
    tops = heads.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"), F.col("n").alias("m"))).alias("t")).select("bucket", "t.b", "t.m")
    across = heads.join(tops.hint("merge"), "bucket").where("a <> b and 4 * least(n, m) >= 3 * greatest(n, m)")
    pairs = pairs.union(across.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    maps = known.select("class", "n", "map")

    def likely(pairs: DataFrame) -> DataFrame:
        with_a = pairs.join(maps.select(F.col("class").alias("a"), F.col("n").alias("m"), F.col("map").alias("x")).hint("merge"), "a")
        with_b = with_a.join(maps.select(F.col("class").alias("b"), F.col("n").alias("n"), F.col("map").alias("y")).hint("merge"), "b")
        return materialise(with_b.select("a", "b", "m", "n", "x", "y").mapInArrow(_likely, "a long, b long"), "likely")

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among the pairs; texts are read again, those of the classes that need them move."""
        wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
        whole = materialise(texts.select("doc_id", "text").mapInArrow(_held_texts(words, seed, bloom_of(wanted, "class", 2 * pairs.count())), "class long, text string").dropDuplicates(["class"]), "texts")
        with_a = pairs.join(whole.select(F.col("class").alias("a"), F.col("text").alias("x")).hint("merge"), "a")
        with_b = with_a.join(whole.select(F.col("class").alias("b"), F.col("text").alias("y")).hint("merge"), "b")
        return materialise(with_b.select("a", "b", "x", "y").mapInArrow(_verify(words, (3, 4)), "a long, b long"), "links")

    links = verified(likely(pairs))
    roots = connected_components(links)
    if not large.isEmpty():
        # asking classes against the told ones of their bucket, but for two of the bucket's largest component: by bit
        # map inside blocks, so that only likely pairs become rows.  Both sides are cut into blocks, those outside
        # the largest component first; a group is an asking block (i) and a told one (j)
        members = materialise(large.join(roots.withColumnRenamed("node", "class").hint("merge"), "class", "left").select("bucket", "class", "code", "n", F.coalesce("root", "class").alias("label")), "members")
        asks, told = F.col("code") >= 4, F.col("code").bitwiseAND(1) > 0
        per_label = members.groupBy("bucket", "label").agg(F.count("*").alias("k"), F.count_if(asks).alias("asks"), F.count_if(told).alias("told"), F.max("n").alias("n"))
        main = per_label.groupBy("bucket").agg(F.max(F.struct("k", "label", "asks", "told")).alias("m"), F.sum("asks").alias("asks"), F.sum("told").alias("told"), F.max("n").alias("n"))
        per_block = f"least({BLOCK_ROWS}, greatest(1, {BLOCK_BYTES} div greatest(32, n)))"  # a bit map has at most a byte a shingle
        blocks = lambda rows, name: F.expr(f"cast(ceil(({rows}) / {per_block}) as int)").alias(name)
        mixed = main.select("bucket", F.col("m.label").alias("main"), blocks("asks - m.asks", "a0"), blocks("m.asks", "a1"), blocks("told - m.told", "t0"), blocks("m.told", "t1")).where("a0 * (t0 + t1) + a1 * t0 > 0")
        rows = members.join(mixed.hint("merge"), "bucket").join(maps.select("class", "map").hint("merge"), "class").withColumn("apart", F.expr("label <> main"))
        upto = lambda n: f"if({n} > 0, sequence(0, {n} - 1), cast(array() as array<int>))"
        place = lambda n: f"if(apart, pmod(xxhash64(class), greatest(1, {n}0)), {n}0 + pmod(xxhash64(class), greatest(1, {n}1)))"
        ask_to = f"if(code >= 4, transform({upto('if(apart, t0 + t1, t0)')}, x -> struct(cast({place('a')} as int) as i, x as j, true as asks)), array())"
        tell_to = f"if(code & 1 > 0, transform({upto('if(apart, a0 + a1, a0)')}, x -> struct(x as i, cast({place('t')} as int) as j, false as asks)), array())"
        dealt = rows.withColumn("to", F.explode(F.expr(f"concat({ask_to}, {tell_to})"))).select("bucket", "to.*", "class", "code", "n", "label", "map")
        more = materialise(dealt.groupBy("bucket", "i", "j").applyInArrow(_compare, "a long, b long").distinct(), "likely")
        if not more.isEmpty():
            links = links.union(verified(more))
            roots = connected_components(links)

    rooted = known.select("class", "first", "rows").join(roots.withColumnRenamed("node", "class").hint("merge"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("of"))
    component = materialise(salted_join(rooted.select("class", "root", "rows"), least, "root", hot_keys(least, "root", "of")).select("class", "root", "component_id", "rows"), "components")
    out = salted_join(docs, component, "class", hot_keys(component, "class", "rows"))
    return out.select("doc_id", *carry, F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def near_duplicates(documents: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id.

    A-Z is lower-cased; words are runs without ASCII white space; fewer than ``words`` words are one
    shingle; texts without words (or null) have the empty set and link with nothing.  Sets link at
    Jaccard similarity 3/4 or more.  component_id is the smallest id reachable, itself included;
    null ids count only if nothing else is reachable.  Rows that repeat an id are judged each by
    its own text.  An empty table gives no row; other columns are not read.
    """
    return linked_rows(documents, words, id_col, text_col).select("doc_id", "n_shingles", "component_id")
