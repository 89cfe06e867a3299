"""Shared helpers: Arrow text buffers, vectorised byte hashing, shared-folder tables.

Only bounded things reach the driver (a bit map, a few hot keys), never rows.  Helpers that run inside tasks work on one Arrow
batch at a time.
"""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import materialise  # noqa: F401


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its int64 offsets; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64, count=n + 1, offset=8 * column.offset)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased and nothing else changed."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def mix64(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over the word; in place where ``out`` is ``x``."""
    x = x.astype(np.uint64, copy=True) if out is None else out
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x7FB5D329728EA185)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x81DADEF4BC2DD44D)
        x ^= x >> np.uint64(33)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit code for each byte value."""
    return mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


BASES = (0x5851F42D4C957F2D, 0xD1342543DE82EF95)  # odd, so they have inverses modulo 2**64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    step = 4096
    first, x = [], 1
    for _ in range(min(step, n)):
        first.append(x)
        x = x * base % 2**64
    out[: len(first)] = first
    with np.errstate(over="ignore"):
        done = len(first)
        jump = np.uint64(pow(base, step, 2**64))
        while done < n:
            k = min(step, n - done)
            out[done : done + k] = out[done - step : done - step + k] * jump
            done += k
    return out


class SpanHasher:
    """64-bit polynomial hashes of any byte span of a buffer, from prefix sums modulo 2**64.

    Not for spans of a thousand bytes and more that someone else chooses: such hashes have known clashes there.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1, base: int = 0):
        n = len(data) + 1
        held = SpanHasher._powers.get(base)
        if held is None or len(held[0]) < n:
            size = max(n, 2 * len(held[0]) if held else 0)
            held = SpanHasher._powers[base] = (_powers(BASES[base], size), _powers(pow(BASES[base], -1, 2**64), size))
        up, self.down = held
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n, np.uint64)
            np.take(byte_codes(seed), data, out=self.prefix[1:])
            self.prefix[1:] *= up[: n - 1]
            np.cumsum(self.prefix, out=self.prefix)

    def windows(self, length: int) -> np.ndarray:
        """As ``spans``, of every span of one length in the buffer."""
        with np.errstate(over="ignore"):
            raw = self.prefix[length:] - self.prefix[: len(self.prefix) - length]
            raw *= self.down[: len(raw)]
            raw += np.uint64(length * 0xD6E8FEB86659FD93 % 2**64)
            return mix64(raw, out=raw)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.prefix[end] - self.prefix[start]) * self.down[start]
            return mix64(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ragged_arange(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for every count c, one after another."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) - np.repeat(ends - counts, counts)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made from it that no column of ``df`` has."""
    while name in df.columns:
        name += "_"
    return name


SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches between the JVM and Python hold about BATCH_BYTES: long texts come in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Let the system have the memory that this process has freed: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library can
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in runs of about ``most`` bytes of text, which bounds a task's memory; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi
    give_back()


def arrow_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], text: int = 1) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function from one that maps a slice of rows; ``text`` is the place of the text column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            if (out := fn(batch)) is not None:
                yield out

    return run


def hash_partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BLOOM_LEAST, BLOOM_MOST = 1 << 20, 1 << 27  # bits


def bloom_of(keys: DataFrame, column: str, expected: int) -> np.ndarray:
    """A bit map over a column of 64-bit hashes, two bits a key and about 16 for each ``expected`` one.

    Spark merges it word by word; only the words come to the driver, 16 MB at most.  It serves to
    leave rows out of a shuffle; beyond some ten million keys, where it fills, more and more rows
    go through the shuffle that needn't, which costs time but no result.
    """
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (16 * expected).bit_length()))
    bit = F.explode(F.array(*(F.expr(f"shiftrightunsigned({column}, {s}) & {bits - 1}") for s in (0, 32)))).alias("bit")
    words = keys.select(bit).groupBy(F.expr("cast(bit div 32 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 32 as int))")).alias("m"))
    out = np.zeros(bits // 32, np.uint32)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy().astype(np.uint32)
    return out


def bloom_hits(keys: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the map."""
    u = keys.view(np.uint64)
    hit = np.ones(len(u), bool)
    for s in (0, 32):
        bit = (u >> np.uint64(s)) & np.uint64(32 * len(bloom) - 1)
        hit &= (bloom[(bit // np.uint64(32)).astype(np.int64)] >> (bit % np.uint64(32)).astype(np.uint32)) & 1 > 0
    return hit


def in_bloom(bloom: np.ndarray, wanted: bool, column: str = "k") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` function: the rows whose ``column`` may be in the map, or those whose isn't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = bloom_hits(batch.column(batch.schema.get_field_index(column)).to_numpy(), bloom)
            yield batch.filter(pa.array(hit if wanted else ~hit))

    return run


HOT_KEYS, HOT_ROWS, SALTS = 64, 1000, 64


def hot_keys(counted: DataFrame, key: str, count: str) -> list[int]:
    """Hashes of the keys with most rows: at most HOT_KEYS of them, of HOT_ROWS rows at least."""
    return [r[0] for r in counted.where(F.col(count) >= HOT_ROWS).orderBy(F.col(count).desc()).select(F.xxhash64(key)).limit(HOT_KEYS).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list[int]) -> DataFrame:
    """``left`` with the columns of ``right`` (one row a key at most), whose rows of the ``hot`` keys are repeated.

    A key that holds a large part of ``left`` is so dealt over SALTS keys of the shuffle.
    """
    if not hot:
        return left.join(right.hint("merge"), key, "left")
    is_hot = F.coalesce(F.xxhash64(key).isin(*hot), F.lit(False))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread.hint("merge"), [key, "_salt"], "left").drop("_salt")
