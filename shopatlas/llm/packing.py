"""Cost-balanced packing of token sequences.

A piece of n ids costs LINEAR * n + QUADRATIC * n**2 (its own attention).  Documents of a group,
largest first, go to the lowest-cost sequence that has room for all of them (whole sequences are cut off the
long ones before); a document that fits nowhere is cut over the lowest-cost sequences with room.  A group has
exactly as much room as it has ids: whole sequences and, for the rest, sequences of a power of two, which need
no padding.  What falls to these goes on to the task's next group, so that a task has them only once.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import with_end, word_table
from .common import slices

CAPACITY = 2048
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, ...]:
    """Pieces of one group: document place, start in it, length, sequence, offset in the sequence, and whether that is a whole one."""
    whole, rest = np.divmod(np.asarray(lengths, np.int64), capacity)
    n_whole = int(whole.sum())
    doc = np.repeat(np.arange(len(lengths)), whole)
    start = (np.arange(n_whole) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    pieces = [(doc, start, np.full(n_whole, capacity), np.arange(n_whole), np.zeros(n_whole, np.int64), np.ones(n_whole, np.int64))]
    total = int(rest.sum())
    tail = total % capacity
    room = np.array([capacity] * (total // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if tail >> k & 1], np.int64)
    size, cost = room.copy(), np.zeros(len(room))
    made: list[tuple[int, ...]] = []
    order = np.argsort(-np.asarray(lengths, np.int64), kind="stable")
    for d in order[rest[order] > 0].tolist():
        left, at = int(rest[d]), int(whole[d]) * capacity
        while left:
            fits = room >= left
            s = int(np.argmin(np.where(fits if fits.any() else room > 0, cost, np.inf)))
            n = min(left, int(room[s]))
            made.append((d, at, n, n_whole + s, int(size[s] - room[s]), int(size[s] == capacity)))
            room[s] -= n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            left, at = left - n, at + n
    pieces.append(tuple(np.array(made, np.int64).reshape(-1, 6).T))
    return tuple(np.concatenate(x) for x in zip(*pieces, strict=True))


def pack_documents(documents: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut and pack all documents into sequences of at most ``capacity`` (a power of two) ids.

    One pass without a shuffle: a task packs the texts it reads in groups of about 1 MB, within which costs are balanced.
    A sequence's number is made of its task's and its own.  Null texts are empty (the end id
    alone), null ids stay null, rows that repeat an id are documents of their own, an empty table
    gives no row; other columns are not read.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        # what is still to pack: the document's id, its length, where the piece starts in it, and the piece's ids
        left = (pa.array([], pa.int64()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(1, np.int64))

        def packed(names: pa.Array, whole: np.ndarray, base: np.ndarray, ids: np.ndarray, bounds: np.ndarray, last: bool):
            nonlocal number, left
            doc, start, length, sequence, offset, full = pack(np.diff(bounds), capacity)
            first = bounds[:-1][doc] + start
            later = np.flatnonzero((full == 0) & (not last))
            now = np.flatnonzero((full == 1) | last)
            flat = ids.astype("<u4", copy=False)
            if len(now):
                sums = [zlib.crc32(flat[a : a + n]) for a, n in zip(first[now].tolist(), length[now].tolist(), strict=True)]
                columns = ((base[doc] + start)[now], length[now], sums, whole[doc][now], number + sequence[now], offset[now])
                yield pa.RecordBatch.from_arrays([names.take(pa.array(doc[now])), *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
                number += int(sequence[now].max()) + 1
            parts = [ids[a : a + n] for a, n in zip(first[later].tolist(), length[later].tolist(), strict=True)]
            left = (names.take(pa.array(doc[later])), whole[doc][later], (base[doc] + start)[later], np.concatenate([np.zeros(0, np.uint32), *parts]), np.concatenate([[0], np.cumsum(length[later])]))

        for batch in slices(batches):
            ids, bounds = with_end(*word_table(tokenizer).encode(batch.column(1)), end_id)
            names = pa.concat_arrays([left[0], batch.column(0).cast(pa.int64())])
            whole = np.concatenate([left[1], np.diff(bounds)])
            base = np.concatenate([left[2], np.zeros(batch.num_rows, np.int64)])
            yield from packed(names, whole, base, np.concatenate([left[3], ids]), np.concatenate([left[4], left[4][-1] + bounds[1:]]), False)
        if len(left[1]):
            yield from packed(*left, True)

    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
