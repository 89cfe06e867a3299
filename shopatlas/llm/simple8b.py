"""Simple-8b word-aligned coding of integer blocks, vectorised over all blocks of a call.

A word holds a 4-bit selector and 60 payload bits: ``COUNTS[s]`` values of ``BITS[s]`` bits each.
A block has BLOCK values, starts a new word and has an entry in the block offsets, so blocks are
decoded independently.  A value of more than 60 bits is an escape: its word holds the place of
the value in a list of exceptions.
"""
from __future__ import annotations

import numpy as np

BLOCK = 128
# The selectors of Simple-8b, most values first; the last one is the escape.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15


def _width(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs; 61 for what has to be an escape."""
    out = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    high = values >> np.uint64(32)
    if high.any():
        out = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], out)
    return np.minimum(out, 61).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), the first word of each block and the end (uint32), exceptions (uint64)."""
    values = np.asarray(values, np.uint64)
    blocks = -(-len(values) // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint32), np.zeros(0, np.uint64)
    grid = np.zeros(blocks * BLOCK, np.uint64)
    grid[: len(values)] = values
    length = np.full(blocks, BLOCK)
    length[-1] = len(values) - BLOCK * (blocks - 1)
    width = np.zeros((blocks, 2 * BLOCK), np.uint8)  # nothing needs bits behind the end of a block
    width[:, :BLOCK] = _width(grid).reshape(blocks, BLOCK)
    choice = np.full((blocks, BLOCK), ESCAPE, np.uint8)
    reach, widest = 1, width
    spans = {1: width}
    while reach < 64:
        wider = widest.copy()
        wider[:, :-reach] = np.maximum(widest[:, :-reach], widest[:, reach:])
        reach, widest = 2 * reach, wider
        spans[reach] = widest
    for s in range(14, -1, -1):
        n = int(COUNTS[s])
        p = 1 << (n.bit_length() - 1)
        most = spans[p][:, :BLOCK] if p == n else np.maximum(spans[p][:, :BLOCK], spans[p][:, n - p : n - p + BLOCK])
        choice[most <= BITS[s]] = s
    rows, at, places, picked, order = np.arange(blocks), np.zeros(blocks, np.int64), [], [], []
    while len(rows):
        s = choice[rows, at[rows]]
        places.append(rows * BLOCK + at[rows])
        picked.append(s)
        order.append(rows)
        at[rows] += COUNTS[s]
        rows = rows[at[rows] < length[rows]]
    row, place, s = np.concatenate(order), np.concatenate(places), np.concatenate(picked)
    sort = np.argsort(place, kind="stable")
    row, place, s = row[sort], place[sort], s[sort]
    words = s.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([grid, np.zeros(BLOCK, np.uint64)])
    for k in np.unique(s).tolist():
        mine = np.flatnonzero(s == k)
        if k == ESCAPE:
            exceptions = padded[place[mine]]
            words[mine] |= np.arange(len(mine), dtype=np.uint64)
            continue
        left = (row[mine] + 1) * BLOCK - place[mine]
        for j in range(int(COUNTS[k])) if BITS[k] else ():
            inside = j < left
            words[mine[inside]] |= padded[place[mine[inside]] + j] << np.uint64(j * int(BITS[k]))
    if ESCAPE not in s:
        exceptions = np.zeros(0, np.uint64)
    return words, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=blocks))]).astype(np.uint32), exceptions


def decode(words: np.ndarray, block_starts: np.ndarray, exceptions: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` values of the blocks, all blocks at once."""
    out = np.zeros(count, np.uint64)
    if not count:
        return out
    s = (words >> np.uint64(60)).astype(np.int64)
    held = COUNTS[s]
    block = np.repeat(np.arange(len(block_starts) - 1), np.diff(block_starts.astype(np.int64)))
    before = np.cumsum(held) - held
    place = block * BLOCK + before - before[block_starts[:-1].astype(np.int64)][block]
    end = np.minimum((block + 1) * BLOCK, count)
    for k in np.unique(s).tolist():
        mine = np.flatnonzero(s == k)
        payload = words[mine] & np.uint64((1 << 60) - 1)
        if k == ESCAPE:
            out[place[mine]] = exceptions[payload.astype(np.int64)]
        elif BITS[k]:
            low = np.uint64((1 << int(BITS[k])) - 1)
            for j in range(int(COUNTS[k])):
                inside = place[mine] + j < end[mine]
                out[place[mine][inside] + j] = (payload[inside] >> np.uint64(j * int(BITS[k]))) & low
    return out
