"""Byte-level BPE ids of Arrow text batches, with the tokenizers library doing every distinct word once.

The split pattern of byte-level BPE cuts a text into words that are encoded independently of
each other.  The cuts are found with numpy over a whole batch, the distinct words go through
the tokenizers library once per worker and are kept, and the ids of all texts are gathered
from that table.  A text with a character whose class is not certain (unassigned in old Unicode
versions, multi-byte white space, odd control characters) is given to the library as a whole.
"""
from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

from .common import mix64, text_bytes

_UNSURE, _LETTER, _NUMBER, _OTHER, _BREAK, _SPACE = range(6)
_TABLE_END = 0x30000


def char_classes() -> np.ndarray:
    """Class of every code point below _TABLE_END; unsure where Unicode versions may differ."""
    old = unicodedata.ucd_3_2_0
    out = np.zeros(_TABLE_END, np.uint8)
    for cp in range(_TABLE_END):
        now = unicodedata.category(c := chr(cp))
        if now != old.category(c) or now in ("Cn", "Cs"):
            continue
        out[cp] = _LETTER if now[0] == "L" else _NUMBER if now[0] == "N" else _UNSURE if c.isspace() else _OTHER
    out[0x1C:0x20] = _UNSURE
    out[[9, 10, 11, 12, 13]] = _BREAK
    out[32] = _SPACE
    out[[0, 0x85]] = _UNSURE
    return out


def byte_kinds(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the character that each UTF-8 byte belongs to."""
    kinds = classes[:128][np.minimum(data, 127)]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b0 = data[lead].astype(np.int64)
        size = np.where(b0 < 0xE0, 2, np.where(b0 < 0xF0, 3, 4))
        cp = np.where(size == 2, b0 & 0x1F, np.where(size == 3, b0 & 0x0F, b0 & 0x07))
        for k in (1, 2, 3):
            more = size > k
            cp[more] = (cp[more] << 6) | (data[lead[more] + k] & 0x3F)
        kind = np.where(cp < _TABLE_END, classes[np.minimum(cp, _TABLE_END - 1)], _UNSURE).astype(np.uint8)
        kinds[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            kinds[lead[more] + k] = kind[more]
    return kinds


def word_starts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Mask of the bytes at which the split pattern starts a word."""
    n = len(data)
    group = np.minimum(kinds, _BREAK)
    blank = group == _BREAK
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    cut = np.empty(n, bool)
    cut[:1] = True
    np.not_equal(group[1:], group[:-1], out=cut[1:])
    glued = (kinds[:-1] == _SPACE) & ~blank[1:]  # a space goes with the word that follows it
    cut[1:] &= ~glued
    last_blank = np.zeros(n, bool)
    if n > 2:
        last_blank[1:-1] = blank[1:-1] & blank[:-2] & ~blank[2:] & ~first[1 : n - 1] & ~first[2:n]
    cut |= last_blank
    cut |= first[:n]
    quotes = np.flatnonzero(data == 39)
    if len(quotes):
        before = np.where(quotes > 0, kinds[quotes - 1], _BREAK)
        quotes = quotes[first[quotes] | ((before != _OTHER) & (before != _SPACE))]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        edge = np.concatenate([first, np.ones(3, bool)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        inside1 = ~edge[quotes + 1]
        inside2 = inside1 & ~edge[quotes + 2]
        short = inside1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = inside2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        cut[quotes[short | long] + 1] = False
        cut[quotes[long] + 2] = False
        ends = np.concatenate([quotes[short] + 2, quotes[long] + 3])
        cut[ends[ends < n]] = True
    return cut


class WordTable:
    """Ids of words seen so far; emptied when it holds more than ``most`` words.

    A word of up to 16 bytes is the key of an open-addressing table kept in numpy (its bytes as
    two integers, so nothing rests on a hash being unique); longer words are in a dictionary.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        self.most = most
        self.load(path)
        self._clear()

    def load(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.classes = char_classes()

    def _clear(self) -> None:
        slots = 1 << max(10, (self.most * 2).bit_length())
        self.low, self.high = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.held = np.full(slots, -1, np.int32)
        self.long: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.used = self.words = 0

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15) + (high >> np.uint64(29)))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(64 - (len(self.held).bit_length() - 1))).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        slot = self._slots(low, high)
        out = self.held[slot].astype(np.int64)
        left = np.flatnonzero((out >= 0) & ((self.low[slot] != low) | (self.high[slot] != high)))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.held) - 1)
            at = slot[left]
            out[left] = self.held[at]
            left = left[(out[left] >= 0) & ((self.low[at] != low[left]) | (self.high[at] != high[left]))]
        return out

    def _insert(self, low: np.ndarray, high: np.ndarray, index: np.ndarray) -> None:
        if 2 * self.words > len(self.held):
            kept = np.flatnonzero(self.held >= 0)
            low, high, index = (np.concatenate(x) for x in ((self.low[kept], low), (self.high[kept], high), (self.held[kept], index)))
            slots = 1 << (4 * self.words).bit_length()
            self.low, self.high, self.held = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.full(slots, -1, np.int32)
        slot = self._slots(low, high)
        left = np.arange(len(low))
        while len(left):
            at = slot[left]
            free = np.flatnonzero(self.held[at] < 0)
            took = free[np.unique(at[free], return_index=True)[1]]
            self.held[at[took]] = index[left[took]]
            self.low[at[took]], self.high[at[took]] = low[left[took]], high[left[took]]
            left = np.delete(left, took)
            slot[left] = (slot[left] + 1) & (len(self.held) - 1)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def encode_whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the words, and a mask of the bytes that are not certain."""
        kinds = byte_kinds(data, self.classes)
        return np.flatnonzero(word_starts(data, offsets, kinds)), kinds == _UNSURE

    def _learn(self, words: list[bytes]) -> int:
        """Encode new words; the index of the first."""
        found = self.encode_words(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        n, k = self.words, len(words)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + k > len(self.start):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + k] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + k] = sizes
        self.used += len(flat)
        self.words += k
        return n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts, one after another, and int64 offsets by text."""
        data, offsets = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        return self.encode_bytes(data, offsets)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, of a buffer of texts."""
        at, unsure = self.split(data, offsets)
        length = np.diff(np.append(at, len(data)))
        odd = np.zeros(0, np.int64)
        good = np.ones(len(at), bool)  # words of the texts that are not given to the library as a whole
        if unsure.any():
            odd_text = np.diff(np.concatenate([[0], np.cumsum(unsure)])[offsets]) > 0
            odd = np.flatnonzero(odd_text)
            good = ~odd_text[np.searchsorted(offsets, at, side="right") - 1]
        if self.words > self.most:
            self._clear()
        eight = np.lib.stride_tricks.as_strided(np.concatenate([data, np.zeros(16, np.uint8)]), (len(data) + 8, 8), (1, 1))
        ones = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = eight[at].view("<u8").ravel() & (ones >> ((8 - np.minimum(length, 8)) * 8).astype(np.uint64))
        high = np.zeros(len(at), np.uint64)
        more = np.flatnonzero((length > 8) & (length <= 16))
        high[more] = eight[at[more] + 8].view("<u8").ravel() & (ones >> ((16 - length[more]) * 8).astype(np.uint64))
        giant = np.flatnonzero((length > 16) & good)
        index = np.where(good & (length <= 16), self._find(low, high), 0)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new_low, new_high, back = _distinct(low[missing], high[missing])
            first = self._learn(np.stack([new_low, new_high], 1).view("S16").ravel().tolist())
            self._insert(new_low, new_high, first + np.arange(len(new_low)))
            index[missing] = first + back
        if len(giant):
            words = [data[a : a + n].tobytes() for a, n in zip(at[giant].tolist(), length[giant].tolist(), strict=True)]
            if new_words := list(dict.fromkeys(w for w in words if w not in self.long)):
                first = self._learn(new_words)
                self.long.update(zip(new_words, range(first, first + len(new_words)), strict=True))
            index[giant] = [self.long[w] for w in words]
        size = np.where(good, self.size[index], 0)
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[index] - ends + size, size) + np.arange(int(ends[-1]))]
        bounds = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return self._replace(ids, bounds, odd, data, offsets) if len(odd) else (ids, bounds)

    def _replace(self, ids: np.ndarray, bounds: np.ndarray, odd: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = {k: np.array(self.encode_whole(data[offsets[k] : offsets[k + 1]].tobytes().decode()), np.uint32) for k in odd.tolist()}
        parts, sizes, done = [], np.diff(bounds), 0
        for k, own in whole.items():
            parts += [ids[bounds[done] : bounds[k]], own]
            sizes[k], done = len(own), k + 1
        parts.append(ids[bounds[done] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def _distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs and each row's place among them (a pair may stand twice, which does no harm)."""
    with np.errstate(over="ignore"):
        order = np.argsort(mix64(low ^ mix64(high)), kind="stable")
    low, high = low[order], high[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    back = np.empty(len(low), np.int64)
    back[order] = np.cumsum(new) - 1
    return low[new], high[new], back


_tables: dict[str, WordTable] = {}


def word_table(path: str) -> WordTable:
    """The worker's table for a tokenizer file; Python workers are reused, so it outlives a task."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to every text's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ends = bounds[1:] + np.arange(n)
    keep[ends] = False
    out[keep] = ids
    return out, bounds + np.arange(n + 1)

