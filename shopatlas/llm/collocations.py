"""Phrase collocation mining with FM-indexes over word ids.

A shard is a slice of a task's texts.  Its index is the Burrows-Wheeler transform of its words and
that of the reversed words, in the order of the first ``DEPTH`` words of each suffix, which is all
that phrases of at most ``DEPTH`` words ask for.  A phrase is an interval in both; extending all
intervals of a depth by one word, to the right by one transform and to the left by the other,
gives every longer phrase that occurs, with its count.  Spark sums the counts of all shards.

A phrase that occurs often enough consists of words and shorter phrases that do, so words, then
pairs, that are too rare in the whole corpus are left out of what the shards enumerate.  Bit maps
of a bounded size tell; what they let through needlessly is summed and then dropped, so no count
depends on them.  Words carry their language, and no piece of text has two.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SpanHasher, bloom_hits, bloom_of, bound_batches, lower_ascii, materialise, mix64, ragged_arange, slices, text_bytes

SHARD_BYTES = 8 << 20
DEPTH = 3
LEAST, KEEP, SALTS = 10, 2000, 64
SHARE = 50  # per cent of a phrase's occurrences inside a longer one that let the longer one stand for it
UNKNOWN = "und"
_PIECE, _BLANK = 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = _PIECE
_KINDS[np.frombuffer(b" \t", np.uint8)] = _BLANK


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of lower-cased texts, the text of each, and whether it is the first of its piece."""
    kinds = _KINDS[data]
    inside = kinds == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    at = np.flatnonzero(start)
    size = np.flatnonzero(end) + 1 - at
    doc = np.searchsorted(offsets, at, side="right") - 1
    cuts = np.cumsum(kinds == _PIECE)[at]
    first = np.ones(len(at), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (cuts[1:] != cuts[:-1])
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    return words, doc, first


def _hashes(words: pa.Array) -> np.ndarray:
    words = words.cast(pa.large_binary())
    bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    raw = words.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return SpanHasher(data[bounds[0] : bounds[-1]]).spans(bounds[:-1] - bounds[0], bounds[1:] - bounds[0])


def word_keys(words: pa.Array, lang: np.ndarray, langs: pa.Array) -> np.ndarray:
    """64-bit hashes of (language, word)."""
    with np.errstate(over="ignore"):
        return mix64(_hashes(words) + mix64(_hashes(langs))[lang] * np.uint64(3)).view(np.int64)


def pair_keys(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(keys.view(np.uint64))[a] * np.uint64(5) + keys.view(np.uint64)[b]).view(np.int64)


class Shard:
    """The distinct (language, word) pairs of a slice (langs, lang, words) and, of each word, which it is and whether it starts a piece."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(0).fill_null(UNKNOWN).dictionary_encode()
        data, offsets = text_bytes(batch.column(1))
        words, doc, self.first = split_words(lower_ascii(data), offsets)
        coded = words.dictionary_encode()
        both = langs.indices.to_numpy().astype(np.int64)[doc] * max(1, len(coded.dictionary)) + coded.indices.to_numpy()
        known, self.ids = np.unique(both, return_inverse=True)
        self.langs, self.lang = langs.dictionary, known // max(1, len(coded.dictionary))
        self.words = coded.dictionary.take(pa.array(known % max(1, len(coded.dictionary))))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` function: (lang, text) to (lang, word, k, n) of each slice."""
    for batch in slices(batches, most=SHARD_BYTES):
        s = Shard(batch)
        count = np.bincount(s.ids, minlength=len(s.words))
        yield pa.RecordBatch.from_arrays([s.langs.take(pa.array(s.lang)), s.words.cast(pa.large_string()).cast(pa.string()), pa.array(word_keys(s.words, s.lang, s.langs)), pa.array(count, pa.int64())], ["lang", "word", "k", "n"])


class FMIndex:
    """Both transforms of a sequence of symbols (0 ends a piece), for phrases of at most ``DEPTH`` symbols."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray, size: int):
        self.size = size
        self.sides = []
        for bwt in (forward, backward):
            count = np.bincount(bwt, minlength=size)
            # (symbol, place) in order: the number of a symbol before a place is a search
            self.sides.append((bwt, np.cumsum(count) - count, np.sort((bwt.astype(np.int64) << 32) | np.arange(len(bwt)))))

    @staticmethod
    def transform(text: np.ndarray) -> np.ndarray:
        """The symbol before each suffix, the suffixes in the order of their first DEPTH symbols; ``text`` ends with 0s."""
        padded = np.concatenate([text, np.zeros(DEPTH, text.dtype)]).astype(np.int64)
        columns = [padded[k : k + len(text)] for k in range(DEPTH)]
        bits = int(text.max(initial=0)).bit_length()
        if bits * DEPTH < 64:
            key = columns[0]
            for c in columns[1:]:
                key = (key << bits) | c
            order = np.argsort(key)
        else:
            order = np.lexsort(columns[::-1])
        return np.roll(text, 1)[order].astype(np.int32)

    @classmethod
    def build(cls, text: np.ndarray, size: int) -> FMIndex:
        return cls(cls.transform(text), cls.transform(text[::-1]), size)

    def symbols(self) -> tuple[np.ndarray, np.ndarray]:
        """The intervals (low in both transforms, count) of all single symbols, and the symbols."""
        first = self.sides[0][1]
        count = np.diff(np.append(first, len(self.sides[0][0])))
        there = np.flatnonzero(count)
        there = there[there > 0]
        return np.stack([first[there], self.sides[1][1][there], count[there]], 1), there

    def extend(self, intervals: np.ndarray, left: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All phrases one symbol longer: their intervals, the phrase each comes from, and its new symbol."""
        mine, other = (0, 1) if left else (1, 0)
        bwt, first, places = self.sides[mine]
        low, count = intervals[:, mine], intervals[:, 2]
        owner = np.repeat(np.arange(len(intervals)), count)
        key = np.sort((owner << 32) | bwt[np.repeat(low, count) + ragged_arange(count)])
        new = np.flatnonzero(np.append(np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
        size = np.diff(np.append(new, len(key)))
        owner, symbol = key[new] >> 32, key[new] & 0xFFFFFFFF
        smaller = new - (np.cumsum(count) - count)[owner]  # of its own interval, those with a smaller symbol
        out = np.empty((len(new), 3), np.int64)
        out[:, mine] = np.searchsorted(places, (symbol << 32) | low[owner])  # equals first[symbol] and the symbol's number before low
        out[:, other] = intervals[owner, other] + smaller
        out[:, 2] = size
        real = symbol > 0
        return out[real], owner[real], symbol[real]


_INDEX = "shard long, langs array<string>, lang binary, words binary, forward binary, backward binary"


def _squeeze(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a, "<i4").tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i4")


def symbol_text(shard: Shard, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shard's symbols with 0 between pieces and in place of rare words, and the word of each symbol from 1 on.

    Runs of 0 are one, and a word between two of them goes too: it has no neighbour.
    """
    good = frequent[shard.ids]
    cut = shard.first.copy()
    cut[1:] |= ~good[:-1]  # a rare word before
    after = np.append(cut[1:] | ~good[1:], True)
    kept = good & ~(cut & after)
    used, symbols = np.unique(shard.ids[kept], return_inverse=True)
    starts = cut[kept]
    at = np.arange(len(symbols)) + np.cumsum(starts)
    text = np.zeros(len(symbols) + int(starts.sum()) + 1, np.int64)
    text[at] = symbols + 1
    return text, used


def _indexed(bloom: np.ndarray):
    """``mapInArrow`` function: (lang, text) to an index row a slice, of its frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId() << 32, [c.split(" ")[0] for c in _INDEX.split(", ")]
        for number, batch in enumerate(slices(batches, most=SHARD_BYTES)):
            s = Shard(batch)
            text, used = symbol_text(s, bloom_hits(word_keys(s.words, s.lang, s.langs), bloom))
            if len(used):
                joined = b"\n".join(s.words.take(pa.array(used)).to_pylist())  # no word holds a line feed
                row = [part + number, s.langs.to_pylist(), _squeeze(s.lang[used]), zlib.compress(joined, 1), _squeeze(FMIndex.transform(text)), _squeeze(FMIndex.transform(text[::-1]))]
                kinds = (pa.int64(), pa.list_(pa.string()), *(pa.binary(),) * 4)
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[FMIndex, pa.Array, np.ndarray, pa.Array]]:
    """Index, words, the language of each, and the languages, of every index row."""
    for batch in batches:
        for k in range(batch.num_rows):
            langs, lang, words, forward, backward = (batch.column(c)[k] for c in range(1, 6))
            words = pa.array(zlib.decompress(words.as_py()).split(b"\n"), pa.large_binary())
            yield FMIndex(_spread(forward.as_py()), _spread(backward.as_py()), len(words) + 1), words, _spread(lang.as_py()), langs.values


def _pairs(index: FMIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of all phrases of two words, and their words' places (by extension to the right)."""
    intervals, symbol = index.symbols()
    longer, owner, last = index.extend(intervals, left=False)
    return longer, symbol[owner] - 1, last - 1


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` function: index rows to (k, n) of each shard's pairs of words."""
    for index, words, lang, langs in _opened(batches):
        intervals, a, b = _pairs(index)
        yield pa.RecordBatch.from_arrays([pa.array(pair_keys(word_keys(words, lang, langs), a, b)), pa.array(intervals[:, 2])], ["k", "n"])


def _count_phrases(bloom: np.ndarray):
    """``mapInArrow`` function: index rows to (lang, phrase, words, n) of phrases all of whose pairs are in the map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for index, words, lang, langs in _opened(batches):
            keys = word_keys(words, lang, langs)
            intervals, a, b = _pairs(index)
            often = bloom_hits(pair_keys(keys, a, b), bloom)
            intervals, a, b = intervals[often], a[often], b[often]
            longer, owner, first = index.extend(intervals, left=True)
            front = bloom_hits(pair_keys(keys, first - 1, a[owner]), bloom)
            longer, owner, first = longer[front], owner[front], first[front] - 1
            for found, places in ((intervals, (a, b)), (longer, (first, a[owner], b[owner]))):
                phrase = pc.binary_join_element_wise(*(words.take(pa.array(p)) for p in places), pa.scalar(b" ", pa.large_binary()))
                n = len(phrase)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang[places[0]])), phrase.cast(pa.large_string()).cast(pa.string()), pa.array(np.full(n, len(places)), pa.int32()), pa.array(found[:, 2])], ["lang", "phrase", "words", "n"])

    return run


def phrase_counts(documents: DataFrame, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (lang, phrase, f), phrases of two and three words (lang, phrase, words, f), all of ``least`` occurrences or more, and totals (lang, n).

    A text is lower-cased (A-Z) and split at ``.,;:!?`` and line breaks into pieces, those at
    spaces and tabs into words; phrases lie within a piece.  A null language is ``und``, a null
    text empty.  Only the two columns are read; every row counts, repeated ones too.
    """
    bound_batches(documents.sparkSession)
    rows = documents.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(_count_words, "lang string, word string, k long, n long")
    every = materialise(counted.groupBy("lang", "word", "k").agg(F.sum("n").alias("f")), "words")
    words = every.where(F.col("f") >= least)
    index = materialise(rows.mapInArrow(_indexed(bloom_of(words, "k", words.count())), _INDEX), "fm-index")
    pairs = materialise(index.mapInArrow(_count_pairs, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("k"), "pairs")
    found = index.mapInArrow(_count_phrases(bloom_of(pairs, "k", pairs.count())), "lang string, phrase string, words int, n long")
    phrases = materialise(found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least), "phrases")
    return words.select("lang", F.col("word").alias("phrase"), "f"), phrases, every.groupBy("lang").agg(F.sum("f").alias("n"))


def _exact(a: Column, l: Column, r: Column) -> Column:
    """floor(1000000 a a / (l r)) in 38 digits."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))


def score(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of their lowest-scoring cut (of equals the first)."""
    named = lambda df, part, f: df.select(F.col("lang"), F.col("phrase").alias(part), F.col("f").alias(f)).hint("merge")
    word = lambda part, f: named(words, part, f)
    pair = lambda part, f: named(phrases.where("words = 2"), part, f)
    split = phrases.withColumns({"head": F.substring_index("phrase", " ", 1), "last": F.substring_index("phrase", " ", -1)})
    split = split.join(word("head", "f_head"), ["lang", "head"]).join(word("last", "f_last"), ["lang", "last"])
    two = split.where("words = 2").select("lang", "phrase", "words", "f", F.col("f_head").alias("l"), F.col("f_last").alias("r"), _exact(F.col("f"), F.col("f_head"), F.col("f_last")).alias("score"))
    three = split.where("words = 3").withColumns({"tail": F.substring_index("phrase", " ", -2), "front": F.substring_index("phrase", " ", 2)})
    three = three.join(pair("tail", "f_tail"), ["lang", "tail"]).join(pair("front", "f_front"), ["lang", "front"])
    three = three.withColumns({"s1": _exact(F.col("f"), F.col("f_head"), F.col("f_tail")), "s2": _exact(F.col("f"), F.col("f_front"), F.col("f_last"))})
    early = F.col("s1") <= F.col("s2")
    pick = lambda x, y: F.when(early, F.col(x)).otherwise(F.col(y))
    return two.union(three.select("lang", "phrase", "words", "f", pick("f_head", "f_front").alias("l"), pick("f_tail", "f_last").alias("r"), pick("s1", "s2").alias("score")))


def without_parts(scored: DataFrame) -> DataFrame:
    """``scored`` without phrases of which SHARE per cent or more stand in one longer phrase."""
    longer = scored.where("words = 3").select("lang", "f", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"))
    longest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    joined = scored.join(longest.hint("merge"), ["lang", "phrase"], "left")
    return joined.where(F.col("most").isNull() | (F.col("words") == 3) | (100 * F.col("most") < SHARE * F.col("f"))).drop("most")


def collocations(documents: DataFrame, least: int = LEAST, keep: int = KEEP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``keep`` best phrases of two or three words of each language.

    a is a phrase's count, l and r those of its parts at the lowest-scoring cut, n all words of
    the language.  Ranked by score and a, falling, then by the phrase's bytes.  Phrases are those
    of ``phrase_counts``; without any there are no rows.
    """
    words, phrases, totals = phrase_counts(documents, least, lang_col, text_col)
    found = without_parts(materialise(score(words, phrases), "scored"))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))  # so that no task ranks a whole language
    best = salted.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= keep)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= keep)
    return ranked.join(totals.hint("merge"), "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")
