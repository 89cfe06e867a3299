"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, in Arrow.

A task takes texts in slices.  Of a slice, the ids of both tokenizers are lists by document, whose
flat values, parent indices and segmented sums give every token's document and end.  One Acero
join on (document, end) keys finds all ends: between two of them exactly one token of each side
lies, which is a link, and an end of both sides closes a group.  ``Table.group_by`` counts the
pairs of a document and of a slice; Spark sums the slices' counts over the corpus and hands each
slice the totals of its own pairs.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordTable, word_table
from .common import bound_batches, materialise, slices, text_bytes
from .pieces import SPACE, PieceModel

SLICE_TEXT = 1 << 20
DOC_BITS = 40  # of a (document, end) key, below the document's number in its slice: ends of up to a terabyte


class LibraryPieces(WordTable):
    """Ids of words as the SentencePiece library gives them.

    No piece holds a space mark after another character, so what lies between runs of spaces is
    merged on its own.
    """

    def load(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = PieceModel(path)  # refuses models that change texts
        if any(SPACE in p.lstrip(SPACE) for p in self.model.scores):
            raise ValueError("only models whose pieces keep to words can be used")
        self.library = SentencePieceProcessor(model_file=path)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        found = self.library.encode([w[1:].decode() for w in words], num_threads=1)  # the library puts the first space back
        return [ids if w != b" " else [self.library.piece_to_id(SPACE)] for w, ids in zip(words, found, strict=True)]

    def encode_whole(self, text: str) -> list[int]:
        return self.library.encode(text[1:])

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = data == 32
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut), data == 0


_tables: dict[str, LibraryPieces] = {}


def library_pieces(path: str) -> LibraryPieces:
    """The worker's table for a model file."""
    if path not in _tables:
        _tables[path] = LibraryPieces(path)
    return _tables[path]


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_entries: dict[str, pa.Array] = {}


def byte_entries(path: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary; special tokens stand for nothing."""
    if path not in _entries:
        tokenizer, to_byte = word_table(path).tokenizer, byte_characters()
        special = {i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        by_id = {i: s for s, i in tokenizer.get_vocab().items()}
        _entries[path] = pa.array([b"" if i in special or i not in by_id else bytes(to_byte[c] for c in by_id[i]) for i in range(max(by_id) + 1)], pa.large_binary())
    return _entries[path]


def piece_entries(path: str) -> pa.Array:
    """The bytes of each id of a SentencePiece model."""
    if path not in _entries:
        model = library_pieces(path).model
        ends = model.start + model.size
        _entries[path] = pa.array([model.flat[a:b].tobytes() for a, b in zip(model.start.tolist(), ends.tolist(), strict=True)], pa.large_binary())
    return _entries[path]


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(ids.astype(np.int32)))


def faithful(lists: pa.Array, entries: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each document, whether its tokens' bytes are its text's."""
    joined = entries.take(lists.values)
    bounds = joined.offsets.to_numpy() if hasattr(joined, "offsets") else np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, 8 * joined.offset)
    raw = joined.buffers()[2]
    made = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    ends = (bounds - bounds[0])[lists.offsets.to_numpy()]
    if len(made) == len(data) and np.array_equal(ends, offsets) and np.array_equal(made, data):
        return np.ones(len(lists), bool)
    return np.array([np.array_equal(made[a:b], data[c:d]) for a, b, c, d in zip(ends[:-1], ends[1:], offsets[:-1], offsets[1:], strict=True)], bool)


def token_ends(lists: pa.Array, entries: pa.Array, name: str) -> pa.Table:
    """key (document and end of each token in it) and the token's place among all of the slice."""
    parent = pc.list_parent_indices(lists)
    size = pc.binary_length(entries).take(pc.list_flatten(lists)).cast(pa.int64())
    total = pc.cumulative_sum(size)
    first = lists.offsets.to_numpy()[:-1]
    before = np.concatenate([[0], total.to_numpy()])[first]  # bytes before each document
    end = pc.subtract(total, pa.array(before).take(parent))
    key = pc.add(pc.shift_left(parent.cast(pa.int64()), pa.scalar(DOC_BITS, pa.int64())), end)
    return pa.table({"key": key, name: pa.array(np.arange(len(key)), pa.int64())})


def align(a: pa.Array, b: pa.Array, a_entries: pa.Array, b_entries: pa.Array) -> pa.Table:
    """Links in text order: doc, a and b (places of the tokens), and whether the link's end closes a group.

    Both lists hold tokens of the same bytes, document by document.
    """
    left, right = token_ends(a, a_entries, "a"), token_ends(b, b_entries, "b")
    joined = left.join(right, keys="key", join_type="full outer", use_threads=False).combine_chunks().sort_by("key")
    joined = joined.combine_chunks()
    at_a, at_b = joined.column("a").combine_chunks(), joined.column("b").combine_chunks()
    closes = pc.and_(pc.is_valid(at_a), pc.is_valid(at_b))
    doc = pc.shift_right(joined.column("key"), pa.scalar(DOC_BITS, pa.int64()))
    # a token covers what lies before its end: the next end of its own side
    return pa.table({"doc": doc, "a": pc.fill_null_backward(at_a), "b": pc.fill_null_backward(at_b), "closes": closes})


def group_strings(a: pa.Array, b: pa.Array, links: pa.Table, n: int) -> list[str]:
    """a1,a2|b1;a3|b2,b3 of each document."""
    closing = links.filter(links.column("closes"))
    sides = []
    for lists, name in ((a, "a"), (b, "b")):
        ends = np.concatenate([[0], closing.column(name).to_numpy() + 1])
        words = lists.values.cast(pa.string())
        sides.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), ","))
    groups = pc.binary_join_element_wise(*sides, "|")
    bounds = np.searchsorted(closing.column("doc").to_numpy(), np.arange(n + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), groups), ";").to_pylist()


def without(lists: pa.Array, gone: np.ndarray) -> pa.Array:
    """``lists`` with those of the marked documents emptied."""
    bounds = lists.offsets.to_numpy()
    size = np.diff(bounds)
    ids = lists.values.to_numpy()[np.repeat(~gone, size)]
    return _lists(ids, np.concatenate([[0], np.cumsum(np.where(gone, 0, size))]))


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed bytes of equally long or different arrays of integers below 2**31."""
    sizes = np.array([len(arrays), *map(len, arrays)], "<i4")
    return zlib.compress(b"".join([sizes.tobytes(), *(np.ascontiguousarray(a, "<i4").tobytes() for a in arrays)]), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    """The inverse of ``pack``."""
    flat = np.frombuffer(zlib.decompress(data), "<i4")
    ends = int(flat[0]) + 1 + np.cumsum(flat[1 : 1 + flat[0]], dtype=np.int64)
    return np.split(flat, [int(flat[0]) + 1, *ends[:-1].tolist()])[1:] if flat[0] else []


_SLICE = "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, pair array<long>, times array<long>, links binary"


def _aligned(a_path: str, b_path: str, keep_groups: bool):
    """``mapInArrow`` function: (doc_id, text) to a row a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, names = TaskContext.get().partitionId() << 32, [c.split(" ")[0] for c in _SLICE.split(", ")]
        for number, batch in enumerate(slices(batches, most=SLICE_TEXT)):
            n = batch.num_rows
            data, offsets = text_bytes(batch.column(1))
            some = np.diff(offsets) > 0
            data, offsets = np.insert(data, offsets[:-1][some], 32), offsets + np.concatenate([[0], np.cumsum(some)])  # the space in front
            sides, gone = [], ~some
            for table, entries in ((word_table(a_path), byte_entries(a_path)), (library_pieces(b_path), piece_entries(b_path))):
                lists = _lists(*(table.encode_bytes(data, offsets) if len(data) else (np.zeros(0, np.uint32), offsets)))
                gone = gone | ~faithful(lists, entries, data, offsets)
                sides.append(lists)
            if gone.any():
                sides = [without(x, gone) for x in sides]
            a, b = sides
            links = align(a, b, byte_entries(a_path), piece_entries(b_path))
            told = group_strings(a, b, links, n)
            pair = pc.add(pc.shift_left(b.values.take(links.column("b")).cast(pa.int64()), pa.scalar(32, pa.int64())), a.values.take(links.column("a")).cast(pa.int64()))
            own = pa.table({"doc": links.column("doc"), "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
            whole = own.group_by("pair", use_threads=False).aggregate([("count_all", "sum")])
            pairs = whole.column("pair").combine_chunks()
            at = pc.index_in(own.column("pair"), value_set=pairs).to_numpy()
            per = lambda t: np.bincount(t.column("doc").to_numpy(), minlength=n)
            counts = [np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy()), per(links.filter(links.column("closes"))), per(links)]
            groups = told if keep_groups else [hashlib.sha256(s.encode()).hexdigest() if k else "" for s, k in zip(told, counts[0].tolist(), strict=True)]
            row = [[first + number], [batch.column(0).to_pylist()], *([c.tolist()] for c in counts), [groups], [pairs.to_pylist()], [whole.column("count_all_sum").to_pylist()], [pack(np.searchsorted(own.column("doc").to_numpy(), np.arange(n + 1)), at, own.column("count_all").to_numpy())]]
            kinds = [pa.int64(), *(pa.list_(pa.int64()),) * 5, pa.list_(pa.string()), *(pa.list_(pa.int64()),) * 2, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names)

    return run


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mapInArrow`` function: slices with their pairs' totals to a row a document."""
    for batch in batches:
        for k in range(batch.num_rows):
            docs, *counts, groups, links, totals, best = (batch.column(c)[k] for c in range(9))
            bounds, at, times = (x.astype(np.int64) for x in unpack(links.as_py()))
            total, high = totals.values.to_numpy(), best.values.to_numpy(zero_copy_only=False)
            sums = [np.concatenate([[0], np.cumsum(x)])[bounds] for x in (times * high[at], times * total[at])]
            yield pa.RecordBatch.from_arrays([docs.values, *(c.values for c in counts), *(pa.array(np.diff(s), pa.int64()) for s in sums), groups.values], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align_documents(documents: DataFrame, a_path: str, b_path: str, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of each row of ``documents``.

    Both tokenizers read a space and the text: ``a_path`` is a byte-level vocabulary of the
    tokenizers library, ``b_path`` a SentencePiece model (which adds the space itself).  Tokens of
    both that end at one byte close a group; two tokens are linked when their bytes overlap.  A
    pair of ids counts its links in all documents: ``count_sum`` adds that up over a document's
    links, ``n_best`` counts links whose pair no other pair of the same b id exceeds.  ``groups`` is
    ``a1,a2|b1;a3|b2,b3`` or its SHA-256 in hex.

    Texts that are null or empty, and texts that a tokenizer does not give back byte by byte (such
    as those with U+2581), have no tokens: zeros and an empty string.  Null and repeated ids pass
    through, each row on its own; other columns are not read.  A text stands in one task whole.
    """
    spark = documents.sparkSession
    bound_batches(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    done = materialise(rows.mapInArrow(_aligned(a_path, b_path, keep_groups), _SLICE), "aligned")
    each = done.select("slice", F.posexplode(F.arrays_zip("pair", "times")).alias("pos", "p")).select("slice", "pos", "p.pair", "p.times")
    totals = materialise(each.groupBy("pair").agg(F.sum("times").alias("total")), "pair-totals")
    best = totals.groupBy(F.shiftright("pair", 32).alias("b")).agg(F.max("total").alias("top"))
    known = totals.withColumn("b", F.shiftright("pair", 32)).join(best.hint("merge"), "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    told = each.select("slice", "pos", "pair").join(known.hint("merge"), "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("pos", "total", "best"))).alias("t"))
    told = told.select("slice", F.col("t.total").alias("totals"), F.transform("t", lambda t: t.best.cast("int")).alias("best"))
    none = F.expr("cast(array() as array<long>)")
    scored = done.join(told.hint("merge"), "slice", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", F.coalesce("totals", none).alias("totals"), F.coalesce("best", F.expr("cast(array() as array<int>)")).alias("best"))
    return scored.mapInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
