"""Token-id files: texts to ids to Simple-8b segments in ascending id order, and back.

A file is Parquet that Spark writes and any Spark reader opens; each row is one self-contained
binary segment: a header, the documents it holds with their id counts, per-block offsets, the
packed words and the exceptions.  Segments of one part are numbered, know how many ids of the
part precede them, and hold about ``SEGMENT_IDS`` ids, so a reader needs one segment at a time.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import fresh_path
from . import simple8b
from .bpe import with_end, word_table
from .common import slices

SEGMENT_IDS = 1 << 20
_HEADER = struct.Struct("<4sIQQQQ")
_MAGIC = b"S8B1"


def pack_segment(doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One binary segment: documents (id, whether it is known, id count) and their ids."""
    words, starts, exceptions = simple8b.encode(ids)
    head = _HEADER.pack(_MAGIC, len(doc_ids), len(ids), len(starts), len(words), len(exceptions))
    return b"".join([head, *(np.ascontiguousarray(x, t).tobytes() for x, t in ((doc_ids, "<i8"), (known, "u1"), (counts, "<i8"), (starts, "<u4"), (words, "<u8"), (exceptions, "<u8")))])


def unpack_segment(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The inverse of ``pack_segment``."""
    magic, docs, ids, starts, words, exceptions = _HEADER.unpack_from(data)
    if magic != _MAGIC:
        raise ValueError("not a token segment")
    at, found = _HEADER.size, []
    for n, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<i8"), (starts, "<u4"), (words, "<u8"), (exceptions, "<u8")):
        found.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    doc_ids, known, counts, block_starts, packed, odd = found
    return doc_ids, known, counts, simple8b.decode(packed, block_starts, odd, ids)


def write_token_files(documents: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending id order; returns the written files as a DataFrame.

    Null texts are empty (only the end id is written); null ids come first; rows that repeat an
    id are written one after another, in the order of a hash of their text; an empty table writes no segment.  Other columns are not
    read, whatever their names.  One range shuffle, no other.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, before = TaskContext.get().partitionId(), 0, 0
        for batch in slices(batches):
            ids, bounds = with_end(*word_table(tokenizer).encode(batch.column(1)), end_id)
            key = batch.column(0)
            known = np.array(key.is_valid())
            doc = np.array(key.fill_null(0).cast(pa.int64()))
            lo = 0
            while lo < len(doc):
                hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + SEGMENT_IDS, side="right")) - 1)
                own = ids[bounds[lo] : bounds[hi]]
                payload = pack_segment(doc[lo:hi], known[lo:hi], np.diff(bounds[lo : hi + 1]), own)
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([number]), pa.array([before]), pa.array([len(own)]), pa.array([payload])], ["part", "segment", "ids_before", "n_ids", "payload"])
                number, before, lo = number + 1, before + len(own), hi

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumns({"sum": F.xxhash64("text"), "deal": F.rand(7)})
    ordered = rows.repartitionByRange("id", "sum", "deal").sortWithinPartitions("id", "sum").select("id", "text")  # so that one id's rows, null's too and rows alike in both, are cut apart
    packed = ordered.mapInArrow(segments, "part long, segment long, ids_before long, n_ids long, payload binary")
    packed.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(packed.schema).parquet(path)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only one total per part (not per segment or document) goes to the driver; a part with no
    ids before it in the order has start 0.
    """
    totals = {r.part: r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    offsets, total = {}, 0
    for part in sorted(totals):
        offsets[part], total = total, total + totals[part]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                doc_ids, known, counts, ids = unpack_segment(payload)
                ends = np.cumsum(counts)
                flat = ids.astype("<u4")
                sums = [zlib.crc32(flat[b - n : b]) for b, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=known == 0), pa.array(offsets[part] + before + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "ids_before", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(documents: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files into the shared folder and read every document's digest back from them."""
    spark: SparkSession = documents.sparkSession
    return read_token_files(write_token_files(documents, fresh_path(spark, "tokens"), tokenizer, end_id))
