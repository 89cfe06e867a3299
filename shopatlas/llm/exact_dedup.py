"""Exact deduplication by content-defined chunk recipes.

A text becomes an ordered list of chunk identifiers (its recipe); only digests move between
tasks, never texts.  Chunk edges depend on the 32 bytes before them, so equal stretches of long
documents get equal chunks.  A chunk's 64-bit identifier is verified against SHA-256 and length
of every chunk that bears it; should two different chunks ever share one, SHA-256 takes its place.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import SpanHasher, arrow_batches, hot_keys, lower_ascii, materialise, salted_join, text_bytes

WINDOW, MEAN_CHUNK, LONGEST_CHUNK = 32, 4096, 65536


def chunk_edges(data: np.ndarray, offsets: np.ndarray, hashed: SpanHasher | None = None) -> np.ndarray:
    """Sorted chunk starts of all texts in the buffer; every non-empty text starts one."""
    hashed = hashed or SpanHasher(data)
    starts = offsets[:-1][np.diff(offsets) > 0]
    if len(data) > WINDOW:
        hot = WINDOW + np.flatnonzero(hashed.windows(WINDOW)[:-1] % np.uint64(MEAN_CHUNK) == 0)
        own = np.searchsorted(offsets, hot, side="right") - 1
        edges = np.union1d(starts, hot[hot - offsets[own] >= WINDOW])
    else:
        edges = starts
    gap = np.diff(np.append(edges, len(data)))
    extra = np.maximum(gap - 1, 0) // LONGEST_CHUNK
    if extra.any():
        k = np.repeat(np.cumsum(extra) - extra, extra)
        edges = np.sort(np.concatenate([edges, np.repeat(edges, extra) + (np.arange(int(extra.sum())) - k + 1) * LONGEST_CHUNK]))
    return edges


_CHUNKS = ArrayType(StructType([StructField("weak", LongType()), StructField("length", LongType()), StructField("strong", BinaryType())]))
_CHUNK = pa.struct([("weak", pa.int64()), ("length", pa.int64()), ("strong", pa.binary())])


def _recipes(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column(1))
    low = lower_ascii(data)
    hashed = SpanHasher(low)
    edges = chunk_edges(low, offsets, hashed)
    ends = np.append(edges[1:], len(low)).astype(np.int64)
    raw = low.tobytes()
    strong = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edges.tolist(), ends.tolist(), strict=True)]
    chunks = pa.StructArray.from_arrays([pa.array(hashed.spans(edges, ends).view(np.int64)), pa.array(ends - edges), pa.array(strong, pa.binary())], fields=list(_CHUNK))
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(edges, offsets).astype(np.int32)), chunks)
    whole = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], lists, pa.array(whole, pa.string())], ["doc_id", *batch.schema.names[2:], "chunks", "text_sha256"])


def exact_dedup(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``documents``: doc_id, the ``carry`` columns, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  Of equal texts the
    largest id stays.  Rows that repeat both id and text have the same answer (each counts in
    group_size); a null id stays only in a group that has no other.  An empty table gives no row;
    other columns are not read.  Only groups of two or more are joined back, and the largest of
    them are dealt over many keys of that join.
    """
    own = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry)
    shape = StructType([*(f for f in own.schema if f.name != "text"), StructField("chunks", _CHUNKS), StructField("text_sha256", StringType())])
    recipes = materialise(own.mapInArrow(arrow_batches(_recipes), shape), "recipes")
    chunk = recipes.select(F.explode("chunks").alias("c")).select("c.*")
    clash = chunk.groupBy("weak").agg(F.min("strong").alias("a"), F.max("strong").alias("b"), F.min("length").alias("m"), F.max("length").alias("n")).where("a <> b or m <> n")
    part = "weak" if clash.isEmpty() else "strong"
    listed = recipes.select("doc_id", *carry, "text_sha256", F.col(f"chunks.{part}").alias("recipe"))
    groups = materialise(listed.groupBy("recipe").agg(F.max("doc_id").alias("top"), F.count("*").alias("rows")).where("rows > 1"), "groups")
    joined = salted_join(listed, groups, "recipe", hot_keys(groups, "recipe", "rows"))
    keep_id = F.when(F.col("rows").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return joined.withColumn("keep_id", keep_id).select("doc_id", *carry, "keep_id", F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")
