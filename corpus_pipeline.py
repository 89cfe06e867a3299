"""The corpus pipeline: language ID, exact dedup, near dedup, secret scan, packing.

Every stage works on all that its predecessor kept and is written as Parquet and read again
before the next one.  The first four return the columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopatlas.llm import exact_dedup, jaccard, langid, packing, secrets
from shopatlas.llm.common import bloom_of, free_name, in_bloom, materialise
from shopatlas.llm.queries import tokenizer_path

LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts without letters and undecided ones go."""
    return langid.keep_identified(docs, langid.fit(docs), LEAST_SCORE)


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a digest of the text; the digest's column has a name that no other has."""
    name = free_name(docs, "_sha")
    return docs.withColumn(name, F.sha2(F.coalesce("text", F.lit("")), 256)), name


def _settle(docs: DataFrame, sha: str, marks: DataFrame) -> DataFrame:
    """One row of each group that has several; rows outside such groups all stay.

    ``marks`` (group, doc_id, sha, first, n) holds id and digest of all rows in groups, ``n`` alike in
    both; the one with the smallest ``first`` stays, and of n rows alike the first by a hash of all
    columns.  A bit map of the digests keeps rows that stand alone out of the join.
    """
    columns = [c for c in docs.columns if c != sha]
    best = marks.groupBy("group").agg(F.min("first").alias("best"), F.sum("n").alias("rows")).where("rows > 1")
    several = materialise(marks.join(best.hint("merge"), "group").select("doc_id", "sha", F.when(F.col("first") == F.col("best"), F.col("n")).alias("n")), "grouped")
    keys = several.select(F.xxhash64("sha").alias("k")).distinct()
    bloom, key = bloom_of(keys, "k", keys.count()), free_name(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64(sha))
    alone = keyed.mapInArrow(in_bloom(bloom, False, key), keyed.schema).select(*columns)
    near = keyed.mapInArrow(in_bloom(bloom, True, key), keyed.schema)
    wanted, (i, t, n, row) = several, (free_name(docs, f"_{c}") for c in ("i", "t", "n", "row"))
    wanted = wanted.select(F.col("doc_id").alias(i), F.col("sha").alias(t), F.coalesce("n", F.lit(0)).alias(n))
    joined = near.join(wanted.hint("merge"), (F.col(sha) == F.col(t)) & F.col("doc_id").eqNullSafe(F.col(i)), "left")
    once = joined.where(F.col(n).isNull() | (F.col(n) == 1)).select(*columns)
    first = joined.where(F.col(n) > 1).groupBy(i, t).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row))
    return alone.union(once).union(first.select(f"{row}.*"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: that with the largest doc_id; of rows that share it too, one."""
    rows, sha = _named(docs)
    found = exact_dedup.exact_dedup(rows, carry=(sha,)).where("group_size > 1")
    marks = found.groupBy(F.col("text_sha256").alias("group"), "doc_id", F.col(sha).alias("sha"), "kept").agg(F.count("*").alias("n"))
    return _settle(rows, sha, marks.select("group", "doc_id", "sha", F.struct(~F.col("kept"), "sha", "doc_id").alias("first"), "n"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id; texts without words stay."""
    rows, sha = _named(docs)
    linked = materialise(jaccard.linked_rows(rows, carry=(sha,)), "linked").where("root is not null")
    marks = linked.groupBy(F.col("root").alias("group"), "doc_id", F.col(sha).alias("sha")).agg(F.count("*").alias("n"))
    return _settle(rows, sha, marks.select("group", "doc_id", "sha", F.struct(F.col("doc_id").isNull(), "doc_id", "sha").alias("first"), "n"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in them are replaced by a mark and n_chars follows the text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in packed sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
