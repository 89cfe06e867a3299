"""Tables of which readers see whole versions: a folder a version, and a journal that names them."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

JOURNAL = "number long, folder string, rows long, digest string"


def content_digest(df: DataFrame) -> tuple[int, str]:
    """Number of rows and a digest of the rows in any order: two 64-bit sums of row hashes."""
    sums = [F.sum(F.xxhash64(*df.columns, F.lit(seed)).cast("decimal(20,0)")) for seed in ("a", "b")]
    n, *found = df.agg(F.count("*"), *sums).first()
    return n, "".join(f"{int(x or 0) % 2**64:016x}" for x in found)


def current(spark: SparkSession, path: str) -> Row | None:
    """The newest version (number, folder, rows, digest), read once; None before the first."""
    try:
        return spark.read.schema(JOURNAL).json(f"{path}/journal").orderBy(F.desc("number")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def publish(df: DataFrame, path: str, write, rows: int | None = None, digest: str | None = None) -> Row:
    """Write ``df`` by ``write(df, folder)`` into a new folder, then add it to the journal; one writer at a time.

    The journal is only added to, one small file a version, after the folder is whole.  A reader
    of an older version keeps its folder; a writer that fails leaves a folder that nothing names.
    """
    spark = df.sparkSession
    before = current(spark, path)
    number = before.number + 1 if before else 0
    folder = f"version-{number:06d}-{digest or uuid.uuid4().hex}"
    write(df, f"{path}/{folder}")
    spark.createDataFrame([(number, folder, rows, digest)], JOURNAL).coalesce(1).write.mode("append").json(f"{path}/journal")
    return current(spark, path)
