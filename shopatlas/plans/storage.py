"""Snapshots and other tables in the folder that the cluster shares."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder.

    Only a session in one local process may do without: it gets a temporary folder.  On a
    cluster, where machines don't share such a folder, a missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if not held.isEmpty():
            path = held.get()
        elif context.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="shopatlas-")
            context.setCheckpointDir(path)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet into the shared folder and read back: a lineage cut that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
