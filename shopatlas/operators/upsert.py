"""Table maintenance as full-outer joins of a snapshot with a batch (plain Parquet has no MERGE)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import versions
from ..plans.storage import materialise
from .stats import last_wins


def upsert(snapshot: DataFrame, batch: DataFrame, keys: list[str], values: list[str], kept: list[str], order: str = "ordinal") -> DataFrame:
    """Snapshot after the batch: all ``values`` of a known key are overwritten, ``kept`` columns stay.

    Of rows of the batch with one key the last by ``order`` counts.  New keys take ``kept`` from the
    batch.  Keys must not be null.
    """
    new = last_wins(batch, keys, [order]).select(*keys, *(F.col(c).alias(f"new_{c}") for c in (*values, *kept)), F.lit(True).alias("_new"))
    old = snapshot.select(*keys, *values, *kept, F.lit(True).alias("_old"))
    both = old.join(new.hint("merge"), keys, "full_outer")
    return both.select(
        *keys,
        *(F.when(F.col("_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in values),
        *(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"new_{c}")).alias(c) for c in kept),
    )


def seed_upsert(existing: DataFrame, seeds: DataFrame, key: str = "slug", changed: tuple[str, ...] = ("category_id",)) -> DataFrame:
    """Missing rows are added; of known ones only the ``changed`` columns follow the seeds."""
    rest = [c for c in existing.columns if c != key]
    fresh = seeds.select(key, *(F.col(c).alias(f"seed_{c}") for c in rest), F.lit(True).alias("_seed"))
    both = existing.withColumn("_old", F.lit(True)).join(fresh, key, "full_outer")
    pick = lambda c: F.when(F.col("_seed") & (F.lit(c in changed) | F.col("_old").isNull()), F.col(f"seed_{c}")).otherwise(F.col(c))
    return both.select(key, *(pick(c).alias(c) for c in rest))


def rename_value(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Rename a value, and add a row for it if neither was there (other columns null)."""
    renamed = df.withColumn(column, F.when(F.col(column) == old, new).otherwise(F.col(column)))
    there = renamed.agg(F.max(F.col(column).eqNullSafe(new)).alias("there"))
    missing = there.where("not coalesce(there, false)").select(F.lit(new).alias(column))
    return renamed.unionByName(missing, allowMissingColumns=True)


def delete_where(df: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Rows that stay (the condition is false or null), and the deleted count as one row."""
    hit = F.coalesce(condition, F.lit(False))
    return df.where(~hit), df.where(hit).agg(F.count("*").alias("deleted"))


def chain_row_upsert(chains: DataFrame, refreshed: DataFrame) -> DataFrame:
    """Chain rows (id, slug, location_count) after a refresh: counts replaced, new slugs numbered on.

    ``chains`` is a dimension of a few dozen rows.
    """
    both = chains.join(refreshed.select("slug", F.col("location_count").alias("new_count")), "slug", "full_outer")
    top = chains.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    added = F.row_number().over(W.partitionBy(F.col("id").isNull()).orderBy("slug"))
    return both.crossJoin(F.broadcast(top)).select(F.coalesce(F.col("id"), F.col("top") + added).alias("id"), "slug", F.coalesce("new_count", "location_count").alias("location_count"))


def added_ids(before: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return batch.select(key).distinct().join(before.select(key).distinct().hint("merge"), key, "left_anti").agg(F.count("*").alias("added"))


def copy_with_skips(rows: DataFrame, chains: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their target chain id, and per unknown slug how many are skipped."""
    ids = chains.select(F.col("slug").alias("chain_slug"), F.col("id").alias("target_chain_id"))
    skipped = rows.join(ids, "chain_slug", "left_anti").groupBy("chain_slug").agg(F.count("*").alias("skipped"))
    return rows.join(ids, "chain_slug"), skipped


def truncate_and_load(rows: DataFrame, chains: DataFrame, path: str) -> DataFrame:
    """Replace the table at ``path`` by the rows of known chains; per unknown slug how many were skipped.

    The new table is a version of its own that takes the old one's place when it is whole, so ``rows``
    may be read from it, and a load that fails leaves it as it was.
    """
    known, skipped = copy_with_skips(rows, chains)
    report = materialise(skipped, "skipped")
    versions.publish(known, path, lambda df, folder: df.write.parquet(folder))
    return report


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    """The table that was loaded last."""
    held = versions.current(spark, path)
    if held is None:
        raise ValueError(f"nothing was loaded into {path}")
    return spark.read.parquet(f"{path}/{held.folder}")
