"""The whole ingest: canonical records to snapshot, quarantine and run metrics, in one plan."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, scope
from ..operators import canonical, upsert
from .storage import materialise

KEYS = ["chain_id", "external_id"]
VALUES = ["name", "address", "province", "city", "district", "lng", "lat", "coordinate_system", "last_seen_at"]
KEPT = ["created_at"]


@dataclass
class Ingested:
    snapshot: DataFrame
    quarantine: DataFrame
    metrics: DataFrame


def tag(records: DataFrame) -> DataFrame:
    """Adds ``reason``: why a record is invalid, null for valid ones."""
    c = {k: F.col(k) for k in ("external_id", "name", "address", "province", "city", "district", "lng", "lat")}
    return records.withColumn("reason", scope.invalid_reason(c["external_id"], c["name"], c["address"], c["province"], c["city"], c["district"], c["lng"], c["lat"]))


def to_wgs(records: DataFrame) -> DataFrame:
    return geo.with_wgs84(records)


def run_metrics(tagged: DataFrame) -> DataFrame:
    """Per chain: fetched, parsed, upserted, failed, and status (success, or partial with failures)."""
    out = tagged.groupBy("chain_id").agg(F.count("*").alias("fetched"), F.count("*").alias("parsed"), F.count_if(F.col("reason").isNull()).alias("upserted"), F.count_if(F.col("reason").isNotNull()).alias("failed"))
    return out.withColumn("status", F.when(F.col("failed") == 0, "success").otherwise("partial"))


def ingest(snapshot: DataFrame, records: DataFrame, store_name: str | None = None) -> Ingested:
    """Validate, convert, resolve ids and upsert a batch.

    ``snapshot`` has KEYS, VALUES and KEPT; ``records`` those (coordinates in their own system) and an
    ``ordinal``.  ``store_name`` names a column of both that holds the normalised names; it is kept
    in the snapshot like a value.  The tagged batch and its converted rows are written once each, for several readers.
    """
    tagged = materialise(tag(records), "batch")
    valid = materialise(to_wgs(tagged.where("reason is null")), "converted")
    named = canonical.canonical_ids(snapshot, valid, store_name=store_name)
    out = upsert.upsert(snapshot, named, KEYS, [*VALUES, store_name] if store_name else VALUES, KEPT)
    return Ingested(out, tagged.where("reason is not null"), run_metrics(tagged))
