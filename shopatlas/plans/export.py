"""Exports: GeoJSON, catalogue files, manifests and partitioned snapshots."""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators.search import feature
from . import versions
from .storage import materialise


def geojson_rows(locations: DataFrame) -> DataFrame:
    """chain_slug, id, feature of all located rows (sort by id when writing)."""
    return locations.where("lng is not null and lat is not null").select("chain_slug", "id", feature().alias("feature"))


def write_geojson(locations: DataFrame, path: str) -> None:
    """One folder a chain, a feature a line, in id order within a file."""
    rows = geojson_rows(locations).repartitionByRange("chain_slug", "id").sortWithinPartitions("chain_slug", "id")
    rows.select("chain_slug", F.col("feature").alias("value")).write.partitionBy("chain_slug").text(path)


def feature_collections(locations: DataFrame) -> DataFrame:
    """chain_slug, part, id, line: the lines of a whole FeatureCollection of each chain.

    The document of a chain is its lines in the order of part and id: a head (part 0), a feature a
    line (1, from the second on with a comma before it) and a tail (2).
    """
    return _lines(geojson_rows(locations))


def _lines(rows: DataFrame) -> DataFrame:
    """``feature_collections`` of the rows of ``geojson_rows``."""
    ends = rows.groupBy(F.col("chain_slug").alias("slug")).agg(F.min("id").alias("first"))
    ends = materialise(ends, "ends")  # a row a chain, asked for three times
    comma = F.when(F.col("id") == F.col("first"), "").otherwise(",")
    own = rows.join(ends, F.col("chain_slug").eqNullSafe(F.col("slug"))).select("chain_slug", F.lit(1).alias("part"), "id", F.concat(comma, "feature").alias("line"))
    end = lambda part, line: ends.select(F.col("slug").alias("chain_slug"), F.lit(part).alias("part"), F.lit(None).cast("long").alias("id"), F.lit(line).alias("line"))
    return own.unionAll(end(0, '{"type":"FeatureCollection","features":[')).unionAll(end(2, "]}"))


def write_collections(locations: DataFrame, path: str, mode: str = "error") -> None:
    """A folder a chain; its files one after another, in the order of their names, are the chain's document."""
    _write_lines(feature_collections(locations), path, mode)


def _write_lines(lines: DataFrame, path: str, mode: str = "error") -> None:
    order = ["chain_slug", "part", "id"]
    rows = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("chain_slug", F.col("line").alias("value")).write.mode(mode).partitionBy("chain_slug").text(path)


def write_release(locations: DataFrame, path: str) -> int:
    """Collections as a new version named by the rows' content; the number of stores.

    Rows that equal the current release's are not written again.  A reader takes the version that
    the journal names last, and a new one is named only once it is whole.  Features are made once, for
    the digest and for the files.
    """
    rows = materialise(geojson_rows(locations), "features")
    total, digest = versions.content_digest(rows)
    before = versions.current(locations.sparkSession, path)
    if before is None or (before.rows, before.digest) != (total, digest):
        versions.publish(rows, path, lambda df, folder: _write_lines(_lines(df), folder), total, digest)
    return total


def source_features(shops: DataFrame) -> DataFrame:
    """Features of source shops (shop_id, shop_code, lng, lat in GCJ-02): hashed id and WGS-84 coordinates."""
    p = geo.gcj02_to_wgs84(F.col("lng"), F.col("lat"))
    rows = shops.withColumn("p", p).withColumns({"id": text.hash31(F.col("shop_id")), "lng": F.col("p.lng"), "lat": F.col("p.lat")})
    return rows.where("lng is not null").select("shop_id", "id", feature("shop_id", "shop_code").alias("feature"))


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as a JSON object of the columns (sort when writing)."""
    return df.select(*columns, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_by(df: DataFrame, path: str, key: str) -> None:
    """Replace the partitions of ``key`` that the rows belong to; rows without it are left out."""
    df.where(F.col(key).isNotNull()).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_by_with_stats(df: DataFrame, path: str, key: str) -> DataFrame:
    """As ``write_by``; of each partition written how many rows it has and had (null: it is new)."""
    rows = materialise(df, "partitions")
    stats = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    try:
        had = df.sparkSession.read.parquet(path).groupBy(key).agg(F.count("*").alias("rows_before"))
        stats = stats.join(had.hint("merge"), key, "left")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stats = stats.withColumn("rows_before", F.lit(None).cast("long"))
    stats = materialise(stats, "partition-stats")
    write_by(rows, path, key)
    return stats


def backup(df: DataFrame, path: str) -> DataFrame:
    """A snapshot of the rows in a folder of its own; returns its one-row count."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"))
