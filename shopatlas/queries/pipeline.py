"""Exports, the ingest as a whole, and its streaming form."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..plans import export, ingest, storage
from ..streaming import ingest as streaming
from .book import Book, Tables
from .functions import reason_sql, wgs_sql
from .maintenance import resolved_sql
from .search import _EXPORT, FULL, _full, _parts

BOOK = Book()


@BOOK.add(f"SELECT id, round(lng, 9) AS x, round(lat, 9) AS y, name, chain_slug, category_slug, address, city FROM ({FULL}) WHERE lng IS NOT NULL")
def geojson_per_chain(t):
    """Written a folder a chain, read back line by line."""
    path = storage.fresh_path(t.spark, "features")
    export.write_geojson(_full(t), path)
    return _parts(t.spark.read.text(path).select(F.col("value").alias("feature")))


@BOOK.add(f"SELECT chain_slug, count(*) AS features, min(id) AS first_id FROM ({FULL}) WHERE lng IS NOT NULL GROUP BY 1")
def geojson_documents(t):
    """Counted from the lines of the documents; the first feature is the one without a comma."""
    lines = export.feature_collections(_full(t)).where("part = 1")
    own = F.from_json(F.ltrim("line", F.lit(",")), "id long")["id"]
    return lines.groupBy("chain_slug").agg(F.count(own).alias("features"), F.min(F.when(~F.col("line").startswith(","), own)).alias("first_id"))


_AS_GCJ = "(SELECT id, lng, lat, 'GCJ02' AS coordinate_system FROM location WHERE lng IS NOT NULL)"


@BOOK.add(f"SELECT concat('s', CAST(l.id AS STRING)) AS shop_id, round(round(w.lng, 9), 6) AS x, round(round(w.lat, 9), 6) AS y FROM location l JOIN ({wgs_sql(_AS_GCJ)}) w ON w.id = l.id")
def geojson_from_source(t):
    shops = _full(t).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("shop_id"), F.col("external_id").alias("shop_code"), "name", "address", "city", "chain_slug", "category_slug", "lng", "lat")
    p = F.from_json("feature", "geometry struct<coordinates: array<double>>")["geometry"]["coordinates"]
    return export.source_features(shops).select("shop_id", F.round(F.get(p, F.lit(0)), 6).alias("x"), F.round(F.get(p, F.lit(1)), 6).alias("y"))


@BOOK.add("SELECT name, concat('{\"id\":', id, ',\"name\":\"', name, '\",\"slug\":\"', slug, '\"}') AS json FROM category")
def categories_json(t):
    return export.json_rows(t.category, "id", "name", "slug").orderBy("name").select("name", "json")


@BOOK.add(f"SELECT slug, concat('{{\"id\":', id, ',\"slug\":\"', slug, '\",\"location_count\":', location_count, '}}') AS json FROM ({_EXPORT})")
def chains_json(t):
    totals = stats.chain_counts(t.chain, t.location, "export")
    return export.json_rows(totals, "id", "slug", "location_count").select("slug", "json")


@BOOK.add(f"SELECT concat('{{\"chains\":[', array_to_string(list(concat('\"', slug, '\"') ORDER BY slug), ','), '],\"location_count\":', sum(location_count)::BIGINT, '}}') AS json FROM ({_EXPORT})")
def manifest_json(t):
    return export.json_rows(stats.manifest(stats.chain_counts(t.chain, t.location, "export")), "chains", "location_count").select("json")


@BOOK.add("SELECT city, count(*) AS n, max(id) AS top FROM location WHERE city IS NOT NULL AND NOT (city = '上海市' AND id % 2 = 0) GROUP BY 1")
def repartition_by_city(t):
    """All cities written, then one city's partition replaced."""
    path = storage.fresh_path(t.spark, "cities")
    own = t.location.select("id", "city")
    export.write_by(own, path, "city")
    export.write_by(own.where("city = '上海市' and id % 2 = 1"), path, "city")
    return t.spark.read.parquet(path).groupBy("city").agg(F.count("*").alias("n"), F.max("id").alias("top"))


@BOOK.add("SELECT count(*) AS rows FROM location")
def snapshot_backup(t):
    return export.backup(t.location, storage.fresh_path(t.spark, "backup"))


@BOOK.add(f"SELECT chain_id, count(*) AS fetched, count(*) AS parsed, count(*) FILTER (reason IS NULL) AS upserted, count(*) FILTER (reason IS NOT NULL) AS failed, CASE WHEN count(*) FILTER (reason IS NOT NULL) = 0 THEN 'success' ELSE 'partial' END AS status FROM ({reason_sql()}) GROUP BY 1")
def run_metrics(t):
    return ingest.run_metrics(ingest.tag(t.location))


def _batches(t: Tables):
    """A stored snapshot and new records; external ids are those of the rows' own."""
    base = t.location.withColumns({"ordinal": F.col("id"), "last_seen_at": F.col("seen_at"), "created_at": F.col("seen_at"), "external_id": F.concat(F.lit("e"), F.col("id").cast("string"))})
    old = storage.materialise(ingest.to_wgs(base.where("id % 5 = 0 and lng is not null")), "stored")
    return old.select(*ingest.KEYS, *ingest.VALUES, *ingest.KEPT), base.where("id % 5 <> 0")


_WGS = f"SELECT l.id, l.chain_id, l.cust, concat('e', CAST(l.id AS STRING)) AS e, l.name, l.seen_at, r.reason, w.lng, w.lat, CASE WHEN l.id % 5 = 0 THEN -1 ELSE l.id END AS o, 0 AS run FROM location l JOIN ({reason_sql()}) r ON r.id = l.id JOIN ({wgs_sql()}) w ON w.id = l.id WHERE l.lng IS NOT NULL AND (l.id % 5 = 0 OR r.reason IS NULL)"


def _ingested_sql(pool: str) -> str:
    """The snapshot after the rows of a pool: values of an id's last record, created_at of the stored row or else of the first run's last record."""
    return f"""WITH p AS MATERIALIZED ({pool}),
b AS (SELECT p.*, r.external_id AS x FROM p JOIN ({resolved_sql('p')}) r ON r.o = p.o),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, x ORDER BY o DESC) AS rn, first_value(seen_at) OVER (PARTITION BY chain_id, x ORDER BY run, o DESC) AS born FROM b) WHERE rn = 1),
s AS (SELECT * FROM p WHERE o < 0)
SELECT coalesce(n.chain_id, s.chain_id) AS chain_id, coalesce(n.x, s.e) AS external_id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE s.name END AS name, round(CASE WHEN n.id IS NOT NULL THEN n.lng ELSE s.lng END, 6) AS lng, coalesce(s.seen_at, n.born) AS created_at
FROM n FULL JOIN s ON s.chain_id = n.chain_id AND s.e = n.x"""


def _shown(snapshot):
    return snapshot.select("chain_id", "external_id", "name", F.round("lng", 6).alias("lng"), "created_at")


@BOOK.add(_ingested_sql(_WGS))
def ingest_end_to_end(t):
    return _shown(ingest.ingest(*_batches(t)).snapshot)


_RUNS = f"""SELECT * REPLACE (CASE WHEN o < 0 THEN o ELSE (id % 2) * 1000000000 + o END AS o, CASE WHEN o < 0 THEN -1 ELSE id % 2 END AS run) FROM ({_WGS})
UNION ALL SELECT * REPLACE (2000000000 + o AS o, 2 AS run) FROM ({_WGS}) WHERE o >= 0 AND id % 7 = 0"""


@BOOK.add(_ingested_sql(_RUNS))
def stream_ingest(t):
    """The same ingest as a stream in three batches: even ids, odd ids, and every seventh record once more.

    A batch lands in as many files as its tasks write; the stream is started once for each and takes all that is new.
    """
    old, new = _batches(t)
    landed, progress = storage.fresh_path(t.spark, "landed"), storage.fresh_path(t.spark, "progress")
    store = streaming.SnapshotStore(t.spark, storage.fresh_path(t.spark, "snapshots"), buckets=16)
    store.start(old)
    for run, own in enumerate(("id % 2 = 0", "id % 2 = 1", "id % 7 = 0")):
        new.where(own).withColumn("ordinal", F.col("ordinal") + run * 1_000_000_000).write.mode("append").parquet(landed)
        query = streaming.stream_ingest(t.spark.readStream.schema(new.schema).parquet(landed), store, progress)
        query.awaitTermination()
    return _shown(store.read(query.lastProgress["batchId"] if query.lastProgress else -1))


def streamed_first_seen(t: Tables):
    landed, out = storage.fresh_path(t.spark, "landed"), storage.fresh_path(t.spark, "seen")
    rows = _full(t).select("chain_slug", "external_id")
    rows.write.parquet(landed)
    stream = streaming.first_seen_stream(t.spark.readStream.schema(rows.schema).parquet(landed), ["chain_slug", "external_id"])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.fresh_path(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out).groupBy("chain_slug").agg(F.count("*").alias("n"))
