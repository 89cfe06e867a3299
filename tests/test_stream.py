"""The bucketed snapshot of the streamed ingest against batch after batch over a plain one."""
import os

import pytest
from pyspark.sql import functions as F

from shopatlas.plans import ingest
from shopatlas.plans.storage import materialise
from shopatlas.streaming.ingest import SnapshotStore, stream_ingest

SHAPE = "chain_id int, external_id string, name string, address string, province string, city string, district string, lng double, lat double, coordinate_system string, last_seen_at string, created_at string"
METRE = 1 / 111195.0


def row(e, name, metres, seen, chain=1):
    return (chain, e, name, "Road 1", "广东省", "广州市", "天河区", 113.3, 23.1 + metres * METRE, "WGS84", seen, seen)


def batches(spark):
    stored = [row(f"s{k}", f"Shop {k}", 0, "day 0", 1 + k % 3) for k in range(60)]
    days = [
        [row("n0", "Shop 0", 40, "day 1"), row("n1", "Fresh", 0, "day 1")],
        [row("n2", "Shop 0", 80, "day 2"), row("s3", "Renamed", 0, "day 2"), row("bad", "", 0, "day 2")],
        [row("n0", "Shop 0", 40, "day 1"), row("n1", "Fresh", 0, "day 1")],  # late, and seen before
        [row("n3", "Renamed", 30, "day 4"), row("s3", "Shop 3", 0, "day 4"), row("n4", "Shop 3", 20, "day 4")],
        [row("n1", "Fresh", 500, "day 5"), row("n5", "Fresh", 520, "day 5")],
    ]
    new = [[(*r, 100 * k + j) for j, r in enumerate(rows)] for k, rows in enumerate(days)]
    return spark.createDataFrame(stored, SHAPE), [spark.createDataFrame(rows, SHAPE + ", ordinal long") for rows in new]


def shown(df):
    return sorted((tuple(r) for r in df.select("chain_id", "external_id", "name", F.round("lat", 7), "last_seen_at", "created_at").collect()), key=repr)


def files(path):
    return [os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")]


def test_five_batches_and_a_restart_equal_plain_ingests(spark, tmp_path, monkeypatch):
    stored, days = batches(spark)
    plain = stored
    for day in days:
        plain = materialise(ingest.ingest(plain, day).snapshot, "plain")
    landed, progress, store = str(tmp_path / "landed"), str(tmp_path / "progress"), SnapshotStore(spark, str(tmp_path / "store"), buckets=32)
    store.start(stored)
    whole = len(files(tmp_path / "store"))
    publish, failed = SnapshotStore._publish, []

    def once(self, batch_id, versions):
        if batch_id == 2 and not failed:
            failed.append(batch_id)
            raise OSError("lost before the manifest")
        publish(self, batch_id, versions)

    monkeypatch.setattr(SnapshotStore, "_publish", once)
    stream = lambda: stream_ingest(spark.readStream.schema(days[0].schema).option("maxFilesPerTrigger", 1).parquet(landed), store, progress)
    for day in days:
        day.coalesce(1).write.mode("append").parquet(landed)
    with pytest.raises(Exception, match="lost before the manifest"):
        stream().awaitTermination()
    assert failed == [2]
    stream().awaitTermination()
    assert shown(store.read(4)) == shown(plain)
    written = [len([f for f in files(tmp_path / "store") if f"rows-{k + 1:09d}" in f]) for k in range(5)]
    assert all(0 < n <= 6 for n in written) and whole > 40
    with pytest.raises(ValueError, match="never written"):
        store.read(17)


def test_a_hot_bucket_is_dealt_over_tasks(spark, tmp_path):
    n, aqe = 20_000, "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    stored, days = batches(spark)
    many = spark.range(0, n, 1, 8).select(F.lit(1).alias("chain_id"), F.format_string("m%d", "id").alias("external_id"), F.lit("Many").alias("name"), *(F.lit(v).alias(c) for c, v in (("address", "Road 1"), ("province", "广东省"), ("city", "广州市"), ("district", "天河区"))), (113.0 + F.col("id") / 1000).alias("lng"), F.lit(23.1).alias("lat"), F.lit("WGS84").alias("coordinate_system"), F.lit("day 0").alias("last_seen_at"), F.lit("day 0").alias("created_at"))
    store = SnapshotStore(spark, str(tmp_path / "store"), buckets=1)
    before = spark.conf.get(aqe)
    spark.conf.set(aqe, "16k")
    try:
        store.start(stored.unionByName(many))
    finally:
        spark.conf.set(aqe, before)
    assert len(files(tmp_path / "store" / "rows-000000000")) > 2  # one bucket, several tasks
    assert store.read(-1).count() == n + 60 and store.read(-1).columns == store.columns
    store.apply(days[0], 0)
    assert shown(store.read(0)) == shown(materialise(ingest.ingest(stored.unionByName(many), days[0]).snapshot, "plain"))
