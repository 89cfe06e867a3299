"""Releases, loads and database tables that readers see whole or not at all."""
import uuid

import pytest
from pyspark.sql import functions as F

from shopatlas.operators import tiling, upsert
from shopatlas.plans import export, versions
from shopatlas.sources import readers, relational

DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
STORE = "id long, name string, address string, city string, chain_slug string, category_slug string, lng double, lat double"


def stores(spark, name, n=6):
    return spark.createDataFrame([(k, name, "a", "c", f"chain {k % 2}", "g", 110.0, 30.0) for k in range(n)], STORE)


def names(df):
    return {r.name for r in df.collect()}


def test_releases_of_equal_size_and_a_reader_between_them(spark, tmp_path):
    path = str(tmp_path / "releases")
    with pytest.raises(ValueError, match="no release"):
        readers.read_release(spark, path)
    assert export.write_release(stores(spark, "old"), path) == 6
    reader = readers.read_release(spark, path)
    assert export.write_release(stores(spark, "new"), path) == 6
    assert names(reader) == {"old"}  # its folder is still there
    assert names(readers.read_release(spark, path)) == {"new"}
    before = versions.current(spark, path)
    export.write_release(stores(spark, "new").repartition(3), path)  # the same rows: no new release
    assert versions.current(spark, path) == before
    export.write_release(stores(spark, "old"), path)
    assert names(readers.read_release(spark, path)) == {"old"}


def failing(df):
    return df.withColumn("name", F.when(F.col("id") == 5, F.raise_error(F.lit("half-way")).cast("string")).otherwise(F.col("name")))


def test_a_load_that_fails_leaves_the_former_table(spark, tmp_path):
    path, chains = str(tmp_path / "table"), spark.createDataFrame([(1, "chain 0"), (2, "chain 1")], "id int, slug string")
    with pytest.raises(ValueError, match="nothing was loaded"):
        upsert.read_loaded(spark, path)
    upsert.truncate_and_load(stores(spark, "one"), chains, path)
    with pytest.raises(Exception, match="half-way"):
        upsert.truncate_and_load(failing(stores(spark, "two")).repartition(3), chains, path)
    assert names(upsert.read_loaded(spark, path)) == {"one"}
    again = upsert.read_loaded(spark, path).withColumn("name", F.lit("three")).select(*stores(spark, "x").columns)
    upsert.truncate_and_load(again, chains, path)  # from the table itself
    assert names(upsert.read_loaded(spark, path)) == {"three"}


def test_a_database_load_that_fails_leaves_the_former_table(spark):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = stores(spark, "one", 1300).select("id", "name", "lng")
    assert relational.load_table(rows, url, "stores", **DERBY) == 1300
    with pytest.raises(Exception, match="half-way"):
        relational.load_table(failing(stores(spark, "two")).select("id", "name", "lng").repartition(3), url, "stores", **DERBY)
    found = relational.scan_table(spark, url, "stores", "id", 4, **DERBY)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in rows.collect())
    assert relational.load_table(stores(spark, "three", 3).select("id", "name", "lng"), url, "stores", **DERBY) == 3
    assert names(relational.scan_table(spark, url, "stores", "id", 4, **DERBY)) == {"three"}
    relational.load_table(rows.limit(0), url, "stores", **DERBY)
    assert relational.scan_table(spark, url, "stores", "id", 4, **DERBY).count() == 0


def test_cities_by_list_stores_and_chinese_order(spark):
    centres = spark.createDataFrame([("上海", 121.0, 31.0), ("北京", 116.0, 40.0), ("广州", 113.0, 23.0), ("成都", 104.0, 30.0), ("杭州", 120.0, 30.0)], "city string, lng double, lat double")
    points = spark.createDataFrame([(104.01, 30.0), (104.0, 30.1), (120.0, 30.0), (120.3, 30.0), (120.3, 30.0)], "lng double, lat double")
    found = {r.city: (r.place, r.stores) for r in tiling.city_order(centres, points, ["杭州"], []).collect()}
    assert found == {"杭州": (1, 1), "成都": (2, 2), "北京": (3, 0), "广州": (4, 0), "上海": (5, 0)}


def test_embedded_objects_from_sql(spark):
    readers.register_embedded_json(spark)
    pages = spark.createDataFrame([(1, "x data_json:'{\"a\": {\"b\": 1}}' data_json:'{}'"), (2, None), (3, "none")], "id int, html string")
    found = spark.sql("SELECT p.id, o.pos, o.json FROM {p} p, LATERAL embedded_json(p.html, \"data_json:'\") o", p=pages)
    assert sorted(map(tuple, found.collect())) == [(1, 0, '{"a": {"b": 1}}'), (1, 1, "{}")]
