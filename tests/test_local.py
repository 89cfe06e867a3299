"""Stores settled inside tasks, and the same by joins."""
import random

import pytest
from conftest import SF

from shopatlas import registry
from shopatlas.operators import local, resolve


def _stores(spark, seed):
    draw = random.Random(seed)
    rows = []
    for i in range(260):
        x, y = draw.choice([(100.0, 30.0), (179.9999, 0.0), (-179.9999, 0.0001), (10.0, 89.9)])
        place = (x + draw.randrange(12) * 0.0002, y + draw.randrange(12) * 0.0002)
        name = draw.choice(["一店", "二店", "", None]) if i % 9 == 0 else draw.choice(["一店", "二店", "三店"])
        rows.append((i * 7 % 263, draw.randrange(2), name, "a" * draw.randrange(4), draw.choice(["", None, "d"]), "c", *((None, None) if i % 17 == 0 else place)))
    return spark.createDataFrame(rows, "id long, chain_id int, name string, address string, district string, city string, lng double, lat double")


@pytest.mark.parametrize("mode", ["components", "greedy"])
@pytest.mark.parametrize("seed", [1, 2])
def test_stores_inside_tasks_equal_joins(spark, monkeypatch, mode, seed):
    df = _stores(spark, seed)
    with monkeypatch.context() as m:
        m.setattr(resolve, "_clusters_by_joins", None)  # no store is large
        m.setattr(resolve, "same_store_edges", None)
        inside = sorted(map(tuple, resolve.duplicate_clusters(df, mode=mode).collect()))
    for most in (0, 90):  # every store, or some of them, by joins
        monkeypatch.setattr(local, "MOST", most)
        assert sorted(map(tuple, resolve.duplicate_clusters(df, mode=mode).collect())) == inside


@pytest.mark.parametrize("query", ["dedupe_clusters", "dedupe_greedy", "dedupe_deleted"])
def test_small_stores_need_no_rounds(spark, monkeypatch, query):
    monkeypatch.setattr(resolve, "connected_components", None)
    assert registry.QUERIES[query](spark, SF).count()


def test_ids_of_small_stores_need_no_cells(spark, monkeypatch):
    from pyspark.sql import functions as F

    from shopatlas.operators import canonical

    df = _stores(spark, 3).withColumns({"ordinal": F.col("id"), "external_id": F.concat(F.lit("e"), (F.col("id") % 200).cast("string"))})
    ids = lambda: sorted(canonical.canonical_ids(df.where("id % 3 = 0"), df.where("id % 3 > 0")).select("id", "external_id").collect())
    with monkeypatch.context() as m:
        m.setattr(canonical, "cell_edges", None)
        inside = ids()
    for most in (0, 90):
        monkeypatch.setattr(local, "MOST", most)
        assert ids() == inside


def test_hot_questions_are_no_join_key(spark):
    plan = registry.QUERIES["geocode_cascade"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Union" not in plan


def test_features_of_a_release_are_made_once(spark, tmp_path, monkeypatch):
    from shopatlas.plans import export, versions

    read, own = [], versions.content_digest
    monkeypatch.setattr(versions, "content_digest", lambda df: read.append(df.inputFiles()) or own(df))
    registry.QUERIES["geojson_release"](spark, SF).count()
    assert len(read) == 2 and all("features-" in f for files in read for f in files) and export
