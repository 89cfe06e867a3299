"""Spatial order, boxes with great-circle edges, far neighbours without all pairs."""
import math
import random

import pytest
from pyspark.sql import functions as F

from shopatlas.operators import layout, pyramid, search


def test_ranges_cover_the_box_and_little_more():
    rng = random.Random(5)
    for _ in range(30):
        west, south = rng.uniform(-180, 170), rng.uniform(-90, 80)
        box = (west, south, min(180.0, west + rng.choice([0.0, 0.01, 1, 40])), min(90.0, south + rng.choice([0.0, 0.01, 1, 40])))
        ranges = layout.key_ranges(*box)
        assert 0 < len(ranges) <= layout.MOST_RANGES and ranges == sorted(ranges)
        for _ in range(20):
            x, y = rng.uniform(box[0], box[2]), rng.uniform(box[1], box[3])
            i, j = (min(int((v - low) / width * 65536), 65535) for v, low, width in ((x, -180, 360), (y, -90, 180)))
            key = sum(((i >> b & 1) << 2 * b) | ((j >> b & 1) << 2 * b + 1) for b in range(16))
            assert any(a <= key <= b for a, b in ranges)
    assert layout.key_ranges(10.0, 0.0, 5.0, 1.0) == []
    city = layout.key_ranges(113.0, 23.0, 113.4, 23.3)
    assert sum(b - a + 1 for a, b in city) < 4 * (0.4 / 360 * 65536 + 2) * (0.3 / 180 * 65536 + 2)


def rows_scanned(df):
    """The rows of df, and how many its scan gave out."""
    plan = df._jdf.queryExecution().executedPlan()
    held = plan.executeCollectPublic()
    leaf = plan.collectLeaves().apply(0)
    return len(held), leaf.metrics().apply("numOutputRows").value()


def test_a_city_box_reads_few_row_groups(spark, tmp_path):
    n = 200_000
    points = spark.range(n).select("id", (F.rand(1) * 60 + 75).alias("lng"), (F.rand(2) * 34 + 18).alias("lat"), F.lit("x" * 40).alias("name"))
    points = points.union(spark.createDataFrame([(-1, None, 30.0, "x"), (-2, 113.2, None, "x")], "id long, lng double, lat double, name string"))
    path = str(tmp_path / "spatial")
    layout.write_spatial(points, path, block_bytes=64 << 10)
    assert spark.read.parquet(path).count() == n + 2
    box = (113.0, 23.0, 113.6, 23.5)
    found = layout.read_box(spark, path, *box)
    kept, scanned = rows_scanned(found)
    assert kept == points.where(F.col("lng").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])).count() > 0
    assert scanned < n / 10


def test_geodesic_boxes_bulge(spark):
    box = (70.0, 40.0, 140.0, 60.0)
    rng = random.Random(2)
    points = [(k, rng.uniform(60, 150), rng.uniform(30, 80)) for k in range(4000)]

    def inside(x, y):
        if not box[0] <= x <= box[2]:
            return False
        unit = lambda lng, lat: (math.cos(math.radians(lat)) * math.cos(math.radians(lng)), math.cos(math.radians(lat)) * math.sin(math.radians(lng)), math.sin(math.radians(lat)))
        side = []
        for lat in (box[1], box[3]):
            a, b, p = unit(box[0], lat), unit(box[2], lat), unit(x, y)
            normal = (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
            side.append(sum(i * j for i, j in zip(normal, p, strict=True)))
        return side[0] >= 0 >= side[1]

    df = spark.createDataFrame([*points, (-1, None, 50.0)], "id long, lng double, lat double")
    found = {r.id for r in df.where(layout.in_geodesic_box(F.col("lng"), F.col("lat"), *box)).collect()}
    assert found == {k for k, x, y in points if inside(x, y)}
    planar = {k for k, x, y in points if box[0] <= x <= box[2] and box[1] <= y <= box[3]}
    assert found - planar and planar - found
    west, south, east, north = layout.geodesic_bounds(*box)
    assert south == 40.0 and north == max(y for x, y in [(105, math.degrees(math.atan(math.tan(math.radians(60)) / math.cos(math.radians(35)))))])
    assert all(south <= y <= north for k, x, y in points if k in found)
    southern = layout.geodesic_bounds(70.0, -60.0, 140.0, -40.0)
    assert southern[1] < -60.0 and southern[3] == -40.0
    with pytest.raises(ValueError, match="180"):
        layout.geodesic_bounds(-100.0, 0.0, 100.0, 10.0)


def test_far_queries_stay_linear_and_right(spark):
    rng = random.Random(9)
    stores = [(k, rng.uniform(100, 120), rng.uniform(20, 45)) for k in range(300)] + [(900, -179.5, 0.2), (901, 10.0, -89.7)]
    asked = [(k, rng.uniform(-180, 180), rng.uniform(-90, 90)) for k in range(200)] + [(500 + k, -30.0 + k / 1000, -20.0) for k in range(300)]
    locations, queries = spark.createDataFrame(stores, "id long, lng double, lat double"), spark.createDataFrame(asked, "q long, lng double, lat double")
    found = {(r.query_id, r["rank"]): r.id for r in search.nearest(queries, locations, 3, 1000.0, query_id="q").collect()}
    from shopatlas.operators.sphere import metres

    for q, x, y in asked:
        want = sorted((metres(x, y, a, b), k) for k, a, b in stores)[:3]
        assert [found[q, r] for r in (1, 2, 3)] == [k for _, k in want]
    plan = search._far_pairs(queries, locations, 3, "q")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    assert len({r.query_id for r in search.nearest(queries.limit(2), locations.limit(1), 3, 1000.0, query_id="q").collect()}) == 2  # fewer than k: all
    assert search.nearest(queries, locations.limit(0), 3, 1000.0, query_id="q").count() == 0


def test_boxes_of_any_size_from_a_pyramid(spark, tmp_path):
    rng = random.Random(4)
    points = [(k, round(rng.uniform(100, 103), rng.choice([2, 6])), round(rng.uniform(-2, 2), rng.choice([2, 6])), f"n{k}") for k in range(3000)]
    path = str(tmp_path / "pyramid")
    df = spark.createDataFrame([*points, (-1, None, 0.0, "x")], "id long, lng double, lat double, name string")
    pyramid.write_pyramid(df, path)
    for box in ((100.5, -1.0, 102.0, 1.0), (101.0, 0.0, 101.0, 0.0), (101.0, 0.0, 101.001, 0.001), (99.0, -3.0, 104.0, 3.0), (100.11, -1.73, 100.9, 1.99)):
        inside = [p for p in points if box[0] <= p[1] <= box[2] and box[1] <= p[2] <= box[3]]
        assert pyramid.count_box(spark, path, *box) == len(inside)
        for most in (5000, 100, 7):
            want = inside
            if len(inside) > most:
                size, first = 1 << pyramid.thin_level(*box, most), {}
                for p in inside:
                    cell = tuple(math.floor(v / pyramid.FINEST) // size for v in p[1:3])
                    first[cell] = min(first.get(cell, p), p)
                want = first.values()
            assert sorted(map(tuple, pyramid.read_box(spark, path, *box, most).select("id", "lng", "lat", "name").collect())) == sorted(want)
