"""Ids of a batch against plain steps, one record after the other."""
import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from shopatlas import fixtures
from shopatlas.functions import geo, text
from shopatlas.operators import canonical, sphere
from shopatlas.plans import ingest

STORED = "chain_id int, external_id string, name string, lng double, lat double"
BATCH = STORED + ", ordinal long, norm_name string, cx int, root string"
METRE = 1 / 111195.0


def plain(stored, batch, names, radius=50.0):
    """Known ids by ordinal: the table is a dict in the order in which ids were first written."""
    table = {(c, e): (names[n], x, y) for c, e, n, x, y in sorted(stored, key=lambda r: (r[0], r[1]))}
    seen, out = {}, {}
    for c, e, n, x, y, o in sorted(batch, key=lambda r: r[5]):
        name, known = names[n], e
        located = bool(name) and x is not None and y is not None
        if located:
            cell = (c, name, round(x, 4), round(y, 4))
            if cell not in seen:
                near = [k[1] for k, v in table.items() if k[0] == c and v[0] == name and v[1] is not None and v[2] is not None and sphere.metres(x, y, v[1], v[2]) <= radius]
                seen[cell] = near[0] if near else e
            known = seen[cell]
        if known is not None:
            table[(c, known)] = (name, x, y) if located else ("", None, None)
        out[o] = known
    return out


def names_of(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "name string").withColumn("n", text.store_name(F.col("name")))
    return {r.name: r.n for r in df.collect()}


def found(spark, stored, batch, radius=50.0):
    old = spark.createDataFrame(stored, STORED)
    new = spark.createDataFrame([(*r, "x", 7, "r") for r in batch], BATCH).repartition(3)
    df = canonical.canonical_ids(old, new, radius)
    assert df.columns == new.columns
    rows = df.collect()
    assert len(rows) == len(batch)
    return {r.ordinal: r.external_id for r in rows}


def test_a_moved_row_is_found_at_its_new_place(spark):
    stored = [(1, "A", "Shop", 110.0, 30.0)]
    batch = [(1, "B", "Shop", 110.0, 30.0 + 40 * METRE, 0), (1, "C", "Shop", 110.0, 30.0 + 80 * METRE, 1), (1, "D", "Shop", 110.0, 30.0, 2), (2, "E", "Shop", 110.0, 30.0, 3)]
    assert found(spark, stored, batch) == {0: "A", 1: "A", 2: "D", 3: "E"}


@pytest.mark.parametrize("seed, radius", [(1, 50.0), (2, 50.0), (3, 8.0)])
def test_ids_equal_plain_steps(spark, seed, radius):
    rng = random.Random(seed)
    values = ["Shop", "shop ", "Other", "", None]
    names = names_of(spark, values) | {None: ""}
    spots = [(110.0 + rng.randint(0, 12) * 12 * METRE, lat + rng.randint(0, 12) * 12 * METRE) for lat in (30.0, 89.9995) for _ in range(25)]
    spots += [(179.9999, 10.0), (-179.9999, 10.0), (None, 30.0), (110.0, None)]
    stored = [(1, f"s{k}", rng.choice(values), *rng.choice(spots)) for k in range(30)]
    batch = [(rng.choice((1, 1, 2)), rng.choice([f"s{rng.randint(0, 35)}", f"b{rng.randint(0, 60)}", f"n{k}"]), rng.choice(values), *rng.choice(spots), k) for k in range(300)]
    assert found(spark, stored, batch, radius) == plain(stored, batch, names, radius)


def test_ids_of_the_table_equal_plain_steps(spark):
    rows = geo.with_wgs84(fixtures.load(spark, SF, "location")).select("chain_id", "external_id", "name", "lng", "lat", "id").collect()
    names = names_of(spark, {r.name for r in rows})
    stored = list({(r.chain_id, r.external_id): tuple(r[:5]) for r in rows if r.id % 4 == 0}.values())
    batch = [tuple(r) for r in rows if r.id % 4]  # external ids recur, so rows change their names
    assert found(spark, stored, batch) == plain(stored, batch, names)


def test_copies_are_settled_without_pairs(spark, monkeypatch):
    written = []
    keep = canonical.materialise

    def noted(df, name):
        out = keep(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(canonical, "materialise", noted)
    n = 100_000
    batch = spark.range(n).select(F.lit(1).alias("chain_id"), F.format_string("b%06d", "id").alias("external_id"), F.lit("Shop").alias("name"), F.when(F.col("id") < n - 10, 110.0).otherwise(111.0 + F.col("id") % 2 * 20 * METRE).alias("lng"), F.lit(30.0).alias("lat"), F.col("id").alias("ordinal"))
    ids = canonical.canonical_ids(batch.select("chain_id", "external_id", "name", "lng", "lat").limit(0), batch).groupBy("external_id").count()
    assert {tuple(r) for r in ids.collect()} == {("b000000", n - 10), ("b099990", 10)}
    assert sum(k for _, k in written) <= 4 * n and dict(written)["replayed"] <= 2


def test_ingest_takes_over_the_moved_row(spark):
    shape = "chain_id int, external_id string, name string, address string, province string, city string, district string, lng double, lat double, coordinate_system string, last_seen_at string, created_at string"
    row = lambda e, metres, seen: (1, e, "Shop", "Road 1", "广东省", "广州市", "天河区", 113.3, 23.1 + metres * METRE, "WGS84", seen, seen)
    old = spark.createDataFrame([row("A", 0, "day 0")], shape)
    new = spark.createDataFrame([(*row("B", 40, "day 1"), 0), (*row("C", 80, "day 2"), 1)], shape + ", ordinal long")
    done = ingest.ingest(old, new).snapshot.collect()
    assert [(r.external_id, round((r.lat - 23.1) / METRE), r.last_seen_at, r.created_at) for r in done] == [("A", 80, "day 2", "day 0")]
