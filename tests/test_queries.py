"""Every registered location query gives the rows of its SQL on the smallest tables."""
import pytest
from conftest import SF, rows

from shopatlas import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    assert rows(df.select(*[f"`{c}`" for c in columns]).collect()) == rows(rel.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_imports_and_lists_every_query():
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_collections_are_valid_documents_in_many_files(spark, tmp_path):
    import json

    from shopatlas.plans import export

    stores = [(i, f"n{i}", "a", "c", "big" if i % 3 else f"s{i % 2}", "g", 100.0 + i / 1000, 30.0) for i in range(1, 400)]
    df = spark.createDataFrame(stores, "id long, name string, address string, city string, chain_slug string, category_slug string, lng double, lat double")
    path = tmp_path / "out"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    export.write_collections(df, str(path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {}
    for folder in path.glob("chain_slug=*"):
        files = sorted(folder.glob("part-*.txt"))
        found[folder.name.removeprefix("chain_slug=")] = [f["id"] for f in json.loads("".join(f.read_text() for f in files))["features"]]
    want = {}
    for r in stores:
        want.setdefault(r[4], []).append(r[0])
    assert found == want and len(list((path / "chain_slug=big").glob("part-*.txt"))) > 1
