"""Queries against their SQL on tables whose keys are larger than those of the given ones."""
import duckdb
import pytest
from conftest import SF, rows

from shopatlas import registry


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    """The smallest tables with order keys from 400,000 on, among them shop codes that mark tests."""
    folder, con = tmp_path_factory.mktemp("shifted"), duckdb.connect()
    for name in "region nation customer supplier part orders".split():
        keys = "* REPLACE (o_orderkey + 400000 AS o_orderkey)" if name == "orders" else "*"
        con.execute(f"COPY (SELECT {keys} FROM '{SF}/{name}.parquet') TO '{folder}/{name}.parquet'")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return str(folder), con


def test_sources_leave_out_every_test_code(spark, shifted):
    folder, con = shifted
    found = registry.QUERIES["normalize_all_sources"](spark, folder)
    columns = sorted(found.columns)
    want = con.sql(registry.ORACLE_SQL["normalize_all_sources"]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert rows(found.select(*columns).collect()) == rows(want)
