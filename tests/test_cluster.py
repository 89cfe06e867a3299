"""What works only where executors are processes of their own."""
import json
import os
import subprocess
import sys

from conftest import SF, rows

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
RUN = f"""
import json, sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.checkpoint.dir", sys.argv[1]).config("spark.executor.memory", "1g").getOrCreate())
from pyspark.sql import functions as F
from shopatlas import registry
from shopatlas.sources import relational
found = registry.QUERIES["jdbc_load_and_scan"](spark, {SF!r}).select("chain_id", "id", "lng", "name").collect()
url = "jdbc:derby:" + sys.argv[1] + "/odd;create=true"
odd = spark.createDataFrame([(1, ' a "q", '), (2, ""), (3, None), (4, "x\\n\\r\\ny"), (None, "  "), (-7, "NULL")], "id long, name string")
assert relational.load_table(odd, url, "odd", driver="org.apache.derby.jdbc.EmbeddedDriver") == 6
back = relational.scan_table(spark, url, "odd", "id", 3, driver="org.apache.derby.jdbc.EmbeddedDriver")
assert sorted(map(str, back.collect())) == sorted(map(str, odd.collect())), back.collect()
json.dump([list(r) for r in found], open(sys.argv[1] + "/found.json", "w"))
"""


def test_a_database_in_the_driver_serves_a_cluster(duck, tmp_path):
    from shopatlas import registry

    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    with open(tmp_path / "found.json") as f:
        found = json.load(f)
    assert rows(found) == rows(duck.sql(registry.ORACLE_SQL["jdbc_load_and_scan"]).select("chain_id, id, lng, name").fetchall())
