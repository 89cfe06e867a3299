"""Location tables derived from the given tables, as SQL text that Spark and DuckDB both run."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

LOCATION = """
SELECT o_orderkey AS id, c_nationkey AS chain_id, c_custkey AS cust, concat('x', CAST(o_orderkey % 5000 AS STRING)) AS external_id,
  concat(CASE c_custkey % 6 WHEN 0 THEN '全家便利店' WHEN 1 THEN '7-ELEVEn ' WHEN 2 THEN '永辉超市' WHEN 3 THEN '盒马' WHEN 4 THEN ' KFC' ELSE '' END, '(', c_name, '店)') AS name,
  CASE c_custkey % 9 WHEN 0 THEN '广东省' WHEN 1 THEN '浙江省' WHEN 2 THEN '上海市' WHEN 3 THEN '台湾省' WHEN 4 THEN '香港特别行政区' WHEN 5 THEN '内蒙古自治区' WHEN 6 THEN '新疆维吾尔自治区' WHEN 7 THEN '四川省' END AS province,
  CASE c_custkey % 9 WHEN 0 THEN '广州市' WHEN 1 THEN '浙江省杭州市' WHEN 2 THEN '上海市' WHEN 3 THEN '台北市' WHEN 4 THEN '香港' WHEN 5 THEN '呼和浩特市' WHEN 6 THEN '乌鲁木齐市' WHEN 8 THEN '凉山州' END AS city,
  CASE c_custkey % 4 WHEN 0 THEN '天河区' WHEN 1 THEN '余杭区' WHEN 2 THEN '浦东新区' END AS district,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE concat(CASE c_custkey % 9 WHEN 0 THEN '广东省广州市' WHEN 1 THEN '浙江省杭州市' WHEN 2 THEN '上海市' WHEN 7 THEN '金门 ' ELSE '' END,
    CASE o_orderkey % 3 WHEN 0 THEN '中山大道' WHEN 1 THEN '香港中路' ELSE '人民 路' END, CAST(c_custkey % 300 AS STRING), '号', CASE o_orderkey % 5 WHEN 0 THEN '万达广场、二楼' WHEN 1 THEN '时代购物中心B1' ELSE '' END) END AS address,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 73.66 + ((c_custkey * 7919) % 61110) / CAST(1000.0 AS DOUBLE) + ((o_orderkey * 31) % 17) * CAST(0.0001 AS DOUBLE) END AS lng,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE 18.15 + ((c_custkey * 104729) % 35400) / CAST(1000.0 AS DOUBLE) + ((o_orderkey * 13) % 11) * CAST(0.0001 AS DOUBLE) END AS lat,
  CASE o_orderkey % 3 WHEN 0 THEN 'WGS84' WHEN 1 THEN 'GCJ02' ELSE 'BD09' END AS coordinate_system,
  CASE o_orderstatus WHEN 'O' THEN 'official' WHEN 'F' THEN 'poi' ELSE 'seed' END AS source_type, o_orderdate AS seen_at
FROM orders JOIN customer ON o_custkey = c_custkey
"""
CHAIN = "SELECT n_nationkey AS id, n_name AS name, lower(n_name) AS slug, n_regionkey AS category_id FROM nation"
CATEGORY = "SELECT r_regionkey AS id, r_name AS name, lower(r_name) AS slug FROM region"
DISCLOSURE = """
SELECT DISTINCT CASE c_custkey % 9 WHEN 0 THEN '广州' WHEN 1 THEN '杭州市' WHEN 2 THEN '上海市' WHEN 5 THEN '呼和浩特' ELSE '成都市' END AS city, concat('(', c_name, '店)') AS name
FROM customer WHERE c_custkey % 10 <> 0
"""
GAZETTEER = """
SELECT concat('香港中路', CAST(s_suppkey % 300 AS STRING), '号') AS address, CASE s_suppkey % 3 WHEN 0 THEN '杭州' WHEN 1 THEN '广州' END AS city,
  100.0 + s_suppkey / CAST(100.0 AS DOUBLE) AS lng, 30.0 + s_suppkey / CAST(200.0 AS DOUBLE) AS lat,
  CASE s_suppkey % 5 WHEN 0 THEN '门牌号' WHEN 1 THEN '村庄' WHEN 2 THEN '区县' WHEN 3 THEN '' ELSE '道路' END AS level, s_suppkey AS seq
FROM supplier
"""
CITY_CENTER = """
SELECT n_name AS city, 74.0 + (n_nationkey * 2417) % 60 AS lng, 19.0 + (n_nationkey * 1013) % 34 AS lat, n_nationkey % 3 AS size_class, n_nationkey * 7 % 60 AS expected
FROM nation
"""
REQUEST_LOG = "SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, concat(CAST(user_id AS STRING), '|', event_type) AS store FROM events"
DERIVED = {"location": LOCATION, "chain": CHAIN, "category": CATEGORY, "disclosure": DISCLOSURE, "gazetteer": GAZETTEER, "city_center": CITY_CENTER, "request_log": REQUEST_LOG}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from them (read through the session's SQL with its own names)."""
    if name not in DERIVED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f" {t}" in sql.replace("\n", " ")}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}} AS {t}").replace(f"JOIN {t} ", f"JOIN {{{t}}} AS {t} ")
    return spark.sql(sql, **used)


def with_tables(sql: str) -> str:
    """SQL for DuckDB: the derived tables that a query names, as common table expressions in front."""
    named = [k for k in DERIVED if f" {k}" in sql.replace("\n", " ").replace("(", " ")]
    head = ", ".join(f"{k} AS ({DERIVED[k]})" for k in named)
    body = sql.strip()
    if not head:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {body[15:]}"
    return f"WITH {head}, {body[5:]}" if body.startswith("WITH ") else f"WITH {head} {body}"
