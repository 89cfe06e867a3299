"""Readers and projections on the given tables and on records derived from them."""
from __future__ import annotations

from pyspark.sql import functions as F
from ..functions import scope
from ..plans import storage
from ..sources import projections, readers
from .book import Book
from .functions import city_sql, name_sql, region_sql
from .search import FULL

BOOK = Book()

_LI = "(?is)<li[^>]*>(.*?)</li>"


@BOOK.add(f"""SELECT page, pos - 1 AS pos, nullif(regexp_extract(item, '(?is)<a[^>]*href=["'']([^"'']*)', 1), '') AS href, trim(regexp_replace(regexp_replace(item, '(?s)<[^>]+>', ' ', 'g'), '[\\s\\x{{3000}}\\x{{00A0}}]+', ' ', 'g')) AS label
FROM (SELECT page_id AS page, unnest(x) AS item, generate_subscripts(x, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, '{_LI}', 1) AS x FROM pages))""")
def html_cards(t):
    return readers.cards(t.pages).withColumn("pos", F.col("pos").cast("long"))


_TABLE = "concat('<table><tr><th>no</th></tr>', CASE p_partkey % 2 WHEN 0 THEN concat('<tr class=\"a\"><td>1</td><td>广东省</td><td> 广州市 </td><td><b>', p_name, '</b></td><td>中山路', CAST(p_size AS STRING), '号</td></tr>') ELSE concat('<tr><td>上海</td><td>上海市</td><td>', p_name, '</td>\n<td>五羊?站', CAST(p_size AS STRING), '</td></tr><tr><td>x</td></tr>') END, '</table>')"


@BOOK.add("SELECT p_partkey AS page, 1::BIGINT AS pos, CASE p_partkey % 2 WHEN 0 THEN '广东省' ELSE '上海' END AS province, CASE p_partkey % 2 WHEN 0 THEN '广州市' ELSE '上海市' END AS city, p_name AS name, CASE p_partkey % 2 WHEN 0 THEN concat('中山路', CAST(p_size AS STRING), '号') ELSE concat('五羊邨站', CAST(p_size AS STRING)) END AS address FROM part")
def html_table_rows(t):
    pages = t.part.select(F.col("p_partkey").alias("page_id"), F.expr(_TABLE).alias("html"))
    return readers.store_rows(pages).withColumn("pos", F.col("pos").cast("long"))


_SCRIPT = r"""concat('<script>var x = {data_json:\'{"id": ', CAST(event_id AS STRING), ', "in": {"a": [1, {"b": 2}]}, "props": ', props, '}\', more: {}}</script>', CASE event_id % 3 WHEN 0 THEN 'data_json:\'{"id": -1}' ELSE '' END)"""


@BOOK.add("SELECT event_id AS page, 0::BIGINT AS pos, event_id AS id, concat('x', props) = concat('x', props) AS whole FROM events UNION ALL SELECT event_id, 1, -1, true FROM events WHERE event_id % 3 = 0")
def embedded_json(t):
    pages = t.events.select(F.col("event_id").alias("page_id"), F.expr(_SCRIPT).alias("html"))
    found = readers.embedded_json(pages)
    return found.select("page", F.col("pos").cast("long").alias("pos"), F.get_json_object("json", "$.id").cast("long").alias("id"), F.from_json("json", "id long").isNotNull().alias("whole"))


@BOOK.add("SELECT s_suppkey AS page, k::BIGINT AS pos, concat('u', CAST(k AS STRING)) AS \"user\", s_name AS store_name, concat('路', CAST(s_suppkey + k AS STRING)) AS address FROM supplier, range(2) r(k)")
def js_list(t):
    html = "concat('[', concat_ws(',', transform(sequence(0, 1), k -> concat('{user:\\'u', k, '\\', storeName:\\'', s_name, '\\' , address : \\'路', s_suppkey + k, '\\'}'))), ']')"
    pages = t.supplier.select(F.col("s_suppkey").alias("page_id"), F.expr(html).alias("html"))
    return readers.js_objects(pages).withColumn("pos", F.col("pos").cast("long"))


@BOOK.add("SELECT page_id, list_max(list_filter(list_transform(regexp_extract_all(html, '>\\s*(\\d+)\\s*<', 1), lambda x: try_cast(x AS BIGINT)), lambda x: x < 10000)) AS last FROM pages")
def last_page(t):
    return t.pages.select("page_id", readers.largest_page(F.col("html")).alias("last"))


@BOOK.add("SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'quota' WHEN 1 THEN 'transient' ELSE 'ok' END AS route FROM events")
def status_routing(t):
    code = F.expr("CASE event_id % 5 WHEN 0 THEN '121' WHEN 1 THEN '539' WHEN 2 THEN '0' WHEN 3 THEN '200' ELSE 'null' END")
    own = t.events.select(F.col("event_id").alias("id"), F.concat(F.lit('{"message": {"status": '), code, F.lit('}, "data": []}')).alias("body"))
    return readers.route_status(own).select("id", "route")


@BOOK.add("SELECT s_suppkey AS id, 2 AS declared, CAST(k AS INT) AS pos, concat(s_name, '_', CAST(k AS STRING)) AS store_name FROM supplier, range(2) r(k) WHERE s_suppkey % 3 > 0 UNION ALL SELECT s_suppkey, 0, NULL, NULL FROM supplier WHERE s_suppkey % 3 = 0")
def two_table_payload(t):
    body = F.expr("""CASE WHEN s_suppkey % 3 = 0 THEN '{"Table": [{"rowcount": 0}], "Table1": []}' ELSE concat('{"Table": [{"rowcount": 2}], "Table1": [{"storeName": "', s_name, '_0"}, {"storeName": "', s_name, '_1"}]}') END""")
    return readers.two_tables(t.supplier.select(F.col("s_suppkey").alias("id"), body.alias("body")))


@BOOK.add("SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'bare' ELSE 'data' END AS form FROM supplier")
def json_envelope(t):
    row = """concat('{"id": ', s_suppkey, ', "form": "', CASE s_suppkey % 2 WHEN 0 THEN 'bare' ELSE 'data' END, '"}')"""
    own = t.supplier.select(F.expr(f"""CASE s_suppkey % 2 WHEN 0 THEN concat('[', {row}, ']') ELSE concat('{{"data": [', {row}, ']}}') END""").alias("body"))
    found = readers.envelope(own)
    return found.select(F.get_json_object("record", "$.id").cast("long").alias("id"), F.get_json_object("record", "$.form").alias("form"))


@BOOK.add("SELECT l_partkey AS part, l_orderkey AS page, l_linenumber AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def paged_first_seen(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("pos"))
    return readers.paged_first_seen(rows, "part")


@BOOK.add("SELECT conv_id, turn, text FROM conversations WHERE text IS NOT NULL")
def charset_decode(t):
    """Texts to GB18030 or UTF-8 bytes and back (rows of the conversations whose text is not null)."""
    own = t.conversations.where("text is not null")
    with readers.java_charsets(t.spark):
        raw = F.when(F.expr("turn % 2 = 0"), F.encode("text", "UTF-8")).otherwise(F.encode("text", "GB18030"))
        return storage.materialise(own.select("conv_id", "turn", readers.decode_page(raw, "UTF-8").alias("text")), "decoded")


@BOOK.add("SELECT external_id, name FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY coalesce(city, '~') DESC, id DESC) AS rn FROM location) WHERE rn = 1")
def merge_city_files(t):
    own = t.location.select("external_id", "name", F.struct(F.coalesce("city", F.lit("~")), "id").alias("file"))
    return readers.merge_files(own, "external_id").select("external_id", "name")


@BOOK.add("SELECT id FROM location WHERE source_type = 'seed'")
def versioned_read(t):
    return readers.versioned(t.location.withColumnRenamed("source_type", "adapter_version"), "seed").select("id")


@BOOK.add("SELECT id, 'spare' AS part FROM location WHERE source_type = 'seed' UNION ALL SELECT id, 'own' FROM location WHERE source_type = 'poi'")
def fallback_source(t):
    own = lambda kind, name: t.location.where(F.col("source_type") == kind).select("id", F.lit(name).alias("part"))
    return readers.with_fallback(own("none such", "own"), own("seed", "spare")).union(readers.with_fallback(own("poi", "own"), own("official", "spare")))




def _tree(t):
    city = F.to_json(F.struct(F.col("n_name").alias("name"), F.concat_ws(",", (F.col("n_nationkey") + 100.5).cast("string"), F.col("n_nationkey").cast("string")).alias("center")))
    cities = t.nation.where("n_regionkey <> 3").groupBy("n_regionkey").agg(F.array_join(F.collect_list(city), ",").alias("c"))
    own = t.region.join(cities, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return own.select(F.concat(F.lit('{"districts": [{"name": "'), "r_name", F.lit('省", "center": "1.5,2.5", "districts": ['), F.coalesce("c", F.lit("")), F.lit("]}]}")).alias("body"))


@BOOK.add("SELECT r_name AS province, n_name AS city, n_nationkey + 100.5::DOUBLE AS lng, n_nationkey::DOUBLE AS lat FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3 UNION ALL SELECT r_name, concat(r_name, '省'), 1.5, 2.5 FROM region WHERE r_regionkey = 3")
def district_tree(t):
    return readers.district_centres(_tree(t))


@BOOK.add("SELECT r_name AS province, 0::BIGINT AS pos, r_name AS region FROM region UNION ALL SELECT r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name), n_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3 UNION ALL SELECT r_name, 1, concat(r_name, '省') FROM region WHERE r_regionkey = 3")
def region_list(t):
    return readers.region_list(readers.district_centres(_tree(t))).withColumn("pos", F.col("pos").cast("long"))


@BOOK.add("SELECT n_name AS city FROM nation WHERE n_regionkey = 2")
def country_cities(t):
    each = t.nation.groupBy("n_regionkey").agg(F.to_json(F.struct(F.when(F.col("n_regionkey") == 2, "156").otherwise(F.col("n_regionkey").cast("string")).alias("code"), F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("city"))).alias("c"))
    return readers.country_cities(each.agg(F.concat(F.lit('{"data": ['), F.array_join(F.collect_list("c"), ","), F.lit("]}")).alias("body")))


@BOOK.add("SELECT n_name AS city FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey NOT IN (4, 5) AND n_nationkey % 7 > 0")
def city_gate(t):
    own = t.nation.select(F.col("n_name").alias("city"), F.expr("CASE WHEN n_nationkey % 3 > 0 THEN CAST(n_nationkey AS STRING) END").alias("code"), F.expr("CASE WHEN n_nationkey % 7 = 0 THEN '-' ELSE '1.5' END").alias("lng"), F.lit("2").alias("lat"))
    return readers.city_gate(own, ["4", "5"]).select("city")


@BOOK.add("SELECT id, name, CASE WHEN lng IS NOT NULL THEN printf('POINT(%.6f %.6f)', lng, lat) END AS wkt FROM location")
def table_scan_wkt(t):
    from ..functions.geo import point_wkt

    return t.location.select("id", "name", point_wkt(F.col("lng"), F.col("lat")).alias("wkt"))


@BOOK.add(f"SELECT id, name, chain_slug, city FROM ({FULL}) WHERE lng IS NOT NULL AND chain_slug IN ('nation_3', 'nation_4')")
def geojson_scan(t):
    """Documents of all chains, written as files and read back line by line; the rows of two chains, as in the SQL."""
    from ..plans import export
    from .search import _full

    path = storage.fresh_path(t.spark, "geojson")
    export.write_collections(_full(t), path)
    return readers.read_geojson_lines(t.spark, path).where(F.col("chain_slug").isin("nation_3", "nation_4")).select("id", "name", "chain_slug", "city")


@BOOK.add("SELECT c.slug, g.slug AS category_slug FROM chain c JOIN category g ON g.id = c.category_id WHERE g.slug = 'asia'")
def catalog_read(t):
    path = storage.fresh_path(t.spark, "catalog")
    rows = t.chain.join(t.category.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug")), "category_id").select("id", "name", "slug", "category_slug")
    rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(path)
    return readers.read_catalog(t.spark, path, "asia").select("slug", "category_slug")


@BOOK.add("SELECT id, CASE id % 4 WHEN 0 THEN 'e1' WHEN 1 THEN 'h2' WHEN 2 THEN '33' END AS raw_id FROM location")
def raw_ids(t):
    payload = F.expr("""CASE id % 4 WHEN 0 THEN '{"external_id": "e1", "id": 5}' WHEN 1 THEN '{"external_id": "", "orgResourceCode": "h2"}' WHEN 2 THEN '{"storeId": 33}' ELSE '{"name": "x"}' END""")
    return t.location.select("id", projections.raw_id(payload).alias("raw_id"))


_SRC = "SELECT o_orderkey AS k, c_custkey AS c, c_name AS n, concat('中山路', CAST(c_custkey AS STRING), '号') AS a, CASE c_custkey % 4 WHEN 0 THEN '广东省' WHEN 1 THEN '香港' ELSE '上海市' END AS p, CASE c_custkey % 4 WHEN 0 THEN '广州市' ELSE '上海市' END AS t, 100.0 + (o_orderkey % 300) / CAST(10.0 AS DOUBLE) AS x, 20.0 + (o_orderkey % 300) / CAST(10.0 AS DOUBLE) AS y FROM orders JOIN customer ON o_custkey = c_custkey"


def _records(t):
    """Records of every source's own shape, from orders and customers."""
    s = storage.materialise(t.spark.sql(_SRC.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=t.orders, customer=t.customer), "records")
    e = lambda *x: s.selectExpr(*x)
    poi = ("concat('p', k) AS id", "a AS address", "concat(x, ',', y) AS location", "p AS pname", "t AS cityname", "CAST(NULL AS STRING) AS adname")
    area = "named_struct('name', '天河区', 'fields', named_struct('parent', named_struct('name', CASE WHEN c % 2 = 0 THEN t END, 'fields', named_struct('parent', named_struct('name', '上海'))))) AS area"
    return {
        "hema": e("concat('h', k) AS orgResourceCode", "CASE WHEN k % 2 = 0 THEN n ELSE '' END AS resourceName", "a AS address", "p AS province", "t AS city", "CAST(NULL AS STRING) AS county", "CAST(k % 3 AS STRING) AS bizStatus"),
        "rt-mart": e("concat('r', k) AS store_id", "CASE k % 3 WHEN 0 THEN concat(t, '-', n) WHEN 1 THEN n END AS display_name", "a AS address"),
        "7-eleven-cd": e("k AS id", "n AS shopName", "a AS address", "CAST(x AS STRING) AS bMap_lng", "CAST(y AS STRING) AS bMap_lat", "concat(p, t) AS cityFullName"),
        "7-eleven": e(*poi, "concat(CASE k % 2 WHEN 0 THEN '7-ELEVEn(' ELSE '(' END, n, ')') AS name"),
        "walmart": e(*poi, "concat(CASE k % 2 WHEN 0 THEN '沃尔玛(' ELSE '(' END, n, ')') AS name", "CASE k % 3 WHEN 0 THEN '超级市场' ELSE '' END AS type"),
        "sams-club": e(*poi, "concat(CASE k % 2 WHEN 0 THEN '山姆会员商店(' ELSE '(' END, n, ')') AS name"),
        "7fresh": e("k AS id", "n AS name", "a AS address", "CAST(y AS STRING) AS longitude", "CAST(x AS STRING) AS latitude", "CASE k % 2 WHEN 0 THEN 'life' ELSE 'market' END AS format", "CASE k % 3 WHEN 0 THEN t END AS city", "'北京' AS request_city"),
        "yonghui": e("concat(CASE k % 2 WHEN 0 THEN '永辉' ELSE '' END, n) AS name", "concat(t, a) AS address", "p AS province", "t AS city"),
        "family-mart": e("concat(CASE k % 3 WHEN 0 THEN 'FamilyMart' WHEN 1 THEN '全家' ELSE '' END, n) AS name", "a AS address", "p AS province", "t AS city"),
        "kfc": e("concat('k', k) AS storecode", "concat(CASE k % 2 WHEN 0 THEN 'kfc' ELSE '' END, n) AS storename", "a AS address", "t AS cityName", "CAST(NULL AS STRING) AS districtName", "CASE k % 3 WHEN 0 THEN '' ELSE CAST(x AS STRING) END AS lng", "CAST(x AS STRING) AS longitude", "CAST(y AS STRING) AS lat", "CAST(NULL AS STRING) AS latitude", "CASE k % 5 WHEN 0 THEN '710000' ELSE '440100' END AS gbCityCode"),
        "kfc-list": e("n AS storeName", "a AS addressDetail", "t AS cityName", "CAST(NULL AS STRING) AS provinceName", "p AS province", "CASE k % 2 WHEN 0 THEN concat('c', k) END AS storeCode", "CAST(x AS STRING) AS lng", "'-' AS lat"),
        "aldi": e("k AS id", f"named_struct('storesName', n, 'storesAddress', concat(t, a), 'area', {area.removesuffix(' AS area')}) AS fields"),
        "costco": e("concat('co', k) AS external_id", "n AS name", "a AS address", "p AS province", "t AS city", "CAST(NULL AS STRING) AS district", "x AS longitude", "y AS latitude", "CASE k % 2 WHEN 0 THEN 'GCJ02' END AS coordinate_system"),
        "mcdonalds": e("k AS id", "n AS title", "CASE k % 2 WHEN 0 THEN a ELSE '' END AS address", "p AS province", "t AS city", "CAST(NULL AS STRING) AS district", "named_struct('lng', CASE WHEN k % 3 > 0 THEN x END, 'lat', CASE WHEN k % 3 > 0 THEN y END) AS location"),
        "mixue": e("concat('m', k) AS shopId", "CASE k % 9 WHEN 0 THEN '888888' ELSE CAST(k AS STRING) END AS shopCode", "n AS shopName", "a AS shopAddress", "t AS regionName", "CASE k % 4 WHEN 0 THEN '710100' ELSE '310000' END AS regionCode", "CAST(0 AS INT) AS isOversea", "CAST(x AS STRING) AS longitude", "CAST(y AS STRING) AS latitude"),
        "heytea": e("concat('t', k) AS id", "n AS name", "a AS address", "p AS province", "t AS city", "'' AS district", "'15601' AS city_code", "k % 6 = 0 AS is_overseas", "CAST(NULL AS INT) AS is_enable", "CAST(x AS STRING) AS longitude", "CAST(y AS STRING) AS latitude"),
        "stored": t.location.selectExpr("external_id", "name", "address", "province", "city", "district", "lng", "lat", "coordinate_system"),
    }


def _branch(slug, where="true", external="NULL", name="n", address="a", province="NULL", city="NULL", district="NULL", lng="NULL", lat="NULL", crs="'GCJ02'"):
    return f"SELECT '{slug}' AS chain_slug, {external} AS external_id, {name} AS name, {address} AS address, {province} AS province, {city} AS city, {district} AS district, {lng}::DOUBLE AS longitude, {lat}::DOUBLE AS latitude, {crs} AS coordinate_system FROM s WHERE {where}"


_IN = "p <> '香港'"
_HASH = lambda short, name: f"concat('{short}-', substr(sha1(concat_ws('|', {region_sql('p')}, {city_sql('t')}, {name_sql(name)}, concat('中山路', CAST(c AS STRING)))), 1, 16))"
_POI = {"external": "concat('amap-p', CAST(k AS STRING))", "province": "p", "city": "t", "lng": "x", "lat": "y"}
_FULLNAME = "concat(p, t)"
_CODES = ", ".join(f"'{c}'" for c in scope.TEST_CODES)
_ALL = " UNION ALL ".join(
    [
        _branch("hema", "k % 3 = 1", "concat('h', CAST(k AS STRING))", "CASE WHEN k % 2 = 0 THEN n ELSE '盒马' END", province="p", city="t"),
        _branch("rt-mart", external="concat('r', CAST(k AS STRING))", name="CASE WHEN k % 3 < 2 THEN n ELSE '大润发' END", city="CASE k % 3 WHEN 0 THEN t END"),
        _branch("7-eleven-cd", external="concat('cd-', CAST(k AS STRING))", address=f"concat({_FULLNAME}, a)", province="CASE p WHEN '广东省' THEN p WHEN '上海市' THEN p END", city="CASE p WHEN '广东省' THEN t WHEN '上海市' THEN p ELSE concat(p, t) END", district="CASE p WHEN '上海市' THEN t END", lng="x", lat="y", crs="'BD09'"),
        _branch("7-eleven", f"{_IN} AND k % 2 = 0", name="concat('7-ELEVEn(', n, ')')", **_POI),
        _branch("walmart", f"{_IN} AND k % 6 = 0", name="concat('沃尔玛(', n, ')')", **_POI),
        _branch("sams-club", f"{_IN} AND k % 2 = 0", name="concat('山姆会员商店(', n, ')')", **_POI),
        _branch("7fresh", external="concat('7fresh-', CASE k % 2 WHEN 0 THEN 'life' ELSE 'sm' END, '-', CAST(k AS STRING))", name="concat(CASE k % 2 WHEN 0 THEN '七鲜生活' ELSE '七鲜超市' END, ' ', n)", city="CASE k % 3 WHEN 0 THEN t ELSE '北京' END", lng="x", lat="y"),
        _branch("yonghui", _IN, _HASH("yh", "n"), "concat('永辉', n)", "concat(t, a)", "p", "replace(t, '市', '')"),
        _branch("family-mart", _IN, _HASH("fm", "n"), "concat(CASE k % 3 WHEN 0 THEN 'FamilyMart' ELSE '全家' END, n)", province="p", city="t"),
        _branch("kfc", "k % 5 > 0", "concat('k', CAST(k AS STRING))", "concat(CASE k % 2 WHEN 0 THEN 'kfc' ELSE '肯德基' END, n)", city="t", lng="x", lat="y"),
        _branch("kfc-list", external=f"CASE k % 2 WHEN 0 THEN concat('kfc-c', CAST(k AS STRING)) ELSE {_HASH('kfc', 'n')} END", name="concat('肯德基', n)", province="p", city="t", lng="x"),
        _branch("aldi", external="concat('aldi-', CAST(k AS STRING))", address="concat(t, a)", province="'上海市'", city="t", district="'天河区'"),
        _branch("costco", external="concat('co', CAST(k AS STRING))", province="p", city="t", lng="x", lat="y", crs="CASE k % 2 WHEN 0 THEN 'GCJ02' ELSE 'WGS84' END"),
        _branch("mcdonalds", "k % 2 = 0 OR k % 3 > 0", "concat('mcd-', CAST(k AS STRING))", address="CASE k % 2 WHEN 0 THEN a END", province="p", city="t", lng="CASE WHEN k % 3 > 0 THEN x END", lat="CASE WHEN k % 3 > 0 THEN y END"),
        _branch("mixue", f"k % 9 > 0 AND k % 4 > 0 AND CAST(k AS STRING) NOT IN ({_CODES}) AND y BETWEEN 17.5 AND 54.5 AND x BETWEEN 72 AND 136", "concat('m', CAST(k AS STRING))", city="t", lng="x", lat="y"),
        _branch("heytea", "k % 6 > 0 AND x BETWEEN 73.66 AND 134.77 AND y BETWEEN 18.15 AND 53.55", "concat('t', CAST(k AS STRING))", province="p", city="concat(p, ' ', t)", district="''", lng="x", lat="y"),
        "SELECT 'stored', external_id, name, address, province, city, district, lng, lat, coordinate_system FROM location",
    ]
)


@BOOK.add(f"WITH s AS ({_SRC}) {_ALL}")
def normalize_all_sources(t):
    return projections.normalise(_records(t))


_COSTCO = _branch("costco", external="concat('co', CAST(k AS STRING))", crs="CASE k % 2 WHEN 0 THEN 'GCJ02' ELSE 'WGS84' END")


@BOOK.add(f"WITH s AS ({_SRC}) SELECT external_id, coordinate_system FROM ({_COSTCO})")
def static_source(t):
    return projections.get("costco")(_records(t)["costco"]).select("external_id", "coordinate_system")


@BOOK.add("SELECT external_id, name, lng AS longitude FROM location WHERE chain_id = 3")
def stored_as_source(t):
    own = t.location.where("chain_id = 3")
    return projections.get("stored")(own).select("external_id", "name", "longitude")


@BOOK.add("SELECT chain_slug, count(*) AS n FROM (SELECT c.slug AS chain_slug, external_id FROM location l JOIN chain c ON c.id = l.chain_id GROUP BY 1, 2) GROUP BY 1")
def stream_dedup(t):
    """First-seen filtering as a stream over the orders' files, counted per chain."""
    from .pipeline import streamed_first_seen

    return streamed_first_seen(t)


