"""Records of single sources, saved files and releases, and variants of windows, grids and tiles."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import geo, scope, sql, text
from ..operators import stats, tiling, upsert
from ..plans import export, storage
from ..sources import projections, readers, relational
from ..streaming import ingest as streaming
from .book import Book
from .functions import _moved_sql, city_sql, wgs_sql
from .search import _EXPORT, FULL, _full, haversine_sql
from .sources import _SCRIPT, _SRC, _records

BOOK = Book()
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}

_CARD = "concat('<ul><div class=\"store-item x\"><a href=\"/stores/info?storeId=', CAST(s_suppkey AS STRING), '\">了解门店</a><div> 上海市-', s_name, '</div><p>营业时间：07:30 - 22:00</p><div>门店地址：', s_name, '路1号</div><div>服务电话：021-', CAST(s_nationkey AS STRING), '</div></div><div class=\"store-item\"><a href=\"/x\">y</a>', CASE s_suppkey % 3 WHEN 0 THEN '<div>门店地址：z</div>' ELSE '' END, '</div><div class=\"store-item\"><a href=\"?storeId=9\">无地址-店</a></div></ul>')"


@BOOK.add("SELECT s_suppkey AS page, 0::BIGINT AS pos, CAST(s_suppkey AS STRING) AS store_id, concat('上海市-', s_name) AS display_name, concat(s_name, '路1号') AS address, '07:30 - 22:00' AS hours, concat('021-', CAST(s_nationkey AS STRING)) AS phone FROM supplier")
def store_cards(t):
    pages = t.supplier.select(F.col("s_suppkey").alias("page_id"), F.expr(_CARD).alias("html"))
    return readers.store_cards(pages).withColumn("pos", F.col("pos").cast("long"))


_INFO = "concat('<table><tr><th>城市</th><th>门店名称</th></tr><tr><td>城市 ', n_name, '市</td>\n<td>门店名称 麦当劳', n_name, '餐厅</td><td>信息公示</td></tr><tr><td>城市</td><td>x</td></tr><tr><td>单</td></tr><tr><td> 深圳市 </td><td>麦当劳', CAST(n_nationkey AS STRING), '</td></tr></table>')"


@BOOK.add("SELECT n_nationkey AS page, 1::BIGINT AS pos, concat(n_name, '市') AS city, concat('麦当劳', n_name, '餐厅') AS name FROM nation UNION ALL SELECT n_nationkey, 4, '深圳市', concat('麦当劳', CAST(n_nationkey AS STRING)) FROM nation")
def disclosure_rows(t):
    pages = t.nation.select(F.col("n_nationkey").alias("page_id"), F.expr(_INFO).alias("html"))
    return readers.disclosure_rows(pages).withColumn("pos", F.col("pos").cast("long"))


_STATUS = "CASE event_id % 6 WHEN 0 THEN '{\"status\": 121}' WHEN 1 THEN '{\"status\": 539}' WHEN 2 THEN '{\"status\": \"0\"}' WHEN 3 THEN '{\"status\": 200}' WHEN 4 THEN '{\"status\": \"broken\"}' ELSE 'null' END"


@BOOK.add("SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'quota' WHEN 1 THEN 'transient' WHEN 4 THEN 'transient' ELSE 'ok' END AS route, CASE WHEN event_id % 6 IN (0, 1, 4) THEN 0 ELSE 2 END::BIGINT AS rows, CASE WHEN event_id % 6 NOT IN (0, 1, 4) THEN event_id END AS first FROM events")
def status_rows(t):
    """Routes of responses, and the objects in the ``data`` of those that are ok."""
    body = F.concat(F.lit('{"message": '), F.expr(_STATUS), F.lit(', "count": 3, "data": [{"id": '), F.col("event_id").cast("string"), F.lit(', "location": {"lat": 23.1}}, 7, {"id": -1}]}'))
    own = t.events.select(F.col("event_id").alias("id"), body.alias("body"))
    rows = readers.ok_rows(own).groupBy("id").agg(F.count("*").alias("rows"), F.max(F.when(F.col("pos") == 0, F.get_json_object("record", "$.id").cast("long"))).alias("first"))
    return readers.route_status(own).select("id", "route").join(rows.hint("merge"), "id", "left").select("id", "route", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "first")


@BOOK.add("SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN concat(text, '中山路') ELSE coalesce(text, '') || '中山路' END AS text, CASE turn % 2 WHEN 0 THEN concat(text, '中山') ELSE coalesce(text, '') || '中山' END AS other FROM conversations")
def charset_order(t):
    """Texts as GB18030 and UTF-8 bytes, read by the source that tries GB18030 first and by the one that tries UTF-8 first; null stays null."""
    own = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.coalesce("text", F.lit(""))).alias("t"))
    with readers.java_charsets(t.spark):
        ours = F.encode(F.concat("t", F.lit("中山路")), "GB18030")
        theirs = F.encode(F.concat("t", F.lit("中山")), "UTF-8")
        return storage.materialise(own.select("conv_id", "turn", readers.decode_page(ours, "GB18030").alias("text"), readers.decode_page(theirs, "UTF-8").alias("other")), "decoded")


@BOOK.add(f"WITH s AS ({_SRC}) SELECT concat('k', CAST(k AS STRING)) AS external_id, t AS city FROM s WHERE k % 5 > 0 AND k % 4 > 0 AND k % 7 > 0")
def restaurant_gate(t):
    """Portal rows of type H whose city code is the requested one."""
    rows = _records(t)["kfc"].withColumn("_k", F.substring("storecode", 2, 20).cast("long"))
    rows = rows.withColumn("typeCode", F.expr("CASE WHEN _k % 4 > 0 THEN 'H' WHEN _k % 8 = 0 THEN 'D' END")).withColumn("requestCityCode", F.expr("CASE WHEN _k % 7 > 0 THEN gbCityCode ELSE '310000' END"))
    return projections.get("kfc")(rows).select("external_id", "city")


@BOOK.add(f"WITH s AS ({_SRC}) SELECT k, concat('kfc-c', CAST(k AS STRING)) AS external_id, CASE k % 2 WHEN 0 THEN concat('KFC', n) ELSE concat('肯德基', n) END AS name, p AS province, CASE k % 4 WHEN 3 THEN NULL ELSE x END AS longitude, y AS latitude FROM s WHERE k % 6 > 0")
def older_list_aliases(t):
    """Rows of the older list under its other field names."""
    s = t.spark.sql(_SRC.replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=t.orders, customer=t.customer)
    rows = s.selectExpr("k", "concat(' ', CASE k % 2 WHEN 0 THEN 'KFC' ELSE '' END, n) AS name", "CASE WHEN k % 6 > 0 THEN concat(a, ' ') ELSE '  ' END AS address", "p AS province", "t AS city", "CAST(NULL AS STRING) AS storeCode", "concat('c', k) AS storeId", "CASE k % 4 WHEN 0 THEN CAST(x AS STRING) WHEN 1 THEN '-' END AS lng", "CASE k % 4 WHEN 1 THEN CAST(x AS STRING) END AS lon", "CASE k % 4 WHEN 2 THEN CAST(x AS STRING) END AS mapLng", "CAST(y AS STRING) AS y", "'' AS latitude")
    out = projections.get("kfc-list")(rows)
    return out.select(F.regexp_extract("external_id", r"(\d+)$", 1).cast("long").alias("k"), "external_id", "name", "province", "longitude", "latitude")


@BOOK.add("WITH c AS (SELECT city, count(*) AS n FROM location WHERE city IS NOT NULL GROUP BY 1) SELECT city, n, (row_number() OVER (ORDER BY n, city))::INT AS place FROM c WHERE city NOT IN ('上海市', '香港')")
def cities_small_first(t):
    counts = stats.count_by(t.location.where("city is not null"), "city")
    done = t.location.where(F.col("city").isin("上海市", "香港")).select("city")
    return stats.pending_small_first(counts, done)


_STATIC = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in (r[0], r[4], r[5], r[6], r[8])) + ")" for r in projections.STATIC_STORES)


@BOOK.add(f"SELECT s.external_id, s.district, s.x::DOUBLE AS longitude, coalesce(s.crs, 'WGS84') AS coordinate_system, count(l.id) AS stores FROM (VALUES {_STATIC}) s(external_id, city, district, x, crs) LEFT JOIN location l ON {city_sql('l.city')} = {city_sql('s.city')} GROUP BY ALL")
def static_stores(t):
    """The inline list, and how many locations are in each one's city."""
    own = projections.get("costco")(projections.static_stores(t.spark))
    n = t.location.groupBy(text.city(F.col("city")).alias("key")).agg(F.count("*").alias("n"))
    joined = own.join(n.hint("merge"), text.city(own.city) == n.key, "left")
    return joined.select("external_id", "district", "longitude", "coordinate_system", F.coalesce("n", F.lit(0)).alias("stores"))


@BOOK.add(f"SELECT id, name, chain_slug, city FROM ({FULL}) WHERE lng IS NOT NULL")
def geojson_release(t):
    """Two releases written, the older one of every other store; the newest is read, all chains."""
    path = storage.fresh_path(t.spark, "releases")
    export.write_release(_full(t).where("id % 2 = 0"), path)
    export.write_release(_full(t), path)
    return readers.read_release(t.spark, path).select("id", "name", "chain_slug", "city")


@BOOK.add("SELECT external_id, name, id FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seen_at::VARCHAR DESC, id DESC) AS rn FROM (SELECT external_id, seen_at, max(id) AS id, arg_max(name, id) AS name FROM location GROUP BY 1, 2)) WHERE rn = 1")
def city_files(t):
    """Stores saved as a folder of files a day; of an id the later file's store counts."""
    path = storage.fresh_path(t.spark, "city-files")
    one = stats.last_wins(t.location.select("external_id", "seen_at", "id", "name"), ["external_id", "seen_at"], ["id"])
    lines = one.select(F.col("seen_at").cast("string").alias("day"), F.to_json(F.struct(F.create_map("external_id", F.struct("id", "name")).alias("stores"))).alias("value"))
    lines.repartition("day").write.partitionBy("day").text(path)
    return readers.read_city_files(t.spark, path, "id long, name string")


@BOOK.add("SELECT id, name FROM location")
def saved_by_version(t):
    """A snapshot saved by this version, and one by another, which gives no row."""
    both = []
    for version in ("v2", "v1"):
        path = storage.fresh_path(t.spark, "saved")
        t.location.select(F.lit(version).alias("adapter_version"), F.struct("id", "name").alias("store")).write.json(path)
        both.append(readers.read_saved(t.spark, path, "v2", "id long, name string"))
    return both[0].unionByName(both[1])


@BOOK.add(f"SELECT e.slug, concat('{{\"id\":', e.id, ',\"name\":\"', c.name, '\",\"slug\":\"', e.slug, '\",\"category_slug\":\"', g.slug, '\",\"location_count\":', e.location_count, '}}') AS json FROM ({_EXPORT}) e JOIN chain c ON c.id = e.id JOIN category g ON g.id = c.category_id")
def chains_catalog_json(t):
    """The catalogue with names and categories."""
    totals = stats.chain_counts(t.chain, t.location, "export").join(t.category.select(F.col("id").alias("category_id"), F.col("slug").alias("category_slug")), "category_id")
    return export.json_rows(totals, "id", "name", "slug", "category_slug", "location_count").select("slug", "json")


@BOOK.add(f"SELECT 'loaded' AS kind, c.slug, count(*) AS n FROM ({FULL}) l JOIN chain c ON c.slug = l.chain_slug WHERE c.id % 5 > 0 AND l.id % 2 = 1 GROUP BY ALL UNION ALL SELECT 'skipped', chain_slug, count(*) FROM ({FULL}) WHERE chain_id % 5 = 0 AND id % 2 = 1 GROUP BY ALL")
def truncate_and_load(t):
    """A table loaded twice: only the second load is in it."""
    path = storage.fresh_path(t.spark, "table")
    known = t.chain.where("id % 5 > 0")
    upsert.truncate_and_load(_full(t).where("id % 2 = 0"), known, path)
    report = upsert.truncate_and_load(_full(t).where("id % 2 = 1"), known, path)
    loaded = upsert.read_loaded(t.spark, path).groupBy(F.col("chain_slug").alias("slug")).agg(F.count("*").alias("n"))
    return loaded.select(F.lit("loaded").alias("kind"), "slug", "n").union(report.select(F.lit("skipped"), "chain_slug", "skipped"))


@BOOK.add("SELECT city, count(*) AS rows, CASE WHEN city <> '台北市' THEN count(*) + (SELECT count(*) FROM location m WHERE m.city = l.city AND m.id % 3 > 0) END AS rows_before FROM location l WHERE city IS NOT NULL AND id % 3 = 0 GROUP BY 1")
def city_overwrite_stats(t):
    """Partitions written over, with the rows that each has and had."""
    path = storage.fresh_path(t.spark, "cities")
    export.write_by_with_stats(t.location.select("id", "city").where("city <> '台北市'"), path, "city")
    return export.write_by_with_stats(t.location.select("id", "city").where("id % 3 = 0"), path, "city")


_PAYLOAD = "concat('{\"id\":', k, ',\"name\":', to_json(n), ',\"address\":', to_json(a), ',\"longitude\":\"', CAST(y AS STRING), '\",\"latitude\":\"', CAST(x AS STRING), '\",\"format\":\"', CASE k % 2 WHEN 0 THEN 'life' ELSE 'market' END, '\",\"city\":', CASE k % 3 WHEN 0 THEN concat('\"', t, '\"') ELSE 'null' END, ',\"request_city\":\"北京\"}')"


@BOOK.add(f"WITH s AS ({_SRC}) SELECT concat('7fresh-', CASE k % 2 WHEN 0 THEN 'life' ELSE 'sm' END, '-', CAST(k AS STRING)) AS external_id, {_PAYLOAD} AS raw_payload, 'official' AS source_type, 'shops' AS source_url FROM s")
def raw_payloads(t):
    """Canonical rows that carry the whole source record."""
    rows = projections.audited(_records(t)["7fresh"], "official", "shops")
    return projections.get("7fresh")(rows).select("external_id", "raw_payload", "source_type", "source_url")


@BOOK.add("SELECT id, external_id, source_type, 'table' AS source_url, concat('{\"id\":', id, ',\"name\":', to_json(name), '}') AS raw_payload FROM location WHERE id = 33")
def raw_lookup(t):
    stored = t.location.select("id", "external_id", "source_type", F.lit("table").alias("source_url"), F.to_json(F.struct("id", "name")).alias("raw_payload"))
    return projections.raw_row(stored, 33)


@BOOK.add("SELECT event_id, CASE WHEN ts IS NOT NULL THEN concat(lpad(CAST(event_id % 24 AS STRING), 2, '0'), ':30-', lpad(CAST((event_id + 9) % 24 AS STRING), 2, '0'), ':00') END AS hours FROM events")
def opening_hours(t):
    clock = lambda h, rest: F.when(F.col("ts").isNotNull(), F.concat(F.lpad(F.expr(f"cast(({h}) % 24 as string)"), 2, "0"), F.lit(rest)))
    return t.events.select("event_id", projections.opening_hours(clock("event_id", ":30:00"), clock("event_id + 9", ":00:59")).alias("hours"))


_EVEN = lambda x: f"printf('%.4f', round_even({x}, 4))"


@BOOK.add(f"SELECT id, concat_ws(',', CASE WHEN lat IS NOT NULL THEN {_EVEN('lat')} END, CASE WHEN lng IS NOT NULL THEN {_EVEN('lng')} END, '0.2500') AS key FROM location")
def visited_keys(t):
    """Keys at four decimals with halves to the even digit, of all rows."""
    part = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", geo.round_half_even(F.col(c))))
    whole = geo.visited_key(F.col("lat"), F.col("lng"), F.lit(0.25))
    return t.location.select("id", F.when(F.col("lat").isNotNull(), whole).otherwise(F.concat_ws(",", part("lat"), part("lng"), F.lit("0.2500"))).alias("key"))


_GRID_HOLES = " OR ".join(f"(x BETWEEN {w} AND {e} AND y BETWEEN {s} AND {n})" for w, s, e, n in scope.GRID_OUT_BOXES)
_SCOPE_HOLES = " OR ".join(f"(x BETWEEN {w} AND {e} AND y BETWEEN {s} AND {n})" for w, s, e, n in scope.OUT_BOXES)


@BOOK.add(f"""WITH b AS (SELECT chain_id, floor(min(lng)) AS w, floor(min(lat)) AS s, ceil(max(lng)) AS e, ceil(max(lat)) AS n FROM location WHERE lng IS NOT NULL GROUP BY 1),
g AS (SELECT chain_id, s + 0.25 + i * 0.5 AS y, w + 0.25 + j * 0.5 AS x FROM b, range(200) a(i), range(200) c(j) WHERE i < (n - s) * 2 AND j < (e - w) * 2)
SELECT chain_id, count(*) AS none, count(*) FILTER (NOT ({_GRID_HOLES})) AS grid, count(*) FILTER (NOT ({_SCOPE_HOLES})) AS scope, round(max(x), 6) AS east FROM g GROUP BY 1""")
def lattice_of_chains(t):
    """Lattices over the box of every chain's stores, with no holes, the grid's and the scope's."""
    boxes = storage.materialise(tiling.chain_boxes(t.location), "boxes")
    kinds = [tiling.lattice_of(boxes, 0.5, k).select("chain_id", F.lit(k).alias("kind"), "lng") for k in ("none", "grid", "scope")]
    rows = kinds[0].union(kinds[1]).union(kinds[2])
    return rows.groupBy("chain_id").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("none", "grid", "scope")), F.round(F.max("lng"), 6).alias("east"))


def _tree_sql(split: str) -> str:
    return f"""WITH RECURSIVE p AS (SELECT lng - 73.0 AS x, lat - 18.0 AS y FROM location WHERE lng IS NOT NULL),
c AS (SELECT k AS level, floor(x / (8.0 / (1 << k)))::BIGINT AS x, floor(y / (8.0 / (1 << k)))::BIGINT AS y, count(*) AS n FROM p, range(4) r(k) GROUP BY 1, 2, 3),
a(level, x, y, n) AS (SELECT 0::BIGINT, x, y, n FROM c WHERE level = 0 UNION ALL
  SELECT a.level + 1, a.x * 2 + dx, a.y * 2 + dy, coalesce((SELECT n FROM c WHERE c.level = a.level + 1 AND c.x = a.x * 2 + dx AND c.y = a.y * 2 + dy), 0) FROM a, (VALUES (0), (1)) u(dx), (VALUES (0), (1)) v(dy) WHERE a.level < 3 AND {split})
SELECT level, x, y, n FROM a"""


@BOOK.add(_tree_sql("8.0 / (1 << a.level) > 1.5 AND (a.n > 0 OR 8.0 / (1 << a.level) > 3.0)"))
def quadtree_any(t):
    """Cells with any hit split, and large empty ones."""
    return tiling.quadtree(t.location, 73.0, 18.0, 8.0, 4, 12, "any", min_step=1.5, empty_min_step=3.0).withColumn("level", F.col("level").cast("long"))


@BOOK.add(_tree_sql("8.0 / (1 << a.level) > 1.0 AND (a.n >= 40 OR (a.n > 0 AND 8.0 / (1 << a.level) >= 8.0))"))
def quadtree_partial(t):
    """Saturated cells split, and first-level ones with any hit."""
    return tiling.quadtree(t.location, 73.0, 18.0, 8.0, 4, 40, "partial", min_step=1.0, first_step=8.0).withColumn("level", F.col("level").cast("long"))


@BOOK.add("SELECT r_name AS province, n_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey % 4 > 0")
def region_plan_city(t):
    """Every city whose own probe found something."""
    cities = t.nation.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("city"), (F.col("n_nationkey") % 4).alias("n"))).alias("cities"))
    probes = t.region.join(cities, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("province"), F.lit(0).alias("n"), "cities")
    return tiling.region_plan(probes, "city")


@BOOK.add("""WITH f AS (SELECT store, min(seq) AS seq FROM request_log GROUP BY 1),
n AS (SELECT (seq - 1) // 200 AS w, count(*) AS new_stores FROM f GROUP BY 1), r AS (SELECT (seq - 1) // 200 AS w, count(*) AS requests, arg_max(seq % 3, seq) AS queue FROM request_log GROUP BY 1),
c AS (SELECT r.w AS "window", requests, queue, coalesce(new_stores, 0) AS new_stores, (sum(coalesce(new_stores, 0)) OVER (ORDER BY r.w))::BIGINT AS store_count FROM r LEFT JOIN n USING (w)),
h AS (SELECT min("window") AS first FROM c WHERE requests = 200 AND store_count >= 100 AND new_stores < 199 AND queue <= 0)
SELECT "window", requests, new_stores, store_count, coalesce("window" = first, false) AS stop FROM c, h""")
def plateau_with_queue(t):
    """A window stops the search only while nothing is left in the queue."""
    log = stats.number_by(t.events, ["ts", "event_id"]).select("seq", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("store"), (F.col("seq") % 3).alias("queue"))
    return stats.plateau_windows(log, 200, 100, 199, queue="queue")


@BOOK.add("""WITH l AS (SELECT event_type AS kind, user_id % 50 AS store, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, length(event_type) * 5 AS target FROM events),
f AS (SELECT kind, store, min(seq) AS seq FROM l GROUP BY 1, 2),
n AS (SELECT kind, (seq - 1) // 40 AS w, count(*) AS new_stores FROM f GROUP BY 1, 2), r AS (SELECT kind, (seq - 1) // 40 AS w, count(*) AS requests, max(target) AS least FROM l GROUP BY 1, 2),
c AS (SELECT kind, r.w AS "window", requests, least, coalesce(new_stores, 0) AS new_stores, (sum(coalesce(new_stores, 0)) OVER (PARTITION BY kind ORDER BY r.w))::BIGINT AS store_count FROM r LEFT JOIN n USING (kind, w)),
h AS (SELECT kind, min("window") AS first FROM c WHERE requests = 40 AND store_count >= least AND new_stores < 1 GROUP BY 1)
SELECT kind, "window", requests, new_stores, store_count, coalesce("window" = first, false) AS stop FROM c LEFT JOIN h USING (kind)""")
def plateau_by_city(t):
    """The form for cities: windows of 40 requests without a new store, once the target is met."""
    log = stats.number_within(t.events, "event_type", ["ts", "event_id"]).select("seq", F.col("event_type").alias("kind"), (F.col("user_id") % 50).alias("store"), (F.length("event_type") * 5).alias("target"))
    return stats.plateau_windows(log, 40, "target", 1, by="kind")


@BOOK.add(f"SELECT id, lng AS x, lat AS y FROM ({_moved_sql('SELECT id, lng, lat FROM location', '+')})".replace("lng AS x, lat AS y", "round(lng, 6) AS x, round(lat, 6) AS y"))
def sql_to_gcj02(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT id, round(wgs84_to_gcj02(lng, lat).lng, 6) AS x, round(wgs84_to_gcj02(lng, lat).lat, 6) AS y FROM {l}", l=t.location)


@BOOK.add(f"SELECT id, round(lng, 6) AS x, round(lat, 6) AS y FROM ({wgs_sql()})")
def sql_to_wgs84(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT id, round(to_wgs84(lng, lat, coordinate_system).lng, 6) AS x, round(to_wgs84(lng, lat, coordinate_system).lat, 6) AS y FROM {l}", l=t.location)


@BOOK.add(f"""SELECT id, {city_sql('city')} AS city, substr(sha1(city), 1, 16) AS slug, concat_ws('|', coalesce(province, ''), coalesce(city, '')) AS key, nullif(concat(province, city, district), '') AS region,
CASE WHEN upper(name) LIKE '%KFC%' OR contains(name, '肯德基') THEN name ELSE concat('肯德基', name) END AS branded, coalesce(lng BETWEEN 100 AND 118 AND lat BETWEEN 22 AND 40, false) AS inside, CASE WHEN lng IS NOT NULL THEN printf('POINT(%.6f %.6f)', lng, lat) END AS wkt FROM location""")
def sql_text_functions(t):
    sql.register(t.spark)
    return t.spark.sql("SELECT id, city_name(city) AS city, short_digest(city) AS slug, city_key(province, city) AS key, join_region(province, city, district) AS region, branded(name, '肯德基', 'KFC') AS branded, coalesce(in_box(lng, lat, 100D, 22D, 118D, 40D), false) AS inside, point_wkt(lng, lat) AS wkt FROM {l}", l=t.location)


@BOOK.add("SELECT c.slug AS chain_slug, count(*) AS n FROM location l JOIN chain c ON c.id = l.chain_id GROUP BY 1")
def stream_dedup_watermark(t):
    """First-seen filtering with a watermark over two files that hold the same rows: each counts once."""
    landed, out = storage.fresh_path(t.spark, "landed"), storage.fresh_path(t.spark, "seen")
    rows = _full(t).select("chain_slug", "id", F.col("seen_at").cast("timestamp").alias("at"))
    for _ in range(2):
        rows.write.mode("append").parquet(landed)
    stream = streaming.first_seen_stream(t.spark.readStream.schema(rows.schema).parquet(landed), ["chain_slug", "id"], "at", "4000 days")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", storage.fresh_path(t.spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(rows.schema).parquet(out).groupBy("chain_slug").agg(F.count("*").alias("n"))


@BOOK.add(f"""WITH f AS (SELECT avg(lng) AS x, avg(lat) AS y FROM (SELECT lng, lat FROM location WHERE lng IS NOT NULL ORDER BY id LIMIT 1))
SELECT id, round(d, 3) AS distance_m FROM (SELECT id, {haversine_sql('lng', 'lat', 'x', 'y')} AS d FROM location, f) WHERE d <= 60000""")
def nearby_store(t):
    """Stores about the place of the first one."""
    from ..operators import search

    first = t.location.where("lng is not null").orderBy("id").select("lng", "lat").first()
    if first is None:
        return t.location.limit(0).select("id", F.lit(0.0).alias("distance_m"))
    return search.nearby(t.location, first.lng, first.lat, 60_000.0, limit=None).select("id", F.round("distance_m", 3).alias("distance_m"))


@BOOK.add("SELECT id, external_id, name, lng AS longitude FROM location")
def stored_as_source_all(t):
    return projections.get("stored")(t.location.withColumn("_source_url", F.col("id").cast("string"))).select(F.col("source_url").cast("long").alias("id"), "external_id", "name", "longitude")


@BOOK.add("SELECT id, CASE WHEN lng IS NOT NULL THEN 'Point' END AS type, round(lng, 9) AS x FROM location")
def point_geojson_all(t):
    own = t.location.select("id", F.from_json(geo.point_geojson(F.col("lng"), F.col("lat")), "type string, coordinates array<double>").alias("p"))
    return own.select("id", F.col("p.type").alias("type"), F.get("p.coordinates", F.lit(0)).alias("x"))


_EMBEDDED = "SELECT event_id AS page, 0::BIGINT AS pos, event_id AS id, 2::BIGINT AS deep, true AS even FROM events UNION ALL SELECT event_id, 1, -1, NULL, true FROM events WHERE event_id % 3 = 0"


@BOOK.add(_EMBEDDED)
def embedded_json_parts(t):
    """Embedded objects cut out whole: what lies deepest in them, and that their braces are as many on either side."""
    pages = t.events.select(F.col("event_id").alias("page_id"), F.expr(_SCRIPT).alias("html"))
    found = readers.embedded_json(pages)
    braces = lambda c: F.length("json") - F.length(F.replace("json", F.lit(c), F.lit("")))
    return found.select("page", F.col("pos").cast("long").alias("pos"), F.get_json_object("json", "$.id").cast("long").alias("id"), F.get_json_object("json", "$.in.a[1].b").cast("long").alias("deep"), (braces("{") == braces("}")).alias("even"))


@BOOK.add(_EMBEDDED)
def embedded_json_sql(t):
    """The same rows from SQL: a table function called for each page."""
    readers.register_embedded_json(t.spark, "embedded_objects")
    pages = t.events.select(F.col("event_id").alias("page"), F.expr(_SCRIPT).alias("html"))
    found = t.spark.sql("""SELECT p.page, CAST(o.pos AS BIGINT) AS pos, o.json, CAST(get_json_object(o.json, '$.id') AS BIGINT) AS id, CAST(get_json_object(o.json, '$.in.a[1].b') AS BIGINT) AS deep
        FROM {pages} p, LATERAL embedded_objects(p.html, "data_json:'") o""", pages=pages)
    braces = lambda c: F.length("json") - F.length(F.replace("json", F.lit(c), F.lit("")))
    return found.select("page", "pos", "id", "deep", (braces("{") == braces("}")).alias("even"))


@BOOK.add("SELECT id, chain_id, name, round(lng, 6) AS lng FROM location WHERE id % 3 > 0 AND id > 100")
def jdbc_load_and_scan(t):
    """Locations loaded into a database inside the driver's process, twice, and read back in ranges of their id."""
    url = f"jdbc:derby:{tempfile.mkdtemp(prefix='shopatlas-')}/{uuid.uuid4().hex};create=true"
    rows = t.location.select("id", "chain_id", "name", "lng")
    relational.load_table(rows.where("id % 3 = 0"), url, "stores", **DERBY)
    relational.load_table(rows.where("id % 3 > 0"), url, "stores", **DERBY)
    found = relational.scan_table(t.spark, url, "stores", "id", 4, **DERBY).where("id > 100")
    return found.select("id", "chain_id", "name", F.round("lng", 6).alias("lng"))
