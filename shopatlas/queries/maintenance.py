"""Resolution, upserts, reconciliation, gazetteer and tiling queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scope
from ..operators import canonical, reconcile, resolve, stats, tiling, upsert
from ..plans.storage import materialise
from .book import Book
from .functions import IDENTITY, LOCATED, city_sql, name_sql
from .search import FULL, haversine_sql

BOOK = Book()


@BOOK.add(f"""SELECT id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY k1, k2, k3, k4 ORDER BY len(coalesce(address, '')) DESC, len(coalesce(district, '')) DESC, len(coalesce(city, '')) DESC, id) AS rn FROM ({IDENTITY})) WHERE rn = 1""")
def richer_wins(t):
    return resolve.richer_wins(t.location, order="id").select("id", "external_id")


_NEAR = f"SELECT a.id AS a, b.id AS b FROM {LOCATED} a JOIN {LOCATED} b ON a.chain_id = b.chain_id AND a.cust = b.cust AND a.id <> b.id WHERE {haversine_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')} <= 50"


@BOOK.add(f"""WITH RECURSIVE e AS MATERIALIZED ({_NEAR}), r(a, b) AS (SELECT id, id FROM location UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1),
k AS (SELECT c.*, row_number() OVER (PARTITION BY cluster ORDER BY len(coalesce(address, '')) DESC, len(coalesce(district, '')) DESC, len(coalesce(city, '')) DESC, c.id) AS rn FROM c JOIN location l ON l.id = c.id)
SELECT id, cluster, rn = 1 AS keep FROM k""")
def dedupe_clusters(t):
    return resolve.duplicate_clusters(located(t))


@BOOK.add()
def dedupe_greedy(t):
    """The greedy mode depends on the order of its own steps, which SQL cannot replay."""
    return resolve.duplicate_clusters(located(t), mode="greedy")


@BOOK.add(f"""WITH RECURSIVE e AS MATERIALIZED ({_NEAR}), r(a, b) AS (SELECT id, id FROM location UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS id, min(b) AS cluster FROM r GROUP BY 1), k AS (SELECT l.chain_id, row_number() OVER (PARTITION BY cluster ORDER BY len(coalesce(address, '')) DESC, len(coalesce(district, '')) DESC, len(coalesce(city, '')) DESC, c.id) AS rn FROM c JOIN location l ON l.id = c.id)
SELECT chain_id, count(*) AS deleted FROM k WHERE rn > 1 GROUP BY 1""")
def dedupe_deleted(t):
    return resolve.deleted_by_chain(t.location, resolve.duplicate_clusters(located(t)))


def located(t):
    """Locations with WGS-84 coordinates, written: else the conversion is repeated inside every distance.

    They are dealt out first, as a table of few row groups would be converted by few tasks.
    """
    return materialise(geo.with_wgs84(t.location.repartition("id")), "located")


def _halves(t):
    rows = located(t)
    old, new = rows.where("id % 4 = 0"), rows.where("id % 4 <> 0").withColumn("ordinal", F.col("id"))
    return old.withColumn("external_id", F.concat(F.lit("s"), F.col("id").cast("string"))), new.withColumn("external_id", F.concat(F.lit("b"), F.col("id").cast("string")))


_POOL = f"SELECT id, chain_id, cust, lng, lat, CASE WHEN id % 4 = 0 THEN concat('s', CAST(id AS STRING)) ELSE concat('b', CAST(id AS STRING)) END AS e, CASE WHEN id % 4 = 0 THEN -1 ELSE id END AS o, 0 AS run FROM {LOCATED}"


def resolved_sql(pool: str) -> str:
    """id, o, external_id of the batch rows (o >= 0) of a pool (id, chain_id, cust, lng, lat, e, o, run), taken one after another.

    Each store (chain and customer) walks through its own rows: ``rows`` is what the table holds of it (rows of
    earlier runs in the order of their ids, then those of this run as they came), ``seen`` the cells met.
    """
    near = haversine_sql("q.lng", "q.lat", "s.lng", "s.lat")
    return f"""WITH RECURSIVE pool AS MATERIALIZED (SELECT *, round(lng, 4) AS cx, round(lat, 4) AS cy, row_number() OVER (PARTITION BY chain_id, cust ORDER BY o, e) AS k FROM ({pool}) WHERE lng IS NOT NULL),
walk AS (SELECT DISTINCT chain_id, cust, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS o, NULL::VARCHAR AS x, []::STRUCT(n BIGINT, run BIGINT, e VARCHAR, lng DOUBLE, lat DOUBLE)[] AS rows, []::STRUCT(cx DOUBLE, cy DOUBLE, run BIGINT, e VARCHAR)[] AS seen FROM pool
  UNION ALL SELECT chain_id, cust, k, CASE WHEN o >= 0 THEN id END, o, x,
    list_append(list_filter(rows, lambda q: q.e <> x), struct_pack(n := coalesce(list_filter(rows, lambda q: q.e = x)[1].n, k), run := coalesce(list_filter(rows, lambda q: q.e = x)[1].run, run), e := x, lng := lng, lat := lat)),
    CASE WHEN o >= 0 THEN list_append(seen, struct_pack(cx := cx, cy := cy, run := run, e := x)) ELSE seen END
  FROM (SELECT s.*, CASE WHEN s.o < 0 THEN s.e ELSE coalesce(list_filter(s.seen, lambda c: c.cx = s.cx AND c.cy = s.cy AND c.run = s.run)[1].e, list_sort(list_transform(list_filter(s.rows, lambda q: {near} <= 50), lambda q: struct_pack(n := CASE WHEN q.run = s.run THEN q.n ELSE 0 END, e := q.e)))[1].e, s.e) END AS x
    FROM (SELECT p.*, w.rows, w.seen FROM walk w JOIN pool p ON p.chain_id = w.chain_id AND p.cust = w.cust AND p.k = w.k + 1) s))
SELECT id, o, x AS external_id FROM walk WHERE id IS NOT NULL"""


@BOOK.add(f"SELECT id, external_id FROM ({resolved_sql(_POOL)})" + f" UNION ALL SELECT id, e FROM ({_POOL}) WHERE o >= 0 AND lng IS NULL")
def resolve_ids(t):
    old, new = _halves(t)
    return canonical.canonical_ids(old, new).select("id", "external_id")


@BOOK.add("""WITH n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, external_id ORDER BY id DESC) AS rn FROM location WHERE id % 3 > 0) WHERE rn = 1),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, external_id ORDER BY id) AS rn FROM location WHERE id % 3 = 0) WHERE rn = 1)
SELECT coalesce(n.chain_id, o.chain_id) AS chain_id, coalesce(n.external_id, o.external_id) AS external_id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN n.address ELSE o.address END AS address, coalesce(o.seen_at, n.seen_at) AS created_at
FROM o FULL JOIN n ON n.chain_id = o.chain_id AND n.external_id = o.external_id""")
def upsert_locations(t):
    base = t.location.withColumns({"created_at": F.col("seen_at"), "ordinal": F.col("id")})
    old = stats.first_seen(base.where("id % 3 = 0"), ["chain_id", "external_id"], ["id"])
    return upsert.upsert(old, base.where("id % 3 > 0"), ["chain_id", "external_id"], ["name", "address"], ["created_at"])


@BOOK.add("""SELECT coalesce(a.slug, b.slug) AS slug, coalesce(a.name, b.name) AS name, CASE WHEN b.slug IS NOT NULL THEN b.category_id ELSE a.category_id END AS category_id
FROM (SELECT * FROM chain WHERE id % 3 > 0) a FULL JOIN (SELECT slug, concat(name, '!') AS name, 9 AS category_id FROM chain WHERE id % 2 = 0) b ON a.slug = b.slug""")
def seed_upsert(t):
    old = t.chain.where("id % 3 > 0").select("slug", "name", "category_id")
    seeds = t.chain.where("id % 2 = 0").select("slug", F.concat("name", F.lit("!")).alias("name"), F.lit(9).alias("category_id"))
    return upsert.seed_upsert(old, seeds)


@BOOK.add("SELECT id, CASE slug WHEN 'asia' THEN 'orient' ELSE slug END AS slug FROM category UNION ALL SELECT NULL, 'polar'")
def rename_value(t):
    own = upsert.rename_value(t.category.select("id", "slug"), "slug", "asia", "orient")
    return upsert.rename_value(own, "slug", "no such", "polar")


@BOOK.add("SELECT id, source_type FROM location WHERE source_type IS DISTINCT FROM 'poi'")
def delete_source_type(t):
    return upsert.delete_where(t.location, F.col("source_type") == "poi")[0].select("id", "source_type")


@BOOK.add("SELECT count(*) AS deleted FROM location WHERE source_type = 'poi'")
def delete_count(t):
    return upsert.delete_where(t.location, F.col("source_type") == "poi")[1]


@BOOK.add("""WITH c AS (SELECT id, slug, id * 10 AS n FROM chain WHERE id % 3 > 0), r AS (SELECT slug, id * 100 AS n FROM chain WHERE id % 2 = 0)
SELECT coalesce(c.id, (SELECT max(id) FROM c) + row_number() OVER (PARTITION BY c.id IS NULL ORDER BY coalesce(c.slug, r.slug))) AS id, coalesce(c.slug, r.slug) AS slug, coalesce(r.n, c.n) AS location_count FROM c FULL JOIN r ON c.slug = r.slug""")
def chain_row_upsert(t):
    old = t.chain.where("id % 3 > 0").select(F.col("id").cast("long").alias("id"), "slug", (F.col("id") * 10).alias("location_count"))
    return upsert.chain_row_upsert(old, t.chain.where("id % 2 = 0").select("slug", (F.col("id") * 100).alias("location_count")))


@BOOK.add("SELECT count(DISTINCT external_id) AS added FROM location WHERE id % 3 > 0 AND external_id NOT IN (SELECT external_id FROM location WHERE id % 3 = 0)")
def added_ids(t):
    return upsert.added_ids(t.location.where("id % 3 = 0"), t.location.where("id % 3 > 0"), "external_id")


@BOOK.add(f"SELECT l.id, c.id AS target_chain_id FROM ({FULL}) l JOIN chain c ON c.slug = l.chain_slug WHERE c.id % 5 > 0")
def slug_map(t):
    from .search import _full

    return upsert.copy_with_skips(_full(t), t.chain.where("id % 5 > 0"))[0].select("id", "target_chain_id")


@BOOK.add(f"SELECT chain_slug, count(*) AS skipped FROM ({FULL}) WHERE chain_id % 5 = 0 GROUP BY 1")
def copy_with_skips(t):
    from .search import _full

    return upsert.copy_with_skips(_full(t), t.chain.where("id % 5 > 0"))[1]


_OBS = f"SELECT DISTINCT {city_sql('city')} AS kc, {name_sql('name')} AS kn FROM location"
_REF = f"SELECT city, name, {city_sql('city')} AS kc, {name_sql('name')} AS kn FROM disclosure"


@BOOK.add(f"SELECT city, name FROM ({_REF}) r WHERE EXISTS (SELECT 1 FROM ({_OBS}) o WHERE o.kc = r.kc AND o.kn = r.kn)")
def disclosure_matched(t):
    return reconcile.matched(t.disclosure, t.location)


@BOOK.add(f"SELECT city, name FROM ({_REF}) r WHERE NOT EXISTS (SELECT 1 FROM ({_OBS}) o WHERE o.kc = r.kc AND o.kn = r.kn)")
def disclosure_unmatched(t):
    return reconcile.unmatched(t.disclosure, t.location)


@BOOK.add(f"SELECT count(*) AS total, count(o.kc) AS matched, count(*) - count(o.kc) AS unmatched FROM ({_REF}) r LEFT JOIN ({_OBS}) o ON o.kc = r.kc AND o.kn = r.kn")
def disclosure_totals(t):
    return reconcile.match_totals(t.disclosure, t.location)


@BOOK.add(f"SELECT kc AS city_key, count(DISTINCT kn) AS keys FROM ({_REF}) GROUP BY 1")
def keys_by_city(t):
    return reconcile.keys_by_city(t.disclosure)


@BOOK.add(f"SELECT city, count(*) FILTER (o.kc IS NULL) AS missing, count(*) FILTER (o.kc IS NULL) = 0 AS complete FROM (SELECT DISTINCT city, kc, kn FROM ({_REF})) r LEFT JOIN ({_OBS}) o ON o.kc = r.kc AND o.kn = r.kn GROUP BY 1")
def city_complete(t):
    return reconcile.complete_cities(t.disclosure, t.location)


_SECOND = "SELECT DISTINCT city, concat(CASE c_custkey % 3 WHEN 0 THEN '麦当劳' ELSE '' END, name) AS name FROM (SELECT d.city, d.name, CAST(substr(d.name, 11, 9) AS BIGINT) AS c_custkey FROM disclosure d) WHERE c_custkey % 4 > 0"


@BOOK.add(f"""SELECT u.city, u.name, CASE WHEN bool_or(g.name = u.name) THEN u.name ELSE concat('麦当劳', u.name) END AS found_name FROM (SELECT city, name, kc FROM ({_REF}) r WHERE NOT EXISTS (SELECT 1 FROM ({_OBS}) o WHERE o.kc = r.kc AND o.kn = r.kn)) u
JOIN (SELECT {city_sql('city')} AS kc, name FROM ({_SECOND})) g ON g.kc = u.kc AND g.name IN (u.name, concat('麦当劳', u.name)) GROUP BY 1, 2""")
def gap_fill(t):
    second = t.spark.sql(_SECOND.replace("FROM disclosure d", "FROM {d} d"), d=t.disclosure)
    return reconcile.gap_fill(t.disclosure, t.location, second, "麦当劳")


_OK = "level IN ('门牌号', '兴趣点', '道路', '道路交叉路口', '村庄', '热点商圈') OR coalesce(level, '') = ''"
_BEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY seq) AS rn FROM gazetteer WHERE {_OK}) WHERE rn = 1"


@BOOK.add(f"SELECT l.id, g.lng AS hit_lng, CASE WHEN g.level IN ('门牌号', '道路') THEN 0.9 WHEN g.level = '村庄' THEN 0.7 END::DOUBLE AS confidence, 'amap' AS provider FROM (SELECT id, concat('香港中路', CAST(id % 400 AS STRING), '号') AS address FROM location) l LEFT JOIN ({_BEST}) g USING (address)")
def gazetteer_lookup(t):
    asked = t.location.select("id", F.concat(F.lit("  香港中路"), (F.col("id") % 400).cast("string"), F.lit("号 ")).alias("address"))
    found = reconcile.lookup(asked, t.gazetteer)
    return found.select("id", F.col("hit.lng").alias("hit_lng"), F.col("hit.confidence").cast("double").alias("confidence"), "provider")


_ASK = """SELECT id, CASE id % 4 WHEN 0 THEN concat('香港中路', CAST(id % 90 AS STRING), '号、三楼') WHEN 1 THEN '无此路1号' WHEN 2 THEN NULL ELSE concat('香港中路', CAST(id % 90 AS STRING), '号') END AS address,
CASE id % 3 WHEN 0 THEN '杭州市' WHEN 1 THEN '广州' END AS city, CASE id % 5 WHEN 0 THEN '' WHEN 1 THEN concat('店', CAST(id % 40 AS STRING)) ELSE name END AS name, CAST(NULL AS STRING) AS province, CAST(NULL AS STRING) AS district, lng, lat, coordinate_system FROM location"""
_POI = "SELECT concat('店', CAST(seq AS STRING)) AS name, city, lng + 1 AS lng, lat + 1 AS lat, '天河区' AS district, address FROM gazetteer"
_CENTRES = "SELECT '杭州' AS city, 120.0::DOUBLE AS lng, 30.0::DOUBLE AS lat UNION ALL SELECT '广州', 113.0::DOUBLE, 23.0::DOUBLE"


def _cascade_sql() -> str:
    g = f"(SELECT address AS what, coalesce(city, '') AS city, lng, lat, address AS formatted FROM gazetteer WHERE {_OK})"
    p = f"(SELECT name AS what, coalesce(city, '') AS city, lng, lat, concat(district, address) AS formatted FROM ({_POI}))"
    towns = "SELECT id, 0 AS c, regexp_replace(city, '市$', '') AS city FROM a WHERE city IS NOT NULL UNION ALL SELECT id, 9, '' FROM a"
    first = lambda side: f"SELECT what, city, min(struct_pack(lng := lng, lat := lat, formatted := formatted)) AS h FROM {side} GROUP BY 1, 2"
    return f"""WITH a AS ({_ASK}), towns AS ({towns}),
w AS (SELECT id, 0 AS stage, 0 AS p, address AS what FROM a WHERE address IS NOT NULL UNION ALL SELECT id, 0, 1, regexp_replace(address, '[、，／/].*', '') FROM a WHERE address LIKE '%、%'
  UNION ALL SELECT id, 0, 2, city FROM a WHERE city IS NOT NULL UNION ALL SELECT id, 1, 3, name FROM a WHERE name <> ''),
h AS (SELECT w.id, stage, p, c, h FROM w JOIN towns USING (id) JOIN ({first(g)}) k ON stage = 0 AND k.what = w.what AND k.city = towns.city
  UNION ALL SELECT w.id, stage, p, c, h FROM w JOIN towns USING (id) JOIN ({first(p)}) k ON stage = 1 AND k.what = w.what AND k.city = towns.city
  UNION ALL SELECT towns.id, 2, 0, c, struct_pack(lng := z.lng, lat := z.lat, formatted := NULL::VARCHAR) FROM towns JOIN ({_CENTRES}) z ON z.city = towns.city),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stage, p, c) AS rn FROM h)
SELECT id, stage, h.lng AS lng, h.lat AS lat, h.formatted AS formatted FROM b WHERE rn = 1"""


def _cascaded(t):
    asked = t.spark.sql(_ASK.replace("FROM location", "FROM {location}"), location=t.location)
    pois = t.spark.sql(_POI.replace("FROM gazetteer", "FROM {gazetteer}"), gazetteer=t.gazetteer)
    centres = t.spark.sql("SELECT '杭州' AS city, 120D AS lng, 30D AS lat UNION ALL SELECT '广州', 113D, 23D")
    return asked, reconcile.cascade(asked, t.gazetteer, pois, centres)


@BOOK.add(_cascade_sql())
def geocode_cascade(t):
    return _cascaded(t)[1]


@BOOK.add(f"""WITH hits AS (SELECT id, 1.5::DOUBLE AS lng, 2.5::DOUBLE AS lat, CASE id % 3 WHEN 0 THEN 'x?' ELSE '好地址' END AS formatted FROM location WHERE id % 2 = 0),
d AS (SELECT id, lng, lat, coordinate_system, CASE id % 5 WHEN 0 THEN address || '?' ELSE address END AS address, name FROM location)
SELECT d.id, CASE WHEN u THEN 1.5 ELSE d.lng END AS lng, CASE WHEN u THEN 2.5 ELSE d.lat END AS lat, CASE WHEN u THEN 'WGS84' ELSE coordinate_system END AS coordinate_system,
CASE WHEN u AND contains(address, '?') AND NOT contains(f, '?') THEN f ELSE address END AS address FROM (SELECT d.*, h.formatted AS f, d.lng IS NULL AND coalesce(d.address, '') <> '' AND h.id IS NOT NULL AS u FROM d LEFT JOIN hits h ON h.id = d.id) d""")
def enrich_merge(t):
    hits = t.location.where("id % 2 = 0").select("id", F.lit(1.5).alias("lng"), F.lit(2.5).alias("lat"), F.expr("CASE id % 3 WHEN 0 THEN 'x?' ELSE '好地址' END").alias("formatted"))
    own = t.location.select("id", "lng", "lat", "coordinate_system", F.expr("CASE id % 5 WHEN 0 THEN concat(address, '?') ELSE address END").alias("address"), "name")
    return reconcile.enrich(own, hits).drop("name")


@BOOK.add("SELECT l.id, coalesce(l.city, c.city) AS city FROM location l LEFT JOIN (SELECT n_nationkey AS chain_id, n_name AS city FROM nation WHERE n_nationkey % 2 = 0) c USING (chain_id) WHERE coalesce(l.city, c.city) IS NOT NULL")
def city_complete_from_cache(t):
    cache = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("chain_id"), F.col("n_name").alias("cached"))
    return t.location.join(cache, "chain_id", "left").select("id", F.coalesce("city", "cached").alias("city")).where("city is not null")


@BOOK.add("SELECT c.city, count(l.id) AS stores FROM city_center c LEFT JOIN location l ON l.lng BETWEEN c.lng - CASE WHEN c.city IN ('NATION_3', 'NATION_5') THEN 0.35 ELSE 0.18 END AND c.lng + CASE WHEN c.city IN ('NATION_3', 'NATION_5') THEN 0.35 ELSE 0.18 END AND l.lat BETWEEN c.lat - CASE WHEN c.city IN ('NATION_3', 'NATION_5') THEN 0.35 ELSE 0.18 END AND c.lat + CASE WHEN c.city IN ('NATION_3', 'NATION_5') THEN 0.35 ELSE 0.18 END GROUP BY 1")
def city_box_counts(t):
    return tiling.box_counts(t.location, tiling.city_boxes(t.city_center, ("NATION_3", "NATION_5")))


_NEAR_CITY = "SELECT c.city, count(l.id) AS stores FROM city_center c LEFT JOIN location l ON l.lng BETWEEN c.lng - CASE WHEN c.city IN ('NATION_9') THEN 0.35 ELSE 0.18 END AND c.lng + CASE WHEN c.city IN ('NATION_9') THEN 0.35 ELSE 0.18 END AND l.lat BETWEEN c.lat - CASE WHEN c.city IN ('NATION_9') THEN 0.35 ELSE 0.18 END AND c.lat + CASE WHEN c.city IN ('NATION_9') THEN 0.35 ELSE 0.18 END GROUP BY 1"


@BOOK.add(f"SELECT city, stores, row_number() OVER (ORDER BY CASE city WHEN 'NATION_7' THEN 0 WHEN 'NATION_2' THEN 1 WHEN 'NATION_9' THEN 3 ELSE 102 END, stores DESC, city) AS place FROM ({_NEAR_CITY})")
def city_order(t):
    """The place of each city: by list, stores near it, and name."""
    return tiling.city_order(t.city_center.select("city", "lng", "lat"), t.location, ["NATION_7", "NATION_2"], ["NATION_9"]).select("city", "stores", "place")


_BOXES = " UNION ALL ".join(f"SELECT '{k}' AS box, {w}::DOUBLE AS w, {s}::DOUBLE AS s, {e}::DOUBLE AS e, {n}::DOUBLE AS n" for k, (w, s, e, n) in (scope.REGION_BOXES | scope.GAP_BOXES).items())


@BOOK.add(f"SELECT id, box FROM location JOIN ({_BOXES}) b ON lng BETWEEN w AND e AND lat BETWEEN s AND n")
def region_membership(t):
    return tiling.region_membership(t.location, scope.REGION_BOXES | scope.GAP_BOXES).select("id", "box")


@BOOK.add("SELECT city, CASE city WHEN 'NATION_7' THEN 0 WHEN 'NATION_2' THEN 1 WHEN 'NATION_9' THEN 3 ELSE 102 END::BIGINT AS rank FROM city_center")
def city_priority(t):
    out = tiling.city_priority(t.city_center, ["NATION_7", "NATION_2"], ["NATION_9"])
    return out.orderBy("rank", F.desc("expected"), F.collate("city", "zh")).select("city", F.col("rank").cast("long").alias("rank"))


_LAT = "SELECT i, j, ({s} + 0.25 + i * 0.5)::DOUBLE AS lat, ({w} + 0.25 + j * 0.5)::DOUBLE AS lng FROM range({ny}) a(i), range({nx}) b(j)"


@BOOK.add(f"""SELECT n_nationkey AS k, count(*) AS cells, round(min(lat), 6) AS south, round(max(lng), 6) AS east FROM nation JOIN ({_LAT.format(s='18.0', w='112.0', ny=20, nx=22)}) ON (i + j) % 25 = n_nationkey
WHERE NOT ((lng >= 120 AND lat BETWEEN 21.9 AND 25.35) OR (lng BETWEEN 119.3 AND 119.85 AND lat BETWEEN 23 AND 23.8) OR (lng BETWEEN 113.5 AND 113.6 AND lat BETWEEN 22.08 AND 22.22)) GROUP BY 1""")
def lattice(t):
    cells = tiling.lattice(t.spark, 112.0, 18.0, 123.0, 28.0, 0.5, "scope").withColumn("k", (F.col("i") + F.col("j")) % 25)
    own = t.nation.select(F.col("n_nationkey").alias("k"))
    return own.join(cells.hint("merge"), "k").groupBy("k").agg(F.count("*").alias("cells"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lng"), 6).alias("east"))


@BOOK.add("SELECT city, i, j, round(lat + i * (5 / 111.0), 6) AS point_lat, round(lng + j * (5 / (111.0 * greatest(cos(radians(lat)), 0.2))), 6) AS point_lng FROM city_center, range(-4, 5) a(i), range(-4, 5) b(j)")
def km_lattice(t):
    out = tiling.km_lattice(t.city_center, 20.0, 5.0)
    return out.select("city", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("point_lat", 6).alias("point_lat"), F.round("point_lng", 6).alias("point_lng"))


@BOOK.add("""SELECT round(y, 4) AS lat, round(x, 4) AS lng, 0.25::DOUBLE AS step, count(*) AS n FROM (SELECT floor((lat + a * 0.125) * 10000 + 0.5) / 10000 AS y, floor((lng + b * 0.125) * 10000 + 0.5) / 10000 AS x FROM city_center, (VALUES (-1), (1)) p(a), (VALUES (-1), (1)) q(b))
WHERE NOT ((x BETWEEN 113.5 AND 113.6 AND y BETWEEN 22.08 AND 22.22) OR (x BETWEEN 113.83 AND 114.45 AND y BETWEEN 22.1 AND 22.45) OR (x BETWEEN 119.3 AND 122.1 AND y BETWEEN 21.9 AND 25.4)) AND x BETWEEN 80 AND 130 AND y BETWEEN 18 AND 50 GROUP BY 1, 2""")
def quad_split(t):
    cells = t.city_center.select("lat", "lng", F.lit(0.5).alias("step"))
    out = tiling.quad_split(cells, (80.0, 18.0, 130.0, 50.0))
    return out.groupBy(F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "step").agg(F.count("*").alias("n"))


@BOOK.add("""WITH RECURSIVE p AS (SELECT lng - 73.0 AS x, lat - 18.0 AS y FROM location WHERE lng IS NOT NULL),
c AS (SELECT k AS level, floor(x / (8.0 / (1 << k)))::BIGINT AS x, floor(y / (8.0 / (1 << k)))::BIGINT AS y, count(*) AS n FROM p, range(4) r(k) GROUP BY 1, 2, 3),
a(level, x, y, n) AS (SELECT 0::BIGINT, x, y, n FROM c WHERE level = 0 UNION ALL
  SELECT a.level + 1, a.x * 2 + dx, a.y * 2 + dy, coalesce((SELECT n FROM c WHERE c.level = a.level + 1 AND c.x = a.x * 2 + dx AND c.y = a.y * 2 + dy), 0) FROM a, (VALUES (0), (1)) u(dx), (VALUES (0), (1)) v(dy) WHERE a.level < 3 AND a.n >= 12)
SELECT level, x, y, n FROM a""")
def quadtree_tiles(t):
    return tiling.quadtree(t.location, 73.0, 18.0, 8.0, 4, 12).withColumn("level", F.col("level").cast("long"))


_PROBE = "SELECT n_name AS province, n_nationkey * 90 AS n, n_nationkey % 3 AS k FROM nation"


@BOOK.add(f"""SELECT province, CASE WHEN n >= 1000 AND k > 0 THEN concat(province, '_', CAST(i AS STRING)) ELSE province END AS region FROM ({_PROBE}), range(2) r(i) WHERE n > 0 AND (i < 1 OR (n >= 1000 AND k > 1))""")
def region_plan(t):
    cities = F.transform(F.when(F.expr("n_nationkey % 3 > 0"), F.sequence(F.lit(0), F.expr("n_nationkey % 3 - 1"))).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.concat_ws("_", F.col("n_name"), i.cast("string")).alias("city"), i.alias("n")))
    probes = t.nation.select(F.col("n_name").alias("province"), (F.col("n_nationkey") * 90).alias("n"), cities.alias("cities"))
    return tiling.region_plan(probes)


@BOOK.add("SELECT city, greatest(600, 150 * expected)::BIGINT AS city_budget, greatest(400, 12 * (expected // greatest(size_class, 1)))::BIGINT AS district_budget FROM city_center")
def city_budget(t):
    out = tiling.budgets(t.city_center.select("city", F.col("expected").alias("targets"), F.col("size_class").alias("districts")))
    return out.select("city", F.col("city_budget").cast("long").alias("city_budget"), F.col("district_budget").cast("long").alias("district_budget"))


