"""Box, radius and text queries, thinning, counts and pages."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scope
from ..operators import layout, pyramid, stats
from ..operators import search as ops
from ..plans.storage import fresh_path, materialise
from .book import Book, Tables
from .functions import LOCATED

BOOK = Book()
BOX = (100.0, 22.0, 118.0, 40.0)
_W, _S, _E, _N = BOX
NOT_OUT = "NOT coalesce(regexp_matches(province, '^(台湾|台灣|香港|澳门|澳門)'), false) AND NOT coalesce(regexp_matches(city, '^(台湾|台灣|香港|澳门|澳門)'), false)"
IN_BOX = f"lng BETWEEN {_W} AND {_E} AND lat BETWEEN {_S} AND {_N}"
FULL = "SELECT l.*, c.slug AS chain_slug, g.slug AS category_slug FROM location l JOIN chain c ON c.id = l.chain_id JOIN category g ON g.id = c.category_id"
ROW = "id, name, address, city, chain_slug, category_slug"


def _full(t: Tables):
    return ops.with_chain(t.location, t.chain, t.category)


def _row(df):
    return df.select("id", "name", "address", "city", "chain_slug", "category_slug")


def _parts(df):
    shape = "id long, geometry struct<coordinates: array<double>>, properties struct<name: string, chain_slug: string, category_slug: string, address: string, city: string>"
    f = df.select(F.from_json("feature", shape).alias("f"))
    return f.select("f.id", F.get("f.geometry.coordinates", F.lit(0)).alias("x"), F.get("f.geometry.coordinates", F.lit(1)).alias("y"), "f.properties.*")


@BOOK.add(f"SELECT id, round(lng, 9) AS x, round(lat, 9) AS y, name, chain_slug, category_slug, address, city FROM ({FULL}) WHERE {IN_BOX} AND {NOT_OUT}")
def bbox_geojson(t):
    """Features of a box, read back from their GeoJSON text."""
    return _parts(ops.features(ops.in_bbox(_full(t), *BOX)))


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE {IN_BOX} AND {NOT_OUT} AND category_slug IN ('asia', 'europe') AND chain_slug IN ('nation_1', 'nation_2', 'nation_3', 'nation_8')")
def bbox_filtered(t):
    return _row(ops.in_bbox(_full(t), *BOX, categories=" asia, europe,", chains="nation_1,nation_2,nation_3 ,nation_8"))


@BOOK.add(f"SELECT count(*) AS n FROM location WHERE {IN_BOX} AND {NOT_OUT}")
def bbox_count(t):
    return ops.in_bbox(t.location, *BOX).agg(F.count("*").alias("n"))


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE {IN_BOX} AND {NOT_OUT} ORDER BY id LIMIT 500")
def bbox_capped(t):
    """A capped page: the cap is the feature."""
    return _row(ops.in_bbox(_full(t), *BOX).orderBy("id").limit(500))


_STEP = geo.thinning_step(*BOX, 400)


@BOOK.add(f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY floor(lng / {_STEP} + 0.5), floor(lat / {_STEP} + 0.5) ORDER BY id) AS rn FROM ({FULL}) WHERE {IN_BOX} AND {NOT_OUT}) WHERE rn = 1")
def bbox_thinned_round(t):
    return _row(ops.thin_by_cell(ops.in_bbox(_full(t), *BOX), _STEP))


@BOOK.add(f"""SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY chain_slug ORDER BY id) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY chain_slug, floor(lng / {_STEP}), floor(lat / {_STEP}) ORDER BY id) AS rn FROM ({FULL}) WHERE {IN_BOX}) WHERE rn = 1) WHERE k <= 30""")
def bbox_thinned_floor(t):
    inside = _full(t).where(geo.in_box(F.col("lng"), F.col("lat"), *BOX))
    return _row(ops.thin_by_cell(inside, _STEP, "floor", by=("chain_slug",), most=30))


@BOOK.add(f"SELECT id, chain_slug, row_number() OVER (PARTITION BY chain_slug ORDER BY id) AS rn FROM ({FULL})")
def interleave_chains(t):
    return ops.chain_rank(_full(t)).select("id", "chain_slug", "rn")


@BOOK.add(f"""
WITH RECURSIVE c AS (SELECT chain_slug AS k, count(*) AS n FROM ({FULL}) GROUP BY 1),
q(k, n, turn) AS (SELECT k, n, 0 FROM c UNION ALL
  SELECT k, CASE WHEN total > 200 THEN greatest(1, floor(n * (200 / total::DOUBLE)))::BIGINT ELSE n END, turn + 1 FROM (SELECT *, sum(n) OVER () AS total FROM q) WHERE turn < 12),
f AS (SELECT k, n FROM q WHERE turn = 12),
r AS (SELECT id, chain_slug, row_number() OVER (PARTITION BY chain_slug ORDER BY id) AS rn FROM ({FULL}))
SELECT id, chain_slug, rn FROM r JOIN f ON k = chain_slug AND rn <= n ORDER BY rn, chain_slug LIMIT 200""")
def cap_combined(t):
    return ops.cap_combined(_full(t), 200).select("id", "chain_slug", "rn")


_BOXES = {"whole": (100.0, 22.0, 118.0, 40.0, 50_000), "thinned": (100.0, 22.0, 118.0, 40.0, 300), "tight": (73.0, 18.0, 136.0, 54.0, 900)}


def _box_sql(name):
    w, s, e, n, most = _BOXES[name]
    step = geo.thinning_step(w, s, e, n, most)
    inside = f"SELECT *, count(*) OVER () AS total, row_number() OVER (PARTITION BY floor(lng / {step} + 0.5), floor(lat / {step} + 0.5) ORDER BY id) AS rn FROM ({FULL}) WHERE lng BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n} AND {NOT_OUT}"
    return f"SELECT '{name}' AS box, {ROW} FROM ({inside}) WHERE total <= {most} OR rn = 1"


@BOOK.add(" UNION ALL ".join(map(_box_sql, _BOXES)))
def bbox_count_then_choose(t):
    """Three boxes, each counted first: one whole, two thinned by steps of their own."""
    rows = materialise(_full(t), "full")
    each = [_row(ops.box_rows(rows, *box)).select(F.lit(name).alias("box"), "*") for name, box in _BOXES.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE lng BETWEEN 108.0 AND 112.0 AND lat BETWEEN 28.0 AND 32.0")
def bbox_layout(t):
    """A box of one city read from a table in the order of a space-filling curve."""
    path = fresh_path(t.spark, "spatial")
    layout.write_spatial(_full(t), path)
    return _row(layout.read_box(t.spark, path, 108.0, 28.0, 112.0, 32.0))


def _side_sql(lat, west, east):
    """Positive north of the great circle from (west, lat) to (east, lat): the point times the vector product of both ends."""
    point = lambda x, y: (f"cos(radians({y})) * cos(radians({x}))", f"cos(radians({y})) * sin(radians({x}))", f"sin(radians({y}))")
    (ax, ay, az), (bx, by, bz), (px, py, pz) = point(west, lat), point(east, lat), point("lng", "lat")
    return f"({px}) * ({ay} * {bz} - {az} * {by}) + ({py}) * ({az} * {bx} - {ax} * {bz}) + ({pz}) * ({ax} * {by} - {ay} * {bx})"


def _pyramid_sql(name):
    w, s, e, n, most = _BOXES[name]
    size = pyramid.FINEST
    coarse = 1 << pyramid.thin_level(w, s, e, n, most)
    inside = f"SELECT *, count(*) OVER () AS total, row_number() OVER (PARTITION BY floor(floor(lng / {size}) / {coarse}), floor(floor(lat / {size}) / {coarse}) ORDER BY id) AS rn FROM ({FULL}) WHERE lng BETWEEN {w} AND {e} AND lat BETWEEN {s} AND {n}"
    return f"SELECT '{name}' AS box, {ROW} FROM ({inside}) WHERE total <= {most} OR rn = 1"


@BOOK.add(" UNION ALL ".join(map(_pyramid_sql, _BOXES)))
def bbox_pyramid(t):
    """The three boxes from tables of counts and first rows by cell."""
    path = fresh_path(t.spark, "pyramid")
    pyramid.write_pyramid(_full(t).select("id", "lng", "lat", "name", "address", "city", "chain_slug", "category_slug"), path)
    each = [_row(pyramid.read_box(t.spark, path, *box)).select(F.lit(name).alias("box"), "*") for name, box in _BOXES.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


_WIDE = (75.0, 30.0, 130.0, 45.0)


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE lng BETWEEN 75.0 AND 130.0 AND {_side_sql('30.0', '75.0', '130.0')} >= 0 AND {_side_sql('45.0', '75.0', '130.0')} <= 0")
def bbox_geodesic(t):
    """A wide box with great-circle edges, which planar edges cut differently at top and bottom."""
    path = fresh_path(t.spark, "spatial")
    layout.write_spatial(_full(t), path)
    return _row(layout.read_geodesic_box(t.spark, path, *_WIDE))


def haversine_sql(x1, y1, x2, y2):
    h = f"pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2)"
    return f"2 * 6371008.8 * asin(sqrt(least({h}, 1.0)))"


@BOOK.add(f"SELECT id, round(d, 3) AS distance_m FROM (SELECT id, {haversine_sql('lng', 'lat', '110.0', '30.0')} AS d FROM location) WHERE d <= 100000")
def nearby(t):
    return ops.nearby(t.location, 110.0, 30.0, 100_000.0, limit=None).select("id", F.round("distance_m", 3).alias("distance_m"))


@BOOK.add(f"""SELECT query_id, id, round(d, 3) AS distance_m, rank FROM (SELECT c.city AS query_id, l.id, {haversine_sql('c.lng', 'c.lat', 'l.lng', 'l.lat')} AS d,
  row_number() OVER (PARTITION BY c.city ORDER BY {haversine_sql('c.lng', 'c.lat', 'l.lng', 'l.lat')}, l.id) AS rank FROM city_center c, location l WHERE l.lng IS NOT NULL) WHERE rank <= 3""")
def nearest_k(t):
    """Three nearest stores of each city centre."""
    found = ops.nearest(t.city_center, t.location, 3, 150_000.0, query_id="city")
    return found.select("query_id", "id", F.round("distance_m", 3).alias("distance_m"), F.col("rank").cast("long").alias("rank"))


@BOOK.add(f"""SELECT a.id AS left_id, b.id AS right_id, round({haversine_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')}, 3) AS distance_m
FROM {LOCATED} a JOIN {LOCATED} b ON a.chain_id = b.chain_id AND a.cust = b.cust AND a.id < b.id WHERE {haversine_sql('a.lng', 'a.lat', 'b.lng', 'b.lat')} <= 50""")
def radius_pairs(t):
    from ..operators.resolve import same_name_pairs

    return same_name_pairs(materialise(geo.with_wgs84(t.location), "located")).select("left_id", "right_id", F.round("distance_m", 3).alias("distance_m"))


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE name ILIKE '%customer%1_店%' OR address ILIKE '%customer%1_店%' OR city ILIKE '%customer%1_店%'")
def search_ilike(t):
    return _row(ops.like_search(_full(t), "customer%1_店", limit=None))


@BOOK.add(f"SELECT {ROW} FROM ({FULL}) WHERE contains(lower(concat_ws(' ', coalesce(name, ''), coalesce(address, ''), coalesce(city, ''))), '店) 广')")
def search_substring(t):
    return _row(ops.substring_search(_full(t), " 店) 广 ", limit=None))


@BOOK.add("SELECT id, slug FROM chain WHERE contains(lower(name), 'n_1') OR contains(lower(slug), 'n_1')")
def chain_search(t):
    return ops.chain_search(t.chain, " N_1 ").select("id", "slug")


_API = f"SELECT c.id, c.slug, count(l.id) AS location_count FROM chain c LEFT JOIN (SELECT * FROM location WHERE {NOT_OUT}) l ON l.chain_id = c.id GROUP BY 1, 2"
_EXPORT = "SELECT c.id, c.slug, count(l.id) AS location_count FROM chain c LEFT JOIN (SELECT * FROM location WHERE lng IS NOT NULL) l ON l.chain_id = c.id GROUP BY 1, 2"


@BOOK.add(_API)
def chain_counts_api(t):
    return stats.chain_counts(t.chain, t.location).select("id", "slug", "location_count")


@BOOK.add(_EXPORT)
def chain_counts_export(t):
    return stats.chain_counts(t.chain, t.location, "export").select("id", "slug", "location_count")


@BOOK.add(f"SELECT array_to_string(list(slug ORDER BY slug), ',') AS chains, sum(location_count)::BIGINT AS location_count FROM ({_EXPORT})")
def manifest(t):
    return stats.manifest(stats.chain_counts(t.chain, t.location, "export")).select(F.array_join("chains", ",").alias("chains"), "location_count")


@BOOK.add(f"SELECT chain_slug, count(*) AS n FROM ({FULL}) GROUP BY 1")
def count_desc(t):
    return stats.count_by(_full(t), "chain_slug").orderBy(F.desc("n"), "chain_slug")


@BOOK.add(f"SELECT id, name FROM location WHERE chain_id = 7 AND {NOT_OUT} ORDER BY name ASC NULLS LAST, id LIMIT 100 OFFSET 50")
def chain_page(t):
    own = t.location.where((F.col("chain_id") == 7) & scope.query_scope(F.col("province"), F.col("city")))
    return own.orderBy(F.asc_nulls_last("name"), "id").offset(50).limit(100).select("id", "name")


@BOOK.add("SELECT id, seen_at FROM location ORDER BY seen_at DESC, id LIMIT 20")
def runs_recent(t):
    return t.location.orderBy(F.desc("seen_at"), "id").limit(20).select("id", "seen_at")


@BOOK.add("SELECT id, chain_slug, seen_at FROM (SELECT l.id, l.seen_at, c.slug AS chain_slug FROM location l JOIN chain c ON c.id = l.chain_id WHERE l.lng IS NULL) ORDER BY seen_at DESC, id LIMIT 50 OFFSET 10")
def failures_page(t):
    own = t.location.where("lng is null").join(t.chain.select(F.col("id").alias("chain_id"), F.col("slug").alias("chain_slug")), "chain_id")
    return own.orderBy(F.desc("seen_at"), "id").offset(10).limit(50).select("id", "chain_slug", "seen_at")


@BOOK.add("SELECT id, name, slug FROM category ORDER BY name")
def categories_sorted(t):
    return t.category.orderBy("name")


@BOOK.add("SELECT c.id, c.name, c.slug FROM chain c JOIN category g ON g.id = c.category_id WHERE g.slug = 'asia'")
def chains_of_category(t):
    return t.chain.join(t.category.select(F.col("id").alias("category_id"), F.col("slug").alias("g")), "category_id").where("g = 'asia'").select("id", "name", "slug")


@BOOK.add("SELECT id, name, lng, lat FROM location WHERE id = 17")
def point_lookup(t):
    return t.location.where("id = 17").select("id", "name", "lng", "lat")


@BOOK.add("""WITH w AS (SELECT city, count(*) AS expected FROM location WHERE city IS NOT NULL AND id % 3 = 0 GROUP BY 1 HAVING count(*) >= 40),
h AS (SELECT city, count(*) AS observed FROM location WHERE city IS NOT NULL AND id % 3 = 1 AND city <> '上海市' GROUP BY 1)
SELECT city, expected, coalesce(observed, 0) AS observed, round(coalesce(observed, 0) / expected, 6) AS ratio, coalesce(observed, 0) / expected < 1.05 AS flagged FROM w LEFT JOIN h USING (city)""")
def city_coverage(t):
    known = t.location.where("city is not null")
    return stats.coverage(known.where("id % 3 = 0"), known.where("id % 3 = 1 and city <> '上海市'")).withColumn("ratio", F.round("ratio", 6)).orderBy(F.desc("expected"))


@BOOK.add("SELECT coalesce(province, 'unknown') AS province, count(*) AS n FROM location GROUP BY 1")
def province_tally(t):
    return stats.tally(t.location, "province")


@BOOK.add("SELECT count(*) AS total, count(*) FILTER (source_type = 'official') AS official, count(*) FILTER (starts_with(external_id, 'x1')) AS ones, count(*) FILTER (lng IS NULL) AS unplaced FROM location")
def format_counts(t):
    return stats.conditional_counts(t.location, official=F.col("source_type") == "official", ones=F.col("external_id").startswith("x1"), unplaced=F.col("lng").isNull())


@BOOK.add("SELECT source_type, count(DISTINCT external_id) AS distinct_ids FROM location GROUP BY 1")
def distinct_ids(t):
    return stats.distinct_ids(t.location, "external_id", "source_type")


_SELECTED = "SELECT slug FROM chain WHERE category_id = 2 OR id % 4 = 1"


def _selected(t):
    return t.chain.where("category_id = 2 or id % 4 = 1").select("slug")


@BOOK.add(f"SELECT g.slug, coalesce(bool_and(s.slug IS NOT NULL) FILTER (c.id IS NOT NULL), true) AS selected FROM category g LEFT JOIN chain c ON c.category_id = g.id LEFT JOIN ({_SELECTED}) s ON s.slug = c.slug GROUP BY 1")
def category_all_selected(t):
    return stats.fully_selected(t.category, t.chain, _selected(t))


@BOOK.add(f"""SELECT g.slug, coalesce(sum(CASE WHEN s.slug IS NOT NULL THEN c.location_count ELSE 0 END), 0)::BIGINT AS stores,
  CASE WHEN bool_and(s.slug IS NOT NULL) THEN 'all' WHEN bool_or(s.slug IS NOT NULL) THEN 'some' ELSE 'none' END AS state
FROM category g LEFT JOIN (SELECT e.*, h.category_id FROM ({_EXPORT}) e JOIN chain h ON h.id = e.id) c ON c.category_id = g.id LEFT JOIN ({_SELECTED}) s ON s.slug = c.slug GROUP BY 1""")
def category_selected_totals(t):
    return stats.selected_totals(t.category, stats.chain_counts(t.chain, t.location, "export"), _selected(t))


@BOOK.add(f"SELECT slug FROM ({_SELECTED}) UNION SELECT slug FROM chain WHERE category_id = 0")
def toggle_category_on(t):
    return stats.toggle(_selected(t), t.chain, 0, True)


@BOOK.add(f"SELECT slug FROM ({_SELECTED}) EXCEPT SELECT slug FROM chain WHERE category_id = 2")
def toggle_category_off(t):
    return stats.toggle(_selected(t), t.chain, 2, False)


@BOOK.add("SELECT n_nationkey AS id, array_to_string(list_distinct_ordered, '|') AS words FROM (SELECT n_nationkey, [lower(n_name), n_name] AS list_distinct_ordered FROM nation)")
def keyword_list(t):
    text = F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ,, "), F.col("n_name"), F.lit(","), F.lower("n_name"))
    return t.nation.select(F.col("n_nationkey").alias("id"), F.array_join(scope.csv_array(text), "|").alias("words"))


@BOOK.add("(SELECT city FROM city_center WHERE expected >= 40 UNION SELECT city FROM city_center WHERE city IN ('NATION_3', 'NATION_5')) EXCEPT SELECT city FROM city_center WHERE size_class = 2")
def dense_city_filter(t):
    c = t.city_center
    listed = c.where(F.col("city").isin("NATION_3", "NATION_5")).select("city")
    return c.where("expected >= 40").select("city").union(listed).distinct().exceptAll(c.where("size_class = 2").select("city").distinct())


_BY = "(PARTITION BY name, chain_id ORDER BY seen_at, id)"


@BOOK.add(f"SELECT id, name, chain_id FROM (SELECT *, row_number() OVER {_BY} AS rn FROM location) WHERE rn = 1")
def first_seen(t):
    return stats.first_seen(t.location, ["name", "chain_id"], ["seen_at", "id"]).select("id", "name", "chain_id")


@BOOK.add("SELECT id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY seen_at DESC, id DESC) AS rn FROM location) WHERE rn = 1")
def last_wins(t):
    return stats.last_wins(t.location, ["external_id"], ["seen_at", "id"]).select("id", "external_id")


@BOOK.add("""SELECT id, external_id FROM (SELECT *, row_number() OVER (PARTITION BY external_id ORDER BY CASE source_type WHEN 'official' THEN 0 ELSE 1 END, id) AS rn
FROM location WHERE source_type = 'official' OR (source_type = 'poi' AND city IS DISTINCT FROM '上海市')) WHERE rn = 1""")
def source_precedence(t):
    official = t.location.where("source_type = 'official'").withColumn("place", F.lit(0))
    poi = t.location.where("source_type = 'poi'").where(~F.col("city").eqNullSafe("上海市")).withColumn("place", F.lit(1))
    return stats.first_seen(official.unionByName(poi), ["external_id"], ["place", "id"]).select("id", "external_id")


@BOOK.add("""WITH f AS (SELECT store, min(seq) AS seq FROM request_log GROUP BY 1),
n AS (SELECT (seq - 1) // 500 AS w, count(*) AS new_stores FROM f GROUP BY 1), r AS (SELECT (seq - 1) // 500 AS w, count(*) AS requests FROM request_log GROUP BY 1),
c AS (SELECT r.w AS "window", requests, coalesce(new_stores, 0) AS new_stores, (sum(coalesce(new_stores, 0)) OVER (ORDER BY r.w))::BIGINT AS store_count FROM r LEFT JOIN n USING (w)),
h AS (SELECT min("window") AS first FROM c WHERE requests = 500 AND store_count >= 300 AND new_stores < 420)
SELECT c.*, coalesce("window" = first, false) AS stop FROM c, h""")
def plateau_windows(t):
    log = stats.number_by(t.events, ["ts", "event_id"]).select("seq", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("store"))
    return stats.plateau_windows(log, 500, 300, 420)
