"""Scalar functions, predicates and validation over the derived locations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, scope, sql, text
from ..plans import ingest
from .book import Book

BOOK = Book()
_PI = "pi()"


def _shift_sql(lng: str, lat: str) -> tuple[str, str]:
    """SQL of the GCJ-02 shift in degrees (east, north)."""
    x, y = f"({lng} - 105.0)", f"({lat} - 35.0)"
    both = f"(20.0 * sin(6.0 * {x} * {_PI}) + 20.0 * sin(2.0 * {x} * {_PI})) * 2.0 / 3.0"
    n = f"-100.0 + 2.0 * {x} + 3.0 * {y} + 0.2 * {y} * {y} + 0.1 * {x} * {y} + 0.2 * sqrt(abs({x})) + {both} + (20.0 * sin({y} * {_PI}) + 40.0 * sin({y} / 3.0 * {_PI})) * 2.0 / 3.0 + (160.0 * sin({y} / 12.0 * {_PI}) + 320.0 * sin({y} / 30.0 * {_PI})) * 2.0 / 3.0"
    e = f"300.0 + {x} + 2.0 * {y} + 0.1 * {x} * {x} + 0.1 * {x} * {y} + 0.1 * sqrt(abs({x})) + {both} + (20.0 * sin({x} * {_PI}) + 40.0 * sin({x} / 3.0 * {_PI})) * 2.0 / 3.0 + (150.0 * sin({x} / 12.0 * {_PI}) + 300.0 * sin({x} / 30.0 * {_PI})) * 2.0 / 3.0"
    m = f"(1 - {geo.ECCENTRICITY} * pow(sin(radians({lat})), 2))"
    return f"({e}) * 180.0 / ({geo.AXIS} / sqrt({m}) * cos(radians({lat})) * {_PI})", f"({n}) * 180.0 / ({geo.AXIS} * (1 - {geo.ECCENTRICITY}) / ({m} * sqrt({m})) * {_PI})"


_OUT = "({{0}} < {} OR {{0}} > {} OR {{1}} < {} OR {{1}} > {})".format(*geo.GCJ_BOX)


def _moved_sql(source: str, sign: str) -> str:
    e, n = _shift_sql("lng", "lat")
    out = _OUT.format("lng", "lat")
    return f"SELECT id, CASE WHEN {out} THEN lng ELSE lng {sign} {e} END AS lng, CASE WHEN {out} THEN lat ELSE lat {sign} {n} END AS lat FROM ({source})"


_BD = f"SELECT id, r * cos(a) AS lng, r * sin(a) AS lat FROM (SELECT id, sqrt(x * x + y * y) - 0.00002 * sin(y * {_PI} * 3000 / 180) AS r, atan2(y, x) - 0.000003 * cos(x * {_PI} * 3000 / 180) AS a FROM (SELECT id, lng - 0.0065 AS x, lat - 0.006 AS y FROM ({{0}})))"
_ROUND = "SELECT id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM ({0})"
_LOC = "SELECT id, lng, lat FROM location"


def _converted(t, f):
    return t.location.select("id", f(F.col("lng"), F.col("lat")).alias("p")).select("id", F.round("p.lng", 6).alias("lng"), F.round("p.lat", 6).alias("lat"))


@BOOK.add(_ROUND.format(_moved_sql(_LOC, "-")))
def gcj_to_wgs(t):
    return _converted(t, geo.gcj02_to_wgs84)


@BOOK.add(_ROUND.format(_moved_sql(_LOC, "+")))
def wgs_to_gcj(t):
    return _converted(t, geo.wgs84_to_gcj02)


@BOOK.add(f"SELECT id, round(r * cos(a) + 0.0065, 6) AS lng, round(r * sin(a) + 0.006, 6) AS lat FROM (SELECT id, sqrt(lng * lng + lat * lat) + 0.00002 * sin(lat * {_PI} * 3000 / 180) AS r, atan2(lat, lng) + 0.000003 * cos(lng * {_PI} * 3000 / 180) AS a FROM location)")
def gcj_to_bd(t):
    return _converted(t, geo.gcj02_to_bd09)


@BOOK.add(_ROUND.format(_moved_sql(_BD.format(_LOC), "-")))
def bd_to_wgs(t):
    return _converted(t, lambda x, y: geo.to_wgs84(x, y, F.lit("BD09")))


def wgs_sql(source: str = "location") -> str:
    """id, lng, lat in WGS-84 of a table with coordinate_system."""
    pick = f"SELECT id, lng, lat FROM {source} WHERE coordinate_system = "
    gcj, bd = f"{pick} 'GCJ02'", f"{pick} 'BD09'"
    return f"{pick} 'WGS84' UNION ALL {_moved_sql(gcj, '-')} UNION ALL {_moved_sql(_BD.format(bd), '-')}"


# Locations with their coordinates in WGS-84, in which all distances are measured.
LOCATED = f"(SELECT l.* REPLACE (w.lng AS lng, w.lat AS lat) FROM location l JOIN ({wgs_sql()}) w ON w.id = l.id)"


@BOOK.add(_ROUND.format(wgs_sql()))
def to_wgs84(t):
    return geo.with_wgs84(t.location).select("id", F.round("lng", 6).alias("lng"), F.round("lat", 6).alias("lat"))


_WS = r"[\s\x{3000}\x{00A0}]+"


def _bare(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{_WS}', '', 'g')"


def name_sql(x: str) -> str:
    return f"lower(trim(regexp_replace({_bare(x)}, '^(?:全家便利店|全家FamilyMart|FamilyMart|全家|7-ELEVEn|7-ELEVEN|7-11|永辉超市|永辉|盒马|麦当劳|肯德基|KFC|七鲜超市|七鲜生活)', ''), '()（）·-— '))"


def region_sql(x: str) -> str:
    return f"lower(regexp_replace({_bare(x)}, '(?:特别行政区|维吾尔自治区|壮族自治区|回族自治区|自治区|省|市)$', ''))"


def city_sql(x: str) -> str:
    b = _bare(x)
    return region_sql(f"CASE WHEN contains({b}, '省') AND len(split_part({b}, '省', 1)) + 1 < len({b}) THEN substr({b}, len(split_part({b}, '省', 1)) + 2) ELSE {b} END")


def address_sql() -> str:
    """Address core of each location."""
    cut = "list_reduce([a, p, c, d, concat(rp, rc), concat(rp, '省', rc, '市'), concat(rc, '市')], lambda s, q: CASE WHEN q <> '' AND starts_with(s, q) THEN substr(s, len(q) + 1) ELSE s END)"
    inner = f"SELECT id, {_bare('address')} AS a, {_bare('province')} AS p, {_bare('city')} AS c, {_bare('district')} AS d, {region_sql('province')} AS rp, {region_sql('city')} AS rc FROM location"
    street = r"[\x{4e00}-\x{9fff}]{2,30}(?:路|街|道|巷|里|大道|大街|公路|快速|环线)\d+(?:-\d+)?"
    return f"SELECT id, lower(CASE WHEN regexp_matches(z, '{street}') THEN regexp_extract(z, '{street}') ELSE z END) AS core FROM (SELECT id, replace(ltrim({cut}, '省市区县 '), '号', '') AS z FROM ({inner}))"


@BOOK.add(f"SELECT id, {name_sql('name')} AS norm FROM location")
def norm_name(t):
    return t.location.select("id", text.store_name(F.col("name")).alias("norm"))


@BOOK.add(f"SELECT id, {region_sql('province')} AS norm FROM location")
def norm_region(t):
    return t.location.select("id", text.region(F.col("province")).alias("norm"))


@BOOK.add(f"SELECT id, {city_sql('city')} AS norm FROM location")
def norm_city(t):
    return t.location.select("id", text.city(F.col("city")).alias("norm"))


def _five():
    return [F.col(c) for c in ("province", "city", "district", "name", "address")]


@BOOK.add(address_sql())
def norm_address(t):
    p, c, d, _, a = _five()
    return t.location.select("id", text.address_core(a, p, c, d).alias("core"))


IDENTITY = f"SELECT l.*, {region_sql('province')} AS k1, {city_sql('city')} AS k2, {name_sql('name')} AS k3, core AS k4 FROM location l JOIN ({address_sql()}) USING (id)"


@BOOK.add(f"SELECT id, concat('fm-', substr(sha1(concat_ws('|', k1, k2, k3, k4)), 1, 16)) AS content_id FROM ({IDENTITY})")
def content_id(t):
    return t.location.select("id", text.content_id("fm", *_five()).alias("content_id"))


_HAN = r"[\x{4e00}-\x{9fff}]"


def _or_null(x: str) -> str:
    return f"nullif({x}, '')"


_INFER = _or_null(f"regexp_replace(regexp_extract(address, '({_HAN}{{2,10}}?(?:市|地区|盟|州))', 1), '市$', '')")


_HINT = _or_null("regexp_replace(trim(city), '市$', '')")


@BOOK.add(f"SELECT id, {_INFER} AS inferred, {_HINT} AS hint FROM location")
def infer_city(t):
    return t.location.select("id", text.city_of_address(F.col("address")).alias("inferred"), text.city_hint(F.col("city")).alias("hint"))


_REGION = "^(?:(.+?省))?(?:(.+?市))?(?:(.+?(?:区|县|市)))?"


@BOOK.add(f"""SELECT id, CASE WHEN m THEN substr(address, 1, 3) ELSE {_or_null(f"regexp_extract(address, '{_REGION}', 1)")} END AS province, CASE WHEN m THEN substr(address, 1, 3) ELSE {_or_null(f"regexp_extract(address, '{_REGION}', 2)")} END AS city,
{_or_null(f"regexp_extract(address, '{_REGION}', 3)")} AS district FROM (SELECT *, coalesce(substr(address, 1, 3) IN ('北京市', '上海市', '天津市', '重庆市'), false) AS m FROM location)""")
def address_region(t):
    return t.location.select("id", text.address_region(F.col("address")).alias("r")).select("id", "r.*")


_FULL = "concat(coalesce(CASE WHEN province LIKE '%省' THEN province END, ''), CASE id % 4 WHEN 0 THEN '广州市' WHEN 1 THEN '北京市' WHEN 2 THEN '天津市' ELSE '神农架' END, coalesce(district, ''))"


@BOOK.add(f"""SELECT id, coalesce(nullif(regexp_extract(f, '^(.+?省)(.+?市)(.*)', 1), ''), nullif(regexp_extract(f, '^(北京市|上海市|天津市|重庆市)(.*)', 1), '')) AS province,
CASE WHEN regexp_matches(f, '^(.+?省)(.+?市)(.*)') THEN regexp_extract(f, '^(.+?省)(.+?市)(.*)', 2) WHEN regexp_matches(f, '^(北京市|上海市|天津市|重庆市)') THEN substr(f, 1, 3) ELSE f END AS city,
CASE WHEN regexp_matches(f, '^(.+?省)(.+?市)(.*)') THEN nullif(regexp_extract(f, '^(.+?省)(.+?市)(.*)', 3), '') WHEN regexp_matches(f, '^(北京市|上海市|天津市|重庆市)') THEN nullif(substr(f, 4), '') END AS district FROM (SELECT id, {_FULL} AS f FROM location)""")
def city_full_name(t):
    return t.location.select("id", text.full_city_name(F.expr(_FULL)).alias("r")).select("id", "r.*")


@BOOK.add("SELECT id, regexp_replace(province, '(.)(?:特别行政区|自治区|自治州|地区|盟|省|市)$', '\\1') AS short, regexp_replace(city, '(.)(?:特别行政区|自治区|自治州|地区|盟|省|市)$', '\\1') AS short_city FROM location")
def short_region(t):
    return t.location.select("id", text.short_region(F.col("province")).alias("short"), text.short_region(F.col("city")).alias("short_city"))


@BOOK.add("SELECT id, CASE WHEN regexp_matches(province, '(?:特别行政区|维吾尔自治区|壮族自治区|回族自治区|自治区)$') THEN regexp_replace(province, '(?:特别行政区|维吾尔自治区|壮族自治区|回族自治区|自治区)$', '') ELSE regexp_replace(province, '[省市]$', '') END AS short FROM location")
def short_region_long(t):
    return t.location.select("id", text.short_region_long(F.col("province")).alias("short"))


_DAMAGED = "concat(name, CASE id % 6 WHEN 0 THEN '五羊?站' WHEN 1 THEN '沥?蛘镜?' WHEN 2 THEN '旧唐?A口' WHEN 3 THEN '南?藻路与?川路' WHEN 4 THEN '体育西?B出口' ELSE '' END)"


@BOOK.add(f"""SELECT id, CASE WHEN contains(v, '?') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '五羊\\?站', '五羊邨站'), '沥\\?蛘', '沥滘'), '旧唐\\?', '旧塘'), '南\\?藻路', '南蕰藻路'), '\\?川路', '蕰川路'), '镜\\?', '站'),
'([\\x{{4e00}}-\\x{{9fff}}])\\?([A-Z0-9])', '\\1站\\2') ELSE v END AS fixed, contains(v, '?') AS damaged FROM (SELECT id, {_DAMAGED} AS v FROM location)""")
def repair_text(t):
    v = t.location.select("id", F.expr(_DAMAGED).alias("v"))
    return v.select("id", text.repair(F.col("v")).alias("fixed"), text.damaged(F.col("v")).alias("damaged"))


@BOOK.add("SELECT id, CASE WHEN h = 0 THEN 1 ELSE h END AS hash FROM (SELECT id, list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, len(name) + 1), lambda i: unicode(substr(name, i::INT, 1))::HUGEINT)), lambda a, b: (a * 31 + b) % 4294967296)::BIGINT AS h FROM location)")
def hash31_id(t):
    return t.location.select("id", text.hash31(F.col("name")).alias("hash"))


_RAW = "CASE id % 5 WHEN 0 THEN '1000+' WHEN 1 THEN ' 12 ' WHEN 2 THEN '' WHEN 3 THEN '7' END"


@BOOK.add(f"""SELECT id, coalesce(try_cast(nullif(trim(rtrim(trim({_RAW}), '+')), '') AS INT), 0) AS n, coalesce(try_cast(nullif(CASE WHEN id % 2 = 0 THEN 'x' END, '') AS DOUBLE), CAST(id AS DOUBLE) / 4) AS first,
CASE WHEN id % 3 > 0 THEN round(lng, 4) END AS lng, CASE WHEN id % 3 > 0 THEN round(lat, 4) END AS lat FROM location""")
def parse_helpers(t):
    pair = F.when(F.expr("id % 3 > 0"), F.concat_ws(",", F.round("lng", 4).cast("string"), F.round("lat", 4).cast("string"))).otherwise("nowhere")
    p = text.lng_lat(pair)
    first = text.first_number(F.expr("CASE WHEN id % 2 = 0 THEN 'x' END"), (F.col("id") / 4).cast("string"))
    return t.location.select("id", text.result_count(F.expr(_RAW)).alias("n"), first.alias("first"), p["lng"].alias("lng"), p["lat"].alias("lat"))


@BOOK.add(f"""SELECT id, array_to_string(list_distinct_in_order, '|') AS cities, coalesce(array_to_string(f, '|'), '') AS fallbacks FROM (SELECT id,
  CASE WHEN i IS NULL THEN CASE WHEN h IS NULL THEN [] ELSE [h] END WHEN h IS NULL OR h = i THEN [i] ELSE [i, h] END AS list_distinct_in_order,
  list_filter([CASE WHEN s <> address THEN s END, CASE WHEN g <> address AND g IS DISTINCT FROM s THEN g END, CASE WHEN m <> address AND m IS DISTINCT FROM s AND m IS DISTINCT FROM g THEN m END], lambda x: x IS NOT NULL) AS f
FROM (SELECT id, address, {_INFER} AS i, nullif(regexp_replace(trim(city), '市$', ''), '') AS h, nullif(trim(regexp_replace(address, '[、，／/].*', '')), '') AS s, nullif(regexp_extract(address, '^(.+?广场)', 1), '') AS g, nullif(regexp_extract(address, '^(.+?(?:购物中心|购物广场))', 1), '') AS m FROM location))""")
def geocode_candidates(t):
    cities = F.array_join(text.city_candidates(F.col("address"), F.col("city")), "|")
    return t.location.select("id", cities.alias("cities"), F.coalesce(F.array_join(text.address_fallbacks(F.col("address")), "|"), F.lit("")).alias("fallbacks"))


@BOOK.add("SELECT seq, CASE WHEN level IN ('门牌号', '兴趣点', '道路') THEN 0.9 WHEN level IN ('道路交叉路口', '村庄', '热点商圈') THEN 0.7 WHEN level <> '' THEN 0.5 END::DOUBLE AS score, coalesce(CASE WHEN level IN ('门牌号', '兴趣点', '道路', '道路交叉路口', '村庄', '热点商圈') THEN true WHEN level <> '' THEN false END, true) AS ok FROM gazetteer")
def confidence(t):
    score = text.confidence(F.col("level")).cast("double")
    return t.gazetteer.select("seq", score.alias("score"), text.acceptable(score).alias("ok"))


@BOOK.add("""SELECT id, CASE WHEN n <= 3 THEN 0.12 WHEN n <= 8 THEN 0.18 WHEN n <= 20 THEN 0.25 ELSE 0.35 END::DOUBLE AS radius, round(floor(greatest(1.0, least(20.0, s * 250)) * 10 + 0.5) / 10, 1) AS km,
round(greatest(sqrt(greatest(s, 0.001) * greatest(s * 2, 0.001) / 400) * 0.9, 0.002), 9) AS step FROM (SELECT id, id % 30 AS n, (id % 90) / 1000.0::DOUBLE AS s FROM location)""")
def step_functions(t):
    own = t.location.select("id", F.expr("id % 30").alias("n"), F.expr("(id % 90) / 1000D").alias("s"))
    zero = F.lit(0.0)
    return own.select("id", geo.box_radius_for_stores(F.col("n")).cast("double").alias("radius"), F.round(geo.search_km(F.col("s")), 1).alias("km"), F.round(geo.thinning_step_column(zero, zero, F.col("s"), F.col("s") * 2, 400), 9).alias("step"))


@BOOK.add("SELECT id, concat_ws('|', printf('%.4f', floor(lat * 10000 + 0.5) / 10000), printf('%.4f', floor(lng * 10000 + 0.5) / 10000), printf('%.4f', 0.5::DOUBLE)) AS key, concat_ws('|', coalesce(province, ''), coalesce(city, '')) AS city_key, substr(sha1(city), 1, 16) AS slug FROM location WHERE lng IS NOT NULL")
def cell_keys(t):
    own = t.location.where("lng is not null")
    return own.select("id", geo.cell_key(F.col("lat"), F.col("lng"), F.lit(0.5)).alias("key"), text.city_key(F.col("province"), F.col("city")).alias("city_key"), text.short_digest(F.col("city")).alias("slug"))


@BOOK.add("SELECT id, round(lng, 9) AS x, round(lat, 9) AS y, 'Point' AS type FROM location WHERE lng IS NOT NULL")
def point_geojson(t):
    own = t.location.where("lng is not null").select("id", F.from_json(geo.point_geojson(F.col("lng"), F.col("lat")), "type string, coordinates array<double>").alias("p"))
    return own.select("id", F.get("p.coordinates", F.lit(0)).alias("x"), F.get("p.coordinates", F.lit(1)).alias("y"), F.col("p.type").alias("type"))


@BOOK.add("SELECT id, len(coalesce(address, '')) AS address, len(coalesce(district, '')) AS district, len(coalesce(city, '')) AS city, nullif(concat(province, city, district), '') AS region, CASE WHEN upper(name) LIKE '%KFC%' OR contains(name, '肯德基') THEN name ELSE concat('肯德基', name) END AS branded, CASE WHEN address <> '' THEN concat(coalesce(district, ''), address) END AS poi FROM location")
def record_helpers(t):
    own = t.location.select("id", text.richness(F.col("address"), F.col("district"), F.col("city")).alias("r"), text.join_region(F.col("province"), F.col("city"), F.col("district")).alias("region"), text.prefixed(F.col("name"), "肯德基", "KFC").alias("branded"), text.poi_address(F.col("district"), F.col("address")).alias("poi"))
    return own.select("id", *(F.col(f"r.{c}").cast("long").alias(c) for c in ("address", "district", "city")), "region", "branded", "poi")


MARKERS = "台湾|台灣|台北|新北|台中|台南|高雄|桃园|桃園|彰化|屏东|屏東|基隆|新竹|苗栗|云林|雲林|嘉义|嘉義|台东|台東|花莲|花蓮|澎湖|金门|金門|香港特别行政区|澳门特别行政区|澳門特別行政區|^香港|^澳门|^澳門"
OUT_BOX = "coalesce((lng >= 120 AND lat BETWEEN 21.9 AND 25.35) OR (lng BETWEEN 119.3 AND 119.85 AND lat BETWEEN 23 AND 23.8) OR (lng BETWEEN 113.5 AND 113.6 AND lat BETWEEN 22.08 AND 22.22), false)"


def _starts(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '^(台湾|台灣|香港|澳门|澳門)'), false)"


def _marked(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{MARKERS}'), false)"


@BOOK.add(f"SELECT id, NOT ({_starts('province')} OR {_starts('city')} OR {_starts('district')} OR {_marked('address')} OR {_marked('name')} OR {OUT_BOX}) AS record_scope, NOT ({_starts('province')} OR {_starts('city')}) AS query_scope FROM location")
def scope_filter(t):
    c = {k: F.col(k) for k in ("province", "city", "district", "address", "name", "lng", "lat")}
    return t.location.select("id", scope.in_scope(*c.values()).alias("record_scope"), scope.query_scope(c["province"], c["city"]).alias("query_scope"))


def reason_sql(source: str = "location") -> str:
    texts = " OR ".join(_marked(x) for x in ("province", "city", "district", "address", "name"))
    return f"""SELECT *, CASE WHEN coalesce(external_id, '') = '' THEN 'no_id' WHEN coalesce(address, '') = '' AND coalesce(name, '') = '' THEN 'nameless' WHEN lng IS NULL OR lat IS NULL THEN 'unplaced'
WHEN {texts} THEN 'text_out_of_scope' WHEN {OUT_BOX} THEN 'place_out_of_scope' WHEN NOT (lng BETWEEN 73 AND 136 AND lat BETWEEN 3 AND 54) THEN 'place_out_of_bounds' END AS reason FROM {source}"""


@BOOK.add(f"SELECT id, reason FROM ({reason_sql()})")
def validate_reasons(t):
    return ingest.tag(t.location).select("id", "reason")


@BOOK.add(f"SELECT reason, count(*) AS n FROM ({reason_sql()}) WHERE reason IS NOT NULL GROUP BY 1")
def quarantine(t):
    return ingest.tag(t.location).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


_SHOP = "SELECT id, external_id AS code, CASE id % 7 WHEN 0 THEN '830001' WHEN 1 THEN '710000' WHEN 2 THEN '999999' ELSE '440100' END AS region_code, city AS region, concat(name, CASE id % 11 WHEN 0 THEN '培训门店' ELSE '' END) AS name, CASE id % 13 WHEN 0 THEN 'SGA' ELSE address END AS address, CAST(CASE id % 17 WHEN 0 THEN 1 ELSE 0 END AS INT) AS overseas, CASE WHEN id % 19 = 0 THEN 'n/a' ELSE CAST(lng AS STRING) END AS lng, CAST(lat AS STRING) AS lat FROM location"


@BOOK.add(f"""SELECT id, coalesce(region_code = '999999' OR region_code LIKE '83%', false) OR coalesce(regexp_matches(name, '测试|请勿下单|不要点餐|勿动|内部门店|数字门店|培训门店|培训中心'), false) OR coalesce(regexp_matches(lower(address), '测试区域|测试门店|罗布泊|^是是是$|^sga$'), false) AS test,
overseas = 0 AND NOT regexp_matches(region_code, '^(71|81|82)') AND coalesce(try_cast(lng AS DOUBLE) BETWEEN 72 AND 136 AND try_cast(lat AS DOUBLE) BETWEEN 17.5 AND 54.5, false) AS mainland FROM ({_SHOP})""")
def retail_filter(t):
    s = t.spark.sql(_SHOP.replace("FROM location", "FROM {location}"), location=t.location)
    c = {k: F.col(k) for k in s.columns}
    return s.select("id", scope.is_test_shop(c["code"], c["region_code"], c["region"], c["name"], c["address"]).alias("test"), scope.is_mainland_shop(c["overseas"], c["region_code"], c["lng"], c["lat"]).alias("mainland"))


@BOOK.add(f"SELECT count(*) AS raw, count(*) FILTER (overseas = 0 AND NOT regexp_matches(region_code, '^(71|81|82)') AND coalesce(try_cast(lng AS DOUBLE) BETWEEN 72 AND 136 AND try_cast(lat AS DOUBLE) BETWEEN 17.5 AND 54.5, false)) AS kept FROM ({_SHOP})")
def retail_drop_count(t):
    s = t.spark.sql(_SHOP.replace("FROM location", "FROM {location}"), location=t.location)
    keep = scope.is_mainland_shop(F.col("overseas"), F.col("region_code"), F.col("lng"), F.col("lat"))
    return s.agg(F.count("*").alias("raw"), F.count_if(keep).alias("kept"))


@BOOK.add("SELECT id, id % 5 <> 0 AND id % 3 <> 0 AND NOT (id % 4 = 1) AND coalesce(lng BETWEEN 73.66 AND 134.77 AND lat BETWEEN 18.15 AND 53.55, false) AS keep FROM location")
def enabled_filter(t):
    code = F.when(F.expr("id % 4 = 1"), "156815").otherwise("15601")
    enabled = F.expr("CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN 1 END")
    keep = scope.is_enabled_shop(F.expr("id % 5 = 0"), enabled, code, F.col("lng").cast("string"), F.col("lat").cast("string"), (73.66, 18.15, 134.77, 53.55))
    return t.location.select("id", keep.alias("keep"))


_BRAND = "CASE id % 8 WHEN 0 THEN '7-eleven(人民路店)' WHEN 1 THEN '7 ELEVEN (x有限公司)' WHEN 2 THEN '沃尔玛(山姆店)' WHEN 3 THEN '沃尔玛 （中山店）' WHEN 4 THEN '山姆会员商店(福田店)' WHEN 5 THEN '山姆会员商店(地铁站)' WHEN 6 THEN '7ELEVE(公交站)' ELSE name END"


@BOOK.add("SELECT id, id % 8 = 0 OR (id % 8 = 7 AND regexp_matches(name, '(?i)7[\\s-]?ELEVEN?\\s*[(（]')) AS seven, id % 8 = 3 AND id % 2 = 1 AND id % 3 > 0 AS hyper, id % 8 = 4 AS club FROM location")
def brand_filters(t):
    kind = F.when(F.expr("id % 3 > 0"), "购物服务;超级市场").otherwise("购物服务")
    own = t.location.withColumn("b", F.expr(_BRAND))
    return own.select("id", scope.is_seven_eleven(F.col("b")).alias("seven"), scope.is_hypermarket(F.col("b"), kind).alias("hyper"), scope.is_club(F.col("b")).alias("club"))


@BOOK.add(f"SELECT id, {name_sql('name')} AS norm, {region_sql('province')} AS region, regexp_replace(city, '(.)(?:特别行政区|自治区|自治州|地区|盟|省|市)$', '\\1') AS short, {_starts('province')} AS out, round(2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(30 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(30)) * pow(sin(radians(110 - lng) / 2), 2)))), 3) AS metres FROM location")
def sql_functions(t):
    """The same helpers called by name from SQL text."""
    sql.register(t.spark)
    return t.spark.sql("SELECT id, store_name(name) AS norm, region_name(province) AS region, short_region_name(city) AS short, out_of_region(province) AS out, round(distance_m(lng, lat, 110D, 30D), 3) AS metres FROM {location}", location=t.location)


@BOOK.add(f"""SELECT c.id, c.content_id, h.hash, r.province, r.city, r.district, d.fixed, n.province AS full_province, n.city AS full_city, n.district AS full_district, g.fallbacks
FROM ({BOOK.sql['content_id']}) c JOIN ({BOOK.sql['hash31_id']}) h ON h.id = c.id JOIN ({BOOK.sql['address_region']}) r ON r.id = c.id JOIN ({BOOK.sql['repair_text']}) d ON d.id = c.id JOIN ({BOOK.sql['city_full_name']}) n ON n.id = c.id JOIN ({BOOK.sql['geocode_candidates']}) g ON g.id = c.id""")
def sql_address_functions(t):
    """Identity, hash, repair, regions and fallbacks called by name from SQL text."""
    sql.register(t.spark)
    rows = t.location.withColumns({"damaged": F.expr(_DAMAGED), "full": F.expr(_FULL)})
    each = t.spark.sql("""SELECT id, content_id('fm', province, city, district, name, address) AS content_id, hash31(name) AS hash, address_region(address) AS r, repair(damaged) AS fixed, full_city_name(full) AS n,
        coalesce(array_join(address_fallbacks(address), '|'), '') AS fallbacks FROM {rows}""", rows=rows)
    return each.select("id", "content_id", "hash", "r.*", "fixed", F.col("n.province").alias("full_province"), F.col("n.city").alias("full_city"), F.col("n.district").alias("full_district"), "fallbacks")
