"""The functions that SQL users call by name: SQL functions of the session, expanded by Catalyst."""
from __future__ import annotations

from pyspark.sql import SparkSession

from . import text
from .geo import AXIS, EARTH_RADIUS_M, ECCENTRICITY, GCJ_BOX
from .scope import GRID_OUT_BOXES, OUT_BOXES, OUT_FULL_NAMES, OUT_MARKERS, OUT_PREFIXES
from .text import CHAIN_PREFIXES, MUNICIPALITIES, REGION_SUFFIXES, SHORT_SUFFIXES


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def _in_boxes(boxes) -> str:
    return "coalesce(" + " OR ".join(f"(x BETWEEN {w} AND {e} AND y BETWEEN {s} AND {n})" for w, s, e, n in boxes) + ", false)"


_BARE = r"regexp_replace(coalesce(x, ''), r'(?U)\s+', '')"
_TRIM = r"regexp_replace({0}, r'(?U)^\s+|\s+$', '')"
_AFTER_LABEL = f"substring({_TRIM.format('x')}, length(label) + 1)"
_POINT = "STRUCT<lng: DOUBLE, lat: DOUBLE>"
_BD = "pi() * 3000D / 180"
_WEST, _EAST, _SOUTH, _NORTH = GCJ_BOX
_U, _V = "(x - 105D)", "(y - 35D)"
_BOTH = f"(20D * sin(6 * pi() * {_U}) + 20D * sin(2 * pi() * {_U})) * 2 / 3"
_EASTING = f"300D + {_U} + 2 * {_V} + 0.1D * {_U} * {_U} + 0.1D * {_U} * {_V} + 0.1D * sqrt(abs({_U})) + {_BOTH} + (20D * sin(pi() * {_U}) + 40D * sin(pi() / 3 * {_U})) * 2 / 3 + (150D * sin(pi() / 12 * {_U}) + 300D * sin(pi() / 30 * {_U})) * 2 / 3"
_NORTHING = f"-100D + 2 * {_U} + 3 * {_V} + 0.2D * {_V} * {_V} + 0.1D * {_U} * {_V} + 0.2D * sqrt(abs({_U})) + {_BOTH} + (20D * sin(pi() * {_V}) + 40D * sin(pi() / 3 * {_V})) * 2 / 3 + (160D * sin(pi() / 12 * {_V}) + 320D * sin(pi() / 30 * {_V})) * 2 / 3"
_M = f"(1 - {ECCENTRICITY}D * pow(sin(radians(y)), 2))"
_REGION = "STRUCT<province: STRING, city: STRING, district: STRING>"
_PARTS = "^(?:(.+?省))?(?:(.+?市))?(?:(.+?(?:区|县|市)))?"
_WHOLE = "^(.+?省)(.+?市)(.*)"
_AFTER = f"regexp_replace(x, '{text.AFTER_COMMA}', '')"


def _bare(x: str) -> str:
    return _BARE.replace("(x,", f"({x},")


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _mended(x: str) -> str:
    for pattern, right in text.REPAIRS:
        x = f"regexp_replace({x}, r'{pattern}', '{right}')"
    return x


# By name in an order in which each one calls only those before it.
DEFINITIONS = {
    "store_name(x STRING) RETURNS STRING": f"lower(btrim(regexp_replace({_BARE}, '^{_any(CHAIN_PREFIXES)}', ''), '()（）·-— '))",
    "region_name(x STRING) RETURNS STRING": f"lower(regexp_replace({_BARE}, '{_any(REGION_SUFFIXES)}$', ''))",
    "city_name(x STRING) RETURNS STRING": f"region_name(regexp_replace({_BARE}, '^[^省]*省(?=.)', ''))",
    "short_region_name(x STRING) RETURNS STRING": f"regexp_replace(x, '(.){_any(SHORT_SUFFIXES)}$', '$1')",
    "short_digest(x STRING) RETURNS STRING": "substring(sha1(x), 1, 16)",
    "city_hint(x STRING) RETURNS STRING": f"nullif(regexp_replace({_TRIM.format('x')}, '市$', ''), '')",
    "city_of_address(x STRING) RETURNS STRING": f"city_hint(nullif(regexp_extract(x, r'({text.HAN}{{2,10}}?(?:市|地区|盟|州))', 1), ''))",
    "join_region(a STRING, b STRING, c STRING) RETURNS STRING": "nullif(concat_ws('', a, b, c), '')",
    "poi_address(d STRING, a STRING) RETURNS STRING": "CASE WHEN a <> '' THEN concat(coalesce(d, ''), a) END",
    "city_key(p STRING, c STRING) RETURNS STRING": "concat_ws('|', coalesce(p, ''), coalesce(c, ''))",
    "strip_label(x STRING, label STRING) RETURNS STRING": f"CASE WHEN startswith({_TRIM.format('x')}, label) THEN {_TRIM.format(_AFTER_LABEL)} ELSE {_TRIM.format('x')} END",
    "branded(x STRING, brand STRING, mark STRING) RETURNS STRING": "CASE WHEN contains(upper(x), upper(brand)) OR contains(upper(x), upper(mark)) THEN x ELSE concat(brand, x) END",
    "result_count(x STRING) RETURNS INT": rf"coalesce(try_cast(nullif(regexp_replace({_TRIM.format('x')}, r'\+$', ''), '') AS INT), 0)",
    "first_number(a STRING, b STRING) RETURNS DOUBLE": "coalesce(try_cast(nullif(a, '') AS DOUBLE), try_cast(nullif(b, '') AS DOUBLE))",
    f"lng_lat(x STRING) RETURNS {_POINT}": "named_struct('lng', CASE WHEN size(split(x, ',', 2)) = 2 THEN try_cast(get(split(x, ',', 2), 0) AS DOUBLE) END, 'lat', CASE WHEN size(split(x, ',', 2)) = 2 THEN try_cast(get(split(x, ',', 2), 1) AS DOUBLE) END)",
    "municipality(x STRING) RETURNS STRING": f"nullif(regexp_extract(x, '^({'|'.join(MUNICIPALITIES)})', 1), '')",
    "geocode_confidence(x STRING) RETURNS DOUBLE": "CASE WHEN x IN ('门牌号', '兴趣点', '道路') THEN 0.9D WHEN x IN ('道路交叉路口', '村庄', '热点商圈') THEN 0.7D WHEN x <> '' THEN 0.5D END",
    "acceptable(x DOUBLE) RETURNS BOOLEAN": "x IS NULL OR x >= 0.7D",
    "out_of_region(x STRING) RETURNS BOOLEAN": f"coalesce(rlike(x, '^{_any(OUT_PREFIXES)}'), false)",
    "out_of_text(x STRING) RETURNS BOOLEAN": f"out_of_region(x) OR coalesce(rlike(x, '{'|'.join(OUT_MARKERS + OUT_FULL_NAMES)}'), false)",
    "out_of_coordinates(x DOUBLE, y DOUBLE) RETURNS BOOLEAN": _in_boxes(OUT_BOXES),
    "out_of_grid(x DOUBLE, y DOUBLE) RETURNS BOOLEAN": _in_boxes(GRID_OUT_BOXES),
    "out_of_china(x DOUBLE, y DOUBLE) RETURNS BOOLEAN": f"x < {_WEST} OR x > {_EAST} OR y < {_SOUTH} OR y > {_NORTH}",
    f"gcj02_shift(x DOUBLE, y DOUBLE) RETURNS {_POINT}": f"named_struct('lng', ({_EASTING}) / ({AXIS}D / sqrt({_M}) * cos(radians(y)) * pi() / 180), 'lat', ({_NORTHING}) / ({AXIS}D * (1 - {ECCENTRICITY}D) / ({_M} * sqrt({_M})) * pi() / 180))",
    f"wgs84_to_gcj02(x DOUBLE, y DOUBLE) RETURNS {_POINT}": "CASE WHEN out_of_china(x, y) THEN named_struct('lng', x, 'lat', y) ELSE named_struct('lng', x + gcj02_shift(x, y).lng, 'lat', y + gcj02_shift(x, y).lat) END",
    f"gcj02_to_wgs84(x DOUBLE, y DOUBLE) RETURNS {_POINT}": "CASE WHEN out_of_china(x, y) THEN named_struct('lng', x, 'lat', y) ELSE named_struct('lng', x - gcj02_shift(x, y).lng, 'lat', y - gcj02_shift(x, y).lat) END",
    f"gcj02_to_bd09(x DOUBLE, y DOUBLE) RETURNS {_POINT}": f"named_struct('lng', (sqrt(x * x + y * y) + 0.00002D * sin(y * {_BD})) * cos(atan2(y, x) + 0.000003D * cos(x * {_BD})) + 0.0065D, 'lat', (sqrt(x * x + y * y) + 0.00002D * sin(y * {_BD})) * sin(atan2(y, x) + 0.000003D * cos(x * {_BD})) + 0.006D)",
    f"bd09_to_gcj02(x DOUBLE, y DOUBLE) RETURNS {_POINT}": f"named_struct('lng', (sqrt(pow(x - 0.0065D, 2) + pow(y - 0.006D, 2)) - 0.00002D * sin((y - 0.006D) * {_BD})) * cos(atan2(y - 0.006D, x - 0.0065D) - 0.000003D * cos((x - 0.0065D) * {_BD})), 'lat', (sqrt(pow(x - 0.0065D, 2) + pow(y - 0.006D, 2)) - 0.00002D * sin((y - 0.006D) * {_BD})) * sin(atan2(y - 0.006D, x - 0.0065D) - 0.000003D * cos((x - 0.0065D) * {_BD})))",
    f"to_wgs84(x DOUBLE, y DOUBLE, system STRING) RETURNS {_POINT}": "CASE system WHEN 'WGS84' THEN named_struct('lng', x, 'lat', y) WHEN 'GCJ02' THEN gcj02_to_wgs84(x, y) WHEN 'BD09' THEN gcj02_to_wgs84(bd09_to_gcj02(x, y).lng, bd09_to_gcj02(x, y).lat) END",
    "street_core(x STRING) RETURNS STRING": f"lower(coalesce(nullif(regexp_extract(x, r'{text.STREET}', 0), ''), x))",
    "address_core(a STRING, p STRING, c STRING, d STRING) RETURNS STRING": f"street_core(replace(trim(LEADING '{text.REGION_MARKS}' FROM aggregate(array({_bare('p')}, {_bare('c')}, {_bare('d')}, concat(region_name(p), region_name(c)), concat(region_name(p), '省', region_name(c), '市'), concat(region_name(c), '市')), {_bare('a')}, (left, q) -> CASE WHEN q <> '' AND startswith(left, q) THEN substring(left, length(q) + 1) ELSE left END)), '号', ''))",
    "content_id(prefix STRING, p STRING, c STRING, d STRING, name STRING, a STRING) RETURNS STRING": "concat(prefix, '-', short_digest(concat_ws('|', region_name(p), city_name(c), store_name(name), address_core(a, p, c, d))))",
    "repair(x STRING) RETURNS STRING": f"CASE WHEN contains(x, '?') THEN {_mended('x')} ELSE x END",
    "hash31(x STRING) RETURNS BIGINT": "CASE WHEN x IS NOT NULL THEN coalesce(nullif(aggregate(transform(split(x, ''), c -> CAST(ascii(c) AS BIGINT)), 0L, (h, c) -> (h * 31 + c) % 4294967296L), 0L), 1L) END",
    f"address_region(x STRING) RETURNS {_REGION}": f"named_struct('province', CASE WHEN substring(x, 1, 3) IN ({_quoted(MUNICIPALITIES)}) THEN substring(x, 1, 3) ELSE nullif(regexp_extract(x, '{_PARTS}', 1), '') END, 'city', CASE WHEN substring(x, 1, 3) IN ({_quoted(MUNICIPALITIES)}) THEN substring(x, 1, 3) ELSE nullif(regexp_extract(x, '{_PARTS}', 2), '') END, 'district', nullif(regexp_extract(x, '{_PARTS}', 3), ''))",
    f"full_city_name(x STRING) RETURNS {_REGION}": f"CASE WHEN x RLIKE '{_WHOLE}' THEN named_struct('province', regexp_extract(x, '{_WHOLE}', 1), 'city', regexp_extract(x, '{_WHOLE}', 2), 'district', nullif(regexp_extract(x, '{_WHOLE}', 3), '')) WHEN municipality(x) IS NOT NULL THEN named_struct('province', municipality(x), 'city', municipality(x), 'district', nullif(substring(x, 4), '')) ELSE named_struct('province', CAST(NULL AS STRING), 'city', nullif(x, ''), 'district', CAST(NULL AS STRING)) END",
    "address_fallbacks(x STRING) RETURNS ARRAY<STRING>": f"filter(array_distinct(array_compact(array(nullif({_TRIM.format(_AFTER)}, ''), nullif(regexp_extract(x, '{text.SQUARE}', 1), ''), nullif(regexp_extract(x, '{text.MALL}', 1), '')))), f -> f <> x)",
    "distance_m(x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE) RETURNS DOUBLE": f"2 * {EARTH_RADIUS_M}D * asin(sqrt(least(1D, pow(sin(radians(y2 - y1) / 2), 2) + cos(radians(y1)) * cos(radians(y2)) * pow(sin(radians(x2 - x1) / 2), 2))))",
    "in_box(x DOUBLE, y DOUBLE, w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE) RETURNS BOOLEAN": "x BETWEEN w AND e AND y BETWEEN s AND n",
    "box_radius(n BIGINT) RETURNS DOUBLE": "CASE WHEN n <= 3 THEN 0.12D WHEN n <= 8 THEN 0.18D WHEN n <= 20 THEN 0.25D ELSE 0.35D END",
    "search_km(x DOUBLE) RETURNS DOUBLE": "floor(greatest(1D, least(20D, x * 250)) * 10 + 0.5D) / 10",
    "thinning_step(w DOUBLE, s DOUBLE, e DOUBLE, n DOUBLE, most INT) RETURNS DOUBLE": "greatest(sqrt(greatest(e - w, 0.001D) * greatest(n - s, 0.001D) / most) * 0.9D, 0.002D)",
    "round_half_up(x DOUBLE) RETURNS DOUBLE": "floor(x * 10000 + 0.5D) / 10000D",
    "cell_key(y DOUBLE, x DOUBLE, step DOUBLE) RETURNS STRING": "concat_ws('|', format_string('%.4f', round_half_up(y)), format_string('%.4f', round_half_up(x)), format_string('%.4f', round_half_up(step)))",
    "visited_key(y DOUBLE, x DOUBLE, step DOUBLE) RETURNS STRING": "concat_ws(',', format_string('%.4f', bround(y, 4)), format_string('%.4f', bround(x, 4)), format_string('%.4f', bround(step, 4)))",
    "point_wkt(x DOUBLE, y DOUBLE) RETURNS STRING": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN format_string('POINT(%.6f %.6f)', x, y) END",
    "point_geojson(x DOUBLE, y DOUBLE) RETURNS STRING": "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN to_json(named_struct('type', 'Point', 'coordinates', array(round(x, 9), round(y, 9)))) END",
}


def register(spark: SparkSession) -> list[str]:
    """Define the functions for this session; their names."""
    for head, body in DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in DEFINITIONS]
