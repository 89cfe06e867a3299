"""Source records to canonical records, by chain slug; users register their own.

A normaliser maps a DataFrame of one source's records to the canonical columns; rows that lack
the source's required fields are left out.  ``normalise`` unites the sources.
"""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scope, text

# Columns that a record may bring along (with an underscore in front) through any normaliser.
AUDIT = {"raw_payload": "string", "source_type": "string", "source_url": "string", "postal_code": "string", "last_seen_at": "timestamp"}
CANONICAL = {"chain_slug": "string", "external_id": "string", "name": "string", "address": "string", "province": "string", "city": "string", "district": "string", "longitude": "double", "latitude": "double", "coordinate_system": "string"}
Normaliser = Callable[[DataFrame], DataFrame]
_registry: dict[str, Normaliser] = {}


def register(slug: str) -> Callable[[Normaliser], Normaliser]:
    """Decorator: the normaliser for a chain's source."""

    def add(f: Normaliser) -> Normaliser:
        _registry[slug] = f
        return f

    return add


def get(slug: str) -> Normaliser:
    if slug not in _registry:
        raise KeyError(f"no source is registered for {slug}")
    return _registry[slug]


def slugs() -> list[str]:
    return sorted(_registry)


def canonical(df: DataFrame, slug: str, **columns) -> DataFrame:
    """Exactly the canonical columns, those not given as null, and the audit columns that the records carry."""
    columns["chain_slug"] = F.lit(slug)
    given = {k: (v if isinstance(v, Column) else F.col(v)) for k, v in columns.items()}
    carried = [F.col(f"_{k}").cast(t).alias(k) for k, t in AUDIT.items() if f"_{k}" in df.columns]
    return df.select(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in CANONICAL.items()), *carried)


def audited(df: DataFrame, source_type: str, source_url: str | None = None, seen_at: Column | None = None, postal_code: str | None = None) -> DataFrame:
    """Records that carry the audit columns: the whole source record as JSON, where and when it was seen."""
    own = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.withColumns({"_raw_payload": own, "_source_type": F.lit(source_type), "_source_url": F.lit(source_url), "_last_seen_at": F.current_timestamp() if seen_at is None else seen_at, "_postal_code": F.col(postal_code) if postal_code else F.lit(None)})


def raw_row(stored: DataFrame, location_id: int) -> DataFrame:
    """The stored source record of one location."""
    return stored.where(F.col("id") == location_id).select("id", "external_id", "source_type", "source_url", "raw_payload")


def normalise(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of all sources' canonical rows."""
    return reduce(DataFrame.unionByName, (get(k)(v) for k, v in sources.items()))


def there(*columns: str) -> Column:
    """All of these are neither null nor blank."""
    return reduce(lambda a, b: a & b, (F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in columns))


def _or(column: str, default: str) -> Column:
    return F.coalesce(text.blank_to_null(F.col(column)), F.lit(default))


@register("hema")
def hema(df: DataFrame) -> DataFrame:
    """Open stores (bizStatus 1) with a code and an address; no coordinates."""
    own = df.where((F.col("bizStatus") == "1") & there("orgResourceCode", "address"))
    return canonical(own, "hema", external_id="orgResourceCode", name=_or("resourceName", "盒马"), address="address", province="province", city="city", district="county", coordinate_system=F.lit("GCJ02"))


@register("rt-mart")
def rt_mart(df: DataFrame) -> DataFrame:
    """display_name is city-name; the name falls back to it and to the brand."""
    parts = F.split("display_name", "-", 2)
    city = F.when(F.size(parts) == 2, text.blank_to_null(text.stripped(F.get(parts, F.lit(0)))))
    name = F.coalesce(F.when(F.size(parts) == 2, text.blank_to_null(text.stripped(F.get(parts, F.lit(1))))), text.blank_to_null(F.col("display_name")), F.lit("大润发"))
    return canonical(df.where(there("store_id", "address")), "rt-mart", external_id="store_id", name=name, address="address", city=city, coordinate_system=F.lit("GCJ02"))


@register("7-eleven-cd")
def seven_eleven_feed(df: DataFrame) -> DataFrame:
    """Official feed: BD09 coordinates, region from the full city name, which the address gets in front."""
    r = text.full_city_name(F.col("cityFullName"))
    address = F.when(F.coalesce(F.col("cityFullName"), F.lit("")).isin("") | F.col("address").contains(F.col("cityFullName")), F.col("address")).otherwise(F.concat("cityFullName", "address"))
    return canonical(df.where(there("id", "address")), "7-eleven-cd", external_id=F.concat(F.lit("cd-"), F.col("id").cast("string")), name="shopName", address=address, province=r["province"], city=r["city"], district=r["district"], longitude=F.col("bMap_lng").try_cast("double"), latitude=F.col("bMap_lat").try_cast("double"), coordinate_system=F.lit("BD09"))


def _poi(df: DataFrame, slug: str, chosen: Column) -> DataFrame:
    p = text.lng_lat(F.col("location"))
    own = df.where(~scope.out_of_region(F.col("pname")) & ~scope.out_of_region(F.col("cityname")) & chosen & p["lng"].isNotNull() & p["lat"].isNotNull())
    return canonical(own, slug, external_id=F.concat(F.lit("amap-"), F.col("id")), name="name", address=text.blank_to_null(F.col("address")), province="pname", city="cityname", district="adname", longitude=p["lng"], latitude=p["lat"], coordinate_system=F.lit("GCJ02"))


@register("7-eleven")
def seven_eleven_poi(df: DataFrame) -> DataFrame:
    return _poi(df, "7-eleven", scope.is_seven_eleven(F.col("name")))


@register("walmart")
def walmart(df: DataFrame) -> DataFrame:
    return _poi(df, "walmart", scope.is_hypermarket(F.col("name"), F.col("type")))


@register("sams-club")
def sams_club(df: DataFrame) -> DataFrame:
    return _poi(df, "sams-club", scope.is_club(F.col("name")))


@register("7fresh")
def seven_fresh(df: DataFrame) -> DataFrame:
    """The source's longitude holds the latitude and the other way round; the city may come from the request."""
    label = F.when(F.col("format") == "life", "七鲜生活").otherwise("七鲜超市")
    short = F.when(F.col("format") == "life", "life").otherwise("sm")
    return canonical(df.where(there("id", "address")), "7fresh", external_id=F.concat(F.lit("7fresh-"), short, F.lit("-"), F.col("id").cast("string")), name=F.concat(label, F.lit(" "), F.col("name")), address="address", city=F.coalesce(text.blank_to_null(F.col("city")), F.col("request_city")), longitude=F.col("latitude").try_cast("double"), latitude=F.col("longitude").try_cast("double"), coordinate_system=F.lit("GCJ02"))


def _table(df: DataFrame, slug: str, brand: str, marks: tuple[str, ...], short: str) -> DataFrame:
    own = df.where(there("name", "address") & ~scope.out_of_region(F.col("province")) & ~scope.out_of_region(F.col("city")))
    city = F.coalesce(text.city_of_address(F.col("address")), F.col("city"))
    key = text.content_id(short, F.col("province"), F.col("city"), F.lit(None).cast("string"), F.col("name"), F.col("address"))
    return canonical(own, slug, external_id=key, name=text.prefixed(F.col("name"), brand, *marks), address="address", province="province", city=city, coordinate_system=F.lit("GCJ02"))


@register("yonghui")
def yonghui(df: DataFrame) -> DataFrame:
    return _table(df, "yonghui", "永辉", (), "yh")


@register("family-mart")
def family_mart(df: DataFrame) -> DataFrame:
    mended = df.withColumns({c: text.clean_cell(F.col(c)) for c in ("name", "address", "city", "province")})
    return _table(mended, "family-mart", "全家", ("FamilyMart",), "fm")


@register("kfc")
def kfc_portal(df: DataFrame) -> DataFrame:
    """Rows outside the excluded city codes; where they say so, restaurants of the requested city only."""
    out = F.coalesce(F.col("gbCityCode").rlike("^(710000|810000|820000)"), F.lit(False))
    own = df.where(there("storecode", "storename", "address") & ~out)
    if {"typeCode", "requestCityCode"} <= set(df.columns):
        own = own.where(scope.is_portal_restaurant(F.col("typeCode"), F.col("gbCityCode"), F.col("requestCityCode")))
    return canonical(own, "kfc", external_id="storecode", name=text.prefixed(F.col("storename"), "肯德基", "KFC"), address="address", city="cityName", district="districtName", longitude=text.first_number(F.col("lng"), F.col("longitude")), latitude=text.first_number(F.col("lat"), F.col("latitude")), coordinate_system=F.lit("GCJ02"))


def _first(df: DataFrame, *names: str) -> Column:
    """The first of these columns that is there and neither null nor blank."""
    return F.coalesce(*(text.blank_to_null(F.col(n).cast("string")) for n in names if n in df.columns), F.lit(None).cast("string"))


def _number(df: DataFrame, *names: str) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return text.first_number(*found) if found else F.lit(None).cast("double")


@register("kfc-list")
def kfc_list(df: DataFrame) -> DataFrame:
    """Older rows, under any of their fields' names: the id is the code, or else a hash of the content."""
    name, address = text.stripped(_first(df, "storeName", "name")), text.stripped(_first(df, "addressDetail", "address"))
    code, province, city, district = _first(df, "storeCode", "storeId", "code"), _first(df, "provinceName", "province"), _first(df, "cityName", "city"), _first(df, "districtName", "district")
    own = df.where((F.coalesce(name, F.lit("")) != "") & (F.coalesce(address, F.lit("")) != ""))
    key = F.coalesce(F.concat(F.lit("kfc-"), code), text.content_id("kfc", province, city, district, name, address))
    return canonical(own, "kfc-list", external_id=key, name=text.prefixed(name, "肯德基", "KFC"), address=address, province=province, city=city, district=district, longitude=_number(df, "lng", "lon", "longitude", "mapLng", "x"), latitude=_number(df, "lat", "latitude", "mapLat", "y"), coordinate_system=F.lit("GCJ02"))


@register("aldi")
def aldi(df: DataFrame) -> DataFrame:
    """Region from the nested area, else from the address; a bare 上海 is a city."""
    area, r = F.col("fields.area"), text.address_region(F.col("fields.storesAddress"))
    pick = lambda own, other: F.regexp_replace(F.coalesce(text.blank_to_null(own), other), "^上海$", "上海市")
    own = df.where(there("id", "fields.storesName", "fields.storesAddress"))
    return canonical(own, "aldi", external_id=F.concat(F.lit("aldi-"), F.col("id").cast("string")), name="fields.storesName", address="fields.storesAddress", province=pick(area["fields"]["parent"]["fields"]["parent"]["name"], r["province"]), city=pick(area["fields"]["parent"]["name"], r["city"]), district=F.coalesce(text.blank_to_null(area["name"]), r["district"]), coordinate_system=F.lit("GCJ02"))


def opening_hours(start: Column, end: Column) -> Column:
    return F.concat(F.substring(start, 1, 5), F.lit("-"), F.substring(end, 1, 5))


# The stores of the inline list (id, name, address, province, city, district, longitude, latitude, coordinate system).
STATIC_STORES = [
    ("costco-shanghai-minhang", "开市客上海闵行会员店", "上海市闵行区朱建路235号", "上海市", "上海市", "闵行区", None, None, None),
    ("costco-shanghai-pudong", "开市客上海浦东会员店", "上海市浦东新区康新公路5178号", "上海市", "上海市", "浦东新区", None, None, None),
    ("costco-suzhou", "开市客苏州会员店", "江苏省苏州市高新区城际路9号", "江苏省", "苏州市", "虎丘区", None, None, None),
    ("costco-ningbo", "开市客宁波会员店", "浙江省宁波市鄞州区首南东路1998号", "浙江省", "宁波市", "鄞州区", None, None, None),
    ("costco-hangzhou", "开市客杭州会员店", "浙江省杭州市萧山区鸿达路63号", "浙江省", "杭州市", "萧山区", None, None, None),
    ("costco-shenzhen", "开市客深圳会员店", "广东省深圳市龙华区民治街道龙塘社区民达路68号", "广东省", "深圳市", "龙华区", 114.013758, 22.626941, "GCJ02"),
    ("costco-nanjing", "开市客南京会员店", "江苏省南京市江宁区吉印大道3788号", "江苏省", "南京市", "江宁区", None, None, None),
]


def static_stores(spark: SparkSession) -> DataFrame:
    """The inline list as source records."""
    return spark.createDataFrame(STATIC_STORES, "external_id string, name string, address string, province string, city string, district string, longitude double, latitude double, coordinate_system string")


@register("costco")
def costco(df: DataFrame) -> DataFrame:
    """A fixed list; without coordinates where it has none."""
    return canonical(df.where(there("external_id", "address")), "costco", external_id="external_id", name="name", address="address", province="province", city="city", district="district", longitude="longitude", latitude="latitude", coordinate_system=F.coalesce("coordinate_system", F.lit("WGS84")))


@register("mcdonalds")
def mcdonalds(df: DataFrame) -> DataFrame:
    own = df.where(there("id") & (there("address") | (F.col("location.lat").isNotNull() & F.col("location.lng").isNotNull())))
    return canonical(own, "mcdonalds", external_id=F.concat(F.lit("mcd-"), F.col("id").cast("string")), name="title", address=text.blank_to_null(F.col("address")), province="province", city="city", district="district", longitude="location.lng", latitude="location.lat", coordinate_system=F.lit("GCJ02"))


@register("mixue")
def mixue(df: DataFrame) -> DataFrame:
    """Retail shops of the mainland; test and internal ones go."""
    keep = scope.is_mainland_shop(F.col("isOversea"), F.col("regionCode"), F.col("longitude"), F.col("latitude")) & ~scope.is_test_shop(F.col("shopCode"), F.col("regionCode"), F.col("regionName"), F.col("shopName"), F.col("shopAddress"))
    return canonical(df.where(keep & there("shopId")), "mixue", external_id="shopId", name="shopName", address="shopAddress", city="regionName", longitude=F.col("longitude").try_cast("double"), latitude=F.col("latitude").try_cast("double"), coordinate_system=F.lit("GCJ02"))


@register("heytea")
def heytea(df: DataFrame) -> DataFrame:
    """The city label is province, city and district with blanks between."""
    keep = scope.is_enabled_shop(F.col("is_overseas"), F.col("is_enable"), F.col("city_code"), F.col("longitude"), F.col("latitude"), (73.66, 18.15, 134.77, 53.55))
    label = F.concat_ws(" ", *(text.blank_to_null(F.col(c)) for c in ("province", "city", "district")))
    return canonical(df.where(keep & there("id")), "heytea", external_id="id", name="name", address="address", province="province", city=label, district="district", longitude=F.col("longitude").try_cast("double"), latitude=F.col("latitude").try_cast("double"), coordinate_system=F.lit("GCJ02"))


@register("stored")
def stored(df: DataFrame) -> DataFrame:
    """Stored locations as source records again."""
    return canonical(df, "stored", external_id="external_id", name="name", address="address", province="province", city="city", district="district", longitude="lng", latitude="lat", coordinate_system="coordinate_system")


def raw_id(payload: Column) -> Column:
    """Id of a raw JSON record, by the first of its usual names that holds one."""
    names = ("external_id", "orgResourceCode", "id", "storeId", "store_id", "poiId")
    return F.coalesce(*(text.blank_to_null(F.get_json_object(payload, f"$.{n}")) for n in names))
