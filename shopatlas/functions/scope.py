"""Which records belong to the dataset: scope, validity and retail predicates as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import in_box

# Names and boxes that set the scope.
OUT_PREFIXES = ("台湾", "台灣", "香港", "澳门", "澳門")
OUT_MARKERS = ("台湾", "台灣", "台北", "新北", "台中", "台南", "高雄", "桃园", "桃園", "彰化", "屏东", "屏東", "基隆", "新竹", "苗栗", "云林", "雲林", "嘉义", "嘉義", "台东", "台東", "花莲", "花蓮", "澎湖", "金门", "金門")
OUT_FULL_NAMES = ("香港特别行政区", "澳门特别行政区", "澳門特別行政區")
OUT_BOXES = ((120.0, 21.9, 180.0, 25.35), (119.3, 23.0, 119.85, 23.8), (113.5, 22.08, 113.6, 22.22))
GRID_OUT_BOXES = ((113.5, 22.08, 113.6, 22.22), (113.83, 22.1, 114.45, 22.45), (119.3, 21.9, 122.1, 25.4))
VALID_BOX = (73.0, 3.0, 136.0, 54.0)
RETAIL_BOX = (72.0, 17.5, 136.0, 54.5)
REGION_BOXES = {"east-south": (104.0, 20.0, 122.5, 42.0), "northeast": (118.0, 38.5, 135.0, 53.2), "southwest": (97.0, 21.0, 108.5, 34.0), "northwest": (73.66, 35.0, 97.5, 49.5), "hainan-south": (108.5, 18.0, 111.5, 21.5), "north-central": (104.0, 37.0, 120.0, 45.0)}
GAP_BOXES = {"shenzhen-core": (113.88, 22.42, 114.15, 22.58), "zhuhai": (113.52, 22.15, 113.88, 22.45)}
TEST_CODES = ("888888", "11223344", "123456", "400001", "400002", "400003", "400004", "400005", "400006", "400008", "1000000", "1000001", "1000002", "1000004", "100000001", "100000002")
TEST_REGIONS = ("无人区", "台湾测试区域")
TEST_NAME = "(?i)测试|请勿下单|不要点餐|勿动|内部门店|数字门店|培训门店|培训中心|客户请勿下单"
TEST_ADDRESS = "(?i)测试区域|测试门店|罗布泊|^是是是$|^sga$"


def _is(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def out_of_region(name: Column) -> Column:
    """Starts with an excluded region; null does not."""
    return _is(name.rlike("^(?:" + "|".join(OUT_PREFIXES) + ")"))


def out_of_text(value: Column) -> Column:
    """Starts with an excluded region, or holds a place or full region name; null does not."""
    return out_of_region(value) | _is(value.rlike("|".join(OUT_MARKERS + OUT_FULL_NAMES)))


def _boxes(lng: Column, lat: Column, boxes) -> Column:
    hit = F.lit(False)
    for west, south, east, north in boxes:
        hit = hit | in_box(lng, lat, west, south, east, north)
    return _is(hit)


def out_of_coordinates(lng: Column, lat: Column) -> Column:
    return _boxes(lng, lat, OUT_BOXES)


def out_of_grid(lng: Column, lat: Column) -> Column:
    return _boxes(lng, lat, GRID_OUT_BOXES)


def in_scope(province: Column, city: Column, district: Column, address: Column, name: Column, lng: Column, lat: Column) -> Column:
    """A record's scope: region prefixes, texts and coordinates."""
    return ~(out_of_region(province) | out_of_region(city) | out_of_region(district) | out_of_text(address) | out_of_text(name) | out_of_coordinates(lng, lat))


def query_scope(province: Column, city: Column) -> Column:
    """Scope at query time: prefixes of province and city only; null passes."""
    return ~(out_of_region(province) | out_of_region(city))


def invalid_reason(external_id, name, address, province, city, district, lng, lat) -> Column:
    """Code of the first rule that a record breaks, null for a valid one."""
    texts = F.lit(False)
    for x in (province, city, district, address, name):
        texts = texts | out_of_text(x)
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return (
        F.when(blank(external_id), "no_id")
        .when(blank(address) & blank(name), "nameless")
        .when(lng.isNull() | lat.isNull(), "unplaced")
        .when(texts, "text_out_of_scope")
        .when(out_of_coordinates(lng, lat), "place_out_of_scope")
        .when(~in_box(lng, lat, *VALID_BOX), "place_out_of_bounds")
    )


# The expressions that tell the brands.
def _not_a_shop(name: Column) -> Column:
    return (name.contains("有限公司") & ~name.contains("店")) | name.rlike("公交站|地铁站")


def is_seven_eleven(name: Column) -> Column:
    return _is(name.rlike(r"(?i)7[\s-]?ELEVEN?\s*[(（]") & ~_not_a_shop(name))


def is_hypermarket(name: Column, kind: Column) -> Column:
    return _is(name.rlike(r"沃尔玛\s*[(（]") & ~name.contains("山姆") & ~_not_a_shop(name)) & _is(kind.rlike("沃尔玛|超级市场"))


def is_club(name: Column) -> Column:
    return _is(name.rlike(r"山姆会员商店\s*[(（]") & ~_not_a_shop(name))


def is_test_shop(code: Column, region_code: Column, region: Column, name: Column, address: Column) -> Column:
    return _is(code.isin(*TEST_CODES)) | _is((region_code == "999999") | region_code.startswith("83")) | _is(region.isin(*TEST_REGIONS)) | _is(name.rlike(TEST_NAME)) | _is(address.rlike(TEST_ADDRESS))


def is_mainland_shop(overseas: Column, region_code: Column, lng: Column, lat: Column) -> Column:
    """Coordinates come as text; what does not read as a number is out."""
    x, y = lng.try_cast("double"), lat.try_cast("double")
    return ~_is(overseas == 1) & ~_is(region_code.rlike("^(71|81|82)")) & _is(in_box(x, y, *RETAIL_BOX))


def is_enabled_shop(overseas: Column, enabled: Column, city_code: Column, lng: Column, lat: Column, box) -> Column:
    """Only an explicit 0 disables; null passes."""
    x, y = lng.try_cast("double"), lat.try_cast("double")
    return ~_is(overseas) & F.coalesce(enabled != 0, F.lit(True)) & ~_is(city_code.rlike("^(15681|15682)")) & _is(in_box(x, y, *box))


def is_portal_restaurant(type_code: Column, city_code: Column, requested: Column) -> Column:
    """A restaurant (type H) whose city code is the one that was asked for."""
    return _is(type_code == "H") & _is(F.coalesce(city_code.cast("string"), F.lit("")) == requested.cast("string"))


def csv_list(value: str | None) -> list[str]:
    """Trimmed non-empty parts of a comma-separated parameter, in order, each once."""
    return list(dict.fromkeys(x.strip() for x in (value or "").split(",") if x.strip()))


def csv_array(value: Column) -> Column:
    parts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(parts)
