"""Names, regions and addresses of Chinese stores as column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists that decide which records are the same store.
CHAIN_PREFIXES = ("全家便利店", "全家FamilyMart", "FamilyMart", "全家", "7-ELEVEn", "7-ELEVEN", "7-11", "永辉超市", "永辉", "盒马", "麦当劳", "肯德基", "KFC", "七鲜超市", "七鲜生活")
REGION_SUFFIXES = ("特别行政区", "维吾尔自治区", "壮族自治区", "回族自治区", "自治区", "省", "市")
SHORT_SUFFIXES = ("特别行政区", "自治区", "自治州", "地区", "盟", "省", "市")
MUNICIPALITIES = ("北京市", "上海市", "天津市", "重庆市")
HAN = r"[\x{4e00}-\x{9fff}]"
STREET = HAN + r"{2,30}(?:路|街|道|巷|里|大道|大街|公路|快速|环线)\d+(?:-\d+)?"
AFTER_COMMA, SQUARE, MALL = "[、，／/].*", "^(.+?广场)", "^(.+?(?:购物中心|购物广场))"
REGION_MARKS = "省市区县 "
# Damaged spellings (pattern, replacement) in the order in which they are mended.
REPAIRS = (
    (r"金\?M阁(?=金茗阁)", ""), (r"\?I岭", "下梅林"), (r"\?蚩谡", "坦尾"), (r"五羊\?站", "五羊邨站"), (r"沥\?蛘", "沥滘"), (r"厦\?蛘", "厦滘"),
    (r"旧唐\?", "旧塘"), (r"南\?藻路", "南蕰藻路"), (r"\?川路", "蕰川路"), (r"镜\?", "站"), (r"([\x{4e00}-\x{9fff}])\?(?=[A-Z0-9])", "$1站"), (r"\?蛘", "滘"),
)


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def no_space(x: Column) -> Column:
    """All white space out, null as empty."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def match(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null without one."""
    return blank_to_null(F.regexp_extract(x, pattern, group))


def store_name(name: Column) -> Column:
    """Name without white space, its chain's prefix and bracket marks, lower-cased; null gives ''."""
    return F.lower(F.btrim(F.regexp_replace(no_space(name), "^" + _any(CHAIN_PREFIXES), ""), F.lit("()（）·-— ")))


def region(value: Column) -> Column:
    """Region without its suffix (the first that fits), lower-cased; null gives ''."""
    return F.lower(F.regexp_replace(no_space(value), _any(REGION_SUFFIXES) + "$", ""))


def city(value: Column) -> Column:
    """As ``region``, of what follows the first 省 (unless nothing does)."""
    return region(F.regexp_replace(no_space(value), "^[^省]*省(?=.)", ""))


def address_core(address: Column, province: Column, city_: Column, district: Column) -> Column:
    """Street and number where found, else the address without its region; null gives ''."""
    p, c = region(province), region(city_)
    prefixes = F.array(no_space(province), no_space(city_), no_space(district), F.concat(p, c), F.concat(p, F.lit("省"), c, F.lit("市")), F.concat(c, F.lit("市")))
    cut = F.aggregate(prefixes, no_space(address), lambda a, q: F.when((q != "") & F.startswith(a, q), F.substring(a, F.length(q) + 1, F.length(a))).otherwise(a))
    rest = F.replace(F.ltrim(cut, F.lit(REGION_MARKS)), F.lit("号"), F.lit(""))
    whole = F.regexp_extract(rest, STREET, 0)
    return F.lower(F.when(whole != "", whole).otherwise(rest))


def identity(province: Column, city_: Column, district: Column, name: Column, address: Column) -> Column:
    """The four parts that tell one store from another."""
    parts = (region(province), city(city_), store_name(name), address_core(address, province, city_, district))
    return F.struct(*(x.alias(k) for k, x in zip(("province", "city", "name", "address"), parts, strict=True)))


def content_id(prefix: str, province: Column, city_: Column, district: Column, name: Column, address: Column) -> Column:
    """prefix and 16 hex digits of SHA-1 over the identity."""
    key = F.concat_ws("|", region(province), city(city_), store_name(name), address_core(address, province, city_, district))
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(key), 1, 16))


def short_digest(x: Column) -> Column:
    """16 hex digits of SHA-1."""
    return F.substring(F.sha1(x), 1, 16)


def city_hint(value: Column) -> Column:
    """Trimmed, without one trailing 市; null where nothing is left."""
    return blank_to_null(F.regexp_replace(stripped(value), "市$", ""))


def city_of_address(address: Column) -> Column:
    """First run of 2 to 10 Han characters that ends like a city's name."""
    return city_hint(match(address, f"({HAN}{{2,10}}?(?:市|地区|盟|州))"))


def city_candidates(address: Column, city_: Column) -> Column:
    """Cities to try: from the address, the stated one, none."""
    return F.array_append(F.array_distinct(F.array_compact(F.array(city_of_address(address), city_hint(city_)))), F.lit(None).cast("string"))


def join_region(*parts: Column) -> Column:
    return blank_to_null(F.concat_ws("", *parts))


def address_region(address: Column) -> Column:
    """struct(province, city, district) at the start of an address; municipalities are both."""
    pattern = "^(?:(.+?省))?(?:(.+?市))?(?:(.+?(?:区|县|市)))?"
    first = F.substring(address, 1, 3)
    own = first.isin(*MUNICIPALITIES)
    return F.struct(F.when(own, first).otherwise(match(address, pattern, 1)).alias("province"), F.when(own, first).otherwise(match(address, pattern, 2)).alias("city"), match(address, pattern, 3).alias("district"))


def full_city_name(value: Column) -> Column:
    """struct(province, city, district) of a name like 省 + 市 + rest."""
    full = "^(.+?省)(.+?市)(.*)"
    own = "^" + "(" + "|".join(MUNICIPALITIES) + ")(.*)"
    whole, town = match(value, full), match(value, own)
    return F.struct(
        F.coalesce(whole, town).alias("province"),
        F.when(whole.isNotNull(), match(value, full, 2)).when(town.isNotNull(), town).otherwise(blank_to_null(value)).alias("city"),
        F.when(whole.isNotNull(), match(value, full, 3)).when(town.isNotNull(), match(value, own, 2)).alias("district"),
    )


def short_region(name: Column) -> Column:
    """Without its suffix where something is left."""
    return F.regexp_replace(name, "(.)" + _any(SHORT_SUFFIXES) + "$", "$1")


def short_region_long(name: Column) -> Column:
    """Without one of the long suffixes, else without one 省 or 市; blank is null."""
    clean = stripped(name)
    long = _any(REGION_SUFFIXES[:5]) + "$"
    return F.when(name == "", None).when(clean.rlike(long), F.regexp_replace(clean, long, "")).otherwise(F.regexp_replace(clean, "[省市]$", ""))


def repair(value: Column) -> Column:
    """Mend spellings that an export has damaged (only texts with a ?)."""
    out = value
    for pattern, text in REPAIRS:
        out = F.regexp_replace(out, pattern, text)
    return F.when(value.contains("?"), out).otherwise(value)


def clean_cell(value: Column) -> Column:
    return blank_to_null(repair(stripped(value)))


def damaged(value: Column) -> Column:
    return F.coalesce(value.rlike(r"[?\x{FFFD}]"), F.lit(False))


def hash31(value: Column) -> Column:
    """31-polynomial hash modulo 2**32, never 0."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % (1 << 32))
    return F.when(total == 0, F.lit(1).cast("long")).otherwise(total)


def first_number(*values: Column) -> Column:
    """The first value that reads as a number."""
    return F.coalesce(*(blank_to_null(v).try_cast("double") for v in values))


def lng_lat(value: Column) -> Column:
    """struct(lng, lat) of 'lng,lat'; nulls where it does not read so."""
    parts = F.split(value, ",", 2)
    two = F.size(parts) == 2
    return F.struct(F.when(two, F.get(parts, F.lit(0)).try_cast("double")).alias("lng"), F.when(two, F.get(parts, F.lit(1)).try_cast("double")).alias("lat"))


def result_count(value: Column) -> Column:
    """'1000+' is 1000; null and blank are 0."""
    return F.coalesce(blank_to_null(F.regexp_replace(stripped(value), r"\+$", "")).try_cast("int"), F.lit(0))


def one_space(value: Column) -> Column:
    return stripped(F.regexp_replace(value, r"(?U)\s+", " "))


def confidence(level: Column) -> Column:
    """Confidence of a geocoder's level; null stays null."""
    # The geocoder's names of its levels.
    high, middle = ("门牌号", "兴趣点", "道路"), ("道路交叉路口", "村庄", "热点商圈")
    return F.when(level.isin(*high), 0.9).when(level.isin(*middle), 0.7).when(level != "", 0.5)


def acceptable(score: Column) -> Column:
    return score.isNull() | (score >= 0.7)


def address_fallbacks(address: Column) -> Column:
    """Shorter spellings of an address to look up, distinct and in order."""
    cut = stripped(F.regexp_replace(address, AFTER_COMMA, ""))
    found = F.array(blank_to_null(cut), match(address, SQUARE), match(address, MALL))
    return F.filter(F.array_distinct(F.array_compact(found)), lambda x: x != address)


def richness(address: Column, district: Column, city_: Column) -> Column:
    """How complete a record is: lengths of address, district, city."""
    return F.struct(*(F.length(F.coalesce(x, F.lit(""))).alias(k) for k, x in (("address", address), ("district", district), ("city", city_))))


def strip_label(value: Column, label: str) -> Column:
    return stripped(F.regexp_replace(stripped(value), f"^{label}", ""))


def poi_address(district: Column, address: Column) -> Column:
    return F.when(address != "", F.concat(F.coalesce(district, F.lit("")), address))


def city_key(province: Column, city_: Column) -> Column:
    return F.concat_ws("|", F.coalesce(province, F.lit("")), F.coalesce(city_, F.lit("")))


def prefixed(name: Column, brand: str, *marks: str) -> Column:
    """The brand in front of names that carry none of the marks (compared in upper case)."""
    there = F.lit(False)
    for m in (brand, *marks):
        there = there | F.upper(name).contains(m.upper())
    return F.when(there, name).otherwise(F.concat(F.lit(brand), name))
