"""Row tests of functions and predicates on literal cases."""
import math

import pytest
from pyspark.sql import functions as F

from shopatlas.functions import geo, scope, text
from shopatlas.operators import resolve, search, stats, tiling, upsert
from shopatlas.sources import projections, readers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("name, norm", [("全家便利店(人民路店)", "人民路店"), (" 7-ELEVEn　(A)", "a"), (None, ""), ("KFC", ""), ("麦当劳-X", "x")])
def test_store_name(spark, name, norm):
    assert one(spark, text.store_name(s(name))) == norm


@pytest.mark.parametrize("address", ["广东省广州市阅江中路686号", "广州市 阅江中路686"])
def test_address_variants_have_one_core(spark, address):
    assert one(spark, text.address_core(s(address), s("广东省"), s("广州市"), s(None))) == "阅江中路686"


@pytest.mark.parametrize("value, out", [("广西壮族自治区", "广西"), ("内蒙古自治区", "内蒙古"), ("上海市", "上海"), ("", ""), (None, "")])
def test_region(spark, value, out):
    assert one(spark, text.region(s(value))) == out


def test_city_drops_the_province(spark):
    assert one(spark, text.city(s("浙江省杭州市"))) == "杭州"
    assert one(spark, text.city(s("浙江省"))) == "浙江"


@pytest.mark.parametrize("damaged, mended", [("五羊?站", "五羊邨站"), ("沥?蛘", "沥滘"), ("体育西?B出口", "体育西站B出口"), ("中山路", "中山路"), (None, None)])
def test_repair(spark, damaged, mended):
    assert one(spark, text.repair(s(damaged))) == mended


def test_mainland_scope(spark):
    none = s(None)
    keep = lambda **k: one(spark, scope.in_scope(*(k.get(c, none) for c in ("province", "city", "district", "address", "name")), k.get("lng", F.lit(None).cast("double")), k.get("lat", F.lit(None).cast("double"))))
    assert keep(address=s("青岛市香港中路10号")) and keep(name=s("青岛澳门中心店"), province=s("山东省"))
    assert not keep(name=s("澳门中心店"))
    assert not keep(province=s("台湾省")) and not keep(address=s("台中市西区"))
    assert not keep(lng=F.lit(121.5), lat=F.lit(25.0)) and keep(lng=F.lit(114.05), lat=F.lit(22.54))


def test_round_trip_and_identity_outside(spark):
    for lng, lat in ((116.4, 39.9), (104.06, 30.67), (87.6, 43.8)):
        p = geo.wgs84_to_gcj02(F.lit(lng), F.lit(lat))
        q = one(spark, geo.gcj02_to_wgs84(p["lng"], p["lat"]))
        assert math.hypot(q.lng - lng, q.lat - lat) < 1e-5
        b = geo.gcj02_to_bd09(F.lit(lng), F.lit(lat))
        r = one(spark, geo.bd09_to_gcj02(b["lng"], b["lat"]))
        assert math.hypot(r.lng - lng, r.lat - lat) < 1e-5
    assert one(spark, geo.wgs84_to_gcj02(F.lit(10.0), F.lit(50.0))).asDict() == {"lng": 10.0, "lat": 50.0}


def test_unknown_system_is_an_error(spark):
    df = spark.createDataFrame([(100.0, 30.0, "XY")], "lng double, lat double, coordinate_system string")
    with pytest.raises(Exception, match="unknown coordinate system"):
        geo.with_wgs84(df).collect()


@pytest.mark.parametrize("raw, n", [("1000+", 1000), ("12", 12), ("", 0), (None, 0)])
def test_result_count(spark, raw, n):
    assert one(spark, text.result_count(s(raw))) == n


def test_levels(spark):
    assert [one(spark, text.confidence(s(x))) for x in ("门牌号", "村庄", "区县", "", None)] == [0.9, 0.7, 0.5, None, None]


def test_embedded_objects():
    assert readers.balanced("a data_json:'{\"x\": {\"y\": 1}}' b data_json:'{}' data_json:'{", "data_json:'") == ['{"x": {"y": 1}}', "{}"]


def test_swapped_source_coordinates(spark):
    raw = spark.createDataFrame([("1", "店", "路", "40.126245", "116.647047", "market", None, "北京")], "id string, name string, address string, longitude string, latitude string, format string, city string, request_city string")
    row = projections.get("7fresh")(raw).first()
    assert (row.latitude, row.longitude, row.city, row.external_id) == (40.126245, 116.647047, "北京", "7fresh-sm-1")


def test_register_a_source(spark):
    @projections.register("corner-shop")
    def corner(df):
        return projections.canonical(df, "corner-shop", external_id="id", name="id")

    out = projections.normalise({"corner-shop": spark.createDataFrame([("7",)], "id string")})
    assert out.columns == list(projections.CANONICAL) and out.first().external_id == "7"
    projections._registry.pop("corner-shop")


def test_quotas_shrink_and_stop():
    assert sum(search.quotas({"a": 100, "b": 10, "c": 1}, 50).values()) <= 50
    assert search.quotas({"a": 1, "b": 1, "c": 0}, 1) == {"a": 1, "b": 1, "c": 0}
    assert search.quotas({}, 5) == {}


def test_radius_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    pts = [(i, 110 + rng.random() / 100, 53 + rng.random() / 100, "A") for i in range(150)] + [(900, None, None, "A"), (901, 110.0, 53.0, None)]
    df = spark.createDataFrame(pts, "id long, lng double, lat double, chain_id string").withColumn("name", F.lit("x"))
    got = {(r.left_id, r.right_id) for r in resolve.same_name_pairs(df, 120.0).collect()}

    def far(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in pts[:150] for b in pts[:150] if a[0] < b[0] and far(a, b) <= 120}


def test_greedy_and_components_differ_on_a_chain(spark):
    step = 40 / 111195
    rows = [(k, 1, "店", "路" * (5 if k == 2 else 1), None, None, 110.0, 30.0 + k * step) for k in (1, 2, 3, 4, 5)]
    df = spark.createDataFrame(rows, "id long, chain_id int, name string, address string, district string, city string, lng double, lat double")
    kept = lambda mode: sorted(r.id for r in resolve.duplicate_clusters(df, mode=mode).collect() if r.keep)
    assert kept("components") == [2]
    assert kept("greedy") == [2, 4]


def test_thinning_keeps_one_row_a_cell(spark):
    df = spark.range(500).select("id", ((F.col("id") * 37 % 100) / 100).alias("lng"), ((F.col("id") * 53 % 100) / 100).alias("lat"))
    for how in ("round", "floor"):
        thin = search.thin_by_cell(df, 0.1, how)
        cell = (lambda c: F.floor(F.col(c) / 0.1 + 0.5)) if how == "round" else (lambda c: F.floor(F.col(c) / 0.1))
        assert thin.select(cell("lng"), cell("lat")).distinct().count() == thin.count() == df.select(cell("lng"), cell("lat")).distinct().count()


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 10)], "k int, v string, made int")
    new = spark.createDataFrame([(1, "b", 20, 0), (2, "c", 20, 1), (2, "d", 21, 2)], "k int, v string, made int, ordinal int")
    once = upsert.upsert(old, new, ["k"], ["v"], ["made"])
    assert sorted(map(tuple, once.collect())) == [(1, "b", 10), (2, "d", 21)]
    assert sorted(map(tuple, upsert.upsert(once, new, ["k"], ["v"], ["made"]).collect())) == [(1, "b", 10), (2, "d", 21)]


def test_lattice_and_empty_tables(spark):
    assert tiling.lattice(spark, 0.0, 0.0, 1.0, 1.0, 0.5).count() == 4
    assert tiling.lattice(spark, 0.0, 0.0, 0.1, 0.1, 0.5).count() == 0
    none = spark.createDataFrame([], "id long, lng double, lat double, chain_slug string")
    assert search.thin_by_cell(none, 0.1).count() == 0
    assert search.cap_combined(none, 5).count() == 0
    assert stats.number_by(none, ["id"]).count() == 0


def test_nearest_looks_farther_where_it_must(spark):
    points = spark.createDataFrame([(1, 110.0, 30.0), (2, 110.5, 30.0), (3, 113.0, 30.0)], "id long, lng double, lat double")
    asked = spark.createDataFrame([(7, 110.01, 30.0)], "q long, lng double, lat double")
    found = search.nearest(asked, points, 3, 2000.0, query_id="q").orderBy("rank").collect()
    assert [(r.query_id, r.id, r.rank) for r in found] == [(7, 1, 1), (7, 2, 2), (7, 3, 3)]


def _metres(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))


@pytest.mark.parametrize("latitude, spread, radius", [(60, 0.02, 150.0), (75, 0.05, 400.0), (-89.9, 60.0, 3000.0), (45, 80.0, 4_800_000.0), (0, 170.0, 12_000_000.0)])
def test_radius_pairs_at_any_latitude(spark, latitude, spread, radius):
    """About 180 degrees, where longitudes wrap, too."""
    import random

    rng = random.Random(latitude)
    points = [(k, (180 + rng.uniform(-spread, spread) + 180) % 360 - 180, max(-90.0, min(90.0, latitude + rng.uniform(-spread, spread) / 4))) for k in range(160)]
    points += [(200, 180.0, float(latitude)), (201, -180.0, float(latitude)), (202, 0.0, 90.0), (203, 0.0, -90.0)]
    df = spark.createDataFrame(points, "id long, lng double, lat double")
    found = [(r.left_id, r.right_id) for r in search.radius_pairs(df, df, radius).collect()]
    assert len(found) == len(set(found))
    assert set(found) == {(a[0], b[0]) for a in points for b in points if _metres(a[1:], b[1:]) <= radius}


def test_nearest_from_ten_metres_to_the_other_side(spark):
    import random

    rng = random.Random(1)
    points = [(k, 110 + rng.uniform(-3, 3), 30 + rng.uniform(-3, 3)) for k in range(120)] + [(500, -60.0, -20.0), (501, None, 1.0)]
    asked = [(1, 110.0, 30.0), (2, -70.0, -30.0), (3, 179.9, 75.0), (4, 111.0, 30.0), (5, None, None)]
    df, q = spark.createDataFrame(points, "id long, lng double, lat double"), spark.createDataFrame(asked, "q long, lng double, lat double")
    got = {}
    for r in search.nearest(q, df, 4, 10.0, query_id="q").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    near = lambda a: [p[0] for p in sorted((p for p in points if p[1] is not None), key=lambda p: (_metres(a[1:], p[1:]), p[0]))][:4]
    assert {k: [i for _, i in sorted(v)] for k, v in got.items()} == {a[0]: near(a) for a in asked if a[1] is not None}
    few = search.nearest(q, df.where("id >= 500"), 4, 10.0, query_id="q").collect()
    assert sorted((r.query_id, r.id) for r in few) == [(1, 500), (2, 500), (3, 500), (4, 500)]


def _greedy(stores):
    """The clean-up in plain steps: (id, lng, lat, score) of one chain and name."""
    alive = {s[0]: s for s in stores}
    for s in sorted(stores):
        if s[0] not in alive:
            continue
        pool = [s] + sorted(x for x in alive.values() if x[0] != s[0] and _metres(s[1:3], x[1:3]) <= 50)
        best = max(pool, key=lambda x: x[3])
        for x in pool:
            if x[0] != best[0]:
                del alive[x[0]]
    return set(alive)


@pytest.mark.parametrize("seed, replayed", [(0, 100_000), (1, 100_000), (2, 1)])
def test_greedy_and_components_equal_plain_steps(spark, monkeypatch, seed, replayed):
    import random

    from shopatlas.operators import greedy

    monkeypatch.setattr(greedy, "REPLAYED", replayed)  # beyond it components go by rounds

    rng = random.Random(seed)
    rows = []
    n = 160 if replayed > 1 else 40
    for k in range(n):
        spot = rng.choice([(110 + rng.randint(0, 9) / 2500, 30 + rng.randint(0, 3) / 2500), (110 + rng.random() / 300, 30 + rng.random() / 900)])
        rows.append((k, rng.randint(1, 2), rng.choice(["店", "KFC店", "铺"]), "路" * rng.randint(0, 3), "区" * rng.randint(0, 1), None, *spot))
    rows += [(900, 1, "店", "x", None, None, None, None), (901, 1, "KFC", "x", None, None, 110.0, 30.0)]
    df = spark.createDataFrame(rows, "id long, chain_id int, name string, address string, district string, city string, lng double, lat double")
    groups = {}
    for r in rows[:n]:
        groups.setdefault((r[1], r[2].replace("KFC", "")), []).append((r[0], r[6], r[7], (len(r[3]), len(r[4]), 0)))
    kept = {r.id for r in resolve.duplicate_clusters(df, mode="greedy").collect() if r.keep}
    assert kept == set().union(*map(_greedy, groups.values())) | {900, 901}
    root = {r[0]: r[0] for r in rows}
    for stores in groups.values():
        for a in stores:
            for b in stores:
                if _metres(a[1:3], b[1:3]) <= 50 and root[a[0]] != root[b[0]]:
                    low, high = sorted((root[a[0]], root[b[0]]))
                    root = {k: low if v == high else v for k, v in root.items()}
    assert {r.id: r.cluster for r in resolve.duplicate_clusters(df).collect()} == root


def test_greedy_ends_on_a_long_chain(spark, monkeypatch):
    from shopatlas.operators import greedy

    monkeypatch.setattr(greedy, "survivors_by_rounds", None)  # no rounds at all
    n = 10_000
    df = spark.range(n).select("id", F.lit(1).alias("chain_id"), F.lit("店").alias("name"), F.lit("x").alias("address"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("city"), (110 + F.col("id") * 40 / 111195).alias("lng"), F.lit(0.0).alias("lat"))
    kept = {r.id for r in resolve.duplicate_clusters(df, mode="greedy").collect() if r.keep}
    assert kept == set(range(0, n, 2))


def test_greedy_equals_plain_steps_on_the_table(spark):
    from conftest import SF

    from shopatlas import fixtures, registry

    located = geo.with_wgs84(fixtures.load(spark, SF, "location")).select("id", "chain_id", text.store_name(F.col("name")).alias("n"), "lng", "lat", *(F.length(F.coalesce(c, F.lit(""))).alias(c) for c in ("address", "district", "city"))).collect()
    groups, rest = {}, set()
    for r in located:
        if r.n == "" or r.lng is None:
            rest.add(r.id)
        else:
            groups.setdefault((r.chain_id, r.n), []).append((r.id, r.lng, r.lat, (r.address, r.district, r.city)))
    kept = {r.id for r in registry.QUERIES["dedupe_greedy"](spark, SF).collect() if r.keep}
    assert kept == set().union(*map(_greedy, groups.values())) | rest


def _page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


def test_store_cards(spark):
    html = """<div class="store-item">
  <a href="/stores/store-info?storeId=1001">了解门店</a>
  <div>上海市-闸北店</div>
  <div>营业时间：07:30 - 22:00</div>
  <div>门店地址：上海市闸北区共和新路3318号</div>
  <div>服务电话：021-56032077</div>
</div>"""
    found = readers.store_cards(_page(spark, html)).collect()
    assert [tuple(r)[2:] for r in found] == [("1001", "上海市-闸北店", "上海市闸北区共和新路3318号", "07:30 - 22:00", "021-56032077")]
    assert readers.store_cards(_page(spark, None)).count() == readers.store_cards(_page(spark, "<p>")).count() == 0


def test_disclosure_rows(spark):
    html = """<table>
<tr><th>城市</th><th>门店名称</th></tr>
<tr>
  <td>城市 广州市</td>
  <td>门店名称 麦当劳广州天河领展广场餐厅</td>
  <td>信息公示</td>
</tr>
<tr>
  <td>城市 深圳市</td>
  <td>门店名称 麦当劳深圳万象城餐厅</td>
  <td>信息公示</td>
</tr>
</table>
<a href="?page=812">812</a>"""
    found = readers.disclosure_rows(_page(spark, html)).orderBy("pos").collect()
    assert [(r.city, r.name) for r in found] == [("广州市", "麦当劳广州天河领展广场餐厅"), ("深圳市", "麦当劳深圳万象城餐厅")]
    assert one(spark, readers.largest_page(s(html))) == 812


def test_status_routes_and_rows(spark):
    bodies = ['{"message": {"status": 121, "message": "x"}}', '{"message": {"status": 539}}', '{"count": 1, "data": [{"id": "abc", "location": {"lat": 23.1, "lng": 113.2}}]}', '{"message": {"status": "odd"}, "data": [{}]}', '{"message": {"status": null}, "data": null}']
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, body string")
    assert [r.route for r in readers.route_status(df).orderBy("id").collect()] == ["quota", "transient", "ok", "transient", "ok"]
    assert [(r.id, r.pos) for r in readers.ok_rows(df).collect()] == [(2, 0)]


def test_older_list_rows(spark):
    shape = "storeName string, addressDetail string, cityName string, provinceName string, pro string, storeCode string, lng string, lat string"
    rows = [("肯德基(建国门店)", "建国门外大街1号", "北京市", "北京市", "010-12345678", "BJ001", "116.434", "39.908"), ("天河店", "天河路1号", "广州市", "广东省", None, None, None, None), (" ", "x", None, None, None, None, None, None)]
    a, b = sorted(projections.get("kfc-list")(spark.createDataFrame(rows, shape)).collect(), key=lambda r: r.external_id != "kfc-BJ001")
    assert (a.external_id, a.coordinate_system, a.longitude, a.latitude, a.name) == ("kfc-BJ001", "GCJ02", 116.434, 39.908, "肯德基(建国门店)")
    assert b.external_id.startswith("kfc-") and b.name == "肯德基天河店" and b.longitude is None


def test_charset_order(spark):
    raw = ["北京市朝阳区".encode("gbk"), "北京市".encode(), b"\xff\xff", None, b""]
    with readers.java_charsets(spark):
        df = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(raw)], "k int, b binary")
        own = df.select("k", readers.decode_page(F.col("b"), "GB18030").alias("gb"), readers.decode_page(F.col("b"), "UTF-8").alias("utf"))
        found = own.orderBy("k").collect()
    assert found[0].gb == found[0].utf == "北京市朝阳区" and found[1].utf == "北京市" and "�" in found[2].utf and found[3].gb is None and found[4].gb == found[4].utf == ""
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == "false"


def test_braces_of_embedded_objects():
    assert readers.balanced("x d:'{a{b}{}} d:'{c d:'{e}", "d:'") == ["{a{b}{}}"]
    assert readers.balanced("d:'", "d:'") == readers.balanced("d:'}{}", "none") == []


def test_registered_sql_functions(spark):
    from shopatlas.functions import sql

    names = sql.register(spark)
    assert len(names) == len(set(names)) >= 39
    ask = lambda e: spark.sql(f"SELECT {e} AS x").first().x
    assert ask("strip_label(' 城市 广州市 ', '城市')") == "广州市" and ask("city_name('浙江省杭州市')") == "杭州"
    assert ask("gcj02_to_bd09(116.4, 39.9).lng") == pytest.approx(one(spark, geo.gcj02_to_bd09(F.lit(116.4), F.lit(39.9))["lng"]), abs=1e-9)
    assert ask("bd09_to_gcj02(116.4, 39.9).lat") == pytest.approx(one(spark, geo.bd09_to_gcj02(F.lit(116.4), F.lit(39.9))["lat"]), abs=1e-9)
    assert ask("cell_key(30.00005D, 110D, 0.5D)") == one(spark, geo.cell_key(F.lit(30.00005), F.lit(110.0), F.lit(0.5)))
    assert ask("visited_key(30.00005D, 110D, 0.5D)") == one(spark, geo.visited_key(F.lit(30.00005), F.lit(110.0), F.lit(0.5)))
    assert ask("first_number('x', '4.5')") == 4.5 and ask("result_count(' 1000+ ')") == 1000 and ask("municipality('上海市x')") == "上海市"
