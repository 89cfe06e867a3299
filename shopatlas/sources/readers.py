"""Readers: landed JSON, HTML pages, GeoJSON and snapshots to rows."""
from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.stats import first_seen, last_wins
from ..plans import versions

TAG = r"(?s)<[^>]+>"


def plain(html: Column) -> Column:
    """Text of an HTML fragment: no tags, one space for white space."""
    return text.one_space(F.regexp_replace(html, TAG, " "))


def all_of(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def table_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, cells (plain text) of every table row but each page's first."""
    rows = pages.select(F.col(key).alias("page"), F.posexplode(all_of(F.col(html), r"(?is)<tr[^>]*>(.*?)</tr>")).alias("pos", "row")).where("pos > 0")
    return rows.select("page", "pos", F.transform(all_of(F.col("row"), r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), plain).alias("cells"))


def store_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Store records of 5-cell (number first) or 4-cell tables: province, city, name, address."""
    rows = table_rows(pages, html, key).where("size(cells) >= 4")
    at = lambda k: F.when(F.size("cells") >= 5, F.get("cells", F.lit(k + 1))).otherwise(F.get("cells", F.lit(k)))
    return rows.select("page", "pos", *(text.clean_cell(at(k)).alias(c) for k, c in enumerate(("province", "city", "name", "address"))))


def cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, href, label of every link that stands in a list item."""
    items = pages.select(F.col(key).alias("page"), F.posexplode(all_of(F.col(html), r"(?is)<li[^>]*>(.*?)</li>")).alias("pos", "item"))
    return items.select("page", "pos", text.match(F.col("item"), r"""(?is)<a[^>]*href=["']([^"']*)""").alias("href"), plain(F.col("item")).alias("label"))


def disclosure_rows(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, city, name of tables whose first two cells are a city and a store, each behind its label."""
    rows = table_rows(pages, html, key).where("size(cells) >= 2")
    cell = lambda k, label: text.blank_to_null(text.strip_label(F.get("cells", F.lit(k)), label))
    return rows.select("page", "pos", cell(0, "城市").alias("city"), cell(1, "门店名称").alias("name")).where("city is not null and name is not null")


def labelled(lines: Column, label: str) -> Column:
    """What follows ``label`` (and a colon) in the first line that starts with it."""
    hit = F.get(F.filter(lines, lambda x: x.startswith(label)), F.lit(0))
    return text.blank_to_null(text.stripped(F.regexp_replace(F.substring(hit, len(label) + 1, 1 << 20), "^：", "")))


# The labels of a store card's lines.
CARD_LABELS = ("营业时间", "门店地址", "服务电话", "团购电话", "了解门店")


def store_cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, store_id, display_name, address, hours, phone of ``div.store-item`` cards.

    The id comes from the card's link, the rest from its lines; a card without id or address is left
    out.  A card reaches to the next one.
    """
    blocks = F.slice(F.split(F.col(html), r"""(?i)<div[^>]*class=["'][^"']*\bstore-item\b[^>]*>"""), 2, 1 << 30)
    cards_ = pages.select(F.col(key).alias("page"), F.posexplode(blocks).alias("pos", "card"))
    lines = F.filter(F.transform(F.split(F.regexp_replace("card", TAG, "\n"), "\n"), text.stripped), lambda x: x != "")
    own = cards_.withColumn("lines", lines)
    unlabelled = lambda x: x.contains("-") & ~reduce(lambda a, b: a | b, (x.startswith(k) for k in CARD_LABELS))
    return own.select(
        "page",
        "pos",
        text.match(F.col("card"), r"""(?i)<a[^>]*href=["'][^"']*storeId=(\d+)""").alias("store_id"),
        F.get(F.filter("lines", unlabelled), F.lit(0)).alias("display_name"),
        labelled(F.col("lines"), "门店地址").alias("address"),
        labelled(F.col("lines"), "营业时间").alias("hours"),
        labelled(F.col("lines"), "服务电话").alias("phone"),
    ).where("store_id is not null and address is not null")


def js_objects(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, user, store_name, address of {user:'..',storeName:'..',address:'..'} literals."""
    pattern = r"\{\s*user\s*:\s*'([^']*)'\s*,\s*storeName\s*:\s*'([^']*)'\s*,\s*address\s*:\s*'([^']*)'"
    groups = [all_of(F.col(html), pattern, k) for k in (1, 2, 3)]
    return pages.select(F.col(key).alias("page"), F.posexplode(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("user", "store_name", "address"), strict=True)))).alias("pos", "x")).select("page", "pos", "x.*")


def largest_page(html: Column, below: int = 10_000) -> Column:
    """Largest number that stands alone in a tag."""
    numbers = F.transform(all_of(html, r">\s*(\d+)\s*<"), lambda x: x.try_cast("long"))
    return F.array_max(F.filter(numbers, lambda x: x < below))


_BRACE = re.compile("[{}]")


def balanced(html: str, opening: str) -> list[str]:
    """The {...} that follows each occurrence of ``opening``, by counting braces."""
    out, at = [], html.find(opening)
    while at >= 0:
        start, depth, end = -1, 0, at + len(opening)
        for m in _BRACE.finditer(html, end):
            start = m.start() if start < 0 and m[0] == "{" else start
            depth += (1 if m[0] == "{" else -1) if start >= 0 else 0
            if start >= 0 and depth == 0:
                end = m.end()
                out.append(html[start:end])
                break
        if start < 0 or depth:
            break
        at = html.find(opening, end)
    return out


class EmbeddedObjects:
    """Rows pos, json for ``LATERAL``: the objects embedded in one page."""

    def eval(self, html: str, opening: str):
        yield from enumerate(balanced(html, opening) if html and opening else [])


def register_embedded_json(spark: SparkSession, name: str = "embedded_json") -> None:
    """Let SQL call ``LATERAL embedded_json(html, opening)``: a table function that gets its pages in Arrow batches."""
    spark.udtf.register(name, F.udtf(EmbeddedObjects, returnType="pos int, json string", useArrow=True))


def embedded_json(pages: DataFrame, opening: str = "data_json:'", html: str = "html", key: str = "page_id") -> DataFrame:
    """page, pos, json of the objects embedded in page scripts.

    Nested braces are beyond regular expressions, so this one reader runs Python on Arrow batches;
    pages without the mark are left out before.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, k, x) for p, h in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, x in enumerate(balanced(h, opening))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string()), strict=True)], ["page", "pos", "json"])

    return pages.where(F.col(html).contains(opening)).select(F.col(key).cast("long"), html).mapInArrow(cut, "page long, pos int, json string")


@contextmanager
def java_charsets(spark: SparkSession):
    """GB18030 for the columns that are made inside, and U+FFFD for what can't be decoded; afterwards the session is as it was."""
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "true")
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def decode_page(content: Column, first: str = "GB18030") -> Column:
    """Text of page bytes: by the first of GB18030 and UTF-8 unless that fails, else by the other.

    Some bytes are valid in both, so the order is the source's.  A charset fails where the text does not
    give the bytes back.  Use it in DataFrames made inside ``java_charsets``.
    """
    gb = F.decode(content, "GB18030")
    is_gb, is_utf8 = F.encode(gb, "GB18030") == content, F.is_valid_utf8(content.cast("string"))
    utf8 = F.decode(content, "UTF-8")
    if first == "GB18030":
        return F.when(is_gb, gb).otherwise(utf8)
    return F.when(is_utf8 | ~is_gb, utf8).otherwise(gb)


def route_status(responses: DataFrame, column: str = "body", quota: int = 121) -> DataFrame:
    """Adds route: quota, transient (a status that is neither 0 nor 200, or no number), or ok (no status too)."""
    status = F.get_json_object(column, "$.message.status")
    return responses.withColumn("route", F.when(status == str(quota), "quota").when(~F.coalesce(status, F.lit("0")).isin("0", "200"), "transient").otherwise("ok"))


def ok_rows(responses: DataFrame, column: str = "body", key: str = "id") -> DataFrame:
    """key, pos, record (JSON) of the objects in ``data`` of responses on the ok route."""
    listed = F.from_json(F.get_json_object(column, "$.data"), "array<string>")
    rows = route_status(responses, column).where("route = 'ok'").select(key, F.posexplode(listed).alias("pos", "record"))
    return rows.where(F.ltrim("record").startswith("{"))


def two_tables(payloads: DataFrame, column: str = "body", key: str = "id") -> DataFrame:
    """key, declared, pos, store_name of a payload with a declared count (Table) and rows (Table1)."""
    shape = "Table array<struct<rowcount:int>>, Table1 array<struct<storeName:string, storeCode:string>>"
    p = payloads.select(F.col(key), F.from_json(column, shape).alias("p"))
    return p.select(key, F.get("p.Table", F.lit(0))["rowcount"].alias("declared"), F.posexplode_outer("p.Table1").alias("pos", "row")).select(key, "declared", "pos", F.col("row.storeName").alias("store_name"))


def envelope(payloads: DataFrame, column: str = "body") -> DataFrame:
    """Records of a bare JSON list or of the list under ``data``."""
    listed = F.coalesce(F.from_json(F.get_json_object(column, "$.data"), "array<string>"), F.from_json(F.when(F.ltrim(column).startswith("["), F.col(column)), "array<string>"))
    return payloads.select(F.explode(listed).alias("record"))


def paged_first_seen(rows: DataFrame, key: str) -> DataFrame:
    """First sighting of each id over pages that repeat (page, pos)."""
    return first_seen(rows, [key], ["page", "pos"])


def merge_files(rows: DataFrame, key: str, file: str = "file") -> DataFrame:
    """One row for each id of several files; the later file (by name) wins."""
    return last_wins(rows, [key], [file])


def read_city_files(spark: SparkSession, path: str, shape: str, key: str = "external_id") -> DataFrame:
    """Stores of several JSON files; of an id the store of the later file (by path) counts.

    A file's lines are objects whose ``stores`` map ids to stores of the given shape.
    """
    rows = spark.read.schema(f"stores map<string, struct<{shape}>>").json(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), F.explode("stores").alias(key, "store"))
    return last_wins(rows, [key], ["file"]).select(key, "store.*")


def read_saved(spark: SparkSession, path: str, version: str, shape: str) -> DataFrame:
    """Rows saved as JSON lines (adapter_version, store); none of them where they were saved by another version."""
    return versioned(spark.read.schema(f"adapter_version string, store struct<{shape}>").json(path), version).select("store.*")


def read_release(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest release; the chain is the folder's."""
    release = versions.current(spark, path)
    if release is None:
        raise ValueError(f"no release in {path}")
    rows = read_geojson_lines(spark, f"{path}/{release.folder}", file=True)
    chain = F.url_decode(F.regexp_extract("file", "/chain_slug=([^/]*)/", 1))
    return rows.drop("chain_slug").withColumn("chain_slug", chain).drop("file")


def versioned(df: DataFrame, version: str) -> DataFrame:
    """The snapshot's rows if written by this version, else none."""
    return df.where(F.col("adapter_version") == version)


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary source, or the fallback if it has no row."""
    n = primary.limit(1).agg(F.count("*").alias("n"))
    spare = fallback.crossJoin(F.broadcast(n)).where("n = 0").drop("n")
    return primary.unionByName(spare)


def district_centres(tree: DataFrame, column: str = "body") -> DataFrame:
    """province, city, lng, lat of a nested district tree; a province without cities stands for itself."""
    shape = "array<struct<name:string, center:string, districts:array<struct<name:string, center:string>>>>"
    p = tree.select(F.explode(F.from_json(F.get_json_object(column, "$.districts"), shape)).alias("p"))
    rows = p.select(F.col("p.name").alias("province"), F.col("p.center").alias("own"), F.explode_outer("p.districts").alias("c"))
    at = text.lng_lat(F.coalesce("c.center", "own"))
    return rows.select(text.short_region(F.col("province")).alias("province"), F.coalesce("c.name", "province").alias("city"), at["lng"].alias("lng"), at["lat"].alias("lat"))


def region_list(centres: DataFrame) -> DataFrame:
    """province, pos, region: each province followed by its cities."""
    own = centres.groupBy("province").agg(F.array_sort(F.collect_set("city")).alias("cities"))
    return own.select("province", F.posexplode(F.concat(F.array("province"), "cities")).alias("pos", "region"))


def country_cities(payloads: DataFrame, code: str = "156", column: str = "body") -> DataFrame:
    """Cities of the country with this code in a list of countries."""
    shape = "array<struct<code:string, city:array<struct<name:string>>>>"
    return payloads.select(F.explode(F.from_json(F.get_json_object(column, "$.data"), shape)).alias("x")).where(F.col("x.code") == code).select(F.explode("x.city").alias("c")).select(F.col("c.name").alias("city"))


def city_gate(cities: DataFrame, excluded: list[str]) -> DataFrame:
    """Cities with a code that is not excluded and a numeric centre."""
    lng, lat = F.col("lng").try_cast("double"), F.col("lat").try_cast("double")
    return cities.where((F.coalesce("code", F.lit("")) != "") & ~F.col("code").isin(*excluded) & lng.isNotNull() & lat.isNotNull())


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Rows of GeoJSON feature collections (one document a file)."""
    shape = "type string, features array<struct<id:long, geometry:struct<coordinates:array<double>>, properties:struct<name:string, chain_slug:string, category_slug:string, address:string, city:string>>>"
    f = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select(F.col("f.id").alias("id"), F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), "f.properties.*")


def read_geojson_lines(spark: SparkSession, path: str, file: bool = False) -> DataFrame:
    """Rows of feature collections with a feature a line, whatever number of files they are in; with ``file`` their file's path."""
    shape = "id long, geometry struct<coordinates:array<double>>, properties struct<name:string, chain_slug:string, category_slug:string, address:string, city:string>"
    line = F.regexp_replace("value", r"^\s*,|,\s*$", "")
    more = [F.col("_metadata.file_path").alias("file")] if file else []
    f = spark.read.text(path).select(line.alias("line"), *more).where(F.col("line").startswith('{"type":"Feature",')).select(F.from_json("line", shape).alias("f"), *(["file"] if file else []))
    return f.select(F.col("f.id").alias("id"), F.get("f.geometry.coordinates", F.lit(0)).alias("lng"), F.get("f.geometry.coordinates", F.lit(1)).alias("lat"), "f.properties.*", *(["file"] if file else []))


def read_catalog(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Chains of a catalogue file, all or of one category."""
    chains = spark.read.schema("id long, name string, slug string, category_slug string, location_count long").json(path, multiLine=True)
    return chains.where(F.col("category_slug") == category) if category else chains
