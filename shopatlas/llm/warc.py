"""WARC archives: whole-file gzip streams, a normaliser to one member per record, offset index.

``write_streams`` makes archives as careless writers do (one gzip stream per file);
``normalise`` inflates each stream once, rewrites every record as its own gzip member and lists
the members' offsets; ``read_records`` opens single members by that index, which is a table of its own.
Archives are rows (name, content) like those of Spark's binaryFile source, so they live wherever Spark
can write; a content is a whole .warc.gz file.  Archives from elsewhere may have any number of gzip members.
"""
from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_of, bound_batches, hash_partitions, hot_keys, in_bloom, materialise, salted_join

ARCHIVE_BYTES, ARCHIVES_A_TASK = 32 << 20, 2
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
_NULL = 1 << 64


def record_id(page_id: int | None, number: int = 0) -> str:
    """A record's URI holds the page's id; pages without one are numbered apart."""
    value = _NULL * (2 * number + 1) if page_id is None else page_id % _NULL
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def page_of(uri: str) -> int | None:
    """The page of a record that was written here; null for others and for pages without an id."""
    try:
        value = uuid.UUID(uri.strip("<>")).int
    except ValueError:
        return None
    return None if value >= _NULL else value - _NULL * (value >> 63)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, number: int = 0, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head with the full length but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    target = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "") or f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, number)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and content block of one record; bytes that are not UTF-8 are replaced."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode(errors="replace").split("\r\n")[1:]))
    return fields, rest[: _length(fields.get("content-length"))]


def _length(value: str | None) -> int:
    if value is None or not value.isascii() or not value.isdigit():
        raise ValueError(f"a record without a Content-Length: {value!r}")
    return int(value)


def records_of(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Cut an inflated stream into records by their Content-Length."""
    held = bytearray()
    need = None
    for piece in stream:
        held += piece
        while True:
            if need is None:
                if (at := held.find(b"\r\n\r\n")) < 0:
                    break
                lengths = [x.split(b":", 1)[1].strip().decode("latin-1") for x in bytes(held[:at]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                need = at + 4 + _length(lengths[0] if lengths else None) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("the stream ends inside a record")


def inflate(content: bytes, step: int = 1 << 20, feed: int = 1 << 16) -> Iterator[bytes]:
    """Inflate a gzip file of one or more members piece by piece."""
    view, at, data, engine = memoryview(content), 0, b"", None
    while data or at < len(view):
        if not data:
            data = bytes(view[at : at + feed])
            at += len(data)
        engine = engine or zlib.decompressobj(31)
        if out := engine.decompress(data, step):
            yield out
        data = engine.unused_data if engine.eof else engine.unconsumed_tail
        engine = None if engine.eof else engine
    while engine is not None:
        if out := engine.decompress(b"", step):
            yield out
        elif not engine.eof:
            raise ValueError("the gzip stream is cut short")
        engine = None if engine.eof else engine


def deflate(raw: bytes) -> bytes:
    engine = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, html and refers_to: null for responses, else the page that holds the payload.

    Payloads are equal when SHA-256 and length are; a null html is empty.  Of equal payloads of at
    least ``min_bytes`` bytes the largest id is the response (rows that repeat that id too).  A
    group without any id has responses only; a row without id in another group is a revisit.
    Only rows of groups of two or more are moved (a bit map of their digests leaves out the others), and
    the largest groups are dealt over many keys of the join.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html")).withColumns({"sum": F.unhex(F.sha2("html", 256)), "size": F.octet_length("html")})
    own = own.withColumn("k", F.xxhash64("sum"))
    many = materialise(own.where(F.col("size") >= min_bytes).groupBy("sum").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    bloom = bloom_of(many.select(F.xxhash64("sum").alias("k")), "k", many.count())
    joined = salted_join(own.mapInArrow(in_bloom(bloom, True), own.schema), many, "sum", hot_keys(many, "sum", "n"))
    refers_to = F.when(F.col("first") != F.coalesce("page_id", F.lit(None), F.col("first") - 1), F.col("first"))
    alone = own.mapInArrow(in_bloom(bloom, False), own.schema)
    return joined.select("page_id", "url", "html", refers_to.alias("refers_to")).union(alone.select("page_id", "url", "html", F.lit(None).cast("long")))


def write_streams(marked: DataFrame) -> DataFrame:
    """Archives (name, content), each one gzip stream of about ARCHIVE_BYTES inflated bytes."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, rows, engine, parts, size = TaskContext.get().partitionId(), 0, 0, None, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{number:04d}.warc.gz"]), pa.array([b"".join([*parts, engine.flush()])], pa.binary())], ["name", "content"])

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                engine = engine or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                rows += 1
                raw = record(page_id, url, html.encode(), refers_to, (part << 40) + rows)
                parts.append(engine.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    yield close()
                    number, engine, parts, size = number + 1, None, [], 0
        if engine:
            yield close()

    return marked.mapInArrow(archives, "name string, content binary")


_INDEX = "array<struct<offset: long, length: long, record_id: string, type: string>>"


def normalise(archives: DataFrame) -> DataFrame:
    """name, content (one gzip member per record) and the members' index, for each archive."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                members, index, at = [], [], 0
                for raw in records_of(inflate(content)):
                    fields, _ = parse(raw)
                    if "warc-record-id" not in fields or "warc-type" not in fields:
                        raise ValueError(f"{name}: a record without WARC-Record-ID or WARC-Type")
                    members.append(deflate(raw))
                    index.append({"offset": at, "length": len(members[-1]), "record_id": fields["warc-record-id"], "type": fields["warc-type"]})
                    at += len(members[-1])
                kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([index], kind)], ["name", "content", "members"])

    return archives.select("name", "content").mapInArrow(rewrite, f"name string, content binary, members {_INDEX}")


def sidecar(normalised: DataFrame) -> DataFrame:
    """The offset index alone: one row per record."""
    return normalised.select("name", F.explode("members").alias("m")).select("name", "m.*")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = []
            for m in members:
                fields, block = parse(zlib.decompress(content[m["offset"] : m["offset"] + m["length"]], 31))
                if fields["warc-type"] not in ("response", "revisit"):
                    continue
                head, _, payload = block.partition(b"\r\n\r\n")
                sizes = [x.split(b":", 1)[1].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                said, full = fields.get("warc-payload-digest", "").removeprefix("sha1:"), int(sizes[0]) if sizes else len(payload)
                if fields["warc-type"] == "response":
                    own = digest(payload)
                    if (said and said != own) or len(payload) != full:
                        raise ValueError(f"{fields['warc-record-id']}: the payload differs from its digest")
                    said = own
                refers_to = fields.get("warc-refers-to")
                rows.append((page_of(fields["warc-record-id"]), full, said, fields["warc-type"], page_of(refers_to) if refers_to else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(archives: DataFrame, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every indexed response and revisit.

    A response's digest is computed from its payload and must equal the one in its header, if that is
    there; a revisit's digest and length are those its header gives for the full payload.  Archives and
    index are tables of their own here, which are joined by name; ``read_indexed`` moves no content.
    """
    # archives are large: they are dealt by their number, a few to a task
    tasks = max(hash_partitions(archives.sparkSession), -(-archives.count() // ARCHIVES_A_TASK))
    members = index.repartition(tasks, "name").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("members"))  # of one archive, which is of bounded size
    whole = archives.select("name", "content").repartition(tasks, "name")
    return whole.join(members.hint("merge"), "name").select("content", "members").mapInArrow(_read, _RECORD)


def read_indexed(normalised: DataFrame) -> DataFrame:
    """As ``read_records``, of archives that hold their index beside their content: each task opens what it reads."""
    bound_batches(normalised.sparkSession)
    return normalised.select("content", "members").mapInArrow(_read, _RECORD)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages as WARC records, normalise the archives, write the index beside them, read them back by it.

    Null payloads are empty, null urls get a urn; an empty table gives no row; other columns are not read.
    """
    normalised = materialise(normalise(write_streams(mark_revisits(pages, min_bytes))), "archives")
    materialise(sidecar(normalised), "archive-index")  # a row a record, for whoever looks one up
    return read_indexed(normalised)
