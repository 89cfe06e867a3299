"""Secret scan: keyword prefilter, anchored expressions at the hits, embedded checksums.

An Aho-Corasick automaton runs once over a whole Arrow batch of lower-cased bytes; an expression
is tried only where one of its keywords ends.  Tokens with an embedded checksum (fixed public
formats: CRC-32 in base 62, twofold SHA-256 in base 58) are reported only when it holds.
"""
from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, lower_ascii, text_bytes

# Kinds in the order in which they are listed at equal starts.
KINDS = ("assign", "access", "hex", "forge", "registry", "wallet")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "registry": ("npm_",), "wallet": ("xprv", "yprv", "zprv")}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "forge": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "registry": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "wallet": re.compile(rb"[xyz]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"),
}
CHECKED = ("forge", "registry", "wallet")  # stand free of letters and digits on the left, and hold a checksum
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 32


def base62_crc32(body: bytes) -> bytes:
    """CRC-32 of the body as six base-62 digits."""
    x, out = zlib.crc32(body), b""
    for _ in range(6):
        x, r = divmod(x, 62)
        out = BASE62[r : r + 1] + out
    return out


def base58_holds(token: bytes) -> bool:
    """Whether the last four of 82 bytes are the start of the twofold SHA-256 of the others."""
    x = 0
    for c in token:
        x = x * 58 + BASE58.index(c)
    if x >= 1 << (82 * 8):
        return False
    raw = x.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _holds(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return m.end(1) - m.start(1) >= 8
    if kind == "access":
        return m.end() - m.start() >= 16
    if kind == "wallet":
        return base58_holds(m[0])
    return base62_crc32(m[1]) == m[2]


@lru_cache
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            found.add_word(w, (kind, len(w)))
    found.make_automaton()
    return found


def _hex_runs(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    digit = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 102))
    stops = np.concatenate([[-1], np.flatnonzero(~digit), [len(data)]])
    long = np.flatnonzero(np.diff(stops) > HEX_RUN)
    runs = []
    for a, b in zip((stops[long] + 1).tolist(), stops[long + 1].tolist(), strict=True):
        inner = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b)].tolist()
        runs += [(s, e) for s, e in zip([a, *inner], [*inner, b], strict=True) if e - s >= HEX_RUN]
    return runs


def find(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text: (start, place in KINDS, end) in bytes of the text, sorted.

    Per kind the matches are those of a left-to-right search without overlaps; a match that fails
    its length or checksum is dropped but still uses up its characters.
    """
    raw = data.tobytes()
    found: dict[int, list[tuple[int, int, int]]] = {}
    hex_kind = KINDS.index("hex")
    for a, b in _hex_runs(data, offsets):
        k = int(np.searchsorted(offsets, a, side="right")) - 1
        found.setdefault(k, []).append((a - int(offsets[k]), hex_kind, b - int(offsets[k])))
    done = dict.fromkeys(KINDS, 0)
    for last, (kind, n) in _automaton().iter(lower_ascii(data).tobytes().decode("latin-1")):
        start = last + 1 - n
        if start < done[kind]:
            continue
        k = int(np.searchsorted(offsets, start, side="right")) - 1
        if kind in CHECKED and start > offsets[k] and raw[start - 1 : start].isalnum():
            continue
        if (m := PATTERNS[kind].match(raw, start, int(offsets[k + 1]))) is None:
            continue
        done[kind] = m.end()
        if _holds(kind, m):
            found.setdefault(k, []).append((start - int(offsets[k]), KINDS.index(kind), m.end() - int(offsets[k])))
    return {k: sorted(v) for k, v in found.items()}


def code_point_spans(data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """As ``find``, in code points."""
    out = {}
    for k, spans in find(data, offsets).items():
        own = data[offsets[k] : offsets[k + 1]]
        if own.max() >= 128:
            count = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
            spans = [(int(count[a]), kind, int(count[b])) for a, kind, b in spans]
        out[k] = spans
    return out


def _digest(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = code_point_spans(*text_bytes(batch.column(1)))
    n = batch.num_rows
    counts = np.zeros((3, n), np.int64)
    base, spans = [hashlib.sha256(b"").hexdigest()] * n, [""] * n
    for k, own in found.items():
        named = [f"{KINDS[kind]}:{a}:{b}" for a, kind, b in own]
        for _, kind, _ in own:
            if kind < 3:
                counts[kind, k] += 1
        spans[k] = ",".join(named)
        base[k] = hashlib.sha256(",".join(x for x, (_, kind, _) in zip(named, own, strict=True) if kind < 3).encode()).hexdigest()
    return pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(base, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, counts of the base kinds, base_sha256, spans.

    Null texts are empty; null or repeated ids pass through, each row on its own; an empty
    table gives no row; other columns are not read.  One pass, no shuffle.
    """
    return documents.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(arrow_batches(_digest), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, mark: str = "[secret]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``documents`` with every found span replaced by ``mark``.

    Overlapping spans are replaced as one; texts without a find, and nulls, stay as they are.
    """
    names = documents.columns
    place = names.index(text_col)
    sign = mark.encode()

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(batch.column(place))
        found = find(data, offsets)
        if not found:
            return batch
        texts = batch.column(place).to_pylist()
        for k, spans in found.items():
            raw, out, at = data[offsets[k] : offsets[k + 1]].tobytes(), [], 0
            reach = -1
            for a, _, b in spans:
                if a >= max(reach, 0) or reach < 0:
                    out += [raw[at:a], sign]
                reach = max(reach, b)
                at = reach
            texts[k] = b"".join([*out, raw[at:]]).decode()
        columns = list(batch.columns)
        columns[place] = pa.array(texts, batch.schema.field(place).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return documents.mapInArrow(arrow_batches(clean, place), documents.schema)
