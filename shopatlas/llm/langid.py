"""Language identification with a byte convolutional network, trained and applied in numpy.

Embedded bytes, filters of several widths, max pooling over a fixed-length window and softmax.
All windows of a text are scored; the text's probabilities are the windows' means weighted by
their letters.  The filters of all widths are one matrix product per batch of windows.
"""
from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, slices, text_bytes

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
TRAIN_PER_LANGUAGE, TRAIN_WINDOWS = 400, 6
TRAIN_MOST = 25_600  # documents in all: with more than 64 languages each has an even share, one at least
EPOCHS, BATCH, RATE = 5, 64, 0.01
UNKNOWN = "und"


@dataclass
class ByteNetwork:
    """Weights; ``filters`` has a row for each place in the widest filter and embedding part."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """The bytes under each filter position, embedded: (windows, positions, width * EMBED)."""
        wide = np.zeros((len(windows), windows.shape[1] + max(WIDTHS) - 1), np.uint8)
        wide[:, : windows.shape[1]] = windows
        x = self.embedding[wide]
        n = windows.shape[1]
        return np.concatenate([x[:, j : j + n] for j in range(max(WIDTHS))], axis=2)

    def pooled(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = (columns.reshape(-1, columns.shape[2]) @ self.filters).reshape(*columns.shape[:2], -1)
        return out, np.maximum(out.max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [softmax(self.pooled(self.columns(windows[lo : lo + BATCH]))[1] @ self.dense + self.offset) for lo in range(0, len(windows), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> ByteNetwork:
    """Fit by Adam on windows (n, WINDOW) of bytes and label numbers."""
    rng = np.random.default_rng(seed)
    width, kinds = max(WIDTHS), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat(np.arange(width) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1).astype(np.float32)
    net = ByteNetwork(languages, rng.normal(0, 1, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.3, (width * EMBED, kinds)) * mask).astype(np.float32), np.zeros(kinds, np.float32), rng.normal(0, 0.3, (kinds, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embedding[0] = 0
    names = ("embedding", "filters", "bias", "dense", "offset")
    first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            columns = net.columns(windows[pick])
            out, hidden = net.pooled(columns)
            p = softmax(hidden @ net.dense + net.offset)
            p[np.arange(len(pick)), labels[pick]] -= 1
            p /= len(pick)
            d_hidden = (p @ net.dense.T) * (hidden > 0)
            at = out.argmax(axis=1)
            patch = columns[np.arange(len(pick))[:, None], at]
            grads = {"dense": hidden.T @ p, "offset": p.sum(0), "bias": d_hidden.sum(0), "filters": np.einsum("nfc,nf->cf", patch, d_hidden, optimize=True) * mask}
            d_patch = (d_hidden[:, :, None] * net.filters.T[None]).reshape(len(pick), kinds, width, EMBED)
            wide = np.zeros((len(pick), WINDOW + width - 1), np.uint8)
            wide[:, :WINDOW] = windows[pick]
            under = wide[np.arange(len(pick))[:, None, None], at[:, :, None] + np.arange(width)]
            grads["embedding"] = np.stack([np.bincount(under.ravel(), d_patch[..., e].ravel(), 256) for e in range(EMBED)], 1)
            grads["embedding"][0] = 0
            step += 1
            for k in names:
                g = grads[k].astype(np.float32)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                getattr(net, k)[...] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteNetwork:
    """Train on about TRAIN_PER_LANGUAGE documents of every language (fewer where there are fewer), TRAIN_MOST in all.

    The sample is drawn by a hash of id and text among rows with text and language that are not held out,
    and rows alike in both count once; TRAIN_WINDOWS windows spread over each text are used.  Only these
    come to the driver.  Every label is learned; more labels than TRAIN_MOST are an error.
    """
    known = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    known = known.withColumn("h", F.xxhash64("doc_id", "text", F.lit("train")))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(TRAIN_MOST + 1).collect()}
    if len(counts) > TRAIN_MOST:
        raise ValueError(f"more than {TRAIN_MOST} languages to learn")
    if not counts:
        return ByteNetwork([], *[np.zeros((0, 0), np.float32)] * 5)
    each = max(1, min(TRAIN_PER_LANGUAGE, TRAIN_MOST // len(counts)))
    share = F.element_at(F.from_json(F.lit(json.dumps({k: min(1.0, each / n) for k, n in counts.items()})), "map<string, double>"), F.col("lang"))
    drawn = F.pmod("h", F.lit(1 << 20)) < share * (1 << 20)
    if each < TRAIN_PER_LANGUAGE:  # a draw of few may miss a language, so its first row by hash is taken in any case
        first = known.groupBy("lang").agg(F.min("h").alias("h"))
        sample = known.where(drawn).unionByName(known.join(first.hint("merge"), ["lang", "h"], "left_semi").select(*known.columns))
    else:
        sample = known.where(drawn)
    sample = sample.dropDuplicates(["lang", "h"])
    size = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(TRAIN_WINDOWS - 1)), lambda i: F.substring("text", (i * F.greatest(size - WINDOW, F.lit(0)) / (TRAIN_WINDOWS - 1)).cast("int") + 1, WINDOW))
    rows = sorted(((r.doc_id, r.lang, r.p) for r in sample.select("doc_id", "lang", F.array_distinct(pieces).alias("p")).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    languages = sorted(counts)
    pairs = [(x.encode()[:WINDOW], languages.index(lang)) for _, lang, p in rows for x in p if x]
    if not pairs:
        return ByteNetwork([], *[np.zeros((0, 0), np.float32)] * 5)
    windows = np.frombuffer(b"".join(x.ljust(WINDOW, b"\0") for x, _ in pairs), np.uint8).reshape(-1, WINDOW)
    return train(lower_ascii(windows), np.array([y for _, y in pairs]), languages)


def _letters(data: np.ndarray) -> np.ndarray:
    return ((data >= 97) & (data <= 122)) | (data >= 128)


def text_scores(net: ByteNetwork, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probabilities of the languages for each text; all windows of the whole text count."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    per = -(-size // WINDOW)
    of = np.repeat(np.arange(n), per)
    ends = np.cumsum(per)
    start = offsets[:-1][of] + (np.arange(int(ends[-1])) - (ends - per)[of]) * WINDOW
    low = np.concatenate([lower_ascii(data), np.zeros(WINDOW, np.uint8)])
    total = np.zeros((n, len(net.languages)))
    weight = np.zeros(n)
    for lo in range(0, len(start), 4096):
        s, t = start[lo : lo + 4096], of[lo : lo + 4096]
        windows = low[s[:, None] + np.arange(WINDOW)]
        windows[np.arange(WINDOW) >= (offsets[t + 1] - s)[:, None]] = 0
        w = _letters(windows).sum(1) + 1e-6
        p = net.probabilities(windows)
        for k in range(len(net.languages)):
            total[:, k] += np.bincount(t, p[:, k] * w, n)
        weight += np.bincount(t, w, n)
    return total / np.maximum(weight, 1e-9)[:, None]


def _judge(net: ByteNetwork, texts: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not net.languages:
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    p = text_scores(net, *text_bytes(texts))
    best = p.argmax(1)
    score = np.clip(p[np.arange(len(p)), best], 0, 1)
    return np.where(lettered, np.array(net.languages, object)[best], UNKNOWN), np.where(lettered, score, 0.0)


LETTERED = r"coalesce(rlike(text, '\\p{L}'), false)"


def predict(documents: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, lang_pred, score.

    A null text, or one without any letter, is ``und`` with score 0, and so is every text when
    no labelled text was there to learn from.  Null and repeated ids pass through (null is not held
    out); an empty table gives no row; only id and text are read.  One pass, no shuffle.
    """

    def run(batches):
        for batch in slices(batches):
            lang, score = _judge(net, batch.column(1), batch.column(3).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    read = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    return read.select("*", F.expr(LETTERED)).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, net: ByteNetwork, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is identified with at least this score."""
    place, names = documents.columns.index(text_col), documents.columns

    def run(batches):
        for batch in slices(batches, place):
            lang, score = _judge(net, batch.column(place), batch.column(len(names)).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=names).filter(pa.array((lang != UNKNOWN) & (score >= least)))

    lettered = F.expr(LETTERED.replace("text", f"`{text_col}`")).alias(free_name(documents, "_lettered"))
    return documents.select("*", lettered).mapInArrow(run, documents.schema)
