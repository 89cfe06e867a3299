"""SentencePiece encoding and decoding by max-plus dynamic programming, parallel within giant texts.

The segmentation with the largest sum of piece scores is found; of equal sums the one whose last
piece is longest, then the one before it, and so on.  A character that is no piece costs the
unknown score and becomes byte pieces.  Scores are added in double precision, exact for the whole
numbers of a rank-scored model.

Two characters that stand side by side in no piece are cut apart on every path, so a text falls into
words there, and each distinct word is segmented once per worker.  Giant texts are cut into chunks.
A path's state at a chunk's edge is how far its next cut lies behind it.  Every chunk gives a transfer
matrix from the states at its start to those at its end; the matrices' max-plus products give every
chunk's entry scores; chunks then say from which entry state each exit state is reached and keep how
long the best last piece before each cut is; composing the states from the right gives each chunk its
exit state, and all chunks are backtraced independently.  Where a chunk has certain cuts, only what lies
before the first and behind the last of them depends on the states.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordTable
from .common import hash_partitions, materialise, slices, text_bytes

GIANT, CHUNK = 65536, 16384
CHUNKS_A_TASK = 4
MOST_WORDS = 500_000  # distinct words that a worker remembers
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character costs beyond the lowest score


class PieceModel:
    """Pieces, scores and byte ids of a SentencePiece model file, read with the library."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        from sentencepiece import sentencepiece_model_pb2

        library = SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto.FromString(library.serialized_model_proto())
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that put a space in front and otherwise leave texts as they are can be used")
        n = library.get_piece_size()
        self.pieces = [library.id_to_piece(i) for i in range(n)]
        special = [library.is_control(i) or library.is_unknown(i) or library.is_unused(i) or library.is_byte(i) for i in range(n)]
        self.scores = {p: (float(library.get_score(i)), i) for i, (p, s) in enumerate(zip(self.pieces, special, strict=True)) if not s}
        self.bytes = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown = min(x for x, _ in self.scores.values()) - UNKNOWN_PENALTY
        self.longest = max(map(len, self.scores))
        by_word = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        inside = self.inside = {p[i : i + 2] for p in self.scores for i in range(len(p) - 1)}
        # where two bytes may be cut apart: no piece holds the two characters side by side
        self.apart = np.zeros((256, 256), bool)
        mark = lambda c: SPACE if c == 32 else chr(c)
        for x in range(128):
            for y in range(128):
                self.apart[x, y] = mark(x) + mark(y) not in inside
        self.apart[128:, 32] = by_word
        table = [b"" if library.is_control(i) or library.is_unknown(i) else bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.known: dict[str, tuple[float, list[int]]] = {}
        self.size = np.array([len(x) for x in table])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def certain_cuts(self, text: str) -> np.ndarray:
        """Places between two characters that no piece holds side by side."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        pairs, of = np.unique((points[:-1] << np.uint64(32)) | points[1:], return_inverse=True)
        apart = np.array([chr(x >> 32) + chr(x & 0xFFFFFFFF) not in self.inside for x in pairs.tolist()], bool)
        return 1 + np.flatnonzero(apart[of.reshape(-1)]) if len(pairs) else np.zeros(0, np.int64)

    def ids(self, text: str, cuts: list[int]) -> list[int]:
        """Ids of the pieces between successive cuts."""
        out: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            piece = text[a:b]
            hit = self.scores.get(piece)
            if hit is None:
                out += [self.bytes[x] for x in piece.encode()]
            else:
                out.append(hit[1])
        return out

    def forward(self, text: str, end: int, entry: list[float]) -> tuple[list[float], list[int]]:
        """Best score of every cut, and the length of the piece before it (0: entered from the chunk before).

        Cuts at ``end`` and behind are reached by pieces that start before ``end`` only.
        """
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        n = min(len(text), end + longest - 1)
        best, back = [-np.inf] * (n + 1), [0] * (n + 1)
        best[: len(entry)] = entry[: n + 1]
        for t in range(1, n + 1):
            top, hit = best[t], None
            for a in range(t - longest if t > longest else 0, min(t, end)):  # longest pieces first: they win ties
                if (hit := get(text[a:t])) is not None and (v := best[a] + hit[0]) > top:
                    top, back[t] = v, t - a
            if hit is None and t <= end and (v := best[t - 1] + unknown) > top:
                top, back[t] = v, 1
            best[t] = top
        return best, back

    def into(self, text: str) -> np.ndarray:
        """Best score from each place to the end of the text."""
        n = len(text)
        best = np.full(n + 1, -np.inf)
        best[n] = 0
        for a in range(n - 1, -1, -1):
            for t in range(a + 1, min(n, a + self.longest) + 1):
                hit = self.scores.get(text[a:t])
                if hit is not None or t == a + 1:
                    best[a] = max(best[a], best[t] + (hit[0] if hit else self.unknown))
        return best

    @staticmethod
    def trace(back: list[int], t: int) -> list[int]:
        """Cuts up to ``t``, from the one that was entered."""
        cuts = [t]
        while back[cuts[-1]]:
            cuts.append(cuts[-1] - back[cuts[-1]])
        return cuts[::-1]

    def segment(self, text: str) -> tuple[float, list[int]]:
        """Score and ids of a text (with its space marks in place)."""
        best, back = self.forward(text, len(text), [0.0])
        return best[len(text)], self.ids(text, self.trace(back, len(text)))

    def words(self, text: str, cuts: list[int]) -> list[tuple[float, list[int]]]:
        """Score and ids of what lies between successive certain cuts; each word is segmented once."""
        out = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            word = text[a:b]
            if (hit := self.known.get(word)) is None:
                if len(self.known) >= MOST_WORDS:
                    self.known.clear()
                hit = self.known[word] = self.segment(word)
            out.append(hit)
        return out

    def matrix(self, text: str, end: int) -> np.ndarray:
        """Transfer matrix of a chunk: best score from entry state i to exit state j."""
        k = self.longest
        cuts = self.certain_cuts(text[: end + 1]).tolist()
        if cuts:
            enter = np.full(k, -np.inf)
            enter[: cuts[0] + 1] = self.into(text[: cuts[0]])[:k]
            leave = np.full(k, -np.inf)
            tail = self.forward(text[cuts[-1] :], end - cuts[-1], [0.0])[0][end - cuts[-1] :]
            leave[: len(tail)] = tail
            return enter[:, None] + sum(x for x, _ in self.words(text, cuts)) + leave
        n = min(len(text), end + k - 1)
        best = np.full((n + 1, k), -np.inf)
        best[np.arange(min(k, n + 1)), np.arange(min(k, n + 1))] = 0
        for t in range(1, n + 1):
            for a in range(max(0, t - k), min(t, end)):
                hit = self.scores.get(text[a:t])
                if hit is not None or a == t - 1:
                    np.maximum(best[t], best[a] + (hit[0] if hit else self.unknown), out=best[t])
        out = np.full((k, k), -np.inf)
        out[:, : n - end + 1] = best[end:].T
        return out

    def chunk(self, text: str, end: int, entry: list[float]) -> tuple[list[int], list[int], str, list[int], int]:
        """What a chunk's entry scores decide.

        The entry state that each exit state comes from, the ids up to the last certain cut, the
        text behind it (all of it without such a cut), the piece lengths there, and the chunk's end in it.
        """
        cuts = self.certain_cuts(text[: end + 1]).tolist()
        if not cuts:
            best, back = self.forward(text, end, entry)
            comes = [0 if t >= len(best) or best[t] == -np.inf else self.trace(back, t)[0] for t in range(end, end + self.longest)]
            return comes, [], text, back, end
        _, back = self.forward(text[: cuts[0]], cuts[0], entry[: cuts[0] + 1])
        head = self.trace(back, cuts[0])
        ids = self.ids(text, head)
        for _, own in self.words(text, cuts):
            ids += own
        tail = text[cuts[-1] :]
        return [head[0]] * self.longest, ids, tail, self.forward(tail, end - cuts[-1], [0.0])[1], end - cuts[-1]

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of the ids; the space that encoding put in front goes."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)
        raw = self.flat[at].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


class PieceTable(WordTable):
    """Ids of words (what lies between certain cuts) seen so far."""

    def load(self, path: str) -> None:
        self.model = PieceModel(path)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        return [self.model.segment(w.decode().replace(" ", SPACE))[1] for w in words]

    def encode_whole(self, text: str) -> list[int]:
        return self.model.segment(text.replace(" ", SPACE))[1]

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data), bool)
        cut[1:] = self.model.apart[data[:-1], data[1:]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        odd = np.zeros(len(data), bool)  # texts with the mark itself, or NUL, go as a whole
        mark = np.frombuffer(SPACE.encode(), np.uint8)
        odd[:-2] |= (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
        odd |= data == 0
        return np.flatnonzero(cut), odd

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        some = np.diff(offsets) > 0
        if not some.any():
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        data = np.insert(data, offsets[:-1][some], 32)
        return self.encode_bytes(data, offsets + np.concatenate([[0], np.cumsum(some)]))


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """The worker's table for a model file."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


_ENCODED = "doc_id long, text_sha256 string, ids array<int>"


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, bounds = piece_table(path).encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _lists(ids, bounds)], ["doc_id", "text_sha256", "ids"])

    return run


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ahead = piece_table(path).model.longest - 1
        for batch in slices(batches):
            for doc_id, text, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = SPACE + text.replace(" ", SPACE)
                n = max(1, len(text) // CHUNK)
                for k in range(n):
                    end = len(text) if k == n - 1 else (k + 1) * CHUNK
                    yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([k]), pa.array([doc_id], pa.int64()), pa.array([digest]), pa.array([text[k * CHUNK : end + ahead]]), pa.array([end - k * CHUNK])], ["row", "k", "doc_id", "text_sha256", "text", "size"])
                number += 1

    return run


def _matrices(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_table(path).model
        for batch in batches:
            out = [model.matrix(t, n).tobytes() for t, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["row", "k", "matrix"])

    return run


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two transfer matrices; associative."""
    return (a[:, :, None] + b[None]).max(axis=1)


def prefix_products(matrices: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling the reach."""
    out, reach = matrices.copy(), 1
    while reach < len(out):
        out[reach:] = np.stack([max_plus(a, b) for a, b in zip(out[:-reach], out[reach:], strict=True)])
        reach *= 2
    return out


def _entries(table: pa.Table) -> pa.Table:
    """Entry scores of every chunk of one text."""
    table = table.sort_by("k")
    raw = table.column("matrix").to_pylist()
    size = int(round((len(raw[0]) // 8) ** 0.5))
    products = prefix_products(np.stack([np.frombuffer(x, np.float64).reshape(size, size) for x in raw]))
    first = np.full(size, -np.inf)
    first[0] = 0
    entry = [first, *(p[0] for p in products[:-1])]
    return pa.table({"row": table.column("row"), "k": table.column("k"), "entry": pa.array([e.tobytes() for e in entry], pa.binary())})


_INSIDE = "row long, k long, doc_id long, text_sha256 string, comes array<long>, ids binary, tail string, back binary, size long"


def _inside(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_table(path).model
        for batch in batches:
            rows = [model.chunk(t, n, np.frombuffer(e, np.float64).tolist()) for t, n, e in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6)), strict=True)]
            comes, ids, tail, back, size = zip(*rows, strict=True) if rows else [()] * 5
            packed = [pa.array([np.array(x, "<i4").tobytes() for x in y], pa.binary()) for y in (ids, back)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(comes, pa.list_(pa.int64())), packed[0], pa.array(tail, pa.string()), packed[1], pa.array(size, pa.int64())], ["row", "k", "doc_id", "text_sha256", "comes", "ids", "tail", "back", "size"])

    return run


def _exits(table: pa.Table) -> pa.Table:
    """Exit state of every chunk of one text: the last one ends at the text's end."""
    table = table.sort_by("k")
    state, out = 0, []
    for comes in table.column("comes").to_pylist()[::-1]:
        out.append(state)
        state = comes[state]
    return pa.table({"row": table.column("row"), "k": table.column("k"), "leave": pa.array(out[::-1], pa.int64())})


def _backtrace(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_table(path).model
        for batch in batches:
            out = []
            for ids, tail, back, size, leave in zip(*(batch.column(c).to_pylist() for c in (4, 5, 6, 7, 8)), strict=True):
                cuts = model.trace(np.frombuffer(back, "<i4").tolist(), size + leave)
                out.append(ids + np.array(model.ids(tail, cuts), "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.binary())], ["row", "k", "doc_id", "text_sha256", "ids"])

    return run


def _together(table: pa.Table) -> pa.Table:
    table = table.sort_by("k")
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), "<i4")
    return pa.table({"doc_id": table.column("doc_id")[:1], "text_sha256": table.column("text_sha256")[:1], "ids": pa.array([ids.tolist()], pa.list_(pa.int32()))})


def encode(documents: DataFrame, model: str, giant: int = GIANT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, text_sha256, ids.

    Null and empty texts have no ids; null or repeated ids pass through, each row on its own;
    other columns are not read.  Texts of more than ``giant`` characters are spread over tasks.
    """
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("text_sha256", F.sha2("text", 256))
    short = texts.where(F.length("text") <= giant).mapInArrow(_short(model), _ENCODED)
    giants = texts.where(F.length("text") > giant)
    chunks = materialise(giants.mapInArrow(_chunks(model), "row long, k long, doc_id long, text_sha256 string, text string, size long"), "chunks")
    tasks = max(hash_partitions(documents.sparkSession), -(-chunks.count() // CHUNKS_A_TASK))  # by chunks: their bytes are few, their work is not
    spread = chunks.select("row", "k", "text", "size").repartition(tasks, "row", "k")
    matrices = spread.mapInArrow(_matrices(model), "row long, k long, matrix binary")
    entries = materialise(matrices.groupBy("row").applyInArrow(_entries, "row long, k long, entry binary"), "entries")
    entered = chunks.join(entries.hint("merge"), ["row", "k"]).select("row", "k", "doc_id", "text_sha256", "text", "size", "entry")
    inside = materialise(entered.repartition(tasks, "row", "k").mapInArrow(_inside(model), _INSIDE), "inside")
    exits = inside.select("row", "k", "comes").groupBy("row").applyInArrow(_exits, "row long, k long, leave long")
    final = inside.join(exits.hint("merge"), ["row", "k"]).select("row", "k", "doc_id", "text_sha256", "ids", "tail", "back", "size", "leave").repartition(tasks, "row", "k")
    long = final.mapInArrow(_backtrace(model), "row long, k long, doc_id long, text_sha256 string, ids binary").groupBy("row").applyInArrow(_together, _ENCODED)
    return short.union(long)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), decoded_sha256, round_trip of encoded rows.

    Decoding gives back every text exactly, except that the space mark itself comes back as a space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model).model
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            n, sums, digests = [], [], []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = flat[a:b]
                n.append(b - a)
                sums.append(zlib.crc32(own.astype("<i4")))
                digests.append(hashlib.sha256(pieces.decode(own)).hexdigest())
            same = [x == y for x, y in zip(digests, batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), pa.array(digests, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return encoded.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
