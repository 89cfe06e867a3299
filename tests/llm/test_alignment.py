"""Token alignment against a plain merge of both token lists, on the table and on odd texts."""
import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF

from shopatlas.llm import alignment, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")


def plain(texts, paths):
    """The columns from (doc_id, text) pairs, by the libraries and two pointers."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    byte_bpe, pieces = Tokenizer.from_file(paths[0]), SentencePieceProcessor(model_file=paths[1])
    byte_bpe.encode_special_tokens = True
    chars = alignment.byte_characters()
    a_bytes = {i: bytes(chars[c] for c in s) if s != "<|endoftext|>" else b"" for s, i in byte_bpe.get_vocab().items()}
    b_bytes = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
    count, found = Counter(), []
    for doc_id, text in texts:
        text, groups, links = text or "", [], []
        a, b = (byte_bpe.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        if any(b"".join(x) != (" " + text).encode() for x in ([a_bytes[i] for i in a], [b_bytes(i) for i in b])):
            a = b = []
        i = j = end_a = end_b = 0
        while i < len(a):
            if end_a == end_b:
                groups.append(([], []))
            if end_a <= end_b:
                took_a, took_b = True, end_a == end_b
            else:
                took_a, took_b = False, True
            if took_a:
                groups[-1][0].append(a[i])
                end_a += len(a_bytes[a[i]])
                i += 1
            if took_b:
                groups[-1][1].append(b[j])
                end_b += len(b_bytes(b[j]))
                j += 1
            links.append((a[i - 1], b[j - 1]))
            while end_b < end_a and i == len(a):  # what is left of b under the last a
                groups[-1][1].append(b[j])
                links.append((a[i - 1], b[j]))
                end_b += len(b_bytes(b[j]))
                j += 1
        while j < len(b):
            raise AssertionError("a ended before b")
        count.update(links)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((doc_id, len(a), len(b), groups, links, told))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(d, na, nb, len(g), len(k), sum(count[x] == top[x[1]] for x in k), sum(count[x] for x in k), s) for d, na, nb, g, k, s in found]


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


@pytest.mark.parametrize("size", [1 << 12, 4 << 20])
def test_alignment_equals_a_plain_merge(spark, paths, monkeypatch, size):
    monkeypatch.setattr(alignment, "SLICE_TEXT", size)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = queries.op12_alignment(spark, SF).withColumnRenamed("groups_sha256", "groups").select(*COLUMNS).collect()
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in plain(texts, paths)]
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)


def test_alignment_edges(spark, paths):
    odd = ["", None, " ", "   ", "a", " a  b ", "x▁y", "nul\x00byte", "tab\tand\r\n\x0b", "<s><|endoftext|></s><0x0A>", "中文😀 é́", "a" * 5000, "don't  stop " * 30, "   wide", "a", "a"]
    rows = [(k if k != 4 else None, t, 1, 2, "p") for k, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slice long, n_a int, pair string")
    found = alignment.align_documents(docs.repartition(3), *paths, keep_groups=True).select(*COLUMNS).collect()
    want = plain([r[:2] for r in rows], paths)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert [r[1:] for r in want if r[0] == 6] == [(0, 0, 0, 0, 0, 0, "")]
    assert alignment.align_documents(docs.limit(0), *paths).count() == 0


def test_packed_arrays_come_back():
    for arrays in ([], [[]], [[1, 2], [], [3]]):
        assert [x.tolist() for x in alignment.unpack(alignment.pack(*map(np.array, arrays)))] == arrays


def test_group_strings_by_hand(paths):
    import pyarrow as pa

    entries = pa.array([b"", b" ", b"ab", b" a", b"b", b" ab"], pa.large_binary())
    a, b = alignment._lists(np.array([3, 4, 5]), np.array([0, 2, 2, 3])), alignment._lists(np.array([1, 2, 1, 2]), np.array([0, 2, 2, 4]))
    links = alignment.align(a, b, entries, entries)
    assert alignment.group_strings(a, b, links, 3) == ["3,4|1,2", "", "5|1,2"]
    assert links.num_rows == 5
