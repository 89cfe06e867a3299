"""Phrase mining against plain counting: the index alone, small fixtures in many shards, odd rows."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF

from shopatlas.llm import collocations
from shopatlas.llm.collocations import FMIndex

SCHEMA = "doc_id long, lang string, text string, k long, n long, phrase string, word string"


def plain(docs, least, keep):
    pieces = []
    for lang, text in docs:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        pieces += [(lang or "und", re.findall(r"[^ \t]+", p)) for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]
    f = defaultdict(Counter)
    for lang, words in pieces:
        for size in (1, 2, 3):
            f[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        often = {k: v for k, v in count.items() if len(k) > 1 and v >= least}
        rows = []
        for p, a in often.items():
            if len(p) == 2 and any(100 * often.get(q, 0) >= 50 * a for q in often if len(q) == 3 and p in (q[:2], q[1:])):
                continue
            cut = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-cut[0], -a, " ".join(p).encode(), count[p[: cut[1]]], count[p[cut[1] :]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:keep])]
    return sorted(out)


def table(spark, docs, parts=5):
    return spark.createDataFrame([(i, lang, text, 1, 2, "p", "w") for i, (lang, text) in enumerate(docs)], SCHEMA).repartition(parts)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("wide", [False, True])
def test_index_enumerates_every_phrase(wide):
    rng = np.random.default_rng(3)
    text = rng.integers(0, 7, 2000)
    if wide:  # symbols of more bits than three of which go into a word
        text = np.where(text > 0, text + (1 << 22), 0)
    text[-1] = 0
    index = FMIndex.build(text, int(text.max()) + 1)
    want = {size: Counter(t for t in zip(*(text[k:].tolist() for k in range(size)), strict=False) if 0 not in t) for size in (1, 2, 3)}
    ones, symbol = index.symbols()
    assert dict(zip([(s,) for s in symbol.tolist()], ones[:, 2].tolist(), strict=True)) == want[1]
    right, owner, last = index.extend(ones, left=False)
    two = list(zip(symbol[owner].tolist(), last.tolist(), strict=True))
    assert dict(zip(two, right[:, 2].tolist(), strict=True)) == want[2]
    for left in (True, False):  # both ways give the same phrases, and intervals that can be extended on
        longer, owner, new = index.extend(right, left)
        three = [(n, *two[o]) if left else (*two[o], n) for n, o in zip(new.tolist(), owner.tolist(), strict=True)]
        assert dict(zip(three, longer[:, 2].tolist(), strict=True)) == want[3]


@pytest.mark.parametrize("size", [200, 8 << 20])
def test_collocations_equal_plain_counting(spark, monkeypatch, size):
    monkeypatch.setattr(collocations, "SHARD_BYTES", size)
    rng = random.Random(size)
    words = ["The", "cat", "sat", "é", "中文", "new", "york", "x" * 40, "a\xa0b", "of"]
    docs = []
    for k in range(400):
        lang = ("en", "fr", None)[k % 3] if k % 2 else "en"
        docs.append((lang, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\r\n"]) for _ in range(rng.randint(0, 40))) + "new york city"))
    docs += [("en", "of the cat of the cat of the cat")] * 60 + [("rare", "just once here")]
    assert found(collocations.collocations(table(spark, docs), least=5, keep=60)) == plain(docs, 5, 60)


def test_collocations_of_the_table_equal_plain_counting(spark):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    assert found(collocations.collocations(df)) == plain(docs, 10, 2000)


def test_nulls_empty_texts_and_long_ones(spark):
    docs = [(None, None), ("en", ""), ("en", " \t.,"), ("en", "One"), ("en", "go on " * 50_000), (None, "go on " * 12), ("x", "a.b," * 20)]
    assert found(collocations.collocations(table(spark, docs))) == plain(docs, 10, 2000)
    assert collocations.collocations(table(spark, docs).limit(0)).count() == 0


def test_large_counts_stay_exact(spark):
    words = spark.createDataFrame([("en", "a", 900_000_000_000_007), ("en", "b", 800_000_000_000_011)], "lang string, phrase string, f long")
    phrases = spark.createDataFrame([("en", "a b", 2, 700_000_000_000_013)], "lang string, phrase string, words int, f long")
    r = collocations.score(words, phrases).first()
    assert (r.l, r.r) == (900_000_000_000_007, 800_000_000_000_011)
    assert r.score == 1_000_000 * 700_000_000_000_013**2 // (900_000_000_000_007 * 800_000_000_000_011)
