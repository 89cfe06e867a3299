"""The training-data operators against brute force, exact round trips and held-out accuracy, with edge cases."""
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import corpus_pipeline
from shopatlas.llm import bpe, embedding_dedup, exact_dedup, jaccard, langid, packing, pieces, queries, repeats, secrets, simple8b, token_files, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, id string, runs string"
RNG = random.Random(11)
LONG = " ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "Épsilon", "zeta"]) + str(RNG.randint(0, 99)) for _ in range(30_000))
CASES = [(1, None), (2, ""), (3, " \t\n"), (4, "Hello World"), (5, "hello world"), (6, "hello world"), (None, "no id"), (None, None), (8, "é" * 120), (9, LONG), (10, LONG), (11, LONG + " end"), (12, "中文 text 😀 don't  stop\n\n")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "x", 1, "a", "id", "runs") for i, t in CASES], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def corpus(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(queries.tokenizer_path())
    found.encode_special_tokens = True
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    assert rows(df.select(*columns).collect()) == rows(rel.select(*columns).fetchall())


# token ids


def test_ids_equal_the_library(tokenizer):
    rng = random.Random(1)
    letters = "ab's tlrevmd'  \n\t!?12é ß　中<|>"
    texts = ["", None, "don't  we'll\n\n'tis 'sx a!'s ", "x\n", " 'S 'LL", "0's½'t²", "emoji 😀 ok", "a\x1cb", "<|endoftext|>", LONG[:5000]] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    table = bpe.WordTable(queries.tokenizer_path(), most=500)
    for _ in range(2):
        ids, bounds = table.encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 50257, 2**40, 2**63])
def test_simple8b_round_trip(n, top):
    v = np.random.default_rng(n).integers(0, top, n).astype(np.uint64)
    v[1:3] = [2**64 - 1, 2**60][: len(v[1:3])]
    words, starts, odd = simple8b.encode(v)
    assert (simple8b.decode(words, starts, odd, n) == v).all()


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, corpus, tokenizer):
    start = 0
    for r in sorted(queries.op6_token_output(spark, SF).collect()):
        ids = tokenizer.encode(corpus[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), _crc(ids))
        start += len(ids)


def test_token_files_cut_rows_alike_in_id_and_text(spark, tmp_path):
    own = F.col("id") % 3 == 0
    df = spark.range(3000).select(F.when(own, F.col("id")).otherwise(7).alias("doc_id"), F.when(own, F.format_string("text %d", "id")).otherwise("always the same").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    files = token_files.write_token_files(df.repartition(4), str(tmp_path / "tokens"), queries.tokenizer_path())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert token_files.read_token_files(files).count() == 3000
    held = sorted(r.n for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    assert len(held) == 4 and held[-1] < 0.4 * sum(held)


def test_token_files_edges(docs, none, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT_IDS", 3)
    out = token_files.token_output(docs, queries.tokenizer_path()).orderBy("start").collect()
    assert [r.doc_id for r in out] == sorted((i for i, _ in CASES), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in out] == np.concatenate([[0], np.cumsum([r.n_tokens for r in out])[:-1]]).tolist()
    assert token_files.token_output(none, queries.tokenizer_path()).count() == 0


def test_packing(spark, corpus, tokenizer):
    sequences, cover = {}, {}
    for r in queries.op2_packing(spark, SF).collect():
        ids = tokenizer.encode(corpus[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == _crc(ids[r.start : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        cover.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(cover) == set(corpus)
    for spans in [*sequences.values(), *cover.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at and n > 0
            at += n
    sizes = [sum(n for _, n in s) for s in sequences.values()]
    assert max(sizes) <= 2048 and all(n & (n - 1) == 0 for n in sizes)  # so nothing is padded


def test_packing_edges(docs, none):
    out = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    assert sum(r.length for r in out) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens for r in out if r.doc_id}.values()) + sum(r.length for r in out if r.doc_id is None)
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    doc, start, length, seq, offset, _ = packing.pack(np.array([5000, 1, 2048, 700, 0, 700, 700]))
    assert length.sum() == 9149 and np.bincount(doc, length, 7).tolist() == [5000, 1, 2048, 700, 0, 700, 700]


def test_packing_follows_the_cost_rule():
    rng = random.Random(9)
    for _ in range(30):
        lengths = [rng.choice([0, rng.randint(1, 40), rng.randint(1, 200)]) for _ in range(rng.randint(1, 40))]
        got = sorted(zip(*(x.tolist() for x in packing.pack(np.array(lengths), 64)[:5])))
        rest = [n % 64 for n in lengths]
        tail = sum(rest) % 64
        room = [64] * (sum(rest) // 64) + [1 << k for k in range(6, -1, -1) if tail >> k & 1]
        size, cost = list(room), [0.0] * len(room)
        want, n_whole = [], 0
        for d, n in enumerate(lengths):
            for k in range(n // 64):
                want.append((d, 64 * k, 64, n_whole, 0))
                n_whole += 1
        for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
            left, at = rest[d], lengths[d] - rest[d]
            while left:
                able = [s for s in range(len(room)) if room[s] >= left] or [s for s in range(len(room)) if room[s]]
                s = min(able, key=lambda s: (cost[s], s))
                n = min(left, room[s])
                want.append((d, at, n, n_whole + s, size[s] - room[s]))
                room[s] -= n
                cost[s] += packing.LINEAR * n + packing.QUADRATIC * n * n
                left, at = left - n, at + n
        assert got == sorted(want)


def test_packing_has_one_tail_a_task(spark, monkeypatch):
    monkeypatch.setattr(packing, "slices", lambda batches: packing_slices(batches, most=2000))
    from shopatlas.llm.common import slices as packing_slices

    df = spark.createDataFrame([(k, "some words and more " * (k % 90)) for k in range(200)], "doc_id long, text string").coalesce(1)
    sizes = {}
    for r in packing.pack_documents(df, queries.tokenizer_path()).collect():
        sizes[r.sequence_id] = sizes.get(r.sequence_id, 0) + r.length
    assert sum(n < 2048 for n in sizes.values()) <= 11 and len(sizes) > 15


# exact and near duplicates


def test_exact_dedup_edges(docs, none):
    out = exact_dedup.exact_dedup(docs).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(CASES)
    assert (by[4].keep_id, by[4].group_size, by[4].kept, by[6].kept) == (6, 3, False, True)
    assert (by[1].keep_id, by[2].kept, by[9].keep_id, by[10].kept) == (2, True, 10, True)
    assert by[9].text_sha256 == hashlib.sha256(re.sub("[A-Z]", lambda m: m[0].lower(), LONG).encode()).hexdigest()
    assert exact_dedup.exact_dedup(none).count() == 0


def test_chunks_cover_and_align():
    data = np.random.default_rng(0).integers(0, 256, 300_000).astype(np.uint8)
    edges = exact_dedup.chunk_edges(data, np.array([0, len(data)]))
    moved = exact_dedup.chunk_edges(np.concatenate([np.zeros(77, np.uint8), data]), np.array([0, len(data) + 77]))
    assert edges[0] == 0 and np.diff(np.append(edges, len(data))).max() <= exact_dedup.LONGEST_CHUNK
    assert len(set(edges.tolist()) & set((moved - 77).tolist())) > 0.9 * len(edges)


def _shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _near_brute(cases):
    sets = {i: _shingles(t) for i, t in cases}
    root = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


def _edited(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randint(0, 10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("small_bucket", [1024, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small_bucket):
    """Groups of near copies about the threshold, a passage in many texts, tiny texts."""
    monkeypatch.setattr(jaccard, "SMALL_BUCKET", small_bucket)
    rng = random.Random(small_bucket)
    texts = []
    for size in (3, 5, 6, 8, 12, 20, 40, 90, 200):
        base = [f"t{rng.randint(0, 400)}" for _ in range(size)]
        texts += [_edited(rng, base, k % 6) for k in range(14)]
    passage = " ".join(f"p{k}" for k in range(40))
    texts += [passage + " " + _edited(rng, ["q"] * 30, 30) for _ in range(25)] + ["one", "ONE", "two words", "", None]
    cases = list(enumerate(texts))
    df = spark.createDataFrame(cases, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert got == _near_brute(cases)


def test_near_duplicates_bound_groups_of_a_shared_passage(spark, monkeypatch):
    passage = " ".join(f"common{k}" for k in range(60))
    texts = [f"{passage} " + " ".join(f"own{i}x{k}" for k in range(50)) for i in range(300)]
    texts.append(texts[7] + " end")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 32)
    compare, seen = jaccard._compare, spark.sparkContext.accumulator(0)

    def bounded(table):
        seen.add(1)
        assert len(table) <= 4 * 32
        return compare(table)

    monkeypatch.setattr(jaccard, "_compare", bounded)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert seen.value > 0 and got == {i: i for i in range(300)} | {300: 7}


def test_near_duplicates_of_words_that_clash_in_polynomial_hashes(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2**64 under every odd base."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    text = " ".join(f"w{k}" for k in range(7))
    cases = [(1, word), (2, other), (3, f"{text} {word}"), (4, f"{text} {other}"), (5, word.upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert got == _near_brute(cases) and got[2][1] == 2 and got[4][1] == 4


def test_exact_shingles_equal_words():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(300)]
    text, number = jaccard.exact_shingles(*bpe.text_bytes(pa.array(texts)))
    want = [(k, tuple(w[i : i + 5])) for k, t in enumerate(texts) if (w := t.split()) for i in range(max(1, len(w) - 4))]
    assert text.tolist() == [k for k, _ in want]
    names = {}
    assert all(names.setdefault(x, n) == n for (_, x), n in zip(want, number.tolist())) and len(set(names.values())) == len(names)


def test_near_duplicates_deal_hot_signatures_over_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 1)
    rng = random.Random(7)
    base = [f"t{rng.randint(0, 400)}" for _ in range(60)]
    passage = " ".join(f"common{k}" for k in range(60))
    texts = [_edited(rng, base, k % 9) for k in range(150)] + [passage + " " + _edited(rng, ["q"] * 30, 30) for _ in range(120)]
    cases = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(cases, "doc_id long, text string").repartition(3)).collect()}
    assert got == _near_brute(cases)


def test_near_duplicates_edges(docs, none):
    out = jaccard.near_duplicates(docs).collect()
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in out if r.doc_id is not None}
    assert len(out) == len(CASES) and by[1] == (0, 1) and by[3] == (0, 3) and by[6] == (1, 4) and by[11][1] == by[10][1] == 9
    assert jaccard.near_duplicates(none).count() == 0


def test_allotments_find_every_linked_pair():
    """Pigeonhole: linked sets always share a signature that one of them probes."""
    rng = np.random.default_rng(5)
    for size in (1, 3, 4, 7, 9, 14, 25, 47, 49, 64, 120, 400):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = rng.integers(0, max(1, len(a) // 7) + 1)
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**63, gone).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 4 * common < 3 * (len(a) + len(b) - common):
                continue
            sets, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            cost = rng.integers(0, 50, len(sets))
            of, sign, code, _ = jaccard.signatures(sets, bounds, cost)
            big, small = (0, 1) if len(a) >= len(b) else (1, 0)
            asks = {s: c for s, c in zip(sign[of == big].tolist(), code[of == big].tolist()) if c >= 4}
            hit = [s for s, c in zip(sign[of == small].tolist(), code[of == small].tolist()) if s in asks and jaccard.probes(np.array([asks[s]]), np.array([c]))[0]]
            assert hit
            x, y = jaccard.bitmaps(sets, bounds)
            assert jaccard.maps_differ(x, y) <= len(a) + len(b) - 2 * common


# repeats


def _repeats_brute(cases):
    seen, out = set(), {}
    for i, t in sorted(cases):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def _repeats(df):
    return {r.doc_id: tuple(r)[1:] for r in repeats.remove_repeats(df).collect()}


@pytest.mark.parametrize("hot, wide", [(8, 4096), (1, 4096), (8, 1)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, wide):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "WIDE_CORE", wide)
    rng = random.Random(3)
    blocks = ["".join(rng.choice("xyzw ") for _ in range(130)) for _ in range(6)]
    texts = ["ab" * 300, "a" * 450, "a" * 99, "a" * 100, None, "", "é" * 120] + ["".join(rng.choice("ab") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    texts += ["".join(rng.choice(blocks)[rng.randint(0, 30) :] for _ in range(5)) for _ in range(60)]
    cases = [(i * 3 - 9, t) for i, t in enumerate(texts)]
    monkeypatch.setattr(repeats, "PART_BYTES", 5000)  # several parts a task
    assert _repeats(spark.createDataFrame(cases, "doc_id long, text string").repartition(5)) == _repeats_brute(cases)


def test_suffix_ranks_are_the_order_of_the_bytes():
    data = np.random.default_rng(3).integers(0, 3, 900).astype(np.uint8)
    data[400:700] = data[:300]
    raw = data.tobytes() + bytes(100)
    whole = [raw[k : k + 100] for k in range(len(data))]
    want = {x: k for k, x in enumerate(sorted(set(whole)))}
    ranks = repeats.suffix_ranks(data)
    assert (np.argsort(ranks, kind="stable") == sorted(range(len(whole)), key=lambda k: (whole[k], k))).all()
    assert len(set(ranks.tolist())) == len(want) and len({(r, w) for r, w in zip(ranks.tolist(), whole)}) == len(want)


def test_repeats_on_the_tables(spark, corpus):
    assert {r.doc_id: tuple(r)[1:] for r in queries.op3_repeats(spark, SF).collect()} == _repeats_brute(corpus.items())


def test_repeats_edges(docs, none):
    out = repeats.remove_repeats(docs).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(CASES) and by[10].n_removed == len(LONG.encode()) and by[11].n_removed == len(LONG.encode()) and by[1].n_bytes == 0
    assert repeats.remove_repeats(none).count() == 0


# secrets


def test_secrets_equal_plain_search(spark, corpus):
    plain = {"assign": re.compile(r"""(?ia:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}
    rng = random.Random(6)
    parts = ["password: ", "Token=", "api_key='", "apikey", "secret", " : ", "=", "abcdefgh12", "é", "AKIA", "ABCDEFGH12345", "0123456789abcdef", "\n", "x"]
    cases = list(corpus.items()) + [(-k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for k in range(1, 400)]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    for i, t in cases:
        spans = []
        for k, (kind, p) in enumerate(plain.items()):
            for m in p.finditer(t or ""):
                if (len(m[1]) if kind == "assign" else len(m[0])) >= (8, 16, 32)[k]:
                    spans.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
        text = ",".join(x for _, _, x in sorted(spans))
        assert found[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert [found[i].n_assign, found[i].n_access, found[i].n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]


def test_secrets_checksum_and_redaction(spark, docs, none):
    body = "k" * 30
    good, bad = "ghp_" + body + secrets.base62_crc32(body.encode()).decode(), "ghp_" + body + "000000"
    df = spark.createDataFrame([(1, f"é {good} password=longenough1"), (2, bad), (3, None), (4, "secret: 'token=abcdefghij'")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert spans[1] == "forge:2:42,assign:43:63" and spans[2] == "" and spans[3] == ""
    key = "xprv9s21ZrQH143K3QTDL4LXw2F7HEK3wJUD2nW2nRk4stbPy6cq3jPPqjiChkVvvNKmPGJxWUtg6LnF5kejMRNNU3TGtRBeJgk33yuGBxrMPHi"  # a published test vector
    more = spark.createDataFrame([(1, f"({key})"), (2, f"x{key}"), (3, key[:-1] + "j"), (4, "x" + good), (5, f"é{good}.")], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan(more).collect()} == {1: "wallet:1:112", 2: "", 3: "", 4: "", 5: "forge:1:41"}
    mixed = spark.createDataFrame([(1, f"é token={good}é token: abcdefgh12é")], "doc_id long, text string")  # base and checked spans overlap
    assert secrets.redact(mixed).first().text == "é [secret]é [secret]é"
    texts = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert texts[1] == "é [secret] [secret]" and texts[2] == bad and texts[3] is None
    assert secrets.scan(docs).count() == secrets.redact(docs).count() == len(CASES) and secrets.scan(none).count() == secrets.redact(none).count() == 0


# vectors


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    cases = [(1, 1, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 1, [1.0, 0.0]), (4, 2, [1.0, 0.0]), (5, None, [1.0, 0.0]), (6, 1, None), (7, 1, [0.0, 0.0]), (8, 1, [nan, 1.0]), (9, 1, [inf, 1.0]), (10, 1, [None, 1.0]), (11, 1, [0.0, 1.0]), (None, 1, [0.0, 1.0]), (12, 1, []), (13, 1, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(cases, "vec_id long, label int, embedding array<float>").withColumn("node", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[3] == (2, 1, False) and got[11] == (1, 11, True) and got[None] == (1, 11, False)
    assert all(got[k] == (0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 12, 13))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_vectors_recall_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16))
    v = (centres[rng.integers(0, 60, 600)] + rng.normal(size=(600, 16)) * 0.15).astype(np.float32)
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    true = ((u @ u.T) >= 0.93).sum(1) - 1
    got = np.array([r.n_links for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()


def test_vectors_of_large_shards_are_cut_again(spark, monkeypatch):
    for name, value in (("SHARD", 50), ("MOST_SHARDS", 3), ("LARGE", 120)):
        monkeypatch.setattr(embedding_dedup, name, value)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(80, 16))
    v = (centres[rng.integers(0, 80, 900)] + rng.normal(size=(900, 16)) * 0.15).astype(np.float32)
    df = spark.createDataFrame([(i, "ab"[i % 2], x.tolist()) for i, x in enumerate(v)], "vec_id long, label string, embedding array<float>")
    seen = []
    build = embedding_dedup.sharded
    monkeypatch.setattr(embedding_dedup, "sharded", lambda *a: seen.append(build(*a)) or seen[-1])
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    same = np.arange(900)[:, None] % 2 == np.arange(900) % 2
    true = (((u @ u.T) >= 0.93) & same).sum(1) - 1
    got = np.array([r.n_links for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert (got <= true).all() and got.sum() >= 0.95 * true.sum()
    assert max(r["count"] for r in seen[-1].groupBy("label", "dim", "shard").count().collect()) <= 120 << 2


def test_vectors_of_a_group_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    rng = np.random.default_rng(5)
    v = (rng.normal(size=24) + rng.normal(size=(900, 24)) * 0.22).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    true = ((u @ u.T) >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    got = np.array([r.n_links for r in embedding_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    assert true.mean() > 300 and (got <= true).all() and got.sum() >= 0.99 * true.sum()


def test_vectors_audit_sees_few_links_and_fails_loudly(spark, monkeypatch):
    v = np.random.default_rng(6).normal(size=(1500, 24)).astype(np.float32)
    v[1400:1403] = v[:3] * np.float32(1.5) + np.float32(0.01)
    df = spark.createDataFrame([(i, i % 2, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<float>")
    monkeypatch.setattr(embedding_dedup, "ATTEMPTS", 1)
    monkeypatch.setattr(embedding_dedup, "search_graph", lambda index, threshold, beam: spark.createDataFrame([], "a long, b long, links binary"), raising=False)
    with pytest.raises(ValueError, match="recall"):
        embedding_dedup.near_duplicates(df)


def test_vectors_recall_is_measured_or_an_error(spark, monkeypatch):
    v = np.random.default_rng(8).normal(size=(700, 24)).astype(np.float32)
    frame = lambda rows: spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(rows)], "vec_id long, label int, embedding array<float>")
    assert {r.n_links for r in embedding_dedup.near_duplicates(frame(v)).collect()} == {0}  # all compared: known to be none
    monkeypatch.setattr(embedding_dedup, "AUDIT_DRAWS", (2,))
    with pytest.raises(ValueError, match="unknown"):
        embedding_dedup.near_duplicates(frame(v))
    v[650:] = v[:50] * np.float32(1.5) + np.float32(0.01)  # the draw of two may miss them, the search doesn't
    assert sum(r.n_links for r in embedding_dedup.near_duplicates(frame(v)).collect()) >= 90


def test_vectors_of_many_labels(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(2500, 8)).astype(np.float32)
    rows = [(i, i // 2, (v[i // 2] + np.float32(0.001) * (i % 2)).tolist()) for i in range(5000)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()
    assert len(got) == 5000 and {(r.n_links, r.component_id - r.vec_id // 2 * 2) for r in got} == {(1, 0)}


def test_vectors_of_a_dense_shard_come_in_blocks():
    n, dim = 3000, 16
    v = np.random.default_rng(1).normal(size=dim) + np.random.default_rng(2).normal(size=(n, dim)) * 0.02
    table = pa.table({"node": pa.array(np.arange(n)), "label": pa.array(np.zeros(n, np.int64)), "dim": pa.array(np.full(n, dim)), "vector": pa.array([x.astype(np.float32).tobytes() for x in v], pa.binary()), "n": pa.array(np.ones(n, np.int64)), "homes": pa.array([[0]] * n, pa.list_(pa.int64()))})
    built = embedding_dedup._build(table).append_column("entries", pa.nulls(n, pa.list_(pa.int64())))
    before, most, links = pa.total_allocated_bytes(), 0, 0
    for batch in embedding_dedup._search(0.93, 16)(iter(built.combine_chunks().to_batches())):
        most = max(most, pa.total_allocated_bytes() - before)
        links += sum(len(x) // 16 for x in batch.column(2).to_pylist() if x)
    assert links >= n * (n - 1) and most < 100 << 20


def test_vectors_of_clashing_hashes(spark, monkeypatch):
    """Under the first seed all vectors have one hash; the next one is taken."""
    real, seeds = F.xxhash64, []

    def clash(*columns):
        if any(isinstance(c, str) and c == "embedding" for c in columns):
            seeds.append(len(seeds))
            return F.lit(7).cast("long") if len(seeds) == 1 else real(*columns)
        return real(*columns)

    monkeypatch.setattr(embedding_dedup.F, "xxhash64", clash)
    df = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [1.0, 0.001])], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.component_id for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 2, 3: 1} and len(seeds) == 2


# pieces


def test_pieces_equal_the_library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    path = queries.tokenizer_path("piece_bpe_32k.model")
    m = proto.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces and scores, segmented by largest sum
    for p in m.pieces:
        p.score = max(p.score, -31741.0)  # so that the library's single-precision sums stay exact
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    model, rng = pieces.PieceModel(path), random.Random(2)
    for _ in range(300):
        t = " ".join("".join(rng.choice(["th", "er", "in", "a", "é", "ing", "st", "x", "qu", "ö", "Z", "."]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
        assert model.segment("▁" + t.replace(" ", "▁"))[1] == library.encode(t)
        assert model.decode(np.array(library.encode(t))).decode() == library.decode(library.encode(t)) == t


def _best_pieces(model, text):
    """Plain dynamic programme over the whole text."""
    text = "▁" + text.replace(" ", "▁")
    best, back = [0.0], [0]
    for t in range(1, len(text) + 1):
        found = []
        for a in range(max(0, t - model.longest), t):
            if (hit := model.scores.get(text[a:t])) is not None:
                found.append((best[a] + hit[0], t - a, a))
            elif a == t - 1:
                found.append((best[a] + model.unknown, 1, a))
        top = max(found)
        best.append(top[0])
        back.append(top[2])
    cuts = [len(text)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    return model.ids(text, cuts[::-1])


@pytest.fixture(scope="module")
def plain_pieces(corpus):
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    return {i: _best_pieces(model, t) if t else [] for i, t in corpus.items()}


@pytest.mark.parametrize("giant", [2000, 65536])
def test_pieces_of_the_tables_equal_the_plain_programme(spark, corpus, plain_pieces, monkeypatch, giant):
    monkeypatch.setattr(pieces.encode, "__defaults__", (giant, "doc_id", "text"))
    got = {r.doc_id: (r.n_ids, r.ids_crc32, r.decoded_sha256, r.round_trip) for r in queries.op8_sentencepiece(spark, SF).collect()}
    assert set(got) == set(corpus)
    for i, t in corpus.items():
        ids = plain_pieces[i]
        assert got[i] == (len(ids), _crc(ids), hashlib.sha256((t or "").encode()).hexdigest(), True)


def test_pieces_refuse_models_that_change_texts(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto.FromString(open(queries.tokenizer_path("piece_bpe_32k.model"), "rb").read())
    m.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "other.model"
    path.write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="leave texts"):
        pieces.PieceModel(str(path))


def test_pieces_in_chunks_and_back(spark, docs, none, monkeypatch):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    monkeypatch.setattr(pieces, "CHUNK", 40)
    rng = random.Random(8)
    cases = [(i, "".join(rng.choice("abtheringst  \n中é") for _ in range(rng.randint(0, 500)))) for i in range(40)] + [(100, None), (101, ""), (102, " x"), (103, "e" * 300), (104, "=" * 170 + " " * 90 + "ther" * 40), (105, "▁a▁" * 60)]
    df = spark.createDataFrame(cases, "doc_id long, text string")
    whole, parts = ({r.doc_id: list(r.ids) for r in pieces.encode(df, path, giant=n).collect()} for n in (10**9, 50))
    model = pieces.PieceModel(path)
    assert whole == parts and all(whole[i] == (_best_pieces(model, t) if t else []) for i, t in cases)
    assert all(r.round_trip for r in pieces.decode(pieces.encode(docs, path), path).collect())
    assert pieces.decode(pieces.encode(none, path), path).count() == 0


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-9, 9, (3, 4, 4)).astype(float)
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()
    assert (pieces.prefix_products(np.stack([a, b, c]))[2] == pieces.max_plus(pieces.max_plus(a, b), c)).all()


# archives


def test_archives_edges(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    cases = [(1, "http://a/ü b\r\nX: y", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "<p>é</p>"), (None, "u", "<p>é</p>"), (None, None, "alone"), (-5, "u", "x" * 5000)]
    df = spark.createDataFrame(cases, "page_id long, url string, html string").withColumn("content", F.lit("c"))
    got = {(r.page_id, r.payload_bytes): r for r in warc.archive_pages(df).collect()}
    assert len(got) == len(cases)
    assert got[1, 9].record_type == "revisit" and got[1, 9].refers_to == 4 and got[4, 9].record_type == "response" and got[None, 9].refers_to == 4
    assert got[2, 0].refers_to == 3 and got[None, 5].record_type == "response" and got[-5, 5000].payload_digest == warc.digest(b"x" * 5000)
    assert {r.record_type for r in warc.archive_pages(df, min_bytes=10).collect()} == {"response"}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_members_open_alone():
    import gzip

    raw = [warc.record(k, "u", b"body %d" % k, None) for k in range(5)]
    stream = gzip.compress(b"".join(raw))
    assert list(warc.records_of(warc.inflate(stream, 7))) == raw
    with pytest.raises(ValueError):
        list(warc.records_of(warc.inflate(stream[:-20])))
    assert gzip.decompress(warc.deflate(raw[3])) == raw[3]


def test_archives_from_elsewhere(spark):
    import gzip

    page = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    lines = ["WARC/1.0", "WARC-Type: {}", "WARC-Record-ID: <urn:uuid:{}>", "X-Note: \u00e9".encode("latin-1").decode("latin-1"), "Content-Length: {}"]
    make = lambda kind, i, body: "\r\n".join(lines).format(kind, f"12345678-1234-5678-1234-00000000000{i}", len(body)).encode("latin-1") + b"\r\n\r\n" + body + b"\r\n\r\n"
    raw = [make("warcinfo", 1, b"software: x"), make("response", 2, page), make("response", 3, b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 9)]
    archives = spark.createDataFrame([("many", b"".join(gzip.compress(x) for x in raw)), ("one", gzip.compress(b"".join(raw)))], "name string, content binary")
    made = warc.normalise(archives)
    index = warc.sidecar(made)
    rows = {(r.payload_bytes, r.payload_digest) for r in warc.read_records(made, index).collect()}
    assert rows == {(5, warc.digest(b"hello")), (2304, warc.digest(bytes(range(256)) * 9))}
    whole = {r.name: r.content for r in made.select("name", "content").collect()}
    for r in index.collect():  # any gzip reader opens the file, and a member alone
        assert gzip.decompress(whole[r.name][r.offset : r.offset + r.length]) in raw
    assert gzip.decompress(whole["one"]) == gzip.decompress(whole["many"]) == b"".join(raw)
    for bad, why in ((raw[1].replace(b"Content-Length", b"Length"), "Content-Length"), (raw[1].replace(b"WARC-Type", b"Type"), "WARC-Type"), (raw[1][:-9], "inside")):
        with pytest.raises(Exception, match=why):
            warc.normalise(spark.createDataFrame([("bad", gzip.compress(bad))], "name string, content binary")).collect()


# languages


def test_language_accuracy_on_held_out(spark, none):
    path = SF.replace("0.001", "0.01")
    found = queries.op10_language_id(spark, path).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_language_edges(docs):
    net = langid.fit(docs)
    out = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    assert out[1].lang_pred == out[2].lang_pred == out[3].lang_pred == "und" and out[4].lang_pred == "en"
    kept = langid.keep_identified(docs, net)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, None, 8, 9, 10, 11, 12}


def test_every_language_is_learned(spark, monkeypatch):
    words = {f"l{k:02d}": [chr(0x4E00 + 7 * k + j) * 3 for j in range(5)] for k in range(70)}
    rows = [(100 * k + j, " ".join(w * 3), lang) for k, (lang, w) in enumerate(words.items()) for j in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.fit(df).languages == sorted(words)
    monkeypatch.setattr(langid, "TRAIN_MOST", 70)  # a share of one document
    assert langid.fit(df).languages == sorted(words)
    monkeypatch.setattr(langid, "TRAIN_MOST", 69)
    with pytest.raises(ValueError, match="69"):
        langid.fit(df)


def test_network_equals_plain_loops(spark, docs):
    net = langid.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = ["hello world", "é" * 300, "die der und " * 40, "x"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = langid.text_scores(net, langid.lower_ascii(np.frombuffer(b"".join(data), np.uint8)), offsets)
    for d, got in zip(data, found, strict=True):
        d = bytes(b + 32 if 65 <= b <= 90 else b for b in d)
        total, weight = np.zeros(len(net.languages)), 0
        for lo in range(0, len(d), langid.WINDOW):
            window = d[lo : lo + langid.WINDOW]
            padded = window.ljust(langid.WINDOW + max(langid.WIDTHS), b"\0")
            hidden = np.full(net.filters.shape[1], -np.inf)
            for at in range(langid.WINDOW):
                x = np.concatenate([net.embedding[padded[at + j]] for j in range(max(langid.WIDTHS))])
                hidden = np.maximum(hidden, x @ net.filters)
            logits = np.maximum(hidden + net.bias, 0) @ net.dense + net.offset
            p = np.exp(logits - logits.max())
            letters = sum(97 <= b <= 122 or b >= 128 for b in window)
            total, weight = total + letters * p / p.sum(), weight + letters
        assert np.allclose(got, total / weight, atol=1e-4), (got, total / weight)


# the pipeline


@pytest.mark.parametrize("extra", [("_id", "_text", "_n", "_row", "_sha", "_lettered"), ("_key", "_i", "_t", "k", "root", "group", "kept", "text_sha256")])
def test_pipeline_stages_with_clashing_columns(spark, extra):
    text = " ".join(f"w{k}" for k in range(40))
    cases = [(1, "Same text"), (2, "same text"), (3, text), (4, f"{text} x"), (5, "alone")]
    df = spark.createDataFrame([(i, t, "en", *(f"{c}{i}" for c in extra)) for i, t in cases], "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra))
    steps = dict(corpus_pipeline.STAGES)
    for name, left in (("language_id", None), ("exact_dedup", [2, 3, 4, 5]), ("near_dedup", [1, 3, 5]), ("secret_scan", [1, 2, 3, 4, 5])):
        out = steps[name](spark, df, SF)
        assert out.columns == df.columns
        rows = out.collect()
        assert left is None or sorted(r.doc_id for r in rows if r.doc_id != 2 or name != "near_dedup") == left
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)


def test_pipeline_stages(spark, docs, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "near_dedup", "secret_scan", "packing"]
    steps = dict(corpus_pipeline.STAGES)
    for name in names[1:4]:
        out = steps[name](spark, docs, SF)
        assert out.columns == docs.columns
    assert {r.doc_id for r in steps["exact_dedup"](spark, docs, SF).collect()} >= {3, 6, 8, 10, 11, 12}
    assert steps["near_dedup"](spark, docs, SF).where("doc_id in (10, 11)").count() == 0
    for name in names:
        assert steps[name](spark, none, SF).count() == 0


def test_pipeline_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(40))
    cases = [(5, "a"), (5, "b"), (9, "a"), (9, "A"), (9, "A"), (None, "c"), (None, "c"), (None, "d"), (None, "a"), (None, None), (1, ""), (7, text), (7, f"{text} x"), (7, f"{text} x"), (None, f"{text} x y"), (7, "other text")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(cases)], "doc_id long, text string, _sha int").repartition(3)
    steps = dict(corpus_pipeline.STAGES)
    exact = steps["exact_dedup"](spark, df, SF).collect()
    low = sorted((r.text or "").lower() for r in exact)
    assert low == sorted({(t or "").lower() for _, t in cases})
    ids = {(r.text or "").lower(): r.doc_id for r in exact}
    assert ids["a"] == 9 and ids["b"] == 5 and ids["c"] is ids["d"] is None and ids[""] == 1 and ids[f"{text} x"] == 7
    near = [(r.doc_id, r.text) for r in steps["near_dedup"](spark, df, SF).collect()]
    assert sorted(t.lower() for _, t in near if t and len(t) < 20) == ["a", "b", "c", "d", "other text"] and sum(not t for _, t in near) == 2
    assert len([t for _, t in near if t and t.startswith("w0 ")]) == 1 and (7, "other text") in near and len(near) == 8


def test_pipeline_equals_its_operators(spark):
    """run() against the stages' own rules applied to plain rows: what each drops, keeps and packs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(docs)
    judged = {r.doc_id: r for r in langid.predict(docs, net).collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if judged[r.doc_id].lang_pred != "und" and judged[r.doc_id].score >= corpus_pipeline.LEAST_SCORE}
    last = {}
    for i, t in sorted(left.items()):
        last[re.sub("[A-Z]", lambda m: m[0].lower(), t)] = i
    left = {i: left[i] for i in last.values()}
    near = _near_brute(sorted(left.items()))
    left = {i: t for i, t in left.items() if near[i][1] == i}
    clean = secrets.redact(spark.createDataFrame(sorted(left.items()), "doc_id long, text string"))
    want = {}
    for r in packing.pack_documents(clean, queries.tokenizer_path()).collect():
        want.setdefault(r.doc_id, set()).add(r.doc_tokens)
    got = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, set()).add(r.doc_tokens)
    assert got == want


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns[0] == "doc_id"
