"""Chat windows against a plain programme, with hostile texts, ties, crowded blocks and odd columns."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shopatlas.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, block string, cut int, kind string, n long, line string"
COUNT = re.compile(r"[一-鿿]|[^\W\d_]{1,4}|\d{1,3}|[^\w\s]|_")


def table(spark, turns, parts=3):
    return spark.createDataFrame([(*t, "x", 1, "k", 2, "l") for t in turns], SCHEMA).repartition(parts)


def plain_windows(turns, budget, history, history_turns, whole):
    """Windows of one conversation: lists of (turn, is new), by taking turns one after another in each block."""
    out, system = [], turns[0] if turns[0][2] == "system" else None
    for key in sorted({b for b, *_ in whole}):
        own = [t for b, t in whole if b == key]
        before = [t for b, t in whole if b == key - 1 and t[1] % chat.BLOCK_TURNS >= chat.BLOCK_TURNS - history_turns]
        row = before + own
        keep = row[0] if own and row[0] is turns[0] and system else system
        room = max(1, budget - history - (len(COUNT.findall(keep[3])) if keep else 0))
        size = [0 if t is keep else len(COUNT.findall(t[3])) for t in row]
        i = len(before)
        while i < len(row):
            j = i + 1
            while j < len(row) and sum(size[i : j + 1]) <= room:
                j += 1
            back = i
            while back > (1 if row[0] is keep else 0) and i - back < history_turns and sum(size[back - 1 : i]) <= history:
                back -= 1
            head = [(keep, False)] if keep and row[i] is not keep else []
            out.append(head + [(t, False) for t in row[back:i]] + [(t, True) for t in row[i:j]])
            i = j
    return out


def show(window):
    code = lambda s: s.replace("\\", "\\b").replace("<", "\\l").replace(">", "\\g")
    return "".join(f"<turn {code(t[2])}>{code(t[3])}</turn>\n" for t, _ in window)


@pytest.mark.parametrize("budget, history, history_turns", [(40, 12, 3), (200, 60, 6), (30, 0, 0)])
def test_windows_equal_a_plain_programme(spark, budget, history, history_turns):
    rng = random.Random(budget)
    words = ["alpha", "be", "gamma12", "</turn>", "<turn user>", "\\", "\\l", "中文", "é", "\n", ">"]
    turns = []
    for conv, n in ((1, 3), (2, 150), (3, 64), (4, 1), (5, 200)):
        for k in range(n):
            role = "system" if k == 0 and conv != 3 else ("user", "assistant")[k % 2]
            turns.append((conv, k, role, " ".join(rng.choice(words) for _ in range(rng.randint(0, 25)))))
    found = chat.chat_windows(table(spark, turns), budget, history, history_turns).collect()
    want = []
    for conv in (1, 2, 3, 4, 5):
        own = [t for t in turns if t[0] == conv]
        want += [(conv, show(w), sum(not new for _, new in w)) for w in plain_windows(own, budget, history, history_turns, [(t[1] // chat.BLOCK_TURNS, t) for t in own])]
    assert sorted((r.conv_id, r.text, r.context) for r in found) == sorted(want)
    for r in found:
        new = r.text.split("</turn>\n")[r.context : -1]
        assert r.tokens <= budget or sum(not t.startswith("<turn system>") and bool(COUNT.search(t.split(">")[1])) for t in new) <= 1
        told = [(m[1], m[2]) for m in re.finditer(r"<turn ([^>]*)>([^<]*)</turn>\n", r.text)][r.context :]
        assert [r.text[s.start : s.end] for s in r.loss] == [text for role, text in told if role == "assistant" and text]


def plain_digests(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv), key=lambda t: (t[:2], show([(t, True)])))
        told, learned = "".join(f"{r}\n{x}\n" for *_, r, x in own), "".join(x for *_, r, x in own if r == "assistant")
        marks = sum(len(r) + len(x) + sum(map((r + x).count, "\\<>")) + 15 for *_, r, x in own)
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), marks)
    return out


def digested(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_nulls_ties_long_texts_and_clashing_columns(spark):
    long = "word <b> \\ " * 40_000
    turns = [(1, 0, "user", None), (1, 1, None, "x"), (1, None, "assistant", "late"), (None, 0, "assistant", "no id"), (None, 900, "user", "far"), (2, 5, "assistant", "same"), (2, 5, "assistant", "same"), (2, 5, "user", "same"), (3, 0, "a>b\\", "t"), (4, 0, "user", long), (4, 1, "assistant", long), (5, -3, "system", "before"), (5, 70, "assistant", "")]
    assert digested(chat.format_conversations(table(spark, turns))) == plain_digests(turns)
    assert chat.format_conversations(table(spark, [])).count() == 0


def test_crowded_blocks_are_cut_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(chat, "CROWDED", 100)
    turns = [(1, 0, "system", "rules"), (1, 0, "system", "rules")] + [(1, 3, "assistant", f"copy {k % 40}") for k in range(500)] + [(1, 80, "user", "next"), (2, 0, "assistant", "alone")]
    for sent in (chat.MOST_SENT, 0):  # broadcast and merge join
        monkeypatch.setattr(chat, "MOST_SENT", sent)
        windows = chat.chat_windows(table(spark, turns), 100, 20, 2)
        assert digested(chat.digests(windows)) == plain_digests(turns)
        assert windows.where("conv_id = 1").select("cut").distinct().count() > 5
        assert windows.where("conv_id = 1 and not startswith(text, '<turn system>')").count() == 0


def test_a_long_conversation_is_many_groups(spark):
    rows = spark.range(20_000).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    windows = chat.chat_windows(rows)
    per = windows.groupBy("block", "cut").agg(F.sum(F.size(F.split("text", chat.CLOSE)) - 1 - F.col("context")).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert tuple(per) == (chat.BLOCK_TURNS, 20_000)


def test_no_python_on_the_main_path(spark):
    plan = chat.chat_windows(table(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
