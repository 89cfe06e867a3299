r"""Chat formatting in budgeted windows, in DataFrame functions only.

A conversation becomes windows of whole turns.  Prefix sums of the turns' tokens choose the spans
of new turns (targets); each window begins with the conversation's system turn and a limited
history, repeated turns of which nothing is learned again.  A turn is one line,
``<turn role>text</turn>``, in which ``\``, ``<`` and ``>`` of role and text are written ``\b``,
``\l`` and ``\g``: no text holds a mark, and reading turns the escapes back.

Turns are dealt in blocks of ``BLOCK_TURNS`` turn numbers, so a conversation that holds a large
part of all rows is many groups.  A block in which turn numbers repeat so often that it has more
than ``CROWDED`` rows is numbered by ranges and cut again.

Nulls: a null role or text is empty, a null turn comes last, a null conversation id is one
conversation.  Rows of one turn are ordered by their line.  Only the four named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import number_within
from .common import materialise

BLOCK_TURNS, CROWDED = 64, 1024
BUDGET, HISTORY, HISTORY_TURNS = 2048, 512, 6
TOKEN_PATTERN = r"\p{IsHan}|\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"
MOST_SENT = 10_000  # rows of the list of crowded blocks that may be broadcast
LAST = (1 << 63) - 1
OPEN, MID, CLOSE = "<turn ", ">", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(text: Column) -> Column:
    r"""Text without ``<``, ``>`` and bare ``\``."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """The inverse of ``escape``."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def lines(conversations: DataFrame) -> DataFrame:
    """conv_id, at (the turn), block, line and what is known of it: tokens, code points before and in the text, whether it is learned."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("at"), role.alias("role"), text.alias("text"), F.regexp_count(text, F.lit(TOKEN_PATTERN)).cast("long").alias("tokens"), escape(role).alias("head"), escape(text).alias("body"))
    line = F.concat(F.lit(OPEN), "head", F.lit(MID), "body", F.lit(CLOSE))
    start = F.length("head") + len(OPEN) + len(MID)
    return rows.select("conv_id", "at", F.expr(f"at div {BLOCK_TURNS}").alias("block"), line.alias("line"), "tokens", start.alias("start"), F.length("body").alias("chars"), (F.col("role") == "assistant").alias("learned"), (F.col("role") == "system").alias("system"))


_TURN = ("at", "line", "tokens", "start", "chars", "learned", "system")


def _same_block(a: str, b: str) -> Column:
    return F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id")) & (F.col(f"{a}.block") == F.col(f"{b}.block"))


def _with_cut(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` with ``cut``: 0, or in crowded blocks the place of the row's run of BLOCK_TURNS rows."""
    crowded = materialise(sizes.where(F.col("n") > CROWDED).select("conv_id", "block"), "crowded")
    count = crowded.limit(MOST_SENT + 1).count()
    if not count:
        return rows.withColumn("cut", F.lit(0).cast("long"))
    listed = (F.broadcast(crowded) if count <= MOST_SENT else crowded.hint("merge")).alias("c")
    loose = rows.alias("r").join(listed, _same_block("r", "c"), "left_anti").withColumn("cut", F.lit(0).cast("long"))
    tight = rows.alias("r").join(listed, _same_block("r", "c"), "left_semi").withColumn("key", F.struct("conv_id", "block"))
    numbered = number_within(tight, "key", ["at", "line"], "seq")
    return loose.unionByName(numbered.withColumn("cut", F.expr(f"(seq - 1) div {BLOCK_TURNS}")).drop("key", "seq"))


def _blocks(rows: DataFrame, history_turns: int) -> DataFrame:
    """conv_id, block, cut, turns: the turns of each block in order, after its system turn (kind 0) and history (kind 1)."""
    sizes = materialise(rows.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.min("at").alias("first")), "blocks")
    own = _with_cut(rows, sizes)
    # the last turn numbers of a block are history for the next one
    lead = rows.where((F.col("at") % BLOCK_TURNS >= BLOCK_TURNS - history_turns) & (F.col("at") < LAST)).withColumn("block", F.col("block") + 1)
    lead = lead.withColumn("cut", F.lit(0).cast("long"))
    # the system turn goes to every later block of its conversation
    cuts = F.when(F.col("n") > CROWDED, F.expr(f"(n - 1) div {BLOCK_TURNS}")).otherwise(F.lit(0).cast("long"))
    parts = sizes.select("conv_id", "block", cuts.alias("last"))
    whole = parts.groupBy("conv_id").agg(F.min("block").alias("head"), F.sum(F.col("last") + 1).alias("parts")).where("parts > 1")
    firsts = sizes.groupBy("conv_id").agg(F.min("first").alias("first"))
    several = whole.alias("w").join(firsts.hint("merge").alias("f"), F.col("w.conv_id").eqNullSafe(F.col("f.conv_id"))).select("w.conv_id", "head", "first")
    system = rows.where("system").alias("r").join(several.hint("merge").alias("s"), F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("at") == F.col("first")))
    system = system.groupBy("r.conv_id", "head").agg(F.min(F.struct(*_TURN)).alias("t"))
    spread = parts.alias("p").join(system.hint("merge").alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    spread = spread.select("p.conv_id", "p.block", "head", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("cut"), "t.*").where("block > head or cut > 0").drop("head")
    columns = ["conv_id", "block", "cut"]
    all_rows = own.select(*columns, F.lit(2).alias("kind"), *_TURN)
    for kind, more in ((1, lead), (0, spread)):
        all_rows = all_rows.union(more.select(*columns, F.lit(kind).alias("kind"), *_TURN))
    return all_rows.groupBy(*columns).agg(F.sort_array(F.collect_list(F.struct("kind", *_TURN))).alias("turns")).where(F.exists("turns", lambda t: t.kind == 2))


def _at(array: Column, index: Column) -> Column:
    return F.get(array, index)


def chat_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows (conv_id, block, cut, number, text, context, tokens, loss) of all conversations (conv_id, turn, role, text).

    A window holds at most ``budget`` tokens (pieces of TOKEN_PATTERN): the system turn, then turns
    before the window of at most ``history`` tokens and ``history_turns`` turns, then as many new
    turns as fit.  The first ``context`` turns are repeated; ``loss`` lists the code points (start, end exclusive)
    of ``text`` that are learned: assistant texts of new turns.  Every turn is new in exactly one
    window.  A turn that leaves no room (a system turn, or one longer than what is left) stands above
    the budget, with at most turns without tokens beside it; it is never cut.  The system turn is the first of its conversation, if its role is ``system`` (a
    block that no history precedes takes its own first turn, if that is one).  No rows give no windows.
    """
    if history_turns > BLOCK_TURNS // 2 or history >= budget:
        raise ValueError("the history has to be shorter than half a block and the budget")
    blocks = _blocks(lines(conversations), history_turns)
    # sums[i]: tokens before turn i, without the system turn's
    head = _at(F.col("turns"), F.lit(0))
    blocks = blocks.withColumn("sys", (head["kind"] == 0) | ((head["kind"] == 2) & head["system"]))
    blocks = blocks.withColumns({"room": F.greatest(F.lit(1).cast("long"), F.lit(budget - history) - F.when(F.col("sys"), head["tokens"]).otherwise(F.lit(0))), "base": F.when(F.col("sys"), 1).otherwise(0), "new": F.array_position(F.transform("turns", lambda t: t.kind), 2).cast("int") - 1})
    sizes = F.transform("turns", lambda t, i: F.when(F.col("sys") & (i == 0), F.lit(0).cast("long")).otherwise(t.tokens))
    sums = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)))
    blocks = blocks.withColumn("sums", sums).withColumn("n", F.size("turns"))
    span = lambda a, b: _at(F.col("sums"), b) - _at(F.col("sums"), a)
    fresh = lambda s, i: (F.size(s) == 0) | (span(F.element_at(s, -1), i + 1) > F.col("room"))
    starts = F.aggregate(F.sequence("new", F.col("n") - 1), F.expr("cast(array() as array<int>)"), lambda s, i: F.when(fresh(s, i), F.concat(s, F.array(i))).otherwise(s))
    blocks = blocks.withColumn("starts", starts)
    near = lambda i: F.sequence(F.least(i, F.greatest(F.col("base"), i - history_turns)), i)
    since = lambda i: _at(F.filter(near(i), lambda j: span(j, i) <= history), F.lit(0))
    windows = F.transform("starts", lambda i, k: F.struct((k + 1).alias("k"), i.alias("start"), since(i).alias("since"), F.coalesce(_at(F.col("starts"), k + 1), F.col("n")).alias("end")))
    each = blocks.select("conv_id", "block", "cut", "turns", "sys", F.explode(windows).alias("w"))
    repeated = F.col("sys") & (F.col("w.start") > 0)
    shown = F.concat(F.when(repeated, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)), F.slice("turns", F.col("w.since") + 1, F.col("w.end") - F.col("w.since")))
    each = each.select("conv_id", "block", "cut", F.col("w.k").alias("number"), (F.col("w.start") - F.col("w.since") + repeated.cast("int")).alias("context"), shown.alias("shown"))
    offsets = F.aggregate("shown", F.array(F.lit(0).cast("long")), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t.start + t.chars + len(CLOSE))))
    each = each.withColumn("offsets", offsets)
    spans = F.transform("shown", lambda t, i: F.struct((_at(F.col("offsets"), i) + t.start).alias("start"), (_at(F.col("offsets"), i) + t.start + t.chars).alias("end"), (t.learned & (t.chars > 0) & (i >= F.col("context"))).alias("on")))
    loss = F.transform(F.filter(spans, lambda s: s.on), lambda s: F.struct(s.start.alias("start"), s.end.alias("end")))
    total = F.aggregate("shown", F.lit(0).cast("long"), lambda s, t: s + t.tokens)
    return each.select("conv_id", "block", "cut", "number", F.array_join(F.transform("shown", lambda t: t.line), "").alias("text"), "context", total.alias("tokens"), loss.alias("loss"))


def new_turns(windows: DataFrame) -> DataFrame:
    """``windows`` with ``turns``: role, text and formatted code points of each new turn, parsed from the windows' text."""
    pieces = F.filter(F.split("text", CLOSE), lambda p: p != "")
    new = F.slice(pieces, F.col("context") + 1, F.size(pieces))
    parsed = F.transform(new, lambda p: F.struct(unescape(F.substring(F.substring_index(p, MID, 1), len(OPEN) + 1, LAST >> 33)).alias("role"), unescape(F.substring_index(p, MID, -1)).alias("text"), (F.length(p) + len(CLOSE)).cast("long").alias("chars")))
    return windows.withColumn("turns", parsed)


def learned_text(windows: DataFrame) -> DataFrame:
    """``windows`` with ``learned``: what lies under the loss mask, without escapes."""
    parts = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s.start + 1).cast("int"), (s.end - s.start).cast("int"))))
    return windows.withColumn("learned", F.array_join(parts, ""))


def digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of windows that were read back.

    ``formatted_chars`` counts each turn's line once, without what is repeated.  A digest is of a whole conversation's text, which therefore stands in one row here (2 GB at
    most); the windows themselves never do.
    """
    read = learned_text(new_turns(windows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    rows = read.select("conv_id", F.struct("block", "cut", "number", told.alias("told"), "learned").alias("w"), F.size("turns").alias("n"), F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t.chars).alias("chars"))
    each = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    learned = F.array_join(F.transform("w", lambda w: w.learned), "")
    return each.select("conv_id", "n_turns", F.sha2(F.array_join(F.transform("w", lambda w: w.told), ""), 256).alias("turns_sha256"), F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned, 256).alias("loss_sha256"), "formatted_chars")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Windows written as a table, read back and digested."""
    return digests(materialise(chat_windows(conversations), "chat"))
