r"""Chat formatting in windows of a token budget.

A conversation is cut between turns by the prefix sums of its turns' tokens alone, so no turn waits for another's
window.  Let ``room`` be the budget less the system turn and ``stride`` three quarters of it.  The turns that start in
the ``k``-th stride form window ``k``; its last turn stays there if it ends within ``room`` of the stride's start, else
it has a window of its own behind it.  Every window begins with the system turn (the first turn, where its role is
``system``).  What room its new turns leave is filled with the turns before them, at most ``history`` turns and
``history_tokens`` tokens.  Loss spans cover the texts of assistant turns that are new in the window; repeated ones are
masked, so every target is learned once.

The template is ``<|turn|>role<|text|>text<|end|>`` and a line break per turn.  Control strings inside roles and texts
get a backslash behind their first character, and those that have backslashes there get one more; ``unescape`` takes it
away again.

DataFrame functions only.  Prefix sums are taken within buckets of 4096 turn numbers and carried by one row per
bucket, the system turn is copied once per 64 windows, and history meets its window by position, so a conversation with
a third of all rows is spread over many tasks.  A window's turns are gathered, which the budget bounds.

Defined results: a null role or text is an empty one.  Turns with a null number come first; equal numbers are ordered
by role, then text; repeated rows are turns of their own.  Rows with a null ``conv_id`` are one conversation.  A turn
larger than the room is whole, in a window of its own with ``over_budget``.  An empty table returns nothing.  Extra
columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize

BUDGET, HISTORY, HISTORY_TOKENS = 512, 2, 128
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
MARKS = 3
# Control strings of common templates
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
HEADS = "([<\\[])"
RESTS = "(" + "|".join(re.escape(c[1:]) for c in CONTROLS) + ")"
WORDLIKE = r"[\p{L}\p{M}]{1,4}|\p{Nd}{1,3}|[^\p{L}\p{M}\p{Nd}\x00-\x20]"
BUCKET_BITS, COPIES = 12, 64


def escape(text: Column) -> Column:
    return F.regexp_replace(text, HEADS + r"(\\*)" + RESTS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, HEADS + r"\\(\\*)" + RESTS, "$1$2$3")


def word_pieces(text: Column) -> Column:
    """Tokens of a text, about: pieces of four letters or three digits, and every other visible character."""
    return F.regexp_count(text, F.lit(WORDLIKE)).cast("long")


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Inner join in which null keys are equal; the columns of ``left``, then the others of ``right``."""
    rest = [c for c in right.columns if c not in keys]
    right = right.select(*(F.col(k).alias(f"other_{k}") for k in keys), *rest)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"other_{k}")) for k in keys])
    return left.join(right, same).select(*left.columns, *rest)


def _placed(rows: DataFrame, budget: int) -> DataFrame:
    """Turns with their position, the tokens before them and the window in which they are new."""
    bucket = F.shiftright(F.coalesce("turn", F.lit(-(1 << 63))), BUCKET_BITS)
    within = Window.partitionBy("conv_id", "bucket").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    rows = rows.withColumn("bucket", bucket)
    ranked = materialize(rows.withColumns({"pos": F.row_number().over(within), "ends": F.sum("tokens").over(within.rowsBetween(Window.unboundedPreceding, 0))}), "turns")
    leads = F.max(F.when((F.col("pos") == 1) & (F.col("role") == "system"), F.col("tokens")))
    sums = ranked.groupBy("conv_id", "bucket").agg(F.count("*").alias("n"), F.sum("tokens").alias("sum"), leads.alias("leads"))
    over = Window.partitionBy("conv_id").orderBy("bucket")
    before, everything = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = sums.select(
        "conv_id", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.coalesce(F.first("leads").over(everything), F.lit(0)).alias("system"), F.sum("sum").over(everything).alias("total"))
    placed = _joined(ranked, carried, "conv_id", "bucket")
    room = F.greatest(budget - F.col("system"), F.lit(2))
    placed = placed.select(
        "conv_id", "role", "body", "tokens", "system", "total", (F.col("pos") + F.col("n_before")).alias("pos"),
        (F.col("ends") + F.col("sum_before") - F.col("tokens") - F.col("system")).alias("start"), room.alias("room"))
    first = (F.col("pos") == 1) & (F.col("system") > 0)
    stride = F.expr("room * 3 div 4")
    block = F.when(first, 0).otherwise(F.expr("start div (room * 3 div 4)"))
    alone = ~first & (F.col("start") + F.col("tokens") > F.col("block") * stride + F.col("room"))
    return materialize(placed.withColumn("leading", first).withColumn("block", block).withColumn("part", alone.cast("int")), "placed")


def windows(
    conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS, tokens: Column | None = None
) -> DataFrame:
    """``conv_id, block, part, n_repeated, text, loss, tokens, over_budget`` per window of ``conversations``
    (``conv_id``, ``turn``, ``role``, ``text``); windows of a conversation are ordered by ``block``, then ``part``.

    ``tokens`` counts a turn's text (a column expression over ``conversations``); ``loss`` holds spans of ``text`` in
    code points, end exclusive.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = (word_pieces(text) if tokens is None else F.coalesce(tokens, F.lit(0))).cast("long") + MARKS
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), escape(text).alias("body"), counted.alias("tokens"))
    turns = _placed(rows, budget)
    key = ["conv_id", "block", "part"]
    spans = turns.where("not leading").groupBy(*key).agg(
        F.min("pos").alias("at"), F.min("start").alias("begin"), F.sum("tokens").alias("fresh"), F.first("room").alias("room"), (F.max("system") > 0).alias("led"))
    member = ["pos", "role", "body", "tokens"]
    new = turns.select(*key, *member, F.lit(False).alias("repeated"))
    ahead = turns.where("not leading").withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(history)))) if history > 0 else turns.where("false").withColumn("ahead", F.lit(1))
    ahead = ahead.select("conv_id", *member, "start", (F.col("pos") + F.col("ahead")).alias("at"))
    left = F.least(F.col("room") - F.col("fresh"), F.lit(history_tokens))
    again = _joined(ahead, spans, "conv_id", "at").where(F.col("begin") - F.col("start") <= left)
    leading = turns.where("leading").withColumn("copy", F.explode(F.expr(f"sequence(0L, (total - system) div (room * 3 div 4) div {COPIES})")))
    leading = leading.select("conv_id", "copy", *member)
    led = spans.where("led and not (block = 0 and part = 0)").select(*key, F.expr(f"block div {COPIES}").alias("copy"))
    system = _joined(led, leading, "conv_id", "copy")
    rest = [*key, *member, F.lit(True).alias("repeated")]
    members = new.union(again.select(*rest)).union(system.select(*rest))
    turn = F.struct("pos", "role", "body", "repeated")
    grouped = members.groupBy(*key).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"), F.sum("tokens").alias("tokens"), F.sum(F.col("repeated").cast("int")).cast("int").alias("n_repeated"))
    return grouped.select(
        *key, "n_repeated", F.array_join(F.transform("turns", _formatted), "").alias("text"), _loss(F.col("turns")).alias("loss"), "tokens", (F.col("tokens") > budget).alias("over_budget"))


def _head(turn: Column) -> Column:
    return F.concat(F.lit(TURN), escape(turn["role"]), F.lit(TEXT))


def _formatted(turn: Column) -> Column:
    return F.concat(_head(turn), turn["body"], F.lit(END))


def _loss(turns: Column) -> Column:
    """Spans of the assistant texts that aren't repeated."""
    empty = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<begin:int,end:int>>)").alias("spans"))

    def further(done: Column, turn: Column) -> Column:
        begin = done["at"] + F.length(_head(turn))
        end = begin + F.length(turn["body"])
        span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
        target = (turn["role"] == "assistant") & ~turn["repeated"]
        return F.struct((end + len(END)).alias("at"), F.when(target, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(turns, empty, further, lambda done: done["spans"])


def new_turns(formatted: DataFrame) -> DataFrame:
    """``conv_id, block, part, turns`` (``role``, ``text``) read back from ``text``, without the repeated ones."""
    pieces = F.split("text", re.escape(END))
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))

    def parsed(piece: Column) -> Column:
        halves = F.split(F.substring(piece, F.lit(len(TURN) + 1), F.length(piece)), re.escape(TEXT))
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return formatted.withColumn("turns", F.transform(fresh, parsed))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold: turns and targets as digests, which gather a conversation's text."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("text"), s["begin"] + 1, s["end"] - s["begin"]))), "")
    parts = new_turns(formatted).select(
        "conv_id", F.size("turns").alias("n"), F.length("text").alias("chars"), F.struct("block", "part", said.alias("said"), learned.alias("learned")).alias("p"))
    whole = parts.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("p")).alias("parts"))
    loss = F.array_join("parts.learned", "")
    return whole.select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.array_join("parts.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))


CONTROL_ID, CONTROL_TEXT = -7, "</s>[INST] ok [/INST]"


def with_control(conversations: DataFrame) -> DataFrame:
    """The conversations, and one that says control strings."""
    said = conversations.sparkSession.sql(f"SELECT * FROM VALUES ({CONTROL_ID}L, 0L, 'user', '{CONTROL_TEXT}'), ({CONTROL_ID}L, 1L, 'assistant', '{CONTROL_TEXT}') AS t(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").union(said)


def digests_sql(budget: int = BUDGET, history: int = HISTORY, history_tokens: int = HISTORY_TOKENS) -> str:
    """The digests from the table itself; the sizes of windows by the same rule, with plain window sums."""
    marks = len(TURN) + len(TEXT) + len(END)
    back = " ".join(
        f"""UNION ALL SELECT w.conv_id, t.chars FROM spans w JOIN placed t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.at - {d} AND NOT t.is_first
          WHERE w.begin - t.start <= least(w.room - w.fresh, {history_tokens})"""
        for d in range(1, history + 1)
    )
    heads = HEADS.replace("'", "''")
    return rf"""
    WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES ({CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}'), ({CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}')),
    counted AS (SELECT *, len(regexp_extract_all(text, '{WORDLIKE}')) + {MARKS} AS tokens,
      regexp_replace(text, '{heads}(\\*){RESTS}', '\1\\\2\3', 'g') AS body, regexp_replace(role, '{heads}(\\*){RESTS}', '\1\\\2\3', 'g') AS name FROM said),
    sums AS (SELECT *, row_number() OVER o AS pos, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) - tokens AS before FROM counted
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body)),
    led AS (SELECT *, coalesce(max(CASE WHEN pos = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS system FROM sums),
    roomy AS (SELECT *, before - system AS start, greatest({budget} - system, 2)::BIGINT AS room, pos = 1 AND system > 0 AS is_first,
      length(name) + length(body) + {marks} AS chars FROM led),
    blocks AS (SELECT *, CASE WHEN is_first THEN 0 ELSE (start // (room * 3 // 4)) END AS block FROM roomy),
    placed AS (SELECT *, (NOT is_first AND start + tokens > block * (room * 3 // 4) + room)::INTEGER AS part FROM blocks),
    spans AS (SELECT conv_id, block, part, min(pos) AS at, min(start) AS begin, sum(tokens) AS fresh, min(room) AS room, max(system) > 0 AS led
      FROM placed WHERE NOT is_first GROUP BY ALL),
    written AS (SELECT conv_id, chars FROM placed {back}
      UNION ALL SELECT w.conv_id, t.chars FROM spans w JOIN placed t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.is_first WHERE w.led AND NOT (w.block = 0 AND w.part = 0)),
    size AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars FROM written GROUP BY conv_id),
    content AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM placed GROUP BY conv_id)
    SELECT c.*, formatted_chars FROM content c JOIN size s ON s.conv_id IS NOT DISTINCT FROM c.conv_id"""


DIGESTS_SQL = digests_sql()
