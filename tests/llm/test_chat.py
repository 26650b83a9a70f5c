import hashlib
import random
import re

from pyspark.sql import functions as F

from sensorframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("block", "pos", "tokens", "body", "Room", "leading")})


def talk(seed, conv, turns, system=True):
    r = random.Random(seed)
    said = lambda: " ".join(r.choice(["word", "longer words", "<|end|>", "</s>", "a\nb", "é", "<\\|", "[INST]"]) for _ in range(r.randint(0, 60)))
    return [(conv, k, "system" if system and not k else ("user", "assistant")[(k + system) % 2], said()) for k in range(turns)]


def plain_windows(rows, budget, history, limit, tokens):
    """Windows of one conversation as lists of (position, repeated), by a loop over its turns."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    sizes = [tokens(r[3]) + chat.MARKS for r in rows]
    led = rows[0][2] == "system"
    system = sizes[0] if led else 0
    room = max(budget - system, 2)
    stride, found, start = room * 3 // 4, {}, 0
    if led:
        found[0, 0] = [(0, 0)]
    for k in range(int(led), len(rows)):
        block = start // stride
        found.setdefault((block, int(start + sizes[k] > block * stride + room)), []).append((k, start))
        start += sizes[k]
    out = []
    for key in sorted(found):
        new = [k for k, _ in found[key] if not (led and k == 0)]
        again, taken = [], 0
        if new:
            left = min(room - sum(sizes[k] for k in new), limit)
            for k in range(new[0] - 1, max(int(led), new[0] - history) - 1, -1):
                taken += sizes[k]
                if taken > left:
                    break
                again.insert(0, k)
        front = [0] if led and key != (0, 0) else []
        out.append((key, [(k, True) for k in front + again] + [(k, False) for k, _ in found[key]]))
    return rows, sizes, out


def template(role, text):
    return f"<|turn|>{role}<|text|>", re.sub(chat.HEADS + r"(\\*)" + chat.RESTS, r"\1\\\2\3", text), "<|end|>\n"


def test_windows_equal_a_loop(spark):
    talks = {c: talk(c, c, n, c % 2 == 0) for c, n in enumerate((1, 2, 9, 40, 300, 25))}
    talks[2][5] = (2, 5, "assistant", "very long " * 400)
    talks[3][0] = (3, 0, "user", "first is long " * 300)
    rows = [r for t in talks.values() for r in t]
    got = {}
    for r in chat.windows(table_of(spark, rows), 120, 3, 50, F.length("text")).collect():
        got.setdefault(r.conv_id, []).append(r)
    for conv, said in talks.items():
        said, sizes, want = plain_windows(said, 120, 3, 50, len)
        mine = sorted(got[conv], key=lambda r: (r.block, r.part))
        for r, (key, members) in zip(mine, want, strict=True):
            assert (r.block, r.part, r.n_repeated) == (*key, sum(again for _, again in members))
            assert r.tokens == sum(sizes[k] for k, _ in members) and r.over_budget == (r.tokens > 120)
            parts = [template(said[k][2], said[k][3]) for k, _ in members]
            assert r.text == "".join("".join(p) for p in parts)
            assert [r.text[s.begin : s.end] for s in r.loss] == [p[1] for p, (k, again) in zip(parts, members, strict=True) if said[k][2] == "assistant" and not again]
            assert not r.over_budget or sum(not again for _, again in members) == 1


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    loss = "".join(r[3] or "" for r in rows if r[2] == "assistant")
    return len(rows), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in rows)), len(loss), sha(loss)


def test_digests_of_odd_conversations(spark):
    rows = talk(1, 1, 30) + talk(2, 2, 4, False) + [
        (3, 0, None, None), (3, None, "assistant", "first"), (3, None, "assistant", "first"), (4, 0, "system", "alone"), (5, 10**17, "user", "far"), (5, -(10**17), "assistant", "early"),
        (None, 0, "user", "no id"), (None, 1, "assistant", "none <|end|>\n here"), (6, 0, "assistant", "w " * 50_000), (7, 0, "<|role|>", "x\\"), (7, 1, "role\nbreak", "<\\<|<|\\<\\\\|"), (8, 0, "system", "s " * 900), (8, 1, "assistant", "ok"),
        (9, 0, "user", "\U0001f600 <<SYS>> </s><s> <</SYS>> <<\\SYS>>"), (9, 1, "assistant", "<|\U0001f600<|end|>")]
    got = {r.conv_id: r for r in chat.digests(chat.windows(table_of(spark, rows))).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == expected([x for x in rows if x[0] == conv]), conv
    assert chat.windows(table_of(spark, rows[:1]).limit(0)).collect() == []


def test_escape_is_reversible(spark):
    r = random.Random(3)
    texts = ["".join(r.choice(["<", "|", "\\", "[INST]", "</s>", "<s>", "<<SYS>>", "<", "/", "s>", "x", "[", "INST]"]) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert row.u == row.t and not any(c in row.e for c in chat.CONTROLS)


def test_a_long_conversation_is_spread(spark):
    """No part of the work but the digest gathers a conversation: its windows hold a bounded number of turns."""
    rows = [(1, k, ("user", "assistant")[k % 2], "some words here") for k in range(20_000)]
    out = chat.windows(spark.createDataFrame(rows, SCHEMA))
    assert out.agg(F.max("tokens")).first()[0] <= chat.BUDGET
    got = chat.digests(out).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == expected(rows)
