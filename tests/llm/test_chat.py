"""Chat formatting against brute force and exact round trips."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from talespark.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "user", None),
    (1, 1, "assistant", ""),
    (2, None, None, "no turn, no role"),
    (2, 0, "", "x"),
    (2, 0, "", "x"),
    (None, 3, "tool: ### ", "### User: a</turn>\n"),
    (None, 1, "=\\", "\\i\\b\\\\"),
    (4, 1, "assistant", "### " * 5 + "#### " + "</turn></turn>"),
    (4, 0, "user", "a" * 200_000),
    (5, 0, "assistant", "#"),
    (6, 0, "user", "# ## ### #### aé\U0001f600   ###"),
    (6, 1, "assistant", "<</turn</turn>"),
    (6, 2, "assistant", "</turn>\n### Assistant: b"),
]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def safe(text, more=()):
    text = text.replace("\\", "\\b")
    for c in ("### ", "</turn>", *more):
        text = text.replace(c, c[0] + "\\i" + c[1:])
    return text


def plain(rows):
    """conv_id to (n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid, complete)."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [(t if t is not None else -(10**9), r or "", safe(x or ""), x or "") for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        name = lambda r: r.capitalize() if r in ("system", "user", "assistant") else "=" + safe(r, (": ",))
        whole = "".join(f"### {name(r)}: {s}</turn>\n" for _, r, s, _ in mine)
        learned = "".join(x for _, r, _, x in mine if r == "assistant")
        letters = "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "?") for _, r, _, _ in mine)
        valid = re.fullmatch(r"s?(ua)*u?", letters) is not None
        said = "".join(f"{r}\n{x}\n" for _, r, _, x in mine)
        out[conv] = (len(mine), digest(said), len(learned), digest(learned), len(whole), valid, valid and letters.endswith("a"))
    return out


def digests(out):
    return {r[0]: tuple(r)[1:] for r in out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid", "complete").collect()}


@pytest.fixture
def written(spark, tmp_path):
    """op11 on rows of one's own."""

    def run(rows):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
        return digests(queries.QUERIES["op11_chat_formatting"](spark, str(tmp_path)))

    return run


PLANTED = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def test_whole_query_by_brute_force(spark, data):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{data}/conversations.parquet'").fetchall()
    got = digests(queries.QUERIES["op11_chat_formatting"](spark, data))
    assert got == plain(rows + PLANTED) and got[-7][2] == len(PLANTED[0][3])


def test_odd_rows(written):
    assert written(ODD) == plain(ODD + PLANTED)


def test_empty_table(written):
    assert written([]) == plain(PLANTED)


def test_no_native_python(spark, data):
    plan = queries.QUERIES["op11_chat_formatting"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1


def test_round_trip_of_random_texts(spark):
    rng, bits = random.Random(3), ["\\", "\\i", "\\b", "#", "### ", "## ", " ", "</turn>", "</tu", "rn>", "\n", "i", "b", ": ", ":", "=", "Assistant", "é"]
    draw = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [(i // 4, i % 4, rng.choice(["user", "assistant", "system", None, draw(5)]), draw(14)) for i in range(2000)]
    out = chat.format_conversations(spark.createDataFrame(rows, SCHEMA))
    back = out.select("conv_id", chat.read_turns(chat.formatted_text()).alias("t"), "segments").collect()
    assert len(back) == 500
    for r in back:
        want = [(role or "", text) for c, _, role, text in rows if c == r["conv_id"]]
        assert [tuple(x) for x in r["t"]] == want
        texts = [s["text"] for s in r["segments"]]
        assert all("### " not in s and "</turn>" not in s for s in texts[1::3])
        assert [s["loss"] for s in r["segments"]][1::3] == [role == "assistant" for role, _ in want] and not any(s["loss"] for i, s in enumerate(r["segments"]) if i % 3 != 1)


def test_machine_equals_the_expression(spark):
    rng = random.Random(5)
    orders = ["".join(rng.choice("uuaas?") for _ in range(rng.randrange(1, 7))) for _ in range(300)] + ["ua" * 400, "s" + "ua" * 300 + "a"]
    role = {"u": "user", "a": "assistant", "s": "system", "?": "User"}
    rows = [(i, k, role[c], "t") for i, o in enumerate(orders) for k, c in enumerate(o)]
    for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect():
        o = orders[r["conv_id"]]
        good = max(n for n in range(len(o) + 1) if re.fullmatch(r"s?(ua)*u?", o[:n]))
        assert (r["valid"], r["fault"]) == (good == len(o), None if good == len(o) else good)
        assert r["complete"] == (good == len(o) and o.endswith("a"))


def test_another_template(spark):
    """Tool turns, two learned roles, and a machine in which a tool answers a call."""
    t = chat.ChatTemplate("<|im|>", "\n>", "<|fin|>", {"user": "U", "assistant": "A", "tool": "T"}, ("assistant", "tool"), "s", ("a",), {("s", "user"): "u", ("u", "assistant"): "a", ("a", "tool"): "t", ("t", "assistant"): "a"})
    rows = [(1, i, r, "<|im|>A\n><|fin|>\\") for i, r in enumerate(("user", "assistant", "tool", "assistant"))] + [(2, 0, "tool", "x"), (3, 0, "user", "y")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA), t).select("*", chat.read_turns(chat.formatted_text(), t).alias("t"), chat.loss_text().alias("l")).collect()}
    assert (out[1]["valid"], out[1]["complete"], out[2]["valid"], out[3]["valid"], out[3]["complete"]) == (True, True, False, True, False)
    assert [tuple(x) for x in out[1]["t"]] == [r[2:] for r in rows[:4]] and out[1]["l"] == rows[0][3] * 3


@pytest.mark.parametrize("marks", [("##", ": ", "</turn>\n"), ("### ", ": ", "aba"), ("### ", ":", "</turn>"), ("<a>", ": ", "></a>"), ("### \\", ": ", "</turn>")])
def test_marks_that_may_arise_are_refused(marks):
    with pytest.raises(ValueError):
        chat.ChatTemplate(*marks)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], SCHEMA).select("*", F.lit("y").alias("TEXT"), F.lit("assistant").alias("Role"), F.lit("z").alias("text"))
    assert [tuple(x) for x in chat.format_conversations(rows).select(chat.read_turns(chat.formatted_text()).alias("t")).first()["t"]] == [("user", "x")]
