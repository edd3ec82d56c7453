"""Chat formatting in DataFrame functions only.

A template declares, as data, how a turn is marked, the roles' names, which roles are
learned, and a finite-state machine over roles: its transitions and accepting states.
The machine is folded over a conversation's turns; every turn becomes text segments,
each with its own loss flag. Control strings inside texts and role names are escaped,
so that the formatted text alone gives back every turn.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, read

#: Escapes: INSIDE parts a control string, BACKSLASH stands for a backslash.
INSIDE, BACKSLASH = "\\i", "\\b"


@dataclass(frozen=True)
class ChatTemplate:
    """Marks, names, learned roles, and the machine that turn orders must pass.

    A turn is ``mark + name + colon + text + end``. Roles without a name are written as
    ``=`` and the escaped role. ``transitions`` maps (state, role) to the next state; a
    missing entry is an error, in which the machine stays.
    """

    mark: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accepting: tuple[str, ...] = ("assistant",)
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )

    def controls(self) -> list[str]:
        return [self.mark, self.end.strip()]

    def __post_init__(self) -> None:
        """Refuse marks that could arise from a text and what stands beside it."""
        strings = [*self.controls(), self.colon]
        edges = [*strings, self.end, *(self.mark + n + self.colon for n in self.names.values())]
        for a in strings:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"a control string has two characters or more and no backslash: {a!r}")
            for b in edges:
                if any(a[i:] == b[: len(a) - i] or b[-i:] == a[:i] for i in range(1, len(a))):
                    raise ValueError(f"{a!r} and {b!r} may overlap")
        if any(n.startswith("=") or any(s in n for s in [*strings, "\\"]) for n in self.names.values()) or len(set(self.names.values())) < len(self.names):
            raise ValueError("names are distinct and hold no control string")


def escape(text: Column, controls: list[str]) -> Column:
    """Text in which no control string occurs; :func:`unescape` gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    for c in controls:
        out = F.replace(out, F.lit(c), F.lit(c[0] + INSIDE + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(INSIDE), F.lit("")), F.lit(BACKSLASH), F.lit("\\"))


def _order(turns: str, template: ChatTemplate) -> Column:
    """The machine folded over ``turns``: (state, n, fault); ``fault`` is the position of
    the first turn that has no transition, from 0."""
    states = sorted({template.start, *template.accepting, *(s for s, _ in template.transitions), *template.transitions.values()})
    roles = sorted({r for _, r in template.transitions})
    dead = len(states)
    step = [states.index(template.transitions[s, r]) if (s, r) in template.transitions else dead for s in states for r in [*roles, None]]
    table = F.array(*(F.lit(x) for x in [*step, *[dead] * (len(roles) + 1)]))

    def move(at: Column, turn: Column) -> Column:
        role = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(r) for r in roles)), turn["role"]), F.lit(0)), F.lit(len(roles) + 1)).cast("int")
        to = F.get(table, at["state"] * (len(roles) + 1) + role - 1)
        fault = F.when(at["fault"].isNull() & (to == dead), at["n"]).otherwise(at["fault"])
        return F.struct(to.alias("state"), (at["n"] + 1).alias("n"), fault.alias("fault"))

    begin = F.struct(F.lit(states.index(template.start)).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("fault"))
    ends = F.array(*(F.lit(states.index(s)) for s in template.accepting))
    return F.aggregate(turns, begin, move, lambda at: F.struct(at["fault"].alias("fault"), F.array_contains(ends, at["state"]).alias("complete")))


def format_conversations(rows: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, complete, fault, and
    ``segments``, an array of (text, loss) whose texts joined are the formatted text.

    Turns go by ``turn`` (nulls first), ties by role and formatted text; repeated rows are
    turns of their own. A null text or role is an empty one; rows with a null conv_id are
    one conversation; other columns are ignored. ``valid`` says whether the machine has a
    transition for every turn, ``fault`` is the first turn without one (else null), and
    ``complete`` whether it ends in an accepting state. Faulty conversations are formatted
    like any other. An empty table gives no rows. A conversation is one row, so below 2 GB.
    """
    t = template or ChatTemplate()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = pick(rows, "conv_id", "turn", "role", "text").select("conv_id", F.struct("turn", role.alias("role"), escape(text, t.controls()).alias("body")).alias("t"))
    named = F.create_map(*(F.lit(x) for pair in t.names.items() for x in pair)) if t.names else F.create_map(F.lit(""), F.lit(None).cast("string"))
    name = lambda r: F.coalesce(F.try_element_at(named, r), F.concat(F.lit("="), escape(r, [*t.controls(), t.colon])))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    learned = F.array(*(F.lit(r) for r in t.learned)) if t.learned else F.array().cast("array<string>")
    segments = lambda x: F.array(
        part(F.concat(F.lit(t.mark), name(x["role"]), F.lit(t.colon)), F.lit(False)),
        part(x["body"], F.array_contains(learned, x["role"])),
        part(F.lit(t.end), F.lit(False)),
    )
    out = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), _order("turns", t).alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select("conv_id", "n_turns", F.col("m.fault").isNull().alias("valid"), F.col("m.complete").alias("complete"), F.col("m.fault").cast("long").alias("fault"), "segments")


def formatted_text(segments: str = "segments") -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def loss_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


def read_turns(text: str | Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) turns of a formatted text, by its marks alone."""
    t = template or ChatTemplate()
    roles = F.create_map(*(F.lit(x) for r, n in t.names.items() for x in (n, r))) if t.names else F.create_map(F.lit(""), F.lit(None).cast("string"))
    pieces = F.split(text, F.lit(f"\\Q{t.end}\\E"))

    def turn(piece: Column) -> Column:
        colon = F.instr(piece, t.colon)
        name = F.substring(piece, F.lit(len(t.mark) + 1), colon - len(t.mark) - 1)
        role = F.coalesce(F.try_element_at(roles, name), unescape(F.substring(name, F.lit(2), F.length(name))))
        return F.struct(role.alias("role"), unescape(F.substring(piece, colon + len(t.colon), F.length(piece))).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    turns = F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))
    planted = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", said.alias("text"))
    out = format_conversations(pick(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(planted))
    out = out.withColumns({"written": formatted_text(), "learned": loss_text()}).withColumn("turns", read_turns("written"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("written").cast("long").alias("formatted_chars"),
        "valid",
        "complete",
    )


#: ``### `` and ``</turn>`` are parted by ``\i``; a turn's frame has 13 characters besides its name and text.
OP11_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, ['user', 'assistant'][i + 1], '\### Assistant: </turn> ok' FROM range(2) AS r(i)),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '### ', '#\i## '), '</turn>', '<\i/turn>') AS body,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
         ELSE '=' || replace(replace(replace(replace(role, '\', '\b'), '### ', '#\i## '), '</turn>', '<\i/turn>'), ': ', ':\i ') END AS name FROM rows),
o AS (SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(14 + length(name) + length(body))::BIGINT AS formatted_chars,
  bool_and(coalesce(CASE role WHEN 'system' THEN pos = 1 WHEN 'user' THEN pos = 1 OR before IN ('system', 'assistant') WHEN 'assistant' THEN before = 'user' END, false)) AS valid,
  valid AND arg_max(role, pos) = 'assistant' AS complete
FROM o GROUP BY conv_id
"""
