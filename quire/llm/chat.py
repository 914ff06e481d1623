"""Chat formatting with DataFrame functions only.

A template declares, for each role, the marks around a text and whether the text counts for the loss, and a finite-state machine
over roles. A conversation becomes segments (text, loss), in turn order; their texts joined are the formatted
conversation. Marks never occur inside a formatted text: a control string in it gets one backslash after its first
character (and one more where it already has some), which reading takes away again.

Large conversations. Turns are formatted row by row. Rows are first gathered by (conversation, block of BLOCK_TURNS turn numbers); a
block keeps, for every state of the machine, the state after it and how many turns were in order, so that blocks compose
without their turns. format_blocks() is the scalable output, one row a block; join_blocks() gives one row a conversation,
which Spark limits to 2 GB of text.

Defined cases: null text and null role are empty; a role that the template lacks is written out in full and breaks the turn order;
turns with equal numbers follow each other by role and text, null turns come first; an empty table gives no rows; a null
conv_id is a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
FAIL = "fail"


@dataclass(frozen=True)
class Mark:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    begin: str
    roles: dict[str, Mark]
    #: Around the name and the text of any other role.
    other: tuple[str, str, str]
    start: str
    moves: dict[str, dict[str, str]]
    accept: tuple[str, ...]
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [self.begin, *(x for m in self.roles.values() for x in (m.open, m.close)), *self.other]
        controls = tuple(dict.fromkeys(m.strip() for m in marks))
        object.__setattr__(self, "controls", controls)
        for a in controls:
            if len(a) < 2 or " " in a or "\\" in a:
                raise ValueError(f"a control string has two characters or more, no space and no backslash: {a!r}")
            for b in controls:
                if a != b and a in b or any(a.endswith(b[:k]) for k in range(1, len(b))) and a != b:
                    raise ValueError(f"control strings overlap: {a!r}, {b!r}")
        for opening, closing in [(m.open, m.close) for m in self.roles.values()] + [(self.other[0], self.other[2])]:
            if opening[-1:] != " " or closing[:1] != " ":
                raise ValueError("a space must part marks from the text")

    @property
    def rests(self) -> str:
        """Alternatives of (first character behind, rest ahead) for each control string."""
        return "|".join(rf"(?<={re.escape(c[0])}){{0}}(?=\\*{re.escape(c[1:])})" for c in self.controls)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.rests.replace("{0}", ""), "\\\\")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.rests.replace("{0}", r"\\"), "")


INSTRUCT = Template(
    begin="<s>",
    roles={
        "system": Mark("[SYS] ", " [/SYS]"),
        "user": Mark("[INST] ", " [/INST]"),
        "assistant": Mark("[ANS] ", " </s>", loss=True),
        "tool": Mark("[TOOL] ", " [/TOOL]"),
    },
    other=("[ROLE] ", " [TEXT] ", " [/ROLE]"),
    start="begin",
    moves={
        "begin": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked", "tool": "called"},
        "called": {"tool": "called", "assistant": "answered"},
    },
    accept=("answered",),
)


def _step(template: Template, state: Column, role: Column) -> Column:
    out = F.lit(FAIL)
    for before, moves in template.moves.items():
        for r, after in moves.items():
            out = F.when((state == before) & (role == r), after).otherwise(out)
    return out


def _fold(template: Template, roles: Column, start: str) -> Column:
    """(state, ok) after the roles, begun in a state; ok: turns before the order broke."""
    first = F.struct(F.lit(start).alias("state"), F.lit(0).cast("long").alias("ok"))

    def step(acc: Column, role: Column) -> Column:
        state = _step(template, acc["state"], role)
        return F.struct(state.alias("state"), (acc["ok"] + F.when(state != FAIL, 1).otherwise(0)).alias("ok"))

    return F.aggregate(roles, first, step)


def format_blocks(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, block, n_turns, segments array<struct<text, loss>>, after (state and ok for each state of the machine, in its order): one row a block of turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = [F.lit(None).cast("string")] * 2
    for name, mark in template.roles.items():
        marks = [F.when(F.col("role") == name, x).otherwise(m) for x, m in zip((mark.open, mark.close), marks, strict=True)]
    a, b, c = template.other
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).select(
        "conv_id",
        F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK_TURNS).alias("block"),
        F.struct(
            "turn", "role", "text",
            F.coalesce(marks[0], F.concat(F.lit(a), template.escape(F.col("role")), F.lit(b))).alias("open"),
            template.escape(F.col("text")).alias("body"),
            F.coalesce(marks[1], F.lit(c)).alias("close"),
        ).alias("t"),
    )
    loss = [r for r, m in template.roles.items() if m.loss]
    segment = lambda x, on: F.struct(x.alias("text"), on.alias("loss"))
    no = F.lit(False)
    gathered = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    return gathered.select(
        "conv_id",
        "block",
        F.size("turns").cast("long").alias("n_turns"),
        F.flatten(F.transform("turns", lambda t: F.array(segment(t["open"], no), segment(t["body"], t["role"].isin(loss)), segment(t["close"], no)))).alias("segments"),
        F.array(*(_fold(template, roles, s) for s in template.moves)).alias("after"),
    )


def join_blocks(blocks: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """conv_id, formatted, segments, valid (the machine accepts the turns), n_valid_turns (turns before the order broke)."""
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "segments", "after"))).alias("blocks"))
    start = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("ok"))

    def step(acc: Column, block: Column) -> Column:
        to = F.get(block["after"], F.array_position(F.array(*map(F.lit, template.moves)), acc["state"]).cast("int") - 1)
        return F.struct(F.coalesce(to["state"], F.lit(FAIL)).alias("state"), (acc["ok"] + F.coalesce(to["ok"], F.lit(0))).alias("ok"))

    begin = F.array(F.struct(F.lit(template.begin).alias("text"), F.lit(False).alias("loss")))
    return whole.select(
        "conv_id",
        F.concat(begin, F.flatten(F.transform("blocks", lambda b: b["segments"]))).alias("segments"),
        F.aggregate("blocks", start, step).alias("end"),
    ).select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("end.state").isin(*template.accept).alias("valid"),
        F.col("end.ok").alias("n_valid_turns"),
    )


def parse(formatted: Column, template: Template = INSTRUCT) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    q = re.escape
    known = "|".join(f"{q(m.open)}.*?{q(m.close)}" for m in template.roles.values())
    a, b, c = template.other
    turns = F.regexp_extract_all(formatted, F.lit(f"(?s)(?:{known}|{q(a)}.*?{q(b)}.*?{q(c)})"), F.lit(0))

    def read(turn: Column) -> Column:
        middle = F.instr(turn, b)
        role = F.substring(turn, F.lit(len(a) + 1), middle - len(a) - 1)
        text = F.substring(turn, middle + len(b), F.length(turn) - middle - len(b) - len(c) + 1)
        for name, m in template.roles.items():
            here = F.startswith(turn, F.lit(m.open))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substring(turn, F.lit(len(m.open) + 1), F.length(turn) - len(m.open) - len(m.close))).otherwise(text)
        return F.struct(template.unescape(role).alias("role"), template.unescape(text).alias("text"))

    return F.transform(turns, read)


def digests(conversations: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """What reading the output of join_blocks() gives: turns, text under the loss, and their hashes."""
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    read = conversations.select("conv_id", parse(F.col("formatted"), template).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "n_valid_turns")
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "n_valid_turns",
    )


def format_conversations(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    return join_blocks(format_blocks(turns, template), template)


#: The same digests from the turns themselves; sizes from the template's marks.
SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, len(regexp_extract_all(text, '\[\\*/?(SYS|INST|TOOL|ROLE)\]|\[\\*(ANS|TEXT)\]|<\\*/?s>')) + length(text)
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 WHEN 'tool' THEN 15
      ELSE 23 + length(role) + len(regexp_extract_all(role, '\[\\*/?(SYS|INST|TOOL|ROLE)\]|\[\\*(ANS|TEXT)\]|<\\*/?s>')) END AS chars,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'o' END AS code
  FROM turns
), whole AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) + 3 AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    string_agg(code, '' ORDER BY turn NULLS FIRST, role, text) AS codes
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars, regexp_matches(codes, '^s?(ua(t+a)*)+$') AS valid,
  CAST(length(regexp_extract(codes, '^s?((ua(t+a)*)+(t+|u)?|u)?')) AS BIGINT) AS n_valid_turns
FROM whole
"""
