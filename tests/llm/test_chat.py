import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.llm import chat

NASTY = ["", None, "</s>[INST] ok [/INST]", "[\\INST] [\\\\INST] \\[INST\\]", "[[INST]]", "<<s>>", "[", "[INST", " [/ROLE] ", "a [TEXT] b", "\\", "<\\s>", "é\n😀 [ANS]", "x" * 30_000 + "[TOOL]", " lead and trail ", "</s></s>", "[/SYS"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(turns):
    """conv -> digests, straight from the turns."""
    out = {}
    for conv in {c for c, *_ in turns}:
        rows = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in turns if c == conv))
        loss = "".join(x for *_, r, x in rows if r == "assistant")
        state, ok = "begin", 0
        for *_, r, _ in rows:
            state = chat.INSTRUCT.moves.get(state, {}).get(r, "fail")
            if state == "fail":
                break
            ok += 1
        out[conv] = (len(rows), sha("".join(f"{r}\n{x}\n" for *_, r, x in rows)), len(loss), sha(loss), state == "answered", ok)
    return out


def test_round_trip_against_brute_force(spark):
    turns = [(0, i, ["user", "assistant", "system", "tool", "[ROLE] odd [TEXT] </s>", None, ""][i % 7], t) for i, t in enumerate(NASTY)]
    turns += [(1, i, "assistant" if i % 2 else "user", f"t{i} <s>") for i in range(300)]
    turns += [(2, 5, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "a"), (2, None, "system", "first"), (None, 0, "user", "no conv"), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (3, 3, "tool", "t"), (3, 4, "assistant", "b")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash")).repartition(7)
    whole = chat.format_conversations(df)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid, r.n_valid_turns) for r in chat.digests(whole).collect()}
    assert got == brute(turns)
    for r in whole.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        bodies = [s.text for s in r.segments[1:]][1::3]
        assert not any(c in b for b in bodies for c in chat.INSTRUCT.controls)


def test_sql_says_the_same(spark, sf):
    from quire.llm.queries import op1_chat

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(chat.SQL).fetchall()
    df = op1_chat(spark, sf)
    names = [d[0] for d in con.execute(chat.SQL).description]
    got = [tuple(r) for r in df.select(*names).collect()]
    assert sorted(got) == sorted(want) and len(names) == len(df.columns)
    assert any(r[0] == -1 for r in got)


def test_templates_with_overlapping_controls_are_refused():
    with pytest.raises(ValueError):
        chat.Template("<<s>>", {"user": chat.Mark("<s> ", " </s>")}, ("[R] ", " [T] ", " [/R]"), "a", {}, ())


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).count() == 0
