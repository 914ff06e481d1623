"""Text functions and classifiers on single values, with the expectations that their definitions give."""

import pytest
from pyspark.sql import functions as F

from quire.functions import classify as c
from quire.functions import jsontext
from quire.functions import text as t

CASES = [
    (t.normalize_whitespace, "  a  b​c\td\n e﻿ ", "a b c d\n e"),
    (t.normalize_whitespace, None, ""),
    (lambda x: t.normalize_text(x, False), "‘a’ “b” 1–2 … —", "'a' \"b\" 1-2 ... —"),
    (t.strip_markers, "Add **5 uL** Buffer _A_ a_b_c.", "Add 5 uL Buffer A abc."),
    (t.normalize_cross_references, "See sec. 3.2, Section 4 and SECTION 5", "See Section 3.2, Section 4 and SECTION 5"),
    (t.normalize_centrifuge_units, "12,000*g* 5_g_ 300 x g 4xg 7 X g", "12,000 × g 5 × g 300 × g 4 × g 7 × g"),
    (t.normalize_temperature_units, "4o C, -20oC, 37.5°C, 5 OF 10", "4 °C, -20 °C, 37.5 °C, 5 °F 10"),
    (t.strip_callout_prefix, "crucial: keep cold.", "keep cold."),
    (t.strip_callout_prefix, "Warning — hot", "hot"),
    (t.clean_title, "**Extraction of RNA:**", "Extraction of RNA"),
    (t.title_case, "a guide to the rna and pcr of", "A Guide to the RNA and PCR Of"),
    (t.title_slug, "In situ hybridisation (ISH) — wholemount", "In-Situ-Hybridisation-ISH-Wholemount"),
    (t.title_slug, "!!!", "Untitled-Protocol"),
    (t.title_slug, "word " * 20, "Word-Word-Word-Word-Word-Word-Word-Word-Word-Word-Word-Word"),
    (t.title_slug, "x" * 70, "X" + "x" * 59),
    (t.stem_title, "/in/my_cool-protocol.docx", "My Cool Protocol"),
    (t.footer_title, "x" * 41, "x" * 37 + "…"),
    (t.footnote_refs, "a [3] b (1) c (12)d [1] (2)", [1, 2, 3]),
    (t.without_footnote_refs, "a [3] b (1) c", "a b c"),
    (t.sentences, "Add 5 mL. Mix e.g. Well. See Fig. 3. Then stop! Now", ["Add 5 mL. Mix e.g. Well.", "See Fig. 3.", "Then stop!", "Now"]),
    (t.normalize_date, "Last updated: 5-3-2024", "05/03/2024"),
    (t.normalize_date, "15 march 2024", "15/03/2024"),
    (t.normalize_date, "Sept 2024", None),
    (t.normalize_date, "2024-03-05", None),
    (t.normalize_date, "99/77/2024", "99/77/2024"),
    (t.valid_date, "31/02/2024", True),
    (t.valid_date, "10/13/2024", False),
    (t.valid_date, "1/1/2024", False),
    (t.overview_paragraphs, " a \n\n\n b\nc ", ["a", "b\nc"]),
    (t.overview_paragraphs, "", [""]),
    (t.estimate_tokens, "x" * 36, 10),
    (t.estimate_tokens, "", 1),
    (c.callout_type, "CRUCIAL: avoid contamination.", "critical"),
    (c.callout_type, "**IMPORTANT:** x", "caution"),
    (c.callout_type, "It is crucial to work quickly, toxic", "critical"),
    (c.callout_type, "Caution: crucial", "caution"),
    (c.callout_type, "écrucial", None),
    (c.callout_type, "  ", None),
    (c.is_stopping_point, "Keep overnight at 4", True),
    (c.is_stopping_point, "Keep overnight", False),
    (c.section_type, "run bash, bash and bash", "computational"),
    (c.section_type, "run bash", "wet_lab"),
    (c.section_type, "a\n    code", "computational"),
    (c.role, " Notes & Variants: ", "notes"),
    (c.role, "Title", None),
]


@pytest.mark.parametrize(("f", "value", "want"), CASES)
def test_value(spark, f, value, want):
    df = spark.createDataFrame([(value,)], "x string")
    got = df.select(f(F.col("x")).alias("y")).first().y
    assert (list(got) if isinstance(got, list) else got) == want


@pytest.mark.parametrize(
    ("text", "style", "want"),
    [("x", "Heading 2", 2), ("x", "h3", 3), ("x", "Subtitle", 1), ("Overview", "", 1), ("PCR", None, 2), ("4 °C", "", 2), ("Reagents", "", 0), ("A B C D E F G H I", "", 0), ("12", "", 0)],
)
def test_heading_level(spark, text, style, want):
    assert spark.createDataFrame([(text, style)], "x string, s string").select(c.heading_level(F.col("x"), F.col("s")).alias("y")).first().y == want


def test_cells_and_code(spark):
    df = spark.createDataFrame([(["a", " "], ["Reagent", "Cat. No."], ["", " "], ["x", "notes"], "a\r\n\nb", "py")], "a array<string>, b array<string>, c array<string>, d array<string>, code string, lang string")
    r = df.select(t.pad_cells(F.col("a"), 3).alias("p"), c.is_header_row(F.col("b")).alias("h1"), c.is_header_row(F.col("c")).alias("h2"), c.is_header_row(F.col("d")).alias("h3"), t.code_lines(F.col("code"), F.col("lang")).alias("l")).first()
    assert (list(r.p), r.h1, r.h2, r.h3, list(r.l)) == (["a", "—", "—"], True, True, False, ["# py", "a", " ", "b"])


def test_inline_tokens(spark):
    df = spark.createDataFrame([("a **b** _c_ _**d**_ * `e_f_` x",)], "x string")
    plain = [(x.text, x.bold, x.italic) for x in df.select(t.inline_tokens(F.col("x")).alias("y")).first().y]
    assert plain[:7] == [("a ", False, False), ("b", True, False), (" ", False, False), ("c", False, True), (" ", False, False), ("d", True, True), (" ", False, False)]
    code = [(x.text, x.code) for x in df.select(t.inline_code_tokens(F.col("x")).alias("y")).first().y]
    assert ("e_f_", True) in code and ("*", False) in code


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('say {"a": {"b": "}"}} end', ('{"a": {"b": "}"}}', None)),
        ('```json\n{"a": 1}\n```', ('{"a": 1}', None)),
        (r'{"a": "q\"}"}', (r'{"a": "q\"}"}', None)),
        ("none", (None, "no object")),
        (None, (None, "no object")),
        ('{"a": "open', (None, "incomplete object")),
    ],
)
def test_json_object(text, want):
    assert jsontext.find_object(text) == want


@pytest.mark.parametrize(
    ("path", "value", "want"),
    [
        ("title", "new", ('{"title": "new", "steps": [{"t": 1}]}', None)),
        ("steps[0].t", "[2]", ('{"title": "x", "steps": [{"t": [2]}]}', None)),
        ("steps[3].t", "1", (None, "index out of range: 3")),
        ("none.t", "1", (None, "missing key: none")),
        ("title.t", "1", (None, "wrong container at t")),
        ("steps[x]", "1", (None, "malformed path: steps[x]")),
    ],
)
def test_set_path(path, value, want):
    assert jsontext.set_path('{"title": "x", "steps": [{"t": 1}]}', path, value) == want


def test_json_udfs(spark):
    df = spark.createDataFrame([('x {"a": 1}', '{"a": 1}', "a", "5")], "t string, d string, p string, v string")
    r = df.select(jsontext.json_object(F.col("t")).alias("o"), jsontext.set_json_path("d", "p", "v").alias("s")).first()
    assert r.o.object == '{"a": 1}' and r.s.document == '{"a": 5}'
