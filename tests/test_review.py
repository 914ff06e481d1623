import copy
import json

from pyspark.sql import functions as F

from quire.functions.jsontext import set_path
from quire.operators import review
from quire.sources import records
from tests.test_records import GOOD

DOC = "doc_id long, json string"


def full(record):
    """The record with every declared field."""
    out = {k: None for k in ("title", "subtitle", "author", "section_type", "section_number", "section_name", "version", "date", "overview", "materials", "prerequisites", "procedure", "notes", "references", "mix_tables", "source_filename")}
    return out | {k: v for k, v in record.items() if k in out}


EDITS = [
    (1, "title", '"New"', True, None),
    (2, "procedure[0].heading", "Mix", True, None),
    (3, "procedure[0].steps[0].text", " ", False, "step_text_empty procedure[0].steps[0].text"),
    (4, "procedure[0].steps[1].text", "x", False, "out of range: [1]"),
    (5, "procedure[0].callouts[0].after_step", "1", False, "after_step_range procedure[0].callouts[0].after_step"),
    (6, "procedure[0].steps", '[{"depth": 0, "step_type": "action", "text": "a"}, {"depth": 0, "step_type": "action", "text": "b"}]', True, None),
    (7, "procedure[0].callouts[0].after_step", "1", True, None),
    (8, "procedure.heading", "x", False, "wrong container at heading"),
    (9, "nothing", "x", False, "no field nothing"),
    (10, "title[0]", "x", False, "wrong container at [0]"),
    (11, "a..b", "x", False, "malformed path"),
    (12, "", "x", False, "malformed path"),
    (13, "notes", "one text", False, "wrong type"),
    (14, "notes", '["one", "two"]', True, None),
    (15, "notes[1]", "2", False, "wrong type"),
    (16, "notes[1]", '"2"', True, None),
    (17, "section_type", "computational", False, "materials_in_computational materials"),
    (18, "materials", "[]", True, None),
    (19, "section_type", "computational", True, None),
    (20, "prerequisites.software", "git", False, "wrong container at software"),
    (21, "prerequisites", '{"software": "git"}', True, None),
    (22, "prerequisites.access", "key", True, None),
    (23, "title", None, False, "title_missing title"),
    (24, "subtitle", None, True, None),
    (25, "procedure[99999999999].heading", "x", False, "out of range: [99999999999]"),
]


def test_edits_one_after_another(spark):
    docs = spark.createDataFrame([(1, json.dumps(GOOD)), (2, json.dumps(GOOD)), (3, "no json")], DOC).select("doc_id", F.from_json("json", records.RECORD).alias("record"), F.lit(1).alias("results"))
    docs = docs.withColumn("record", F.when(F.col("doc_id") < 3, F.col("record")))
    rows = [(1, n, p, v) for n, p, v, _, _ in EDITS] + [(3, 1, "title", "x"), (4, 1, "title", "x"), (None, 2, "title", "x")]
    edits = spark.createDataFrame(rows, "doc_id long, n int, path string, value string").repartition(4)
    out = review.folded(docs, edits)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r for r in out.select("doc_id", F.to_json("record", {"ignoreNullFields": "false"}).alias("json"), "results").collect()}
    assert [(r.n, r.path, r.accepted, r.reason) for r in got[1].results] == [(n, p, ok, why) for n, p, _, ok, why in EDITS]
    assert got[2].results == [] and [tuple(r) for r in got[3].results] == [(1, "title", False, "no record")]
    want = full(copy.deepcopy(GOOD))
    for _, path, value, ok, _ in EDITS:
        if ok:
            want = json.loads(set_path(json.dumps(want), path, "null" if value is None else value)[0])
    have = json.loads(got[1].json)
    assert have["title"] == "New" and have["prerequisites"] == {"software": "git", "access": "key", "dependencies": None}
    assert have["procedure"][0]["callouts"][0]["after_step"] == 1 and [s["text"] for s in have["procedure"][0]["steps"]] == ["a", "b"]
    assert {k: v for k, v in have.items() if k not in ("procedure", "prerequisites")} == {k: v for k, v in want.items() if k not in ("procedure", "prerequisites")}
    assert {(r.doc_id, r.n) for r in review.unknown(docs, edits).collect()} == {(4, 1), (None, 2)}


def test_a_broken_record_can_be_mended_step_by_step(spark):
    bad = GOOD | {"title": " ", "date": "soon"}
    docs = spark.createDataFrame([(1, json.dumps(bad))], DOC).select("doc_id", F.from_json("json", records.RECORD).alias("record"))
    edits = spark.createDataFrame([(1, 1, "overview", "o"), (1, 2, "title", "T"), (1, 3, "title", ""), (1, 4, "date", "01/02/2024")], "doc_id long, n long, path string, value string")
    got = review.outcomes(review.folded(docs, edits)).orderBy("n").collect()
    assert [(r.n, r.accepted, r.reason) for r in got] == [(1, True, None), (2, True, None), (3, False, "title_empty title"), (4, True, None)]
    assert review.folded(docs, edits.limit(0)).first().results == [] and review.folded(docs.limit(0), edits).count() == 0


def test_the_fold_is_in_the_plan_once_whatever_is_asked_of_the_results(spark):
    docs = spark.createDataFrame([(1, json.dumps(GOOD))], DOC).select("doc_id", F.from_json("json", records.RECORD).alias("record"))
    edits = spark.createDataFrame([(1, 1, "title", "T"), (1, 2, "title", " ")], "doc_id long, n long, path string, value string")
    out = review.folded(docs, edits)
    rows = out.select("doc_id", F.explode("results").alias("e"), F.col("record.title").alias("title")).where("e.n > 0")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
    assert [(r.e.n, r.e.accepted, r.title) for r in rows.orderBy("e.n").collect()] == [(1, True, "T"), (2, False, "T")]


def test_rules_of_a_changed_field_say_what_all_rules_say_of_the_change(spark):
    section = GOOD["procedure"][0]
    bad = {
        "title": " ", "section_type": "computational", "section_number": None, "overview": None, "date": "soon", "prerequisites": {"software": "git"}, "materials": [{"heading": "h", "rows": []}, {"heading": "h", "rows": [{"cells": ["a"], "bold": False}]}],
        "procedure": [section | {"heading": " ", "steps": [{"depth": 0, "step_type": "x", "text": " "}], "callouts": [{"callout_type": "y", "text": "", "after_step": 3}]}], "mix_tables": [{"heading": "h", "rows": [{"cells": None, "bold": True}]}],
    }
    other = bad | {"section_type": "unknown", "procedure": [], "mix_tables": []}
    fields = list(full({}))
    pairs = [(f, json.dumps(full(a)), json.dumps(full(a) | {f: full(b)[f]})) for a in (GOOD, GOOD | bad, GOOD | other) for b in (GOOD, GOOD | bad, GOOD | other) for f in fields]
    old, new = F.col("old"), F.col("new")
    added = lambda of: F.filter(of(new), lambda v: ~F.array_contains(of(old), v))
    at = lambda r: records.broken_rules_at(r, F.col("field"))
    read = spark.createDataFrame(pairs, "field string, a string, b string").select("field", *(F.from_json(c, records.RECORD).alias(n) for c, n in (("a", "old"), ("b", "new"))))
    got = read.select("field", added(records.broken_rules).alias("all"), added(at).alias("near"), records.breaks_rules_at(new, F.col("field")).alias("breaks"), (F.size(at(new)) > 0).alias("listed")).collect()
    assert [r.near for r in got] == [r.all for r in got] and [r.breaks for r in got] == [r.listed for r in got]
    assert {v["rule"] for r in got for v in r.all} >= {"materials_in_computational", "prerequisites_in_wet_lab", "after_step_range", "mix_width", "rows_empty", "step_text_empty", "procedure_empty", "type_unknown", "date_invalid"}


def test_values_are_held_against_the_type_that_is_declared_where_the_path_leads(spark):
    docs = spark.createDataFrame([(1, json.dumps(GOOD))], DOC).select("doc_id", F.from_json("json", records.RECORD).alias("record"))
    cases = [
        ("materials", '[{"heading": "h", "rows": [{"cells": ["a", "b", "c"], "bold": "so"}]}]', "wrong type"), ("materials", '[{"heading": "h", "rows": [{"cells": ["a", "b", "c"], "bold": true}]}]', None), ("materials[0].rows[0].cells[1]", "2", "wrong type"),
        ("materials[0].rows[0].cells[1]", "two", None), ("materials[0].rows[0].bold", "two", "wrong type"), ("materials[0].rows[0]", '{"cells": ["x", "y", "z"], "bold": false}', None), ("materials[0].rows[1]", '{"cells": []}', "out of range: [1]"),
        ("procedure[0]", "[]", "wrong type"), ("procedure[0].section_no", "4", None), ("procedure[0].section_no", "four", "wrong type"), ("procedure[0].steps[0].depth", "zero", "wrong type"), ("procedure[0].steps[0].depth.x", "0", "wrong container at x"), ("notes", '["a", null]', None), ("notes", '["a", 1]', "wrong type"), ("[0]", "x", "malformed path"), ("notes[x]", "x", "malformed path"),
    ]
    edits = spark.createDataFrame([(1, n, p, v) for n, (p, v, _) in enumerate(cases)], "doc_id long, n long, path string, value string")
    out = review.folded(docs, edits)
    assert [r.reason for r in review.outcomes(out).orderBy("n").collect()] == [why for _, _, why in cases]
    record = json.loads(out.select(F.to_json("record", {"ignoreNullFields": "false"})).first()[0])
    assert record["materials"][0]["rows"] == [{"cells": ["x", "y", "z"], "bold": False}] and record["notes"] == ["a", None] and record["procedure"][0]["section_no"] == 4
