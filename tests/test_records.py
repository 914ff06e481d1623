import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.__main__ import main
from quire.sources import config, records

GOOD = {
    "title": "T", "subtitle": None, "section_type": "wet_lab", "section_number": "", "section_name": "", "date": "01/02/2024", "overview": "", "materials": [{"heading": "h", "rows": [{"cells": ["a", "b", "c"]}]}], "unknown": 1,
    "procedure": [{"section_no": 0, "heading": "H", "steps": [{"seq": 0, "depth": 0, "step_type": "action", "text": "x"}], "callouts": [{"callout_type": "tip", "text": "y", "after_step": 0}]}],
}
BAD = {
    "empty_title": (GOOD | {"title": " "}, [("title_empty", "title")]),
    "no_title": ({k: v for k, v in GOOD.items() if k != "title"}, [("title_missing", "title")]),
    "typed": (GOOD | {"procedure": "x"}, [("procedure_mistyped", "procedure")]),
    "date": (GOOD | {"date": "2024-01-01"}, [("date_invalid", "date")]),
    "kind": (GOOD | {"section_type": "computational"}, [("materials_in_computational", "materials")]),
    "rows": (GOOD | {"materials": [{"heading": "h", "rows": [{"cells": ["a", "b", "c"]}]}, {"heading": "h", "rows": [{"cells": ["a"]}]}]}, [("materials_width", "materials[1].rows[0].cells")]),
    "after": (GOOD | {"procedure": [GOOD["procedure"][0] | {"callouts": [{"callout_type": "tip", "text": "y", "after_step": 1}]}]}, [("after_step_range", "procedure[0].callouts[0].after_step")]),
    "step": (GOOD | {"procedure": [GOOD["procedure"][0] | {"steps": [{"depth": 0, "step_type": "odd", "text": ""}]}]}, [("step_text_empty", "procedure[0].steps[0].text"), ("step_type_unknown", "procedure[0].steps[0].step_type")]),
    "no_rows": (GOOD | {"materials": [{"heading": "h", "rows": []}, {"heading": "h"}]}, [("rows_empty", "materials[0].rows"), ("rows_empty", "materials[1].rows")]),
    "notes": (GOOD | {"notes": "one", "references": ["a", {"b": 1}], "prerequisites": None}, [("notes_mistyped", "notes"), ("references_mistyped", "references[1]")]),
    "deep": (GOOD | {"procedure": [GOOD["procedure"][0], GOOD["procedure"][0] | {"steps": [{"depth": "x", "step_type": "action", "text": 5}], "callouts": []}]}, [("depth_mistyped", "procedure[1].steps[0].depth"), ("text_mistyped", "procedure[1].steps[0].text")]),
    "none": (GOOD | {"procedure": []}, [("procedure_empty", "procedure")]),
}


def test_violations_of_records(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(GOOD))
    (tmp_path / "text.json").write_text("no json")
    for name, (value, _) in BAD.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    found = {}
    for r in records.violations(records.read_records(spark, str(tmp_path))).withColumn("name", F.regexp_extract("doc_id", r"(\w+)\.json$", 1)).collect():
        found.setdefault(r.name, []).append((r.rule, r.path))
    assert "good" not in found and ("not_json", "") in found.pop("text")
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, (_, v) in BAD.items()}


def test_schema_and_config(spark, tmp_path):
    assert "procedure" in records.schema_json()
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.json")
    (tmp_path / "c.json").write_text('{"a": 1}')
    assert config.load(tmp_path / "c.json") == {"a": 1}
    (tmp_path / "c.json").write_text('{"a": 2}')
    assert config.load(tmp_path / "c.json") == {"a": 1} and config.load(tmp_path / "c.json", force=True) == {"a": 2}


def test_command_line(spark, tmp_path, capsys):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>Some words</w:t></w:r></w:p></w:body></w:document>")
    assert main(["format", str(tmp_path / "a.docx"), "--out", str(tmp_path / "o")]) == 0 and (tmp_path / "o" / "A_v1_0.docx").exists()
    assert main(["format", str(tmp_path / "none.docx")]) == 2 and main(["format", str(tmp_path / "o")]) == 2
    assert main(["schema"]) == 0 and "section_type" in capsys.readouterr().out


def test_schema_is_json_schema(spark):
    schema = json.loads(records.schema_json())
    assert schema["type"] == "object" and "title" in schema["required"] and schema["properties"]["section_type"]["enum"] == ["wet_lab", "computational"]
    rows = schema["properties"]["materials"]["items"]["properties"]["rows"]["items"]
    assert rows["properties"]["cells"]["type"] == "array"


def test_rendering_one_record(spark, tmp_path, capsysbinary, monkeypatch):
    import io

    (tmp_path / "r.json").write_text(json.dumps(GOOD))
    assert main(["render", str(tmp_path / "r.json"), "--out", str(tmp_path / "deep" / "r.docx")]) == 0
    said = json.loads(capsysbinary.readouterr().out.splitlines()[-1])
    assert said["status"] == "success" and zipfile.ZipFile(tmp_path / "deep" / "r.docx").testzip() is None
    monkeypatch.setattr("sys.stdin", io.StringIO(json.dumps(GOOD)))
    assert main(["render", "-"]) == 0
    got = capsysbinary.readouterr()
    assert got.out == (tmp_path / "deep" / "r.docx").read_bytes() and json.loads(got.err.splitlines()[-1])["output"] is None
    (tmp_path / "bad.json").write_text(json.dumps(GOOD | {"procedure": []}))
    assert main(["render", str(tmp_path / "bad.json"), "--out", str(tmp_path / "x.docx")]) == 1 and not (tmp_path / "x.docx").exists()
    assert json.loads(capsysbinary.readouterr().out.splitlines()[-1])["errors"] == ["procedure_empty procedure"]
    assert main(["render", str(tmp_path / "none.json")]) == 2 and main(["check", "--converter", "no-such-program"]) == 0
