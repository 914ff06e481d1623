"""Files in and out, a stream over a folder, prompts."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, completion, render, segment
from quire.sources import ooxml, probes, records
from quire.streaming import ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
BODY = f"""<w:document {W}><w:body>
<w:p><w:pPr><w:pStyle w:val="h"/></w:pPr><w:r><w:t>Procedure</w:t></w:r></w:p>
<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t xml:space="preserve">Add </w:t></w:r><w:r><w:rPr><w:b/></w:rPr><w:t>5 uL</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:i/></w:rPr><w:t> x</w:t></w:r></w:p>
<w:sectPr/>
<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl>
</w:body></w:document>"""
STYLES = f'<w:styles {W}><w:style w:styleId="h"><w:name w:val="Heading 1"/><w:rPr><w:b/></w:rPr></w:style></w:styles>'
NOTES = f'<w:footnotes {W}><w:footnote w:id="-1"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>second  note</w:t></w:r></w:p></w:footnote></w:footnotes>'


def make(path, **parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(f"word/{name}.xml", data)


def test_reading_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    make(tmp_path / "sub" / "one.docx", document=BODY, styles=STYLES, footnotes=NOTES)
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    rows = {(r.path.rsplit("/", 1)[1], r.kind, r.pos): r for r in ooxml.read_documents(spark, str(tmp_path)).collect()}
    head, item = rows["one.docx", "paragraph", 0], rows["one.docx", "paragraph", 1]
    assert head.style_name == "Heading 1" and head.runs[0].bold
    assert [(r.text, r.bold, r.italic) for r in item.runs] == [("Add ", False, False), ("5 uL", True, False), (" x", False, True)]
    assert (item.num_id, item.ilvl, item.has_numbering) == (3, 1, True)
    assert rows["one.docx", "table", 3].cells == [["a b", ""]]
    assert rows["one.docx", "footnote", -1].footnote_id == 2 and rows["one.docx", "footnote", -1].runs[0].text == "second note"
    assert rows["bad.docx", "error", -1].problem.startswith("BadZipFile") and len(rows) == 6


def test_writing_and_reading_again(spark, tmp_path):
    made = [(1, "a.docx", 1, "heading1", "Overview"), (1, "a.docx", 2, "paragraph", "x < y & \x01z"), (1, "a.docx", 3, "spacer", ""), (2, "b.docx", 1, "heading2", "Only")]
    out = ooxml.write_documents(spark.createDataFrame(made, "doc_id long, output_name string, block_no int, kind string, body string"), f"file://{tmp_path}/out")
    assert {r.output_path.rsplit("/", 1)[1] for r in out.collect()} == {"a.docx", "b.docx"}
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "out" / "a.docx").read_bytes())).testzip() is None
    got = ooxml.read_documents(spark, f"{tmp_path}/out").where(F.col("path").endswith("a.docx") & (F.col("kind") == "paragraph")).orderBy("pos").collect()
    assert [(r.style_name, "".join(x.text for x in r.runs)) for r in got] == [("Heading 1", "Overview"), ("Normal", "x < y & z"), ("Normal", "")]


def test_list_info(spark):
    cases = [(False, False, None, None, "List", None, (False, 0, False)), (True, False, None, None, "List Number", None, (True, 1, True)), (True, False, None, None, "Normal", None, (False, 0, False)), (True, True, 0, 2, "x", None, (False, 0, False)), (True, True, 4, 2, "x", False, (True, 3, False)), (True, True, 4, None, None, None, (True, 1, True))]
    df = spark.createDataFrame([c[:6] for c in cases], "p boolean, n boolean, id int, l int, s string, f boolean").coalesce(1)
    got = df.select(blocks.list_info(*(F.col(x) for x in ("p", "n", "id", "l", "s", "f"))).alias("i")).collect()
    assert [tuple(r.i) for r in got] == [c[6] for c in cases]


def test_overview_before_and_after_the_steps(spark):
    long = "This paragraph is long enough to stand for an overview of it."
    rows = [(1, 1, "Normal", 0, long), (1, 2, "Heading 1", 0, "Procedure"), (1, 3, "List Number", 1, "Do this"), (2, 1, "Heading 1", 0, "Procedure"), (2, 2, "List Number", 1, "Do that"), (2, 3, "Normal", 0, long)]
    paras = blocks.paragraphs(spark.createDataFrame(rows, "doc_id long, pos long, style_name string, list_level int, text string"))
    got = {r.doc_id: r.overview for r in segment.overview(paras).collect()}
    assert got == {1: long, 2: ""}


def test_stream_of_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1. Do it\n\nNote: see\nplain\n- item\n")
    lines = ingest.classified_lines(spark, str(tmp_path / "in"))
    q = ingest.class_counts(lines).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert {r["class"]: r.n for r in spark.table("counts").collect()} == {"step": 2, "callout_note": 1, "prose": 1}
    finally:
        q.stop()


def test_prompts_and_a_client(spark):
    df = spark.createDataFrame([(1, " body "), (2, "other")], "doc_id long, text string")
    prompts = df.select("doc_id", completion.user_message(F.col("text"), F.lit("f.docx")).alias("user_message"))
    r = prompts.orderBy("doc_id").first()
    assert "File: f.docx\n\nbody\n\n" in r.user_message and "Section" not in r.user_message
    out = completion.complete(prompts, lambda batch: [f'{{"title": "T{len(x)}", "procedure": [{{"heading": "H", "steps": []}}]}}' for x in batch]).withColumn("attempt", F.lit(1))
    assert {x.source for x in completion.first_valid(completion.read_attempts(out)).collect()} == {"completion"}
    body = json.loads(prompts.select(completion.request("m", completion.messages(F.col("user_message"))).alias("b")).first().b)
    assert body["messages"][0]["role"] == "system" and body["stream"] is False
    again = df.select(completion.retry_message(F.lit("x" * 3000), F.lit("bad")).alias("m")).first().m
    assert "[cut]" in again and len(again) < 2200


def test_a_folder_from_files_to_files(spark, tmp_path):
    from quire.plans.folder import format_folder, records

    def p(text, style="", num=""):
        props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{num}"/><w:numId w:val="1"/></w:numPr>' if num else "")
        return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'

    styles = f'<w:styles {W}>' + "".join(f'<w:style w:styleId="h{i}"><w:name w:val="Heading {i}"/></w:style>' for i in (1, 2, 3)) + "</w:styles>"
    row = lambda *cells: "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"
    body = [p("Buffer work", "h1"), p("This says at some length what the procedure is for."), p("Materials", "h1"), p("Salts", "h3"), "<w:tbl>" + row("Reagent", "Supplier", "Notes") + row("NaCl", "", "x") + "</w:tbl>"]
    body += [p("Procedure", "h1"), p("Mixing", "h2"), p("First some words"), p("Spin at 300 xg", num="0"), p("IMPORTANT: keep cold", num="0"), p("Sub step", num="1"), p("Can be stored", num="0"), p("References", "h1"), p("A book")]
    make(tmp_path / "one.docx", document=f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>", styles=styles)
    make(tmp_path / "empty.docx", document=f"<w:document {W}><w:body/></w:document>")
    (tmp_path / "bad.docx").write_bytes(b"x")
    got = {r.doc_id.rsplit("/", 1)[1]: json.loads(r.record) for r in records(spark, str(tmp_path)).collect()}
    one = got["one.docx"]
    assert one["title"] == "Buffer work" and one["overview"].startswith("This says") and one["references"] == ["A book"] and one["section_type"] == "wet_lab"
    assert one["materials"] == [{"heading": "Salts", "rows": [{"cells": ["NaCl", "—", "x"], "bold": False}]}] and one["subtitle"] is None
    section = one["procedure"][0]
    assert section["heading"] == "Mixing" and section["preamble"] == "First some words" and [c["text"] for c in section["callouts"]] == ["keep cold"]
    assert [(s["text"], s["depth"], s["step_type"]) for s in section["steps"]] == [("Spin at 300 × g", 0, "action"), ("Sub step", 1, "action"), ("Can be stored", 0, "stopping_point")]
    assert got["empty.docx"]["title"] == "Empty" and got["empty.docx"]["procedure"][0]["steps"][0]["text"].startswith("[")
    results = {r.path.rsplit("/", 1)[1]: r for r in format_folder(spark, str(tmp_path), f"file://{tmp_path}/out").collect()}
    assert {k: r.status for k, r in results.items()} == {"one.docx": "success", "empty.docx": "success", "bad.docx": "failed"}
    written = (tmp_path / "out" / "Buffer-Work_v1_0.docx").read_bytes()
    xml = zipfile.ZipFile(io.BytesIO(written)).read("word/document.xml").decode()
    order = ["Buffer work", "This says", "Materials", "Salts", "NaCl", "Procedure", "Mixing", "First some", "Caution", "Spin at 300 × g", "Sub step", "Safe stopping point", "Can be stored", "References", "A book", "End of Protocol"]
    assert [xml.index(x) for x in order] == sorted(xml.index(x) for x in order)


def test_rounds_of_attempts(spark):
    good = '{"title": "T", "section_type": "Wet_Lab ", "date": "5 March 2024", "procedure": [{"heading": "H", "steps": [{"depth": 0, "step_type": "action", "text": "x"}]}]}'

    def client(bodies):
        out = []
        for b in bodies:
            turns = json.loads(b)["messages"]
            tries = (len(turns) - 2) // 2
            wanted = int(turns[1]["content"])
            if tries:
                assert turns[-1]["role"] == "user" and "The answer was not valid" in turns[-1]["content"]
            out.append(good if tries >= wanted else [("no", None), ('{"title": "", "procedure": []}', None), (None, "not_json: <html>")][tries % 3])
        return out

    prompts = spark.createDataFrame([(i, str(i)) for i in range(6)], "doc_id long, user_message string")
    attempts = completion.extract(prompts, client)
    kinds = {}
    for r in attempts.orderBy("doc_id", "attempt").collect():
        kinds.setdefault(r.doc_id, []).append(r.failure_kind)
    assert kinds == {0: [None], 1: ["no_json", None], 2: ["no_json", "validation_error", None], 3: ["no_json", "validation_error", "not_json", None], **{k: ["no_json", "validation_error", "not_json", "no_json"] for k in (4, 5)}}
    assert {r.doc_id: (r.attempt, r.source) for r in completion.first_valid(attempts).collect()} == {k: (k + 1, "completion") if k < 4 else (None, "heuristic") for k in range(6)}
    with pytest.raises(completion.Unavailable):
        completion.extract(prompts, lambda bodies: [(None, "unavailable: refused")] * len(bodies))


def test_rounds_go_on_where_a_run_broke_off(spark, tmp_path):
    """Requests that have replies aren't sent again; a request without a reply is; the last word is the heuristic's."""
    good = '{"title": "T", "source_filename": "made up", "procedure": [{"heading": "H", "steps": [{"depth": 0, "step_type": "action", "text": "x"}]}]}'

    def client(bodies, log=str(tmp_path)):
        import uuid

        out = []
        for b in bodies:
            turns = json.loads(b)["messages"]
            tries, wanted = (len(turns) - 2) // 2, int(turns[1]["content"].split()[0])
            with open(f"{log}/sent_{uuid.uuid4().hex}", "w") as f:
                f.write(f"{wanted} {tries}")
            out.append((None, "unavailable: reset") if "lost" in turns[1]["content"] else good if tries >= wanted else "no")
        return out

    def sent():
        found = sorted(tuple(map(int, f.read_text().split())) for f in tmp_path.glob("sent_*"))
        for f in tmp_path.glob("sent_*"):
            f.unlink()
        return found

    prompts = spark.createDataFrame([(f"/in/{i}.docx", str(i)) for i in range(6)] + [("/in/9.docx", "0 lost")], "doc_id string, user_message string")
    store = f"file://{tmp_path}/store"
    completion.extract(prompts, client, most_attempts=2, store=store)  # and here the driver is lost
    assert sent() == sorted([(i, 0) for i in range(6)] + [(0, 0)] + [(i, 1) for i in range(1, 6)] + [(0, 0)])
    more = prompts.unionByName(spark.createDataFrame([("/in/7.docx", "0")], prompts.schema))
    attempts = completion.extract(more, client, store=store)
    assert sent() == sorted([(0, 0)] + [(0, 0)] * 4 + [(i, 2) for i in range(2, 6)] + [(i, 3) for i in range(3, 6)])
    own = spark.createDataFrame([(f"/in/{i}.docx", json.dumps({"title": f"own {i}", "source_filename": f"{i}.docx"})) for i in (1, 4, 5, 8, 9)], "doc_id string, j string").select("doc_id", F.from_json("j", records.RECORD).alias("record"))
    got = {r.doc_id[4]: (r.source, r.attempt, r.record and r.record.title, r.record and r.record.source_filename) for r in completion.with_fallback(attempts, own).collect()}
    assert got == {
        "0": ("completion", 1, "T", "made up"), "1": ("completion", 2, "T", "1.docx"), "2": ("completion", 3, "T", "made up"), "3": ("completion", 4, "T", "made up"), "7": ("completion", 1, "T", "made up"),
        "4": ("heuristic", None, "own 4", "4.docx"), "5": ("heuristic", None, "own 5", "5.docx"), "8": ("heuristic", None, "own 8", "8.docx"), "9": ("heuristic", None, "own 9", "9.docx"),
    }


def test_http_client():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = {"ok": '{"message": {"content": "hi"}}', "html": "<html>" * 100, "odd": '{"x": 1}'}[body["k"]].encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        do_GET = lambda self: (self.send_response(200), self.end_headers(), self.wfile.write(b'{"models": [{"name": "m"}]}'))

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    ok, html, odd = completion.HttpClient(url, 5)([json.dumps({"k": k}) for k in ("ok", "html", "odd")])
    assert ok == ("hi", None) and html[1].startswith("not_json: <html>") and len(html[1]) == 310 and odd[1].startswith("odd_structure")
    assert probes.server(url) == (True, ["m"])
    server.shutdown()
    server.server_close()
    assert completion.HttpClient(url, 1)(["{}"])[0][1].startswith("unavailable") and probes.server(url, 1) == (False, [])
    assert probes.command("no-such-program") is None and probes.command("python")


def test_files_by_type_and_a_converter(spark, tmp_path):
    make(tmp_path / "a.docx", document=BODY)
    (tmp_path / "b.doc").write_bytes((tmp_path / "a.docx").read_bytes())
    (tmp_path / "c.pdf").write_bytes(b"x")
    locked = bytearray((tmp_path / "a.docx").read_bytes())
    for at in (6, locked.index(b"PK\x01\x02") + 8):
        locked[at] |= 1  # says that it is encrypted
    (tmp_path / "d.docx").write_bytes(locked)
    every = ooxml.listing(spark, str(tmp_path), "*")
    problems = lambda rows: {r.path.rsplit("/", 1)[1]: r.problem for r in rows.where("kind = 'error'").collect()}
    got = problems(ooxml.read_files(every))
    assert got.pop("d.docx").startswith("RuntimeError") and got == {"b.doc": "no converter", "c.pdf": "unsupported type"}
    assert set(problems(ooxml.read_files(every, lambda data: data))) == {"c.pdf", "d.docx"}

    def fails(data):
        raise TimeoutError("120 s")

    assert problems(ooxml.read_files(every, fails))["b.doc"] == "TimeoutError: 120 s"
    assert {r.path.rsplit("/", 1)[1] for r in ooxml.listing(spark, str(tmp_path)).select("path").collect()} == {"a.docx", "b.doc", "d.docx"}


def test_steps_nested_deeper_than_eight(spark):
    rows = [(1, 0, i, "step", "step", i + 1, f"s{i}") for i in range(14)] + [(1, 0, 14, "step", "step", 12, "x"), (1, 0, 15, "step", "step", 1, "y")]
    tree = segment.step_tree(spark.createDataFrame(rows, "doc_id long, section_no long, pos long, kind string, class string, list_level int, text string"))
    got = {r.seq: (r.depth, r.parent_seq) for r in tree.collect()}
    assert got == {**{i: (i, i - 1 if i else None) for i in range(14)}, 14: (11, 10), 15: (0, None)}


def test_what_hangs_under_a_nested_stopping_point_is_not_shown(spark):
    step = lambda seq, depth, kind: {"seq": seq, "depth": depth, "parent_seq": None, "step_type": kind, "text": f"t{seq}", "code": "a\n\nb" if seq == 5 else None, "code_language": None}
    steps = [step(0, 0, "action"), step(1, 1, "stopping_point"), step(2, 2, "action"), step(3, 1, "action"), step(4, 0, "stopping_point"), step(5, 0, "action")]
    section = {"section_no": 0, "heading": "H", "preamble": None, "steps": steps, "callouts": [{"callout_type": "tip", "text": "c0", "after_step": 0}, {"callout_type": "note", "text": "c9", "after_step": 9}, {"callout_type": "note", "text": "top", "after_step": None}]}
    df = spark.createDataFrame([([section],)], "procedure " + records.RECORD.split("procedure ")[1].split(", notes")[0])
    for computational, kinds in ((False, ["step0"]), (True, ["code_step0", "code", "spacer"])):
        blocks_ = df.select(F.explode(render.procedure_blocks(F.col("procedure"), F.lit(computational))).alias("b")).select("b.*").collect()
        said = [(b.kind, b.body) for b in blocks_][2:]
        assert [k for k, _ in said] == ["heading2", "callout_note", "spacer", kinds[0], "stopping_point", kinds[0][:-1] + "1", "callout_tip", "spacer", "stopping_point", *kinds, "spacer"]
        assert said[1][1] == "ℹ\u00a0\u00a0Note\ntop" and said[4][1].endswith("t1") and said[5][1] == "t3"


def test_intermediate_tables_can_be_discarded(spark):
    from pathlib import Path

    from quire.sources import shared

    shared.discard(spark)
    rows = shared.written(spark.range(5))
    place = Path(rows.inputFiles()[0].removeprefix("file:")).parents[1]
    assert rows.count() == 5 and place.exists()
    assert shared.discard(spark) == 1 and not place.exists() and shared.discard(spark) == 0


def test_files_are_deflated_and_alike_in_their_shared_parts():
    """A part that all files share is packed once, and a long one is deflated."""
    from quire.sources.docx import _shared_parts, document_bytes

    _shared_parts.cache_clear()
    files = [document_bytes([("paragraph", f"said {k}")] * 500, {"title": f"T{k}"}) for k in range(20)]
    assert _shared_parts.cache_info().misses == 1
    for k, data in enumerate(files):
        z = zipfile.ZipFile(io.BytesIO(data))
        assert z.testzip() is None and len(data) < sum(x.file_size for x in z.infolist()) / 4
        rows = ooxml.read_blocks(data)
        assert rows[0]["title"] == f"T{k}" and [r["runs"][0]["text"] for r in rows[1:]] == [f"said {k}"] * 500


def test_documents_with_their_blocks_are_packed_as_they_are(spark, sf):
    from quire import queries

    plan = queries.queries()["word_properties"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "Aggregate" not in plan


def test_parts_are_read_as_the_directory_says(tmp_path):
    """What isn't there as the directory says is the file's error, as it was with zipfile alone."""
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", BODY)
        z.writestr("word/styles.xml", STYLES)
    data = whole.getvalue()
    assert [r["kind"] for r in ooxml.read_blocks(data)] == ["properties", "paragraph", "paragraph", "table"]
    at = data.index(b"word/document.xml") + len("word/document.xml")
    with pytest.raises(Exception, match="CRC|decompress|invalid"):
        ooxml.read_blocks(data[: at + 40] + bytes([data[at + 40] ^ 0x55]) + data[at + 41 :])


def test_a_record_is_rendered_in_its_one_row(spark, sf):
    """The blocks of a record aren't told apart and gathered again before its file is packed; one aggregation, by document, comes after."""
    from quire import queries

    plan = queries.queries()["rendered_files"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1 and "posexplode" not in plan


def test_workers_hold_bounded_pieces_of_a_batch(spark, monkeypatch):
    """A batch of many documents is made into files, and read, a few blocks at a time; documents and rows stay whole and in order."""
    import pyarrow as pa

    blocks_ = [{"kind": "paragraph", "body": "x", "cells": None}]
    batch = pa.RecordBatch.from_pylist([{"doc_id": str(k), "output_name": "x.docx", "blocks": blocks_ * n} for k, n in enumerate([1000] * 10 + [5000, 0, 3, 2048])])
    pieces = list(ooxml._pieces(batch))
    assert [d for p in pieces for d in p.column(0).to_pylist()] == [str(k) for k in range(14)]
    assert all(p.num_rows == 1 or sum(len(b) for b in p.column(2).to_pylist()) <= ooxml.AT_ONCE for p in pieces)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("x.docx").alias("output_name"), F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.struct(F.lit("paragraph").alias("kind"), F.concat(F.lit("p"), k.cast("string")).alias("body"), F.lit(None).cast("array<string>").alias("cells"))).alias("blocks"))
    files = ooxml.pack(rows).select(F.col("doc_id").alias("path"), "content")
    got = ooxml.read_bytes(files).where("kind = 'paragraph'")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(4 << 20)
    assert got.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct(F.col("runs")[0]["text"]).alias("texts")).where("n = 100 and texts = 100").count() == 40


def test_records_of_files_meet_in_one_exchange(spark, sf):
    """The driver never has one plan of all parts of the records: each part is written, and they meet in one aggregation."""
    from quire import queries

    plan = queries.queries()["records_from_files"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_no_part_of_the_records_is_broadcast(spark, sf):
    """By the size of compressed files a side of millions of rows may seem small enough for the driver."""
    from quire import queries
    from quire.plans import folder

    files = queries._words(spark, sf).select(F.concat(F.lit("/in/"), "output_name").alias("path"), "content")
    f = folder.Folder(spark, files=files)
    for part in (folder._sections(f), f.materials, f.mixes):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan


def test_documents_are_written_from_sorted_rows(spark, monkeypatch):
    """No document is one value on its way to its file, and its rows may come in any order and batches."""
    monkeypatch.setattr(ooxml, "AT_ONCE", 7)
    rows = [(d, f"{d}.docx", n, "paragraph", f"text {d} {n}") for d in (1, 2, None) for n in range(40)]
    packed = ooxml.pack_documents(spark.createDataFrame(rows[::-1], "doc_id long, output_name string, block_no long, kind string, body string"))
    plan = packed._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    got = {r.doc_id: ooxml.read_blocks(bytes(r.content)) for r in packed.collect()}
    assert set(got) == {"1", "2", None}
    for d, found in got.items():
        assert [r["runs"][0]["text"] for r in found if r["kind"] == "paragraph"] == [f"text {d} {n}" for n in range(40)]


def test_long_documents_are_parsed_by_parts(spark, monkeypatch):
    """A child of the body at a time gives the same blocks; an error late in the file is still its only row."""
    cells = [("material_header", "", ["a", "b"]), ("material", "", ["x", "y"])]
    from quire.sources.docx import document_bytes

    whole = document_bytes([("heading1", "H", None), *cells, *[("paragraph", f"**b** {n} _i_", None) for n in range(60)], ("callout_note", "one\ntwo", None), ("step1", "s", None)], {"title": "T"}, {1: "note"})
    want = ooxml.read_blocks(whole)
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:  # the last paragraph's level isn't a number that can be read
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ooxml.W[1:-1]}"><w:body>{"<w:p><w:r><w:t>t</w:t></w:r></w:p>" * 60}<w:p><w:pPr><w:numPr><w:ilvl w:val="²"/></w:numPr></w:pPr></w:p></w:body></w:document>')
    bad = made.getvalue()
    monkeypatch.setattr(ooxml, "LONG_PART", 0)
    held = []
    for child in ooxml._children(zipfile.ZipFile(io.BytesIO(whole)).read("word/document.xml")):
        held.append(child.tag)
    assert len(held) == 65 and ooxml.read_blocks(whole) == want and len(want) > 60
    monkeypatch.setattr(ooxml, "AT_ONCE", 7)
    got = ooxml.read_bytes(spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(bad)), ("c", bytearray(whole))], "path string, content binary").coalesce(1)).collect()
    assert [[r.kind for r in got if r.path == p] for p in "abc"] == [[r["kind"] for r in want], ["error"], [r["kind"] for r in want]]
