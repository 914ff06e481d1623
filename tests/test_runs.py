from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quire.operators import manifest
from quire.sources import filesink


def listing(spark, rows):
    return spark.createDataFrame([(p, c, k) for k, (p, c) in enumerate(rows)], "path string, content binary, status int").withColumn("content_hash", manifest.content_hash(F.col("content"))).drop("content")


def test_contents_from_run_to_run(spark, tmp_path):
    folder = f"file://{tmp_path}/manifest"
    first = listing(spark, [("/a/x", b"1"), ("/a-b/y", b"1"), ("/a/z", b"2"), ("/a/n", None), ("/b/n", None)]).drop("status")
    got = {r.path: (r.status, r.first_path) for r in manifest.told(first, folder).collect()}
    assert got == {"/a/x": ("new", "/a/x"), "/a-b/y": ("repeat", "/a/x"), "/a/z": ("new", "/a/z"), "/a/n": ("new", "/a/n"), "/b/n": ("new", "/b/n")}
    manifest.add(folder, manifest.told(first, folder).where("status = 'new' and content_hash is not null").withColumn("output_path", F.concat(F.lit("/out"), "path")))
    second = listing(spark, [("/c/new name", b"1"), ("/c/q", b"3"), ("/a/z", b"2"), ("/c/n", None)]).drop("status")
    got = {r.path: (r.status, r.done_path) for r in manifest.told(second, folder).collect()}
    assert got == {"/c/new name": ("done", "/a/x"), "/c/q": ("new", None), "/a/z": ("done", "/a/z"), "/c/n": ("new", None)}
    assert manifest.told(second.limit(0), folder).count() == 0


def test_runs_at_the_same_time_lose_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/manifest"

    def run(k):
        rows = [(f"{k}-{i}", f"/{k}/{i}", "") for i in range(50)] + [("both", f"/{k}/both", "")]
        manifest.add(folder, spark.createDataFrame(rows, "content_hash string, path string, output_path string").repartition(3))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, range(4)))
    found = manifest.known(spark, folder)
    assert found.count() == 4 * 50 + 1


def test_sink_commits_all_or_nothing(spark, tmp_path):
    rows = [(str(k), f"f{k}.bin", b"x" * k) for k in range(40)]
    files = spark.createDataFrame(rows, "doc_id string, output_name string, content binary").repartition(5)
    out = tmp_path / "out"
    said = filesink.save(files, f"file://{out}")
    assert {(r.doc_id, r.output_path, r.n_bytes) for r in said.collect()} == {(str(k), f"file://{out}/f{k}.bin", k) for k in range(40)}
    assert sorted(p.name for p in out.iterdir() if p.is_file()) == sorted(n for _, n, _ in rows) and (out / "f7.bin").read_bytes() == b"x" * 7
    assert not list((out / "_staging").glob("*")) if (out / "_staging").exists() else True
    # one task fails after it has written files, others have ended: nothing of the job is left, what was there stays
    bad = files.withColumn("output_name", F.when(F.col("doc_id") == "17", None).otherwise(F.concat(F.lit("new-"), "output_name")))
    with pytest.raises(Exception, match="without a name"):
        filesink.save(bad, f"file://{out}")
    assert sorted(p.name for p in out.iterdir() if p.is_file()) == sorted(n for _, n, _ in rows)
    assert not [p for p in out.rglob("*") if p.is_file() and "_staging" in str(p)]
    assert filesink.status(spark, f"file://{out}").count() == 40


def test_a_folder_formatted_twice(spark, tmp_path):
    import io
    import zipfile

    from quire.plans.folder import format_folder

    def docx(words):
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.writestr(zipfile.ZipInfo("word/document.xml"), f"<w:document {w}><w:body><w:p><w:r><w:t>{words}</w:t></w:r></w:p></w:body></w:document>")
        return data.getvalue()

    source, out, kept = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/manifest"
    source.mkdir()
    for name, words in (("one", "Some words"), ("two", "Other words"), ("same", "Some words")):
        (source / f"{name}.docx").write_bytes(docx(words))
    short = lambda rows: {r.path.rpartition("/")[2]: (r.status, (r.reason or "").rpartition("/")[2]) for r in rows.collect()}
    assert short(format_folder(spark, str(source), out, manifest_folder=kept)) == {"one.docx": ("success", ""), "two.docx": ("success", ""), "same.docx": ("skipped", "one.docx")}
    (source / "three.docx").write_bytes(docx("Third words"))
    (source / "one.docx").rename(source / "renamed.docx")
    assert short(format_folder(spark, str(source), out, manifest_folder=kept)) == {"three.docx": ("success", ""), "renamed.docx": ("skipped", "one.docx"), "two.docx": ("skipped", "two.docx"), "same.docx": ("skipped", "one.docx")}
