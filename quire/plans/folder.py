"""A folder of Word files, from bytes to records and to written files, as one set-oriented plan; a bad file is a row, never an exception."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import classify, text
from quire.operators import batch, blocks, completion, giants, manifest, registry, render, segment, tables
from quire.sources import ooxml
from quire.sources.records import RECORD
from quire.sources.shared import written


def sorted_side(rows: DataFrame) -> DataFrame:
    """The side of a join that is never broadcast: written tables compress to a small part of what they take in the driver's memory, and by their files' size they seem small enough."""
    return rows.hint("merge")


@dataclass(frozen=True)
class Folder:
    """The stages over a folder's files, or over `files` (path, content); doc_id is a file's path.

    Files are parsed once: blocks, paragraphs with their levels and paragraphs with their segments are written to the shared folder, and all else reads those, as are heads and each part of the records.
    """

    spark: SparkSession
    path: str = ""
    glob: str = "*.docx"
    author: str = "Unattributed"
    version: str = "1.0"
    section: str = ""  # the section that the documents are said to belong to
    sections_registry: dict[str, str] = field(default_factory=dict)
    converter: Callable[[bytes], bytes] | None = None
    files: DataFrame | None = None

    @cached_property
    def raw(self) -> DataFrame:
        files = self.files if self.files is not None else ooxml.listing(self.spark, self.path, self.glob)
        return written(ooxml.read_files(files, self.converter), "blocks").withColumnRenamed("path", "doc_id")

    @cached_property
    def documents(self) -> DataFrame:
        """doc_id, problem, properties: one row a file."""
        first = lambda c: F.max(c).alias(c)
        return self.raw.groupBy("doc_id").agg(first("problem"), first("title"), first("author"), first("date"))

    @cached_property
    def paragraphs(self) -> DataFrame:
        rows = self.raw.where("kind = 'paragraph'")
        info = blocks.list_info(*(F.col(c) for c in ("has_properties", "has_numbering", "num_id", "ilvl", "style_name", "numbered")))
        place = F.concat_ws("\n", "doc_id", F.col("pos").cast("string"))
        runs = rows.select(place.alias("para_id"), F.posexplode("runs").alias("run_pos", "r")).select("para_id", "run_pos", "r.text", "r.bold", "r.italic")
        marked = blocks.merge_runs(runs)
        whole = F.array_join(F.transform("runs", lambda r: r["text"]), "")
        out = rows.select("doc_id", "pos", "style_name", place.alias("para_id"), text.normalize_whitespace(whole).alias("raw_text"), info.alias("i")).join(sorted_side(marked), "para_id").where(F.length("raw_text") > 0)
        return written(out.select("doc_id", "pos", "style_name", F.col("i.level").alias("list_level"), "raw_text", text.normalize_units(F.col("marked_text")).alias("text"), F.col("i.is_list").alias("is_list"), F.col("i.numbered").alias("is_numbered"), classify.heading_level(F.col("raw_text"), F.col("style_name")).alias("heading_level")), "paragraphs")

    @cached_property
    def segmented(self) -> DataFrame:
        return written(giants.by_size(self.paragraphs, segment.segments, giants.segments), "segments")

    @cached_property
    def sections(self) -> DataFrame:
        return written(giants.by_size(self.segmented, segment.procedure, giants.procedure), "sections")

    @cached_property
    def tree(self) -> DataFrame:
        return giants.by_size(self.sections, segment.step_tree, giants.step_tree)

    @cached_property
    def callouts(self) -> DataFrame:
        rows = self.sections.where("kind = 'callout'")
        return rows.select("doc_id", "section_no", F.col("pos").alias("ord"), F.substring("class", 9, 20).alias("callout_type"), text.strip_callout_prefix(F.col("text")).alias("text"), F.lit(None).cast("long").alias("after_step"))

    @cached_property
    def heads(self) -> DataFrame:
        """doc_id, title, author, date, section_type, overview, output_name."""
        p = self.paragraphs.groupBy("doc_id").agg(F.min_by("raw_text", F.when(F.col("heading_level") == 1, F.col("pos"))).alias("heading"))
        rows = self.raw.where("kind = 'table'").select("doc_id", "pos", F.posexplode("cells").alias("row_ord", "cells"))
        kinds = blocks.full_text(self.paragraphs, rows).select("doc_id", classify.section_type(F.col("full_text")).alias("section_type"))
        d = self.documents.where("problem is null").join(sorted_side(p), "doc_id", "left").join(sorted_side(kinds), "doc_id", "left").join(sorted_side(segment.overview(self.paragraphs)), "doc_id", "left")
        heading = F.when(F.col("heading").isNotNull(), text.clean_title(F.col("heading")))
        title = F.coalesce(F.when(F.length("title") > 0, F.col("title")), heading, text.stem_title(F.col("doc_id")))
        out = d.select("doc_id", title.alias("title"), text.author(F.col("author"), None, self.author).alias("author"), "date", F.coalesce("section_type", F.lit("wet_lab")).alias("section_type"), F.coalesce("overview", F.lit("")).alias("overview"))
        out = out.withColumn("place", registry.section(F.lit(self.section), F.col("section_type") == "computational", self.sections_registry))
        return written(out.withColumn("output_name", text.output_filename(F.col("place.number"), F.col("title"), F.lit(self.version))), "heads")

    def _tables(self, role: str) -> tuple[DataFrame, DataFrame]:
        wet = self.heads.where("section_type = 'wet_lab'").select("doc_id")
        t = self.raw.where("kind = 'table'").join(sorted_side(wet), "doc_id", "left_semi").select("doc_id", F.col("pos").alias("table_ord"), F.posexplode("cells").alias("row_ord", "cells"))
        h = self.segmented.where((F.col("segment") == role) & (F.col("heading_level") == 3))
        return t, sorted_side(h).select("doc_id", (F.row_number().over(segment.by_document()) - 1).alias("ord"), F.col("raw_text").alias("heading"))

    @cached_property
    def materials(self) -> DataFrame:
        return tables.materials(*self._tables("materials"))

    @cached_property
    def mixes(self) -> DataFrame:
        return tables.mixes(*self._tables("mixes"), sorted_side(self.segmented.where("segment = 'mixes'")))

    @cached_property
    def notes(self) -> DataFrame:
        foot = self.raw.where("kind = 'footnote'").select("doc_id", F.col("footnote_id").alias("id"), F.get("runs", F.lit(0))["text"].alias("text"))
        return segment.notes(self.segmented, foot)

    @cached_property
    def references(self) -> DataFrame:
        return segment.references(self.segmented)


def listed(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(name))


def _table_list(rows: DataFrame, name: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("row_ord", "cells", "bold")))
    one = rows.groupBy("doc_id", "table_no").agg(F.first("heading").alias("heading"), F.transform(ordered, lambda x: F.struct(x["cells"].alias("cells"), x["bold"].alias("bold"))).alias("rows"))
    return one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "heading", "rows"))), lambda t: F.struct(t["heading"].alias("heading"), t["rows"].alias("rows"))).alias(name))


_STEP = "struct<seq: int, depth: int, parent_seq: int, step_type: string, text: string, code: string, code_language: string>"
_CALLOUT = "struct<callout_type: string, text: string, after_step: bigint>"


def procedures(sections: DataFrame, tree: DataFrame, callouts: DataFrame) -> DataFrame:
    """doc_id, procedure: sections with their steps as an adjacency list (seq, depth, parent_seq) and their callouts."""
    key = ["doc_id", "section_no"]
    heads = sections.groupBy(key).agg(F.first("heading").alias("heading"), F.max(F.when(F.col("kind") == "preamble", F.col("text"))).alias("preamble"))
    kind = F.when(F.col("kind") == "stopping_point", "stopping_point").otherwise("action")
    no = F.lit(None).cast("string")
    steps = tree.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "depth", "parent_seq", kind.alias("step_type"), "text", no.alias("code"), no.alias("code_language")).cast(_STEP))).alias("steps"))
    ordered = F.array_sort(F.collect_list(F.struct("ord", "callout_type", "text", "after_step")))
    calls = callouts.groupBy(key).agg(F.transform(ordered, lambda c: F.struct(c["callout_type"].alias("callout_type"), c["text"].alias("text"), c["after_step"].cast("bigint").alias("after_step"))).alias("callouts"))
    joined = heads.join(sorted_side(steps), key, "left").join(sorted_side(calls), key, "left")
    empty = lambda kind: F.expr("array()").cast(f"array<{kind}>")
    section = F.struct(F.col("section_no").cast("bigint").alias("section_no"), "heading", "preamble", F.coalesce("steps", empty(_STEP)).alias("steps"), F.coalesce("callouts", empty(_CALLOUT)).alias("callouts"))
    return joined.groupBy("doc_id").agg(F.array_sort(F.collect_list(section)).alias("procedure"))


def _sections(f: Folder) -> DataFrame:
    """doc_id, procedure of every readable file; without a section: all list items in one, or a placeholder."""
    made = procedures(f.sections, f.tree, f.callouts)
    items = f.paragraphs.where("is_list and heading_level = 0").withColumn("seq", (F.row_number().over(segment.by_document()) - 1).cast("int"))
    no = F.lit(None)
    bare = lambda seq, body: F.struct(seq.alias("seq"), F.lit(0).alias("depth"), no.alias("parent_seq"), F.lit("action").alias("step_type"), body.alias("text"), no.alias("code"), no.alias("code_language")).cast(_STEP)
    all_items = items.groupBy("doc_id").agg(F.array_sort(F.collect_list(bare(F.col("seq"), F.col("text")))).alias("all_items"))
    docs = f.heads.select("doc_id").join(sorted_side(made), "doc_id", "left").join(sorted_side(all_items), "doc_id", "left")
    fallback = F.array(F.struct(F.lit(0).cast("bigint").alias("section_no"), F.lit("Procedure").alias("heading"), F.lit(None).cast("string").alias("preamble"), F.coalesce("all_items", F.array(bare(F.lit(0), F.lit(render.PLACEHOLDER)))).alias("steps"), F.expr("array()").cast(f"array<{_CALLOUT}>").alias("callouts")))
    return docs.select("doc_id", F.coalesce("procedure", fallback).alias("procedure"))


def record_rows(f: Folder) -> DataFrame:
    """doc_id, output_name, record (a struct of the declared schema) of each readable file."""
    parts = {
        "materials": _table_list(f.materials, "materials"), "mix_tables": _table_list(f.mixes, "mix_tables"), "notes": listed(f.notes, "number", "note", "notes"), "references": listed(f.references, "number", "reference", "references"),
        "prerequisites": segment.prerequisites(f.segmented).select("doc_id", F.struct("software", "access", "dependencies").alias("prerequisites")), "procedure": _sections(f),
    }
    head = [c for c in f.heads.columns if c != "doc_id"]
    # each part is a job of its own, so that the driver never holds a plan of all of them; they meet in one aggregation
    rows = [f.heads.select("doc_id", F.struct(*head).alias("head")), *(written(part, name) for name, part in parts.items())]
    met = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows).groupBy("doc_id").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("head", *parts)))
    whole = met.where("head is not null").select("doc_id", "head.*", *parts)
    none = lambda c: F.coalesce(c, F.expr("array()").cast(whole.schema[c].dataType)).alias(c)
    record = F.struct(
        "title", F.lit(None).cast("string").alias("subtitle"), "author", "section_type", F.col("place.number").alias("section_number"), F.col("place.name").alias("section_name"), F.lit(f.version).alias("version"), "date", "overview",
        none("materials"), F.when(F.col("section_type") == "computational", F.col("prerequisites")).alias("prerequisites"), "procedure", none("notes"), none("references"), none("mix_tables"),
        F.element_at(F.split("doc_id", "/"), -1).alias("source_filename"),
    )
    return whole.select("doc_id", "output_name", record.cast(StructType.fromDDL(RECORD)).alias("record"))


def records(spark: SparkSession, path: str, **options) -> DataFrame:  # noqa: ANN003  a Folder's
    """doc_id, output_name, record: each readable file's record as JSON, nulls written out."""
    return record_rows(Folder(spark, path, **options)).select("doc_id", "output_name", F.to_json("record", {"ignoreNullFields": "false"}).alias("record"))


def extracted(f: Folder, client: Callable, model: str = "model", store: str | None = None) -> DataFrame:
    """doc_id, record, source, attempt: each readable file's record by a completion service, or the heuristic's where no attempt was valid. `store` keeps the replies from run to run."""
    own = written(record_rows(f), "records")
    rows = f.raw.where("kind = 'table'").select("doc_id", "pos", F.posexplode("cells").alias("row_ord", "cells"))
    body = blocks.full_text(f.paragraphs, rows).join(own.select("doc_id", "record.section_type"), "doc_id")
    prompts = body.select("doc_id", completion.user_message(F.col("full_text"), F.element_at(F.split("doc_id", "/"), -1), F.lit(f.section), F.col("section_type")).alias("user_message"))
    return completion.with_fallback(completion.extract(prompts, client, model, store=store), own)


def format_folder(spark: SparkSession, path: str, out: str, case_sensitive: bool = False, manifest_folder: str = "", **options) -> DataFrame:  # noqa: ANN003  a Folder's
    """path, status, output_path, reason: a row a file, whatever is wrong with it. Files whose names repeat are skipped; of files with one output name the first is written.

    With a manifest, a folder that is kept from run to run, contents that an earlier run has written are skipped, and so are all but the first of the files with one content."""
    told, f = None, Folder(spark, path, **options)
    if manifest_folder:
        files = f.files if f.files is not None else ooxml.listing(spark, path, f.glob)
        told = written(manifest.told(files.select("path", manifest.content_hash(F.col("content")).alias("content_hash")), manifest_folder), "told")
        f = Folder(spark, path, **{**options, "files": files.join(told.where("status = 'new'").select("path"), "path", "left_semi")})
    listed = batch.duplicates(f.documents.select(F.col("doc_id").alias("path"), "problem"), case_sensitive)
    made = written(record_rows(f), "records")
    unlike = made.join(listed.where("not duplicate").select(F.col("path").alias("doc_id")), "doc_id", "left_semi")
    chosen = unlike.join(batch.first_of_each(unlike.select("doc_id", "output_name")), ["doc_id", "output_name"], "left_semi")
    done = written(ooxml.write_documents(render.plan(chosen), out), "files")
    joined = listed.join(done.select(F.col("doc_id").alias("path"), "output_path"), "path", "left")
    status = F.when(F.col("duplicate"), "skipped").when(F.col("output_path").isNotNull(), "success").otherwise("failed")
    reason = F.when(F.col("duplicate"), "duplicate name").when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("output_path").isNull(), "output name taken")
    rows = joined.select("path", status.alias("status"), "output_path", reason.alias("reason"))
    if told is None:
        return rows
    rows = written(rows, "outcomes")
    manifest.add(manifest_folder, rows.where("status = 'success'").join(told.select("path", "content_hash"), "path"))
    why = F.when(F.col("status") == "done", F.concat(F.lit("written before as "), "done_path")).otherwise(F.concat(F.lit("same content as "), "first_path"))
    skipped = told.where("status <> 'new'").select("path", F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("output_path"), why.alias("reason"))
    return rows.unionByName(skipped)
