"""Paragraphs from runs and text, and the plain serialisation of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import classify, text


def paragraphs(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, style_name, list_level, text -> with raw_text, text (units normalised), is_list, is_numbered, heading_level. Blank paragraphs go."""
    out = blocks.select("doc_id", "pos", "style_name", "list_level", F.col("text").alias("marked"), text.normalize_whitespace(F.col("text")).alias("raw_text"))
    out = out.where(F.length("raw_text") > 0)
    return out.select("doc_id", "pos", "style_name", "list_level", "raw_text", text.normalize_units(F.col("marked")).alias("text"), F.contains(F.lower("style_name"), F.lit("list")).alias("is_list"), F.contains(F.lower("style_name"), F.lit("number")).alias("is_numbered"), classify.heading_level(F.col("raw_text"), F.col("style_name")).alias("heading_level"))


def list_info(has_properties: Column, has_numbering: Column, num_id: Column, ilvl: Column, style: Column, numbered: Column) -> Column:
    """struct<is_list, level, numbered> of a paragraph's numbering properties."""
    s = F.lower(F.coalesce(style, F.lit("")))
    made = lambda a, b, c: F.struct(a.alias("is_list"), b.cast("int").alias("level"), c.alias("numbered"))
    no = made(F.lit(False), F.lit(0), F.lit(False))
    by_style = F.when(F.contains(s, F.lit("list")), made(F.lit(True), F.lit(1), F.contains(s, F.lit("number")))).otherwise(no)
    return F.when(~has_properties, no).when(~has_numbering, by_style).when(num_id == 0, no).otherwise(made(F.lit(True), F.coalesce(ilvl, F.lit(0)) + 1, F.coalesce(numbered, F.lit(True))))


def numbered_lists(numberings: DataFrame, abstracts: DataFrame) -> DataFrame:
    """(doc_id, num_id, abstract_id) and (doc_id, abstract_id, ilvl, fmt) -> (doc_id, num_id, ilvl, numbered). A missing link counts as numbered."""
    joined = numberings.join(abstracts, ["doc_id", "abstract_id"], "left")
    return joined.select("doc_id", "num_id", F.coalesce("ilvl", F.lit(0)).alias("ilvl"), F.coalesce(F.col("fmt") != "bullet", F.lit(True)).alias("numbered"))


def merge_runs(runs: DataFrame) -> DataFrame:
    """para_id, run_pos, text, bold, italic -> para_id, marked_text: neighbours of one format merged, spaces kept outside the marks.

    Gaps and islands over one window, then two ordered collections per paragraph; all on para_id, so one exchange.
    """
    shown = F.translate(F.translate(F.coalesce("text", F.lit("")), text.RUN_SPACES, " " * len(text.RUN_SPACES)), text.RUN_NOTHING, "")
    runs = runs.select("para_id", "run_pos", shown.alias("t"), F.coalesce("bold", F.lit(False)).alias("b"), F.coalesce("italic", F.lit(False)).alias("i")).where(F.length("t") > 0)
    w = Window.partitionBy("para_id").orderBy("run_pos")
    form = F.col("b").cast("int") * 2 + F.col("i").cast("int")
    new = F.coalesce((form != F.lag(form).over(w)).cast("int"), F.lit(1))
    islands = runs.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run_pos", "t"))), lambda x: x["t"]), "")
    merged = islands.groupBy("para_id", "island").agg(F.first("b").alias("b"), F.first("i").alias("i"), joined.alias("t"))
    inner = F.trim("t")
    left, right = F.regexp_extract("t", "^ *", 0), F.regexp_extract("t", " *$", 0)
    around = lambda a, z: F.concat(left, F.lit(a), inner, F.lit(z), right)
    marked = (
        F.when((F.length(inner) == 0) | ~(F.col("b") | F.col("i")), F.col("t"))
        .when(F.col("b") & F.col("i"), around("_**", "**_"))
        .when(F.col("b"), around("**", "**"))
        .otherwise(around("_", "_"))
    )
    return merged.select("para_id", "island", marked.alias("t")).groupBy("para_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("island", "t"))), lambda x: x["t"]), "").alias("marked_text"))


def full_text(paras: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, full_text: a line a paragraph (heading marks, list indents with a number or a dash, text) and a line a table row, in block order.

    Paragraphs (doc_id, pos, ...) and table rows (doc_id, pos, row_ord, cells) become lines apart and meet in one aggregation by document, so one exchange. Cells are normalised; rows of blank cells
    have no line, nor has a table of such rows."""
    heading = F.when(F.col("heading_level") > 0, F.concat(F.repeat(F.lit("#"), F.col("heading_level")), F.lit(" ")))
    marker = F.when(F.col("is_numbered"), F.concat(F.col("list_level").cast("string"), F.lit("."))).otherwise("-")
    item = F.when(F.col("is_list"), F.concat(F.repeat(F.lit("  "), F.col("list_level") - 1), marker, F.lit(" ")))
    line = F.concat(F.coalesce(heading, item, F.lit("")), F.col("text"))
    lines = paras.select("doc_id", F.col("pos").cast("long").alias("pos"), F.lit(0).alias("row_ord"), line.alias("line"))
    if rows is not None:
        piped = F.concat(F.lit("| "), F.array_join("cells", " | "), F.lit(" |"))
        lines = lines.unionByName(table_rows(rows).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("row_ord").cast("int").alias("row_ord"), piped.alias("line")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "row_ord", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("full_text"))


def counts(rows: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_tables, n_footnotes of documents given as blocks (doc_id, kind, runs); blank paragraphs don't count."""
    said = F.exists("runs", lambda r: F.length(text.strip(r["text"])) > 0)
    return rows.groupBy("doc_id").agg(F.count_if((F.col("kind") == "paragraph") & said).alias("n_paragraphs"), F.count_if(F.col("kind") == "table").alias("n_tables"), F.count_if(F.col("kind") == "footnote").alias("n_footnotes"))


def table_rows(tables: DataFrame) -> DataFrame:
    """Rows of tables with normalised cells; rows whose cells are all blank go."""
    cells = F.transform("cells", text.normalize_whitespace)
    return tables.withColumn("cells", cells).where(F.exists("cells", lambda c: F.length(c) > 0))
