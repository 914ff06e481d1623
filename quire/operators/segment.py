"""Segmentation, procedure sections, and list nesting: windows over one key, so each document is exchanged once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import classify


def by_document() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("pos")


def up_to_here() -> WindowSpec:
    return by_document().rowsBetween(Window.unboundedPreceding, 0)


def _with_segment(paras: DataFrame) -> DataFrame:
    role = F.when(F.col("heading_level") == 1, classify.role(F.col("raw_text")))
    return paras.withColumn("segment", F.coalesce(F.last(role, True).over(up_to_here()), F.lit("pre_overview")))


def segments(paras: DataFrame) -> DataFrame:
    """Paragraphs with `segment`, the role of the last first-level heading that has one; first-level headings go."""
    return _with_segment(paras).where("heading_level <> 1").withColumn("class", classify.paragraph_class(F.col("raw_text"), F.col("is_list")))


def procedure(segmented: DataFrame) -> DataFrame:
    """Rows of procedure sections: section_no, heading, kind (preamble, callout, step, stopping_point), class, text, list_level.

    Sections with neither a step nor a callout are left out.
    """
    rows = segmented.where("segment = 'procedure'")
    second = F.col("heading_level") == 2
    rows = rows.withColumn("section_no", F.sum(second.cast("int")).over(up_to_here())).withColumn("heading", F.coalesce(F.last(F.when(second, F.col("raw_text")), True).over(up_to_here()), F.lit("Procedure")))
    rows = rows.where("heading_level = 0")
    w = Window.partitionBy("doc_id", "section_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    stepped = F.sum(F.col("class").isin("step", "stopping_point").cast("int")).over(w)
    prose = F.col("class") == "prose"
    first = F.sum(prose.cast("int")).over(w) == 1
    kind = F.when(F.startswith("class", F.lit("callout_")), "callout").when(prose & first & (stepped == 0), "preamble").when(prose, "step").otherwise(F.col("class"))
    rows = rows.withColumn("kind", kind)
    whole = Window.partitionBy("doc_id", "section_no")
    return rows.withColumn("n_kept", F.sum((F.col("kind") != "preamble").cast("int")).over(whole)).where("n_kept > 0").drop("n_kept")


def step_tree(sections: DataFrame) -> DataFrame:
    """Steps with seq, depth and parent_seq.

    A step hangs at its list level, but at most one below the step before it: depth(i) = min(a(i), depth(i-1) + 1), with a(i) = 0 for the
    first step, prose and stopping points. That is i + the running minimum of a(j) - j.
    """
    w = Window.partitionBy("doc_id", "section_no").orderBy("pos")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = sections.where("kind in ('step', 'stopping_point')").withColumn("seq", F.row_number().over(w) - 1)
    a = F.when((F.col("class") == "step") & (F.col("seq") > 0), F.greatest(F.col("list_level") - 1, F.lit(0))).otherwise(0)
    rows = rows.withColumn("depth", (F.col("seq") + F.min(a - F.col("seq")).over(up)).cast("int"))
    under_stop = (F.col("depth") > 0) & (F.last(F.when(F.col("depth") == 0, F.col("kind")), True).over(up) == "stopping_point")
    rows = rows.withColumn("rendered", ~under_stop)
    # a step's parent is the last one before it that is one level up: each step stands once for itself and once, a level down, for its children
    twice = rows.withColumn("as", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("int").alias("above")), F.struct((F.col("depth") + 1).alias("level"), F.col("seq").alias("above")))))
    beside = Window.partitionBy("doc_id", "section_no", "as.level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return twice.withColumn("parent_seq", F.last("as.above", True).over(beside).cast("int")).where("as.above is null").drop("as")


STYLES = ("decimal", "lower_letter", "lower_roman")


def number_style(computational: Column | None = None) -> Column:
    """By depth; deeper steps have bullets, or nothing in computational documents."""
    deeper = F.lit("bullet") if computational is None else F.when(computational, "none").otherwise("bullet")
    return F.coalesce(F.get(F.array(*map(F.lit, STYLES)), F.col("depth")), deeper)


def step_numbers(tree: DataFrame, computational: Column | None = None) -> DataFrame:
    """Rendered action steps with number_style and ordinal, which runs through the whole document for each depth."""
    w = Window.partitionBy("doc_id", "depth").orderBy("pos")
    return tree.where("kind = 'step' and rendered").select("doc_id", "section_no", "seq", "depth", number_style(computational).alias("number_style"), F.row_number().over(w).alias("ordinal"))


def overview(paras: DataFrame) -> DataFrame:
    """doc_id, overview: prose over 20 characters of the overview (or of what precedes every role), else the first over 40 before any list item.

    One aggregation over the window's own exchange."""
    size = F.length("raw_text")
    said = (F.col("heading_level") == 0) & ~F.col("is_list") & (size > 20)
    # stopping points are sought among the paragraphs that may be said, once each
    rows = _with_segment(paras).withColumn("said", F.when(said, ~classify.is_stopping_point(F.col("raw_text"))).otherwise(False))
    joined = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said") & (F.col("segment") == part), F.struct("pos", "text")))), lambda x: x["text"]), "\n\n")
    has = F.bool_or((F.col("segment") == "overview") & (F.col("heading_level") != 1))
    early = F.when(F.col("said") & (F.length("raw_text") > 40), F.col("pos"))
    first_item = F.min(F.when(F.col("is_list"), F.col("pos")))
    found = rows.groupBy("doc_id").agg(F.when(has, joined("overview")).otherwise(joined("pre_overview")).alias("main"), F.min_by("text", early).alias("second"), F.min(early).alias("at"), first_item.alias("first_item"))
    trimmed = F.regexp_replace("main", r"^\s+|\s+$", "")
    second = F.when(F.col("first_item").isNull() | (F.col("at") < F.col("first_item")), F.col("second"))
    return found.select("doc_id", F.coalesce(F.when(F.length(trimmed) > 0, trimmed), second, F.lit("")).alias("overview"))


def prerequisites(segmented: DataFrame) -> DataFrame:
    """doc_id, software, access, dependencies: the last paragraph of the segment with each label, without the label."""
    rows = segmented.where("segment = 'prerequisites'")
    fields = {"software": "software", "access": "access", "dependencies": r"depend\w*"}
    starts = {"software": "software", "access": "access", "dependencies": "depend"}
    found = {}
    for name, label in fields.items():
        has = F.startswith(F.lower("raw_text"), F.lit(starts[name]))
        found[name] = F.max_by(F.when(has, F.regexp_replace("raw_text", rf"(?i)^{label}[:\s]+", "")), F.when(has, F.col("pos"))).alias(name)
    return rows.groupBy("doc_id").agg(*found.values())


def notes(segmented: DataFrame, footnotes: DataFrame | None = None) -> DataFrame:
    """doc_id, number, note: the notes segment in order, then footnotes (doc_id, id, text) by id; numbered from 1."""
    own = segmented.where("segment = 'notes' and (is_list or (heading_level = 0 and length(raw_text) > 0))").select("doc_id", F.lit(0).alias("part"), F.col("pos").alias("at"), F.col("text").alias("note"))
    if footnotes is not None:
        own = own.unionByName(footnotes.where("id > 0").select("doc_id", F.lit(1).alias("part"), F.col("id").alias("at"), F.col("text").alias("note")))
    w = Window.partitionBy("doc_id").orderBy("part", "at")
    return own.select("doc_id", F.row_number().over(w).alias("number"), "note")


def references(segmented: DataFrame) -> DataFrame:
    rows = segmented.where("segment = 'references' and heading_level = 0 and length(raw_text) > 0")
    return rows.select("doc_id", F.row_number().over(by_document()).alias("number"), F.col("text").alias("reference"))
