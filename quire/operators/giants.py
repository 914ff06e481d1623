"""Segments, procedure sections, nesting and numbers of giant documents, in two levels: no task holds a whole document.

The windows of `segment` hold a document each. Here a document's rows are parted into blocks of `block` positions, and each quantity is a scan in three steps: its
running value within a block, a carry for each block from the summaries of the blocks before it, and both put together. Only summaries (a row or a few a block) meet by document.

Carries and how they compose: the last role and the last heading (the later one that is set); numbers of headings, steps and rows (sums);
prose and steps since the last heading (sums, begun anew by a block with a heading); nesting, where a step hangs at its list level but at most one below
the step before it, as a min-plus map: a block of n steps turns the depth d before it into min(d + n, m), so blocks compose by sums of n and minima of m less the steps before;
the last step at each depth (the later one).

A block is a range of positions, so it holds `block` rows at most. `by_size` sends documents of more than `most` rows here and the others to the windows; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quire.functions import classify
from quire.operators.segment import number_style
from quire.sources.shared import written

BLOCK = 1 << 14
#: Rows of a document above which it is a giant.
GIANT = 1 << 17


def by_size(rows: DataFrame, one: Callable[[DataFrame], DataFrame], two: Callable[[DataFrame], DataFrame], most: int = GIANT) -> DataFrame:
    """one(the rows of documents of up to `most` rows) and two(the others'). `rows` is a table that can be read again; giants are few: their number is at most its rows by `most`."""
    giants = written(rows.groupBy("doc_id").count().where(F.col("count") > most).select("doc_id"), "giants")
    if giants.isEmpty():
        return one(rows)
    here = F.broadcast(giants)
    return one(rows.join(here, "doc_id", "left_anti")).unionByName(two(rows.join(here, "doc_id", "left_semi")))


def blocked(rows: DataFrame, block: int, *key: str) -> DataFrame:
    """The rows with their block, exchanged by key and block."""
    return rows.withColumn("block", F.floor(F.col("pos") / block)).repartition("doc_id", *key, "block")


def _within(*key: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *key, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def _before(*key: str) -> WindowSpec:
    return Window.partitionBy("doc_id", *key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def segments(paras: DataFrame, block: int = BLOCK) -> DataFrame:
    """As segment.segments."""
    rows = blocked(paras.withColumn("role", F.when(F.col("heading_level") == 1, classify.role(F.col("raw_text")))), block)
    last = rows.groupBy("doc_id", "block").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("pos"))).alias("last"))
    carry = last.select("doc_id", "block", F.last("last", True).over(_before()).alias("carry"))
    out = rows.withColumn("role", F.last("role", True).over(_within())).join(carry, ["doc_id", "block"])
    out = out.withColumn("segment", F.coalesce("role", "carry", F.lit("pre_overview"))).drop("role", "carry", "block").where("heading_level <> 1")
    return out.withColumn("class", classify.paragraph_class(F.col("raw_text"), F.col("is_list")))


def procedure(segmented: DataFrame, block: int = BLOCK) -> DataFrame:
    """As segment.procedure."""
    rows = blocked(segmented.where("segment = 'procedure'"), block)
    second, plain = F.col("heading_level") == 2, F.col("heading_level") == 0
    prose = plain & (F.col("class") == "prose")
    step = plain & F.col("class").isin("step", "stopping_point")
    rows = rows.withColumn("own_no", F.sum(second.cast("int")).over(_within()))
    rows = rows.withColumns({
        "own_heading": F.last(F.when(second, F.col("raw_text")), True).over(_within()),
        "proses": F.sum(prose.cast("int")).over(_within("own_no")),
        "steps": F.sum(step.cast("int")).over(_within("own_no")),
    })
    parts = rows.groupBy("doc_id", "block", "own_no").agg(F.first("own_heading", True).alias("own_heading"), F.max("proses").alias("proses"), F.max("steps").alias("steps"))
    ends = parts.groupBy("doc_id", "block").agg(F.max("own_no").alias("n"), *(F.max_by(c, "own_no").alias(c) for c in ("own_heading", "proses", "steps")))
    upto = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("stretch", F.sum((F.col("n") > 0).cast("int")).over(upto))
    since = Window.partitionBy("doc_id", "stretch").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({"proses": F.sum("proses").over(since), "steps": F.sum("steps").over(since)})
    beside = Window.partitionBy("doc_id").orderBy("block")
    carry = ends.select("doc_id", "block", _zero(F.sum("n").over(_before())).alias("no_before"), F.last("own_heading", True).over(_before()).alias("heading_before"), *(_zero(F.lag(c).over(beside)).alias(f"{c}_before") for c in ("proses", "steps")))
    out = rows.join(carry, ["doc_id", "block"]).where(plain)
    open_ = F.col("own_no") == 0
    out = out.withColumns({
        "section_no": F.col("no_before") + F.col("own_no"),
        "heading": F.coalesce("own_heading", "heading_before", F.lit("Procedure")),
        "proses": F.col("proses") + F.when(open_, F.col("proses_before")).otherwise(0),
        "steps": F.col("steps") + F.when(open_, F.col("steps_before")).otherwise(0),
    })
    is_prose = F.col("class") == "prose"
    kind = F.when(F.startswith("class", F.lit("callout_")), "callout").when(is_prose & (F.col("proses") == 1) & (F.col("steps") == 0), "preamble").when(is_prose, "step").otherwise(F.col("class"))
    out = written(out.withColumn("kind", kind).select(*segmented.columns, "section_no", "heading", "kind"), "sections")
    # a section without step or callout is its preamble alone, which is one row
    alone = out.groupBy("doc_id", "section_no").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("pos").alias("pos")).where("n = 1 and kind = 'preamble'")
    return out.join(alone.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")


def step_tree(sections: DataFrame, block: int = BLOCK) -> DataFrame:
    """As segment.step_tree."""
    columns = sections.columns
    key = ["doc_id", "section_no", "block"]
    rows = blocked(sections.where("kind in ('step', 'stopping_point')"), block, "section_no")
    at = F.when(F.col("class") == "step", F.greatest(F.col("list_level") - 1, F.lit(0))).otherwise(0)
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy(*key).orderBy("pos")) - 1)
    rows = rows.withColumn("slack", F.min(at - F.col("own")).over(_within("section_no")))
    ends = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min("slack").alias("slack"))
    ends = ends.withColumn("before", _zero(F.sum("n").over(_before("section_no"))))
    carry = ends.select(*key, "before", F.min(F.col("slack") - F.col("before")).over(_before("section_no")).alias("bound"))
    seq = F.col("before") + F.col("own")
    # nothing hangs deeper than 0 at a section's first step
    depth = seq + F.least(F.lit(0), F.coalesce("bound", F.lit(0)), F.col("slack") - F.col("before"))
    rows = written(rows.join(carry, key).select(*columns, "block", seq.cast("int").alias("seq"), depth.cast("int").alias("depth")), "depths")

    rows = rows.repartition(*key)
    root = F.when(F.col("depth") == 0, F.col("kind"))
    roots = rows.groupBy(*key).agg(F.max_by("kind", F.when(F.col("depth") == 0, F.col("pos"))).alias("root"))
    roots = roots.select(*key, F.last("root", True).over(_before("section_no")).alias("root_before"))
    # each step stands once for itself, where it looks for a parent, and once, a level down, for its children
    twice = rows.withColumn("root", F.last(root, True).over(_within("section_no"))).withColumn("as", F.explode(F.array(F.struct(F.col("depth").alias("level"), F.lit(None).cast("int").alias("above")), F.struct((F.col("depth") + 1).alias("level"), F.col("seq").alias("above")))))
    twice = twice.select("*", "as.level", "as.above").drop("as")
    beside = Window.partitionBy(*key, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lasts = twice.groupBy(*key, "level").agg(F.max("above").alias("above"))
    lasts = lasts.select(*key, "level", F.last("above", True).over(_before("section_no", "level")).alias("above"))
    spines = lasts.where("above is not null").groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("level", "above"))).alias("spine"))
    out = twice.withColumn("parent", F.last("above", True).over(beside)).where("above is null").join(roots, key).join(spines, key, "left")
    under_stop = (F.col("depth") > 0) & (F.coalesce("root", "root_before") == "stopping_point")
    parent = F.coalesce("parent", F.when(F.col("depth") > 0, F.try_element_at("spine", F.col("level"))))
    return out.select(*columns, "seq", "depth", (~under_stop).alias("rendered"), parent.cast("int").alias("parent_seq"))


def numbers(rows: DataFrame, name: str, *key: str, block: int = BLOCK) -> DataFrame:
    """The rows with their number (from 1) by position within doc_id and the key."""
    rows = blocked(rows, block, *key)
    own = F.row_number().over(Window.partitionBy("doc_id", *key, "block").orderBy("pos"))
    carry = rows.groupBy("doc_id", *key, "block").count().select("doc_id", *key, "block", _zero(F.sum("count").over(_before(*key))).alias("before"))
    return rows.withColumn(name, own).join(carry, ["doc_id", *key, "block"]).withColumn(name, (F.col(name) + F.col("before")).cast("int")).drop("before", "block")


def step_numbers(tree: DataFrame, block: int = BLOCK, computational: Column | None = None) -> DataFrame:
    """As segment.step_numbers."""
    shown = tree.where("kind = 'step' and rendered").select("doc_id", "pos", "section_no", "seq", "depth", number_style(computational).alias("number_style"))
    return numbers(shown, "ordinal", "depth", block=block).drop("pos")


def references(segmented: DataFrame, block: int = BLOCK) -> DataFrame:
    """As segment.references."""
    rows = segmented.where("segment = 'references' and heading_level = 0 and length(raw_text) > 0")
    return numbers(rows.select("doc_id", "pos", F.col("text").alias("reference")), "number", block=block).select("doc_id", "number", "reference")
