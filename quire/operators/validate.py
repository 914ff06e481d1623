"""Post-processing of loose records and their violations, as rows; nothing throws for a bad record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

TYPES = ("wet_lab", "computational")


def post_process(p: DataFrame, default_author: str = "Unattributed") -> DataFrame:
    """Defaults, lower-cased type, DD/MM/YYYY dates (null where none is recognised), after_step as an integer or null."""
    kind = F.when(F.length(F.coalesce("section_type", F.lit(""))) > 0, F.lower(text.strip(F.col("section_type")))).otherwise("wet_lab")
    dated = F.when(F.rlike("date_raw", F.lit(r"^\d{2}/\d{2}/\d{4}$")), F.col("date_raw")).otherwise(text.normalize_date(F.col("date_raw")))
    who = F.when(F.length(F.coalesce("author_raw", F.lit(""))) > 0, F.col("author_raw")).otherwise(default_author)
    step = F.when(F.rlike("after_step_raw", F.lit(r"^\s*[+-]?\d+\s*$")), F.trim("after_step_raw").try_cast("int"))
    return p.withColumns({"section_type": kind, "date": dated, "author": who, "after_step": step}).drop("date_raw", "author_raw", "after_step_raw")


def violations(p: DataFrame) -> DataFrame:
    """payload_id, rule, detail: a row for each rule that a post-processed record breaks."""
    computational = F.col("section_type") == "computational"
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    rules: list[tuple[str, Column, Column]] = [
        ("title_empty", F.length(F.coalesce("title", F.lit(""))) == 0, F.lit("")),
        ("type_unknown", ~F.col("section_type").isin(*TYPES), word("section_type")),
        ("date_invalid", F.col("date").isNotNull() & ~text.valid_date(F.col("date")), word("date")),
        ("prerequisites_in_wet_lab", (F.col("section_type") == "wet_lab") & F.col("has_prereq"), F.lit("")),
        ("materials_in_computational", computational & (F.col("n_materials") > 0), word("n_materials")),
        ("mixes_in_computational", computational & (F.col("n_mix") > 0), word("n_mix")),
        ("procedure_empty", F.col("n_sections") < 1, F.lit("")),
        ("materials_width", (F.col("n_materials") > 0) & (F.col("n_cells") != 3), word("n_cells")),
        ("mix_width", (F.col("n_mix") > 0) & (F.col("n_cells") != 2), word("n_cells")),
        ("after_step_range", F.col("after_step").isNotNull() & ((F.col("after_step") < 0) | (F.col("after_step") >= F.col("n_steps"))), word("after_step")),
    ]
    found = F.filter(F.array(*(F.struct(F.lit(name).alias("rule"), detail.alias("detail"), bad.alias("bad")) for name, bad, detail in rules)), lambda r: r["bad"])
    return p.select("payload_id", F.explode(found).alias("v")).select("payload_id", "v.rule", "v.detail")


def first_render_error(p: DataFrame) -> DataFrame:
    """payload_id, error: the first rule that the renderer would report, in its order; null if none."""
    missing = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) == 0
    error = (
        F.when(missing("title"), "title")
        .when(missing("section_type"), "section_type")
        .when(~F.col("section_type").isin(*TYPES), "section_type")
        .when(F.col("n_sections") < 1, "procedure")
        .when((F.col("section_type") == "wet_lab") & F.col("has_prereq"), "prerequisites")
        .when((F.col("section_type") == "computational") & ((F.col("n_materials") > 0) | (F.col("n_mix") > 0)), "materials")
    )
    return p.select("payload_id", error.alias("error"))
