"""Records as JSON: their declared schema, reading, and checks of what is read. Unknown fields are ignored; mistyped ones become violations."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

from quire.functions import classify, text
from quire.sources import rules
from quire.sources.rules import Rule

_ROWS = "array<struct<heading: string, rows: array<struct<cells: array<string>, bold: boolean>>>>"
RECORD = (
    "title string, subtitle string, author string, section_type string, section_number string, section_name string, version string, date string, overview string,"
    f" materials {_ROWS}, prerequisites struct<software: string, access: string, dependencies: string>,"
    " procedure array<struct<section_no: bigint, heading: string, preamble: string, steps: array<struct<seq: int, depth: int, parent_seq: int, step_type: string, text: string, code: string, code_language: string>>,"
    " callouts: array<struct<callout_type: string, text: string, after_step: bigint>>>>,"
    f" notes array<string>, references array<string>, mix_tables {_ROWS}, source_filename string"
)
#: The same as a completion service may write it: numbers as text, rows as they come.
LOOSE = RECORD.replace("after_step: bigint", "after_step: string")
REQUIRED = ("title", "section_type", "section_number", "section_name", "overview", "procedure")
CALLOUTS = ("critical", "caution", "tip", "note")
STEPS = ("action", "stopping_point")
#: The constraints of a record, by place.
RULES = (
    *(Rule(c, f"{c}_missing", "required") for c in REQUIRED),
    Rule("title", "title_empty", "filled_if_any"),
    Rule("section_type", "type_unknown", "one_of_if_any", ("wet_lab", "computational")),
    Rule("date", "date_invalid", "date_if_any"),
    Rule("prerequisites", "prerequisites_in_wet_lab", "none_where", ("section_type", "wet_lab", "one")),
    Rule("materials", "materials_in_computational", "none_where", ("section_type", "computational", "list")),
    Rule("mix_tables", "mixes_in_computational", "none_where", ("section_type", "computational", "list")),
    Rule("procedure", "procedure_empty", "some_if_any"),
    Rule("materials[].rows", "rows_empty", "some"),
    Rule("materials[].rows[].cells", "materials_width", "wide", 3),
    Rule("mix_tables[].rows", "rows_empty", "some"),
    Rule("mix_tables[].rows[].cells", "mix_width", "wide", 2),
    Rule("procedure[].heading", "heading_empty", "filled"),
    Rule("procedure[].steps[].text", "step_text_empty", "filled"),
    Rule("procedure[].steps[].step_type", "step_type_unknown", "one_of", STEPS),
    Rule("procedure[].callouts[].text", "callout_text_empty", "filled"),
    Rule("procedure[].callouts[].callout_type", "callout_type_unknown", "one_of", CALLOUTS),
    Rule("procedure[].callouts[].after_step", "after_step_range", "top_step_if_any"),
)


def _json_schema(kind: DataType) -> dict:
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: _json_schema(f.dataType) for f in kind}}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": _json_schema(kind.elementType)}
    name = {StringType: "string", BooleanType: "boolean"}.get(type(kind), "integer")
    return {"anyOf": [{"type": name}, {"type": "null"}]}


def schema_json() -> str:
    """The record's schema as a JSON Schema document."""
    fixed = {"section_type": {"enum": ["wet_lab", "computational"]}}
    whole = _json_schema(StructType.fromDDL(RECORD))
    whole["properties"] |= fixed
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "record", "required": list(REQUIRED), **whole}, indent=1)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file's path), json, record: a record for each JSON file; record is null where the text is no JSON object."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("json"), F.from_json("value", RECORD).alias("record"))


def post_processed(content: Column, default_author: str = "Unattributed", version: str = "1.0") -> Column:
    """The record in a loose JSON text, with defaults, dates as DD/MM/YYYY (null where none is found), the type in lower case, callouts without their
    labels, after_step as a number or null, and rows of three and two cells; rows of a mix that begin with a total or an incubation are bold. Null where the text is no JSON object."""
    def made_of(r: Column) -> Column:
        none = lambda name: F.expr("array()").cast(StructType.fromDDL(RECORD)[name].dataType)
        filled = lambda c, default: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c).otherwise(default)
        dated = F.when(F.rlike(r["date"], F.lit(r"^\d{2}/\d{2}/\d{4}$")), r["date"]).otherwise(text.normalize_date(r["date"]))
        step_number = lambda c: F.when(F.rlike(c, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(c).try_cast("long"))
        callout = lambda c: F.struct(c["callout_type"].alias("callout_type"), text.strip_callout_prefix(text.normalize_whitespace(c["text"])).alias("text"), step_number(c["after_step"]).alias("after_step"))
        section = lambda s: F.struct(*(s[c].alias(c) for c in ("section_no", "heading", "preamble", "steps")), F.transform(s["callouts"], callout).alias("callouts"))

        def tables(name: str, width: int, mixes: bool) -> Column:
            bold = lambda row: F.coalesce(row["bold"], F.lit(False)) | (F.coalesce(classify.is_bold_row(F.get(row["cells"], F.lit(0))), F.lit(False)) if mixes else F.lit(False))
            row = lambda x: F.struct(text.pad_cells(x["cells"], width).alias("cells"), bold(x).alias("bold"))
            return F.coalesce(F.transform(r[name], lambda t: F.struct(t["heading"].alias("heading"), F.transform(t["rows"], row).alias("rows"))), none(name)).alias(name)

        made = F.struct(
            r["title"].alias("title"), r["subtitle"].alias("subtitle"), filled(r["author"], default_author).alias("author"),
            F.when(F.length(text.strip(F.coalesce(r["section_type"], F.lit("")))) > 0, F.lower(text.strip(r["section_type"]))).otherwise("wet_lab").alias("section_type"),
            r["section_number"].alias("section_number"), r["section_name"].alias("section_name"), filled(r["version"], version).alias("version"), dated.alias("date"), r["overview"].alias("overview"),
            tables("materials", 3, False), r["prerequisites"].alias("prerequisites"), F.transform(r["procedure"], section).alias("procedure"),
            F.coalesce(r["notes"], none("notes")).alias("notes"), F.coalesce(r["references"], none("references")).alias("references"), tables("mix_tables", 2, True), r["source_filename"].alias("source_filename"),
        )
        return F.when(r.isNotNull(), made.cast(StructType.fromDDL(RECORD)))

    return text.once(F.from_json(content, LOOSE), made_of)


def counts(records: DataFrame, *more: Column) -> DataFrame:
    """doc_id, columns that are wanted with it, and the record's sections, steps, callouts, notes, references, materials tables and mix tables."""
    r = F.col("record")
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    inner = lambda name: size(F.flatten(F.transform(r["procedure"], lambda s: F.coalesce(s[name], F.expr("array()").cast(StructType.fromDDL(RECORD)["procedure"].dataType.elementType[name].dataType)))))
    plain = {"n_sections": "procedure", "n_notes": "notes", "n_references": "references", "n_materials": "materials", "n_mixes": "mix_tables"}
    return records.select("doc_id", *more, *(size(r[c]).alias(n) for n, c in plain.items()), inner("steps").alias("n_steps"), inner("callouts").alias("n_callouts"))


def violations(records: DataFrame) -> DataFrame:
    """doc_id, json, record -> doc_id, rule, path: a row for each rule that a record breaks, with the full path of what breaks it (none for the record as a whole)."""
    return records.select("doc_id", F.explode(text.once(F.struct(F.col("record").alias("r"), F.try_parse_json("json").alias("raw")), lambda x: broken(x["r"], x["raw"]))).alias("v")).select("doc_id", "v.rule", "v.path")


def unlike_types(raw: Column) -> Column:
    """Violations of a record's fields, required or not, whose values in the variant aren't of the declared types. Most records are told to be right by one look at their schema, and most fields of the others."""
    whole = StructType.fromDDL(RECORD)
    each = F.concat(*(text.once(F.try_variant_get(raw, f"$.{f.name}", "variant"), lambda v, f=f: rules.mistyped_field(f.dataType, v, f.name, f.name in REQUIRED)) for f in whole))
    right = F.rlike(F.schema_of_variant(raw), F.lit(f"^{rules.of_type(whole, REQUIRED)}$"))
    return F.when(right, F.expr("array()").cast(rules.VIOLATIONS)).otherwise(each)


def broken_rules(r: Column) -> Column:
    """array<struct<rule, path>> of a record of the declared type: the rules of RULES that it breaks, in their order by field."""
    none = F.expr("array()").cast(rules.VIOLATIONS)
    return F.concat(*(F.coalesce(p, none) for p in rules.walk(StructType.fromDDL(RECORD), r, RULES)))


def _by_field(field: Column, of: Callable[[tuple[Rule, ...]], Column], none: Column) -> Column:
    """What is made of the rules that a change of the named top field can break."""
    out = F.when(field.isNull(), none)
    for f in StructType.fromDDL(RECORD):
        if near := rules.near(f.name, RULES):
            out = out.when(field == f.name, of(near))
    return out.otherwise(none)


def broken_rules_at(r: Column, field: Column) -> Column:
    """As broken_rules, but only the rules that a change of the named top field can break."""
    none = F.expr("array()").cast(rules.VIOLATIONS)
    return _by_field(field, lambda near: F.concat(*(F.coalesce(p, none) for p in rules.walk(StructType.fromDDL(RECORD), r, near))), none)


def breaks_rules_at(r: Column, field: Column) -> Column:
    """Whether broken_rules_at has any; false for a null record. Cheaper than the list."""
    return r.isNotNull() & _by_field(field, lambda near: rules.breaks(StructType.fromDDL(RECORD), r, near), F.lit(False))


def broken(r: Column, raw: Column) -> Column:
    """array<struct<rule, path>> of a record and the variant that it was read from. A value of a wrong type is said once, not as missing too."""
    not_json = F.array(rules.made("not_json", F.lit("")))
    wrong = unlike_types(raw)
    both = text.once(F.struct(wrong.alias("wrong"), broken_rules(r).alias("rules")), lambda x: F.concat(x["wrong"], F.filter(x["rules"], lambda v: ~(F.endswith(v["rule"], F.lit("_missing")) & F.exists(x["wrong"], lambda w: w["path"] == v["path"])))))
    return F.when(r.isNull() | raw.isNull(), not_json).otherwise(both)
