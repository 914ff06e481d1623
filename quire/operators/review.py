"""Review of records: many edits a record, folded in their order, each applied only if the record still keeps every rule.

All of it is one expression a record: the edits of a document become an array, and `aggregate` carries the record through it. An edit's path
(`procedure[0].steps[2].text`, places from 0) is walked down the declared schema; the value is read as JSON, or is a text if it isn't JSON, and must be of the type that the
schema declares there. The candidate is checked by all rules that a change of the path's first field can break (records.broken_rules_at), and if it breaks one the record stays as it was. No Python worker.

Edits of one record depend on each other, so they are one row's work, in memory of their own size; records are independent. A record that breaks rules before any edit takes the
edits that leave it without a broken rule, or with the broken rules it had, less some.

Defined cases: an edit without a doc_id or for a document that isn't there is in no result (`unknown` gives those); edits with the same number are by path, then value; a null path is an empty one,
which leads nowhere; a null value sets null; a null record takes no edit; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from quire.functions import text
from quire.sources import records, rules

RESULTS = "array<struct<n: bigint, path: string, accepted: boolean, reason: string>>"


def _kind() -> StructType:
    return StructType.fromDDL(records.RECORD)


def steps_of(path: Column) -> Column:
    """The steps of a path: names, and places in brackets; null if there is more in it than those."""
    steps = F.regexp_extract_all(path, F.lit(r"([^.\[\]]+|\[\d+\])"), F.lit(1))
    whole = F.rlike(path, F.lit(r"^[^.\[\]]+(?:\[\d+\])*(?:\.[^.\[\]]+(?:\[\d+\])*)*$"))
    return F.when(whole, steps)


def _places(kind: DataType, at: str = "") -> dict[DataType, list[str]]:
    """Types, and the places of each in the declared schema (`procedure[].steps[].text`)."""
    out: dict[DataType, list[str]] = {}
    inner = [(f.dataType, f"{at}.{f.name}" if at else f.name) for f in kind] if isinstance(kind, StructType) else [(kind.elementType, f"{at}[]")] if isinstance(kind, ArrayType) else []
    for below, place in inner:
        out.setdefault(below, []).append(place)
        for deeper, more in _places(below, place).items():
            out.setdefault(deeper, []).extend(more)
    return out


def _variant(value: Column) -> Column:
    return F.coalesce(F.try_parse_json(value), value.cast("variant"))


def _read(edits: DataFrame) -> DataFrame:
    """Edits with what can be said without their records: the path's steps and the places among them, its top field, and whether the value isn't of the type that the schema declares at the path."""
    path, steps = F.coalesce("path", F.lit("")), F.col("steps")
    place = lambda s: F.when(F.startswith(s, F.lit("[")), F.substring(s, F.lit(2), F.length(s) - 2).try_cast("int"))
    out = edits.select("doc_id", F.col("n").cast("long").alias("n"), path.alias("path"), F.col("value").cast("string").alias("value"))
    out = out.select("*", steps_of(F.col("path")).alias("steps"), F.regexp_replace("path", r"\[\d+\]", "[]").alias("at"), _variant(F.col("value")).alias("new"))
    wrong = F.when(steps.isNull(), False)
    for kind, places in _places(_kind()).items():
        wrong = wrong.when(F.col("at").isin(*places), F.size(rules.mistyped(kind, F.col("new"), "value", F.lit(""))) > 0)
    return out.select("doc_id", "n", "path", "value", "steps", F.transform(steps, place).alias("places"), F.get(steps, F.lit(0)).alias("field"), wrong.otherwise(False).alias("mistyped"))


def problem(kind: DataType, value: Column, edit: Column, k: int = 0) -> Column:
    """Why an edit's steps from the k-th on lead nowhere in a value, or why its new value can't stand there; null if all is well."""
    step, place = F.get(edit["steps"], F.lit(k)), F.get(edit["places"], F.lit(k))
    wrong = F.concat(F.lit("wrong container at "), step)
    if isinstance(kind, StructType):
        inner = F.when(F.startswith(step, F.lit("[")) | value.isNull(), wrong)
        for f in kind:
            inner = inner.when(step == f.name, problem(f.dataType, value[f.name], edit, k + 1))
        inner = inner.otherwise(F.concat(F.lit("no field "), step))
    elif isinstance(kind, ArrayType):
        inner = (
            F.when(~F.startswith(step, F.lit("[")) | value.isNull(), wrong)
            .when(F.coalesce(place >= F.size(value), F.lit(True)), F.concat(F.lit("out of range: "), step))
            .otherwise(problem(kind.elementType, F.get(value, place), edit, k + 1))
        )
    else:
        inner = wrong
    # a path has a step at least
    return inner if k == 0 else F.when(F.size(edit["steps"]) == k, F.when(edit["mistyped"], "wrong type")).otherwise(inner)


def changed(kind: DataType, value: Column, edit: Column, k: int = 0) -> Column:
    """The value with an edit's new one at its steps from the k-th on, which lead somewhere."""
    step, place = F.get(edit["steps"], F.lit(k)), F.get(edit["places"], F.lit(k))
    if isinstance(kind, StructType):
        have = {f.name: value[f.name].alias(f.name) for f in kind}
        inner = F.lit(None)
        for f in reversed(kind.fields):
            inner = F.when(step == f.name, F.struct(*(have | {f.name: changed(f.dataType, value[f.name], edit, k + 1).alias(f.name)}).values())).otherwise(inner)
    elif isinstance(kind, ArrayType):
        inner = F.transform(value, lambda x, i: F.when(i == place, changed(kind.elementType, x, edit, k + 1)).otherwise(x))
    else:
        inner = value
    return inner.cast(kind) if k == 0 else F.when(F.size(edit["steps"]) == k, F.try_variant_get(edit["new"], "$", kind.simpleString())).otherwise(inner).cast(kind)


def _fold(record: Column, edits: Column) -> Column:
    """struct<record, results> of a record and its edits in order."""
    whole = _kind()
    state = f"struct<record: {whole.simpleString()}, results: {RESULTS}>"
    begin = F.struct(record.alias("record"), F.expr("array()").cast(RESULTS).alias("results")).cast(state)

    def step(have: Column, edit: Column) -> Column:
        old = have["record"]

        def tried(problem: Column) -> Column:
            return text.once(F.struct(problem.alias("problem"), F.when(problem.isNull(), changed(whole, old, edit)).alias("candidate")), checked)

        def checked(x: Column) -> Column:
            # only the field that the path begins with has changed: other rules are broken as before. Few candidates break any; what both records break is listed for those alone
            said = F.when(records.breaks_rules_at(x["candidate"], edit["field"]), text.once(F.transform(F.array(x["candidate"], old), lambda r: records.broken_rules_at(r, edit["field"])), more))
            return text.once(F.coalesce(x["problem"], said), lambda reason: ended(x["candidate"], reason))

        def more(both: Column) -> Column:
            rolled = F.filter(F.get(both, F.lit(0)), lambda v: ~F.array_contains(F.get(both, F.lit(1)), v))
            return text.once(F.array_join(F.transform(rolled, lambda v: F.concat_ws(" ", v["rule"], v["path"])), "; "), lambda t: F.when(t != "", t))

        def ended(candidate: Column, reason: Column) -> Column:
            fine = reason.isNull()
            result = F.struct(edit["n"].alias("n"), edit["path"].alias("path"), fine.alias("accepted"), reason.alias("reason"))
            return F.struct(F.when(fine, candidate).otherwise(old).alias("record"), F.concat(have["results"], F.array(result)).alias("results")).cast(state)

        known = (F.size(edit["steps"]) == 1) & edit["field"].isin(*whole.names)
        where = F.when(old.isNull(), "no record").when(edit["steps"].isNull(), "malformed path").when(known, F.when(edit["mistyped"], "wrong type"))
        return text.once(where.otherwise(problem(whole, old, edit)), tried)

    parsed = F.transform(edits, lambda e: F.struct(*(e[c].alias(c) for c in ("n", "path", "steps", "places", "field", "mistyped")), _variant(e["value"]).alias("new")))
    return F.aggregate(parsed, begin, step)


def folded(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, record and (doc_id, n, path, value) -> doc_id, record, results (n, path, accepted, reason of each edit, in order)."""
    # rows of one document meet first and are read then: what is read isn't sent. Edits of the same number, path and value are alike in the rest
    read = _read(edits.where("doc_id is not null").repartition("doc_id"))
    listed = read.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*read.columns[1:]))).alias("edits"))
    out = rows.select("doc_id", F.col("record").cast(_kind()).alias("record")).join(listed, "doc_id", "left")
    fold = F.when(F.col("edits").isNull(), F.struct("record", F.expr("array()").cast(RESULTS).alias("results"))).otherwise(_fold(F.col("record"), F.col("edits")))
    # rows of a generator: a filter on the results (an explode of them brings two) isn't pushed below, where it would fold again
    return out.select("doc_id", F.inline(F.array(fold)))


def outcomes(reviewed: DataFrame) -> DataFrame:
    """doc_id, n, path, accepted, reason: a row an edit."""
    return reviewed.select("doc_id", F.explode("results").alias("e")).select("doc_id", "e.n", "e.path", "e.accepted", "e.reason")


def unknown(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits that no record takes: of documents that aren't there, or without a doc_id."""
    return edits.join(rows.select("doc_id"), "doc_id", "left_anti")
