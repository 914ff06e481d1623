"""The constraints of records as data, and walks over the declared schema that apply them at any depth.

A rule names a place in the schema (`materials[].rows[].cells`), a check and its argument. walk() builds one expression from the schema's types: fields are descended
into where a rule lies below them, arrays by transform with the element's index, so a violation carries its full path (`materials[1].rows[3].cells`). mistyped() walks a
variant beside the declared types in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructType

from quire.functions import text

VIOLATIONS = "array<struct<rule: string, path: string>>"


@dataclass(frozen=True)
class Rule:
    path: str
    name: str
    check: str
    argument: object = None


def _blank(c: Column) -> Column:
    return ~F.rlike(F.coalesce(c, F.lit("")), F.lit(r"(?U)\S"))


def _steps_on_top(section: Column) -> Column:
    return F.size(F.filter(section["steps"], lambda x: F.coalesce(x["depth"], F.lit(0)) == 0))


#: What makes a value bad: of (the value, the structs around it from the outermost on, the rule's argument).
CHECKS: dict[str, Callable[[Column, list[Column], object], Column]] = {
    "required": lambda c, up, _: c.isNull(),
    "filled": lambda c, up, _: _blank(c),
    "filled_if_any": lambda c, up, _: c.isNotNull() & _blank(c),
    "one_of": lambda c, up, of: ~F.coalesce(c, F.lit("")).isin(*of),
    "one_of_if_any": lambda c, up, of: ~c.isin(*of),
    "date_if_any": lambda c, up, _: c.isNotNull() & ~text.valid_date(c),
    "some": lambda c, up, _: c.isNull() | (F.size(c) == 0),
    "some_if_any": lambda c, up, _: F.size(c) == 0,
    "wide": lambda c, up, n: F.coalesce(F.size(c), F.lit(-1)) != n,
    "none_where": lambda c, up, other: (up[0][other[0]] == other[1]) & (F.size(c) > 0 if other[2] == "list" else c.isNotNull()),
    "top_step_if_any": lambda c, up, _: c.isNotNull() & ((c < 0) | (c >= _steps_on_top(up[-2]))),
}
#: The checks that look at another top field, the first of their argument. All others stay within the top field that their place is in.
OUTWARD = ("none_where",)


def made(name: str, path: Column) -> Column:
    return F.struct(F.lit(name).alias("rule"), path.alias("path"))


def _under(path: str, rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    return tuple(r for r in rules if r.path == path or r.path.startswith((f"{path}.", f"{path}[]")))


def near(field: str, rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules that a change of a top field can break: those at or below it, and those of other places that look at it."""
    return tuple(r for r in rules if r in _under(field, rules) or (r.check in OUTWARD and r.argument[0] == field))


def walk(kind: DataType, value: Column, rules: tuple[Rule, ...], at: str = "", path: Column | None = None, up: tuple[Column, ...] = ()) -> list[Column]:
    """Arrays of violations (null for none) of a value of a declared type, at a place of the schema and under a path."""
    none = F.expr("array()").cast(VIOLATIONS)
    said = path if path is not None else F.lit("")
    out = [F.when(F.coalesce(CHECKS[r.check](value, list(up), r.argument), F.lit(False)), F.array(made(r.name, said))) for r in rules if r.path == at]
    if isinstance(kind, StructType):
        for f in kind:
            place = f"{at}.{f.name}" if at else f.name
            if below := _under(place, rules):
                out += walk(f.dataType, value[f.name], below, place, F.concat(said, F.lit(f".{f.name}")) if at else F.lit(f.name), (*up, value))
    elif isinstance(kind, ArrayType) and (below := tuple(r for r in rules if r.path.startswith(f"{at}[]"))):

        def element(x: Column, i: Column) -> Column:
            parts = walk(kind.elementType, x, below, f"{at}[]", F.concat(said, F.lit("["), i.cast("string"), F.lit("]")), up)
            return F.concat(*(F.coalesce(p, none) for p in parts))

        out.append(F.flatten(F.transform(value, element)))
    return out


def breaks(kind: DataType, value: Column, rules: tuple[Rule, ...], at: str = "", up: tuple[Column, ...] = ()) -> Column:
    """Whether walk() finds any violation. Conditions alone: no paths and no lists."""
    out = [F.coalesce(CHECKS[r.check](value, list(up), r.argument), F.lit(False)) for r in rules if r.path == at]
    if isinstance(kind, StructType):
        for f in kind:
            place = f"{at}.{f.name}" if at else f.name
            if below := _under(place, rules):
                out.append(breaks(f.dataType, value[f.name], below, place, (*up, value)))
    elif isinstance(kind, ArrayType) and (below := tuple(r for r in rules if r.path.startswith(f"{at}[]"))):
        out.append(F.coalesce(F.exists(value, lambda x: breaks(kind.elementType, x, below, f"{at}[]", up)), F.lit(False)))
    return reduce(lambda a, b: a | b, out)


def of_type(kind: DataType, required: tuple[str, ...] = ()) -> str:
    """A pattern of what schema_of_variant says of values of a declared type. Values that are like it are surely of the type; others may be (a number in a text, unknown fields). Null is of any type, but for the required fields."""
    if isinstance(kind, StructType):
        fields = "|".join(f"{f.name}: {'(?!VOID)' if f.name in required else ''}{of_type(f.dataType)}" for f in kind)
        out = rf"OBJECT<(?:(?:{fields})(?:, )?)*>"
    elif isinstance(kind, ArrayType):
        out = rf"ARRAY<{of_type(kind.elementType)}>"
    else:
        out = {StringType: "STRING", BooleanType: "BOOLEAN"}.get(type(kind), "BIGINT")
    return f"(?:VOID|{out})"


def mistyped(kind: DataType, value: Column, name: str, path: Column, required: bool = False) -> Column:
    """Violations where a variant isn't of the declared type: the outermost places only. Null is of any type, but for a required field."""
    none = F.expr("array()").cast(VIOLATIONS)
    wrong = F.array(made(f"{name}_mistyped", path))
    if isinstance(kind, StructType):
        inside = F.concat(*(mistyped(f.dataType, F.try_variant_get(value, f"$.{f.name}", "variant"), f.name, F.concat(path, F.lit(f".{f.name}"))) for f in kind))
        of_kind = F.try_variant_get(value, "$", "map<string, variant>").isNotNull()
    elif isinstance(kind, ArrayType):
        items = F.try_variant_get(value, "$", "array<variant>")
        inside = F.flatten(F.transform(items, lambda x, i: mistyped(kind.elementType, x, name, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        of_kind = items.isNotNull()
    else:
        inside = none
        if isinstance(kind, StringType):
            of_kind = F.schema_of_variant(value) == "STRING"
        else:
            of_kind = F.try_variant_get(value, "$", "boolean" if isinstance(kind, BooleanType) else "bigint").isNotNull()
    return F.when(value.isNull(), none).when(F.is_variant_null(value), wrong if required else none).when(~of_kind, wrong).otherwise(F.coalesce(inside, none))


def mistyped_field(kind: DataType, value: Column, name: str, required: bool = False) -> Column:
    """mistyped() of a record's field; most are told to be right by one look at their schema."""
    right = F.rlike(F.schema_of_variant(value), F.lit(f"^{of_type(kind)}$")) & ~(F.is_variant_null(value) & F.lit(required))
    return F.when(value.isNull() | right, F.expr("array()").cast(VIOLATIONS)).otherwise(mistyped(kind, value, name, F.lit(name), required))
