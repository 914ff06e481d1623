"""The registry of numbered sections: a document's section number and name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the section of computational documents that name none.
COMPUTATIONAL = "9"


def section(hint: Column, computational: Column, names: dict[str, str]) -> Column:
    """struct<number, name>: the hinted section if the registry has it; else, for computational documents, the hint or the default number with the default's name;
    else the hint, if any, without a name. The registry is small and folded into the expression."""
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv)) if names else F.create_map(F.lit(""), F.lit(""))
    given = F.coalesce(hint, F.lit(""))
    known = F.element_at(lookup, given).isNotNull() & (given != "")
    number = F.when(~known & F.coalesce(computational, F.lit(False)) & (given == ""), COMPUTATIONAL).otherwise(given)
    name = F.when(known, F.element_at(lookup, given)).when(F.coalesce(computational, F.lit(False)), names.get(COMPUTATIONAL, "")).otherwise("")
    return F.struct(number.alias("number"), name.alias("name"))
