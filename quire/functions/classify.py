"""Prioritised paragraph classifiers as Column expressions; CASE short-circuits, so its order is the priority."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import CALLOUT_LABELS, once, strip, strip_markers

#: What marks a callout of each class, in order of priority.
CALLOUT_WORDS = {
    "critical": "critical|critical step|protocol will fail|crucial",
    "caution": "important|warning|caution|hazard|toxic|corrosive|flammable|carcinogen|biohazard|radiation|rnase|dnase|keep on ice|avoid freeze|avoid freeze/thaw|sensitive to",
    "tip": "shortcut|to improve|for best results|works well",
    "note": "see section|refer to|for more information|species-specific|see also|cross-reference",
}
#: Phrases of a stopping point; words of computational texts; titles of first-level sections.
STOPPING = "pause point|safe stopping point|can be stored|may be stored|samples can be stored|can be left|store at this stage|can stop here|overnight at"
COMPUTATIONAL = "bash|python|git|conda|pip|docker|node|npm|script|command|terminal|shell|cli|api|server|database|bioinformatics|pipeline|workflow|jupyter|notebook|environment|package|install|deploy"
KNOWN_TITLES = ("overview", "materials", "procedure", "notes & variants", "notes and variants", "references", "reagent mixes & recipes", "reagent mixes and recipes", "prerequisites")
#: First-level heading -> role.
ROLES = {
    "overview": "overview", "materials": "materials", "procedure": "procedure", "notes & variants": "notes", "notes and variants": "notes", "notes & variants:": "notes",
    "references": "references", "reagent mixes & recipes": "mixes", "reagent mixes and recipes": "mixes", "prerequisites": "prerequisites",
}
#: Words of a table's header row.
HEADER_WORDS = ("reagent", "supplier", "cat", "equipment", "notes", "catalogue")


def _has(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def _callout(plain: Column) -> Column:
    out = F.when(F.length(strip(F.coalesce(plain, F.lit("")))) == 0, None)
    for kind, labels in CALLOUT_LABELS.items():
        out = out.when(_has(plain, rf"(?i)^(?:{labels})\s*[:\-–—]"), kind)
    for kind, words in CALLOUT_WORDS.items():
        out = out.when(_has(plain, rf"(?i)\b(?:{words})\b"), kind)
    return out


def _stops(plain: Column) -> Column:
    return _has(plain, rf"(?i)\b(?:{STOPPING})\b")


def callout_type(c: Column) -> Column:
    """critical, caution, tip, note or null: a label in front first, then the words of each class."""
    return once(strip_markers(c), _callout)


def is_stopping_point(c: Column) -> Column:
    return _stops(strip_markers(c))


def heading_level(text: Column, style: Column) -> Column:
    s = F.lower(F.coalesce(style, F.lit("")))
    out = F.when(F.contains(s, F.lit("title")), 1)
    for level in (3, 2, 1):
        out = F.when(F.contains(s, F.lit(f"heading {level}")) | (s == f"h{level}"), level).otherwise(out)
    known = F.when(F.lower(strip(strip_markers(text))).isin(*KNOWN_TITLES), 1)
    capitals = F.when((text == F.upper(text)) & (text != F.lower(text)) & (F.size(F.split(strip(text), r"(?U)\s+")) <= 8), 2)
    return F.coalesce(out, known, capitals, F.lit(0))


def section_type(full_text: Column) -> Column:
    """computational with a fence, a line indented by four or more, or three of the words; else wet_lab."""
    code = _has(full_text, r"(?m)```|^\s{4,}\S")
    hits = F.regexp_count(full_text, F.lit(rf"(?i)\b(?:{COMPUTATIONAL})\b"))
    return F.when(code | (hits >= 3), "computational").otherwise("wet_lab")


def paragraph_class(raw_text: Column, is_list: Column) -> Column:
    def of(plain: Column) -> Column:
        rest = F.when(_stops(plain), "stopping_point").when(is_list, "step").otherwise("prose")
        return once(_callout(plain), lambda kind: F.coalesce(F.concat(F.lit("callout_"), kind), rest))

    return once(strip_markers(raw_text), of)


def role(heading: Column) -> Column:
    """Role of a first-level heading, or null. The ten rows are folded into the expression: cheaper than a join, and no shuffle."""
    mapping = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.element_at(mapping, F.lower(strip(heading)))


def is_header_row(cells: Column) -> Column:
    filled = F.filter(cells, lambda c: F.length(strip(c)) > 0)
    return F.forall(filled, lambda c: F.exists(F.array(*map(F.lit, HEADER_WORDS)), lambda w: F.contains(F.lower(c), w)))


def is_bold_row(first_cell: Column) -> Column:
    return _has(first_cell, "(?i)^(total|incubate)")
