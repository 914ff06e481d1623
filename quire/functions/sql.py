"""The library's functions for SQL: temporary functions of a session, defined in SQL from the same lists and patterns, without Python workers.

    register(spark)
    spark.sql("SELECT callout_type(text), heading_level(text, style) FROM paragraphs")
    spark.sql("SELECT doc_id, pos, line FROM (SELECT doc_id, lines_of(text) AS of FROM documents), LATERAL inline(of)")

Scalar functions: strip_markers, squeeze (normalize_whitespace), callout_type, is_stopping_point, paragraph_class(text, is_list), heading_level(text, style), section_role, content_hash.
For inline(), which takes a column, not the call itself: lines_of(text) -> pos, line of the lines that aren't blank; cells_of(line) -> pos, cell of a table row written with bars. They are arrays, not table functions: a table function
that is defined by a query is joined with its argument, which shuffles whole texts; inline() of an array is one pass.
Nulls: as the Column functions of the same name have them; lines_of and cells_of give null, of which inline() makes no rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions import classify, text


def _quoted(pattern: str) -> str:
    """A pattern as a raw string literal."""
    return "r\"" + pattern.replace('"', r"\x22") + "\""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, {_quoted(r'(?U)^\s+|\s+$')}, '')"


def _squeezed(c: str) -> str:
    """As an expression: functions that are defined in SQL can't be called inside a lambda."""
    return _strip(f"regexp_replace(translate(coalesce({c}, ''), '{text.AS_SPACE}', '{' ' * len(text.AS_SPACE)}'), ' {{2,}}', ' ')")


def _words(words: str) -> str:
    return _quoted(rf"(?i)\b(?:{words})\b")


def statements() -> list[str]:
    labels = "\n".join(f"WHEN rlike(strip_markers(t), {_quoted(rf'(?i)^(?:{words})\s*[:\-–—]')}) THEN '{kind}'" for kind, words in text.CALLOUT_LABELS.items())
    said = "\n".join(f"WHEN rlike(strip_markers(t), {_words(words)}) THEN '{kind}'" for kind, words in classify.CALLOUT_WORDS.items())
    styles = "\n".join(f"WHEN contains(lower(coalesce(style, '')), 'heading {k}') OR lower(coalesce(style, '')) = 'h{k}' THEN {k}" for k in (1, 2, 3))
    known = ", ".join(f"'{t}'" for t in classify.KNOWN_TITLES)
    roles = "\n".join(f"WHEN '{title}' THEN '{role}'" for title, role in classify.ROLES.items())
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return [
        rf"{make} strip_markers(t STRING) RETURNS STRING RETURN regexp_replace(regexp_replace(t, {_quoted(r'\*\*(.+?)\*\*')}, '$1'), {_quoted(r'_(.+?)_')}, '$1')",
        f"{make} squeeze(t STRING) RETURNS STRING RETURN {_squeezed('t')}",
        f"{make} callout_type(t STRING) RETURNS STRING RETURN CASE WHEN length({_strip("coalesce(strip_markers(t), '')")}) = 0 THEN NULL\n{labels}\n{said} END",
        f"{make} is_stopping_point(t STRING) RETURNS BOOLEAN RETURN rlike(strip_markers(t), {_words(classify.STOPPING)})",
        f"{make} paragraph_class(t STRING, is_list BOOLEAN) RETURNS STRING RETURN coalesce('callout_' || callout_type(t), CASE WHEN is_stopping_point(t) THEN 'stopping_point' WHEN is_list THEN 'step' ELSE 'prose' END)",
        f"""{make} heading_level(t STRING, style STRING) RETURNS INT RETURN CASE {styles} WHEN contains(lower(coalesce(style, '')), 'title') THEN 1
            WHEN lower({_strip('strip_markers(t)')}) IN ({known}) THEN 1 WHEN t = upper(t) AND t <> lower(t) AND size(split({_strip('t')}, {_quoted(r'(?U)\s+')})) <= 8 THEN 2 ELSE 0 END""",
        f"{make} section_role(t STRING) RETURNS STRING RETURN CASE lower({_strip('t')}) {roles} END",
        f"{make} content_hash(t STRING) RETURNS STRING RETURN sha2(CAST(t AS BINARY), 256)",
        f"{make} lines_of(t STRING) RETURNS ARRAY<STRUCT<pos INT, line STRING>> RETURN filter(transform(split(t, '\\n'), (x, i) -> named_struct('pos', i, 'line', trim(x))), s -> s.line <> '')",
        f"{make} cells_of(t STRING) RETURNS ARRAY<STRUCT<pos INT, cell STRING>> RETURN transform(split(t, {_quoted(r' \| ')}), (x, i) -> named_struct('pos', i, 'cell', {_squeezed('x')}))",
    ]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session; those of an earlier call are replaced."""
    for s in statements():
        spark.sql(s)
