"""JSON inside free text: the only scalar work that is no Spark expression. Arrow-batched, never row by row through the JVM."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_TOKEN = re.compile(r'"(?:\\.|[^"\\])*"?|[{}]', re.S)
_STEP = re.compile(r"([^.\[\]]+)|\[(\d+)\]")


def fenced(text: str) -> str | None:
    """The first text between fences that begins and ends as an object does; the opening fence may name the format."""
    parts = text.split("```")
    for inside in parts[1:-1]:
        body = inside.removeprefix("json").strip()
        if body[:1] == "{" and body[-1:] == "}":
            return body
    return None


def find_object(text: str | None) -> tuple[str | None, str | None]:
    """(the first JSON object's text, what is wrong): a fenced one, else the first balanced one."""
    if body := fenced(text or ""):
        return body, None
    start = (text or "").find("{")
    if start < 0:
        return None, "no object"
    depth = 0
    for m in _TOKEN.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m[0], 0)
        if not depth:
            return text[start : m.end()], None
    return None, "incomplete object"


def set_path(document: str, path: str, value: str) -> tuple[str | None, str | None]:
    """(the document with the value, as JSON or else a string, at a path such as procedure[0].heading; what is wrong)."""
    steps = [int(i) if i else k for k, i in _STEP.findall(path)]
    if not steps or "".join(f"[{s}]" if isinstance(s, int) else s for s in steps) != path.replace(".", ""):
        return None, f"malformed path: {path}"
    whole = at = json.loads(document)
    try:
        new = json.loads(value)
    except ValueError:
        new = value
    for k, s in enumerate(steps):
        if isinstance(s, int) != isinstance(at, list) or not isinstance(at, list | dict):
            return None, f"wrong container at {s}"
        if isinstance(s, int) and s >= len(at):
            return None, f"index out of range: {s}"
        if k == len(steps) - 1:
            at[s] = new
        elif isinstance(s, str) and s not in at:
            return None, f"missing key: {s}"
        else:
            at = at[s]
    return json.dumps(whole, ensure_ascii=False), None


@F.pandas_udf(StructType().add("object", StringType()).add("problem", StringType()))
def json_object(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([find_object(t) for t in texts], columns=["object", "problem"])


@F.pandas_udf(StructType().add("document", StringType()).add("problem", StringType()))
def set_json_path(documents: pd.Series, paths: pd.Series, values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([set_path(*x) for x in zip(documents, paths, values, strict=True)], columns=["document", "problem"])
