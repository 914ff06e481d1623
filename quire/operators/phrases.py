"""Phrase lists as data: classes of texts by an equality join of their word runs with a phrase table, in place of alternations compiled into the plan.

A phrase table has phrase, class and priority (the least wins); lists may have hundreds of thousands of phrases. A text is cut into words (`\\w`, ASCII as in the patterns
that this stands beside) and what stands between them; every run of up to `longest` words, with what stands between them as written, is looked up. So a phrase is found exactly where the
pattern `\\bphrase\\b` would find it, in any case of ASCII letters.

Runs are made distinct in the row before they are exploded (but for counts), the phrase table is broadcast if it has MOST_BROADCAST rows at most, which is counted, and hits alone meet again by key.

Defined cases: null and empty texts have no class; a phrase that doesn't begin and end with a word character is refused, as nothing could find it; equal phrases take the least priority,
then the first class; an empty table gives no classes; extra columns of the texts are handed on.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import classify
from quire.functions.text import CALLOUT_LABELS, strip_markers

MOST_BROADCAST = 500_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def table(spark: SparkSession, lists: Mapping[str, Sequence[str]]) -> DataFrame:
    """phrase, class, priority of lists by class, in order of priority."""
    rows = [(p, kind, k) for k, (kind, phrases) in enumerate(lists.items()) for p in phrases]
    odd = [p for p, _, _ in rows if not (p and all(c.isascii() and (c.isalnum() or c == "_") for c in (p[0], p[-1])))]
    if odd:
        raise ValueError(f"phrases must begin and end with a letter, a digit or an underscore: {odd[:5]}")
    out = spark.createDataFrame(rows, "phrase string, class string, priority int").withColumn("phrase", _low(F.col("phrase")))
    return out.groupBy("phrase").agg(F.min(F.struct("priority", "class")).alias("best")).select("phrase", "best.class", "best.priority")


def built_in(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(callouts, stopping points, computational words): the library's own lists."""
    own = lambda words: words.split("|")
    return table(spark, {k: own(v) for k, v in classify.CALLOUT_WORDS.items()}), table(spark, {"stopping_point": own(classify.STOPPING)}), table(spark, {"computational": own(classify.COMPUTATIONAL)})


def from_settings(spark: SparkSession, settings: Mapping) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same of a settings file (config.load): callouts (class -> phrases, in order of priority), stopping_points and computational; what it lacks is the library's own."""
    own = built_in(spark)
    given = settings.get("callouts"), settings.get("stopping_points"), settings.get("computational")
    made = (given[0], given[1] and {"stopping_point": given[1]}, given[2] and {"computational": given[2]})
    return tuple(table(spark, new) if new else old for new, old in zip(made, own, strict=True))


def runs(c: Column, longest: int) -> Column:
    """The runs of one to `longest` words of a text, with what stands between the words."""
    parts = F.regexp_extract_all(_low(c), F.lit(r"(\w+|\W+)"), F.lit(1))
    first = F.when(F.rlike(c, F.lit(r"^\w")), 1).otherwise(2)  # words and what is between them take turns

    def of(n: int) -> Column:
        places = F.filter(F.sequence(first, F.greatest(F.size(parts), first), F.lit(2)), lambda i: i + 2 * (n - 1) <= F.size(parts))
        return F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.lit(2 * n - 1)), ""))

    return F.flatten(F.array(*map(of, range(1, longest + 1))))


def _joined(texts: DataFrame, key: list[str], column: str, phrases: DataFrame, distinct: bool) -> DataFrame:
    words = F.size(F.regexp_extract_all("phrase", F.lit(r"(\w+)"), F.lit(1)))
    n, longest = phrases.agg(F.count("*"), F.max(words)).first()
    found = runs(F.col(column), longest or 1)
    exploded = texts.select(*key, F.explode(F.array_distinct(found) if distinct else found).alias("phrase"))
    return exploded.join(F.broadcast(phrases) if n <= MOST_BROADCAST else phrases, "phrase")


def classes(texts: DataFrame, key: list[str], column: str, phrases: DataFrame, name: str = "class") -> DataFrame:
    """The texts with the class of the phrase of least priority that each has, or null. `key` names a text."""
    best = _joined(texts, key, column, phrases, True).groupBy(*key).agg(F.min(F.struct("priority", "class")).alias("best"))
    return texts.join(best.select(*key, F.col("best.class").alias(name)), key, "left")


def counts(texts: DataFrame, key: list[str], column: str, phrases: DataFrame) -> DataFrame:
    """The key and n: how many times phrases of the table stand in the text; a row for each text that has one."""
    return _joined(texts, key, column, phrases, False).groupBy(*key).agg(F.count("*").alias("n"))


def callouts(texts: DataFrame, key: list[str], column: str, phrases: DataFrame, name: str = "callout") -> DataFrame:
    """The texts with their callout class: by a label in front, else by phrases; as classify.callout_type with the built-in table."""
    plain = strip_markers(F.col(column))
    label = F.when(F.lit(False), "")
    for kind, labels in CALLOUT_LABELS.items():
        label = label.when(F.rlike(plain, F.lit(rf"(?i)^(?:{labels})\s*[:\-–—]")), kind)
    columns = texts.columns
    marked = texts.withColumns({"plain_text": plain, "said_label": label})
    return classes(marked, key, "plain_text", phrases, "phrase_class").select(*columns, F.coalesce("said_label", "phrase_class").alias(name))
