import random
import re

import pytest
from pyspark.sql import functions as F

from quire.functions import classify
from quire.operators import phrases

TEXTS = ["", None, "RNase-free water", "see  section 4", "See section 4!", "SEE SECTION", "IMPORTANT: works well", "tip - toxic", "avoid freeze/thaw cycles", "xtoxic toxicx", "to improve, works well", "_critical_ step", "ünote: important", "can be stored overnight at 4", "Can Be Stored", "critical step critical", "…toxic…", "python_x python", "node npm node; CLI"]


def test_as_the_patterns_say(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").withColumn("class", F.lit("kept"))
    callouts, stops, words = phrases.built_in(spark)
    got = phrases.callouts(texts, ["id"], "text", callouts).withColumn("want", classify.callout_type(F.col("text")))
    assert got.columns == ["id", "text", "class", "callout", "want"]
    assert all(r.callout == r.want for r in got.collect()) and got.where("callout is not null").count() >= 9
    got = phrases.classes(texts, ["id"], "text", stops, "stop").withColumn("want", F.coalesce(classify.is_stopping_point(F.col("text")), F.lit(False)))
    assert all((r.stop is not None) == r.want for r in got.collect())
    n = {r.id: r.n for r in phrases.counts(texts, ["id"], "text", words).collect()}
    assert n == {i: k for i, t in enumerate(TEXTS) if (k := len(re.findall(rf"(?ai)\b(?:{classify.COMPUTATIONAL})\b", t or "")))}


def test_a_hundred_thousand_phrases_by_priority(spark, monkeypatch):
    r = random.Random(1)
    lists = {kind: [f"{kind} word{k} of {k % 7}" if k % 3 else f"{kind}{k}" for k in range(50_000)] for kind in ("first", "second")}
    lists["third"] = ["first3", "tail"]
    table = phrases.table(spark, lists)
    said = [(i, f"x {lists['second'][k]}, {lists['first'][j] if i % 2 else 'nothing'}. tail") for i, (k, j) in enumerate((r.randrange(50_000), r.randrange(50_000)) for _ in range(300))] + [(999, "FIRST3"), (1000, "TAIL end"), (1001, "no")]
    texts = spark.createDataFrame(said, "id long, text string")
    for most in (phrases.MOST_BROADCAST, 0):
        monkeypatch.setattr(phrases, "MOST_BROADCAST", most)
        got = {r.id: r["class"] for r in phrases.classes(texts, ["id"], "text", table).collect()}
        assert got == {**{i: "first" if i % 2 else "second" for i in range(300)}, 999: "first", 1000: "third", 1001: None}
    with pytest.raises(ValueError, match="begin and end"):
        phrases.table(spark, {"a": ["fine", "(odd"]})
    callouts, stops, _ = phrases.from_settings(spark, {"callouts": {"loud": ["very loud"], "low": ["loud"]}})
    got = {r.id: r["class"] for r in phrases.classes(spark.createDataFrame([(1, "a very loud one"), (2, "Loud"), (3, "toxic")], "id long, text string"), ["id"], "text", callouts).collect()}
    assert got == {1: "loud", 2: "low", 3: None} and stops.count() == len(classify.STOPPING.split("|"))
