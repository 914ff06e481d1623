import random

import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, giants, segment

PARAS = "doc_id long, pos long, style_name string, list_level int, text string"
HEADS = ["Overview", "Procedure", "Notes and Variants", "References", "Procedure", "Untitled"]
TEXTS = ["Add water", "IMPORTANT: cold", "Samples can be stored at 4C", "plain prose of some length", "See [1] here"]


def paragraphs(spark, docs=90, seed=3):
    r, rows = random.Random(seed), []
    for doc in range(docs):
        procedure = r.random() < 0.7
        for pos in sorted(r.sample(range(400), r.randrange(0, 120))):
            x = r.random()
            if not procedure and x < 0.04 or x < 0.005:
                rows.append((doc, pos, "Heading 1", 0, r.choice(HEADS)))
                procedure = rows[-1][4] == "Procedure"
            elif x < 0.07:
                rows.append((doc, pos, "Heading 2", 0, f"Stage {pos}"))
            elif x < 0.15:
                rows.append((doc, pos, "Normal", 0, r.choice(TEXTS)))
            else:
                rows.append((doc, pos, "List Number", r.randrange(1, 6), r.choice([*TEXTS, "Add salt", "Add salt"])))
        if doc % 3 == 0:
            rows.append((doc, -1, "Heading 1", 0, "Procedure"))
    return blocks.paragraphs(spark.createDataFrame(rows, PARAS))


def rows(df):
    columns = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_blocks_give_what_windows_give(spark, block):
    p = paragraphs(spark).cache()
    one = segment.segments(p)
    assert rows(giants.segments(p, block)) == rows(one)
    sections = segment.procedure(one)
    assert rows(giants.procedure(one, block)) == rows(sections)
    tree = segment.step_tree(sections)
    assert tree.where("depth > 2").count() > 20 and tree.where("not rendered").count() > 20
    assert rows(giants.step_tree(sections, block)) == rows(tree)
    assert rows(giants.step_numbers(tree, block)) == rows(segment.step_numbers(tree))
    assert rows(giants.references(one, block)) == rows(segment.references(one))
    p.unpersist()


def test_giants_go_by_blocks_and_the_others_by_windows(spark):
    p = paragraphs(spark).cache()
    sizes = {r.doc_id: r["count"] for r in p.groupBy("doc_id").count().collect()}
    seen = {}

    def kind(name):
        def of(part):
            seen[name] = {r.doc_id for r in part.select("doc_id").distinct().collect()}
            return segment.segments(part) if name == "one" else giants.segments(part, 7)

        return of

    assert rows(giants.by_size(p, kind("one"), kind("two"), most=80)) == rows(segment.segments(p))
    assert seen == {"one": {d for d, n in sizes.items() if n <= 80}, "two": {d for d, n in sizes.items() if n > 80}}
    assert len(seen["two"]) > 5
    assert giants.by_size(p, lambda x: x, None, most=1000).count() == p.count()


def test_no_task_holds_more_than_a_block_of_a_document_of_a_million_paragraphs(spark):
    """Rows are exchanged by document and block; only summaries meet by document."""
    n, block = 1_000_000, 10_000
    para = spark.range(n).select(
        F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("pos"), F.when(F.col("id") == 0, "Heading 1").otherwise("List Number").alias("style_name"),
        (1 + F.col("id") % 4).cast("int").alias("list_level"), F.when(F.col("id") == 0, "procedure").otherwise("Add water").alias("text"),
    )
    tree = giants.step_tree(giants.procedure(giants.segments(blocks.paragraphs(para), block), block), block)
    got = tree.agg(F.count("*"), F.max("seq"), F.sum("depth"), F.count_if(F.col("parent_seq").isNull()), F.sum("parent_seq")).first()
    # levels go 2 3 4 1 2 3 4 1: depths 0 1 2 0, then 1 2 3 0 over and over
    depth = lambda k: k if k < 3 else (k + 1) % 4
    parent, last = [], {}
    for k in range(n - 1):
        last[depth(k)] = k
        parent.append(last[depth(k) - 1] if depth(k) else None)
    assert tuple(got) == (n - 1, n - 2, sum(map(depth, range(n - 1))), parent.count(None), sum(x for x in parent if x is not None))
    most = giants.blocked(tree, block, "section_no").groupBy("doc_id", "section_no", "block").count().agg(F.max("count")).first()[0]
    assert most <= block
