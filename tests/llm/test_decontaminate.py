import random

import numpy as np
import pytest

from quire.llm import decontaminate as d

ITEM = "Each morning Mary takes 15 eggs from her ducks. Then Mary eats 3 of them for breakfast and bakes muffins for her friends with 4 more. How much does Mary earn if each egg sells for $2 at the market and she walks 7 km to reach it?"
OTHER = ITEM.replace("Mary", "Paula").replace("15", "28").replace("3 of", "9 of").replace("4 more", "6 more").replace("$2", "$5").replace("7 km", "11 miles")
rnd = random.Random(5)
VOCAB = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choices(VOCAB, k=n))


BENCH = [(1, ITEM), (2, prose(30)), (3, prose(30)), (4, "too short"), (5, None), (6, ""), (7, "1 2 3 4 5 6 7 8 9 10 11 12")]


def shuffled(text):
    words = text.split()
    rnd.shuffle(words)
    return " ".join(words)


DOCS = {
    1: prose(100) + " " + ITEM + " " + prose(50),
    2: prose(100) + ". " + OTHER + " " + prose(50),
    3: prose(300),
    4: None,
    5: "",
    6: shuffled(ITEM),
    7: prose(20) + " " + BENCH[1][1].upper() + " " + BENCH[2][1],
    8: "1 2 3 4 5 6 7 8 9 10 11 12",
    9: prose(30_000) + " " + ITEM,
    10: "too short",
    11: " ".join(ITEM.split()[:14]) + " " + prose(60),
    12: ITEM,
}
# 8 and 10 are whole copies of items without windows; 11 has fourteen words of an item, ten of them literal
WANT = {1: (1, 1, False), 2: (1, 1, True), 7: (2, 2, False), 8: (7, 1, False), 9: (1, 1, False), 10: (4, 1, False), 12: (1, 1, False)}


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 20])
def test_planted_leaks(spark, block_words):
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in DOCS.items()], "doc_id long, text string, item_id int, extra string")
    bench = spark.createDataFrame([(i, t, "y") for i, t in BENCH], "item_id long, text string, doc_id string")
    got = d.judge(docs, bench, block_words).collect()
    assert len(got) == len(DOCS)
    assert {r.doc_id: (r.item_id, r.n_items, r.other_values) for r in got if r.contaminated} == WANT
    kept = d.clean(docs, bench, block_words)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(DOCS) - set(WANT)


def test_contradictory_slots_do_not_count(spark):
    item = "then we add 3 cups of flour and then we add 5 cups of sugar and then we add 8 cups of water"
    clash = "then we add 1 cups of flour and then we add 1 cups of sugar and then we add 1 cups of water"
    fine = item.replace("3", "4").replace("5", "6").replace("8", "9")
    docs = spark.createDataFrame([(1, clash), (2, fine)], "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in d.judge(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: False, 2: True}


def test_a_run_of_thirteen_literal_words_is_evidence(spark):
    long = prose(300)
    words = long.split()
    item = " ".join(words[:40]) + " 17 " + " ".join(words[40:])
    cases = {
        1: prose(50) + " " + " ".join(words[100:113]) + " " + prose(50),
        2: prose(50) + " " + " ".join(words[100:112]) + " xyz " + " ".join(words[113:125]) + " " + prose(50),
        3: " ".join(words[34:40]) + " 17 " + " ".join(words[40:46]),  # 12 words and a number
        4: " ".join(words[200:260]),
        5: " ".join([*words[10:18], *words[60:68], *words[110:118]]),
        6: " ".join(words[287:]).upper(),
    }
    got = d.judge(spark.createDataFrame(list(cases.items()), "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r.doc_id: (r.item_id, r.matched_windows) for r in got.collect() if r.contaminated} == {1: (9, 9), 4: (9, 56), 6: (9, 9)}


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    rows = d.judge(docs, spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()
    return [(r.item_id, r.n_items, r.other_values) if r.contaminated else None for r in rows]


def test_items_without_windows(spark):
    items = [(1, "Add 3 km and 4 km"), (2, "Bonn 1949 1990 Berlin"), (3, "12 + 5 = 17, 17 * 2 = 34, 34 - 4 = 30")]
    texts = ["please add 3 km and 4 km now", "add 3 km and 5 km", "Bonn 1949 1990 Berlin", "see Bonn 1949 1990 Berlin", prose(40) + " 12 + 5 = 17, 17 * 2 = 34, 34 - 4 = 30 " + prose(9)]
    assert held(spark, texts, items) == [(1, 1, False), None, (2, 1, False), None, (3, 1, False)]


def test_names_and_numbers_do_not_break_runs(spark):
    words = prose(200).split()
    item = " ".join(w + (f" {i}" if i % 5 == 4 else "") for i, w in enumerate(words))
    part = " ".join(item.split()[60:78])  # 18 tokens, 15 of them literal
    assert held(spark, [part, part.replace("59", "58")], [(1, item)]) == [(1, 1, False), None]


def test_scripts_without_spaces(spark):
    item = "第一段文字说明了如何计算面积和周长的方法"
    assert held(spark, ["前言。" + item + "。后记", "完全不同的一句话没有任何关系可言"], [(1, item)]) == [(1, 1, False), None]


def test_items_of_one_template(spark):
    """Many items that differ in values alone are one class; the member with the document's values is reported."""
    question = "a farmer has {} cows and sells them at the market for {} dollars each before the winter comes"
    items = [(k, question.format(k + 100, 2 * k + 300)) for k in range(3000)]
    got = held(spark, [question.format(102, 304), question.format(1, 2), prose(30)], items)
    assert got == [(2, 3000, False), (0, 3000, True), None]


def test_null_and_repeated_items(spark):
    items = [(None, ITEM), (None, ITEM), (5, BENCH[1][1]), (5, BENCH[2][1]), (6, BENCH[1][1]), (6, None)]
    assert held(spark, [ITEM, BENCH[1][1], BENCH[2][1]], items) == [(None, 1, False), (5, 2, False), (5, 1, False)]


def test_candidates_cover_every_match():
    """Half of a class's windows, and any seven in a row, hold a window that finds it."""
    shared = " ".join(VOCAB[:40])
    index = d.Index([(k, f"{shared} {prose(n)} {shared}".encode()) for k, n in enumerate([0, 3, 10, 80, 200])])
    chosen = np.zeros(len(index.keys), bool)
    chosen[index.candidates()] = True
    for a, b in zip(index.ranges, index.ranges[1:]):
        assert (~chosen[a:b]).sum() < d.LEAST * (b - a)
        assert all(chosen[i : i + 7].any() for i in range(a, b - 6))


def brute(text, items):
    """Items of which five plain words in a row, in half of their places, occur in the text."""
    words = lambda t: [x for w in t.split() if (x := d._EDGE.sub("", w).lower())]
    grams = lambda t: {tuple(ws[i : i + 5]) for ws in [words(t)] for i in range(len(ws) - 4)}
    own = grams(text)
    return {i for i, t in items if (g := grams(t)) and len(g & own) >= 0.5 * len(g)}


def test_corpus_against_brute_force(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {r.doc_id for r in docs.collect() if brute(r.text or "", items)}
    got = {r.doc_id for r in d.judge(docs, bench).where("contaminated").collect()}
    assert got == want and want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in d.judge(docs, none).collect()] == [False]
    assert d.judge(docs.limit(0), none).count() == 0
    assert d.clean(docs, none).count() == 1
