import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries as q
from quire.llm import search
from tests.oracle import both, connect

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def brute_force(docs, items, most=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_words = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scored = []
        for d, c in counts:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // max(n_words, 1)
            s = sum(r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, r in Counter(terms(text)).items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:most])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture():
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Ünïcode", "ABC", "x1y2"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    docs = [(k, " ".join(r.choices(vocabulary, weights, k=r.randrange(80)))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(70)] + [(5, docs[5][1]), (7, "w3 w4"), (None, docs[9][1]), (None, docs[9][1]), (None, None), (2000, ""), (2001, "-- , "), (2002, "abc " * 40_000)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.randrange(1, 25)))) for k in range(40)]
    items += [(0, "w5 w6 abc"), (3, items[3][1]), (50, None), (51, ""), (52, "nowhere at all"), (None, "w1 w2 w2 W2"), (53, docs[5][1])]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(search.SHARD, search.ITEMS_BYTES), (2000, 1000)])
def test_as_by_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "ITEMS_BYTES", block)
    docs, items = fixture()
    random.Random(1).shuffle(docs)
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, item_id string, score int").repartition(5)
    b = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    assert rows(search.rank(d, b)) == brute_force(docs, items)


def test_documents_are_passed_over():
    """A rare term fills the heap; from then on documents that hold only the frequent one are not looked at."""

    class Watched(list):
        read = 0

        def __getitem__(self, k):
            Watched.read += isinstance(k, int)
            return super().__getitem__(k)

    rare, frequent = list(range(0, 2000, 100)), list(range(100_000))
    lists = [(rare, [10] * len(rare), 100, 1000), (frequent, Watched([9] * len(frequent)), 1, 9)]
    heap = []
    search.weak_and(lists, frequent, heap, 20)
    assert sorted(heap) == sorted((1009, -d) for d in rare)
    assert Watched.read < 2500


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.dictionaries(st.integers(0, 30), st.integers(1, 6), min_size=1), st.integers(1, 4)), max_size=6), st.integers(1, 5), st.randoms())
def test_heap_of_any_lists(drawn, most, r):
    names = r.sample(range(100), 31)
    lists = [(sorted(d), [d[k] for k in sorted(d)], f, f * max(d.values())) for d, f in drawn]
    heap = []
    search.weak_and(lists, names, heap, most)
    total = Counter()
    for d, f in drawn:
        for k, i in d.items():
            total[k] += f * i
    assert sorted(heap, reverse=True) == sorted(((s, -names[k]) for k, s in total.items()), reverse=True)[:most]


def test_tables_without_rows(spark):
    docs, items = fixture()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(search.rank(d.limit(0), b)) == []
    assert rows(search.rank(d, b.limit(0))) == []
    assert rows(search.rank(d, b.where("text is null"))) == []


def test_one_text_of_twenty_megabytes(spark):
    docs = [(1, "alpha beta " + "common words here " * 1_200_000), (2, "alpha common"), (3, "beta"), (4, "other"), (5, "none")]
    assert len(docs[0][1]) > 20 << 20
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(search.rank(d, spark.createDataFrame([(1, "alpha common")], "item_id long, text string"))) == brute_force(docs, [(1, "alpha common")])


def test_query_and_sql_agree(spark, sf):
    got, want = both(spark, connect(sf), sf, q.queries()["op12_wand"], q.oracle_sql()["op12_wand"])
    assert got == want
