import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import queries as q
from quire.llm import resample
from tests.oracle import both, connect

DOCS = "doc_id long, text string, weight string, score string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(gram):
    return zlib.crc32(gram.encode()) % 10000


def brute_force(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        w, g = grams(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000)))) for b in map(bucket, g))
        h = int(hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def fixture():
    r = random.Random(5)
    vocabulary = ["Alpha", "beta", "ñandú", "x1", "été", "gamma", "Δelta", "z"]
    docs = [(k, " ".join(r.choices(vocabulary, k=r.randrange(60)))) for k in range(120)]
    docs += [(200, None), (201, ""), (202, "--- ,,, "), (203, "beta"), (None, docs[7][1]), (None, None), (3, docs[3][1]), (4, "other words " * 15)]
    docs += [(300 + k, "beta gamma x1 " * 10) for k in range(40)]  # copies
    docs += [(400, "a" * 300 + " " + "b" * 70000 + " c"), (401, " ".join(f"w{k}" for k in range(30000)))]
    return docs, ["beta gamma x1 beta gamma", "Été! ñandú-z", None, ""]


def test_as_by_brute_force(spark):
    docs, target = fixture()
    df = spark.createDataFrame([(*d, "a", "b") for d in docs], DOCS).repartition(5)
    want = brute_force(docs, target)
    assert sum(r[4] is not None for r in want) > 5
    assert rows(resample.resample(df, spark.createDataFrame([(t,) for t in target], "text string"))) == want


def test_one_text_of_many_pieces(spark):
    """20 MB in one text: it is a piece of its own, beside small ones."""
    r = random.Random(6)
    word = [f"w{k}" for k in range(5000)]
    text = " ".join(r.choices(word, k=3_600_000))
    assert len(text) > 20 << 20 or len(text) > 19_000_000
    w, g = grams(text)
    counts = Counter(map(bucket, g))
    runs = resample.SuffixRuns([b"w1 w2", text.encode(), b""])
    own = runs.counts()
    for b in map(bucket, ["w1", "w2", "w1 w2"]):
        own[b] -= 1
    assert dict(enumerate(own.tolist())) == {b: counts.get(b, 0) for b in range(10000)}
    gain = np.arange(10000) % 97 - 40
    assert runs.sums(gain).tolist() == [sum(int(gain[bucket(x)]) for x in ("w1", "w2", "w1 w2")), sum(int(gain[b]) * n for b, n in counts.items()), 0]


def test_tables_without_rows(spark):
    docs, target = fixture()
    none, texts = spark.createDataFrame([], DOCS), spark.createDataFrame([(t,) for t in target], "text string")
    assert rows(resample.resample(none, texts)) == []
    some = spark.createDataFrame([(*d, "a", "b") for d in docs[:30]], DOCS)
    assert rows(resample.resample(some, texts.limit(0))) == brute_force(docs[:30], [])


def test_selected_documents_keep_their_columns(spark):
    docs, target = fixture()
    df = spark.createDataFrame([(*d, f"kept {k}", "b") for k, d in enumerate(docs)], DOCS)
    want = {r[0] for r in brute_force(docs, target, 30, 5) if r[4] is not None}
    got = resample.selected(df, spark.createDataFrame([(t,) for t in target], "text string"), 30, 5)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == want
    assert all(r.weight.startswith("kept") for r in got.collect())


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.binary(max_size=40), st.binary(max_size=300)), min_size=1, max_size=20))
def test_hashes_put_together(pairs):
    a, b = zip(*pairs, strict=True)
    crc = lambda x: np.array([zlib.crc32(t) for t in x], np.uint32)
    got = resample.followed(crc(a), crc(b), np.array(list(map(len, b)), np.int64))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in pairs]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab É-\n", max_size=30), max_size=6))
def test_runs_of_any_texts(texts):
    got = resample.SuffixRuns([t.encode() for t in texts])
    want = Counter(bucket(g) for t in texts for g in grams(t)[1])
    assert {b: n for b, n in enumerate(got.counts().tolist()) if n} == want
    gain = np.arange(10000) - 5000
    assert got.sums(gain).tolist() == [sum(int(gain[bucket(g)]) for g in grams(t)[1]) for t in texts]


def test_query_and_sql_agree(spark, sf):
    got, want = both(spark, connect(sf), sf, q.queries()["op13_resample"], q.oracle_sql()["op13_resample"])
    assert got == want
    assert any(r[got[0].index("rank")] for r in got[1])
