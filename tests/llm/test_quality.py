import math
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quire.llm import quality as q


def test_measures_of_a_text():
    m, x = q.measures([b"The cat cat sat!!\nTHE #tag\nTHE #tag\n", b"", b"one"])
    assert m[0, 0] == -8 and m[0, 3] == 2 / 8 and abs(m[0, 4] - 1 / 3) < 1e-9
    assert m[0, 1] == 2 / 8 and m[0, 2] == 2 / 8 and m[0, 5] == 4 / 8 and m[0, 9] == 1 / 8
    assert m[0, 6] == -3 / 8 and abs(m[0, 8] - 1 / 7) < 1e-9
    assert (m[1, 1:7] == 0).all() and x.shape == (3, q.DIMENSIONS) and np.isfinite(x).all()


def test_expectation_maximisation_recovers_rates():
    rnd = np.random.default_rng(4)
    k, n = len(q.LABELLERS), 40_000
    good = rnd.random(n) < 0.8
    miss = rnd.uniform(0.2, 0.7, k)  # how often each finds a bad document bad
    v = np.where(good[:, None] | (rnd.random((n, k)) >= miss), q.GOOD, q.BAD)
    v[rnd.random((n, k)) < 0.2] = q.NOTHING
    p, c = np.unique(q.pattern(v), return_counts=True)
    posterior, rates, share = q.expectation_maximisation(p, c)
    assert abs(share - 0.8) < 0.02 and np.abs(rates[0, :, q.BAD] - miss).max() < 0.05
    of = dict(zip(p.tolist(), posterior))
    said = np.array([of[x] for x in q.pattern(v).tolist()]) >= 0.5
    assert (said == good).mean() > 0.97
    assert (q.unpack(q.pattern(v[:50])) == v[:50]).all()


def brute_measures(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    n = max(1, len(words))
    count = lambda w, marks: sum(bytes([b]) in marks for b in w)
    each = lambda s: [s[i : i + 1] for i in range(len(s))]
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = list(zip(words, words[1:]))
    return [
        -len(words),
        sum(count(w, each(q._SYMBOLS)) for w in words) / n,
        sum(len(w) > 1 and w.upper() == w != w.lower() for w in words) / n,
        max(map(words.count, set(words)), default=0) / n,
        1 - len(set(lines)) / len(lines) if lines else 0,
        sum(count(w, each(string.punctuation.encode())) for w in words) / n,
        -sum(w.lower().strip(b".,;:!?\"'()").decode("utf-8", "replace") in q.FUNCTION_WORDS for w in words) / n,
        abs(sum(len(w.decode()) for w in words) / n - 6),
        1 - len(set(pairs)) / len(pairs) if pairs else 0,
        sum(a == b for a, b in pairs) / n,
    ]


def brute_votes(m):
    return [1 if -m[0] < fewest else q.GOOD if m[c] <= good else q.BAD if m[c] >= bad else 1 for _, c, bad, good, fewest in q.LABELLERS]


def brute_em(all_votes):
    """Posterior of each document, document by document."""
    k = len(q.LABELLERS)
    p = [1 / (1 + math.exp(-(v.count(q.GOOD) - q.START_BAD * v.count(q.BAD)))) for v in all_votes]
    for _ in range(200):
        rate = {}
        for c in (0, 1):
            for j in range(k):
                bad, good = (sum((x if c else 1 - x) for x, v in zip(p, all_votes) if v[j] == vote) for vote in (q.BAD, q.GOOD))
                bad, good = bad + (0.2 if c else 2.0), good + (2.0 if c else 1.0)
                rate[c, j, q.BAD], rate[c, j, q.GOOD], rate[c, j, 1] = bad / (bad + good), good / (bad + good), 1.0
        share = (sum(p) + 2) / (len(p) + 3)
        new = []
        for v in all_votes:
            g, b = (math.log(s) + sum(math.log(rate[c, j, v[j]]) for j in range(k)) for c, s in ((1, share), (0, 1 - share)))
            new.append(1 / (1 + math.exp(min(500, b - g))))
        done = max(abs(a - b) for a, b in zip(p, new)) < 1e-9
        p = new
        if done:
            break
    return p


def brute_score(text, m, weights):
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    x = Counter()
    for w in words:
        core = w.lower().strip(b".,;:!?\"'()")
        x[q.bucket("shape", q.shape(w))] += 1
        x[q.bucket("word", core) if 0 < len(core) <= 3 else q.bucket("shape", q.shape(w))] += 1
    x = {k: math.sqrt(c / (2 * max(1, len(words)))) for k, c in x.items()}
    x |= dict(enumerate([1, min(math.log1p(len(words)) / 5, 1), m[9], m[3], m[8], m[4]]))
    z = sum(float(weights[k]) * float(np.float16(np.float32(v))) for k, v in x.items())
    return 1 / (1 + math.exp(-z))


def test_query_against_brute_force(spark, sf):
    """Votes, posteriors and scores; the scorer's weights are the model's."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(None, "one two"), (None, None), (None, ""), (3, "AAA bbb #x! " * 9), (3, "AAA bbb #x! " * 9), (9, "é ü. \n\n é ü. \n" * 6)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    texts = [(r.text or "").encode() for r in docs.collect()]
    rows = q.featured(docs)
    model = q.train(rows)
    ms = [brute_measures(t) for t in texts]
    got = Counter((r.doc_id, round(r.posterior, 6), round(r.score, 5), r.accepted) for r in q.judge(rows, model).collect())
    want = Counter()
    for doc_id, t, m, p in zip([r.doc_id for r in docs.collect()], texts, ms, brute_em([brute_votes(m) for m in ms])):
        score = brute_score(t, m, model.weights)
        want[doc_id, round(p, 6), round(score, 5), score >= q.THRESHOLD] += 1
    assert got == want


def test_null_and_repeated_ids(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = q.featured(docs)
    usual = q.judge(rows, q.train(rows)).where("accepted").count()
    for doc_id in ("null", "7"):
        rows = q.featured(docs.selectExpr(f"cast({doc_id} as long) doc_id", "text"))
        assert abs(q.judge(rows, q.train(rows)).where("accepted").count() - usual) <= 0.01 * docs.count()
    # a sample is never larger than it may be, and equal rows enter it once
    rows = q.featured(docs.limit(1).crossJoin(spark.range(500).select()).union(docs))
    assert q.train(rows, most_sample=50).weights.any()


def test_labelled_corpus(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = q.featured(docs.withColumn("pattern", F.lit("p")))
    model = q.train(found)
    got = q.judge(found, model)
    assert got.count() == docs.count()
    rows = got.join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.accepted for r in good) >= 0.98 * len(good) and sum(r.accepted for r in bad) <= 0.1 * len(bad)
    kept = q.accept(found, model)
    assert kept.columns == [*docs.columns, "pattern"] and kept.where("pattern = 'p' and text is not null").count() > 0
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in got.where("accepted").collect()}


def test_odd_rows(spark):
    texts = [None, "", " \n", "word " * 30_000, "x" * 50_000, "same text here", "same text here"]
    docs = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    rows = q.featured(docs)
    model = q.train(rows)
    assert q.judge(rows, model).count() == len(texts)
    none = q.featured(docs.limit(0))
    assert q.judge(none, q.train(none)).count() == 0 and q.accept(none, model).count() == 0 and q.accept(none, model).columns == docs.columns
