import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import neighbours as nb
from quire.llm import queries as q

ROWS = "vec_id long, embedding array<float>, score string, class int"


def rows_of(vectors):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1) for i, v in vectors]


def valid(vectors, size):
    for i, v in vectors:
        if i is not None and v is not None and len(v) == size and None not in v and np.isfinite(np.array(v, np.float64)).all() and np.any(v):
            yield i, np.array(v, np.float32).astype(np.float64)


def brute_force(vectors, size):
    rows = list(valid(vectors, size))
    distinct = list({(i, v.tobytes()): (i, v) for i, v in rows}.values())
    matrix = np.stack([v for _, v in distinct])
    norms = np.sqrt((matrix**2).sum(axis=1))
    out = []
    for i, v in rows:
        if i % 50 == 0:
            score = (matrix * v).sum(axis=1) / (norms * np.sqrt((v**2).sum()))
            near = sorted((-s, d[0]) for s, d in zip(score.tolist(), distinct, strict=True) if d[0] != i)[:5]
            out += [(i, k + 1, x, round(-s, 9)) for k, (s, x) in enumerate(near)]
    return sorted(out)


def result(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def fixture():
    r = np.random.default_rng(7)
    vectors = [(k, v) for k, v in enumerate(r.normal(size=(900, 6)).astype(np.float32).tolist())]
    hot = r.normal(size=6).astype(np.float32).tolist()
    vectors += [(2000 + k, hot) for k in range(400)]
    vectors += [(3000 + k, (np.array(hot) + r.normal(size=6) * 1e-3).tolist()) for k in range(300)]
    vectors += [(5000, None), (5050, []), (5100, [0.0] * 6), (5150, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5200, [float("nan")] * 6), (5250, [float("inf"), 1, 1, 1, 1, 1]), (5300, [1.0, 2.0])]
    vectors += [(None, hot), (-50, hot), (-50, hot), (50, vectors[50][1]), (6000, vectors[1][1])]
    return vectors


@pytest.mark.parametrize(("shelf", "least", "queries"), [(nb.SHELF_BYTES, nb.LEAST_SHELF, nb.QUERIES), (24 * 30, 1, 7)])
def test_as_by_brute_force_where_all_neighbours_are_asked_for(spark, monkeypatch, shelf, least, queries):
    """With a recall of 1 and fewer queries than the calibration takes, the budget is that of the farthest true neighbour."""
    monkeypatch.setattr(nb, "SHELF_BYTES", shelf)
    monkeypatch.setattr(nb, "LEAST_SHELF", least)
    monkeypatch.setattr(nb, "QUERIES", queries)
    vectors = fixture()
    df = spark.createDataFrame(rows_of(vectors), ROWS).repartition(5)
    assert result(nb.nearest(df, recall=1.0)) == brute_force(vectors, 6)


def test_recall_on_the_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = nb.nearest(vectors)
    assert found.count() == 200
    assert nb.recall(found, vectors) >= 0.9


def test_few_cells_are_visited_where_vectors_lie_in_clusters(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(60, 16)) * 5
    points = (centres[r.integers(0, 60, 6000)] + r.normal(size=(6000, 16)) * 0.2).astype(np.float32)
    df = spark.createDataFrame(rows_of(enumerate(points.tolist())), ROWS)
    of = nb.kind(df)
    entries = nb.classes(df, of)
    index = nb.fit(entries, of, 6000)
    nb.count(index, entries, of, nb.RECALL)
    assert index.counts.sum() == 6000
    assert index.budget < 600
    found = nb.nearest(df)
    assert nb.recall(found, df, 1000) >= 0.9


def test_tables_without_queries_or_rows(spark):
    df = spark.createDataFrame(rows_of(fixture()), ROWS)
    assert nb.nearest(df.limit(0)).collect() == []
    assert nb.nearest(df.where("vec_id = 7")).collect() == []
    assert nb.nearest(df.where("vec_id = 50")).collect() == []
    assert nb.nearest(df.where("vec_id in (5000, 5050, 5100)")).collect() == []
    one = spark.createDataFrame([(0, [2.0]), (1, [3.0]), (2, [-1.0]), (50, [0.5])], "vec_id long, embedding array<double>")
    assert result(nb.nearest(one)) == [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, -1.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, -1.0)]


@settings(deadline=None, max_examples=80)
@given(st.integers(1, 7), st.integers(0, 2**32 - 1), st.integers(1, 200))
def test_cells_come_by_summed_distance(k, seed, budget):
    r = np.random.default_rng(seed)
    index = nb.MultiIndex(np.zeros((k, 2)), np.zeros((k, 2)), r.integers(0, 5, k * k), budget)
    a, b = r.integers(0, 9, k).astype(float), r.integers(0, 9, k).astype(float)
    got = index.visit(a, b)
    sums = (a[:, None] + b[None, :]).ravel()
    assert len(set(got)) == len(got)
    assert [sums[c] for c in got] == sorted(sums[c] for c in got)
    held = index.counts[got].sum()
    assert held >= min(budget, index.counts.sum())
    if got:
        assert held - index.counts[got[-1]] < budget
        assert all(sums[c] >= sums[got[-1]] for c in set(np.flatnonzero(index.counts).tolist()) - set(got))


def test_query_over_the_given_table(spark, sf):
    rows = q.queries()["op11_multi_index"](spark, sf).collect()
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    scores = {(a, c): s for a, _, c, s in all_pairs(vectors)}
    assert len(rows) == 50
    assert all(abs(scores[r.query_id, r.vec_id] - r.score) < 1e-12 for r in rows)


def all_pairs(vectors):
    matrix = np.array([v for _, v in vectors], np.float64)
    norms = np.sqrt((matrix**2).sum(axis=1))
    for i, (a, _) in enumerate(vectors):
        if a % 50 == 0:
            for j, (b, _) in enumerate(vectors):
                yield a, 0, b, float(matrix[i] @ matrix[j] / norms[i] / norms[j])
