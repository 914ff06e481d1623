import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import simhash as s


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: (doc_id, fp) -> component of each, by comparing all."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        least[find(i)] = min(d, least.get(find(i), d))
    return [least[find(i)] for i in range(len(fps))]


TEXTS = [None, "", " \n\t", "One", "one", "a b c", "a b c d", "A B C D", "é Ñ ü x y", "word " * 3000, "a b c d a b c d a b c d", " a b c d e f", "x" * 50_000]


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 100 doc_id", "text", "'x' fp", "1 component_id")
    docs = docs.unionByName(spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp string, component_id int"))
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = {d: (f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in s.near_duplicates(docs).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("block", [1024, 5])
def test_links_of_planted_fingerprints(spark, block):
    """Chains, dense balls and random ones; with a small block, hot keys are dealt to pairs of blocks."""
    rnd = random.Random(3)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for base in fps[:4]:
        fps += [base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(25)]
    x = fps[5]
    for _ in range(25):  # a chain: each differs from the one before in 4 bits or 5
        for b in rnd.sample(range(64), rnd.choice([4, 4, 4, 5])):
            x ^= 1 << b
        fps.append(x)
    rows = [(i, f) for i, f in enumerate(fps + fps[:10])]
    rnd.shuffle(rows)
    want = dict(zip([d for d, _ in rows], brute_components(rows)))
    df = spark.createDataFrame([(d, f - (1 << 64) if f >> 63 else f) for d, f in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in s.link(df, block).collect()}
    assert got == want


def test_search_deals_large_keys_to_blocks_across_batches():
    keys = np.array([1] * 3 + [2] * 11 + [3] * 4 + [4] * 6 + [5])
    fps = np.arange(len(keys)).astype(np.int64) * 1000003
    for size in (1, 2, 3, 5, 7, 25):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(fps[i : i + size])], names=["key", "fp"]) for i in range(0, len(keys), size)]
        rows = [r for b in s.search(iter(batches), 4) for r in b.to_pylist() if r["key"] is not None]
        assert sorted((r["key"], r["a"], r["block"]) for r in rows) == [(k, int(fps[i]), (i - np.flatnonzero(keys == k)[0]) // 4) for i, k in enumerate(keys) if k in (2, 4)]


def test_empty_table_and_null_ids(spark):
    assert s.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = s.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "q")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.component_id or -1) for r in got) == [(False, 7), (True, -1), (True, 7)]


def test_components_of_few_edges_are_few_tasks(spark):
    from random import Random

    r = Random(3)
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(200)] + [(7, 7)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        before = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "48")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        given = spark.createDataFrame(edges, "a long, b long").repartition(5)
        spark.sparkContext.setJobGroup("components", "components")
        out = s.components(given)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        got = [tuple(x) for x in out.select("a", "b").collect()]
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(got) == sorted((x, m) for x, m in least.items() if x != m)
    status = spark.sparkContext.statusTracker()
    stages = {k for j in status.getJobIdsForGroup("components") for k in status.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)
    print("tasks", tasks)
    assert tasks < 1000  # 4,000 with a task for each shuffle partition
