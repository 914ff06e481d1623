import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import wide

FULL = (1 << 64) - 1


def mix(x):
    x = (x + 0x9E3779B97F4A7C15) & FULL
    x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & FULL
    x = ((x ^ x >> 27) * 0x94D049BB133111EB) & FULL
    return x ^ x >> 31


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def plain_fingerprint(text):
    """Eight words, bit by bit."""
    hashes = []
    for s in shingles(text):
        h = 0
        for w in s:
            h = mix((h * 0x9E3779B97F4A7C15 + mix(xxhash.xxh64_intdigest(w.encode(), 5))) & FULL)
        hashes.append(h)
    out = []
    for k in range(8):
        mixed = [mix(h ^ k * 0x5851F42D4C957F2D & FULL) for h in hashes]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)))
    return out


def plain_links(a, b, ta, tb):
    if a == b:
        return True
    words, segments = wide.layout(0)
    apart = [(x ^ y).bit_count() for x, y in zip(a, b)]
    agree = any((((x ^ y) >> first) & (1 << width) - 1).bit_count() <= 1 for x, y in zip(a[:words], b) for first, width in segments)
    if not agree or sum(apart[:2]) > wide.NARROW or sum(apart) > wide.MOST:
        return False
    x, y = set(shingles(ta)), set(shingles(tb))
    return len(x & y) >= 0.8 * len(x | y)


def plain_kept(rows):
    """doc_ids (all different) of the least document of each component, by comparing all."""
    fps = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and plain_links(fps[i], fps[j], rows[i][1], rows[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return set(least.values())


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def test_fingerprints_bit_by_bit():
    texts = ["", " \n", "One two", "a b c d e", "A b\tc d E f", "word " * 300, "é ü ñ " * 9 + "x"]
    got = wide.fingerprints([t.encode() for t in texts])
    # packbits puts the first bit of each byte on top; bits are numbered per word from the hash's own bytes
    for t, g in zip(texts, got):
        assert [int(x) for x in g] == [int.from_bytes(w.to_bytes(8, "little"), "little") for w in plain_fingerprint(t)], t


@pytest.mark.parametrize("block", [1024, 5])
def test_near_copies_against_all_pairs(spark, block):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        words = rnd.choices(vocab, k=rnd.randint(150, 400))
        rows.append(" ".join(words))
        rows += [edited(words, rnd, n) for n in (1, 2, 3, 5, 8, 15)]
    words = rnd.choices(vocab, k=300)
    rows += [edited(words, rnd, 2) for _ in range(40)]  # one large group
    rows += ["", " ", None, "one", "One", "a b c d e", "a b c d e"]
    rnd.shuffle(rows)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, node string")
    out = wide.deduplicate(docs, block)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == plain_kept(list(enumerate(rows)))


def test_recall_at_a_similarity(spark):
    """Pairs well above 0.8 are found, unrelated texts and halves in common stay."""
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(5000)]
    rows, n = [], 60
    for k in range(n):
        words = rnd.choices(vocab, k=500)
        rows += [(3 * k, " ".join(words)), (3 * k + 1, edited(words, rnd, 5)), (3 * k + 2, " ".join(words[:250] + rnd.choices(vocab, k=250)))]
    kept = {r.doc_id for r in wide.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(3 * k in kept and 3 * k + 2 in kept for k in range(n))
    assert sum(3 * k + 1 not in kept for k in range(n)) >= 0.9 * n


def test_least_spanning_forests():
    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 1 << 63, (1, 2)).astype(np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, (30, 2)).astype(np.uint64)), rnd.integers(0, 1 << 63, (10, 2)).astype(np.uint64)])
    found = wide.forests(fps)
    assert len(found) == wide.FORESTS
    seen = set()
    for k, (a, b) in enumerate(found):
        assert (wide.distance(fps[a], fps[b]) <= wide.NARROW).all() and set(a) | set(b) <= set(range(30))
        assert k or len(a) == 29 and set(a) | set(b) == set(range(30))
        edges = {frozenset(e) for e in zip(a.tolist(), b.tolist())}
        assert len(edges) == len(a) and not edges & seen
        seen |= edges


@pytest.mark.parametrize("changed", [3, 4])
def test_a_failed_edge_parts_nothing(spark, changed):
    """Groups of texts around the threshold: what links stays together, however the trees run."""
    rnd = random.Random(changed)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(25):
        words = rnd.choices(vocab, k=300)
        rows += [edited(words, rnd, rnd.randint(changed, changed + 1) * 2) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in wide.deduplicate(docs).collect()} == plain_kept(list(enumerate(rows)))


def exact_pairs(texts, least=0.8):
    """All pairs of different shingle sets at `least` or more, by prefixes in the order of how rare shingles are."""
    sets = {}
    for d, t in texts:
        sets.setdefault(frozenset(map(hash, shingles(t))), d)
    sets = {d: s for s, d in sets.items() if s}
    count = Counter(x for s in sets.values() for x in s)
    index, out = {}, {}
    for d, s in sorted(sets.items(), key=lambda x: len(x[1])):
        prefix = sorted(s, key=lambda x: (count[x], x))[: len(s) - math.ceil(least * len(s)) + 1]
        for e in {e for x in prefix for e in index.get(x, ())}:
            if len(sets[e]) >= least * len(s):
                both = len(s & sets[e])
                if both >= least * (len(s) + len(sets[e]) - both):
                    out[e, d] = both / (len(s) + len(sets[e]) - both)
        for x in prefix:
            index.setdefault(x, []).append(d)
    return out


def test_recall_on_the_given_documents(spark):
    """Against an exact join: of the pairs of different shingle sets at 0.8 or more, nine in ten are one component."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    pairs = exact_pairs([(r.doc_id, r.text) for r in docs.collect()])
    assert len(pairs) > 30
    keyed = docs.where("doc_id is not null")
    rows = wide.fingerprint_rows(keyed)
    classes = wide.written(rows.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("least"), F.min("wide").alias("wide")))
    root = {r.node: r.root for r in wide.rooted(classes, keyed).collect()}
    of = {r.doc_id: root[r.node] for r in rows.select("doc_id", "node").collect()}
    found = sum(of[a] == of[b] for a, b in pairs)
    print("pairs", len(pairs), "linked", found, sorted(round(s, 2) for (a, b), s in pairs.items() if of[a] != of[b]))
    assert found >= 0.9 * len(pairs)


def test_similarity_of_sketches():
    words = [f"w{i}" for i in range(4000)]
    a, b = " ".join(words), " ".join(words[400:] + [f"v{i}" for i in range(400)])
    exact = lambda x, y: len(set(shingles(x)) & set(shingles(y))) / len(set(shingles(x)) | set(shingles(y)))
    assert abs(wide.similarity(wide.sketch(a.encode()), wide.sketch(b.encode())) - exact(a, b)) < 0.05
    a, b = " ".join(words[:500]), " ".join(words[50:520])
    assert wide.similarity(wide.sketch(a.encode()), wide.sketch(b.encode())) == exact(a, b)
    assert wide.similarity(b"", b"") == 1.0


def test_keys_through_a_shuffle_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(wide, "MOST_BROADCAST", 0)
    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, long), (1, long), (2, long + " more"), (None, long), (None, None), (3, None), (4, ""), (5, "other"), (5, long + " more words")]
    got = wide.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, long), (1, long), (3, ""), (5, "other")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert wide.deduplicate(empty).count() == 0


def test_rows_that_repeat_id_and_text(spark):
    """The one with the least columns stays, whatever the order."""
    rows = [(1, "same text here and more", c, n) for c, n in (("b", 2), ("a", 3), ("a", 1))]
    for part in (rows, rows[::-1]):
        got = wide.deduplicate(spark.createDataFrame(part, "doc_id long, text string, kind string, n int").repartition(3)).collect()
        assert [tuple(r) for r in got] == [(1, "same text here and more", "a", 1)]


def test_keys_are_the_same_at_any_size():
    """What is found in a small table is found in a large one."""
    assert wide.layout(1 << 30) == wide.layout(0)


def test_links_beyond_the_forests_are_found():
    """Of a key's links that its forests don't have, those whose ends are apart come out, whatever the blocks that hold them."""
    import pyarrow as pa

    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, (1, 2)).astype(np.uint64)
    fps = np.concatenate([base ^ (np.uint64(1) << rnd.integers(0, 64, (150, 2)).astype(np.uint64)), rnd.integers(0, 1 << 63, (20, 2)).astype(np.uint64)])
    nodes, roots = np.arange(170) * 7, np.arange(170) % 3
    keys = np.repeat([4, 9], 85)
    edges, more = wide._grouped(keys, nodes, fps)
    assert len(more) > 100 and set(fps[more][:, 0].tolist()) <= set(fps[:150, 0].tolist())
    words = fps.view(np.int64)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (keys, nodes, words[:, 0], words[:, 1], roots)], names=["pair", "node", "w0", "w1", "root"])
    pieces = [batch.slice(k, 33) for k in range(0, 170, 33)]
    got = [(a, b) for out in wide.links_apart(iter(pieces)) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    want = {(int(nodes[x]), int(nodes[y])) for x in range(170) for y in range(x + 1, 170) if keys[x] == keys[y] and roots[x] != roots[y] and wide.distance(fps[x], fps[y]) <= wide.NARROW}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > len(edges[0])


def test_pairs_that_fail_are_no_rows(spark, monkeypatch):
    """Many texts close by their fingerprints, most of them not similar enough: the last step's rows don't grow with the square of their number, and all links are found."""
    rnd = random.Random(8)
    rows = []
    for k in range(300):
        words = [f"w{i}" for i in range(60)]
        words[6 + 3 * (k % 16)] = f"new{rnd.randrange(10**6)}"
        rows.append(" ".join(words))
    made = {}

    def counted(df, name="table", write=wide.written):
        out = write(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(wide, "written", counted)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r.doc_id for r in wide.deduplicate(docs).collect()} == plain_kept(list(enumerate(rows)))
    assert made["candidates"] > 3000 and made["others"] <= 300, made


@pytest.mark.parametrize("long", [60, 1500])
def test_links_apart_against_all_pairs(long):
    """similar_apart joins what all pairs join, and no more, within a block and across two, with texts beyond the sketch too."""
    rnd = random.Random(long)
    texts = []
    for _ in range(3):
        words = rnd.choices([f"v{i}" for i in range(5000)], k=long)
        texts += [edited(words, rnd, rnd.randint(0, long // 28)).encode() for _ in range(20)]
    fps, sketched = wide.fingerprints(texts), [wide.sketch(t) for t in texts]
    roots = np.arange(60) // 2
    for side in (np.zeros(60, np.int64), np.arange(60) % 3 // 2):
        linked = lambda x, y: plain_links([int(w) for w in fps[x]], [int(w) for w in fps[y]], "", "") and wide.similarity(sketched[x], sketched[y]) >= 0.8  # noqa: B023, E731
        across = [(x, y) for x in range(60) for y in range(x) if not side.any() or side[x] != side[y]]
        want, got, order = list(roots), list(roots), wide.similar_apart(roots, side, fps, sketched)
        for of, pairs in ((want, [p for p in across if linked(*p)]), (got, list(zip(*map(list, order), strict=True)))):
            for x, y in pairs:
                of[:] = [of[x] if r == of[y] else r for r in of]
        least = lambda of: [of.index(r) for r in of]
        assert least(got) == least(want) and 0 < len(order[0]) < 30 and len(set(want)) > 3


def test_members_of_keys(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(key, node, node % 7) for key in range(60) for node in rnd.sample(range(200), 30)]
    keys = rnd.sample(range(60), 20)
    have, wanted = spark.createDataFrame(rows, "key long, node long, root long"), spark.createDataFrame([(k,) for k in keys], "key long")
    want = sorted({(node, root) for key, node, root in rows if key in keys})
    for parts in (1, 4, 16, 1000):
        monkeypatch.setattr(wide, "PARTS", parts)
        assert sorted(tuple(r) for r in wide.members_of(have, wanted).collect()) == want
    assert wide.members_of(have, wanted.limit(0)).count() == 0
