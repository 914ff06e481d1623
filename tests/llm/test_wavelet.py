import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import wavelet as w

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return w.Encoder(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=300), st.integers(0, 70_000))
def test_shard_against_a_list(ids, token):
    shard = w.Shard(w.build(np.array(ids, np.uint32), [5, None], [len(ids), 0]))
    assert shard.ids().tolist() == ids
    assert [shard.access(i) for i in range(len(ids))] == ids
    for t in {token, *ids[:5]}:
        assert shard.count(t) == ids.count(t)
        assert list(shard.occurrences(t)) == [i for i, x in enumerate(ids) if x == t]
        assert shard.rank(t, len(ids) // 2) == ids[: len(ids) // 2].count(t)
    assert shard.documents()[0] == [5, None] and shard.documents()[1].tolist() == [len(ids), 0]


def test_many_blocks():
    rnd = np.random.default_rng(0)
    ids = np.minimum(rnd.zipf(1.3, 300_000), 50_000).astype(np.uint32)
    shard = w.Shard(w.build(ids, [1], [len(ids)]))
    assert (shard.ids() == ids).all()
    for i in rnd.integers(0, len(ids), 50).tolist():
        assert shard.access(i) == ids[i]
    for t in (1, 2, 17, 49_999):
        at = np.flatnonzero(ids == t)
        assert shard.count(t) == len(at)
        assert shard.count(t, 1000, 200_000) == int(((at >= 1000) & (at < 200_000)).sum())
        assert [shard.select(t, k) for k in range(0, len(at), max(1, len(at) // 5))] == at[:: max(1, len(at) // 5)].tolist()
    with pytest.raises(IndexError):
        shard.select(1, len(ids))


pieces = st.sampled_from([" ", "  ", "\n", "\n ", " \n", "\t", "a", "the", "'s", "don't", "'", "é,", "ñandú", "“", "A1b", "。", "k", " ", " ", "\x1c", "é", "漢字", "<|endoftext|>", "1234", "!", "'t", "_", "ÿ", "ª", "×", "ǅ", "ə", "́", "...", "😀", "\x85", "᠎", "​"])


@settings(max_examples=500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_pieces_encode_as_the_whole(encoder, text):
    assert np.frombuffer(encoder.encode(text), encoder.dtype).tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 0]


def brute(rows):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_tokens": 2000, "partition_bytes": 60_000}])
def test_documents_against_brute_force(spark, sf, sizes):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id * 3 - 50 doc_id", "text", "1 start")
    texts = [(1000, None), (1001, ""), (1000, "b"), (1000, "b"), (None, "x y"), (-99, "word " * 4000), (1002, "  \n "), (1003, "a  <|endoftext|>b<|endoftext|><|endoftext|> \n")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, start int")).repartition(5)
    got = [tuple(r) for r in w.encode_and_read(docs, PATH, **sizes).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    rows = docs.withColumn("mark", F.xxhash64("text")).collect()
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.mark))
    assert sorted(got, key=lambda r: r[1]) == brute([(r.doc_id, r.text) for r in rows])


def test_empty_table(spark):
    assert w.encode_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("n", [1, 3, 2000])
def test_rows_of_one_doc_id_take_many_files(spark, monkeypatch, n):
    monkeypatch.setattr(w, "SUM_PARTS", 2)
    docs = spark.range(n).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    manifest = w.write(docs, PATH, w.shared_dir(spark), partition_bytes=2_000)
    sizes = [r.n_docs for r in manifest.collect()]
    assert sum(sizes) == n and (n < 2000 or len(sizes) > 5 and max(sizes) < 600)
    got = sorted((r.start, r.n_tokens) for r in w.read(manifest).collect())
    assert [s for s, _ in got] == np.cumsum([0, *(t for _, t in got)])[:-1].tolist()
