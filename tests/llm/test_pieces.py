import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import pieces as p

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def fst():
    return p.Transducers(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


some = st.one_of(
    st.sampled_from([" ", "  ", "    ", "the", "ing", "ation", "\n", "\t", "▁", "é", "漢", "😀", "1", "2024", "ß", "aaa", "aaaa", "ooo", "--", "....", "://", "é", "\x00", "Ａ"]),
    st.text(alphabet="aeinorstlh ", max_size=12),
    st.text(max_size=6),
)


@settings(max_examples=600, deadline=None)
@given(st.lists(some, max_size=10).map("".join))
def test_encodes_and_decodes_as_the_library(fst, library, text):
    text = text.encode("utf-8", "replace").decode()
    ids = np.frombuffer(fst.encode(text), fst.dtype).tolist()
    assert ids == library.encode(text)
    assert fst.decode(np.array(ids, fst.dtype)) == text.replace("▁", " ")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="▁aeinorstlh'sé", min_size=1, max_size=14))
def test_one_state_a_place_is_enough(fst, text):
    assert fst.shortest(text) == fst.shortest_of_all(text)


def test_a_text_without_a_path_is_an_error():
    fst = p.Transducers(PATH)
    fst.follows = lambda a, b: False
    with pytest.raises(ValueError, match="no path"):
        fst.encode("thethethe")


def test_the_normaliser_is_the_models(library):
    assert p.Normaliser.of(library.serialized_model_proto())(b"a b") == "▁a▁b".encode()
    settings = lambda *pairs: bytes([3 << 3 | 2, 2 * len(pairs)]) + b"".join(bytes([n << 3, v]) for n, v in pairs)
    assert p.Normaliser.of(settings((3, 0), (4, 0)))(b" a") == "▁a".encode()
    for refused in (settings((4, 1)), settings((4, 0), (5, 0)), bytes([3 << 3 | 2, 5, 2 << 3 | 2, 1, 65, 4 << 3, 0])):
        with pytest.raises(ValueError, match="normaliser"):
            p.Normaliser.of(refused)


def test_corpus_words_as_the_library(fst, library, sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    for text in texts:
        assert np.frombuffer(fst.encode(text), fst.dtype).tolist() == library.encode(text)


def test_rows(spark, library):
    texts = [None, "", " ", "a▁b", "x" * 20_000, "word " * 3000, "same", "same"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_pieces int")
    got = {r.doc_id: r for r in p.encode(docs, PATH).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "")
        assert (got[i].n_pieces, got[i].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert got[i].exact == ("▁" not in (t or ""))
    assert {r.doc_id: list(r.ids) for r in p.encoded(docs, PATH).collect()} == {i: library.encode(t or "") for i, t in enumerate(texts)}


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert p.encode(none, PATH).count() == 0 and p.encoded(none, PATH).count() == 0
