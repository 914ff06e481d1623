import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from quire.llm import quality
from tests.llm.test_decontaminate import brute as leaked
from tests.llm.test_pii import added_brute
from tests.llm.test_pii import brute as base_spans
from tests.llm.test_quality import brute_measures, brute_score
from tests.llm.test_wide import plain_kept

SF = "/root/testdata/sf0.001"


def redacted(text):
    base = base_spans(text)
    out, at = "", 0
    for a, b, kind in sorted((a, b, k) for k, a, b in base + added_brute(text, base)):
        if a >= at:
            out += text[at:a] + f"<{kind.upper()}>"
        at = max(at, b)
    return out + text[at:]


def test_run_against_a_plain_version(spark):
    """The same stages on lists, from their descriptions, one document at a time; only the scorer's weights are the package's."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    weights = quality.train(quality.featured(docs)).weights
    rows = [(d, t) for d, t in rows if brute_score(t.encode(), brute_measures(t.encode()), weights) >= quality.THRESHOLD]
    keep = plain_kept(rows)
    rows = [(d, t) for d, t in rows if d in keep]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(d, t) for d, t in rows if not leaked(t, items)]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {d: library.encode(redacted(t)) for d, t in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 50 < len(got) < docs.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_pass_on_columns_with_clashing_names(spark, stage):
    """Extra columns named as the stages' own come through as they were."""
    extra = ["pattern", "fp", "text_key", "contaminated", "spans", "score", "key", "row", "block", "root", "_text_key", "n_words"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("doc_id", "text", "lang", "source", "n_chars", *(f"concat('{c}', doc_id) {c}" for c in extra))
    out = stage[1](spark, docs, SF)
    rows = out.collect()
    assert out.columns == docs.columns and rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        if name != "pieces":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_deduplication_of_repeated_and_unnamed_rows(spark):
    from quire.llm.wide import deduplicate

    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (None, "a b c d e"), (None, "z"), (3, "q r s t u v")]
    got = deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 0, 1, 3]


def test_deduplication_keeps_a_row_of_each_component_of_a_repeated_id(spark):
    from quire.llm.wide import deduplicate

    one, two, three = "a b c d e", "q r s t u v", "some other words stand in here"
    for rows, want in (
        ([(1, one), (1, two)], [(1, one), (1, two)]),  # two texts of one doc_id
        ([(1, one), (2, one), (2, two), (2, two)], [(1, one), (2, two)]),  # a copy and another text
        ([(5, three), (5, one), (3, one), (3, two), (4, two), (None, two)], [(3, one), (3, two), (5, three), (None, two)]),
    ):
        for order in (rows, rows[::-1]):
            got = deduplicate(spark.createDataFrame(order, "doc_id long, text string"))
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
