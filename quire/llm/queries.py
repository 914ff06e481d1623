"""The queries of this subpackage by name, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import chat, decontaminate, lm, neighbours, pieces, pii, quality, quality_rules, resample, search, simhash, toxicity, wavelet
from quire.llm.common import id_and_text, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    return chat.digests(chat.format_conversations(turns.unionByName(own)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op3_wavelet_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = lm.sliced(table(spark, sf_dir, "documents"))
    return lm.score(texts, lm.train(texts))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.featured(id_and_text(table(spark, sf_dir, "documents")), ["doc_id"])
    return quality.judge(rows, quality.train(rows))


def op10_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))


def op11_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op12_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_chat, op2_quality_rules, op3_wavelet_files, op4_decontaminate, op5_lm, op6_simhash, op7_toxicity, op8_pii, op9_quality, op10_pieces, op11_multi_index, op12_wand, op13_resample)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.SQL, "op12_wand": search.SQL, "op13_resample": resample.SQL}
