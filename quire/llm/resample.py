"""Importance resampling of documents towards a target distribution, by hashed n-gram features.

Features are all runs of one to three consecutive words; a feature's bucket is a hash of its bytes. The gain of a bucket is the
log ratio of its smoothed shares in the target and in the documents; a document's weight is the sum of the gains over its
features, and its score adds Gumbel noise that is fixed by its doc_id, so that the highest scores are a sample drawn without replacement
with probabilities in proportion to exp(weight / 1000).

Method. Each piece of a partition (PIECE bytes of whole texts, a longer text alone) is a sequence of word ids with an end after each text. Its suffix
array, to the depth of three words, is one sort of packed ids. Where neighbours share their first n words their n-grams are one
run; a run's n-gram is hashed once and its bucket is scattered back to all places where it occurs. CRC-32 is linear, so a run's hash is put
together from the hashes of its words, without building its text.
Counting goes over the documents once and adds up run lengths: 10,000 buckets leave a task at most. Gains (10,000 numbers) go out with
the second pass, which sums them over each text's places. Neither pass shuffles texts. Ranks come from one range partitioning of the scores:
a row's rank is the rows of all partitions before its own, and its place there.

Defined cases: null and empty texts, and texts without a word, have no features and weight 0; fewer than `least_words` words are scored but can't
be drawn; a null doc_id has the noise of the text `42:null`; repeated rows count and are drawn each; equal scores are taken by ascending doc_id,
nulls first, and then by fewer features; an empty table of documents gives no rows; without target texts T and t are 0; extra columns are ignored
(`selected` hands them on); a long text is a piece of its own, in memory of ten to twenty times its bytes.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import LETTERS, column_bytes, gathered, id_and_text, longs, tidied, words, written

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of text that share one suffix array.
PIECE = 4 << 20
_BYTES = np.arange(256, dtype=np.uint32)


def _powers() -> list[np.ndarray]:
    """For k = 0, 1, ...: what 2**k zero bytes after it make of a CRC-32, as four tables by byte of the CRC."""
    step = _BYTES.copy()
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    values = np.stack([_BYTES << np.uint32(8 * j) for j in range(4)])
    out = [values >> np.uint32(8) ^ step[values & 0xFF]]
    for _ in range(31):
        out.append(_through(out[-1], out[-1]))
    return out


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 0xFF] ^ table[1][crc >> 8 & 0xFF] ^ table[2][crc >> 16 & 0xFF] ^ table[3][crc >> 24]


_POWERS = _powers()


def followed(crc: np.ndarray, after: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of texts put together: those with `crc`, then those with `after`, which have `length` bytes."""
    out = crc.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero(length >> k & 1)
        out[at] = _through(_POWERS[k], out[at])
    return out ^ after


class SuffixRuns:
    """The suffix array of word sequences to the depth of LONGEST words, and its runs of equal n-grams."""

    def __init__(self, texts: list[bytes]):
        distinct, place, self.n_words, _ = words(texts, gap=LETTERS)
        lengths = np.array([0, *map(len, distinct)], np.int64)
        alone = np.array([0, *map(zlib.crc32, distinct)], np.uint32)
        spaced = np.array([0, *(zlib.crc32(b" ", c) for c in alone[1:].tolist())], np.uint32)
        # 0 ends a text; words are numbered from 1
        ends = np.cumsum(self.n_words)
        sequence = np.concatenate([np.insert(place + 1, ends, 0), [0, 0]])
        at = np.flatnonzero(sequence)
        first, second, third = sequence[at], sequence[at + 1], sequence[at + 2]
        third = np.where(second == 0, 0, third)
        base = np.int64(len(distinct) + 1)
        pair = first * base + second
        if int(base) ** 3 >= 1 << 63:
            pair = np.unique(pair, return_inverse=True)[1]
        depth3 = pair * base + third
        self.order = np.argsort(depth3, kind="stable")
        first, second, third = first[self.order], second[self.order], third[self.order]
        differs = [x[1:] != x[:-1] for x in (first, second, third)]
        heads = np.zeros(len(first), bool)
        heads[:1] = True
        #: For each n: the run's first place in the suffix array, its length, its bucket (-1 where the text ends within the n words).
        self.runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n in range(LONGEST):
            heads[1:] |= differs[n]
            start = np.flatnonzero(heads)
            size = np.diff(start, append=len(first))
            a, b, c = first[start], second[start], third[start]
            crc = alone[a]
            if n == 1:
                crc = followed(spaced[a], alone[b], lengths[b])
            elif n == 2:
                crc = followed(followed(spaced[a], spaced[b], lengths[b] + 1), alone[c], lengths[c])
            whole = (a, b, c)[n] > 0
            self.runs.append((start, size, np.where(whole, (crc % np.uint32(BUCKETS)).astype(np.int64), -1)))

    def counts(self) -> np.ndarray:
        """Features of each bucket."""
        out = np.zeros(BUCKETS, np.int64)
        for _, size, bucket in self.runs:
            np.add.at(out, bucket[bucket >= 0], size[bucket >= 0])
        return out

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """For each text, the sum of gains over the buckets of its features."""
        total = np.zeros(len(self.order), np.int64)
        bucket = np.empty(len(self.order), np.int64)
        known = np.append(gains, 0)  # -1 takes the last
        for _, size, run in self.runs:
            bucket[self.order] = np.repeat(run, size)
            total += known[bucket]
        running = np.concatenate([[0], np.cumsum(total)])
        ends = np.cumsum(self.n_words)
        return running[ends] - running[ends - self.n_words]


def bucket_counts(docs: DataFrame) -> DataFrame:
    """bucket, n: features of each bucket over all texts; buckets without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in gathered(batches, PIECE):
            total += SuffixRuns(column_bytes(batch)).counts()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return id_and_text(docs).select("text").mapInArrow(tidied(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _text_only(target: DataFrame) -> DataFrame:
    return target.select(F.lit(None).cast("long").alias("doc_id"), "text")


def gains(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket."""
    both = bucket_counts(docs).withColumn("side", F.lit(0)).unionByName(bucket_counts(_text_only(target)).withColumn("side", F.lit(1)))
    found = np.zeros((2, BUCKETS))
    for bucket, n, side in both.collect():  # two rows a bucket at most
        found[side, bucket] = n
    s, t = found
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def noise(doc_id: Column) -> Column:
    """Gumbel noise in thousandths, fixed by the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def score(docs: DataFrame, gain: np.ndarray, *more: str) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, and the long columns `more` of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, PIECE):
            runs = SuffixRuns(column_bytes(batch))
            n = runs.n_words
            features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([longs(batch), pa.array(n), pa.array(features), pa.array(runs.sums(gain)), *(longs(batch, c) for c in more)], names=["doc_id", "n_words", "n_features", "weight", *more])

    rows = docs if more else id_and_text(docs)
    out = rows.mapInArrow(tidied(run), "doc_id long, n_words long, n_features long, weight long" + "".join(f", {c} long" for c in more))
    return out.withColumn("score", F.col("weight") + noise(F.col("doc_id")))


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of `scored` (a table that can be read again) with rank: 1, 2, ... for the drawn ones, null for the others."""
    able = F.coalesce(F.col("n_words"), F.lit(0)) >= least_words
    keys = [F.desc("score"), F.asc("doc_id"), F.asc("n_features")]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows that are equal in all that counts are told apart by chance, so that they needn't meet in one task
    dealt = scored.where(able).withColumn("apart", F.rand(SEED)).repartitionByRange(parts, *keys, F.asc("apart"))
    placed = written(dealt.drop("apart").sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "placed")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before, seen = [], 0
    for k, n in sorted(placed.groupBy(part.alias("part")).count().collect()):  # a row a partition
        before.append((k, seen))
        seen += n
    most = percent * seen // 100
    starts = scored.sparkSession.createDataFrame(before, "part long, before long")
    rank = F.col("before") + place + 1
    drawn = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= most, rank)).select(*scored.columns, "rank")
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words: a row for each row of `docs`; `target` has a column text."""
    scored = written(score(docs, gains(docs, target)), "scored")
    return ranked(scored).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def selected(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The drawn rows of `docs`, all columns. Rows that repeat both doc_id and text are drawn together."""
    key, gain = f"key_{uuid.uuid4().hex}", gains(docs, target)
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = id_and_text(docs).withColumn(key, hashed)
    drawn = ranked(written(score(rows, gain, key), "scored"), percent, least_words).where("rank is not null").select(key).distinct()
    return docs.withColumn(key, hashed).join(drawn, key, "left_semi").select(docs.columns)


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features(table: str, key: str) -> str:
    return f"""SELECT {key}, w, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]), list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
    FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}') AS w FROM {table})"""


#: CRC-32 byte by byte, with its table made by rule.
SQL = f"""
WITH RECURSIVE bits(b, k, c) AS (
    SELECT range, 0, range FROM range(256)
    UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM ({_features("documents", "doc_id")}) GROUP BY ALL),
b AS MATERIALIZED (SELECT f, count(*) AS n FROM ({_features("benchmark", "item_id")}) GROUP BY ALL),
features AS MATERIALIZED (
    SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(generate_series(1, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::BIGINT)),
        lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)])), 4294967295) % 10000 AS bucket
    FROM (SELECT f FROM d UNION SELECT f FROM b), crc),
docs AS MATERIALIZED (SELECT bucket, sum(n)::BIGINT AS s FROM d JOIN features USING (f) GROUP BY ALL),
target AS MATERIALIZED (SELECT bucket, sum(n)::BIGINT AS t FROM b JOIN features USING (f) GROUP BY ALL),
totals AS (SELECT (SELECT coalesce(sum(s), 0) FROM docs)::DOUBLE AS s_all, (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE AS t_all),
gains AS MATERIALIZED (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM docs LEFT JOIN target USING (bucket), totals),
sums AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM d JOIN features USING (f) JOIN gains USING (bucket) GROUP BY ALL),
scored AS (
    SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        len(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORDS}')) AS n_words,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents LEFT JOIN sums USING (doc_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * able // 100 THEN place END AS rank, n_words FROM placed
UNION ALL SELECT doc_id, n_features, weight, score, NULL, n_words FROM scored WHERE n_words < 20
"""
