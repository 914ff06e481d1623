"""Ranked lexical search of a set of items over all documents: weak-AND with one heap an item and shard.

A document's score is the sum over the item's terms of the term's weight (by how few documents hold it) times an impact that grows with its
occurrences, less in long documents; all in integers, as the contract of op12 has it.

Method. A shard is SHARD bytes of whole texts of a partition (a longer text alone). Its postings (documents ascending, an impact each) and every
term's greatest impact are made in memory. For an item, cursors on its terms' postings are kept in order of their documents; the first
cursor at which the sum of greatest contributions reaches the heap's least score is the pivot, and cursors before it jump to the pivot's
document, so documents that can't get into the heap are passed over unread. A task's heaps go on from shard to shard, with the threshold that they
have reached; the tasks' heaps are merged in two steps, by item and a hash of the document, then by item.
The statistics (N, L, df of the items' terms) come from one pass before that, a number a term and task. Texts are never shuffled or written.

Items reach the tasks by a broadcast of ITEMS_BYTES of item text at most. More items are dealt to blocks of that size by hash, each of which goes over the
documents: cost is documents times blocks. A single longer item is a block's, whole.

Defined cases: null and empty texts, and texts without a term, are in no result and not counted in N; identical rows of the items are one item, and the
texts of one item_id are ranked each for itself; a null item_id is carried; repeated documents are ranked each; equal scores are by ascending doc_id, nulls last;
a term that all documents hold has weight 0; empty tables give no rows; extra columns are ignored; a long text is a shard of its own, in memory
of ten to twenty times its bytes.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import LETTERS, column_bytes, gathered, id_and_text, longs, tidied, words

MOST = 20
#: Bytes of text in a shard; bytes of item text that are broadcast at once; parts of the first merge of an item's heaps.
SHARD = 4 << 20
ITEMS_BYTES = 4 << 20
PARTS = 64
#: Stands for a missing doc_id in heaps, after all others.
NO_ID = np.iinfo(np.int64).max


@dataclass
class Items:
    """A block of items: place of each distinct term; for each item its key, its terms' places and how often each occurs."""

    vocabulary: dict[bytes, int]
    keys: list[int]
    terms: list[list[int]]
    repeats: list[list[int]]
    weights: list[int] | None = None

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        distinct, place, n, _ = words([t.encode() for _, t in rows], gap=LETTERS)
        ends = np.cumsum(n)
        found = [np.unique(place[e - k : e], return_counts=True) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        return cls({w: i for i, w in enumerate(distinct)}, [k for k, _ in rows], [t.tolist() for t, _ in found], [c.tolist() for _, c in found])


class Postings:
    """The occurrences of known terms in some texts, and the words of each."""

    def __init__(self, texts: list[bytes], vocabulary: dict[bytes, int]):
        distinct, place, self.n_words, _ = words(texts, gap=LETTERS)
        known = np.fromiter((vocabulary.get(w, -1) for w in distinct), np.int64, len(distinct))
        term = known[place]
        text = np.repeat(np.arange(len(texts)), self.n_words)[term >= 0]
        # ascending by term, then by text
        both, self.tf = np.unique(term[term >= 0] * max(len(texts), 1) + text, return_counts=True)
        self.term, self.text = np.divmod(both, max(len(texts), 1))
        self.starts = np.flatnonzero(np.diff(self.term, prepend=-1))
        self.df = np.diff(self.starts, append=len(self.term))

    def lists(self, n_docs: int, n_words: int) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
        """For each term: its texts, ascending, their impacts, and the greatest of these."""
        m = 100 - 25 + 25 * self.n_words * n_docs // max(n_words, 1)
        impact = 1_000_000_000 * self.tf // (1000 * self.tf + 12 * m[self.text])
        most = np.maximum.reduceat(impact, self.starts) if len(self.starts) else impact
        ends = self.starts + self.df
        return {t: (self.text[a:b], impact[a:b], top) for t, a, b, top in zip(self.term[self.starts].tolist(), self.starts.tolist(), ends.tolist(), most.tolist(), strict=True)}


def weak_and(lists: list[tuple[list[int], list[int], int, int]], names: list[int], heap: list[tuple[int, int]], most: int = MOST) -> None:
    """lists: (texts ascending, impacts, factor, greatest contribution) of each term. names: each text's doc_id. Puts (score, -doc_id) into the heap of the `most` best.

    A text that ties with the heap's least may still come before it by its doc_id, so bounds that equal the threshold are not passed over.
    """
    cursors = [[texts[0], 0, texts, impacts, factor, bound] for texts, impacts, factor, bound in lists]
    cursors.sort(key=lambda c: c[0])
    while cursors:
        least = heap[0][0] if len(heap) == most else 1
        reach = pivot = 0
        for pivot, c in enumerate(cursors):  # noqa: B007
            reach += c[5]
            if reach >= least:
                break
        else:
            return
        target = cursors[pivot][0]
        if cursors[0][0] == target:
            score = moved = 0
            for c in cursors:
                if c[0] != target:
                    break
                score += c[4] * c[3][c[1]]
                c[1] += 1
                moved += 1
            entry = (score, -names[target])
            if score > 0 and len(heap) < most:
                heapq.heappush(heap, entry)
            elif score > 0 and entry > heap[0]:
                heapq.heapreplace(heap, entry)
        else:
            moved = 0
            for c in cursors:
                if c[0] == target:
                    break
                c[1] = bisect_left(c[2], target, c[1])
                moved += 1
        ended = False
        for c in cursors[:moved]:
            if c[1] < len(c[2]):
                c[0] = c[2][c[1]]
            else:
                ended = True
                c[0] = -1
        if ended:
            cursors = [c for c in cursors if c[0] >= 0]
        cursors.sort(key=lambda c: c[0])


def statistics(docs: DataFrame, items: Items) -> tuple[int, int, np.ndarray]:
    """(N, L, df of each of the items' terms) over all documents."""
    terms = len(items.vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms + 2, np.int64)
        for batch in gathered(batches, SHARD):
            found = Postings(column_bytes(batch), sent.value)
            total[found.term[found.starts]] += found.df
            total[terms:] += [np.count_nonzero(found.n_words), found.n_words.sum()]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    out = np.zeros(terms + 2, np.int64)
    for term, n in id_and_text(docs).mapInArrow(tidied(run), "term long, n long").groupBy("term").agg(F.sum("n")).collect():  # a row a term of the items
        out[term] = n
    return int(out[terms]), int(out[terms + 1]), out[:terms]


def best(docs: DataFrame, items: Items, n_docs: int, n_words: int, most: int = MOST) -> DataFrame:
    """item (its key), doc_id, score: each task's heaps."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in items.keys]
        for batch in gathered(batches, SHARD):
            names = longs(batch).fill_null(NO_ID).to_pylist()
            found = Postings(column_bytes(batch), items.vocabulary).lists(n_docs, n_words)
            plain = {}  # as lists, which cursors step through faster
            for heap, terms, repeats in zip(heaps, items.terms, items.repeats, strict=True):
                lists = []
                for t, r in zip(terms, repeats, strict=True):
                    factor = r * items.weights[t]
                    if t in found and factor:
                        if t not in plain:
                            plain[t] = found[t][0].tolist(), found[t][1].tolist()
                        lists.append((*plain[t], factor, factor * found[t][2]))
                weak_and(lists, names, heap, most)
        out = [(k, -i, s) for k, heap in zip(items.keys, heaps, strict=True) for s, i in heap]
        item, doc_id, score = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([None if i == NO_ID else i for i in doc_id], pa.int64()), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return id_and_text(docs).mapInArrow(tidied(run), "item long, doc_id long, score long")


def first_of(rows: DataFrame, by: list[str | Column], most: int) -> DataFrame:
    """The `most` first rows of each group, with their rank."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def rank(docs: DataFrame, items: DataFrame, most: int = MOST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's `most` best documents, of the items (item_id, text)."""
    rows = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEMS_BYTES))
    found = []
    for k in range(blocks):
        own = rows.where(F.pmod("item", F.lit(blocks)) == k)
        block = Items.of([(r.item, r.text) for r in own.collect()])  # about ITEMS_BYTES
        n_docs, n_words, df = statistics(docs, block)
        block.weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
        found.append(best(docs, block, n_docs, n_words, most))
    heaps = reduce(DataFrame.unionByName, found)
    parted = first_of(heaps.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))), ["item", "part"], most)
    ranked = first_of(parted, ["item"], most)
    return ranked.join(rows.select("item", "item_id"), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _terms(table: str, key: str) -> str:
    return f"SELECT {key}, translate(unnest(regexp_extract_all(text, '{_TERMS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM {table}"


SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM ({_terms("documents", "doc_id")}) GROUP BY ALL),
b AS MATERIALIZED (SELECT item_id, term, count(*) AS repeats FROM ({_terms("benchmark", "item_id")}) GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM d GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_words FROM lengths),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * n_docs) // n_words) AS m FROM lengths, totals),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM d WHERE term IN (SELECT term FROM b) GROUP BY ALL), totals),
scored AS (SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM b JOIN weights USING (term) JOIN d USING (term) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 20
"""
