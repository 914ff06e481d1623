"""Quality classifier without labels: overlapping heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller votes good, bad or nothing on a document. Over the counts of all vote patterns of the corpus, EM in the manner of Dawid
and Skene estimates, for each labeller, how often it gives each vote to good and to bad documents, and the share of
good ones; a pattern's posterior follows. There are 3^10 patterns at most, so the driver's share is bounded. The posteriors
of a bounded sample (`most_sample` rows at most, chosen by a hash of doc_id and text; rows alike in both once) label the training of
a logistic scorer over hashed word shapes, short words and repetitions. All documents are scored; those below THRESHOLD are rejected.
Texts are gone over once: votes and features (numbers above zero, in half precision) are written to the shared folder, and the rest reads those.

Defined cases: null and empty texts get the votes of a text without words, and are scored like it; a null doc_id is a row like
any other; with documents of one kind only, EM keeps its prior towards good; repeated rows count and are scored each; a score of
exactly THRESHOLD is accepted; an empty table gives no rows; extra columns are ignored (or passed on by `accept`, whatever
their names); a long text is held whole, in ten to twenty times its bytes.
"""

from __future__ import annotations

import re
import string
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quire.llm.common import column_bytes, slices, small_batches, tidied, words, written

MOST_SAMPLE = 8_000
DIMENSIONS = 1024
#: Bytes of text whose features are held at once, as full rows.
FEATURED_BYTES = 1 << 20
THRESHOLD = 0.5
#: Good votes that a bad one outweighs where EM begins. With so many, a document that two of them find bad begins as
#: bad, so that a group on which two that go together agree isn't taken for good ones; all rates are estimated from there.
START_BAD = 6.0
_SYMBOLS = b"#*$%&|<>^~{}[]\\_=+@"
_MARKS = string.punctuation.encode()
_EDGES = b".,;:!?\"'()"
#: Bytes of a character after its first.
_INNER = bytes(range(0x80, 0xC0))
#: Byte classes: capitals, other letters (and all beyond ASCII), digits; marks stand for themselves.
_CLASS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)

#: Frequent function words of the languages at hand.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that for was on with as at by from this be or an are a"
    " der die das und in zu den mit von ist ein eine nicht auf für als sich"
    " le la les de des et un une en que qui dans pour par sur au il elle"
    " el los las y del se con una su al lo como".split()
)
_FUNCTION = frozenset(w.encode() for w in FUNCTION_WORDS)

#: name, column of measures(), votes bad at or beyond, votes good at or within (larger is worse), fewest words to vote.
LABELLERS = (
    ("words_few", 0, -2.0, -10.0, 0),
    ("symbols", 1, 0.35, 0.05, 3),
    ("capitals", 2, 0.40, 0.10, 3),
    ("one_word", 3, 0.30, 0.18, 20),
    ("lines_again", 4, 0.35, 0.10, 3),
    ("marks", 5, 0.60, 0.30, 5),
    ("function_words", 6, -0.02, -0.08, 20),
    ("word_length", 7, 4.5, 3.0, 5),
    ("pairs_again", 8, 0.50, 0.20, 20),
    ("word_after_itself", 9, 0.30, 0.05, 10),
)
BAD, NOTHING, GOOD = 0, 1, 2


@lru_cache(maxsize=100_000)
def bucket(kind: str, x: bytes) -> int:
    return 8 + xxhash.xxh64_intdigest(kind.encode() + x, 3) % (DIMENSIONS - 8)


def shape(word: bytes) -> bytes:
    """The character classes of the whole word, the binary order of the number of their runs, and the length in steps of four (16 and more alike)."""
    runs = _RUN.sub(rb"\1", word.translate(_CLASS))
    return bytes(sorted(set(runs))) + bytes([255, len(runs).bit_length(), min(len(word), 16) // 4])


def measures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of the labellers' measures for each text, its hashed features)."""
    n = len(texts)
    distinct, ids, counts, _ = words(texts, lower=False)
    size = max(1, len(distinct))
    of = np.repeat(np.arange(n), counts)
    some = np.maximum(counts, 1)

    def mean(values: list[int]) -> np.ndarray:
        return np.bincount(of, np.array(values, float)[ids] if values else None, minlength=n) / some

    core = [w.lower().strip(_EDGES) for w in distinct]
    pair, often = np.unique(of * size + ids, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, pair // size, often)
    again, same = np.zeros(n), np.zeros(len(ids))
    if len(ids) > 1:
        both = of[1:] == of[:-1]
        same[1:] = (ids[1:] == ids[:-1]) & both
        if n * size * size < 1 << 62:
            key = (of[1:] * size + ids[:-1]) * size + ids[1:]
            seen = np.unique(key[both]) // (size * size)
        else:
            seen = np.unique(np.stack([of[1:][both], ids[:-1][both], ids[1:][both]]), axis=1)[0]
        again = 1 - np.bincount(seen, minlength=n) / np.maximum(counts - 1, 1)
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    repeated = np.array([1 - len(set(x)) / len(x) if x else 0.0 for x in lines])
    after_itself = np.bincount(of, same, minlength=n) / some
    m = np.stack([
        -counts.astype(float),
        mean([len(w) - len(w.translate(None, _SYMBOLS)) for w in distinct]),
        mean([len(w) > 1 and w.isupper() for w in distinct]),
        most / some,
        repeated,
        mean([len(w) - len(w.translate(None, _MARKS)) for w in distinct]),
        -mean([c in _FUNCTION for c in core]),
        np.abs(mean([len(w.translate(None, _INNER)) for w in distinct]) - 6.0),
        np.where(counts > 1, again, 0),
        after_itself,
    ], axis=1)
    first = [bucket("shape", shape(w)) for w in distinct]
    second = [bucket("word", c) if 0 < len(c) <= 3 else f for c, f in zip(core, first, strict=True)]
    x = sum(np.bincount(of * DIMENSIONS + np.array(b, np.int64)[ids], minlength=n * DIMENSIONS) if b else np.zeros(n * DIMENSIONS) for b in (first, second))
    x = np.sqrt(x.reshape(n, DIMENSIONS) / (2.0 * some[:, None]))
    x[:, :6] = np.stack([np.ones(n), np.minimum(np.log1p(counts) / 5, 1), after_itself, most / some, m[:, 8], repeated], axis=1)
    return m, x.astype(np.float32)


def votes(m: np.ndarray) -> np.ndarray:
    """A row of votes for each row of measures."""
    out = np.full((len(m), len(LABELLERS)), NOTHING)
    for k, (_, column, bad, good, fewest) in enumerate(LABELLERS):
        v = m[:, column]
        may = -m[:, 0] >= fewest
        out[may & (v >= bad), k] = BAD
        out[may & (v <= good), k] = GOOD
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v @ 3 ** np.arange(v.shape[1])


def unpack(p: np.ndarray) -> np.ndarray:
    return p[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good for each pattern, rates[class, labeller, vote] among votes cast, share of good)."""
    v = unpack(patterns)
    k = v.shape[1]
    good, bad = (v == GOOD).sum(1), (v == BAD).sum(1)
    # to begin with: one bad vote weighs as much as START_BAD good ones
    posterior = 1 / (1 + np.exp(-(good - START_BAD * bad)))
    rates, share = np.full((2, k, 3), 1.0), 0.5
    smooth = {BAD: (2.0, 0.2), GOOD: (1.0, 2.0)}  # towards labellers that are better than chance: votes added to (bad, good) documents
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        for c in (0, 1):
            cast = {vote: weight[c] @ (v == vote) + smooth[vote][c] for vote in (BAD, GOOD)}
            for vote in cast:
                rates[c, :, vote] = cast[vote] / (cast[BAD] + cast[GOOD])
        share = float((weight[1].sum() + 2) / (counts.sum() + 3))
        # a vote of NOTHING is missing, and says nothing (its rate stays 1)
        log = np.stack([np.log(rates[c][np.arange(k), v]).sum(axis=1) for c in (0, 1)])
        new = 1 / (1 + np.exp(np.clip(log[0] + np.log(1 - share) - log[1] - np.log(share), -500, 500)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior, rates, share


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the logistic scorer for soft labels, by Adam over the whole sample."""
    w, y, weight = np.zeros(x.shape[1], x.dtype), y.astype(x.dtype), weight.astype(x.dtype)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + ridge * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    posteriors: dict[int, float]
    rates: np.ndarray
    share: float

    def score(self, column: pa.Array) -> np.ndarray:
        """Of rows of features, as `sparse` writes them."""
        if not len(column):
            return np.zeros(0)
        entries, begins = entries_of(column)
        z = np.add.reduceat(self.weights.astype(float)[entries["at"]] * entries["value"], begins)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


ENTRY = np.dtype([("at", "<u2"), ("value", "<f2")])


def sparse(x: np.ndarray) -> pa.Array:
    """Each row's numbers above zero, as bytes. A row has its bias at least."""
    rows, at = np.nonzero(x)
    entries = np.empty(len(rows), ENTRY)
    entries["at"], entries["value"] = at, x[rows, at]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(x)))]) * ENTRY.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(x), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(entries.tobytes())]).cast(pa.binary())


def entries_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(entries of all rows, where each row's begin)."""
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), ENTRY), np.cumsum([0, *map(len, found)])[:-1] // ENTRY.itemsize


@dataclass(frozen=True)
class Featured:
    """Rows with their votes and features, written: `columns` as they came, then `added` (row hash, pattern, features)."""

    table: DataFrame
    columns: list[str]
    added: list[str]


def featured(docs: DataFrame, kept: list[str] | None = None) -> Featured:
    """`docs` has doc_id and text, and any other columns; those in `kept` (None: all) are written beside the features."""
    small_batches(docs.sparkSession)
    kept = docs.columns if kept is None else kept
    token = uuid.uuid4().hex
    added = [f"{kind}_{token}" for kind in ("row", "pattern", "features")]
    source = "text" if "text" in kept else f"text_{token}"
    read = [] if "text" in kept else [F.col("text").alias(source)]  # what the workers read and don't write
    skip = len(read)
    marked = docs.select(*read, *kept, F.xxhash64(F.col("doc_id"), F.col("text")).alias(added[0]))
    schema = StructType([*marked.schema.fields[skip:], StructField(added[1], LongType()), StructField(added[2], BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source, FEATURED_BYTES):
            m, x = measures(column_bytes(batch, source))
            yield pa.RecordBatch.from_arrays([*batch.columns[skip:], pa.array(pattern(votes(m))), sparse(x)], names=[*batch.schema.names[skip:], *added[1:]])

    return Featured(written(marked.mapInArrow(tidied(run), schema), "features"), kept, added)


def train(rows: Featured, most_sample: int = MOST_SAMPLE) -> Model:
    mark, voted, x = (F.col(c) for c in rows.added)
    found = rows.table.groupBy(voted.alias("pattern")).agg(F.count("*").alias("n")).orderBy("pattern").collect()
    patterns, counts = np.array([r.pattern for r in found], np.int64), np.array([r.n for r in found], np.int64)
    posterior, rates, share = expectation_maximisation(patterns, counts)
    posteriors = dict(zip(patterns.tolist(), posterior.tolist(), strict=True))
    if not len(found):
        return Model(np.zeros(DIMENSIONS), posteriors, rates, share)
    # twice as many hashes as are wanted, so that the limit, and not chance, sets the number
    part = min(1.0, 2 * most_sample / int(counts.sum()))
    chosen = rows.table.select(mark.alias("row"), voted.alias("pattern"), x.alias("x")).where(F.pmod("row", F.lit(1 << 30)) < int(part * (1 << 30)))
    sample = chosen.dropDuplicates(["row"]).orderBy(F.pmod("row", F.lit(1 << 30)), "row").limit(most_sample).toArrow()
    entries, begins = entries_of(sample["x"])
    dense = np.zeros((sample.num_rows, DIMENSIONS), np.float32)
    dense[np.repeat(np.arange(len(dense)), np.diff(begins, append=len(entries))), entries["at"]] = entries["value"]
    y = np.array([posteriors[p] for p in sample["pattern"].to_pylist()])
    rare = np.where(y >= 0.5, 1.0, min(20.0, max(1.0, (y >= 0.5).sum() / max(1, (y < 0.5).sum()))) ** 0.5)
    return Model(fit(dense, y, rare), posteriors, rates, share)


SCHEMA = "doc_id long, posterior double, score double, accepted boolean"


def judge(rows: Featured, model: Model) -> DataFrame:
    """One row per row: the labellers' posterior, the scorer's score, and whether it reaches THRESHOLD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                score = model.score(batch.column(2))
                known = [model.posteriors.get(p) for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(known, pa.float64()), pa.array(score), pa.array(score >= THRESHOLD)], names=["doc_id", "posterior", "score", "accepted"])

    return rows.table.select(F.col("doc_id").cast("long"), *rows.added[1:]).mapInArrow(run, SCHEMA)


def accept(rows: Featured, model: Model) -> DataFrame:
    """The rows, with the columns that they came with, that the scorer accepts."""
    accepted = F.pandas_udf(lambda x: pd.Series(model.score(pa.array(x, pa.binary())) >= THRESHOLD), "boolean")
    return rows.table.where(accepted(rows.added[2])).select(*rows.columns)
