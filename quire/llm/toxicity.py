"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words, parted by white space, become symbols: insult (four strengths), threat, target, negation, report, other; a quotation mark, straight or not, at
a word's beginning is a symbol of its own before the word's, which no reach counts. A clause, which ends
at a punctuation mark or a newline, passes through a cascade of letter-to-letter transducers. The first reads it from its end:
  addressed  an insult or threat with a person within four words after it becomes its targeted form
What it writes, a machine composed of the others reads from the beginning:
  negation   an insult or threat within three words after a negation becomes its negated form
  report     one after a verb of reporting or a quotation mark in the same clause becomes its reported form
  target     one with a person within four words before it becomes its targeted form
  score      writes each form's weight
so `you are an idiot` weighs more than `idiot`, `he is not an idiot` or `they said idiot` weigh less, and `kill you` or `you I will kill`
is a threat, `kill the process` none. A clause weighs the sum of its words' weights, and a document's score is a logistic function
of its clauses: the strongest, the sum, and how many weigh anything.

Function words are fixed lists. Insults are learned from labelled rows: words and word beginnings that occur in far more
toxic texts than others (in LEAST_TEXTS toxic texts or more); near copies among the labelled rows count once. The logistic function
is fitted to the same rows. Learning takes at most `most_labelled` labelled rows of `most_bytes` bytes at most, those with the smallest
hashes of doc_id and then of the text, which bounds what the driver holds; scoring takes all rows and whole texts.

Defined cases: null and empty texts have no clauses and get the score of a text in which nothing matches; a null doc_id isn't held out
and isn't learned from; with no labelled rows, or none of a label, no insults are known and scores rest on a fixed prior; a doc_id
with both labels counts as toxic; repeated rows are scored each; a score of exactly 0.3 predicts 1; an empty table gives no
rows; extra columns are ignored; a long text is held whole, in ten to twenty times its bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_bytes, id_and_text, longs, slices, tidied, words

#: Bounds of what is learned from: labelled rows, and bytes of a text.
MOST_LABELLED = 8_000
MOST_BYTES = 32 << 10
#: Toxic texts that a word must occur in.
LEAST_TEXTS = 5
THRESHOLD = 0.3

#: The closed word classes of the grammar.
THREATS = frozenset("kill hurt destroy shoot stab burn beat hang murder die töten umbringen tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours you're u he she they him her them his their all everyone this these du dich dein ihr euch tu te toi vous ton tus usted ustedes ellos".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't don't doesn't won't cannot without nicht kein keine nie pas jamais ni nunca sin".split())
REPORTS = frozenset("said says say told wrote writes quoted quotes called calling according claimed reported asked sagte schrieb dit dijo".split())

OTHER, TARGET, NEGATION, REPORT, MARK, THREAT, INSULT = 0, 1, 2, 3, 4, 5, 6
LEVELS = 4
#: Input symbols: the closed classes, then an insult of each strength.
SYMBOLS = INSULT + LEVELS
_CORE = re.compile(r"^[^\w]+|[^\w]+$")
_OPENS = re.compile(r"^[^\w]*[\"“„«][^\w]*\w")
_ENDS = re.compile(r"[.,;:!?…|)\"”»]+$")


@dataclass(frozen=True)
class Transducer:
    """A sequential letter-to-letter transducer: to[state][symbol], out[state][symbol]; state 0 begins."""

    to: tuple[tuple[int, ...], ...]
    out: tuple[tuple[float, ...], ...]

    def __matmul__(self, other: Transducer) -> Transducer:
        """The composition: what this writes, the other reads. States are made as they are reached."""
        states, todo = {(0, 0): 0}, [(0, 0)]
        to, out = [], []
        for a, b in todo:
            row_to, row_out = [], []
            for x in range(len(self.to[a])):
                y = int(self.out[a][x])
                after = (self.to[a][x], other.to[b][y])
                if after not in states:
                    states[after] = len(states)
                    todo.append(after)
                row_to.append(states[after])
                row_out.append(other.out[b][y])
            to.append(tuple(row_to))
            out.append(tuple(row_out))
        return Transducer(tuple(to), tuple(out))


# Forms: a hot symbol (threat or insult) carries three flags through the cascade, as symbol + SYMBOLS * flags.
NEGATED, REPORTED, TARGETED = 1, 2, 4
FORMS = SYMBOLS * 8


def _hot(symbol: int) -> bool:
    return symbol % SYMBOLS >= THREAT


def _marker(after: tuple[int, ...], reach: int | None, flag: int) -> Transducer:
    """Sets a flag on hot symbols within `reach` symbols, marks aside, after a symbol of a kind in `after` (None: up to the clause's end)."""
    n = 1 if reach is None else reach
    to, out = [], []
    for state in range(n + 1):  # state: how much reach is left
        to.append(tuple(n if x % SYMBOLS in after else (state if reach is None or x % SYMBOLS == MARK else max(0, state - 1)) for x in range(FORMS)))
        out.append(tuple(x + SYMBOLS * flag if state and _hot(x) and not x // SYMBOLS & flag else x for x in range(FORMS)))
    return Transducer(tuple(to), tuple(out))


def _scorer(strengths: tuple[float, ...]) -> Transducer:
    def weight(form: int) -> float:
        flags, symbol = divmod(form, SYMBOLS)
        if symbol < THREAT:
            return 0.0
        base = 1.5 if symbol == THREAT and flags & TARGETED else 0.0 if symbol == THREAT else strengths[symbol - INSULT]
        return base * (0.5 if flags & NEGATED else 1) * (0.7 if flags & REPORTED else 1) * (1.25 if flags & TARGETED else 1)

    return Transducer((tuple([0] * FORMS),), (tuple(weight(x) for x in range(FORMS)),))


#: Weight of an insult of each strength.
STRENGTHS = (0.75, 1.5, 2.5, 3.5)


def addressed() -> Transducer:
    """Reads a clause from its end."""
    return _marker((TARGET,), 4, TARGETED)


def grammar() -> Transducer:
    return _marker((NEGATION,), 3, NEGATED) @ _marker((REPORT, MARK), None, REPORTED) @ _marker((TARGET,), 4, TARGETED) @ _scorer(STRENGTHS)


@dataclass(frozen=True)
class Model:
    words: dict[str, int]  # insult -> level
    beginnings: dict[str, int]
    weights: tuple[float, ...]  # bias, strongest clause, log of the sum, log of the number of clauses

    def symbol(self, word: str) -> int:
        word = word.replace("\u2019", "'")
        core = _CORE.sub("", word)
        if core in NEGATIONS:
            return NEGATION
        if core in REPORTS:
            return REPORT
        if core in self.words:
            return INSULT + self.words[core]
        for k in range(min(len(core), 8), 3, -1):
            level = self.beginnings.get(core[:k])
            if level is not None:
                return INSULT + level
        if core in THREATS:
            return THREAT
        return TARGET if core in TARGETS else OTHER


PRIOR = (-3.0, 0.8, 0.5, 0.2)


def opens(word: str) -> bool:
    """Whether a quotation mark stands before the word's first letter."""
    return _OPENS.match(word) is not None


def clause_weight(symbols: list[int], back: Transducer, machine: Transducer) -> float:
    state, forms = 0, []
    for x in reversed(symbols):
        forms.append(back.out[state][x])
        state = back.to[state][x]
    state, total = 0, 0.0
    for x in reversed(forms):
        total += machine.out[state][x]
        state = machine.to[state][x]
    return total


def clause_features(texts: list[bytes], model: Model, machine: Transducer) -> np.ndarray:
    """A row a text: strongest clause, log(1 + sum), log(1 + clauses that weigh anything). Clauses without a hot word are not run."""
    out = np.zeros((len(texts), 3))
    back = addressed()
    distinct, ids, counts, newlines = words(texts)
    decoded = [w.decode("utf-8", "replace").lower() for w in distinct]
    symbol = np.fromiter((model.symbol(w) for w in decoded), np.int8, len(decoded))[ids]
    quotes = np.fromiter(map(opens, decoded), bool, len(decoded))[ids]
    ends = np.fromiter((bool(_ENDS.search(w)) for w in decoded), bool, len(decoded))[ids]
    of = np.repeat(np.arange(len(texts)), counts)
    begins = np.zeros(len(of) + 1, bool)
    begins[newlines] = True  # a newline ends each text
    begins[1:][ends] = True
    begins[0] = True
    heads = np.flatnonzero(begins[:-1])
    clause = np.cumsum(begins[:-1]) - 1
    bounds = np.append(heads, len(of))
    sums, most, number = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    for c in np.unique(clause[symbol >= THREAT]).tolist():
        own = slice(bounds[c], bounds[c + 1])
        total = clause_weight(np.insert(symbol[own], np.flatnonzero(quotes[own]), MARK).tolist(), back, machine)
        if total:
            d = of[bounds[c]]
            sums[d] += total
            number[d] += 1
            most[d] = max(most[d], total)
    out[:, 0], out[:, 1], out[:, 2] = most, np.log1p(sums), np.log1p(number)
    return out


def _signature(words: list[bytes]) -> tuple[int, int]:
    """Two least hashes over five-word shingles."""
    grams = [b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    return min(xxhash.xxh64_intdigest(g, 1) for g in grams), min(xxhash.xxh64_intdigest(g, 2) for g in grams)


def _level(log_odds: float) -> int:
    return int(np.clip((log_odds - 2) / 1.0, 0, LEVELS - 1))


def learn(rows: list[tuple[bytes, int]]) -> Model:
    """From (text, label) rows."""
    seen: set[tuple[int, int, int]] = set()
    n, words_of, begins_of = [0, 0], (Counter(), Counter()), (Counter(), Counter())
    largest: Counter = Counter()
    likely: set[str] = set()
    # toxic texts first: the others need only be counted for what several toxic ones have
    for label in (1, 0):
        for text, y in rows:
            split = text.lower().split() if y == label else []
            sign = {(label, k, s) for k, s in enumerate(_signature(split))} if split else set()
            if not split or sign & seen:
                continue
            seen |= sign
            n[label] += 1
            cores = {_CORE.sub("", w.decode("utf-8", "replace").lower().replace("\u2019", "'")) for w in split} - {""}
            begins = {w[:k] for w in cores if len(w) > 4 for k in range(4, min(len(w), 9))}
            words_of[label].update(cores if label else cores & likely)
            begins_of[label].update(begins if label else begins & likely)
        if label:
            for w, c in words_of[1].items():
                for k in range(4, min(len(w), 9)):
                    largest[w[:k]] = max(largest[w[:k]], c)
            for count in (words_of[1], begins_of[1]):
                for w in [w for w, c in count.items() if c < LEAST_TEXTS]:
                    del count[w]
                likely.update(count)

    def odds(count: tuple[Counter, Counter], term: str) -> float:
        return float(np.log((count[1][term] + 0.5) / (n[1] + 1)) - np.log((count[0][term] + 0.5) / (n[0] + 1)))

    def telling(count: tuple[Counter, Counter]) -> dict[str, float]:
        least = max(LEAST_TEXTS, 0.004 * n[1])
        return {t: o for t, c in count[1].items() if c >= least and (o := odds(count, t)) >= 2.5}

    telling_words, begins = (telling(words_of), telling(begins_of)) if all(n) else ({}, {})
    # a beginning must hold more than one word's texts
    begins = {b: o for b, o in begins.items() if begins_of[1][b] >= 1.5 * largest[b]}
    model = Model({t: _level(o) for t, o in telling_words.items()}, {t: _level(o) for t, o in begins.items()}, PRIOR)
    if not all(n):
        return model
    x = np.concatenate([clause_features([t for t, _ in rows[k : k + 500]], model, grammar()) for k in range(0, len(rows), 500)])
    return Model(model.words, model.beginnings, _fit(x, np.array([y for _, y in rows], float)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.array(PRIOR)
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED, most_bytes: int = MOST_BYTES) -> Model:
    """A model from at most `most_labelled` labelled rows, of at most `most_bytes` bytes each, that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    # at most `most_labelled` rows of 12 bytes are broadcast
    rows = id_and_text(docs).where(F.octet_length("text") <= most_bytes).join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(most_labelled)
    found = rows.select("text", "toxic").toArrow()
    return learn(list(zip(found["text"].cast(pa.large_binary()).to_pylist(), found["toxic"].to_pylist(), strict=True)))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        w = np.array(model.weights)
        for batch in slices(batches):
            z = clause_features(column_bytes(batch), model, machine) @ w[1:] + w[0]
            yield pa.RecordBatch.from_arrays([longs(batch), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    out = id_and_text(docs).mapInArrow(tidied(run), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
