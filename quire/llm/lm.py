"""Language-model scores from a log-frequency Bloom filter.

Tokens are words, ASCII capitals lowered, and one end a text. Training counts tokens exactly, and runs of two tokens (of up to ORDER where a
model is trained so). A run that occurs c times has the quantised count q = 1 + floor(log2 c); the filter holds (run, 1) to (run, q). Probing
(run, 1), (run, 2), ... until one is missing gives q back (too high with a probability of about 0.6 % a step, never too low), and the
middle of its range as the count. A token's probability interpolates the run's frequency relative to its history with the probability by the
shorter run, down to the smoothed token frequency; the first token of a text has the texts' beginnings as history. The weights depend on the
history's count, by powers of two, and are fitted on all training texts, each with its own occurrences taken out of the counts.

The filter grows with the corpus, so it is neither broadcast nor sent through the driver: probes go to it. Texts are cut into slices of
some MB. A slice's tokens are written to a file in the shared folder; its distinct keys, sorted, go by shuffle to the segments of
the key space, a row for each slice and segment. A task adds a segment's counts up, builds the segment's filter, writes it, probes
it for each distinct key once, and sends each slice the answers for its keys; another shuffle brings a slice's answers together. So every
key moves once each way and nothing is read more often as the corpus grows. The number of segments follows the number of keys
that are sent, so that a segment is some tens of MB at any size. A key that all slices have adds a row's entry a slice to its segment.

Defined cases: null and empty texts are one end; a null doc_id is a training row; without training rows all probabilities are those
of the base formula (log 0 never occurs); repeated rows count and are scored each; an empty table gives no rows; extra columns
are ignored; a long text is a slice of its own, whole, in memory of ten to twenty times its bytes. Keys are 62-bit hashes of words and runs.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_bytes, gathered, id_and_text, longs, mix64, shared_dir, tidied, words, written
from quire.llm.files import read_file, write_file

#: Longest run of tokens in the filter.
ORDER = 2
#: Bytes of text in a slice; slices in a block; distinct keys in a segment, and most keys that are sent to one.
SLICE_TEXT = 8 << 20
BLOCK = 3
SEGMENT_KEYS = 500_000
MOST_SENT = 6_000_000
#: One key in so many, by hash, is counted to estimate how many there are.
SHARE = 1024
#: Most tasks that go over the slices.
TASKS = 20_000
#: Files of a table that has a row a slice. All rows of a task go to one, so that they are of one attempt whatever is run again.
FEW = 8
BITS_PER_ITEM = 12
PROBES = 4
MOST_LEVELS = 48
END = xxhash.xxh64_intdigest(b"\n", 11)
START = xxhash.xxh64_intdigest(b"\n\n", 11)
KIND = np.uint64(3)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, the place there of each token of the texts, one after another, tokens of each text)."""
    distinct, place, n, _ = words(texts)
    place = np.insert(place, np.cumsum(n), len(distinct))  # the end, which no word equals
    return np.fromiter((xxhash.xxh64_intdigest(w, 11) for w in [*distinct, b"\n"]), np.uint64), place, n + 1


def run_keys(h: np.ndarray, n: np.ndarray, order: int) -> list[np.ndarray]:
    """For lengths 2 to `order`, the key of the run that ends at each token. At a text's first token all runs are (START, token)."""
    heads = np.cumsum(n) - n
    mixed, before, out = mix64(h), h, []
    for length in range(2, order + 1):
        last = np.empty_like(h)
        last[1:] = before[:-1]
        last[heads] = START
        with np.errstate(over="ignore"):
            before = mix64(last * np.uint64(0x9E3779B97F4A7C15) ^ mixed) & ~KIND | np.uint64(length - 1)
        out.append(before)
    return out


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts, 0 for none: a number's length in bits."""
    return np.frexp(counts.astype(float))[1].astype(np.int64)


def middle(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 1.5 * 2.0 ** (q - 1) - 0.5, 0.0)


def _places(keys: np.ndarray, level: np.ndarray | int, bits: int) -> Iterator[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mix64(keys + np.uint64(0x632BE59BD9B4E019) * np.asarray(level).astype(np.uint64))
        b = mix64(a) | np.uint64(1)
        for i in range(PROBES):
            yield (a + np.uint64(i) * b) % np.uint64(bits)


class Segment:
    """The token counts and the filter of the keys of one segment."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, filter_bits: np.ndarray):
        self.keys, self.counts, self.filter = keys, counts, filter_bits

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray) -> Segment:
        token = keys & KIND == 0
        order = np.argsort(keys[token])
        runs, q = keys[~token], levels(counts[~token])
        bits = max(64, -(-BITS_PER_ITEM * int(q.sum()) // 64) * 64)
        filled = np.zeros(bits // 8, np.uint8)
        for level in range(1, int(q.max(initial=0)) + 1):
            for at in _places(runs[q >= level], level, bits):
                np.bitwise_or.at(filled, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return cls(keys[token][order], counts[token][order], filled)

    def to_bytes(self) -> bytes:
        kind = "<u4" if self.counts.max(initial=0) < 1 << 32 else "<u8"
        return struct.pack("<QQQ", len(self.keys), len(self.filter), int(kind[2])) + self.keys.astype("<u8").tobytes() + self.counts.astype(kind).tobytes() + self.filter.tobytes()

    @classmethod
    def of_bytes(cls, data: memoryview) -> Segment:
        n, m, width = struct.unpack("<QQQ", data[:24])
        return cls(np.frombuffer(data, "<u8", n, 24), np.frombuffer(data, f"<u{width}", n, 24 + 8 * n), np.frombuffer(data, np.uint8, m, 24 + (8 + width) * n))

    def token_counts(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0).astype(np.int64)

    def run_levels(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts, by probing level after level."""
        out = np.zeros(len(keys), np.int64)
        there = np.arange(len(keys))
        for level in range(1, MOST_LEVELS):
            hit = np.ones(len(there), bool)
            for at in _places(keys[there], level, 8 * len(self.filter)):
                hit &= (self.filter[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            there = there[hit]
            if not len(there):
                break
            out[there] = level
        return out

    def answers(self, keys: np.ndarray) -> np.ndarray:
        """Of distinct keys: a token's count, a run's quantised count."""
        token = keys & KIND == 0
        out = np.empty(len(keys), np.int64)
        out[token], out[~token] = self.token_counts(keys[token]), self.run_levels(keys[~token])
        return out


# ---------------------------------------------------------------- arrays in rows and files


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers, in bytes of the least width and byte by byte of equal weight, compressed."""
    most = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if most < 1 << 8 * w)
    planes = numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(f"<u{data[0]}").astype(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes | memoryview) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


class Slice:
    """Some MB of texts as tokens: hashes and places, the texts' tokens and doc_ids, and which are held out."""

    def __init__(self, hashes, place, n, doc_ids, known, held):
        self.hashes, self.place, self.n, self.doc_ids, self.known, self.held = hashes, place, n, doc_ids, known, held

    def to_bytes(self) -> bytes:
        fields = [pack(x) for x in (self.hashes, self.place, self.n, self.doc_ids.view(np.uint64), self.known, self.held)]
        return struct.pack("<6Q", *map(len, fields)) + b"".join(fields)

    @classmethod
    def of_bytes(cls, data: memoryview) -> Slice:
        ends = 48 + np.cumsum([0, *struct.unpack("<6Q", data[:48])])
        hashes, place, n, doc_ids, known, held = (unpack(data[a:b]) for a, b in zip(ends, ends[1:]))
        return cls(hashes, place.astype(np.int64), n.astype(np.int64), doc_ids.view(np.int64), known.astype(bool), held.astype(bool))

    def keys(self, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(the slice's distinct keys, sorted; for tokens and each length of run the place there of each token's key; times that a key occurs in training texts)."""
        h = self.hashes[self.place]
        train = np.repeat(~self.held, self.n)
        found = []
        for k in [None, *run_keys(h, self.n, order)]:
            if k is None:
                u, at = np.unique(self.hashes & ~KIND, return_inverse=True)
                at = at[self.place]
            else:
                u, at = np.unique(k, return_inverse=True)
            found.append((u, at, np.bincount(at[train], minlength=len(u))))
        every = np.concatenate([u for u, _, _ in found])
        by_key = np.argsort(every)
        rank = np.empty_like(by_key)
        rank[by_key] = np.arange(len(by_key))
        ranks = np.split(rank, np.cumsum([len(u) for u, _, _ in found])[:-1])
        return every[by_key], [r[at] for r, (_, at, _) in zip(ranks, found, strict=True)], np.concatenate([c for _, _, c in found])[by_key]


@dataclass(frozen=True)
class Sliced:
    """Texts in slices: table has block, slice, path, keys, texts (training texts), sample; the files are in the shared folder. keys: as the slices have them; distinct: about as many there are in all."""

    table: DataFrame
    n: int
    keys: int
    distinct: int
    texts: int
    order: int


def sliced(docs: DataFrame, order: int = ORDER) -> Sliced:
    docs = id_and_text(docs)
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/slices"
    names = ["block", "slice", "path", "keys", "texts", "sample"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, SLICE_TEXT):
            ids = longs(batch)
            held = batch.column(batch.schema.get_field_index("held")).to_numpy(zero_copy_only=False).astype(bool)
            one = Slice(*tokens(column_bytes(batch)), ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held)
            path = f"{folder}/{number:016x}-{uuid.uuid4().hex}"
            write_file(path, one.to_bytes())
            keys = one.keys(order)[0]
            sample = keys[mix64(keys) % np.uint64(SHARE) == 0].view(np.int64).tolist()
            first = number - (number & 0xFFFFFFFF) % BLOCK
            columns = [pa.array([x]) for x in (first, number, path, len(keys), int((~held).sum()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([sample], pa.list_(pa.int64()))], names=names)
            number += 1

    table = written(docs.withColumn("held", held_out(F.col("doc_id"))).mapInArrow(tidied(cut), "block long, slice long, path string, keys long, texts long, sample array<long>").repartition(FEW, F.shiftright("slice", 32)).coalesce(FEW), "slices")
    zero = F.lit(0)
    sums = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("keys"), zero).alias("keys"), F.coalesce(F.sum("texts"), zero).alias("texts")).first()
    distinct = SHARE * table.select(F.explode("sample").alias("key")).distinct().count()
    return Sliced(table, sums.n, sums["keys"], distinct, sums.texts, order)


def in_blocks(texts: Sliced) -> DataFrame:
    """block, paths: of the slices of each block, in order; BLOCK at most."""
    return texts.table.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", "path"))).alias("of")).select("block", F.col("of.path").alias("paths"))


def block_keys(paths: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a block's slices, sorted, and how often each occurs in training texts."""
    found = [Slice.of_bytes(read_file(p)).keys(order)[::2] for p in paths]
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in found]))
    return keys, counts


def sent(texts: Sliced, segments: int) -> DataFrame:
    """segment, block, keys, counts: each block's keys by segment of the key space."""
    order = texts.order

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = block_keys(paths, order)
                segment = ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
                heads = np.flatnonzero(np.diff(segment, prepend=-1))
                rows = [(int(segment[a]), block, pack_sorted(keys[a:b]), pack(counts[a:b])) for a, b in zip(heads, [*heads[1:], len(keys)])]
                for at in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 256]), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["segment", "block", "keys", "counts"])

    dealt = in_blocks(texts).repartitionByRange(max(1, min(texts.n, TASKS)), "block")
    return dealt.mapInArrow(tidied(send), "segment long, block long, keys binary, counts binary")


ANSWERS = "block long, segment long, answers binary, path string, tokens long, distinct long"


def _answered(segment: int, built: Segment | None, asked: pa.Table, folder: str = "") -> pa.Table:
    """The answers of a segment to the blocks that ask it; builds it from their counts, and writes it, if there is none yet."""
    parts = [unpack_sorted(k) for k in asked["keys"].to_pylist()]
    keys, at = np.unique(np.concatenate(parts), return_inverse=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    path = tokens_in = distinct = None
    if built is None:
        counts = np.zeros(len(keys), np.int64)
        ends = np.cumsum([0, *map(len, parts)])
        for a, b, c in zip(ends, ends[1:], asked["counts"].to_pylist()):
            counts[at[a:b]] += unpack(c).astype(np.int64)  # a block has a key once
        there = counts > 0
        built = Segment.build(keys[there], counts[there])
        path = f"{folder}/segment-{segment:08d}"
        write_file(path, built.to_bytes())
        tokens_in, distinct = int(built.counts.sum()), len(built.keys)
    found = built.answers(keys)[at].astype(np.uint64)
    ends = np.cumsum([0, *map(len, parts)])
    blobs = [pack(found[a:b]) for a, b in zip(ends, ends[1:])]
    once = lambda x: pa.array([x] + [None] * (len(blobs) - 1), pa.string() if isinstance(x, str) else pa.int64())
    if not blobs:
        return pa.Table.from_batches([], _ANSWERS)
    columns = [pa.array(asked["block"].to_pylist(), pa.int64()), pa.array([segment] * len(blobs), pa.int64()), pa.array(blobs, pa.binary()), once(path).cast(pa.string()), once(tokens_in), once(distinct)]
    return pa.table(columns, schema=_ANSWERS)


_ANSWERS = pa.schema([("block", pa.int64()), ("segment", pa.int64()), ("answers", pa.binary()), ("path", pa.string()), ("tokens", pa.int64()), ("distinct", pa.int64())])


@dataclass(frozen=True)
class Model:
    segments: int
    files: DataFrame  # segment, path
    tokens: int
    distinct: int
    texts: int
    order: int
    weights: tuple[tuple[float, ...], ...]  # of runs' relative frequencies: for lengths from 2 on, by log2 of the history's count
    of: Sliced | None = field(default=None, compare=False)  # the texts that were counted, and the answers to them
    answers: DataFrame | None = field(default=None, compare=False)

    def asked(self, texts: Sliced) -> DataFrame:
        """block, segment, answers."""
        if texts is self.of:
            return self.answers

        def answer(asked: pa.Table, files: pa.Table) -> pa.Table:
            if not asked.num_rows:
                return pa.Table.from_batches([], _ANSWERS)
            empty = Segment.build(np.zeros(0, np.uint64), np.zeros(0, np.int64))
            built = Segment.of_bytes(read_file(files["path"][0].as_py())) if files.num_rows else empty
            return _answered(asked["segment"][0].as_py(), built, asked)

        both = sent(texts, self.segments).groupBy("segment").cogroup(self.files.groupBy("segment"))
        return both.applyInArrow(answer, ANSWERS).select("block", "segment", "answers")

    def plain(self) -> Model:
        """The same numbers without tables: what tasks need."""
        return replace(self, files=None, of=None, answers=None)

    def facts(self, one: Slice, places: list[np.ndarray], found: np.ndarray, own: int = 0) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """(counts; smoothed probabilities; for each length of run its relative frequency and its history's bucket), for each token. found: the answers to the slice's keys; places: as Slice.keys has them.

        own: times that each occurrence is taken out of the counts."""
        c = found[places[0]]
        heads = np.cumsum(one.n) - one.n
        smoothed = (np.maximum(c - own, 0) + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))
        runs, before = [], c.astype(float)
        for at in places[1:]:
            history = np.empty_like(before)
            history[1:] = before[:-1]
            history[heads] = self.texts
            before = middle(found[at])
            together, history = np.maximum(before - own, 0), np.maximum(history - own, 0)
            share = np.where(history > 0, np.minimum(together, history) / np.maximum(history, 0.5), 0.0)
            bucket = np.where(history > 0, np.log2(np.maximum(history, 1)).astype(np.int64) + 1, 0)
            runs.append((share, np.minimum(bucket, MOST_LEVELS - 1)))
        return c, smoothed, runs

    def probability(self, smoothed: np.ndarray, runs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        p = smoothed
        for w, (share, bucket) in zip(self.weights, runs):
            by = np.array(w)[bucket]
            p = (1 - by) * p + by * share
        return p


def _per_slice(texts: Sliced, answers: DataFrame, f, schema: str, empty: pa.Schema) -> DataFrame:
    """f(slice, the places of its tokens' keys, the answers to its keys) over all slices, a block at a time."""
    order = texts.order

    def one(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return empty.empty_table()
        paths = table["paths"][0].as_py()
        answers = [unpack(a).astype(np.int64) for a in found.sort_by("segment")["answers"].to_pylist()]
        got, keys, out = np.concatenate([*answers, np.zeros(0, np.int64)]), block_keys(paths, order)[0], []
        for p in paths:
            slice_ = Slice.of_bytes(read_file(p))
            own, places, _ = slice_.keys(order)
            out.append(f(slice_, places, got[np.searchsorted(keys, own)]))
        return pa.concat_tables(out)

    return in_blocks(texts).groupBy("block").cogroup(answers.select("block", "segment", "answers").groupBy("block")).applyInArrow(one, schema)


def train(docs: DataFrame | Sliced, order: int = ORDER) -> Model:
    texts = docs if isinstance(docs, Sliced) else sliced(docs, order)
    segments = max(1, -(-texts.distinct // SEGMENT_KEYS), -(-texts.keys // MOST_SENT))
    folder = f"{shared_dir(texts.table.sparkSession)}/filter"

    def build(key: tuple, asked: pa.Table) -> pa.Table:
        return _answered(key[0].as_py(), None, asked, folder)

    answers = written(sent(texts, segments).groupBy("segment").applyInArrow(build, ANSWERS), "answers")
    zero = F.lit(0)
    sums = answers.agg(F.coalesce(F.sum("tokens"), zero).alias("tokens"), F.coalesce(F.sum("distinct"), zero).alias("distinct")).first()
    files = answers.where("path is not null").select("segment", "path")
    model = Model(segments, files, sums.tokens, sums["distinct"], texts.texts, texts.order, (), texts, answers.select("block", "segment", "answers"))
    for _ in range(2, texts.order + 1):
        model = replace(model, weights=(*model.weights, fit(model)))
    return model


def fit(model: Model, rounds: int = 60) -> tuple[float, ...]:
    """The weights of the shortest runs that have none yet, by EM on all training texts, each without its own occurrences.

    Tokens enter as numbers by (bucket, eighth-octave of the ratio of the run's frequency to the probability by shorter runs), some hundred rows.
    """
    plain = model.plain()
    schema = pa.schema([("bucket", pa.int64()), ("ratio", pa.int64()), ("n", pa.int64())])

    def ratios(one: Slice, places: list[np.ndarray], found: np.ndarray) -> pa.Table:
        _, smoothed, runs = plain.facts(one, places, found, own=1)
        share, bucket = runs[len(plain.weights)]
        train = np.repeat(~one.held, one.n)
        shorter = plain.probability(smoothed, runs)[train]
        share, bucket = share[train], bucket[train]
        ratio = np.where(share > 0, np.round(8 * np.log2(np.maximum(share, 1e-300) / shorter)), -10_000).astype(np.int64)
        code, n = np.unique(bucket << 32 | (ratio + (1 << 20)), return_counts=True)
        return pa.table([pa.array(code >> 32), pa.array((code & 0xFFFFFFFF) - (1 << 20)), pa.array(n.astype(np.int64))], schema=schema)

    rows = _per_slice(model.of, model.answers, ratios, "bucket long, ratio long, n long", schema).groupBy("bucket", "ratio").agg(F.sum("n").alias("n")).collect()
    out = [0.0] * MOST_LEVELS
    for b in {r.bucket for r in rows if r.bucket > 0}:
        r = np.array([0.0 if x.ratio == -10_000 else 2.0 ** (x.ratio / 8) for x in rows if x.bucket == b])
        n = np.array([x.n for x in rows if x.bucket == b], float)
        w = 0.3
        for _ in range(rounds):
            w = float((n * (w * r / (w * r + 1 - w))).sum() / n.sum())
        out[b] = min(w, 0.95)
    return tuple(out)


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame | Sliced, model: Model) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability)."""
    texts = docs if isinstance(docs, Sliced) else sliced(docs, model.order)
    plain = model.plain()
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def scores(one: Slice, places: list[np.ndarray], found: np.ndarray) -> pa.Table:
        c, smoothed, runs = plain.facts(one, places, found)
        heads = np.cumsum(one.n) - one.n
        total = lambda x: np.add.reduceat(x, heads)  # noqa: E731  each text has a token
        return pa.table(
            [pa.array(one.doc_ids, mask=~one.known), pa.array(one.held), pa.array(one.n), pa.array(total((c > 0).astype(np.int64))), pa.array(total(np.log10(smoothed))), pa.array(total(np.log10(plain.probability(smoothed, runs))))],
            schema=schema,
        )

    out = _per_slice(texts, model.asked(texts), scores, SCHEMA, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
