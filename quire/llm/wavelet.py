"""Token ids in wavelet-matrix files: one compressed file a shard, with access, counting and occurrence lookup.

A shard holds the ids of consecutive documents. Bit-plane l has, for each id, its l-th bit from the top; after
each plane the ids are stably parted by that bit, zeros first. Planes are cut into blocks of BLOCK_BITS bits, each compressed
by zstandard where that helps; a directory has each block's place and the ones before it, so rank and select touch one
block a plane. A document table has doc_ids and lengths.

File: magic, u32 header length, JSON header, then sections at the offsets that the header names.

Order: documents are range-partitioned and sorted by (doc_id, hash of the text, text), so that a doc_id with many rows takes many
partitions; a partition starts another file after `shard_tokens` ids, so a file holds that many ids or one document. Partition and file
numbers follow that order, and a document's start is the ids of all files before its own plus those before it in the file.

Defined cases: a null or empty text has the end id alone; null doc_ids come first; rows that repeat a doc_id keep
a row each, in the order of their texts' hashes; an empty table writes no file and gives no rows; extra columns are ignored; a
special token's string in a text is that token; a text above ENCODE_BYTES is encoded alone, whole, in ten to twenty times its bytes.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import column_text, gathered, id_and_text, longs, shared_dir, tidied
from quire.llm.files import read_file, write_file

MAGIC = b"QWAVE01\n"
END_ID = 0
BLOCK_BITS = 1 << 16
#: Ids in a file, and bytes of text in a partition.
SHARD_TOKENS = 16 << 20
PARTITION_BYTES = 24 << 20
#: Bytes of text encoded at once (a longer text is encoded alone).
ENCODE_BYTES = 6 << 20
#: Ids that are parted at once.
AT_ONCE = 1 << 18
#: Parts of texts whose ids a worker keeps, in each of two generations, and the bytes of the longest.
KEPT_PARTS = 400_000
LONGEST_KEPT = 48
#: Partitions that one running sum goes over, and tasks that read files back (a task reads one file after another).
SUM_PARTS = 1024
READ_TASKS = 4096


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The file of a shard."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    z = zstandard.ZstdCompressor(level=1)
    sections: list[bytes] = []
    size = 0

    def add(data: bytes) -> list[int]:
        nonlocal size
        sections.append(data)
        size += len(data)
        return [size - len(data), len(data)]

    planes, zeros = [], []
    rest = ids.astype(np.uint32 if bits > 16 else np.uint16)
    for level in range(bits):
        bit = (rest & rest.dtype.type(1 << (bits - 1 - level))) != 0
        packed = np.packbits(bit)
        step = BLOCK_BITS // 8
        blocks = [packed[at : at + step].tobytes() for at in range(0, len(packed), step)]
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(np.bitwise_count(packed), np.arange(0, len(packed), step), dtype=np.int64) if len(packed) else [])]).astype("<u8")
        stored = [min(b, z.compress(b), key=len) for b in blocks]
        places = np.concatenate([[0], np.cumsum([len(b) for b in stored])]).astype("<u8")
        planes.append({"blocks": add(b"".join(stored)), "places": add(places.tobytes()), "ranks": add(ranks.tobytes())})
        zeros.append(len(bit) - int(ranks[-1]))
        if level < bits - 1:
            parted, low, high = np.empty_like(rest), 0, zeros[-1]
            for at in range(0, len(rest), AT_ONCE):  # in pieces, as places take more than ids
                piece, ones = rest[at : at + AT_ONCE], np.flatnonzero(bit[at : at + AT_ONCE])
                none = np.flatnonzero(~bit[at : at + AT_ONCE])
                parted[low : low + len(none)], parted[high : high + len(ones)] = piece.take(none), piece.take(ones)
                low, high = low + len(none), high + len(ones)
            rest = parted
    known = np.array([d is not None for d in doc_ids])
    docs = {"ids": add(z.compress(np.array([d or 0 for d in doc_ids], "<i8").tobytes())), "known": add(z.compress(np.packbits(known).tobytes())), "lengths": add(z.compress(np.array(lengths, "<i8").tobytes()))}
    header = json.dumps({"n": len(ids), "bits": bits, "zeros": zeros, "planes": planes, "docs": docs, "n_docs": len(doc_ids), "block_bits": BLOCK_BITS}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *sections])


class Shard:
    """A file's ids: access, rank, select, count, occurrences, and all of them at once."""

    def __init__(self, data: bytes | memoryview):
        data = memoryview(data)
        if bytes(data[: len(MAGIC)]) != MAGIC:
            raise ValueError("not a wavelet file")
        at = len(MAGIC) + 4
        (size,) = struct.unpack("<I", data[len(MAGIC) : at])
        head = json.loads(bytes(data[at : at + size]))
        self.n, self.bits, self.zeros, self.n_docs = head["n"], head["bits"], head["zeros"], head["n_docs"]
        self.step = head["block_bits"] // 8
        self.part = lambda place: data[at + size + place[0] : at + size + place[0] + place[1]]
        self.planes = [{"blocks": self.part(p["blocks"]), "places": np.frombuffer(self.part(p["places"]), "<u8"), "ranks": np.frombuffer(self.part(p["ranks"]), "<u8")} for p in head["planes"]]
        self.docs = head["docs"]
        self.z = zstandard.ZstdDecompressor()
        self.block = lru_cache(maxsize=256)(self._block)

    def _block(self, level: int, k: int) -> np.ndarray:
        plane = self.planes[level]
        stored = plane["blocks"][int(plane["places"][k]) : int(plane["places"][k + 1])]
        full = min(self.step, (self.n + 7) // 8 - k * self.step)
        return np.frombuffer(stored if len(stored) == full else self.z.decompress(stored, max_output_size=full), np.uint8)

    def _bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // (8 * self.step))[i // 8 % self.step]) >> (7 - i % 8) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        k, within = divmod(i, 8 * self.step)
        ones = int(self.planes[level]["ranks"][k])
        if within:
            block = self.block(level, k)
            ones += int(np.bitwise_count(block[: within // 8]).sum())
            if within % 8:
                ones += (int(block[within // 8]) >> (8 - within % 8)).bit_count()
        return ones

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        ranks = self.planes[level]["ranks"].astype(np.int64)
        counts = ranks if bit else np.minimum(np.arange(len(ranks)) * 8 * self.step, self.n) - ranks
        b = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.block(level, b))[: self.n - b * 8 * self.step]
        return b * 8 * self.step + int(np.flatnonzero(bits == bit)[k - int(counts[b])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.bits):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out = out << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return out

    def rank(self, token: int, i: int) -> int:
        """Times that token occurs among the first i ids."""
        if token >> self.bits:
            return 0
        start, i = 0, min(i, self.n)
        for level in range(self.bits):
            a, b = self._ones(level, start), self._ones(level, i)
            if token >> (self.bits - 1 - level) & 1:
                start, i = self.zeros[level] + a, self.zeros[level] + b
            else:
                start, i = start - a, i - b
        return i - start

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        if k < 0 or k >= self.count(token):
            raise IndexError(k)
        start = 0
        for level in range(self.bits):
            ones = self._ones(level, start)
            start = self.zeros[level] + ones if token >> (self.bits - 1 - level) & 1 else start - ones
        i = start + k
        for level in reversed(range(self.bits)):
            bit = token >> (self.bits - 1 - level) & 1
            i = self._select(level, bit, i - self.zeros[level] if bit else i)
        return i

    def occurrences(self, token: int) -> Iterator[int]:
        return (self.select(token, k) for k in range(self.count(token)))

    def ids(self) -> np.ndarray:
        """All ids, in order."""
        rest = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            packed = np.concatenate([self._block(level, k) for k in range(len(self.planes[level]["places"]) - 1)] or [np.zeros(0, np.uint8)])
            bit = np.unpackbits(packed, count=self.n).astype(bool)
            before = np.empty_like(rest)
            low, high = 0, self.zeros[level]
            top = rest.dtype.type(1 << (self.bits - 1 - level))
            for at in range(0, self.n, AT_ONCE):
                ones, none = np.flatnonzero(bit[at : at + AT_ONCE]), np.flatnonzero(~bit[at : at + AT_ONCE])
                piece = before[at : at + AT_ONCE]
                piece[none], piece[ones] = rest[low : low + len(none)], rest[high : high + len(ones)] | top
                low, high = low + len(none), high + len(ones)
            rest = before
        return rest

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """doc_ids and lengths."""
        ids, known, lengths = (self.z.decompress(self.part(self.docs[k])) for k in ("ids", "known", "lengths"))
        flags = np.unpackbits(np.frombuffer(known, np.uint8), count=self.n_docs).astype(bool)
        return [int(d) if k else None for d, k in zip(np.frombuffer(ids, "<i8"), flags, strict=True)], np.frombuffer(lengths, "<i8")


def byte_alphabet() -> dict[int, str]:
    """The characters for which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


def _class(members: str | bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


#: White space by the pattern's rule or by any near it; what is taken for white space in error is just not cut at.
_WHITE = _class(bytes([*range(0x09, 0x0E), *range(0x1C, 0x21)]))
_LETTER = _class(bytes([*range(0x41, 0x5B), *range(0x61, 0x7B)]))
_WIDE = np.array([int.from_bytes(chr(c).encode(), "big") for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)])


def _white(u: np.ndarray, at: np.ndarray, after: bool) -> np.ndarray:
    """Whether the character that starts at (after) or ends before (not after) each place is white space. `u` has three spare bytes at both ends."""
    one = u[at] if after else u[at - 1]
    out = _WHITE[one]
    high = np.flatnonzero(one >= 0x80)
    if len(high):
        p = at[high] if after else at[high] - 3
        x, y, z = (u[p + k].astype(np.int64) for k in range(3))
        pair = x << 8 | y if after else y << 8 | z
        out[high] = np.isin(pair, _WIDE) | np.isin(x << 16 | y << 8 | z, _WIDE)
    return out


def cuts(u: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places at which UTF-8 texts, one after another in `u` between three spare bytes at both ends, fall into parts that tokenise alone.

    The byte-level pattern always starts a piece at a space that a non-space follows, makes one of a newline between
    non-spaces, and ends one between a letter and an ASCII character that is none. `starts`: where texts begin, and the end of the last.
    """
    edge = np.zeros(len(u), bool)
    edge[starts] = True
    space = np.flatnonzero(u[3:-3] == 0x20) + 3
    space = space[~edge[space + 1]]
    space = space[~_white(u, space + 1, True)]
    line = np.flatnonzero(u[3:-3] == 0x0A) + 3
    line = line[~edge[line] & ~edge[line + 1]]
    line = line[~_white(u, line, False)]
    line = line[~_white(u, line + 1, True)]
    here, before = u[3:-3], u[2:-4]
    other = (here < 0x80) & ~_LETTER[here]
    ends = np.flatnonzero(other & _LETTER[before]) + 3
    # Latin letters of two bytes, U+00C0 to U+024F without the two signs among them
    two = np.flatnonzero(other & (before >= 0x80)) + 3
    code = u[two - 2].astype(np.int64) << 8 | u[two - 1]
    two = two[(code >= 0xC380) & (code <= 0xC98F) & (code != 0xC397) & (code != 0xC3B7)]
    for found in (space, line, line + 1, ends, two):
        edge[found] = True
    return np.flatnonzero(edge)


class Encoder:
    """Ids of texts by the tokenizers library, for a byte-level vocabulary; ids of short parts are kept.

    Texts fall into parts (see `cuts`); a batch's distinct parts are looked up or encoded once and put together by place. Letters, with a space
    or none before them, are one piece of the pattern and go to the library's merge model without the pattern; all other parts
    go through the whole tokenizer. A special token's string in a text is that token, as the library has it: the text is parted there.
    """

    LETTERS = re.compile(rb" ?[A-Za-z]+| ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added.values()):
            raise ValueError("special tokens that take their surroundings in aren't supported")
        self.special = {t.content.encode(): i for i, t in added.items()}
        self.at_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")")
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.end = self.packed([END_ID])
        self.newline = self.letters[0x0A]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of distinct parts: from the two generations that are kept, or anew."""
        found = list(map(self.young.get, parts))
        missing = [k for k, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        new = []
        for k in missing:
            found[k] = self.old.get(parts[k])
            if found[k] is None:
                new.append(k)
        letters = [k for k in new if (part := parts[k]).isalpha() or part[:1] == b" " and part[1:].isalpha() or self.LETTERS.fullmatch(part)]
        mapped = b"\n".join([parts[k] for k in letters]).decode("latin-1").translate(self.letters).split(self.newline)
        tokenize, flat, ends = self.model.tokenize, [], [0]
        for word in mapped if letters else ():
            flat += [t.id for t in tokenize(word)]
            ends.append(len(flat) * self.dtype.itemsize)
        ids = self.packed(flat)
        for k, at, to in zip(letters, ends, ends[1:]):
            found[k] = ids[at:to]
        for k in new:
            if found[k] is None:
                found[k] = self.packed(self.tokenizer.encode(parts[k].decode(), add_special_tokens=False).ids)
        if len(self.young) + len(missing) > KEPT_PARTS:
            self.old, self.young = self.young, {}
        self.young.update((parts[k], found[k]) for k in missing if len(parts[k]) <= LONGEST_KEPT)
        return found

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text with the end id, as bytes."""
        with_special = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        out = self.plain([b"" if k in with_special else t for k, t in enumerate(texts)])
        for k in with_special:
            # every second one is a special token; a text between two of them is encoded by itself
            split = self.at_special.split(texts[k])
            ids = self.plain(split[::2])
            out[k] = b"".join(x for i, x in zip(ids, [*(self.packed([self.special[s]]) for s in split[1::2]), b""], strict=True) for x in (i, x))
        return [ids + self.end for ids in out]

    def plain(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join([b"   ", *texts, b"   "])
        starts = np.cumsum([3, *map(len, texts)])
        u = np.frombuffer(data, np.uint8)
        edges = cuts(u, starts)
        if len(edges) < 2:
            return [b""] * len(texts)
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(self.encode_parts(parts.dictionary.to_pylist()), pa.large_binary()).take(parts.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[np.searchsorted(edges, starts)].tolist()
        found = memoryview(ids.buffers()[2]) if ids.buffers()[2] is not None else memoryview(b"")
        return [bytes(found[a:b]) for a, b in zip(ends, ends[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode()])[0]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """A worker's encoder; it and what it keeps last over tasks."""
    return Encoder(path)


MANIFEST = "part int, file int, path string, n_docs long, n_tokens long, n_bytes long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, tokenizer_path: str, folder: str, shard_tokens: int = SHARD_TOKENS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """Writes the shards into `folder` (a URI) and returns the manifest: part, file, path, n_docs, n_tokens, n_bytes."""
    docs = id_and_text(docs)
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // partition_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, encoder = TaskContext.get().partitionId(), 0, encoder_of(tokenizer_path)
        attempt = uuid.uuid4().hex  # another attempt writes other files
        found: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal file, held
            path = f"{folder}/shard-{part:06d}-{file:06d}-{attempt}.qwave"
            data = build(np.frombuffer(b"".join(found), encoder.dtype), doc_ids, lengths)
            write_file(path, data)
            row = pa.RecordBatch.from_pylist([{"part": part, "file": file, "path": path, "n_docs": len(doc_ids), "n_tokens": held, "n_bytes": len(data)}], schema=schema)
            for x in (found, doc_ids, lengths):
                x.clear()
            file, held = file + 1, 0
            return row

        schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])
        for batch in gathered(batches, ENCODE_BYTES):
            texts = [t.encode() for t in column_text(batch)]
            for doc_id, ids in zip(longs(batch).to_pylist(), encoder.encode_all(texts), strict=True):
                n = len(ids) // encoder.dtype.itemsize
                if held and held + n > shard_tokens:
                    yield flush()
                found.append(ids)
                doc_ids.append(doc_id)
                lengths.append(n)
                held += n
        if doc_ids:
            yield flush()

    # the text's hash parts the rows of one doc_id, without texts in the sample that sets the ranges
    ranged = docs.withColumn("mark", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")
    path = f"{folder}/manifest"
    # the manifest's rows go to few files; all rows of a task go to one, so that they are of one attempt whatever is run again
    few = max(1, parts // 256)
    ranged.mapInArrow(tidied(run), MANIFEST).repartition(few, "part").coalesce(few).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def starts(manifest: DataFrame) -> DataFrame:
    """path and before: the ids of all files before it. Sums of SUM_PARTS partitions are summed in one window, files within each such block in their own."""
    blocks = manifest.withColumn("block", F.floor(F.col("part") / SUM_PARTS))
    sums = blocks.groupBy("block").agg(F.sum("n_tokens").alias("all"))
    ahead = F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    within = F.sum("n_tokens").over(Window.partitionBy("block").orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    placed = blocks.join(sums.select("block", F.coalesce(ahead, F.lit(0)).alias("ahead")), "block")
    return placed.select("path", (F.col("ahead") + F.coalesce(within, F.lit(0))).alias("before"))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files. The driver sees the number of files alone."""
    tasks = max(1, min(manifest.count(), READ_TASKS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(read_file(path))
                doc_ids, lengths = shard.documents()
                data = memoryview(shard.ids().astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                whole = pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(before + starts), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield from (whole.slice(at, 50_000) for at in range(0, whole.num_rows, 50_000))

    return starts(manifest).repartitionByRange(tasks, "before").mapInArrow(tidied(run), ROWS)


def encode_and_read(docs: DataFrame, tokenizer_path: str, **sizes: int) -> DataFrame:
    return read(write(docs, tokenizer_path, f"{shared_dir(docs.sparkSession)}/shards", **sizes))
