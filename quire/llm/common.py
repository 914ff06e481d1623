"""What the operators share: text in bounded slices, words, memory given back, lineage cuts. The shared folder is quire.sources.shared's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import shared_dir, small_batches, written  # noqa: F401  the operators take these from here

#: The white space that separates words in every contract here.
SPACE = b" \t\n\v\f\r"
#: Bytes of text that a worker holds in intermediate arrays at once (a longer text is held alone).
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Just the two columns that a text operator reads; other columns, whatever their names, are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column of each piece holds about `most` bytes; a longer row is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            start = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, start + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows in batches whose column holds up to about `most` bytes: small batches are put together, large ones cut."""
    held, size = [], 0
    for piece in slices(batches, column, most):
        own = pc.sum(pc.binary_length(piece.column(piece.schema.get_field_index(column)))).as_py() or 0
        if held and size + own > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(piece)
        size += own
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def column_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of a string column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def column_text(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """Texts of a string column; null is empty, and bytes that aren't UTF-8 become U+FFFD."""
    return [b.decode("utf-8", "replace") for b in column_bytes(batch, name)]


_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_GAP = np.zeros(256, bool)
_GAP[list(SPACE)] = True
#: What parts words that are made of ASCII letters and digits and all that isn't ASCII (in UTF-8, bytes from 0x80 on).
LETTERS = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def words(texts: list[bytes], lower: bool = True, gap: np.ndarray = _GAP) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct words of the texts, ASCII capitals lowered if so wanted, parted by the bytes that `gap` marks, of which newline is one; the place there of each word, one text after another; words of each text; words of all that start before each newline).

    A text's words take ten to twenty times its bytes at the peak."""
    # words and gaps alternate, with a gap at both ends
    data = b"\n".join([b"", *texts, b""])
    if lower:
        data = data.translate(_LOWER)
    u = np.frombuffer(data, np.uint8)
    between = gap[u]
    offsets = np.concatenate([[0], np.flatnonzero(between[1:] != between[:-1]) + 1, [len(u)]])
    if len(offsets) == 2:
        return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    found = parts.take(pa.array(np.arange(1, len(offsets) - 1, 2))).dictionary_encode()
    starts = offsets[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = np.diff(np.searchsorted(starts, ends), prepend=0)
    return found.dictionary.to_pylist(), np.asarray(found.indices, dtype=np.int64), n, np.searchsorted(starts, np.flatnonzero(u == 0x0A))


def release() -> None:
    """Gives what Arrow and the C library hold unused back to the system: workers live on from task to task, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same pass over batches, and release() at its end."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def longs(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Kept(dict):
    """A bounded table in two generations: when the young one is full it becomes the old one, whose entries come back when used."""

    def __init__(self, make, most: int, longest: int):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = out
        return out


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder; sets a folder only where the session names none."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
