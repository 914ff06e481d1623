"""Quality rules: base counts and zstandard compression bands.

A document is judged by how far zstandard shrinks it. Ratio here is raw bytes over compressed bytes, less the
fixed cost of an empty frame. Repetitive text (high ratio) and incompressible text such as key material or
encoded binaries (low ratio) lie outside a band; the band depends on the length, as short texts shrink less.
The ratio is taken over the whole document and over chunks of it, so that neither a long repetitive
stretch in a sound document nor a document that only repeats itself far apart escapes. Chunks cover every byte: the last one is what
is left, or goes to the one before if it is too short to be judged. Lower limits lie between what base64 and random words of that
length reach and what prose does; text in hexadecimal digits shrinks like prose and isn't told from it.

Defined cases: a null or empty text has no words and fails the base rule; texts below 128
bytes have no lower limit; a ratio that equals a limit, or a share of bytes that equals `bad_share`, is
kept; repeated rows are judged row by row, and a null doc_id is a row like any other; the order of rows plays no
part; an empty table gives no rows; extra columns are ignored; a long text is judged whole, in ten to twenty times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quire.llm.common import SPACE, column_bytes, id_and_text, longs, mix64, slices, tidied, words

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20


@dataclass(frozen=True)
class Band:
    """Ratios allowed for texts of at least `from_bytes` bytes."""

    from_bytes: int
    least: float
    most: float


#: (bytes, lower limit from that length on)
LOWEST = ((0, 0.0), (128, 1.09), (192, 1.16), (256, 1.2), (384, 1.28), (512, 1.34), (768, 1.42), (1024, 1.5))


@dataclass(frozen=True)
class Bands:
    """`whole`: by a document's length. `chunk`: by a chunk's length; more than `bad_share` of a document's bytes in chunks outside it reject.

    Documents of less than two chunks of `chunk_bytes` are cut into chunks of `short_chunk_bytes`."""

    whole: tuple[Band, ...] = field(default_factory=lambda: (*(Band(n, least, 3.0 if n < 1024 else 3.2) for n, least in LOWEST), Band(4096, 1.5, 3.6), Band(32768, 1.5, 4.5)))
    chunk: tuple[Band, ...] = field(default_factory=lambda: tuple(Band(n, least, 3.0) for n, least in LOWEST))
    chunk_bytes: int = 2048
    short_chunk_bytes: int = 512
    least_bytes: int = 128
    bad_share: float = 0.34
    level: int = 3


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " whole_ratio double, n_chunks long, n_chunks_repetitive long, n_chunks_incompressible long"
)


def repeated_words(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For texts whose words, as numbers, follow each other in `ids` (counts: words of each), the words of each that lie in a 5-word window found twice or more in that text."""
    total, n = len(ids), len(counts)
    starts = np.cumsum(counts) - counts
    if total < WINDOW + 1:
        return np.zeros(n, np.int64)
    ids = ids.astype(np.uint64)
    of = np.repeat(np.arange(n), counts)
    at = np.flatnonzero(of[: total - WINDOW + 1] == of[WINDOW - 1 :])
    if len(at) < 2:
        return np.zeros(n, np.int64)
    mixed = mix64(ids)
    with np.errstate(over="ignore"):
        key = mix64(of[at].astype(np.uint64) + np.uint64(1 << 40))
        for j in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[at + j]
            key ^= key >> np.uint64(29)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    a, b = at[order[:-1][same]], at[order[1:][same]]
    if (of[a] != of[b]).any() or any((ids[a + j] != ids[b + j]).any() for j in range(WINDOW)):
        # two windows share a key: compare the windows themselves
        rows = np.stack([of[at].astype(np.uint64), *(ids[at + j] for j in range(WINDOW))], axis=1)
        _, inverse, often = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[often[inverse.ravel()] > 1]
    else:
        twice = np.unique(np.concatenate([a, b]))
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
    return (inside[starts + counts] - inside[starts]).astype(np.int64)


def band_of(bands: tuple[Band, ...], size: int) -> Band:
    return next(b for b in reversed(bands) if size >= b.from_bytes)


class Compressor:
    """Ratios of one worker's texts."""

    def __init__(self, bands: Bands):
        self.bands = bands
        self.z = zstandard.ZstdCompressor(level=bands.level, write_checksum=False, write_content_size=False)
        self.empty = len(self.z.compress(b""))

    def ratio(self, text: bytes) -> float:
        return len(text) / max(1, len(self.z.compress(text)) - self.empty)

    def verdict(self, text: bytes) -> tuple[float, int, int, int, bool]:
        """Whole ratio, chunks, chunks too repetitive, chunks incompressible, kept."""
        bands = self.bands
        whole = self.ratio(text) if text else 0.0
        band = band_of(bands.whole, len(text))
        size = bands.chunk_bytes if len(text) >= 2 * bands.chunk_bytes else bands.short_chunk_bytes
        cuts = [*range(0, len(text), size), len(text)]
        if len(cuts) > 2 and cuts[-1] - cuts[-2] < bands.least_bytes:
            del cuts[-2]
        if len(cuts) <= 2:
            return whole, 0, 0, 0, band.least <= whole <= band.most
        high = low = bad = 0
        for a, b in pairwise(cuts):
            ratio, own = self.ratio(text[a:b]), band_of(bands.chunk, b - a)
            high += ratio > own.most
            low += ratio < own.least
            bad += 0 if own.least <= ratio <= own.most else b - a
        return whole, len(cuts) - 1, high, low, band.least <= whole <= band.most and bad <= bands.bad_share * len(text)


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """One row per row of `docs`: counts, ratios and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = Compressor(bands)
        for batch in slices(batches):
            texts = column_bytes(batch)
            _, ids, n_words, _ = words(texts, lower=False)
            repeat = repeated_words(ids, n_words)
            # code points: bytes that don't continue one
            points = np.fromiter((len(t.decode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            spaces = np.fromiter((len(t) - len(t.translate(None, SPACE)) for t in texts), np.int64, len(texts))
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            lines = [[x for x in t.split(b"\n") if x.strip(SPACE)] for t in texts]
            failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
            whole, chunks, high, low, fits = zip(*map(z.verdict, texts), strict=True)
            yield pa.RecordBatch.from_arrays(
                [longs(batch), pa.array(n_words), pa.array(points - spaces), pa.array(symbols, pa.int64()), pa.array([len(x) - len(set(x)) for x in lines], pa.int64()), pa.array(repeat), pa.array(failed), pa.array(np.array(fits) & ~failed), pa.array(whole, pa.float64()), pa.array(chunks, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                names=NAMES,
            )

    return id_and_text(docs).mapInArrow(tidied(run), SCHEMA)


NAMES = [c.split()[0] for c in SCHEMA.split(",")]
