"""SentencePiece encoding and decoding by weighted finite-state transducers.

Encoding composes three transducers with an input and takes the shortest path in the tropical semiring:
  normaliser   compiled from the model's normaliser settings: a meta space for each space, and one before a text that is not empty
               (a model with a character map, or one that drops spaces, is refused);
  pieces       a trie that reads a piece's characters and writes its id, at the weight of minus its score in the model; for a
               character that no piece has, a byte-fallback path reads it and writes the ids of its bytes, at a weight above all pieces';
  order        an acceptor of piece sequences whose states are pieces. It has an arc from a to b (weight 0) only where
               merging the characters of a followed by b gives back a and b.
A byte-pair model is not a unigram model: its segmentation is not the one of greatest score. But a sequence is the
result of merging if, and only if, each neighbouring pair in it is, so the order acceptor leaves just that one path
at finite weight. States of the composition are made as they are reached; the acceptor's arcs are kept once made. While a place is
reached in one state only, that state alone is kept; where a second arrives, or none goes on, all states are searched, and a text
without a path is an error.

A text may be cut wherever no piece spans the cut: before each run of meta spaces, and between characters that no
piece has side by side. A batch's distinct stretches between such cuts are looked up in a bounded table, or searched, once.

Decoding is the inverse: ids to characters and bytes, meta spaces to spaces, without the one in front.

Defined cases: null and empty texts have no ids and decode to an empty text; a meta space that stands in a text decodes to a space, as in
the SentencePiece library (`exact` is false then); repeated rows and null doc_ids are encoded each; an empty table gives no rows; extra
columns are ignored; a long text is encoded whole, in ten to twenty times its bytes, and one without spaces as one stretch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import Kept, column_text, id_and_text, longs, slices, tidied

SPACE = "▁"
KEPT = 200_000
KEPT_PAIRS = 400_000
SHORT = 48


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return out

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield number, message[at : at + size]
            at += size


@dataclass(frozen=True)
class Normaliser:
    """A transducer of two states, before and after a text's first character: what it writes for a space, and before the first character."""

    first: bytes
    space: bytes

    #: Fixed values, of the model's format: the model's field of normaliser settings, and theirs for the character map, the space in
    #: front, the dropping of spaces and the meta space.
    SETTINGS = 3
    CHARACTERS, IN_FRONT, DROPS, META = 2, 3, 4, 5

    @classmethod
    def of(cls, model: bytes) -> Normaliser:
        found = {cls.CHARACTERS: b"", cls.IN_FRONT: 1, cls.DROPS: 1, cls.META: 1}
        for number, value in fields(model):
            if number == cls.SETTINGS:
                found |= dict(fields(value))
        if found[cls.CHARACTERS] or found[cls.DROPS] or not found[cls.META]:
            raise ValueError("a normaliser that maps characters, drops spaces or keeps them plain isn't supported")
        return cls(SPACE.encode() if found[cls.IN_FRONT] else b"", SPACE.encode())

    def __call__(self, text: bytes) -> bytes:
        return self.first + text.replace(b" ", self.space) if text else b""


class Transducers:
    """A byte-pair model's transducers; scores say which merge comes first."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.normaliser = Normaliser.of(model.serialized_model_proto())
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = [b""] * size
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece] = i, model.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a meta space after another character")
        self.byte_set = frozenset(self.byte_ids)
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # the trie of pieces: node -> {character: (node, id or None)}
        self.trie: list[dict[str, tuple[int, int | None]]] = [{}]
        for piece, i in self.ids.items():
            node = 0
            for k, c in enumerate(piece):
                to, out = self.trie[node].get(c, (0, None))
                if not to:
                    self.trie.append({})
                    to = len(self.trie) - 1
                self.trie[node][c] = (to, i if k == len(piece) - 1 else out)
                node = to
        self.names = {i: p for p, i in self.ids.items()}
        self.order: dict[tuple[int, int], bool] = {}
        self.weights = {i: -self.scores[p] for p, i in self.ids.items()}
        self.fallback = max(self.weights.values()) + 10
        self.surfaces = pa.array(self.surface, pa.large_binary())
        self.paths = Kept(lambda x: np.array(self.shortest(x), self.dtype).tobytes(), KEPT // 4, SHORT)
        #: pairs of bytes, both of ASCII characters, that no piece has side by side
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for x, y in self.beside:
            if x.isascii() and y.isascii():
                self.apart[ord(x), ord(y)] = False
        self.stretches = Kept(lambda x: self.stretch(x.decode()), KEPT, SHORT)

    def merged(self, text: str) -> list[str]:
        """The characters of a short text after all merges, greatest score first, the left one of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int) -> bool:
        """Whether the order acceptor has an arc from a to b."""
        known = self.order.get((a, b))
        if known is None:
            x, y = self.names[a], self.names[b]
            known = x[-1] + y[0] not in self.beside or self.merged(x + y) == [x, y]
            if len(self.order) >= KEPT_PAIRS:
                self.order.clear()
            self.order[a, b] = known
        return known

    def arcs(self, text: str, at: int, here: int) -> Iterator[tuple[int, int, float]]:
        """(place after, id or -1 for the bytes of a character, weight) of the arcs from a state: `at` characters read, `here` the last piece or -1."""
        trie, order = self.trie, self.order
        node, end = 0, at
        while end < len(text):
            arc = trie[node].get(text[end])
            if arc is None:
                break
            node, out = arc
            end += 1
            if out is None:
                continue
            if here >= 0:
                fits = order.get((here, out))
                if not (self.follows(here, out) if fits is None else fits):
                    continue
            yield end, out, self.weights[out]
        if text[at] not in self.ids:  # byte fallback; the acceptor starts anew behind it
            yield at + 1, -1, self.fallback

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path of the composition with a normalised text. A state is (characters read, last piece, -1 for none)."""
        n = len(text)
        last, before = [-2] * (n + 1), [0] * (n + 1)  # -2: not reached
        last[0] = -1
        trie, order = self.trie, self.order
        for at in range(n):
            here = last[at]
            if here == -2:
                continue
            node = 0
            for end in range(at, n):  # the arcs of this state, as in arcs()
                arc = trie[node].get(text[end])
                if arc is None:
                    break
                node, out = arc
                if out is not None:
                    if here >= 0:
                        fits = order.get((here, out))
                        if not (self.follows(here, out) if fits is None else fits):
                            continue
                    if last[end + 1] != -2:
                        return self.shortest_of_all(text)
                    last[end + 1], before[end + 1] = out, at
            if text[at] not in self.ids:
                if last[at + 1] != -2:
                    return self.shortest_of_all(text)
                last[at + 1], before[at + 1] = -1, at
        if last[n] == -2:
            return self.shortest_of_all(text)
        path, at = [], n
        while at:
            path.append((before[at], at, last[at]))
            at = before[at]
        return self.written(text, path[::-1])

    def shortest_of_all(self, text: str) -> list[int]:
        """The same with every state of every place."""
        n = len(text)
        states: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]  # last piece -> (weight, place and piece before)
        states[0][-1] = (0.0, 0, -1)
        for at in range(n):
            for here, (weight, _, _) in states[at].items():
                for end, out, cost in self.arcs(text, at, here):
                    if out not in states[end] or weight + cost < states[end][out][0]:
                        states[end][out] = (weight + cost, at, here)
        if not states[n]:
            raise ValueError(f"no path through the model for {text[:80]!r}")
        at, here = n, min(states[n], key=lambda x: states[n][x][0])
        path = []
        while at:
            _, start, previous = states[at][here]
            path.append((start, at, here))
            at, here = start, previous
        return self.written(text, path[::-1])

    def written(self, text: str, path: list[tuple[int, int, int]]) -> list[int]:
        return [i for a, b, out in path for i in ([out] if out >= 0 else [self.byte_ids[x] for x in text[a:b].encode("utf-8", "surrogatepass")])]

    def stretch(self, text: str) -> bytes:
        """Ids of a normalised stretch, cut once more where no piece has the two characters side by side."""
        if text[1:].isascii():  # cut already, but behind its first character
            cuts = [1] if len(text) > 1 and text[:2] not in self.beside else []
        else:
            cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.beside]
        if not cuts:
            return np.array(self.shortest(text), self.dtype).tobytes()
        return b"".join([self.paths[text[a:b]] for a, b in pairwise([0, *cuts, len(text)])])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, as bytes of self.dtype."""
        data = b"".join(normal := [self.normaliser(t) for t in texts])
        u = np.frombuffer(data, np.uint8)
        starts = np.cumsum([0, *map(len, normal)])
        # a stretch begins at a text's start, at a meta space after another character, and between ASCII characters that are never side by side
        meta = np.flatnonzero((u[:-2] == 0xE2) & (u[1:-1] == 0x96) & (u[2:] == 0x81)) if len(u) > 2 else np.zeros(0, np.int64)
        again = np.zeros(len(meta), bool)
        again[1:] = meta[1:] == meta[:-1] + 3
        edge = np.zeros(len(u) + 1, bool)
        edge[meta[~again]] = True
        edge[1:-1] |= self.apart[u[:-1], u[1:]] if len(u) else False
        edge[starts] = True
        edges = np.flatnonzero(edge)
        if len(edges) < 2:
            return [b""] * len(texts)
        stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        ids = pa.array(map(self.stretches.__getitem__, stretches.dictionary.to_pylist()), pa.large_binary()).take(stretches.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1, 8 * ids.offset)[np.searchsorted(edges, starts)].tolist()
        found = memoryview(ids.buffers()[2])
        return [bytes(found[a:b]) for a, b in pairwise(ends)]

    def decode_all(self, ids: list[np.ndarray]) -> list[bytes]:
        """The characters and bytes of each sequence, without the space in front."""
        lengths = np.cumsum([0, *map(len, ids)])
        parts = self.surfaces.take(pa.array(np.concatenate([np.zeros(0, self.dtype), *ids])))
        ends = np.frombuffer(parts.buffers()[1], np.int64, len(parts) + 1, 8 * parts.offset)[lengths].tolist()
        found = memoryview(parts.buffers()[2]) if parts.buffers()[2] is not None else memoryview(b"")
        front = bool(self.normaliser.first)
        return [bytes(found[a + (front and found[a : a + 1] == b" ") : b]) for a, b in pairwise(ends)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text.encode("utf-8", "surrogatepass")])[0]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def transducers(model_file: str) -> Transducers:
    """A worker's transducers; they and what they keep last over tasks."""
    return Transducers(model_file)


SCHEMA = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_chars long, exact boolean"


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """One row per row of `docs`: the ids' number and checksum (little-endian unsigned 32-bit), and whether decoding them gives the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducers(model_file)
        for batch in slices(batches):
            is_byte = np.zeros(len(fst.surface), bool)
            is_byte[fst.byte_ids] = True
            texts = [t.encode() for t in column_text(batch)]
            ids = [np.frombuffer(x, fst.dtype) for x in fst.encode_all(texts)]
            backs = fst.decode_all(ids)
            rows = [(len(x), int(is_byte[x].sum()), zlib.crc32(x.astype("<u4").tobytes()), len(back.decode("utf-8", "replace")), back == text) for x, back, text in zip(ids, backs, texts, strict=True)]
            columns = [pa.array(c, pa.bool_() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([longs(batch), *columns], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs).mapInArrow(tidied(run), SCHEMA)


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids array<int>, exact: the ids themselves, each text's decoded again and compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducers(model_file)
        for batch in slices(batches):
            texts = [t.encode() for t in column_text(batch)]
            ids = [np.frombuffer(x, fst.dtype) for x in fst.encode_all(texts)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, fst.dtype), *ids]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([longs(batch), lists, pa.array([back == t for back, t in zip(fst.decode_all(ids), texts, strict=True)], pa.bool_())], names=["doc_id", "ids", "exact"])

    return id_and_text(docs).mapInArrow(tidied(run), "doc_id long, ids array<int>, exact boolean")
