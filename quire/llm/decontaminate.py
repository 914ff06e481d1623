"""Benchmark decontamination by template canonicalisation.

Documents and benchmark items become sequences of template tokens: words in lower case without the punctuation around them,
with numbers, units and names replaced by typed placeholders that keep their value as a slot. Characters of scripts without spaces are
tokens by themselves. Windows of five template tokens, three or more of them literal words, are hash-joined: an item's windows are
the build side, and all windows of all documents probe it. A document holds an item when
  - at least LEAST of the item's windows occur in it with consistent slots, and at least that share of the matching windows that have slots are
    consistent: over the windows that match, each value of the item stands for one value of the document and no two values of a type
    for the same one, so that a question with other numbers and names is caught, while windows that merely share wording with
    contradictory values do not count; or
  - both have a run of the same tokens, numbers, units and names of the same value included, with RUN literal words or more, whatever part of
    the item it is (looked for where five of the item's windows lie on one diagonal); or
  - the item has no window (it is short, or mostly numbers and names) and the document has all of its tokens in a row with the same
    values; an item under five tokens only as the whole document.
A name is a capitalised word that doesn't begin a sentence, or one that does and is such a name elsewhere in the text.

Items that differ in values alone are one class, judged by its smallest item_id; the member with the document's own values is
reported if there is one. A window that many items share finds no candidates where rarer ones do: half of an item's windows, the rarest, and one of each
four in a row are joined for candidates, which no match can avoid; a candidate's other windows are looked up in the document.

The benchmark is gone over once and never held by the driver: executors make the index of each block of about `block_words` words and write it to
the shared folder; workers read the blocks and keep the last ones within CACHE_BYTES. Documents are not shuffled. A benchmark
whose indexes (some 40 bytes a word) pass CACHE_BYTES is read again for each BLOCKS_TEXT of documents.

Defined cases: null and empty texts hold nothing and are no items; items without item_id count, and are reported as null; items
that repeat count once if their item_id does, too, and otherwise each; the smallest item_id among the best covered is reported; ties at LEAST
count as held; repeated documents and null doc_ids get a row each; an empty table gives no rows, an empty benchmark leaves all documents
clean; extra columns are ignored (or passed on by `clean`); a long text is held whole, in ten to twenty times its bytes.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, OrderedDict, defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import column_bytes, gathered, id_and_text, longs, mix64, shared_dir, small_batches, tidied, words, written
from quire.llm.files import read_file, write_file

WINDOW = 5
LITERALS = 3
LEAST = 0.5
#: Literal words in a run, the same in item and document, that are evidence whatever the item's length; windows on a diagonal where runs are looked for.
RUN = 13
RUN_WINDOWS = 5
BLOCK_WORDS = 1_000_000
#: Bytes of index that a worker keeps, and bytes of text that go through the blocks at once if there are several.
CACHE_BYTES = 160 << 20
BLOCKS_TEXT = 16 << 20
#: Stands for an item_id that is null: after all others.
NO_ID = (1 << 63) - 1

#: Units of measure, in lower case.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons"
    " ml cl l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years"
    " meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters percent degree degrees cent cents dollar dollars"
    " euro euros pence yen mph kmh watt watts volt volts joule joules newton newtons hertz byte bytes kb mb gb".split()
)
NUMBER, UNIT, NAME, NUMBER_UNIT = 1, 2, 3, 4
_PLACE = {k: np.uint64(0x51A7_0000_0000_0000 + k) for k in (NUMBER, UNIT, NAME, NUMBER_UNIT)}
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w$€£%]+$")
_NUMBER = re.compile(r"[$€£]?[+-]?[0-9][0-9.,/]*%?")
_NUMBER_UNIT = re.compile(r"[0-9][0-9.,]*-?([a-z]+)")


#: Characters of scripts without spaces (kana, unified ideographs), in UTF-8.
_WIDE = re.compile(rb"(\xe3[\x81-\x83\x90-\xbf][\x80-\xbf]|[\xe4-\xe9][\x80-\xbf]{2})")


def classify(word: str) -> tuple[int, int, bool, bool, bytes]:
    """(hash of the literal, kind of placeholder or 0, capitalised, ends a sentence, value); a word of punctuation alone has an empty value."""
    core = _EDGE.sub("", word)
    low = core.lower()
    ends = word.rstrip("\"')]»”’").endswith((".", "!", "?", ":", "…"))
    kind = 0
    if low and (low[0].isdigit() or low[0] in "$€£+-"):
        if _NUMBER.fullmatch(low):
            kind = NUMBER
        elif (m := _NUMBER_UNIT.fullmatch(low)) and m[1] in UNITS:
            kind = NUMBER_UNIT
    elif low in UNITS or low == "%":
        kind = UNIT
    capital = not kind and core[:1].isupper() and core[1:2].islower()
    value = low.encode("utf-8", "replace")
    return xxhash.xxh64_intdigest(value, 7), kind, capital, ends, value


def _joined(mixed: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the five numbers from each place on."""
    key = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            key = key * np.uint64(0x9E3779B97F4A7C15) + mixed[at + j]
            key ^= key >> np.uint64(29)
    return key


class Templates:
    """The template tokens of several texts, one after another: text, literal hash, kind and value of each."""

    def __init__(self, texts: list[bytes]):
        distinct, ids, counts, _ = words([_WIDE.sub(rb" \1 ", t) if _WIDE.search(t) else t for t in texts], lower=False)
        facts = [classify(w.decode("utf-8", "replace")) for w in distinct]
        self.values = [f[4] for f in facts]
        column = lambda i, kind: np.fromiter((f[i] for f in facts), kind, len(facts))[ids]
        literal, kind, capital, ends = column(0, np.uint64), column(1, np.int8), column(2, bool), column(3, bool)
        some = np.fromiter((bool(f[4]) for f in facts), bool, len(facts))[ids]
        of = np.repeat(np.arange(len(texts)), counts)
        begins = np.ones(len(of), bool)
        begins[1:] = ends[:-1] | (of[1:] != of[:-1])
        key = literal ^ mix64(of.astype(np.uint64))
        name = capital & ~begins
        maybe = np.flatnonzero(capital & begins)
        name[maybe[np.isin(key[maybe], key[name])]] = True
        kind = np.where(name, NAME, kind)
        self.of, self.ids, self.kind, self.literal = of[some], ids[some], kind[some], literal[some]
        self.tokens = np.select([self.kind == k for k in _PLACE], list(_PLACE.values()), self.literal)
        self.starts = np.searchsorted(self.of, np.arange(len(texts) + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first token, hash) of each window with enough literals."""
        n = len(self.of)
        if n < WINDOW:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        literals = np.concatenate([[0], np.cumsum(self.kind == 0)])
        fits = (self.of[: n - WINDOW + 1] == self.of[WINDOW - 1 :]) & (literals[WINDOW:] - literals[:-WINDOW] >= LITERALS)
        at = np.flatnonzero(fits)
        return at, _joined(mix64(self.tokens), at)

    def value(self, at: int) -> bytes:
        return self.values[self.ids[at]]


class Index:
    """The classes of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]]):
        t = Templates([x for _, x in items])
        classes: dict[tuple, int] = {}
        chosen: list[int] = []  # an item each class
        self.item_ids: list[int] = []
        self.sizes: list[int] = []
        self.members: dict[tuple[int, tuple[bytes, ...]], int] = {}
        for i, item_id in sorted(enumerate(x for x, _ in items), key=lambda x: x[1]):
            a, b = t.starts[i], t.starts[i + 1]
            if a == b:
                continue
            slots = [(int(t.kind[p]), t.value(p)) for p in (np.flatnonzero(t.kind[a:b]) + a).tolist()]
            order = {s: k for k, s in enumerate(dict.fromkeys(slots))}
            key = (t.tokens[a:b].tobytes(), tuple(order[s] for s in slots))
            c = classes.setdefault(key, len(classes))
            if c == len(chosen):
                chosen.append(i)
                self.item_ids.append(item_id)
                self.sizes.append(0)
            self.sizes[c] += 1
            self.members.setdefault((c, tuple(v for _, v in slots)), item_id)
        t = Templates([items[i][1] for i in chosen])
        self.literal, self.kind, self.starts = t.literal, t.kind, t.starts
        self.value_of = {int(p): t.value(p) for p in np.flatnonzero(t.kind)}
        at, key = t.windows()
        self.keys, self.places = key, at  # by class and place
        self.ranges = np.searchsorted(t.of[at], np.arange(len(chosen) + 1))
        self.total = np.diff(self.ranges)
        joined = np.sort(self.candidates())
        self.joined, self.joined_of = key[joined], t.of[at[joined]]
        order = np.argsort(self.joined, kind="stable")
        self.joined, self.joined_of = self.joined[order], self.joined_of[order]
        size = 1 << max(10, int(len(order) * 16).bit_length())
        self.mask = np.uint64(size - 1)
        self.maybe = np.zeros(size, bool)
        self.maybe[(self.joined & self.mask).astype(np.int64)] = True
        self.whole: dict[bytes, list[int]] = defaultdict(list)  # the first tokens of classes without a window
        for c in np.flatnonzero(self.total == 0).tolist():
            self.whole[t.literal[t.starts[c] : t.starts[c + 1]][:WINDOW].tobytes()].append(c)
        firsts = np.array([np.frombuffer(k, np.uint64) for k in self.whole if len(k) == 8 * WINDOW], np.uint64).reshape(-1, WINDOW)
        self.anchors = np.sort(_joined(mix64(firsts.ravel()), np.arange(len(firsts)) * WINDOW))

    def candidates(self) -> np.ndarray:
        """The windows that find candidates: of each class its rarest, so many that what is left out is less than LEAST, and the rarest of each four in a row."""
        _, at, often = np.unique(self.keys, return_inverse=True, return_counts=True)
        often, of = often[at], np.repeat(np.arange(len(self.total)), self.total)
        rank = np.arange(len(of)) - self.ranges[of]
        by_rarity = np.lexsort((rank, often, of))
        least = by_rarity[rank < (self.total - np.ceil(LEAST * self.total) + 1)[of]]
        group = rank // 4
        by_group = np.lexsort((often, group, of))
        first = np.ones(len(of), bool)
        first[1:] = (of[by_group][1:] != of[by_group][:-1]) | (group[by_group][1:] != group[by_group][:-1])
        return np.unique(np.concatenate([least, by_group[first]]))

    def probe(self, t: Templates) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """(text, item_id, items of its class, windows matched, windows of the item, whether its values are others) for each class that a text holds."""
        at, key = t.windows()
        hit = np.flatnonzero(self.maybe[(key & self.mask).astype(np.int64)])
        first, last = np.searchsorted(self.joined, key[hit], side="left"), np.searchsorted(self.joined, key[hit], side="right")
        hit, first, last = hit[last > first], first[last > first], last[last > first]
        texts = t.of[at[hit]]
        bounds = np.searchsorted(t.of[at], np.arange(len(t.starts)))
        for a, b in pairwise([*np.flatnonzero(np.diff(texts, prepend=-1)), len(hit)]):
            text = int(texts[a])
            found = np.zeros(len(self.total), bool)
            for x, y in set(zip(first[a:b].tolist(), last[a:b].tolist(), strict=True)):
                found[self.joined_of[x:y]] = True
            own = slice(bounds[text], bounds[text + 1])
            order = np.argsort(key[own], kind="stable")
            keys, places = key[own][order], at[own][order]
            for c in np.flatnonzero(found).tolist():
                mine = slice(self.ranges[c], self.ranges[c + 1])
                lo, hi = np.searchsorted(keys, self.keys[mine], side="left"), np.searchsorted(keys, self.keys[mine], side="right")
                n = hi - lo
                matching = int((n > 0).sum())
                if matching < min(np.ceil(LEAST * self.total[c]), RUN_WINDOWS):
                    continue
                item_places = np.repeat(self.places[mine], n)
                text_places = places[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
                matched, member = self.consistent(c, item_places, text_places, t) if matching >= LEAST * self.total[c] else (0, None)
                if matched and matched >= LEAST * self.total[c]:
                    yield text, self.item_ids[c] if member is None else member, self.sizes[c], matched, int(self.total[c]), member is None
                elif n := self.in_runs(c, item_places, text_places, t, text):
                    yield text, self.item_ids[c], self.sizes[c], n, int(self.total[c]), False
        if self.whole:
            yield from self.wholes(t)

    def wholes(self, t: Templates) -> Iterator[tuple[int, int, int, int, int, bool]]:
        """Texts with all tokens and values of classes without a window."""
        at = np.flatnonzero(t.of[: max(0, len(t.of) - WINDOW + 1)] == t.of[WINDOW - 1 :])
        key = _joined(mix64(t.literal), at)
        near = np.minimum(np.searchsorted(self.anchors, key), max(0, len(self.anchors) - 1))
        starts = at[self.anchors[near] == key].tolist() if len(self.anchors) else []
        short = np.flatnonzero(np.diff(t.starts) < WINDOW)
        starts += t.starts[short[t.starts[short] < t.starts[short + 1]]].tolist()
        seen = set()
        for p in starts:
            text = int(t.of[p])
            end = t.starts[text + 1]
            for c in self.whole.get(t.literal[p : min(p + WINDOW, end)].tobytes(), ()):
                a, b = self.starts[c], self.starts[c + 1]
                whole = b - a >= WINDOW or (p == t.starts[text] and end - p == b - a)
                if whole and p + b - a <= end and (text, c) not in seen and (t.literal[p : p + b - a] == self.literal[a:b]).all():
                    seen.add((text, c))
                    yield text, self.item_ids[c], self.sizes[c], 1, 1, False

    def in_runs(self, c: int, item_places: np.ndarray, text_places: np.ndarray, t: Templates, text: int) -> int:
        """The class's windows that lie in runs of the same tokens and values with RUN literal words or more."""
        begin, end = self.starts[c], self.starts[c + 1]
        shift, often = np.unique(text_places - item_places, return_counts=True)
        inside = np.zeros(self.total[c], bool)
        places = self.places[self.ranges[c] : self.ranges[c + 1]]
        literals = np.concatenate([[0], np.cumsum(self.kind[begin:end] == 0)])
        for d in shift[often >= RUN_WINDOWS].tolist():
            lo, hi = max(begin, t.starts[text] - d), min(end, t.starts[text + 1] - d)
            same = self.literal[lo:hi] == t.literal[lo + d : hi + d]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
            for x, y in zip(edges[::2] + lo, edges[1::2] + lo):
                if literals[y - begin] - literals[x - begin] >= RUN:
                    inside |= (places >= x) & (places + WINDOW <= y)
        return int(inside.sum())

    def consistent(self, c: int, item_places: np.ndarray, text_places: np.ndarray, t: Templates) -> tuple[int, int | None]:
        """(the class's windows that match with slots that agree with one mapping of values, 0 if most with slots don't; the item with the values that it maps to)."""
        pairs = []
        votes: dict[tuple[int, bytes], Counter] = defaultdict(Counter)
        for mine, theirs in zip(item_places.tolist(), text_places.tolist(), strict=True):
            pair = [((int(self.kind[mine + j]), self.value_of[mine + j]), t.value(theirs + j)) for j in np.flatnonzero(self.kind[mine : mine + WINDOW]).tolist()]
            pairs.append((mine, pair))
            for value, other in pair:
                votes[value][other] += 1
        taken: dict[tuple[int, bytes], bytes] = {}
        used: set[tuple[int, bytes]] = set()
        for (kind, value), count in sorted(votes.items(), key=lambda x: (-max(x[1].values()), x[0])):
            for other, _ in sorted(count.items(), key=lambda x: (-x[1], x[0])):
                if (kind, other) not in used:
                    taken[kind, value] = other
                    used.add((kind, other))
                    break
        good = {e for e, pair in pairs if all(taken.get(v) == w for v, w in pair)}
        slotted = {e for e, pair in pairs if pair}
        if len(good & slotted) < LEAST * len(slotted):
            return 0, None
        # a value of the class's item that no matching window shows stands for itself
        slots = [(int(self.kind[p]), self.value_of[p]) for p in (np.flatnonzero(self.kind[self.starts[c] : self.starts[c + 1]]) + self.starts[c]).tolist()]
        return len(good), self.members.get((c, tuple(taken.get(s, s[1]) for s in slots)))


class Blocks:
    """The indexes in the shared folder; a worker keeps the last ones that it read."""

    kept: OrderedDict[str, tuple[Index, int]] = OrderedDict()

    def __init__(self, folder: str, present: list[int]):
        self.folder, self.present = folder, present

    def index(self, k: int) -> Index:
        path = f"{self.folder}/block-{k:08d}"
        kept = Blocks.kept
        if path in kept:
            kept.move_to_end(path)
        else:
            data = read_file(path)
            kept[path] = pickle.loads(data), len(data)
            while len(kept) > 1 and sum(size for _, size in kept.values()) > CACHE_BYTES:
                kept.popitem(last=False)
        return kept[path][0]

    def text_bytes(self) -> int:
        return BLOCKS_TEXT if len(self.present) > 1 else BLOCKS_TEXT // 8

    def held(self, texts: list[bytes]) -> dict[int, tuple[int, int, int, int, bool]]:
        """text -> (item_id, items held, matched, windows, other values) of the best covered item."""
        found = defaultdict(list)
        if self.present:
            t = Templates(texts)
            for k in self.present:
                for text, item, n, matched, total, other in self.index(k).probe(t):
                    found[text].append((-matched / total, item, matched, total, other, n))
        return {text: (min(x)[1], sum(y[5] for y in x), *min(x)[2:5]) for text, x in found.items()}


def indexed(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Blocks:
    """Writes the indexes of the benchmark's items (item_id, text), in blocks of about that many words. The driver sees the blocks' numbers."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    folder = f"{shared_dir(benchmark.sparkSession)}/benchmark"

    def build(key: tuple, group: pa.Table) -> pa.Table:
        k = key[0].as_py()
        texts = [x.decode("utf-8", "replace").encode() for x in group["text"].cast(pa.binary()).to_pylist()]
        write_file(f"{folder}/block-{k:08d}", pickle.dumps(Index(list(zip(group["item_id"].to_pylist(), texts, strict=True)))))
        return pa.table({"block": pa.array([k], pa.int64())})

    made = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))).groupBy("block").applyInArrow(build, "block long").repartition(1)
    return Blocks(folder, sorted(r.block for r in written(made, "blocks").collect()))


RESULT = "doc_id long, contaminated boolean, item_id long, n_items long, matched_windows long, item_windows long, other_values boolean"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def judge(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of `docs`: whether it holds an item, which is covered best, and how many are held."""
    blocks = indexed(benchmark, block_words)
    kinds = (pa.bool_(), *[pa.int64()] * 4, pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, blocks.text_bytes()):
            held = blocks.held(column_bytes(batch))
            rows = [(False, None, 0, None, None, None)] * batch.num_rows
            for i, (item, n, matched, total, other) in held.items():
                rows[i] = (True, None if item == NO_ID else item, n, matched, total, other)
            yield pa.RecordBatch.from_arrays([longs(batch), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=_NAMES)

    return id_and_text(docs).mapInArrow(tidied(run), RESULT)


def clean(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, with all their columns, that hold no item of the benchmark."""
    blocks = indexed(benchmark, block_words)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, blocks.text_bytes()):
            keep = np.ones(batch.num_rows, bool)
            keep[list(blocks.held(column_bytes(batch)))] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(run), docs.schema)
