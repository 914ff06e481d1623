"""Near copies by wide SimHash fingerprints through the same deletion-variant signatures: the pipeline's near-duplicate stage.

The links of simhash.py (64 bits, four of them different at most) hold for shingle sets far above a similarity of 0.8, at which about ten of 64
bits differ. Here a fingerprint has 512 bits over five-word shingles, of which 15 % differ at a Jaccard similarity of 0.8. Two texts are
candidates if they agree, up to one bit, on a segment: each fingerprint is indexed under a one-wildcard key for each indexed bit, and an equality
join on the key brings candidates together, of which at most NARROW of the first 128 bits and MOST of the 512 may differ (3.6 and 3.4 standard deviations above what differs at 0.8). Two
candidates link if the Jaccard similarity of their shingle sets is SIMILARITY or more: exact for texts whose union has up to SKETCH shingles, and beyond
that from the SKETCH least hashes of the union (off by 0.0125 in standard deviation).

Segments have 16 bits, eight of them in two words, whatever the table's size, so a pair that is found in a small table is found in a large one: 93 % of the pairs at a similarity of exactly 0.8 agree
on some segment, 98 % at 0.85 and nearly all above, more where further copies stand between them. A key has about one stranger in 32,768 classes, so comparisons of strangers grow with the square of the table.

Within a key, members aren't all paired. Those with a partner within NARROW leave the task as FORESTS edge-disjoint least spanning forests by distance over the 128 bits. The first forests' edges are
verified; of the others, those whose ends are still apart then, so a failed edge of the tree doesn't part what it held together. Where a key may have more links than its forests and its members are
still apart after that, they are compared with their sketches at hand, by pairs of blocks of all that the keys hold together: every pair that has a key in common and differs in so few bits is verified there unless its ends are linked
by then, and only links that join two components leave the task. So components are those of all links, whatever the sizes of keys and blocks and the order of rows, and no row is made of a pair that fails.
Only the texts of the edges' ends are read again for that, through a broadcast of their keys up to MOST_BROADCAST, else through a shuffle. Equal fingerprints are one class first. A key with more than BLOCK members is dealt to pairs of blocks, as in simhash.py, whose components these edges go to.

Defined cases: null and empty texts, and texts of white space only, are copies of each other; fewer than five words are one shingle; rows that
repeat doc_id and text are one; rows without a doc_id can't be named, take no part and stay; an empty table gives no rows; of a component's rows the least doc_id stays, then the least
hash of the text; all columns are handed on, whatever their names; a long text is a piece of its own, in memory of ten to twenty times its bytes. Classes are named by a 64-bit hash of their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import SLICE_BYTES, checkpointed, column_bytes, id_and_text, longs, mix64, slices, small_batches, tidied, words, written

SHINGLE = 5
WORDS = 8  # of 64 bits
QUARTERS = ((0, 16), (16, 16), (32, 16), (48, 16))
NARROW = 34
MOST = 104
FORESTS = 4
#: Members of a key up to which all pairs are compared at once.
SMALL = 64
SIMILARITY = 0.8
SKETCH = 1024
#: Most keys of texts (24 bytes each) that are broadcast.
MOST_BROADCAST = 200_000
#: Blocks that many members are dealt to, and the least members of one.
DEALT = 32
LEAST = 16
#: One in so many keys shows most members.
PARTS = 16
#: Shingles whose bits are unpacked at once.
AT_ONCE = 1 << 13


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each shingle, one text after another; shingles of each text)."""
    distinct, place, n, _ = words(texts)
    by_word = np.fromiter((xxhash.xxh64_intdigest(w, 5) for w in distinct), np.uint64, len(distinct))
    h = mix64(by_word)[place] if len(distinct) else np.zeros(0, np.uint64)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    starts = np.cumsum(n) - n
    at = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
    end = np.repeat(starts + n, count)
    out = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):  # a short text's shingle has fewer words
            here = at + j < end
            out[here] = mix64(out[here] * np.uint64(0x9E3779B97F4A7C15) + h[at[here] + j])
    return out, count


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64[texts, WORDS]: a bit is set where more than half of the shingles' hashes have it."""
    hashes, n = shingle_hashes(texts)
    of = np.repeat(np.arange(len(texts)), n)
    counts = np.zeros((len(texts), 64 * WORDS), np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = of[at : at + AT_ONCE]
        wide = np.stack([mix64(hashes[at : at + AT_ONCE] ^ np.uint64(k * 0x5851F42D4C957F2D & (1 << 64) - 1)) for k in range(WORDS)], axis=1)
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        counts[part[heads]] += np.add.reduceat(np.unpackbits(wide.view(np.uint8), axis=1), heads, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n[:, None], axis=1).view(np.uint64)


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, node (the class's name), and its fingerprint, a long a word."""
    names = ["doc_id", "text_key", "node", "wide"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES // 2):
            fp = fingerprints(column_bytes(batch))
            node = np.array([xxhash.xxh64_intdigest(r.tobytes(), 3) for r in fp], np.uint64).view(np.int64)
            wide = pa.ListArray.from_arrays(pa.array(np.arange(0, len(fp) * WORDS + 1, WORDS, dtype=np.int32)), pa.array(fp.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([longs(batch), longs(batch, "text_key"), pa.array(node), wide], names=names)

    rows = id_and_text(docs).withColumn("text_key", simhash.text_key())
    return rows.mapInArrow(tidied(run), "doc_id long, text_key long, node long, wide array<long>")


def layout(_: int = 0) -> tuple[int, tuple[tuple[int, int], ...]]:
    """(words that are indexed, the segments of a word): the same for any number of classes."""
    return 2, QUARTERS


def variants(classes: DataFrame, indexed: int, segments: tuple[tuple[int, int], ...]) -> DataFrame:
    """key, node, w0, w1: a row for each class and indexed bit, which is left out of its segment."""
    w0, w1 = (F.get("wide", F.lit(k)).alias(f"w{k}") for k in range(2))
    every = classes.select("node", w0, w1, "wide", F.explode(F.sequence(F.lit(0), F.lit(64 * indexed - 1))).alias("at")).withColumn("p", F.col("at") % 64)
    word = F.get("wide", F.floor(F.col("at") / 64).cast("int"))
    segment = F.lit(None).cast("long")
    for first, width in segments:
        inside = F.shiftrightunsigned(word, first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, p - {first})")))
        segment = F.when(F.col("p").between(first, first + width - 1), inside).otherwise(segment)
    return every.select(F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(segment).alias("key"), "node", "w0", "w1")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _apart(some: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """uint8[some, fps]: the distance of each pair over the 128 bits."""
    return np.bitwise_count(some[:, None, 0] ^ fps[None, :, 0]) + np.bitwise_count(some[:, None, 1] ^ fps[None, :, 1])


FAR = np.uint8(255)


def forests(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (places) of FORESTS least spanning forests of the members, of edges up to NARROW; none has an edge of one before it."""
    apart = np.concatenate([_apart(fps[k : k + 64], fps) for k in range(0, len(fps), 64)])
    apart[(apart > NARROW) | np.eye(len(fps), dtype=bool)] = FAR
    own = np.flatnonzero((apart < FAR).any(axis=1))  # strangers have no edge
    apart, m = apart[np.ix_(own, own)], len(own)
    out = []
    if not m:
        return out
    for _ in range(FORESTS):
        near, parent, rest = np.full(m, FAR), np.zeros(m, np.int64), np.ones(m, bool)
        a, b = [], []
        new = 0
        while True:
            rest[new] = False
            near[new] = FAR
            closer = rest & (apart[new] < near)
            near[closer], parent[closer] = apart[new][closer], new
            new = int(np.argmin(near))
            if near[new] < FAR:
                a.append(parent[new])
                b.append(new)
            elif rest.any():
                new = int(np.argmax(rest))  # another tree
            else:
                break
        if not a:
            break
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        apart[a, b] = apart[b, a] = FAR
        out.append((own[a], own[b]))
    return out


Edges = tuple[np.ndarray, np.ndarray, np.ndarray]


def group_edges(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Edges:
    """Edges (node, node, number of their forest) within runs of equal keys. In small runs all pairs are compared at once, so that strangers cost little."""
    return _grouped(keys, nodes, fps)[0]


def _grouped(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> tuple[Edges, np.ndarray]:
    """(group_edges, places of the members of runs that may have more links than their forests)."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(heads, len(keys)))
    run = np.repeat(np.arange(len(heads)), sizes)
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
    a, b = [small[:0]], [small[:0]]
    at = small
    for lag in range(1, SMALL):
        at = at[at + lag < len(keys)]
        at = at[keys[at + lag] == keys[at]]  # a member without a neighbour this far on has none farther
        if not len(at):
            break
        hit = at[distance(fps[at], fps[at + lag]) <= NARROW]
        a.append(hit)
        b.append(hit + lag)
    a, b = np.concatenate(a), np.concatenate(b)
    pairs = np.bincount(run[a], minlength=len(heads))
    alone = pairs[run[a]] == 1
    found = [(nodes[a[alone]], nodes[b[alone]], np.zeros(np.count_nonzero(alone), np.int64))]
    close = np.zeros(len(keys), bool)
    close[a], close[b] = True, True
    more = [small[:0]]
    for k in np.flatnonzero((pairs > 1) | (sizes > SMALL)).tolist():
        members = np.arange(heads[k], heads[k] + sizes[k])
        if sizes[k] <= SMALL:
            members = members[close[members]]
        trees = forests(fps[members])
        found += [(nodes[members[x]], nodes[members[y]], np.full(len(x), rank)) for rank, (x, y) in enumerate(trees)]
        if len(trees) == FORESTS:
            more.append(members[np.unique(np.concatenate(trees[0]))])  # the first forest spans all that have a link
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)), np.concatenate(more)


FOUND = "a long, b long, forest int, key long, block int, w0 long, w1 long"
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("forest", pa.int32()), ("key", pa.int64()), ("block", pa.int32()), ("w0", pa.int64()), ("w1", pa.int64())])


def _edges(a: np.ndarray, b: np.ndarray, forest: np.ndarray) -> pa.RecordBatch:
    """Each edge once, with the first of its forests."""
    rows = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), forest], axis=1), axis=0) if len(a) else np.zeros((0, 3), np.int64)
    rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])] if len(rows) else rows
    return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(np.int32)), *(pa.nulls(len(rows), f.type) for f in list(_FOUND)[3:])], schema=_FOUND)


def _members(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray, block: np.ndarray, forest: pa.Array | None = None) -> pa.RecordBatch:
    """Members of large keys; with a forest of -1, of keys that may have more links than their forests."""
    words_, none = np.ascontiguousarray(fps).view(np.int64), [pa.nulls(len(nodes), pa.int64()), pa.nulls(len(nodes), pa.int32()) if forest is None else forest]
    return pa.RecordBatch.from_arrays([pa.array(nodes), *none, pa.array(keys), pa.array(block.astype(np.int32)), pa.array(words_[:, 0]), pa.array(words_[:, 1])], schema=_FOUND)


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, nodes, w0, w1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
    return keys, nodes, np.stack([w0, w1], axis=1).view(np.uint64)


def _empty() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.uint64)


def search(block: int):  # noqa: ANN201  a pass over batches
    """Rows (key, node, w0, w1) sorted by key -> edges, or the members of keys that have more than `block`, by block. Holds one batch and at most `block` members of the key that it ended in."""

    def whole(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(heads, len(keys)))
        large = np.repeat(sizes > block, sizes)
        if large.any():
            place = np.arange(len(keys)) - np.repeat(heads, sizes)
            yield _members(keys[large], nodes[large], fps[large], place[large] // block)
        keys, nodes, fps = keys[~large], nodes[~large], fps[~large]
        edges, more = _grouped(keys, nodes, fps)
        yield _edges(*edges)
        if len(more):
            yield _members(keys[more], nodes[more], fps[more], np.zeros(len(more)), pa.array(np.full(len(more), -1, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_key, passed = _empty(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held = tuple(np.concatenate(x) for x in zip(held, _columns(batch), strict=True))
            if passed:
                same = int(np.searchsorted(held[0], open_key, side="right"))
                yield _members(*(x[:same] for x in held), (passed + np.arange(same)) // block)
                passed = passed + same if same == len(held[0]) else 0
                held = tuple(x[same:] for x in held)
                if not len(held[0]):
                    continue
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield from whole(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
            if len(held[0]) > block:
                yield _members(*held, np.arange(len(held[0])) // block)
                open_key, passed, held = held[0][0], len(held[0]), _empty()
        yield from whole(*held)

    return run


def pair_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, node, w0, w1) sorted by pair of blocks, at most two blocks each -> edges."""
    held = _empty()
    for batch in batches:
        if not batch.num_rows:
            continue
        held = tuple(np.concatenate(x) for x in zip(held, _columns(batch), strict=True))
        last = int(np.searchsorted(held[0], held[0][-1], side="left"))
        if last:
            yield _edges(*group_edges(*(x[:last] for x in held)))
            held = tuple(x[last:] for x in held)
    if len(held[0]):
        yield _edges(*group_edges(*held))


def links_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, node, w0, w1, root) sorted by pair of blocks, at most two blocks each -> the pairs (a, b) up to NARROW whose roots differ. All of them, one by one: similar_links verifies such pairs where they meet."""

    def whole(pair: np.ndarray, nodes: np.ndarray, fps: np.ndarray, roots: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(pair)], strict=False):
            n, f, r = nodes[start:end], fps[start:end], roots[start:end]
            for k in range(0, len(n), 64):
                x, y = np.nonzero((_apart(f[k : k + 64], f) <= NARROW) & (r[k : k + 64, None] != r[None]) & (n[k : k + 64, None] < n[None]))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(n[k + x]), pa.array(n[y])], names=["a", "b"])

    held = (*_empty(), np.zeros(0, np.int64))
    for batch in batches:
        if batch.num_rows:
            held = tuple(np.concatenate(x) for x in zip(held, (*_columns(batch), batch.column(4).to_numpy(zero_copy_only=False)), strict=True))
            last = int(np.searchsorted(held[0], held[0][-1], side="left"))
            yield from whole(*(x[:last] for x in held))
            held = tuple(x[last:] for x in held)
    yield from whole(*held)


def agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """bool[pairs]: whether fingerprints have a key in common, that is, agree up to one bit on a segment."""
    words_, segments = layout()
    return np.any([np.bitwise_count((x[:, w] ^ y[:, w]) >> np.uint64(first) & np.uint64((1 << width) - 1)) <= 1 for w in range(words_) for first, width in segments], axis=0)


def similar_apart(roots: np.ndarray, side: np.ndarray, wide: np.ndarray, sketched: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(places, places) of links that join all members whose roots differ and that are linked: at most one less than there are members.

    Of two sides, only pairs across them are looked at. All pairs of members are compared by fingerprint, and the candidates by the hashes that their sketches have in common, which
    one list of members a hash counts for a member and all others at once."""
    n = np.array([len(x) // 8 for x in sketched], np.int64)
    held = np.frombuffer(b"".join(sketched), "<u8")
    of = np.repeat(np.arange(len(n)), n)
    place = np.unique(held, return_inverse=True)[1]
    has = of[np.argsort(place, kind="stable")]  # the members that have a hash, one hash after another
    count = np.bincount(place)
    start, ends = np.cumsum(count) - count, np.cumsum(n)
    label, two = np.unique(roots, return_inverse=True)[1], (side != side[:1]).any()
    a, b = [], []
    for k in range(len(n)):
        later = np.flatnonzero(label[k + 1 :] != label[k]) + k + 1
        if two:
            later = later[side[later] != side[k]]
        later = later[_apart(wide[k : k + 1], wide[later])[0] <= NARROW]
        later = later[agree(wide[k : k + 1], wide[later]) & (distance(wide[k : k + 1], wide[later]) <= MOST)]
        if not len(later):
            continue
        own = place[ends[k] - n[k] : ends[k]]
        sizes = count[own]
        at = np.repeat(start[own] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        common = np.bincount(has[at], minlength=len(n))[later]
        union = n[k] + n[later] - common
        whole = union <= SKETCH
        may = (common >= SIMILARITY * SKETCH) & ~whole  # what the least hashes of the union have in common isn't more
        may[whole] = np.where(union[whole] > 0, common[whole] / np.maximum(union[whole], 1), 1.0) >= SIMILARITY
        for other, exact in zip(later[may].tolist(), whole[may].tolist(), strict=True):
            if label[other] != label[k] and (exact or similarity(sketched[k], sketched[other]) >= SIMILARITY):
                a.append(k)
                b.append(other)
                label[label == label[other]] = label[k]
    return np.array(a, np.int64), np.array(b, np.int64)


def similar_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, node, root, block, wide, sketch) sorted by pair of blocks, at most two blocks each -> similar_apart of each pair, (a, b)."""

    def whole(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        pair, nodes, roots, block = (rows.column(k).to_numpy() for k in range(4))
        wide = pc.list_flatten(rows.column(4)).to_numpy().view(np.uint64).reshape(-1, WORDS)
        heads = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        for start, end in zip(heads.tolist(), [*heads[1:].tolist(), len(pair)], strict=True):
            x, y = similar_apart(roots[start:end], block[start:end], wide[start:end], rows.column(5).slice(start, end - start).to_pylist())
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[start + x]), pa.array(nodes[start + y])], names=["a", "b"])

    held = None
    for batch in batches:
        if batch.num_rows:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            pair = held.column(0).to_numpy()
            last = int(np.searchsorted(pair, pair[-1], side="left"))
            if last:
                yield from whole(held.slice(0, last))
                held = held.slice(last).combine_chunks()
    if held is not None:
        yield from whole(held)


def close(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """The edges (a, b) whose fingerprints differ in MOST bits at most."""
    side = lambda name: classes.select(F.col("node").alias(name), F.col("wide").alias(f"{name}_wide"))
    both = edges.join(side("a"), "a").join(side("b"), "b")
    bits = sum((F.bit_count(F.get("a_wide", F.lit(k)).bitwiseXOR(F.get("b_wide", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    return both.where(bits <= MOST).select("a", "b")


def sketch(text: bytes) -> bytes:
    """The SKETCH least hashes of a text's shingles, ascending."""
    return np.unique(shingle_hashes([text])[0])[:SKETCH].astype("<u8").tobytes()


def similarity(a: bytes, b: bytes) -> float:
    """Jaccard similarity by the least hashes of the union."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    union = np.union1d(x, y)[:SKETCH]
    return float(np.isin(union, np.intersect1d(x, y)).mean()) if len(union) else 1.0


def sketches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: node, doc_id, text_key. -> node, sketch: of the text of each."""
    rows = id_and_text(docs).withColumn("text_key", simhash.text_key())
    wanted = written(wanted, "wanted")
    few = wanted.count() <= MOST_BROADCAST
    texts = rows.join(F.broadcast(wanted) if few else wanted, ["doc_id", "text_key"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([longs(batch, "node"), pa.array(map(sketch, column_bytes(batch)), pa.binary())], names=["node", "sketch"])

    return texts.mapInArrow(tidied(run), "node long, sketch binary").groupBy("node").agg(F.min("sketch").alias("sketch"))


def verified(edges: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The edges (a, b) between texts of SIMILARITY or more."""
    edges = written(close(edges, classes), "edges")
    ends = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    found = written(sketches(docs, classes.join(ends, "node").select("node", "least.doc_id", "least.text_key")), "sketches")
    side = lambda name: found.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [similarity(x, y) >= SIMILARITY for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(same, pa.bool_()))

    both = edges.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch")
    return both.mapInArrow(tidied(run), "a long, b long")


def _by_pairs(members: DataFrame, last: DataFrame) -> DataFrame:
    """pair, node, w0, w1 of the members of the keys (key, last block) for each pair of a key's blocks, sorted by pair."""
    width = F.least(F.lit(simhash.WIDEST), F.ceil((F.col("last") + 1) / simhash.MOST_BLOCKS)).cast("int")
    return (
        members.join(last.select("key", "last", width.alias("width")), "key")
        .select("key", "node", "w0", "w1", F.expr("block div width").alias("block"), F.explode(F.expr("sequence(0L, last div width)")).alias("other"))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "node", "w0", "w1")
        .repartition("pair")
        .sortWithinPartitions("pair", "node")
    )


def members_of(have: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct (node, root) of rows (key, node, root) whose keys are among the keys. A member has up to a hundred of them: those that one part in PARTS of the keys shows aren't looked up in the others."""
    some = F.pmod(F.xxhash64("key"), F.lit(PARTS)) == 0
    shown = written(have.where(some).join(keys.where(some), "key").select("node", "root").distinct(), "shown")
    rest = have.where(~some).join(shown.select("node"), "node", "left_anti").join(keys, "key").select("node", "root").distinct()
    return written(shown.unionByName(rest), "parted")


def others_apart(members: DataFrame, edges: DataFrame, classes: DataFrame, docs: DataFrame, block: int) -> DataFrame:
    """Links (a, b) that join what is linked among members (node, root; of the keys that may have links beyond their forests) and has different roots: some of all such links, as many as a forest has in each pair of blocks.

    The spanning edges of the keys hold together all that can be linked. What they hold together is dealt to DEALT blocks, fewer if they had less than LEAST members and more if more than `block`; each pair of
    blocks compares its members with their sketches at hand. So rows grow with members times blocks, and no pair that fails is a row."""
    node = members.select("node")
    inside = edges.join(node.withColumnRenamed("node", "a"), "a", "left_semi").join(node.withColumnRenamed("node", "b"), "b", "left_semi")
    held = simhash.components(inside).select(F.col("a").alias("node"), F.col("b").alias("of"))
    held = members.join(held.unionByName(held.select(F.col("of").alias("node"), "of").distinct()), "node")
    held = written(held, "held")
    # written first, so that the join with many members can be split
    blocks = F.ceil(F.col("n") / F.least(F.lit(block), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / DEALT)))).cast("int").alias("blocks")
    parted = checkpointed(held.groupBy("of").agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("of", blocks))
    held = written(held.join(parted, "of"), "apart")
    small_batches(docs.sparkSession)
    named = classes.join(held.select("node"), "node", "left_semi")
    own = named.select("node", "wide").join(sketches(docs, named.select("node", "least.doc_id", "least.text_key")), "node")
    return (
        held.join(written(own, "sketches"), "node")
        .withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .select("of", "node", "root", "block", "wide", "sketch", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
        .select(F.xxhash64("of", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "node", "root", "block", "wide", "sketch")
        .repartition("pair")
        .sortWithinPartitions("pair", "node")
        .mapInArrow(tidied(similar_links), "a long, b long")
    )


def rooted(classes: DataFrame, docs: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """node, least (struct<doc_id, text_key>) and fingerprints of distinct classes (a table that can be read again) -> node, least, root."""
    keyed = variants(classes, *layout()).repartition("key").sortWithinPartitions("key", "node")
    found = written(keyed.mapInArrow(tidied(search(block)), FOUND), "links")
    blocks = found.where("key is not null and forest is null").select("key", F.col("a").alias("node"), "block", "w0", "w1")
    # written first, so that the join with a large key's members can be split
    last = checkpointed(blocks.groupBy("key").agg(F.max("block").alias("last")))
    more = _by_pairs(blocks, last).mapInArrow(tidied(pair_search), FOUND).select("a", "b", "forest")
    edges = found.where("b is not null").select("a", "b", "forest").unionByName(more).groupBy("a", "b").agg(F.min("forest").alias("forest"))
    edges = written(edges, "candidates")
    first = verified(edges.where("forest = 0").select("a", "b"), classes, docs)
    first = written(first, "first")
    place = lambda linked, name: linked.select(F.col("a").alias(name), F.col("b").alias(f"{name}_root"))
    linked = simhash.components(first)
    rest = edges.where("forest > 0").join(place(linked, "a"), "a", "left").join(place(linked, "b"), "b", "left")
    apart = written(rest.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), "apart")
    if not apart.isEmpty():
        first = written(first.unionByName(verified(apart, classes, docs)), "second")
        linked = simhash.components(first)
    # all other links whose ends are apart, of the keys that may have some
    roots = linked.select(F.col("a").alias("node"), F.col("b").alias("root"))
    have = found.where("key is not null").select("key", F.col("a").alias("node")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    have = written(have, "members")
    parted = checkpointed(have.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key"))
    if not parted.isEmpty():
        members = members_of(have, parted)
        others = written(others_apart(members, edges.where("forest = 0").select("a", "b"), classes, docs, block), "others")
        if not others.isEmpty():
            linked = simhash.components(first.unionByName(others))
    return classes.join(linked.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))


def deduplicate(docs: DataFrame, block: int = simhash.BLOCK) -> DataFrame:
    """The documents, with all their columns, one of each component: the row of the least doc_id, and of its rows the one of the least text key."""
    rows = fingerprint_rows(docs.where("doc_id is not null"))
    least = F.min(F.struct("doc_id", "text_key")).alias("least")
    classes = written(rows.groupBy("node").agg(least, F.min("wide").alias("wide")), "classes")
    return simhash.one_of_each(docs, rooted(classes, docs, block))
