"""SimHash near-duplicates through deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingle hashes have it. Two fingerprints link
when they differ in at most `MOST` = 4 bits.

Search. Four differences fall on three segments (22, 21 and 21 bits) so that one segment differs by at most one
bit: fewer segments than an exact-match scheme needs, at the price of one-wildcard variants. Each fingerprint
is indexed under 64 keys, one per bit position p: the number p and the bits of p's segment other than p. Two
segments that differ in bit p alone share the key of p, and equal segments share all their keys. An equality
join on the key then finds every linked pair at least once, and the full distance is verified.

Groups. Equal fingerprints become one class first, so copies never meet in the index. Within a key, members are
not paired with each other: a breadth-first search over the key's members gives the components of their verified
links, and a spanning forest of them is all that leaves the task. A link (u, v) that holds meets in some key,
where u and v fall in one component; so the union of the forests has exactly the components of all links.
A key with more members than `BLOCK` (one bucket of a large group of near copies) is split: its members are dealt
to blocks, and each pair of blocks is a task's group of its own, so that no task holds more than two blocks. A member
goes to as many groups as its key has blocks: MOST_BLOCKS at most up to a million members, then one more for each 16,384.

Components come from alternating large-star and small-star steps over the forest, each of them written.

Defined cases: null and empty texts, and texts of white space only, have fingerprint zero and link like any
other; fewer than four words are one shingle; repeated rows and ties each get a row; a null doc_id is carried and takes
its class's component (null if the class has no doc_id); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed, column_bytes, id_and_text, longs, slices, tidied, written

SEED = 42
SHINGLE = 4
MOST = 4
#: First bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Members of a key that one group holds; a key with more is dealt to pairs of blocks, of up to WIDEST times as many members.
BLOCK = 1024
MOST_BLOCKS = 64
WIDEST = 16
#: Edges that a task of a components step takes at least, and the tasks of a step over few edges.
EDGES = 1 << 15
LEAST_TASKS = 8
#: Shingles whose bits are unpacked at once.
AT_ONCE = 1 << 17
_SPACE = re.compile(rb"[ \t\n\v\f\r]")
PIECE = 1 << 20


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in pieces of about PIECE bytes, cut between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = _SPACE.search(text, end)
            end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end


def digests(words: list[bytes]) -> bytes:
    """XXH64 of each shingle, 8 bytes each, most significant first."""
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    xx = xxhash.xxh64_digest
    return b"".join([xx(joined[a:b], SEED) for a, b in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)])


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """uint64 fingerprint of each text."""
    found, lengths = [], []
    for text in texts:
        n, carry = 0, []
        for piece in word_pieces(text.lower()):
            words = carry + piece
            if len(words) >= SHINGLE:
                found.append(digests(words))
                n += len(words) - SHINGLE + 1
                carry = words[1 - SHINGLE :]
            else:
                carry = words
        if not n and carry:
            found.append(xxhash.xxh64_digest(b" ".join(carry), SEED))
            n = 1
        lengths.append(n)
    n = np.array(lengths, np.int64)
    counts = np.zeros((len(texts), 64), np.int64)
    hashes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, 8)
    of = np.repeat(np.arange(len(texts)), n)
    for at in range(0, len(hashes), AT_ONCE):
        part = of[at : at + AT_ONCE]
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        counts[part[heads]] += np.add.reduceat(np.unpackbits(hashes[at : at + AT_ONCE], axis=1), heads, axis=0, dtype=np.int32)
    return np.packbits(counts * 2 > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def text_key() -> Column:
    """A hash of the text, which tells rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def fingerprint_rows(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; and text_key, if keyed."""
    more = ["text_key"] * keyed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([longs(batch), pa.array(fingerprints(column_bytes(batch)).view(np.int64)), *(longs(batch, c) for c in more)], names=["doc_id", "fp", *more])

    rows = id_and_text(docs)
    return (rows.withColumn("text_key", text_key()) if keyed else rows).mapInArrow(tidied(run), "doc_id long, fp long" + ", text_key long" * keyed)


def variants(classes: DataFrame) -> DataFrame:
    """key, fp: 64 rows a fingerprint, one for each bit left out of its segment."""
    segment = F.lit(None).cast("long")
    for first, width in SEGMENTS:
        segment = F.when(
            F.col("p").between(first, first + width - 1),
            F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << width) - 1)).bitwiseAND(F.bitwise_not(F.expr(f"shiftleft(1L, p - {first})"))),
        ).otherwise(segment)
    return classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select((F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(segment)).alias("key"), "fp")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MOST


def forest(members: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges (from, to) of the components of distinct fingerprints, by breadth-first search: a member that has been reached is never compared again."""
    out, rest = [], members
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and len(rest):
            hit = near(rest, frontier.pop())
            if hit.any():
                reached = rest[hit]
                rest = rest[~hit]
                frontier.extend(reached)
                out.append((np.full(len(reached), root), reached))
    return out


def group_edges(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal keys: small runs pair by pair all at once, others by forest()."""
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
    a, b = [], []
    at, within = np.flatnonzero(small), keys[small]
    for lag in range(1, 8):
        if len(at) <= lag:
            break
        both = np.flatnonzero(within[lag:] == within[:-lag])
        x, y = fps[at[both]], fps[at[both + lag]]
        hit = near(x, y)
        a.append(x[hit])
        b.append(y[hit])
    for k in np.flatnonzero(sizes > 8):
        for x, y in forest(fps[heads[k] : heads[k] + sizes[k]]):
            a.append(x)
            b.append(y)
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


RUNS = "a long, b long, key long, block int"


def _rows(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None = None, block: np.ndarray | None = None) -> pa.RecordBatch:
    none = lambda kind: pa.nulls(len(a), kind)
    return pa.RecordBatch.from_arrays(
        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else none(pa.int64()), pa.array(key) if key is not None else none(pa.int64()), pa.array(block.astype(np.int32)) if block is not None else none(pa.int32())],
        names=["a", "b", "key", "block"],
    )


def search(batches: Iterator[pa.RecordBatch], block: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> edges (a, b); members of a key that has more than `block` come out as (a, key, block) instead.

    Holds one batch and, of the key that the last batch ended in, at most `block` members.
    """
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    open_key, passed = None, 0  # a key beyond `block` that may go on, and how many of its members have been dealt to blocks
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if passed:
            same = int(np.searchsorted(keys, open_key, side="right"))
            yield _rows(fps[:same], None, keys[:same], (passed + np.arange(same)) // block)
            passed = passed + same if same == len(keys) else 0
            keys, fps = keys[same:], fps[same:]
            if not len(keys):
                continue
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        yield from whole_keys(keys[:last], fps[:last], block)
        keys, fps = keys[last:], fps[last:]
        if len(keys) > block:
            yield _rows(fps, None, keys, np.arange(len(fps)) // block)
            open_key, passed = keys[0], len(fps)
            keys, fps = keys[:0], fps[:0]
    yield from whole_keys(keys, fps, block)


def whole_keys(keys: np.ndarray, fps: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(heads, len(keys)))
    large = np.repeat(sizes > block, sizes)
    if large.any():
        place = np.arange(len(keys)) - np.repeat(heads, sizes)
        yield _rows(fps[large], None, keys[large], place[large] // block)
    a, b = group_edges(keys[~large], fps[~large]) if not large.all() else (fps[:0], fps[:0])
    yield _rows(a, b)


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of a partition -> (node, least node that the partition links it to), by union and find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    pairs = [(x, find(x)) for x in list(parent)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for at in range(0, len(pairs), 100_000):
        a, b = zip(*pairs[at : at + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """a, b: for each node of the edges (a, b) but the least of its component, that least node.

    Large-star and small-star steps, until every edge is a star's. The edges of a star's centre, which may be most of them, are joined to one row: each step
    is written, so that both sides of a join are plain exchanges, which adaptive execution can split, and nothing is computed twice. A task takes EDGES edges
    or more, so few edges are few tasks with few files, whatever the number of shuffle partitions.
    """
    edges = written(edges.mapInArrow(tidied(contract), "a long, b long").where("a > b").distinct(), "edges")
    tasks = max(LEAST_TASKS, -(-edges.count() // EDGES))
    kept = lambda rows, name: written(rows.coalesce(tasks), name)
    least = F.least(F.min("b"), F.col("a")).alias("m")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = kept(both.groupBy("a").agg(least, F.count_if(F.col("b") < F.col("a")).alias("lower"), F.count_if(F.col("b") > F.col("a")).alias("upper")), "least")
        if near.where("lower > 1 or lower > 0 and upper > 0").isEmpty():
            return edges
        # larger neighbours go to the least one
        large = kept(both.where("b > a").join(near.select("a", "m"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        # smaller neighbours, and the node itself, go to the least one
        low = kept(large.groupBy("a").agg(least), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = kept(small.where("a > b").distinct(), "small")


def rooted(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp, least (distinct fingerprints) -> fp, least, root: a fingerprint that names its component."""
    keyed = variants(classes).repartition("key").sortWithinPartitions("key")
    found = written(keyed.mapInArrow(tidied(partial(search, block=block)), RUNS), "links")
    blocks = found.where("key is not null").select("key", F.col("a").alias("fp"), "block")
    # written first, so that the join with a large key's members can be split
    last = checkpointed(blocks.groupBy("key").agg(F.max("block").alias("last")))
    # a key of more than MOST_BLOCKS blocks gets wider ones, up to WIDEST, as each member goes to as many groups as its key has blocks
    width = F.least(F.lit(WIDEST), F.ceil((F.col("last") + 1) / MOST_BLOCKS)).cast("int")
    pairs = (
        blocks.join(last.select("key", "last", width.alias("width")), "key")
        .select("key", "fp", F.expr("block div width").alias("block"), F.explode(F.expr("sequence(0L, last div width)")).alias("other"))
        .select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("pair"), "fp")
        .repartition("pair")
        .sortWithinPartitions("pair")
    )
    more = pairs.mapInArrow(pair_search, "a long, b long")
    edges = found.where("b is not null").select("a", "b").unionByName(more).distinct()
    linked = components(edges)
    return classes.join(linked.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def link(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fp -> doc_id, fp, component_id: the least doc_id that links reach."""
    of = rooted(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), block)
    # written first, so that the join with a large component's classes can be split
    least = checkpointed(of.groupBy("root").agg(F.min("least").alias("component_id")))
    return fps.join(of.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def pair_search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pair, fp) sorted by pair of blocks, at most two blocks each -> edges."""
    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    edges = lambda k, f: pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in group_edges(k, f)], names=["a", "b"])
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last:
            yield edges(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
    if len(keys):
        yield edges(keys, fps)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: one row per row of `docs`."""
    fps = written(fingerprint_rows(docs), "fingerprints")
    return link(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """rooted: least (struct<doc_id, text_key>) and root of each class. -> the rows of `docs` that are the least of their component, and those without a doc_id.

    Of rows that repeat doc_id and text, the one whose columns are the least stays."""
    token = uuid.uuid4().hex
    mark, row = f"text_key_{token}", f"row_{token}"  # no column of the documents has these names
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept")).where("kept is not null").select("kept.doc_id", F.col("kept.text_key").alias(mark))
    named = docs.where("doc_id is not null").withColumn(mark, text_key()).join(kept, ["doc_id", mark], "left_semi")
    one = named.groupBy("doc_id", mark).agg(F.min(F.struct(*docs.columns)).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.where("doc_id is null"))
