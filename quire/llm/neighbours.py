"""Approximate nearest neighbours by cosine, through an inverted multi-index.

Equal vectors are one class first, with the EACH smallest ids that a query of five can need, so that copies of a frequent vector, however
many, are one entry and one query. The halves of the unit vectors are quantised separately, by K centroids each, fitted on SAMPLE
classes at most (those of the least hashes); an entry's cell is its pair of centroids, K x K in all. Every entry is in the index.

Search. A query goes over the pairs of centroids in the order of their summed distances, which a heap yields from the two sorted lists of distances, until
the cells that it has visited hold BUDGET entries; those entries are compared in double precision. The budget isn't fixed: CALIBRATION queries
(those of the least hashes) are compared with all entries in one pass, and the budget is the least with which RECALL of their true neighbours lie in visited cells. So
where halves say much about the whole few cells are read, and where vectors are like noise a good part of all. `recall` measures what
a search has found.

Work is dealt in shelves: runs of neighbouring cells, up to SHELF_BYTES of vectors; a cell with more is split over shelves. A query is sent once to each
shelf that holds cells of its visit, with the list of those. A task holds one shelf's entries and streams queries past them, cell by cell; with more than QUERIES
queries, shelves are copied for each block of queries. The EACH best of each query and shelf are merged by query.

To the driver go the sample, K x K cell counts (65,536 at most), and the calibration queries' neighbours.

Defined cases: vectors null, zero, of a norm that a double can't hold, or with null or non-finite components take no part, nor do rows without vec_id
or vectors whose length isn't the most frequent one (of equally frequent ones, the greater); rows are told apart by vec_id: rows that repeat both vec_id and vector are one
candidate and are queries each; a vec_id with several vectors asks once a vector, and none of them is its own neighbour; equal scores are by ascending
vec_id; fewer candidates than wanted give fewer rows, and an empty table none; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quire.llm.common import small_batches, tidied, written

NEAREST = 5
EACH = NEAREST + 1
EVERY = 50
SAMPLE = 16_384
ROUNDS = 12
MOST_CENTROIDS = 256
CALIBRATION = 256
RECALL = 0.96
SHELF_BYTES = 16 << 20
LEAST_SHELF = 4096
QUERIES = 1 << 18
#: Scores that a task holds at once.
AT_ONCE = 1 << 21
#: Scores this close to the last one that counts are compared by the exact measure.
CLOSE = 1e-9


def asks(vec_id: Column) -> Column:
    return F.pmod(vec_id, F.lit(EVERY)) == 0


@dataclass(frozen=True)
class Kind:
    """Length of the vectors, and how their components are kept."""

    size: int
    dtype: str

    def matrix(self, packed: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(packed.to_pylist()), self.dtype).reshape(-1, self.size)


def kind(vectors: DataFrame) -> Kind | None:
    """By the most frequent length; None if there is no vector."""
    element = vectors.schema["embedding"].dataType.elementType
    most = vectors.where("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return Kind(most["size"], "<f4" if isinstance(element, FloatType) else "<f8") if most else None


def packed(vectors: DataFrame, of: Kind) -> DataFrame:
    """class (a hash of the vector), v (its components' bytes), ids, asked: the rows that take part, a batch's equal vectors together; ids has the EACH smallest, asked those that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            whole = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(column), of.size), False), batch.column(0).is_valid())
            ids, column = batch.column(0).filter(whole).to_numpy(), column.filter(whole)
            if not len(ids):
                continue
            flat = column.flatten()
            filled = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False).astype(of.dtype).reshape(-1, of.size)
            with np.errstate(over="ignore"):
                squared = (filled.astype(np.float64) ** 2).sum(axis=1)
            good = np.isfinite(squared) & (squared > 0)
            ids, filled = ids[good], np.ascontiguousarray(filled[good])
            groups: dict[bytes, tuple[bytes, list[int]]] = {}
            for i, row in zip(ids.tolist(), filled, strict=True):
                v = row.tobytes()
                groups.setdefault(xxhash.xxh3_128_digest(v), (v, []))[1].append(i)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(groups), pa.binary()),
                    pa.array([v for v, _ in groups.values()], pa.binary()),
                    pa.array([sorted(set(x))[:EACH] for _, x in groups.values()], pa.list_(pa.int64())),
                    pa.array([[i for i in x if i % EVERY == 0] for _, x in groups.values()], pa.list_(pa.int64())),
                ],
                names=["class", "v", "ids", "asked"],
            )

    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if of.dtype == "<f4" else "array<double>").alias("embedding"))
    return rows.mapInArrow(tidied(run), "class binary, v binary, ids array<long>, asked array<long>")


def classes(vectors: DataFrame, of: Kind) -> DataFrame:
    """class, v, ids (the EACH smallest), asks (whether any of its rows is a query): a row a distinct vector."""
    rows = packed(vectors, of).select("class", "v", "ids", (F.size("asked") > 0).alias("asks"))
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, EACH)
    return written(rows.groupBy("class").agg(F.first("v").alias("v"), ids.alias("ids"), F.max("asks").alias("asks")), "classes")


def units(vectors: np.ndarray) -> np.ndarray:
    out = vectors.astype(np.float64)
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, without the part that is a point's own: its order is the same."""
    return (centroids**2).sum(axis=1) - 2 * points @ centroids.T


def centroids(points: np.ndarray, k: int) -> np.ndarray:
    """k means of the points, from evenly spaced ones; a centroid that loses all its points stays."""
    if not points.shape[1]:  # the second half of vectors of one component
        return points[:k]
    out = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        of = distances(points, out).argmin(axis=1)
        n = np.bincount(of, minlength=k)
        sums = np.stack([np.bincount(of, points[:, j], k) for j in range(points.shape[1])], axis=1)
        out[n > 0] = sums[n > 0] / n[n > 0, None]
    return out


@dataclass
class MultiIndex:
    """Centroids of both halves; once counted, entries of each cell, the budget, and each cell's first shelf and number of shelves."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray | None = None
    budget: int = 0
    shelf: np.ndarray | None = None
    shelves: np.ndarray | None = None

    @property
    def k(self) -> int:
        return len(self.first)

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return distances(unit[:, :cut], self.first), distances(unit[:, cut:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.halves(unit)
        return a.argmin(axis=1) * self.k + b.argmin(axis=1)

    def visit(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """The cells of one query, by the sum of its distances to both centroids, until they hold `budget` entries."""
        rows, columns = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y, counts, k = a[rows].tolist(), b[columns].tolist(), self.counts, self.k
        rows, columns = rows.tolist(), columns.tolist()
        out, held, heap = [], 0, [(x[0] + y[0], 0, 0)]
        while heap and held < self.budget:
            _, i, j = heapq.heappop(heap)
            cell = rows[i] * k + columns[j]
            if counts[cell]:
                out.append(cell)
                held += counts[cell]
            # (i, j) is reached from (i, j - 1) alone, and (i, 0) from (i - 1, 0): each pair once, none before a nearer one
            if j + 1 < k:
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))
        return out

    def needed(self, unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """For queries and a cell each: how many entries a visit holds before it comes to that cell, plus one."""
        a, b = self.halves(unit)
        out = np.empty(len(cells), np.int64)
        for i, cell in enumerate(cells.tolist()):
            sums = (a[i][:, None] + b[i][None, :]).ravel()
            out[i] = 1 + self.counts[(sums < sums[cell]) | ((sums == sums[cell]) & (np.arange(len(sums)) < cell))].sum()
        return out

    def lay(self, most: int) -> None:
        """Deals cells to shelves of up to `most` entries."""
        self.shelf, self.shelves = np.zeros(len(self.counts), np.int64), np.ones(len(self.counts), np.int64)
        at = held = 0
        for cell, n in enumerate(self.counts.tolist()):
            if held and held + n > most:
                at, held = at + 1, 0
            parts = max(1, -(-n // most))
            self.shelf[cell], self.shelves[cell] = at, parts
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)


def fit(entries: DataFrame, of: Kind, n: int) -> MultiIndex:
    """Centroids by a sample of SAMPLE classes; the class is a hash, so the least ones are a fair sample."""
    least = min(1.0, 1.2 * SAMPLE / max(n, 1))
    bound = bytearray(int(least * (2**32 - 1)).to_bytes(4, "big")) + b"\xff" * 12
    rows = entries.where(F.col("class") <= F.lit(bytes(bound))).select("class", "v").limit(SAMPLE).collect()
    unit = units(of.matrix(pa.array([bytes(r.v) for r in sorted(rows, key=lambda r: bytes(r["class"]))], pa.binary())))
    k = int(min(MOST_CENTROIDS, len(unit), max(1, round(n**0.5 / 4))))
    cut = max(1, of.size // 2)
    return MultiIndex(centroids(unit[:, :cut], k), centroids(unit[:, cut:], k))


def better(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("place") <= most)


def count(index: MultiIndex, entries: DataFrame, of: Kind, recall: float) -> None:
    """Entries of each cell, and the budget, by one pass over all entries."""
    sample = entries.where("asks").orderBy("class").select("class", "v").limit(CALIBRATION).collect()
    wanted = units(of.matrix(pa.array([bytes(r.v) for r in sample], pa.binary())))
    own = {bytes(r["class"]): i for i, r in enumerate(sample)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(index.k**2, np.int64)
        best, where = np.full((len(wanted), NEAREST), -2.0), np.full((len(wanted), NEAREST), -1)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                unit = units(of.matrix(part.column(1)))
                cells = index.cells(unit)
                total += np.bincount(cells, minlength=len(total))
                near = wanted @ unit.T
                for j, c in enumerate(part.column(0).to_pylist()):
                    if c in own:
                        near[own[c], j] = -2.0
                near = np.concatenate([best, near], axis=1)
                where_all = np.concatenate([where, np.broadcast_to(cells, (len(wanted), len(cells)))], axis=1)
                top = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
                best, where = np.take_along_axis(near, top, 1), np.take_along_axis(where_all, top, 1)
        at, (q, j) = np.flatnonzero(total), np.nonzero(where >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(at), pa.array(total[at].astype(float))], names=["query", "cell", "value"])
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(where[q, j]), pa.array(best[q, j])], names=["query", "cell", "value"])

    found = written(entries.select("class", "v").mapInArrow(tidied(run), "query long, cell long, value double"), "counted")
    index.counts = np.zeros(index.k**2, np.int64)
    for cell, n in found.where("query < 0").groupBy("cell").agg(F.sum("value")).collect():  # K x K at most
        index.counts[cell] = int(n)
    near = better(found.where("query >= 0"), "query", [F.desc("value")], NEAREST).select("query", "cell").collect()
    n = int(index.counts.sum())
    index.budget = n
    if near:
        needed = np.sort(index.needed(wanted[[q for q, _ in near]], np.array([c for _, c in near])))
        index.budget = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


ROWS = "key long, asking boolean, class binary, v binary, ids array<long>, cells array<int>"


def _rows(key: list, asking: bool, batch: pa.RecordBatch, at: list, cells: list) -> pa.RecordBatch:
    rows = batch.take(pa.array(at, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array([asking] * len(at), pa.bool_()), rows.column(0), rows.column(1), rows.column(2), pa.array(cells, pa.list_(pa.int32()))],
        names=["key", "asking", "class", "v", "ids", "cells"],
    )


def shelved(index: MultiIndex, entries: DataFrame, of: Kind, blocks: int) -> DataFrame:
    """The entries, once for each block of queries, and the queries, once for each shelf that they visit; both under the key of shelf and block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                unit = units(of.matrix(part.column(1)))
                names = np.array([int.from_bytes(c[8:], "big") for c in part.column(0).to_pylist()], np.uint64)
                cells = index.cells(unit)
                shelf = index.shelf[cells] + (names % index.shelves[cells].astype(np.uint64)).astype(np.int64)
                for block in range(blocks):
                    yield _rows((shelf * blocks + block).tolist(), False, part, list(range(part.num_rows)), [[c] for c in cells.tolist()])
                a, b = index.halves(unit)
                for i in np.flatnonzero(part.column(3).to_numpy(zero_copy_only=False)).tolist():
                    block = int(names[i] >> np.uint64(32)) % blocks
                    by: dict[int, list[int]] = {}
                    for cell in sorted(index.visit(a[i], b[i])):
                        for s in range(index.shelf[cell], index.shelf[cell] + index.shelves[cell]):
                            by.setdefault(int(s), []).append(cell)
                    yield _rows([s * blocks + block for s in by], True, part, [i] * len(by), list(by.values()))

    return entries.select("class", "v", "ids", "asks").mapInArrow(tidied(run), ROWS)


class Shelf:
    """The entries of one shelf, by cell."""

    def __init__(self, of: Kind, rows: pa.Table):
        cells = rows.column("cells").combine_chunks().flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        self.of, cells = of, cells[order]
        rows = rows.take(pa.array(order))
        self.vectors = of.matrix(rows.column("v").combine_chunks()).astype(np.float64)
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.units = self.vectors / self.norms[:, None]
        self.ids = rows.column("ids").to_pylist()
        heads = np.flatnonzero(np.diff(cells, prepend=-1))
        self.range = dict(zip(cells[heads].tolist(), zip(heads.tolist(), np.append(heads[1:], len(cells)).tolist(), strict=True), strict=True))

    def answer(self, asked: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """class, vec_id, score: the EACH best of each query among the entries of the cells that it visits."""
        vectors = self.of.matrix(asked.column(3)).astype(np.float64)
        norms = np.sqrt((vectors**2).sum(axis=1))
        unit = vectors / norms[:, None]
        lists = asked.column(5)
        cells = lists.flatten().to_numpy()
        who = np.repeat(np.arange(asked.num_rows), pc.list_value_length(lists).to_numpy())
        order = np.argsort(cells, kind="stable")
        cells, who = cells[order], who[order]
        best = np.full((asked.num_rows, EACH), -2.0)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        heads = np.flatnonzero(np.diff(cells, prepend=-1))
        for head, end in zip(heads.tolist(), np.append(heads[1:], len(cells)).tolist(), strict=True):
            if int(cells[head]) not in self.range:
                continue  # of a split cell, no entry fell to this shelf
            start, stop = self.range[int(cells[head])]
            step = max(1, AT_ONCE // (stop - start))
            for at in range(head, end, step):
                rows = who[at : min(end, at + step)]
                near = unit[rows] @ self.units[start:stop].T
                both = np.concatenate([best[rows], near], axis=1)
                best[rows] = np.partition(both, -EACH, axis=1)[:, -EACH:]
                i, j = np.nonzero(near >= best[rows].min(axis=1)[:, None] - CLOSE)
                found.append((rows[i], start + j, near[i, j]))
        if not found:
            return
        i, j, near = (np.concatenate(x) for x in zip(*found, strict=True))
        kept = near >= best.min(axis=1)[i] - CLOSE
        i, j = i[kept], j[kept]
        score = np.concatenate([(vectors[i[a : a + 4096]] * self.vectors[j[a : a + 4096]]).sum(axis=1) for a in range(0, len(i), 4096)]) / (norms[i] * self.norms[j])
        n = np.array([len(self.ids[x]) for x in j.tolist()], np.int64)
        vec_id = np.array([y for x in j.tolist() for y in self.ids[x]], np.int64)
        i, score = np.repeat(i, n), np.repeat(score, n)
        order = np.lexsort((vec_id, -score, i))
        i, vec_id, score = i[order], vec_id[order], score[order]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < EACH
        yield pa.RecordBatch.from_arrays([asked.column(2).take(pa.array(i[top])), pa.array(vec_id[top]), pa.array(score[top])], names=["class", "vec_id", "score"])


def searched(of: Kind, rows: DataFrame) -> DataFrame:
    """Rows of `shelved` -> class, vec_id, score of each query and shelf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, shelf = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            asking = batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asking[1:] != asking[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                if keys[a] != key:
                    key, held, shelf = keys[a], [], None
                if not asking[a]:
                    held.append(batch.slice(a, b - a))
                elif held or shelf:
                    if shelf is None:
                        shelf, held = Shelf(of, pa.Table.from_batches(held)), []
                    yield from shelf.answer(batch.slice(a, b - a))

    return rows.repartition("key").sortWithinPartitions("key", "asking").mapInArrow(tidied(run), "class binary, vec_id long, score double")


def nearest(vectors: DataFrame, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the NEAREST nearest that are found of each row whose vec_id is divisible by EVERY, among all other rows."""
    spark = vectors.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    of = kind(vectors)
    if of is None:
        return none
    entries = classes(vectors, of)
    n, queries = entries.agg(F.count("*"), F.count_if("asks")).first()
    if not queries:
        return none
    index = fit(entries, of, n)
    count(index, entries, of, recall)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index.lay(min(max(1, SHELF_BYTES // (of.size * int(of.dtype[2]))), max(LEAST_SHELF, n // parts)))
    found = searched(of, shelved(index, entries, of, -(-queries // QUERIES)))
    best = better(found, "class", [F.desc("score"), F.asc("vec_id")], EACH)
    # written first, so that the join with the queries of a frequent vector can be split
    lists = written(best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best")), "found")
    own = packed(vectors.where(asks(F.col("vec_id").cast("long"))), of).select("class", F.explode("asked").alias("query_id"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, NEAREST)
    return (
        own.join(lists, "class")
        .select("query_id", F.posexplode(others).alias("at", "one"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
    )


def recall(found: DataFrame, vectors: DataFrame, most: int = 200) -> float:
    """The share of true neighbours found, of `most` queries of the least ids, each compared with all rows: a pair found counts if its score isn't below the last true one's."""
    asked = vectors.where(asks(F.col("vec_id"))).orderBy("vec_id").limit(most).select("vec_id", "embedding").collect()
    ids, unit = [r.vec_id for r in asked], units(np.array([r.embedding for r in asked], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(ids), NEAREST), -2.0)
        for batch in batches:
            own = batch.column(0).to_numpy()
            near = unit @ units(np.array(batch.column(1).to_pylist(), np.float64)).T
            near[np.array(ids)[:, None] == own[None, :]] = -2.0
            best = np.sort(np.concatenate([best, near], axis=1), axis=1)[:, -NEAREST:]
        i, j = np.nonzero(best > -2.0)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[i]), pa.array(best[i, j])], names=["query_id", "true"])

    true = better(vectors.select("vec_id", "embedding").mapInArrow(run, "query_id long, true double"), "query_id", [F.desc("true")], NEAREST)
    last = true.groupBy("query_id").agg(F.min("true").alias("last"), F.count("*").alias("n"))
    hits = last.join(found.select("query_id", "score"), "query_id", "left").groupBy("query_id", "n").agg(F.count_if(F.col("score") >= F.col("last") - 1e-9).alias("hits"))
    return hits.agg(F.sum(F.least("hits", "n")) / F.sum("n")).first()[0]
