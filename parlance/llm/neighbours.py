"""Approximate nearest neighbours through stable projections and kd-trees.

Vectors are projected to a few dimensions with Gaussian (2-stable) directions, so that a squared
projected distance, over the true one, follows a chi-square law with that many degrees of freedom (Sun
et al., SRS, 2014). A search takes projected neighbours in order of distance, verifies each on the
original vectors, and stops when the chi-square test says that a row further on is nearer than the
present k-th with a probability below ``miss``.

* Equal vectors collapse first: a vector is kept once, with its k + 1 least ids. No more of them can be
  among k neighbours, so nothing is lost, and a vector with very many copies is searched once.
* Cells: planes fitted on some ``SAMPLE`` distinct vectors, drawn by a hash, cut the projected space into up to ``SAMPLE`` / 16 cells
  of about ``SHARD_ROWS`` rows. Every row is put into its cell; a cell beyond that size is cut into
  shards by a hash. Each shard holds one kd-tree over its projections.
* First round: a query searches the shards of its own cell. Second round: the same test, with its k-th
  distance so far, tells which other cells' boxes are near enough, and it goes to those alone.
* Inside a shard, leaves come in order of their boxes' distance, and rows of a leaf are verified only
  if their own projected distance passes the test.

A task holds one shard at a time, built once for up to ``BLOCK_ROWS`` queries that stream through it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import checkpointed

SHARD_ROWS, BLOCK_ROWS, LEAF, SAMPLE = 16_384, 2048, 256, 16_384
_NO_ID = -(2**63)


def chi_square_cdf(x: float, degrees: int) -> float:
    """The chi-square distribution function for an even number of degrees of freedom."""
    if x <= 0:
        return 0.0
    if x > 1000:
        return 1.0
    term = total = np.exp(-x / 2)
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return float(1 - total)


def chi_square_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


@lru_cache(maxsize=4)
def directions(dim: int, to: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, to))


class KDTree:
    """A kd-tree over projected points: nodes halve their points at the median of their widest side."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.order = np.arange(len(points))
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.nodes: list[tuple[int, int, int, int]] = []  # begin, end, left child, right child (-1: leaf)
        todo = [(0, len(points), -1, 0)]
        while todo:
            begin, end, parent, side = todo.pop()
            at, own = len(self.nodes), self.order[begin:end]
            box = points[own]
            self.low.append(box.min(axis=0))
            self.high.append(box.max(axis=0))
            self.nodes.append((begin, end, -1, -1))
            if parent >= 0:
                b, e, left, right = self.nodes[parent]
                self.nodes[parent] = (b, e, at, right) if side == 0 else (b, e, left, at)
            if end - begin > leaf:
                axis, half = int((self.high[at] - self.low[at]).argmax()), (end - begin) // 2
                self.order[begin:end] = own[np.argpartition(box[:, axis], half)]
                todo += [(begin, begin + half, at, 0), (begin + half, end, at, 1)]
        self.lows, self.highs = np.array(self.low), np.array(self.high)

    def nearest_first(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(least squared distance, begin, end) of leaves in ``order``, nearest boxes first."""
        gap = np.maximum(np.maximum(self.lows - q, q - self.highs), 0)
        far = np.einsum("ij,ij->i", gap, gap)
        heap = [(float(far[0]), 0)]
        while heap:
            d, at = heapq.heappop(heap)
            begin, end, left, right = self.nodes[at]
            if left < 0:
                yield d, begin, end
            else:
                heapq.heappush(heap, (float(far[left]), left))
                heapq.heappush(heap, (float(far[right]), right))


class Shard:
    """Distinct vectors with their ids, behind a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], to: int, miss: float, seed: int) -> None:
        self.basis = directions(vectors.shape[1], to, seed)
        projected = vectors @ self.basis
        self.tree, self.quantile = KDTree(projected), chi_square_quantile(1 - miss, to)
        order = self.tree.order
        self.vectors, self.projected = vectors[order], projected[order]
        self.ids = [ids[i] for i in order]
        self.first = np.array([own[0] for own in self.ids], np.int64)
        #: The id of a vector that has but one: a query's own row is known by it.
        self.only = np.array([own[0] if len(own) == 1 else _NO_ID for own in self.ids], np.int64)
        self.verified = 0

    def search(self, q_id: int, q: np.ndarray, k: int, bound: float) -> list[tuple[float, int]]:
        """Up to k (distance, id) no further than ``bound``, the nearest first, ties by id; ``q_id`` left out."""
        low, radius = q @ self.basis, bound
        near_d, near_at = np.empty(0), np.empty(0, np.int64)
        for reach, begin, end in self.tree.nearest_first(low):
            limit = self.quantile * radius * radius
            if reach > limit:
                break
            gap = self.projected[begin:end] - low
            at = begin + np.flatnonzero((np.einsum("ij,ij->i", gap, gap) <= limit) & (self.only[begin:end] != q_id))
            if not len(at):
                continue
            self.verified += len(at)
            diff = self.vectors[at] - q
            d = np.sqrt((diff * diff).sum(axis=1))
            ok = d <= radius
            near_d, near_at = np.concatenate([near_d, d[ok]]), np.concatenate([near_at, at[ok]])
            if len(near_d) > k:
                best = np.lexsort((self.first[near_at], near_d))[:k]
                near_d, near_at = near_d[best], near_at[best]
            if len(near_d) == k:
                radius = min(radius, float(near_d.max()))
        return sorted((float(d), i) for d, at in zip(near_d, near_at.tolist(), strict=True) for i in self.ids[at] if i != q_id)[:k]


class Cells:
    """Planes that halve the projected space, level by level; a point's cell is the leaf it falls into."""

    def __init__(self, points: np.ndarray, levels: int) -> None:
        self.levels, m = levels, points.shape[1]
        self.axis, self.cut = np.zeros(2**levels - 1, np.int64), np.zeros(2**levels - 1)
        self.low, self.high = np.full((2**levels, m), -np.inf), np.full((2**levels, m), np.inf)
        todo = [(0, 0, points, np.full(m, -np.inf), np.full(m, np.inf))]
        while todo:
            node, level, own, low, high = todo.pop()
            if level == levels:
                cell = node - (2**levels - 1)
                self.low[cell], self.high[cell] = low, high
                continue
            axis = int(np.ptp(own, axis=0).argmax()) if len(own) else 0
            cut = float(np.median(own[:, axis])) if len(own) else 0.0
            self.axis[node], self.cut[node] = axis, cut
            right = own[:, axis] > cut
            top, bottom = high.copy(), low.copy()
            top[axis] = bottom[axis] = cut
            todo += [(2 * node + 1, level + 1, own[~right], low, top), (2 * node + 2, level + 1, own[right], bottom, high)]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - (2**self.levels - 1)

    def near(self, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) of all cells whose box is within the squared distance ``limit`` of a point."""
        where, cell = [], []
        for at in range(0, len(points), 128):
            p = points[at : at + 128, None]
            gap = np.maximum(np.maximum(self.low - p, p - self.high), 0)
            i, c = np.nonzero(np.einsum("pcm,pcm->pc", gap, gap) <= limit[at : at + 128, None])
            where.append(i + at)
            cell.append(c)
        return np.concatenate(where), np.concatenate(cell)


def usable(table: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part. Null ids, and vectors that are null, empty, zero or hold a null
    or non-finite component, take none. v stays in single precision if it is so in the table."""
    kind = "float" if dict(table.dtypes)["embedding"] == "array<float>" else "double"
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


def _matrix(raw: list[bytes], dim: int) -> np.ndarray:
    kind = "<f4" if raw and len(raw[0]) == 4 * dim else "<f8"
    return np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(float)


def _placed(rows: DataFrame, id_type: str, cells: dict[int, Cells], to: int, seed: int) -> DataFrame:
    """``rows(dim, a, id, v)`` -> (dim, cell, a, id, vec): v as bytes, with its cell."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
                vectors = flat.reshape(-1, dim)
                if dim in cells:
                    cell = cells[dim].of(vectors.astype(float) @ directions(dim, to, seed)).astype(np.int32)
                else:
                    cell = np.zeros(len(vectors), np.int32)
                vec = pa.array([row.tobytes() for row in vectors], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("dim"), pa.array(cell), part.column("a"), part.column("id"), vec], ["dim", "cell", "a", "id", "vec"]
                )

    return rows.mapInArrow(over, f"dim int, cell int, a long, id {id_type}, vec binary")


def _searched(data: DataFrame, asked: DataFrame, k: int, to: int, miss: float, seed: int) -> DataFrame:
    """``data(dim, cell, a, id, vec)``, ``asked(dim, cell, a, id, vec, bound)`` -> (query_id, a, vec_id, score):
    up to k neighbours of each query from each shard of the cells that it asks."""
    spark, keys = data.sparkSession, ["dim", "cell"]
    # At most SAMPLE / 16 cells a dimension, so their sizes may pass the driver.
    rows = {(r.dim, r.cell): r["count"] for r in data.groupBy(*keys).count().collect()}
    held = {(r.dim, r.cell): r["count"] for r in asked.groupBy(*keys).count().collect()}
    units = [(*at, -(-rows[at] // SHARD_ROWS), -(-n // BLOCK_ROWS)) for at, n in held.items() if at in rows]
    if not units:
        return spark.createDataFrame([], "query_id long, a long, vec_id long, score double")
    plan = F.broadcast(spark.createDataFrame(units, "dim int, cell int, shards int, blocks int"))
    here = data.join(plan, keys).select(
        *keys, F.pmod(F.xxhash64("a"), "shards").cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("query_id"), "a", F.lit(None).cast("double").alias("bound"), F.col("id").alias("ids"), "vec",
    )
    come = asked.join(plan, keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("id", "a"), "blocks").cast("int").alias("block"), F.lit(1).alias("kind"),
        F.col("id").alias("query_id"), "a", "bound", F.array().cast("array<long>").alias("ids"), "vec",
    )
    unit = [*keys, "shard", "block"]
    met = here.unionByName(come).repartition(min(10_000, sum(s * b for *_, s, b in units)), *unit).sortWithinPartitions(*unit, "kind")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard, vectors, ids = None, None, [], []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in (*unit, "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
                *key, kind = marks[begin].tolist()
                part = batch.slice(begin, end - begin)
                if key != current:
                    current, shard, vectors, ids = key, None, [], []
                raw = part.column("vec").to_pylist()
                if kind == 0:
                    vectors += raw
                    ids += part.column("ids").to_pylist()
                    continue
                if not vectors and shard is None:
                    continue
                if shard is None:
                    shard, vectors, ids = Shard(_matrix(vectors, key[0]), ids, to, miss, seed), [], []
                out = []
                own = (part.column(c).to_pylist() for c in ("query_id", "a", "bound"))
                for q_id, a, bound, q in zip(*own, _matrix(raw, key[0]), strict=True):
                    out += [(q_id, a, i, d) for d, i in shard.search(q_id, q, k, bound)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["query_id", "a", "vec_id", "score"])

    return met.mapInArrow(over, "query_id long, a long, vec_id long, score double")


def _first(found: DataFrame, k: int, *query: str) -> DataFrame:
    order = Window.partitionBy(*query).orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(
    table: DataFrame, every: int = 100, k: int = 10, to: int = 24, miss: float = 0.08, seed: int = 11, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``table(vec_id, embedding)`` -> (query_id, rank, vec_id, score) for queries ``vec_id % every = 0``.

    score is the Euclidean distance in double precision; rank counts from 1, ties go to the smaller
    vec_id; all candidates are returned where there are fewer than k. Repeated rows of one vec_id with
    one vector count once; an id with several vectors counts with the nearest, and then fewer than k ids
    may be returned. Rows of a query's own vec_id are never its neighbours. Vectors of a length other than
    the query's are not compared with it. Columns of other names are not read; an empty table gives an empty
    result. ``to`` must be even.
    """
    table.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4096)
    rows = usable(table).select(
        "vec_id", "v", F.size("v").alias("dim"), F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b")
    )
    vector = ["dim", "a", "b"]  # two hashes of 64 bits stand for a vector
    order = Window.partitionBy(*vector).orderBy("vec_id")
    least = rows.select(*vector, "vec_id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    groups = checkpointed(least.groupBy(*vector).agg(F.array_sort(F.collect_list("vec_id")).alias("id")))  # k + 1 at most
    cells: dict[int, Cells] = {}
    for dim, n in sorted((r.dim, r["count"]) for r in groups.groupBy("dim").count().collect()):
        levels = min(int(np.ceil(np.log2(n / shard_rows))) if n > shard_rows else 0, int(np.log2(SAMPLE / 16)))
        if levels:
            # Distinct vectors by a hash below a limit, some SAMPLE of them, each read from the row of its least id.
            share = F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)) < int((1 << 31) * min(1.0, SAMPLE / n))
            picked = groups.where((F.col("dim") == dim) & share).withColumn("vec_id", F.col("id")[0]).join(rows, [*vector, "vec_id"])
            points = np.unique(np.array([r.v for r in picked.select("v").collect()], float), axis=0)
            cells[dim] = Cells(points @ directions(dim, to, seed), levels)
    once = rows.join(groups.withColumn("vec_id", F.col("id")[0]), [*vector, "vec_id"]).dropDuplicates([*vector, "vec_id"])
    data = checkpointed(_placed(once.select("dim", "a", "id", "v"), "array<long>", cells, to, seed))
    own = rows.where(F.col("vec_id") % every == 0).dropDuplicates([*vector, "vec_id"])
    asked = checkpointed(_placed(own.select("dim", "a", F.col("vec_id").alias("id"), "v"), "long", cells, to, seed))
    found = checkpointed(_searched(data, asked.withColumn("bound", F.lit(float("inf"))), k, to, miss, seed))
    if cells:
        reach = _first(found, k, "query_id", "a").groupBy(F.col("query_id").alias("id"), "a").agg(F.max("score").alias("far"), F.count("*").alias("n"))
        bound = F.when(F.col("n") >= k, F.col("far")).otherwise(float("inf"))
        wider = asked.join(reach, ["id", "a"], "left").select("dim", "cell", "a", "id", "vec", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
        quantile = chi_square_quantile(1 - miss, to)

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, home, far = (batch.column(c).to_numpy() for c in ("dim", "cell", "bound"))
                for dim in set(np.unique(dims).tolist()) & cells.keys():
                    at = np.flatnonzero(dims == dim)
                    points = _matrix(batch.column("vec").take(pa.array(at)).to_pylist(), dim) @ directions(dim, to, seed)
                    i, cell = cells[dim].near(points, quantile * far[at] ** 2)
                    ok = cell != home[at[i]]
                    part = batch.take(pa.array(at[i[ok]]))
                    yield part.set_column(1, "cell", pa.array(cell[ok].astype(np.int32)))

        more = checkpointed(wider.mapInArrow(others, "dim int, cell int, a long, id long, vec binary, bound double"))
        found = found.unionByName(_searched(data, more, k, to, miss, seed))
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return _first(best, k, "query_id").select("query_id", "rank", "vec_id", "score")


def query(table: DataFrame) -> DataFrame:
    """The rows of query op7."""
    return nearest(table)
