"""Operator 6: exact top-k by inner product with a KD-tree per shard.

Vectors are quantised to integers. Each partition of the table is a shard: its vectors form a KD-tree by median splits of the widest
dimension, every node with its tight bounding box. A query goes through a tree best first: the node with the largest bound on the inner
product over its box, sum of max(q_i lo_i, q_i hi_i), comes next, and the search ends when no bound reaches the query's kth score. The
kth scores are propagated: a first search over one sample tree gives every query k real candidates, and all shards start from that
score. Each shard's best k of a query are merged at the end.

Queries are a stated set. They are written in blocks to the shared folder, and a shard's task takes one block after the other, so that
it holds one tree and one block.

Cases: null vectors and ones with null or non-finite components take no part, nor do null ids; components that a shorter vector lacks
count as 0, so an empty one has score 0; components and scores that 64-bit integers can't hold raise; a query meets every candidate but the
row with its own id; ties go to the smaller id; repeated rows are candidates each (an id with several vectors gets one list over all of them);
with fewer than k candidates all are returned; an empty table or query set gives no rows; other columns play no part.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from .storage import new_path, read_range, write_file

FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long: floor(scale * x)) of the rows that take part."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    fine = given.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    most = fine.agg(F.max(F.size("x"))).first()[0] or 1
    whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    # a double of 2^63 or more would be cut to the largest integer without a word
    checked = F.when(F.forall("x", lambda v: F.abs(v * F.lit(float(scale))) < 2.0**63), whole).otherwise(F.raise_error(F.lit("a component is too large")))
    return fine.select("vec_id", F.concat(checked, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))).alias("v"))


def _numbers(values: np.ndarray) -> np.ndarray:
    """Integers as doubles where these are exact."""
    return values if np.abs(values).max(initial=0) >= 2**53 or (values == np.iinfo(np.int64).min).any() else values.astype(np.float64)


def _below(score: int) -> float:
    """The largest double that isn't over a score."""
    out = float(score)
    return out if int(out) <= score else float(np.nextafter(out, -np.inf))


class Tree:
    """A KD-tree in arrays: node n has children 2n + 1 and 2n + 2; leaves are runs of the reordered vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 64):
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(ids)) / leaf))))
        nodes = 2 ** (self.depth + 1) - 1
        self.lo, self.hi = (np.zeros((nodes, vectors.shape[1])) for _ in range(2))
        self.span = np.zeros((nodes, 2), np.int64)
        order = np.arange(len(ids))
        self.span[0] = 0, len(ids)
        for n in range(nodes):
            a, b = self.span[n]
            part = vectors[order[a:b]]
            if not len(part):
                self.lo[n], self.hi[n] = np.inf, -np.inf
            else:
                self.lo[n], self.hi[n] = part.min(axis=0), part.max(axis=0)
            if 2 * n + 2 < nodes:
                middle = (a + b) // 2
                if b - a > 1:
                    d = int((self.hi[n] - self.lo[n]).argmax())
                    order[a:b] = order[a:b][np.argpartition(part[:, d], (b - a) // 2)]
                self.span[2 * n + 1], self.span[2 * n + 2] = (a, middle), (middle, b)
        self.ids, self.vectors = ids[order], vectors[order]
        self.first_leaf = 2**self.depth - 1
        self.full = self.span[:, 1] > self.span[:, 0]
        # inner products in floating point are exact below 2^53; larger ones are taken in Python integers
        self.peak = float(np.abs(vectors.astype(float)).max(initial=0))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each node's box."""
        lo, hi = np.where(self.full[:, None], self.lo, 0), np.where(self.full[:, None], self.hi, 0)
        queries = queries.astype(float)
        out = np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T
        out += np.abs(out) * 1e-9  # rounding never hides a node
        out[:, ~self.full] = -np.inf
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(query, vec_id, score) of each query's best k here that reach its kth score so far (-inf: none)."""
        exact = self.peak * float(np.abs(queries.astype(float)).max(initial=0)) * queries.shape[1] < 2**53
        vectors = self.vectors if exact else self.vectors.astype(np.int64).astype(object)
        bounds, out = self.bounds(queries), []
        for n in range(len(queries)):
            query = queries[n] if exact else queries[n].astype(np.int64).astype(object)
            bound, least = bounds[n], kth[n]
            best: list[tuple] = []  # (score, -vec_id), the worst first
            heap = [(-bound[0], 0)]
            while heap and -heap[0][0] >= least:
                _, node = heapq.heappop(heap)
                if node < self.first_leaf:
                    for child in (2 * node + 1, 2 * node + 2):
                        if bound[child] >= least:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.span[node]
                score = vectors[a:b] @ query
                for at in np.flatnonzero(score >= least):
                    vec = int(self.ids[a + at])
                    if vec == query_ids[n]:
                        continue
                    item = (int(score[at]), -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                    if len(best) == k and best[0][0] > least:
                        least = best[0][0]
            out += [(int(query_ids[n]), -vec, score) for score, vec in best]
        return out


def _arrays(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray] | None:
    ids, vectors = [], []
    for batch in batches:
        if batch.num_rows:
            column = batch.column(1)
            ids.append(batch.column(0).to_numpy())
            vectors.append(column.flatten().to_numpy().reshape(batch.num_rows, -1))
    return (np.concatenate(ids), _numbers(np.concatenate(vectors))) if ids else None


def _packed(ids: np.ndarray, vectors: np.ndarray, kth: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, ids=ids, vectors=vectors, kth=kth)
    return out.getvalue()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 512, sample: int = 4096, leaf: int = 64, shard: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates in vectors (vec_id, v) of each query (vec_id, v).

    sample: vectors of the tree that gives the first kth scores; shard: vectors in a tree at most."""
    spark = vectors.sparkSession
    folder = new_path(spark, "queries")
    first = vectors.limit(sample).collect()
    seed = (np.array([r["vec_id"] for r in first], np.int64), _numbers(np.array([r["v"] for r in first], np.int64))) if first else None
    shared = spark.sparkContext.broadcast(seed)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if shared.value is None:
            return
        tree = Tree(*shared.value, leaf)
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                ids, vecs = _arrays([batch.slice(lo, block)])
                scores: dict[int, list[int]] = {}
                for q, _, score in tree.search(ids, vecs, np.full(len(ids), -np.inf), k):
                    scores.setdefault(q, []).append(score)
                kth = np.array([_below(min(s)) if len(s := scores.get(int(q), [])) >= k else -np.inf for q in ids], float)
                name = f"block-{part}-{n}.npz"
                write_file(f"{folder}/{name}", [_packed(ids, vecs, kth)])
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(ids)])], ["name", "queries"])
                n += 1

    distinct = queries.dropDuplicates(["vec_id", "v"])
    blocks = spark.sparkContext.broadcast([r["name"] for r in map_arrow(distinct, prepare, "name string, queries long").collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, n = [], 0
            for batch in batches:
                held.append(batch)
                n += batch.num_rows
                if n >= shard:
                    yield _arrays(held)
                    held, n = [], 0
            if n:
                yield _arrays(held)

        for ids, vecs in shards():
            tree = Tree(ids, vecs, leaf)
            for name in blocks.value:
                with np.load(io.BytesIO(read_range(f"{folder}/{name}"))) as some:
                    found = tree.search(some["ids"], some["vectors"], some["kth"], k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    found = map_arrow(vectors, search, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
