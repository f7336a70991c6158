"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise, mix64

#: Vectors that the trees' hyperplanes are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
TREES = 12
#: Rows of a leaf that the trees aim at, and sampled rows that a leaf keeps at least.
LEAF, _LEAST = 400, 16
#: Recall that the search is tuned to on the sample, and how many of its vectors are asked for that.
RECALL, _ASKED = 0.96, 100
#: Rows and visiting queries that one task meets at a time.
_BLOCK_ROWS, _BLOCK_VISITS = 4_096, 8_192


@dataclass
class Forest:
    """Trees in arrays: node i splits at normals[i] . x > offsets[i] into right[i], else left[i]; children below 0 are leaf ~child."""

    normals: np.ndarray
    offsets: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    leaves: int

    def route(self, x: np.ndarray) -> np.ndarray:
        """(vectors, trees): the leaf that each vector falls into in each tree."""
        at = np.tile(np.array(self.roots), (len(x), 1))
        while (inner := at >= 0).any():
            rows, trees = np.nonzero(inner)
            node = at[rows, trees]
            side = np.einsum("ij,ij->i", x[rows], self.normals[node]) > self.offsets[node]
            at[rows, trees] = np.where(side, self.right[node], self.left[node])
        return ~at

    def search(self, q: np.ndarray, sizes: np.ndarray, candidates: int, least: int) -> list[int]:
        """Leaves for one query, nearest margin first over all trees, until they hold ``candidates``."""
        margins = self.normals @ q - self.offsets
        queue = [(-np.inf, r) for r in self.roots]
        heapq.heapify(queue)
        found, held = [], 0
        while queue and (held < candidates or len(found) < least):
            worst, node = heapq.heappop(queue)
            while node >= 0:
                m = margins[node]
                near, far = (self.right[node], self.left[node]) if m > 0 else (self.left[node], self.right[node])
                heapq.heappush(queue, (max(worst, abs(m)), int(far)))
                node = int(near)
            if sizes[~node]:
                found.append(~node)
                held += sizes[~node]
        return found


def fit(x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Each node splits its sample at the median of the projection on the difference of two of its vectors."""
    rng = np.random.default_rng(seed)
    normals, offsets, left, right, roots = [], [], [], [], []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = x[rng.choice(rows, 2, replace=False)]
                d = b - a
                size = np.linalg.norm(d)
                if size > 0:
                    p = x[rows] @ (d / size)
                    cut = float(np.median(p))
                    side = p > cut
                    if side.any() and not side.all():
                        node = len(offsets)
                        normals.append(d / size)
                        offsets.append(cut)
                        left.append(0)
                        right.append(0)
                        left[node], right[node] = grow(rows[~side]), grow(rows[side])
                        return node
        leaves += 1
        return ~(leaves - 1)

    for _ in range(trees):
        roots.append(grow(np.arange(len(x))))
    d = x.shape[1] if x.ndim == 2 else 1
    return Forest(np.array(normals).reshape(-1, d), np.array(offsets), np.array(left, np.int64), np.array(right, np.int64), roots, leaves)


def _needed(forest: Forest, x: np.ndarray, k: int, recall: float, seed: int) -> float:
    """Rows that a query has to meet, over all trees, for ``recall`` of its k nearest among ``x``."""
    leaf = forest.route(x)
    sizes = np.bincount(leaf.ravel(), minlength=forest.leaves)
    met = [np.zeros(1)]
    for i in np.random.default_rng(seed).permutation(len(x))[:_ASKED] if len(x) > 1 else ():
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        true = np.argsort(d, kind="stable")[: min(k, len(x) - 1)]
        # when each leaf is met
        order = forest.search(x[i], sizes, int(sizes.sum()), 0)
        when = np.full(forest.leaves, np.inf)
        when[order] = np.cumsum(sizes[order])
        met.append(when[leaf[true]].min(axis=1))
    return float(np.quantile(np.concatenate(met), recall))


def tune(forest: Forest, x: np.ndarray, rows: int, k: int, recall: float = RECALL, seed: int = 5) -> int:
    """Rows that a query has to meet among ``rows`` indexed ones for ``recall`` of its k nearest.

    Measured by brute force within the sample ``x`` and within a quarter of it; the power by which the two
    differ, from 0 to 1, carries on to all rows. Structured data need few rows however many there are; without
    structure no tree helps much, the power is 1, and the answer says so.
    """
    whole = max(1.0, _needed(forest, x, k, recall, seed))
    if rows <= len(x):
        return int(np.ceil(whole))
    part = max(1.0, _needed(forest, x[:: 4], k, recall, seed))
    power = float(np.clip(np.log(whole / part) / np.log(4), 0, 1))
    return int(np.ceil(1.1 * whole * (rows / len(x)) ** power))


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vector.isNotNull() & fine & F.exists(v, lambda c: c != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), -1)


def _tally(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    """Rows by leaf and vec_id."""
    for batch in batches:
        if batch.num_rows:
            leaf = forest.route(_matrix(batch.column(1)))
            ids = np.repeat(batch.column(0).to_numpy(), leaf.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel(), pa.int64()), pa.array(ids)], ["leaf", "vec_id"])


def _place(batches: Iterator[pa.RecordBatch], forest: Forest, blocks: np.ndarray, visits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every vector in its leaf of each tree, in one of the leaf's blocks, once for each block of visiting queries."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            leaf = forest.route(_matrix(part.column(1)))
            rows = np.repeat(np.arange(len(leaf)), leaf.shape[1])
            leaf = leaf.ravel()
            times = visits[leaf]  # a leaf that no query visits needs no rows
            rows, leaf = np.repeat(rows, times), np.repeat(leaf, times)
            asked = np.arange(len(leaf)) - np.repeat(np.cumsum(times) - times, times)
            ids, spread = (part.column(c).to_numpy()[rows] for c in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(spread % blocks[leaf]), pa.array(asked, pa.int64()), pa.array(ids), part.column(1).take(pa.array(rows))], ["leaf", "block", "asked", "vec_id", "vector"])


def _search(batches: Iterator[pa.RecordBatch], forest: Forest, sizes: np.ndarray, candidates: int) -> Iterator[pa.RecordBatch]:
    """The leaves that each query visits."""
    for batch in batches:
        found = [forest.search(q, sizes, candidates, len(forest.roots)) for q in (_matrix(batch.column(1)) if batch.num_rows else ())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int64()))], ["query_id", "vector", "leaves"])


def _visit(batches: Iterator[pa.RecordBatch], blocks: np.ndarray, visits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spread = mix64(batch.column(0).to_numpy().astype(np.uint64)) >> np.uint64(1)
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            lists = part.column(2)
            leaf = lists.flatten().to_numpy()
            row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
            n = blocks[leaf]
            block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            leaf, row = np.repeat(leaf, n), np.repeat(row, n)
            asked = spread[at + row].astype(np.int64) % visits[leaf]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(block), pa.array(asked), part.column(0).take(take), part.column(1).take(take)], ["leaf", "block", "asked", "query_id", "vector"])


def _rank(rows: pa.Table, visits: pa.Table, k: int) -> pa.Table:
    """The k nearest ids of one block of a leaf for each query that visits it, each at its smallest distance."""
    out: list[list] = [[], [], []]
    if rows.num_rows and visits.num_rows:
        ids, x = rows.column("vec_id").to_numpy(), _matrix(rows.column("vector").combine_chunks())
        repeats = len(np.unique(ids)) < len(ids)
        for query, q in zip(visits.column("query_id").to_pylist(), _matrix(visits.column("vector").combine_chunks())):
            d = np.sqrt(((x - q) ** 2).sum(axis=1))
            best = np.lexsort((ids, d))
            best = best[ids[best] != query]
            if repeats:
                best = best[np.sort(np.unique(ids[best], return_index=True)[1])]
            best = best[:k]
            out[0] += [query] * len(best)
            out[1] += ids[best].tolist()
            out[2] += d[best].tolist()
    return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest among the candidates found, by exact distance.

    ``vectors``, ``queries``: (vec_id, embedding). The hyperplanes are fitted on at most ``sample`` vectors,
    the first in a hashed order of the rows, one of each vec_id; all vectors are indexed. The more rows there
    are per sampled one, the finer the trees, down to leaves of a few sampled rows. A query walks all
    trees through one priority queue of margins until the leaves it has met hold as many ids (each leaf's
    distinct ones) as ``recall`` needs by brute force within the sample, carried on to all rows by the power
    at which it grows there. Leaves of any size are cut into blocks of some thousand rows, and their visitors
    too. Ties go to the smaller vec_id; a query's own
    id is no candidate. Vectors that are null, zero, hold null or non-finite components or have another
    length than most take no part. Rows that repeat a vec_id count once per distinct vector, at its smallest distance.
    An empty table, of vectors or of queries, gives no rows.
    """
    fine = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    vectors, queries = fine(vectors), fine(queries)
    lengths = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    spark, out = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], out)
    vectors, queries = (x.where(F.size("vector") == lengths.n) for x in (vectors, queries))
    spread = F.xxhash64("vec_id", "vector").bitwiseAND((1 << 63) - 1)
    vectors = materialise(vectors.distinct().withColumn("spread", spread), "vectors")
    total = vectors.count()
    picked = vectors.orderBy("spread", "vec_id").limit(sample).toArrow()
    once = np.sort(np.unique(picked.column("vec_id").to_numpy(), return_index=True)[1])
    known = _matrix(picked.column("vector").combine_chunks())[once]
    forest = fit(known, trees, max(min(leaf, _LEAST), leaf * len(known) // total))
    each = map_arrow(vectors, partial(_tally, forest=forest), "leaf long, vec_id long").groupBy("leaf", "vec_id").agg(F.count(F.lit(1)).alias("n"))
    tally = each.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids")).collect()  # leaves: bounded by the sample
    sizes, held = np.zeros(forest.leaves, np.int64), np.zeros(forest.leaves, np.int64)
    for r in tally:
        sizes[r.leaf], held[r.leaf] = r.ids, r.n
    candidates = max(10 * k, tune(forest, known, int(sizes.sum() // trees), k, recall))
    kind = vectors.schema["vector"].dataType.simpleString()
    asked = materialise(map_arrow(queries, partial(_search, forest=forest, sizes=sizes, candidates=candidates), f"query_id long, vector {kind}, leaves array<long>"), "visits")
    met = np.zeros(forest.leaves, np.int64)
    for r in asked.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().collect():
        met[r.leaf] = r["count"]
    blocks, visits = np.maximum(1, -(-held // _BLOCK_ROWS)), -(-met // _BLOCK_VISITS)
    key = "leaf long, block long, asked long"
    placed = map_arrow(vectors, partial(_place, forest=forest, blocks=blocks, visits=visits), f"{key}, vec_id long, vector {kind}")
    visiting = map_arrow(asked, partial(_visit, blocks=blocks, visits=visits), f"{key}, query_id long, vector {kind}")
    names = ["leaf", "block", "asked"]
    found = placed.groupBy(*names).cogroup(visiting.groupBy(*names)).applyInArrow(lambda a, b: _rank(a, b, k), "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
