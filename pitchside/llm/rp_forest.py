"""Operator 8: approximate nearest neighbours by a forest of random-projection trees.

Trees are built on a bounded sample: each node parts its points at the median of their projections
on the line between two of them. Every row is indexed: (tree, leaf, id, vector), one row per tree. A query
walks all trees through one shared priority queue, which always opens the branch with the smallest
margin next, whichever tree it is in, until the opened leaves hold ``effort`` times the rows of the table
(by the sample's shares; rows met in several trees count each time). Queries and rows of a leaf meet in a
shuffle; exact distances in double precision rank what was found, first per leaf, then over all leaves.

Equal vectors are searched once, and only the k + 1 smallest ids of equal vectors are indexed: no other
could be among the k nearest with ties to smaller ids. So a vector that a third of the rows share makes no
large leaf and no large group. On the driver: the sample and the trees (``sample_rows`` vectors each).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.sampling import hash_sample
from pitchside.sources.stage import stage


@dataclass
class Tree:
    """Node i is a split (normal[i], threshold[i], left[i], right[i]) or, if left[i] < 0, leaf right[i]."""

    normal: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf_share: np.ndarray

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row of ``x``."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = self.right[node]
            elif len(rows):
                low = x[rows] @ self.normal[node] <= self.threshold[node]
                todo += [(self.left[node], rows[low]), (self.right[node], rows[~low])]
        return out


def build_tree(points: np.ndarray, leaf_points: int, rng: np.random.Generator) -> Tree:
    normal, threshold, left, right, sizes = [], [], [], [], []

    def grow(rows: np.ndarray) -> int:
        me = len(left)
        normal.append(np.zeros(points.shape[1], np.float32))
        threshold.append(0.0)
        left.append(-1)
        right.append(len(sizes))
        if len(rows) > leaf_points:
            a, b = points[rng.choice(rows, 2, replace=False)]
            line = (a - b) / max(float(np.linalg.norm(a - b)), 1e-12)
            at = points[rows] @ line
            cut = float(np.median(at))
            low = at <= cut
            if low.any() and not low.all():
                normal[me], threshold[me] = line.astype(np.float32), cut
                left[me] = grow(rows[low])
                right[me] = grow(rows[~low])
                return me
        sizes.append(len(rows))
        return me

    grow(np.arange(len(points)))
    return Tree(np.array(normal, np.float32), np.array(threshold), np.array(left), np.array(right), np.array(sizes) / max(1, len(points)))


def open_leaves(forest: list[Tree], x: np.ndarray, effort: float) -> list[tuple[int, int]]:
    """(tree, leaf) in the order of the shared queue until their shares sum up to ``effort`` (or all are open)."""
    queue = [(0.0, t, 0) for t in range(len(forest))]
    margins = [tree.normal @ x - tree.threshold for tree in forest]
    opened, share = [], 0.0
    while queue and share < effort:
        margin, t, node = heapq.heappop(queue)
        tree = forest[t]
        while tree.left[node] >= 0:
            d = margins[t][node]
            near, far = (tree.left[node], tree.right[node]) if d <= 0 else (tree.right[node], tree.left[node])
            heapq.heappush(queue, (max(margin, abs(d)), t, far))
            node = near
        opened.append((t, int(tree.right[node])))
        share += tree.leaf_share[tree.right[node]]
    return opened


def _matrix(column: pa.Array, dtype: type = np.float32) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id and a vector of the commonest length, all numbers finite, not all zero."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).filter(
        F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.filter(F.size("vec") == (size[0][0] if size else 0))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, trees: int = 10,
            sample_rows: int = 20_000, leaf_points: int = 32, effort: float = 1.3, seed: int = 8) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of every query row, by Euclidean distance.

    ``is_query`` selects queries by the column ``id``; candidates are all rows but the query's own id. Ties go to the smaller
    id. Null, zero, non-finite or odd-length vectors and null ids take no part; repeated rows count once. Fewer candidates
    than k: all of them. An empty table: no rows. ``sample_rows`` bounds what trees are built on; ``effort`` is the share of
    the table that a query reads (one row met in two trees counts twice).
    """
    spark = df.sparkSession
    rows = stage(usable(df, id_col, vec_col).distinct(), "vectors")
    same = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1)
    sample = hash_sample(kept.filter(F.col("n") == 1).select("id", "vec"), "id", sample_rows).toArrow()
    rng = np.random.default_rng(seed)
    points = _matrix(sample.column("vec").combine_chunks()) if sample.num_rows else np.zeros((0, 1), np.float32)
    order = np.argsort(sample.column("id").to_numpy()) if sample.num_rows else []
    forest = spark.sparkContext.broadcast([build_tree(points[order], leaf_points, rng) for _ in range(trees)] if sample.num_rows else [])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            for t, tree in enumerate(forest.value):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaves_of(x)), batch.column(0), batch.column(1)], names=["tree", "leaf", "id", "vec"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in enumerate(_matrix(batch.column(1))):
                opened = open_leaves(forest.value, x, effort)
                take = pa.array(np.full(len(opened), i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t for t, _ in opened], pa.int32()), pa.array([leaf for _, leaf in opened], pa.int32()), batch.column(0).take(take), batch.column(1).take(take)], names=["tree", "leaf", "q", "vec"])

    def rank(queries: pa.Table, members: pa.Table) -> pa.Table:
        out_q, out_id, out_d = [], [], []
        if queries.num_rows and members.num_rows:
            ids = members.column("id").to_numpy()
            by_id = np.argsort(ids)
            ids, x = ids[by_id], _matrix(members.column("vec").combine_chunks(), np.float64)[by_id]
            for q, y in zip(queries.column("q").to_numpy(), _matrix(queries.column("vec").combine_chunks(), np.float64), strict=True):
                d = np.sqrt(((x - y) ** 2).sum(axis=1))
                best = np.argsort(d, kind="stable")[: k + 1]
                out_q.append(np.full(len(best), q))
                out_id.append(ids[best])
                out_d.append(d[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"q": join(out_q, np.int64), "id": join(out_id, np.int64), "score": join(out_d, np.float64)})

    vec = rows.schema["vec"].dataType.simpleString()
    indexed = kept.select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(index, f"tree int, leaf int, id long, vec {vec}")
    queries = rows.filter(is_query)
    heads = queries.groupBy("vec").agg(F.min("id").cast("long").alias("q"))
    visits = heads.select("q", "vec").mapInArrow(search, f"tree int, leaf int, q long, vec {vec}")
    found = visits.groupBy("tree", "leaf").cogroup(indexed.groupBy("tree", "leaf")).applyInArrow(rank, "q long, id long, score double")
    found = found.groupBy("q", "id").agg(F.min("score").alias("score"))
    nearest_of = Window.partitionBy("q").orderBy("score", "id")
    found = found.withColumn("n", F.row_number().over(nearest_of)).filter(F.col("n") <= k + 1).drop("n")
    own = queries.select(F.col("id").cast("long").alias("query_id"), "vec").join(heads, "vec").select("query_id", "q").distinct()
    final = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = own.join(found, "q").filter(F.col("id") != F.col("query_id")).withColumn("rank", F.row_number().over(final))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
