"""Operator 13: hard negatives by inner product, found under bounds from segment summaries.

A vector is cut into segments; each keeps its mean and its deviation (the norm of what is left after the mean is taken
off). For two vectors the inner product of a segment lies within ``width * mean * mean`` plus or minus ``deviation *
deviation``. Sums over coarse segments bound many pairs at the price of a few numbers; pairs that stay open are bounded
again over finer segments, and only then scored exactly. A lower bound that k rows are sure to reach is the floor which others'
upper bounds must pass.

Scale: rows are dealt into cells of a bounded number of rows, which go through one task each; every cell streams past all
anchors (the stated query set), a small batch at a time, and keeps the best k of each. Neither side is ever whole in a
task or on the driver. Labels do not decide where a row goes, so a hot label makes no hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.llm.vectors import integer_matrix, integer_vectors
from pitchside.sources.stage import stage

#: Numbers of segments, coarse to fine (those over a quarter of the components are left out, the first always stays).
SEGMENTS = (1, 4, 16)
#: Components in a cell at most (as doubles 32 MB), rows and anchors compared at once.
CELL_VALUES, ROWS, ANCHORS = 1 << 22, 2048, 128


@dataclass
class Points:
    """Ids, label texts and integer vectors, with a (means, deviations) pair for each level of segments."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    def part(self, at: slice) -> Points:
        return Points(self.ids[at], self.labels[at], self.x[at], [(m[at], d[at]) for m, d in self.levels])


def summarise(x: np.ndarray, segments: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: means times the root of the segment's width, and deviations, a column per segment."""
    out, size = [], x.shape[1]
    for n in [s for s in segments if s <= max(segments[0], size // 4)]:
        starts = np.arange(n) * size // n
        width = np.diff([*starts, size])
        mean = np.add.reduceat(x, starts, axis=1) / width
        rest = x - np.repeat(mean, width, axis=1)
        out.append((mean * np.sqrt(width), np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))))
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` with those of ``b``."""
    peak = max(float(np.abs(a).max(initial=0)), 1.0) * max(float(np.abs(b).max(initial=0)), 1.0) * a.shape[1]
    if peak < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


class Best:
    """The k best (score, then smaller id) of every query column so far."""

    def __init__(self, columns: int, k: int):
        self.k, self.floor = k, np.full(columns, -np.inf)
        self.column, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, column: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        column, score, ids = np.concatenate([self.column, column]), np.concatenate([self.score, score]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -score, column))
        column, score, ids = column[order], score[order], ids[order]
        rank = np.arange(len(column)) - np.searchsorted(column, column)
        keep = rank < self.k
        last = rank == self.k - 1
        self.floor[column[last]] = np.maximum(self.floor[column[last]], score[last])
        self.column, self.score, self.ids = column[keep], score[keep], ids[keep]


def search(rows: Points, anchors: Points, of: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int) -> tuple[Best, int]:
    """The k best rows for every query column, and how many pairs were scored exactly.

    Column c asks for anchor ``of[c]``: rows of its label (``same``) or of others, never of its own id, with a score from ``low[c]`` to
    ``high[c]``.
    """
    best, scored = Best(len(of), k), 0
    for start in range(0, len(rows.ids), ROWS):
        block = rows.part(slice(start, start + ROWS))
        alive = (((block.labels[:, None] == anchors.labels) == same) & (block.ids[:, None] != anchors.ids))[:, of]
        for (rm, rd), (am, ad) in zip(block.levels, anchors.levels, strict=True):
            middle, spread = rm @ am.T, rd @ ad.T
            # half a unit, scores being whole, and what rounding may cost for very large numbers
            spread += 0.5 + 1e-9 * np.abs(middle).max(initial=0) + 1e-9 * spread.max(initial=0)
            upper, lower = (middle + spread)[:, of], (middle - spread)[:, of]
            if len(block.ids) >= k:
                sure = np.where(alive & (upper <= high) & (lower >= low), lower, -np.inf)
                best.floor = np.maximum(best.floor, np.partition(sure, len(block.ids) - k, axis=0)[len(block.ids) - k])
            alive &= (upper >= np.maximum(best.floor, low)) & (lower <= high)
            if not alive.any():
                break
        else:
            row, column = np.nonzero(alive)
            scored += len(row)
            if len(row) * 8 > len(block.ids) * len(anchors.ids):
                score = inner(block.x, anchors.x)[row, of[column]]
            else:
                score = np.einsum("ij,ij->i", block.x[row], anchors.x[of[column]])
            fit = (score >= low[column]) & (score <= high[column]) & (score >= best.floor[column])
            best.add(column[fit], score[fit], block.ids[row[fit]])
    return best, scored


def _cells(spark_rows: DataFrame, anchors: DataFrame, cells: int) -> DataFrame:
    """Rows (kind 0) of a cell, then all anchors (kind 1), cell by cell in order; a partition for each cell."""
    rows = spark_rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(cells)).cast("int").alias("cell"), F.lit(0).alias("kind"),
                             "id", "label", "v", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("array<bigint>").alias("goals"))
    asked = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), F.lit(1).alias("kind"), "id", "label", "v", "anchor", "goals")
    return rows.unionByName(asked).repartitionById(cells, F.col("cell")).sortWithinPartitions("cell", "kind")


def _best_in_cells(cells: DataFrame, k: int, same: bool, ratio: tuple[int, int], segments: tuple[int, ...]) -> DataFrame:
    """(anchor, goal, id, score): each cell's k best rows of every anchor (``same``) or of every goal score of an anchor."""

    def points(parts: list[pa.RecordBatch]) -> Points:
        table = pa.Table.from_batches(parts)
        x = integer_matrix(table.column("v"))
        return Points(table.column("id").to_numpy(), table.column("label").to_numpy(zero_copy_only=False).astype(str), x, summarise(x, segments))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
        for batch in batches:
            tag = batch.column(0).to_numpy() * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(tag)) + 1), len(tag)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    yield int(tag[a]) // 2, int(tag[a]) % 2, batch.slice(a, b - a)

    def ask(rows: Points, batch: pa.RecordBatch) -> pa.RecordBatch:
        anchors, number = points([batch]), batch.column(5).to_numpy()
        if same:
            of = np.arange(len(number))
            goal = np.zeros(len(of), np.int64)
            low, high = np.full(len(of), np.iinfo(np.int64).min), np.full(len(of), np.iinfo(np.int64).max)
        else:
            goals = batch.column(6).to_pylist()
            of = np.array([i for i, g in enumerate(goals) for _ in g], np.int64)
            goal = np.array([n for g in goals for n in range(len(g))], np.int64)
            high = np.array([s for g in goals for s in g], np.int64)
            low = -(-ratio[0] * high // ratio[1])
        best, _ = search(rows, anchors, of, low, high, same, k)
        return pa.RecordBatch.from_arrays(
            [pa.array(number[of[best.column]]), pa.array(goal[best.column].astype(np.int32)), pa.array(best.ids), pa.array(best.score)],
            names=["anchor", "goal", "id", "score"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, rows = -1, [], None
        for cell, kind, batch in runs(batches):
            if cell != at:
                at, parts, rows = cell, [], None
            if kind == 0:
                parts.append(batch)
            elif parts:
                rows = rows or points(parts)
                for start in range(0, batch.num_rows, ANCHORS):
                    yield ask(rows, batch.slice(start, ANCHORS))

    return cells.mapInArrow(compare, "anchor bigint, goal int, id bigint, score bigint")


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
                   positives: int = 5, negatives: int = 5, ratio: tuple[int, int] = (80, 100), segments: tuple[int, ...] = SEGMENTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by inner product of integer vectors.

    ``is_anchor`` selects anchors by the column ``id``. An anchor's positives are the ``positives`` best other rows of its label, its
    negatives for a positive the ``negatives`` best rows of other labels whose score is at most the positive's and at least
    ``ratio`` of it. Higher scores first, ties to the smaller id; fewer rows: all of them.

    Null labels and ids take no part, and what ``integer_vectors`` leaves out. Fully repeated rows count once; rows that share an id
    but differ are rows each, and an anchor never meets a row of its own id. No positive or no fitting negative: no row. An
    empty table: no rows. The columns of ``df`` that are not named are not read.
    """
    if -(-ratio[0] // ratio[1]) > 1 or min(ratio) < 0:
        raise ValueError("ratio must lie between 0 and 1")
    spark = df.sparkSession
    rows = integer_vectors(df, id_col, vec_col, label, scale).filter(F.col("id").isNotNull() & F.col("label").isNotNull())
    rows = stage(rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), "v").distinct(), "vectors")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    cells = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * width // CELL_VALUES))
    anchors = stage(rows.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    asked = _cells(rows, anchors.withColumn("goals", F.lit(None).cast("array<bigint>")), cells)
    near = _best_in_cells(asked, positives, True, ratio, segments)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    near = near.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    near = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("p"))
    asking = stage(anchors.join(near, "anchor").withColumn("goals", F.transform("p", lambda x: x["score"])), "asking")

    hard = _best_in_cells(_cells(rows, asking, cells), negatives, False, ratio, segments)
    order = Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "id")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives).withColumnRenamed("id", "negative_id")
    out = hard.join(asking.select("anchor", F.col("id").alias("anchor_id"), "p"), "anchor").withColumn("pos", F.col("p")[F.col("goal")])
    return out.select("anchor_id", F.col("pos.id").alias("positive_id"), "rank", "negative_id",
                      F.col("pos.score").alias("positive_score"), F.col("score").alias("negative_score"))
