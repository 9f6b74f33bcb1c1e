"""Operator 5: uniform shuffle into shards of exact size (law ``rows``).

Method, a hypergeometric communication matrix. Rows fall into blocks by a keyed hash (the
"partitions" of the method, so a retried task sees the same block). The driver knows only how many
rows each block has and draws from the multivariate hypergeometric law how many of them go to
each cell of each shard; cells cut a shard so that no task holds a whole shard. Then every block is
permuted locally (order by a second keyed hash) and dealt out by its row of the matrix, rows are
exchanged, and every cell is permuted again (third hash), which gives the slots. The matrix makes
the shard sizes exact; all counts of blocks to cells have the law of a uniform shuffle.

Shuffled are two exchanges of (identity, carried columns), no texts unless the caller carries them.
On the driver: ``blocks`` counts and a blocks x cells matrix, at most MAX_BLOCKS^2 numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCKS = 512
#: Totals from which numpy draws no exact hypergeometric numbers.
NUMPY_TOTAL = 1_000_000_000


def communication_matrix(block_rows: list[int], cell_rows: list[int], seed: int) -> list[list[int]]:
    """How many rows of each block go to each cell: row sums ``block_rows``, column sums ``cell_rows``."""
    rng = np.random.default_rng(seed)
    left = np.array(cell_rows, np.int64)
    matrix = []
    for n in block_rows:
        drawn = _draw(rng, left, int(n))
        left = left - drawn
        matrix.append(drawn.tolist())
    return matrix


def _draw(rng: np.random.Generator, colors: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows dealt to cells that still take ``colors`` rows; large totals are split by halves of the cells, which has the same law."""
    total = int(colors.sum())
    if total < NUMPY_TOTAL:
        return rng.multivariate_hypergeometric(colors, n, method="marginals")
    if len(colors) == 1:
        return np.array([n], np.int64)
    half = len(colors) // 2
    good = int(colors[:half].sum())
    first = hypergeometric(rng, good, total - good, n)
    return np.concatenate([_draw(rng, colors[:half], first), _draw(rng, colors[half:], n - first)])


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` rows drawn from ``good + bad`` are good, for totals of any size, by exact rejection.

    The law is log-concave, so with its greatest probability p at the mode it lies below p * min(1, exp(w - p * distance)),
    w = 1 + p / 2 (Devroye's hat for such laws); under six tries are expected whatever the numbers are.
    """
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)
    top = _log_law(mode, good, bad, n)
    p = math.exp(top)
    w = 1 + p / 2
    while True:
        flat = rng.random() <= w / (1 + w)
        distance = (rng.random() * w if flat else w + rng.exponential()) / p
        x = mode + (1 if rng.random() < 0.5 else -1) * round(distance)
        if least <= x <= most and rng.random() * min(1.0, math.exp(w - p * distance)) <= math.exp(_log_law(x, good, bad, n) - top):
            return x


def _log_law(x: int, good: int, bad: int, n: int) -> float:
    """Log of the hypergeometric probability, as a quotient of binomial ones: no difference of large log-factorials is taken."""
    share = n / (good + bad)
    return _log_binomial(x, good, share) + _log_binomial(n - x, bad, share) - _log_binomial(n, good + bad, share)


def _log_binomial(x: int, n: int, p: float) -> float:
    """Log of the binomial probability of ``x`` in ``n`` in saddle-point form (Loader): Stirling's remainders and deviances, all small numbers."""
    if x in (0, n):
        return n * (math.log1p(-p) if x == 0 else math.log(p))
    remainder = _stirling(n) - _stirling(x) - _stirling(n - x)
    return remainder - _deviance(x, n * p) - _deviance(n - x, n * (1 - p)) - 0.5 * math.log(2 * math.pi * x * ((n - x) / n))


def _stirling(n: int) -> float:
    """log(n!) less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def _deviance(x: int, mean: float) -> float:
    d = (x - mean) / mean
    return mean * ((1 + d) * math.log1p(d) - d)


def _cells(n_rows: int, n_shards: int, per_shard: int) -> list[list[int]]:
    """Rows of each cell of each shard: shard sizes at most one apart, and so are a shard's cells."""
    sizes = [n_rows // n_shards + (j < n_rows % n_shards) for j in range(n_shards)]
    return [[s // per_shard + (q < s % per_shard) for q in range(per_shard)] for s in sizes]


def shard_rows(df: DataFrame, key_cols: list[str], carry: list[str], n_shards: int = 8, seed: int = 5, blocks: int | None = None) -> DataFrame:
    """``carry`` columns of every row plus ``shard`` (0..n_shards-1) and ``slot`` (gapless from 0 in the shard).

    ``key_cols`` identify a row; rows that agree in all of them are told apart by no rule, so they take
    their places in any order. Null and empty values are ordinary key values. An empty table gives an
    empty result. Columns named in ``carry`` must not be called shard or slot. ``blocks``: blocks of the
    matrix, the session's shuffle partitions by default, at most MAX_BLOCKS.
    """
    spark = df.sparkSession
    blocks = min(MAX_BLOCKS, blocks or int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_shard = max(1, blocks // n_shards)
    key = F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in key_cols])
    block = F.pmod(key, F.lit(blocks)).cast("int")
    counted = {r[0]: r[1] for r in df.groupBy(block.alias("b")).count().collect()}  # at most `blocks` rows
    block_rows = [counted.get(b, 0) for b in range(blocks)]
    cells = _cells(sum(block_rows), n_shards, per_shard)
    matrix = np.array(communication_matrix(block_rows, [c for shard in cells for c in shard], seed), np.int64)
    # Row r of a block goes to the first cell whose running total exceeds r: first the shard, then its cell.
    ends = matrix.cumsum(axis=1).reshape(blocks, n_shards, per_shard)
    plan = spark.createDataFrame(
        [(b, ends[b, :, -1].tolist(), ends[b].tolist()) for b in range(blocks)],
        "_block int, _shard_ends array<bigint>, _cell_ends array<array<bigint>>")

    again = lambda salt: F.xxhash64(F.lit(salt), F.col("_key"))
    rows = df.select(*[F.col(f"`{c}`") for c in carry], key.alias("_key"), block.alias("_block"))
    local = Window.partitionBy("_block").orderBy(again(seed + 1), "_key")
    rows = rows.withColumn("_rank", F.row_number().over(local) - 1)
    rows = rows.join(F.broadcast(plan), "_block")  # at most MAX_BLOCKS^2 numbers
    rank = F.col("_rank")
    passed = lambda ends: F.size(F.filter(ends, lambda e: e <= rank))
    rows = rows.withColumn("shard", passed(F.col("_shard_ends")))
    rows = rows.withColumn("_cell", passed(F.col("_cell_ends")[F.col("shard")]))
    rows = rows.select(*carry, "_key", "shard", "_cell")
    inner = Window.partitionBy("shard", "_cell").orderBy(again(seed + 2), "_key")
    size = F.lit(sum(block_rows))
    shard_size = F.floor(size / n_shards) + (F.col("shard") < size % n_shards).cast("long")
    start = (F.col("_cell") * F.floor(shard_size / per_shard) + F.least(F.col("_cell").cast("long"), shard_size % per_shard))
    slot = start + F.row_number().over(inner) - 1
    return rows.select(*carry, F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"))
