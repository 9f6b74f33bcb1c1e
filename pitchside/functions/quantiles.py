"""Exact interpolated quantiles (R type 7) without sorting the table or gathering a group.

Selection in narrowing brackets. A mergeable sketch gives, for every probability, two values between which the wanted ranks
lie (``percentile_approx`` is within 1/accuracy of the rank, and the bracket is twice as wide). One aggregate counts the rows
below each bracket and keeps the nearest values outside it. The distinct values inside are counted, dealt into equal bins
between the bracket's ends, and the running counts of the bins tell which bins hold the ranks; with more ``levels`` these
bins are divided again between their own ends. Only the values of the bins left at the end are put in order, and no array of values is ever made.

All steps are aggregates with map-side combine, for all groups and probabilities at once; the levels work on the shuffled
counts, not on the table. A hot value is one counted value.
Nothing is written, and the joins are on the group columns and bins, to tables of at most ``BINS`` rows per group and probability.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 50_000
#: Bins that a bracket is divided into, and the bytes of input below which it is not (at most some 80,000 values, as doubles).
BINS, LEVEL_BYTES = 4_096, 8 << 30


def _bin(x: Column, low: Column, high: Column) -> Column:
    """The bin of ``x`` between ``low`` and ``high``; never falls as ``x`` grows, also with infinite or missing widths."""
    share = F.try_divide((x - low) * F.lit(float(BINS)), high - low)
    share = F.when(share.isNull() | F.isnan(share) | (share < 0), 0.0).otherwise(F.least(share, F.lit(BINS - 1.0)))
    return F.when(x == high, F.lit(BINS - 1)).otherwise(F.floor(share).cast("int"))


def last_candidates(counts: DataFrame, keys: Sequence[str], levels: int) -> DataFrame:
    """``counts`` without the values that cannot stand at a wanted rank, with their bin (``_path``, ``_b``) and the rows in earlier bins (``_before``).

    ``counts``: (*keys, _x, _c, _first, _last, _low, _high): a distinct value, its rows, the wanted ranks among the values of its key, and
    the ends between which all of them lie. Each level keeps at most two bins of a key.
    """
    k = [*keys, "_path"]
    found = counts.withColumn("_path", F.lit(0).cast("long")).withColumn("_before", F.lit(0).cast("long"))
    for level in range(levels):
        if level:   # what was kept is divided again, between the least and the largest value of its bin
            found = found.withColumn("_path", F.col("_path") * BINS + F.col("_b")).drop("_b")
        found = found.withColumn("_b", _bin(F.col("_x"), F.col("_low"), F.col("_high")))
        bins = found.groupBy(*k, "_b").agg(
            F.sum("_c").alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"),
            *[F.min(c).alias(c) for c in ("_before", "_first", "_last")])
        line = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(line), F.lit(0)))
        inside = [(F.col(r) >= F.col("_before")) & (F.col(r) < F.col("_before") + F.col("_n")) for r in ("_first", "_last")]
        kept = bins.filter(inside[0] | inside[1]).select(*k, "_b", "_before", F.col("_least").alias("_low"), F.col("_most").alias("_high"))
        found = found.drop("_before", "_low", "_high").join(kept, [*k, "_b"])
    return found


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    accuracy: int = ACCURACY, levels: int | None = None) -> DataFrame:
    """Rows ``(*group_cols, prob_idx, prob, n, quantile)``, NULL values ignored; no values, no row.

    The quantile at probability p is x[k] + h * (x[k+1] - x[k]) with
    h = (n - 1) * p - k over the sorted values, computed as R does:
    ``(1 - h) * x[k] + h * x[k+1]``, and exactly x[k] when the two are equal.
    Values counted one by one: about 4 / ``accuracy`` of the rows at most, fewer if they repeat; put in order: those in two bins
    of the last of ``levels``. By default one level from ``LEVEL_BYTES`` of input on, by the planner's estimate (below, a bracket holds few
    values), else none; the result is the same.
    """
    g, m = list(group_cols), len(probs)
    vals = df.select(*g, F.col(value_col).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    slack = 2.0 / accuracy
    edges = F.array(*[F.lit(min(1.0, max(0.0, p + d))) for p in probs for d in (-slack, slack)])
    sketch = F.percentile_approx("_x", edges, accuracy).alias("_edges")
    if g:
        rows = vals.join(vals.groupBy(*g).agg(sketch), g)
    else:
        rows = vals.withColumn("_edges", vals.agg(sketch).scalar())
    x = F.col("_x")
    low, high = (lambda i: F.col("_edges")[2 * i]), (lambda i: F.col("_edges")[2 * i + 1])
    around = [F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count_if(x < low(i)).alias("below"), F.max(F.when(x < low(i), x)).alias("prev"),
                 F.min(F.when(x > high(i), x)).alias("next"), F.min(low(i)).alias("_low"), F.max(high(i)).alias("_high")).alias(f"_a{i}")
        for i in range(m)]]
    around = rows.groupBy(*g).agg(*around) if g else rows.agg(*around).filter("n > 0")
    probabilities = F.array(*[F.struct(F.lit(i).alias("prob_idx"), F.lit(float(p)).alias("prob"), F.col(f"_a{i}").alias("a"))
                              for i, p in enumerate(probs)])
    targets = around.select(*g, "n", F.explode(probabilities).alias("_p")).select(*g, "n", "_p.prob_idx", "_p.prob", "_p.a.*")
    h = (F.col("n") - 1) * F.col("prob")
    targets = targets.withColumn("_first", F.floor(h) - F.col("below")).withColumn("_last", F.ceil(h) - F.col("below"))

    if levels is None:
        levels = int(vals._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > LEVEL_BYTES)
    inside = rows.select(*g, "_x", F.explode(F.filter(F.array(*[
        F.when((x >= low(i)) & (x <= high(i)), F.lit(i)) for i in range(m)]), lambda i: i.isNotNull())).alias("prob_idx"))
    key = [*g, "prob_idx"]
    counts = inside.groupBy(*key, "_x").agg(F.count(F.lit(1)).alias("_c"))
    if levels:
        counts = last_candidates(counts.join(targets.select(*key, "_first", "_last", "_low", "_high"), key), key, levels)
    else:
        counts = counts.select("*", F.lit(0).alias("_path"), F.lit(0).alias("_b"), F.lit(0).cast("long").alias("_before"))
    line = Window.partitionBy(*key, "_path", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(*key, "_x", (F.col("_before") + F.sum("_c").over(line)).alias("_end"))
    found = targets.join(placed, key, "left").groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("n", "prob", "prev", "next", "_first", "_last")],
        *[F.min(F.when(F.col("_end") > F.col(r), F.col("_x"))).alias(v) for r, v in (("_first", "_x0"), ("_last", "_x1"))])

    def at(rank: str, value: str) -> Column:
        """The value at a rank: before the bracket, inside, or after it."""
        return F.when(F.col(rank) < 0, F.col("prev")).otherwise(F.coalesce(F.col(value), F.col("next")))

    found = found.select(*key, "prob", "n", at("_first", "_x0").alias("_lo"), at("_last", "_x1").alias("_hi"))
    frac = h - F.floor(h)
    return found.select(
        *key, "prob", "n",
        F.when(F.col("_lo") == F.col("_hi"), F.col("_lo"))
        .otherwise((F.lit(1.0) - frac) * F.col("_lo") + frac * F.col("_hi")).alias("quantile"))
