"""Rolling form per player over a dense week spine, in blocks of weeks.

No step holds all weeks of a player together. The spine of a player is cut into blocks of ``BLOCK`` weeks; a block also
covers the last weeks of the one before it (the halo), as many as the longest frame looks back, and brings the player's points of
the first week, which momentum counts from. Each block has a row for its first week even if the player has none there, so gaps are the intervals from
a row's week to the next row's (``lead``) and are filled with zeros row by row. The frames run over the same blocks without another
shuffle, and the halo's rows are dropped at the end.

A week that no spine can hold (none, below 1 or beyond ``max_week``) is reported by ``invalid_weeks`` and lengthens nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions import constants as K

#: Weeks of a block.
BLOCK = 1024


def valid_week(max_week: int = K.MAX_WEEK) -> Column:
    return F.col("week").isNotNull() & F.col("week").between(1, max_week)


def invalid_weeks(player_points: DataFrame, max_week: int = K.MAX_WEEK) -> DataFrame:
    """The rows that no spine can hold: no week, one below 1 or beyond ``max_week``. Report them; ``dense_weeks`` leaves their points out."""
    return player_points.filter(~F.coalesce(valid_week(max_week), F.lit(False)))


def _filled_blocks(player_points: DataFrame, n_weeks: int | None, max_week: int, block: int, halo: int) -> DataFrame:
    """(player_id, block, week, points, base): every week of every block and the ``halo`` weeks before it; base in the block's first row."""
    # The three readings of the input take the same columns and no filter of their own: an input that is an aggregate is shuffled once.
    valid = valid_week(max_week)
    last = player_points.select(F.max(F.struct(F.when(valid, F.col("week")).alias("week"), "player_id", "points"))["week"]).scalar()
    end = F.greatest(F.coalesce(last, F.lit(0)), F.lit(int(n_weeks or 0)))
    of = lambda week: F.floor((week - 1) / F.lit(block)).cast("int")
    # Every player of the input has blocks, also one whose only rows are invalid.
    first = F.sum(F.when(valid & (F.col("week") == 1), F.col("points")).otherwise(0))
    starts = player_points.groupBy("player_id").agg(F.coalesce(first, F.lit(0)).alias("base")) \
        .select("player_id", "base", F.explode(F.when(end >= 1, F.sequence(F.lit(0), of(end)))).alias("block"))
    starts = starts.select("player_id", "block", F.greatest(F.lit(1), F.col("block") * block + 1 - halo).alias("week"), F.lit(0).cast("long").alias("points"), "base")
    blocks = F.explode_outer(F.when(valid, F.sequence(of(F.col("week")), F.least(of(F.col("week") + halo), of(end)))))
    rows = player_points.select("player_id", blocks.alias("block"), "week", F.col("points").cast("long").alias("points"),
                                F.lit(None).cast("long").alias("base")).filter(F.col("block").isNotNull())
    weekly = rows.unionByName(starts).groupBy("player_id", "block", "week").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("points"), F.max("base").alias("base"))
    line = Window.partitionBy("player_id", "block").orderBy("week")
    following = F.coalesce(F.lead("week").over(line), F.least((F.col("block") + 1) * block, end) + 1)
    spans = weekly.withColumn("_next", following)
    return spans.select("player_id", "block", F.explode(F.sequence("week", F.col("_next") - 1)).alias("w"), "week", "points", "base").select(
        "player_id", "block", F.col("w").cast("int").alias("week"), F.when(F.col("w") == F.col("week"), F.col("points")).otherwise(0).alias("points"),
        F.when(F.col("w") == F.col("week"), F.col("base")).alias("base"))


def dense_weeks(player_points: DataFrame, n_weeks: int | None = None, max_week: int = K.MAX_WEEK, block: int = BLOCK) -> DataFrame:
    """``(player_id, week, points)`` for every week from 1 to the last valid one of the data, zero where a player has no row.

    ``n_weeks`` can lengthen the spine, never cut it. Every player of the input is kept, also one whose only rows are
    ``invalid_weeks``.
    """
    return _filled_blocks(player_points, n_weeks, max_week, block, 0).select("player_id", "week", "points")


def rolling_form(player_points: DataFrame, n_weeks: int | None = None, short: int = K.ROLLING_SHORT, long: int = K.ROLLING_LONG,
                 max_week: int = K.MAX_WEEK, block: int = BLOCK) -> DataFrame:
    """3- and 5-week moving averages, 5-week volatility (sample sd) and momentum.

    Averages and volatility are NULL until the window is full (R's ``if (i < k) NA``).
    Momentum is ``cumsum(c(0, diff(x)))``, which telescopes to ``x - x[1]``.
    """
    dense = _filled_blocks(player_points, n_weeks, max_week, block, max(short, long) - 1)
    w = Window.partitionBy("player_id", "block").orderBy("week")
    pts, week = F.col("points").cast("double"), F.col("week")
    return dense.select(
        "player_id", "week", "points", "block",
        F.when(week >= short, F.avg(pts).over(w.rowsBetween(-(short - 1), 0))).alias("ma_short"),
        F.when(week >= long, F.avg(pts).over(w.rowsBetween(-(long - 1), 0))).alias("ma_long"),
        F.when(week >= long, F.stddev_samp(pts).over(w.rowsBetween(-(long - 1), 0))).alias("volatility"),
        (pts - F.first("base").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("momentum"),
    ).filter(F.col("week") > F.col("block") * block).drop("block")


def momentum_by_differences(player_points: DataFrame, n_weeks: int | None = None, max_week: int = K.MAX_WEEK, block: int = BLOCK) -> DataFrame:
    """Momentum the long way, by a running sum of differences in two levels; must equal ``rolling_form``'s momentum.

    The sum runs within each block; the totals of a player's earlier blocks, one row per block, are added to it.
    """
    dense = _filled_blocks(player_points, n_weeks, max_week, block, 1)
    w = Window.partitionBy("player_id", "block").orderBy("week")
    own = dense.withColumn("_d", F.coalesce(F.col("points") - F.lag("points").over(w), F.lit(0))).filter(F.col("week") > F.col("block") * block)
    own = own.withColumn("_d", F.when(F.col("week") > 1, F.col("_d")).otherwise(0))
    before = Window.partitionBy("player_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("player_id", "block").agg(F.sum("_d").alias("_t"))
    totals = totals.select("player_id", "block", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    within = F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("player_id", "block", "week", within.alias("_s")).join(totals, ["player_id", "block"]).select(
        "player_id", "week", (F.col("_s") + F.col("_before")).cast("double").alias("momentum"))
