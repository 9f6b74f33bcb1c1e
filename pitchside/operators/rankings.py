"""Sorted listings and top-k operators.

Every ORDER BY ends with ``id``: R's ``arrange`` is stable (ties keep source
order, which is id order), Spark's sort is not, so limits must be made
deterministic explicitly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import lookup, ordinal, round_all_numeric


def top_value(df: DataFrame, n: int | None = None, variant: str = "v2") -> DataFrame:
    """Best points-per-cost players (after the dashboard filter); plans as TakeOrderedAndProject."""
    ordered = df.orderBy(F.desc_nulls_last("value"), F.asc("id"))
    if variant == "v2":
        n = K.TOP_VALUE_N_V2 if n is None else n
        cols = [F.col("id"), F.col("full_name").alias("player"), F.col("TEAMS").alias("team"),
                F.col("position"), F.col("total_points"), F.col("cost_pretty").alias("cost"),
                F.col("value"), F.col("form_numeric").alias("form"), F.col("minutes")]
    elif variant == "v1":
        n = K.TOP_VALUE_N_V1 if n is None else n
        cols = [F.col("id"), F.col("full_name"), F.col("TEAMS"), F.col("position"), F.col("total_points"),
                F.col("cost_pretty").alias("cost_millions"), F.col("value")]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return ordered.limit(n).select(*cols)


def feature_leaders(features: DataFrame, n: int = K.FEATURE_LEADERS_N) -> DataFrame:
    """Top players by momentum, every numeric column rounded to 2 places."""
    top = features.orderBy(F.desc_nulls_last("momentum"), F.asc("id")).limit(n).select(
        F.col("id"), F.col("full_name").alias("player"), F.col("TEAMS").alias("team"), F.col("position"),
        F.col("momentum"), F.col("efficiency"), F.col("goals_per_90"), F.col("assists_per_90"),
        F.col("consistency_score").alias("consistency"))
    return round_all_numeric(top, 2)


def team_points(active: DataFrame) -> DataFrame:
    """Sum of points per team; partial aggregation before the shuffle."""
    return active.groupBy("TEAMS").agg(F.sum("total_points").alias("total_points"))


def top_teams(active: DataFrame, n: int = K.TOP_TEAMS_N) -> DataFrame:
    """Top teams by summed points; ``chart_order`` is the chart's ascending order (1 = lowest shown)."""
    top = team_points(active).orderBy(F.desc("total_points"), F.asc("TEAMS")).limit(n)
    # The window runs over at most n rows (after the limit), never over the table.
    return top.withColumn("chart_order",
                          F.row_number().over(Window.orderBy(F.asc("total_points"), F.desc("TEAMS"))))


def team_squad(active: DataFrame, team: str | None = None, variant: str = "v2") -> DataFrame:
    """Squad listing ordered by position name, then points descending; all teams when ``team`` is None."""
    df = active if team is None else active.filter(F.col("TEAMS") == F.lit(team))
    if variant == "v2":
        cols = [F.col("id"), F.col("TEAMS").alias("team"), F.col("full_name").alias("player"),
                F.col("position"), F.col("total_points"), F.col("cost_million").alias("cost"),
                F.col("value"), F.col("form_numeric").alias("form")]
    elif variant == "v1":
        cols = [F.col("id"), F.col("TEAMS").alias("team"), F.col("full_name").alias("player"),
                F.col("position"), F.col("total_points"), F.col("cost_million").alias("cost")]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.select(*cols).orderBy(F.asc("team"), F.asc("position"), F.desc("total_points"), F.asc("id"))


_SQUAD_COLUMNS = ["id", "player", "team", "position", "total_points", "goals", "assists", "clean_sheets",
                  "cost_million", "value"]


def _squad_select(df: DataFrame) -> DataFrame:
    return df.select(F.col("id"), F.col("full_name").alias("player"), F.col("TEAMS").alias("team"),
                     F.col("position"), F.col("total_points"), F.col("goals_scored").alias("goals"),
                     F.col("assists"), F.col("clean_sheets"), F.col("cost_million"), F.col("value"))


def elite_squad(active: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """Best players per position under quotas (default 2 GK, 5 DEF, 5 MID, 3 FWD).

    ``row_number`` per position, filtered first by the literal largest quota so
    Catalyst inserts a partial WindowGroupLimit before the shuffle (each map
    task keeps at most that many rows per position: four hot keys never ship
    the table), then by each position's own quota.
    """
    quotas = dict(K.SQUAD_QUOTAS if quotas is None else quotas)
    order = list(quotas)
    w = Window.partitionBy("position").orderBy(F.desc("total_points"), F.asc("id"))
    ranked = (active.filter(F.col("position").isin(order))
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") <= F.lit(max(quotas.values())))
              .filter(F.col("_rn") <= lookup("position", quotas, 0)))
    return (_squad_select(ranked)
            .orderBy(ordinal("position", order), F.desc("total_points"), F.asc("id")))


def elite_squad_union(active: DataFrame, quotas: dict[str, int] | None = None) -> DataFrame:
    """The reference's form: one top-k per position, then a union (equivalence check for elite_squad)."""
    quotas = dict(K.SQUAD_QUOTAS if quotas is None else quotas)
    order = list(quotas)
    parts = [active.filter(F.col("position") == F.lit(pos))
             .orderBy(F.desc("total_points"), F.asc("id")).limit(k)
             for pos, k in quotas.items()]
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return _squad_select(merged).orderBy(ordinal("position", order), F.desc("total_points"), F.asc("id"))
