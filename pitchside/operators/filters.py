"""Dashboard filters, point lookups and the points-vs-cost scatter dataset."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions.exprs import num_text, r_paste

ALL = "All"


def dashboard_filter(df: DataFrame, position: str | None = None, team: str | None = None,
                     max_cost: float | None = None, min_minutes: float | None = None) -> DataFrame:
    """Optional predicates; ``None``/"All" adds none. Catalyst merges them into one Filter."""
    if position is not None and position != ALL:
        df = df.filter(F.col("position") == F.lit(position))
    if team is not None and team != ALL:
        df = df.filter(F.col("TEAMS") == F.lit(team))
    if max_cost is not None:
        df = df.filter(F.col("cost_million") <= F.lit(float(max_cost)))
    if min_minutes is not None:
        df = df.filter(F.col("minutes") >= F.lit(float(min_minutes)))
    return df


def lookup_players(df: DataFrame, ids: Iterable[int] | None = None, names: Iterable[str] | None = None) -> DataFrame:
    """Point lookup by id or full name; no list means every player."""
    if ids is not None:
        df = df.filter(F.col("id").isin([int(i) for i in ids]))
    if names is not None:
        df = df.filter(F.col("full_name").isin(list(names)))
    return df


def points_vs_cost(df: DataFrame, variant: str = "v2") -> DataFrame:
    """Scatter dataset: cost, points, colour key and the tooltip text.

    v2 colours by position; v1 by team (and shapes by position).
    """
    cost = num_text("cost_million", 1)
    points = num_text("total_points", 0)
    if variant == "v2":
        tooltip = r_paste(F.lit("Player:"), "full_name", F.lit("<br>Team:"), "TEAMS",
                          F.lit("<br>Position:"), "position", F.lit("<br>Cost: £"), cost,
                          F.lit("<br>Points:"), points, F.lit("<br>Value:"), num_text("value", 2))
        colour = F.col("position")
    elif variant == "v1":
        tooltip = r_paste("full_name", F.lit("<br>Team:"), "TEAMS", F.lit("<br>Cost: £"), cost,
                          F.lit("<br>Points:"), points)
        colour = F.col("TEAMS")
    else:
        raise ValueError(f"unknown variant {variant!r}")
    return df.select("id", "cost_million", "total_points", colour.alias("colour_key"),
                     F.col("position").alias("shape_key"), tooltip.alias("tooltip"))
