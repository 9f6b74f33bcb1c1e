"""Player table: dimension lookups, cost/value columns, numeric coercion, activity filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import nan_to_null, parse_number, r_paste

_UNSET = object()

NUMERIC_TEXT_COLUMNS = {
    "form": "form_numeric",
    "points_per_game": "points_per_game_numeric",
    "influence": "influence_numeric",
    "creativity": "creativity_numeric",
    "threat": "threat_numeric",
    "ict_index": "ict_index_numeric",
    "selected_by_percent": "selected_by_percent",
}
COUNT_COLUMNS = ["minutes", "total_points", "goals_scored", "assists", "clean_sheets"]


def _cost_text(cost_million):
    """``format(round(cost, 1), nsmall = 1)`` before padding; NA prints as ``NA``."""
    # format_string prints a NULL argument as text, so NULL is handled before formatting.
    return (F.when(cost_million.isNull(), F.lit("NA"))
            .otherwise(F.format_string("%.1f", F.bround(cost_million, 1) + F.lit(0.0))))


def build_players(players_raw: DataFrame, teams: DataFrame, positions: DataFrame, *,
                  variant: str = "v2", on_nonpositive_cost=_UNSET, pad: bool = True) -> DataFrame:
    """Join the team and position dimensions and derive the player columns.

    v2 (default): unknown team/position -> "Unknown"; value 0 when cost <= 0;
    seven numeric-text columns parsed; rows missing points, cost or minutes dropped.
    v1: the dimension value stays NULL when missing, value NULL when cost <= 0,
    no coercion and no NULL filter.

    ``cost_pretty`` pads every cost to the widest formatted cost of the whole
    table (R formats the column as one vector). The width is a scalar subquery
    (a max over ``now_cost`` alone, computed once and inlined as a value).
    """
    if variant not in ("v1", "v2"):
        raise ValueError(f"unknown variant {variant!r}")
    if on_nonpositive_cost is _UNSET:
        on_nonpositive_cost = 0.0 if variant == "v2" else None

    # Dimensions: no hint; the planner broadcasts them when their size estimate is small.
    t = teams.select(F.col("id").alias("_team_id"), F.col("name").alias("_team_name"))
    p = positions.select(F.col("id").alias("_pos_id"), F.col("singular_name").alias("_pos_name"))
    joined = (players_raw
              .join(t, players_raw["team"] == t["_team_id"], "left")
              .join(p, players_raw["element_type"] == p["_pos_id"], "left"))

    cost_million = F.col("now_cost").cast("double") / F.lit(10.0)
    cost_text = _cost_text(cost_million)
    if pad:
        width = players_raw.select(
            F.max(F.length(_cost_text(F.col("now_cost").cast("double") / F.lit(10.0))))).scalar()
        cost_pretty = F.concat(F.lit(K.CURRENCY), F.lpad(cost_text, width, " "))
    else:
        cost_pretty = F.concat(F.lit(K.CURRENCY), cost_text)

    total_points = F.col("total_points").cast("double")
    fallback = F.lit(on_nonpositive_cost).cast("double")
    value = (F.when(cost_million.isNull() | total_points.isNull(), F.lit(None).cast("double"))
             .when(cost_million > 0, F.bround(total_points / cost_million, 2))
             .otherwise(fallback))

    if variant == "v2":
        team_name = F.coalesce(F.col("_team_name"), F.lit(K.UNKNOWN))
        position = F.coalesce(F.col("_pos_name"), F.lit(K.UNKNOWN))
    else:
        team_name = F.col("_team_name")
        position = F.col("_pos_name")

    base = [
        F.col("id"), F.col("first_name"), F.col("second_name"), F.col("team"), F.col("element_type"),
        F.col("now_cost"),
        team_name.alias("TEAMS"),
        position.alias("position"),
        cost_million.alias("cost_million"),
        cost_pretty.alias("cost_pretty"),
        value.alias("value"),
        r_paste("first_name", "second_name").alias("full_name"),
    ]
    if variant == "v1":
        counts = [F.col(c).cast("double").alias(c) for c in COUNT_COLUMNS]
        return joined.select(*base, *counts)

    parsed = [parse_number(F.col(src)).alias(dst) for src, dst in NUMERIC_TEXT_COLUMNS.items()]
    counts = [nan_to_null(F.col(c).cast("double")).alias(c) for c in COUNT_COLUMNS]
    out = joined.select(*base, *parsed, *counts)
    return out.filter(F.col("total_points").isNotNull() & F.col("cost_million").isNotNull()
                      & F.col("minutes").isNotNull())


def is_active(min_minutes: float = K.ACTIVE_MIN_MINUTES_V2, require_form: bool = True) -> Column:
    """``minutes > min_minutes`` (v2: 100, v1: 500); v2 also needs form and PPG present."""
    out = F.col("minutes") > F.lit(min_minutes)
    if require_form:
        out = out & F.col("form_numeric").isNotNull() & F.col("points_per_game_numeric").isNotNull()
    return F.coalesce(out, F.lit(False))


def active_players(players: DataFrame, min_minutes: float = K.ACTIVE_MIN_MINUTES_V2,
                   require_form: bool = True) -> DataFrame:
    """The players who are ``is_active``."""
    out = players.filter(F.col("minutes") > F.lit(min_minutes))
    if require_form:
        out = out.filter(F.col("form_numeric").isNotNull() & F.col("points_per_game_numeric").isNotNull())
    return out
