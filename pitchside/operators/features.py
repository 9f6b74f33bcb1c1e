"""Engineered feature table (one row per active player, complete cases only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import lookup, r_ifelse, r_pmin, safe_div
from pitchside.functions.joins import salted_lookup
from pitchside.functions.quantiles import exact_quantiles

FEATURE_COLUMNS = [
    "id", "full_name", "TEAMS", "position", "total_points", "form_numeric", "form_weight",
    "points_per_game_numeric", "points_per_90", "minutes", "goals_scored", "assists",
    "clean_sheets", "goals_per_90", "assists_per_90", "position_multiplier",
    "influence_score", "creativity_score", "threat_score", "team_avg_points",
    "popularity", "cost_million", "is_high_performer", "consistency_score",
    "momentum", "efficiency",
]


def table_scalars(active: DataFrame, approx_quantile: bool = False) -> tuple[Column, Column]:
    """The two table-wide scalars the features use, as scalar subqueries ``(q75, pooled_sd)``.

    * ``q75``: 75th percentile of total_points, interpolated (R type 7), from
      the distributed exact quantile (a sketch's bracket, then exact counts);
      ``approx_quantile=True`` uses the mergeable sketch alone.
    * ``pooled_sd``: sample sd of goals, assists and clean sheets taken as one
      pooled vector (R's ``sd(c(a, b, c))`` inside an ungrouped mutate is one
      scalar for the table). NULL when any of them is NULL, as in R.

    Both are global aggregates (exactly one row, NULL on an empty table), used
    as scalar subqueries: computed once and inlined as values, no join.
    """
    if approx_quantile:
        q = active.select(F.percentile_approx("total_points", K.HIGH_PERFORMER_QUANTILE, 100_000)
                          .cast("double"))
    else:
        q = (exact_quantiles(active, "total_points", [K.HIGH_PERFORMER_QUANTILE])
             .select(F.max("quantile")))
    pooled = F.explode(F.array("goals_scored", "assists", "clean_sheets")).alias("_v")
    sd = active.select(pooled).select(F.when(F.count("_v") == F.count(F.lit(1)), F.stddev_samp("_v")))
    return q.scalar(), sd.scalar()


def table_statistics(active: DataFrame, approx_quantile: bool = False) -> DataFrame:
    """The table-wide scalars as a one-row table ``(q75, pooled_sd)``."""
    q75, sd = table_scalars(active, approx_quantile)
    return active.sparkSession.range(1).select(q75.alias("q75"), sd.alias("pooled_sd"))


def team_means(active: DataFrame) -> DataFrame:
    """Mean points per team id; partial aggregation makes a hot team harmless."""
    return (active.filter(F.col("team").isNotNull())
            .groupBy(F.col("team").alias("_t")).agg(F.avg("total_points").alias("_team_avg")))


def build_features(active: DataFrame, approx_quantile: bool = False, means: DataFrame | None = None) -> DataFrame:
    """The feature table; ``means`` may pass in ``team_means(active)`` already staged."""
    minutes = F.col("minutes")
    per_90 = lambda c: r_ifelse(minutes > 0, safe_div(F.col(c) * 90, minutes), F.lit(0.0))

    # Team mean joined back by key, salted: the aggregated side has one row per team, and teams are hot keys.
    df = salted_lookup(active, team_means(active) if means is None else means, "team", "_t", "id")
    q75, pooled_sd = table_scalars(active, approx_quantile)

    out = df.select(
        F.col("id"), F.col("full_name"), F.col("TEAMS"), F.col("position"), F.col("total_points"),
        F.col("form_numeric"),
        r_pmin(F.col("form_numeric") * F.lit(K.FORM_WEIGHT_FACTOR), K.FORM_WEIGHT_CAP).alias("form_weight"),
        F.col("points_per_game_numeric"),
        per_90("total_points").alias("points_per_90"),
        minutes.alias("minutes"), F.col("goals_scored"), F.col("assists"), F.col("clean_sheets"),
        per_90("goals_scored").alias("goals_per_90"),
        per_90("assists").alias("assists_per_90"),
        lookup("position", K.FEATURE_POSITION_MULTIPLIER, 1.0).cast("double").alias("position_multiplier"),
        F.coalesce(F.col("influence_numeric") / F.lit(100.0), F.lit(0.0)).alias("influence_score"),
        F.coalesce(F.col("creativity_numeric") / F.lit(100.0), F.lit(0.0)).alias("creativity_score"),
        F.coalesce(F.col("threat_numeric") / F.lit(100.0), F.lit(0.0)).alias("threat_score"),
        # R's ave() keeps a row's own value when its group key is NA.
        F.when(F.col("team").isNull(), F.col("total_points")).otherwise(F.col("_team_avg")).alias("team_avg_points"),
        (F.coalesce(F.col("selected_by_percent"), F.lit(0.0)) / F.lit(100.0)).alias("popularity"),
        F.col("cost_million"),
        r_ifelse(F.col("total_points") > q75, F.lit("High"), F.lit("Low")).alias("is_high_performer"),
        r_ifelse(minutes > 0,
                 safe_div(safe_div("total_points", minutes / F.lit(90.0)), pooled_sd + F.lit(1.0)),
                 F.lit(0.0)).alias("consistency_score"),
        (F.col("form_numeric") * F.col("points_per_game_numeric")).alias("momentum"),
        r_ifelse(F.col("cost_million") > 0, safe_div("total_points", "cost_million"), F.lit(0.0)).alias("efficiency"),
    )
    # complete.cases over the 26 columns (dropna also drops NaN).
    return out.select(*FEATURE_COLUMNS).dropna(how="any")
