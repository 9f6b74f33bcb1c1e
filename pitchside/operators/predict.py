"""Points prediction for every player, its card, and the difficulty sweep.

The reference adds uniform noise in [-0.3, 0.3] and reports the mean, min and
max of ten draws; here the centre and the limits of that same noise band are
reported, which is deterministic and needs no per-player sampling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import clip, lookup, num_text
from pitchside.operators.filters import lookup_players
from pitchside.operators.fixtures import resolve_difficulty


def _base() -> F.Column:
    return (F.col("form_numeric") * F.lit(K.PREDICT_FORM_WEIGHT)
            + F.col("points_per_game_numeric") * F.lit(K.PREDICT_PPG_WEIGHT))


def _raw_prediction(difficulty: F.Column) -> F.Column:
    mult = lookup(difficulty, K.DIFFICULTY_MULTIPLIER, 1.0).cast("double")
    adj = lookup("position", K.PREDICT_POSITION_ADJUSTMENT, 1.0).cast("double")
    return clip(_base() * mult * adj, K.PREDICT_MIN, K.PREDICT_MAX)


def predict(active: DataFrame, upcoming: DataFrame | None = None, gameweek: int | None = None,
            manual: int = K.DEFAULT_MANUAL_DIFFICULTY, per_week: DataFrame | None = None) -> DataFrame:
    """Predicted points, with band, for every active player in one job.

    With ``upcoming`` the difficulty comes from each player's fixture in the
    gameweek (default: the first upcoming one); without it (manual mode) every
    player uses ``manual``.
    """
    resolved = resolve_difficulty(active, upcoming, gameweek, manual, per_week)
    x = _raw_prediction(F.col("fixture_difficulty"))
    return resolved.select(
        "id", "full_name", "TEAMS", "position", "form_numeric", "points_per_game_numeric",
        "total_points", "goals_scored", "assists", "minutes", "value",
        "gameweek", "fixture_id", "fixture_difficulty",
        _base().alias("base_prediction"),
        F.bround(x, 1).alias("predicted_points"),
        F.bround(clip(x - F.lit(K.PREDICT_NOISE), K.PREDICT_MIN, K.PREDICT_MAX), 1).alias("predicted_low"),
        F.bround(clip(x + F.lit(K.PREDICT_NOISE), K.PREDICT_MIN, K.PREDICT_MAX), 1).alias("predicted_high"),
    )


def prediction_card(predictions: DataFrame, ids=None, names=None) -> DataFrame:
    """The 13-row (metric, value) card per player, as text; ``ids`` or ``names`` narrow it to some players."""
    predictions = lookup_players(predictions, ids, names)
    d = F.col("fixture_difficulty")
    labels = F.array(*[F.lit(f"({name})") for name in K.DIFFICULTY_LABELS])
    label = F.coalesce(F.get(labels, d - 1), F.lit("NA"))
    pts = lambda c: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(F.concat(num_text(c, 1), F.lit(" pts")))
    rows = [
        ("Player", F.col("full_name")),
        ("Team", F.col("TEAMS")),
        ("Position", F.col("position")),
        ("Current Form", F.concat(num_text("form_numeric", 1), F.lit("/10.0"))),
        ("Points Per Game", num_text("points_per_game_numeric", 1)),
        ("Total Points", num_text("total_points", 0)),
        ("Goals", num_text("goals_scored", 0)),
        ("Assists", num_text("assists", 0)),
        ("Minutes Played", F.format_number(F.col("minutes"), 0)),
        ("Value Rating", num_text("value", 2)),
        ("Fixture Difficulty", F.concat(F.coalesce(d.cast("string"), F.lit("NA")), F.lit("/5 "), label)),
        ("Predicted Points", pts("predicted_points")),
        ("Prediction Range", F.when(F.col("predicted_low").isNull() | F.col("predicted_high").isNull(), F.lit("N/A"))
         .otherwise(F.concat(num_text("predicted_low", 1), F.lit(" - "), num_text("predicted_high", 1), F.lit(" pts")))),
    ]
    card = F.array(*[F.struct(F.lit(i + 1).alias("row"), F.lit(name).alias("metric"),
                              F.coalesce(v.cast("string"), F.lit("NA")).alias("value"))
                     for i, (name, v) in enumerate(rows)])
    return predictions.select("id", F.explode(card).alias("_c")).select(
        "id", F.col("_c.row").alias("row"), F.col("_c.metric").alias("metric"), F.col("_c.value").alias("value"))


def difficulty_sweep(active: DataFrame, current: int = K.DEFAULT_MANUAL_DIFFICULTY, ids=None, names=None) -> DataFrame:
    """Prediction at each difficulty 1..5 for every player (or those of ``ids`` or ``names``); ``is_current`` marks the selected one."""
    active = lookup_players(active, ids, names)
    labels = F.array(*[F.lit(name) for name in K.DIFFICULTY_LABELS])
    swept = active.select("id", "position", "form_numeric", "points_per_game_numeric",
                          F.explode(F.sequence(F.lit(1), F.lit(len(K.DIFFICULTY_LABELS)))).alias("difficulty"))
    return swept.select(
        "id", "difficulty", F.get(labels, F.col("difficulty") - 1).alias("label"),
        F.bround(_raw_prediction(F.col("difficulty")), 1).alias("predicted_points"),
        (F.col("difficulty") == F.lit(int(current))).alias("is_current"))
