"""Per-player cards in long form: radar profile and pairwise comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import safe_div
from pitchside.functions.joins import salted_lookup
from pitchside.operators.filters import lookup_players


def radar(active: DataFrame, ids=None, variant: str = "v2", names=None) -> DataFrame:
    """Radar values per player.

    v2: goals, assists, clean sheets, points, minutes each as % of the table
    max, form as form/10 * 100. A zero max gives
    NULL (R would give NaN/Inf). v1: raw stats, only minutes scaled; adds the
    axis bound (the player's largest value * 1.1). The table maxima are scalar
    subqueries over the same table, which Catalyst merges into one aggregate.
    """
    top = {c: active.select(F.max(c)).scalar()
           for c in ("goals_scored", "assists", "clean_sheets", "total_points", "minutes")}
    df = active
    df = lookup_players(df, ids, names)
    if variant == "v2":
        rows = [(label, safe_div(c, top[c]) * F.lit(100.0)) for label, c in K.RADAR_V2]
        rows.append(("Form", F.col("form_numeric") / F.lit(10.0) * F.lit(100.0)))
        extra = []
    elif variant == "v1":
        rows = [(label, safe_div(c, top[c]) * F.lit(100.0) if c == "minutes" else F.col(c).cast("double"))
                for label, c in K.RADAR_V1]
        # Row-wise greatest: no shuffle.
        extra = [(F.greatest(*[v.cast("double") for _, v in rows]) * F.lit(K.RADAR_V1_AXIS_FACTOR)).alias("axis_max")]
    else:
        raise ValueError(f"unknown variant {variant!r}")
    items = F.array(*[F.struct(F.lit(i + 1).alias("ord"), F.lit(name).alias("metric"),
                               v.cast("double").alias("value")) for i, (name, v) in enumerate(rows)])
    out_cols = ["id", F.col("_m.ord").alias("ord"), F.col("_m.metric").alias("metric"),
                F.col("_m.value").alias("value")]
    if extra:
        out_cols.append("axis_max")
    return df.select("id", *extra, F.explode(items).alias("_m")).select(*out_cols)


def compare(active: DataFrame, pairs: DataFrame, variant: str = "v2") -> DataFrame:
    """Side-by-side stats for each (player1_id, player2_id) pair.

    Both sides are looked up by id with equi-joins. A player who is the second
    of very many pairs is a hot key, so that side is first reduced to the
    players it names and then looked up with salt.
    """
    if variant not in ("v1", "v2"):
        raise ValueError(f"unknown variant {variant!r}")
    stats = K.COMPARE_V2 if variant == "v2" else K.COMPARE_V1
    cols = sorted({c for _, c, _ in stats})
    p1 = active.select(F.col("id").alias("player1_id"), *[F.col(c).alias(f"p1_{c}") for c in cols])
    p2 = active.select(F.col("id").alias("_id2"), *[F.col(c).alias(f"p2_{c}") for c in cols])
    named = pairs.select(F.col("player2_id").alias("_id2")).distinct()
    first = pairs.select("player1_id", "player2_id").join(p1, "player1_id")
    joined = salted_lookup(first, p2.join(named, "_id2", "left_semi"), "player2_id", "_id2", "player1_id")
    joined = joined.filter(F.col("_id2").isNotNull())
    items = F.array(*[
        F.struct(F.lit(i + 1).alias("ord"), F.lit(label).alias("stat"),
                 (F.col(f"p1_{c}").cast("double") / F.lit(div)).alias("player1"),
                 (F.col(f"p2_{c}").cast("double") / F.lit(div)).alias("player2"))
        for i, (label, c, div) in enumerate(stats)])
    return joined.select("player1_id", "player2_id", F.explode(items).alias("_s")).select(
        "player1_id", "player2_id", F.col("_s.ord").alias("ord"), F.col("_s.stat").alias("stat"),
        F.col("_s.player1").alias("player1"), F.col("_s.player2").alias("player2"))


def named_pairs(active: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(player1_id, player2_id) of pairs of full names, for ``compare``; players who share a name are paired each, unknown names with nobody."""
    spark = active.sparkSession
    said = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "n1 string, n2 string")
    first = active.select(F.col("full_name").alias("n1"), F.col("id").alias("player1_id"))
    second = active.select(F.col("full_name").alias("n2"), F.col("id").alias("player2_id"))
    return said.join(first, "n1").join(second, "n2").select("player1_id", "player2_id")
