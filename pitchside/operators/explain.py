"""Explanations: additive decision path and centred local contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.operators.filters import lookup_players


def decision_path(features: DataFrame, ids=None, names=None) -> DataFrame:
    """Six steps per player: table mean, + momentum*2, + efficiency*1.5, + form_weight*0.8,
    * position multiplier, then the player's actual points (labelled as such). Each rounded to 1 place.

    The mean is over the whole feature table (a scalar subquery), before any id filter.
    """
    base = features.select(F.avg("total_points")).scalar()
    df = lookup_players(features, ids, names)
    w = K.DECISION_WEIGHTS
    s1 = base
    s2 = s1 + F.col("momentum") * F.lit(w["momentum"])
    s3 = s2 + F.col("efficiency") * F.lit(w["efficiency"])
    s4 = s3 + F.col("form_weight") * F.lit(w["form_weight"])
    s5 = s4 * F.col("position_multiplier")
    s6 = F.col("total_points")
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"),
                 F.bround(v.cast("double"), 1).alias("value"), F.lit(text).alias("explanation"))
        for i, ((name, text), v) in enumerate(zip(K.DECISION_STEPS, [s1, s2, s3, s4, s5, s6]))])
    return df.select("id", F.explode(steps).alias("_s")).select(
        "id", "_s.step_no", "_s.step", "_s.value", "_s.explanation")


def local_contributions(features: DataFrame, ids=None, names=None) -> DataFrame:
    """Seven weighted features per player, centred on that player's own mean, ranked ascending.

    The ranking is a per-row ``array_sort`` (ties keep the feature order), so
    there is no window and no shuffle.
    """
    df = lookup_players(features, ids, names)
    raw = [(name, F.col(name) * F.lit(weight)) for name, weight in K.CONTRIBUTION_WEIGHTS]
    total = raw[0][1]
    for _, c in raw[1:]:
        total = total + c
    mean = total / F.lit(float(len(raw)))
    items = F.array(*[F.struct((c - mean).alias("contribution"), F.lit(i).alias("feature_ord"),
                               F.lit(name).alias("feature")) for i, (name, c) in enumerate(raw)])
    return (df.select("id", F.posexplode(F.array_sort(items)).alias("_pos", "_c"))
            .select("id", (F.col("_pos") + 1).alias("rank"), F.col("_c.feature").alias("feature"),
                    F.col("_c.contribution").alias("contribution"),
                    (F.col("_c.contribution") > 0).alias("is_positive")))
