"""Feature statistics: correlation matrix, histograms and box statistics.

Histograms and box statistics work on the feature table in long form
``(feature, x)``, obtained with a per-row ``explode`` (no shuffle), so one job
covers every feature and each aggregate is grouped by a key whose cardinality
is the number of features. The correlation matrix is one wide global aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.quantiles import exact_quantiles


def long_features(features: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature_ord, feature, x[, id])``: one row per (row, feature); keeps ``id`` as a tiebreak when present."""
    items = F.array(*[F.struct(F.lit(i).alias("feature_ord"), F.lit(c).alias("feature"),
                               F.col(c).cast("double").alias("x")) for i, c in enumerate(cols)])
    keep = ["id"] if "id" in features.columns else []
    return features.select(*keep, F.explode(items).alias("_f")).select(
        "_f.feature_ord", "_f.feature", "_f.x", *keep)


def feature_correlation(features: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every feature pair over complete rows, as long rows (x, y, corr).

    One scan and one global aggregate: ``covar_pop`` and ``var_pop`` keep a count, means and centred second moments, which
    partial aggregates merge by the differences of their means, so a column far from zero loses no digits and nothing needs to
    be known before. A constant column gives NULL (R: NA) instead of a division error: its second moment is exactly zero, as all its
    means are equal. The diagonal is 1 for non-constant columns.
    """
    cols = list(K.CORRELATION_FEATURES if cols is None else cols)
    k = len(cols)
    df = features.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(cols)]).dropna(how="any")
    one = df.selectExpr(*[f"covar_pop(_{i}, _{j}) AS _c_{i}_{j}" for i in range(k) for j in range(i + 1, k)],
                        *[f"var_pop(_{i}) AS _v_{i}" for i in range(k)])

    def corr(i: int, j: int) -> str:
        if i == j:
            return f"CASE WHEN _v_{i} > 0 THEN 1.0D END"
        return f"try_divide(_c_{min(i, j)}_{max(i, j)}, sqrt(_v_{i}) * sqrt(_v_{j}))"

    items = ", ".join(f"named_struct('feature_x', '{a}', 'feature_y', '{b}', 'corr', {corr(i, j)})"
                      for i, a in enumerate(cols) for j, b in enumerate(cols))
    return one.select(F.expr(f"explode(array({items}))").alias("_c")).select(
        "_c.feature_x", "_c.feature_y", "_c.corr")


def _title(feature: F.Column) -> F.Column:
    """Chart label: first letter upper-cased, underscores to spaces ("goals_per_90" -> "Goals per 90")."""
    spaced = F.regexp_replace(feature, "_", " ")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def feature_histogram(features: DataFrame, cols: list[str] | None = None, bins: int = K.HISTOGRAM_BINS) -> DataFrame:
    """Equal-width histogram of each feature over [min, max], ``bins`` bins, the max in the last bin.

    Bounds come from a per-feature aggregate (one row per feature, bounded by
    ``len(cols)``, so broadcasting it is safe); counts are a partial-aggregated
    group-by on (feature, bin); empty bins come from a feature x bin spine.
    """
    cols = list(K.CORRELATION_FEATURES if cols is None else cols)
    long = long_features(features, cols).filter(F.col("x").isNotNull())
    bounds = long.groupBy("feature_ord", "feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = F.col("hi") - F.col("lo")
    binned = long.join(F.broadcast(bounds), ["feature_ord", "feature"]).select(
        "feature_ord",
        F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) / span * F.lit(float(bins))),
                                 F.lit(bins - 1))).otherwise(F.lit(0)).cast("int").alias("bin"))
    counts = binned.groupBy("feature_ord", "bin").agg(F.count(F.lit(1)).alias("count"))
    spine = bounds.select("feature_ord", "feature", "lo", "hi",
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return (spine.join(counts, ["feature_ord", "bin"], "left")
            .select("feature", _title(F.col("feature")).alias("label"), "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def feature_box(features: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Box statistics per feature: quartiles (interpolated), fences at 1.5 IQR, whisker ends, outliers.

    Quartiles come from the distributed exact quantile (no feature's values
    are gathered in one task); ``approx=True`` uses the mergeable sketch.
    """
    cols = list(K.CORRELATION_FEATURES if cols is None else cols)
    long = long_features(features, cols).filter(F.col("x").isNotNull())
    if approx:
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        quart = long.groupBy("feature_ord", "feature").agg(
            F.percentile_approx("x", probs, 100_000).alias("_q"), F.count(F.lit(1)).alias("n"))
        quart = quart.select("feature_ord", "feature", "n", *[F.col("_q")[i].cast("double").alias(name)
                                                              for i, name in enumerate(("q1", "median", "q3"))])
    else:
        q = exact_quantiles(long, "x", [0.25, 0.5, 0.75], ["feature_ord", "feature"])
        quart = q.groupBy("feature_ord", "feature").agg(
            F.max("n").alias("n"),
            *[F.max(F.when(F.col("prob_idx") == i, F.col("quantile"))).alias(name)
              for i, name in enumerate(("q1", "median", "q3"))])
    iqr = F.col("q3") - F.col("q1")
    quart = quart.select("*", iqr.alias("iqr"),
                         (F.col("q1") - F.lit(K.BOX_WHISKER_IQR) * iqr).alias("lower_fence"),
                         (F.col("q3") + F.lit(K.BOX_WHISKER_IQR) * iqr).alias("upper_fence"))
    inside = (F.col("x") >= F.col("lower_fence")) & (F.col("x") <= F.col("upper_fence"))
    tails = (long.join(F.broadcast(quart.select("feature_ord", "lower_fence", "upper_fence")), "feature_ord")
             .groupBy("feature_ord").agg(F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
                                         F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
                                         F.count_if(~inside).alias("n_outliers")))
    return quart.join(tails, "feature_ord").select(
        "feature", "n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
        "whisker_low", "whisker_high", "n_outliers")
