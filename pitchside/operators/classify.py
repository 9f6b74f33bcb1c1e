"""High/low performer classification.

``classify_rules`` is the dashboard's rule: a clipped weighted score, a label at
0.5 and per-model confidence tiers (the reference's random jitter is dropped).
``fit_classifiers`` replaces the hard-coded model scores with models actually
trained on the feature table with ``pyspark.ml`` and kept in the shared folder;
``permutation_importance`` replaces the typed-in importances.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.exprs import clip
from pitchside.operators.filters import lookup_players
from pitchside.session import checkpoint_dir
from pitchside.sources import files
from pitchside.sources.stage import Staging

# The ten features the importance chart names, in its order.
MODEL_FEATURES = ["form_weight", "points_per_90", "momentum", "efficiency", "goals_per_90",
                  "assists_per_90", "influence_score", "creativity_score", "team_avg_points", "threat_score"]


def score(df: DataFrame) -> F.Column:
    total = None
    for name, weight in K.CLASSIFY_WEIGHTS:
        term = F.col(name) * F.lit(weight)
        total = term if total is None else total + term
    return clip(total / F.lit(K.CLASSIFY_DIVISOR), K.CLASSIFY_MIN, K.CLASSIFY_MAX)


def classify_rules(features: DataFrame, ids=None, names=None) -> DataFrame:
    """Three rows per player (SVM, Random Forest, XGBoost): label, probabilities, confidence."""
    df = lookup_players(features, ids, names)
    df = df.select("id", score(df).alias("_score"))
    margin = F.abs(F.col("_score") - F.lit(K.CLASSIFY_THRESHOLD))
    rows = []
    for model, high, medium in K.CONFIDENCE_TIERS:
        conf = F.when(margin > F.lit(high), F.lit("High"))
        conf = conf.when(margin > F.lit(medium), F.lit("Medium")).otherwise(F.lit("Low")) if medium is not None \
            else conf.otherwise(F.lit("Medium"))
        rows.append(F.struct(F.lit(model).alias("model"), conf.alias("confidence")))
    return df.select("id", "_score", F.explode(F.array(*rows)).alias("_r")).select(
        "id", F.col("_r.model").alias("model"),
        F.when(F.col("_score") > F.lit(K.CLASSIFY_THRESHOLD), F.lit("High")).otherwise(F.lit("Low")).alias("prediction"),
        F.bround(F.col("_score") * F.lit(100.0), 1).alias("high_pct"),
        F.bround(F.lit(100.0) - F.col("_score") * F.lit(100.0), 1).alias("low_pct"),
        F.col("_r.confidence").alias("confidence"),
        F.col("_score").alias("score"))


def evaluate(predictions: DataFrame) -> DataFrame:
    """(model, metric, value): accuracy, and precision and recall of the class "High" (label 1).

    ``predictions``: (model, label, prediction) with labels 0 and 1. One confusion count per model in one aggregate. A ratio
    over nothing (no positive said, or none there) is NULL.
    """
    n = predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("ok"),
        F.count_if((F.col("label") == 1) & (F.col("prediction") == 1)).alias("tp"),
        F.count_if(F.col("prediction") == 1).alias("said"), F.count_if(F.col("label") == 1).alias("there"))
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in (
        ("accuracy", ratio("ok", "n")), ("precision", ratio("tp", "said")), ("recall", ratio("tp", "there")))])
    return n.select("model", F.explode(rows).alias("r")).select("model", "r.metric", "r.value")


def rule_predictions(features: DataFrame) -> DataFrame:
    """(id, model, label, prediction) of the rule: "High" as 1, against the table's own high performers."""
    truth = features.select("id", (F.col("is_high_performer") == "High").cast("double").alias("label"))
    said = classify_rules(features).select("id", "model", (F.col("prediction") == "High").cast("double").alias("prediction"))
    return said.join(truth, "id").select("id", "model", "label", "prediction")


MODELS = ("SVM", "Random Forest", "XGBoost")


def estimators(seed: int, max_iter: int = 10, num_trees: int = 20, models: Sequence[str] = MODELS) -> dict[str, Estimator]:
    """The three model families (or those named), by the names the dashboard gives them."""
    every = {
        "SVM": LinearSVC(maxIter=max_iter, regParam=0.01),
        "Random Forest": RandomForestClassifier(numTrees=num_trees, seed=seed),
        "XGBoost": GBTClassifier(maxIter=max_iter, seed=seed),
    }
    return {name: every[name] for name in models}


def model_rows(features: DataFrame, seed: int = 42, test_fraction: float = 0.3) -> DataFrame:
    """(id, the model features, label, is_test): the split depends on the id alone, not on how the rows are laid out."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    return features.select("id", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES],
                           (F.col("is_high_performer") == "High").cast("double").alias("label"), (place < test_fraction).alias("is_test"))


def fit_classifiers(features: DataFrame, seed: int = 42, root: str | None = None, test_fraction: float = 0.3, max_iter: int = 10,
                    num_trees: int = 20, models: Sequence[str] = MODELS) -> dict[str, PipelineModel]:
    """The three models trained to predict ``is_high_performer``, fitted once per feature table and kept under ``root``.

    ``root`` is by default a folder in the shared checkpoint folder. A table is known by a digest of the rows the models see, one
    aggregate; if the models of that digest and these parameters are there, they are loaded and nothing is fitted. They count as there once their
    manifest is, which is written last. Note the label is a threshold on total_points, and points_per_90/efficiency/team
    average derive from total_points, so the models' metrics are optimistic (leakage inherited from the feature definitions).
    """
    spark = features.sparkSession
    rows = model_rows(features, seed, test_fraction)
    wanted = estimators(seed, max_iter, num_trees, models)
    digest = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h")).first()
    root = root or os.path.join(checkpoint_dir(spark), "pitchside-models")
    path = f"{root}/{digest.n}-{digest.h}-{seed}-{max_iter}-{num_trees}-{'-'.join(n.replace(' ', '') for n in models)}"
    manifest = f"{path}/manifests/complete.json"
    if not files.exists(spark, manifest):
        _fit(rows, path, manifest, wanted)
    folder = json.loads(files.read_text(spark, manifest))["folder"]
    # Also just after a fit: a model read back carries no training summary, which would drag the session into every task.
    return {name: PipelineModel.load(f"{path}/{folder}/{name}") for name in wanted}


def _fit(rows: DataFrame, path: str, manifest: str, wanted: dict[str, Estimator]) -> None:
    """Fit the models on the training part of ``rows``, write them in a new folder below ``path``, then ``manifest`` that names it."""
    spark, staging, folder = rows.sparkSession, Staging(), uuid.uuid4().hex
    try:
        assembler = VectorAssembler(inputCols=MODEL_FEATURES, outputCol="features")
        train = staging.stage(assembler.transform(rows.filter(~F.col("is_test"))).select("features", "label"), "training-vectors")
        fitted = {name: PipelineModel(stages=[assembler, estimator.fit(train)]) for name, estimator in wanted.items()}
    finally:
        staging.close()
    for name, model in fitted.items():
        model.write().save(f"{path}/{folder}/{name}")
    try:
        files.write_new(spark, manifest, json.dumps({"folder": folder}))
    except FileExistsError:   # another query fitted the same models meanwhile; they are equal
        files.remove(spark, f"{path}/{folder}")


def trained_predictions(rows: DataFrame, models: dict[str, PipelineModel], keep: Sequence[str] = ("id", "is_test")) -> DataFrame:
    """(*keep, model, label, prediction, score): every row of ``model_rows`` by every model.

    ``score``: the probability of "High", or for the SVM the distance from its plane.
    """
    out = None
    for name, model in models.items():
        said = model.transform(rows)
        value = vector_to_array("probability" if "probability" in said.columns else "rawPrediction")[1]
        said = said.select(*keep, F.lit(name).alias("model"), "label", "prediction", value.alias("score"))
        out = said if out is None else out.unionByName(said)
    return out


def shuffled_rows(rows: DataFrame, columns: Sequence[str], repeats: int, seed: int, rows_per_bucket: int = 1_000) -> DataFrame:
    """``rows`` once for each repeat and column (``repeat``, ``shuffled``), with the values of that column dealt anew among them.

    A keyed shuffle: a hash of (repeat, column, id) deals the rows into buckets of about ``rows_per_bucket`` and puts each bucket in
    a random order; every row takes the value of its successor, the last that of the first. So every value is used once, and no
    task holds more than some buckets. The order is fixed by ``seed`` and the ids.
    """
    buckets = max(1, rows.count() // rows_per_bucket)
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("repeat"), F.lit(c).alias("shuffled")) for r in range(repeats) for c in columns])).alias("_e")
    h = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), "repeat", "shuffled", "id")
    long = rows.select("*", each).select(*rows.columns, "_e.*").withColumn("_bucket", F.pmod(h("bucket"), F.lit(buckets)))
    own = F.coalesce(*[F.when(F.col("shuffled") == c, F.col(c)) for c in columns])
    line = Window.partitionBy("repeat", "shuffled", "_bucket").orderBy(h("order"), "id")
    long = long.withColumn("_own", own).withColumn("_new", F.coalesce(F.lead("_own").over(line), F.first("_own").over(line)))
    return long.select(*[F.when(F.col("shuffled") == c, F.col("_new")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns],
                       "repeat", "shuffled")


def permutation_importance(rows: DataFrame, predict: Callable[[DataFrame, Sequence[str]], DataFrame], columns: Sequence[str] = tuple(MODEL_FEATURES),
                           repeats: int = 3, seed: int = 42) -> DataFrame:
    """(model, feature, accuracy, importance, chart_order): how much accuracy each model loses when a column is shuffled.

    ``predict(rows, keep)`` gives (*keep, model, label, prediction). ``accuracy`` is that of the shuffled rows, over all ``repeats``;
    ``importance`` the loss; ``chart_order`` ascends with it within a model, ties in the order of the feature's name. One pass scores all
    columns; the shuffled rows are as many as rows x columns x repeats.
    """
    right = (F.col("label") == F.col("prediction")).cast("double")
    whole = predict(rows, ()).groupBy("model").agg(F.avg(right).alias("_whole"))
    dealt = predict(shuffled_rows(rows, columns, repeats, seed), ("shuffled",))
    each = dealt.groupBy("model", F.col("shuffled").alias("feature")).agg(F.avg(right).alias("accuracy"))
    each = each.join(whole, "model").withColumn("importance", F.col("_whole") - F.col("accuracy"))
    order = Window.partitionBy("model").orderBy("importance", "feature")   # one row per feature
    return each.select("model", "feature", "accuracy", "importance", F.row_number().over(order).alias("chart_order"))


def train_classifiers(features: DataFrame, seed: int = 42, test_fraction: float = 0.3, max_iter: int = 10, num_trees: int = 20,
                      models: Sequence[str] = MODELS, root: str | None = None) -> dict[str, DataFrame]:
    """``predictions`` of every player by the trained models, ``metrics`` (accuracy, precision, recall) and ``importances`` on the test part."""
    fitted = fit_classifiers(features, seed, root, test_fraction, max_iter, num_trees, models)
    rows = model_rows(features, seed, test_fraction)
    predictions = trained_predictions(rows, fitted)
    test = rows.filter("is_test")
    return {"predictions": predictions, "metrics": evaluate(predictions.filter("is_test")),
            "importances": permutation_importance(test, lambda df, keep: trained_predictions(df, fitted, keep), seed=seed)}
