"""Every named query against its DuckDB oracle SQL on the sf0.001 tables."""

import pytest

from oracle_harness import compare, duck
from pitchside.plans.catalog import queries
from pitchside.plans.oracle import oracle_sql

SF = "/root/testdata/sf0.001"
QUERIES = queries()
SQL = oracle_sql()


def test_every_query_has_an_oracle_or_is_model_training():
    assert set(QUERIES) - set(SQL) == {"classifier_metrics", "feature_importance", "trained_scores"}
    assert set(SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, SF, QUERIES[name], SQL[name])
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["values_match"], r


MODELS = {"SVM", "Random Forest", "XGBoost"}


def test_model_training_runs(spark):
    metrics = QUERIES["classifier_metrics"](spark, SF).collect()
    assert {m.model for m in metrics} == MODELS
    assert all(0.0 <= m.value <= 1.0 for m in metrics)


def test_models_fitted_after_an_observation_score(spark, scratch_dir):
    """An observation makes the session unfit for tasks; a model that carried it there would fail."""
    import os
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    from pitchside.operators import classify
    seen = Observation("before")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count()
    features = QUERIES["features"](spark, SF)
    got = classify.train_classifiers(features, root=os.path.join(scratch_dir, "fresh-models"))
    assert got["predictions"].count() == 3 * features.count()


def test_models_are_fitted_once_and_score_every_player(spark, monkeypatch):
    from pyspark.ml.base import Estimator
    QUERIES["classifier_metrics"](spark, SF).count()
    monkeypatch.setattr(Estimator, "fit", lambda *a: pytest.fail("a second query fits again"))
    scores = QUERIES["trained_scores"](spark, SF)
    players = QUERIES["features"](spark, SF).count()
    assert {r.model: r["count"] for r in scores.groupBy("model").count().collect()} == dict.fromkeys(MODELS, players)
    assert 0 < scores.filter("is_test").count() < scores.count()


def test_feature_importance_runs(spark):
    imp = QUERIES["feature_importance"](spark, SF).collect()
    assert {r.model for r in imp} == MODELS and len(imp) == 30
    for model in MODELS:
        own = sorted((r for r in imp if r.model == model), key=lambda r: r.chart_order)
        assert [r.chart_order for r in own] == list(range(1, 11))
        assert [r.importance for r in own] == sorted(r.importance for r in own) and own[-1].importance > 0
