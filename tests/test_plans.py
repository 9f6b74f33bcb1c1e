"""Physical-plan shape: the strategies the operators are written to get."""

import re

import pytest

from conftest import plan_text
from pitchside.plans.catalog import QUERIES, League

SF = "/root/testdata/sf0.001"
TRAINED = ("classifier_metrics", "feature_importance", "trained_scores")


@pytest.fixture(scope="module")
def league(spark):
    return League(spark, SF)


def test_elite_squad_uses_partial_group_limit(league):
    text = plan_text(QUERIES["elite_squad"](league))
    assert "WindowGroupLimit" in text


def test_top_k_is_take_ordered(league):
    assert "TakeOrderedAndProject" in plan_text(QUERIES["top_value"](league))


def test_fixture_match_is_an_equi_join(league):
    text = plan_text(QUERIES["predict"](league))
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_no_cross_joins_anywhere(league):
    """Table-wide values are scalar subqueries; every join is an equi-join."""
    for name, fn in QUERIES.items():
        if name in TRAINED:
            continue
        text = plan_text(fn(league))
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_unstaged_features_and_box_have_equi_joins_only(spark, threshold):
    """Also with broadcasting off, and without staging, so the whole plan is seen."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        lg = League(spark, SF, lazy=True)
        for name in ("features", "feature_box", "feature_scalars"):
            text = plan_text(QUERIES[name](lg))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_planning_starts_no_job_and_writes_nothing(spark):
    """Operators only build plans: no job runs until the result is read."""
    from pitchside.operators import features, predict, stats
    lg = League(spark, SF, lazy=True)
    active, upcoming = lg.active, lg.upcoming   # the readers look at the files' schemas
    sc = spark.sparkContext
    sc.setJobGroup("planning-only", "")
    try:
        table = features.build_features(active)
        stats.feature_box(table)
        predict.predict(active, upcoming)
        assert not sc.statusTracker().getJobIdsForGroup("planning-only")
    finally:
        sc.setJobGroup("after", "")


def test_closing_a_league_removes_its_tables(spark):
    import os
    from pitchside.session import checkpoint_dir
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "pitchside-stage")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    for _ in range(2):
        lg = League(spark, SF)
        QUERIES["predict"](lg).count()
        assert set(os.listdir(folder)) > before
        lg.close()
        assert set(os.listdir(folder)) == before


def test_one_branch_query_scans_its_columns_only(spark):
    text = plan_text(QUERIES["position_domain"](League(spark, SF, lazy=True)))
    customer = [m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "c_custkey" in m]
    assert customer and all("c_name" not in m for m in customer)


def test_hot_team_is_spread_without_broadcast_or_adaptive_skew(spark):
    """One team holds most players: its rows meet the team mean in many tasks."""
    from pyspark.sql import functions as F
    from pitchside.functions.joins import salted_lookup
    keys = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 10 < 9, F.lit(1)).otherwise(F.lit(2)).alias("team"))
        table = spark.createDataFrame([(1, 10.0), (2, 20.0)], "_t int, mean double")
        got = salted_lookup(rows, table, "team", "_t", "id")
        parts = [r["count"] for r in got.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert got.count() == 4000 and got.filter("mean = team * 10").count() == 4000
        assert len(parts) >= 6 and max(parts) < 2000
    finally:
        for k, v in keys.items():
            spark.conf.set(k, v)


def test_scans_are_pruned(spark):
    lg = League(spark, SF)
    text = plan_text(lg.players_raw)
    lineitem = [m for m in re.findall(r"ReadSchema: struct<([^>]*)>", text) if "l_orderkey" in m]
    assert lineitem and all(set(re.findall(r"(\w+):", m)) ==
                            {"l_orderkey", "l_quantity", "l_returnflag", "l_linestatus"} for m in lineitem)


def test_filters_reach_the_staged_scan(league):
    text = plan_text(QUERIES["active_players"](league))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(minutes,100", text)


def test_no_python_evaluation_anywhere(league):
    for name, fn in QUERIES.items():
        if name in TRAINED:
            continue
        text = plan_text(fn(league))
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text, name


def test_profile_reads_nothing_beyond_the_load(spark):
    """The profile is observed in the jobs that stage the tables: its own plan has no scan and starts no job over a table."""
    from pitchside.operators import aggregates
    lg = League(spark, SF)
    row = QUERIES["profile"](lg)
    assert "Scan parquet" not in plan_text(row)
    assert row.first() == aggregates.profile(lg.players, lg.active, lg.upcoming, lg.teams, lg.positions).first()
    lg.close()
