"""Operators on the hand-made league; expected values computed by hand from the formulas."""

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_by_id
from pitchside.operators import (aggregates, cards, classify, explain, features, filters, fixtures, players,
                                 predict, rankings)


def r(x, k):
    """R's round on the printed value: half-to-even on the shortest decimal text."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1).scaleb(-k), rounding=ROUND_HALF_EVEN))


@pytest.fixture(scope="module")
def active(league):
    p = players.build_players(league["players_raw"], league["teams"], league["positions"])
    return players.active_players(p).cache()


@pytest.fixture(scope="module")
def feats(active):
    return features.build_features(active).cache()


@pytest.fixture(scope="module")
def upcoming(league):
    return fixtures.upcoming_fixtures(league["fixtures"], league["teams"])


def test_dashboard_filter(active):
    assert {x.id for x in filters.dashboard_filter(active, position="Midfielder").collect()} == {3, 11}
    assert {x.id for x in filters.dashboard_filter(active, team="Alpha", max_cost=5.5).collect()} == {1, 2}
    got = filters.dashboard_filter(active, position="All", team="All", max_cost=None, min_minutes=2000)
    assert {x.id for x in got.collect()} == {1, 2, 3, 4}


def test_points_vs_cost_tooltip(active):
    t = rows_by_id(filters.points_vs_cost(active))
    assert t[1]["tooltip"] == ("Player: Ann Able <br>Team: Alpha <br>Position: Goalkeeper <br>Cost: £ 4.5 "
                               "<br>Points: 120 <br>Value: 26.67")
    assert t[4]["tooltip"].endswith("<br>Cost: £ 10 <br>Points: 200 <br>Value: 20")


def test_top_value_ties_and_limit(active):
    got = rankings.top_value(active, n=3).collect()
    # value: 1 -> 26.67, 2 -> 27.27, 7 -> 37.5, 3 -> 22.5, 4 -> 20, 11 -> 18.57
    assert [x.id for x in got] == [7, 2, 1]
    assert got[0].cost == "£ 4.0"


def test_elite_squad_quotas_and_union(active):
    squad = rankings.elite_squad(active, {"Goalkeeper": 1, "Defender": 1, "Midfielder": 1, "Forward": 1})
    # Goalkeepers 1 (120) and 7 (150): 7 wins; midfielders 3 (180), 11 (130): 3 wins.
    assert [x.id for x in squad.collect()] == [7, 2, 3, 4]
    full = {x.id for x in rankings.elite_squad(active).collect()}
    union = {x.id for x in rankings.elite_squad_union(active).collect()}
    assert full == union == {1, 2, 3, 4, 7, 11}


def test_team_outputs(active):
    teams = {x.TEAMS: x.total_points for x in rankings.top_teams(active, n=10).collect()}
    assert teams == {"Alpha": 400.0, "Bravo": 180.0, "Charlie": 200.0, "Unknown": 150.0}
    squad = [x.id for x in rankings.team_squad(active, team="Alpha").collect()]
    assert squad == [2, 1, 11]   # Defender, Goalkeeper, Midfielder (alphabetical), then points
    dist = {x.position: x["count"] for x in aggregates.position_distribution(active).collect()}
    assert dist == {"Goalkeeper": 2, "Defender": 1, "Midfielder": 2, "Forward": 1}
    dom = aggregates.filter_domains(active).first()
    assert (dom.cost_min, dom.cost_max, dom.minutes_max) == (4, 10, 2700.0)


def test_features_by_hand(active, feats):
    f = rows_by_id(feats)
    assert set(f) == {1, 2, 3, 4, 7, 11}
    pts = np.array([120, 150, 180, 200, 150, 130], dtype=float)
    q75 = np.percentile(pts, 75)                       # numpy's default is R type 7
    assert q75 == 172.5
    assert {i for i, row in f.items() if row["is_high_performer"] == "High"} == {3, 4}
    pooled = np.concatenate([[0, 3, 10, 20, 0, 6], [1, 4, 8, 5, 0, 7], [10, 12, 5, 0, 8, 3]]).astype(float)
    sd = pooled.std(ddof=1)
    assert f[1]["consistency_score"] == pytest.approx((120 / (2000 / 90)) / (sd + 1))
    assert f[1]["team_avg_points"] == pytest.approx((120 + 150 + 130) / 3)
    assert f[7]["team_avg_points"] == 150.0             # team 9 has only player 7
    assert f[4]["form_weight"] == 10.0                  # min(12 * 1.5, 10)
    assert f[1]["position_multiplier"] == 0.8 and f[4]["position_multiplier"] == 1.3
    assert f[7]["creativity_score"] == 0.0 and f[7]["threat_score"] == 0.0 and f[7]["popularity"] == 0.0
    assert f[3]["goals_per_90"] == pytest.approx(10 * 90 / 2600)
    assert f[4]["momentum"] == 108.0 and f[4]["efficiency"] == 20.0


def test_pooled_sd_null_empties_features(spark, active):
    with_null = active.withColumn("assists", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("assists")))
    assert features.build_features(with_null).count() == 0   # R: sd(...) is NA, complete.cases drops all


def test_upcoming_and_resolution(upcoming, active):
    up = rows_by_id(upcoming)
    assert set(up) == {103, 104, 105, 106}
    assert up[106]["home_team"] is None and up[106]["away_team"] == "Alpha"
    res = rows_by_id(fixtures.resolve_difficulty(active, upcoming))
    assert (res[1]["fixture_id"], res[1]["fixture_difficulty"]) == (103, 2)   # home
    assert (res[3]["fixture_id"], res[3]["fixture_difficulty"]) == (103, 4)   # away: 6 - 2
    assert (res[4]["fixture_id"], res[4]["fixture_difficulty"]) == (105, 1)   # team_h = team_a
    assert res[7]["fixture_id"] is None and res[7]["fixture_difficulty"] == 3  # no fixture: manual
    wk3 = rows_by_id(fixtures.resolve_difficulty(active, upcoming, gameweek=3))
    assert (wk3[1]["fixture_id"], wk3[1]["fixture_difficulty"]) == (106, 3)   # away at 9: 6 - 3
    assert wk3[3]["fixture_id"] is None and wk3[3]["fixture_difficulty"] == 3
    none = rows_by_id(fixtures.resolve_difficulty(active, upcoming, gameweek=0))
    assert all(v["fixture_difficulty"] == 3 for v in none.values())


def test_disjunctive_join_equivalence(upcoming, active):
    """Exploded legs + first-per-team equals the literal OR join + first by fixture id."""
    legs = rows_by_id(fixtures.resolve_difficulty(active, upcoming))
    u = upcoming.filter(F.col("gameweek") == 2)
    cand = active.join(u, (u.team_h == active.team) | (u.team_a == active.team)).select(
        active.id, u.id.alias("fid"),
        F.when(u.team_h == active.team, u.difficulty).otherwise(6 - u.difficulty).alias("eff"))
    first = {x.id: (x.fid, x.eff) for x in cand.groupBy("id").agg(F.min(F.struct("fid", "eff")).alias("m"))
             .select("id", "m.fid", "m.eff").collect()}
    for pid, (fid, eff) in first.items():
        assert (legs[pid]["fixture_id"], legs[pid]["fixture_difficulty"]) == (fid, eff)


def test_empty_fixtures(spark, active, league):
    empty = fixtures.empty_upcoming(spark)
    got = rows_by_id(predict.predict(active, empty))
    assert all(v["fixture_difficulty"] == 3 for v in got.values())
    assert fixtures.upcoming_fixtures(league["fixtures"].limit(0), league["teams"]).count() == 0


def test_predictions_and_clipping(active, upcoming):
    p = rows_by_id(predict.predict(active, upcoming))
    x1 = (5.0 * 0.6 + 4.0 * 0.4) * 1.10 * 0.85           # GK, home difficulty 2
    assert p[1]["predicted_points"] == r(x1, 1)
    assert (p[1]["predicted_low"], p[1]["predicted_high"]) == (r(x1 - 0.3, 1), r(x1 + 0.3, 1))
    assert (p[4]["predicted_points"], p[4]["predicted_low"], p[4]["predicted_high"]) == (12.0, 11.7, 12.0)
    assert (p[7]["predicted_points"], p[7]["predicted_low"], p[7]["predicted_high"]) == (1.0, 1.0, 1.3)
    manual = rows_by_id(predict.predict(active, None, manual=5))
    assert manual[3]["predicted_points"] == r((8.0 * 0.6 + 6.5 * 0.4) * 0.70 * 1.00, 1)


def test_prediction_card_text(active, upcoming):
    card = predict.prediction_card(predict.predict(active, upcoming)).filter(F.col("id") == 3)
    got = {x.metric: x.value for x in card.collect()}
    assert len(got) == 13
    assert got["Current Form"] == "8/10.0"
    assert got["Points Per Game"] == "6.5"
    assert got["Minutes Played"] == "2,600"
    assert got["Value Rating"] == "22.5"
    assert got["Fixture Difficulty"] == "4/5 (Hard)"
    assert got["Predicted Points"] == "6.3 pts"
    assert got["Prediction Range"] == "6 - 6.6 pts"


def test_difficulty_sweep(active):
    sw = [x for x in predict.difficulty_sweep(active, current=2).collect() if x.id == 4]
    assert [(x.difficulty, x.label, x.is_current) for x in sorted(sw, key=lambda x: x.difficulty)] == [
        (1, "Very Easy", False), (2, "Easy", True), (3, "Average", False), (4, "Hard", False), (5, "Very Hard", False)]
    assert {x.difficulty: x.predicted_points for x in sw}[1] == 12.0


def test_radar_and_compare(active, spark):
    rad = {(x.id, x.metric): x.value for x in cards.radar(active, ids=[3]).collect()}
    assert rad[(3, "Goals")] == pytest.approx(50.0)        # 10 / max 20
    assert rad[(3, "Form")] == pytest.approx(80.0)
    v1 = cards.radar(active, ids=[4], variant="v1").collect()
    assert {x.metric: x.value for x in v1}["Minutes"] == pytest.approx(100.0)
    assert v1[0].axis_max == pytest.approx(200 * 1.1)
    pairs = spark.createDataFrame([(3, 4), (1, 7)], "player1_id long, player2_id long")
    cmp = {(x.player1_id, x.stat): (x.player1, x.player2) for x in cards.compare(active, pairs).collect()}
    assert cmp[(3, "Minutes/100")] == (26.0, 27.0)
    assert cmp[(1, "Clean Sheets")] == (10.0, 8.0)
    zero = active.withColumn("goals_scored", F.lit(0.0))
    assert {x.metric: x.value for x in cards.radar(zero, ids=[3]).collect()}["Goals"] is None


def test_decision_path_and_contributions(feats):
    f = rows_by_id(feats)
    base = np.mean([120, 150, 180, 200, 150, 130])
    path = [x for x in explain.decision_path(feats, ids=[3]).collect()]
    assert [x.step_no for x in path] == [1, 2, 3, 4, 5, 6]
    v = f[3]
    s4 = base + v["momentum"] * 2 + v["efficiency"] * 1.5 + v["form_weight"] * 0.8
    assert [x.value for x in path] == [r(base, 1), r(base + v["momentum"] * 2, 1),
                                       r(base + v["momentum"] * 2 + v["efficiency"] * 1.5, 1), r(s4, 1),
                                       r(s4 * v["position_multiplier"], 1), 180.0]
    lc = explain.local_contributions(feats, ids=[3]).collect()
    assert [x.rank for x in lc] == list(range(1, 8))
    contribs = [x.contribution for x in lc]
    assert contribs == sorted(contribs) and sum(contribs) == pytest.approx(0.0, abs=1e-9)


def test_classify_rules(feats):
    got = classify.classify_rules(feats, ids=[4, 7]).collect()
    assert len(got) == 6
    by = {(x.id, x.model): x for x in got}
    assert by[(4, "SVM")].score == 0.9 and by[(4, "SVM")].confidence == "High"
    assert by[(4, "XGBoost")].confidence == "High"       # |0.9 - 0.5| = 0.4 > 0.35
    assert by[(4, "SVM")].prediction == "High" and by[(4, "SVM")].high_pct == 90.0
    s7 = by[(7, "SVM")].score
    assert by[(7, "Random Forest")].confidence == ("High" if abs(s7 - 0.5) > 0.25 else
                                                   "Medium" if abs(s7 - 0.5) > 0.1 else "Low")


def test_point_lookup(active):
    assert {r.id for r in filters.lookup_players(active, ids=[1, 4, 99]).collect()} == {1, 4}
    assert {r.id for r in filters.lookup_players(active, names=["Jo Jones"]).collect()} == {11}


def test_points_vs_cost_v1_tooltip(league):
    v1 = players.build_players(league["players_raw"], league["teams"], league["positions"], variant="v1")
    t = rows_by_id(filters.points_vs_cost(players.active_players(v1, 500, require_form=False), variant="v1"))
    assert t[1]["tooltip"] == "Ann Able <br>Team: Alpha <br>Cost: £ 4.5 <br>Points: 120"
    assert t[7]["colour_key"] is None and t[7]["tooltip"].startswith("Gus Gray <br>Team: NA")


def test_profile_and_gameweek_domain(league, active, upcoming):
    p = players.build_players(league["players_raw"], league["teams"], league["positions"])
    row = aggregates.profile(p, active, upcoming, league["teams"], league["positions"]).first()
    assert (row.players_rows, row.teams_rows, row.positions_rows, row.active_rows, row.fixtures_rows) == \
        (11, 3, 4, 6, 4)
    assert row.positions_seen == "Defender, Forward, Goalkeeper, Midfielder"
    assert row.gameweeks == "2, 3"
    gw = [(r.gameweek, r.is_default) for r in aggregates.gameweek_domain(upcoming).collect()]
    assert gw == [(2, True), (3, False)]


def test_team_mean_keeps_own_value_without_team(active):
    no_team = active.withColumn("team", F.when(F.col("id") == 1, F.lit(None)).otherwise(F.col("team")))
    f = rows_by_id(features.build_features(no_team))
    assert f[1]["team_avg_points"] == 120.0                      # R's ave(): NA group keeps its own value
    assert f[2]["team_avg_points"] == pytest.approx((150 + 130) / 2)


def test_null_propagation_helpers(spark):
    from pitchside.functions.exprs import clip, r_ifelse
    df = spark.createDataFrame([(None,), (0.5,), (20.0,)], "x double")
    got = df.select(clip("x", 1.0, 12.0).alias("c"),
                    r_ifelse(F.col("x") > 1, F.lit("hi"), F.lit("lo")).alias("i")).collect()
    assert [(r.c, r.i) for r in got] == [(None, None), (1.0, "lo"), (12.0, "hi")]


def test_fixture_without_difficulty_is_not_manual(active, upcoming):
    blank = upcoming.withColumn("difficulty", F.lit(None).cast("int"))
    got = rows_by_id(predict.predict(active, blank, manual=5))
    plays = [i for i, x in got.items() if x["fixture_id"] is not None]
    assert plays and all(got[i]["fixture_difficulty"] is None for i in plays)
    assert all(x["fixture_difficulty"] == 5 for i, x in got.items() if i not in plays)
    some = got[plays[0]]
    base = some["form_numeric"] * 0.6 + some["points_per_game_numeric"] * 0.4
    adj = {"Forward": 1.05, "Midfielder": 1.0, "Defender": 0.9, "Goalkeeper": 0.85}.get(some["position"], 1.0)
    assert some["predicted_points"] == pytest.approx(min(max(round(base * adj, 1), 1), 12), abs=0.051)   # multiplier 1.0
    card = {x.metric: x.value for x in predict.prediction_card(predict.predict(active, blank)).collect() if x.id == plays[0]}
    assert card["Fixture Difficulty"] == "NA/5 NA"


def test_compare_v1_keeps_players_without_position(league):
    from pitchside.plans.catalog import best_at_position_pairs
    v1 = players.active_players(players.build_players(league["players_raw"], league["teams"], league["positions"], variant="v1"),
                                500, require_form=False)
    pairs = best_at_position_pairs(v1)
    assert pairs.count() == v1.count()
    assert cards.compare(v1, pairs, variant="v1").count() == 5 * v1.count()


def test_evaluate_counts_the_high_class(spark):
    rows = [("m", 1.0, 1.0), ("m", 1.0, 0.0), ("m", 1.0, 0.0), ("m", 0.0, 1.0), ("m", 0.0, 0.0), ("none", 0.0, 0.0)]
    got = {(r.model, r.metric): r.value for r in classify.evaluate(spark.createDataFrame(rows, "model string, label double, prediction double")).collect()}
    assert got[("m", "accuracy")] == pytest.approx(2 / 5) and got[("m", "precision")] == pytest.approx(1 / 2)
    assert got[("m", "recall")] == pytest.approx(1 / 3) and got[("none", "recall")] is None


def test_split_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), *map(float, rng.random(len(classify.MODEL_FEATURES))), "High" if rng.random() < 0.4 else "Low") for i in range(300)]
    df = spark.createDataFrame(rows, ["id", *classify.MODEL_FEATURES, "is_high_performer"])
    ids = [sorted(r.id for r in classify.train_classifiers(x, max_iter=2, models=("SVM",))["predictions"].filter("is_test").select("id").collect())
           for x in (df.coalesce(1), df.repartition(7))]
    assert ids[0] == ids[1] and 50 < len(ids[0]) < 130


def test_permutation_importance_matches_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)).round(3)
    label = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(i, *map(float, x[i]), float(label[i])) for i in range(500)], "id long, a double, b double, c double, label double")
    said = lambda a, b: (a + 0.3 * b > 0).cast("double")  # noqa: E731  a fixed rule in place of a trained model

    def predict(df, keep):
        return df.select(*keep, F.lit("rule").alias("model"), "label", said(F.col("a"), F.col("b")).alias("prediction"))

    for per_bucket in (1_000, 40):
        dealt = classify.shuffled_rows(rows, ["a", "b", "c"], 2, 5, per_bucket).toPandas()
        assert len(dealt) == 500 * 3 * 2
        want = {}
        for (_, name), part in dealt.groupby(["repeat", "shuffled"]):
            part = part.sort_values("id")
            for i, c in enumerate("abc"):
                same = (part[c].to_numpy() == x[:, i]).mean()
                assert sorted(part[c]) == sorted(x[:, i]) and (same < 0.05 if c == name else same == 1)
            want.setdefault(name, []).append(((part.a + 0.3 * part.b > 0) == label).mean())
    got = {r.feature: r for r in classify.permutation_importance(rows, predict, ["a", "b", "c"], 2, 5).collect()}
    dealt = classify.shuffled_rows(rows, ["a", "b", "c"], 2, 5).toPandas()
    for name, part in dealt.groupby("shuffled"):
        truth = label[part.id.to_numpy()]
        assert got[name].accuracy == pytest.approx(((part.a + 0.3 * part.b > 0) == truth).mean())
        assert got[name].importance == pytest.approx(1.0 - got[name].accuracy)
    assert got["c"].importance == 0 and [got[c].chart_order for c in "cba"] == [1, 2, 3]
