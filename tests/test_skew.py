"""A skewed league: one team holds a third of the players, one points value a third of the rows.

Results must equal pandas brute force, and the plans must pre-aggregate on the
hot keys instead of shipping their rows to one task.
"""

import numpy as np
import pandas as pd
import pytest

from conftest import plan_text
from pitchside.operators import features, fixtures, players, predict, rankings
from pitchside.sources import schemas

N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(11)
    team = np.where(rng.random(N) < 1 / 3, 1, rng.integers(2, 21, N))
    pts = np.where(rng.random(N) < 1 / 3, 100, rng.integers(20, 250, N))
    rows = []
    for i in range(N):
        rows.append((i, f"F{i}", f"S{i}", int(team[i]), int(rng.integers(1, 5)), int(rng.integers(40, 130)),
                     int(pts[i]), int(rng.integers(200, 3400)), int(rng.integers(0, 20)), int(rng.integers(0, 15)),
                     int(rng.integers(0, 18)), f"{rng.integers(0, 100) / 10:.1f}", f"{rng.integers(10, 80) / 10:.1f}",
                     "100.0", "50.0", "20.0", "10.0", "5.0"))
    raw = spark.createDataFrame(rows, schema=schemas.PLAYERS_RAW)
    teams = spark.createDataFrame([(t, f"T{t}") for t in range(1, 21)], schema=schemas.TEAMS)
    pos = spark.createDataFrame([(1, "Goalkeeper"), (2, "Defender"), (3, "Midfielder"), (4, "Forward")],
                                schema=schemas.POSITIONS)
    # 2000 fixtures in gameweek 1, team 1 in every one of them (a hot team for the resolver).
    fx = spark.createDataFrame([(10_000 + j, 1, False, 1 if j % 2 else int(2 + j % 19), 1 if j % 2 == 0 else
                                 int(2 + j % 19), int(1 + j % 5)) for j in range(2000)], schema=schemas.FIXTURES_RAW)
    active = players.active_players(players.build_players(raw, teams, pos)).cache()
    pdf = pd.DataFrame(rows, columns=[f.name for f in schemas.PLAYERS_RAW.fields])
    return active, pdf, fx, teams


def test_team_means_and_threshold_under_skew(skewed):
    active, pdf, _, _ = skewed
    f = features.build_features(active).toPandas().set_index("id")
    want = pdf.groupby("team")["total_points"].mean()
    got = f["team_avg_points"]
    assert np.allclose(got.to_numpy(), pdf.set_index("id").loc[got.index, "team"].map(want).to_numpy())
    q75 = np.percentile(pdf["total_points"].astype(float), 75)
    assert set(f.index[f["is_high_performer"] == "High"]) == set(pdf.id[pdf.total_points > q75])


def test_team_means_pre_aggregate(skewed):
    active = skewed[0]
    text = plan_text(features.team_means(active))
    assert "partial_avg" in text


def test_elite_squad_under_skew(skewed):
    active, pdf, _, _ = skewed
    got = [r.id for r in rankings.elite_squad(active).collect()]
    pos = {1: "Goalkeeper", 2: "Defender", 3: "Midfielder", 4: "Forward"}
    quotas = {"Goalkeeper": 2, "Defender": 5, "Midfielder": 5, "Forward": 3}
    pdf = pdf.assign(position=pdf.element_type.map(pos)).sort_values(["total_points", "id"],
                                                                     ascending=[False, True])
    want = [i for p, k in quotas.items() for i in pdf[pdf.position == p].id.head(k)]
    assert got == want


def test_hot_team_fixture_resolution(skewed):
    active, pdf, fx, teams = skewed
    up = fixtures.upcoming_fixtures(fx, teams)
    res = {r.id: (r.fixture_id, r.fixture_difficulty) for r in predict.predict(active, up).collect()}
    t1 = pdf.id[pdf.team == 1].iloc[0]
    assert res[t1] == (10_000, 6 - 1)     # fixture 10000: team 1 away (j even), home difficulty 1
    text = plan_text(fixtures.first_fixture_per_team_week(up))
    assert "partial_min" in text
