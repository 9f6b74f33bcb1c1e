"""Shared fixtures: a local session and a hand-made 12-player league."""

from __future__ import annotations

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from pitchside.sources import schemas  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="pitchside-tests-")
    session = (SparkSession.builder.master("local[4]").appName("pitchside-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def scratch_dir():
    return tempfile.mkdtemp(prefix="pitchside-scratch-")


# id, first, second, team, element_type, now_cost, total_points, minutes, goals, assists, clean_sheets,
# form, points_per_game, influence, creativity, threat, ict_index, selected_by_percent
PLAYERS = [
    (1, "Ann", "Able", 1, 1, 45, 120, 2000, 0, 1, 10, "5.0", "4.0", "300.0", "50.0", "10.0", "36.0", "12.5"),
    (2, "Bob", "Best", 1, 2, 55, 150, 2500, 3, 4, 12, "6.5", "5.0", "400.0", "150.0", "120.0", "45.0", "30.0"),
    (3, "Cat", "Cole", 2, 3, 80, 180, 2600, 10, 8, 5, "8.0", "6.5", "700.0", "800.0", "600.0", "90.0", "41.0"),
    (4, "Dan", "Dee", 3, 4, 100, 200, 2700, 20, 5, 0, "12.0", "9.0", "900.0", "300.0", "1200.0", "120.0", "55.5"),
    (5, "Eve", "Ely", 3, 3, 0, 60, 101, 1, 0, 0, "NaN", "2.0", "10.0", "5.0", "2.0", "1.0", "0.5"),
    (6, "Fay", "Fox", 3, 2, -5, 40, 100, 0, 1, 2, "3.0", "2.5", "20.0", "10.0", "5.0", "2.0", "1.0"),
    (7, "Gus", "Gray", 9, 1, 40, 150, 1500, 0, 0, 8, "0.5", "1.0", "100.0", None, "bad", "20.0", None),
    (8, "Hal", "Hope", 1, 7, 60, 90, 900, 2, 2, 1, "abc", "3.0", "80.0", "60.0", "40.0", "9.0", "3.0"),
    (9, "Ivy", "Ives", 2, 3, 65, 110, 1200, 4, 3, 2, "1.5d", "3.5", "90.0", "70.0", "50.0", "10.0", "4.0"),
    (10, "Jo", "Jones", 3, 4, 75, 130, 1800, 9, 2, 0, None, "4.5", "200.0", "90.0", "300.0", "30.0", "7.0"),
    (11, "Jo", "Jones", 1, 3, 70, 130, 1700, 6, 7, 3, "7.0", "5.5", "500.0", "400.0", "200.0", "60.0", "20.0"),
    (12, "Kim", None, 2, 2, None, 0, 0, 0, 0, 0, "1.0", "1.0", "0.0", "0.0", "0.0", "0.0", "0.0"),
]

TEAMS = [(1, "Alpha"), (2, "Bravo"), (3, "Charlie")]
POSITIONS = [(1, "Goalkeeper"), (2, "Defender"), (3, "Midfielder"), (4, "Forward")]

# id, event, finished, team_h, team_a, team_h_difficulty
FIXTURES = [
    (100, 1, True, 1, 2, 3),      # finished
    (101, None, False, 1, 3, 2),  # no gameweek
    (102, 0, False, 2, 3, 4),     # gameweek 0
    (103, 2, False, 1, 2, 2),     # gw 2: team 1 home (2), team 2 away (6 - 2 = 4)
    (104, 2, False, 2, 1, 5),     # double gameweek for teams 1 and 2: ignored (103 comes first)
    (105, 2, False, 3, 3, 1),     # team_h = team_a: the home rule wins (1)
    (106, 3, False, 9, 1, 3),     # team 9 has no team row
]


@pytest.fixture(scope="session")
def league(spark):
    players_raw = spark.createDataFrame(PLAYERS, schema=schemas.PLAYERS_RAW)
    teams = spark.createDataFrame(TEAMS, schema=schemas.TEAMS)
    positions = spark.createDataFrame(POSITIONS, schema=schemas.POSITIONS)
    fixtures = spark.createDataFrame(FIXTURES, schema=schemas.FIXTURES_RAW)
    return {"players_raw": players_raw, "teams": teams, "positions": positions, "fixtures": fixtures}


def rows_by_id(df, key="id"):
    return {r[key]: r.asDict() for r in df.collect()}


def plan_text(df) -> str:
    """The formatted physical plan, through the public ``explain``."""
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()
