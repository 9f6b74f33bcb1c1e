"""Player table: dimension defaults, cost text, value rule, numeric coercion, filters."""

from pyspark.sql import functions as F

from conftest import plan_text, rows_by_id
from pitchside.functions.exprs import num_text, parse_number
from pitchside.operators.players import active_players, build_players


def test_v2_defaults_cost_and_value(league):
    p = rows_by_id(build_players(league["players_raw"], league["teams"], league["positions"]))
    assert set(p) == set(range(1, 12))  # id 12 has no cost: dropped
    assert p[7]["TEAMS"] == "Unknown" and p[8]["position"] == "Unknown"
    assert p[1]["TEAMS"] == "Alpha" and p[4]["position"] == "Forward"
    # Widest formatted cost is "10.0" (4 chars): every cost is padded to it.
    assert p[1]["cost_pretty"] == "£ 4.5"
    assert p[4]["cost_pretty"] == "£10.0"
    assert p[6]["cost_pretty"] == "£-0.5"
    assert p[5]["cost_pretty"] == "£ 0.0"
    assert p[1]["value"] == 26.67           # 120 / 4.5 = 26.666..
    assert p[4]["value"] == 20.0
    assert p[5]["value"] == 0.0 and p[6]["value"] == 0.0  # cost 0 and negative
    assert p[1]["full_name"] == "Ann Able"


def test_v2_numeric_text_parsing(league):
    p = rows_by_id(build_players(league["players_raw"], league["teams"], league["positions"]))
    assert p[5]["form_numeric"] is None      # "NaN" is missing in R
    assert p[8]["form_numeric"] is None      # "abc"
    assert p[9]["form_numeric"] is None      # "1.5d": Spark's cast would accept it, R does not
    assert p[10]["form_numeric"] is None     # NULL
    assert p[3]["form_numeric"] == 8.0
    assert p[7]["threat_numeric"] is None and p[7]["creativity_numeric"] is None
    assert p[7]["selected_by_percent"] is None
    assert p[2]["selected_by_percent"] == 30.0


def test_v1_variant(league):
    p = rows_by_id(build_players(league["players_raw"], league["teams"], league["positions"], variant="v1"))
    assert len(p) == 12                      # no NULL filter
    assert p[7]["TEAMS"] is None and p[8]["position"] is None
    assert p[5]["value"] is None and p[6]["value"] is None   # cost <= 0 gives NA in v1
    assert p[12]["full_name"] == "Kim NA"    # R pastes the text NA
    assert p[12]["cost_pretty"] == "£  NA"   # NA right-justified to the column width


def test_active_thresholds(league):
    players = build_players(league["players_raw"], league["teams"], league["positions"])
    active = {r["id"] for r in active_players(players).collect()}
    assert active == {1, 2, 3, 4, 7, 11}     # 6 has 100 minutes (not > 100); 5, 8, 9, 10 lack form
    v1 = build_players(league["players_raw"], league["teams"], league["positions"], variant="v1")
    active_v1 = {r["id"] for r in active_players(v1, 500, require_form=False).collect()}
    assert active_v1 == {1, 2, 3, 4, 7, 8, 9, 10, 11}


def test_parse_and_print_helpers(spark):
    df = spark.createDataFrame([(" 1.5 ",), ("1e3",), ("-.5",), ("NA",), ("",), ("Inf",), ("0x1A",)], "s string")
    got = [r[0] for r in df.select(parse_number("s")).collect()]
    assert got == [1.5, 1000.0, -0.5, None, None, None, None]
    nums = spark.createDataFrame([(4.25,), (12.5,), (45.0,), (-0.04,), (None,), (7.949999999999999,)], "x double")
    assert [r[0] for r in nums.select(num_text("x", 1)).collect()] == ["4.2", "12.5", "45", "0", None, "7.9"]
    assert [r[0] for r in nums.select(num_text("x", 0)).collect()][:3] == ["4", "12", "45"]


def test_no_python_udfs_in_player_plan(league):
    plan = build_players(league["players_raw"], league["teams"], league["positions"])
    text = plan_text(plan)
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text
    assert plan.filter(F.col("id") == 1).count() == 1
