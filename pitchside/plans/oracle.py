"""DuckDB oracle SQL for every named query (independent formulations, not generated from the plans).

The driver registers the test tables as views; each query rebuilds the league
tables with CTEs and computes the operator directly in SQL. Double columns
are rounded to 6 places half-to-even on both sides (see ``plans.catalog``), so
last-bit differences between the engines' summation orders do not count.

FIXED VALUES: multipliers, weights, labels, quotas and thresholds below restate those of
``functions/constants.py`` on purpose, so that the SQL does not depend on the plans.
"""

from __future__ import annotations

CHECK_DIGITS = 6

# R's as.numeric over text: anchored numeric pattern, then a cast.
_NUM_RE = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*"


def _br(x: str, k: int) -> str:
    """Half-to-even rounding of the double's shortest decimal text (Spark ``bround``, R ``round``).

    DuckDB's ``round_even`` nudges values within ~1e-15 of a tie (7.949999999999999 -> 8.0);
    this rounds the exact decimal instead.
    """
    d = f"TRY_CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 17))"
    sc = f"({d} * {10 ** k})"
    fl = f"floor({sc})"
    return (f"(CAST((CASE WHEN {sc} - {fl} > 0.5 THEN {fl} + 1 WHEN {sc} - {fl} < 0.5 THEN {fl} "
            f"WHEN {fl} % 2 = 0 THEN {fl} ELSE {fl} + 1 END) AS DOUBLE) / {10 ** k})")


def _num(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({c}, '{_NUM_RE}') THEN TRY_CAST(trim({c}) AS DOUBLE) END)"


def _txt(c: str, k: int) -> str:
    """Number printed like R after round(x, k)."""
    if k == 0:
        return f"(CASE WHEN {c} IS NOT NULL THEN printf('%.0f', {_br(c, 0)} + 0.0) END)"
    return (f"(CASE WHEN {c} IS NOT NULL THEN "
            f"regexp_replace(printf('%.{k}f', {_br(c, k)} + 0.0), '\\.?0+$', '') END)")


BASE = f"""
L AS (
  SELECT o.o_custkey AS custkey,
         COUNT(*) AS total_points,
         SUM(l.l_quantity) AS minutes_d,
         COUNT(*) FILTER (WHERE l.l_linestatus = 'F' AND l.l_returnflag = 'R') AS goals_scored,
         COUNT(*) FILTER (WHERE l.l_linestatus = 'F' AND l.l_returnflag = 'A') AS assists,
         COUNT(*) FILTER (WHERE l.l_linestatus = 'F' AND l.l_returnflag = 'N') AS clean_sheets,
         COUNT(DISTINCT o.o_orderkey) AS n_orders,
         SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity END) AS q_r,
         SUM(CASE WHEN l.l_returnflag = 'A' THEN l.l_quantity END) AS q_a,
         SUM(CASE WHEN l.l_returnflag = 'N' THEN l.l_quantity END) AS q_n
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey
  GROUP BY o.o_custkey
),
players_raw AS (
  SELECT c.c_custkey AS id,
         split_part(c.c_name, '#', 1) AS first_name,
         split_part(c.c_name, '#', 2) AS second_name,
         CAST(c.c_nationkey AS INTEGER) AS team,
         CAST(CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3
                                  WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS INTEGER) AS element_type,
         CAST(floor(c.c_acctbal / CAST(50 AS DOUBLE)) AS INTEGER) AS now_cost,
         CAST(L.total_points AS BIGINT) AS total_points,
         CAST(L.minutes_d AS BIGINT) AS minutes,
         CAST(L.goals_scored AS BIGINT) AS goals_scored,
         CAST(L.assists AS BIGINT) AS assists,
         CAST(L.clean_sheets AS BIGINT) AS clean_sheets,
         CASE WHEN c.c_custkey % 97 = 0 THEN 'n/a'
              ELSE CAST(CAST((c.c_custkey * 7) % 101 AS DOUBLE) / CAST(10 AS DOUBLE) AS VARCHAR) END AS form,
         CASE WHEN c.c_custkey % 89 = 0 THEN NULL
              ELSE CAST(CAST(L.total_points AS DOUBLE) / L.n_orders AS VARCHAR) END AS points_per_game,
         CAST(L.q_r AS VARCHAR) AS influence,
         CAST(L.q_a AS VARCHAR) AS creativity,
         CAST(L.q_n AS VARCHAR) AS threat,
         CAST(L.minutes_d / CAST(10 AS DOUBLE) AS VARCHAR) AS ict_index,
         CAST(CAST(100 AS DOUBLE) * L.n_orders / (SELECT COUNT(*) FROM orders) AS VARCHAR) AS selected_by_percent
  FROM customer c LEFT JOIN L ON c.c_custkey = L.custkey
),
teams AS (SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS name FROM nation),
positions AS (SELECT * FROM (VALUES (1, 'Goalkeeper'), (2, 'Defender'), (3, 'Midfielder'), (4, 'Forward'))
              AS v(id, singular_name)),
pj AS (
  SELECT r.*, t.name AS team_name, ps.singular_name AS pos_name,
         CAST(r.now_cost AS DOUBLE) / CAST(10 AS DOUBLE) AS cost_million
  FROM players_raw r LEFT JOIN teams t ON r.team = t.id LEFT JOIN positions ps ON r.element_type = ps.id
),
cw AS (SELECT CAST(max(length(coalesce(printf('%.1f', {_br('cost_million', 1)} + 0.0), 'NA'))) AS INTEGER) AS w FROM pj),
pj2 AS (
  SELECT pj.*,
         '£' || lpad(coalesce(printf('%.1f', {_br('cost_million', 1)} + 0.0), 'NA'), (SELECT w FROM cw), ' ')
           AS cost_pretty,
         coalesce(first_name, 'NA') || ' ' || coalesce(second_name, 'NA') AS full_name
  FROM pj
),
players AS (
  SELECT id, first_name, second_name, team, element_type, now_cost,
         coalesce(team_name, 'Unknown') AS TEAMS,
         coalesce(pos_name, 'Unknown') AS position,
         cost_million, cost_pretty,
         CASE WHEN cost_million IS NULL OR total_points IS NULL THEN NULL
              WHEN cost_million > 0 THEN {_br('total_points / cost_million', 2)}
              ELSE CAST(0 AS DOUBLE) END AS value,
         full_name,
         {_num('form')} AS form_numeric,
         {_num('points_per_game')} AS points_per_game_numeric,
         {_num('influence')} AS influence_numeric,
         {_num('creativity')} AS creativity_numeric,
         {_num('threat')} AS threat_numeric,
         {_num('ict_index')} AS ict_index_numeric,
         {_num('selected_by_percent')} AS selected_by_percent,
         CAST(minutes AS DOUBLE) AS minutes,
         CAST(total_points AS DOUBLE) AS total_points,
         CAST(goals_scored AS DOUBLE) AS goals_scored,
         CAST(assists AS DOUBLE) AS assists,
         CAST(clean_sheets AS DOUBLE) AS clean_sheets
  FROM pj2
  WHERE total_points IS NOT NULL AND cost_million IS NOT NULL AND minutes IS NOT NULL
),
players_v1 AS (
  SELECT id, team, element_type, now_cost, team_name AS TEAMS, pos_name AS position, cost_million, cost_pretty,
         CASE WHEN cost_million > 0 THEN {_br('total_points / cost_million', 2)} END AS value,
         full_name, CAST(total_points AS DOUBLE) AS total_points, CAST(minutes AS DOUBLE) AS minutes,
         CAST(goals_scored AS DOUBLE) AS goals_scored, CAST(assists AS DOUBLE) AS assists,
         CAST(clean_sheets AS DOUBLE) AS clean_sheets
  FROM pj2
),
active AS (
  SELECT * FROM players
  WHERE minutes > 100 AND form_numeric IS NOT NULL AND points_per_game_numeric IS NOT NULL
),
active_v1 AS (SELECT * FROM players_v1 WHERE minutes > 500),
q75 AS (SELECT quantile_cont(total_points, 0.75) AS q75 FROM active),
psd AS (
  SELECT CASE WHEN count(v) = count(*) THEN stddev_samp(v) END AS sd
  FROM (SELECT goals_scored AS v FROM active UNION ALL SELECT assists FROM active
        UNION ALL SELECT clean_sheets FROM active)
),
tm AS (SELECT team, avg(total_points) AS team_avg FROM active WHERE team IS NOT NULL GROUP BY team),
f0 AS (
  SELECT a.id, a.full_name, a.TEAMS, a.position, a.total_points, a.form_numeric,
         CASE WHEN a.form_numeric IS NOT NULL THEN least(a.form_numeric * CAST(1.5 AS DOUBLE), CAST(10 AS DOUBLE)) END
           AS form_weight,
         a.points_per_game_numeric,
         CASE WHEN a.minutes > 0 THEN a.total_points * 90 / a.minutes ELSE 0.0 END AS points_per_90,
         a.minutes, a.goals_scored, a.assists, a.clean_sheets,
         CASE WHEN a.minutes > 0 THEN a.goals_scored * 90 / a.minutes ELSE 0.0 END AS goals_per_90,
         CASE WHEN a.minutes > 0 THEN a.assists * 90 / a.minutes ELSE 0.0 END AS assists_per_90,
         CAST(CASE a.position WHEN 'Forward' THEN 1.3 WHEN 'Midfielder' THEN 1.1 WHEN 'Defender' THEN 1.0
                              WHEN 'Goalkeeper' THEN 0.8 ELSE 1.0 END AS DOUBLE) AS position_multiplier,
         coalesce(a.influence_numeric / CAST(100 AS DOUBLE), 0.0) AS influence_score,
         coalesce(a.creativity_numeric / CAST(100 AS DOUBLE), 0.0) AS creativity_score,
         coalesce(a.threat_numeric / CAST(100 AS DOUBLE), 0.0) AS threat_score,
         CASE WHEN a.team IS NULL THEN a.total_points ELSE tm.team_avg END AS team_avg_points,
         coalesce(a.selected_by_percent, 0.0) / CAST(100 AS DOUBLE) AS popularity,
         a.cost_million,
         CASE WHEN a.total_points > (SELECT q75 FROM q75) THEN 'High' ELSE 'Low' END AS is_high_performer,
         CASE WHEN a.minutes > 0
              THEN (a.total_points / (a.minutes / CAST(90 AS DOUBLE))) / ((SELECT sd FROM psd) + CAST(1 AS DOUBLE))
              ELSE 0.0 END AS consistency_score,
         a.form_numeric * a.points_per_game_numeric AS momentum,
         CASE WHEN a.cost_million > 0 THEN a.total_points / a.cost_million ELSE 0.0 END AS efficiency
  FROM active a LEFT JOIN tm ON a.team = tm.team
),
features AS (
  SELECT * FROM f0
  WHERE id IS NOT NULL AND full_name IS NOT NULL AND TEAMS IS NOT NULL AND position IS NOT NULL
    AND total_points IS NOT NULL AND form_numeric IS NOT NULL AND form_weight IS NOT NULL
    AND points_per_game_numeric IS NOT NULL AND points_per_90 IS NOT NULL AND minutes IS NOT NULL
    AND goals_scored IS NOT NULL AND assists IS NOT NULL AND clean_sheets IS NOT NULL
    AND goals_per_90 IS NOT NULL AND assists_per_90 IS NOT NULL AND position_multiplier IS NOT NULL
    AND influence_score IS NOT NULL AND creativity_score IS NOT NULL AND threat_score IS NOT NULL
    AND team_avg_points IS NOT NULL AND popularity IS NOT NULL AND cost_million IS NOT NULL
    AND is_high_performer IS NOT NULL AND consistency_score IS NOT NULL AND momentum IS NOT NULL
    AND efficiency IS NOT NULL
),
fixtures_raw AS (
  SELECT o.o_orderkey AS id,
         CASE WHEN o.o_orderkey % 50 = 0 THEN NULL
              ELSE CAST(1 + floor(date_diff('day', DATE '1995-01-01', CAST(o.o_orderdate AS DATE))
                                  / CAST(7 AS DOUBLE)) AS INTEGER) END AS event,
         o.o_orderstatus = 'F' AS finished,
         CAST(c.c_nationkey AS INTEGER) AS team_h,
         CAST((o.o_orderkey * 7 + 3) % 25 AS INTEGER) AS team_a,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(1 + o.o_orderkey % 5 AS INTEGER) END AS team_h_difficulty
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
),
upcoming AS (
  SELECT f.id, f.event AS gameweek, th.name AS home_team, ta.name AS away_team,
         f.team_h_difficulty AS difficulty, f.team_h, f.team_a
  FROM fixtures_raw f LEFT JOIN teams th ON f.team_h = th.id LEFT JOIN teams ta ON f.team_a = ta.id
  WHERE f.finished = false AND f.event IS NOT NULL AND f.event > 0
),
cand AS (
  SELECT a.id AS pid, u.id AS fid, u.gameweek,
         CASE WHEN u.team_h = a.team THEN u.difficulty ELSE 6 - u.difficulty END AS eff,
         row_number() OVER (PARTITION BY a.id ORDER BY u.id) AS rn
  FROM active a JOIN upcoming u ON (u.team_h = a.team OR u.team_a = a.team)
  WHERE u.gameweek = (SELECT min(gameweek) FROM upcoming)
),
resolved AS (
  SELECT a.*, c.fid AS fixture_id, c.gameweek, CAST(CASE WHEN c.fid IS NOT NULL THEN c.eff ELSE 3 END AS INTEGER) AS fixture_difficulty
  FROM active a LEFT JOIN cand c ON c.pid = a.id AND c.rn = 1
)
"""

_MULT = ("CAST(CASE {d} WHEN 1 THEN 1.25 WHEN 2 THEN 1.10 WHEN 3 THEN 1.00 WHEN 4 THEN 0.85 WHEN 5 THEN 0.70 "
         "ELSE 1.0 END AS DOUBLE)")
_ADJ = ("CAST(CASE position WHEN 'Forward' THEN 1.05 WHEN 'Midfielder' THEN 1.00 WHEN 'Defender' THEN 0.90 "
        "WHEN 'Goalkeeper' THEN 0.85 ELSE 1.0 END AS DOUBLE)")
_BASE_PRED = "(form_numeric * CAST(0.6 AS DOUBLE) + points_per_game_numeric * CAST(0.4 AS DOUBLE))"


def _clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, CAST({hi} AS DOUBLE)), CAST({lo} AS DOUBLE)) END)"


def _pred_sql(resolved: str, difficulty: str) -> str:
    x = _clip(f"({_BASE_PRED} * {_MULT.format(d=difficulty)} * {_ADJ})", 1, 12)
    return f"""
pred AS (
  SELECT id, full_name, TEAMS, position, form_numeric, points_per_game_numeric, total_points, goals_scored,
         assists, minutes, value, gameweek, fixture_id, fixture_difficulty,
         {_BASE_PRED} AS base_prediction,
         {_br('x', 1)} AS predicted_points,
         {_br(_clip('x - CAST(0.3 AS DOUBLE)', 1, 12), 1)} AS predicted_low,
         {_br(_clip('x + CAST(0.3 AS DOUBLE)', 1, 12), 1)} AS predicted_high
  FROM (SELECT *, {x} AS x FROM {resolved})
)"""


_SWEEP_X = _clip(f"({_BASE_PRED} * {_MULT.format(d='difficulty')} * {_ADJ})", 1, 12)

_PLAYER_COLS = ("id, first_name, second_name, team, element_type, now_cost, TEAMS, position, cost_million, "
                "cost_pretty, value, full_name, form_numeric, points_per_game_numeric, influence_numeric, "
                "creativity_numeric, threat_numeric, ict_index_numeric, selected_by_percent, minutes, "
                "total_points, goals_scored, assists, clean_sheets")
_PLAYER_V1_COLS = ("id, team, element_type, now_cost, TEAMS, position, cost_million, cost_pretty, value, "
                   "full_name, total_points, minutes")

_FEATURES = ["goals_per_90", "assists_per_90", "points_per_90", "momentum", "efficiency",
             "consistency_score", "influence_score", "creativity_score", "threat_score"]


def _with(body: str, extra: str = "") -> str:
    return f"WITH {BASE}{(',' + extra) if extra else ''}\n{body}"


def _card_sql() -> str:
    labels = ("CASE fixture_difficulty WHEN 1 THEN '(Very Easy)' WHEN 2 THEN '(Easy)' WHEN 3 THEN '(Average)' "
              "WHEN 4 THEN '(Hard)' WHEN 5 THEN '(Very Hard)' END")
    rows = [
        ("Player", "full_name"),
        ("Team", "TEAMS"),
        ("Position", "position"),
        ("Current Form", f"{_txt('form_numeric', 1)} || '/10.0'"),
        ("Points Per Game", _txt("points_per_game_numeric", 1)),
        ("Total Points", _txt("total_points", 0)),
        ("Goals", _txt("goals_scored", 0)),
        ("Assists", _txt("assists", 0)),
        ("Minutes Played", "format('{:,.0f}', minutes)"),
        ("Value Rating", _txt("value", 2)),
        ("Fixture Difficulty", f"coalesce(CAST(fixture_difficulty AS VARCHAR), 'NA') || '/5 ' || coalesce({labels}, 'NA')"),
        ("Predicted Points", f"CASE WHEN predicted_points IS NULL THEN 'N/A' "
                             f"ELSE {_txt('predicted_points', 1)} || ' pts' END"),
        ("Prediction Range", f"CASE WHEN predicted_low IS NULL OR predicted_high IS NULL THEN 'N/A' "
                             f"ELSE {_txt('predicted_low', 1)} || ' - ' || {_txt('predicted_high', 1)} || ' pts' END"),
    ]
    parts = [f"SELECT id, {i + 1} AS row, '{name}' AS metric, coalesce(CAST({expr} AS VARCHAR), 'NA') AS value FROM pred"
             for i, (name, expr) in enumerate(rows)]
    return "\nUNION ALL\n".join(parts)


def _radar_v2() -> str:
    metrics = [("Goals", "goals_scored"), ("Assists", "assists"), ("Clean Sheets", "clean_sheets"),
               ("Total Points", "total_points"), ("Minutes", "minutes")]
    parts = [f"SELECT id, {i + 1} AS ord, '{label}' AS metric, "
             f"{c} / nullif((SELECT max({c}) FROM active), 0) * CAST(100 AS DOUBLE) AS value FROM active"
             for i, (label, c) in enumerate(metrics)]
    parts.append("SELECT id, 6 AS ord, 'Form' AS metric, "
                 "form_numeric / CAST(10 AS DOUBLE) * CAST(100 AS DOUBLE) AS value FROM active")
    return "\nUNION ALL\n".join(parts)


def _radar_v1() -> str:
    inner = ("SELECT id, goals_scored AS goals, assists, clean_sheets, "
             "minutes / nullif((SELECT max(minutes) FROM active_v1), 0) * CAST(100 AS DOUBLE) AS mins_pct, "
             "total_points FROM active_v1")
    vals = [("Goals", "goals"), ("Assists", "assists"), ("Clean Sheets", "clean_sheets"),
            ("Minutes", "mins_pct"), ("Total Points", "total_points")]
    axis = "greatest(goals, assists, clean_sheets, mins_pct, total_points) * CAST(1.1 AS DOUBLE)"
    parts = [f"SELECT id, {i + 1} AS ord, '{m}' AS metric, {c} AS value, {axis} AS axis_max FROM rv1"
             for i, (m, c) in enumerate(vals)]
    return _with("\nUNION ALL\n".join(parts), f"rv1 AS ({inner})")


def _compare(variant: str, chosen: str | None = None) -> str:
    table = "active" if variant == "v2" else "active_v1"
    stats = [("Goals", "goals_scored", 1), ("Assists", "assists", 1), ("Clean Sheets", "clean_sheets", 1),
             ("Total Points", "total_points", 1)]
    stats += [("Minutes/100", "minutes", 100), ("Form", "form_numeric", 1)] if variant == "v2" \
        else [("Minutes", "minutes", 1)]
    parts = [f"SELECT p.p1 AS player1_id, p.p2 AS player2_id, {i + 1} AS ord, '{label}' AS stat, "
             f"x.{c} / CAST({div} AS DOUBLE) AS player1, y.{c} / CAST({div} AS DOUBLE) AS player2 "
             f"FROM pairs p JOIN {table} x ON x.id = p.p1 JOIN {table} y ON y.id = p.p2"
             for i, (label, c, div) in enumerate(stats)]
    pairs = f"""best AS (
  SELECT position, id FROM (SELECT position, id, row_number() OVER (PARTITION BY position
                                   ORDER BY total_points DESC, id) AS rn FROM {table}) WHERE rn = 1),
pairs AS ({chosen or f"SELECT a.id AS p1, b.id AS p2 FROM {table} a JOIN best b ON a.position IS NOT DISTINCT FROM b.position"})"""
    return _with("\nUNION ALL\n".join(parts), pairs)


def _decision_path() -> str:
    steps = [
        ("Base Prediction", "b", "Average points across all players"),
        ("Add Momentum Effect", "b + momentum * CAST(2 AS DOUBLE)", "Player''s recent momentum adds to prediction"),
        ("Add Efficiency Factor", "b + momentum * CAST(2 AS DOUBLE) + efficiency * CAST(1.5 AS DOUBLE)",
         "Cost-efficiency factor increases confidence"),
        ("Add Form Weight", "b + momentum * CAST(2 AS DOUBLE) + efficiency * CAST(1.5 AS DOUBLE) "
                            "+ form_weight * CAST(0.8 AS DOUBLE)", "Current form weight applied"),
        ("Position Adjustment", "(b + momentum * CAST(2 AS DOUBLE) + efficiency * CAST(1.5 AS DOUBLE) "
                                "+ form_weight * CAST(0.8 AS DOUBLE)) * position_multiplier",
         "Position-specific multiplier applied"),
        ("Final Prediction", "total_points", "Actual total points for reference"),
    ]
    parts = [f"SELECT id, {i + 1} AS step_no, '{name}' AS step, {_br(expr, 1)} AS value, "
             f"'{text}' AS explanation FROM fb" for i, (name, expr, text) in enumerate(steps)]
    return _with("\nUNION ALL\n".join(parts),
                 "fb AS (SELECT f.*, (SELECT avg(total_points) FROM features) AS b FROM features f)")


def _local_contributions() -> str:
    weights = [("momentum", 2.0), ("efficiency", 1.5), ("form_weight", 0.8), ("points_per_90", 1.2),
               ("goals_per_90", 3.0), ("influence_score", 5.0), ("creativity_score", 4.0)]
    terms = [f"{c} * CAST({w} AS DOUBLE)" for c, w in weights]
    total = " + ".join(terms)
    longs = "\nUNION ALL\n".join(
        f"SELECT id, {i} AS ford, '{c}' AS feature, {t} - ({total}) / CAST(7 AS DOUBLE) AS contribution FROM features"
        for i, ((c, _), t) in enumerate(zip(weights, terms)))
    body = ("SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY contribution, ford) AS INTEGER) AS rank, "
            "feature, contribution, contribution > 0 AS is_positive FROM lc")
    return _with(body, f"lc AS ({longs})")


def _classify() -> str:
    s = ("greatest(least((momentum * CAST(0.3 AS DOUBLE) + efficiency * CAST(0.3 AS DOUBLE) "
         "+ form_weight * CAST(0.2 AS DOUBLE) + points_per_90 * CAST(0.2 AS DOUBLE)) / CAST(10 AS DOUBLE), "
         "CAST(0.9 AS DOUBLE)), CAST(0.1 AS DOUBLE))")
    m = "abs(score - CAST(0.5 AS DOUBLE))"
    conf = {
        "SVM": f"CASE WHEN {m} > 0.3 THEN 'High' WHEN {m} > 0.15 THEN 'Medium' ELSE 'Low' END",
        "Random Forest": f"CASE WHEN {m} > 0.25 THEN 'High' WHEN {m} > 0.1 THEN 'Medium' ELSE 'Low' END",
        "XGBoost": f"CASE WHEN {m} > 0.35 THEN 'High' ELSE 'Medium' END",
    }
    parts = [f"SELECT id, '{model}' AS model, CASE WHEN score > 0.5 THEN 'High' ELSE 'Low' END AS prediction, "
             f"{_br('score * CAST(100 AS DOUBLE)', 1)} AS high_pct, "
             f"{_br('CAST(100 AS DOUBLE) - score * CAST(100 AS DOUBLE)', 1)} AS low_pct, "
             f"{c} AS confidence, score FROM sc" for model, c in conf.items()]
    return _with("\nUNION ALL\n".join(parts), f"sc AS (SELECT id, {s} AS score FROM features)")


def _correlation() -> str:
    parts = []
    for a in _FEATURES:
        for b in _FEATURES:
            if a == b:
                expr = f"CASE WHEN stddev_samp({a}) > 0 THEN CAST(1 AS DOUBLE) END"
            else:
                expr = f"CASE WHEN stddev_samp({a}) > 0 AND stddev_samp({b}) > 0 THEN corr({a}, {b}) END"
            parts.append(f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {expr} AS corr FROM features")
    return _with("\nUNION ALL\n".join(parts))


def _long_features() -> str:
    return "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, {c} AS x FROM features" for c in _FEATURES)


def _histogram() -> str:
    extra = f"""lf AS ({_long_features()}),
hb AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM lf WHERE x IS NOT NULL GROUP BY feature),
hbin AS (
  SELECT l.feature,
         CASE WHEN b.hi > b.lo THEN CAST(least(floor((l.x - b.lo) / (b.hi - b.lo) * CAST(30 AS DOUBLE)), 29) AS INTEGER)
              ELSE 0 END AS bin
  FROM lf l JOIN hb b ON l.feature = b.feature WHERE l.x IS NOT NULL),
hc AS (SELECT feature, bin, count(*) AS c FROM hbin GROUP BY feature, bin),
hs AS (SELECT feature, lo, hi, CAST(r.range AS INTEGER) AS bin FROM hb, range(0, 30) r)"""
    body = """SELECT s.feature,
       upper(substr(replace(s.feature, '_', ' '), 1, 1)) || substr(replace(s.feature, '_', ' '), 2) AS label,
       s.bin,
       s.lo + s.bin * ((s.hi - s.lo) / CAST(30 AS DOUBLE)) AS bin_lo,
       s.lo + (s.bin + 1) * ((s.hi - s.lo) / CAST(30 AS DOUBLE)) AS bin_hi,
       CAST(coalesce(c.c, 0) AS BIGINT) AS count
FROM hs s LEFT JOIN hc c ON s.feature = c.feature AND s.bin = c.bin"""
    return _with(body, extra)


def _box() -> str:
    extra = f"""lf AS ({_long_features()}),
bq AS (
  SELECT feature, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
         quantile_cont(x, 0.75) AS q3
  FROM lf WHERE x IS NOT NULL GROUP BY feature),
bf AS (SELECT *, q3 - q1 AS iqr, q1 - CAST(1.5 AS DOUBLE) * (q3 - q1) AS lower_fence,
              q3 + CAST(1.5 AS DOUBLE) * (q3 - q1) AS upper_fence FROM bq)"""
    body = """SELECT b.feature, CAST(b.n AS BIGINT) AS n, b.q1, b.median, b.q3, b.iqr, b.lower_fence, b.upper_fence,
       min(l.x) FILTER (WHERE l.x >= b.lower_fence AND l.x <= b.upper_fence) AS whisker_low,
       max(l.x) FILTER (WHERE l.x >= b.lower_fence AND l.x <= b.upper_fence) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (l.x >= b.lower_fence AND l.x <= b.upper_fence)) AS BIGINT) AS n_outliers
FROM bf b JOIN lf l ON l.feature = b.feature AND l.x IS NOT NULL
GROUP BY b.feature, b.n, b.q1, b.median, b.q3, b.iqr, b.lower_fence, b.upper_fence"""
    return _with(body, extra)


def _rolling() -> str:
    extra = """pp AS (
  SELECT user_id AS player_id, CAST(2 * day(ts) - 1 + CASE WHEN hour(ts) >= 12 THEN 1 ELSE 0 END AS INTEGER) AS week,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS points
  FROM events GROUP BY 1, 2),
sp AS (SELECT p.player_id, CAST(w.range AS INTEGER) AS week FROM (SELECT DISTINCT player_id FROM pp) p,
       range(1, (SELECT max(week) FROM pp) + 1) w),
dn AS (SELECT s.player_id, s.week, CAST(coalesce(pp.points, 0) AS BIGINT) AS points
       FROM sp s LEFT JOIN pp ON pp.player_id = s.player_id AND pp.week = s.week)"""
    body = """SELECT player_id, week, points,
  CASE WHEN row_number() OVER w >= 3 THEN avg(points) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS ma_short,
  CASE WHEN row_number() OVER w >= 5 THEN avg(points) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS ma_long,
  CASE WHEN row_number() OVER w >= 5
       THEN stddev_samp(points) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS volatility,
  CAST(points - first_value(points) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS momentum
FROM dn
WINDOW w AS (PARTITION BY player_id ORDER BY week)"""
    return _with(body, extra)


def _points_vs_cost(variant: str) -> str:
    cost, pts = _txt("cost_million", 1), _txt("total_points", 0)
    if variant == "v2":
        tip = (f"concat_ws(' ', 'Player:', coalesce(full_name, 'NA'), '<br>Team:', coalesce(TEAMS, 'NA'), "
               f"'<br>Position:', coalesce(position, 'NA'), '<br>Cost: £', coalesce({cost}, 'NA'), "
               f"'<br>Points:', coalesce({pts}, 'NA'), '<br>Value:', coalesce({_txt('value', 2)}, 'NA'))")
        return _with(f"SELECT id, cost_million, total_points, position AS colour_key, position AS shape_key, "
                     f"{tip} AS tooltip FROM active")
    tip = (f"concat_ws(' ', coalesce(full_name, 'NA'), '<br>Team:', coalesce(TEAMS, 'NA'), "
           f"'<br>Cost: £', coalesce({cost}, 'NA'), '<br>Points:', coalesce({pts}, 'NA'))")
    return _with(f"SELECT id, cost_million, total_points, TEAMS AS colour_key, position AS shape_key, "
                 f"{tip} AS tooltip FROM active_v1")


def _elite_union() -> str:
    quotas = [("Goalkeeper", 2), ("Defender", 5), ("Midfielder", 5), ("Forward", 3)]
    parts = [f"(SELECT * FROM active WHERE position = '{p}' ORDER BY total_points DESC, id LIMIT {k})"
             for p, k in quotas]
    return _with("SELECT id, full_name AS player, TEAMS AS team, position, total_points, goals_scored AS goals, "
                 "assists, clean_sheets, cost_million, value FROM (" + "\nUNION ALL\n".join(parts) + ")")


def _manual(difficulty: int) -> str:
    return (f"man AS (SELECT a.*, CAST(NULL AS BIGINT) AS fixture_id, CAST(NULL AS INTEGER) AS gameweek, "
            f"CAST({difficulty} AS INTEGER) AS fixture_difficulty FROM active a)")


_MANUAL_2, _MANUAL_3 = _manual(2), _manual(3)
_GAMEWEEK_3 = """cand_gw AS (
  SELECT a.id AS pid, u.id AS fid, u.gameweek,
         CASE WHEN u.team_h = a.team THEN u.difficulty ELSE 6 - u.difficulty END AS eff,
         row_number() OVER (PARTITION BY a.id ORDER BY u.id) AS rn
  FROM active a JOIN upcoming u ON (u.team_h = a.team OR u.team_a = a.team)
  WHERE u.gameweek = 20),
resolved_gw AS (
  SELECT a.*, c.fid AS fixture_id, c.gameweek, CAST(CASE WHEN c.fid IS NOT NULL THEN c.eff ELSE 3 END AS INTEGER) AS fixture_difficulty
  FROM active a LEFT JOIN cand_gw c ON c.pid = a.id AND c.rn = 1)"""


def _rule_metrics() -> str:
    return f"""WITH r AS (
  SELECT c.model, c.prediction = 'High' AS said, f.is_high_performer = 'High' AS truth
  FROM ({_classify()}) c JOIN ({_with("SELECT id, is_high_performer FROM features")}) f ON c.id = f.id),
m AS (SELECT model, count(*) AS n, count(*) FILTER (WHERE said = truth) AS ok, count(*) FILTER (WHERE said AND truth) AS tp,
             count(*) FILTER (WHERE said) AS p, count(*) FILTER (WHERE truth) AS t FROM r GROUP BY model)
SELECT model, 'accuracy' AS metric, ok / nullif(n, 0)::DOUBLE AS value FROM m
UNION ALL SELECT model, 'precision', tp / nullif(p, 0)::DOUBLE FROM m
UNION ALL SELECT model, 'recall', tp / nullif(t, 0)::DOUBLE FROM m"""


_SWEEP = _with(
    "SELECT id, difficulty, CASE difficulty WHEN 1 THEN 'Very Easy' WHEN 2 THEN 'Easy' WHEN 3 THEN 'Average' "
    "WHEN 4 THEN 'Hard' WHEN 5 THEN 'Very Hard' END AS label, "
    f"{_br(_SWEEP_X, 1)} "
    "AS predicted_points, difficulty = 3 AS is_current "
    "FROM (SELECT a.*, CAST(d.range AS INTEGER) AS difficulty FROM active a, range(1, 6) d)")


def _changed(table: str, select: str, body: str) -> str:
    """``body`` over the league in which ``select`` from ``landed`` stands for the raw table."""
    return _with(body).replace(f"{table} AS (", "landed AS (", 1).replace(f"{_AFTER[table]} AS (", f"{table} AS ({select}),\n{_AFTER[table]} AS (", 1)


#: The common table expression that follows a raw table.
_AFTER = {"players_raw": "teams", "fixtures_raw": "upcoming"}

_SQL: dict[str, str] = {
    "players": _with(f"SELECT {_PLAYER_COLS} FROM players"),
    "players_v1": _with(f"SELECT {_PLAYER_V1_COLS} FROM players_v1"),
    "players_from_json": _with(f"SELECT {_PLAYER_COLS} FROM players"),
    "active_players": _with(f"SELECT {_PLAYER_COLS} FROM active"),
    "active_players_v1": _with(f"SELECT {_PLAYER_V1_COLS} FROM active_v1"),
    "dashboard_filter_position": _with(f"SELECT {_PLAYER_COLS} FROM active WHERE position = 'Midfielder'"),
    "dashboard_filter_team_cost": _with(
        f"SELECT {_PLAYER_COLS} FROM active WHERE TEAMS = 'NATION_7' AND cost_million <= 10.0"),
    "dashboard_filter_all": _with(
        f"SELECT {_PLAYER_COLS} FROM active WHERE position = 'Defender' AND TEAMS = 'NATION_1' "
        f"AND cost_million <= 15.0 AND minutes >= 500"),
    "points_vs_cost": _points_vs_cost("v2"),
    "points_vs_cost_v1": _points_vs_cost("v1"),
    "top_value": _with("SELECT id, full_name AS player, TEAMS AS team, position, total_points, cost_pretty AS cost, "
                       "value, form_numeric AS form, minutes FROM active "
                       "ORDER BY value DESC NULLS LAST, id LIMIT 20"),
    "top_value_filtered": _with(
        "SELECT id, full_name AS player, TEAMS AS team, position, total_points, cost_pretty AS cost, "
        "value, form_numeric AS form, minutes FROM active "
        "WHERE position = 'Forward' AND cost_million <= 8.0 AND minutes >= 300 "
        "ORDER BY value DESC NULLS LAST, id LIMIT 20"),
    "top_value_v1": _with("SELECT id, full_name, TEAMS, position, total_points, cost_pretty AS cost_millions, value "
                          "FROM active_v1 ORDER BY value DESC NULLS LAST, id LIMIT 10"),
    "feature_leaders": _with(
        f"SELECT id, full_name AS player, TEAMS AS team, position, {_br('momentum', 2)} AS momentum, "
        f"{_br('efficiency', 2)} AS efficiency, {_br('goals_per_90', 2)} AS goals_per_90, "
        f"{_br('assists_per_90', 2)} AS assists_per_90, {_br('consistency_score', 2)} AS consistency "
        "FROM features ORDER BY features.momentum DESC NULLS LAST, id LIMIT 20"),
    "team_points": _with("SELECT TEAMS, sum(total_points) AS total_points FROM active GROUP BY TEAMS"),
    "top_teams": _with(
        "SELECT TEAMS, total_points, CAST(row_number() OVER (ORDER BY total_points, TEAMS DESC) AS INTEGER) "
        "AS chart_order FROM (SELECT TEAMS, sum(total_points) AS total_points FROM active GROUP BY TEAMS "
        "ORDER BY total_points DESC, TEAMS LIMIT 10)"),
    "team_squad": _with("SELECT id, TEAMS AS team, full_name AS player, position, total_points, "
                        "cost_million AS cost, value, form_numeric AS form FROM active"),
    "team_squad_one": _with("SELECT id, TEAMS AS team, full_name AS player, position, total_points, "
                            "cost_million AS cost, value, form_numeric AS form FROM active WHERE TEAMS = 'NATION_3'"),
    "team_squad_v1": _with("SELECT id, TEAMS AS team, full_name AS player, position, total_points, "
                           "cost_million AS cost FROM active_v1"),
    "elite_squad": _with(
        "SELECT id, full_name AS player, TEAMS AS team, position, total_points, goals_scored AS goals, assists, "
        "clean_sheets, cost_million, value FROM (SELECT *, row_number() OVER (PARTITION BY position "
        "ORDER BY total_points DESC, id) AS rn FROM active) WHERE rn <= CASE position WHEN 'Goalkeeper' THEN 2 "
        "WHEN 'Defender' THEN 5 WHEN 'Midfielder' THEN 5 WHEN 'Forward' THEN 3 ELSE 0 END"),
    "elite_squad_union": _elite_union(),
    "position_distribution": _with("SELECT position, count(*) AS count FROM active GROUP BY position"),
    "filter_domains": _with("SELECT CAST(floor(min(cost_million)) AS BIGINT) AS cost_min, "
                            "CAST(ceil(max(cost_million)) AS BIGINT) AS cost_max, max(minutes) AS minutes_max "
                            "FROM active"),
    "position_domain": _with("SELECT DISTINCT position FROM active"),
    "team_domain": _with("SELECT DISTINCT TEAMS AS team FROM active"),
    "gameweek_domain": _with("SELECT DISTINCT gameweek, gameweek = (SELECT min(gameweek) FROM upcoming) AS is_default "
                             "FROM upcoming"),
    "profile": _with(
        "SELECT (SELECT count(*) FROM players) AS players_rows, (SELECT count(*) FROM teams) AS teams_rows, "
        "(SELECT count(*) FROM positions) AS positions_rows, (SELECT count(*) FROM active) AS active_rows, "
        "(SELECT string_agg(p, ', ' ORDER BY p) FROM (SELECT DISTINCT position AS p FROM active)) AS positions_seen, "
        "(SELECT count(*) FROM upcoming) AS fixtures_rows, "
        "(SELECT string_agg(CAST(g AS VARCHAR), ', ' ORDER BY g) FROM (SELECT DISTINCT gameweek AS g FROM upcoming)) "
        "AS gameweeks"),
    "feature_scalars": _with("SELECT (SELECT q75 FROM q75) AS q75, (SELECT sd FROM psd) AS pooled_sd"),
    "features": _with("SELECT * FROM features"),
    "upcoming_fixtures": _with("SELECT id, gameweek, home_team, away_team, difficulty, team_h, team_a FROM upcoming"),
    "fixture_difficulty": _with("SELECT id, team, fixture_id, gameweek, fixture_difficulty FROM resolved"),
    "predict": _with("SELECT * FROM pred", _pred_sql("resolved", "fixture_difficulty")),
    "predict_manual": _with(
        "SELECT * FROM pred",
        "man AS (SELECT a.*, CAST(NULL AS BIGINT) AS fixture_id, CAST(NULL AS INTEGER) AS gameweek, "
        "CAST(2 AS INTEGER) AS fixture_difficulty FROM active a)," + _pred_sql("man", "fixture_difficulty")),
    "prediction_card": _with(_card_sql(), _pred_sql("resolved", "fixture_difficulty")),
    "difficulty_sweep": _SWEEP,
    "radar": _with(_radar_v2()),
    "radar_v1": _radar_v1(),
    "compare": _compare("v2"),
    "compare_v1": _compare("v1"),
    "decision_path": _decision_path(),
    "local_contributions": _local_contributions(),
    "classify_rules": _classify(),
    "feature_correlation": _correlation(),
    "feature_histogram": _histogram(),
    "feature_box": _box(),
    "rolling_form": _rolling(),
    "elite_squad_v1": _with(
        "SELECT id, full_name AS player, TEAMS AS team, position, total_points, goals_scored AS goals, assists, "
        "clean_sheets, cost_million, value FROM (SELECT *, row_number() OVER (PARTITION BY position "
        "ORDER BY total_points DESC, id) AS rn FROM active_v1) WHERE rn <= CASE position WHEN 'Goalkeeper' THEN 2 "
        "WHEN 'Defender' THEN 5 WHEN 'Midfielder' THEN 5 WHEN 'Forward' THEN 3 ELSE 0 END"),
    "position_distribution_v1": _with("SELECT position, count(*) AS count FROM active_v1 GROUP BY position"),
    "top_teams_v1": _with(
        "SELECT TEAMS, total_points, CAST(row_number() OVER (ORDER BY total_points, TEAMS DESC) AS INTEGER) "
        "AS chart_order FROM (SELECT TEAMS, sum(total_points) AS total_points FROM active_v1 GROUP BY TEAMS "
        "ORDER BY total_points DESC, TEAMS LIMIT 10)"),
    "dashboard_filter_v1": _with(
        f"SELECT {_PLAYER_V1_COLS} FROM active_v1 WHERE position = 'Midfielder' AND cost_million <= 12.0 AND minutes >= 700"),
    "filter_domains_v1": _with("SELECT CAST(floor(min(cost_million)) AS BIGINT) AS cost_min, "
                               "CAST(ceil(max(cost_million)) AS BIGINT) AS cost_max, max(minutes) AS minutes_max "
                               "FROM active_v1"),
    "lookup_by_name": _with(f"SELECT {_PLAYER_COLS} FROM active WHERE full_name IN ('Customer 000000007', 'Customer 000000011')"),
    "lookup_no_match": _with(f"SELECT {_PLAYER_COLS} FROM active WHERE full_name = 'Nobody'"),
    "radar_one": f"SELECT * FROM ({_with(_radar_v2())}) WHERE id = 7",
    "decision_path_one": f"SELECT * FROM ({_decision_path()}) WHERE id = 7",
    "predict_gameweek": _with("SELECT * FROM pred", _GAMEWEEK_3 + "," + _pred_sql("resolved_gw", "fixture_difficulty")),
    "prediction_card_manual": _with(_card_sql(), _MANUAL_2 + "," + _pred_sql("man", "fixture_difficulty")),
    "predict_no_fixtures": _with("SELECT * FROM pred", _MANUAL_3 + "," + _pred_sql("man", "fixture_difficulty")),
    "players_from_documents": _with(f"SELECT {_PLAYER_COLS} FROM players"),
    "fixtures_from_document": _with("SELECT id, gameweek, home_team, away_team, difficulty, team_h, team_a FROM upcoming"),
    "published_players": _with(f"SELECT {_PLAYER_COLS} FROM players"),
    "streamed_players": _with(f"SELECT {_PLAYER_COLS} FROM players"),
    "players_after_changes": _changed(
        "players_raw", "SELECT * REPLACE (CASE WHEN id % 5 = 1 THEN total_points + 10 ELSE total_points END AS total_points) FROM landed WHERE id % 7 <> 0",
        f"SELECT {_PLAYER_COLS} FROM players"),
    "fixtures_after_changes": _changed(
        "fixtures_raw", "SELECT * REPLACE (finished OR id % 4 = 0 AS finished, CASE WHEN id % 6 = 1 THEN event + 1 ELSE event END AS event, "
        "CASE WHEN id % 13 = 2 THEN 5 ELSE team_h_difficulty END AS team_h_difficulty) FROM landed WHERE id % 9 <> 0",
        "SELECT id, gameweek, home_team, away_team, difficulty, team_h, team_a FROM upcoming"),
    "prediction_card_one": f"SELECT * FROM ({_with(_card_sql(), _pred_sql('resolved', 'fixture_difficulty'))}) WHERE id = 7",
    "difficulty_sweep_one": f"SELECT * FROM ({_SWEEP}) WHERE id IN (7, 11)",
    "local_contributions_one": f"SELECT * FROM ({_local_contributions()}) WHERE id = 7",
    "classify_rules_one": f"SELECT * FROM ({_classify()}) WHERE id = 7",
    "compare_named": _compare("v2", "SELECT x.id AS p1, y.id AS p2 FROM active x JOIN active y ON x.full_name = 'Customer 000000007' AND y.full_name = 'Customer 000000011'"),
    "rule_metrics": _rule_metrics(),
}


# Double columns of each query's output; both engines round exactly these to CHECK_DIGITS.
DOUBLE_COLUMNS = {
    'players': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'players_v1': ['cost_million', 'value', 'total_points', 'minutes'],
    'players_from_json': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'active_players': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'active_players_v1': ['cost_million', 'value', 'total_points', 'minutes'],
    'dashboard_filter_position': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'dashboard_filter_team_cost': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'dashboard_filter_all': ['cost_million', 'value', 'form_numeric', 'points_per_game_numeric', 'influence_numeric', 'creativity_numeric', 'threat_numeric', 'ict_index_numeric', 'selected_by_percent', 'minutes', 'total_points', 'goals_scored', 'assists', 'clean_sheets'],
    'points_vs_cost': ['cost_million', 'total_points'],
    'points_vs_cost_v1': ['cost_million', 'total_points'],
    'top_value': ['total_points', 'value', 'form', 'minutes'],
    'top_value_filtered': ['total_points', 'value', 'form', 'minutes'],
    'top_value_v1': ['total_points', 'value'],
    'feature_leaders': ['momentum', 'efficiency', 'goals_per_90', 'assists_per_90', 'consistency'],
    'team_points': ['total_points'],
    'top_teams': ['total_points'],
    'team_squad': ['total_points', 'cost', 'value', 'form'],
    'team_squad_one': ['total_points', 'cost', 'value', 'form'],
    'team_squad_v1': ['total_points', 'cost'],
    'elite_squad': ['total_points', 'goals', 'assists', 'clean_sheets', 'cost_million', 'value'],
    'elite_squad_union': ['total_points', 'goals', 'assists', 'clean_sheets', 'cost_million', 'value'],
    'position_distribution': [],
    'filter_domains': ['minutes_max'],
    'position_domain': [],
    'team_domain': [],
    'gameweek_domain': [],
    'profile': [],
    'feature_scalars': ['q75', 'pooled_sd'],
    'features': ['total_points', 'form_numeric', 'form_weight', 'points_per_game_numeric', 'points_per_90', 'minutes', 'goals_scored', 'assists', 'clean_sheets', 'goals_per_90', 'assists_per_90', 'position_multiplier', 'influence_score', 'creativity_score', 'threat_score', 'team_avg_points', 'popularity', 'cost_million', 'consistency_score', 'momentum', 'efficiency'],
    'upcoming_fixtures': [],
    'fixture_difficulty': [],
    'predict': ['form_numeric', 'points_per_game_numeric', 'total_points', 'goals_scored', 'assists', 'minutes', 'value', 'base_prediction', 'predicted_points', 'predicted_low', 'predicted_high'],
    'predict_manual': ['form_numeric', 'points_per_game_numeric', 'total_points', 'goals_scored', 'assists', 'minutes', 'value', 'base_prediction', 'predicted_points', 'predicted_low', 'predicted_high'],
    'prediction_card': [],
    'difficulty_sweep': ['predicted_points'],
    'radar': ['value'],
    'radar_v1': ['value', 'axis_max'],
    'compare': ['player1', 'player2'],
    'compare_v1': ['player1', 'player2'],
    'decision_path': ['value'],
    'local_contributions': ['contribution'],
    'classify_rules': ['high_pct', 'low_pct', 'score'],
    'feature_correlation': ['corr'],
    'feature_histogram': ['bin_lo', 'bin_hi'],
    'feature_box': ['q1', 'median', 'q3', 'iqr', 'lower_fence', 'upper_fence', 'whisker_low', 'whisker_high'],
    'elite_squad_v1': ['total_points', 'goals', 'assists', 'clean_sheets', 'cost_million', 'value'],
    'top_teams_v1': ['total_points'],
    'dashboard_filter_v1': ['cost_million', 'value', 'total_points', 'minutes'],
    'filter_domains_v1': ['minutes_max'],
    'radar_one': ['value'],
    'decision_path_one': ['value'],
    'rule_metrics': ['value'],
    'rolling_form': ['ma_short', 'ma_long', 'volatility', 'momentum'],
}


for _same, _as in (("lookup_by_name", "players"), ("lookup_no_match", "players"), ("players_from_documents", "players"),
                   ("published_players", "players"), ("streamed_players", "players"), ("players_after_changes", "players"),
                   ("difficulty_sweep_one", "difficulty_sweep"), ("local_contributions_one", "local_contributions"),
                   ("classify_rules_one", "classify_rules"), ("compare_named", "compare"), ("prediction_card_one", "prediction_card"),
                   ("predict_gameweek", "predict"), ("predict_no_fixtures", "predict")):
    DOUBLE_COLUMNS[_same] = DOUBLE_COLUMNS[_as]


def _rounded(name: str, sql: str) -> str:
    cols = DOUBLE_COLUMNS.get(name, [])
    if not cols:
        return sql
    repl = ", ".join(f"{_br(c, CHECK_DIGITS)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n)"


def oracle_sql() -> dict[str, str]:
    return {name: _rounded(name, sql) for name, sql in _SQL.items()}
