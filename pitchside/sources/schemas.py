"""Explicit schemas for every input; nothing is inferred at read time."""

from pyspark.sql import types as T

PLAYERS_RAW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("first_name", T.StringType()),
    T.StructField("second_name", T.StringType()),
    T.StructField("team", T.IntegerType()),
    T.StructField("element_type", T.IntegerType()),
    T.StructField("now_cost", T.IntegerType()),
    T.StructField("total_points", T.LongType()),
    T.StructField("minutes", T.LongType()),
    T.StructField("goals_scored", T.LongType()),
    T.StructField("assists", T.LongType()),
    T.StructField("clean_sheets", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("points_per_game", T.StringType()),
    T.StructField("influence", T.StringType()),
    T.StructField("creativity", T.StringType()),
    T.StructField("threat", T.StringType()),
    T.StructField("ict_index", T.StringType()),
    T.StructField("selected_by_percent", T.StringType()),
])

TEAMS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
])

POSITIONS = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("singular_name", T.StringType()),
])

FIXTURES_RAW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("event", T.IntegerType()),
    T.StructField("finished", T.BooleanType()),
    T.StructField("team_h", T.IntegerType()),
    T.StructField("team_a", T.IntegerType()),
    T.StructField("team_h_difficulty", T.IntegerType()),
])

# Output of upcoming_fixtures, and the schema of the empty table used when the
# fixtures source is missing or empty. ``id`` is kept as the tie-break.
UPCOMING_FIXTURES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("gameweek", T.IntegerType()),
    T.StructField("home_team", T.StringType()),
    T.StructField("away_team", T.StringType()),
    T.StructField("difficulty", T.IntegerType()),
    T.StructField("team_h", T.IntegerType()),
    T.StructField("team_a", T.IntegerType()),
])

# The bootstrap document: one JSON object with three arrays.
BOOTSTRAP = T.StructType([
    T.StructField("elements", T.ArrayType(PLAYERS_RAW)),
    T.StructField("teams", T.ArrayType(TEAMS)),
    T.StructField("element_types", T.ArrayType(POSITIONS)),
])
