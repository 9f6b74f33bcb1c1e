"""Upcoming fixtures and fixture-aware difficulty for every player in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.functions.joins import salted_lookup
from pitchside.sources import schemas


def empty_upcoming(spark: SparkSession) -> DataFrame:
    """The fixed-schema empty table used when no fixtures are available."""
    return spark.createDataFrame([], schema=schemas.UPCOMING_FIXTURES)


def upcoming_fixtures(fixtures_raw: DataFrame | None, teams: DataFrame, ordered: bool = True) -> DataFrame:
    """Unfinished fixtures with valid gameweeks and both team names, by gameweek.

    ``finished == FALSE`` drops NULL as well (R's filter does). Team names come
    from two left joins with the team dimension (broadcast when its size
    estimate is small); a missing team keeps a NULL name. ``ordered=False`` skips the final sort for consumers
    that do not need it (the difficulty resolver).
    """
    if fixtures_raw is None:
        return empty_upcoming(teams.sparkSession)
    home = teams.select(F.col("id").alias("_h_id"), F.col("name").alias("home_team"))
    away = teams.select(F.col("id").alias("_a_id"), F.col("name").alias("away_team"))
    out = (fixtures_raw.filter(~F.col("finished"))
           .join(home, F.col("team_h") == F.col("_h_id"), "left")
           .join(away, F.col("team_a") == F.col("_a_id"), "left")
           .select(F.col("id").cast("long"), F.col("event").cast("int").alias("gameweek"),
                   "home_team", "away_team", F.col("team_h_difficulty").cast("int").alias("difficulty"),
                   F.col("team_h").cast("int"), F.col("team_a").cast("int"))
           .filter(F.col("gameweek").isNotNull() & (F.col("gameweek") > 0)))
    return out.orderBy("gameweek", "id") if ordered else out


def fixture_legs(upcoming: DataFrame) -> DataFrame:
    """Each fixture as two legs ``(team_id, is_home, effective_difficulty)``.

    The away side's difficulty is ``6 - home difficulty``; the home leg sorts
    first, so a fixture with team_h = team_a resolves by the home rule. This
    turns the disjunctive ``team_h = t OR team_a = t`` match into an equi-join.
    """
    d = F.col("difficulty")
    legs = F.array(
        F.struct(F.col("team_h").alias("team_id"), F.lit(0).alias("leg"), d.alias("eff")),
        F.struct(F.col("team_a").alias("team_id"), F.lit(1).alias("leg"), (F.lit(6) - d).alias("eff")),
    )
    return upcoming.select("id", "gameweek", F.explode(legs).alias("_l")).select(
        "id", "gameweek", F.col("_l.team_id").alias("team_id"), (F.col("_l.leg") == 0).alias("is_home"),
        F.col("_l.leg").alias("leg"), F.col("_l.eff").alias("effective_difficulty"))


def target_gameweek(upcoming: DataFrame, gameweek: int | None) -> Column:
    """The gameweek to resolve: the given one, else the first upcoming one (a scalar subquery)."""
    if gameweek is not None:
        return F.lit(int(gameweek)).cast("int")
    return upcoming.select(F.min("gameweek")).scalar()


def first_fixture_per_team_week(upcoming: DataFrame) -> DataFrame:
    """Each team's first fixture in every gameweek (lowest fixture id, home leg first).

    ``min(struct(id, leg, ...))`` is an ordinary aggregate with map-side
    combine, so a team with very many fixtures costs one partial row per task
    instead of a sorted window partition. The output has one row per
    (team, gameweek).
    """
    return fixture_legs(upcoming).groupBy("team_id", "gameweek").agg(
        F.min(F.struct("id", "leg", "effective_difficulty")).alias("_first"))


def first_fixture_per_team(upcoming: DataFrame, gameweek: int | None = None, per_week: DataFrame | None = None) -> DataFrame:
    """For the target gameweek (default: the first upcoming one), each team's first fixture.

    With a given gameweek the filter is pushed below the aggregate, so only
    that week's fixtures are aggregated. The default gameweek needs the
    minimum over all fixtures first; a caller that has staged the (team,
    gameweek) aggregate, one row per team and week, passes it as ``per_week``,
    and both the minimum and the filter read it.
    """
    if per_week is None:
        per_week = first_fixture_per_team_week(upcoming)
    first = per_week.filter(F.col("gameweek") == target_gameweek(per_week, gameweek))
    return first.select(F.col("team_id").alias("_team_id"),
                        F.col("_first.id").alias("fixture_id"),
                        F.col("gameweek"),
                        F.col("_first.effective_difficulty").alias("_fixture_difficulty"))


def resolve_difficulty(players: DataFrame, upcoming: DataFrame | None, gameweek: int | None = None,
                       manual: int = K.DEFAULT_MANUAL_DIFFICULTY, per_week: DataFrame | None = None) -> DataFrame:
    """Adds ``fixture_id``, ``gameweek`` and ``fixture_difficulty`` to every player.

    A player whose team plays in the gameweek gets that fixture's difficulty
    (home: d, away: 6 - d), NULL if the fixture has none; otherwise, or with no
    fixtures or gameweek 0, the manual difficulty. ``per_week`` may pass in
    ``first_fixture_per_team_week(upcoming)`` already staged. The few teams are
    hot keys, so the match is salted by player.
    """
    manual_col = F.lit(int(manual)).cast("int")
    if upcoming is None or gameweek == 0:
        return players.select("*", F.lit(None).cast("long").alias("fixture_id"),
                              F.lit(None).cast("int").alias("gameweek"),
                              manual_col.alias("fixture_difficulty"))
    per_team = first_fixture_per_team(upcoming, gameweek, per_week)
    joined = salted_lookup(players, per_team, "team", "_team_id", "id")
    return joined.select(*[F.col(c) for c in players.columns], "fixture_id", "gameweek",
                         F.when(F.col("fixture_id").isNotNull(), F.col("_fixture_difficulty"))
                         .otherwise(manual_col).alias("fixture_difficulty"))
