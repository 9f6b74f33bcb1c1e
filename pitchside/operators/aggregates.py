"""Group and table-wide aggregates: distributions, filter domains, pipeline profile."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def position_distribution(active: DataFrame) -> DataFrame:
    return active.groupBy("position").agg(F.count(F.lit(1)).alias("count"))


def filter_domains(active: DataFrame) -> DataFrame:
    """Slider bounds: floor(min cost), ceiling(max cost), max minutes (one row)."""
    return active.agg(
        F.floor(F.min("cost_million")).cast("long").alias("cost_min"),
        F.ceil(F.max("cost_million")).cast("long").alias("cost_max"),
        F.max("minutes").alias("minutes_max"),
    )


def position_domain(active: DataFrame) -> DataFrame:
    return active.select("position").distinct().orderBy("position")


def team_domain(active: DataFrame) -> DataFrame:
    return active.select(F.col("TEAMS").alias("team")).distinct().orderBy("team")


def gameweek_domain(upcoming: DataFrame) -> DataFrame:
    """Sorted distinct gameweeks; ``is_default`` marks the smallest (the picker's default)."""
    weeks = upcoming.select("gameweek").distinct()
    first = weeks.select(F.min("gameweek")).scalar()
    return weeks.select("gameweek", (F.col("gameweek") == first).alias("is_default")).orderBy("gameweek")


def profile(players: DataFrame, active: DataFrame, upcoming: DataFrame,
            teams: DataFrame, positions: DataFrame) -> DataFrame:
    """Start-up diagnostics in one row: stage row counts, positions seen, gameweeks available.

    The lists are built from distinct sets whose size is bounded by the
    position dimension and the calendar, not by the number of rows. Each
    value is a scalar subquery (a global aggregate) over its own input. ``Profile`` gives the same row without reading anything again.
    """
    count = lambda df: df.select(F.count(F.lit(1))).scalar()
    positions_seen = active.select(F.concat_ws(", ", F.array_sort(F.collect_set("position")))).scalar()
    gameweeks = upcoming.select(
        F.array_join(F.array_sort(F.collect_set("gameweek")).cast("array<string>"), ", ")).scalar()
    return players.sparkSession.range(1).select(
        count(players).alias("players_rows"), count(teams).alias("teams_rows"),
        count(positions).alias("positions_rows"), count(active).alias("active_rows"),
        positions_seen.alias("positions_seen"), count(upcoming).alias("fixtures_rows"),
        gameweeks.alias("gameweeks"))


class Profile:
    """``profile`` by observation: the same row, taken in the jobs that write the tables anyway.

    ``players``, ``fixtures`` and ``dimension`` return their table with an observation on it; ``row`` waits for the jobs that run over
    these and puts their values together.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def _observe(self, df: DataFrame, name: str, *values: Column) -> DataFrame:
        self._seen[name] = Observation(f"profile-{name}-{uuid.uuid4().hex}")
        return df.observe(self._seen[name], *values)

    def players(self, players: DataFrame, is_active: Column) -> DataFrame:
        return self._observe(players, "players", F.count(F.lit(1)).alias("players_rows"), F.count_if(is_active).alias("active_rows"),
                             F.collect_set(F.when(is_active, F.col("position"))).alias("positions_seen"))

    def fixtures(self, upcoming: DataFrame) -> DataFrame:
        return self._observe(upcoming, "fixtures", F.count(F.lit(1)).alias("fixtures_rows"), F.collect_set("gameweek").alias("gameweeks"))

    def dimension(self, df: DataFrame, name: str) -> DataFrame:
        return self._observe(df, name, F.count(F.lit(1)).alias(f"{name}_rows"))

    def row(self, spark: SparkSession) -> DataFrame:
        said: dict = {}
        for observation in self._seen.values():
            said |= observation.get
        return spark.range(1).select(
            *[F.lit(said[c]).cast("long").alias(c) for c in ("players_rows", "teams_rows", "positions_rows", "active_rows")],
            F.lit(", ".join(sorted(said["positions_seen"]))).alias("positions_seen"), F.lit(said["fixtures_rows"]).cast("long").alias("fixtures_rows"),
            F.lit(", ".join(map(str, sorted(said["gameweeks"])))).alias("gameweeks"))
