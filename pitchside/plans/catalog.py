"""

``League`` derives the league tables from a scale-factor directory once per
instance, lazily: the player and feature tables are staged (written to the
checkpoint folder) the first time a query uses them, everything else is a
plan. Every query is a function ``League -> DataFrame``; ``queries()`` adapts
them to ``(spark, sf_dir)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchside.functions import constants as K
from pitchside.operators import (aggregates, cards, classify, explain, features, filters, fixtures, players,
                                 predict, rankings, stats, timeseries)
from pitchside.plans.oracle import CHECK_DIGITS
from pitchside.sources import json_docs, landing, sinks, testdata
from pitchside.sources.stage import Staging
from pitchside.streaming import snapshots


class League:
    """The league tables for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str, lazy: bool = False):
        """``lazy``: derived tables stay plans, for a query that reads them once, so its columns prune every scan."""
        self.spark = spark
        self.sf_dir = sf_dir
        self._staging = Staging()
        self._profile = aggregates.Profile()
        self._lazy = lazy

    def close(self) -> None:
        """Remove the tables this league has staged; its queries' results can no longer be read."""
        self._staging.close()

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        return df if self._lazy else self._staging.stage(df, name)

    # ---- inputs (stand-in tables) -------------------------------------------------
    @cached_property
    def players_raw(self) -> DataFrame:
        return testdata.players_raw(self.spark, self.sf_dir)

    @cached_property
    def teams(self) -> DataFrame:
        return testdata.teams(self.spark, self.sf_dir)

    @cached_property
    def positions(self) -> DataFrame:
        return testdata.positions(self.spark)

    @cached_property
    def fixtures_raw(self) -> DataFrame:
        return testdata.fixtures_raw(self.spark, self.sf_dir)

    @cached_property
    def player_points(self) -> DataFrame:
        return testdata.player_points(self.spark, self.sf_dir)

    # ---- derived tables -----------------------------------------------------------
    @cached_property
    def players(self) -> DataFrame:
        """Staged once: every scalar branch (widths, quantiles, team means) re-reads it. The profile's counts are taken on the way."""
        seen = self._profile
        built = players.build_players(self.players_raw, seen.dimension(self.teams, "teams"), seen.dimension(self.positions, "positions"))
        return self._stage(seen.players(built, players.is_active()), "players")

    @cached_property
    def players_v1(self) -> DataFrame:
        return self._stage(players.build_players(self.players_raw, self.teams, self.positions, variant="v1"), "players_v1")

    @cached_property
    def active(self) -> DataFrame:
        return players.active_players(self.players)

    @cached_property
    def active_v1(self) -> DataFrame:
        return players.active_players(self.players_v1, K.ACTIVE_MIN_MINUTES_V1, require_form=False)

    @cached_property
    def features(self) -> DataFrame:
        """Staged once: correlation, histograms, box statistics and explanations re-read it."""
        return self._stage(features.build_features(self.active, means=self.team_means), "features")

    @cached_property
    def team_means(self) -> DataFrame:
        """Staged: one row per team, so the planner knows its true size."""
        return self._stage(features.team_means(self.active), "team-means")

    @cached_property
    def upcoming(self) -> DataFrame:
        return fixtures.upcoming_fixtures(self.fixtures_raw, self.teams, ordered=False)

    @cached_property
    def fixtures_per_week(self) -> DataFrame:
        """Staged: one row per team and week; the default gameweek's minimum and the match both read it."""
        return self._stage(fixtures.first_fixture_per_team_week(self._profile.fixtures(self.upcoming)), "fixtures-per-week")

    def profile(self) -> DataFrame:
        """Start-up diagnostics, observed while the player table and the weekly fixtures were staged."""
        self.players, self.fixtures_per_week  # noqa: B018  (stages them unless they are)
        return self._profile.row(self.spark)

    # ---- stand-in sources: the same tables through the landed-document and publishing paths -------
    def _folder(self, name: str) -> str:
        return self._staging.folder(self.spark, name)

    @cached_property
    def landed(self) -> str:
        """A landing folder of players: an older snapshot with other points and players who left since, the current one, and one that never became complete."""
        path, raw = self._folder("landing"), self.players_raw
        left = raw.filter("id % 10 = 0").withColumn("id", F.col("id") + 1_000_000_000)
        older = raw.withColumn("total_points", F.col("total_points") + 7).unionByName(left)
        json_docs.land_bootstrap(older, self.teams, self.positions, path)
        json_docs.land_bootstrap(raw, self.teams, self.positions, path)
        landing.write_documents(json_docs.bootstrap_documents(older, self.teams, self.positions), path, landing.SNAPSHOT, 3)
        return path

    def players_from_documents(self) -> DataFrame:
        return players.build_players(*json_docs.read_bootstrap(self.spark, self.landed, staging=self._staging))

    def players_after_changes(self) -> DataFrame:
        """A snapshot, a newer one without the players who left, then changes of some players' points."""
        path, raw = self._folder("landing"), self.players_raw
        json_docs.land_bootstrap(raw, self.teams, self.positions, path)
        stayed = raw.filter("id % 7 <> 0")
        json_docs.land_bootstrap(stayed, self.teams, self.positions, path)
        changed = stayed.filter("id % 5 = 1").withColumn("total_points", F.col("total_points") + 10)
        json_docs.land_bootstrap(changed, self.teams.limit(0), self.positions.limit(0), path, kind=landing.CHANGES)
        return players.build_players(*json_docs.read_bootstrap(self.spark, path, staging=self._staging))

    def streamed_players(self) -> DataFrame:
        """The player table as the stream over the landing folder publishes it, all that has landed being done."""
        out = self._folder("streamed")
        query = snapshots.start_player_refresh(self.spark, self.landed, out, query_name=None, checkpoint_location=self._folder("stream"),
                                               available_now=True)
        query.awaitTermination()
        return snapshots.latest_players(self.spark, out)

    def fixtures_from_document(self) -> DataFrame:
        path = self._folder("fixtures-document")
        json_docs.land_fixtures(self.fixtures_raw, path)
        return json_docs.load_upcoming(self.spark, path, self.teams, self._staging)

    def fixtures_after_changes(self) -> DataFrame:
        """Upcoming fixtures after a second snapshot (some finished, some moved, some withdrawn) and changes of difficulty."""
        path, raw = self._folder("fixtures-landing"), self.fixtures_raw
        json_docs.land_fixtures(raw, path)
        later = raw.filter("id % 9 <> 0").withColumn("finished", F.col("finished") | (F.col("id") % 4 == 0)) \
            .withColumn("event", F.when(F.col("id") % 6 == 1, F.col("event") + 1).otherwise(F.col("event")))
        json_docs.land_fixtures(later, path)
        harder = later.filter("id % 13 = 2").withColumn("team_h_difficulty", F.lit(5))
        json_docs.land_fixtures(harder, path, kind=landing.CHANGES)
        return json_docs.load_upcoming(self.spark, path, self.teams, self._staging)

    def published_players(self) -> DataFrame:
        """Published twice; readers follow the newest version."""
        path = self._folder("published")
        sinks.publish(self.players.withColumn("total_points", F.col("total_points") + 7), path)
        sinks.publish(self.players, path)
        return sinks.read_published(self.spark, path)


class LandedLeague(League):
    """The same tables from landed documents: bootstrap snapshots and a fixtures list.

    Every query in ``QUERIES`` runs on it unchanged except ``rolling_form``,
    which needs a weekly points table (``player_points``, passed in).
    """

    def __init__(self, spark: SparkSession, bootstrap_path: str, fixtures_path: str,
                 player_points: DataFrame | None = None):
        super().__init__(spark, sf_dir="")
        self._bootstrap = json_docs.read_bootstrap(spark, bootstrap_path, staging=self._staging)
        self._fixtures_path = fixtures_path
        self._points = player_points

    @cached_property
    def players_raw(self) -> DataFrame:
        return self._bootstrap[0]

    @cached_property
    def teams(self) -> DataFrame:
        return self._bootstrap[1]

    @cached_property
    def positions(self) -> DataFrame:
        return self._bootstrap[2]

    @cached_property
    def fixtures_raw(self) -> DataFrame | None:
        return json_docs.read_fixtures(self.spark, self._fixtures_path, staging=self._staging)

    @cached_property
    def upcoming(self) -> DataFrame:
        return fixtures.upcoming_fixtures(self.fixtures_raw, self.teams, ordered=False)

    @cached_property
    def player_points(self) -> DataFrame:
        if self._points is None:
            raise ValueError("rolling form needs a player_points table (player_id, week, points)")
        return self._points


def best_at_position_pairs(active: DataFrame) -> DataFrame:
    """Comparison pairs: every active player against the top scorer of their position.

    The top scorer per position comes from a row_number filtered by a literal
    (a partial WindowGroupLimit: one row per position per task crosses the shuffle).
    That table has one row per distinct position, and positions are the position
    dimension's names or "Unknown", so it is bounded by the dimension and is
    broadcast: the players are never shuffled by their few, hot position keys.
    """
    w = Window.partitionBy("position").orderBy(F.desc("total_points"), F.asc("id"))
    best = (active.select("position", "id", "total_points").withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= 1).select(F.col("position").alias("_pos"), F.col("id").alias("player2_id")))
    # v1 keeps players without a position; they are compared among themselves.
    return active.select("position", F.col("id").alias("player1_id")) \
        .join(F.broadcast(best), F.col("position").eqNullSafe(F.col("_pos"))).select("player1_id", "player2_id")


def _players_cols(df: DataFrame) -> DataFrame:
    return df.select("id", "first_name", "second_name", "team", "element_type", "now_cost", "TEAMS", "position",
                     "cost_million", "cost_pretty", "value", "full_name", "form_numeric",
                     "points_per_game_numeric", "influence_numeric", "creativity_numeric", "threat_numeric",
                     "ict_index_numeric", "selected_by_percent", "minutes", "total_points", "goals_scored",
                     "assists", "clean_sheets")


def _players_v1_cols(df: DataFrame) -> DataFrame:
    return df.select("id", "team", "element_type", "now_cost", "TEAMS", "position", "cost_million",
                     "cost_pretty", "value", "full_name", "total_points", "minutes")


QUERIES: dict[str, Callable[[League], DataFrame]] = {
    # sources, players, filters
    "players": lambda L: _players_cols(L.players),
    "players_v1": lambda L: _players_v1_cols(L.players_v1),
    "players_from_json": lambda L: _players_cols(players.build_players(
        json_docs.parse_elements(json_docs.to_json_lines(L.players_raw)), L.teams, L.positions)),
    "active_players": lambda L: _players_cols(L.active),
    "active_players_v1": lambda L: _players_v1_cols(L.active_v1),
    "dashboard_filter_position": lambda L: _players_cols(filters.dashboard_filter(L.active, position="Midfielder")),
    "dashboard_filter_team_cost": lambda L: _players_cols(
        filters.dashboard_filter(L.active, team="NATION_7", max_cost=10.0)),
    "dashboard_filter_all": lambda L: _players_cols(
        filters.dashboard_filter(L.active, position="Defender", team="NATION_1", max_cost=15.0, min_minutes=500)),
    "points_vs_cost": lambda L: filters.points_vs_cost(L.active),
    "points_vs_cost_v1": lambda L: filters.points_vs_cost(L.active_v1, variant="v1"),
    # rankings
    "top_value": lambda L: rankings.top_value(filters.dashboard_filter(L.active)),
    "top_value_filtered": lambda L: rankings.top_value(
        filters.dashboard_filter(L.active, position="Forward", max_cost=8.0, min_minutes=300)),
    "top_value_v1": lambda L: rankings.top_value(L.active_v1, variant="v1"),
    "feature_leaders": lambda L: rankings.feature_leaders(L.features),
    "team_points": lambda L: rankings.team_points(L.active),
    "top_teams": lambda L: rankings.top_teams(L.active),
    "team_squad": lambda L: rankings.team_squad(L.active),
    "team_squad_one": lambda L: rankings.team_squad(L.active, team="NATION_3"),
    "team_squad_v1": lambda L: rankings.team_squad(L.active_v1, variant="v1"),
    "elite_squad": lambda L: rankings.elite_squad(L.active),
    "elite_squad_union": lambda L: rankings.elite_squad_union(L.active),
    # aggregates and domains
    "position_distribution": lambda L: aggregates.position_distribution(L.active),
    "filter_domains": lambda L: aggregates.filter_domains(L.active),
    "position_domain": lambda L: aggregates.position_domain(L.active),
    "team_domain": lambda L: aggregates.team_domain(L.active),
    "gameweek_domain": lambda L: aggregates.gameweek_domain(L.upcoming),
    "profile": lambda L: L.profile(),
    # features
    "feature_scalars": lambda L: features.table_statistics(L.active),
    "features": lambda L: L.features,
    # fixtures and prediction
    "upcoming_fixtures": lambda L: fixtures.upcoming_fixtures(L.fixtures_raw, L.teams),
    "fixture_difficulty": lambda L: fixtures.resolve_difficulty(L.active, L.upcoming, per_week=L.fixtures_per_week).select(
        "id", "team", "fixture_id", "gameweek", "fixture_difficulty"),
    "predict": lambda L: predict.predict(L.active, L.upcoming, per_week=L.fixtures_per_week),
    "predict_gameweek": lambda L: predict.predict(L.active, L.upcoming, gameweek=20),
    "predict_no_fixtures": lambda L: predict.predict(L.active, json_docs.load_upcoming(L.spark, L._folder("no-fixtures"), L.teams)),
    "predict_manual": lambda L: predict.predict(L.active, None, manual=2),
    "prediction_card": lambda L: predict.prediction_card(predict.predict(L.active, L.upcoming, per_week=L.fixtures_per_week)),
    "prediction_card_manual": lambda L: predict.prediction_card(predict.predict(L.active, None, manual=2)),
    "difficulty_sweep": lambda L: predict.difficulty_sweep(L.active),
    # cards and explanations
    "radar": lambda L: cards.radar(L.active),
    "radar_v1": lambda L: cards.radar(L.active_v1, variant="v1"),
    "compare": lambda L: cards.compare(L.active, best_at_position_pairs(L.active)),
    "compare_v1": lambda L: cards.compare(L.active_v1, best_at_position_pairs(L.active_v1), variant="v1"),
    "decision_path": lambda L: explain.decision_path(L.features),
    "local_contributions": lambda L: explain.local_contributions(L.features),
    "classify_rules": lambda L: classify.classify_rules(L.features),
    "rule_metrics": lambda L: classify.evaluate(classify.rule_predictions(L.features)),
    # lookups by name, and one without a match
    "lookup_by_name": lambda L: _players_cols(filters.lookup_players(L.active, names=["Customer 000000007", "Customer 000000011"])),
    "lookup_no_match": lambda L: _players_cols(filters.lookup_players(L.active, names=["Nobody"])),
    "radar_one": lambda L: cards.radar(L.active, names=["Customer 000000007"]),
    "decision_path_one": lambda L: explain.decision_path(L.features, names=["Customer 000000007"]),
    "prediction_card_one": lambda L: predict.prediction_card(
        predict.predict(L.active, L.upcoming, per_week=L.fixtures_per_week), names=["Customer 000000007"]),
    "difficulty_sweep_one": lambda L: predict.difficulty_sweep(L.active, ids=[7, 11]),
    "local_contributions_one": lambda L: explain.local_contributions(L.features, names=["Customer 000000007"]),
    "classify_rules_one": lambda L: classify.classify_rules(L.features, names=["Customer 000000007"]),
    "compare_named": lambda L: cards.compare(L.active, cards.named_pairs(
        L.active, [("Customer 000000007", "Customer 000000011"), ("Customer 000000011", "Nobody")])),
    # the older table's variants
    "elite_squad_v1": lambda L: rankings.elite_squad(L.active_v1),
    "position_distribution_v1": lambda L: aggregates.position_distribution(L.active_v1),
    "top_teams_v1": lambda L: rankings.top_teams(L.active_v1),
    "dashboard_filter_v1": lambda L: _players_v1_cols(
        filters.dashboard_filter(L.active_v1, position="Midfielder", max_cost=12.0, min_minutes=700)),
    "filter_domains_v1": lambda L: aggregates.filter_domains(L.active_v1),
    # landed documents and the published table
    "players_from_documents": lambda L: _players_cols(L.players_from_documents()),
    "players_after_changes": lambda L: _players_cols(L.players_after_changes()),
    "streamed_players": lambda L: _players_cols(L.streamed_players()),
    "fixtures_from_document": lambda L: L.fixtures_from_document(),
    "fixtures_after_changes": lambda L: L.fixtures_after_changes(),
    "published_players": lambda L: _players_cols(L.published_players()),
    # statistics
    "feature_correlation": lambda L: stats.feature_correlation(L.features),
    "feature_histogram": lambda L: stats.feature_histogram(L.features),
    "feature_box": lambda L: stats.feature_box(L.features),
    # time series
    "rolling_form": lambda L: timeseries.rolling_form(L.player_points),
    # trained models (no SQL oracle: rows-only check)
    "classifier_metrics": lambda L: classify.train_classifiers(L.features)["metrics"],
    "trained_scores": lambda L: classify.train_classifiers(L.features)["predictions"],
    "feature_importance": lambda L: classify.train_classifiers(L.features)["importances"],
}


def for_check(df: DataFrame, digits: int = CHECK_DIGITS) -> DataFrame:
    """Round double columns half-to-even for the cross-engine comparison (operators keep full precision)."""
    return df.select(*[F.bround(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


#: Queries that read their table in one branch: nothing is staged for them, and their columns reach the scans.
ONE_BRANCH = {"position_distribution", "position_domain", "team_domain", "filter_domains", "team_points", "top_teams", "team_squad",
              "team_squad_one", "elite_squad", "upcoming_fixtures", "position_distribution_v1", "top_teams_v1", "filter_domains_v1",
              "team_squad_v1", "elite_squad_v1", "predict_manual", "difficulty_sweep", "lookup_no_match"}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(name, fn):
        return lambda spark, sf_dir: for_check(fn(League(spark, sf_dir, lazy=name in ONE_BRANCH)))
    return {name: bind(name, fn) for name, fn in QUERIES.items()}
