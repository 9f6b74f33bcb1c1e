"""Landed JSON documents, the empty-fixtures fallback, the sink and the streaming refresh."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import FIXTURES, PLAYERS, POSITIONS, TEAMS
from pitchside.operators.players import build_players
from pitchside.sources import json_docs, schemas
from pitchside.sources import landing as zone
from pitchside.sources.json_docs import (load_upcoming, parse_elements, read_bootstrap, read_fixtures,
                                         to_json_lines)
from pitchside.sources.sinks import expire, publish, read_published, versions
from pitchside.streaming.snapshots import latest_players, start_player_refresh

PLAYER_KEYS = [f.name for f in schemas.PLAYERS_RAW.fields]


def _doc(players):
    return {"elements": [dict(zip(PLAYER_KEYS, p)) for p in players],
            "teams": [{"id": i, "name": n} for i, n in TEAMS],
            "element_types": [{"id": i, "singular_name": n} for i, n in POSITIONS]}


@pytest.fixture()
def landing():
    root = tempfile.mkdtemp(prefix="pitchside-landing-")
    os.makedirs(os.path.join(root, "bootstrap"))
    with open(os.path.join(root, "bootstrap", "snap-1.json"), "w") as fh:
        json.dump(_doc(PLAYERS[:6]), fh, indent=2)
    with open(os.path.join(root, "bootstrap", "snap-2.json"), "w") as fh:
        json.dump(_doc(PLAYERS[6:]), fh, indent=2)
    keys = ["id", "event", "finished", "team_h", "team_a", "team_h_difficulty"]
    with open(os.path.join(root, "fixtures.json"), "w") as fh:
        json.dump([dict(zip(keys, f)) for f in FIXTURES], fh, indent=2)
    return root


def test_bootstrap_documents(spark, landing):
    players, teams, positions = read_bootstrap(spark, os.path.join(landing, "bootstrap"))
    assert players.count() == 12 and teams.count() == 3 and positions.count() == 4
    built = {r.id: r for r in build_players(players, teams, positions).collect()}
    assert built[7].TEAMS == "Unknown" and built[4].cost_pretty == "£10.0"


def test_json_lines_roundtrip(spark, league):
    back = parse_elements(to_json_lines(league["players_raw"]))
    assert sorted(back.collect()) == sorted(league["players_raw"].collect())
    broken = spark.createDataFrame([("{not json",)], "value string")
    assert parse_elements(broken, mode="PERMISSIVE").first().id is None
    with pytest.raises(Exception, match="(?i)malformed"):
        parse_elements(broken).collect()


def test_missing_players_source_is_fatal(spark, landing):
    with pytest.raises(FileNotFoundError):
        read_bootstrap(spark, os.path.join(landing, "nothing-here"))


def test_latest_snapshot_wins(spark, landing):
    path = os.path.join(landing, "bootstrap", "snap-3.json")
    changed = [(*PLAYERS[0][:6], 999, *PLAYERS[0][7:])]
    with open(path, "w") as fh:
        json.dump({**_doc(changed), "teams": [{"id": 1, "name": "Renamed"}]}, fh)
    later = os.stat(path).st_mtime + 60
    os.utime(path, (later, later))
    players, teams, positions = read_bootstrap(spark, os.path.join(landing, "bootstrap"))
    assert players.count() == 12 and players.filter("id = 1").first().total_points == 999
    assert {r.id: r.name for r in teams.collect()}[1] == "Renamed" and teams.count() == 3 and positions.count() == 4


def test_malformed_or_empty_players_source_is_fatal(spark, landing):
    broken = os.path.join(landing, "broken")
    os.makedirs(broken)
    with open(os.path.join(broken, "a.json"), "w") as fh:
        fh.write(json.dumps(_doc(PLAYERS))[:-40])
    with pytest.raises(ValueError, match="malformed"):
        read_bootstrap(spark, broken)
    empty = os.path.join(landing, "empty")
    os.makedirs(empty)
    with pytest.raises(ValueError, match="no document"):
        read_bootstrap(spark, empty)


def test_malformed_fixtures_are_reported(spark, landing):
    path = os.path.join(landing, "fixtures-broken.json")
    with open(path, "w") as fh:
        fh.write('[{"id": 1, "event": ')
    with pytest.warns(UserWarning, match="malformed"):
        assert read_fixtures(spark, path).count() == 0


def test_fixtures_document_and_fallback(spark, landing):
    raw = read_fixtures(spark, os.path.join(landing, "fixtures.json"))
    assert raw.count() == 7
    teams = spark.createDataFrame(TEAMS, schema=schemas.TEAMS)
    assert {r.id for r in load_upcoming(spark, os.path.join(landing, "fixtures.json"), teams).collect()} == \
        {103, 104, 105, 106}
    empty = load_upcoming(spark, os.path.join(landing, "missing.json"), teams)
    assert empty.count() == 0 and empty.schema == schemas.UPCOMING_FIXTURES


def test_landed_league_runs_the_catalog(spark, landing):
    from pitchside.plans.catalog import QUERIES, LandedLeague
    lg = LandedLeague(spark, os.path.join(landing, "bootstrap"), os.path.join(landing, "fixtures.json"))
    assert {r.id for r in QUERIES["active_players"](lg).collect()} == {1, 2, 3, 4, 7, 11}
    assert QUERIES["elite_squad"](lg).count() == 6
    pred = {r.id: r.fixture_difficulty for r in QUERIES["predict"](lg).collect()}
    assert pred[1] == 2 and pred[7] == 3
    missing = LandedLeague(spark, os.path.join(landing, "bootstrap"), os.path.join(landing, "none.json"))
    assert {r.fixture_difficulty for r in QUERIES["predict"](missing).collect()} == {3}


def test_publish_roundtrip(spark, scratch_dir, league):
    out = os.path.join(scratch_dir, "published")
    publish(league["teams"], out, partition_by=["id"])
    assert sorted(r.name for r in read_published(spark, out).collect()) == ["Alpha", "Bravo", "Charlie"]


def test_publish_gives_whole_versions(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="pitchside-published-"), "table")
    with pytest.raises(FileNotFoundError):
        read_published(spark, out)
    rows = lambda n: spark.range(n).repartition(4)
    assert publish(rows(10), out) == 1
    held = read_published(spark, out)
    assert publish(rows(20), out) == 2
    # A reader that has version 1 in its hands keeps all of it; a new reader has all of version 2; the old one can be named.
    assert (held.count(), read_published(spark, out).count(), read_published(spark, out, 1).count()) == (10, 20, 10)
    # A write that dies half way leaves the table as it was, and its files are no version's.
    dies = rows(40).select(F.when(F.col("id") == 39, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="dies"):
        publish(dies, out)
    assert read_published(spark, out).count() == 20 and [v["number"] for v in versions(spark, out)] == [1, 2]
    # A new version may have other columns; an empty one keeps its columns.
    publish(rows(5).withColumn("x", F.lit(1.5)), out, fmt="json")
    assert read_published(spark, out).dtypes == [("id", "bigint"), ("x", "double")] and read_published(spark, out).count() == 5
    publish(spark.createDataFrame([], "a int"), out, fmt="csv")
    assert read_published(spark, out).count() == 0 and read_published(spark, out).columns == ["a"]
    assert [v["number"] for v in versions(spark, out)] == [2, 3, 4]   # the last three stay
    expire(spark, out, keep=1, orphan_hours=0)
    assert [v["number"] for v in versions(spark, out)] == [4]
    assert len([n for n in os.listdir(out) if n.startswith("data-")]) == 1


def test_publishers_at_once_both_publish(spark, monkeypatch):
    from pitchside.sources import sinks
    out = os.path.join(tempfile.mkdtemp(prefix="pitchside-published-"), "table")
    publish(spark.range(1), out)
    monkeypatch.setattr(sinks, "_newest", lambda s, p: 0)   # as if this writer had looked before the other was done
    assert publish(spark.range(2), out, keep=0) == 2


def landed_players(spark, root, rows, kind="snapshot", rows_per_document=3):
    frame = lambda data, schema: spark.createDataFrame(data, schema=schema)
    dims = kind == "snapshot"
    return json_docs.land_bootstrap(frame(rows, schemas.PLAYERS_RAW), frame(TEAMS if dims else [], schemas.TEAMS),
                                    frame(POSITIONS if dims else [], schemas.POSITIONS), root, kind, rows_per_document)


def test_newest_complete_snapshot_is_read_alone(spark):
    root = tempfile.mkdtemp(prefix="pitchside-land-")
    with pytest.raises(FileNotFoundError):
        read_bootstrap(spark, os.path.join(root, "none"))
    assert landed_players(spark, root, PLAYERS) == 1
    assert len(zone.current(spark, root)[0].paths) > 2   # one snapshot, several documents
    assert landed_players(spark, root, PLAYERS[:9]) == 2
    ids = lambda **kw: sorted(r.id for r in read_bootstrap(spark, root, **kw)[0].collect())
    assert ids() == list(range(1, 10))           # players 10 to 12 have left
    assert ids(upto=1) == list(range(1, 13))     # as of the first
    # a third generation without a manifest, and one that has lost a document, are not there
    zone.write_documents(spark.createDataFrame([("{",)], "value string"), root, "snapshot", 3)
    assert landed_players(spark, root, PLAYERS[:3]) == 3
    os.remove(zone.current(spark, root)[0].paths[0].removeprefix("file:"))
    assert ids() == list(range(1, 10))
    players, teams, positions = read_bootstrap(spark, root)
    assert teams.count() == 3 and positions.count() == 4
    # changes add to the newest snapshot, the newest row of an id wins
    landed_players(spark, root, [(*PLAYERS[0][:6], 999, *PLAYERS[0][7:]), PLAYERS[11]], "changes")
    got = {r.id: r.total_points for r in read_bootstrap(spark, root)[0].collect()}
    assert sorted(got) == [*range(1, 10), 12] and got[1] == 999 and got[2] == 150
    zone.expire(spark, root)
    assert ids() == [*range(1, 10), 12]
    with pytest.raises(FileNotFoundError):   # the state before is gone
        read_bootstrap(spark, root, upto=1)


def test_fixtures_over_snapshots(spark, league):
    root = tempfile.mkdtemp(prefix="pitchside-land-")
    rows = [(1, 2, False, 1, 2, 3), (2, 2, False, 1, 2, 3), (3, 2, False, 2, 3, 4), (4, 3, False, 3, 1, 1)]
    land = lambda r, kind="snapshot": json_docs.land_fixtures(spark.createDataFrame(r, schema=schemas.FIXTURES_RAW), root, kind, 2)
    land(rows)
    land([(1, 2, True, 1, 2, 3), (2, 5, False, 1, 2, 3), (4, 3, False, 3, 1, 1)])    # 1 finished, 2 moved, 3 withdrawn
    upcoming = lambda: sorted((r.gameweek, r.id, r.difficulty) for r in load_upcoming(spark, root, league["teams"]).collect())
    assert upcoming() == [(3, 4, 1), (5, 2, 3)]
    land([(4, 3, False, 3, 1, 5)], "changes")
    land([(4, 4, False, 3, 1, 2), (9, 6, False, 1, 3, 2)], "changes")
    assert upcoming() == [(4, 4, 2), (5, 2, 3), (6, 9, 2)]
    land(rows[:0])   # a complete snapshot of nothing
    assert upcoming() == []
    plain = tempfile.mkdtemp(prefix="pitchside-land-")   # plain documents: one row per id, the newest
    keys = ["id", "event", "finished", "team_h", "team_a", "team_h_difficulty"]
    for n, fixtures in enumerate((rows[:2], [(2, 5, False, 1, 2, 3)])):
        path = os.path.join(plain, f"{n}.json")
        with open(path, "w") as fh:
            json.dump([dict(zip(keys, f)) for f in fixtures], fh)
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    assert sorted((r.id, r.event) for r in read_fixtures(spark, plain).collect()) == [(1, 2), (2, 5)]


def test_documents_follow_the_rows(spark, league):
    many = spark.range(1000).selectExpr("id", "CAST(1 AS INT) AS event", "false AS finished", "1 AS team_h", "2 AS team_a", "3 AS team_h_difficulty")
    root = tempfile.mkdtemp(prefix="pitchside-land-")
    json_docs.land_fixtures(many, root, rows_per_document=50)
    paths = zone.current(spark, root)[0].paths
    assert len(paths) == 20 and max(os.path.getsize(p) for p in paths) < 3 * min(os.path.getsize(p) for p in paths)
    assert read_fixtures(spark, root).count() == 1000


def test_streaming_refresh_takes_whole_snapshots(spark):
    root = tempfile.mkdtemp(prefix="pitchside-land-")
    out, progress = os.path.join(root, "players-live"), os.path.join(root, "progress")

    def refresh(**options):
        start_player_refresh(spark, os.path.join(root, "in"), out, None, progress, available_now=True, **options).awaitTermination()
        return latest_players(spark, out)

    many = [(i, f"F{i}", *PLAYERS[0][2:]) for i in range(1, 151)]
    landed_players(spark, os.path.join(root, "in"), many, rows_per_document=40)
    assert len(zone.current(spark, os.path.join(root, "in"))[0].paths) == 4
    first = refresh()
    assert first.count() == 150 and {r.generation for r in first.collect()} == {1}
    zone.write_documents(spark.createDataFrame([("{}",)], "value string"), os.path.join(root, "in"), "snapshot", 2)   # never complete
    assert refresh().count() == 150
    landed_players(spark, os.path.join(root, "in"), many[:100])
    landed_players(spark, os.path.join(root, "in"), [(*many[0][:6], 999, *many[0][7:])], "changes")
    live = refresh(max_per_trigger=5)
    assert live.count() == 100 and live.filter("total_points = 999").count() == 1 and {r.generation for r in live.collect()} == {3}
