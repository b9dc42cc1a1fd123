"""Landed JSON: files, missing parts, fallbacks, positional rows, written logs."""

import json

from pyspark.sql import functions as F

from matchlake.sources import payloads as p


def texts(spark, *documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "game_id int, payload string")


def test_plays_from_files(spark, tmp_path):
    play = {"orderNumber": 7, "period": 1, "clock": "PT11M00.00S", "scoreHome": "2", "unknown": {"x": 1}}
    (tmp_path / "a.json").write_text(json.dumps({"game": {"actions": [play, {"actionId": 3}]}}))
    rows = p.read_payloads(spark, str(tmp_path), p.PLAYS_SCHEMA).withColumn("game_id", F.lit(1))
    got = [(r.order_number, r.action_id, r.score_home, r.description) for r in p.flatten_plays(rows).collect()]
    assert sorted(got, key=str) == [(7, None, "2", None), (None, 3, None, None)]


def test_fallback_only_for_failures(spark):
    def given(*numbers):
        return {"game": {"actions": [{"orderNumber": n} for n in numbers]}}

    first = p.parse_payloads(texts(spark, given(1), "oops", given(), {"other": 1}), p.PLAYS_SCHEMA)
    second = p.parse_payloads(texts(spark, given(9), given(8), given(7), given(6)), p.PLAYS_SCHEMA)
    got = p.flatten_plays(p.with_fallback(first, second)).select("game_id", "order_number").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 8), (3, 6)]


def test_schedule(spark):
    games = [
        {"gameId": "0022400001", "gameStatus": 3, "gameDateTimeEst": "2024-10-22T19:30:00Z",
         "homeTeam": {"teamTricode": "AAA", "teamId": 1}, "awayTeam": {"teamTricode": "BBB"}},
        {"gameId": "0012400001", "gameStatus": 9, "gameDateTimeEst": "2024-10-04T19:30:00Z",
         "homeTeam": {"teamTricode": None}, "awayTeam": {}},
    ]
    body = {"leagueSchedule": {"gameDates": [{"games": games[:1]}, {"games": games[1:]}, {"games": []}]}}
    rows = p.parse_payloads(texts(spark, body).withColumn("season", F.lit("2024-2025")), p.SCHEDULE_SCHEMA)
    got = sorted(map(tuple, p.flatten_schedule(rows).collect()))
    assert got == [
        ("0012400001", "2024-10-04T19:30:00Z", None, None, "Unknown", "2024-2025", "Pre Season"),
        ("0022400001", "2024-10-22T19:30:00Z", "AAA", "BBB", "Completed", "2024-2025", "Regular Season"),
    ]


def box(score=None):
    def team(i, players):
        return {"teamId": i, "teamTricode": f"T{i}", "score": score, "statistics": {"points": 100 + i, "assists": 20},
                "players": players}

    player = {"personId": 5, "firstName": " Al", "familyName": "Bo ", "name": "A. Bo", "position": "G",
              "statistics": {"minutes": "12:30", "points": 9, "reboundsOffensive": 2}}
    return {"homeTeam": team(1, [player, {"personId": 6, "statistics": {}}]), "awayTeam": team(2, [])}


def test_box_formats(spark):
    done = p.parse_payloads(texts(spark, {"boxScoreTraditional": box()}, {"nothing": 1}), p.BOX_SCHEMA)
    team = sorted((r.team_id, r.pts, r.pts_allowed, r.ast, r.reb) for r in p.team_stats(done).collect())
    assert team == [("1", 101, 102, 20, None), ("2", 102, 101, 20, None)]
    players = {r.player_id: r for r in p.player_stats(done).collect()}
    assert (players[5].player_name, players[5].min, players[5].oreb, players[5].team_id) == ("Al Bo", 12.5, 2, "1")
    assert (players[6].player_name, players[6].position, players[6].pts) == ("", None, None)
    live = p.parse_payloads(texts(spark, {"game": box(33)}, {"game": box()}), p.LIVE_BOX_SCHEMA)
    assert sorted((r.game_id, r.team_id, r.pts, r.pts_allowed) for r in p.team_stats(live, live=True).collect()) == [
        (0, "1", 33, 33), (0, "2", 33, 33), (1, "1", 0, 0), (1, "2", 0, 0),
    ]
    named = {(r.game_id, r.player_id): (r.player_name, r.position) for r in p.player_stats(live, live=True).collect()}
    assert named[0, 5] == ("A. Bo", "G") and named[0, 6] == ("", "")


def test_rowset(spark):
    row = [76001, "Last, First", "First Last", 1, "1990", "1994", "x", 0, "c", "a", "b", "Team"]
    body = {"resultSets": [{"rowSet": [row, [5, "Solo", "Solo", 0, "1", "2"]]}]}
    got = sorted(map(tuple, p.players_from_rowset(p.parse_payloads(texts(spark, body), p.ROWSET_SCHEMA)).collect()))
    assert got == [
        (5, "", "Solo", "Solo", "1", "2", 0, None),
        (76001, "First", "Last", "First Last", "1990", "1994", 1, "Team"),
    ]


def test_quarantine_appends(spark, tmp_path):
    path = str(tmp_path / "failed")
    rows = spark.createDataFrame([("t", 1, "a, b")], "moment string, game_id int, error string")
    p.append_quarantine(rows, path)
    p.append_quarantine(rows, path)
    assert [r.error for r in spark.read.option("header", True).csv(path).collect()] == ["a, b"] * 2
