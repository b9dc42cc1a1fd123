"""Guarded writes, display pages and predictors by name."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import predict, quarantine, views
from test_states import PLAY, other, running


def held(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_spoilt_games_are_set_aside_whole(spark):
    plays = spark.createDataFrame(
        [
            running(1, 1, 1, "PT12M00.00S", 0, 0), running(1, 2, 1, "soon", 0, 0), running(1, 2, 1, "soon", 0, 0),
            other(2, 1, 1, "PT12M00.00S", "", ""), other(2, 2, 1, "PT11M00.00S", "", ""),
            running(3, 1, None, "PT12M00.00S", 0, 0), running(None, 1, 1, "PT12M00.00S", 0, 0),
        ],
        PLAY,
    )
    for most in (1 << 20, 1):
        done = quarantine.guarded_plays(plays, most=most)
        assert done.counts == {"kept": 2, "rejected": 5} and done.verdict == "broken rows"
        assert done.kept.columns == plays.columns and held(done.kept, "game_id", "action_id") == [(2, 1), (2, 2)]
        faults = held(done.rejected.filter("game_id IS NOT NULL"), "game_id", "order_number", "fault")
        assert faults == [(1, 1, "of a spoilt game"), (1, 2, "unreadable"), (1, 2, "unreadable"), (3, 1, "unreadable")]
        assert held(quarantine.quarantined_games(done), "game_id", "plays", "unreadable") == [(1, 3, 2), (3, 1, 1)]
    assert quarantine.guarded_plays(plays.limit(0)).verdict == "empty"
    assert quarantine.guarded_plays(plays.filter("game_id = 2")).verdict == "accept"
    assert quarantine.guarded_plays(plays.filter("game_id = 1")).verdict == "reject"


def test_display_pages_hold_players_and_plays(spark):
    display = spark.createDataFrame([(1, "A"), (2, "B")], "game_id long, home string")
    board = spark.createDataFrame(
        [(1, "home", 7, "x", 3, 9, 1), (1, "home", 8, "y", 2, 5, 2), (1, "away", 9, "z", 1, 1, 1)],
        "game_id long, side string, person_id long, name string, points int, pred_points int, place int",
    )
    pages = spark.createDataFrame([(1, 0, ["b"]), (1, 1, ["a"])], "game_id long, page int, condensed array<string>")
    got = {(r.game_id, r.page): r for r in views.game_pages(display, board, pages).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    assert [p.person_id for p in got[1, 1].home_players] == [7, 8] and [p.name for p in got[1, 0].away_players] == ["z"]
    assert got[2, 0].home_players is None and got[2, 0].condensed is None


def test_predictors_by_name(spark):
    class Fixed:
        def predict(self, features):
            return predict.with_win_probability(features.select("game_id", F.lit(100.0).alias("pred_home_score"), F.lit(90.0).alias("pred_away_score")))

    known = spark.createDataFrame([(1, 80.0, 82.0, 84.0, 86.0), (2, None, 1.0, 1.0, 1.0)], "game_id long, Home_PPG double, Home_OPP_PPG double, Away_PPG double, Away_OPP_PPG double")
    found = predict.predictors({"Fixed": Fixed()})
    assert set(found) == {"Baseline", "Fixed", "Ensemble"}
    columns = ["game_id", "pred_home_score", "pred_away_score"]
    assert held(found["Baseline"](known), *columns) == [(1, 83.0, 83.0)]
    assert held(found["Ensemble"](known), *columns) == [(1, 91.5, 86.5), (2, 100.0, 90.0)]
    assert held(predict.predictors({"Fixed": Fixed()}, ["Fixed"])["Ensemble"](known), *columns) == [(1, 100.0, 90.0), (2, 100.0, 90.0)]
    with pytest.raises(ValueError):
        predict.predictors(members=["Nobody"])
