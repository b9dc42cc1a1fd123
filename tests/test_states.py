"""Play lists → states, on hand-built games and on a game cut into ranges."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import states as s
from matchlake.operators.scan import range_cuts

PLAY = (
    "game_id long, order_number long, action_id long, period int, clock string, score_home string, "
    "score_away string, description string, team_tricode string, person_id long, player_name string, "
    "points_total int, sub_type string"
)


def running(game, n, period, clock, home, away, text="shot", team=None, person=None, name=None, points=None):
    return (game, n, None, period, clock, str(home), str(away), text, team, person, name, points, None)


def other(game, n, period, clock, home, away, text="shot", team=None, person=None, name=None, sub=None):
    return (game, None, n, period, clock, home, away, text, team, person, name, None, sub)


GAMES = [(i, f"2024-10-2{i} 19:00:00", "HOM", "AWY") for i in range(1, 7)]
PLAYS = [
    # 1: running feed, out of order, one play undescribed, overtime, unknown team, player 0
    running(1, 7, 1, "PT10M00.00S", 2, 0, team="HOM", person=11, name="A. One", points=2),
    running(1, 4, 1, "PT12M00.00S", 0, 0),
    running(1, 9, 1, "PT10M00.00S", 2, 3, team="XXX", person=0, name="Z. Zero", points=3),
    running(1, 12, 2, "PT11M59.90S", 2, 3, text=None),
    running(1, 10, 4, "PT00M00.10S", 4, 3, team="HOM", person=11, name="A. Renamed", points=4),
    running(1, 11, 5, "PT05M00.00S", 4, 3, team="HOM", person=11, name="A. One"),
    running(1, 20, 5, "PT00M00.00S", 5, 3, text="Game End"),
    # 2: other feed, blank scores carried, last play ends the game
    other(2, 1, 1, "PT12M00.00S", "", ""),
    other(2, 2, 1, "PT11M00.00S", "2", "0", "Shot (2 PTS)", "HOM", 11, "A. One"),
    other(2, 3, 1, "PT10M00.00S", "", "", "Miss", "AWY", 0, "Z. Zero"),
    other(2, 4, 1, "PT09M00.00S", "0", "3", "Three (3 PTS)", "AWY", 22, "B. Two"),
    other(2, 5, 4, "PT00M00.00S", None, None, "Period End", sub="end"),
    # 3: other feed whose last play does not end it
    other(3, 1, 1, "PT12M00.00S", "1", "1", "x", sub="end"),
    other(3, 2, 1, "PT11M00.00S", "", "", "y"),
    # 4: one unreadable clock spoils the game, not the others
    running(4, 1, 1, "PT12M00.00S", 0, 0),
    running(4, 2, 1, "soon", 0, 0),
    # 5: a readable play and an undescribed one without a period; 6: a running play without a score
    running(5, 1, 1, "PT12M00.00S", 0, 0),
    running(5, 2, None, "PT11M00.00S", 0, 0, text=None),
    running(6, 1, 1, "PT12M00.00S", "", 0),
    running(6, 2, 1, "PT11M00.00S", 1, 0),
    running(6, 3, 1, "PT10M00.00S", 1, 0),
]


@pytest.fixture(scope="module")
def tables(spark):
    games = spark.createDataFrame(GAMES, "game_id long, start string, home_team string, away_team string")
    return games.withColumn("start", F.col("start").cast("timestamp_ntz")), spark.createDataFrame(PLAYS, PLAY)


def rows(frame, *columns, by=("game_id", "play_id")):
    return [tuple(r) for r in frame.orderBy(*by).select(*columns).collect()]


def test_game_states(tables):
    out = s.game_states(*tables)
    got = rows(out, "game_id", "play_id", "home_score", "away_score", "is_final_state")
    assert got == [
        (1, 4, 0, 0, False), (1, 7, 2, 0, False), (1, 9, 2, 3, False), (1, 10, 4, 3, False),
        (1, 11, 4, 3, False), (1, 20, 5, 3, True),
        (2, 1, 0, 0, False), (2, 2, 2, 0, False), (2, 3, 2, 0, False), (2, 4, 0, 3, False),
        (2, 5, 0, 3, True),
        (3, 1, 1, 1, False), (3, 2, 1, 1, False),
    ]
    first = out.filter("game_id = 1 AND play_id = 9").first()
    assert (first.home, first.away, str(first.game_date), first.total, first.home_margin) == (
        "HOM", "AWY", "2024-10-21", 5, -1,
    )


def test_malformed(tables):
    assert [r.game_id for r in s.malformed_games(tables[1]).orderBy("game_id").collect()] == [4, 5, 6]


def test_play_order(tables):
    got = rows(s.play_order(tables[1]).filter("game_id = 1"), "play_id", by=("position",))
    assert [r[0] for r in got] == [4, 7, 9, 12, 10, 11, 20]


def test_player_timeline(tables):
    out = s.player_timeline(*tables)
    got = rows(out, "game_id", "play_id", "side", "person_id", "name", "points")
    assert got == [
        (1, 7, "home", 11, "A. One", 2), (1, 9, "away", 0, "Z. Zero", 3), (1, 10, "home", 11, "A. One", 4),
        (1, 11, "home", 11, "A. One", 4),
        (2, 2, "home", 11, "A. One", 2), (2, 4, "away", 22, "B. Two", 3),
    ]


@pytest.mark.parametrize("pages", [1, 3])
def test_snapshot_and_maps(tables, pages):
    snapshot = s.players_snapshot(*tables)
    got = rows(snapshot, "game_id", "side", "person_id", "name", "points", by=("game_id", "side"))
    assert got == [
        (1, "away", 0, "Z. Zero", 3), (1, "home", 11, "A. One", 4),
        (2, "away", 22, "B. Two", 3), (2, "home", 11, "A. One", 2),
    ]
    maps = s.player_maps(snapshot, pages).filter("game_id = 1 AND side = 'home'").first()
    assert {k: tuple(v) for k, v in maps.players.items()} == {"11": ("A. One", 4)}


def test_latest_final_and_flags(spark, tables):
    states = spark.createDataFrame(
        [(1, 5, 90, 80, False), (1, 9, 100, 98, True), (1, 8, 99, 98, True), (2, 3, 10, 12, False)],
        "game_id long, play_id long, home_score int, away_score int, is_final_state boolean",
    )
    assert rows(s.latest_state(states), "game_id", "play_id", "home_score") == [(1, 9, 100), (2, 3, 10)]
    assert rows(s.final_states(states), "game_id", "home_score", by=("game_id",)) == [(1, 100)]
    games = tables[0].withColumn("game_data_finalized", F.col("game_id") == 3)
    got = rows(s.finalize_games(games, states), "game_id", "game_data_finalized", by=("game_id",))
    assert got == [(1, True), (2, False), (3, True), (4, False), (5, False), (6, False)]


def in_order(plays):
    """One plain sort per game: nulls first, most clock first, equal places in any order."""
    from matchlake.functions.clock import clock_seconds

    left = plays.withColumn("left", clock_seconds(F.col("clock"))).collect()
    games = {}
    for r in left:
        place = (r.period is not None, r.period or 0, r["left"] is not None, -(r["left"] or 0),
                 (r.order_number or r.action_id) is not None, r.order_number or r.action_id or 0)
        games.setdefault(r.game_id, []).append((place, r))
    return {g: sorted(rs, key=lambda x: x[0]) for g, rs in games.items()}


def test_order_with_missing_and_repeated_places(spark):
    """Positions are 1..n whatever is missing, and follow one plain sort."""
    plays = [
        other(1, 1, 1, "PT11M00.00S", "", "", "a"), other(1, 2, 1, None, "", "", "b"),
        other(1, 3, 1, "PT10M00.00S", "", "", "c"), other(1, 4, None, "PT09M00.00S", "", "", "d"),
        other(1, 5, 1, "soon", "", "", "e"), other(1, None, 1, "PT10M00.00S", "", "", "f"),
        other(1, 3, 1, "PT10M00.00S", "", "", "g"), other(1, 1 << 21, 1, "PT10M00.00S", "", "", "h"),
        other(1, None, None, None, "", "", "i"), other(2, 1, 1, "PT11M00.00S", "", "", "j"),
    ]
    frame = spark.createDataFrame(plays, PLAY)
    want = {g: [x[0] for x in rs] for g, rs in in_order(frame).items()}
    found = s.play_order(frame).orderBy("game_id", "position").collect()
    assert [(r.game_id, r.position) for r in found] == [(1, k) for k in range(1, 10)] + [(2, 1)]
    placed = {r.description: k for k, r in enumerate(found)}
    for g, rs in in_order(frame).items():
        at = [placed[r.description] for _, r in rs]
        assert all(a < b or want[g][k] == want[g][k + 1] for k, (a, b) in enumerate(zip(at, at[1:], strict=False)))
    again = s.play_order(frame.repartition(7)).orderBy("game_id", "position").collect()
    assert [r.description for r in again] == [r.description for r in found]


@pytest.mark.parametrize("most", [1 << 20, 200])
def test_one_game_with_a_third_of_all_plays(spark, most):
    """A busy game, whole or over at least five ranges, equals a plain pass over its plays."""
    busy = [
        other(1, n, 1 + n // 500, f"PT{11 - n % 500 // 50:02d}M{59 - n % 50:02d}.00S",
              str(n) if n % 7 == 0 else "", "", f"x ({n} PTS)", "HOM", n % 3, "P")
        for n in range(1, 1501)
    ]
    quiet = [
        other(1000 + n // 10, n % 10, 1, f"PT11M{59 - n % 10:02d}.00S", str(n % 10), "", "y", "AWY", 5, "Q")
        for n in range(3000)
    ]
    plays = spark.createDataFrame(busy + quiet, PLAY)
    games = plays.select("game_id").distinct().select(
        "game_id", F.lit("2024-10-22 19:00:00").cast("timestamp_ntz").alias("start"),
        F.lit("HOM").alias("home_team"), F.lit("AWY").alias("away_team"),
    )
    got = {(r.game_id, r.play_id): r.home_score for r in s.game_states(games, plays, most).collect()}
    points = {(r.game_id, r.play_id): r.points for r in s.player_timeline(games, plays, most).filter("game_id = 1").collect()}
    if most == 200:
        cut = range_cuts(s._placed(plays), ["game_id"], s._ORDER, most).collect()
        assert len(cut) == 1 and len(cut[0].cuts) >= 4
    want, told = {}, {}
    for game, ordered in in_order(plays).items():
        home, known = 0, {}
        for _, r in ordered:
            home = int(r.score_home) if r.score_home else home
            want[game, r.action_id] = home
            if game == 1 and r.person_id:
                known[r.person_id] = r.action_id
                told[1, r.action_id] = known[r.person_id]
    assert got == want and points == told
