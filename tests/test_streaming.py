"""Streams over several micro-batches equal the batch operators."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlake.operators import states as s
from matchlake.streaming import closing, live
from test_states import PLAY, other, running

SCHEDULE = "game_id long, start string, home_team string, away_team string"


def landed(spark, folder, batches, schema=PLAY):
    """One file per delivery, written in order."""
    path = f"{folder}/plays.parquet"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture
def schedule(spark):
    rows = [(i, f"2024-10-2{i} 19:00:00", "HOM", "AWY") for i in range(1, 5)]
    return spark.createDataFrame(rows, SCHEDULE).withColumn("start", F.col("start").cast("timestamp_ntz"))


DELIVERIES = [
    [running(1, 1, 1, "PT12M00.00S", 0, 0), other(2, 1, 1, "PT12M00.00S", "2", "")],
    [running(1, 2, 1, "PT11M00.00S", 2, 0), running(1, 2, 1, "PT11M00.00S", 2, 0), other(2, 2, 1, "PT10M00.00S", "", "3")],
    [running(1, 9, 4, "PT00M00.00S", 90, 88, "Game End"), other(2, 3, 2, "PT10M00.00S", "", ""),
     running(3, 1, 1, "PT12M00.00S", 1, 1, text=None)],
]


def test_running_states_follow_deliveries(spark, tmp_path, schedule):
    path = landed(spark, tmp_path, DELIVERIES)
    plays = live.read_stream(spark, path, files_per_batch=1)
    folder = live.publish(live.running_states(plays, schedule, "30 days"), "t", folder=str(tmp_path / "out"))
    got = {r.game_id: tuple(r) for r in live.published(spark, folder, "game_id").select("game_id", "home", "play_id", "home_score", "away_score", "is_final_state").collect()}
    assert got == {1: (1, "HOM", 9, 90, 88, True), 2: (2, "HOM", 3, 2, 3, False)}
    every = spark.read.parquet(f"{folder}/rows/batch=*").filter("game_id = 1").orderBy("play_id").collect()
    assert [(r.play_id, r.home_score) for r in every] == [(1, 0), (2, 2), (9, 90)]
    # Nothing new has landed: another run adds nothing and changes nothing.
    live.publish(live.running_states(live.read_stream(spark, path, 1), schedule, "30 days"), "t", folder=folder)
    assert live.published(spark, folder, "game_id").count() == 2


def test_stream_equals_batch(spark, tmp_path, schedule):
    path = landed(spark, tmp_path, DELIVERIES)
    plays = live.read_stream(spark, path, files_per_batch=1)
    folder = live.publish(live.running_states(plays, schedule, "30 days"), "t", folder=str(tmp_path / "out"))
    columns = ["game_id", "play_id", "home_score", "away_score", "is_final_state"]
    batch = s.latest_state(s.game_states(schedule, spark.read.parquet(path).distinct()))
    as_rows = lambda frame: sorted(tuple(r) for r in frame.select(*columns).collect())
    assert as_rows(live.published(spark, folder, "game_id")) == as_rows(batch)


def test_repeats_are_dropped_across_batches(spark, tmp_path):
    rows = [
        [(1, 1, "2024-10-21 19:00:00"), (1, 2, "2024-10-21 19:01:00"), (1, 2, "2024-10-21 19:01:00")],
        [(1, 2, "2024-10-21 19:01:00"), (1, 3, "2024-10-21 19:02:00"), (2, 1, "2024-10-21 19:02:00")],
    ]
    path = landed(spark, tmp_path, rows, "game_id long, play_id long, at string")
    stream = live.read_stream(spark, path, 1).withColumn("at", F.col("at").cast("timestamp"))
    once = live.first_deliveries(stream, "at", "2 hours")
    folder = live.publish(once, "t", mode="append", folder=str(tmp_path / "out"))
    got = sorted((r.game_id, r.play_id) for r in live.published(spark, folder).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_plays_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [
        [(1, 1, "2024-10-21 19:00:00")], [(2, 1, "2024-10-21 23:00:00")], [(3, 1, "2024-10-21 23:30:00")],
        [(1, 2, "2024-10-21 19:30:00"), (3, 2, "2024-10-21 23:31:00")],
    ]
    path = landed(spark, tmp_path, rows, "game_id long, play_id long, at string")
    stream = live.read_stream(spark, path, 1).withColumn("at", F.col("at").cast("timestamp"))
    folder = live.publish(live.first_deliveries(stream, "at", "1 hour"), "t", mode="append", folder=str(tmp_path / "out"))
    got = sorted((r.game_id, r.play_id) for r in live.published(spark, folder).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (3, 2)]


def test_games_in_parts_keep_all_their_plays(spark, tmp_path, schedule):
    """States are derived from all plays of a game, whichever deliveries bring them."""
    parts = [
        [other(1, 1, 1, "PT12M00.00S", "2", "0"), other(1, 2, 1, "PT11M00.00S", "", ""), running(2, 1, 1, "PT12M00.00S", 0, 0)],
        [other(1, 3, 1, "PT10M00.00S", "", "3"), other(1, 4, 2, "PT10M00.00S", "", "")],
        [running(2, 2, 1, "PT11M00.00S", 2, 0), running(3, 1, 1, "PT12M00.00S", 0, 0)],
    ]
    path = landed(spark, tmp_path, parts)
    out = str(tmp_path / "out")
    folder = live.publish_whole(live.read_stream(spark, path, 1), "t", lambda rows: s.game_states(schedule, rows), folder=out)
    columns = ["game_id", "play_id", "home_score", "away_score"]
    as_rows = lambda frame: sorted(tuple(r) for r in frame.select(*columns).collect())
    got = as_rows(live.published(spark, folder, "game_id"))
    assert got == as_rows(s.game_states(schedule, spark.read.parquet(path)))
    assert got == [(1, 1, 2, 0), (1, 2, 2, 0), (1, 3, 2, 3), (1, 4, 2, 3), (2, 1, 0, 0), (2, 2, 2, 0), (3, 1, 0, 0)]


def test_unreadable_games_are_marked_as_in_a_batch(spark, tmp_path, schedule):
    parts = [
        [running(1, 1, 1, "PT12M00.00S", 0, 0), running(2, 1, 1, "PT12M00.00S", 0, 0), running(3, 1, 1, "PT12M00.00S", 0, 0)],
        [running(1, 2, 1, "oops", 2, 0), running(2, 2, None, "PT11M00.00S", 2, 0, text=None), running(3, 2, 1, "PT11M00.00S", 2, 0)],
    ]
    path = landed(spark, tmp_path, parts)
    stream = live.running_states(live.read_stream(spark, path, 1), schedule, "30 days")
    folder = live.publish(stream, "t", folder=str(tmp_path / "out"))
    got = live.published(spark, folder, "game_id")
    assert {r.game_id: r.is_spoilt for r in got.collect()} == {1: True, 2: True, 3: False}
    batch = s.game_states(schedule, spark.read.parquet(path)).select("game_id").distinct()
    assert [r.game_id for r in batch.collect()] == [3]


def test_live_predictions_stream(spark, tmp_path, schedule):
    path = landed(spark, tmp_path, DELIVERIES)
    stored = spark.createDataFrame(
        [(i, "P", "2024-10-20 00:00:00", 100.0, 96.0, 0.6) for i in (1, 2, 3)],
        "game_id long, predictor string, prediction_ts string, pred_home_score double, pred_away_score double, pred_home_win_pct double",
    )
    states = live.running_states(live.read_stream(spark, path, 1), schedule, "30 days")
    folder = live.publish(live.running_predictions(states, stored, "P"), "t", folder=str(tmp_path / "out"))
    got = {r.game_id: r for r in live.published(spark, folder, "game_id").collect()}
    assert set(got) == {1, 2}
    assert (got[1].pred_home_score, got[1].pred_home_win_pct) == (90.0, 1.0)
    done = (24 - 10) / 48  # second period, ten minutes left
    assert got[2].pred_home_score == pytest.approx(done * 70 + (1 - done) * 100)


def test_players_stream_equals_batch(spark, tmp_path, schedule):
    one = running(1, 3, 1, "PT09M00.00S", 2, 0, team="HOM", person=11, name="A. One", points=2)
    later = running(1, 5, 2, "PT09M00.00S", 4, 0, team="HOM", person=11, name="A. Other", points=4)
    text = other(2, 1, 1, "PT09M00.00S", "", "", "Shot (7 PTS)", "AWY", 22, "B. Two")
    path = landed(spark, tmp_path, [[later, text], [one, one], [other(2, 2, 1, "PT08M00.00S", "", "", "Miss", "AWY", 22, "B. Two")]])
    stream = live.running_players(live.read_stream(spark, path, 1), schedule, "30 days")
    folder = live.publish(stream, "t", folder=str(tmp_path / "out"))
    got = live.published(spark, folder, "game_id", "side", "person_id")
    want = s.players_snapshot(schedule, spark.read.parquet(path))
    as_rows = lambda frame: sorted(tuple(r) for r in frame.select("game_id", "side", "person_id", "name", "points").collect())
    assert as_rows(got) == as_rows(want) == [(1, "home", 11, "A. One", 4), (2, "away", 22, "B. Two", 7)]


SPLIT = [
    [(1, 1, "2024-10-21 19:00:00"), (2, 1, "2024-10-21 23:00:00"), (2, 1, "2024-10-21 23:00:00")],
    [(1, 2, "2024-10-21 19:30:00"), (3, 1, "2024-10-21 23:30:00"), (1, 3, "2024-10-21 22:00:00"), (4, 1, None)],
    [(1, 2, "2024-10-21 19:31:00"), (1, 1, "2024-10-21 19:00:00"), (3, 1, "2024-10-21 23:30:00"), (5, 1, "2024-10-21 22:31:00"),
     (6, 1, "2024-10-21 20:00:00"), (6, 1, "2024-10-21 22:00:00"), (6, 2, "2024-10-21 22:00:01")],
]


def split(spark, tmp_path, batches=SPLIT):
    path = landed(spark, tmp_path, batches, "game_id long, play_id long, at string")
    stream = live.read_stream(spark, path, 1).withColumn("at", F.col("at").cast("timestamp"))
    return live.publish_split(stream, "t", "at", "1 hour", folder=str(tmp_path / "out"))


def test_late_plays_are_set_aside_and_repaired(spark, tmp_path):
    store = split(spark, tmp_path)
    late = sorted((r.game_id, r.play_id, r.batch) for r in live.late_rows(spark, store).collect())
    assert late == [(1, 1, 2), (1, 2, 2), (6, 1, 2), (6, 1, 2)]  # at the watermark is late as well
    kept = sorted((r.game_id, r.play_id) for r in store.read().collect())
    assert kept == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2)]
    rows = {(r.game_id, r.play_id): str(r["at"]) for r in live.repaired(spark, store).collect()}
    assert sorted(rows) == sorted({(g, p) for b in SPLIT for g, p, _ in b})
    assert rows[1, 2].endswith("19:30:00") and rows[6, 1].endswith("20:00:00")  # the first that arrived
    assert live.repaired(spark, store).count() == len(rows)


def test_late_plays_are_those_that_the_engine_drops(spark, tmp_path):
    """Kept rows are those of the built-in duplicate filter behind the same watermark."""
    batches = [[r for r in b if r[2]] for b in SPLIT]
    store = split(spark, tmp_path, batches)
    path = f"{tmp_path}/plays.parquet"
    stream = live.read_stream(spark, path, 1).withColumn("at", F.col("at").cast("timestamp"))
    folder = live.publish(live.first_deliveries(stream, "at", "1 hour"), "t", mode="append", folder=str(tmp_path / "engine"))
    got = sorted((r.game_id, r.play_id) for r in live.published(spark, folder).collect())
    assert got == sorted((r.game_id, r.play_id) for r in store.read().collect())


def closed(spark, tmp_path, batches):
    schema = "game_id long, start string, order_number long, action_id long, description string, sub_type string"
    path = landed(spark, tmp_path, batches, schema)
    stream = live.read_stream(spark, path, 1).withColumn("start", F.col("start").cast("timestamp"))
    folder = closing.close_games(stream, "t", "1 day", 5 * 86400, folder=str(tmp_path / "out"))
    left = spark.read.format("statestore").option("stateVarName", "game").load(f"{folder}/progress")
    return folder, sorted(r.key.game_id for r in left.collect())


def test_games_close_at_their_final_play_or_by_a_timer(spark, tmp_path):
    early, later, last = "2024-10-01 19:00:00", "2024-12-01 19:00:00", "2025-03-01 19:00:00"
    batches = [
        [(1, early, 1, None, "x", None), (2, early, None, 1, "x", None), (3, early, None, 1, "x", "end"), (6, early, 1, None, None, "end")],
        [(1, early, 2, None, "Game End", None), (4, later, None, 1, None, "end"), (7, early, 1, None, "x", None)],
        [(5, last, 1, None, "x", None)],
    ]
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    folder, left = closed(spark, tmp_path, batches)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    got = {r.game_id: (r.is_final, r.reason, r.plays) for r in closing.closings(spark, folder).collect()}
    timer = (False, "timer", 1)
    assert got == {1: (True, "final play", 2), 2: timer, 3: (True, "final play", 1), 4: timer, 6: timer, 7: timer}
    assert left == [5]
    games = spark.createDataFrame([(1, False), (2, False), (5, True), (9, False)], "game_id long, game_data_finalized boolean")
    done = {r.game_id: (r.game_data_finalized, r.reason) for r in closing.finalized(games, closing.closings(spark, folder)).collect()}
    assert done == {1: (True, "final play"), 2: (False, "timer"), 5: (True, None), 9: (False, None)}


def test_the_store_is_empty_when_all_games_have_ended(spark, tmp_path):
    day = "2024-10-01 19:00:00"
    folder, left = closed(spark, tmp_path, [[(g, day, 1, None, "x", None) for g in range(9)], [(g, day, 2, None, "Game End", None) for g in range(9)]])
    assert left == [] and closing.closings(spark, folder).filter("is_final AND plays = 2").count() == 9


def test_the_schedule_is_not_broadcast_and_only_busy_games_are_salted(spark, schedule):
    """Its size is estimated from files: a small estimate brought all games, once per salt, to the driver."""
    plays = spark.createDataFrame([running(1, n, 1, "PT12M00.00S", 0, 0) for n in range(40)] + [other(2, 1, 1, "PT12M00.00S", "2", "")], PLAY)
    busy = live.busy_games(plays, plays=30)
    assert busy == [1] and live.busy_games(plays, plays=41) == []
    want = sorted(tuple(r) for r in live.with_schedule(plays, schedule, "1 day", salts=1).collect())
    for known, copies in ((None, 4 * 8), (busy, 3 + 8), ([], 4)):
        joined = live.with_schedule(plays, schedule, "1 day", busy=known)
        assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in joined.collect()) == want and len(want) == 41
        made = [n for n in nodes(joined._jdf.queryExecution().executedPlan()) if n.nodeName() == "Generate"]
        assert [n.metrics().apply("numOutputRows").value() for n in made] == [copies]


def nodes(plan):
    """The operators of a plan that has run."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.executedPlan()
    below = [plan.plan()] if plan.nodeName().endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    return [plan, *[n for child in below for n in nodes(child)]]


def test_games_that_share_a_key_close_as_alone(spark, tmp_path):
    """Closings of each batch, whatever the number of keys; a call of the processor brings the games of a key."""
    days = ["2024-10-01 19:00:00", "2024-10-01 19:00:01", "2024-10-02 18:59:59", "2024-10-07 19:00:00", "1969-05-01 10:00:00", None]
    rng = np.random.default_rng(5)

    def play(game, batch):
        return (game, days[game % 6] if game % 11 else days[3], batch + 1, None, "Game End" if rng.random() < 0.15 else "x", None)

    opened = [(None, days[0], 1, None, "x", None), (1 << 60, days[0], 1, None, "x", None), (-1, days[1], 1, None, "x", None)]
    batches = [opened + [play(int(g), b) for g in rng.integers(0, 60, 150) if b < 2 or g > 40] for b in range(3)]
    batches += [[(999, "2024-10-20 19:00:00", 1, None, "x", None)], [(1000, "2024-10-20 19:00:00", 1, None, "Game End", None)]]
    schema = "game_id long, start string, order_number long, action_id long, description string, sub_type string"
    path = landed(spark, tmp_path, batches, schema)
    found = []
    for keys in (1, 3, 40):
        stream = live.read_stream(spark, path, 1).withColumn("start", F.col("start").cast("timestamp"))
        folder = closing.close_games(stream, "t", "1 day", 5 * 86400, folder=str(tmp_path / f"out{keys}"), keys=keys)
        rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
        found.append(sorted((str(r.game_id), r.batch, r.reason, r.plays) for r in rows.collect()))
        left = spark.read.format("statestore").option("stateVarName", "game").load(f"{folder}/progress").collect()
        still = np.concatenate([np.frombuffer(bytes(r.value.games), "int64").reshape(-1, 5)[:, 0] for r in left])
        assert len(left) <= keys and 999 in still and len(set(still)) == len(still)
    want = closed_alone(batches, 86400, 5 * 86400)
    assert found[0] == found[1] == found[2] == want


def closed_alone(batches, delay, hold):
    """The closings of each batch by a loop over games; the watermark begins at 1970."""
    seconds = lambda text: None if text is None else int(datetime.fromisoformat(text + "+00:00").timestamp())
    known, out, edge, highest = {}, [], 0, 0
    for k, rows in enumerate([*batches, []]):
        late, edge = edge, max(0, highest - delay)  # rows are late by the watermark of the batch before
        games = {}
        for game, start, _, _, text, _ in rows:
            if start is None or seconds(start) > late:
                games.setdefault(game, []).append((seconds(start), text))
        for game, plays in games.items():
            before, expiry = known.pop(game, (0, None))
            if any(text == "Game End" for _, text in plays):
                out.append((str(game), k, "final play", before + len(plays)))
            else:
                start = plays[0][0]
                known[game] = (before + len(plays), expiry if before else start and start + hold)
        for game, (plays, expiry) in list(known.items()):
            if expiry is not None and expiry <= edge:
                out.append((str(game), k, "timer", plays))
                del known[game]
        highest = max([highest, *[seconds(r[1]) for r in rows if r[1]]])
    return sorted(out)


def test_states_lie_outside_the_heap(spark, tmp_path, schedule):
    """In RocksDB of bounded memory, as the checkpoint tells; the session stays as it was."""
    before = {k: spark.conf.get(k, None) for k in live._ROCKS}
    path = landed(spark, tmp_path, DELIVERIES)
    folder = live.publish(live.running_states(live.read_stream(spark, path, 1), schedule, "30 days"), "t", folder=str(tmp_path / "out"))
    assert list(tmp_path.glob("out/progress/state/0/*/*.zip")) and not list(tmp_path.glob("out/progress/state/0/*/*.delta"))
    told = next(tmp_path.glob("out/progress/offsets/0")).read_text()
    assert "RocksDBStateStoreProvider" in told
    assert {k: spark.conf.get(k, None) for k in live._ROCKS} == before
    assert live.published(spark, folder, "game_id").count() == 2
