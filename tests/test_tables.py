"""Audits, repairs, synchronisation, quality, views and team lookups on edge rows."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import audit, evaluate, history, predict, quality, queues, repair, sync, teams, views

GAME = (
    "game_id long, start string, home_team string, away_team string, status string, season string, "
    "season_type string, pre_game_data_finalized boolean, game_data_finalized boolean"
)
STATE = (
    "game_id long, play_id long, period int, home string, away string, home_score int, away_score int, "
    "is_final_state boolean, ingest_seq long"
)


def games(spark, rows):
    return spark.createDataFrame(rows, GAME).withColumn("start", F.col("start").cast("timestamp_ntz"))


def game(i, home="A", away="B", status="Completed", pre=False, data=True, day=1, season="2024-2025",
         kind="Regular Season"):
    return (i, f"2024-11-{day:02d} 19:00:00", home, away, status, season, kind, pre, data)


def state(i, n, hs, as_, final=False, seq=None, period=1, home="A", away="B"):
    return (i, n, period, home, away, hs, as_, final, n if seq is None else seq)


def found(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


@pytest.fixture(scope="module")
def tables(spark):
    g = games(spark, [
        game(1), game(2, data=False, day=2), game(3, pre=True, day=3), game(4, pre=True, data=False, day=4),
        game(5, home="C", away="D", day=5, pre=True), game(6, home=None, away="Z", status="Not Started", data=False, day=6),
        game(7, day=1, status="In Progress", data=False),
    ])
    s = spark.createDataFrame([
        state(1, 1, 2, 0), state(1, 2, 2, 3), state(1, 3, 1, 3), state(1, 4, 20, 3), state(1, 5, 20, 3, True),
        state(2, 1, 0, 0), state(2, 5, 90, 80, True), state(2, 6, 91, 80, True), state(2, 7, 91, 80, True),
        state(3, 1, 0, -2, seq=5), state(3, 2, 0, 0, seq=4), state(3, 2, 0, 0, seq=6), state(3, 3, None, 1, seq=7),
        state(99, 1, 0, 0), state(7, 1, 1, 1, home="A", away="X"), state(7, 2, 1, 1, home=None, away="B"),
    ], STATE)
    p = spark.createDataFrame(
        [(1, "A"), (1, "B"), (1, "Q"), (1, None), (2, "A"), (3, "A"), (98, "A")], "game_id long, team_tricode string"
    )
    return {
        "games": g, "states": s, "plays": p,
        "features": spark.createDataFrame([(3,), (97,)], "game_id long"),
        "predictions": spark.createDataFrame([(1, "Baseline"), (96, "Tree")], "game_id long, predictor string"),
        "teams": spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "C")], "team_id string, abbreviation string"),
        "team_box": spark.createDataFrame([(1, "A"), (1, "X"), (6, "A"), (6, None)], "game_id long, team_id string"),
        "as_of": "2024-11-02 12:00:00",
        "active_seasons": ["2024-2025"],
    }


EXPECTED = {
    "FLAG-001": (["game_id"], [(3,), (5,)]),
    "FLAG-002": (["game_id"], [(5,)]),
    "FLAG-003": (["game_id"], [(4,), (5,)]),
    "FLAG-004": (["game_id", "home_prior_count", "away_prior_count"], [(5, 0, 0)]),
    "FLAG-005": (["game_id"], [(4,)]),
    "FLAG-006": (["game_id"], [(2,)]),
    "TEAM-001": (["game_id", "team_tricode", "play_count"], [(1, "Q", 1)]),
    "TEAM-002": (["game_id", "away", "state_count"], [(7, "X", 1)]),
    "TEAM-003": (["team"], [("D",), ("Z",)]),
    "TEAM-005": (["game_id", "team_id"], [(1, "X")]),
    "INTEGRITY-001": (["game_id", "log_count"], [(98, 1)]),
    "INTEGRITY-002": (["game_id", "state_count"], [(99, 1)]),
    "INTEGRITY-003": (["game_id"], [(97,)]),
    "INTEGRITY-004": (["game_id", "predictor"], [(96, "Tree")]),
    "INTEGRITY-005": (["table", "field", "nulls"], [("games", "home_team", 1), ("states", "home", 1), ("states", "home_score", 1)]),
    "INTEGRITY-006": (["game_id", "play_id", "dup_count"], [(3, 2, 2)]),
    "SCORE-001": (["game_id", "play_id"], [(1, 3)]),
    "SCORE-002": (["game_id", "play_id"], [(3, 1)]),
    "SCORE-003": (["game_id", "unique_finals", "score"], [(2, 2, "90-80"), (2, 2, "91-80")]),
    "SCORE-004": (["game_id", "play_id", "home_diff", "away_diff"], [(1, 4, 19, 0), (2, 5, 90, 80)]),
    "VOL-001": (["game_id", "play_count"], [(1, 4), (2, 1), (3, 1), (98, 1)]),
    "VOL-002": (["game_id", "play_count", "state_count"], [(1, 4, 5), (2, 1, 4), (3, 1, 4), (98, 1, 0)]),
    "TEMP-001": (["game_id"], [(2,), (3,), (4,), (5,)]),
    "TEMP-002": (["game_id"], [(3,)]),
}


@pytest.mark.parametrize("rule", sorted(EXPECTED))
def test_rule(tables, rule):
    columns, rows = EXPECTED[rule]
    assert found(audit.RULES[rule].rows(tables).select(*columns).dropna(subset=columns[:1]), *columns) == rows


def test_unknown_active_team_may_be_null(tables):
    rows = [r.team for r in audit.RULES["TEAM-004"].rows(tables).collect()]
    assert sorted(t for t in rows if t) == ["D", "Z"]


def test_report(tables):
    report = {r.check_id: r for r in audit.validation_report(tables, sample=2).collect()}
    assert set(report) == set(audit.RULES)
    assert report["VOL-001"]["count"] == 4 and len(report["VOL-001"]["sample"]) == 2
    assert report["FLAG-001"].fixable and not report["SCORE-002"].fixable
    for rule, found_here in report.items():
        told = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
        every = sorted(r[0] for r in audit.RULES[rule].rows(tables).select(F.to_json(F.struct("*"), told)).collect())
        assert (found_here["count"], found_here["sample"]) == (len(every), every[:2]), rule
    only = audit.validation_report(tables, ["Flag", "Nothing"])
    assert {r.category for r in only.collect()} == {"Flag"}
    summary = {r.severity: r.issues for r in audit.severity_summary(only).collect()}
    assert summary == {"critical": 4, "warning": 2}


def test_fix_flags_in_order(tables):
    out = repair.fix_flags(tables["games"], tables["states"], tables["plays"])
    got = found(out, "game_id", "pre_game_data_finalized", "game_data_finalized", "fixed_001", "fixed_002", "fixed_005", "fixed_006")
    assert got == [
        (1, False, True, False, False, False, False),
        (2, False, True, False, False, False, True),
        (3, False, False, True, False, True, False),
        (4, False, False, False, False, True, False),
        (5, False, False, True, False, True, False),
        (6, False, False, False, False, False, False),
        (7, False, False, False, False, False, False),
    ]


def test_fix_orphans_and_duplicates(tables):
    assert found(repair.fix_orphans(tables["features"], tables["games"]), "game_id") == [(3,)]
    kept = repair.fix_duplicates(tables["states"])
    assert kept.columns == tables["states"].columns
    assert found(kept.filter("game_id = 3"), "play_id", "ingest_seq") == [(1, 5), (2, 4), (3, 7)]
    assert kept.count() == 15


def test_games_without_a_team_have_no_past(spark, tables):
    open_game = game(8, home=None, status="Not Started", data=False, day=9)
    known = games(spark, [game(1), game(9, home="B", away=None, pre=True, day=8), open_game])
    t = tables | {"games": known}
    rows = audit.RULES["FLAG-004"].rows(t)
    assert found(rows, "game_id", "home_prior_count", "away_prior_count") == [(9, 1, 0)]
    assert found(history.games_needing_pregame(known), "game_id") == [(1,), (8,)]
    counts = history.prior_counts(known, spark.createDataFrame([(1, 9, 8)], "game_id long, home_score int, away_score int"))
    assert found(counts, "game_id", "side", "needed", "loaded") == [
        (1, "away", 0, 0), (1, "home", 0, 0), (8, "away", 2, 1), (8, "home", 0, 0), (9, "away", 0, 0), (9, "home", 1, 1),
    ]


def test_filters_reach_the_scan(spark, tmp_path):
    """On a stored table the date range and status filters are pushed down."""
    path = str(tmp_path / "games")
    games(spark, [game(1), game(2, day=2)]).write.parquet(path)
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for rows, wanted in (
        (queues.on_date(stored, "2024-11-01"), "GreaterThanOrEqual(start,2024-11-01T00:00)"),
        (queues.in_progress(stored, "2024-2025"), "EqualTo(status,In Progress)"),
    ):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan and "ReadSchema" in plan
    assert found(queues.on_date(stored, "2024-11-01"), "game_id") == [(1,)]


def test_schedule_sync(spark):
    old = games(spark, [
        game(1, pre=True), game(2), game(3, status="In Progress"), game(4), game(5, season="2023-2024"),
    ])
    new = games(spark, [
        game(1), game(3, status="Completed"), game(4, away=None), game(6), game(7, home=None),
    ]).drop(*sync.FLAGS)
    out = sync.sync_schedule(old, new, "2024-2025")
    assert found(out, "game_id", "status", "away_team", "pre_game_data_finalized", "game_data_finalized") == [
        (1, "Completed", "B", True, True),  # unchanged, flags kept
        (3, "Completed", "B", False, True),  # changed, flags kept
        (4, "Completed", "B", False, True),  # delivered with a null: left as it was
        (5, "Completed", "B", False, True),  # another season
        (6, "Completed", "B", False, False),  # new
    ]
    counts = sync.sync_counts(old, new, "2024-2025").first()
    assert tuple(counts) == (2, 2, 1)
    assert {r.verdict for r in sync.sync_guard(new, "2024-2025").collect()} == {"accept"}
    assert sync.sync_guard(new, "2023-2024").first().verdict == "mixed seasons"
    assert sync.sync_guard(old.filter("game_id < 0"), "2024-2025").first().verdict == "empty"


def test_replacing(spark):
    old = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(1, "z", 2), (3, "w", 1), (2, "old", 0)], "k int, v string, at int")
    assert found(sync.replace_rows(old, new, ["k"], "at"), "k", "v") == [(1, "z"), (2, "y"), (3, "w")]
    a = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "game_id int, n int")
    b = spark.createDataFrame([(1, 9)], "game_id int, n int")
    assert found(sync.replace_groups(a, b), "game_id", "n") == [(1, 9), (2, 1)]
    assert found(sync.replace_groups(a, b.filter("n < 0")), "game_id", "n") == [(1, 1), (1, 2), (2, 1)]
    changed = sync.changed_rows(
        spark.createDataFrame([(1, "a", None), (2, "b", "t"), (3, None, None), (4, "n", "n")], "k int, x string, y string"),
        spark.createDataFrame([(1, "a", None), (2, "b", None), (3, None, None)], "k int, x string, y string"),
        "k", ["x", "y"],
    )
    assert found(changed, "k") == [(2,), (4,)]


def test_points_allowed(spark):
    box = spark.createDataFrame(
        [(1, "A", 100), (1, "B", 98), (2, "A", 90), (3, "A", None), (3, "B", 80), (4, "A", 1), (4, "B", 2), (4, "C", 3)],
        "game_id int, team_id string, pts int",
    )
    assert found(teams.points_allowed(box).fillna(-1), "game_id", "team_id", "pts_allowed") == [
        (1, "A", 98), (1, "B", 100), (2, "A", -1), (3, "A", 80), (3, "B", -1), (4, "A", -1), (4, "B", -1), (4, "C", -1),
    ]


def test_resolve_team(spark):
    known = spark.createDataFrame(
        [("1", "abc", "alpha beta club", "club", ["old alpha"]), ("2", "xyz", "xy zed", "zed", ["club"])],
        "team_id string, abbreviation string, full_name string, short_name string, alternatives array<string>",
    )
    asked = spark.createDataFrame([("ABC",), ("Alpha-Beta Club",), ("Old-ALPHA",), ("club",), ("zed",), ("?",), (None,)], "who string")
    got = {r.who: (r.team, r.full_name) for r in teams.resolve(asked, "who", known).collect()}
    alpha = ("ABC", "Alpha Beta Club")
    assert got == {"ABC": alpha, "Alpha-Beta Club": alpha, "Old-ALPHA": alpha, "club": alpha,
                   "zed": ("XYZ", "Xy Zed"), "?": (None, None), None: (None, None)}


def test_play_quality(spark):
    g = games(spark, [game(1), game(2)])
    p = spark.createDataFrame([(1,)] * 3, "game_id long")
    s = spark.createDataFrame([state(1, 1, 2, 0), state(1, 2, 1, 0), state(1, 3, 3, 0, True), ], STATE)
    got = {r.game_id: r for r in quality.play_quality(g, p, s, fewest=2, most=5).collect()}
    assert got[1].issues == ["Score decreased at play 2"] and got[1].quality == "FAIL" and got[1].has_final_state
    assert got[2].issues == ["Low play count: 0 (expected 2-5)", "No final state"]
    many = spark.createDataFrame([state(1, n, n, 30 if n < 21 else 0) for n in range(1, 30)], STATE)
    assert quality.first_decrease(many).count() == 0  # only the first 20 states are looked at


def test_coverage_marks(spark):
    g = games(spark, [game(i) for i in range(1, 101)])
    seen = spark.range(1, 97).withColumnRenamed("id", "game_id")
    rows = quality.coverage(g, {"plays": seen.unionAll(seen), "player_box": seen.filter("game_id < 90"), "features": seen.filter("game_id < 50")})
    assert found(rows, "dataset", "covered", "total", "mark") == [
        ("features", 49, 100, "poor"), ("player_box", 89, 100, "fair"), ("plays", 96, 100, "good"),
    ]
    assert found(quality.coverage_alerts(rows), "category", "missing") == [("player_box_missing", 11), ("plays_missing", 4)]


def test_models_ranked_and_promoted(spark):
    m = spark.createDataFrame(
        [(1, "T", "active", 9.0), (2, "T", "active", None), (3, "T", "testing", 5.0), (4, "L", "active", None), (5, "L", "active", None)],
        "model_id int, model_type string, status string, avg_score_mae double",
    )
    assert found(evaluate.best_models(m), "model_type", "model_id") == [("L", 4), ("T", 1)]
    out = evaluate.promote(m, m.filter("model_id = 3"))
    assert found(out, "model_id", "status") == [(1, "archived"), (2, "archived"), (3, "active"), (4, "active"), (5, "active")]


def test_live_predictions(spark):
    p = spark.createDataFrame(
        [(1, "P", "2024-11-01 10:00:00", 100.0, 90.0, 0.7), (1, "P", "2024-10-01 10:00:00", 1.0, 1.0, 0.1),
         (2, "P", "2024-11-01 10:00:00", 100.0, 90.0, 0.7), (3, "P", "2024-11-01 10:00:00", 100.0, 90.0, 0.7),
         (4, "Q", "2024-11-01 10:00:00", 100.0, 90.0, 0.7)],
        "game_id long, predictor string, prediction_ts string, pred_home_score double, pred_away_score double, pred_home_win_pct double",
    )
    latest = spark.createDataFrame(
        [(1, "PT00M00.00S", 4, 88, 95, True), (2, "PT12M00.00S", 3, 60, 50, False), (4, "PT12M00.00S", 3, 1, 1, False)],
        "game_id long, clock string, period int, home_score int, away_score int, is_final_state boolean",
    )
    got = {r.game_id: r for r in predict.live_predictions(predict.live_inputs(p, latest, "P")).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].pred_home_score, got[1].pred_away_score, got[1].pred_home_win_pct) == (88, 95, 0.0)
    assert (got[2].pred_home_score, got[2].pred_away_score) == (110.0, 95.0)
    assert (got[3].pred_home_score, got[3].pred_home_win_pct) == (100.0, 0.7)


def test_pages_keep_every_play(spark):
    plays = spark.range(25).select(
        F.lit(1).cast("long").alias("game_id"), F.col("id").alias("order_number"), F.lit(None).cast("long").alias("action_id"),
        F.lit(1).alias("period"), F.lit("PT01M02.00S").alias("clock"), F.lit("0").alias("score_home"),
        F.lit("0").alias("score_away"), F.col("id").cast("string").alias("description"),
    )
    pages = views.condensed_plays(plays, page_plays=10).orderBy("page").collect()
    assert [len(p.condensed) for p in pages] == [10, 10, 5]
    assert [e.description for p in pages for e in p.condensed] == [str(n) for n in reversed(range(25))]
    assert pages[0].condensed[0].time_info == "1:02 Q1"


def test_queues(spark):
    g = games(spark, [game(1, day=1), game(2, data=False, day=2), game(3, kind="Pre Season", data=False), game(4, status="In Progress", data=False, pre=True, day=4)])
    assert found(queues.needing_collection(g, "2024-2025"), "game_id") == [(2,)]
    assert found(queues.in_progress(g), "game_id") == [(4,)]
    assert found(queues.on_date(g, "2024-11-01"), "game_id") == [(1,), (3,)]
    p = spark.createDataFrame([(4, "B")], "game_id long, predictor string")
    assert queues.needing_prediction(g, p, "B").count() == 0
    assert found(queues.needing_prediction(g, p, "L"), "game_id") == [(4,)]
    ids = spark.createDataFrame([(1,), (9,), (9,)], "game_id long")
    assert found(queues.lookup(g, ids), "game_id") == [(1,)] and found(queues.lookup_missing(g, ids), "game_id") == [(9,)]
    seasons = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "season string")
    log = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00"), ("d", "2024-01-01 00:07:00")], "season string, t string").select("season", F.col("t").cast("timestamp_ntz").alias("last_update"))
    due = queues.refresh_due(seasons, log, "a", "2024-01-01 00:10:00")
    assert found(due, "season", "is_due") == [("a", True), ("b", True), ("c", True), ("d", False)]
