"""The audit rules: each returns its offending rows, the report counts them.

Rules read a dict of tables (games, plays, states, features, predictions, teams,
team_box); plays carry ``play_id`` and ``team_tricode``, states ``ingest_seq``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.operators.history import attach_sides, counted, team_rows, totals_before
from matchlake.operators.quality import FEWEST_PLAYS, MOST_PLAYS
from matchlake.operators.scan import RANGE_ROWS, range_cuts, range_scan

Tables = dict[str, DataFrame]
LARGEST_JUMP = 10


def finalized_without_final_state(t: Tables) -> DataFrame:
    final = t["states"].filter("is_final_state").select("game_id").distinct()
    return (
        t["games"].filter("game_data_finalized").join(final, "game_id", "left_anti")
        .select("game_id", "status", "start")
    )


def finalized_without_plays(t: Tables) -> DataFrame:
    # A yes or no per game: distinct ids combine before the shuffle, plays would not.
    played = t["plays"].select("game_id").distinct()
    return (
        t["games"].filter("game_data_finalized").join(played, "game_id", "left_anti")
        .select("game_id", "status", "start")
    )


def pregame_without_features(t: Tables) -> DataFrame:
    return (
        t["games"].filter("pre_game_data_finalized").join(t["features"], "game_id", "left_anti")
        .select("game_id", "home_team", "away_team", "start")
    )


def pregame_without_history(t: Tables) -> DataFrame:
    """A running count per team replaces two counts over earlier games."""
    used = F.when(counted(t["games"]) & F.col("game_data_finalized"), F.lit(1))
    rows = team_rows(t["games"], "season_type", "game_data_finalized")
    totals = totals_before(rows, {"prior_count": used})
    flagged = t["games"].filter("pre_game_data_finalized")
    return (
        attach_sides(flagged, totals, ["prior_count"])
        .fillna(0, ["home_prior_count", "away_prior_count"])
        .filter((F.col("home_prior_count") == 0) | (F.col("away_prior_count") == 0))
        .select(
            "game_id", "home_team", "away_team", "start", "home_prior_count", "away_prior_count"
        )
    )


def pregame_before_data(t: Tables) -> DataFrame:
    return (
        t["games"].filter(F.col("pre_game_data_finalized") & ~F.col("game_data_finalized"))
        .select("game_id", "home_team", "away_team", "status")
    )


def ended_but_not_finalized(t: Tables) -> DataFrame:
    final = t["states"].filter("is_final_state").select("game_id")
    open_games = t["games"].filter((F.col("status") == "Completed") & ~F.col("game_data_finalized"))
    return open_games.join(final, "game_id", "left_semi").select("game_id", "status", "start")


def _orphans(child: DataFrame, games: DataFrame) -> DataFrame:
    return child.join(games, "game_id", "left_anti")


def orphan_plays(t: Tables) -> DataFrame:
    return (
        t["plays"].groupBy("game_id").agg(F.count(F.lit(1)).alias("log_count"))
        .join(t["games"], "game_id", "left_anti")
    )


def orphan_states(t: Tables) -> DataFrame:
    return (
        t["states"].groupBy("game_id").agg(F.count(F.lit(1)).alias("state_count"))
        .join(t["games"], "game_id", "left_anti")
    )


def orphan_features(t: Tables) -> DataFrame:
    return _orphans(t["features"].select("game_id"), t["games"])


def orphan_predictions(t: Tables) -> DataFrame:
    return _orphans(t["predictions"].select("game_id", "predictor"), t["games"])


KEY_FIELDS = {
    "games": ["game_id", "home_team", "away_team", "start", "season"],
    "states": ["game_id", "play_id", "home", "away", "home_score", "away_score"],
    "features": ["game_id"],
}


def null_key_fields(t: Tables) -> DataFrame:
    """Nulls per (table, field), one pass over each table."""
    parts = []
    for name, fields in KEY_FIELDS.items():
        counts = t[name].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in fields])
        cells = [
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("field"), F.col(c).alias("nulls"))
            for c in fields
        ]
        parts.append(counts.select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts).filter("nulls > 0")


def repeated_states(t: Tables) -> DataFrame:
    return (
        t["states"].groupBy("game_id", "play_id").agg(F.count(F.lit(1)).alias("dup_count"))
        .filter("dup_count > 1")
    )


def _most(t: Tables) -> int | None:
    """Rows of a game that one task scans; none to mind where the report has looked before."""
    return None if t.get("no_large_games") else RANGE_ROWS


def falling_scores(t: Tables) -> DataFrame:
    """States under an earlier play's score in the period.

    Compared with the running maximum of smaller play ids, so neither repeats nor
    long games pair rows with each other.
    """
    rows = t["states"].dropna(subset=["game_id", "period", "play_id"]).select(
        "game_id", "play_id", "period", "home_score", "away_score"
    )
    before = range_scan(
        rows, ["game_id", "period"], ["play_id"],
        {"max_home": ("max_before", "home_score"), "max_away": ("max_before", "away_score")},
        _most(t),
    )
    fell = (F.col("max_home") > F.col("home_score")) | (F.col("max_away") > F.col("away_score"))
    return before.filter(fell).select(*rows.columns).distinct()


def negative_scores(t: Tables) -> DataFrame:
    return t["states"].filter((F.col("home_score") < 0) | (F.col("away_score") < 0)).select(
        "game_id", "play_id", "period", "home_score", "away_score"
    )


def differing_finals(t: Tables) -> DataFrame:
    """One row per distinct final score of the games that have several."""
    score = F.concat(
        F.col("home_score").cast("string"), F.lit("-"), F.col("away_score").cast("string")
    )
    scores = (
        t["states"].filter("is_final_state").select("game_id", score.alias("score"))
        .dropna(subset=["score"]).distinct()
    )
    several = (
        scores.groupBy("game_id").agg(F.count(F.lit(1)).alias("unique_finals"))
        .filter("unique_finals > 1")
    )
    return scores.join(several, "game_id").select("game_id", "unique_finals", "score")


def score_jumps(t: Tables) -> DataFrame:
    rows = t["states"].select("game_id", "play_id", "home_score", "away_score")
    seen = range_scan(
        rows, ["game_id"], ["play_id"],
        {"was_home": ("lag", "home_score"), "was_away": ("lag", "away_score")},
        _most(t),
    )
    return (
        seen.select(
            "game_id",
            "play_id",
            (F.col("home_score") - F.col("was_home")).alias("home_diff"),
            (F.col("away_score") - F.col("was_away")).alias("away_diff"),
        )
        .filter((F.col("home_diff") > LARGEST_JUMP) | (F.col("away_diff") > LARGEST_JUMP))
    )


def unusual_play_counts(t: Tables) -> DataFrame:
    """``t["play_limits"]`` are the fewest and most plays of a usual game, where given."""
    fewest, most = t.get("play_limits", (FEWEST_PLAYS, MOST_PLAYS))
    return (
        t["plays"].groupBy("game_id").agg(F.count(F.lit(1)).alias("play_count"))
        .filter((F.col("play_count") < fewest) | (F.col("play_count") > most))
    )


def differing_counts(t: Tables) -> DataFrame:
    told = t["plays"].groupBy("game_id").agg(F.count(F.lit(1)).alias("play_count"))
    kept = t["states"].groupBy("game_id").agg(F.count(F.lit(1)).alias("state_count"))
    return (
        told.join(kept, "game_id", "left").fillna(0, ["state_count"])
        .filter(F.col("play_count") != F.col("state_count"))
    )


def completed_in_future(t: Tables) -> DataFrame:
    """``t["as_of"]`` is the moment to compare with, as ISO text."""
    moment = F.lit(t["as_of"]).cast("timestamp_ntz")
    return t["games"].filter((F.col("status") == "Completed") & (F.col("start") > moment)).select(
        "game_id", "start", "status"
    )


def out_of_order_ids(t: Tables) -> DataFrame:
    """Games where a smaller play id was ingested after a larger one."""
    rows = t["states"].dropna(subset=["game_id", "ingest_seq"]).select("game_id", "ingest_seq", "play_id")
    seen = range_scan(
        rows, ["game_id"], ["ingest_seq"], {"max_id": ("max_before", "play_id")}, _most(t)
    )
    return seen.filter("max_id > play_id").select("game_id").distinct()


def foreign_team_in_plays(t: Tables) -> DataFrame:
    sides = t["games"].select("game_id", "home_team", "away_team")
    return (
        t["plays"].groupBy("game_id", "team_tricode").agg(F.count(F.lit(1)).alias("play_count"))
        .join(sides, "game_id")
        .filter(~F.col("team_tricode").isin(F.col("home_team"), F.col("away_team")))
        .select("game_id", "team_tricode", "home_team", "away_team", "play_count")
    )


def foreign_team_in_states(t: Tables) -> DataFrame:
    sides = t["games"].select("game_id", "home_team", "away_team")
    return (
        t["states"].groupBy("game_id", "home", "away").agg(F.count(F.lit(1)).alias("state_count"))
        .join(sides, "game_id")
        .filter((F.col("home") != F.col("home_team")) | (F.col("away") != F.col("away_team")))
        .select("game_id", "home", "away", "home_team", "away_team", "state_count")
    )


def _codes(games: DataFrame) -> DataFrame:
    return games.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()


def _unknown(codes: DataFrame, teams: DataFrame) -> DataFrame:
    known = teams.select(F.col("abbreviation").alias("team"))
    return codes.join(known, "team", "left_anti")


def unknown_teams(t: Tables) -> DataFrame:
    return _unknown(_codes(t["games"]), t["teams"])


def unknown_active_teams(t: Tables) -> DataFrame:
    """As above for counted games of the seasons in ``t["active_seasons"]``."""
    active = t["games"].filter(
        counted(t["games"]) & F.col("season").isin(list(t["active_seasons"]))
    )
    return _unknown(_codes(active), t["teams"])


def foreign_team_in_box(t: Tables) -> DataFrame:
    sides = t["games"].select("game_id", "home_team", "away_team")
    return (
        t["team_box"].select("game_id", "team_id").join(sides, "game_id")
        .filter(~F.col("team_id").isin(F.col("home_team"), F.col("away_team")))
    )


@dataclass(frozen=True)
class Rule:
    severity: str
    category: str
    message: str
    rows: Callable[[Tables], DataFrame]
    fixable: bool = False


RULES: dict[str, Rule] = {
    "FLAG-001": Rule("critical", "Flag", "Finalized without a final state", finalized_without_final_state, True),
    "FLAG-002": Rule("critical", "Flag", "Finalized without plays", finalized_without_plays, True),
    "FLAG-003": Rule("critical", "Flag", "Pre-game done without features", pregame_without_features),
    "FLAG-004": Rule("warning", "Flag", "Pre-game done without earlier games", pregame_without_history),
    "FLAG-005": Rule("critical", "Flag", "Pre-game done before the game's data", pregame_before_data, True),
    "FLAG-006": Rule("warning", "Flag", "Ended but not finalized", ended_but_not_finalized, True),
    "TEAM-001": Rule("critical", "Team", "Play team is not in the game", foreign_team_in_plays),
    "TEAM-002": Rule("critical", "Team", "State teams differ from the schedule", foreign_team_in_states),
    "TEAM-003": Rule("warning", "Team", "Scheduled team is unknown", unknown_teams),
    "TEAM-004": Rule("critical", "Team", "Active team is unknown", unknown_active_teams),
    "TEAM-005": Rule("critical", "Team", "Box team is not in the game", foreign_team_in_box),
    "INTEGRITY-001": Rule("critical", "Integrity", "Plays without a game", orphan_plays, True),
    "INTEGRITY-002": Rule("critical", "Integrity", "States without a game", orphan_states, True),
    "INTEGRITY-003": Rule("critical", "Integrity", "Features without a game", orphan_features, True),
    "INTEGRITY-004": Rule("warning", "Integrity", "Predictions without a game", orphan_predictions, True),
    "INTEGRITY-005": Rule("critical", "Integrity", "Nulls in key fields", null_key_fields),
    "INTEGRITY-006": Rule("critical", "Integrity", "Repeated states", repeated_states, True),
    "SCORE-001": Rule("critical", "Score", "Score fell within a period", falling_scores),
    "SCORE-002": Rule("critical", "Score", "Negative score", negative_scores),
    "SCORE-003": Rule("critical", "Score", "Several final scores", differing_finals),
    "SCORE-004": Rule("warning", "Score", "Score jumped", score_jumps),
    "VOL-001": Rule("warning", "Volume", "Unusual number of plays", unusual_play_counts),
    "VOL-002": Rule("warning", "Volume", "Plays and states differ in number", differing_counts),
    "TEMP-001": Rule("warning", "Temporal", "Completed in the future", completed_in_future),
    "TEMP-002": Rule("warning", "Temporal", "Play ids out of order", out_of_order_ids),
}


def _firsts(sample: int):
    """Per task and rule: how many rows, and the ``sample`` first of them by their text."""

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}
        first: dict[str, list[str]] = {}
        for batch in batches:
            for rule in batch.column("check_id").unique().to_pylist():
                rows = batch.column("row").filter(pc.equal(batch.column("check_id"), rule))
                count[rule] = count.get(rule, 0) + len(rows)
                least = rows.take(pc.sort_indices(rows)[:sample]).to_pylist()
                first[rule] = sorted([*first.get(rule, []), *least])[:sample]
        columns = [list(count), list(count.values()), [first[r] for r in count]]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["check_id", "count", "sample"])

    return firsts


def validation_report(
    t: Tables, categories: list[str] | None = None, sample: int = 5
) -> DataFrame:
    """One row per rule that found something: true count and the first rows as JSON.

    Rules of unknown categories are ignored. Each task counts its rows by rule and keeps
    the ``sample`` first of them by their text, so that a rule sends one row per task
    through the shuffle and the samples are exact. Whether any game has too many states
    for one task is counted once for all rules.
    """
    chosen = {
        i: r for i, r in RULES.items() if categories is None or r.category in categories
    }
    if any(r.rows in (falling_scores, score_jumps, out_of_order_ids) for r in chosen.values()):
        t = t | {"no_large_games": range_cuts(t["states"], ["game_id"], ["play_id"], RANGE_ROWS) is None}
    told = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"}
    found = reduce(
        DataFrame.unionByName,
        [
            r.rows(t).select(F.lit(i).alias("check_id"), F.to_json(F.struct("*"), told).alias("row"))
            for i, r in chosen.items()
        ],
    )
    parts = found.mapInArrow(_firsts(sample), "check_id string, count long, sample array<string>")
    counts = parts.groupBy("check_id").agg(
        F.sum("count").alias("count"),
        F.slice(F.array_sort(F.flatten(F.collect_list("sample"))), 1, sample).alias("sample"),
    )
    spark = counts.sparkSession
    about = spark.createDataFrame(
        [(i, r.severity, r.category, r.message, r.fixable) for i, r in chosen.items()],
        "check_id string, severity string, category string, message string, fixable boolean",
    )
    return about.join(counts, "check_id")


def severity_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("severity").agg(
        F.count(F.lit(1)).alias("issues"), F.sum("count").alias("rows")
    )
