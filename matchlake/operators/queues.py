"""Which games a stage still has to work on, and keyed lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.seasons import FINISHED
from matchlake.operators.history import counted


def _season(games: DataFrame, season: str | None) -> DataFrame:
    rows = games.filter(counted(games))
    return rows if season is None else rows.filter(F.col("season") == season)


def needing_collection(games: DataFrame, season: str | None = None) -> DataFrame:
    finished = F.col("status").isin(*FINISHED)
    return _season(games, season).filter(finished & ~F.col("game_data_finalized")).select("game_id")


def in_progress(games: DataFrame, season: str | None = None) -> DataFrame:
    return _season(games, season).filter(F.col("status") == "In Progress").select("game_id")


def on_date(games: DataFrame, day: str) -> DataFrame:
    """A range on ``start`` itself, so the filter reaches the scan."""
    first = F.lit(day).cast("timestamp_ntz")
    after = first + F.make_dt_interval(F.lit(1))
    return games.filter((F.col("start") >= first) & (F.col("start") < after)).select("game_id")


def needing_box(games: DataFrame, box: DataFrame, season: str | None = None) -> DataFrame:
    """Finalized games without a player box row, oldest first."""
    done = _season(games, season).filter(
        F.col("status").isin(*FINISHED) & F.col("game_data_finalized")
    )
    return (
        done.join(box.select("game_id").distinct(), "game_id", "left_anti")
        .orderBy("start", "game_id")
        .select("game_id", "start")
    )


def needing_prediction(
    games: DataFrame, predictions: DataFrame, predictor: str, season: str | None = None
) -> DataFrame:
    have = predictions.filter(F.col("predictor") == predictor).select("game_id")
    ready = _season(games, season).filter("pre_game_data_finalized")
    return ready.join(have, "game_id", "left_anti").select("game_id")


def lookup(games: DataFrame, wanted: DataFrame) -> DataFrame:
    return games.join(wanted.select("game_id").distinct(), "game_id", "left_semi").select(
        "game_id", "home_team", "away_team", "start", "status", "season", "season_type"
    )


def lookup_missing(games: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.select("game_id").distinct().join(games, "game_id", "left_anti")


def seasons_outside(seasons: DataFrame, allowed: DataFrame) -> DataFrame:
    """Asked-for seasons that are not allowed; empty means a subset."""
    return seasons.select("season").distinct().join(allowed.distinct(), "season", "left_anti")


def refresh_due(
    seasons: DataFrame, log: DataFrame, current: str, as_of: str, minutes: float = 5.0
) -> DataFrame:
    """The current season always; others when never or too long ago refreshed."""
    age = F.timestamp_diff("SECOND", F.col("last_update"), F.lit(as_of).cast("timestamp_ntz")) / 60
    due = (F.col("season") == current) | F.col("last_update").isNull() | (age > minutes)
    return seasons.join(log, "season", "left").select("season", due.alias("is_due"))


def finalize_pregame(games: DataFrame, priors: DataFrame) -> DataFrame:
    """The pre-game flag is set when neither side misses its earlier states."""
    missing = priors.groupBy("game_id").agg(F.bool_or("is_missing").alias("__missing"))
    return (
        games.join(missing, "game_id", "left")
        .withColumn(
            "pre_game_data_finalized",
            F.when(F.col("__missing").isNull(), F.col("pre_game_data_finalized")).otherwise(
                ~F.col("__missing")
            ),
        )
        .drop("__missing")
    )
