"""Read-side views: nested games, condensed plays, players and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.clock import clock_label
from matchlake.functions.labels import pick_percent, pick_winner, when_label
from matchlake.operators.scan import RANGE_ROWS, range_scan

PAGE_PLAYS = 1000


def _paged(plays: DataFrame, newest_first: bool, page_plays: int, most: int = RANGE_ROWS) -> DataFrame:
    """Number a game's plays by id and cut them into pages of bounded length."""
    play_id = F.coalesce("order_number", "action_id").cast("long")
    rows = plays.withColumn("play_id", play_id)
    rows = rows.withColumn("rank_id", -F.col("play_id") if newest_first else F.col("play_id"))
    # Scanned by game: the pages, and what joins them by game, need no further exchange.
    ranked = range_scan(rows, ["game_id"], ["rank_id"], {"position": ("count", None)}, most)
    page = F.floor((F.col("position") - 1) / page_plays).cast("int")
    return ranked.withColumn("page", page)


def condensed_plays(plays: DataFrame, page_plays: int = PAGE_PLAYS) -> DataFrame:
    """Newest-first short plays; one row per game and page of plays."""
    entry = F.struct(
        "position",
        clock_label(F.col("clock"), F.col("period")).alias("time_info"),
        F.col("score_home").alias("home_score"),
        F.col("score_away").alias("away_score"),
        "description",
    )
    return (
        _paged(plays, True, page_plays)
        .groupBy("game_id", "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("condensed"))
    )


def game_view(
    games: DataFrame,
    plays: DataFrame,
    latest: DataFrame,
    predictions: DataFrame,
    page_plays: int = PAGE_PLAYS,
) -> DataFrame:
    """A game with its plays, latest state and stored prediction.

    A game of at most ``page_plays`` plays is one row; a longer one continues on
    further rows with a higher ``page``, so no row grows without bound. Plays
    are nested before the joins, which therefore never multiply rows.
    """
    entry = F.struct("play_id", "period", "clock", "score_home", "score_away", "description")
    pages = (
        _paged(plays, False, page_plays)
        .groupBy("game_id", "page")
        .agg(F.array_sort(F.collect_list(entry)).alias("play_by_play"))
    )
    state = latest.select(
        "game_id",
        F.struct(
            "play_id", "clock", "period", "home_score", "away_score", "is_final_state"
        ).alias("state"),
    )
    stored = predictions.select(
        "game_id",
        F.struct(
            "prediction_ts", "pred_home_score", "pred_away_score", "pred_home_win_pct"
        ).alias("pre_game"),
    )
    return (
        games.join(pages, "game_id", "left")
        .join(state, "game_id", "left")
        .join(stored, "game_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
    )


def player_board(players: DataFrame, k: int) -> DataFrame:
    """The k players of each game and side with most predicted points."""
    order = Window.partitionBy("game_id", "side").orderBy(
        F.desc("pred_points"), F.asc("person_id")
    )
    return players.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def game_display(
    games: DataFrame, latest: DataFrame, live: DataFrame, zone: str, today: str
) -> DataFrame:
    """Display columns of each game as of a day in a zone."""
    state = latest.select(
        "game_id", "clock", "period", "home_score", "away_score", "is_final_state"
    )
    rows = games.join(state, "game_id", "left").join(live, "game_id", "left")
    chance = F.col("pred_home_win_pct")
    return rows.select(
        "game_id",
        F.date_format("start", "yyyy-MM-dd").alias("game_date"),
        F.date_format("start", "HH:mm:ss").alias("game_time"),
        F.col("home_team").alias("home"),
        F.col("away_team").alias("away"),
        F.col("status").alias("game_status"),
        "home_score",
        "away_score",
        when_label(
            F.col("status"), F.col("start"), F.col("period"), F.col("clock"),
            F.col("is_final_state"), zone, F.lit(today).cast("date"),
        ).alias("datetime_display"),
        F.bround("pred_home_score", 0).cast("int").alias("pred_home_score"),
        F.bround("pred_away_score", 0).cast("int").alias("pred_away_score"),
        pick_winner(chance, F.col("home_team"), F.col("away_team")).alias("pred_winner"),
        pick_percent(chance).alias("pred_win_pct"),
    )


def game_pages(display: DataFrame, board: DataFrame, condensed: DataFrame) -> DataFrame:
    """Display rows with each side's best players and the condensed plays.

    One row per game and page of plays, newest first; a game without plays has page 0.
    Players are at most as many as the board holds, so no row grows without bound.
    """
    entry = F.struct("place", "person_id", "name", "points", "pred_points")
    best = board.groupBy("game_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("side") == side, entry))).alias(f"{side}_players")
            for side in ("home", "away")
        ]
    )
    return (
        display.join(best, "game_id", "left")
        .join(condensed, "game_id", "left")
        .withColumn("page", F.coalesce("page", F.lit(0)))
    )
