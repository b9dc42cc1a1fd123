"""Plays → event-time game states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions.clock import clock_seconds
from matchlake.functions.text import points_in_text
from matchlake.operators.scan import RANGE_ROWS, range_scan

END_OF_GAME = "Game End"


def _placed(plays: DataFrame) -> DataFrame:
    """Add the order of play: period, most clock first, id.

    Missing periods, clocks and ids come first. Plays equal in all three follow a
    hash of their content. Plays that name no game have no place.
    """
    play_id = F.coalesce("order_number", "action_id").cast("long")
    return plays.filter(F.col("game_id").isNotNull()).withColumns(
        {
            "play_id": play_id,
            "clock_left": -clock_seconds(F.col("clock")),
            "tie": F.xxhash64(*plays.columns),
        }
    )


_ORDER = ["period", "clock_left", "play_id", "tie"]
_WORK = ["clock_left", "tie"]


def play_order(plays: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """Plays with ``play_id`` and their 1-based ``position`` in the game.

    A game of more than ``most`` plays is cut into ranges, here as in all that
    follows the order of play.
    """
    out = range_scan(_placed(plays), ["game_id"], _ORDER, {"position": ("count", None)}, most)
    return out.drop(*_WORK)


def reported(text: str) -> Column:
    """Reported score; blank text counts as not reported."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("int")


def unreadable() -> Column:
    """A play that cannot be placed or, in the running feed, scored."""
    unplaced = (
        F.coalesce("order_number", "action_id").isNull()
        | F.col("period").isNull()
        | clock_seconds(F.col("clock")).isNull()
    )
    unscored = (
        F.col("order_number").isNotNull()
        & F.col("description").isNotNull()
        & (reported("score_home").isNull() | reported("score_away").isNull())
    )
    return unplaced | unscored


def malformed_games(plays: DataFrame) -> DataFrame:
    """Games with an unreadable play."""
    return plays.filter(unreadable()).select("game_id").distinct()


def game_states(games: DataFrame, plays: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """One state per described play, for both feeds.

    The first play in order decides a game's feed. The running one reports
    scores on each play and ends with a ``Game End`` play; in the other, scores
    carry forward from the last play that reported them and the last play ends
    the game when its sub-type is ``end``. Games with an unreadable play are left
    out, see ``malformed_games``.
    """
    described = F.col("description").isNotNull()
    placed = _placed(plays.filter(described)).select(
        "game_id", "play_id", "period", "clock", "description", "sub_type",
        F.col("order_number").isNotNull().alias("is_running"),
        unreadable().alias("is_unreadable"),
        reported("score_home").alias("told_home"),
        reported("score_away").alias("told_away"),
        *_WORK,
    )
    scanned = range_scan(
        placed,
        ["game_id"],
        _ORDER,
        {
            "running_feed": ("first", "is_running"),
            "known_home": ("last", "told_home"),
            "known_away": ("last", "told_away"),
            "is_last": ("is_last", None),
            "is_spoilt": ("any", "is_unreadable"),
        },
        most,
    ).filter(~F.col("is_spoilt"))
    home = F.when(F.col("running_feed"), F.col("told_home")).otherwise(
        F.coalesce("known_home", F.lit(0))
    )
    away = F.when(F.col("running_feed"), F.col("told_away")).otherwise(
        F.coalesce("known_away", F.lit(0))
    )
    final = F.when(
        F.col("running_feed"), F.col("description") == END_OF_GAME
    ).otherwise(F.col("is_last") & F.coalesce(F.col("sub_type") == "end", F.lit(False)))
    # Undescribed plays give no state but can spoil a game; that filter reaches the
    # scan. Joining them here leaves one join for a busy game's plays.
    info = games.select(
        "game_id",
        F.to_date("start").alias("game_date"),
        F.col("home_team").alias("home"),
        F.col("away_team").alias("away"),
    ).join(malformed_games(plays.filter(~described)), "game_id", "left_anti")
    return (
        scanned.select(
            "game_id",
            "play_id",
            "clock",
            "period",
            home.alias("home_score"),
            away.alias("away_score"),
            final.alias("is_final_state"),
        )
        .withColumns(
            {
                "total": F.col("home_score") + F.col("away_score"),
                "home_margin": F.col("home_score") - F.col("away_score"),
            }
        )
        .join(info, "game_id")
    )


def player_events(games: DataFrame, plays: DataFrame) -> DataFrame:
    """Plays that name a player, with the side and any points total reported.

    The side is home only if the play's team is the home team. Player id 0 and
    blank names count only in the running feed.
    """
    running = F.col("order_number").isNotNull()
    named = F.col("person_id").isNotNull() & F.col("player_name").isNotNull()
    usable = named & (running | ((F.col("person_id") != 0) & (F.col("player_name") != "")))
    told = F.when(running, F.col("points_total")).otherwise(
        points_in_text(F.col("description"))
    )
    at_home = F.coalesce(F.col("team_tricode") == F.col("home_team"), F.lit(False))
    return (
        plays.filter(usable & F.col("description").isNotNull())
        .join(games.select("game_id", "home_team"), "game_id")
        .select(
            "game_id",
            F.when(at_home, F.lit("home")).otherwise(F.lit("away")).alias("side"),
            "person_id",
            "player_name",
            "period",
            "clock",
            "order_number",
            "action_id",
            told.alias("told_points"),
        )
    )


def player_timeline(games: DataFrame, plays: DataFrame, most: int = RANGE_ROWS) -> DataFrame:
    """Points of a player as of each of their plays; 0 until first reported."""
    placed = _placed(player_events(games, plays)).select(
        "game_id", "side", "person_id", "player_name", "play_id", "period",
        "told_points", *_WORK,
    )
    out = range_scan(
        placed,
        ["game_id", "side", "person_id"],
        _ORDER,
        {"name": ("first", "player_name"), "latest": ("last", "told_points")},
        most,
    )
    return out.select(
        "game_id", "play_id", "side", "person_id", "name",
        F.coalesce("latest", F.lit(0)).alias("points"),
    )


def players_snapshot(games: DataFrame, plays: DataFrame) -> DataFrame:
    """Each player's name and points after the last play, one row per player."""
    rows = player_events(games, plays).select(
        "game_id", "side", "person_id", "player_name", "told_points",
        F.struct(
            "period",
            (-clock_seconds(F.col("clock"))).alias("clock_left"),
            F.coalesce("order_number", "action_id").cast("long").alias("play_id"),
        ).alias("place"),
    )
    return rows.groupBy("game_id", "side", "person_id").agg(
        F.min_by("player_name", "place").alias("name"),
        F.coalesce(
            F.max_by("told_points", F.when(F.col("told_points").isNotNull(), F.col("place"))),
            F.lit(0),
        ).alias("points"),
    )


def player_maps(snapshot: DataFrame, pages: int = 1) -> DataFrame:
    """Nested form, a map of players per game and side.

    With more than one page the players are spread over that many maps, for
    games with more players than one row should hold.
    """
    page = F.pmod(F.xxhash64("person_id"), F.lit(pages)).cast("int")
    entry = F.struct(
        F.col("person_id").cast("string").alias("key"),
        F.struct("name", "points").alias("value"),
    )
    return (
        snapshot.groupBy("game_id", "side", page.alias("page"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("players"))
    )


def latest_state(states: DataFrame) -> DataFrame:
    """The state with the largest play id of each game."""
    rest = [c for c in states.columns if c not in ("game_id",)]
    # The whole row breaks ties between repeated ids the same way every time.
    best = states.groupBy("game_id").agg(
        F.max(F.struct("play_id", *[c for c in rest if c != "play_id"])).alias("__s")
    )
    return best.select("game_id", *[F.col(f"__s.{c}").alias(c) for c in rest])


def final_states(states: DataFrame) -> DataFrame:
    """Final scores of each game, from its highest final play id."""
    # One maximum over the whole row, so that repeated ids cannot mix two of them.
    last = F.max(F.struct("play_id", "home_score", "away_score")).alias("last")
    finals = states.filter("is_final_state").groupBy("game_id").agg(last)
    return finals.select("game_id", "last.home_score", "last.away_score", "last.play_id")


def finalize_games(games: DataFrame, states: DataFrame) -> DataFrame:
    """Set the data flag of games that have a final state."""
    ended = states.groupBy("game_id").agg(F.bool_or("is_final_state").alias("__ended"))
    return games.join(ended, "game_id", "left").withColumn(
        "game_data_finalized",
        F.col("game_data_finalized") | F.coalesce("__ended", F.lit(False)),
    ).drop("__ended")
