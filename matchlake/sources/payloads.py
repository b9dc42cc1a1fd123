"""Landed JSON payloads → rows.

Payloads are read with a fixed schema, either from files (``read_payloads``) or
from a text column (``parse_payloads``), and flattened with ``inline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.seasons import season_type_of, status_of
from matchlake.functions.text import first_name, last_name, played_minutes

PLAYS_SCHEMA = (
    "game STRUCT<actions: ARRAY<STRUCT<orderNumber: BIGINT, actionId: BIGINT, period: INT, "
    "clock: STRING, scoreHome: STRING, scoreAway: STRING, description: STRING, "
    "teamTricode: STRING, personId: BIGINT, playerNameI: STRING, pointsTotal: INT, "
    "subType: STRING>>>"
)
SCHEDULE_SCHEMA = (
    "leagueSchedule STRUCT<gameDates: ARRAY<STRUCT<games: ARRAY<STRUCT<gameId: STRING, "
    "gameStatus: INT, gameDateTimeEst: STRING, homeTeam: STRUCT<teamTricode: STRING>, "
    "awayTeam: STRUCT<teamTricode: STRING>>>>>>"
)

# Stored column → payload statistic.
TEAM_STATS = {
    "reb": "reboundsTotal",
    "ast": "assists",
    "stl": "steals",
    "blk": "blocks",
    "tov": "turnovers",
    "pf": "foulsPersonal",
    "fga": "fieldGoalsAttempted",
    "fgm": "fieldGoalsMade",
    "fg_pct": "fieldGoalsPercentage",
    "fg3a": "threePointersAttempted",
    "fg3m": "threePointersMade",
    "fg3_pct": "threePointersPercentage",
    "fta": "freeThrowsAttempted",
    "ftm": "freeThrowsMade",
    "ft_pct": "freeThrowsPercentage",
    "plus_minus": "plusMinusPoints",
}
PLAYER_ONLY_STATS = {"oreb": "reboundsOffensive", "dreb": "reboundsDefensive"}

_STATS = ", ".join(
    f"{s}: {'DOUBLE' if s.endswith('Percentage') else 'INT'}"
    for s in ["points", *TEAM_STATS.values(), *PLAYER_ONLY_STATS.values()]
)
_TEAM = (
    f"STRUCT<teamId: BIGINT, teamTricode: STRING, score: INT, statistics: STRUCT<{_STATS}>, "
    "players: ARRAY<STRUCT<personId: BIGINT, firstName: STRING, familyName: STRING, "
    f"name: STRING, position: STRING, statistics: STRUCT<minutes: STRING, {_STATS}>>>>"
)
BOX_SCHEMA = f"boxScoreTraditional STRUCT<homeTeam: {_TEAM}, awayTeam: {_TEAM}>"
LIVE_BOX_SCHEMA = f"game STRUCT<homeTeam: {_TEAM}, awayTeam: {_TEAM}>"
ROWSET_SCHEMA = "resultSets ARRAY<STRUCT<rowSet: ARRAY<ARRAY<STRING>>>>"


def read_payloads(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of one JSON document each (or per line), with their path."""
    return spark.read.schema(schema).json(path).withColumn("path", F.input_file_name())


def parse_payloads(rows: DataFrame, schema: str, text: str = "payload") -> DataFrame:
    """The payload's top fields next to the other columns; all null if unreadable."""
    kept = [c for c in rows.columns if c != text]
    return rows.withColumn("__p", F.from_json(text, schema)).select(*kept, "__p.*")


def flatten_plays(payloads: DataFrame) -> DataFrame:
    return payloads.select("game_id", F.inline("game.actions")).select(
        "game_id",
        F.col("orderNumber").alias("order_number"),
        F.col("actionId").alias("action_id"),
        "period",
        "clock",
        F.col("scoreHome").alias("score_home"),
        F.col("scoreAway").alias("score_away"),
        "description",
        F.col("teamTricode").alias("team_tricode"),
        F.col("personId").alias("person_id"),
        F.col("playerNameI").alias("player_name"),
        F.col("pointsTotal").alias("points_total"),
        F.col("subType").alias("sub_type"),
    )


def with_fallback(primary: DataFrame, fallback: DataFrame, body: str = "game") -> DataFrame:
    """Payloads of the primary source, others only for games it failed to give.

    An empty list from the primary is an answer; a missing body is a failure.
    """
    given = primary.filter(F.col(body).isNotNull())
    return given.unionByName(fallback.join(given.select("game_id"), "game_id", "left_anti"))


def flatten_schedule(payloads: DataFrame) -> DataFrame:
    games = payloads.select("season", F.explode("leagueSchedule.gameDates").alias("d")).select(
        "season", F.inline("d.games")
    )
    return games.select(
        F.col("gameId").alias("game_id"),
        F.col("gameDateTimeEst").alias("start_text"),
        F.col("homeTeam.teamTricode").alias("home_team"),
        F.col("awayTeam.teamTricode").alias("away_team"),
        status_of(F.col("gameStatus")).alias("status"),
        "season",
        season_type_of(F.col("gameId")).alias("season_type"),
    )


def _sides(payloads: DataFrame, body: str) -> DataFrame:
    """One row per team with the other team next to it.

    Unreadable payloads drop out by their null team after the generator, so the
    text is parsed once and not a second time for a filter below it.
    """
    home, away = F.col(f"{body}.homeTeam"), F.col(f"{body}.awayTeam")
    pairs = F.array(
        F.struct(home.alias("team"), away.alias("other")),
        F.struct(away.alias("team"), home.alias("other")),
    )
    return payloads.select("game_id", F.inline(pairs)).filter(F.col("team.teamId").isNotNull())


def _stats(names: dict[str, str]) -> list[Column]:
    return [F.col(f"team.statistics.{s}").alias(c) for c, s in names.items()]


def team_stats(payloads: DataFrame, live: bool = False) -> DataFrame:
    """One row per team; the in-progress format carries points as ``score``.

    Points allowed are the other team's, null when the payload has one team.
    """

    def points(team: str) -> Column:
        if not live:
            return F.col(f"{team}.statistics.points")
        return F.when(
            F.col(f"{team}.teamId").isNotNull(), F.coalesce(f"{team}.score", F.lit(0))
        )

    return _sides(payloads, "game" if live else "boxScoreTraditional").select(
        F.col("team.teamId").cast("string").alias("team_id"),
        "game_id",
        points("team").alias("pts"),
        points("other").alias("pts_allowed"),
        *_stats(TEAM_STATS),
    )


def player_stats(payloads: DataFrame, live: bool = False) -> DataFrame:
    """One row per player of both teams."""
    if live:
        name = F.coalesce("name", F.lit(""))
        position = F.coalesce("position", F.lit(""))
    else:
        name = F.trim(
            F.concat_ws(
                " ", F.coalesce("firstName", F.lit("")), F.coalesce("familyName", F.lit(""))
            )
        )
        position = F.col("position")
    rows = _sides(payloads, "game" if live else "boxScoreTraditional").select(
        "game_id", F.col("team.teamId").cast("string").alias("team_id"), F.inline("team.players")
    )
    stats = TEAM_STATS | PLAYER_ONLY_STATS
    return rows.select(
        F.col("personId").alias("player_id"),
        "game_id",
        "team_id",
        name.alias("player_name"),
        position.alias("position"),
        played_minutes(F.col("statistics.minutes")).alias("min"),
        F.col("statistics.points").alias("pts"),
        *[F.col(f"statistics.{s}").alias(c) for c, s in stats.items()],
    )


# Positions in a player row set.
ROWSET_POSITIONS = {
    "person_id": 0,
    "name": 1,
    "full_name": 2,
    "roster_status": 3,
    "from_year": 4,
    "to_year": 5,
    "team_name": 11,
}


def players_from_rowset(payloads: DataFrame) -> DataFrame:
    rows = payloads.select(F.explode(F.get("resultSets", F.lit(0)).getField("rowSet")).alias("r"))
    named = rows.select(
        *[F.get("r", F.lit(i)).alias(c) for c, i in ROWSET_POSITIONS.items()]
    )
    return named.select(
        F.col("person_id").try_cast("long").alias("person_id"),
        first_name(F.col("name")).alias("first_name"),
        last_name(F.col("name")).alias("last_name"),
        "full_name",
        "from_year",
        "to_year",
        F.col("roster_status").try_cast("int").alias("roster_status"),
        "team_name",
    )


def append_quarantine(rows: DataFrame, path: str) -> None:
    """Append failed records (moment, game, reason) as CSV with a header."""
    rows.select("moment", "game_id", "error").write.mode("append").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
