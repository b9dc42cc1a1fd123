"""What each team had done strictly before a start time.

Every measure is a prefix of sums along (season, team, start), so no game is
ever paired with its earlier games. Rows are summed per start before the first
shuffle, and one window runs over the distinct starts of a team's season. Their
number is bounded by the calendar, not by the data: schedules carry whole
seconds, and in practice a team has a few hundred.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.seasons import COUNTED_SEASON_TYPES
from matchlake.operators.scan import RANGE_ROWS, range_scan

TEAM = ["season", "team"]
#: Earlier games on one page of a list.
PAGE_GAMES = 50
#: Pages of a team's season that asked games meet at once.
BLOCK_PAGES = 64


def counted(games: DataFrame) -> Column:
    return F.col("season_type").isin(*COUNTED_SEASON_TYPES)


def team_rows(games: DataFrame, *columns: str) -> DataFrame:
    """Two rows per game, one for each side, with the named game columns."""
    sides = F.array(
        *[
            F.struct(F.lit(side).alias("side"), F.col(f"{side}_team").alias("team"))
            for side in ("home", "away")
        ]
    )
    kept = dict.fromkeys(["game_id", "season", "start", *columns])
    return games.select(*kept, F.inline(sides))


def sums_per_start(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*TEAM, "start").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()]
    )


def totals_before(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """(season, team, start) → each sum over the rows with an earlier start."""
    earlier = (
        Window.partitionBy(*TEAM)
        .orderBy("start")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return sums_per_start(rows, sums).select(
        *TEAM,
        "start",
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(n) for n in sums],
    )


def attach_sides(
    games: DataFrame, totals: DataFrame, names: list[str], tasks: int | None = None
) -> DataFrame:
    """Games with ``home_<name>`` and ``away_<name>`` from a per-start table.

    A game without a team, season or start keeps nulls there: it has no past. Rows
    grow wide here: ``tasks`` deals them to that many tasks if a shuffle has fewer.
    """
    out = games
    deal = tasks is not None and tasks > int(games.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for side in ("home", "away"):
        view = totals.select(
            "season",
            F.col("team").alias(f"{side}_team"),
            "start",
            *[F.col(n).alias(f"{side}_{n}") for n in names],
        )
        keys = ["season", f"{side}_team", "start"]
        if deal:
            out = out.repartition(tasks, *keys)
        out = out.join(view, keys, "left")
    return out


def prior_counts(games: DataFrame, finals: DataFrame) -> DataFrame:
    """Per game and side: earlier counted games, and how many have a final state.

    The ordered list of a side's earlier games is the team's games of the season
    with a smaller start; ``needed`` says how many there are. A side is missing
    when it has earlier games and none of them has a final state.
    """
    known = finals.select("game_id", F.lit(1).alias("has_final"))
    rows = team_rows(games.join(known, "game_id", "left"), "season_type", "has_final")
    totals = totals_before(
        rows,
        {
            "needed": F.when(counted(games), F.lit(1)),
            "loaded": F.when(counted(games), F.col("has_final")),
        },
    )
    wanted = team_rows(games)
    return wanted.join(totals, [*TEAM, "start"], "left").fillna(0, ["needed", "loaded"]).select(
        "game_id",
        "side",
        "season",
        "team",
        "start",
        "needed",
        "loaded",
        ((F.col("needed") > 0) & (F.col("loaded") == 0)).alias("is_missing"),
    )


def _asked(games: DataFrame, wanted: DataFrame) -> DataFrame:
    return team_rows(games.join(wanted.select("game_id").distinct(), "game_id", "left_semi"))


def prior_lists(
    games: DataFrame,
    finals: DataFrame,
    wanted: DataFrame,
    page_games: int = PAGE_GAMES,
    most: int = RANGE_ROWS,
    shape: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The earlier counted games of both sides of the wanted games, oldest first, in pages.

    One row per game, side and page: ``prior_ids`` (by start, then id) and ``missing_ids``
    (those of them without a final state), both as ``shape`` gives them. A team's season is
    numbered and cut into pages once. What a game asks for is a beginning of that numbering:
    whole pages, which are shaped once for all games, and a part of the last one. So asked
    games join blocks of pages, on (season, team, block), each pair is a row of the result,
    and a busy team is spread over its blocks. Sides without earlier games have no row.
    """
    known = finals.select(F.col("game_id").alias("prior_id"), F.lit(True).alias("has_final")).distinct()
    played = team_rows(games.filter(counted(games))).filter("season IS NOT NULL AND team IS NOT NULL AND start IS NOT NULL")
    have = played.select(*TEAM, F.col("game_id").alias("prior_id"), F.col("start").alias("prior_start"))
    ranked = range_scan(have, TEAM, ["prior_start", "prior_id"], {"place": ("count", None)}, most)
    page = F.floor((F.col("place") - 1) / page_games).alias("page")
    entry = F.struct("place", "prior_id", "prior_start", F.coalesce("has_final", F.lit(False)).alias("has_final"))
    pages = (
        ranked.join(known, "prior_id", "left")
        .groupBy(*TEAM, page)
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )
    asked = _asked(games, wanted)
    # A start at which no counted game was played has a place among those that were.
    marked = sums_per_start(played.select(*TEAM, "start", F.lit(1).alias("n")).unionByName(asked.select(*TEAM, "start", F.lit(0).alias("n"))), {"n": F.col("n")})
    earlier = Window.partitionBy(*TEAM).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = marked.select(*TEAM, "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("needed"))
    asked = asked.join(before.filter("needed > 0"), [*TEAM, "start"]).withColumn("last", F.floor((F.col("needed") - 1) / page_games))

    def listed(entries: Column) -> list[Column]:
        given = [F.transform(e, lambda x: x["prior_id"]) for e in (entries, F.filter(entries, lambda x: ~x["has_final"]))]
        return [(e if shape is None else shape(e)).alias(n) for e, n in zip(given, ("prior_ids", "missing_ids"))]

    shown = ["game_id", "side", "page", "prior_ids", "missing_ids"]
    block = F.floor(F.col("page") / BLOCK_PAGES).alias("block")
    whole = pages.select(*TEAM, block, "page", *listed(F.col("entries")))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / BLOCK_PAGES))
    reached = asked.filter("last > 0").withColumn("block", F.explode(blocks))
    inside = F.filter("entries", lambda e: e["prior_start"] < F.col("start"))
    rest = asked.withColumnRenamed("last", "page").join(pages, [*TEAM, "page"])
    return (
        reached.join(whole, [*TEAM, "block"])
        .filter("page < last")
        .select(*shown)
        .unionByName(rest.select("game_id", "side", "page", *listed(inside)))
    )


def prior_ids(games: DataFrame, wanted: DataFrame) -> DataFrame:
    """The distinct games that the wanted games' lists hold, without forming the lists.

    They are a team's counted games of a season before the latest start that is asked for.
    """
    latest = _asked(games, wanted).groupBy(*TEAM).agg(F.max("start").alias("latest"))
    have = team_rows(games.filter(counted(games)))
    return have.join(latest, TEAM).filter(F.col("start") < F.col("latest")).select("game_id").distinct()


def games_needing_pregame(games: DataFrame) -> DataFrame:
    """Counted games without pre-game data that can have it now.

    Started ones always; future ones once no earlier game of either team in the
    season is still open.
    """
    played = games.filter(counted(games))
    totals = totals_before(
        team_rows(played, "game_data_finalized"),
        {"open_games": (~F.col("game_data_finalized")).cast("int")},
    )
    todo = attach_sides(
        played.filter(~F.col("pre_game_data_finalized")), totals, ["open_games"]
    ).fillna(0, ["home_open_games", "away_open_games"])
    ready = (F.col("status") == "Not Started") & (
        F.col("home_open_games") + F.col("away_open_games") == 0
    )
    return todo.filter(F.col("status").isin("Completed", "In Progress") | ready).select(
        "game_id"
    )
