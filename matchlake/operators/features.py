"""The 43 point-in-time features of a game."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.history import (
    TEAM,
    attach_sides,
    counted,
    sums_per_start,
    team_rows,
)

HALF_LIFE_DAYS = 10
FARTHEST = 300.0
DENSITY_DAYS = (5, 10, 30)
_SUMS = ["n", "wins", "pts", "opp", "home_n", "home_wins", "home_pts", "home_opp"]
_DECAYED = ["n", "wins", "pts", "opp"]
_PER_SIDE = [
    *_SUMS,
    *[f"decayed_{x}" for x in _DECAYED],
    "rest",
    "season_day",
    "density",
]

# The four figures of a team's form.
_FIGURES = ("Win_Pct", "PPG", "OPP_PPG", "Net_PPG")

BASIC = [
    *[f"Home_{f}" for f in _FIGURES],
    *[f"Away_{f}" for f in _FIGURES],
    *[f"{f}_Diff" for f in _FIGURES],
]
CONTEXT = [
    *[f"Home_{f}_Home" for f in _FIGURES],
    *[f"Away_{f}_Away" for f in _FIGURES],
    *[f"{f}_Home_Away_Diff" for f in _FIGURES],
]
DECAY = [
    *[f"Time_Decay_Home_{f}" for f in _FIGURES],
    *[f"Time_Decay_Away_{f}" for f in _FIGURES],
    *[f"Time_Decay_{f}_Diff" for f in _FIGURES],
]
REST = [
    "Day_of_Season",
    "Home_Rest_Days",
    "Home_Game_Freq",
    "Away_Rest_Days",
    "Away_Game_Freq",
    "Rest_Days_Diff",
    "Game_Freq_Diff",
]
FEATURES = [*BASIC, *CONTEXT, *DECAY, *REST]


def team_form(games: DataFrame, finals: DataFrame) -> DataFrame:
    """(season, team, start) → everything the features need about the past.

    ``finals`` has one row per game with its final scores. Games without one, or
    outside the regular and post season, still get a row but add nothing to it.
    """
    scored = games.join(
        finals.select("game_id", "home_score", "away_score"), "game_id", "left"
    )
    rows = team_rows(scored, "season_type", "home_score", "away_score")
    at_home = F.col("side") == "home"
    own = F.when(at_home, F.col("home_score")).otherwise(F.col("away_score"))
    other = F.when(at_home, F.col("away_score")).otherwise(F.col("home_score"))
    rows = rows.withColumns({"own": own, "other": other, "at_home": at_home})
    used = counted(games) & F.col("own").isNotNull() & F.col("other").isNotNull()
    one = {
        "n": F.lit(1),
        "wins": (F.col("own") > F.col("other")).cast("int"),
        "pts": F.col("own"),
        "opp": F.col("other"),
    }
    sums = {x: F.when(used, c) for x, c in one.items()}
    sums |= {f"home_{x}": F.when(used & F.col("at_home"), c) for x, c in one.items()}

    # Three windows over one sort: by start, then twice by day.
    by_start = Window.partitionBy(*TEAM).orderBy("day_no", "start")
    by_day = Window.partitionBy(*TEAM).orderBy("day_no")
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    before_day = by_day.rangeBetween(Window.unboundedPreceding, -1)
    rate = math.log(2) / HALF_LIFE_DAYS
    starts = sums_per_start(rows, sums).withColumn("day_no", F.unix_date(F.to_date("start")))
    # The anchor cancels in every ratio. Games dated far from their season count as
    # FARTHEST away from it, so that no weight leaves the range of doubles.
    named = F.make_date(F.substring("season", 1, 4).try_cast("int"), F.lit(7), F.lit(1))
    anchor = F.coalesce(F.unix_date(named), F.first("day_no").over(by_start))
    away = rate * (F.col("day_no") - anchor)
    starts = starts.withColumn("weight", F.exp(F.greatest(F.least(away, F.lit(FARTHEST)), F.lit(-FARTHEST))))
    played = F.when(F.col("n") > 0, F.col("day_no"))
    seen = starts.select(
        *TEAM,
        "start",
        "day_no",
        played.alias("played"),
        *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"sum_{x}") for x in _SUMS],
        *[
            F.coalesce(F.sum(F.col("weight") * F.col(x)).over(before), F.lit(0.0)).alias(
                f"decayed_{x}"
            )
            for x in _DECAYED
        ],
        F.min(played).over(before).alias("first_day"),
        F.max(played).over(before).alias("latest_day"),
    )
    # A day counts once, at the first start at which the team played on it.
    new_day = F.col("played").isNotNull() & ~F.coalesce(
        F.col("latest_day") == F.col("day_no"), F.lit(False)
    )
    dated = seen.withColumn("new_day", new_day.cast("int")).select(
        "*",
        F.max("played").over(before_day).alias("last_day"),
        *[
            F.coalesce(F.sum("new_day").over(by_day.rangeBetween(-k, -1)), F.lit(0)).alias(
                f"played_{k}"
            )
            for k in DENSITY_DAYS
        ],
    )
    season_day = F.col("day_no") - F.col("first_day")
    density = sum(
        2 * F.col(f"played_{k}") - F.least(F.lit(k), season_day) for k in DENSITY_DAYS
    ) / len(DENSITY_DAYS)
    return dated.select(
        *TEAM,
        "start",
        *[F.col(f"sum_{x}").alias(x) for x in _SUMS],
        *[f"decayed_{x}" for x in _DECAYED],
        F.coalesce(F.col("day_no") - F.col("last_day"), F.lit(0)).alias("rest"),
        season_day.alias("season_day"),
        density.alias("density"),
    )


def _figures(n: Column, wins: Column, pts: Column, opp: Column) -> dict[str, Column]:
    """No games: the win share is 0 and the means are null."""
    return {
        "Win_Pct": F.coalesce(F.try_divide(wins, n), F.lit(0.0)),
        "PPG": F.try_divide(pts, n),
        "OPP_PPG": F.try_divide(opp, n),
        "Net_PPG": F.try_divide(pts, n) - F.try_divide(opp, n),
    }


def _of(side: str, prefix: str = "") -> list[Column]:
    return [F.col(f"{side}_{prefix}{x}") for x in ("n", "wins", "pts", "opp")]


def _matchup(home: dict, away: dict, home_name: str, away_name: str, diff: str) -> list[Column]:
    return (
        [home[f].alias(home_name.format(f)) for f in _FIGURES]
        + [away[f].alias(away_name.format(f)) for f in _FIGURES]
        + [(home[f] - away[f]).alias(diff.format(f)) for f in _FIGURES]
    )


def side_sums(games: DataFrame, finals: DataFrame, tasks: int | None = None) -> DataFrame:
    """What the features follow from, for games whose two sides both have an earlier final state.

    ``tasks`` is the number that the games' wide rows are dealt to, see ``attach_sides``.
    """
    return attach_sides(
        games.select("game_id", "season", "start", "home_team", "away_team"),
        team_form(games, finals),
        _PER_SIDE,
        tasks,
    ).filter("home_n > 0 AND away_n > 0").select(
        "game_id", *[f"{side}_{x}" for side in ("home", "away") for x in _PER_SIDE]
    )


def features(games: DataFrame, finals: DataFrame) -> DataFrame:
    """One row per game whose two sides both have an earlier final state."""
    return features_of(side_sums(games, finals))


def features_of(paired: DataFrame) -> DataFrame:
    """Features from ``side_sums``, row by row."""
    basic = _matchup(
        _figures(*_of("home")), _figures(*_of("away")), "Home_{}", "Away_{}", "{}_Diff"
    )
    away_context = [a - h for a, h in zip(_of("away"), _of("away", "home_"))]
    context = _matchup(
        _figures(*_of("home", "home_")),
        _figures(*away_context),
        "Home_{}_Home",
        "Away_{}_Away",
        "{}_Home_Away_Diff",
    )
    decay = _matchup(
        _figures(*_of("home", "decayed_")),
        _figures(*_of("away", "decayed_")),
        "Time_Decay_Home_{}",
        "Time_Decay_Away_{}",
        "Time_Decay_{}_Diff",
    )
    rest = [
        ((F.col("home_season_day") + F.col("away_season_day")) / 2).alias("Day_of_Season"),
        F.col("home_rest").cast("double").alias("Home_Rest_Days"),
        F.col("home_density").alias("Home_Game_Freq"),
        F.col("away_rest").cast("double").alias("Away_Rest_Days"),
        F.col("away_density").alias("Away_Game_Freq"),
        (F.col("home_rest") - F.col("away_rest")).cast("double").alias("Rest_Days_Diff"),
        (F.col("home_density") - F.col("away_density")).alias("Game_Freq_Diff"),
    ]
    return paired.select("game_id", *basic, *context, *decay, *rest)


def feature_json(rows: DataFrame) -> DataFrame:
    """The stored form: one JSON object per game."""
    names = [c for c in rows.columns if c != "game_id"]
    return rows.select("game_id", F.to_json(F.struct(*names)).alias("feature_set"))


def widen_features(rows: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Parse ``feature_set`` into one DOUBLE column per feature; each row is parsed once."""
    names = names or FEATURES
    texts = [f"__{k}" for k in range(len(names))]
    kept = [c for c in rows.columns if c != "feature_set"]
    parsed = rows.select(*kept, F.json_tuple("feature_set", *names).alias(*texts))
    return parsed.select(*kept, *[F.col(x).try_cast("double").alias(n) for x, n in zip(texts, names, strict=True)])
