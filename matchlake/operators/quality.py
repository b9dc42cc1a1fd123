"""Coverage and play quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions.seasons import FINISHED
from matchlake.operators.history import counted

FEWEST_PLAYS, MOST_PLAYS = 300, 800
FIRST_STATES = 20


def _tagged(datasets: dict[str, DataFrame]) -> DataFrame:
    parts = [d.select("game_id", F.lit(n).alias("dataset")) for n, d in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def coverage(games: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Per season and dataset: finished games, how many have rows, percent, mark."""
    present = _tagged(datasets).groupBy("game_id").agg(
        *[F.max(F.when(F.col("dataset") == n, 1)).alias(n) for n in datasets]
    )
    finished = games.filter(counted(games) & F.col("status").isin(*FINISHED))
    per_season = (
        finished.select("game_id", "season")
        .join(present, "game_id", "left")
        .groupBy("season")
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count(n).alias(n) for n in datasets],
        )
    )
    rows = per_season.select(
        "season",
        "total",
        F.inline(
            F.array(*[F.struct(F.lit(n).alias("dataset"), F.col(n).alias("covered")) for n in datasets])
        ),
    )
    percent = F.try_divide(F.col("covered"), F.col("total")) * 100
    mark = F.when(percent >= 95, "good").when(percent >= 80, "fair").otherwise("poor")
    return rows.select(
        "season", "dataset", "covered", "total", percent.alias("percent"), mark.alias("mark")
    )


def coverage_alerts(covered: DataFrame, full: str = "plays", near: str = "player_box") -> DataFrame:
    """Any game without plays, or under 95 % of games with player boxes."""
    bad = ((F.col("dataset") == full) & (F.col("covered") < F.col("total"))) | (
        (F.col("dataset") == near) & (F.col("covered") < F.col("total") * 0.95)
    )
    return covered.filter(bad).select(
        "season",
        F.concat("dataset", F.lit("_missing")).alias("category"),
        (F.col("total") - F.col("covered")).alias("missing"),
    )


def first_decrease(states: DataFrame, n: int = FIRST_STATES) -> DataFrame:
    """First play among a game's first n whose score fell, counting from 0–0."""
    order = Window.partitionBy("game_id").orderBy("play_id")
    opening = (
        states.select("game_id", "play_id", "home_score", "away_score")
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= n)
    )
    fell = (F.col("home_score") < F.lag("home_score", 1, 0).over(order)) | (
        F.col("away_score") < F.lag("away_score", 1, 0).over(order)
    )
    return (
        opening.withColumn("fell", fell)
        .filter("fell")
        .groupBy("game_id")
        .agg(F.min("play_id").alias("fell_at"))
    )


def play_quality(
    games: DataFrame,
    plays: DataFrame,
    states: DataFrame,
    fewest: int = FEWEST_PLAYS,
    most: int = MOST_PLAYS,
) -> DataFrame:
    told = plays.groupBy("game_id").agg(F.count(F.lit(1)).alias("play_count"))
    kept = states.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("state_count"),
        F.count_if("is_final_state").alias("final_count"),
    )
    rows = (
        games.select("game_id")
        .join(told, "game_id", "left")
        .join(kept, "game_id", "left")
        .join(first_decrease(states), "game_id", "left")
        .fillna(0, ["play_count", "state_count", "final_count"])
    )
    n, s, f = F.col("play_count"), F.col("state_count"), F.col("final_count")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    span = f" (expected {fewest}-{most})"
    issues = F.filter(
        F.array(
            F.when(n < fewest, text("Low play count: ", n, span)).when(
                n > most, text("High play count: ", n, span)
            ),
            F.when(n != s, text("Plays and states differ: ", n, " vs ", s)),
            F.when(f == 0, F.lit("No final state")).when(
                f > 1, text("Multiple final states: ", f)
            ),
            F.when(
                F.col("fell_at").isNotNull(), text("Score decreased at play ", F.col("fell_at"))
            ),
        ),
        lambda issue: issue.isNotNull(),
    )
    return rows.select(
        "game_id",
        "play_count",
        "state_count",
        (f == 1).alias("has_final_state"),
        issues.alias("issues"),
        F.when(F.size(issues) == 0, "PASS").otherwise("FAIL").alias("quality"),
    )


def game_counts(games: DataFrame, datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows of each dataset per game, with the share of the total in plays."""
    counts = (
        _tagged(datasets)
        .groupBy("game_id")
        .agg(*[F.count_if(F.col("dataset") == n).alias(n) for n in datasets])
    )
    total = reduce(lambda a, b: a + b, [F.col(n) for n in datasets])
    first = next(iter(datasets))
    return (
        games.select(
            "game_id",
            F.concat_ws(" @ ", "away_team", "home_team").alias("matchup"),
            "status",
        )
        .join(counts, "game_id", "left")
        .fillna(0, list(datasets))
        .withColumn(f"{first}_share", F.try_divide(F.col(first), total))
    )
