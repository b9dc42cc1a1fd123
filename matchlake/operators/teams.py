"""Any team identifier → its team."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.functions.text import normal_identifier


def alias_table(teams: DataFrame) -> DataFrame:
    """One row per normalised alias; a shared alias names the lowest team id."""
    names = F.array("abbreviation", "full_name", "short_name")
    return (
        teams.select("team_id", F.explode(F.concat(names, F.col("alternatives"))).alias("name"))
        .select("team_id", normal_identifier(F.col("name")).alias("alias"))
        .groupBy("alias")
        .agg(F.min("team_id").alias("team_id"))
    )


def resolve(rows: DataFrame, identifier: str, teams: DataFrame) -> DataFrame:
    """Rows with the team's id and names, null where the identifier is unknown."""
    names = teams.select(
        "team_id",
        F.upper("abbreviation").alias("team"),
        F.initcap("full_name").alias("full_name"),
        F.initcap("short_name").alias("short_name"),
    )
    known = alias_table(teams).join(names, "team_id")
    return (
        rows.withColumn("alias", normal_identifier(F.col(identifier).cast("string")))
        .join(known, "alias", "left")
        .drop("alias")
    )


def points_allowed(team_box: DataFrame) -> DataFrame:
    """Each team's points allowed, when the game has exactly two team rows."""
    sides = team_box.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by("pts", "team_id").alias("first_pts"),
        F.max_by("pts", "team_id").alias("last_pts"),
        F.min("team_id").alias("first_team"),
    )
    other = F.when(F.col("team_id") == F.col("first_team"), F.col("last_pts")).otherwise(
        F.col("first_pts")
    )
    return (
        team_box.join(sides, "game_id")
        .select(*team_box.columns, F.when(F.col("n") == 2, other).alias("pts_allowed"))
    )
