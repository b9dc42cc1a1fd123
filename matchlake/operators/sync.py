"""Keyed writes: replace by key, by group, and full-season synchronisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEDULE = ["start", "home_team", "away_team", "status", "season", "season_type"]
FLAGS = ["pre_game_data_finalized", "game_data_finalized"]


def replace_rows(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key (last write wins)."""
    rest = [c for c in old.columns if c not in keys and c != version]
    both = old.unionByName(new)
    best = both.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("__r"))
    return best.select(*keys, "__r.*").select(*old.columns)


def replace_groups(old: DataFrame, new: DataFrame, key: str = "game_id") -> DataFrame:
    """All old rows of a group give way to its new ones; other groups stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def changed_rows(new: DataFrame, old: DataFrame, key: str, watched: list[str]) -> DataFrame:
    """New rows that are unknown or differ in a watched column."""
    known = old.select(key, F.lit(True).alias("__known"), *[F.col(c).alias(f"__{c}") for c in watched])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in watched])
    return (
        new.join(known, key, "left")
        .filter(F.col("__known").isNull() | ~same)
        .select(*new.columns)
    )


def _matched(old: DataFrame, new: DataFrame) -> DataFrame:
    was = old.select("game_id", F.struct(*SCHEDULE, *FLAGS).alias("was"))
    now = new.select("game_id", F.struct(*SCHEDULE).alias("now"))
    return was.join(now, "game_id", "full_outer")


def _in_scope(season: str | None) -> Column:
    return F.lit(True) if season is None else F.col("was.season") == season


def sync_schedule(old: DataFrame, new: DataFrame, season: str | None = None) -> DataFrame:
    """The schedule after a full-season delivery.

    Games of the season that were not delivered go, delivered ones take the new
    values and keep their flags (new ones start with both unset). A delivered row
    with a null is skipped, so an existing game stays as it was. Without a
    season the delivery covers all of them.
    """
    whole = reduce(lambda a, b: a & b, [F.col(f"now.{c}").isNotNull() for c in SCHEDULE])
    take = F.col("now").isNotNull() & whole
    keep = F.col("was").isNotNull() & ~take & (F.col("now").isNotNull() | ~_in_scope(season))
    return (
        _matched(old, new)
        .filter(take | keep)
        .select(
            "game_id",
            *[F.when(take, F.col(f"now.{c}")).otherwise(F.col(f"was.{c}")).alias(c) for c in SCHEDULE],
            *[F.coalesce(F.col(f"was.{c}"), F.lit(False)).alias(c) for c in FLAGS],
        )
    )


def sync_counts(old: DataFrame, new: DataFrame, season: str | None = None) -> DataFrame:
    """Rows added, updated and removed; skipped rows count as delivered."""
    was, now = F.col("was").isNotNull(), F.col("now").isNotNull()
    same = reduce(
        lambda a, b: a & b, [F.col(f"now.{c}").eqNullSafe(F.col(f"was.{c}")) for c in SCHEDULE]
    )
    return _matched(old, new).agg(
        F.count_if(now & ~was).alias("added"),
        F.count_if(now & was & ~same).alias("updated"),
        F.count_if(was & ~now & _in_scope(season)).alias("removed"),
    )


def sync_guard(new: DataFrame, season: str | None = None) -> DataFrame:
    """Whether a delivery may be applied: rows, whole keys, one season."""
    expected = F.lit(season) if season is not None else F.min("season")
    facts = new.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("game_id").isNull() | F.col("start").isNull()).alias("broken"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        expected.alias("expected"),
    )
    mixed = ~(
        F.col("first_season").eqNullSafe(F.col("expected"))
        & F.col("last_season").eqNullSafe(F.col("expected"))
    )
    verdict = (
        F.when(F.col("rows") == 0, "empty")
        .when(F.col("broken") > 0, "broken rows")
        .when(mixed, "mixed seasons")
        .otherwise("accept")
    )
    return facts.select("rows", "broken", verdict.alias("verdict"))
