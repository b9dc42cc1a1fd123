"""Repairs as table rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fix_flags(games: DataFrame, states: DataFrame, plays: DataFrame) -> DataFrame:
    """Both flags after the four flag repairs, with what each one changed.

    The repairs run in their fixed order, each on the result of the one before:
    unset the data flag without a final state, then without plays, unset the
    pre-game flag where the data flag is now unset, and last set the data flag
    of completed games that have a final state.
    """
    final = states.filter("is_final_state").select("game_id").distinct()
    told = plays.select("game_id").distinct()
    rows = games.join(final.withColumn("__final", F.lit(True)), "game_id", "left").join(
        told.withColumn("__told", F.lit(True)), "game_id", "left"
    )
    has_final = F.coalesce("__final", F.lit(False))
    has_plays = F.coalesce("__told", F.lit(False))
    data, pre = F.col("game_data_finalized"), F.col("pre_game_data_finalized")
    after_1 = data & has_final
    after_2 = after_1 & has_plays
    set_6 = (F.col("status") == "Completed") & ~after_2 & has_final
    return rows.select(
        *[c for c in games.columns if not c.endswith("_finalized")],
        (pre & after_2).alias("pre_game_data_finalized"),
        (after_2 | set_6).alias("game_data_finalized"),
        (data & ~has_final).alias("fixed_001"),
        (after_1 & ~has_plays).alias("fixed_002"),
        (pre & ~after_2).alias("fixed_005"),
        set_6.alias("fixed_006"),
    )


def fix_orphans(child: DataFrame, games: DataFrame) -> DataFrame:
    """Only the rows whose game exists."""
    return child.join(games.select("game_id"), "game_id", "left_semi")


def fix_duplicates(states: DataFrame) -> DataFrame:
    """The first ingested state of each (game, play)."""
    rest = [c for c in states.columns if c not in ("game_id", "play_id", "ingest_seq")]
    first = states.groupBy("game_id", "play_id").agg(
        F.min(F.struct("ingest_seq", *rest)).alias("__s")
    )
    return first.select("game_id", "play_id", "__s.*").select(*states.columns)
