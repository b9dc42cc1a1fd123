"""Writes that set unreadable rows aside in the pass that writes the rest."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matchlake.operators.scan import RANGE_ROWS, range_scan
from matchlake.operators.states import unreadable
from matchlake.sources.shared import new_folder


class Guarded(NamedTuple):
    kept: DataFrame
    rejected: DataFrame
    #: Rows written to either side, as observed while they were written.
    counts: dict[str, int]

    @property
    def verdict(self) -> str:
        if not self.counts["kept"] + self.counts["rejected"]:
            return "empty"
        return "accept" if not self.counts["rejected"] else "broken rows" if self.counts["kept"] else "reject"


def guarded_write(rows: DataFrame, name: str, fault: Column) -> Guarded:
    """Write rows without a ``fault`` and, beside them, the others with theirs.

    ``fault`` is a text, null for a good row. One job writes both sides and counts
    them as they pass; nothing is read before or after to know the numbers.
    """
    spark = rows.sparkSession
    folder = new_folder(spark, name)
    seen = Observation(f"{name}-{folder.rsplit('-', 1)[-1]}")
    marked = rows.withColumn("fault", fault).withColumn("side", F.when(F.col("fault").isNull(), "kept").otherwise("rejected"))
    watched = marked.observe(seen, *[F.count_if(F.col("side") == s).alias(s) for s in ("kept", "rejected")])
    watched.write.partitionBy("side").parquet(folder)
    stored = spark.read.schema(marked.schema).parquet(folder)
    kept, rejected = (stored.filter(F.col("side") == s).drop("side") for s in ("kept", "rejected"))
    return Guarded(kept.drop("fault"), rejected, {s: int(seen.get[s]) for s in ("kept", "rejected")})


def guarded_plays(plays: DataFrame, name: str = "plays", most: int = RANGE_ROWS) -> Guarded:
    """Plays of readable games, and all plays of the others.

    A game with an unreadable play is set aside whole, as its states would be wrong:
    ``fault`` says of each of its plays whether it is the reason. Plays that name no
    game are rejected.
    """
    marked = plays.withColumns({"is_unreadable": unreadable(), "tie": F.xxhash64(*plays.columns)})
    scanned = range_scan(marked, ["game_id"], ["tie"], {"is_spoilt": ("any", "is_unreadable")}, most).drop("tie")
    fault = (
        F.when(F.col("game_id").isNull(), "no game")
        .when(F.col("is_unreadable"), "unreadable")
        .when(F.col("is_spoilt"), "of a spoilt game")
    )
    done = guarded_write(scanned, name, fault)
    work = ("is_unreadable", "is_spoilt")
    return Guarded(done.kept.drop(*work), done.rejected.drop(*work), done.counts)


def quarantined_games(done: Guarded) -> DataFrame:
    """Games set aside, with how many of their plays there are and how many are unreadable."""
    rows = done.rejected.filter("game_id IS NOT NULL")
    return rows.groupBy("game_id").agg(
        F.count(F.lit(1)).alias("plays"), F.count_if(F.col("fault") == "unreadable").alias("unreadable")
    )
