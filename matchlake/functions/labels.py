"""Texts shown next to a game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchlake.functions.clock import clock_face

# Period number → name.
PERIOD_NAMES = {
    1: "1st Quarter",
    2: "2nd Quarter",
    3: "3rd Quarter",
    4: "4th Quarter",
    5: "Overtime",
    6: "2nd Overtime",
    7: "3rd Overtime",
    8: "4th Overtime",
    9: "5th Overtime",
}
LAST_PERIOD_NAME = "Crazy Overtime"


def period_name(period: Column) -> Column:
    out = None
    for number, name in PERIOD_NAMES.items():
        out = (F if out is None else out).when(period == number, F.lit(name))
    return out.when(period > max(PERIOD_NAMES), F.lit(LAST_PERIOD_NAME))


def when_label(
    status: Column,
    start: Column,
    period: Column,
    clock: Column,
    is_final: Column,
    zone: str,
    today: Column,
) -> Column:
    """Clock and period while a game runs, else its day with ``Final`` or a time.

    ``start`` is UTC (TIMESTAMP_NTZ); ``today`` is a DATE in ``zone``. A game
    runs if it has a state and is either in progress or not at a final state.
    """
    running = period.isNotNull() & (
        (status == "In Progress") | ~F.coalesce(is_final, F.lit(False))
    )
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), start)
    ahead = F.datediff(F.to_date(local), today)
    day = (
        F.when(ahead == 0, F.lit("Today"))
        .when(ahead == 1, F.lit("Tomorrow"))
        .when(ahead == -1, F.lit("Yesterday"))
        .otherwise(F.date_format(local, "MMM dd"))
    )
    tail = F.when(status == "Completed", F.lit("Final")).otherwise(
        F.date_format(local, "h:mm a")
    )
    return F.when(
        running, F.concat(clock_face(clock), F.lit(" - "), period_name(period))
    ).otherwise(F.concat(day, F.lit(" - "), tail))


def pick_winner(probability: Column, home: Column, away: Column) -> Column:
    return F.when(probability >= 0.5, home).when(probability < 0.5, away)


def pick_percent(probability: Column) -> Column:
    """``100%``, ``>99%`` or a whole percent, for the predicted winner."""
    share = F.when(probability >= 0.5, probability).otherwise(1 - probability)
    whole = F.bround(share * 100, 0).cast("int").cast("string")
    return (
        F.when(share == 1, F.lit("100%"))
        .when(share >= 0.995, F.lit(">99%"))
        .when(share < 0.995, F.concat(whole, F.lit("%")))
    )


def lead_minutes(predicted_at: Column, start: Column) -> Column:
    """Minutes from a prediction to the start of its game (negative if after)."""
    return F.timestamp_diff("SECOND", predicted_at, start) / 60


def lead_class(minutes: Column) -> Column:
    return (
        F.when(minutes < 0, F.lit("late"))
        .when(minutes < 10, F.lit("tight"))
        .otherwise(F.lit("ok"))
    )
