"""Game clock text: ISO-8601 durations such as ``PT07M34.50S``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REGULATION_PERIODS = 4
REGULATION_MINUTES = 12
OVERTIME_MINUTES = 5


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clock_seconds(clock: Column) -> Column:
    """Seconds left on the clock, null when the text has another shape."""
    shape = r"^PT(\d+)M(\d+(?:\.\d*)?)S$"
    minutes = _part(clock, shape, 1).try_cast("double")
    return minutes * 60 + _part(clock, shape, 2).try_cast("double")


def minutes_left_in_period(clock: Column) -> Column:
    """A clock without decimals counts as zero minutes left."""
    shape = r"PT(\d+)M(\d+\.\d+)S"
    minutes = _part(clock, shape, 1).try_cast("double")
    seconds = _part(clock, shape, 2).try_cast("double")
    return F.coalesce(minutes + seconds / 60, F.lit(0.0))


def _expected_minutes(period: Column) -> Column:
    full = REGULATION_PERIODS * REGULATION_MINUTES
    return F.when(period <= REGULATION_PERIODS, F.lit(full)).otherwise(
        full + (period - REGULATION_PERIODS) * OVERTIME_MINUTES
    )


def _played_minutes(period: Column, clock: Column) -> Column:
    left = minutes_left_in_period(clock)
    return F.when(
        period <= REGULATION_PERIODS, period * REGULATION_MINUTES - left
    ).otherwise(
        REGULATION_PERIODS * REGULATION_MINUTES
        + (period - REGULATION_PERIODS) * OVERTIME_MINUTES
        - left
    )


def fraction_done(period: Column, clock: Column) -> Column:
    return _played_minutes(period, clock) / _expected_minutes(period)


def minutes_left(period: Column, clock: Column) -> Column:
    return _expected_minutes(period) - _played_minutes(period, clock)


def clock_face(clock: Column) -> Column:
    """``PT07M04.50S`` → ``7:04``."""
    shape = r"^PT(\d+)M(\d+)"
    minutes = _part(clock, shape, 1).try_cast("int").cast("string")
    seconds = _part(clock, shape, 2).try_cast("int").cast("string")
    return F.concat(
        minutes,
        F.lit(":"),
        F.when(F.length(seconds) < 2, F.lpad(seconds, 2, "0")).otherwise(seconds),
    )


def clock_label(clock: Column, period: Column) -> Column:
    """``7:04 Q3`` in regulation, ``4:10 OT1`` after it."""
    suffix = F.when(
        period > REGULATION_PERIODS,
        F.concat(F.lit(" OT"), (period - REGULATION_PERIODS).cast("string")),
    ).otherwise(F.concat(F.lit(" Q"), period.cast("string")))
    return F.concat(clock_face(clock), suffix)
