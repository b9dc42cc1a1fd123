"""Seasons, ids and the validity rules for both."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Id prefix → season type.
SEASON_TYPES = {
    "001": "Pre Season",
    "002": "Regular Season",
    "003": "All-Star",
    "004": "Post Season",
    "005": "Post Season",
}
# Numeric status code → status text.
STATUSES = {1: "Not Started", 2: "In Progress", 3: "Completed"}
# Seasons that did not run July to June.
MOVED_SEASONS = [
    ("2011-2012", "2011-07-01", "2012-06-30"),
    ("2019-2020", "2019-07-01", "2020-10-11"),
    ("2020-2021", "2020-10-12", "2021-07-20"),
]
COUNTED_SEASON_TYPES = ("Regular Season", "Post Season")
FINISHED = ("Completed", "Final")


def _lookup(key: Column, table: dict) -> Column:
    out = None
    for known, text in table.items():
        out = (F if out is None else out).when(key == known, F.lit(text))
    return out.otherwise(F.lit("Unknown"))


def season_type_of(game_id: Column) -> Column:
    return _lookup(F.substring(game_id, 1, 3), SEASON_TYPES)


def status_of(code: Column) -> Column:
    return _lookup(code, STATUSES)


def season_of_id(game_id: Column, short: bool = False) -> Column:
    """Characters 4–5 of an id name the first year; below 40 means 20xx."""
    two = F.substring(game_id, 4, 2)
    first = F.concat(
        F.when(two.try_cast("int") < 40, F.lit("20")).otherwise(F.lit("19")), two
    )
    second = (first.try_cast("int") + 1).cast("string")
    return F.concat(first, F.lit("-"), F.substring(second, 3, 2) if short else second)


def season_of_date(day: Column) -> Column:
    """Season of a DATE: July starts a new one, except for the moved seasons."""
    year = F.year(day)
    first = F.when(F.month(day) > 6, year).otherwise(year - 1)
    usual = F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string"))
    out = None
    for season, start, end in MOVED_SEASONS:
        inside = day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        out = (F if out is None else out).when(inside, F.lit(season))
    return out.otherwise(usual)


def short_season(season: Column) -> Column:
    return F.concat(F.substring(season, 1, 5), F.substring(season, -2, 2))


def id_fault(game_id: Column) -> Column:
    """Null for a good id (10 characters, starting ``00``)."""
    good = (F.length(game_id) == 10) & game_id.startswith("00")
    return F.when(~F.coalesce(good, F.lit(False)), F.lit("bad id"))


def date_fault(text: Column) -> Column:
    """Null for a good ``YYYY-MM-DD``; February may have 29 days in any year."""
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    month = F.substring(text, 6, 2).try_cast("int")
    day = F.substring(text, 9, 2).try_cast("int")
    longest = (
        F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, 29).otherwise(31)
    )
    return (
        F.when(~F.coalesce(shaped, F.lit(False)), F.lit("bad format"))
        .when(~month.between(1, 12), F.lit("bad month"))
        .when(~day.between(1, longest), F.lit("bad day"))
    )


def season_fault(text: Column, short: bool = False) -> Column:
    """Null for a good season text with consecutive years in 1900–2100."""
    shape = r"^\d{4}-\d{2}$" if short else r"^\d{4}-\d{4}$"
    first = F.substring(text, 1, 4).try_cast("int")
    tail = F.substring_index(text, "-", -1).try_cast("int")
    second = F.floor(first / 100) * 100 + tail if short else tail
    return (
        F.when(~F.coalesce(text.rlike(shape), F.lit(False)), F.lit("bad format"))
        .when(first + 1 != second, F.lit("not consecutive"))
        .when((first < 1900) | (second > 2100), F.lit("out of range"))
    )
