"""Parsers for the free-text fields of landed payloads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def points_in_text(description: Column) -> Column:
    """Points total written as ``(12 PTS)``; null when there is none."""
    found = F.regexp_extract(description, r"\((\d+) PTS\)", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def played_minutes(text: Column) -> Column:
    """``MM:SS`` or a plain number of minutes → double."""
    parts = F.split(text, ":")
    whole = r"^\s*[+-]?\d+\s*$"
    pair = F.when(
        parts[0].rlike(whole) & F.get(parts, F.lit(1)).rlike(whole),
        F.trim(parts[0]).try_cast("int")
        + F.trim(F.get(parts, F.lit(1))).try_cast("int") / 60,
    )
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(None).cast("double"))
        .when(F.size(parts) == 2, pair)
        .otherwise(F.trim(text).try_cast("double"))
    )


def height_inches(text: Column) -> Column:
    """``6-9`` (feet-inches, digits only) → 81.0."""
    feet = F.nullif(F.regexp_extract(text, r"^(\d+)-(\d+)$", 1), F.lit(""))
    inches = F.nullif(F.regexp_extract(text, r"^(\d+)-(\d+)$", 2), F.lit(""))
    return feet.try_cast("double") * 12 + inches.try_cast("double")


def age_on(birth: Column, as_of: Column) -> Column:
    """Whole years between an ISO birth date text and ``as_of`` (a DATE)."""
    day = F.split(birth, "T")[0]
    born = F.when(day.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), day.try_cast("date"))
    early = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (
        F.month(born) * 100 + F.dayofmonth(born)
    )
    return F.year(as_of) - F.year(born) - early.cast("int")


def _by_comma(name: Column) -> Column:
    return F.split(name, ", ")


def first_name(name: Column) -> Column:
    comma, words = _by_comma(name), F.split(name, " ")
    return (
        F.when(F.size(comma) >= 2, F.get(comma, F.lit(1)))
        .when(F.size(words) > 1, F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
        .when(name.isNotNull(), F.lit(""))
    )


def last_name(name: Column) -> Column:
    comma, words = _by_comma(name), F.split(name, " ")
    return F.when(F.size(comma) >= 2, comma[0]).otherwise(
        F.try_element_at(words, F.lit(-1))
    )


def normal_identifier(text: Column) -> Column:
    """Lower case with hyphens as spaces, the form team aliases are kept in."""
    return F.replace(F.lower(text), F.lit("-"), F.lit(" "))
