"""Scalar functions against hand-worked values."""

import math

import pytest
from pyspark.sql import functions as F

from matchlake.functions import clock, labels, probability, seasons, text


def column(spark, values, kind, *builders):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    out = rows.select("i", *[b(F.col("v")).alias(f"c{n}") for n, b in enumerate(builders)])
    got = [tuple(r)[1:] for r in out.orderBy("i").collect()]
    return [r[0] if len(builders) == 1 else r for r in got]


def test_clock_seconds(spark):
    got = column(spark, ["PT12M34.50S", "PT00M00.00S", "PT5M7S", "12:34", None], "string", clock.clock_seconds)
    assert got == [754.5, 0.0, 307.0, None, None]


@pytest.mark.parametrize(
    "period, text_, done, left",
    [
        (1, "PT12M00.00S", 0.0, 48.0),
        (2, "PT06M00.00S", 18 / 48, 30.0),
        (4, "PT00M00.00S", 1.0, 0.0),
        (5, "PT05M00.00S", 48 / 53, 5.0),
        (6, "PT02M30.00S", 55.5 / 58, 2.5),
        (1, "PT12M00S", 12 / 48, 36.0),  # no decimals: nothing left in the period
    ],
)
def test_progress(spark, period, text_, done, left):
    at = (F.lit(period), F.lit(text_))
    row = spark.range(1).select(clock.fraction_done(*at), clock.minutes_left(*at)).first()
    assert row[0] == pytest.approx(done) and row[1] == pytest.approx(left)


def test_clock_label(spark):
    row = spark.range(1).select(
        clock.clock_label(F.lit("PT07M04.50S"), F.lit(3)),
        clock.clock_label(F.lit("PT00M59.90S"), F.lit(5)),
    ).first()
    assert tuple(row) == ("7:04 Q3", "0:59 OT1")


def test_points_text(spark):
    got = column(spark, ["Shot (12 PTS)", "Miss", "(3 PTS) and (5 PTS)", None], "string", text.points_in_text)
    assert got == [12, None, 3, None]


def test_minutes(spark):
    got = column(spark, ["12:34", "12", "", "  ", "abc", "1:2:3", "3:x", "7.5", None], "string", text.played_minutes)
    assert got[0] == pytest.approx(12 + 34 / 60)
    assert got[1:] == [12.0, None, None, None, None, None, 7.5, None]


def test_height_and_names(spark):
    assert column(spark, ["6-9", "6", "x-9", "", None], "string", text.height_inches) == [81.0, None, None, None, None]
    got = column(
        spark, ["Last, First", "First Middle Last", "Single", "Last, First, Jr", None], "string",
        text.first_name, text.last_name,
    )
    assert got == [
        ("First", "Last"), ("First Middle", "Last"), ("", "Single"), ("First", "Last"), (None, None),
    ]


def test_age(spark):
    as_of = F.lit("2025-03-01").cast("date")
    got = column(
        spark, ["2000-03-01T00:00:00", "2000-03-02T00:00:00", "bad", "", None], "string",
        lambda c: text.age_on(c, as_of),
    )
    assert got == [25, 24, None, None, None]


def test_season_of_id(spark):
    ids = ["0022400001", "0022300001", "0042300401", "0024600001", "0029900001"]
    got = column(spark, ids, "string", seasons.season_of_id, lambda c: seasons.season_of_id(c, True), seasons.season_type_of)
    assert got == [
        ("2024-2025", "2024-25", "Regular Season"),
        ("2023-2024", "2023-24", "Regular Season"),
        ("2023-2024", "2023-24", "Post Season"),
        ("1946-1947", "1946-47", "Regular Season"),
        ("1999-2000", "1999-00", "Regular Season"),
    ]


def test_season_of_date(spark):
    days = {
        "2024-10-22": "2024-2025", "2024-06-15": "2023-2024", "2024-06-30": "2023-2024",
        "2024-07-01": "2024-2025", "2012-06-30": "2011-2012", "2020-10-11": "2019-2020",
        "2020-10-12": "2020-2021", "2021-07-20": "2020-2021", "2021-07-21": "2021-2022",
    }
    got = column(spark, list(days), "string", lambda c: seasons.season_of_date(c.cast("date")))
    assert got == list(days.values())


def test_faults(spark):
    ids = ["0022400001", "00224", "00224000011", "1022400001", "invalid", None]
    assert column(spark, ids, "string", seasons.id_fault) == [None] + ["bad id"] * 5
    dates = {
        "2024-10-22": None, "2023-02-29": None, "2024-02-30": "bad day", "2024-04-31": "bad day",
        "2024-13-01": "bad month", "2024-01-32": "bad day", "2024-01-00": "bad day",
        "2024/10/22": "bad format", "20241022": "bad format", None: "bad format",
    }
    assert column(spark, list(dates), "string", seasons.date_fault) == list(dates.values())
    full = {"2024-2025": None, "2024-2026": "not consecutive", "2024": "bad format",
            "1899-1900": "out of range", "2100-2101": "out of range", "2024-25": "bad format"}
    assert column(spark, list(full), "string", seasons.season_fault) == list(full.values())
    short = {"2024-25": None, "2024-26": "not consecutive", "1999-00": "not consecutive", "2024-2025": "bad format"}
    got = column(spark, list(short), "string", lambda c: seasons.season_fault(c, short=True))
    assert got == list(short.values())
    assert column(spark, ["2024-2025"], "string", seasons.short_season) == ["2024-25"]


def test_win_probability(spark):
    p = probability.home_win_probability
    h, a = F.lit(110.0), F.lit(104.0)
    row = spark.range(1).select(p(h, a), p(h, a, F.lit(47.0)), p(h, a, F.lit(11.0)), p(h, a, F.lit(11.0), "linear")).first()

    def curve(slope):
        return 1 / (1 + math.exp(-(-0.2504 + slope * 6)))

    expected = [curve(0.1949), curve(0.1949), curve(0.1949 * (1 + math.log(4))), curve(0.1949 * 5)]
    assert list(row) == pytest.approx(expected)
    with pytest.raises(ValueError):
        p(h, a, F.lit(1.0), "other")


@pytest.mark.parametrize(
    "current, remaining, method, expected",
    [
        (30, 0.75, "weighted", 0.25 * 120 + 0.75 * 100),
        (90, 0.25, "weighted", 0.75 * 120 + 0.25 * 100),
        (60, 0.25, "weighted", 0.75 * 80 + 0.25 * 100),
        (99, 0.25, "simple", (132 + 100) / 2),
        (0, 1.0, "weighted", 100.0),  # opening second: the stored score
        (0, 1.0, "simple", 85.0),  # and the lower bound for the others
        (5, 0.9, "simple", (70 + 100) / 2),
        (80, 0.5, "simple", (150 + 100) / 2),
        (88, 0.0, "weighted", 88.0),
        (60, 0.5, "logistic", (120 + 100) / 2),
    ],
)
def test_blend(spark, current, remaining, method, expected):
    value = probability.blended_score(F.lit(100.0), F.lit(current), F.lit(remaining), method)
    assert spark.range(1).select(value).first()[0] == pytest.approx(expected)


def test_percent_and_winner(spark):
    chances = [1.0, 0.9951, 0.994, 0.5, 0.505, 0.515, 0.3, 0.004, 0.0, None]
    got = column(
        spark, chances, "double",
        lambda c: labels.pick_winner(c, F.lit("H"), F.lit("A")), labels.pick_percent,
    )
    assert got == [
        ("H", "100%"), ("H", ">99%"), ("H", "99%"), ("H", "50%"), ("H", "50%"), ("H", "52%"),
        ("A", "70%"), ("A", ">99%"), ("A", "100%"), (None, None),
    ]


def test_when_label(spark):
    rows = spark.createDataFrame(
        [
            (1, "In Progress", "2024-10-23 00:30:00", 4, "PT03M05.20S", False),
            (2, "Completed", "2024-10-23 00:30:00", 4, "PT00M00.00S", True),
            (3, "Not Started", "2024-10-23 00:30:00", None, None, None),
            (4, "Not Started", "2024-10-24 23:00:00", None, None, None),
            (5, "Completed", "2024-10-21 23:00:00", 4, "PT00M00.00S", True),
            (6, "Completed", "2024-12-05 23:00:00", 5, "PT00M10.00S", False),
            (7, "Completed", "2024-12-05 23:00:00", None, None, None),
        ],
        "i int, status string, start string, period int, clock string, final boolean",
    )
    label = labels.when_label(
        F.col("status"), F.col("start").cast("timestamp_ntz"), F.col("period"), F.col("clock"),
        F.col("final"), "America/New_York", F.lit("2024-10-22").cast("date"),
    )
    got = [r[0] for r in rows.orderBy("i").select(label).collect()]
    assert got == [
        "3:05 - 4th Quarter", "Today - Final", "Today - 8:30 PM", "Oct 24 - 7:00 PM",
        "Yesterday - Final", "0:10 - Overtime", "Dec 05 - Final",
    ]


def test_lead(spark):
    got = column(spark, [-0.5, 0.0, 9.9, 10.0], "double", labels.lead_class)
    assert got == ["late", "tight", "tight", "ok"]
