"""Ordered scans: groups cut into segments or ranges equal one plain window."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from matchlake.operators.scan import ordered_scan, range_cuts, range_scan

WANTED = {
    "pos": ("count", None),
    "head": ("first", "v"),
    "latest": ("last", "v"),
    "top": ("max_before", "v"),
    "prev": ("lag", "v"),
    "at_end": ("is_last", None),
    "some": ("any", "odd"),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for group, n in (("hot", 400), ("warm", 30), ("one", 1)):
        for at in rng.sample(range(10 * n), n):
            data.append((group, at, rng.choice([None, rng.randint(0, 99)])))
    frame = spark.createDataFrame(data, "g string, at long, v int")
    return frame.withColumn("odd", (F.col("g") == "hot") & (F.col("at") == F.lit(data[7][1])))


@pytest.mark.parametrize("width", [7, 100, 100000])
def test_segments_change_nothing(rows, width):
    cut = rows.withColumn("seg", F.floor(F.col("at") / width))
    got = ordered_scan(cut, ["g"], ["seg"], ["at"], WANTED).drop("seg")
    w = Window.partitionBy("g").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = rows.select(
        "*",
        F.row_number().over(w).cast("long").alias("pos"),
        F.first("v").over(upto).alias("head"),
        F.last("v", ignorenulls=True).over(upto).alias("latest"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("top"),
        F.lag("v").over(w).alias("prev"),
        F.lead(F.lit(1)).over(w).isNull().alias("at_end"),
        F.bool_or("odd").over(Window.partitionBy("g")).alias("some"),
    )
    key = ["g", "at"]
    a = got.toPandas().sort_values(key).reset_index(drop=True)[want.columns]
    b = want.toPandas().sort_values(key).reset_index(drop=True)
    assert a.equals(b)


def test_null_segments_carry(spark):
    """A segment, key or position that is null is carried like any other."""
    data = [("a", 1, 5, 1), ("a", None, None, 2), ("a", None, 7, 3), ("a", 2, 1, None), ("a", 0, 9, 5), (None, 1, 1, 6), (None, None, 2, 7)]
    rows = spark.createDataFrame(data, "g string, seg int, at int, v int")
    wanted = {k: v for k, v in WANTED.items() if k not in ("top", "some")}
    got = ordered_scan(rows, ["g"], ["seg"], ["seg", "at"], wanted)
    found = {(r.g, r.v): (r.pos, r.latest, r.prev, r.at_end) for r in got.collect()}
    assert found == {
        ("a", 2): (1, 2, None, False), ("a", 3): (2, 3, 2, False), ("a", 5): (3, 5, 3, False),
        ("a", 1): (4, 1, 5, False), ("a", None): (5, 1, 1, True),
        (None, 7): (1, 7, None, False), (None, 6): (2, 6, 7, True),
    }


def test_null_safe_join_is_an_equi_join(rows):
    cut = rows.withColumn("seg", F.lit(0))
    out = ordered_scan(cut, ["g"], ["seg"], ["at"], {"pos": ("count", None)})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def plain(rows, keys, order):
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "*",
        F.row_number().over(w).cast("long").alias("pos"),
        F.first("v").over(upto).alias("head"),
        F.last("v", ignorenulls=True).over(upto).alias("latest"),
        F.sum("v").over(upto).alias("total"),
        F.lag("v").over(w).alias("prev"),
        F.lead(F.lit(1)).over(w).isNull().alias("at_end"),
        F.bool_or("odd").over(Window.partitionBy(*keys)).alias("some"),
    )


RANGED = {k: v for k, v in WANTED.items() if k != "top"} | {"total": ("sum", "v")}


def canonical(df, key):
    return df.toPandas().sort_values(key).reset_index(drop=True)


@pytest.mark.parametrize("most", [3, 20, 70, 100000])
def test_ranges_change_nothing(rows, most):
    got = range_scan(rows, ["g"], ["at"], RANGED | {"top": ("max_before", "v")}, most)
    want = plain(rows, ["g"], ["at"])
    top = F.max("v").over(Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    want = want.withColumn("top", top)
    a, b = canonical(got, ["g", "at"]), canonical(want, ["g", "at"])
    assert sorted(a.columns) == sorted(b.columns) and a[b.columns].equals(b)


@pytest.mark.parametrize("most", [4, 16])
def test_ranges_with_nulls_and_ties(spark, most):
    """Null keys and orders are values of their own; rows of one order stay together."""
    rng = random.Random(5)
    data = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), rng.choice([None, *range(30)]), k) for k in range(400)]
    rows = spark.createDataFrame(data, "g string, p int, at int, v int").withColumn("odd", F.col("v") == 17)
    order = ["p", "at", "v"]
    a, b = canonical(range_scan(rows, ["g"], order, RANGED, most), ["v"]), canonical(plain(rows, ["g"], order), ["v"])
    assert a[b.columns].equals(b)
    tied = range_scan(rows.withColumn("v", F.lit(1)), ["g"], ["p"], {"pos": ("count", None)}, most)
    found = tied.groupBy("g").agg(F.count_distinct("pos").alias("d"), F.count("*").alias("n"), F.max("pos").alias("m"))
    assert all(r.d == r.n == r.m for r in found.collect())


def test_only_large_groups_are_cut(rows):
    assert range_cuts(rows, ["g"], ["at"], 400) is None
    assert range_scan(rows.limit(0), ["g"], ["at"], {"pos": ("count", None)}, 4).count() == 0
    cuts = range_cuts(rows, ["g"], ["at"], 40).collect()
    assert [r["__h_g"] for r in cuts] == ["hot"] and len(cuts[0].cuts) >= 5
    assert [c.at for c in cuts[0].cuts] == sorted({c.at for c in cuts[0].cuts})


def test_nothing_as_long_as_the_rows_is_joined(rows):
    out = range_scan(rows, ["g"], ["at"], {"pos": ("count", None)}, 40)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert not any(kind in plan for kind in ("SortMergeJoin", "ShuffledHashJoin", "NestedLoop", "CartesianProduct"))
    whole = range_scan(rows, ["g"], ["at"], {"pos": ("count", None)})
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
