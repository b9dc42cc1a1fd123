"""Stores by bucket: what is read, replaced and compacted, and joins without an exchange."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import features, predict, pregame, states
from matchlake.sources import contest
from matchlake.sources.store import BUCKET_ROWS, BUCKETS, BucketStore, KeyedTables, buckets_for


def rows(spark, *data):
    return spark.createDataFrame(list(data), "game_id long, v string")


def held(frame):
    return sorted((r.game_id, r.v) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, "t", ("game_id",), 8, str(tmp_path / "store"))


def test_deliveries_add_up_and_retries_do_not(spark, store):
    store.append(rows(spark, (1, "a"), (2, "a"), (None, "a")), 0)
    store.append(rows(spark, (1, "b"), (9, "b")), 1)
    store.append(rows(spark, (1, "b"), (9, "b")), 1)
    assert held(store.read().filter("game_id is not null")) == [(1, "a"), (1, "b"), (2, "a"), (9, "b")]
    assert store.read().count() == 5
    assert held(store.read(upto=0).filter("game_id is not null")) == [(1, "a"), (2, "a")]
    assert held(store.read_version(1)) == [(1, "b"), (9, "b")]
    assert BucketStore(spark, "t", ("game_id",), 8, store.folder).read().count() == 5


def test_only_touched_buckets_are_read(spark, store):
    store.append(rows(spark, *((k, "a") for k in range(100))), 0)
    store.append(rows(spark, (5, "b")), 1)
    touched = store.touched(1)
    assert len(touched) == 1 and len(store.touched(0)) == 8
    seen = store.read(touched, 1)
    assert (5, "a") in held(seen) and (5, "b") in held(seen) and len(held(seen)) < 60
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "bucket" in filters and "version" in filters
    assert seen.select(F.input_file_name().alias("f")).distinct().filter("f not like '%bucket={}/%'".format(touched[0])).count() == 0


def test_replaced_groups(spark, store):
    store.append(rows(spark, *((k, "a") for k in range(20)), (3, "a2")), 0)
    store.append(rows(spark, (3, "b"), (4, "b")), 1)
    new = rows(spark, (3, "c"), (77, "c"))
    for _ in range(2):  # a retry changes nothing
        store.replace(new, 2)
    want = [(k, "a") for k in range(20) if k != 3] + [(3, "c"), (4, "b"), (77, "c")]
    assert held(store.read()) == sorted(want)
    assert held(store.read(upto=1)) == sorted([(k, "a") for k in range(20)] + [(3, "a2"), (3, "b"), (4, "b")])
    store.append(rows(spark, (3, "d")), 3)
    assert (3, "d") in held(store.read()) and (3, "c") in held(store.read()) and (3, "a") not in held(store.read())


def test_compacted_deliveries_hold_the_same_rows(spark, store):
    for version in range(6):
        store.append(rows(spark, *((k, str(version)) for k in range(10)), (1000 + version, "x")), version)
        store.compact(version, after=2)
        assert store.read().count() == 11 * (version + 1)
    files = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in files
    bases = store._bases(5)
    assert bases and max(bases.values()) <= 5
    used = {(k, b, v) for k, b, v in store._folders() if (k == "base" and bases.get(b) == v) or (k == "delta" and v > bases.get(b, -1))}
    assert max(sum(1 for k, x, _ in used if x == b) for b in range(8)) <= 4
    read = store.read().select(F.input_file_name().alias("f")).distinct().count()
    assert read <= len(used)


def exchanges(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ")


def test_keyed_tables_join_without_an_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tables = KeyedTables(spark, "game_id", 4)
        one = tables.save("one", rows(spark, *((k, "a") for k in range(50))))
        two = tables.save("two", rows(spark, *((k, "b") for k in range(0, 60, 2))).withColumnRenamed("v", "w"))
        both = one.join(two, "game_id").groupBy("game_id").count()
        assert both.count() == 25 and exchanges(both) == 0
        assert exchanges(one.join(rows(spark, (1, "x")), "game_id", "left_semi")) == 1  # the other side only
        assert "one" in tables and "three" not in tables
        again = tables.save("one", rows(spark, (7, "c")))
        assert held(again) == held(tables.read("one")) == [(7, "c")]
        assert held(one.limit(100))[0] == (0, "a")  # readers of the old table keep it
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_refresh_equals_its_steps(spark, small):
    games, plays = contest.games(spark, small), contest.plays(spark, small)
    done = pregame.refresh(games, plays, KeyedTables(spark, "game_id", 4))
    finals = states.final_states(states.game_states(games, plays))
    as_rows = lambda frame: sorted(map(str, frame.collect()))
    columns = ["game_id", "home_score", "away_score", "play_id"]
    assert as_rows(done.finals.select(columns)) == as_rows(finals.select(columns))
    known = features.features(games, finals)
    assert done.features.count() == known.count() == done.features.join(known, "game_id").count()
    assert as_rows(done.predictions.select("game_id")) == as_rows(predict.baseline(known).select("game_id"))
    told = {r.game_id: r for r in pregame.predicted_games(done).collect()}
    ended = {r.game_id for r in finals.collect()}
    assert len(told) == games.count()
    assert all(r.game_data_finalized for g, r in told.items() if g in ended)


def test_buckets_follow_the_rows():
    assert buckets_for(0) == buckets_for(1000) == BUCKETS
    assert buckets_for(BUCKET_ROWS * 100 + 1) == 101


def test_derived_columns_come_after_the_shuffle(spark):
    tables = KeyedTables(spark, "game_id", 4)
    given = rows(spark, *((k, "a") for k in range(20)))
    kept = tables.save("wide", given, lambda frame: frame.withColumn("w", F.concat("v", F.lit("!"))))
    assert {r.w for r in kept.collect()} == {"a!"} and kept.count() == 20


def test_wide_rows_are_dealt_to_as_many_tasks_as_asked(spark, small):
    games, finals = contest.games(spark, small), contest.finals(spark, small)
    dealt = features.features_of(features.side_sums(games, finals, 20))
    assert "hashpartitioning" in plan(dealt) and ", 20), REPARTITION_BY_NUM" in plan(dealt)
    as_rows = lambda frame: sorted(map(str, frame.select([F.round(c, 6) for c in frame.columns]).collect()))
    assert as_rows(dealt) == as_rows(features.features(games, finals))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()
