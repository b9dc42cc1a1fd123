"""What the tables are shuffled by, and how many tasks and files share them."""

import pytest
from pyspark.sql import functions as F

from matchlake.operators import states, views
from matchlake.plans import catalog
from matchlake.sources import contest

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_shipdate timestamp"
ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


@pytest.fixture
def folder(spark, tmp_path):
    lines = spark.range(400).selectExpr(
        "id % 40 AS l_orderkey", "id % 7 AS l_partkey", "id % 5 AS l_suppkey", "cast(id % 3 AS int) AS l_linenumber",
        "cast(id % 11 AS double) AS l_quantity", "id / 100 AS l_tax", "timestamp'1998-01-01' AS l_shipdate",
    )
    orders = spark.range(40).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "if(id % 3 = 0, 'O', 'F') AS o_orderstatus", "1000.0 + id AS o_totalprice",
        "timestamp'1998-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority",
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path)


@pytest.fixture
def shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_shown_columns_of_lines_are_shuffled(spark, folder):
    raw = contest.table(spark, folder, "lineitem")
    plan = contest.keyed_lines(raw)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_shipdate" not in plan
    every = [*["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_shipdate", "l_tax"]
    columns = "l_orderkey AS game_id, l_partkey AS part, l_suppkey AS supp, cast(l_quantity AS long) AS qty"
    old = raw.selectExpr(f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(every)}) AS play_id", *columns.split(", "))
    told = ["game_id", "play_id", "part", "supp", "qty"]
    assert sorted(map(tuple, contest.lines(spark, folder).select(told).collect())) == sorted(map(tuple, old.select(told).collect()))


def test_lines_are_dealt_by_their_number(spark, folder, monkeypatch):
    monkeypatch.setattr(contest, "LINES_PER_TASK", 20)
    assert contest.lines(spark, folder).rdd.getNumPartitions() == 20


def test_plays_pages_and_points_share_the_exchange_of_the_lines(spark, folder, shuffled):
    games, plays = contest.games(spark, folder), contest.plays(spark, folder)
    assert shuffled(plays) == 2  # lines and closing plays
    assert shuffled(views.condensed_plays(plays)) == 2
    assert shuffled(states.player_timeline(games, plays, None)) <= 3  # and the games


def test_a_stream_of_many_files_gives_the_same_rows(spark, folder, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20)
    told = catalog.queries()["stream_dedup"](spark, folder)
    want = contest.raw_lines(spark, folder).select("game_id", "play_id").distinct()
    assert sorted(map(tuple, told.collect())) == sorted(map(tuple, want.collect()))


def test_no_task_writes_a_whole_delivery(spark, folder, monkeypatch):
    monkeypatch.setattr(catalog, "FILE_ROWS", 20)
    seen = []
    monkeypatch.setattr(catalog.live, "read_stream", lambda spark, path, files_per_batch: seen.append((path, files_per_batch)))
    catalog._lines_stream(catalog.Tables(spark, folder))
    (path, files), = seen
    assert files == 7  # 400 rows in 3 deliveries
    rows = spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()
    assert len(rows) == 3 * files and max(r["count"] for r in rows) < 40


def test_deliveries_hold_the_columns_that_streams_read(spark, folder, monkeypatch):
    made = []
    monkeypatch.setattr(catalog, "_deliveries", lambda t, rows, number: made.append(rows.columns) or rows)
    tables = catalog.Tables(spark, folder)
    catalog._stream_states(tables)
    assert made == [["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]]
    assert catalog._lines_stream(tables).columns == tables.raw("lineitem").columns
