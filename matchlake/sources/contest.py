"""The given star-schema tables read as contest tables.

An order is a game, its lines are plays, nations are teams. Everything a column
needs is in its own row, except a line's number among the lines of its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TEAMS = 25
UNKNOWN_TEAM = "TBD"
GAME_END_ID = 900
#: Lines that one task numbers and scans.
LINES_PER_TASK = 1 << 19

# How the source codes map to contest texts.
STATUS = {"F": "Completed", "P": "In Progress", "O": "Not Started"}
SEASON_TYPE = {
    "1-URGENT": "Regular Season",
    "2-HIGH": "Regular Season",
    "3-MEDIUM": "Regular Season",
    "4-NOT SPECIFIED": "Post Season",
    "5-LOW": "Pre Season",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _mapped(key: str, texts: dict[str, str]) -> Column:
    out = None
    for known, text in texts.items():
        out = (F if out is None else out).when(F.col(key) == known, F.lit(text))
    return out


def home_index(key: Column) -> Column:
    return key % TEAMS


def away_index(key: Column) -> Column:
    step = F.floor(key / TEAMS) % (TEAMS - 1)
    return (home_index(key) + 1 + step) % TEAMS


def team_code(index: Column) -> Column:
    return F.concat(F.lit("NATION_"), index.cast("string"))


def _cents() -> Column:
    return F.round(F.col("o_totalprice") * 100).cast("long")


def _share(divisor: int) -> Column:
    return F.floor(F.col("cents") / divisor)


def games(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("cents", _cents())
    first = F.year("o_orderdate") - (F.month("o_orderdate") < 7).cast("int")
    hours = F.make_dt_interval(F.lit(0), (F.col("cents") % 24).cast("int"))
    away = F.when(F.col("cents") % 101 == 0, F.lit(UNKNOWN_TEAM)).otherwise(
        team_code(away_index(F.col("o_orderkey")))
    )
    return o.select(
        F.col("o_orderkey").alias("game_id"),
        (F.col("o_orderdate") + hours).alias("start"),
        team_code(home_index(F.col("o_orderkey"))).alias("home_team"),
        away.alias("away_team"),
        _mapped("o_orderstatus", STATUS).alias("status"),
        F.concat(first.cast("string"), F.lit("-"), (first + 1).cast("string")).alias("season"),
        _mapped("o_orderpriority", SEASON_TYPE).alias("season_type"),
        (F.col("cents") % 3 == 0).alias("pre_game_data_finalized"),
        ((F.col("o_orderstatus") == "F") != (F.col("cents") % 97 == 0)).alias(
            "game_data_finalized"
        ),
    )


def _tasks(spark: SparkSession, folder: str) -> int:
    """Tasks over the lines: by their number, which the files' footers tell."""
    n = table(spark, folder, "lineitem").count()
    return max(spark.sparkContext.defaultParallelism, -(-n // LINES_PER_TASK))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    return keyed_lines(table(spark, folder, "lineitem"), _tasks(spark, folder))


def keyed_lines(lineitem: DataFrame, tasks: int | None = None) -> DataFrame:
    """Every line as one play, numbered within its order.

    Line numbers repeat within an order, so they cannot be play ids themselves.
    Lines equal in all columns that a play shows get different numbers, and which
    gets which makes no difference. Only these columns are shuffled, over ``tasks``
    tasks where that is given.
    """
    first = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*first))
    shown = lineitem.select("l_orderkey", *first)
    if tasks is not None:
        shown = shown.repartition(tasks, "l_orderkey")
    return shown.select(
        F.col("l_orderkey").alias("game_id"),
        number.cast("long").alias("play_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


def raw_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines as delivered, line numbers repeating within an order."""
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").cast("long").alias("play_id"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("long").alias("qty"),
    )


def clock_text(part: Column, supp: Column, qty: Column) -> Column:
    def two(c):
        return F.lpad(c.cast("string"), 2, "0")

    return F.concat(
        F.lit("PT"), two(part % 12), F.lit("M"), two(supp % 60), F.lit("."), two(qty % 100), F.lit("S")
    )


def line_period() -> Column:
    return (1 + F.floor((F.col("play_id") - 1) / 2)).cast("int")


def line_scores() -> tuple[Column, Column]:
    home = (16 * F.col("play_id") + F.col("qty") % 17).cast("int")
    away = (16 * F.col("play_id") + F.col("supp") % 17).cast("int")
    return home, away


def game_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Closing plays of finished games: none for some, two for some others."""
    o = table(spark, folder, "orders").withColumn("cents", _cents())
    ended = o.filter((F.col("o_orderstatus") == "F") & (F.col("cents") % 89 != 0))
    twice = F.when(F.col("cents") % 83 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return ended.select(
        F.col("o_orderkey").alias("game_id"),
        "cents",
        F.explode(twice).alias("again"),
    ).select(
        "game_id",
        (F.lit(GAME_END_ID) + F.col("again")).cast("long").alias("play_id"),
        (85 + _share(100) % 61 + F.col("again")).cast("int").alias("home_score"),
        (85 + _share(7) % 59).cast("int").alias("away_score"),
        F.col("cents"),
    )


def plays_of_lines(rows: DataFrame, both: bool = True) -> DataFrame:
    """Lines as plays. Even games come in the feed with running totals
    (``order_number``), odd ones in the other (``action_id``); with ``both``
    false all games come in the other."""
    key, part, supp, qty = (F.col(c) for c in ("game_id", "part", "supp", "qty"))
    home, away = line_scores()
    running = (key % 2 == 0) if both else F.lit(False)
    player = F.when(part % 41 != 0, F.concat(F.lit("Player "), part.cast("string")))
    told = F.concat(F.lit("Shot made by "), part.cast("string"))
    team = (
        F.when(part % 50 == 0, F.lit("XXX"))
        .when(F.col("play_id") % 2 == 1, team_code(home_index(key)))
        .otherwise(team_code(away_index(key)))
    )
    return rows.select(
        "game_id",
        F.when(running, F.col("play_id")).alias("order_number"),
        F.when(~running, F.col("play_id")).alias("action_id"),
        line_period().alias("period"),
        clock_text(part, supp, qty).alias("clock"),
        F.when(running | (qty % 3 == 0), home.cast("string")).otherwise(F.lit("")).alias("score_home"),
        F.when(running | (qty % 3 == 1), away.cast("string")).otherwise(F.lit("")).alias("score_away"),
        F.when(qty % 23 != 0, F.when(
            ~running & (supp % 4 != 0),
            F.concat(told, F.lit(" ("), (qty % 40).cast("string"), F.lit(" PTS)")),
        ).otherwise(told)).alias("description"),
        team.alias("team_tricode"),
        F.when(part % 40 == 0, F.lit(0)).otherwise(part).cast("long").alias("person_id"),
        player.alias("player_name"),
        F.when(running & (supp % 7 != 0), (qty % 40).cast("int")).alias("points_total"),
        F.lit("made").alias("sub_type"),
    )


def plays(spark: SparkSession, folder: str, both: bool = True) -> DataFrame:
    """Landed plays of lines and the closing plays of finished games."""
    from_lines = plays_of_lines(lines(spark, folder), both)
    # Dealt as the lines are, so that what follows by game needs no further exchange.
    ends = game_ends(spark, folder).repartition(_tasks(spark, folder), "game_id")
    end_running = (F.col("game_id") % 2 == 0) if both else F.lit(False)
    from_ends = ends.select(
        "game_id",
        F.when(end_running, F.col("play_id")).alias("order_number"),
        F.when(~end_running, F.col("play_id")).alias("action_id"),
        F.lit(4).alias("period"),
        F.lit("PT00M00.00S").alias("clock"),
        F.col("home_score").cast("string").alias("score_home"),
        F.col("away_score").cast("string").alias("score_away"),
        F.lit("Game End").alias("description"),
        F.lit(None).cast("string").alias("team_tricode"),
        F.lit(None).cast("long").alias("person_id"),
        F.lit(None).cast("string").alias("player_name"),
        F.lit(None).cast("int").alias("points_total"),
        F.lit("end").alias("sub_type"),
    )
    return from_lines.unionByName(from_ends)


def _stored(rows: DataFrame, ends: DataFrame) -> DataFrame:
    home, away = line_scores()
    key = F.col("game_id")
    codes = [
        team_code(home_index(key)).alias("home"),
        team_code(away_index(key)).alias("away"),
    ]
    from_lines = rows.select(
        "game_id",
        "play_id",
        *codes,
        clock_text(F.col("part"), F.col("supp"), F.col("qty")).alias("clock"),
        line_period().alias("period"),
        home.alias("home_score"),
        away.alias("away_score"),
        F.lit(False).alias("is_final_state"),
        F.col("part").alias("ingest_seq"),
    )
    from_ends = ends.select(
        "game_id",
        "play_id",
        *codes,
        F.lit("PT00M00.00S").alias("clock"),
        F.lit(4).alias("period"),
        "home_score",
        "away_score",
        F.lit(True).alias("is_final_state"),
        (F.lit(1_000_000_000_000) + F.col("cents")).alias("ingest_seq"),
    )
    return from_lines.unionByName(from_ends)


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Stored snapshots, (game_id, play_id) unique."""
    ends = game_ends(spark, folder).repartition(_tasks(spark, folder), "game_id")
    return _stored(lines(spark, folder), ends)


def raw_states(spark: SparkSession, folder: str) -> DataFrame:
    """Stored snapshots as an unguarded table would hold them, with repeats."""
    return _stored(raw_lines(spark, folder), game_ends(spark, folder))


def finals(spark: SparkSession, folder: str) -> DataFrame:
    from matchlake.operators.states import final_states

    return final_states(states(spark, folder))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Stored predictions of three predictors, each lacking some games."""
    from matchlake.functions.probability import home_win_probability

    o = table(spark, folder, "orders").withColumn("cents", _cents())
    hours = F.make_dt_interval(F.lit(0), (F.col("cents") % 24).cast("int"))
    lead = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("cents") % 40 - 10).cast("int"))
    present = F.filter(
        F.array(
            F.when(F.col("o_totalprice") >= 20000, F.lit("Baseline")),
            F.when(F.col("o_orderpriority") != "5-LOW", F.lit("Linear")),
            F.when(F.col("o_orderstatus") == "F", F.lit("Tree")),
        ),
        lambda name: name.isNotNull(),
    )
    shift = F.length("predictor").cast("double")
    rows = o.select(
        F.col("o_orderkey").alias("game_id"),
        F.explode(present).alias("predictor"),
        (F.col("o_orderdate") + hours - lead).alias("prediction_ts"),
        "cents",
    ).select(
        "game_id",
        "predictor",
        "prediction_ts",
        (85 + _share(11) % 60 + shift / 4).alias("pred_home_score"),
        (85 + _share(13) % 60 - shift / 8).alias("pred_away_score"),
    )
    return rows.withColumn(
        "pred_home_win_pct",
        home_win_probability(F.col("pred_home_score"), F.col("pred_away_score")),
    )


# The features a stored feature text carries.
STORED_FEATURES = ["Home_PPG", "Home_OPP_PPG", "Away_PPG", "Away_OPP_PPG"]


def stored_features(spark: SparkSession, folder: str) -> DataFrame:
    """Stored feature texts; one feature is null in some, some games have none."""
    o = table(spark, folder, "orders").withColumn("cents", _cents())
    values = [
        F.when(F.col("cents") % 31 == 0, F.lit("null")).otherwise(
            (85 + _share(17) % 60).cast("string")
        ),
        (85 + _share(19) % 60).cast("string"),
        (85 + _share(23) % 60).cast("string"),
        (85 + _share(29) % 60).cast("string"),
    ]
    body = F.concat_ws(
        ", ",
        *[F.concat(F.lit(f'"{n}": '), v) for n, v in zip(STORED_FEATURES, values)],
    )
    return o.filter(F.col("o_totalprice") > 60000).select(
        F.col("o_orderkey").alias("game_id"),
        F.concat(F.lit("{"), body, F.lit("}")).alias("feature_set"),
    )


def player_box(spark: SparkSession, folder: str) -> DataFrame:
    """Points per part of an order; orders without an ``A`` line have none."""
    return (
        table(spark, folder, "lineitem")
        .filter(F.col("l_returnflag") == "A")
        .groupBy(F.col("l_orderkey").alias("game_id"), F.col("l_partkey").alias("player_id"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("pts"))
    )


def team_box(spark: SparkSession, folder: str) -> DataFrame:
    """Points per side of an order, from its odd and even lines."""
    odd = F.col("l_linenumber") % 2 == 1
    key = F.col("l_orderkey")
    code = F.when(odd, team_code(home_index(key))).otherwise(team_code(away_index(key)))
    return (
        table(spark, folder, "lineitem")
        .groupBy(key.alias("game_id"), code.alias("team_id"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("pts"))
    )


def teams(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with generated names and alternatives, all already normalised."""
    n = table(spark, folder, "nation")
    key = F.col("n_nationkey").cast("string")
    return n.select(
        key.alias("team_id"),
        F.col("n_name").alias("abbreviation"),
        F.concat(F.lit("nation number "), key).alias("full_name"),
        F.concat(F.lit("number "), key).alias("short_name"),
        F.array(F.concat(F.lit("team "), key), F.concat(F.lit("old team "), key)).alias(
            "alternatives"
        ),
    )
