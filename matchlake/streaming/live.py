"""Live games as Structured Streaming.

Everything kept between micro-batches is a built-in streaming aggregate or
duplicate filter, so it is combined before the shuffle and spread by key; a busy
game costs one partial row per task. Results go to a folder per micro-batch.
Rewriting that folder on a retry makes publishing idempotent, and readers take
each game's newest batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions.clock import clock_seconds
from matchlake.functions.text import points_in_text
from matchlake.operators.predict import live_predictions, newest
from matchlake.operators.states import END_OF_GAME, reported, unreadable
from matchlake.sources.shared import materialized, new_folder
from matchlake.sources.store import BUCKETS, DELTAS, BucketStore

SALTS = 8
#: Plays from which on a game is busy, and busy games at most: beyond that, a game needs more plays to be one.
BUSY_PLAYS, BUSY_GAMES = 1 << 16, 4096
#: Slots that games are counted in first.
SLOTS = 1 << 16


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A landed parquet table as a stream, with the schema of its files.

    The path is given as a pattern because the source takes a plain path to be a
    folder, while a small table may be one file.
    """
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{{{name}}}")


def first_deliveries(plays: DataFrame, moment: str, delay: str) -> DataFrame:
    """Plays without repeats of (game, play) that arrive within the delay.

    Later plays than the watermark allows are dropped here and repaired by the
    batch replacement of the whole game.
    """
    return plays.withWatermark(moment, delay).dropDuplicatesWithinWatermark(["game_id", "play_id"])


def _place():
    return F.struct(
        "period",
        (-clock_seconds(F.col("clock"))).alias("clock_left"),
        F.coalesce("order_number", "action_id").cast("long").alias("play_id"),
    ).alias("place")


def _newest_of(name: str):
    """The value told last in the order of play, 0 before any."""
    told = F.when(F.col(name).isNotNull(), F.struct("place", name))
    return F.coalesce(F.max(told).getField(name), F.lit(0))


def busy_games(landed: DataFrame, plays: int = BUSY_PLAYS, key: str = "game_id") -> list[int]:
    """Games of at least ``plays`` of the landed rows, ``BUSY_GAMES`` at most.

    Slots of games are counted first, in one small row per task and slot; games are
    counted only in slots that hold as many rows.
    """
    plays = max(plays, -(-landed.count() // BUSY_GAMES))
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    full = landed.groupBy(slot.alias("slot")).count().filter(F.col("count") >= plays)
    slots = [r["slot"] for r in full.collect()]
    if not slots:
        return []
    counts = landed.filter(slot.isin(slots)).groupBy(key).count()
    return [r[key] for r in counts.filter((F.col("count") >= plays) & F.col(key).isNotNull()).collect()]


def with_schedule(
    plays: DataFrame, games: DataFrame, delay: str, salts: int = SALTS, busy: list[int] | None = None
) -> DataFrame:
    """Plays with their game's teams and start, watermarked on the start.

    Stateful streams run without adaptive execution, so a busy game is spread by
    a salt: it is there once per salt. ``busy`` names these games, see ``busy_games``;
    without it, any game may be one, and all are there once per salt. The schedule is
    never broadcast: its size is estimated from files, which tell nothing of the salts.
    """
    spread = F.lit(True) if busy is None else F.col("game_id").isin(busy)
    info = games.select(
        "game_id",
        F.col("start").cast("timestamp").alias("start"),
        F.col("home_team").alias("home"),
        F.col("away_team").alias("away"),
        F.explode(F.sequence(F.lit(0), F.when(spread, F.lit(salts - 1)).otherwise(F.lit(0)))).alias("salt"),
    )
    salt = F.pmod(F.xxhash64("order_number", "action_id", "clock"), F.lit(salts)).cast("int")
    return (
        plays.withColumn("salt", F.when(spread, salt).otherwise(F.lit(0)))
        .join(info.hint("merge"), ["game_id", "salt"])
        .drop("salt")
        .withWatermark("start", delay)
    )


def running_states(plays: DataFrame, games: DataFrame, delay: str, busy: list[int] | None = None) -> DataFrame:
    """The state of each game after its last play so far.

    Plays meet the schedule first, so a state knows its teams. The state of a
    game leaves the store once a game starting ``delay`` later has been seen; an
    ended game is marked by ``is_final_state``. As in a batch, plays without a
    description give no state, and a game with an unreadable play, marked by
    ``is_spoilt``, is to be left out by readers.
    """
    described = F.col("description").isNotNull()

    def told(column):
        return F.when(described, column)

    final = F.when(
        F.col("order_number").isNotNull(), F.col("description") == END_OF_GAME
    ).otherwise(F.coalesce(F.col("sub_type") == "end", F.lit(False)))
    rows = with_schedule(plays, games, delay, busy=busy).select(
        "game_id",
        "start",
        "home",
        "away",
        _place(),
        "clock",
        told(reported("score_home")).alias("told_home"),
        told(reported("score_away")).alias("told_away"),
        final.alias("is_final"),
        described.alias("is_described"),
        unreadable().alias("is_unreadable"),
    )
    last = F.max(F.when(F.col("is_described"), F.struct("place", "clock", "is_final")))
    return (
        rows.groupBy("game_id", "start", "home", "away")
        .agg(
            last.alias("last"),
            _newest_of("told_home").alias("home_score"),
            _newest_of("told_away").alias("away_score"),
            F.bool_or("is_unreadable").alias("is_spoilt"),
        )
        .filter("last IS NOT NULL")
        .select(
            "game_id",
            "home",
            "away",
            F.col("last.place.play_id").alias("play_id"),
            F.col("last.place.period").alias("period"),
            F.col("last.clock").alias("clock"),
            "home_score",
            "away_score",
            F.col("last.is_final").alias("is_final_state"),
            "is_spoilt",
        )
    )


def running_players(plays: DataFrame, games: DataFrame, delay: str, busy: list[int] | None = None) -> DataFrame:
    """Each player's first seen name and latest points so far."""
    named = F.col("person_id").isNotNull() & F.col("player_name").isNotNull()
    usable = F.col("order_number").isNotNull() | (
        (F.col("person_id") != 0) & (F.col("player_name") != "")
    )
    told = F.when(F.col("order_number").isNotNull(), F.col("points_total")).otherwise(
        points_in_text(F.col("description"))
    )
    at_home = F.coalesce(F.col("team_tricode") == F.col("home"), F.lit(False))
    rows = with_schedule(
        plays.filter(named & usable & F.col("description").isNotNull()), games, delay, busy=busy
    ).select(
        "game_id",
        "start",
        F.when(at_home, F.lit("home")).otherwise(F.lit("away")).alias("side"),
        "person_id",
        "player_name",
        _place(),
        told.alias("told_points"),
    )
    return (
        rows.groupBy("game_id", "start", "side", "person_id")
        .agg(
            F.min(F.struct("place", "player_name")).getField("player_name").alias("name"),
            _newest_of("told_points").alias("points"),
        )
        .drop("start")
    )


def running_predictions(states: DataFrame, predictions: DataFrame, predictor: str) -> DataFrame:
    """States stream with the stored prediction, blended; none for games spoilt so far."""
    readable = states.filter("NOT is_spoilt").drop("is_spoilt")
    return live_predictions(readable.join(newest(predictions, predictor), "game_id"))


_STATE = "spark.sql.streaming.stateStore"
#: States lie in RocksDB, whose memory is bounded for all of an executor's stores together: a commit
#: writes what a store holds in memory, and rows are not looked up only to be counted.
_ROCKS = {
    f"{_STATE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STATE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STATE}.rocksdb.maxMemoryUsageMB": "256",
    f"{_STATE}.rocksdb.changelogCheckpointing.enabled": "false",
    f"{_STATE}.rocksdb.trackTotalNumberOfRows": "false",
}


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session stays as it was."""
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def publish(
    stream: DataFrame,
    name: str,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "update",
    folder: str | None = None,
) -> str:
    """Run the stream over all that has landed, one folder per micro-batch."""
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if transform is None else transform(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    _run(stream, write, folder, mode)
    return folder


def publish_whole(
    stream: DataFrame,
    name: str,
    derive: Callable[[DataFrame], DataFrame],
    keys: tuple[str, ...] = ("game_id",),
    folder: str | None = None,
    buckets: int = BUCKETS,
    deltas: int = DELTAS,
) -> str:
    """Keep what is delivered, and derive each touched group from all of its rows so far.

    A group may arrive in any number of parts: each micro-batch derives the groups
    it touches anew, and readers take a group's newest batch, see ``published``.
    Deliveries lie by hash bucket of the keys; a micro-batch reads the buckets it
    touches and no others, and every ``deltas`` batches a bucket's deliveries become
    one. A retried batch rewrites its own folders and sees none that came after it.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    store = BucketStore(spark, name, keys, buckets, f"{folder}/delivered")

    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch, batch_id)
        store.compact(batch_id, deltas)
        touched = store.touched(batch_id)
        if not touched:
            return
        groups = store.read_version(batch_id).select(*keys).distinct()
        seen = store.read(touched, batch_id).join(groups, [*keys], "left_semi")
        derive(seen).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")

    _run(stream, write, folder)
    return folder


def publish_split(
    stream: DataFrame,
    name: str,
    moment: str,
    delay: str,
    keys: tuple[str, ...] = ("game_id", "play_id"),
    folder: str | None = None,
    buckets: int = BUCKETS,
) -> BucketStore:
    """Keep each key's first row that is not late, and set late rows aside.

    A row is late if its moment is at or before the watermark of its micro-batch. That
    is the latest moment of all but the last of the earlier ones, less the delay: the
    engine's own operators drop rows by the watermark of the batch before, and here the
    same rows are late. A null moment is never late. Rows that repeat
    a key of their own batch or of the store are left out. Late rows lie under
    ``late``, see ``late_rows``, and the rest in the store that is returned; a
    retried batch rewrites its own folders only.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    store = BucketStore(spark, name, keys, buckets, f"{folder}/kept")

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = batch.agg(F.max(moment).cast("timestamp").alias("latest"))
        latest.write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
        marks = spark.read.parquet(f"{folder}/marks").filter(F.col("batch") < batch_id - 1)
        edge = marks.select((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("edge")).first()["edge"]
        is_late = F.coalesce(F.col(moment) <= F.lit(edge).cast("timestamp"), F.lit(False))
        batch.filter(is_late).write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")
        new = batch.filter(~is_late).dropDuplicates([*keys])
        if batch_id:
            known = store.read(store.buckets_of(new), batch_id - 1).select(*keys)
            new = new.join(known, [*keys], "left_anti")
        store.append(new, batch_id)

    _run(stream, write, folder)
    return store


def late_rows(spark: SparkSession, store: BucketStore) -> DataFrame:
    """Rows that arrived behind the watermark, with the micro-batch that brought them."""
    folder = store.folder.removesuffix("/kept")
    return spark.read.option("basePath", f"{folder}/late").parquet(f"{folder}/late/batch=*")


def repaired(spark: SparkSession, store: BucketStore) -> DataFrame:
    """Kept rows, and of late ones the first of each key that was not kept."""
    keys = list(store.keys)
    late = late_rows(spark, store)
    rest = [c for c in late.columns if c not in (*keys, "batch")]
    first = late.groupBy(*keys).agg(F.min(F.struct("batch", *rest)).alias("first")).select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest])
    kept = store.read()
    return kept.unionByName(first.join(kept.select(*keys), keys, "left_anti").select(*kept.columns))


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], folder: str, mode: str = "append") -> None:
    with _rocks(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def published(spark: SparkSession, folder: str, *keys: str) -> DataFrame:
    """What was published; with keys, only each group's newest batch."""
    rows = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/batch=*")
    if keys:
        latest = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
        rows = rows.join(latest, [*keys, "batch"])
    return rows.drop("batch")
