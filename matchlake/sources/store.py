"""Tables kept by hash bucket of their key: of deliveries, and of one row per key.

Rows lie in folders by kind, bucket and version. A delivery adds ``delta`` folders for
the buckets it touches. ``replace`` and ``compact`` write a new ``base`` of a bucket,
which stands for all of its folders up to that version. Readers name the buckets
they need: that is a filter on folders, so nothing else is listed as input, however
many deliveries there were. Writing a version again replaces its own folders only,
so a retried micro-batch changes nothing, and readers of an earlier version go on
with the folders they know.

``KeyedTables`` are bucketed and sorted Parquet tables. Joins of them on their key, and
aggregates by it, need neither an exchange nor a sort.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.sources.shared import new_folder

#: Folders by hash of the key; a table of many TB takes thousands.
BUCKETS = 16
#: Deliveries after which buckets are compacted.
DELTAS = 8
#: Rows of a bucket of ``KeyedTables``: few enough that a task sorts them in memory.
BUCKET_ROWS = 1 << 18

_PLACE = ["kind", "bucket", "version"]


class BucketStore:
    """Rows of groups named by ``keys``, in ``buckets`` folders under ``folder``."""

    def __init__(self, spark: SparkSession, name: str, keys: tuple[str, ...], buckets: int = BUCKETS, folder: str | None = None):
        self.spark, self.keys, self.buckets = spark, keys, buckets
        self.folder = folder or new_folder(spark, name)
        self.columns: list | None = None

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        self.columns = self.columns or list(rows.schema)
        placed = rows.withColumns({"kind": F.lit(kind), "bucket": self.bucket(), "version": F.lit(version)})
        # A bucket is one file or, if it is large, several of bounded size.
        (
            placed.hint("rebalance", "bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*_PLACE)
            .parquet(f"{self.folder}/rows")
        )

    def _files(self) -> DataFrame:
        path = f"{self.folder}/rows"
        if self.columns is None:  # another session wrote them
            self.columns = list(self.spark.read.parquet(path).drop(*_PLACE).schema)
        kinds = ("kind string", "bucket int", "version long")
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.columns]
        return self.spark.read.schema(", ".join([*columns, *kinds])).parquet(path)

    def _folders(self) -> set[tuple[str, int, int]]:
        """(kind, bucket, version) of all folders, from the listing that a reader has anyway."""
        found = set()
        for file in self._files().inputFiles():
            parts = dict(p.split("=", 1) for p in file.split("/") if "=" in p)
            found.add((parts["kind"], int(parts["bucket"]), int(parts["version"])))
        return found

    def _bases(self, upto: int) -> dict[int, int]:
        """The newest base of each bucket."""
        bases: dict[int, int] = {}
        for kind, bucket, version in self._folders():
            if kind == "base" and version <= upto:
                bases[bucket] = max(version, bases.get(bucket, -1))
        return bases

    def append(self, rows: DataFrame, version: int) -> None:
        """Add a delivery; the same version again takes the place of its first attempt."""
        self._write(rows, "delta", version)

    def touched(self, version: int) -> list[int]:
        """Buckets that a delivery added to."""
        return sorted(b for kind, b, v in self._folders() if kind == "delta" and v == version)

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """Buckets that the groups of ``rows`` lie in, at most ``buckets``."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def read(self, buckets: list[int] | None = None, upto: int = (1 << 62)) -> DataFrame:
        """All rows of these buckets (of all without them) as of a version."""
        files = self._files()
        bases = self._bases(upto)
        since = F.lit(-1).cast("long")
        if bases:
            known = F.create_map(*[F.lit(x) for b, v in sorted(bases.items()) for x in (b, v)])
            since = F.coalesce(F.try_element_at(known, F.col("bucket")), since)
        wanted = ((F.col("kind") == "base") & (F.col("version") == since)) | (
            (F.col("kind") == "delta") & (F.col("version") > since) & (F.col("version") <= upto)
        )
        if buckets is not None:
            wanted = wanted & F.col("bucket").isin(buckets)
        return files.filter(wanted).drop(*_PLACE)

    def read_version(self, version: int) -> DataFrame:
        """The rows of one delivery."""
        return self._files().filter((F.col("kind") == "delta") & (F.col("version") == version)).drop(*_PLACE)

    def replace(self, rows: DataFrame, version: int) -> None:
        """All stored rows of the groups in ``rows`` give way to these; other groups stay.

        Only buckets that ``rows`` touch are read and written.
        """
        groups = rows.select(*self.keys).distinct()
        stays = self.read(self.buckets_of(groups), version - 1).join(groups, list(self.keys), "left_anti")
        self._write(stays.unionByName(rows), "base", version)

    def compact(self, upto: int, after: int = DELTAS) -> None:
        """Write a base of the buckets that have over ``after`` deltas since their last one."""
        folders, bases = self._folders(), self._bases(upto)
        since = [b for kind, b, v in folders if kind == "delta" and bases.get(b, -1) < v <= upto]
        long = sorted(b for b in set(since) if since.count(b) > after)
        if long:
            self._write(self.read(long, upto), "base", upto)


def buckets_for(rows: int) -> int:
    """Buckets of tables of about so many rows."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


class KeyedTables:
    """Tables with the same key and number of buckets, by name, for the life of a session."""

    def __init__(self, spark: SparkSession, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.names: dict[str, str] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def save(
        self, name: str, rows: DataFrame, derive: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Write a table anew, one sorted file per bucket, and read it.

        ``derive`` makes the stored columns row by row where the rows as given are narrower:
        it comes after the shuffle.
        """
        stored = f"{name}_{uuid.uuid4().hex}"
        placed = rows.repartition(self.buckets, self.key)
        (
            (placed if derive is None else derive(placed))
            .write.bucketBy(self.buckets, self.key)
            .sortBy(self.key)
            .option("path", new_folder(self.spark, name))
            .option("compression", "zstd")
            .saveAsTable(stored, format="parquet")
        )
        self.names[name] = stored
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.table(self.names[name])
