"""Bottom-k sketches of word shingles: mergeable, for resemblance, containment and counts.

The sketch of a text is the k smallest distinct hashes of its shingles. Sketches of
parts merge into the sketch of the whole, if the parts overlap by a shingle's words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, partitions, shingles, slices, text_rows

#: Hashes kept; the standard error of a resemblance J is sqrt(J (1 - J) / k).
K = 256
SHINGLE_WORDS = 5


def sketch(text_array: pa.Array, k: int = K, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sketches of the rows of a text column; a text without words has an empty one."""
    return [s[:k] for s in shingles(Words(text_array), size)]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest as a share of all hashes."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's sketch that both hold; two empty sketches are alike."""
    union = merge(a, b, k)
    if not len(union):
        return 1.0
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(both <= union[-1]) / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b holds."""
    if not len(a):
        return 1.0
    alike = resemblance(a, b, k)
    shared = alike * distinct(merge(a, b, k), k)
    return min(1.0, shared / distinct(a, k))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def parse(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint and n_distinct (the estimate) of every whole text, without a shuffle.

    A null text is empty; repeated rows are each returned; other columns are ignored.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = sketch(part.column("text"), k, size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(dump, found), pa.string()), pa.array([distinct(s, k) for s in found], pa.float64())], ["doc_id", "fingerprint", "n_distinct"])

    rows = text_rows(docs)
    return rows.mapInArrow(made, "doc_id long, fingerprint string, n_distinct double")


def with_next(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows dealt so that each task meets a document and its successor, and their partitions.

    Ranges of doc_id from quantiles are sorted in tasks; the first document of a range
    goes to the range before as well, with ``edge`` true, and that of the first range
    to the last. Order: doc_id with nulls first, then text.
    """
    spark = docs.sparkSession
    rows = text_rows(docs).fillna("", "text")
    parts = partitions(spark)
    ranges = 4 * parts
    # Nulls come first. Doubles keep the order of ids, and equal ids in one range.
    place = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    bounds = sorted(set(rows.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.0005)))
    cut = Bucketizer(splits=[-float("inf"), *(bounds or [0.0]), float("inf")], inputCol="place", outputCol="range")
    numbered = cut.transform(rows.withColumn("place", place)).withColumn("bucket", F.col("range").cast("int")).drop("place", "range")
    # One row per range: the number of ranges is set above, not by the data.
    firsts = numbered.groupBy("bucket").agg(F.max(F.col("doc_id").isNull()).alias("no_id"), F.min("doc_id").alias("first")).collect()
    order = sorted(firsts, key=lambda r: r["bucket"])
    pairs = [(r["bucket"], None if r["no_id"] else r["first"], order[k - 1]["bucket"]) for k, r in enumerate(order)]
    heads = spark.createDataFrame(pairs, "bucket int, head long, before int")
    own = numbered.join(F.broadcast(heads), "bucket", "left")
    is_head = F.col("doc_id").eqNullSafe(F.col("head"))
    target = F.when(is_head, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("edge")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge")))
    )
    dealt = own.withColumn("target", F.explode(target)).select("target.bucket", "target.edge", "doc_id", "text")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "edge", F.asc_nulls_first("doc_id"), "text"), parts


def compare_edits(docs: DataFrame, k: int = K, size: int = SHINGLE_WORDS) -> DataFrame:
    """Fingerprints of every whole text and of its edit, whose second half is the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, and the estimates contained (share of the text's shingles
    in its edit) and n_distinct. A null text is empty; texts without words have equal,
    empty fingerprints. Repeated doc ids follow each other by text; the document after
    the last is the first. An empty table gives no rows.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # the row whose successor is still to come

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            ids, texts, nexts = zip(*rows, strict=True)
            edited = []
            for text, other in zip(texts, nexts, strict=True):
                half = len(text) // 2
                edited.append(text[: len(text) - half] + other[:half])
            a, b, c = (sketch(pa.array(t, pa.large_string()), k, size) for t in (texts, edited, nexts))
            pairs = list(zip(a, b, c, strict=True))
            columns = {
                "doc_id": pa.array(ids, pa.int64()),
                "n_chars": pa.array(map(len, texts), pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                "fingerprint": pa.array(map(dump, a), pa.string()),
                "edited_fingerprint": pa.array(map(dump, b), pa.string()),
                "near_edited": pa.array([resemblance(x, y, k) for x, y, _ in pairs], pa.float64()),
                "near_next": pa.array([resemblance(x, z, k) for x, _, z in pairs], pa.float64()),
                "contained": pa.array([containment(x, y, k) for x, y, _ in pairs], pa.float64()),
                "n_distinct": pa.array([distinct(x, k) for x in a], pa.float64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for part in slices(batch):
                ready = []
                columns = (part.column(c).to_pylist() for c in ("bucket", "edge", "doc_id", "text"))
                for bucket, edge, doc_id, text in zip(*columns, strict=True):
                    if waiting and waiting[0] == bucket:
                        ready.append((*waiting[1:], text))
                    waiting = None if edge else (bucket, doc_id, text)
                if ready:
                    yield flush(ready)

    rows, _ = with_next(docs)
    return rows.mapInArrow(
        compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained double, n_distinct double",
    )
