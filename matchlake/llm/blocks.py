"""Blocks of texts and their exchange of counts with shards.

A block is a run of rows of one piece of one input file, so that two passes over the
same files form the same blocks and texts need not be shuffled. A block asks shards
about its distinct n-grams and reads the answers in a later pass, in the order in
which it asked; both travel as compressed arrays, one per block and shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, release, written

#: Bytes of text of a block up to 10 GB of input; grows with the square root of the input,
#: so that the arrays between blocks and shards keep a useful length. A task holds one
#: block, and per byte of it up to some 40 bytes of sorted n-grams.
BLOCK_BYTES = 2 << 20
MOST_BLOCK_BYTES = 32 << 20
#: Bytes of text whose n-grams meet in one shard.
SHARD_BYTES = 16 << 20


def from_files(docs: DataFrame) -> DataFrame:
    """``docs`` itself if all its rows come straight from files, else a written copy."""
    return written(docs, "texts") if docs.where(F.input_file_name() == "").take(1) else docs


def with_split(docs: DataFrame) -> DataFrame:
    """Adds ``split``, which names the piece of the file that a row comes from.

    How files are cut follows the number of live cores unless the session says it;
    it is told the present number here, so that a lost executor between two passes
    does not cut them differently.
    """
    conf, key = docs.sparkSession.conf, "spark.sql.files.minPartitionNum"
    if not conf.get(key, None):
        conf.set(key, str(docs.sparkSession.sparkContext.defaultParallelism))
    return docs.withColumn("split", F.hex(F.xxhash64(F.input_file_name(), F.input_file_block_start())))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]


def layout(total: int) -> tuple[int, int]:
    """Bytes of a block and number of shards (a power of two) for so many bytes of text."""
    block = int(min(MOST_BLOCK_BYTES, max(BLOCK_BYTES, BLOCK_BYTES * (total / 10e9) ** 0.5)))
    return block, 1 << max(4, (total // SHARD_BYTES).bit_length())


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Blocks of about ``limit`` bytes; they depend on the rows of a split and their order only."""
    now, number, held, size = None, 0, [], 0

    def joined() -> tuple[str, pa.RecordBatch]:
        return f"{now}-{number}", pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        splits = batch.column("split").to_numpy(zero_copy_only=False)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))
        edges = [0, *(np.flatnonzero(splits[1:] != splits[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if splits[a] != now:
                if held:
                    yield joined()
                now, number, held, size = splits[a], 0, [], 0
            while a < b:
                before = int(sizes[a - 1]) if a else 0
                stop = min(b, int(np.searchsorted(sizes, before + limit - size)) + 1)
                held.append(batch.slice(a, stop - a))
                size += int(sizes[stop - 1]) - before
                if size >= limit:
                    yield joined()
                    release()
                    number, held, size = number + 1, [], 0
                a = stop
    if held:
        yield joined()
    release()


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed, with their count and width."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return np.array([len(values), values.itemsize], "<i8").tobytes() + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def expand(raw: bytes, kind: type) -> np.ndarray:
    count, width = np.frombuffer(raw[:16], "<i8").tolist()
    planes = np.frombuffer(pa.decompress(raw[16:], count * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, count).T).reshape(-1).view(kind)


def squeeze_sorted(codes: np.ndarray) -> bytes:
    """Ascending 64-bit codes as differences."""
    return squeeze(np.diff(codes, prepend=np.uint64(0)))


def expand_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(expand(raw, np.uint64), dtype=np.uint64)


def write_answers(answers: DataFrame) -> str:
    """Answers (block, kind, shard, payload) as one file per block; returns the folder's URI."""
    folder = new_folder(answers.sparkSession, "answers")
    answers.repartition("block").write.partitionBy("block").parquet(folder)
    return folder if ":" in folder else f"file://{folder}"


def read_answers(folder: str, block: str, kind: int, dtype: type) -> np.ndarray:
    """All answers to a block's questions of one kind, in the order of shards."""
    store, path = fs.FileSystem.from_uri(f"{folder}/block={block}")
    found = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["shard", "payload"], filter=ds.field("kind") == kind).sort_by("shard")
    parts = [expand(raw, dtype) for raw in found["payload"].to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)
