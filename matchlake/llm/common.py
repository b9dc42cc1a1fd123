"""What the operators share: inputs, written tables, text slices and word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step looks at; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: A table is broadcast only if it was counted and is below this; else it is shuffled.
BROADCAST_BYTES = 32 << 20

#: Bytes of the prefix sums that word hashes come from.
HASH_BYTES = 1 << 18
#: Bytes of rows that go to a Python worker at once.
BATCH_BYTES = 4 << 20

#: Bytes that part words: space and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Send rows to Python workers a few MB at a time, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    found = str(spark.conf.get(key)).lower().removesuffix("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(found[-1:], 1)
    size = int(found.rstrip("kmg")) * scale
    if not 0 < size <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_rows(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and ``more`` as strings), whatever else the table holds."""
    small_batches(docs.sparkSession)
    names = [F.col(c).cast("string").alias(c) for c in ("text", *more)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *names)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read from there: cuts lineage, survives lost executors."""
    folder = new_folder(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def small(rows: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint behind a counted size; a larger table joins by shuffle instead."""
    return F.broadcast(rows) if rows.count() * row_bytes <= limit else rows


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system; a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not this C library
    _trim = None


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes together."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop
    release()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and where each row begins and ends; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    return data, bounds - bounds[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, up to n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


class Words:
    """Words of a slice: maximal runs of bytes that part no words, A-Z in lower case."""

    def __init__(self, texts: pa.Array, separator: np.ndarray = SEPARATOR):
        self.data, self.bounds = buffers(texts)
        self.data = LOWER[self.data]
        inside = ~separator[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins = self.bounds[:-1][self.bounds[:-1] < self.bounds[1:]]
        ends = self.bounds[1:][self.bounds[:-1] < self.bounds[1:]] - 1
        first[begins] = inside[begins]
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: The words of row k are those from ``rows[k]`` to ``rows[k + 1]``.
        self.rows = np.searchsorted(self.start, self.bounds)
        self.row = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.rows))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word that depend on its bytes alone."""
        return span_hashes(self.data, self.start, self.end, seed)

    def text(self, k: int) -> str:
        return self.data[self.start[k] : self.end[k]].tobytes().decode("utf-8", "replace")


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of byte spans that begin in ascending order: polynomials from prefix sums."""
    out = np.empty(len(start), np.uint64)
    k = 0
    while k < len(start):
        origin = start[k]
        stop = max(k + 1, int(np.searchsorted(end, origin + HASH_BYTES, "right")))
        piece = data[origin : end[k:stop].max()]
        up, down = _power(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(BYTE_CODE[piece] * up[: len(piece)], out=sums[1:])
        a, b = start[k:stop] - origin, end[k:stop] - origin
        out[k:stop] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _ODD + np.uint64(seed))
        k = stop
    return out


def shingles(words: Words, size: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its runs of ``size`` words.

    A row with fewer words, but at least one, has its whole sequence as its one
    shingle; a row without words has none.
    """
    codes = words.hashes()
    runs = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for k in range(size):
        runs = runs * _ODD + codes[k : k + len(runs)]
    runs = mix(runs + np.uint64(size))
    out = []
    for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for code in codes[a:b]:
                    whole = whole * _ODD + code
            out.append(mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def batches(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns, schema=schema)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values in order and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
