"""Token-id files of fixed-width bit-packed blocks.

A file is: header (magic, bits per id, ids per block, number of ids, of blocks, of
documents), the packed blocks, then block offsets, doc ids, whether they are null,
and first ids of the documents as 64-bit integers. Blocks are padded to 32 ids, so
that 32 ids fill as many 32-bit words as an id has bits, and numpy packs and unpacks
32 columns at a time. One id range is read from the blocks that hold it.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import new_folder, partitions, slices, text_rows, written

MAGIC = b"TIDPACK1"
HEADER = struct.Struct("<8sIIQQQ")
#: Ids of a block.
BLOCK_IDS = 1 << 14
#: Files for each shuffle partition, so that their uneven sizes even out.
FILES_PER_PARTITION = 4


def bits(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> np.ndarray:
    """Ids as little-endian 32-bit words of ``width`` bits an id, the last group padded."""
    groups = -(-len(ids) // 32)
    padded = np.zeros(groups * 32, np.uint32)
    padded[: len(ids)] = ids
    columns = padded.reshape(groups, 32)
    out = np.zeros((groups, width), np.uint32)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        out[:, word] |= columns[:, k] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= columns[:, k] >> np.uint32(32 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, width: int, count: int) -> np.ndarray:
    table = words.reshape(-1, width)
    out = np.empty((len(table), 32), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for k in range(32):
        word, shift = divmod(k * width, 32)
        value = table[:, word] >> np.uint32(shift)
        if shift + width > 32:
            value = value | (table[:, word + 1] << np.uint32(32 - shift))
        out[:, k] = value & mask
    return out.reshape(-1)[:count]


class Writer:
    """Writes one file block by block under a name of its own, then moves it into place."""

    def __init__(self, path: str, width: int, block_ids: int = BLOCK_IDS):
        self.store, self.path = fs.FileSystem.from_uri(path)
        self.store.create_dir(os.path.dirname(self.path), recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.width, self.block_ids = width, block_ids
        self.out = self.store.open_output_stream(self.part)
        self.out.write(HEADER.pack(MAGIC, width, block_ids, 0, 0, 0))
        self.at, self.total, self.waiting, self.held = HEADER.size, 0, [], 0
        self.offsets, self.doc_ids, self.nulls, self.starts = [], [], [], []

    def _block(self, ids: np.ndarray) -> None:
        raw = pack(ids, self.width).astype("<u4").tobytes()
        self.offsets.append(self.at)
        self.out.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.total)
        self.total += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.waiting)
            full = len(ids) // self.block_ids * self.block_ids
            for k in range(0, full, self.block_ids):
                self._block(ids[k : k + self.block_ids])
            self.waiting, self.held = [ids[full:]], len(ids) - full

    def close(self) -> int:
        if self.held:
            self._block(np.concatenate(self.waiting))
        for numbers in (self.offsets, self.doc_ids, self.nulls, self.starts):
            self.out.write(np.array(numbers, "<i8").tobytes())
        self.out.write(HEADER.pack(MAGIC, self.width, self.block_ids, self.total, len(self.offsets), len(self.doc_ids)))
        self.out.close()
        self.store.move(self.part, self.path)
        return self.total


class Reader:
    """Random access to one file; the footer repeats the header with all counts."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        end = self.file.size() - HEADER.size
        magic, self.width, self.block_ids, self.total, blocks, docs = HEADER.unpack(self.file.read_at(HEADER.size, end))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token-id file")
        size = 8 * (blocks + 3 * docs)
        numbers = np.frombuffer(self.file.read_at(size, end - size), "<i8")
        self.edges = np.append(numbers[:blocks], end - size)
        self.doc_ids, self.nulls, self.starts = numbers[blocks:].reshape(3, docs)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``, from the blocks that hold them only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        raw = self.file.read_at(int(self.edges[last + 1] - self.edges[first]), int(self.edges[first]))
        count = min(self.total, (last + 1) * self.block_ids) - first * self.block_ids
        base = first * self.block_ids
        return unpack(np.frombuffer(raw, "<u4"), self.width, count)[start - base : stop - base]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Doc id, first id and ids of each document, read about ``most`` ids at a time."""
        stops = np.append(self.starts[1:], self.total)
        k = 0
        while k < len(self.starts):
            upto = max(k + 1, int(np.searchsorted(stops, self.starts[k] + most, "right")))
            run = self.ids(int(self.starts[k]), int(stops[upto - 1]))
            for j in range(k, upto):
                a, b = int(self.starts[j] - self.starts[k]), int(stops[j] - self.starts[k])
                yield None if self.nulls[j] else int(self.doc_ids[j]), int(self.starts[j]), run[a:b]
            k = upto


def write(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of every whole text, in ascending doc_id, to files in the shared folder.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty, a
    document without tokens has its end id alone, rows with a null doc_id come first,
    repeated doc ids stay next to each other. Returns one row per file: file, base
    (ids of all files before it), n_tokens. An empty table has no files.

    Documents go to files by ranges of doc_id that come from quantiles; only the
    compressed ids are shuffled. A file is written under a name of its own and moved,
    so a task that runs again replaces it whole.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "token-ids")
    uri = folder if ":" in folder else f"file://{folder}"
    rows = text_rows(docs)
    parts = partitions(spark)
    files = parts * FILES_PER_PARTITION
    bounds = np.unique(np.array(rows.approxQuantile("doc_id", [k / files for k in range(1, files)], 0.0005), dtype=np.int64))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits(tokens.load(path).get_vocab_size())
        for batch in batches:
            for part in slices(batch, limit=tokens.SLICE_BYTES):
                ids, counts = tokens.encode(part.column("text"), path)
                edges = np.concatenate([[0], np.cumsum(counts)])
                payload = [pa.compress(np.append(ids[a:b], np.uint32(end_id)).astype(np.uint16 if width <= 16 else np.uint32).tobytes(), "zstd", asbytes=True) for a, b in zip(edges[:-1], edges[1:], strict=True)]
                doc_ids = part.column("doc_id")
                place = np.searchsorted(bounds, pc.fill_null(doc_ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "right")
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(place.astype(np.int64)), pa.array(counts + 1), pa.array(payload, pa.binary())], ["doc_id", "file_no", "n_tokens", "payload"])

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = bits(tokens.load(path).get_vocab_size())
        kind = np.dtype(np.uint16 if width <= 16 else np.uint32)
        writer, now = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file_no": pa.array([now]), "file": [f"{uri}/{now:08d}.tid"], "n_tokens": pa.array([writer.close()], pa.int64())})

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "file_no", "n_tokens", "payload"))
            for doc_id, file_no, n, payload in zip(*columns, strict=True):
                if file_no != now:
                    if writer:
                        yield done()
                    now, writer = file_no, Writer(f"{uri}/{file_no:08d}.tid", width)
                writer.add(doc_id, np.frombuffer(pa.decompress(payload, n * kind.itemsize, "zstd", asbytes=True), kind).astype(np.uint32))
        if writer:
            yield done()

    made = written(
        rows.mapInArrow(encoded, "doc_id long, file_no long, n_tokens long, payload binary")
        .repartition(parts, "file_no")
        .sortWithinPartitions("file_no", "doc_id")
        .mapInArrow(filed, "file_no long, file string, n_tokens long"),
        "token-files",
    )
    # One row per file; their number is a multiple of the shuffle partitions.
    listed = sorted(made.collect(), key=lambda r: r.file_no)
    base, out = 0, []
    for r in listed:
        out.append((r.file, base, r.n_tokens))
        base += r.n_tokens
    return spark.createDataFrame(out, "file string, base long, n_tokens long").repartition(max(1, len(out)))


def read(files: DataFrame, crc: bool = False) -> DataFrame:
    """Documents of the files: doc_id, start (ids of all documents before), n_tokens,
    and ids, or with ``crc`` the unsigned CRC-32 of the ids as little-endian uint32."""
    last = ("ids_crc32", "long") if crc else ("ids", "array<int>")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                for doc_id, start, ids in Reader(file).documents():
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if crc else ids.astype(np.int32)))
                    if len(rows) >= 2000:
                        yield shaped(rows)
                        rows = []
                if rows:
                    yield shaped(rows)

    def shaped(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if crc else pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", last[0]])

    return files.select("file", "base").mapInArrow(opened, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")
