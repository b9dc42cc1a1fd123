"""Packing of token sequences by dominance reduction and best fit.

Only lengths matter for packing, and a length is at most the capacity, so the
instance is a table of counts by length however many documents there are. Sets of
lengths are fixed in bulk:

* Reduction: for an item j with gap g = capacity - j, a set {j}, {j, k} or {j, a, b}
  is fixed when every other feasible set with j is dominated by it, i.e. its other
  items can be dealt out under the set's items without exceeding them. Some optimal
  packing then holds that set.
* Best fit of what remains, longest first, many equal items and bins at a time.

The plan is a list of intervals: the items of one length ranked r0 <= rank < r1 go to
sequences base + rank - r0 at one offset. Documents take ranks within their length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import slices, text_rows, written

CAPACITY = 4096
#: Items of one length that are ranked in one task.
RANKED_ROWS = 100_000


def reduce(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """Counts by length after fixing dominating sets, and the fixed (number, lengths)."""
    left, fixed = counts.copy(), []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(left)[::-1].tolist():
            while left[j] > 0:
                found = _dominating(left, j, capacity)
                if found is None:
                    break
                need = defaultdict(int)
                for length in found:
                    need[length] += 1
                times = int(min(left[length] // n for length, n in need.items()))
                for length, n in need.items():
                    left[length] -= times * n
                fixed.append((times, found))
                changed = True
    return left, fixed


def _dominating(left: np.ndarray, j: int, capacity: int) -> list[int] | None:
    """A set with item j that dominates every feasible set with it, if one is found."""
    gap = capacity - j
    left[j] -= 1
    try:
        if gap == 0:
            return [j]
        if left[gap]:
            return [j, gap]  # fills up: all else that fits beside j fits under it
        lengths = np.flatnonzero(left[: gap + 1])
        if not len(lengths):
            return [j]
        smallest: list[int] = []
        for length in lengths[:3].tolist():
            smallest += [length] * min(3, int(left[length]))
        smallest = smallest[:3]
        largest = int(lengths[-1])
        if len(smallest) < 2 or smallest[0] + smallest[1] > gap:
            return [j, largest]  # one more fits at most
        if len(smallest) > 2 and sum(smallest) <= gap:
            return None
        # Two more fit at most: the best sum of two, and the best smaller item of a pair.
        most, lower = 0, 0
        for x in lengths.tolist():
            below = lengths[lengths <= min(x, gap - x)]
            if len(below) and below[-1] == x and left[x] < 2:
                below = below[:-1]
            if len(below):
                most, lower = max(most, x + int(below[-1])), max(lower, int(below[-1]))
        if most <= largest:
            return [j, largest]
        partners = lengths[lengths <= gap - largest]
        if len(partners) and partners[-1] == largest and left[largest] < 2:
            partners = partners[:-1]
        if len(partners) and int(partners[-1]) >= lower:
            return [j, largest, int(partners[-1])]
        return None
    finally:
        left[j] += 1


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[int]]]:
    """Best fit, longest first, over counts by length: (number of equal bins, lengths)."""
    room: dict[int, list[list]] = defaultdict(list)  # free room: [bins, lengths]
    full: list[tuple[int, list[int]]] = []
    open_rooms = np.zeros(capacity + 1, bool)

    def put(bins: int, lengths: list[int], free: int) -> None:
        if free == 0:
            full.append((bins, lengths))
            return
        room[free].append([bins, lengths])
        open_rooms[free] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        rest = int(counts[length])
        while rest:
            free = length + int(np.argmax(open_rooms[length:]))
            if free > capacity or not open_rooms[free]:
                bins, lengths, free = -(-rest // (capacity // length)), [], capacity
            else:
                bins, lengths = room[free].pop()
                open_rooms[free] = bool(room[free])
            each = free // length
            whole = min(bins, rest // each)
            if whole:
                put(whole, lengths + [length] * each, free - each * length)
                bins, rest = bins - whole, rest - whole * each
            if bins and rest:
                put(1, lengths + [length] * rest, free - rest * length)
                bins, rest = bins - 1, 0
            if bins and lengths:
                put(bins, lengths, free)
    return full + [(n, lengths) for groups in room.values() for n, lengths in groups]


def plan(counts: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Intervals by length and rank for counts by length (index 0 unused)."""
    left, sets = reduce(counts.astype(np.int64), capacity)
    sets = sets + best_fit(left, capacity)
    used, base, rows = defaultdict(int), 0, []
    for n, lengths in sets:
        offset = 0
        for length in lengths:
            rows.append((length, used[length], n, base, offset))
            used[length] += n
            offset += length
        base += n
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "number", "sequence", "offset"), columns, strict=True))


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Every document's ids and end id, cut only where longer than ``capacity``:
    doc_id, piece, start, length, ids_crc32 and with ``with_ids`` the ids (binary,
    little-endian uint32). A null text is empty and has its end id alone."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=tokens.SLICE_BYTES):
                ids, counts = tokens.encode(part.column("text"), path)
                edges = np.concatenate([[0], np.cumsum(counts)]).tolist()
                rows = []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[edges[k] : edges[k + 1]], np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        raw = own[start : start + capacity].tobytes()
                        rows.append((doc_id, n, start, len(raw) // 4, zlib.crc32(raw), raw if with_ids else None))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = len(names) - (not with_ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns[:keep], kinds, strict=False)], names[:keep])

    rows = text_rows(docs)
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def pack(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """Pack all documents into few sequences of at most ``capacity`` tokens.

    ``docs`` has doc_id and text; other columns are ignored. Returns the pieces with
    sequence_id and offset; sequences have no gaps. Repeated rows are packed each,
    null doc ids stay null, an empty table gives no rows.

    Shuffled are only doc ids and lengths. A length that many pieces share is ranked
    in parts of about ``RANKED_ROWS`` rows.
    """
    found = written(pieces(docs, path, end_id, capacity, with_ids), "pieces")
    spark = found.sparkSession
    table = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in table:
        counts[r["length"]] = r["count"]
    layout = plan(counts, capacity)
    sent = spark.sparkContext.broadcast(layout)  # its size depends on the capacity, not on the rows
    salts = spark.createDataFrame([(length, int(-(-n // RANKED_ROWS))) for length, n in enumerate(counts.tolist()) if n], "length long, salts long")
    keyed = found.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), "salts")).drop("salts")
    sizes = keyed.groupBy("length", "salt").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("length", "salt", before.alias("first"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("rank", F.row_number().over(order)).join(firsts, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("first")).drop("first", "salt")

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = sent.value
        keys = where["length"] * (1 << 50) + where["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            length = batch.column("length").to_numpy()
            k = np.searchsorted(keys, length * (1 << 50) + rank, "right") - 1
            sequence = where["sequence"][k] + rank - where["rank"][k] if len(k) else np.zeros(0, np.int64)
            offset = where["offset"][k] if len(k) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "binary"}
    return ranked.mapInArrow(placed, ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long")
