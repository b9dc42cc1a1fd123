"""Codes of vectors by product quantisation over lexicographic tries of their parts.

Every component becomes an integer, every vector eight parts. A block of vectors keeps,
for each part position, its distinct parts in lexicographic order with their counts:
the leaves of a trie whose depth is the component. Blocks are written once. Each round
walks the tries depth first: a node carries the squared distances of its prefix to all
entries of the codebook, so that parts with a common prefix share them, and leaves take
the nearest entry and add themselves, as often as they occur, to its sum. Only counts and
sums of entries leave a task; the codebooks are the only state between rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lists, small, small_batches, written

SCALE = 4096
#: Parts of a vector, entries of a part's codebook, and rounds that move the entries.
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Components at or over this, after scaling, have no exact squared distances as long.
TOO_LARGE = 1 << 26
#: Trie nodes that are expanded in one step.
WIDTH = 8192
#: Bytes of a row that a sum by label sends to a broadcast join.
LABEL_BYTES = 64


def usable(vectors: DataFrame, label: str | None) -> DataFrame:
    """vec_id, label and the scaled components of vectors that have only finite ones."""
    small_batches(vectors.sparkSession)
    marked = F.col(label) if label else F.lit(None).cast("int")
    values = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), marked.alias("label"), values.alias("x"))
    fits = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < TOO_LARGE / SCALE), F.lit(False)))
    kept = rows.where(F.coalesce((F.size("x") > 0) & fits, F.lit(False)))
    return kept.select("vec_id", "label", F.transform("x", lambda x: F.floor(x * SCALE).cast("int")).alias("x"))


class Trie:
    """Distinct parts in lexicographic order; a row is a leaf, a run of rows with a common prefix a node."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.int64)
        #: Depth at which a leaf's path leaves that of the leaf before it.
        self.fork = np.zeros(len(parts), np.int64)
        if len(parts) > 1:
            self.fork[1:] = (parts[1:] != parts[:-1]).argmax(axis=1)

    @staticmethod
    def of(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct parts in order, how often each occurs, and the leaf of each given part."""
        order = np.lexsort(parts.T[::-1])
        ranked = parts[order]
        new = np.ones(len(parts), bool)
        new[1:] = (ranked[1:] != ranked[:-1]).any(axis=1)
        leaf = np.empty(len(parts), np.int64)
        leaf[order] = np.cumsum(new) - 1
        return ranked[new], np.bincount(leaf, minlength=int(new.sum())), leaf

    def nearest(self, entries: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each leaf, the first of equally near ones, and its squared distance."""
        n, depth = self.parts.shape
        index, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
        # Neighbouring nodes of one depth: their first leaves, the end of the last, distances so far.
        stack = [(0, np.zeros(1, np.int64), n, np.zeros((1, len(entries)), np.int64))] if n else []
        while stack:
            at, starts, end, sums = stack.pop()
            if at == depth:
                index[starts] = sums.argmin(axis=1)
                distance[starts] = sums.min(axis=1)
                continue
            first = int(starts[0])
            children = first + np.flatnonzero(self.fork[first:end] <= at)
            if children[0] != first:
                children = np.concatenate([starts[:1], children])
            parent = np.searchsorted(starts, children, "right") - 1
            below = sums[parent] + np.square(self.parts[children, at][:, None] - entries[None, :, at])
            # The leftmost run of children is taken next; the others wait.
            cuts = list(range(0, len(children), width))
            for a in reversed(cuts):
                b = min(len(children), a + width)
                stop = int(children[b]) if b < len(children) else end
                stack.append((at + 1, children[a:b], stop, below[a:b]))
        return index, distance


def _matrix(column: pa.Array, dimension: int, parts: int) -> np.ndarray:
    """Rows by part position by place in the part; short last parts are filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
    width = -(-dimension // parts)
    out = np.zeros((len(values), parts * width), np.int32)
    out[:, :dimension] = values
    return out.reshape(len(values), parts, width)


BLOCK = "parts array<binary>, counts array<binary>, leaves array<binary>"


def blocks(rows: DataFrame, dimension: int, parts: int = PARTS) -> DataFrame:
    """One row per batch of vectors: vec_ids, labels and, by part position, what tries are made of."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cut = _matrix(batch.column("x"), dimension, parts)
            made = [Trie.of(cut[:, p]) for p in range(parts)]
            columns = [[[m[k].astype(kind).tobytes() for m in made]] for k, kind in enumerate(("<i4", "<i8", "<i4"))]
            one = np.array([batch.num_rows])
            wrapped = [lists(batch.column(c), one, batch.column(c).type) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*wrapped, *(pa.array(c, pa.list_(pa.binary())) for c in columns)], ["vec_ids", "labels", "parts", "counts", "leaves"])

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(built, f"vec_ids array<long>, labels array<{label}>, {BLOCK}")


def _moved(table: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after one round: every entry at the mean, rounded down, of what is nearest to it."""
    parts, entries, width = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((parts, entries), np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for leaves, times in zip(batch.column("parts").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                for p in range(parts):
                    trie = Trie(np.frombuffer(leaves[p], "<i4").reshape(-1, width))
                    copies = np.frombuffer(times[p], "<i8")
                    index, _ = trie.nearest(books[p])
                    np.add.at(counts[p], index, copies)
                    np.add.at(sums[p], index, trie.parts * copies[:, None])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"]
        )

    found = table.select("parts", "counts").mapInArrow(summed, "part int, entry int, n long, sums array<long>")
    each = found.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    total = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("value").alias("value"))
    out = books.copy()
    for r in total.collect():  # as many rows as the codebooks have components
        out[r["part"], r["entry"], r["place"]] = r["value"] // r["n"]
    return out


def encode(vectors: DataFrame, label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of vectors, their squared errors and a digest of the codebooks.

    ``vectors`` has vec_id, embedding and, if named, a label; other columns are ignored.
    Returns one row per row whose vector holds only finite components: vec_id, code (the
    nearest entries in part order, two hex digits each), error (squared distances summed
    over parts), label_error (errors summed over equal labels, nulls together; null if
    beyond a long) and codebooks_sha256. Rows with a null or empty vector, with a null or
    non-finite component or one of 16,384 or more, whose squares no long holds, and those
    of another dimension than the most frequent one (the smaller of equally frequent
    ones) are left out. Codebooks start at the vectors of the smallest vec_ids; rows that
    repeat a vec_id follow their components, and those without vec_id are coded but
    start no entry; fewer than ``entries`` vectors make fewer entries. If the dimension
    is no multiple of ``parts``, zeros follow. An empty table, or one without any vec_id,
    gives no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = usable(vectors, label)
    out = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    common = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    start = []
    if common:
        rows = rows.where(F.size("x") == common[0]["n"])
        start = rows.where("vec_id is not null").orderBy("vec_id", "x").limit(entries).select("x").collect()  # ``entries`` rows
    if not start:
        empty = rows.limit(0).select("vec_id", F.lit("").alias("code"), *(F.lit(0).cast("long").alias(c) for c in ("error", "label_error")))
        return empty.withColumn("codebooks_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    dimension = common[0]["n"]
    books = _matrix(pa.array([r["x"] for r in start], pa.list_(pa.int32())), dimension, parts).transpose(1, 0, 2).astype(np.int64)
    table = written(blocks(rows, dimension, parts), "tries")
    for _ in range(rounds):
        books = _moved(table, books)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    width = books.shape[2]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = {c: batch.column(c)[k].values for c in batch.schema.names}
                error, index = 0, []
                for p in range(parts):
                    trie = Trie(np.frombuffer(one["parts"][p].as_py(), "<i4").reshape(-1, width))
                    found, distance = trie.nearest(books[p])
                    leaf = np.frombuffer(one["leaves"][p].as_py(), "<i4")
                    index.append(found[leaf])
                    error = error + distance[leaf]
                digits = np.stack(index, axis=1).astype(np.uint8).tobytes().hex()
                codes = [digits[a : a + 2 * parts] for a in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([one["vec_ids"], one["labels"], pa.array(codes), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    found = written(table.select("vec_ids", "labels", "parts", "leaves").mapInArrow(coded, out), "codes")
    sums = written(found.groupBy(F.col("label").alias("same")).agg(F.try_sum("error").alias("label_error")), "errors")
    joined = found.join(small(sums, LABEL_BYTES), F.col("label").eqNullSafe(F.col("same")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
