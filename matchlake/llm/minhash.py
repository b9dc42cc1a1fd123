"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of one universe make all signature coordinates: the first spreads
the shingles, the second is read from K places in turn, circularly shifted by one for
each coordinate. One shingle's K values are thus a contiguous run of one table.

Equal sets are one class; only its first document goes on. Documents that share a band
are joined into candidate clusters, and inside a cluster every pair of sets is counted
exactly, so that banding only has to bring two documents into one cluster. There are as
many bands as the threshold needs: a pair at it misses all of them with probability
(1 - threshold^7)^bands, at most 2e-7.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lists, mix, shingles, slices, small, text_rows, written
from .components import components

#: Percent of Jaccard similarity that links documents where no other is asked for.
PERCENT = 80
ROWS = 7
#: Largest probability that a pair at the threshold shares no band.
MISSED = 2e-7
UNIVERSE_BITS = 20
#: Documents of a cluster whose sets meet in one task; larger clusters take pairs of such blocks.
BLOCK_ROWS = 1000
SHINGLE_WORDS = 5
SEED = 20

_tables: dict = {}


def bands_for(percent: int, rows: int = ROWS) -> int:
    """Fewest bands that a pair at ``percent`` misses with a probability of ``MISSED`` at most."""
    shared = (percent / 100) ** rows
    return 1 if shared >= 1 else math.ceil(math.log(MISSED) / math.log1p(-shared))


BANDS = bands_for(PERCENT)


def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and all circular runs of the second as rows of a view."""
    if coordinates not in _tables:
        rng = np.random.default_rng(SEED)
        size = 1 << UNIVERSE_BITS
        first = rng.permutation(size).astype(np.uint32)
        second = rng.permutation(size).astype(np.uint32)
        runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: coordinates - 1]]), coordinates)
        _tables[coordinates] = (first, runs)
    return _tables[coordinates]


def signature(found: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """Signature of a set of 64-bit shingle hashes; all ones for an empty set."""
    first, runs = permutations(coordinates)
    places = first[found >> np.uint64(64 - UNIVERSE_BITS)]
    out = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(places), 1024):
        np.minimum(out, runs[places[k : k + 1024]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per document and band."""
    table = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), table.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + table[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, n_shingles, two hashes of the whole set, and band keys."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingles(Words(part.column("text")), size)
                signs = np.stack([signature(s, bands * rows) for s in sets])
                keys = band_keys(signs, bands, rows)
                h1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                h2 = np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) if len(s) else np.uint64(0) for s in sets], np.uint64).view(np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.array(h1), pa.array(h2), lists(keys.reshape(-1), np.full(len(sets), bands), pa.int64())], ["doc_id", "n_shingles", "h1", "h2", "bands"]
                )

    return text_rows(docs).mapInArrow(made, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections.

    A shingle of few sets adds to its pairs one by one; those of many sets are
    columns of 0/1 matrices that are multiplied a slab at a time.
    """
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    holders = np.diff(np.append(new, len(values)))
    out = np.zeros((m, m), np.int64)
    for d in np.unique(holders[(holders > 1) & (holders <= 16)]).tolist():
        table = owner[new[holders == d][:, None] + np.arange(d)]
        for i in range(d):
            for j in range(i + 1, d):
                out += np.bincount(table[:, i] * m + table[:, j], minlength=m * m).reshape(m, m)
    many = np.flatnonzero(holders > 16)
    for k in range(0, len(many), 4096):
        some = many[k : k + 4096]
        slab = np.zeros((m, len(some)), np.float32)
        for c, (a, n) in enumerate(zip(new[some].tolist(), holders[some].tolist(), strict=True)):
            slab[owner[a : a + n], c] = 1
        product = np.rint(slab @ slab.T).astype(np.int64)
        out += np.triu(product, 1)
    return out + out.T


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges from each linked document to the first one of its component here."""
    sizes = np.array([len(s) for s in sets], np.int64)
    shared = shared_counts(sets)
    near = 100 * shared >= percent * (sizes[:, None] + sizes[None, :] - shared)
    np.fill_diagonal(near, False)
    seen, out = np.zeros(len(ids), bool), []
    for k in range(len(ids)):
        if seen[k] or not near[k].any():
            continue
        front = np.zeros(len(ids), bool)
        front[k] = True
        seen[k] = True
        while front.any():
            front = near[front].any(axis=0) & ~seen
            seen |= front
            out += [(int(x), int(ids[k])) for x in ids[front]]
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int | None = None, rows: int = ROWS, size: int = SHINGLE_WORDS, block: int = BLOCK_ROWS) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least ``percent`` / 100.

    ``bands`` follows from ``percent`` and ``rows`` where it is not given.
    ``docs`` has doc_id and text; other columns are ignored. Returns one row per row:
    doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself
    included), kept (doc_id = component_id). Texts that are null, empty or without
    words link with nothing. Rows that repeat a doc_id are one document with the texts
    of both, and each returned; rows with a null doc_id link with nothing, have a null
    component and are kept. An empty table gives no rows.
    """
    base = written(sketches(docs, bands or bands_for(percent, rows), rows, size), "sketches")
    usable = base.where("doc_id is not null and n_shingles > 0")
    classes = written(usable.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep")), "classes")
    members = usable.select("doc_id", "h1", "h2", "n_shingles").join(classes, ["h1", "h2", "n_shingles"]).select("doc_id", "rep")
    heads = usable.join(classes.withColumnRenamed("rep", "doc_id"), ["h1", "h2", "n_shingles", "doc_id"]).select("doc_id", F.explode("bands").alias("band")).distinct()
    shared = heads.groupBy("band").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("band", "b")
    shared = written(shared, "bands")
    near = heads.join(small(shared, 48), "band").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    clusters = written(components(near), "clusters")

    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    placed = written(clusters.join(sizes, "component").select(F.col("node").alias("doc_id"), "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block")), "placed")
    texts = text_rows(docs).join(small(placed, 64), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingles(Words(part.column("text")), size)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "component", "blocks", "block")), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "component", "blocks", "block", "set"])

    # Every pair of a cluster's blocks is one group; a block goes to as many groups as there are blocks.
    hashes = texts.select("doc_id", "component", "blocks", "block", "text").mapInArrow(hashed, "doc_id long, component long, blocks int, block int, set binary")
    dealt = hashes.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("doc_id", "component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set")

    def verified(group: pa.Table) -> pa.Table:
        ids = group["doc_id"].to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in group["set"].to_pylist()]
        found = links(ids, sets, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    same_set = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    edges = dealt.groupBy("component", "i", "j").applyInArrow(verified, "a long, b long").unionByName(same_set)
    joined = components(edges)
    out = base.select("doc_id", "n_shingles").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
