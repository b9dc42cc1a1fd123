"""BPE encoding by tree concatenation, and decoding.

A long text is cut in halves down to leaves that know nothing of each other. Two
neighbours are joined by encoding a window around the cut again and growing it
until both sides agree with it:

* the left ids end with the ids of the window's left half alone, so the window
  begins at a token boundary of the left side, and likewise on the right;
* the first token of the window is the left side's token at that place, and its
  last token is the right side's.

Adjacent tokens of one correct encoding are compatible wherever they occur, so a
shared token on either side makes the spliced sequence the encoding of the whole.
A window that never agrees ends as the whole of both sides. Windows reach further
than any special token, so one that the cut goes through is seen whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import slices, text_rows

#: Code points of a leaf. Longer texts are encoded in halves.
LEAF_CHARS = 8192
#: Leaves of texts longer than this are spread over tasks.
SPREAD_CHARS = 32768
#: First reach of a window to either side of a cut; over the longest special token.
REACH = 32


def cuts(length: int, leaf: int) -> list[int]:
    """Where halving stops: leaf edges in ascending order, both ends included."""
    edges = [0, length]
    while max(b - a for a, b in zip(edges, edges[1:], strict=False)) > leaf:
        halves = [(a + b) // 2 for a, b in zip(edges, edges[1:], strict=False) if b - a > leaf]
        edges = sorted({*edges, *halves})
    return edges


def _whole(path: str, text: str) -> np.ndarray:
    return np.array(tokens.load(path).encode(text, add_special_tokens=False).ids, np.uint32)


def _after_space(text: str, at: int, low: int) -> int:
    """The nearest place at or before ``at`` that follows a space; ``at`` if none is near."""
    found = max(text.rfind(" ", low, at), text.rfind("\n", low, at))
    return found + 1 if found >= 0 else at


def join(path: str, text: str, low: int, cut: int, high: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of ``text[low:high]`` from the ids of its parts before and after ``cut``."""
    reach = REACH
    while True:
        a = cut - reach
        a = low if a <= low else _after_space(text, a, max(low, a - reach))
        b = cut + reach
        b = high if b >= high else b
        space = text.find(" ", b, min(high, b + reach)) if b < high else -1
        b = space if space >= 0 else b
        window = _whole(path, text[a:b])
        if a == low and b == high:
            return window
        head, tail = _whole(path, text[a:cut]), _whole(path, text[cut:b])
        keep, skip = len(left) - len(head), len(tail)
        fits_left = a == low or keep >= 0 and len(head) and len(window) and np.array_equal(left[keep:], head) and window[0] == head[0]
        fits_right = b == high or skip <= len(right) and len(tail) and len(window) and np.array_equal(right[:skip], tail) and window[-1] == tail[-1]
        if fits_left and fits_right:
            parts = ([] if a == low else [left[:keep]]) + [window] + ([] if b == high else [right[skip:]])
            return np.concatenate(parts)
        reach *= 2


def concatenate(path: str, text: str, edges: list[int], leaves: list[np.ndarray]) -> np.ndarray:
    """Join neighbours pairwise, level by level, until one sequence is left."""
    while len(leaves) > 1:
        joined, kept = [], [edges[0]]
        for k in range(0, len(leaves) - 1, 2):
            joined.append(join(path, text, edges[k], edges[k + 1], edges[k + 2], leaves[k], leaves[k + 1]))
            kept.append(edges[k + 2])
        if len(leaves) % 2:
            joined.append(leaves[-1])
            kept.append(edges[-1])
        edges, leaves = kept, joined
    return leaves[0]


def encode_texts(texts: list[str], path: str, leaf: int = LEAF_CHARS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and how many each has; all leaves are encoded together."""
    edges = [cuts(len(t), leaf) if len(t) > leaf else [0, len(t)] for t in texts]
    pieces = [t[a:b] for t, e in zip(texts, edges, strict=True) for a, b in zip(e, e[1:], strict=False)]
    ids, counts = tokens.encode(pa.array(pieces, pa.large_string()), path)
    if all(len(e) == 2 for e in edges):
        return ids, counts
    ends = np.cumsum(counts)
    out, k = [], 0
    for text, e in zip(texts, edges, strict=True):
        leaves = [ids[ends[j] - counts[j] : ends[j]] for j in range(k, k + len(e) - 1)]
        k += len(leaves)
        out.append(concatenate(path, text, e, leaves))
    return np.concatenate(out), np.array([len(o) for o in out], np.int64)


def _digests(path: str, ids: np.ndarray, counts: np.ndarray) -> tuple[list[str], list[str]]:
    numbers = [str(i) for i in range(tokens.load(path).get_vocab_size())]
    written = [hashlib.sha256(x).hexdigest() for x in tokens.joined(numbers, ids, counts)]
    return written, [hashlib.sha256(x).hexdigest() for x in tokens.decoded(path, ids, counts)]


def _rows(path: str, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray, digest: bool) -> pa.RecordBatch:
    if digest:
        a, b = _digests(path, ids, counts)
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    texts = [bytes(x).decode() for x in tokens.decoded(path, ids, counts)]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids.astype(np.int32))), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str, leaf: int = LEAF_CHARS, spread: int = SPREAD_CHARS, digest: bool = False) -> DataFrame:
    """Encode and decode every whole text.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per
    row: doc_id, n_tokens, and ids with decoded text, or with ``digest`` their
    SHA-256 (decimal ids with one space between; UTF-8). A null text is empty and
    has no ids; repeated rows are each returned; a null doc_id stays null.

    Texts over ``spread`` code points send their leaves to different tasks; a text
    is joined where its leaves meet, which encodes only the windows again.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string")
    rows = text_rows(docs).fillna("", "text")
    long = F.length("text") > spread

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=tokens.SLICE_BYTES):
                ids, counts = encode_texts(part.column("text").to_pylist(), path, leaf)
                yield _rows(path, part.column("doc_id"), ids, counts, digest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                key = hashlib.sha256(text.encode()).hexdigest()
                edges = cuts(len(text), leaf)
                n = len(edges) - 1
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array([doc_id] * n, pa.int64()), "key": [key] * n, "leaf": pa.array(edges[:-1], pa.int64()), "text": [text[a:b] for a, b in zip(edges, edges[1:], strict=False)]}
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=tokens.SLICE_BYTES):
                ids, counts = tokens.encode(part.column("text"), path)
                ends = np.cumsum(counts)
                packed = [ids[e - n : e].tobytes() for e, n in zip(ends, counts, strict=True)]
                yield part.append_column("ids", pa.array(packed, pa.binary()))

    def whole(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        places = group["leaf"].to_pylist()
        copies = places.count(0)  # equal rows have the same key
        texts = group["text"].to_pylist()[::copies]
        text = "".join(texts)
        found = [np.frombuffer(x, np.uint32) for x in group["ids"].to_pylist()[::copies]]
        ids = concatenate(path, text, [*places[::copies], len(text)], found)
        doc_ids = pa.array(group["doc_id"].to_pylist()[:copies], pa.int64())
        return pa.Table.from_batches([_rows(path, doc_ids, np.tile(ids, copies), np.full(copies, len(ids)), digest)])

    spread_rows = (
        rows.where(long)
        .mapInArrow(cut, "doc_id long, key string, leaf long, text string")
        .repartition("key", "leaf")
        .mapInArrow(leaves, "doc_id long, key string, leaf long, text string, ids binary")
        .groupBy("doc_id", "key")
        .applyInArrow(whole, schema)
    )
    return rows.where(~long).mapInArrow(direct, schema).unionByName(spread_rows)
