"""Quality from the perplexity of a modified Kneser-Ney model of trusted text.

Symbols are bytes, five at most in an n-gram, so case, marks and word shapes count and
the alphabet is bounded. Shards are keyed by the third and fourth byte of an n-gram:
every level of its back-off from five bytes to three, with contexts and continuation
counts, lies in its shard. Pairs and single bytes are a table of 256 x 256 at most and
go along with the code. Blocks of texts ask shards for the log probabilities of their
distinct n-grams.

A text is kept if its perplexity is at most a quantile of that of held-out trusted texts
of its language. Short texts say little, so every text counts as some bytes longer, at
its language's median perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import buffers, mix, slices, small, text_rows, written
from .toxicity import held_out

ORDER = 5
OPEN, CLOSE = 2, 3
#: The limit is this quantile of a language's held-out trusted texts.
HIGH = 0.995
#: Bytes of median text that every text is taken to have besides its own.
PRIOR_BYTES = 40


def codes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every byte and of the end of each text, and the number per row."""
    data, bounds = buffers(texts)
    n = len(bounds) - 1
    pad = ORDER - 1
    length = np.diff(bounds) + 1
    start = bounds[:-1] + np.arange(n) * (pad + 1)
    inside = np.ones(len(data) + n * (pad + 1), bool)  # all but what opens a text
    for k in range(pad):
        inside[start + k] = False
    flat = np.full(len(inside), OPEN, np.uint8)
    inside[start + pad + length - 1] = False
    flat[inside] = data
    inside[start + pad + length - 1] = True
    flat[start + pad + length - 1] = CLOSE
    codes = np.zeros(max(0, len(flat) - pad), np.uint64)
    for k in range(ORDER):
        codes <<= np.uint64(8)
        codes |= flat[k : k + len(codes)]
    return codes[inside[pad:]], length


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(codes >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def by_shard(codes: np.ndarray, shards: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order by shard and code, and (shard, begin, end) of each shard that occurs."""
    shard = shard_of(codes, shards)
    order = np.lexsort((codes, shard))
    edges = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
    return order, [(s, edges[s], edges[s + 1]) for s in range(shards) if edges[s] < edges[s + 1]]


def levels(codes: np.ndarray, counts: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, n-grams, counts) for five bytes, then continuation counts for four and three."""
    out = [(ORDER, codes, counts)]
    for k in (4, 3):
        codes, counts = np.unique(codes & np.uint64((1 << 8 * k) - 1), return_counts=True)
        out.append((k, codes, counts))
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = np.maximum(n, 1e-9)
    y = n1 / (n1 + 2 * n2)
    return np.array([0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.95, 1.9, 2.8])])


def pair_table(pairs: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """p(b | a) for bytes from continuation counts of pairs, interpolated down to uniform."""
    table = np.zeros((256, 256))
    table[pairs >> 8, pairs & 255] = amounts

    def smooth(a: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = discounts(np.array([np.count_nonzero(a == k) for k in (1, 2, 3, 4)], float))[np.minimum(a, 3).astype(int)]
        total = a.sum(axis=-1, keepdims=True)
        return np.where(total > 0, (np.maximum(a - d, 0) + d.sum(axis=-1, keepdims=True) * lower) / np.maximum(total, 1), lower)

    single = smooth(np.count_nonzero(table, axis=0).astype(float), np.full(256, 1 / 256))
    return smooth(table, single[None, :])


def log_probabilities(codes: np.ndarray, counts: np.ndarray, asked: np.ndarray, cuts: dict[int, np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Natural logarithms of p(last byte | four before) for n-grams of one shard."""
    p = pairs[(asked >> np.uint64(8) & np.uint64(255)).astype(int), (asked & np.uint64(255)).astype(int)]
    for k, grams, amount in reversed(levels(codes, counts)):
        if not len(grams):
            continue
        cut = cuts[k][np.minimum(amount, 3)]
        context, first = np.unique(grams >> np.uint64(8), return_index=True)
        total, freed = np.add.reduceat(amount, first), np.add.reduceat(cut, first)
        own = asked & np.uint64((1 << 8 * k) - 1)
        c = np.minimum(np.searchsorted(context, own >> np.uint64(8)), len(context) - 1)
        g = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        share = np.where(grams[g] == own, np.maximum(amount[g] - cut[g], 0), 0)
        p = np.where(context[c] == own >> np.uint64(8), (share + freed[c] * p) / total[c], p)
    return np.log(p)


def _count_of_counts(amount: np.ndarray) -> list[int]:
    return [int(np.count_nonzero(amount == k)) for k in (1, 2, 3, 4)]


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Perplexity per byte of every whole text of ``docs`` (all its columns but text are
    passed on) by a model of the texts in ``trusted``. A null text is empty: its end alone."""
    rows = blocks.with_split(blocks.from_files(docs))
    size, shards = blocks.layout(blocks.text_bytes(docs))
    kept = [f for f in docs.schema.fields if f.name != "text"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=blocks.BLOCK_BYTES):
                codes, counts = np.unique(codes_of(part.column("text"))[0], return_counts=True)
                order, found = by_shard(codes, shards)
                codes, counts = codes[order], counts[order]
                yield pa.RecordBatch.from_pydict(
                    {"shard": pa.array([s for s, _, _ in found], pa.int32()), "codes": pa.array([blocks.squeeze_sorted(codes[a:b]) for _, a, b in found], pa.binary()), "counts": pa.array([blocks.squeeze(counts[a:b]) for _, a, b in found], pa.binary())}
                )

    def added(group: pa.Table) -> pa.Table:
        codes = np.concatenate([blocks.expand_sorted(x) for x in group["codes"].to_pylist()])
        counts = np.concatenate([blocks.expand(x, np.int64) for x in group["counts"].to_pylist()])
        codes, at = np.unique(codes, return_inverse=True)
        counts = np.bincount(at, counts).astype(np.int64)
        found = levels(codes, counts)
        pairs, amounts = np.unique(found[-1][1] & np.uint64(0xFFFF), return_counts=True)
        return pa.table(
            {
                "shard": group["shard"][:1],
                "codes": pa.array([blocks.squeeze_sorted(codes)], pa.binary()),
                "counts": pa.array([blocks.squeeze(counts)], pa.binary()),
                "few": pa.array([[x for _, _, amount in found for x in _count_of_counts(amount)]], pa.list_(pa.int64())),
                "pairs": pa.array([pairs.astype(np.int64)], pa.list_(pa.int64())),
                "amounts": pa.array([amounts.astype(np.int64)], pa.list_(pa.int64())),
            }
        )

    counted = trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "shard int, codes binary, counts binary")
    model = written(counted.groupBy("shard").applyInArrow(added, "shard int, codes binary, counts binary, few array<long>, pairs array<long>, amounts array<long>"), "ngrams")
    few = model.select(*(F.sum(F.col("few")[k]).alias(f"n{k}") for k in range(12))).first()
    few = np.array([x or 0 for x in few], float).reshape(3, 4)
    cuts = {k: discounts(few[j]) for j, k in enumerate((5, 4, 3))}
    # Pairs of bytes: 65,536 rows at most.
    summed = model.select(F.explode(F.arrays_zip("pairs", "amounts")).alias("x")).groupBy("x.pairs").agg(F.sum("x.amounts").alias("n")).collect()
    pairs = pair_table(np.array([r[0] for r in summed], np.int64), np.array([r[1] for r in summed], float))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.blocks(batches, size):
            codes = np.unique(codes_of(batch.column("text"))[0])
            order, found = by_shard(codes, shards)
            codes = codes[order]
            yield pa.RecordBatch.from_pydict({"block": [block] * len(found), "shard": pa.array([s for s, _, _ in found], pa.int32()), "codes": pa.array([blocks.squeeze_sorted(codes[a:b]) for _, a, b in found], pa.binary())})

    def answer(known: pa.Table, group: pa.Table) -> pa.Table:
        codes = blocks.expand_sorted(known["codes"][0].as_py()) if known.num_rows else np.zeros(0, np.uint64)
        counts = blocks.expand(known["counts"][0].as_py(), np.int64) if known.num_rows else np.zeros(0, np.int64)
        out = [blocks.squeeze(log_probabilities(codes, counts, blocks.expand_sorted(x), cuts, pairs).astype(np.float32)) for x in group["codes"].to_pylist()]
        return pa.table({"block": group["block"], "kind": pa.array([0] * len(out), pa.int32()), "shard": group["shard"], "payload": pa.array(out, pa.binary())})

    asked = rows.mapInArrow(ask, "block string, shard int, codes binary")
    answers = model.select("shard", "codes", "counts").groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(answer, "block string, kind int, shard int, payload binary")
    folder = blocks.write_answers(answers)
    names = [f.name for f in kept]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.blocks(batches, size):
            codes, length = codes_of(batch.column("text"))
            codes, at = np.unique(codes, return_inverse=True)
            order, _ = by_shard(codes, shards)
            found = blocks.read_answers(folder, block, 0, np.float32)
            if len(found) != len(codes):
                raise RuntimeError(f"the input changed while block {block} was scored")
            value = np.empty(len(codes))
            value[order] = found
            total = np.add.reduceat(value[at], np.cumsum(length) - length)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(length.astype(np.int64)), pa.array(np.exp(-total / length))], [*names, "n_symbols", "perplexity"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.select(*names, "text", "split").mapInArrow(scored, f"{schema}, n_symbols long, perplexity double")


def row_key():
    """Tells rows apart that share a doc_id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def classify(docs: DataFrame, labels: DataFrame, high: float = HIGH, prior_bytes: int = PRIOR_BYTES) -> DataFrame:
    """doc_id, row_key, lang, perplexity, adjusted (with the prior bytes), threshold and kept
    for every row; row_key is ``row_key()`` of doc_id and text.

    ``docs`` has doc_id, text and lang; ``labels`` doc_id and quality, whose rows with
    quality 1 are trusted. Of these, the ids whose crc32 leaves no remainder modulo 5 set
    the limits and the others train the model. A language without held-out trusted texts,
    or null, takes the limit of all languages; without any trusted text everything is
    kept. Repeated rows are each returned, a null doc_id is never trusted.
    """
    plain = text_rows(docs, "lang")
    plain = blocks.from_files(plain).withColumn("row_key", row_key())
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = small(written(good, "trusted"), 24)
    trusted = plain.join(good, "doc_id").where(~held_out(F.col("doc_id"))).select("text")
    found = written(perplexities(plain, trusted), "perplexities")

    def with_quantile(rows: DataFrame, value: str, q: float, name: str) -> DataFrame:
        """Adds a quantile over the held-out trusted rows of a language; one row per language and one for all."""
        audit = rows.join(good.where(held_out(F.col("doc_id"))), "doc_id")
        own = audit.groupBy("lang").agg(F.percentile_approx(value, q, 100_000).alias(name))
        overall = audit.agg(F.percentile_approx(value, q, 100_000)).first()[0]
        rest = F.lit(float("inf") if overall is None else float(overall))
        return rows.join(small(own, 64), "lang", "left").withColumn(name, F.coalesce(name, rest))

    middle = with_quantile(found, "perplexity", 0.5, "median")
    bits = F.col("n_symbols") * F.log("perplexity") + F.when(F.col("median") < float("inf"), prior_bytes * F.log("median")).otherwise(0)
    adjusted = middle.withColumn("adjusted", F.exp(bits / (F.col("n_symbols") + prior_bytes)))
    out = with_quantile(adjusted, "adjusted", high, "threshold")
    return out.select("doc_id", "row_key", "lang", "perplexity", "adjusted", "threshold", (F.col("adjusted") <= F.col("threshold")).alias("kept"))
