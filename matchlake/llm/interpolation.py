"""Language-model scores by deleted interpolation of bigrams, words and a uniform share.

p(w | h) = l2(b) c(h w) / c(h) + l1(b) c(w) / N + l0(b) / (V + 1), with a weight triple
for each bucket b of context frequencies (powers of two of c(h)). The weights come from
expectation-maximisation on deleted counts: each training token is predicted from the
counts of all others, so that words and pairs seen once stand for those never seen.

Counts are exact over all training texts. Blocks of texts send their distinct words and
pairs with local counts to shards of the hash space, shards add them up and answer, and
blocks look up their tokens in the answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import Words, mix, text_rows
from .toxicity import held_out

WORD, PAIR = 0, 1
END = np.uint64(0x51ED270B7A1F4C3D)
START = np.uint64(0xA3C59AC2F1B0D417)
#: Steps of a quarter of a power of two for the probabilities that learn the weights.
STEPS, NEVER = 4, 255
#: One training part in so many is left out; it is not learned from at all.
PARTS = 10
ROUNDS = 60


class Tokens:
    """Tokens of a block: the words of each text and its end, with what precedes each."""

    def __init__(self, batch: pa.RecordBatch):
        words = Words(batch.column("text"))
        n = batch.num_rows
        self.length = np.diff(words.rows) + 1
        self.row = np.repeat(np.arange(n), self.length)
        token = np.empty(len(words) + n, np.uint64)
        token[np.arange(len(words)) + words.row] = words.hashes()
        last = np.cumsum(self.length) - 1
        token[last] = END
        self.words, self.word_at = np.unique(token, return_inverse=True)
        self.opens = last - self.length + 1
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.opens] = START
        self.pairs, self.pair_at = np.unique(mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(token)), return_inverse=True)
        self.train = np.asarray(batch.column("train").to_numpy(zero_copy_only=False), bool)[self.row]

    def counts(self, folder: str, block: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(h w), c(h) and c(w) of each token; a text's start is as frequent as ends are."""
        word = blocks.read_answers(folder, block, WORD, np.uint32).astype(np.int64)
        pair = blocks.read_answers(folder, block, PAIR, np.uint32).astype(np.int64)
        if len(word) != len(self.words) or len(pair) != len(self.pairs):
            raise RuntimeError(f"the input changed while block {block} was scored")
        c_word = word[self.word_at]
        context = np.empty_like(c_word)
        context[1:] = c_word[:-1]
        context[self.opens] = word[np.searchsorted(self.words, END)]
        return pair[self.pair_at], context, c_word


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the power of two below their count."""
    out = np.zeros(len(context), np.int64)
    seen = context > 0
    out[seen] = np.frexp(context[seen].astype(float))[1]
    return out


def learn(cells: np.ndarray, times: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weight triples (pair, word, uniform) by bucket from a histogram of deleted probabilities."""
    b, pair, word = cells >> 16, (cells >> 8) & 255, cells & 255
    p = np.stack([np.where(pair == NEVER, 0, 2.0 ** (-pair / STEPS)), np.where(word == NEVER, 0, 2.0 ** (-word / STEPS)), np.full(len(cells), uniform)])
    weights = np.tile(np.array([0.4, 0.4, 0.2])[:, None], (1, 64))
    for _ in range(rounds):
        share = weights[:, b] * p
        share *= times / share.sum(axis=0)
        weights = np.stack([np.bincount(b, s, minlength=64) for s in share]) + np.array([[1e-3], [1e-3], [1e-3]])
        weights /= weights.sum(axis=0)
    seen = np.bincount(b, times, minlength=64) > 0
    for k in range(1, 64):  # contexts more frequent than any deleted one
        if not seen[k] and k > 1:
            weights[:, k] = weights[:, k - 1]
    weights[:, 0] = [0, *(weights[1:, 0] / weights[1:, 0].sum())]
    return weights


def score(docs: DataFrame, parts: int = PARTS) -> DataFrame:
    """Scores of every whole text.

    ``docs`` has doc_id and text; other columns are ignored. Learned from: rows whose
    crc32 of doc_id as text leaves a remainder modulo ``parts``; the others, and rows
    with a null doc_id, are held out. Returns one row per row: doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score (words alone with 0.1 added to every
    count), score (log10 probability by the model). A null or empty text is its end
    alone. With nothing to learn from all probabilities are uniform. An empty table
    gives no rows. One text larger than a block is a block of its own.
    """
    spark = docs.sparkSession
    plain = text_rows(docs)
    rows = blocks.with_split(blocks.from_files(plain)).withColumn("train", ~held_out(F.col("doc_id"), parts))
    size, shards = blocks.layout(blocks.text_bytes(plain))
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.blocks(batches, size):
            own = Tokens(batch)
            for kind, codes, at in ((WORD, own.words, own.word_at), (PAIR, own.pairs, own.pair_at)):
                local = np.bincount(at, own.train, minlength=len(codes)).astype(np.uint32)
                edges = np.searchsorted((codes >> shift).astype(np.int64), np.arange(shards + 1)).tolist()
                some = [s for s in range(shards) if edges[s] < edges[s + 1]]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [block] * len(some),
                        "kind": pa.array([kind] * len(some), pa.int32()),
                        "shard": pa.array(some, pa.int32()),
                        "codes": pa.array([blocks.squeeze_sorted(codes[edges[s] : edges[s + 1]]) for s in some], pa.binary()),
                        "local": pa.array([blocks.squeeze(local[edges[s] : edges[s + 1]]) for s in some], pa.binary()),
                    }
                )

    def answer(group: pa.Table) -> pa.Table:
        codes = [blocks.expand_sorted(x) for x in group["codes"].to_pylist()]
        local = np.concatenate([blocks.expand(x, np.uint32) for x in group["local"].to_pylist()])
        distinct, at = np.unique(np.concatenate(codes), return_inverse=True)
        total = np.bincount(at, local, minlength=len(distinct)).astype(np.uint32)
        ends = np.cumsum([len(c) for c in codes]).tolist()
        answers = [blocks.squeeze(total[at[e - len(c) : e]]) for c, e in zip(codes, ends, strict=True)]
        words = group["kind"][0].as_py() == WORD
        first = [1] + [0] * (len(codes) - 1)  # a shard's sums, once
        return pa.table(
            {
                "block": group["block"],
                "kind": group["kind"],
                "shard": group["shard"],
                "payload": pa.array(answers, pa.binary()),
                "tokens": pa.array([f * words * int(total.sum(dtype=np.int64)) for f in first], pa.int64()),
                "distinct": pa.array([f * words * int(np.count_nonzero(total)) for f in first], pa.int64()),
            }
        )

    asked = rows.mapInArrow(ask, "block string, kind int, shard int, codes binary, local binary")
    answers = asked.groupBy("kind", "shard").applyInArrow(answer, "block string, kind int, shard int, payload binary, tokens long, distinct long")
    folder = blocks.write_answers(answers)
    if plain.isEmpty():
        sums = None
    else:
        sums = spark.read.parquet(folder).agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    n, v = (int(sums["n"] or 0), int(sums["v"] or 0)) if sums else (0, 0)

    def deleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.blocks(batches, size):
            own = Tokens(batch)
            pair, context, word = (c[own.train] - 1 for c in own.counts(folder, block))
            p2 = np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0)
            p1 = word / max(1, n - 1)
            cell = bucket(context) << 16
            for p, up in ((p2, 8), (p1, 0)):
                step = np.full(len(p), NEVER)
                step[p > 0] = np.minimum(NEVER - 1, np.rint(-np.log2(p[p > 0]) * STEPS)).astype(np.int64)
                cell = cell | step << up
            cells, times = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(times.astype(np.int64))], ["cell", "times"])

    # At most 64 buckets times 256 times 256 steps, however long the texts are.
    histogram = rows.mapInArrow(deleted, "cell long, times long").groupBy("cell").agg(F.sum("times").alias("times")).collect()
    cells = np.array([r["cell"] for r in histogram], np.int64)
    weights = learn(cells, np.array([r["times"] for r in histogram], float), 1 / (v + 1))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in blocks.blocks(batches, size):
            own = Tokens(batch)
            pair, context, word = own.counts(folder, block)
            l2, l1, l0 = weights[:, bucket(context)]
            p = l2 * np.divide(pair, context, out=np.zeros(len(pair)), where=context > 0) + l1 * word / max(1, n) + l0 / (v + 1)
            base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))

            def per_row(x: np.ndarray) -> pa.Array:
                return pa.array(np.bincount(own.row, x, minlength=batch.num_rows))

            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(~np.asarray(batch.column("train").to_numpy(zero_copy_only=False), bool)),
                    pa.array(own.length.astype(np.int64)),
                    pa.array(np.bincount(own.row, word > 0, minlength=batch.num_rows).astype(np.int64)),
                    pa.array(np.full(batch.num_rows, n, np.int64)),
                    per_row(base),
                    per_row(np.log10(p)),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
