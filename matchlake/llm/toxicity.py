"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings of a few bytes, so that inflected forms meet. All
terms of the examples are indexed. Those that tell the labels apart (a minimum of
examples, a chi-square and a log odds ratio over their limits) weigh their full idf,
the others a tenth of it; so a copy of an example is its neighbour at 1, whatever its
words. Every text is searched, whole.

The inverted index has posting lists for the rarer terms, and for the common ones,
whose lists would be long, rows of examples with the largest weight of each block of
examples. A search adds up the lists, bounds what the common terms can still add to
each block, opens runs of blocks from the highest bound on and leaves those closed in
which no block can reach the k-th best. Open blocks are judged in single precision, and
all examples that its error leaves a chance are compared again in double precision.

Examples are a bounded sample of labelled rows; every text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, release, slices, span_hashes, text_rows, written

#: Most labelled rows that the examples are fitted on (by hash of doc_id).
EXAMPLES = 10_000
#: Share of its idf that a term weighs which does not tell the labels apart.
ORDINARY = 0.1
#: Terms in more than one of so many examples are common.
COMMON = 8
LEAST_EXAMPLES, LEAST_CHI2, LEAST_LOG_ODDS = 3, 15.0, 1.5
#: Shares of a row's words at which a repeated term is a further term.
SHARES = (0.004, 0.008, 0.016)
#: Bytes of a word's beginning that are terms too, for words longer than that.
BEGINNINGS = (4, 5)
NEIGHBOURS = 15
BLOCK = 16
#: Bytes of text whose terms are counted together; a term takes some 150 bytes meanwhile.
COUNTED_BYTES = 1 << 19
#: Texts that are searched together, blocks that are opened together, and examples that are compared again together.
TOGETHER, OPENED, AGAIN = 128, 64, 2048
#: Longer posting lists are joined as they lie; of shorter ones the places are gathered.
GATHERED = 192
#: Votes of the base rate against those of the neighbours, and the distance of an equal.
PRIOR_VOTES, LEAST_DISTANCE = 0.5, 0.1

#: Terms end at all ASCII characters but letters and digits.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def by_row(codes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The order by row and code; places of the same row and code are in any order."""
    order = np.argsort(codes)
    rows = row[order]
    # Few rows are sorted by counting.
    return order[np.argsort(rows.astype(np.uint16) if rows.max(initial=0) < 1 << 16 else rows, kind="stable")]


def row_terms(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of each row: hash, row, times, and the byte range of one occurrence.

    A term that a row repeats is a further term for each share of the row's words it
    reaches, so that cosines, which know no length, can tell a habit from a chance.
    """
    found = [(words.hashes(), words.row, words.start, words.end)]
    length = words.end - words.start
    for n in BEGINNINGS:
        some = np.flatnonzero(length > n)
        a = words.start[some]
        found.append((span_hashes(words.data, a, a + n, seed=n), words.row[some], a, a + n))
    code, row, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = by_row(code, row)
    code, row = code[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])])) if len(code) else np.zeros(0, np.int64)
    times = np.diff(np.append(new, len(code)))
    code, row, start, end = code[new], row[new], start[order][new], end[order][new]
    share = times / np.maximum(1, np.diff(words.rows))[row]
    out = [(code, row, times, start, end)]
    for level, least in enumerate(SHARES, 1):
        some = np.flatnonzero((times > 1) & (share >= least))
        out.append((mix(code[some] + np.uint64(level)), row[some], np.ones(len(some), np.int64), start[some], end[some]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gathered(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of runs, one run after the other."""
    at = np.repeat(start - np.cumsum(length) + length, length)
    at += np.arange(len(at))
    return at


@dataclass
class Model:
    """Everything a search needs; its size is bounded by the terms of the examples."""

    terms: np.ndarray  # sorted hashes
    weight: np.ndarray  # idf, or its share
    example_ids: np.ndarray
    labels: np.ndarray
    norm: np.ndarray  # lengths of the examples' vectors
    first: np.ndarray  # where a term's postings begin; common terms have none
    example: np.ndarray  # of each posting
    first_often: np.ndarray  # the same of the postings whose example repeats the term
    often: np.ndarray
    more: np.ndarray  # and how far their levels are over 1
    levels: np.ndarray  # 1 + log of the times a term occurs, 0 first
    common: np.ndarray  # a term's column among the common ones, or -1
    dense: np.ndarray  # places in ``levels``: examples x common terms
    most: np.ndarray  # largest share of a vector: common terms x blocks of examples
    base_rate: float
    knots: tuple[np.ndarray, np.ndarray] | None = None  # raw vote to calibrated score

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, leave: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (ties by place) and their cosines, exactly."""
        return self.searches([(terms, weights)], k, [leave])[0]

    def searches(self, queries: list[tuple], k: int = NEIGHBOURS, leave: list[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """A search for each of the queries (terms, weights); a block is opened for many at once."""
        out = []
        for a in range(0, len(queries), TOGETHER):
            out += self._searches(queries[a : a + TOGETHER], k, leave[a : a + TOGETHER] if leave else None)
        return out

    @cached_property
    def shares(self) -> np.ndarray:
        """What the common terms are of each example's vector, in single precision; whole blocks."""
        out = np.zeros((self.most.shape[1] * BLOCK, self.dense.shape[1]), np.float32)
        for a in range(0, len(self.dense), AGAIN):
            out[a : a + AGAIN][: len(self.dense) - a] = self.levels[self.dense[a : a + AGAIN]] / self.norm[a : a + AGAIN, None]
        return out

    def _postings(self, terms: np.ndarray, value: np.ndarray) -> np.ndarray:
        """What rare terms of these values add up to with each example, before its norm."""
        start, length = self.first[terms], self.first[terms + 1] - self.first[terms]
        long = length > GATHERED
        order = np.argsort(long, kind="stable")
        start, length, long = start[order], length[order], int(long.sum())
        short = len(terms) - long
        at = np.empty(length.sum(), np.int64)
        lists = [self.example[a : a + n] for a, n in zip(start[short:].tolist(), length[short:].tolist(), strict=True)]
        np.concatenate([self.example.take(gathered(start[:short], length[:short])), *lists], out=at)
        found = np.bincount(at, np.repeat(value[order], length), minlength=len(self.labels))
        start, length = self.first_often[terms], self.first_often[terms + 1] - self.first_often[terms]
        at = gathered(start, length)
        more = self.more.take(at, mode="clip")
        more *= np.repeat(value, length)
        found += np.bincount(self.often.take(at, mode="clip"), more, minlength=len(self.labels))
        return found

    def _searches(self, queries: list[tuple], k: int, leave: list[int | None] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        count, blocks = len(self.labels), self.most.shape[1]
        partial = np.empty((len(queries), blocks * BLOCK))
        partial[:, count:] = -np.inf
        of_common = np.zeros((len(queries), len(self.most)))
        for i, (terms, weights, *_) in enumerate(queries):
            value, column = weights * self.weight[terms], self.common[terms]
            rare = column < 0
            of_common[i, column[~rare]] = value[~rare]
            partial[i, :count] = self._postings(terms[rare], value[rare]) / self.norm if rare.any() else 0.0
            if leave and leave[i] is not None:
                partial[i, leave[i]] = -np.inf
        bounds = of_common @ self.most + partial.reshape(len(queries), blocks, BLOCK).max(axis=2)
        # Sums of n products that are not negative, in single precision, are off by this share at most.
        error = (len(self.most) + 16) * 2.0**-23
        single, near = of_common.astype(np.float32), np.full(partial.shape, -np.inf, np.float32)
        tops = np.full(bounds.shape, -np.inf, np.float32)
        least = np.full(len(queries), 1e-12)
        runs = [slice(a, min(blocks, a + OPENED)) for a in range(0, blocks, OPENED)]
        for run in sorted(runs, key=lambda x: -bounds[:, x].max()):
            who = np.flatnonzero(bounds[:, run].max(axis=1) >= least)
            if not len(who):
                continue
            span = slice(run.start * BLOCK, run.stop * BLOCK)
            found = single[who] @ self.shares[span].T
            found += partial[who, span]
            near[who, span] = found
            tops[who, run] = found.reshape(len(who), -1, BLOCK).max(axis=2)
            if blocks >= k:  # the k largest of different blocks are k examples
                reached = np.partition(tops, blocks - k, axis=1)[:, blocks - k].astype(float)
                least = np.maximum(np.where(reached > 0, reached * (1 - error), 0) - 3e-12, 1e-12)
        chosen = near >= (least * (1 - 2 * error) - 1e-13)[:, None]
        places = np.flatnonzero(chosen.any(axis=0))
        score = np.full((len(queries), len(places)), -np.inf)
        for a in range(0, len(places), AGAIN):
            some = places[a : a + AGAIN]
            score[:, a : a + AGAIN] = np.where(chosen[:, some], partial[:, some] + of_common @ self.levels[self.dense[some]].T / self.norm[some], -np.inf)
        out = []
        for row in score:
            at = np.flatnonzero(row > 1e-12)
            cosine = np.round(row[at], 12)
            order = np.lexsort((at, -cosine))[:k]
            out.append((places[at[order]], np.minimum(cosine[order], 1.0)))
        return out

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Share of label 1 among neighbours, each weighing by its distance, and the base rate."""
        weight = LEAST_DISTANCE / (LEAST_DISTANCE + 1 - cosine)
        return float((weight @ self.labels[at] + PRIOR_VOTES * self.base_rate) / (weight.sum() + PRIOR_VOTES))

    def calibrated(self, raw: float) -> float:
        return float(np.interp(raw, *self.knots)) if self.knots else raw

    def vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        """Known terms of each row, its unit vector of them, and the spelling of the heaviest."""
        rows = pa.RecordBatch.from_arrays([texts], ["text"])
        return [v for part in slices(rows, limit=COUNTED_BYTES) for v in self._vectors(part.column("text"))]

    def _vectors(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, list[str]]]:
        words = Words(texts, PARTS)
        codes, row, times, start, end = row_terms(words)
        place = np.searchsorted(self.terms, codes)
        place[place == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[place] == codes) if len(self.terms) else np.zeros(0, np.int64)
        known = known[by_row(place[known], row[known])]
        rows, terms, level = row[known], place[known], 1 + np.log(times[known])
        edges = np.searchsorted(rows, np.arange(len(texts) + 1))
        out = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            t = terms[a:b]
            full = level[a:b] * self.weight[t]
            length = np.sqrt(full @ full)
            heavy = known[a:b][np.argsort(-full, kind="stable")[:5]]
            named = [words.data[start[j] : end[j]].tobytes().decode("utf-8", "replace") for j in heavy.tolist()]
            out.append((t, full / length if b > a else full, named))
        return out

    def near(self, queries: list[tuple]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Score, nearest examples and their cosines of each; the base rate's vote without any term."""
        known = [v for v in queries if len(v[0])]
        found = iter(self.searches(known))
        out = []
        for terms, *_ in queries:
            if not len(terms):
                out.append((min(self.calibrated(self.base_rate), self.base_rate), np.zeros(0, np.int64), np.zeros(0)))
                continue
            at, cosine = next(found)
            out.append((min(1.0, max(0.0, self.calibrated(self.vote(at, cosine)))), at, cosine))
        return out

    def scores(self, texts: pa.Array) -> list[float]:
        return [value for value, _, _ in self.near(self.vectors(texts))]


def isotonic(raw: np.ndarray, labels: np.ndarray, weight_of_base: float, base: float) -> tuple[np.ndarray, np.ndarray]:
    """Knots of a non-decreasing fit by pooling adjacent violators; each pool shrinks to the base rate."""
    values, place = np.unique(raw, return_inverse=True)
    ones, n = np.bincount(place, labels), np.bincount(place).astype(float)
    pools: list[list[float]] = []
    for v, one, count in zip(values, ones, n, strict=True):
        pools.append([v, v, one, count])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, high, one2, count2 = pools.pop()
            pools[-1][1], pools[-1][2], pools[-1][3] = high, pools[-1][2] + one2, pools[-1][3] + count2
    x, y = [], []
    for low, high, one, count in pools:
        fit = (one + weight_of_base * base) / (count + weight_of_base)
        x += [low, high] if high > low else [low]
        y += [fit, fit] if high > low else [fit]
    # A small share of the raw vote keeps scores of one pool in the order of their votes.
    x, y = np.array(x), np.maximum.accumulate(np.array(y))
    return x, 0.98 * y + 0.02 * x


def index(ids: np.ndarray, toxic: np.ndarray, first: np.ndarray, codes: np.ndarray, times: np.ndarray) -> Model:
    """A model, not calibrated yet, of examples whose terms lie from ``first`` on in ``codes`` and ``times``."""
    count = len(ids)
    pos, neg = int(toxic.sum()), int(count - toxic.sum())
    owner = np.repeat(np.arange(count, dtype=np.uint32), np.diff(first))
    order = np.argsort(codes, kind="stable")
    codes, owner, times = codes[order], owner[order], times[order]
    del order
    edge = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    terms, first = codes[edge], np.append(edge, len(codes))
    df = np.diff(first).astype(float)
    a = np.add.reduceat(toxic[owner].view(np.uint8), edge, dtype=np.int64).astype(float) if len(edge) else np.zeros(0)
    b, c, d = df - a, pos - a, neg - df + a
    chi2 = (a * d - b * c) ** 2 * (pos + neg) / np.maximum(df * (c + d) * max(pos, 1) * max(neg, 1), 1e-9)
    odds = np.abs(np.log((a + 0.5) / (c + 0.5) / ((b + 0.5) / (d + 0.5))))
    telling = (df >= LEAST_EXAMPLES) & (chi2 >= LEAST_CHI2) & (odds >= LEAST_LOG_ODDS)
    weight = np.log((count + 1) / (df + 0.5)) * np.where(telling, 1.0, ORDINARY)
    distinct = np.flatnonzero(np.bincount(times))
    levels = np.concatenate([[0.0], 1 + np.log(distinct)])
    level = np.searchsorted(distinct, times).astype(np.min_scalar_type(len(distinct) + 1)) + 1
    term = np.repeat(np.arange(len(terms), dtype=np.int32), np.diff(first))
    norm = np.zeros(count)
    for k in range(0, len(owner), 1 << 20):
        some = slice(k, k + (1 << 20))
        norm += np.bincount(owner[some], (levels[level[some]] * weight[term[some]]) ** 2, minlength=count)
    norm = np.sqrt(norm)
    # Examples of like length side by side: their blocks have tight bounds.
    by_norm = np.lexsort((ids, norm))
    place = np.empty(count, np.min_scalar_type(max(count, 1)))
    place[by_norm] = np.arange(count)
    owner, norm = place[owner], np.maximum(norm[by_norm], 1e-300)
    many = df * COMMON > count
    common = np.where(many, np.cumsum(many) - 1, -1)
    of_many = many[term]
    dense = np.zeros((count, int(many.sum())), level.dtype)
    dense[owner[of_many], common[term[of_many]]] = level[of_many]
    blocks = -(-count // BLOCK)
    most = np.zeros((dense.shape[1], blocks))
    for k in range(blocks):
        some = slice(k * BLOCK, min(count, (k + 1) * BLOCK))
        most[:, k] = (levels[dense[some]] / norm[some, None]).max(axis=0)
    first = np.concatenate([[0], np.cumsum(np.where(many, 0, np.diff(first)))])
    owner, level, term = owner[~of_many], level[~of_many], term[~of_many]
    often = levels[level] > 1
    first_often = np.concatenate([[0], np.cumsum(np.bincount(term[often], minlength=len(terms)))])
    return Model(
        terms, weight, ids[by_norm], toxic[by_norm].astype(float), norm, first, owner, first_often, owner[often], levels[level[often]] - 1, levels, common, dense, most * (1 + 1e-12), (pos + 1) / (pos + neg + 2)
    )


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """A model from labelled rows (doc_id, toxic) and their texts.

    Rows without doc_id or label and labelled ids without a text are left out; of
    several labels for one id the larger counts, of several texts the smallest.
    """
    spark = docs.sparkSession
    asked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = asked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    texts = text_rows(docs).join(F.broadcast(chosen), "doc_id")
    sample = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "examples")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=COUNTED_BYTES):
                codes, row, times, _, _ = row_terms(Words(part.column("text"), PARTS))
                order = by_row(codes, row)
                codes, times = codes[order], times[order].astype(np.int32)
                edges = np.searchsorted(row[order], np.arange(part.num_rows + 1)).tolist()
                held = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (codes, times)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), *(pa.array(x, pa.binary()) for x in held)], ["doc_id", "toxic", "codes", "times"])

    # At most ``examples`` rows: 12 bytes for each distinct term of an example.
    found = sample.mapInArrow(counted, "doc_id long, toxic int, codes binary, times binary").toArrow()
    ids, toxic = found["doc_id"].to_numpy().astype(np.int64), found["toxic"].to_numpy() == 1
    codes, times = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_py(), t) for x in found[c])]) for c, t in (("codes", np.uint64), ("times", np.int32)))
    first = np.concatenate([[0], np.cumsum([len(x.as_py()) // 8 for x in found["codes"]])]).astype(np.int64)
    del found
    model = index(ids, toxic, first, codes, times)
    del codes, times
    release()
    # Calibration: each example is voted on by the others.
    sent = spark.sparkContext.broadcast(model)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        by_id = np.argsort(own.example_ids)
        for batch in batches:
            for part in slices(batch):
                queries = own.vectors(part.column("text"))
                some = [j for j, v in enumerate(queries) if len(v[0])]
                places = by_id[np.searchsorted(own.example_ids, part.column("doc_id").to_numpy(), sorter=by_id)][some]
                raws = [own.vote(*v) for v in own.searches([queries[j] for j in some], leave=places.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(raws, pa.float64())], ["id", "raw"])

    votes = sample.mapInArrow(alone, "id long, raw double").collect()  # at most ``examples`` rows
    if votes:
        place, raw = np.array([v["id"] for v in votes]), np.array([v["raw"] for v in votes])
        model.knots = isotonic(raw, model.labels[place], 1.0, model.base_rate)
    sent.unpersist()
    return model


def scorer(model: Model, spark: SparkSession):
    """A column function from texts to scores: the search and vote of ``score`` without its evidence."""
    sent = spark.sparkContext.broadcast(model)  # bounded, see Model

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = []
        for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])):
            out += sent.value.scores(part.column("text"))
        return pd.Series(out, dtype="float64")

    return scored


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of every whole text: doc_id, score, predicted, and as evidence the heaviest
    matched terms and the nearest examples with cosine and label.

    A text without any term of the examples, a null or an empty one gets the vote of the
    base rate. Repeated rows are each returned, null doc ids stay null. No shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see Model
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for part in slices(batch):
                scores, near, matched = [], [], []
                queries = own.vectors(part.column("text"))
                for (_, _, named), (value, at, cosine) in zip(queries, own.near(queries), strict=True):
                    scores.append(value)
                    near.append([{"doc_id": int(own.example_ids[k]), "cosine": float(x), "label": int(own.labels[k])} for k, x in zip(at[:5], cosine[:5], strict=True)])
                    matched.append(named)
                value = np.array(scores)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array(matched, pa.list_(pa.string())), pa.array(near, evidence)], ["doc_id", "score", "predicted", "terms", "nearest"]
                )

    rows = text_rows(docs)
    return rows.mapInArrow(scored, "doc_id long, score double, predicted int, terms array<string>, nearest array<struct<doc_id: long, cosine: double, label: int>>")


def held_out(doc_id, parts: int = 5):
    """Whether crc32 of the doc_id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == 0, F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all of ``docs``.

    Returns doc_id, held_out, score, predicted, terms, nearest.
    """
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))), examples)
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "terms", "nearest")
