"""Vector codes against rounds of plain loops."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchlake.llm import codes, queries

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) of each kept row, and the digest."""
    kept = [(i, [math.floor(4096 * x) for x in v], g) for i, v, g in rows if v and all(x is not None and math.isfinite(x) and abs(x) < 16384 for x in v)]
    if not kept:
        return [], None
    size = min(n for n, c in Counter(len(v) for _, v, _ in kept).items() if c == max(Counter(len(v) for _, v, _ in kept).values()))
    width = -(-size // parts)
    kept = [(i, [tuple((v + [0] * width * parts)[p * width : (p + 1) * width]) for p in range(parts)], v, g) for i, v, g in kept if len(v) == size]
    first = sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2]))[:entries]
    books = [[k[1][p] for k in first] for p in range(parts)]

    def nearest(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, cut, _, _ in kept:
            for p in range(parts):
                groups[p, nearest(cut[p], p)[1]].append(cut[p])
        for (p, e), members in groups.items():
            books[p][e] = tuple(sum(c) // len(members) for c in zip(*members, strict=True))
    found = [(i, [nearest(cut[p], p) for p in range(parts)], g) for i, cut, _, g in kept]
    totals = defaultdict(int)
    for _, near, g in found:
        totals[g] += sum(d for d, _ in near)
    digest = hashlib.sha256(",".join(str(x) for p in range(parts) for c in books[p] for x in c).encode()).hexdigest()
    return [(i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), totals[g]) for i, near, g in found], digest


def same(df, rows, **how):
    want, digest = brute(rows, **how)
    found = codes.encode(df, **how).collect()
    order = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in found], key=order) == sorted(want, key=order)
    assert {r.codebooks_sha256 for r in found} <= {digest}


@pytest.mark.parametrize("width", [1, 3, 10_000])
def test_trie_finds_the_nearest(width):
    rng = np.random.default_rng(width)
    for levels, n in [(2, 200), (50, 300), (1, 5), (3, 1)]:
        given = rng.integers(-levels, levels + 1, (n, 4)).astype(np.int32)
        entries = rng.integers(-levels, levels + 1, (7, 4))
        parts, counts, leaf = codes.Trie.of(given)
        assert (parts[leaf] == given).all() and counts.sum() == n and [tuple(p) for p in parts.tolist()] == sorted({tuple(g) for g in given.tolist()})
        index, distance = codes.Trie(parts).nearest(entries, width)
        want = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_rows(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.standard_normal((60, 16)), 1).astype(np.float32)
    rows = [(k, v.tolist(), k % 3 if k % 5 else None) for k, v in enumerate(values)]
    rows += [(200, rows[0][1], 1)] * 40 + [(3, rows[7][1], 9), (3, rows[3][1], 9), (None, rows[5][1], None)]  # copies, a repeated and a missing id
    bad = [None, [], [0.0] * 15 + [None], [math.nan] * 16, [math.inf] + [0.0] * 15, [-20000.0] * 16, [1.0] * 8, [0.5] * 17]
    rows += [(1000 + k, v, 1) for k, v in enumerate(bad)]
    df = spark.createDataFrame([(i, v, g, 1, "x") for i, v, g in rows], SCHEMA).repartition(5)
    same(df, rows)
    same(df, rows, entries=3, rounds=2, parts=4)
    same(df, rows, parts=5)  # zeros follow
    few = rows[:4]
    same(spark.createDataFrame([(i, v, g, 1, "x") for i, v, g in few], SCHEMA), few)
    assert codes.encode(df.limit(0)).count() == 0 and codes.encode(df.limit(0)).columns == codes.encode(df).columns
    assert codes.encode(df.selectExpr("cast(null as long) vec_id", "embedding", "label")).count() == 0
    plain = codes.encode(df.select("vec_id", "embedding"), label=None).collect()
    assert len({r.label_error for r in plain}) == 1 and plain[0].label_error == sum(r.error for r in plain)


def test_floors_go_down(spark):
    rows = [(k, [x] * 8, 0) for k, x in enumerate([-0.00001, -1 / 4096, 0.0, 0.99999, -0.5, -0.7])]
    same(spark.createDataFrame([(i, v, g, 1, "x") for i, v, g in rows], SCHEMA), rows, entries=2)


def test_query(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want, digest = brute(rows)
    found = queries.queries()["op12_vector_codes"](spark, small).collect()
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in found) == sorted(want)
    assert {r.codebooks_sha256 for r in found} == {digest}
