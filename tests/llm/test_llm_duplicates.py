"""Near-duplicates, fingerprints and vectors against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from matchlake.llm import common, components, descent, fingerprints, minhash

RNG = np.random.default_rng(5)
VOCABULARY = ["w%d" % k for k in range(400)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCABULARY, n))


def edited(text, share, rng=RNG):
    words = text.split()
    for k in rng.choice(len(words), max(1, int(len(words) * share)), replace=False):
        words[k] = "new%d" % rng.integers(10**9)
    return " ".join(words)


def shingle_set(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(pairs, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus():
    texts = [prose(int(n)) for n in RNG.integers(1, 120, 40)]
    for k in range(0, 12):
        texts += [edited(texts[k], s) for s in (0.005, 0.02, 0.05)]
    base = prose(100)
    texts += [edited(base, 0.01) for _ in range(60)]  # one large group, split over blocks below
    return [*texts, None, "", " \t\n", "ONE two", "one TWO", "one two three", base, base.upper(), "Été " * 9, "été " * 9]


@pytest.mark.parametrize("block", [1000, 16])
def test_minhash_equals_all_pairs(spark, block):
    texts = corpus()
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    pairs = [(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = brute(pairs, sets)
    df = spark.createDataFrame([(k, t, True, 1) for k, t in enumerate(texts)], "doc_id long, text string, kept boolean, component_id int")
    found = minhash.near_duplicates(df, block=block, percent=85).collect()
    assert sorted(r.doc_id for r in found) == sorted(sets)
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_stage_drops_copies_from_80_percent(spark):
    import corpus_pipeline

    rng = np.random.default_rng(11)
    texts = [prose(100, rng) for _ in range(30)]
    for k in range(15):  # Jaccard 86 / 106
        words = texts[k].split()
        words[30 + k], words[70] = "newone", "newtwo"
        texts.append(" ".join(words))
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    value = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in range(a)}
    assert any(0.8 <= v < 0.85 for v in value.values()) and not any(v >= 0.85 for v in value.values())
    want = brute([p for p, v in value.items() if v >= 0.8], sets)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert left == {k for k in sets if want[k] == k} and len(left) == 30


def test_bands_follow_the_threshold():
    for percent in (60, 80, 85, 95):
        bands = minhash.bands_for(percent)
        missed = [(1 - (percent / 100) ** minhash.ROWS) ** n for n in (bands, bands - 1)]
        assert missed[0] <= minhash.MISSED < missed[1]
    assert minhash.bands_for(100) == 1


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert found == [(1, 1, True), (3, 1, False), (3, 1, False), (None, None, True), (None, None, True)]
    assert minhash.near_duplicates(df.where("doc_id < 0")).collect() == []


def test_signatures_estimate_resemblance():
    universe = RNG.integers(0, 1 << 63, 3000).astype(np.uint64)
    a, b = universe[:2000], universe[500:2500]
    same = np.mean(minhash.signature(a, 2048) == minhash.signature(b, 2048))
    assert abs(same - 1500 / 2500) < 0.05


def test_shared_counts():
    sets = [np.unique(RNG.integers(0, 60, RNG.integers(0, 50))).astype(np.uint64) for _ in range(45)]
    found = minhash.shared_counts(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(45) for j in range(45) if i != j)


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 201), (201, 200), (7, 7), (None, 3)]
    found = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {**{k: 0 for k in range(61)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_word_hashes_depend_on_bytes_alone():
    texts = pa.array(["Alpha beta\tGAMMA", None, "", "gamma alpha", "x" * 70000 + " beta"])
    words = common.Words(texts)
    named = dict(zip([words.text(k) for k in range(len(words))], words.hashes().tolist(), strict=True))
    assert list(np.diff(words.rows)) == [3, 0, 0, 2, 2] and len(set(named.values())) == 4
    again = common.Words(pa.array(["gamma"]))
    assert again.hashes()[0] == named["gamma"]


def test_fingerprints(spark):
    texts = [prose(300), None, "", "a b", prose(3), prose(700), prose(300), prose(300)]
    texts[7] = texts[6]
    df = spark.createDataFrame([(10 * k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, edge int").repartition(3)
    found = {r.doc_id // 10: r for r in fingerprints.compare_edits(df).collect()}
    assert len(found) == len(texts)
    for k, text in enumerate(texts):
        text, other = text or "", texts[(k + 1) % len(texts)] or ""
        half = len(text) // 2
        edit = text[: len(text) - half] + other[:half]
        a, b, c = shingle_set(text), shingle_set(edit), shingle_set(other)
        r = found[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        for near, s in ((r.near_edited, b), (r.near_next, c)):
            assert abs(near - (len(a & s) / len(a | s) if a | s else 1)) < 0.15
        assert r.n_distinct == len(a) if len(a) < fingerprints.K else abs(r.n_distinct / len(a) - 1) < 0.3
        assert len(fingerprints.parse(r.fingerprint)) == min(len(a), fingerprints.K)
    assert found[6].fingerprint == found[7].fingerprint and found[6].near_next == 1


def test_fingerprints_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (5, "b"), (5, "c"), (5, "c")], "doc_id long, text string")
    found = fingerprints.compare_edits(df).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in found) == [("5", 1), ("5", 1), ("5", 1), ("None", 1)]
    assert fingerprints.compare_edits(df.where("doc_id < 0")).collect() == []
    assert len(fingerprints.fingerprints(df).collect()) == 4
    one = fingerprints.compare_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest()


def test_sketches_merge():
    words = prose(2000).split()
    whole = fingerprints.sketch(pa.array([" ".join(words)]))[0]
    parts = fingerprints.sketch(pa.array([" ".join(words[:1004]), " ".join(words[1000:])]))
    assert fingerprints.merge(*parts).tolist() == whole.tolist()
    assert fingerprints.parse(fingerprints.dump(whole)).tolist() == whole.tolist()
    assert fingerprints.containment(parts[0], whole) > 0.9 > 0.7 > fingerprints.containment(whole, parts[0])


def vectors():
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(16) for _ in range(300)]
    rows += [rows[k] + 0.05 * rng.standard_normal(16) for k in range(40)]
    centre = rng.standard_normal(16)
    rows += [centre + 0.12 * np.linalg.norm(centre) / 4 * rng.standard_normal(16) for _ in range(80)]
    rows += [rows[0], rows[0], rows[5]]
    return [[float(x) for x in r] for r in rows]


def test_vectors_equal_all_pairs(spark):
    rows = vectors()
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = brute(zip(*(a.tolist() for a in np.nonzero(near)), strict=True), range(len(rows)))
    n = len(rows)
    odd = [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [None] * 16), (n + 4, [float("nan")] * 16), (n + 5, [1.0] * 3), (None, rows[0]), (n + 6, [1e300] * 16), (n + 7, [2e300] * 16)]
    df = spark.createDataFrame([(k, v, 1) for k, v in [*enumerate(rows), *odd]], "vec_id long, embedding array<double>, node int")
    found = descent.near_vectors(df).collect()
    assert len(found) == n + len(odd)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, True)
        elif r.vec_id < n:
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum(), want[r.vec_id], want[r.vec_id] == r.vec_id)
        elif r.vec_id < n + 6:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id) == (1, n + 6)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r)[:4] for r in descent.near_vectors(df).collect()] == [(1, 0, 1, True)]
    assert descent.near_vectors(df.where("vec_id < 0")).collect() == []


@pytest.mark.parametrize("percent", [80, 85])
def test_minhash_equals_all_pairs_at(spark, percent):
    texts = corpus()
    sets = {k: shingle_set(t) for k, t in enumerate(texts)}
    want = brute([(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])], sets)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(df, percent=percent, block=16).collect()
    assert {r.doc_id: r.component_id for r in found} == want


def test_isolated_pairs_beside_a_dense_group(spark, monkeypatch):
    monkeypatch.setattr(descent, "CELL", 2)
    monkeypatch.setattr(descent, "TREES", 1)
    monkeypatch.setattr(descent, "trees_for", lambda *_: 1, raising=False)
    monkeypatch.setattr(descent.cells, "__defaults__", (1,))
    monkeypatch.setattr(descent, "ASKED_BYTES", 20_000, raising=False)  # several blocks
    rng = np.random.default_rng(8)
    x = rng.standard_normal((140, 32))
    x[:70] = x[0] + 0.02 * rng.standard_normal((70, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal((70, 32))
    side -= (side * x[70:]).sum(axis=1, keepdims=True) * x[70:]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.concatenate([x, 0.905 * x[70:] + np.sqrt(1 - 0.905**2) * side])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    want = brute(zip(*(a.tolist() for a in np.nonzero(near)), strict=True), range(len(x)))
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = descent.near_vectors(df, rounds=0, attempts=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {k: (near[k].sum(), want[k]) for k in want}


def test_trees_grow_with_the_vectors():
    for count in (2_000, 10**6, 10**7):
        one = (1 - np.arccos(0.9) / np.pi) ** np.ceil(np.log2(count / descent.CELL))
        assert 1 - (1 - one) ** descent.trees_for(count, 0.9, 0.999) >= 0.999


def test_saturated_lists_look_outside(spark, monkeypatch):
    """Two dense groups, linked by one pair only that no first cell holds, and no help by the audit."""
    monkeypatch.setattr(descent, "_audit", lambda *_: 1.0)
    first = descent.cells

    def apart(nodes, count, dimension, seed, *more):
        found = first(nodes, count, dimension, seed, *more)
        group = (nodes.select("node", ((descent.F.col("node") >= 40).cast("int")).alias("side")))
        return found if seed >= 1000 else found.join(group, "node").select("node", "tree", (descent.F.col("cell") * 2 + descent.F.col("side")).alias("cell"), "part")

    monkeypatch.setattr(descent, "cells", apart)
    rng = np.random.default_rng(4)
    x = np.zeros((80, 24))
    x[:40, 0] = x[40:, 1] = 1
    x[40:, 0], x[40:, 1] = 0.8, 0.6
    x += 0.01 * rng.standard_normal(x.shape)
    angle = np.arccos(0.8)
    x[0, :2], x[40, :2] = [np.cos(0.12 * angle), np.sin(0.12 * angle)], [np.cos(0.82 * angle), np.sin(0.82 * angle)]
    x[[0, 40], 2:] = 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[:40, 40:].any() and near[:40, 40:].sum() < 80 and (near.sum(axis=1) >= 9).all()
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = descent.near_vectors(df, attempts=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {k: (near[k].sum(), 0) for k in range(80)}


def linked_by_all_pairs(rows):
    """(vec_id, n_links, component) per row of (vec_id, vector): every distinct (vec_id, vector) is one vector."""
    points = sorted({(i, tuple(v)) for i, v in rows})
    unit = [np.array(v) / np.linalg.norm(v) for _, v in points]
    near = [(a, b) for a in range(len(points)) for b in range(a) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    links, root = [0] * len(points), list(range(len(points)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        links[a] += 1
        links[b] += 1
        root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for p, (i, _) in enumerate(points):
        least[find(p)] = min(least.get(find(p), i), i)
    at = {point: p for p, point in enumerate(points)}
    return [(i, links[at[i, tuple(v)]], least[find(at[i, tuple(v)])]) for i, v in rows]


def test_repeated_ids_and_several_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (8, [0.01, 1.0, 0.0]), (9, [1.0, 0.0]), (10, [1.0, 0.01]), (7, [1.0, 0.0, 0.0]), (5, [1.0, 0.0, 0.0])]
    for dimension in (3, 6):
        heart = rng.standard_normal((12, dimension))
        rows += [(int(rng.integers(20, 60)), (heart[k % 12] + 0.15 * rng.standard_normal(dimension)).tolist()) for k in range(60)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, node int")
    found = descent.near_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted(linked_by_all_pairs(rows))
    assert all(r.kept == (r.vec_id == r.component_id) and r.audited_recall >= 0.999 for r in found)
