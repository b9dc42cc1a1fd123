"""Encoding, token-id files and packing against the tokenizers library and brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchlake.llm import bitpack, bpe, packing, queries, tokens

PATH = queries.TOKENIZER
ODD_TEXTS = [
    "", " ", "a b c", "<|endoftext|>x don't é İSTANBUL ΣΑΣ", "\x1c\x85a b\x0bc", "a<|startoftext|> b", "'S 'll we'd!!'s ",
    "日本語テキスト \U0001f642\U0001f642!!'s", "가 x", "words, with. marks; at! the? ends", "naïve ÉCOLE, ß.",
    "<|ENDOFTEXT|> <|endoftext |>", "x" * 3000, "ab" * 2500, "!'s" * 900, "<|endoftext|>" * 300, "é" * 1500, "a1b2" * 700, " " * 500 + "z",
]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens int")


def test_ids_are_gathered_in_bounded_memory(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 500, 1000)) for _ in range(1000)] + ["", None])
    want = tokens.encode(texts, PATH)
    tracemalloc.start()
    try:
        tokens.encode(texts, PATH)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    # Beside the ids: a place for each word, and no more for each id.
    assert peak < want[0].nbytes + 20 * int(1e6) + 8e6
    monkeypatch.setattr(tokens, "GATHERED_WORDS", 7)
    some = tokens.encode(texts.slice(990), PATH)
    assert np.array_equal(some[0], want[0][want[1][:990].sum() :]) and np.array_equal(some[1], want[1][990:])


def test_words_equal_whole_texts(library):
    ids, counts = tokens.encode(pa.array([*ODD_TEXTS, None]), PATH)
    edges = np.concatenate([[0], np.cumsum(counts)])
    for k, text in enumerate([*ODD_TEXTS, ""]):
        assert ids[edges[k] : edges[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:40])


@pytest.mark.parametrize("leaf", [40, 100, 701])
def test_tree_equals_whole_texts(library, leaf):
    for text in [*ODD_TEXTS, " ".join(ODD_TEXTS) * 2]:
        ids, counts = bpe.encode_texts([text, "b"], PATH, leaf)
        assert ids[: counts[0]].tolist() == library.encode(text, add_special_tokens=False).ids, (leaf, repr(text[:40]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "th", "the ", "'s", "!", "<|endoftext|>", "<|", "|>", "é", "́", "é", " ", "\n", "7", "中", "ing", "xq", "'", "ll"]), min_size=20, max_size=220))
def test_tree_equals_whole_random_texts(parts):
    text = "".join(parts)
    ids, _ = bpe.encode_texts([text], PATH, 33)
    assert ids.tolist() == tokens.load(PATH).encode(text, add_special_tokens=False).ids


def test_encode_rows(spark, library):
    texts = [*ODD_TEXTS, None, " ".join(ODD_TEXTS[:11]) * 40, "a b c"]
    df = rows(spark, texts).unionByName(rows(spark, ["same", "same"]).selectExpr("cast(null as long) doc_id", "text", "ids", "n_tokens"))
    found = bpe.encode(df, PATH, leaf=300, spread=2000, digest=True).collect()
    plain = {r.doc_id: r for r in bpe.encode(rows(spark, texts), PATH, leaf=300, spread=2000).collect()}
    assert len(found) == len(texts) + 2 and sum(r.doc_id is None for r in found) == 2
    for r in found:
        if r.doc_id is None:
            continue
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
        assert plain[r.doc_id].ids == ids and plain[r.doc_id].decoded == decoded


def test_long_equal_rows_are_each_returned(spark):
    df = rows(spark, ["word " * 3000] * 2).selectExpr("1L doc_id", "text")
    assert len(bpe.encode(df, PATH, leaf=300, spread=2000, digest=True).distinct().collect()) == 1
    assert bpe.encode(df, PATH, leaf=300, spread=2000, digest=True).count() == 2


def test_empty_tables(spark):
    none = rows(spark, ["a"]).where("doc_id < 0")
    assert bpe.encode(none, PATH).collect() == []
    assert packing.pack(none, PATH).collect() == []
    assert bitpack.read(bitpack.write(none, PATH)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300))
def test_bits_round_trip(width, count):
    ids = np.random.default_rng(count).integers(0, 1 << width, count, dtype=np.uint64).astype(np.uint32)
    packed = bitpack.pack(ids, width)
    assert len(packed) == -(-count // 32) * width
    assert bitpack.unpack(packed, width, count).tolist() == ids.tolist()


def test_bits_of_vocabularies():
    assert [bitpack.bits(n) for n in (1, 2, 3, 256, 257, 49408)] == [1, 1, 2, 8, 9, 16]


def test_file_random_access(tmp_path):
    rng = np.random.default_rng(1)
    writer = bitpack.Writer(f"file://{tmp_path}/x.tid", 17, block_ids=64)
    docs = [rng.integers(0, 1 << 17, n).astype(np.uint32) for n in (0, 5, 200, 64, 1, 63, 1000)]
    for k, ids in enumerate(docs):
        writer.add(None if k == 3 else k, ids)
    writer.close()
    reader = bitpack.Reader(f"file://{tmp_path}/x.tid")
    flat = np.concatenate(docs)
    for a, b in ((0, 0), (3, 70), (128, 128), (127, 129), (0, len(flat)), (len(flat) - 1, len(flat))):
        assert reader.ids(a, b).tolist() == flat[a:b].tolist()
    again = list(reader.documents(most=100))
    assert [d for d, _, _ in again] == [0, 1, 2, None, 4, 5, 6]
    assert all(ids.tolist() == own.tolist() for (_, _, ids), own in zip(again, docs, strict=True))


def test_files_in_order(spark, library):
    texts = [f"word{k} of the text " * (k % 7) for k in range(60)] + [None]
    df = rows(spark, texts).repartition(5).unionByName(rows(spark, ["again"]).selectExpr("7L doc_id", "text", "ids", "n_tokens")).unionByName(rows(spark, ["null id"]).selectExpr("cast(null as long) doc_id", "text", "ids", "n_tokens"))
    found = sorted(bitpack.read(bitpack.write(df, PATH), crc=True).collect(), key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in found]
    assert ids == sorted([*range(61), 7, -1])
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id not in (7, None):
            own = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert r.n_tokens == len(own) and r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())


def best(lengths, capacity):
    """Fewest bins by trying everything."""
    lengths = sorted(lengths, reverse=True)
    for bins in range(1, len(lengths) + 1):
        def place(k, free):
            if k == len(lengths):
                return True
            for b in sorted(set(free)):
                if b >= lengths[k]:
                    rest = list(free)
                    rest[rest.index(b)] -= lengths[k]
                    if place(k + 1, tuple(rest)):
                        return True
            return False

        if place(0, (capacity,) * bins):
            return bins
    return 0


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_an_optimum(lengths):
    counts = np.bincount(lengths, minlength=21)
    left, fixed = packing.reduce(counts, 20)
    assert all(sum(s) <= 20 for _, s in fixed)
    rest = [v for v, n in enumerate(left.tolist()) for _ in range(n)]
    used = Counter(rest) + Counter(v for n, s in fixed for v in s * n)
    assert used == Counter(lengths)
    assert best(rest, 20) + sum(n for n, _ in fixed) == best(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
def test_plan_places_every_item_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    plan = packing.plan(counts, 64)
    bins = defaultdict(list)
    ranks = defaultdict(list)
    for length, rank, number, sequence, offset in zip(*(plan[c].tolist() for c in ("length", "rank", "number", "sequence", "offset")), strict=True):
        for k in range(number):
            ranks[length].append(rank + k)
            bins[sequence + k].append((offset, length))
    assert {v: sorted(r) for v, r in ranks.items()} == {v: list(range(n)) for v, n in Counter(lengths).items()}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64


def test_pack_rows(spark, library):
    texts = ["the cat " * n for n in (0, 1, 5, 900, 2048, 5000, 3, 3, 1700)] + [None, "the cat " * 5]
    df = rows(spark, texts)
    found = packing.pack(df, PATH).collect()
    assert Counter(r.doc_id for r in found).keys() == set(range(len(texts)))
    sequences = defaultdict(list)
    for r in found:
        own = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == len(own) <= 4096
        assert np.frombuffer(r.ids, "<u4").tolist() == own and r.ids_crc32 == zlib.crc32(r.ids)
        sequences[r.sequence_id].append((r.offset, r.length))
    for items in sequences.values():
        assert all(a + n <= b for (a, n), (b, _) in combinations(sorted(items), 2)) and sum(n for _, n in items) <= 4096
    assert len(sequences) == -(-sum(r.length for r in found) // 4096)
