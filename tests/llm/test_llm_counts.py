"""Token counts against the tokenizers library."""

from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchlake.llm import counts, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "\n\n a", "don't we'll I'M 'S ''s", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endoftext |>", "x" * 3000, "  \t\n  " * 300,
    "naïve ÉCOLE, ß. 日本語テキスト \U0001f642\U0001f642!!", "١٢٣ ½ Ⅷ 12345678901234567890", "\x1c\x85\xa0b\x0bc  　d", "word " * 4000,
    "� a�b", "\U000323b0 ࢏x ౜9", "1" * 700, "!?" * 900, "tail spaces   ", "   \n", "á é", "'", "' s", " '", "é" * 1500,
]


plain = cache(lambda: Tokenizer.from_file(PATH))
proven = cache(lambda: counts.prove(PATH))


@pytest.fixture(scope="module")
def library():
    return plain()


@pytest.fixture(scope="module")
def proof():
    return proven()


def wanted(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("window", [20, 333, 1 << 19])
def test_equals_the_library(library, proof, window):
    found, whole = counts.Counter(proof, kept=5, window=window).counts(TEXTS)
    assert found == [wanted(library, t) for t in TEXTS]
    assert all(0 <= w <= n for w, n in zip(whole, found, strict=True)) and sum(whole) > 4000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(["a", "the ", " the", "'s", "!", "<|endoftext|>", "<|", "é", "́", " ", "  ", "\n", "\xa0", "7", "中", "ing", "౜", "\x1f"]), st.characters(codec="utf-8")), max_size=80))
def test_equals_the_library_on_random_texts(parts):
    text = "".join(parts)
    assert counts.Counter(proven(), window=16).counts([text])[0] == [wanted(plain(), text)]


def test_proof(library, proof):
    assert proof.added == ("<|endoftext|>",) and proof.disputed
    counter = counts.Counter(proof)
    assert " the" in counter.whole and "<|endoftext|>" not in counter.whole
    assert all(len(c.ids) == 1 for c in library.encode_batch(list(counter.whole), add_special_tokens=False))
    # Code points outside of the disputed ranges fall into one class for both.
    inside = {c for a, b in proof.disputed for c in range(a, b + 1)}
    probes = [f"a{chr(c)}1{chr(c)}! {chr(c)}" for c in [*range(0x3000), 0x1F642, 0x10FFFF] if c not in inside]
    assert counter.counts(probes)[0] == [wanted(library, t) for t in probes]


def test_rows(spark, library):
    rows = [(k, t, 7, "x", True) for k, t in enumerate(TEXTS)] + [(None, "a b", 1, "y", False), (3, "again", 1, "y", False), (50, None, 1, None, None), (51, "a" * 200_000 + " b" * 200_000, 1, "", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, n_bytes string, over_limit boolean")
    found = counts.count(df, PATH).collect()
    assert len(found) == len(rows)
    want = sorted((-1 if i is None else i, len((t or "").encode()), wanted(library, t)) for i, t, *_ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in found) == want
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_whole <= r.n_tokens for r in found)
    assert counts.count(df.limit(0), PATH).count() == 0
    assert {r.doc_id for r in counts.count(df.where("doc_id = 51"), PATH, limit=10**6).collect() if r.over_limit} == set()


def test_other_files_are_counted_by_the_library(spark):
    assert counts.prove(queries.TOKENIZER) is None
    other = Tokenizer.from_file(queries.TOKENIZER)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in counts.count(df, queries.TOKENIZER).collect():
        assert (r.n_tokens, r.n_whole) == (wanted(other, TEXTS[r.doc_id]), 0)


def test_query(spark, small, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.queries()["op13_token_counts"](spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in found} == {k: (len((t or "").encode()), wanted(library, t), wanted(library, t) > 512) for k, t in texts.items()}
