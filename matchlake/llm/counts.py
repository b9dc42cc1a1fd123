"""Token counts of whole texts: pre-tokens that are proven to be one token are not merged.

Before any text is read, every string of the vocabulary is encoded alone. Those that
come out as one token are proven: a pre-token equal to one of them counts one, without
merging. Only the other pre-tokens are merged by the library, each distinct one once per
slice of text. Where texts part into pre-tokens is found by a pattern of the same classes
as the library's; code points that the two classify differently are found beforehand as
well, and a text that holds one is left to the library.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import slices, text_rows
from .tokens import load

#: Documents with more tokens than this are over the limit.
LIMIT = 512
#: Code points of a long text whose pre-tokens are held at once; it is cut where one ends.
WINDOW = 1 << 19
#: Merged pre-tokens that a Python worker keeps, and the longest of them; speed only.
KEPT, KEPT_LENGTH = 300_000, 64

# The byte-level pre-tokenizer's pattern.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Classes of code points that the pattern tells apart, each with one that belongs to it.
CLASSES = ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"\s", " "), (r"[^\s\p{L}\p{N}]", "!"))


class Proof(NamedTuple):
    """What is proven about a tokenizer's file; small enough to travel with a task."""

    path: str
    #: One bit per id: its string alone encodes as this one token.
    whole: bytes
    #: Ranges of code points that pattern and library classify differently.
    disputed: tuple[tuple[int, int], ...]
    #: Strings that are tokens wherever they stand in a text.
    added: tuple[str, ...]


def supported(path: str) -> bool:
    """Whether a file's texts part by ``PRE_TOKEN`` alone, after plain added tokens."""
    stored = json.loads(load(path).to_str())
    pre = stored.get("pre_tokenizer") or {}
    model = stored["model"]
    return (
        stored.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and not pre.get("add_prefix_space")
        and pre.get("use_regex", True)
        and model.get("type") == "BPE"
        and not model.get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in stored["added_tokens"])
    )


def _strings(path: str) -> list[str]:
    tokenizer = load(path)
    return tokenizer.decode_batch([[i] for i in range(tokenizer.get_vocab_size())], skip_special_tokens=False)


def _disputed(path: str) -> list[int]:
    """Code points for which the library parts what the pattern takes for one class."""
    split = load(path).pre_tokenizer.pre_tokenize_str
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = []
    for pattern, one in CLASSES:
        members = one + "".join(regex.findall(pattern, every))
        for _, (a, b) in split(members):
            # Pieces begin where the library's class changes; the first character tells which it is.
            if len(split(one + members[a])) != 1:
                out += map(ord, members[a:b])
    return sorted(out)


def prove(path: str) -> Proof | None:
    """The proof for a file, from the file alone; None if its texts part in another way."""
    if not supported(path):
        return None
    strings = _strings(path)
    added = tuple(t.content for t in load(path).get_added_tokens_decoder().values())
    codes = load(path).encode_batch(strings, add_special_tokens=False)
    whole = np.array([c.ids == [k] and s not in added for k, (s, c) in enumerate(zip(strings, codes, strict=True))])
    odd = _disputed(path)
    starts = [c for k, c in enumerate(odd) if not k or odd[k - 1] != c - 1]
    ends = [c for k, c in enumerate(odd) if k + 1 == len(odd) or odd[k + 1] != c + 1]
    return Proof(path, np.packbits(whole).tobytes(), tuple(zip(starts, ends, strict=True)), added)


class Counter:
    """Counts tokens in a Python worker."""

    def __init__(self, proof: Proof, kept: int = KEPT, window: int = WINDOW):
        strings = _strings(proof.path)
        whole = np.unpackbits(np.frombuffer(proof.whole, np.uint8), count=len(strings)).astype(bool)
        self.whole = dict.fromkeys((strings[k] for k in np.flatnonzero(whole).tolist()), 1)
        self.path, self.kept, self.window = proof.path, kept, window
        self.merged: dict[str, int] = {}
        self.pieces = regex.compile(PRE_TOKEN)
        self.gap = regex.compile(r"(?<=\S)\s")
        ranges = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in proof.disputed)
        self.disputed = regex.compile(f"[{ranges}]") if ranges else None
        added = sorted(proof.added, key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def windows(self, text: str) -> Iterator[str]:
        """``text`` cut before white space that follows something else: a pre-token ends there."""
        start = 0
        while len(text) - start > self.window:
            cut = self.gap.search(text, start + self.window)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:] if start else text

    def _parts(self, text: str) -> Iterator[list[str] | int]:
        """Pre-tokens of each window, or the number of tokens of what is counted otherwise."""
        if self.disputed and not text.isascii() and self.disputed.search(text):
            yield len(load(self.path).encode(text, add_special_tokens=False).ids)
            return
        between = self.added.split(text) if self.added else [text]
        yield len(between) - 1
        for part in between:
            for window in self.windows(part):
                yield self.pieces.findall(window)

    def _merge(self, pieces: set[str]) -> dict[str, int]:
        some = list(pieces)
        codes = load(self.path).encode_batch(some, add_special_tokens=False)
        found = {s: len(c.ids) for s, c in zip(some, codes, strict=True)}
        if len(self.merged) > self.kept:
            self.merged.clear()
        self.merged.update((s, n) for s, n in found.items() if len(s) <= KEPT_LENGTH)
        return found

    def counts(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Tokens of each text, and how many of them were proven pre-tokens."""
        totals, proven = [0] * len(texts), [0] * len(texts)
        held, size = [], 0

        def settle() -> None:
            new: set[str] = set()
            for _, pieces in held:
                new.update(pieces)
            rest = [p for p in new if p not in self.whole]
            known = {p: self.merged[p] for p in rest if p in self.merged}
            known |= self._merge({p for p in rest if p not in known})
            for k, pieces in held:
                other = [known[p] for p in pieces if p in known]
                proven[k] += len(pieces) - len(other)
                totals[k] += len(pieces) - len(other) + sum(other)
            held.clear()

        for k, text in enumerate(texts):
            for part in self._parts(text):
                if isinstance(part, int):
                    totals[k] += part
                    continue
                held.append((k, part))
                size += len(part)
                if size > self.window:
                    settle()
                    size = 0
        settle()
        return totals, proven


_counters: dict = {}


def _counter(proof: Proof) -> Counter:
    if proof.path not in _counters:
        _counters[proof.path] = Counter(proof)
    return _counters[proof.path]


def count(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text as the tokenizers library counts them, without special tokens.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per row:
    doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``) and n_whole
    (tokens that were counted by the proof alone). Null and empty texts have no bytes
    and no tokens; rows without doc_id or with a repeated one are counted like all
    others; an empty table gives no rows. Strings of added tokens inside texts are
    tokens, as is the library's default. A text is cut into windows where pre-tokens
    end, so that memory does not grow with its length. Files whose texts part in
    another way than ``PRE_TOKEN`` are counted by the library, with n_whole 0.
    """
    proof = prove(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                column = pc.fill_null(part.column("text"), "")
                texts = column.to_pylist()
                if proof:
                    totals, proven = _counter(proof).counts(texts)
                else:
                    totals = [len(c.ids) for c in load(path).encode_batch(texts, add_special_tokens=False)]
                    proven = [0] * len(texts)
                tokens = pa.array(totals, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(column).cast(pa.int64()), tokens, pc.greater(tokens, limit), pa.array(proven, pa.int64())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"],
                )

    return text_rows(docs).mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long")
