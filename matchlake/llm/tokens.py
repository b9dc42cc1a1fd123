"""Token ids of whole texts with a stored tokenizer, each distinct word encoded once.

The tokenizer parts texts at white space and drops it, so the ids of a text are the
ids of its words in order; words are cut at ASCII white space only, which is inside
what the tokenizer takes for white space. Texts repeat words far more often than
not, so a batch is turned into distinct words and a gather.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of text that are made distinct together.
SLICE_BYTES = 8 << 20
#: Words whose ids are gathered together.
GATHERED_WORDS = 1 << 16
#: Words that occur more than once in a slice, whose ids a Python worker keeps; speed only.
KEPT_WORDS = 150_000

_loaded: dict = {}


def load(path: str):
    """The tokenizer of a file, once per Python worker, without truncation or padding."""
    if path not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = (tokenizer, {})
    return _loaded[path][0]


def parts_at_space(path: str) -> bool:
    """Whether ids of a text are the ids of its words, by what the file says."""
    import json

    stored = json.loads(load(path).to_str())
    pre = stored.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    split = next((s for s in steps if s.get("type") == "Split"), None)
    return bool(
        split and split.get("invert") and split.get("behavior") == "Removed" and split["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    ) and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in stored["added_tokens"])


#: A letter and the marks after it that end a word; there the tokenizer always parts.
WORD_TAIL = r"(\pL)([.,;:!?|*#&%$)]+)(\s|$)"


def _stems(texts: pa.Array) -> pa.Array:
    """Texts of the same ids with fewer distinct words: marks at word ends apart, A-Z lower.

    Special tokens are matched before lower-casing, so a slice with their first
    characters stays as it is.
    """
    if pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    return pc.replace_substring_regex(pc.ascii_lower(texts), WORD_TAIL, r"\1 \2\3")


def _encode_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word, from runs of words that are encoded as one text."""
    out = []
    for k in range(0, len(words), 2048):
        some = words[k : k + 2048]
        code = load(path).encode(" ".join(some), add_special_tokens=False)
        ids = np.array(code.ids, np.uint32)
        at = np.fromiter((a for a, _ in code.offsets), np.int64, len(ids))
        size = np.fromiter(map(len, some), np.int64, len(some)) + 1
        cut = np.searchsorted(at, np.cumsum(size)).tolist()
        out += [ids[a:b].tobytes() for a, b in zip([0, *cut], cut, strict=False)]
    return out


def _word_ids(path: str, words: list[str], times: np.ndarray) -> list[bytes]:
    load(path)
    kept = _loaded[path][1]
    new = [w for w in words if w and w not in kept]
    known = dict(zip(new, _encode_words(path, new), strict=True))
    known[""] = b""
    out = [known[w] if w in known else kept[w] for w in words]
    if len(kept) > KEPT_WORDS:
        kept.clear()
    kept.update((w, ids) for w, ids, n in zip(words, out, times.tolist(), strict=True) if n > 1)
    return out


def encode(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in order as uint32, and how many each row has; null is empty."""
    if not len(texts):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    texts = pc.fill_null(texts, "")
    if not parts_at_space_known(path):
        found = [np.array(c.ids, np.uint32) for c in load(path).encode_batch(texts.to_pylist(), add_special_tokens=False)]
        return np.concatenate(found), np.array([len(f) for f in found], np.int64)
    words = pc.ascii_split_whitespace(_stems(texts))
    per_row = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    place = coded.indices.to_numpy(zero_copy_only=False)
    words_here = coded.dictionary.to_pylist()
    codes = _word_ids(path, words_here, np.bincount(place, minlength=len(words_here)))
    del words, coded, words_here
    flat = np.frombuffer(b"".join(codes), np.uint32)
    count = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
    del codes
    first = np.cumsum(count) - count
    upto = np.zeros(len(place) + 1, np.int64)
    if len(place):
        np.cumsum(count[place], out=upto[1:])
    ids = np.empty(upto[-1], np.uint32)
    for a in range(0, len(place), GATHERED_WORDS):
        here = upto[a : a + GATHERED_WORDS + 1]
        at = np.repeat(first[place[a : a + GATHERED_WORDS]] - here[:-1], np.diff(here))
        at += np.arange(here[0], here[-1])
        ids[here[0] : here[-1]] = flat[at]
    edges = np.concatenate([[0], np.cumsum(per_row)])
    return ids, upto[edges[1:]] - upto[edges[:-1]]


_known: dict[str, bool] = {}


def parts_at_space_known(path: str) -> bool:
    if path not in _known:
        _known[path] = parts_at_space(path)
    return _known[path]


def joined(strings: list[str], ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
    """Per row the bytes of its ids' strings with one space between them."""
    table = pa.array([s + " " for s in strings], pa.large_string())
    taken = table.take(pa.array(ids))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1]
    raw = memoryview(taken.buffers()[2] or b"")
    edges = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a : max(a, b - 1)] for a, b in zip(edges, edges[1:], strict=False)]


def decoded(path: str, ids: np.ndarray, counts: np.ndarray) -> list:
    """Per row the UTF-8 bytes of ``decode(ids, skip_special_tokens=False)``.

    Without a decoder in the file that is the tokens with spaces between them.
    """
    tokenizer = load(path)
    if tokenizer.decoder is not None:
        edges = np.concatenate([[0], np.cumsum(counts)])
        rows = [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return [t.encode() for t in tokenizer.decode_batch(rows, skip_special_tokens=False)]
    if (path, "tokens") not in _known:
        _known[path, "tokens"] = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
    return joined(_known[path, "tokens"], ids, counts)
