"""Secret scan with multipart credential linking.

Base kinds stand alone: assignments, access ids, long hex strings. Weak parts do not:
an identifier, an opaque value or an endpoint is reported only where its complement
lies within one scope, found by an interval join of the parts of a text. A scope is a
paragraph (text between blank lines) and at most ``REACH`` code points away.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import slices, text_rows

#: Code points between parts of one credential.
REACH = 400
KINDS = ("assign", "access", "hex", "identifier", "opaque", "endpoint")

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""\b(?i:access[_-]?key[_-]?id|client[_-]?id|user(?:name|[_-]?id)?|login|account(?:[_-]?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""\b(?:(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+|(?i:endpoint|host(?:name)?|server|bucket|region)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:/_-]{2,})""", re.ASCII)
PARAGRAPH = re.compile(r"\n[^\S\n]*\n")

#: Texts without any of these have no span at all.
MAYBE = r"(?i)(password|passwd|secret|token|api_?key)|AKIA|(access.?key.?id|client.?id|user|login|account)[a-z_-]*[\"']?\x20*[:=]"
MAYBE_HEX = r"[0-9a-f]{24}"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def _opaque(value: str) -> bool:
    """Letters and digits mixed as in no word: at least three digits and four letters."""
    digits = sum(c.isdigit() for c in value)
    return digits >= 3 and sum(c.isalpha() for c in value) >= 4


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """Weak parts whose complementary parts lie in their scope.

    An identifier needs a secret (base or opaque), an opaque value needs an identifier
    or access id, an endpoint needs both. Parts that overlap a base span, or an
    opaque value inside an identifier or endpoint, are not reported again.
    """
    taken = sorted((a, b) for _, a, b in base)

    def clear_of(used: list[tuple[int, int]]):
        """Whether a span overlaps none of the sorted ``used`` ones, by their largest end so far."""
        ends = list(accumulate((e for _, e in used), max))

        def free(a: int, b: int) -> bool:
            k = bisect_left(used, (b, -1))
            return k == 0 or ends[k - 1] <= a

        return free

    unused = clear_of(taken)
    identifiers = [m.span() for m in IDENTIFIER.finditer(text) if unused(*m.span())]
    access = [(a, b) for kind, a, b in base if kind == "access"]
    if not identifiers and not access:
        return []
    endpoints = [m.span() for m in ENDPOINT.finditer(text) if unused(*m.span())]
    unnamed = clear_of(sorted(taken + identifiers + endpoints))
    opaque = [m.span() for m in OPAQUE.finditer(text) if _opaque(m[0]) and unnamed(*m.span())]
    secrets = [(a, b) for kind, a, b in base if kind != "access"] + opaque
    if not secrets:
        return []
    breaks = [m.start() for m in PARAGRAPH.finditer(text)]

    def near(part: tuple[int, int], others: list[tuple[int, int]], ends: list[int]) -> bool:
        """Interval join: the other, by its whole span, reaches the part's interval in its paragraph.

        ``others`` are sorted, ``ends`` their largest end so far; no part crosses a blank line.
        """
        place = bisect_right(breaks, part[0])
        low = max(part[0] - reach, breaks[place - 1] + 1 if place else 0)
        high = min(part[1] + reach, breaks[place] if place < len(breaks) else len(text))
        k = bisect_left(others, (high, -1))
        return k > 0 and ends[k - 1] >= low

    known = sorted(identifiers + access)
    secrets.sort()
    name = known, list(accumulate((b for _, b in known), max))
    secret = secrets, list(accumulate((b for _, b in secrets), max))
    out = [("identifier", *p) for p in identifiers if near(p, *secret)]
    out += [("opaque", *p) for p in opaque if near(p, *name)]
    return out + [("endpoint", *p) for p in endpoints if near(p, *name) and near(p, *secret)]


def spans_of(text: str, reach: int = REACH) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans, each by start and then kind."""
    def order(s):
        return s[1], KINDS.index(s[0]), s[2]

    base = sorted(base_spans(text), key=order)
    return base, sorted(base + linked_spans(text, base, reach), key=order)


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every run of overlapping spans replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def clean(texts: pd.Series) -> pd.Series:
    """Texts with the spans of ``scan`` replaced; null stays null."""
    column = pa.array(texts, pa.string(), from_pandas=True)
    maybe = pc.fill_null(pc.or_(pc.match_substring_regex(column, MAYBE), pc.match_substring_regex(column, MAYBE_HEX)), False).to_pylist()
    return pd.Series([redacted(t, spans_of(t)[1]) if m else t for t, m in zip(column.to_pylist(), maybe, strict=True)], dtype="object")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Spans of every whole text, in code points with exclusive ends.

    ``docs`` has doc_id and text; other columns are ignored. Returns one row per row:
    doc_id, spans (array of kind, start, end), n_base, base (the same for base spans
    alone) and clean_text (spans replaced; null where the text is null). No shuffle:
    a null text is empty and has no spans, null and repeated doc ids are passed on.
    """

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text")
                maybe = pc.or_(pc.match_substring_regex(texts, MAYBE), pc.match_substring_regex(texts, MAYBE_HEX)).to_pylist()
                found = [spans_of(t, reach) if m else ([], []) for t, m in zip(texts.to_pylist(), maybe, strict=True)]
                clean = [redacted(t, s[1]) if s[1] else t for t, s in zip(texts.to_pylist(), found, strict=True)]
                shaped = [[[dict(zip(("kind", "start", "end"), x, strict=True)) for x in pair[k]] for pair in found] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shaped[0], kind), pa.array(shaped[1], kind), pa.array(clean, pa.string())], ["doc_id", "base", "spans", "clean_text"])

    rows = text_rows(docs)
    span = "array<struct<kind: string, start: long, end: long>>"
    return rows.mapInArrow(scanned, f"doc_id long, base {span}, spans {span}, clean_text string")


def digests(found: DataFrame) -> DataFrame:
    """The counts and strings of a scan: kind:start:end, comma-joined."""
    def joined(name: str):
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
