"""Repair of conversations by the cheapest edits, found by bidirectional Dijkstra.

A conversation's rows, in order, are one letter each (role and fault). Its edit lattice
has a node for every row boundary and every state of the role grammar, and an edge for
every edit. A forward search from the first boundary and a reverse search from the last
one take turns; when the two frontiers cannot meet at a lower cost, all crossings of the
cheapest cost are finished and the least audit of them is taken. Searches run once per
distinct string of letters in a batch.

Conversations are cut into segments of bounded rows and bytes. One segment, as nearly all
have, is searched and rendered by itself. Of a longer conversation every segment gives
the cheapest edits between any two states; these tables are joined pairwise up a tree,
which is exact since costs add up and audits are appended.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from heapq import heappop, heappush
from operator import and_
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from matchlake.operators.scan import RANGE_ROWS, range_cuts, range_scan

from .common import small_batches, written

#: Rows and bytes of text of a segment (its last row may go beyond), and segments joined at a time.
SEGMENT_ROWS, SEGMENT_BYTES, FAN = 500, 4 << 20, 32

# What parts no words, and what ends a complete text.
SPACE, END = r"\x20\x09-\x0D", ".!?"
#: Pairs of role initials that may follow each other.
LEGAL = ("su", "ua", "au")

#: Costs of edits; a truncated row that stays costs ``TRUNCATED`` more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The grammar (s?(ua)+)?: states before anything, after a first s, after u, after a.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ROLES = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
STATES = range(len(STEP))


def _edges(code: str, state: int) -> Iterator[tuple[int, str, int]]:
    """Edits of a row of this letter at a state: (cost, letter of the audit, next state)."""
    yield DELETE, "D", state
    if code == "x":
        return
    more = TRUNCATED if code.isupper() else 0
    if code.lower() in STEP[state]:
        yield more, "K", STEP[state][code.lower()]
    yield REROLE + more, "R", STEP[state][ROLES[state][0]]


LETTERS = "suaoSUAOx"
_OUT = {(c, p): tuple(_edges(c, p)) for c in LETTERS for p in STATES}
_IN = {(c, q): tuple((w, e, p) for p in STATES for w, e, to in _OUT[c, p] if to == q) for c in LETTERS for q in STATES}
_INSERT_OUT = tuple(STEP[p][ROLES[p][0]] for p in STATES)
_INSERT_IN = tuple(tuple(p for p in STATES if _INSERT_OUT[p] == q) for q in STATES)


def cheapest(codes: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and ASCII-least audit from a state before the rows to one of some states after them.

    Edits of one row boundary to the next cost nothing at the least, inserts never do:
    popped by (cost, boundary), a node has all its equally cheap ways in, and two such
    ways are never each other's beginning, so the lesser one stays the lesser.
    """
    n = len(codes)
    ahead: dict = {(0, entry): (0, "")}
    back: dict = {(n, q): (0, "") for q in exits}
    heaps = [[(0, 0, entry)], [(0, -n, q) for q in exits]]
    done: tuple[set, set] = (set(), set())
    best: tuple[int, str] | None = None

    def out(i: int, p: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
        if i < n:
            for w, letter, q in _OUT[codes[i], p]:
                yield w, letter, (i + 1, q)
        yield INSERT, "I", (i, _INSERT_OUT[p])

    def into(i: int, q: int) -> Iterator[tuple[int, str, tuple[int, int]]]:
        if i:
            for w, letter, p in _IN[codes[i - 1], q]:
                yield w, letter, (i - 1, p)
        for p in _INSERT_IN[q]:
            yield INSERT, "I", (i, p)

    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best[0]):
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, at, state = heappop(heaps[side])
        node = (abs(at), state)
        if node in done[side]:
            continue
        done[side].add(node)
        labels, others = (ahead, back) if side == 0 else (back, ahead)
        audit = labels[node][1]
        crossings = [(cost, audit, node)] if node in done[1 - side] else []
        for w, letter, other in (out if side == 0 else into)(*node):
            label = (cost + w, audit + letter if side == 0 else letter + audit)
            if other in done[1 - side]:
                crossings.append((*label, other))
            if other not in done[side] and (other not in labels or label < labels[other]):
                if other not in labels or label[0] < labels[other][0]:
                    heappush(heaps[side], (label[0], other[0] if side == 0 else -other[0], other[1]))
                labels[other] = label
        for spent, half, meeting in crossings:
            total = spent + others[meeting][0]
            if best is None or total <= best[0]:
                whole = half + others[meeting][1] if side == 0 else others[meeting][1] + half
                best = min(best, (total, whole)) if best else (total, whole)
    return best


def steps(codes: str, entry: int, audit: str) -> tuple[list[tuple[str, str | None]], str]:
    """Per row the lines inserted before it and its new role ('' as it is, None deleted), and lines at the end."""
    state, before, out = entry, "", []
    for letter in audit:
        if letter == "I":
            before += ROLES[state] + ":\n"
            state = _INSERT_OUT[state]
            continue
        out.append((before, {"D": None, "K": ""}.get(letter, ROLES[state])))
        if letter != "D":
            state = STEP[state][codes[len(out) - 1].lower()] if letter == "K" else _INSERT_OUT[state]
        before = ""
    return out, before


STEPS = pa.list_(pa.struct([("before", pa.string()), ("role", pa.string())]))
SOLVED = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("steps", STEPS), ("tail", pa.string())])
PIECE = pa.struct([("segment", pa.int64()), ("entry", pa.int8()), ("audit", pa.string())])
WAYS = pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("pieces", pa.list_(PIECE))]))
PLAN = pa.struct([("steps", STEPS), ("tail", pa.string())])

def _plan(codes: str, entry: int, audit: str) -> dict:
    listed, tail = steps(codes, entry, audit)
    return {"steps": [{"before": b, "role": r} for b, r in listed], "tail": tail}


@F.arrow_udf(from_arrow_type(SOLVED))
def _solved(codes: pa.Array) -> pa.Array:
    """The cheapest repair of whole conversations."""
    known = {}
    for c in codes.unique().to_pylist():
        cost, audit = cheapest(c, 0, ACCEPTED)
        known[c] = {"cost": cost, "audit": audit, **_plan(c, 0, audit)}
    return pa.array([known[c] for c in codes.to_pylist()], SOLVED)


@F.arrow_udf(from_arrow_type(WAYS))
def _ways(codes: pa.Array, segment: pa.Array) -> pa.Array:
    """The cheapest edits of a segment from every state before it to every state after it."""
    known, out = {}, []
    for c in codes.unique().to_pylist():
        known[c] = [(p, q, way) for p in STATES for q in STATES if (way := cheapest(c, p, (q,)))]
    for c, k in zip(codes.to_pylist(), segment.to_pylist(), strict=True):
        out.append([{"p": p, "q": q, "cost": cost, "pieces": [{"segment": k, "entry": p, "audit": audit}]} for p, q, (cost, audit) in known[c]])
    return pa.array(out, WAYS)


@F.arrow_udf(from_arrow_type(WAYS))
def _joined(tables: pa.Array) -> pa.Array:
    """One table of ways from those of segments that follow each other."""
    out = []
    for row in tables.to_pylist():
        whole = None
        for table in row:
            now = {(w["p"], w["q"]): (w["cost"], "".join(x["audit"] for x in w["pieces"]), w["pieces"]) for w in table}
            if whole is not None:
                both: dict = {}
                for (p, m), (cost, audit, pieces) in whole.items():
                    for q in STATES:
                        if (m, q) in now:
                            more, rest, last = now[m, q]
                            way = (cost + more, audit + rest, pieces + last)
                            if (p, q) not in both or way[:2] < both[p, q][:2]:
                                both[p, q] = way
                now = both
            whole = now
        out.append([{"p": p, "q": q, "cost": w[0], "pieces": w[2]} for (p, q), w in sorted(whole.items())])
    return pa.array(out, WAYS)


@F.arrow_udf(from_arrow_type(PLAN))
def _planned(codes: pa.Array, entry: pa.Array, audit: pa.Array) -> pa.Array:
    rows = zip(codes.to_pylist(), entry.to_pylist(), audit.to_pylist(), strict=True)
    return pa.array([_plan(*r) for r in rows], PLAN)


def _text(steps: Column, tail: Column) -> Column:
    """The repaired lines of a segment, each with its newline, from its rows and steps."""

    def line(row: Column, step: Column) -> Column:
        role = F.when(step["role"] == "", row["role"]).otherwise(step["role"])
        own = F.when(step["role"].isNull(), F.lit("")).otherwise(F.concat(role, F.lit(":"), row["text"], F.lit("\n")))
        return F.concat(step["before"], own)

    return F.concat(F.array_join(F.zip_with("rows", steps, line), ""), tail)


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which a null key is a key like any other."""
    named = right.withColumnsRenamed({c: f"__{c}" for c in keys})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
    return left.join(named, same, how).drop(*(f"__{c}" for c in keys))


def _digests(pieces: DataFrame) -> DataFrame:
    """sha256 of each conversation's text; a task streams over segments and holds one batch of them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_line = object(), None, False
        for batch in batches:
            ids, digests = [], []
            for name, text in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if name != now:
                    if state:
                        ids.append(now)
                        digests.append(state.hexdigest())
                    now, state, open_line = name, hashlib.sha256(), False
                if text:
                    # The newline that ends the text's last line is not part of it.
                    state.update((b"\n" if open_line else b"") + text[:-1].encode())
                    open_line = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("conv_id").type), pa.array(digests, pa.string())], ["conv_id", "repaired_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], batch.column("conv_id").type), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    kind = pieces.schema["conv_id"].dataType.simpleString()
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.select("conv_id", "text").mapInArrow(hashed, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage that depends on conversation and turn alone; a null is one space."""
    marks = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.encode(F.concat(marks[0], F.lit(":"), marks[1]), "UTF-8")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    worse = F.when(fault == 1, F.lit("")).when(fault == 2, F.translate(text, END, "")).otherwise(text)
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = conversations.where(fault != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(fault == 4, F.lit("user")).otherwise(role).alias("role"), worse.alias("text"), F.explode(times).alias("copy")
    )
    return rows.drop("copy")


class Repaired(NamedTuple):
    #: One row per conversation: counts of faults, cost, audit and digest.
    summary: DataFrame
    #: conv_id, segment and the text of its repaired lines, each ended by a newline.
    pieces: DataFrame


def segments(rows: DataFrame, most: int, segment_rows: int, segment_bytes: int) -> DataFrame:
    """Rows of each segment in order with their letters, and counts of faults.

    Segment numbers ascend with the rows; where a row is longer than a segment, some are left out.
    """
    order = ["turn", "role", "text"]
    limit = most if range_cuts(rows, ["conv_id"], order, most) is not None else None
    marked = rows.withColumns(
        {
            "bytes": F.octet_length("text").cast("long"),
            "initial": F.substring("role", 1, 1),
            # Stands for role and text; two of them share it by chance once in 2^128.
            "said": F.md5(F.encode(F.concat("role", F.lit("\0"), "text"), "UTF-8")),
        }
    )
    wanted = {"position": ("count", None), "through": ("sum", "bytes"), "before": ("lag", "initial"), "turn_before": ("lag", "turn"), "is_end": ("is_last", None)}
    scanned = range_scan(marked, ["conv_id"], order, wanted, limit)
    scanned = range_scan(scanned, ["conv_id", "said"], ["position"], {"times": ("count", None)}, limit)
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    again = ~F.col("blank") & (F.col("times") > 1)
    whole = F.col("text").rlike(f"[{END}][{SPACE}]*\\z")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise(F.lit("o"))
    rows = scanned.withColumn("blank", blank).withColumn("again", again).withColumn("truncated", ~F.col("blank") & ~F.col("again") & ~whole)
    code = F.when(F.col("blank") | F.col("again"), F.lit("x")).when(F.col("truncated"), F.upper(letter)).otherwise(letter)
    follows = F.col("before").isNotNull() & ~F.concat("before", "initial").isin(*LEGAL)
    segment = F.floor((F.col("position") - 1) / segment_rows) + F.floor(F.col("through") / segment_bytes)
    count = lambda c: F.sum(c.cast("long"))
    held = rows.groupBy("conv_id", segment.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct("position", "role", "text", code.alias("code")))).alias("rows"),
        F.bool_or("is_end").alias("has_end"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        count(F.col("turn").isNotNull() & ~F.coalesce(F.col("turn") == F.col("turn_before"), F.lit(False))).alias("turns"),
        count(F.col("blank")).alias("blank"),
        count(F.col("again")).alias("duplicate"),
        count(F.col("truncated")).alias("truncated"),
        count(follows).alias("illegal"),
    )
    return held.withColumn("codes", F.array_join(F.transform("rows", lambda r: r["code"]), ""))


def repair(conversations: DataFrame, damage: bool = False, most: int = RANGE_ROWS, segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES, fan: int = FAN) -> Repaired:
    """Repairs conversations so that role initials read (s?(ua)+)?, by the cheapest edits.

    ``conversations`` has conv_id, turn, role and text; other columns are ignored. Rows
    of a conversation come by turn, nulls first, then role and text. Null texts and roles
    are one space; rows without conv_id are one conversation. A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated. Edits: keep (K), rerole to
    user or assistant (R), delete (D, the only one for blank and duplicate rows), insert
    an empty user or assistant (I). With ``damage`` rows are damaged first, and
    conversations that lose all their rows have zeros, an empty audit and the digest of
    nothing. An empty table gives no rows. A conversation's own audit and the ways of one
    join of its tables are held by a task, never its texts.
    """
    small_batches(conversations.sparkSession)
    rows = damaged(conversations) if damage else conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    held = written(segments(rows, most, segment_rows, segment_bytes), "segments")
    counts = ["blank", "duplicate", "truncated", "illegal"]
    facts = held.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in counts)
    )
    alone = (F.col("segment") == 0) & F.col("has_end")
    one = held.where(alone).withColumn("way", _solved("codes"))
    short = written(one.select("conv_id", "segment", F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"), _text(F.col("way.steps"), F.col("way.tail")).alias("text")), "short")
    digest = F.sha2(F.encode(F.expr("left(text, greatest(0, length(text) - 1))"), "UTF-8"), 256)
    solved = short.select("conv_id", "cost", "audit", digest.alias("repaired_sha256"))
    pieces = short.select("conv_id", "segment", "text")
    longer = held.where(~alone)
    if not longer.isEmpty():
        ways = written(longer.select("conv_id", "segment", _ways("codes", "segment").alias("ways")), "ways")
        last = ways.agg(F.max("segment")).first()[0]
        while True:
            lined = ways.groupBy("conv_id", F.floor(F.col("segment") / fan).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("segment", "ways"))).alias("tables"))
            ways = written(lined.select("conv_id", "segment", _joined(F.transform("tables", lambda t: t["ways"])).alias("ways")), "ways")
            last //= fan
            if not last:
                break
        accepted = F.filter("ways", lambda w: (w["p"] == 0) & w["q"].isin(*ACCEPTED))
        audit = lambda w: F.array_join(F.transform(w["pieces"], lambda x: x["audit"]), "")
        least = F.array_min(F.transform(accepted, lambda w: F.struct(w["cost"].alias("cost"), audit(w).alias("audit"), w["pieces"].alias("pieces"))))
        chosen = written(ways.select("conv_id", least.alias("way")).select("conv_id", "way.*"), "chosen")
        asked = chosen.select("conv_id", F.explode("pieces").alias("piece")).select("conv_id", "piece.*")
        joined = _matched(longer, asked, ["conv_id", "segment"]).withColumn("plan", _planned("codes", "entry", "audit"))
        parts = written(joined.select("conv_id", "segment", _text(F.col("plan.steps"), F.col("plan.tail")).alias("text")), "pieces")
        pieces = pieces.unionByName(parts)
        solved = solved.unionByName(_matched(chosen.select("conv_id", "cost", "audit"), _digests(parts), ["conv_id"]))
    names = conversations.select("conv_id").distinct()
    found = _matched(names, _matched(facts, solved, ["conv_id"]), ["conv_id"], "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *counts, "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    summary = found.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
    return Repaired(summary, pieces)
