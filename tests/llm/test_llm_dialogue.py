"""Conversation repair against a plain pass from the end and against all edits of short conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchlake.llm import dialogue, queries

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit int, segment int"
NAMES = {"u": "user", "a": "assistant"}


def passed(rows):
    """(cost, audit, lines) of rows (role, text, fault): least of each suffix, from the last row back."""
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    rest = {s: (0, "", []) if s in ("", "a") else None for s in grammar}

    def inserted(rest):
        while True:
            new = dict(rest)
            for s, need in grammar.items():
                sym = need[-1]
                if new[sym]:
                    c, a, lines = new[sym]
                    way = (c + 3, "I" + a, [NAMES[sym] + ":", *lines])
                    if new[s] is None or way[:2] < new[s][:2]:
                        new[s] = way
            if new == rest:
                return rest
            rest = new

    rest = inserted(rest)
    for role, text, fault in reversed(rows):
        now = {}
        for s, need in grammar.items():
            ways = []
            if rest[s]:
                ways.append((rest[s][0] + 4, "D" + rest[s][1], rest[s][2]))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in need and rest[role[:1]]:
                    c, a, lines = rest[role[:1]]
                    ways.append((c + more, "K" + a, [f"{role}:{text}", *lines]))
                sym = need[-1]
                if rest[sym]:
                    c, a, lines = rest[sym]
                    ways.append((c + more + 3, "R" + a, [f"{NAMES[sym]}:{text}", *lines]))
            now[s] = min(ways, key=lambda w: w[:2], default=None)
        rest = inserted(now)
    return rest[""]


def brute(rows, damage=True):
    groups, names = defaultdict(list), set()
    for conv, turn, role, text in rows:
        names.add(conv)
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        groups[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv in names:
        ordered = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked, count = set(), [], defaultdict(int)
        for _, role, text in ordered:
            said = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        initials = [r[1][:1] for r in ordered]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [r[0] for r in ordered if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit, lines = passed(marked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, digest)
    return out


def found(summary):
    rows = summary.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@settings(max_examples=400, deadline=None)
@given(st.text("suaoSUAOx", max_size=14), st.sampled_from(range(4)), st.sampled_from([(0, 3), (0,), (1,), (2,), (3,)]))
def test_search_equals_a_pass_from_the_end(codes, entry, exits):
    rest = [(0, "") if q in exits else None for q in range(4)]

    def inserted(rest):
        for _ in range(4):
            for p in range(4):
                q = dialogue._INSERT_OUT[p]
                if rest[q] and (rest[p] is None or (rest[q][0] + 3, "I" + rest[q][1]) < rest[p]):
                    rest[p] = (rest[q][0] + 3, "I" + rest[q][1])
        return rest

    rest = inserted(rest)
    for code in reversed(codes):
        rest = inserted([min(((w + rest[q][0], letter + rest[q][1]) for w, letter, q in dialogue._OUT[code, p] if rest[q]), default=None) for p in range(4)])
    assert dialogue.cheapest(codes, entry, exits) == rest[entry]


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_search_equals_all_edits(n):
    """Every string of edits of short conversations, played on the grammar."""
    for codes in product("suaUox", repeat=n):
        best = (4 * n, "D" * n)
        for size in range(n, n + 4):
            for audit in product("DIKR", repeat=size):
                if sum(a != "I" for a in audit) != n:
                    continue
                state, at, cost = 0, 0, 0
                for a in audit:
                    if a == "I":
                        cost, state = cost + 3, {0: 2, 1: 2, 2: 3, 3: 2}[state]
                        continue
                    code, at = codes[at], at + 1
                    if a == "D":
                        cost += 4
                        continue
                    if code == "x":
                        cost = None
                        break
                    cost += 3 * code.isupper() + 3 * (a == "R")
                    own = code.lower() if a == "K" else "a" if state == 2 else "u"
                    state = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, own))
                    if state is None:
                        cost = None
                        break
                if cost is not None and state in (0, 3):
                    best = min(best, (cost, "".join(audit)))
        assert dialogue.cheapest("".join(codes), 0, (0, 3)) == best, codes


def conversations(rng, n, longest):
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "assistant", "user"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "no", "Why?\n ", " ", "", None, "Done!", "über. ", f"t{turn}.", f"t{turn}", f"{turn}?"])
            out.append((conv, turn + (conv % 3 == 1 and turn > 3), role, text))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)


ROWS = [
    *conversations(random.Random(4), 60, 9),
    *[(None, t, "user", f"{t}.") for t in range(4)], (70, None, "user", "a."), (70, None, "assistant", "b."), (71, None, None, None),
    *[(72, 5, "user", "same turn.")] * 3, (72, 5, "assistant", "x" * 3000), (73, 0, "system", "s."), (74, 10**12, "user", "late."), (74, 1, "system", "s."),
]


@pytest.mark.parametrize("damage", [True, False])
def test_rows(spark, damage):
    done = dialogue.repair(frame(spark, ROWS), damage=damage)
    assert found(done.summary) == brute(ROWS, damage)
    assert dialogue.repair(frame(spark, ROWS).limit(0), damage=damage).summary.count() == 0


def test_all_rows_lost(spark):
    gone = next((c, t) for c in range(1000) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    rows = [(*gone, "user", "a.")]
    want = {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert found(dialogue.repair(frame(spark, rows), damage=True).summary) == want == brute(rows)


@pytest.mark.parametrize("size,most,fan", [(7, 40, 2), (50, 1 << 20, 32)])
def test_long_conversations_over_segments(spark, size, most, fan):
    """Segments, ranges and the tree change nothing; some texts are longer than a segment."""
    rng = random.Random(9)
    rows = [(c % 7 + 100, t, r, text) for c, t, r, text in conversations(rng, 30, 12)]
    rows += [(1, t, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"{t}.", f"{t}", "again.", "", "y" * 300 + "."])) for t in range(150)]
    rows += [(None, t // 2, "assistant", f"{t}?") for t in range(60)]
    done = dialogue.repair(frame(spark, rows), damage=True, most=most, segment_rows=size, segment_bytes=250, fan=fan)
    want = brute(rows)
    assert found(done.summary) == want
    texts = defaultdict(list)
    for r in done.pieces.orderBy("segment").collect():
        texts[r.conv_id].append(r.text)
    for conv, parts in texts.items():
        assert hashlib.sha256("".join(parts)[:-1].encode()).hexdigest() == want[conv][-1]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.queries()["op11_conversation_repair"](spark, small)) == brute(rows)
