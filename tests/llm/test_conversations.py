"""Audits of conversations against trying all edits, against plain tables of texts, and the query against a plain program."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from eventpulse.llm import conversations as C
from eventpulse.llm.queries import _damaged, op13_conversation_repair

PATTERN = re.compile("(s?(ua)+)?")


def all_edits(rows):
    """(cost, initials) of the cheapest edits of (role, must go, truncated) by trying all."""
    best = None
    inserts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    choices = [[("D", "", 3)] + ([] if go else [("K", role, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]) for role, go, cut in rows]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        before = 2 * sum(map(len, gaps))
        if best is not None and before > best[0]:
            continue
        for chosen in itertools.product(*choices):
            cost = before + sum(c for _, _, c in chosen)
            if best is not None and cost > best[0]:
                continue
            roles = "".join("".join(g) + r for g, (_, r, _) in itertools.zip_longest(gaps, chosen, fillvalue=("", "", 0)))
            if PATTERN.fullmatch(roles):
                audit = "".join("I" * len(g) + e for g, (e, _, _) in itertools.zip_longest(gaps, chosen, fillvalue=("", "", 0)))
                best = min(best or (99, ""), (cost, audit))
    return best


def plain_edits(rows):
    """The same by a table of whole texts."""
    follow = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def least(cells, more=()):
        out = {}
        for state, value in [*cells, *more]:
            out[state] = min(out.get(state, value), value)
        return out

    def inserted(best):
        for _ in range(3):
            best = least(best.items(), [(follow[r, s], (c + 2, t + "I")) for s, (c, t) in best.items() for r in "ua" if (r, s) in follow])
        return best

    best = inserted({0: (0, "")})
    for role, go, cut in rows:
        after = [(s, (c + 3, t + "D")) for s, (c, t) in best.items()]
        if not go:
            after += [(follow[role, s], (c + cut, t + "K")) for s, (c, t) in best.items() if (role, s) in follow]
            after += [(follow[r, s], (c + 2 + cut, t + "R")) for s, (c, t) in best.items() for r in "ua" if (r, s) in follow]
        best = inserted(least(after))
    return min(v for s, v in best.items() if s in (0, 3))


def letters(rows):
    return "".join(C.LETTERS["sua?".index(r) + (4 if go else 8 if cut else 0)] for r, go, cut in rows)


def chained(text, size):
    chain = C.Chain()
    for at in range(0, len(text), size):
        costs, audits = C._table_of(text[at : at + size], at == 0)
        cells = [None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True)]
        chain.add([cells[4 * e : 4 * e + 4] for e in range(4)])
    return chain.result()


KINDS = [(r, go, cut) for r in "sua?" for go, cut in ((False, 0), (True, 0), (False, 1))]


def test_by_trying_all_edits():
    rng = random.Random(1)
    cases = [[a] for a in KINDS] + [[a, b] for a in KINDS for b in KINDS] + [[rng.choice(KINDS) for _ in range(3)] for _ in range(40)]
    for rows in cases:
        want = all_edits(rows)
        assert plain_edits(rows) == want, rows
        assert chained(letters(rows), 99) == want, rows
        assert chained(letters(rows), 1) == want, rows


def test_long_conversations_whole_and_in_segments():
    rng = random.Random(2)
    for n in [7, 20, 60, 150, 400]:
        for _ in range(12 if n < 150 else 3):
            kinds = rng.sample(KINDS, rng.randrange(1, 6))
            rows = [rng.choice(kinds) for _ in range(n)]
            want = plain_edits(rows)
            for size in (1, 3, 16, n):
                assert chained(letters(rows), size) == want, (rows, size)


def test_order_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(C, "_PRIME", 3)
    monkeypatch.setattr(C, "_TABLES", {})
    rng = random.Random(3)
    for _ in range(60):
        rows = [rng.choice(KINDS) for _ in range(30)]
        assert chained(letters(rows), 99) == plain_edits(rows)


def test_ancestors():
    audits, nodes = C.Audits(), [0]
    for i in range(300):
        nodes.append(audits.add(nodes[-1], "DIKR"[i % 4]))
    assert all(audits.ancestor(nodes[n], d) == nodes[d] for n in range(0, 301, 7) for d in range(n + 1))
    assert audits.text(nodes[9]) == "DIKRDIKRD"


def plain_query(rows):
    """The contract's columns from (conv_id, turn, role, text), by plain loops."""
    groups = {}
    for conv, turn, role, text in rows:
        out = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    result = set()
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        counts, seen, kinds = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in own:
            last = text.rstrip(" \t\n\v\f\r")[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            kinds.append((role[:1] if role[:1] in ("s", "u", "a") and role else "?", fault in ("blank", "duplicate"), int(fault == "truncated")))
        initials = [k[0] for k in kinds]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit = plain_edits(kinds)
        lines, at = [], 0
        many = sum(e != "D" for e in audit)
        for e in audit:
            place = len(lines)
            role = "user" if (place - many % 2) % 2 == 0 else "assistant"
            if e == "I":
                lines.append(f"{role}:")
            else:
                _, old, text = own[at]
                at += 1
                if e != "D":
                    lines.append(f"{old if e == 'K' else role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        result.add((conv, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return result


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def as_set(frame):
    rows = [tuple(r) for r in frame.select(*COLUMNS).collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_query_on_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_set(op13_conversation_repair(spark, small)) == plain_query(rows)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls everywhere, ties, repeats, gaps, strange roles, one conversation of many turns and a very long text."""
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "unknown", "Assistant"], ["Yes.", "No!", "why ", "", None, " \n\t", "Well?  ", "x" * 300_000, "é… fin.", "a:b\nc."]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *range(12), 40]), rng.choice(roles), rng.choice(texts)) for _ in range(600)]
    rows += [(99, i, "user" if i % 2 == 0 else "assistant", rng.choice(["Go on.", f"Turn {i}.", f"{i}", ""])) for i in range(9000)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, place string").repartition(5).write.parquet(f"{folder}/conversations.parquet")
    return folder, rows


def test_query_on_odd_conversations(spark, odd):
    folder, rows = odd
    assert as_set(op13_conversation_repair(spark, folder)) == plain_query(rows)


def test_repaired_turns(spark, odd):
    folder, _ = odd
    repair = C.repair_conversations(_damaged(spark.read.parquet(f"{folder}/conversations.parquet")))
    by_conversation = {}
    for r in repair.turns.select("conv_id", "place", "role").collect():
        by_conversation.setdefault(r.conv_id, {})[r.place] = r.role[:1]
    for places in by_conversation.values():
        assert sorted(places) == list(range(1, len(places) + 1))
        assert PATTERN.fullmatch("".join(places[p] for p in sorted(places)))
    assert repair.audits.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repair = C.repair_conversations(empty)
    assert repair.audits.count() == 0 and repair.turns.count() == 0
