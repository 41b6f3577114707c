"""Audit and repair of conversations' structure: faults of turns, and the cheapest edits after which roles alternate.

A repaired conversation is empty or an optional system turn with pairs of user and assistant after it. Edits run over the
turns in order: Keep, Rerole, Delete, Insert. For each turn and state of this pattern the cheapest edits are kept, and of
several the least text of their initials. Edits are linked nodes that share their prefixes; two texts of one cost are compared by
ancestors at powers of two whose rolling hashes tell where they part, and the part that they should share is verified
letter by letter, up to what is verified before. Texts of one cost over the same turns are never prefixes of each other, so the order of two
prefixes holds for all that follows, and tables from state to state of consecutive segments can be chained.

A conversation is dealt out in segments of 4,096 turns, of which only one letter a turn is collected; a last pass chains the
segments' tables, and only that pass and the digest see one conversation in one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventpulse.operators.numbering import numbered

from .storage import saved
from .wordblocks import released

SEGMENT = 4096
#: States: nothing yet, after a system turn, after a user's, after an assistant's.
STATES, ACCEPTING = 4, (0, 3)
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED_COST = 1
#: A turn's letter: its role's place in ROLES plus 4 for one that must go, 8 for a truncated one.
ROLES, LETTERS = "sua", "ABCDEFGHIJKL"
LEGAL = {"su", "ua", "au"}
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687
_REMEMBERED, _MOST_REMEMBERED = 64, 200_000


class Audits:
    """Texts of edits as linked nodes; node 0 is the empty one."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [(0,)]
        self.verified: set[tuple[int, int]] = set()

    def add(self, node: int, letter: str) -> int:
        new, ups, at = len(self.letter), [node], 1
        while len(self.up[ups[-1]]) >= at and ups[-1]:
            ups.append(self.up[ups[-1]][at - 1])
            at += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        self.up.append(tuple(ups))
        return new

    def ancestor(self, node: int, depth: int) -> int:
        above = self.depth[node] - depth
        j = 0
        while above:
            if above & 1:
                node = self.up[node][j]
            above >>= 1
            j += 1
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def _same(self, a: int, b: int) -> bool:
        """Whether two nodes of one depth and hash spell the same text."""
        first = (a, b)
        while a != b and (a, b) not in self.verified:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        self.verified.add(first)
        return True

    def less(self, x: int, y: int) -> bool:
        """Whether x's text comes before y's."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            return self.depth[x] < self.depth[y] if self._same(a, b) else self.text(x) < self.text(y)
        for j in reversed(range(len(self.up[a]))):
            if j < len(self.up[a]) and j < len(self.up[b]) and self.hash[self.up[a][j]] != self.hash[self.up[b][j]]:
                a, b = self.up[a][j], self.up[b][j]
        if self._same(self.up[a][0], self.up[b][0]):
            return self.letter[a] < self.letter[b]
        return self.text(x) < self.text(y)


def _better(audits: Audits, best: list, state: int, cost: int, parent: int, letter: str) -> None:
    now = best[state]
    if now is None or cost < now[0]:
        best[state] = (cost, audits.add(parent, letter))
    elif cost == now[0]:
        node = audits.add(parent, letter)
        if audits.less(node, now[1]):
            best[state] = (cost, node)


def _inserted(audits: Audits, best: list) -> None:
    """Inserts at one place: a user's turn where one may stand, then an assistant's."""
    for state in (0, 1, 3):
        if best[state] is not None:
            _better(audits, best, 2, best[state][0] + COST[INSERT], best[state][1], INSERT)
    if best[2] is not None:
        _better(audits, best, 3, best[2][0] + COST[INSERT], best[2][1], INSERT)


def edits(letters: str, entry: int, opening: bool) -> list[tuple[int, str] | None]:
    """For each state after the turns, from the entry state before them: the least (cost, initials), None if it can't be reached.
    Inserts before the first turn belong to the turns before it, but for those that open a conversation."""
    audits = Audits()
    best: list = [None] * STATES
    best[entry] = (0, 0)
    if opening:
        _inserted(audits, best)
    for letter in letters:
        fault, role = divmod(LETTERS.index(letter), 4)
        after: list = [None] * STATES
        for state, held in enumerate(best):
            if held is None:
                continue
            cost, node = held
            _better(audits, after, state, cost + COST[DELETE], node, DELETE)
            if fault == 1:
                continue
            more = TRUNCATED_COST if fault == 2 else 0
            if role < 3 and state in NEXT[ROLES[role]]:
                _better(audits, after, NEXT[ROLES[role]][state], cost + more + COST[KEEP], node, KEEP)
            for wanted in "ua":
                if state in NEXT[wanted]:
                    _better(audits, after, NEXT[wanted][state], cost + more + COST[REROLE], node, REROLE)
        best = after
        _inserted(audits, best)
    return [None if held is None else (held[0], audits.text(held[1])) for held in best]


class Chain:
    """Tables of consecutive segments, one after the other. Of each state: cost and linked pieces; of each two states, which
    text comes first, or what each has beyond their common beginning where one is a prefix of the other."""

    def __init__(self):
        self.held: list = [(0, None), None, None, None]
        self.order: dict[tuple[int, int], int | tuple[str, str]] = {}

    def _compared(self, x: tuple[int, str], y: tuple[int, str]) -> int | tuple[str, str]:
        """Order of two texts, each given by the state before the last piece and that piece."""
        known = ("", "") if x[0] == y[0] else self.order[x[0], y[0]]
        if isinstance(known, int):
            return known
        a, b = known[0] + x[1], known[1] + y[1]
        short = min(len(a), len(b))
        if a[:short] == b[:short]:
            return a[short:], b[short:]
        return -1 if a < b else 1

    def add(self, table: list[list[tuple[int, str] | None]]) -> None:
        """table[entry][exit]."""
        best: list = [None] * STATES
        for state in range(STATES):
            for entry, held in enumerate(self.held):
                if held is None or table[entry][state] is None:
                    continue
                more, piece = table[entry][state]
                cost = held[0] + more
                if best[state] is None or cost < best[state][0]:
                    best[state] = (cost, (entry, piece))
                elif cost == best[state][0]:
                    first = self._compared((entry, piece), best[state][1])
                    if first == -1 or isinstance(first, tuple) and len(first[0]) < len(first[1]):
                        best[state] = (cost, (entry, piece))
        alive = [s for s in range(STATES) if best[s] is not None]
        self.order = {(p, q): self._compared(best[p][1], best[q][1]) for p in alive for q in alive if p != q}
        self.held = [None if b is None else (b[0], (self.held[b[1][0]][1], b[1][1])) for b in best]

    def result(self) -> tuple[int, str]:
        """(cost, initials) of the cheapest edits to the end."""
        least = None
        for state in ACCEPTING:
            held = self.held[state]
            if held is None:
                continue
            if least is None or held[0] < self.held[least][0] or held[0] == self.held[least][0] and self.order[state, least] == -1:
                least = state
        cost, link = self.held[least]
        pieces = []
        while link is not None:
            link, piece = link
            pieces.append(piece)
        return cost, "".join(reversed(pieces))


_TABLES: dict[tuple[str, bool], tuple[list[int], list[str]]] = {}


def _table_of(letters: str, opening: bool) -> tuple[list[int], list[str]]:
    """Costs (-1: not reached) and initials for all entries and exits; an opening segment has one entry."""
    key = (letters, opening)
    if key in _TABLES:
        return _TABLES[key]
    found = [edits(letters, entry, opening) if entry == 0 or not opening else [None] * STATES for entry in range(STATES)]
    flat = [cell for row in found for cell in row]
    out = [-1 if c is None else c[0] for c in flat], ["" if c is None else c[1] for c in flat]
    if len(letters) <= _REMEMBERED:
        if len(_TABLES) >= _MOST_REMEMBERED:
            _TABLES.clear()
        _TABLES[key] = out
    return out


def _initials(letters: str) -> str:
    return "".join((ROLES + "?")[LETTERS.index(x) % 4] for x in letters)


def _segment_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conversation, segment, letters) to tables; 200 rows at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            costs, audits, illegal, ends = [], [], [], []
            for segment, letters in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                c, a = _table_of(letters, segment == 0)
                costs.append(c)
                audits.append(a)
                roles = _initials(letters)
                illegal.append(sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1)))
                ends.append(roles[0] + roles[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string())), pa.array(illegal, pa.int64()), pa.array(ends, pa.string())],
                names=["conversation", "segment", "costs", "audits", "illegal", "ends"],
            )


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of conversation and number to one row a conversation."""
    names, current, kind = ["conversation", "illegal", "cost", "audit"], None, None

    def row():
        cost, audit = chain.result()
        return pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([illegal], pa.int64()), pa.array([cost], pa.int64()), pa.array([audit], pa.string())], names=names)

    ready: list[pa.RecordBatch] = []
    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            conversation, _, costs, audits, inner, ends = (batch.column(c)[i].as_py() for c in range(6))
            if current is None or current[0] != conversation:
                if current is not None:
                    ready.append(row())
                current, chain, illegal, last = (conversation,), Chain(), 0, ""
            cells = [None if c < 0 else (c, a) for c, a in zip(costs, audits, strict=True)]
            chain.add([cells[STATES * e : STATES * (e + 1)] for e in range(STATES)])
            illegal += inner + (bool(last) and last + ends[0] not in LEGAL)
            last = ends[1]
        if ready:
            yield from _joined_batches(ready)
            ready = []
    if current is not None:
        yield from _joined_batches([*ready, row()])


def _joined_batches(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conversation, audit) to one row for each turn that stays or is inserted: its place, its position before (null if
    inserted) and its new role (null if kept). Roles follow from the number of turns: an odd one opens with a system turn."""
    for batch in batches:
        for i, audit in enumerate(batch.column(1).to_pylist()):
            letters = np.frombuffer(audit.encode(), np.uint8)
            stays = letters != ord(DELETE)
            kept, many = letters[stays], int(stays.sum())
            position = np.cumsum(letters != ord(INSERT))[stays]
            role = np.where((np.arange(many) - many % 2) % 2 == 0, "user", "assistant")
            for at in range(0, many, SEGMENT):
                part = slice(at, at + SEGMENT)
                n = len(kept[part])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1).take(pa.array(np.zeros(n, np.int64))), pa.array(np.arange(at + 1, at + n + 1)), pa.array(position[part].astype(np.int64), mask=kept[part] == ord(INSERT)),
                        pa.array(role[part].tolist(), pa.string(), mask=kept[part] == ord(KEEP)),
                    ],
                    names=["_conversation", "place", "_position", "_role"],
                )


@dataclass
class Repair:
    """audits: a row a conversation with gaps, blank, duplicate, truncated, illegal, cost, audit; turns: the repaired turns
    (conversation, place from 1, role, text)."""

    audits: DataFrame
    turns: DataFrame


def _blank(text: str) -> Column:
    return ~F.col(text).rlike(r"[^\x20\x09-\x0D]")


def _truncated(text: str) -> Column:
    return ~F.col(text).rlike(r"[.!?][\x20\x09-\x0D]*\z")


def repair_conversations(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """Audits and repaired turns of all conversations of rows; columns are named as in rows.

    Turns stand in order of `turn` (nulls first), then role, then text. A turn's first fault counts: blank (nothing but white
    space), duplicate (role and text seen earlier in the conversation), truncated (the last other character isn't one of
    . ! ?). gaps: numbers missing between the least and largest turn. illegal: neighbours whose roles' initials are neither su,
    ua nor au. Blank and duplicate turns must be deleted, undeleted truncated ones cost 1 more. A null role or text counts
    as one space, a role without or with another initial can't be kept; a null conversation is one like others. Conversations without rows don't
    appear; an empty table gives empty results. Other columns are not read."""
    turns = rows.select(F.col(conversation).alias("_conversation"), F.col(turn).cast("long").alias("_turn"), F.coalesce(F.col(role), F.lit(" ")).alias("_role"), F.coalesce(F.col(text), F.lit(" ")).alias("_text"))
    turns = saved(numbered(turns, ["_conversation"], ["_turn", "_role", "_text"], "_position"))
    said = F.sha2(F.concat(F.length("_role").cast("string"), F.lit(":"), "_role", "_text"), 256)
    marks = turns.select("_conversation", "_turn", "_position", said.alias("_said"), F.instr(F.lit(ROLES), F.substring("_role", 1, 1)).alias("_at"), (F.length("_role") > 0).alias("_named"), _blank("_text").alias("_blank"), _truncated("_text").alias("_cut"))
    marks = saved(marks)
    first = marks.groupBy("_conversation", "_said").agg(F.min("_position").alias("_p")).select(F.col("_conversation").alias("_c"), "_p")
    faults = marks.join(first, (F.col("_position") == F.col("_p")) & F.col("_conversation").eqNullSafe(F.col("_c")), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_p").isNull(), "duplicate").when(F.col("_cut"), "truncated")
    of_role = F.when(F.col("_named") & (F.col("_at") > 0), F.col("_at") - 1).otherwise(3)
    code = of_role + F.when(F.col("_fault").isin("blank", "duplicate"), 4).when(F.col("_fault") == "truncated", 8).otherwise(0)
    faults = saved(faults.withColumn("_fault", fault).select("_conversation", "_turn", "_position", "_fault", F.substring(F.lit(LETTERS), code + 1, 1).alias("_letter")))
    kind = turns.schema["_conversation"].dataType.simpleString()
    segment = F.floor((F.col("_position") - 1) / SEGMENT).alias("segment")
    segments = faults.groupBy(F.col("_conversation").alias("conversation"), segment).agg(F.sort_array(F.collect_list(F.struct("_position", "_letter"))).alias("x"))
    segments = segments.select("conversation", "segment", F.array_join(F.transform("x", lambda x: x["_letter"]), "").alias("letters"))
    tables = segments.mapInArrow(released(_segment_tables), f"conversation {kind}, segment long, costs array<long>, audits array<string>, illegal long, ends string")
    chained = saved(tables.repartition("conversation").sortWithinPartitions("conversation", "segment").mapInArrow(released(_chained), f"conversation {kind}, illegal long, cost long, audit string"))
    counts = [F.count_if(F.col("_fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("_turn") - F.min("_turn") + 1 - F.count_distinct("_turn"), F.lit(0)).cast("long").alias("gaps")
    stats = faults.groupBy("_conversation").agg(gaps, *counts)
    audits = stats.join(chained, F.col("_conversation").eqNullSafe(F.col("conversation"))).select(F.col("_conversation").alias(conversation), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    steps = chained.select("conversation", "audit").mapInArrow(_edited, f"_conversation {kind}, place long, _position long, _role string")
    steps = steps.withColumnsRenamed({"_conversation": "_c", "_position": "_p", "_role": "_new"})
    repaired = steps.join(turns, (F.col("_p") == F.col("_position")) & F.col("_c").eqNullSafe(F.col("_conversation")), "left")
    repaired = repaired.select(F.col("_c").alias(conversation), "place", F.coalesce("_new", "_role").alias(role), F.coalesce("_text", F.lit("")).alias(text))
    return Repair(audits, repaired)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, digest, kind = None, None, None
    for batch in batches:
        kind = batch.schema.field(0).type
        done: list[tuple] = []
        for conversation, role, text in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
            if current is None or current[0] != conversation:
                if current is not None:
                    done.append((current[0], digest.hexdigest()))
                current, digest = (conversation,), hashlib.sha256(f"{role}:{text}".encode())
            else:
                digest.update(f"\n{role}:{text}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conversation", "sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current[0]], kind), pa.array([digest.hexdigest()])], names=["conversation", "sha256"])


def conversation_digests(turns: DataFrame) -> DataFrame:
    """(conversation, sha256) of repaired turns (conversation, place, role, text): lowercase hex over `role:text`, joined by line
    breaks in order of place. A digest is sequential: a conversation passes through one task, as a stream."""
    name = turns.columns[0]
    kind = turns.schema[name].dataType.simpleString()
    return turns.repartition(name).sortWithinPartitions(name, "place").mapInArrow(released(_digests), f"conversation {kind}, sha256 string")
