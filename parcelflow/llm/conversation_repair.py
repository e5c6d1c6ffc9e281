"""Repair of conversation structure with Four-Russians block tables.

A conversation's role initials have to read ``(s?(ua)+)?``. Keeping a row costs 0, giving it the role user or assistant 2,
deleting it 3, inserting a row without text 2; a truncated row that is not deleted adds 1; blank and repeated rows must be deleted.
The cheapest edits come from a cost vector over the automaton's four states, row by row from the end. Less its smallest
entry such a vector is one of a few dozen, so what a block of BLOCK rows does to it is looked up in a table made beforehand for every
block of symbols and every vector. Only vectors between blocks are kept; edits are told from the start by expanding one
block at a time backward again and taking the smallest letter that is still cheapest, which is exact for ties.

Conversations of any length: rows are ordered by range over all tasks, which cuts a long conversation into parts of at most PART_ROWS distinct
rows. A part acts on cost vectors as a 4 x 4 matrix, so parts are solved side by side; only matrices and states, a row for each part,
are carried along a conversation. Texts stay out of all this: they meet the edits by key at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

BLOCK, PART_ROWS = 4, 16_384

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

_SPACE = " \t\n\x0b\f\r"
_INITIALS = "sua?"  # of symbols: 4 * fault + initial, where a fault is 0 none, 1 truncated, 2 must be deleted
_DEAD = 8  # all symbols from here on can only be deleted
_INF = 1 << 20

#: The automaton of ``(s?(ua)+)?``: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 may be the end.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that a state asks for next, and where it leads; a row may be given that role, or one be inserted.
_WANTED, _THEN = ("user", "user", "assistant", "user"), (2, 2, 3, 2)


def _inserts(cost: list[int]) -> tuple[int, ...]:
    """The costs when rows may be inserted first."""
    for _ in range(3):
        cost = [min(c, INSERT + cost[_THEN[q]]) for q, c in enumerate(cost)]
    return tuple(min(c, _INF) for c in cost)


_END = _inserts([0, _INF, _INF, 0])


def _moves(symbol: int, q: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of what may be done with a row in state ``q``, by letter."""
    yield "D", DELETE, q
    if symbol < _DEAD:
        more = TRUNCATED * (symbol // 4)
        then = _NEXT[q].get(_INITIALS[symbol % 4])
        if then is not None:
            yield "K", KEEP + more, then
        yield "R", REROLE + more, _THEN[q]


def _before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """The costs to the end from before a row, given those from after it."""
    return _inserts([min(cost + after[then] for _, cost, then in _moves(symbol, q)) for q in range(4)])


class BlockTables:
    """All normalised cost vectors, and what each block of ``block`` symbols makes of them."""

    symbols = _DEAD + 1

    def __init__(self, block: int = BLOCK):
        self.block = block
        units = [_inserts([0 if p == q else _INF for p in range(4)]) for q in range(4)]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for v in (_END, *units):
            self._add(v)
        one, off = [], []
        for v in self.vectors:  # grows meanwhile, until no symbol makes a new vector
            row = [self._add(_before(s, v)) for s in range(self.symbols)]
            one.append([n for n, _ in row])
            off.append([o for _, o in row])
        one, off = np.array(one, dtype=np.int32), np.array(off, dtype=np.int32)
        then, cost = np.arange(len(one), dtype=np.int32)[:, None], np.zeros((len(one), 1), dtype=np.int32)
        for _ in range(block):  # one more symbol before those that are there
            first, more = one[then].transpose(0, 2, 1), off[then].transpose(0, 2, 1)
            cost = (more + cost[:, None, :]).reshape(len(one), -1)
            then = first.reshape(len(one), -1)
        self.one, self.then, self.cost = one, then.tolist(), cost.tolist()
        self.one_off = off
        self.traced: dict[tuple[int, int, bytes], tuple[str, int]] = {}

    def _add(self, v: tuple[int, ...]) -> tuple[int, int]:
        """The number of a vector less its smallest entry, and that entry."""
        least = min(v)
        same = tuple(c - least if c < _INF else _INF for c in v)
        if same not in self.number:
            self.number[same] = len(self.vectors)
            self.vectors.append(same)
        return self.number[same], least

    def normal(self, v: list[int]) -> tuple[int, int]:
        n = self.number.get(tuple(c - min(v) if c < _INF else _INF for c in v))
        if n is None:
            raise ValueError("a cost vector that no conversation can have")
        return n, min(v)

    def _codes(self, symbols: bytes) -> list[int]:
        row = np.minimum(np.frombuffer(symbols, dtype=np.uint8), _DEAD).astype(np.int64)
        whole = row[: len(row) // self.block * self.block].reshape(-1, self.block)
        return (whole @ (self.symbols ** np.arange(self.block - 1, -1, -1))).tolist()

    def costs(self, symbols: bytes, after: int) -> tuple[list[int], int]:
        """The vectors at the beginnings of all blocks and at the end, block by block from the end, and the cost taken off."""
        whole = len(symbols) // self.block * self.block
        now, total = after, 0
        for s in reversed(symbols[whole:]):
            total += int(self.one_off[now][min(s, _DEAD)])
            now = int(self.one[now][min(s, _DEAD)])
        bounds = [now]
        for code in reversed(self._codes(symbols)):
            total += self.cost[now][code]
            now = self.then[now][code]
            bounds.append(now)
        return bounds[::-1], total

    def _expand(self, q: int, after: int, symbols: bytes) -> tuple[str, int]:
        """The least letters for some rows from state ``q``, tab after each row's, and the state after them."""
        known = self.traced.get((q, after, symbols))
        if known:
            return known
        inner = [self.vectors[after]]
        for s in reversed(symbols):
            inner.append(_before(s, inner[-1]))
        inner.reverse()
        out, state = [], q
        for i, s in enumerate(symbols):
            here, then = inner[i], inner[i + 1]
            while True:
                left = here[state]
                steps = [(letter, to) for letter, cost, to in _moves(s, state) if cost + then[to] == left]
                if here[_THEN[state]] + INSERT == left:
                    steps.append(("I", _THEN[state]))
                letter, state = min(steps)
                out.append(letter)
                if letter != "I":
                    break
            out.append("\t")
        found = "".join(out), state
        if len(self.traced) < 1 << 18:  # memory of the lookups, not a limit of the result
            self.traced[(q, after, symbols)] = found
        return found

    def trace(self, symbols: bytes, after: int, q: int) -> tuple[list[str], int]:
        """The letters for each row from state ``q``, where vector ``after`` follows, and the state after the last row."""
        bounds, _ = self.costs(symbols, after)
        out = []
        for k, then in enumerate(bounds[1:]):
            letters, q = self._expand(q, then, symbols[k * self.block : (k + 1) * self.block])
            out.append(letters)
        letters, q = self._expand(q, after, symbols[(len(bounds) - 1) * self.block :])
        out.append(letters)
        return "".join(out).split("\t")[:-1], q

    def matrix(self, symbols: bytes) -> list[int]:
        """Row q, column p: the least cost from state q before the rows to state p after them."""
        columns = []
        for p in range(4):
            unit, least = self.normal(list(_inserts([0 if p == r else _INF for r in range(4)])))
            bounds, total = self.costs(symbols, unit)
            columns.append([c + total + least if c < _INF else _INF for c in self.vectors[bounds[0]]])
        return [columns[p][q] for q in range(4) for p in range(4)]


@lru_cache(maxsize=1)
def tables() -> BlockTables:
    return BlockTables()


def _roles(letters: str, q: int) -> tuple[list[str], str | None, int]:
    """What some letters make of a row in state ``q``: roles inserted before it, its new role if it is given one, the next state.

    A kept row leads where its initial does; the caller knows it, so the state returned for K is -1.
    """
    before: list[str] = []
    for letter in letters:
        if letter == "I":
            before.append(_WANTED[q])
            q = _THEN[q]
        elif letter == "R":
            return before, _WANTED[q], _THEN[q]
        elif letter == "K":
            return before, None, -1
    return before, None, q


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage by the CRC-32 of ``conv_id:turn``, with their number of copies."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(F.col("conv_id")), F.lit(":"), blank(F.col("turn")))) % 20
    rows = conversations.select("conv_id", "turn", blank(F.col("role")).alias("role"), blank(F.col("text")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


_KEY = ["conv_id", "turn", "role", "digest"]


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which nulls are equal; ``right`` keeps only what the keys do not name."""
    renamed = right.withColumnsRenamed({k: f"its_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"its_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"its_{k}" for k in keys])


def _flagged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, truncated, again): rows that are the same in all are one, ``again`` if another turn had it before."""
    left = F.rtrim(F.col("text"), F.lit(_SPACE))
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "n", (left == "").alias("blank"), (~F.right(left, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    narrow = written(narrow.groupBy(*_KEY).agg(F.sum("n").alias("n"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")), "turns")
    turn = F.struct(F.col("turn").isNotNull().alias("there"), F.col("turn").alias("turn"))
    firsts = narrow.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("first"))
    return _met(narrow, firsts, ["conv_id", "role", "digest"]).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first.turn"))).drop("first")


_PART = "conv_id long, part long, symbols binary, illegal long, turns array<struct<turn:long,role:string,digest:binary,n:long>>"


def _parts(rows: int):
    """Parts of conversations, from rows in order: their symbols (a copy of a row is one more, to be deleted) and the rows' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, last = TaskContext.get().partitionId() << 32, None, None
        symbols, turns, illegal = bytearray(), [], 0

        def done() -> pa.RecordBatch:
            row = {"conv_id": [now[0]], "part": [part], "symbols": [bytes(symbols)], "illegal": [illegal], "turns": [turns]}
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("n", pa.int64())]))]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

        for batch in batches:
            for r in batch.to_pylist():
                if now is not None and (now[0] != r["conv_id"] or len(turns) == rows):
                    yield done()
                    part, last = part + 1, None  # between parts _afters looks
                    symbols, turns, illegal = bytearray(), [], 0
                now = (r["conv_id"],)
                initial = "sua".find(r["role"][:1]) if r["role"] else -1
                initial = 3 if initial < 0 else initial
                fault = 2 if r["blank"] or r["again"] else int(r["truncated"])
                illegal += (last is not None and not _legal(last, initial)) + (r["n"] - 1)  # a copy never has another initial before it
                symbols += bytes([4 * fault + initial]) + bytes([_DEAD + initial]) * (r["n"] - 1)
                turns.append({k: r[k] for k in ("turn", "role", "digest", "n")})
                last = initial
        if now is not None:
            yield done()

    return run


def _legal(a: int, b: int) -> bool:
    return _INITIALS[a] + _INITIALS[b] in ("su", "ua", "au")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        symbols = batch.column("symbols").to_pylist()
        columns = [batch.column("conv_id"), batch.column("part"), pa.array([tables().matrix(s) for s in symbols], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] % 4 for s in symbols], pa.int32()), pa.array([s[-1] % 4 for s in symbols], pa.int32())], names=["conv_id", "part", "matrix", "head", "tail"])


def _afters(parts: pd.DataFrame) -> pd.DataFrame:
    """Which vector follows each part of one conversation, and whether its first row is illegal after the part before."""
    parts = parts.sort_values("part", ignore_index=True)
    after, out = list(_END), []
    for m in reversed(parts["matrix"].tolist()):
        out.append(tables().normal(after)[0])
        after = [min(min(m[4 * q + p] + after[p] for p in range(4)), _INF) for q in range(4)]
    joint = [0, *(int(not _legal(a, b)) for a, b in zip(parts["tail"][:-1], parts["head"][1:], strict=True))]
    return pd.DataFrame({"conv_id": parts["conv_id"], "part": parts["part"], "after": out[::-1], "joint": joint})


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state after each part for every state before it."""
    for batch in batches:
        rows = zip(batch.column("symbols").to_pylist(), batch.column("after").to_pylist(), strict=True)
        to = [[tables().trace(s, after, q)[1] if tables().vectors[after][q] < _INF else q for q in range(4)] for s, after in rows]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "after", "joint")), pa.array(to, pa.list_(pa.int32()))], names=["conv_id", "part", "after", "joint", "to"])


def _entries(parts: pd.DataFrame) -> pd.DataFrame:
    """The state before each part of one conversation."""
    parts = parts.sort_values("part", ignore_index=True)
    state, out = 0, []
    for to in parts["to"].tolist():
        out.append(state)
        state = int(to[state])
    return pd.DataFrame({"conv_id": parts["conv_id"], "part": parts["part"], "after": parts["after"], "joint": parts["joint"], "state": out, "ends": parts.index == len(parts) - 1})


_SOLVED = "conv_id long, part long, audit string, cost long, illegal long, edits array<struct<at:long,turn:long,role:string,digest:binary,before:string,line:string>>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's letters, and for each row that stays or has rows inserted before it: the lines before it and its own role.

    The cost is what the letters cost; rows inserted after a conversation's last row belong to a row without key.
    """
    t = tables()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            alone = r["state"] is None
            q, after, symbols = (0, t.normal(list(_END))[0], r["symbols"]) if alone else (r["state"], r["after"], r["symbols"])
            letters, end = t.trace(symbols, after, q)
            tail = ""
            while (alone or r["ends"]) and end not in (0, 3):
                tail += "I"
                end = _THEN[end]
            edits, at, cost = [], 0, INSERT * len(tail)
            for turn in r["turns"]:
                for k in range(at, at + turn["n"]):
                    mine, s = letters[k], symbols[k]
                    before, role, then = _roles(mine, q)
                    kept = mine[-1] != "D"
                    cost += INSERT * len(before) + (DELETE if not kept else TRUNCATED * (s // 4) + (REROLE if mine[-1] == "R" else KEEP))
                    if kept or before:
                        line = (role or turn["role"]) if kept else None
                        edits.append({"at": k, "turn": turn["turn"], "role": turn["role"], "digest": turn["digest"], "before": "".join(f"{x}:\n" for x in before), "line": line})
                    q = _NEXT[_walked(before, q)][_INITIALS[s % 4]] if then < 0 else then
                at += turn["n"]
            if tail:
                more, _, q = _roles(tail, q)
                edits.append({"at": at, "turn": None, "role": None, "digest": None, "before": "".join(f"{x}:\n" for x in more), "line": None})
            out.append({"conv_id": r["conv_id"], "part": r["part"], "audit": "".join(letters) + tail, "cost": cost, "illegal": r["illegal"] + (r["joint"] or 0), "edits": edits})
        edit = pa.struct([("at", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary()), ("before", pa.string()), ("line", pa.string())])
        kinds = {"conv_id": pa.int64(), "part": pa.int64(), "audit": pa.string(), "cost": pa.int64(), "illegal": pa.int64(), "edits": pa.list_(edit)}
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in kinds.items()], names=list(kinds))


def _walked(before: list[str], q: int) -> int:
    for _ in before:
        q = _THEN[q]
    return q


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of conversations whose lines come in order; nothing but a hash's state is held."""
    now, h = None, None
    for batch in batches:
        ids, hexes = [], []
        for conv, before, line, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "before", "line", "text")), strict=True):
            if now != (conv,):
                if now is not None:
                    ids.append(now[0])
                    hexes.append(h.hexdigest())
                now, h = (conv,), hashlib.sha256()
                said = False
            lines = (before + ("" if line is None else f"{line}:{text}\n"))[:-1]
            h.update((("\n" if said else "") + lines).encode())
            said = True
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hexes, pa.string())], names=["conv_id", "repaired_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([h.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])


def solved(flagged: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """The edits of each part, in a written table."""
    ordered = flagged.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
    parts = written(ordered.mapInArrow(_parts(part_rows), _PART), "parts")
    long = parts.groupBy("conv_id").agg(F.count("*").alias("parts")).where("parts > 1")
    cut = _met(parts.select("conv_id", "part", "symbols"), long.drop("parts"), ["conv_id"], "left_semi")
    matrices = cut.mapInArrow(_matrices, "conv_id long, part long, matrix array<int>, head int, tail int")
    afters = written(matrices.groupBy("conv_id").applyInPandas(_afters, "conv_id long, part long, after int, joint int"), "afters")
    crossing = _met(cut, afters, ["conv_id", "part"]).mapInArrow(_crossings, "conv_id long, part long, after int, joint int, to array<int>")
    entries = crossing.groupBy("conv_id").applyInPandas(_entries, "conv_id long, part long, after int, joint int, state int, ends boolean")
    return written(_met(parts, entries, ["conv_id", "part"], "left").mapInArrow(_solve, _SOLVED), "solved")


def repaired_lines(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, part, at, before, line, text): what the repaired conversations read, in order of part and at.

    ``before``: lines inserted before, each with its end; ``line``: the role of the row itself, null if it is deleted.
    """
    texts = rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    texts = texts.groupBy(*_KEY).agg(F.first("text").alias("text"))
    each = edits.select("conv_id", "part", F.inline("edits"))
    return _met(each, texts, _KEY, "left")


def repaired(conversations: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged first.

    Nulls count as one space, so a null text is blank and a null role is never kept as it is; a null id is one conversation, a null turn comes first and is
    no part of gaps. Rows of one turn go by role and by the SHA-256 of the text; repeated rows are duplicates of the first. An empty
    table gives an empty one; other columns are ignored. ``audit`` is one string, so its length is that of a conversation.
    ``repaired_sha256`` reads a conversation's lines one after the other, as SHA-256 must; they are streamed, never gathered.
    """
    rows = damaged(conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text")))
    flagged = written(_flagged(rows), "flagged")
    edits = solved(flagged, part_rows)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    dead = F.col("blank") | F.col("again")
    copies = F.when(F.col("blank"), 0).when(F.col("again"), F.col("n")).otherwise(F.col("n") - 1)
    turns = flagged.groupBy("conv_id", "turn").agg(count(F.col("blank")).alias("blank"), F.sum(copies).alias("duplicate"), F.count(F.when(~dead & F.col("truncated"), 1)).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    found = turns.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    audits = edits.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_sort(F.collect_list(F.struct("part", "audit"))).alias("audits"))
    audits = audits.select("conv_id", "illegal", "cost", F.array_join("audits.audit", "").alias("audit"))
    lines = repaired_lines(rows, edits).repartition("conv_id").sortWithinPartitions("conv_id", "part", "at").select("conv_id", "before", "line", "text")
    hashes = lines.mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (found, audits, hashes):
        out = _met(out, more, ["conv_id"], "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
