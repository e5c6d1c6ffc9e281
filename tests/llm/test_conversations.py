"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from parcelflow.llm import conversation_repair as repair
from parcelflow.llm.queries import op13_conversation_repair

WS = " \t\n\x0b\f\r"


def cheapest(rows):
    """(cost, audit, repaired lines) of rows (role, text, fault), by plain search; ties by audit.

    ``made`` is the last initial there is: s only comes first, u after nothing, s or a, and a after u; nothing or a may end it.
    """

    @lru_cache(None)
    def best(i, made, inserted):
        options = []
        if i == len(rows) and made in ("", "a"):
            options.append((0, "", ()))
        after = {"": "us", "s": "u", "u": "a", "a": "u"}[made[-1:]]

        def then(cost, letter, i, initial, line, inserted):
            if initial not in after:
                return
            rest = best(i, initial, inserted)
            if rest:
                options.append((cost + rest[0], letter + rest[1], (line, *rest[2])))

        if inserted < 3:
            for role in ("user", "assistant"):
                then(2, "I", i, role[0], f"{role}:", inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            rest = best(i + 1, made, 0)
            if rest:
                options.append((3 + rest[0], "D" + rest[1], rest[2]))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                if role[:1] in ("s", "u", "a") and role:
                    then(more, "K", i + 1, role[0], f"{role}:{text}", 0)
                for new in ("user", "assistant"):
                    then(2 + more, "R", i + 1, new[0], f"{new}:{text}", 0)
        return min(options, default=None)

    for i in range(len(rows), 0, -1):  # from the end, so that calls do not nest deep
        for made in ("", *"sua"):
            best(i, made, 0)
    found = best(0, "", 0)
    assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in found[2]))
    return found


def plain(conversations):
    out = {}
    for conv in dict.fromkeys(r[0] for r in conversations):
        rows = []
        for _, turn, role, text in (r for r in conversations if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, judged = set(), []
        for _, role, text in rows:
            left = text.rstrip(WS)
            judged.append((role, text, "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        count = lambda fault: sum(f == fault for _, _, f in judged)  # noqa: E731, B023
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest(tuple(judged))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, audit string, n int"


def got(df, **kw):
    rows = repair.repaired(df, **kw).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, conversations=60):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "cut", "  ", "", None, "Line. \n", "a.b", "Wer?\x0b"]
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(r.randrange(0, 14)):
            turn = None if r.random() < 0.05 else turn + r.randrange(3)
            text = r.choice(texts) if r.random() < 0.4 else f"{r.random()}{r.choice('.!? x')}"
            rows.append((conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u2"]), text))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("part_rows", [3, repair.PART_ROWS])
def test_equals_plain_search(spark, seed, part_rows):
    rows = made(seed)
    assert got(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), part_rows=part_rows) == plain(rows)


def test_one_long_conversation_over_many_parts(spark):
    """Most rows are of one conversation, and many of these are the same; it is cut into parts in several tasks."""
    r = random.Random(5)
    long = next(c for c in range(3, 99) if zlib.crc32(f"{c}: ".encode()) % 20 > 4)
    rows = [(long, t if t % 50 else None, r.choice(["user", "assistant", "user", "assistant", "system"]), f"t{t // r.choice([1, 1, 9])}{r.choice('.!x')}") for t in range(900)]
    rows += [(long, None, "user", "again.")] * 300 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    want = plain(rows)
    assert got(spark.createDataFrame([(*x, "x", 1) for x in rows], SCHEMA), part_rows=64) == want
    assert len(want[long][6]) >= 1000


def test_query_equals_plain_search(spark, tiny):
    rows = [tuple(r) for r in spark.read.parquet(f"{tiny}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, tiny).collect()} == plain(rows)


def test_nothing_left(spark):
    """A conversation whose rows are all dropped is there with zeros; an empty table gives none."""
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    none = hashlib.sha256(b"").hexdigest()
    assert got(spark.createDataFrame([(7, gone, "user", "Hi.", "x", 1)], SCHEMA)) == {7: (0, 0, 0, 0, 0, 0, "", none)}
    assert got(spark.createDataFrame([], SCHEMA)) == {}


@pytest.mark.parametrize("block", [1, 2, 3, 5])
def test_block_tables_of_any_length(block):
    """Costs through block tables equal costs row by row, and so do the letters."""
    one, many, r = repair.BlockTables(1), repair.BlockTables(block), random.Random(block)
    assert len(many.vectors) < 200
    for _ in range(200):
        symbols = bytes(r.randrange(12) for _ in range(r.randrange(30)))
        cost = repair._END
        for s in reversed(symbols):
            cost = repair._before(s, cost)
        end = many.normal(list(repair._END))[0]
        bounds, total = many.costs(symbols, end)
        assert tuple(c + total for c in many.vectors[bounds[0]]) == cost
        assert many.trace(symbols, end, 0) == one.trace(symbols, one.normal(list(repair._END))[0], 0)
