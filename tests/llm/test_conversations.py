"""The search against trying every edit string, and against a table over (row, state) for long ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from retail_lake.llm import conversations as c

SHAPE = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\v\f\r"


def written(rows, letters):
    """Cost and (role, text) rows of an edit string, or None if it is none for these rows."""
    out, cost, left = [], 0, list(rows)
    for letter in letters:
        due = "assistant" if out and out[-1][0][:1] == "u" else "user"
        if letter == "I":
            out.append((due, ""))
            cost += 2
            continue
        if not left:
            return None
        role, text, fault = left.pop(0)
        if letter == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (fault == "truncated") + (2 if letter == "R" else 0)
        out.append((due if letter == "R" else role, text))
    if left or not SHAPE.fullmatch("".join(r[:1] or "?" for r, _ in out)):
        return None
    return cost, out


def tried(rows):
    best = None
    for n in range(len(rows) + 4):
        for letters in itertools.product("DIKR", repeat=n):
            if sum(x != "I" for x in letters) == len(rows) and (found := written(rows, letters)):
                way = (found[0], "".join(letters))
                best = min(best, way) if best else way
    return best


def tabled(rows):
    """Cheapest (cost, letters) by relaxing over (row, last role written), to a fixed point."""
    best = {(0, ""): (0, "")}
    for i in range(len(rows) + 1):
        changed = True
        while changed:
            changed = False
            for (j, last), (cost, letters) in list(best.items()):
                if j == i:
                    way, at = (cost + 2, letters + "I"), (i, "a" if last == "u" else "u")
                    if at not in best or way < best[at]:
                        best[at], changed = way, True
        if i == len(rows):
            break
        role, _, fault = rows[i]
        for last in ("", "s", "u", "a"):
            if (i, last) not in best:
                continue
            cost, letters = best[i, last]
            due = "a" if last == "u" else "u"
            moves = [("D", 3, last)]
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                moves.append(("R", 2 + more, due))
                if role[:1] == due or role[:1] == "s" and not last:
                    moves.append(("K", more, role[:1]))
            for letter, step, then in moves:
                way, at = (cost + step, letters + letter), (i + 1, then)
                if at not in best or way < best[at]:
                    best[at] = way
    return min(best[len(rows), last] for last in ("", "a") if (len(rows), last) in best)


def solved(rows):
    state = c.Repair()
    for role, text, fault in rows:
        state.add(None, role, text, fault)
    return state.result()


def draw_rows(draw, n):
    roles = ["user", "assistant", "system", "tool", ""]
    faults = [None, None, None, "blank", "duplicate", "truncated"]
    return [(draw.choices(roles, [5, 5, 2, 1, 1])[0], f"t{i}.", draw.choice(faults)) for i in range(n)]


def test_search_against_every_edit_string():
    draw = random.Random(5)
    for n in (0, 1, 2, 3, 4, 4, 4):
        for _ in range(6):
            rows = draw_rows(draw, n)
            assert solved(rows)[5:7] == tried(rows), rows


@pytest.mark.parametrize("stretch", [1, 3, 32, 1_000])
def test_stretches_do_not_change_the_answer(monkeypatch, stretch):
    monkeypatch.setattr(c, "STRETCH", stretch)
    draw = random.Random(11)
    for n in [5, 9, 14, 40] + [120] * (stretch == 32):
        for _ in range(8):
            rows = draw_rows(draw, n)
            got = solved(rows)
            assert got[5:7] == tabled(rows)
            cost, out = written(rows, got[6])
            assert got[7] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
            assert cost == got[5]


def plain(table):
    """What the query is to return, worked out conversation by conversation."""
    by_id = {}
    for conv, turn, role, text in table:
        rows = by_id.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, rows in by_id.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.strip(WHITE)
            fault = (
                "blank" if not bare
                else "duplicate" if (role, text) in seen
                else None if bare[-1] in ".!?"
                else "truncated"
            )
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        counts = [sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")]
        initials = [m[0][:1] or "?" for m in marked]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = tabled(marked)
        _, fixed = written(marked, audit)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query_over_odd_rows(spark):
    draw = random.Random(2)
    table = []
    for conv in [*range(60), None]:
        turns = [*range(draw.randint(1, 9)), None, 3, 3]
        for turn in turns:
            text = draw.choice(["Yes.", "Yes.", "no", "what?", "", None, " \x0b", "\xa0", "x" * 9_000 + ".", "é! \r\n"])
            table.append((conv, turn, draw.choice(["user", "assistant", "assistant", "system", "tool", "", None]), text))
    table += [(77, i, "user" if i % 2 == 0 else "assistant", f"turn {i}" + "." * (i % 3 > 0)) for i in range(700)]
    table += [(78, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in table], "conv_id long, turn long, role string, text string, copy int, fault string")
    got = c.repair(c.damaged(df), "conv_id", "turn", "role", "text", "copy").select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == plain(table)


def test_conversation_whose_rows_are_all_dropped_and_empty_table(spark):
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    (row,) = c.repair(c.damaged(df), "conv_id", "turn", "role", "text", "copy").collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert c.repair(c.damaged(df.limit(0)), "conv_id", "turn", "role", "text", "copy").collect() == []


def test_query_on_the_table(spark):
    from retail_lake.llm.queries import all_queries

    folder = "/root/testdata/sf0.01"
    table = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = all_queries()["op13_conversation_repair"](spark, folder).select(*NAMES).collect()
    assert sorted(map(tuple, got), key=str) == plain(table)
