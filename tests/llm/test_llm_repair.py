"""Structure repair against exhaustive search and plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pandas as pd
import pytest

from tidymill.llm import structure_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, part int, state int, letters string"
WHITE = " \t\n\x0b\f\r"
SHAPE = re.compile("(s?(ua)+)?")


def after_damage(rows):
    """Per conversation its rows (turn, role, text) after damage, in order."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        code = zlib.crc32(name.encode()) % 20
        new = {1: (role, ""), 2: (role, re.sub("[.!?]", "", text)), 4: ("user", text)}.get(code, (role, text))
        found[conv] += [(turn is not None, turn or 0, role, text, turn, new)] * {0: 0, 3: 2}.get(code, 1)
    return {c: [(t[4], *t[5]) for t in sorted(turns, key=lambda t: t[:4])] for c, turns in found.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        cut = text.rstrip(WHITE)
        fault = 1 if not cut else 2 if (role, text) in seen else 3 if cut[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append(fault)
    return out


def exhaustive(rows, marks, inserts=2):
    """All ways to edit, the cheapest and then ASCII-least; with what they leave."""
    best = None

    def go(i, left, cost, audit, lines):
        nonlocal best
        if i == len(rows) and SHAPE.fullmatch("".join(r[:1] for r, _ in lines)):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if left:
            for role in ("user", "assistant"):
                go(i, left - 1, cost + 5, audit + "I", [*lines, (role, "")])
        if i < len(rows):
            _, role, text = rows[i]
            more = 5 * (marks[i] == 3)
            go(i + 1, left, cost + 2, audit + "D", lines)
            if marks[i] in (0, 3):
                if role:
                    go(i + 1, left, cost + more, audit + "K", [*lines, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, left, cost + more + 1, audit + "R", [*lines, (new, text)])

    go(0, inserts, 0, "", [])
    return best


def quick(rows, marks):
    """From the last row to the first, by pairs of cost and text; no insertions, which never pay."""
    best = {0: (0, "", []), 3: (0, "", [])}
    for (_, role, text), mark in zip(reversed(rows), reversed(marks)):
        new = {}
        for state in range(4):
            ways, more = [], 5 * (mark == 3)
            if state in best:
                ways.append((best[state][0] + 2, "D" + best[state][1], best[state][2]))
            if mark in (0, 3):
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, role[:1]))
                named = 3 if state == 2 else 2
                if kept in best:
                    ways.append((best[kept][0] + more, "K" + best[kept][1], [f"{role}:{text}", best[kept][2]]))
                if named in best:
                    name = "assistant" if state == 2 else "user"
                    ways.append((best[named][0] + 1 + more, "R" + best[named][1], [f"{name}:{text}", best[named][2]]))
            if ways:
                new[state] = min(ways, key=lambda w: w[:2])
        best = new
    cost, audit, chain = best[0]
    lines = []
    while chain:
        lines.append(chain[0])
        chain = chain[1]
    return cost, audit, lines


def brute(rows, solver):
    found, kept = [], after_damage(rows)
    for conv in {r[0] for r in rows}:
        turns = kept.get(conv, [])
        marks = faults(turns)
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, lines = solver(turns, marks)
        text = "\n".join(line if isinstance(line, str) else ":".join(line) for line in lines)
        found.append((conv, gaps, marks.count(1), marks.count(2), marks.count(3), sum(p not in ("su", "ua", "au") for p in pairs),
                      cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in repair.damage_and_repair(df).select(*repair.RESULT).collect()), key=str)


def made(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in convs:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "a b!\n", "", None, " \t", "Why? ", "é."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 4]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_all_ways_to_edit(spark, seed):
    rows = made(seed, [None, -3, *range(40)], 5)
    assert run(spark, rows) == brute(rows, exhaustive)


def test_sql_agrees_on_odd_rows(spark):
    rows = made(9, [None, -3, *range(60)], 9)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("conversations", conversations)
    found = con.execute(f"SELECT {', '.join(repair.RESULT)} FROM ({repair.repair_sql()})").fetchall()
    assert sorted(found, key=str) == run(spark, rows)


def test_long_conversations_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(1, i, ["user", "assistant"][(i + rng.randrange(9) // 8) % 2], f"{i}{rng.choice('..x')}") for i in range(1500)]
    rows += [(2, 5, "user", "again.")] * 700 + [(3, i, "assistant", "same.") for i in range(600)]
    rows += made(5, range(10, 60), 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "19")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = run(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows, quick)


def test_edges(spark):
    rows = [(1, None, None, None), (None, None, "user", "x."), (5, 0, "system", "only."), (6, 0, "user", "hi."),
            (6, 9, "assistant", "x" * 30000), (7, 0, "users", "u."), (7, 1, "a", "a.")]
    assert run(spark, rows) == brute(rows, exhaustive)
    assert run(spark, []) == []
    dropped = [(c, t, "user", "x.") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    assert dropped and run(spark, dropped) == brute(dropped, exhaustive)


def test_insertions_where_they_pay():
    costs = repair.Costs(rerole=9, delete=9, insert=1, truncated=0)
    end = repair.at_the_end(costs)
    assert repair.solve([("s", 0)], end, costs)[0][:2] == (2, "K")
    cost, letters, state = repair.solve([("u", 0), ("u", 0)], end, costs)[0]
    assert (cost, letters, repair.tails(costs)[state][1]) == (2, "KIK", "I")
    assert repair.repaired_lines([("user", "a"), ("user", "b")], letters, 0) == ["user:a", "assistant:", "user:b"]


def test_segments_give_what_the_whole_gives():
    rng, costs = random.Random(2), repair.Costs(rerole=2, delete=3, insert=2, truncated=1)
    end = repair.at_the_end(costs)
    for _ in range(200):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 9))]
        cut = rng.randrange(len(rows) + 1)
        whole = repair.solve(rows, end, costs)
        back = repair.solve(rows[cut:], end, costs)
        order = repair.ranks([(b[1], end[b[2]][1]) for b in back])
        front = repair.solve(rows[:cut], [(b[0], r) for b, r in zip(back, order)], costs)
        for state in range(4):
            cost, letters, via = front[state]
            assert (cost, letters + back[via][1]) == whole[state][:2]
