"""Conversation repair against a search over all edits and a chart of all spans."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from refweave.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def search(kinds):
    """Cheapest (cost, audit) by Dijkstra's algorithm over rows read and state."""
    heap, seen = [(0, "", 0, 0)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(kinds) and state in (0, 3):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in "ua":
            if role in NEXT[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, NEXT[state][role]))
        if i < len(kinds):
            kind = kinds[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if kind != "x":
                more = 3 if kind.isupper() else 0
                for role, to in NEXT[state].items():
                    if role == kind.lower():
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, to))
                    if role != "s":
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to))


def chart(kinds):
    """Textbook CYK: every span, every split."""
    n, cells = len(kinds), {}
    for width in range(1, n + 1):
        for i in range(n - width + 1):
            if width == 1:
                cells[i, 1] = repair._ROWS[kinds[i]]
                continue
            ways = [repair.product(cells[i, k], cells[i + k, width - k]) for k in range(1, width)]
            assert len(set(ways)) == 1  # any split gives the same cell
            cells[i, width] = ways[0]
    return cells[0, n]


def test_cells_of_all_short_conversations():
    for n in range(1, 4):
        for kinds in itertools.product("xsuaoSUAO", repeat=n):
            cells = repair.parse("".join(kinds))
            assert repair.cheapest(cells) == search(kinds)
            assert cells == chart(kinds)


def test_cells_of_longer_conversations():
    draw = random.Random(5)
    for _ in range(150):
        kinds = "".join(draw.choice("xsuaoSUAO") for _ in range(draw.randint(4, 30)))
        assert repair.cheapest(repair.parse(kinds)) == search(kinds)
    assert repair.parse(kinds) == chart(kinds)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def expected(rows, damage=True):
    """Results of conversations whose rows have a turn each, or are alike."""
    left = damaged(rows) if damage else rows
    out = []
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        kinds, seen, faults = "", set(), {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "x" if fault in ("b", "d") else kind.upper() if fault == "t" else kind
        cost, audit = search(kinds)
        lines, todo = [], list(mine)
        system = sum(e != "D" for e in audit) % 2
        for edit in audit:
            row = None if edit == "I" else todo.pop(0)
            if edit != "D":
                role = ("user", "assistant")[(len(lines) + system) % 2]
                lines.append(f"{row[2] if edit == 'K' else role}:{row[3] if row else ''}")
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA)
    found = repair.repaired(repair.damage(df) if damage else df, df)
    return sorted((tuple(r) for r in found.collect()), key=str)


def made(n, seed):
    draw = random.Random(seed)
    out = []
    for conv in range(n):
        for turn in range(draw.randint(1, 9)):
            role = draw.choice(["user", "assistant"]) if draw.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = draw.choice(["Yes.", "No?", "So \n", "", " \t", "é\U0001f600!", f"{turn}."])
            out.append((conv, turn * draw.choice([1, 1, 1, 3]), "system" if turn == 0 and draw.random() < 0.4 else role, text))
    return out


def test_conversations(spark):
    rows = made(300, 1)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    assert run(spark, rows) == expected(rows)


ODD = [
    (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (1, None, None, None), (1, 4, "user", None),
    (2, -(2**63), "user", "A."), (2, 2**63 - 1, "assistant", "B."), (3, 0, "", "x"), (4, 0, "tool", "x."), (4, 1, "Assistant", "x."),
    (5, 0, "user", "y" * 3_000_000 + "."), (5, 1, "assistant", "z."), (6, 0, "user", "Hi."), (6, 0, "user", "Hi."),
]


def test_odd_rows(spark):
    found = run(spark, ODD, damage=False)
    odd = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in ODD]
    want = expected(odd, damage=False)
    want = sorted(((*w[:1], min(w[1], 2**63 - 1), *w[2:]) for w in want), key=str)
    assert found == want


def test_nothing(spark):
    assert run(spark, []) == []
    df = spark.createDataFrame([(7, 0, "user", "a")], SCHEMA)
    assert [tuple(r) for r in repair.repaired(df.where("false"), df).collect()] == [
        (7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    ]


def test_one_long_conversation(spark):
    draw = random.Random(10)
    rows = [(9, t, draw.choice(["user", "assistant", "system"]), f"{t}{draw.choice('.!?,')}") for t in range(2600)]
    rows += [(8, t, "user", "again.") for t in range(1500)] + [(7, 0, "user", "a.")]
    assert run(spark, rows, damage=False) == expected(rows, damage=False)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as at", "2 as audit", "3 as cells", "4 as n")
    assert repair.repaired(df, df).count() == 3
