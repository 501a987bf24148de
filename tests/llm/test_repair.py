"""Conversation repair against plain programs over lists."""

import hashlib
import random
import re
import zlib
from itertools import product

from maskwright.llm import repair, turns

BLANK = " \t\n\v\f\r"


def damaged(rows):
    """Rows ``(conv_id, turn, role, text)`` of one table under the query's damage, by conversation."""
    out = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        by = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        mine = out.setdefault(conv, [])
        if by == 0:
            continue
        text = "" if by == 1 else re.sub("[.!?]", "", text) if by == 2 else text
        role = "user" if by == 4 else role
        mine += [(turn, role, text)] * (2 if by == 3 else 1)
    return {c: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rows in out.items()}


def judged(rows):
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(BLANK)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "none")
        seen.add((role, text))
    return faults


NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows, faults):
    """One row after the other, with the best (cost, audit) for each last initial, insertions included."""

    def closed(best):
        for _ in range(4):
            for last, (cost, audit) in list(best.items()):
                for role in "ua":
                    if (last, role) in NEXT:
                        best[role] = min(best.get(role, (9**9, "")), (cost + 3, audit + "I"))
        return best

    best = closed({"": (0, "")})
    for (_, role, _), fault in zip(rows, faults):
        new = {}

        def reach(last, value):
            new[last] = min(new.get(last, (9**9, "")), value)

        for last, (cost, audit) in best.items():
            reach(last, (cost + 4, audit + "D"))
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (last, role[:1]) in NEXT:
                    reach(NEXT[last, role[:1]], (cost + more, audit + "K"))
                for to in "ua":
                    if (last, to) in NEXT:
                        reach(to, (cost + 3 + more, audit + "R"))
        best = closed(new)
    return min(v for k, v in best.items() if k in ("", "a"))


def replayed(rows, audit):
    out, last, left = [], "", iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter == "D":
            continue
        turned = "assistant" if last == "u" else "user"
        role = row[1] if letter == "K" else turned
        out.append(f"{role}:{'' if row is None else row[2]}")
        last = role[:1]
    return out


def expected(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        faults = judged(mine)
        cost, audit = cheapest(mine, faults)
        dated = [t for t, _, _ in mine if t is not None]
        initials = [r[:1] for _, r, _ in mine]
        out[conv] = {
            "gaps": max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0,
            **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(replayed(mine, audit)).encode()).hexdigest(),
        }
    return out


SCHEMA = "conv_id bigint, turn bigint, role string, text string, cost string, part int"


def same(spark, rows):
    data = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {r.conv_id: r.asDict() for r in repair.audited(data).collect()}
    want = expected(rows)
    assert got.keys() == want.keys()
    for conv, row in want.items():
        assert {k: got[conv][k] for k in row} == row, conv
    return want


def written(seed, conversations, longest):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["One.", "Two!", "Three?", "cut off", "", " \t", None, "Four.\x85", "Ünï \U0001f600.", f"N{rng.randint(0, 5)}."])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None]), role, text))
    return rows


def test_against_plain_programs(spark):
    rows = written(3, 150, 9)
    rows += [rows[5]] * 3 + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (-1, None, None, None)]
    # Conversations that lose all their rows stay.
    rows += [(10**6 + n, 0, "user", "Gone.") for n in range(60)]
    want = same(spark, rows)
    assert any(v["audit"] == "" for v in want.values()) and len({v["audit"] for v in want.values()}) > 50


def test_long_conversations_in_pieces(spark):
    """Conversations of many pieces, one of nothing but copies, and one very long text."""
    rows = written(4, 12, 9)
    rng = random.Random(5)
    for conv, n in ((100, 1500), (101, 600)):
        rows += [(conv, k, "assistant" if (k + (k > 700)) % 2 else "user", rng.choice([f"Line {k}.", f"Line {k}", f"Line {k % 40}."])) for k in range(n)]
    rows += [(102, 3, "user", "Same.")] * 700
    rows += [(103, 0, "user", "word " * 100_000 + "."), (103, 1, "assistant", "No " * 50_000)]
    want = same(spark, rows)
    assert len(want[100]["audit"]) > turns.ROWS * 4


def test_tables_of_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(spark, rows)


def test_empty(spark):
    got = repair.audited(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_one_split_stands_for_all():
    """Cells by all splits of all spans, as textbook CYK has them, are those of the middle split."""
    for kinds in map("".join, [*product("suUa-x", repeat=3), *random.Random(1).choices(list(product("sSuUaA-x", repeat=7)), k=60)]):
        n = len(kinds)
        cells = {(i, i + 1): repair.terminal(kinds[i]) for i in range(n)}
        for size in range(2, n + 1):
            for i in range(n - size + 1):
                cell = {}
                for m in range(i + 1, i + size):
                    for at, value in repair.joined(cells[i, m], cells[m, i + size]).items():
                        repair._least(cell, at, value)
                cells[i, i + size] = cell
        assert cells[0, n] == repair.cell_of(kinds)


def test_every_short_audit():
    """The least of all audits up to a length, each checked letter by letter."""
    for kinds in map("".join, product("suUa-", repeat=2)):
        found = []
        for letters in (p for n in range(2, 6) for p in product("DIKR", repeat=n)):
            state, cost, left, fine = 0, 0, list(kinds), True
            for x in letters:
                kind = left.pop(0) if x != "I" and left else None
                if x != "I" and kind is None or kind == "-" and x != "D":
                    fine = False
                    break
                cost += {"D": 4, "I": 3, "K": 0, "R": 3}[x] + (3 if kind and kind.isupper() and x in "KR" else 0)
                if x != "D":
                    step = (state, kind.lower() if x == "K" else repair.TURN[state][0])
                    if step not in repair.STEPS:
                        fine = False
                        break
                    state = repair.STEPS[step]
            if fine and not left and state in repair.ACCEPTED:
                found.append((cost, "".join(letters)))
        assert min(found) == repair.best(repair.cell_of(kinds))
