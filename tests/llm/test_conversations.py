"""Repairs against all edits by brute force, damage against plain Python, long conversations against short ones."""

import hashlib
import re
import zlib
from functools import lru_cache

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tracelake.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, position int, cost string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        mark = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(mark.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    return out


def cheapest(roles, faults):
    """The least (cost, audit, repaired roles by row) over all edits."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(roles) and state in "-a":
            found.append((0, "", ()))
        needs = "a" if state == "u" else "u"
        if inserted < 4:
            cost, audit, rest = best(i, needs, inserted + 1)
            found.append((cost + 2, "I" + audit, ((needs, None), *rest)))
        if i < len(roles):
            cost, audit, rest = best(i + 1, state, 0)
            found.append((cost + 3, "D" + audit, rest))
            if faults[i] not in "bd":
                extra, initial = faults[i] == "t", roles[i][:1]
                if initial == needs or (initial == "s" and state == "-"):
                    cost, audit, rest = best(i + 1, initial, 0)
                    found.append((cost + extra, "K" + audit, ((None, i), *rest)))
                cost, audit, rest = best(i + 1, needs, 0)
                found.append((cost + extra + 2, "R" + audit, ((needs, i), *rest)))
        return min(found, key=lambda f: f[:2], default=(10**9, "~", ()))

    return best(0, "-", 0)


def brute(rows):
    """Report and repaired turns of one conversation's damaged rows."""
    rows = sorted((r for r in rows if not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, faults = set(), ""
    for _, _, role, text, _ in rows:
        plain = text.strip(" \t\n\x0b\x0c\r")
        faults += "b" if not plain else "d" if (role, text) in seen else "t" if plain[-1] not in ".!?" else "-"
        seen.add((role, text))
    roles = [r[2] for r in rows]
    turns = {r[1] for r in rows} - {None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    cost, audit, kept = cheapest(tuple(roles), faults)
    name = {"u": "user", "a": "assistant"}
    lines = [f"{name[new] if new else roles[i]}:{'' if i is None else rows[i][3]}" for new, i in kept]
    return gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    marked = damaged(rows)
    broken = c.damage(df)
    assert sorted(map(str, map(tuple, broken.collect()))) == sorted(map(str, marked))
    found = {r.conv_id: tuple(r)[1:] for r in c.repair(broken, dropped="dropped").collect()}
    want = {k: brute([m for m in marked if m[0] == k]) for k in {r[0] for r in rows}}
    assert found == {k: w[:8] for k, w in want.items()}
    turns = sorted(c.repaired_turns(broken, dropped="dropped").collect(), key=lambda r: r.position)
    for k, w in want.items():
        own = [r for r in turns if r.conv_id == k]
        assert "".join(r.edit for r in own) == w[6] and [f"{r.role}:{r.text}" for r in own if r.edit != "D"] == w[8]


TURN = st.tuples(
    st.sampled_from([*range(8), None]), st.integers(0, 4) | st.none(), st.sampled_from(["system", "user", "assistant", "u", "a b", "", "tool", None]), st.sampled_from(["", " \n", "a.", "a", "b! ", "c?\n", "d", None])
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TURN, max_size=60))
def test_any_conversations(spark, rows):
    check(spark, rows)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TURN, min_size=1, max_size=60))
def test_long_conversations_are_repaired_alike(spark, rows):
    old, c.LONG = c.LONG, 900
    try:
        check(spark, rows)
    finally:
        c.LONG = old


def test_many_gathered_parts(spark, monkeypatch):
    roles, texts = ["user", "assistant", "system"], ["one.", "two", "three!", ""]
    rows = [(i % 37, j, roles[(i * j) % 3], texts[(i + j * j) % 4] + str(j % 5) * (j % 2)) for i in range(37) for j in range(i % 23)]
    check(spark, rows)


def test_edges(spark):
    check(spark, [(1, 0, "user", "Hi."), (1, 1, "assistant", "x" * 200_000 + "."), (2, None, None, None), (None, None, None, None), (None, 5, "user", "Hi."), (3, -4, "system", "S."), (3, 10**12, "user", "a.")] + [(4, 7, "user", "Same.")] * 6)
    empty = spark.createDataFrame([], SCHEMA)
    assert c.repair(c.damage(empty), dropped="dropped").count() == 0 and c.repair(empty).count() == 0


@pytest.mark.parametrize("roles, audit, cost", [("ua", "KK", 0), ("sua", "KKK", 0), ("s", "D", 3), ("u", "KI", 2), ("a", "IK", 2), ("us", "KR", 2), ("suau", "KKKKI", 2), ("uu", "KR", 2), ("", "", 0)])
def test_known_edits(roles, audit, cost):
    import numpy as np

    numbers = np.array(["-sua".index(x) for x in roles], np.int32)
    costs, audits = c.edits(numbers, np.zeros(len(roles), np.int32), np.array([len(roles)]))
    want = cheapest(tuple(roles), "-" * len(roles))
    assert (costs[0], audits[0].decode()) == want[:2]
    assert want[:2] == (cost, audit)
