"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import pytest

from tickloom.llm import conversations
from tickloom.llm.conversations import _INF, Repair  # noqa: F401

SCHEMA = "conv_id long, turn long, role string, text string, n long, code int, copy int"
ROLE = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
WANT = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}


def by_hand(rows: list[tuple]) -> dict:
    """What the contract says of (turn, role, text) rows after damage, by dynamic programming over strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults, seen = [], set()
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("b" if not re.search(r"[^\x20\x09-\x0D]", text) else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(t: int, q: int, inserts: int):
        out = []
        if t == len(rows):
            if q in (0, 3):
                out.append((0, "", ()))
        else:
            _, role, text = rows[t]
            extra = 3 * (faults[t] == "t")
            steps = [("D", 4, q, None)]
            if faults[t] not in ("b", "d"):
                to = ROLE.get(role[:1], {}).get(q)
                if to is not None:
                    steps.append(("K", extra, to, f"{role}:{text}"))
                steps.append(("R", 3 + extra, WANT[q][0], f"{WANT[q][1]}:{text}"))
            for a, c, to, line in steps:
                cost, word, lines = best(t + 1, to, 0)
                out.append((cost + c, a + word, lines if line is None else (line, *lines)))
        if inserts < 3:
            cost, word, lines = best(t, WANT[q][0], inserts + 1)
            out.append((cost + 3, "I" + word, (f"{WANT[q][1]}:", *lines)))
        return min(out, default=(_INF, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = [r[0] for r in rows if r[0] is not None]
    initials = "".join(r[1][:1] or "-" for r in rows)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(rows) - 1)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    }


def damage(conv, turn, role, text) -> list[tuple]:
    role, text = (" " if x is None else x for x in (role, text))
    k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
    return [] if k == 0 else [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)


def data(n: int = 220) -> list[tuple]:
    rnd = random.Random(9)
    out = []
    for conv in range(n):
        size = rnd.choice((0, 1, 2, 3, 5, 9, 30)) if conv else 90
        for turn in rnd.sample(range(max(size * 2, 1)), size):
            role = rnd.choice(("user", "assistant", "user", "assistant", "system", "tool", "", "Up", None))
            text = rnd.choice(("Yes.", "No", "Why?", "  ", "", "Go! \n", None, "é\t", "long " * rnd.randrange(40), f"{turn}."))
            out += [(conv, None if rnd.random() < 0.03 else turn, role, text)] * rnd.choice((1, 1, 1, 2))
    return out + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (10**15 + 1, None, None, None), (10**15, 4, "user", "x.")]


@pytest.mark.parametrize(("block", "partitions"), [(4096, 4), (3, 7), (1, 40)])
def test_repair_equals_a_plain_search(spark, monkeypatch, block, partitions):
    given = data()
    monkeypatch.setattr(conversations, "BLOCK_ROWS", block)
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.createDataFrame([(*r, "clash", "clash") for r in given], "conv_id long, turn long, role string, text string, n string, code string")
        got = conversations.repair(conversations.damaged(rows)).collect()
        want: dict = {}
        for conv, *r in given:
            want.setdefault(conv, []).extend(damage(conv, *r))
        assert len(got) == len(want)
        for r in got:
            assert {k: r[k] for k in r.asDict() if k != "conv_id"} == by_hand(want[r.conv_id]), r.conv_id
        lines: dict = {}
        for r in conversations.repaired_turns(conversations.damaged(rows)).collect():
            lines.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}", r.edit))
        for r in got:
            mine = sorted(lines.get(r.conv_id, []))
            assert [m[0] for m in mine] == list(range(1, len(mine) + 1))
            assert hashlib.sha256("\n".join(m[1] for m in mine).encode()).hexdigest() == r.repaired_sha256
            assert "".join(m[2] for m in mine) == r.audit.replace("D", "")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)


def test_a_conversation_of_many_rows(spark, monkeypatch):
    """One conversation has most of the rows, many of them alike; blocks and tasks share it."""
    rnd = random.Random(4)
    given = [(7, turn, rnd.choice(("user", "assistant")), rnd.choice(("same.", f"{turn}.", "cut"))) for turn in range(900)]
    given += [(7, 3, "user", "same.")] * 400 + [(i, 0, "user", "a.") for i in range(20)]
    monkeypatch.setattr(conversations, "BLOCK_ROWS", 50)
    rows = spark.createDataFrame(given, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(conversations.plain(rows)).collect()}
    monkeypatch.setattr("sys.getrecursionlimit", lambda: 10**6)
    import sys
    import threading

    sys.setrecursionlimit(50_000)
    threading.stack_size(512 << 20)
    found: list = []
    t = threading.Thread(target=lambda: found.append(by_hand([r[1:] for r in given if r[0] == 7])))
    t.start()
    t.join()
    assert {k: got[7][k] for k in found[0]} == found[0]
    assert len(got) == 20


def test_no_rows(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(rows)).collect() == []
    assert conversations.repaired_turns(conversations.plain(rows)).collect() == []


def test_costs_and_audits_of_short_code_words():
    """Words of up to six codes, against the search above."""
    text = {0: "{}.", 1: "{}", 2: ""}
    rnd = random.Random(2)
    automaton = conversations.Repair()
    for _ in range(3000):
        codes = [rnd.randrange(12) for _ in range(rnd.randrange(7))]
        rows = [(t, "suax"[c % 4], text[c // 4].format(t)) for t, c in enumerate(codes)]
        want = by_hand(rows)
        cost, audit, _ = automaton.solve(bytes(codes))
        assert (cost, audit) == (want["cost"], want["audit"]), codes
    made = len(automaton.vectors)
    automaton.solve(bytes(rnd.randrange(12) for _ in range(20_000)))
    assert len(automaton.vectors) < made + 10 < 100  # few, however long the conversations
