"""Repair of conversations: the cheapest edits that bring the roles of each to `(s?(ua)+)?`.

The edits are a weighted automaton over four states of the role pattern. Its lazy determinisation has normalised vectors
of costs, one cost a state, as states; transitions are made when first met and kept in a table. A scan of the table over
the codes of a conversation's rows gives its cost. Tight arcs traced back from the end mark what lies on a cheapest
path, and the path of the least letters through the marks is the audit.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length spreads over tasks. One that lies
whole in a task and is not long is repaired there. The others travel as blocks: codes, a byte a row, go to one task a
conversation, as its audit does anyway; texts are edited block by block, and only the digest reads them in order.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grown, materialize, sparing

#: Blanks of the contract, the initials that count, the roles that edits give.
BLANKS, INITIALS, ROLES = " \t\n\x0b\x0c\r", "sua", ("user", "user", "assistant", "user")
#: Rows and bytes of text of a block; a longer row is a block of its own.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
#: Shares that copies of one text in one conversation are compared in first.
SALTS = 32
_INF = 1 << 40
#: States: nothing yet, after s, after u, after a. What keeping an initial leads to (s, u, a, another), and what an
#: inserted or reassigned role does.
_KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
_NEXT = (2, 2, 3, 2)
_END = (0, 3)
#: Codes: 4 * fault + initial. Faults: none, truncated, blank, duplicate.
_COSTS = {"D": 4, "I": 3, "K": 0, "R": 3}


class Repair:
    """The lazily determinised automaton; a worker keeps one."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.start, _ = self._state([0, _INF, _INF, _INF])

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """(state of a vector of costs after insertions, what was taken off all of them).

        What can't lie on a cheapest path counts as unreached, so that the vectors are few: whatever goes on from "after
        s" goes on from "after a" at the same cost, and what goes on from "nothing yet" does for one deletion more.
        """
        for _ in range(3):
            for q, to in enumerate(_NEXT):
                costs[to] = min(costs[to], costs[q] + _COSTS["I"])
        costs[1] = costs[1] if costs[1] <= costs[3] else _INF
        costs[0] = costs[0] if costs[0] <= costs[3] + _COSTS["D"] else _INF
        least = min(costs)
        v = tuple(min(c - least, _INF) for c in costs)
        if v not in self.ids:
            self.ids[v] = len(self.vectors)
            self.vectors.append(v)
        return self.ids[v], least

    @staticmethod
    @functools.cache
    def arcs(q: int, code: int) -> tuple[tuple[str, int, int], ...]:
        """(letter, cost, next state) of what can be done to a row, in order of letters."""
        fault, initial = divmod(code, 4)
        out = [("D", _COSTS["D"], q)]
        if fault < 2:
            if _KEEP[q][initial] is not None:
                out.append(("K", _COSTS["K"] + 3 * fault, _KEEP[q][initial]))
            out.append(("R", _COSTS["R"] + 3 * fault, _NEXT[q]))
        return tuple(out)

    def step(self, state: int, code: int) -> tuple[int, int]:
        got = self.steps.get((state, code))
        if got is None:
            costs = [_INF] * 4
            for q, v in enumerate(self.vectors[state]):
                for _, c, to in self.arcs(q, code):
                    costs[to] = min(costs[to], v + c)
            got = self.steps[state, code] = self._state(costs)
        return got

    def _closed(self, state: int, marks: int) -> int:
        """Marks, and the states from which tight insertions lead to them."""
        v = self.vectors[state]
        for _ in range(3):
            for q, to in enumerate(_NEXT):
                if marks >> to & 1 and v[q] + _COSTS["I"] == v[to]:
                    marks |= 1 << q
        return marks

    def _back(self, state: int, code: int, marks: int) -> int:
        """What of `state` lies on tight arcs over a row to the marks behind it."""
        key = (state, code, marks)
        if key not in self.marks:
            to_state, off = self.step(state, code)
            v, w, out = self.vectors[state], self.vectors[to_state], 0
            for q in range(4):
                if any(marks >> to & 1 and v[q] < _INF and v[q] + c == w[to] + off for _, c, to in self.arcs(q, code)):
                    out |= 1 << q
            self.marks[key] = self._closed(state, out)
        return self.marks[key]

    def solve(self, codes: bytes) -> tuple[int, str, bytes]:
        """(cost, audit, the state after each row)."""
        states, cost = [self.start], 0
        for code in codes:
            state, off = self.step(states[-1], code)
            states.append(state)
            cost += off
        v = self.vectors[states[-1]]
        best = min(v[q] for q in _END)
        marks = [0] * len(states)
        marks[-1] = self._closed(states[-1], sum(1 << q for q in _END if v[q] == best))
        for t in range(len(codes) - 1, -1, -1):
            marks[t] = self._back(states[t], codes[t], marks[t + 1])
        q, letters, after = 0, [], bytearray()
        for t in range(len(codes) + 1):
            while True:
                v, here = self.vectors[states[t]], marks[t]
                if t == len(codes):
                    found = None if q in _END and v[q] == best else ("I", _NEXT[q])
                else:
                    w, off = self.vectors[states[t + 1]], self.step(states[t], codes[t])[1]
                    over = {a: to for a, c, to in self.arcs(q, codes[t]) if marks[t + 1] >> to & 1 and v[q] + c == w[to] + off}
                    if "D" not in over and here >> _NEXT[q] & 1 and v[q] + _COSTS["I"] == v[_NEXT[q]]:
                        found = ("I", _NEXT[q])
                    else:
                        found = next(iter(over.items()))
                if found is None:
                    break
                letters.append(found[0])
                q = found[1]
                if found[0] != "I":
                    after.append(q)
                    break
        return cost + best, "".join(letters), bytes(after)


_repair = Repair()


@functools.lru_cache(100_000)
def _known(codes: bytes) -> tuple[int, str, bytes]:
    return _repair.solve(codes)


def solve(codes: bytes) -> tuple[int, str, bytes]:
    """Repair.solve(); what short conversations share is kept."""
    return _known(codes) if len(codes) <= 32 else _repair.solve(codes)


def edited(state: int, letters: str, rows: list[tuple[str, str, int]]):
    """The repaired (role, text, letter) of rows (role, text, copies), from a state of the pattern on."""
    left = ((role, text) for role, text, n in rows for _ in range(n))
    for a in letters:
        role, text = ("", "") if a == "I" else next(left)
        if a == "D":
            continue
        to = _KEEP[state][INITIALS.index(role[0]) if role[:1] and role[0] in INITIALS else 3] if a == "K" else _NEXT[state]
        yield (role if a == "K" else ROLES[state]), text, a
        state = to


def _lines(state: int, letters: str, rows: list[tuple[str, str, int]], first: bool) -> bytes:
    """What edited() gives as role:text lines; a newline stands before all but the first."""
    text = "\n".join(f"{role}:{text}" for role, text, _ in edited(state, letters, rows))
    return ("" if first else "\n").encode() + text.encode()


def counts(codes: bytes) -> dict[str, int]:
    """blank, duplicate, truncated and illegal of a conversation."""
    c = np.frombuffer(codes, dtype=np.uint8)
    pair = (c[:-1] % 4) * 4 + c[1:] % 4
    return {"blank": int((c >> 2 == 2).sum()), "duplicate": int((c >> 2 == 3).sum()), "truncated": int((c >> 2 == 1).sum()), "illegal": int((~np.isin(pair, (0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1))).sum())}


# ---- rows ---------------------------------------------------------------------------------------


def plain(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): a null role or text reads as one space; n = 0 only names a conversation."""
    fill = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *fill, F.lit(1).cast("long").alias("n"))


def damaged(rows: DataFrame) -> DataFrame:
    """plain() rows after the damage that crc32("conv_id:turn") % 20 names: 0 drops, 1 empties, 2 takes `.!?` away,
    3 repeats, 4 makes the role user; a null id or turn reads as one space."""
    rows = plain(rows)
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    k = F.crc32(key.cast("binary")) % 20
    role = F.when(k == 0, "").when(k == 4, "user").otherwise(F.col("role"))
    text = F.when(k.isin(0, 1), "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    turn = F.when(k != 0, F.col("turn"))
    return rows.select("conv_id", turn.alias("turn"), role.alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("n"))


def coded(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, n) with equal rows as one, and the code of the first and of the other copies.

    Whether a role and text stood before in the conversation is found in two steps, within shares of the turns first.
    """
    runs = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order = F.col("turn").asc_nulls_first()
    share = F.when(F.col("n") > 0, F.pmod(F.xxhash64("turn"), F.lit(SALTS))).otherwise(-2)
    same = ("conv_id", "role", "text")
    runs = runs.withColumn("share", share).withColumn("lead", F.row_number().over(Window.partitionBy(*same, "share").orderBy(order)) == 1)
    runs = runs.withColumn("share", F.when(F.col("lead") & (F.col("n") > 0), -1).otherwise(F.col("share")))
    first = F.col("lead") & (F.row_number().over(Window.partitionBy(*same, "share").orderBy(order)) == 1)
    initial = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, k) for k, c in enumerate(INITIALS)), F.lit(3))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    fault = F.when(blank, 2).when(~first, 3).when(cut, 1).otherwise(0)
    return runs.select("conv_id", "turn", "role", "text", "n", (4 * fault + initial).cast("int").alias("code"), (4 * F.when(blank, 2).otherwise(3) + initial).cast("int").alias("copy"))


_BLOCK = "conv_id long, part int, block int, codes binary, roles array<string>, texts array<string>, copies array<long>, low long, high long, turns long"
_FOUND = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


class _Block:
    """Rows of one conversation that lie together."""

    def __init__(self):
        self.codes, self.rows, self.bytes = bytearray(), [], 0
        self.low = self.high = None
        self.turns = 0

    def add(self, turn, role, text, n, code, copy):
        if n:
            self.codes += bytes([code]) + bytes([copy]) * (n - 1)
            self.rows.append((role, text, n))
            self.bytes += len(text)
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high, self.turns = turn, self.turns + 1

    def full(self, most: int) -> bool:
        return len(self.rows) >= most or self.bytes >= BLOCK_BYTES


def _found(codes: bytes, spans: list[tuple]) -> tuple[dict, bytes]:
    """The statistics of a conversation from its codes and (low, high, turns) of its blocks, and the states behind its rows."""
    spans = [s for s in spans if s[2]]
    turns = sum(s[2] for s in spans) - sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    cost, audit, after = solve(codes)
    return {"gaps": spans[-1][1] - spans[0][0] + 1 - turns if spans else 0, **counts(codes), "cost": cost, "audit": audit}, after


def _schema() -> str:
    return f"{_BLOCK}, whole boolean, {_FOUND}, repaired_sha256 string"


def _to_arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _blocks(rows: DataFrame, apart: bool = False) -> DataFrame:
    """Conversations that are repaired, and blocks of those that may go on elsewhere or are long; blocks alone if `apart`."""
    arrow, most = _arrow(_schema()), BLOCK_ROWS

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        conv, block, number, seen, out, size = None, None, 0, 0, [], 0

        def as_block(b):
            roles, texts, copies = zip(*b.rows, strict=True) if b.rows else ((), (), ())
            return {"conv_id": conv, "part": part, "block": number, "codes": bytes(b.codes), "roles": roles, "texts": texts, "copies": copies, "low": b.low, "high": b.high, "turns": b.turns, "whole": False}

        def close(last: bool):
            """Ends a conversation: the first of a task and the last may have begun, or go on, in another."""
            if apart or seen == 1 or last or number:
                return as_block(block)
            found, _ = _found(bytes(block.codes), [(block.low, block.high, block.turns)])
            text = _lines(0, found["audit"], block.rows, True)
            return {"conv_id": conv, "whole": True, **found, "repaired_sha256": hashlib.sha256(text).hexdigest()}

        for batch in batches:
            for held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or held[0] != conv:
                    if block is not None:
                        out.append(close(False))
                    conv, block, number = held[0], _Block(), 0
                    seen += 1
                elif block.full(most):
                    out.append(as_block(block))
                    size += block.bytes
                    number, block = number + 1, _Block()
                block.add(*held[1:])
                if len(out) >= 2048 or size >= BLOCK_BYTES:
                    yield _to_arrow(out, arrow)
                    out, size = [], 0
        if block is not None:
            out.append(close(True))
        if out:
            yield _to_arrow(out, arrow)

    turn = F.col("turn").asc_nulls_first()
    dealt = rows.repartitionByRange(F.col("conv_id"), turn, F.substring("role", 1, 32), F.substring("text", 1, 64))
    return dealt.sortWithinPartitions(F.col("conv_id"), turn, "role", "text").mapInArrow(sparing(run), _schema())


def _solved(blocks: DataFrame) -> DataFrame:
    """For each block its letters, the state before it and its place; beside the first one, what is found of the whole."""
    ddl = f"conv_id long, part int, block int, letters string, state int, before long, first boolean, {_FOUND}"
    arrow = _arrow(ddl)

    def one(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["block"]))
        found, after = _found(b"".join(r["codes"] for r in rows), [(r["low"], r["high"], r["turns"]) for r in rows])
        audit = np.frombuffer(found["audit"].encode(), dtype=np.uint8)
        consumed = np.append(0, np.flatnonzero(audit != ord("I")) + 1)  # where the letters of each row end
        out, at, before = [], 0, 0
        for k, r in enumerate(rows):
            end = at + len(r["codes"])
            stop = len(audit) if k == len(rows) - 1 else int(consumed[end])
            letters = found["audit"][int(consumed[at]) : stop]
            out.append({**{c: r[c] for c in ("conv_id", "part", "block")}, "letters": letters, "state": after[at - 1] if at else 0, "before": before, "first": k == 0, **(found if k == 0 else {})})
            at, before = end, before + len(letters) - letters.count("D")
        return pa.Table.from_batches([_to_arrow(out, arrow)])

    return blocks.select("conv_id", "part", "block", "codes", "low", "high", "turns").groupBy("conv_id").applyInArrow(one, ddl)


def _digests(edited_blocks: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of blocks, read in order; memory is that of a batch."""

    def run(batches):
        conv, h, began = None, None, False
        for batch in batches:
            done = []
            for c, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if h is None or c != conv:
                    if h is not None:
                        done.append((conv, h.hexdigest()))
                    conv, h, began = c, hashlib.sha256(), False
                if len(chunk) > 1:  # blocks begin with a newline that the first of all lines has not
                    h.update(chunk if began else chunk[1:])
                    began = True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], names=["conv_id", "repaired_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], names=["conv_id", "repaired_sha256"])

    ordered = edited_blocks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.select("conv_id", "lines").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _with_letters(blocks: DataFrame, solved: DataFrame) -> DataFrame:
    """Blocks beside their letters; blocks are joined one by one, however many a conversation has."""
    l = solved.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.col("block").alias("b"), "letters", "state", "before")
    joined = blocks.join(grown(l), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")) & (F.col("block") == F.col("b")))
    return joined.select("conv_id", "part", "block", "state", "before", "letters", "roles", "texts", "copies")


def _edited(blocks: DataFrame) -> DataFrame:
    """The lines of each block, behind a newline."""

    def run(batches):
        for batch in batches:
            out = []
            for state, word, roles, texts, copies in zip(*(batch.column(c).to_pylist() for c in ("state", "letters", "roles", "texts", "copies")), strict=True):
                out.append(_lines(state, word, list(zip(roles, texts, copies, strict=True)), False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "block")), pa.array(out, pa.binary())], names=["conv_id", "part", "block", "lines"])

    return blocks.mapInArrow(sparing(run), "conv_id long, part int, block int, lines binary")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of plain() or damaged() rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows stand in order of turn, null first, then role and text. A null conv_id is one conversation. Without rows, all
    counts are 0, the audit is empty and the digest that of the empty string.
    """
    blocks = materialize(_blocks(coded(rows)))
    columns = ["conv_id", *_STATS, "repaired_sha256"]
    whole = blocks.filter("whole").select(*columns)
    parts = blocks.filter("not whole")
    solved = materialize(_solved(parts))
    shas = _digests(_edited(_with_letters(parts, solved))).select(F.col("conv_id").alias("c"), "repaired_sha256")
    ends = solved.filter("first").join(grown(shas), F.col("conv_id").eqNullSafe(F.col("c"))).select(*columns)
    return whole.unionByName(ends)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, place, role, text, edit) of the repaired conversations of plain() or damaged() rows: places from 1 on,
    and the letter of the edit that a row comes from. Deleted rows are left out."""
    ddl = "conv_id long, place long, role string, text string, edit string"
    arrow = _arrow(ddl)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                lines = edited(r["state"], r["letters"], list(zip(r["roles"], r["texts"], r["copies"], strict=True)))
                yield _to_arrow([{"conv_id": r["conv_id"], "place": r["before"] + k, "role": role, "text": text, "edit": a} for k, (role, text, a) in enumerate(lines, 1)], arrow)

    blocks = materialize(_blocks(coded(rows), apart=True))
    return _with_letters(blocks, _solved(blocks)).mapInArrow(sparing(run), ddl)
