"""The plan of a long series in segments: runs of `size` rows of a symbol, each in a task of its own.

Windows of a bounded length read the last rows of the segment before, which are copied to both. What reaches back over
all rows is a total of each segment, summed over the segments before. A recursion that is affine in its last values has
a summary of each segment, a matrix and a vector; the summaries of a symbol, one row a segment, are composed in order to
the values that each segment begins with, and all segments run at once from there. A recursion that is not affine runs
over the whole symbol, as in `Series.frame`; the columns around it stay in segments.
"""

from __future__ import annotations

import ast
import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.expr import PYTHON, E, lit

from .series import BY, RAW, Node, Series, _in_spark, _source, rows_joined, scan_frame

#: States of a recursion that are summarised; its summary has the square of them.
MOST_STATES = 16
_HERE = "partition by symbol, segment order by seq"


# ---- recursions that are affine in their last values ----------------------------------------------


class _NotAffine(Exception):
    pass


class _Linear:
    """Reads the expressions of a scan: degree 0 (data alone) or 1 (affine in the last values), and the linear part."""

    def __init__(self, degrees: dict[str, int]):
        self.degrees = degrees

    def degree(self, e: ast.expr) -> int:
        match e:
            case ast.Constant():
                return 0
            case ast.Name():
                return self.degrees.get(e.id, 0)
            case ast.UnaryOp(op=ast.USub() | ast.UAdd()):
                return self.degree(e.operand)
            case ast.BinOp(op=ast.Add() | ast.Sub()):
                return max(self.degree(e.left), self.degree(e.right))
            case ast.BinOp(op=ast.Mult()):
                return self._at_most_one(self.degree(e.left) + self.degree(e.right))
            case ast.IfExp():
                self._data(e.test)
                return max(self.degree(e.body), self.degree(e.orelse))
            case ast.Call(func=ast.Name(id="_div")):
                self._data(e.args[1])
                return max(self.degree(e.args[0]), self.degree(e.args[2]))
        for x in ast.walk(e):
            if isinstance(x, ast.Name):
                self._data(x)
        return 0

    def _at_most_one(self, d: int) -> int:
        if d > 1:
            raise _NotAffine
        return d

    def _data(self, e: ast.expr) -> None:
        if self.degree(e):
            raise _NotAffine

    def part(self, e: ast.expr) -> str:
        """The linear part, over names that stand for it where they have degree 1."""
        if not self.degree(e):
            return "0.0"
        match e:
            case ast.Name():
                return e.id
            case ast.UnaryOp(op=ast.USub()):
                return f"(-{self.part(e.operand)})"
            case ast.UnaryOp():
                return self.part(e.operand)
            case ast.BinOp(op=ast.Add() | ast.Sub()):
                return f"({self.part(e.left)} {'+' if isinstance(e.op, ast.Add) else '-'} {self.part(e.right)})"
            case ast.BinOp():
                a, b = (self.part(x) if self.degree(x) else _data_text(x) for x in (e.left, e.right))
                return f"({a} * {b})"
            case ast.IfExp():
                return f"({self.part(e.body)} if {_data_text(e.test)} else {self.part(e.orelse)})"
        return f"_div({self.part(e.args[0])}, {_data_text(e.args[1])}, {self.part(e.args[2])})"


def _data_text(e: ast.expr) -> str:
    """The text of an expression of data, by names that keep their values beside the linear parts."""

    class Kept(ast.NodeTransformer):
        def visit_Name(self, n):
            return ast.Name("_d_" + n.id) if n.id not in PYTHON and n.id not in ("abs", "max", "min", "round", "float") else n

    return f"({ast.unparse(Kept().visit(ast.parse(ast.unparse(e), mode='eval').body))})"


def _parsed(n: Node) -> tuple[ast.expr, bool]:
    """(what a node becomes on a row, whether its value is that of the row before)."""
    text, old = n.expr.py, n.expr.py.startswith("_old(")
    return ast.parse(text[5:-1] if old else text, mode="eval").body, old


def _degrees(nodes: Sequence[Node], known: dict[str, int]) -> dict[str, int]:
    """Degrees of the columns of a plain node or of one scan, beside those that are known; raises _NotAffine."""
    degrees = known | ({k: 1 for n in nodes for k in (n.name, f"z{n.name}")} if nodes[0].kind == "s" else {})
    for n in nodes:  # a column that later expressions read by name has the degree of its expression
        if n.expr.py.startswith("_keep("):
            raise _NotAffine
        e, old = _parsed(n)
        d = _Linear(degrees).degree(e)
        degrees[n.name] = 1 if old else d
    return degrees


def _affine(left: Sequence[Node], done: set[str]) -> list[Node]:
    """The nodes of `left` that can be computed together by scans affine in all of their last values, and what is
    plain and affine between them."""
    core, have, degrees, states = [], set(done), {}, 0
    groups: dict[tuple[str, ...], list[Node]] = {}
    for n in left:
        groups.setdefault(n.group or (n.name,), []).append(n)
    for nodes in groups.values():
        more = len(nodes) if nodes[0].kind == "s" else 0
        if nodes[0].kind in "wj" or states + more > MOST_STATES or not all(n.names <= have for n in nodes):
            continue
        try:
            degrees = _degrees(nodes, degrees)
        except _NotAffine:
            continue
        core += nodes
        states += more
        have |= {n.name for n in nodes}
    return core if states else []


def _linear_source(nodes: list[Node], reads: list[str]) -> str:
    """A function that carries one vector of last values through the linear part of a scan."""
    degrees: dict[str, int] = {}
    for g in dict.fromkeys(n.group or (n.name,) for n in nodes):
        degrees = _degrees([n for n in nodes if (n.group or (n.name,)) == g], degrees)
    linear = _Linear(degrees)
    states = [n for n in nodes if n.kind == "s"]
    lines = ["def run(state, rows):", *(f"    z{n.name} = state[{k}]" for k, n in enumerate(states)), f"    for {', '.join([*(f'_d_{r}' for r in reads), '_d__'])} in rows:"]
    for n in nodes:
        e, old = _parsed(n)
        if old:
            lines.append(f"        {n.name} = z{n.name}; y{n.name} = {linear.part(e)}")
        elif linear.degrees[n.name]:
            lines.append(f"        {n.name} = y{n.name} = {linear.part(e)}")
        else:
            lines.append(f"        _d_{n.name} = {_data_text(e)}; {n.name} = y{n.name} = 0.0")
    lines += [f"        z{n.name} = y{n.name}" for n in states]
    lines.append(f"    return [{', '.join('z' + n.name for n in states)}]")
    return "\n".join(lines)


def _function(source: str):
    space = dict(PYTHON)
    exec(compile(source, "<scan>", "exec"), space)
    return space["run"]


def _runs(batch, reads: list[str]):
    """(symbol, segment, rows, first row, end) of the runs of one segment in a batch sorted by symbol, segment and seq."""
    symbols, segments = batch.column("symbol").to_pylist(), batch.column("segment").to_pylist()
    cols = [batch.column(c).to_pylist() for c in reads] + [batch.column("rn").to_pylist()]
    rows = list(zip(*cols, strict=True))
    a = 0
    while a < len(rows):
        b = a + 1
        while b < len(rows) and segments[b] == segments[a] and symbols[b] == symbols[a]:
            b += 1
        yield symbols[a], segments[a], rows[a:b], a, b
        a = b


def _summaries(df: DataFrame, nodes: list[Node], reads: list[str]) -> DataFrame:
    """(symbol, segment, m): where the last values end from 0, then from each unit vector by the linear part alone."""
    states = [k for k, n in enumerate(nodes) if n.kind == "s"]
    full, part = _source(nodes, reads), _linear_source(nodes, reads)
    d = len(states)

    def run(batches):
        import pyarrow as pa

        whole, steep = _function(full), _function(part)
        key, ends = None, []
        done: list[tuple] = []

        def flush():
            out = done[:]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.list_(pa.float64()))], names=["symbol", "segment", "m"])

        def close():
            if key is not None:
                done.append((*key, [float(ends[0][k]) for k in states] + [float(v) for e in ends[1:] for v in e]))

        for batch in batches:
            for symbol, segment, rows, _, _ in _runs(batch, reads):
                if (symbol, segment) != key:
                    close()
                    key = (symbol, segment)
                    ends = [[0.0] * len(nodes)] + [[float(j == k) for j in range(d)] for k in range(d)]
                ends = [whole(ends[0], rows)[0], *(steep(e, rows) for e in ends[1:])]
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    return df.mapInArrow(run, "symbol string, segment long, m array<double>")


def _starts(summaries: DataFrame, inits: list[float]) -> DataFrame:
    """(symbol, segment, z): the last values that each segment begins with; a symbol's summaries are a row a segment."""
    d = len(inits)

    def one(table):
        import numpy as np
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["segment"])
        z, out = np.array(inits), []
        for r in rows:
            out.append(z.tolist())
            m = np.array(r["m"]).reshape(d + 1, d)
            z = m[0] + z @ m[1:]
        return pa.table({"symbol": pa.array([r["symbol"] for r in rows], pa.string()), "segment": pa.array([r["segment"] for r in rows], pa.int64()), "z": pa.array(out, pa.list_(pa.float64()))})

    return summaries.groupBy("symbol").applyInArrow(one, "symbol string, segment long, z array<double>")


def _replayed(df: DataFrame, nodes: list[Node], reads: list[str]) -> DataFrame:
    """df(..., z) with the columns of a scan, each segment from its z."""
    source, names = _source(nodes, reads), [n.name for n in nodes]
    states = [k for k, n in enumerate(nodes) if n.kind == "s"]

    def run(batches):
        import pyarrow as pa

        step, key, state = _function(source), None, []
        for batch in batches:
            got = []
            z = batch.column("z")
            for symbol, segment, rows, a, _ in _runs(batch, reads):
                if (symbol, segment) != key:
                    key, state = (symbol, segment), [0.0] * len(nodes)
                    for k, v in zip(states, z[a].as_py(), strict=True):
                        state[k] = v
                state, out = step(state, rows)
                got += out
            new = [pa.array([float(v) for v in c], pa.float64()) for c in zip(*got, strict=True)] if got else [pa.array([], pa.float64())] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names))


# ---- the frame in segments ------------------------------------------------------------------------


def stored(df: DataFrame) -> DataFrame:
    """df written below spark.checkpoint.dir and read again: what is read twice is made once, and survives lost executors.

    Only where the session names no folder and runs on one machine, as in tests, a local one is taken.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tickloom-checkpoints")
    path = f"{base.rstrip('/')}/tickloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _beside(df: DataFrame, other: DataFrame, key: str, part: str) -> DataFrame:
    """df with the columns of other(key, part, ...), one row each; a null key is a key too. Joined by shuffle, as both grow."""
    o = other.withColumnsRenamed({key: "_k", part: "_p"}).hint("merge")
    return df.join(o, F.col(key).eqNullSafe(F.col("_k")) & (F.col(part) == F.col("_p"))).drop("_k", "_p")


def numbered(df: DataFrame, block, key: str = "symbol", order: Sequence[str] = ("seq",), name: str = "rn") -> DataFrame:
    """df with the number of each row of its symbol, counted block by block: blocks are runs of rows in order, such as
    the days of a series. Only a count for each block is put in order for the whole symbol."""
    df = df.withColumn("_block", block)
    sizes = df.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(key, "_block").orderBy(*order))
    df = _beside(df, sizes.select(key, "_block", before.alias("_before")), key, "_block")
    return df.withColumn(name, F.col("_before") + place).drop("_block", "_before")


def _lookback(stages: list[list[Node]]) -> int:
    """Rows before a segment that windows over windows read."""
    reach: dict[str, int] = {}
    for nodes in stages:
        for n in nodes:
            reach[n.name] = (n.reach or 0) + max((reach.get(x, 0) for x in n.names), default=0)
    return max(reach.values(), default=0)


def _before(n: Node) -> Node:
    """What takes a column's value of the row before, as a window."""
    x = n.expr.sql[5:-1]
    return Node(n.name, "w", E(f"coalesce(lag({x}, 1) over ({BY}), {lit(n.init).sql})", "", n.names), names=n.names, reach=1)


def _plan(series: Series, outputs: dict[str, E]) -> list[tuple[str, list]]:
    """Steps in order: ("windows", stages of nodes), ("totals", nodes), ("rows", nodes of other rows), ("scan", nodes) and,
    for what can't be split, ("whole", nodes)."""
    need = {n.name for _, nodes in series.stages(list(outputs.values())) for n in nodes} - {"rn"}
    left = [n for n in series.nodes.values() if n.name in need]
    done = {*RAW, *series.extra, "rn"}
    steps: list[tuple[str, list]] = []

    def add(kind: str, nodes: list[Node]):
        if kind == "windows" and steps and steps[-1][0] == "windows":
            steps[-1][1].append(nodes)
        elif nodes:
            steps.append((kind, [nodes] if kind == "windows" else nodes))
        done.update(n.name for n in nodes)

    while left:
        ready = [n for n in left if n.names <= done and (n.kind in "wp" or n.expr.py.startswith("_old("))]
        if ready:
            ready = [_before(n) if n.kind == "s" else n for n in ready]
            add("windows", [n for n in ready if n.reach is not None])
            add("totals", [n for n in ready if n.reach is None])
        elif far := [n for n in left if n.kind == "j" and n.names <= done]:
            add("rows", far)
        elif core := _affine(left, done):
            add("scan", core)
        else:
            have, nodes = set(done), []
            for n in left:
                if n.kind in "ps" and n.names <= have:
                    nodes.append(n)
                    have.add(n.name)
            add("whole", nodes)
        left = [n for n in left if n.name not in done]
    return steps


def in_segments(series: Series, outputs: dict[str, E]) -> bool:
    """Whether no recursion of the plan has to run over a whole symbol."""
    return all(kind != "whole" for kind, _ in _plan(series, outputs))


def _windows(df: DataFrame, stages: list[list[Node]], size: int) -> DataFrame:
    far = _lookback(stages)
    if far:
        both = F.expr(f"case when pmod(cast(rn as bigint) - 1, {size}) >= {size - far} then array(0, 1) else array(0) end")
        df = df.withColumn("_on", F.explode(both)).withColumn("segment", F.col("segment") + F.col("_on"))
    for nodes in stages:
        df = df.selectExpr("*", *(f"{_in_spark(n.expr.sql).replace(BY, _HERE)} as {n.name}" for n in nodes))
    return df.filter("_on = 0").drop("_on") if far else df


_OVER = {"sum({})": "sum", "max({})": "max", "min({})": "min"}


def _totals(df: DataFrame, nodes: list[Node]) -> DataFrame:
    """Aggregates over all rows so far, or over all rows of the symbol: a total a segment, put together in order."""
    local, total, prefix, out = [], [], [], []
    back = "over (partition by symbol order by segment rows between unbounded preceding and 1 preceding)"
    for n in nodes:
        name, here, last = n.name, f"_h_{n.name}", f"_t_{n.name}"
        arg = n.arg.sql
        if n.call.startswith("whole "):
            call = n.call[6:].format
            if n.call[6:] not in _OVER:
                raise ValueError(f"{n.call} is not taken over segments")
            total.append(F.expr(call(arg)).alias(last))
            prefix.append(f"{call(last)} over (partition by symbol) as {last}")
            out.append(f"{last} as {name}")
            continue
        rows = f"over ({_HERE} rows between unbounded preceding and current row)"
        if n.call == "last":
            local.append(f"last_value({arg}) ignore nulls {rows} as {here}")
            total.append(F.expr(f"max_by({arg}, case when ({arg}) is not null then seq end)").alias(last))
            prefix.append(f"last_value({last}) ignore nulls {back} as {last}")
            out.append(f"coalesce({here}, {last}) as {name}")
        elif n.call == "avg({})":
            local += [f"sum({arg}) {rows} as {here}", f"count({arg}) {rows} as {here}_n"]
            total += [F.expr(f"sum({arg})").alias(last), F.expr(f"count({arg})").alias(f"{last}_n")]
            prefix += [f"sum({last}) {back} as {last}", f"sum({last}_n) {back} as {last}_n"]
            out.append(f"({here} + coalesce({last}, 0e0)) / ({here}_n + coalesce({last}_n, 0)) as {name}")
        elif n.call in _OVER:
            call = _OVER[n.call]
            local.append(f"{call}({arg}) {rows} as {here}")
            total.append(F.expr(f"{call}({arg})").alias(last))
            prefix.append(f"{call}({last}) {back} as {last}")
            out.append(f"{here} + coalesce({last}, 0e0) as {name}" if call == "sum" else f"{'greatest' if call == 'max' else 'least'}({here}, {last}) as {name}")
        else:
            raise ValueError(f"{n.call} is not taken over segments")
    columns = df.columns
    each = df.groupBy("symbol", "segment").agg(*total).selectExpr("symbol", "segment", *prefix)
    joined = _beside(df.selectExpr("*", *local) if local else df, each, "symbol", "segment")
    return joined.selectExpr(*(f"`{c}`" for c in columns), *out)


def segmented(series: Series, bars: DataFrame, outputs: dict[str, E], size: int = 100_000) -> DataFrame:
    """The rows of series.frame(bars, outputs), made in segments of `size` rows, or of as many as the windows reach back.

    Equal to it but for the last bits: sums over segments are added in another order.
    """
    steps = _plan(series, outputs)
    size = max([size, *(_lookback(some) for kind, some in steps if kind == "windows")])
    df = numbered(bars, F.floor(F.col("seq") / size)).withColumn("rn", F.col("rn").cast("double"))
    df = df.withColumn("segment", F.floor((F.col("rn") - 1) / size).cast("long"))
    for kind, some in steps:
        if kind == "windows":
            df = _windows(df, some, size)
        elif kind == "totals":
            df = _totals(df, some)
        elif kind == "rows":
            df = rows_joined(df, some)
        elif kind == "scan":
            df = _scan(df, some)
        else:
            df = scan_frame(df.repartition("symbol"), some)
    return df.selectExpr("symbol", "seq", *(f"{e.sql} as `{k}`" for k, e in outputs.items()))


def _scan(df: DataFrame, nodes: list[Node]) -> DataFrame:
    df = stored(df)
    reads = sorted({c for n in nodes for c in n.names} - {n.name for n in nodes})
    order = ("symbol", "segment", "seq")
    parts = df.repartition("symbol", "segment").sortWithinPartitions(*order)
    starts = _starts(_summaries(parts.select(*dict.fromkeys(["symbol", "segment", "seq", "rn", *reads])), nodes, reads), [n.init for n in nodes if n.kind == "s"])
    joined = _beside(df.repartition("symbol", "segment"), starts, "symbol", "segment").select(*df.columns, "z")
    return _replayed(joined.sortWithinPartitions(*order), nodes, reads).drop("z")


__all__ = ["in_segments", "numbered", "segmented", "stored"]

