"""Indicators over a stream of bars: each micro-batch goes on from the last rows of the one before.

What an indicator remembers of a symbol are its last rows with all columns of the plan: windows read the rows they reach
back to, a recursion its last values, and a total over all rows its last one. So the state is a table of a few rows a
symbol, written beside the results, and every micro-batch is an ordinary Spark job over (kept rows, new rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.expr import PYTHON, E
from tickloom.operators.indicators import columns
from tickloom.operators.registry import REGISTRY, Context
from tickloom.plans.series import BY, RAW, Node, Series, _in_spark, _source

_SO_FAR = f"over ({BY} rows between unbounded preceding and current row)"
_JOIN = {"sum({})": "{0} + {1}", "max({})": "greatest({0}, {1})", "min({})": "least({0}, {1})"}


class Steps:
    """The plan of an indicator, run batch by batch."""

    def __init__(self, name: str, **params):
        spec = REGISTRY[name]
        if spec.input != "bars":
            raise ValueError(f"{name} reads other rows than the bars of one series")
        self.series: Series = Context()
        self.outputs: dict[str, E] = columns(spec.run(self.series, **params))
        self.stages = self.series.stages(list(self.outputs.values()))
        self.nodes = [n for _, nodes in self.stages for n in nodes]
        for n in self.nodes:
            if n.kind == "j" or n.call.startswith("whole ") or n.expr.py.startswith("_keep(") or (n.reach is None and n.name != "rn" and n.call not in (*_JOIN, "avg({})", "last")):
                raise ValueError(f"{name} reads the whole history")
        #: Rows of a symbol that are kept from batch to batch.
        self.rows = max([1, *(n.reach or 0 for n in self.nodes)])

    def _columns(self) -> list[str]:
        return [n.name for n in self.nodes]

    def schema(self, spark: SparkSession, bars: DataFrame) -> T.StructType:
        """Of the kept rows."""
        arrays = {n.name for n in self.nodes if n.expr.sql.startswith("list(")}
        fields = [T.StructField(c, T.ArrayType(T.DoubleType()) if c in arrays else T.DoubleType()) for c in self._columns()]
        return T.StructType([*self._bars(bars).schema.fields, *fields])

    @staticmethod
    def _bars(bars: DataFrame) -> DataFrame:
        return bars.select("symbol", F.col("seq").cast("long").alias("seq") if "seq" in bars.columns else F.lit(None).cast("long").alias("seq"), "ts", *RAW)

    def step(self, bars: DataFrame, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(results of new bars, rows to keep) from new bars and the rows that were kept before.

        Bars of a symbol have to come in order: what is late belongs to no batch. Bars without a seq are numbered in
        order of ts, on from the last one kept.
        """
        new = self._bars(bars).withColumn("_kept", F.lit(False))
        if kept is None:
            kept = bars.sparkSession.createDataFrame([], self.schema(bars.sparkSession, bars))
        df = kept.withColumn("_kept", F.lit(True)).unionByName(new, allowMissingColumns=True)
        if "seq" not in bars.columns:
            last = F.coalesce(F.max("seq").over(Window.partitionBy("symbol")), F.lit(0))
            place = F.row_number().over(Window.partitionBy("symbol", "_kept").orderBy("ts", *RAW))
            df = df.withColumn("seq", F.coalesce("seq", (last + place).cast("long")))
        for kind, nodes in self.stages:
            df = self._scan(df, nodes) if kind == "s" else df.selectExpr(*(c for c in df.columns if c not in {n.name for n in nodes}), *map(self._window, nodes))
        out = df.filter("not _kept").selectExpr("symbol", "seq", "ts", *(f"{e.sql} as `{k}`" for k, e in self.outputs.items()))
        newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("seq").desc()))
        return out, df.withColumn("_n", newest).filter(F.col("_n") <= self.rows).select("symbol", "seq", "ts", *RAW, *self._columns())

    def _window(self, n: Node) -> str:
        """A column of kept rows stays; one of new rows is made, from the last kept row on where it reaches back over all."""
        last = f"last_value(case when _kept then {n.name} end) ignore nulls {_SO_FAR}"
        if n.name == "rn":
            made = f"coalesce({last}, 0e0) + row_number() over (partition by symbol, _kept order by seq)"
        elif n.reach is not None:
            made = _in_spark(n.expr.sql)
        elif n.call == "last":
            made = f"coalesce(last_value(case when not _kept then {n.arg.sql} end) ignore nulls {_SO_FAR}, {last})"
        elif n.call == "avg({})":
            before = f"last_value(case when _kept then rn end) ignore nulls {_SO_FAR}"
            made = f"(coalesce({last} * {before}, 0e0) + sum(case when not _kept then {n.arg.sql} end) {_SO_FAR}) / rn"
        else:
            here = f"{n.call.format(f'case when not _kept then {n.arg.sql} end')} {_SO_FAR}"
            made = f"case when {last} is null then {here} else {_JOIN[n.call].format(last, here)} end"
        return f"case when _kept then {n.name} else {made} end as {n.name}"

    def _scan(self, df: DataFrame, nodes: list[Node]) -> DataFrame:
        """The columns of a scan: the state of a symbol is read from its last kept row, and goes on over the new ones."""
        names = [n.name for n in nodes]
        reads = sorted({c for n in nodes for c in n.names} - set(names))
        source = _source(nodes, reads) + "\n" + _resumed(nodes, reads)
        init = [n.init for n in nodes]

        def run(batches):
            import pyarrow as pa

            space = dict(PYTHON)
            exec(compile(source, "<scan>", "exec"), space)
            symbol, state = object(), None
            for batch in batches:
                cols = {c: batch.column(c).to_pylist() for c in ("symbol", "_kept", *reads, *names)}
                out: list[list] = [[] for _ in names]
                for i in range(batch.num_rows):
                    if cols["symbol"][i] != symbol:
                        symbol, state = cols["symbol"][i], list(init)
                    row = tuple(cols[c][i] for c in reads)
                    if cols["_kept"][i]:
                        values = [cols[c][i] for c in names]
                        state = space["resume"](values, row)
                    else:
                        state, got = space["run"](state, [(*row, None)])
                        values = got[0]
                    for o, v in zip(out, values, strict=True):
                        o.append(float(v))
                rest = [c for c in batch.schema.names if c not in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *(pa.array(o, pa.float64()) for o in out)], names=[*rest, *names])

        rest = [f for f in df.schema.fields if f.name not in names]
        schema = T.StructType([*rest, *(T.StructField(n, T.DoubleType()) for n in names)])
        return df.repartition("symbol").sortWithinPartitions("symbol", "seq").mapInArrow(run, schema)


def _resumed(nodes: list[Node], reads: list[str]) -> str:
    """A function that makes the state behind a row from its columns."""
    names = [n.name for n in nodes]
    lines = ["def resume(values, row):", f"    {', '.join(names)}, = values"]
    if reads:
        lines.append(f"    {', '.join(reads)}, = row")
    values = [n.expr.py[5:-1] if n.expr.py.startswith("_old(") else n.name for n in nodes]
    return "\n".join([*lines, f"    return [{', '.join(values)}]"])


def streamed_indicator(bars: DataFrame, name: str, path: str, checkpoint: str, trigger: dict | None = None, **params) -> StreamingQuery:
    """Starts an indicator over a stream of bars: (symbol, ts, open, high, low, close, volume), and seq if there is one.

    Results are appended as Parquet below `path`/results, a folder a micro-batch; the kept rows are below `path`/kept.
    Both folders are overwritten if a micro-batch is run again after a failure, from the same kept rows, so each bar
    counts once. `path` and `checkpoint` lie where all executors reach them.
    """
    steps = Steps(name, **params)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{path}/kept/batch={number - 1}"
        kept = spark.read.schema(steps.schema(spark, batch)).parquet(before) if number else None
        out, keep = steps.step(batch, kept)
        keep.write.mode("overwrite").parquet(f"{path}/kept/batch={number}")
        out.write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def streams(name: str, **params) -> bool:
    """Whether an indicator can run over a stream: it reads no other row than those before, and keeps no arrays."""
    try:
        Steps(name, **params)
    except ValueError:
        return False
    return True


__all__ = ["Steps", "streamed_indicator", "streams"]
