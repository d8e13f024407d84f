"""Bars: (symbol, seq, ts, open, high, low, close, volume), one row a symbol and period, ordered by seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.plans.segments import numbered

COLUMNS = ("symbol", "seq", "ts", "open", "high", "low", "close", "volume")


def to_bars(df: DataFrame, symbol: str = "symbol", ts: str = "ts", seq: str | None = None, block: str | None = None, **names: str) -> DataFrame:
    """Bars from a table with the price columns (or those that `names` maps to them).

    Rows with a null price or volume are left out. Without a seq column the others are numbered in order of ts
    within the symbol, bars of one time in the order of their prices and volume. With `block` (minute, hour, day,
    month, ...) they are numbered within each such time and the blocks counted, so that no task sorts a whole symbol.
    """
    prices = [F.col(names.get(c, c)).cast("double").alias(c) for c in COLUMNS[3:]]
    given = [F.col(seq).cast("long").alias("seq")] if seq else []
    rows = df.select(F.col(symbol).cast("string").alias("symbol"), *given, F.col(ts).cast("timestamp").alias("ts"), *prices).na.drop(subset=list(COLUMNS[3:]))
    if block:
        rows = numbered(rows, F.date_trunc(block, "ts"), order=("ts", *COLUMNS[3:]), name="seq").withColumn("seq", F.col("seq").cast("long"))
    elif not seq:
        rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("ts", *COLUMNS[3:])).cast("long"))
    return rows.select(*COLUMNS)


def read_bars(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Bars from files of any format that Spark reads."""
    names = {k: options.pop(k) for k in ("symbol", "ts", "seq", *COLUMNS[3:]) if k in options}
    return to_bars(spark.read.format(format).options(**options).load(path), **names)


def from_ticks(df: DataFrame, symbol: str, ts: str, value: str, period: str = "hour", order: tuple[str, ...] = ()) -> DataFrame:
    """Bars of a period from single values: first, highest, lowest and last value, and how many there were."""
    place = F.struct(ts, *order)
    bars = df.groupBy(F.col(symbol).alias("symbol"), F.date_trunc(period, F.col(ts)).alias("ts")).agg(
        F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, place).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return to_bars(bars)


def resample(bars: DataFrame, period: str) -> DataFrame:
    """Coarser bars from bars."""
    return _coarser(bars, F.date_trunc(period, "ts"))


#: What sets the periods of a day apart; days, weeks, months and years leave a day whole.
SUBKEYS = {"minute": F.minute, "hour": F.hour}


def regroup(bars: DataFrame, period: str = "day") -> DataFrame:
    """Coarser bars by day and, within the day, by minute of the hour or hour: the ten o'clock and eleven o'clock
    bars of one minute are one. Days come in order, and groups of a day in the order of their first bars."""
    if period not in (*SUBKEYS, "day", "week", "month", "year"):
        raise ValueError(f"no period {period}")
    return _coarser(bars, F.to_date("ts"), *([SUBKEYS[period]("ts")] if period in SUBKEYS else []))


def _coarser(bars: DataFrame, *keys) -> DataFrame:
    keys = [k.alias(f"key{i}") for i, k in enumerate(keys)]
    out = bars.groupBy("symbol", *keys).agg(
        F.min("ts").alias("ts"), F.min("seq").alias("at"), F.min_by("open", "seq").alias("open"), F.max("high").alias("high"),
        F.min("low").alias("low"), F.max_by("close", "seq").alias("close"), F.sum("volume").alias("volume"),
    )
    first = F.min("at").over(Window.partitionBy("symbol", "key0"))
    out = out.withColumn("day", first).withColumn("seq", F.row_number().over(Window.partitionBy("symbol").orderBy("day", "at")))
    return to_bars(out, seq="seq")


#: Columns of the market's bars beside those of a symbol.
MARKET = ("market_open", "market_high", "market_low", "market_close", "market_volume")


def with_market(bars: DataFrame, market: DataFrame, missing: str = "raise") -> DataFrame:
    """bars with the market's bar of the same time; market has one symbol.

    A bar whose time the market lacks fails the job that reads it, with the symbol and the time; with missing="drop"
    it is left out.
    """
    if missing not in ("raise", "drop"):
        raise ValueError("missing is raise or drop")
    side = market.select("ts", *(F.col(c[7:]).alias(c) for c in MARKET))
    if missing == "drop":
        return bars.join(side, "ts").select(*COLUMNS, *MARKET)
    lacks = F.raise_error(F.concat(F.lit("the market has no bar of "), F.coalesce(F.col("ts").cast("string"), F.lit("an unknown time")), F.lit(", which the symbol has: "), F.coalesce("symbol", F.lit("null"))))
    joined = bars.join(side, "ts", "left")
    return joined.select(*COLUMNS, *(F.when(F.col(c).isNull(), lacks.cast("double")).otherwise(F.col(c)).alias(c) for c in MARKET))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_ticks(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority", "o_orderdate", "o_totalprice", "day", ("o_orderkey",))


def daily_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of all orders, as one symbol."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("market", F.lit("all"))
    return from_ticks(orders, "market", "o_orderdate", "o_totalprice", "day", ("o_orderkey",))


#: The same bars in SQL.
HOURLY_SQL = """select event_type as symbol, cast(row_number() over (partition by event_type order by date_trunc('hour', ts)) as bigint) as seq,
 cast(date_trunc('hour', ts) as timestamp) as ts, arg_min(value, ts) as open, max(value) as high, min(value) as low, arg_max(value, ts) as close,
 cast(count(*) as double) as volume from events group by event_type, date_trunc('hour', ts)"""
PERIODS_SQL = f"""select symbol, cast(row_number() over (partition by symbol order by cast(ts as date)) as bigint) as seq, min(ts) as ts,
 arg_min(open, seq) as open, max(high) as high, min(low) as low, arg_max(close, seq) as close, sum(volume) as volume
 from ({HOURLY_SQL}) group by symbol, cast(ts as date)"""
_DAY_SQL = """arg_min(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) as open, max(o_totalprice) as high, min(o_totalprice) as low,
 arg_max(o_totalprice, struct_pack(a := o_orderdate, b := o_orderkey)) as close, cast(count(*) as double) as volume from orders"""
MARKET_SQL = f"""select 'all' as symbol, cast(row_number() over (order by o_orderdate) as bigint) as seq, cast(o_orderdate as timestamp) as ts,
 {_DAY_SQL} group by o_orderdate"""
PAIR_SQL = f"""select a.symbol, cast(row_number() over (partition by a.symbol order by a.ts) as bigint) as seq, cast(a.ts as timestamp) as ts,
 cast(a.open as double) as open, cast(a.high as double) as high, cast(a.low as double) as low, cast(a.close as double) as close, a.volume,
 cast(m.open as double) as market_open, cast(m.high as double) as market_high, cast(m.low as double) as market_low, cast(m.close as double) as market_close, m.volume as market_volume
 from (select o_orderpriority as symbol, o_orderdate as ts, {_DAY_SQL} group by o_orderpriority, o_orderdate) a
 join (select o_orderdate as ts, {_DAY_SQL} group by o_orderdate) m on a.ts = m.ts"""
