"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_bars(ticks: DataFrame, symbol: str, ts: str, value: str, period: str = "1 hour", late: str = "1 hour", order: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) of each finished period of a stream of single values.

    ts is the start of the period. A bar is given once the watermark, `late` behind the newest tick, has passed its
    period; ticks that come later than that are left out, as are null values. State is one row a symbol and open
    period. Bars have no seq: number those that were written with sources.bars.to_bars().
    """
    place = F.struct(F.col(ts), *map(F.col, order))
    rows = ticks.filter(F.col(value).isNotNull()).withWatermark(ts, late)
    bars = rows.groupBy(F.col(symbol).cast("string").alias("symbol"), F.window(ts, period).alias("period")).agg(
        F.min_by(value, place).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, place).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bars.select("symbol", F.col("period.start").alias("ts"), *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")))
