"""Calling indicators: on bars, alone or in a chain."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tickloom.functions.expr import E
from tickloom.plans.segments import in_segments, segmented
from tickloom.plans.series import rounded
from tickloom.sources.bars import HOURLY_SQL, MARKET, MARKET_SQL, PAIR_SQL, PERIODS_SQL, daily, daily_market, hourly, regroup, with_market

from . import averages, channels, composites, cycles, market, momentum, searches, oscillators, pivots, recursions, regressions, spectral, trend, volatility  # noqa: F401
from .registry import AVERAGES, REGISTRY, ChainError, Context, Result


class Indicators:
    """A chain of indicators over bars. Nothing runs before the frame is used.

    Indicators(bars).then("RelativeStrengthIndex").then("BollingerBands", n=20).frame() applies the bands to
    the RSI. An indicator without a single output ends a chain; then() after it raises ChainError.

    Pivots read bars of `period` (minute, hour, day, week, month, year), which may only begin a chain. Indicators
    of two series need the `market`, bars of one symbol. A bar without a market bar of the same time is an error when the
    frame is used, or is left out if `missing` is "drop". `input` names the price that the first indicator reads.
    """

    def __init__(self, bars: DataFrame, source: E | None = None, market: DataFrame | None = None, period: str = "day", missing: str = "raise", input: str = "Close"):
        self.bars = bars if market is None else with_market(bars, market, missing)
        self.period, self.paired = period, market is not None
        self.context = Context(MARKET if self.paired else ())
        if source is not None:
            self.context.x = source
        elif input != "Close":
            self.context.select(input)
        self.last: Result | None = None

    def then(self, name: str, **params) -> Indicators:
        if self.last is not None:
            self.context.x = self.context.let(self.last.value)
        spec = REGISTRY[name]
        if spec.input == "pair" and not self.paired:
            raise ValueError(f"{name} needs the bars of a market")
        if spec.input == "periods":
            if self.last is not None:
                raise ChainError("periods may only begin a chain")
            self.bars = regroup(self.bars, self.period)
        self.last = spec.run(self.context, **params)
        return self

    def frame(self, segment_rows: int | None = None) -> DataFrame:
        """symbol, seq, the last indicator's outputs and its signal.

        With `segment_rows`, series are cut into segments of so many rows that run side by side: for symbols with
        millions of rows. Without, a symbol is the unit of parallelism.
        """
        if self.last is None:
            raise ValueError("no indicator was asked for")
        if segment_rows:
            return segmented(self.context, self.bars, columns(self.last), segment_rows)
        return self.context.frame(self.bars, columns(self.last))


def column_name(key: str) -> str:
    """An output's key as a column name: what SQL does not take in names becomes an underscore."""
    out = re.sub(r"\W", "_", key)
    return f"_{out}" if out[0].isdigit() else out


def columns(result: Result) -> dict[str, E]:
    out = {column_name(k): e for k, e in result.outputs.items()}
    return out | ({"trade_signal": result.signal} if result.signal is not None else {})


def indicator(bars: DataFrame, name: str, market: DataFrame | None = None, period: str = "day", segment_rows: int | None = None, missing: str = "raise", input: str = "Close", **params) -> DataFrame:
    """One indicator over bars; `input` names the price it reads, one of registry.INPUTS."""
    return Indicators(bars, market=market, period=period, missing=missing, input=input).then(name, **params).frame(segment_rows)


def splits(name: str, **params) -> bool:
    """Whether all of an indicator runs in segments: its recursions, if any, are affine in their last values."""
    s = Context(MARKET if REGISTRY[name].input == "pair" else ())
    return in_segments(s, columns(REGISTRY[name].run(s, **params)))


#: Registered as an average of its own, but no indicator of the catalogue.
INNER = {"LinearRegressionValue"}


def catalog(spark: SparkSession) -> DataFrame:
    """(name, category, parameters, is_average) of all indicators."""
    rows = [(s.name, s.category, ", ".join(f"{k}={v}" for k, v in s.params.items()), s.average) for s in REGISTRY.values() if s.name not in INNER]
    return spark.createDataFrame(rows, "name string, category string, parameters string, is_average boolean")


#: Indicators whose recursion is too deep for a recursive query, or has steps that SQL can't loop over.
NO_SQL = {
    "AutoLineWithDrift",
    "CorrectedMovingAverage",
    "EhlersAdaptiveBandPassFilter",
    "EhlersAdaptiveLaguerreFilter",
    "FisherLeastSquaresMovingAverage",
    "PercentageTrend",
    "R2AdaptiveRegression",
    "RecursiveRelativeStrengthIndex",
}

#: Decimals that queries keep, as sums in another order differ in the last bits.
DIGITS = 4


def query(name: str):
    """The indicator over hourly bars of the event table, rounded, as a query function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        kind = REGISTRY[name].input
        if kind == "pair":
            bars, s = with_market(daily(spark, sf_dir), daily_market(spark, sf_dir)), Context(MARKET)
        else:
            bars, s = hourly(spark, sf_dir), Context()
        out = columns(REGISTRY[name].run(s))
        df = s.frame(regroup(bars, "day") if kind == "periods" else bars, out)
        return df.selectExpr("symbol", "seq", *(k if k == "trade_signal" else f"{rounded(f'`{k}`', DIGITS)} as `{k}`" for k in out))

    return run


def oracle(name: str) -> str:
    kind = REGISTRY[name].input
    s = Context(MARKET if kind == "pair" else ())
    s.written_out = True
    return s.sql({"bars": HOURLY_SQL, "periods": PERIODS_SQL, "pair": PAIR_SQL}[kind], columns(REGISTRY[name].run(s)), DIGITS)


#: Indicators that are also registered over one long series, cut into segments.
SEGMENTED = ("SimpleMovingAverage", "ExponentialMovingAverage", "WellesWilderMovingAverage", "RelativeStrengthIndex", "MovingAverageConvergenceDivergence", "BollingerBands", "AverageTrueRange", "KaufmanAdaptiveMovingAverage")
#: Rows of a segment in these queries; few, as the series of the test tables are short.
SEGMENT_ROWS = 512


def segment_query(name: str):
    """The indicator over the days of all orders, one series, in segments."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = Context()
        out = columns(REGISTRY[name].run(s))
        df = segmented(s, daily_market(spark, sf_dir), out, SEGMENT_ROWS)
        return df.selectExpr("symbol", "seq", *(k if k == "trade_signal" else f"{rounded(f'`{k}`', DIGITS)} as `{k}`" for k in out))

    return run


def segment_oracle(name: str) -> str:
    s = Context()
    return s.sql(MARKET_SQL, columns(REGISTRY[name].run(s)), DIGITS)


def query_name(name: str) -> str:
    """SimpleMovingAverage -> simple_moving_average."""
    out = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    return f"ta_{out}"


__all__ = ["AVERAGES", "REGISTRY", "SEGMENTED", "ChainError", "Indicators", "catalog", "indicator", "oracle", "query", "query_name", "segment_oracle", "segment_query", "splits"]
