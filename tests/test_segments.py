"""Series in segments against the same series in one piece."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ta
from tickloom.plans.segments import numbered
from tickloom.sources.bars import to_bars

SCHEMA = "symbol string, seq long, ts timestamp, open double, high double, low double, close double, volume double"


def walk(spark, lengths: dict, gaps: bool = False, level: float = 100.0):
    rnd = random.Random(17)
    rows = []
    for symbol, n in lengths.items():
        x, seq = level, 0
        for _ in range(n):
            seq += rnd.choice((1, 1, 5)) if gaps else 1
            a, x = x, x * math.exp(rnd.gauss(0, 0.02))
            rows.append((symbol, seq, None, a, max(a, x) * 1.01, min(a, x) * 0.99, x, float(rnd.randrange(1, 1000))))
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def both(bars, name, size, **params):
    want = {(r.symbol, r.seq): r.asDict() for r in ta.indicator(bars, name, **params).collect()}
    got = {(r.symbol, r.seq): r.asDict() for r in ta.indicator(bars, name, segment_rows=size, **params).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, v in w.items():
            if isinstance(v, float):
                assert got[k][c] == pytest.approx(v, rel=1e-9, abs=1e-9), (k, c)
            else:
                assert got[k][c] == v, (k, c)
    return want


NAMES = [
    "SimpleMovingAverage", "ExponentialMovingAverage", "WellesWilderMovingAverage", "RelativeStrengthIndex",
    "MovingAverageConvergenceDivergence", "BollingerBands", "TripleExponentialMovingAverage", "OnBalanceVolume",
    "AverageTrueRange", "StochasticOscillator", "HullMovingAverage", "VolumeWeightedAveragePrice", "AverageDirectionalIndex",
    "TrueStrengthIndex", "Ehlers2PoleSuperSmootherFilterV1", "KaufmanAdaptiveMovingAverage",
]


WHOLE = ["McGinleyDynamicIndicator", "SuperTrend"]


@pytest.mark.parametrize("name", NAMES)
def test_equal_to_one_piece(spark, name):
    both(walk(spark, {"A": 230, "B": 61, "C": 1, None: 70}, gaps=True), name, 37)


@pytest.mark.parametrize("name", WHOLE)
def test_recursions_that_are_not_affine(spark, name):
    both(walk(spark, {"A": 90, "B": 20}), name, 25)


@pytest.mark.parametrize("name", ["ExponentialMovingAverage", "RelativeStrengthIndex"])
def test_segments_of_few_rows_and_of_other_prices(spark, name):
    both(walk(spark, {"A": 90}), name, 1)
    both(walk(spark, {"A": 90}, level=1e6), name, 20)


def test_chains_run_in_segments(spark):
    bars = walk(spark, {"A": 150, "B": 40})
    want = ta.Indicators(bars).then("RelativeStrengthIndex", n=7).then("BollingerBands", n=9).frame().orderBy("symbol", "seq").collect()
    got = ta.Indicators(bars).then("RelativeStrengthIndex", n=7).then("BollingerBands", n=9).frame(40).orderBy("symbol", "seq").collect()
    for a, b in zip(got, want, strict=True):
        assert a.trade_signal == b.trade_signal
        assert a.MiddleBand == pytest.approx(b.MiddleBand, abs=1e-9)


def test_one_symbol_runs_in_many_tasks(spark):
    bars = spark.range(1, 40_001).selectExpr("if(id > 0, 'A', 'B') as symbol", "id as seq", "timestamp_seconds(id * 60) as ts", *(f"100 + 5 * sin(id / 50.0) + id % 7 as {c}" for c in ("open", "high", "low", "close")), "1e0 as volume")
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ta.indicator(bars, "ExponentialMovingAverage", n=30, segment_rows=2000)
        tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
        assert len(tasks) > 1
        assert max(r["count"] for r in tasks) < 30_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)


def test_which_split():
    assert all(ta.splits(n) for n in NAMES)
    assert not any(ta.splits(n) for n in WHOLE)
    assert sum(map(ta.splits, ta.REGISTRY)) > 600


def test_numbered_by_blocks(spark):
    bars = walk(spark, {"A": 200, "B": 30}, gaps=True)
    got = numbered(bars, F.floor(F.col("seq") / 11)).select("symbol", "seq", "rn").collect()
    for symbol in "AB":
        rows = sorted((r.seq, r.rn) for r in got if r.symbol == symbol)
        assert [r[1] for r in rows] == list(range(1, len(rows) + 1))
    ticks = spark.range(500).selectExpr("cast(id % 3 as string) as symbol", "timestamp_seconds(id * 7919 % 86400 * 10) as ts", "id * 1e0 as open", "id * 1e0 as high", "id * 1e0 as low", "id * 1e0 as close", "1e0 as volume")
    assert sorted(map(tuple, to_bars(ticks, block="hour").collect())) == sorted(map(tuple, to_bars(ticks).collect()))
