"""Bars of a stream equal those of a batch, but for periods that are still open."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tickloom.operators import indicators as ta
from tickloom.sources.bars import from_ticks, to_bars
from tickloom.streaming.bars import streamed_bars
from tickloom.streaming.indicators import Steps, streamed_indicator, streams


def test_finished_periods_equal_the_batch(spark, tmp_path):
    rnd = random.Random(4)
    rows = [("ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i, rnd.choice((None, *range(20)))) for i in range(200)]
    schema = "kind string, at timestamp, id long, v double"
    rows = [(k, t, i, None if v is None else float(v)) for k, t, i, v in rows]
    for part in range(4):
        spark.createDataFrame(rows[part * 50 : part * 50 + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "ticks"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "ticks"))
    out = streamed_bars(stream, "kind", "at", "v", "1 hour", "30 minutes", ("id",))
    query = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "bars"))
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "bars")).collect()}
    ticks = spark.createDataFrame([r for r in rows if r[3] is not None], schema)
    batch = {tuple(r) for r in from_ticks(ticks, "kind", "at", "v", "hour", ("id",)).select("symbol", "ts", "open", "high", "low", "close", "volume").collect()}
    last = max(t for _, t, _, v in rows if v is not None) - dt.timedelta(minutes=30)
    assert got == {b for b in batch if b[1] + dt.timedelta(hours=1) <= last}
    assert got


NAMES = [
    "ExponentialMovingAverage", "RelativeStrengthIndex", "MovingAverageConvergenceDivergence", "BollingerBands", "OnBalanceVolume",
    "SuperTrend", "AverageTrueRange", "StochasticOscillator", "TripleExponentialMovingAverage", "McGinleyDynamicIndicator", "UlcerIndex", "VolumeWeightedAveragePrice",
]


def _bars(n: int = 160):
    rnd, rows = random.Random(8), []
    price = {"A": 50.0, "B": 90.0, None: 20.0}
    for i in range(n):
        for s in price:
            if s == "B" and i < 60 or s is None and i % 3:
                continue
            o, price[s] = price[s], price[s] * (1 + rnd.gauss(0, 0.02))
            c = price[s]
            rows.append((s, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, float(rnd.randrange(1, 99))))
    return rows


SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"


def _equal(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        for c, v in w.items():
            assert got[k][c] == (pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v), (k, c)


@pytest.mark.parametrize("name", NAMES)
def test_batch_by_batch_equals_all_at_once(spark, name):
    rows = _bars()
    batch = to_bars(spark.createDataFrame(rows, SCHEMA))
    want = {(r.symbol, r.seq): r.asDict() for r in ta.indicator(batch, name).collect()}
    steps, kept, got = Steps(name), None, {}
    for a, b in ((0, 1), (1, 90), (90, 90), (90, 200), (200, len(rows))):
        out, keep = steps.step(spark.createDataFrame(rows[a:b], SCHEMA), kept)
        kept = spark.createDataFrame(keep.collect(), keep.schema)
        for r in out.drop("ts").collect():
            got[r.symbol, r.seq] = r.asDict()
        assert max((r["count"] for r in kept.groupBy("symbol").count().collect()), default=0) <= steps.rows
    _equal(got, want)


def test_a_stream_of_bars(spark, tmp_path):
    rows = _bars()
    for part in range(4):
        spark.createDataFrame(rows[part * 70 : part * 70 + 70], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "bars"))
    query = streamed_indicator(stream, "RelativeStrengthIndex", str(tmp_path / "out"), str(tmp_path / "state"), n=9)
    query.awaitTermination()
    got = {(r.symbol, r.seq): r.asDict() for r in spark.read.parquet(str(tmp_path / "out" / "results")).drop("ts", "batch").collect()}
    want = {(r.symbol, r.seq): r.asDict() for r in ta.indicator(to_bars(spark.createDataFrame(rows[:280], SCHEMA)), "RelativeStrengthIndex", n=9).collect()}
    assert len({p.name for p in (tmp_path / "out" / "kept").iterdir()}) == 4
    _equal(got, want)


def test_which_stream():
    assert streams("ExponentialMovingAverage")
    assert not streams("EhlersConvolutionIndicator")  # reads the row half the series ago
    assert not streams("EhlersMesaPredictIndicatorV1")  # keeps an array
    assert sum(map(streams, ta.REGISTRY)) > 500
