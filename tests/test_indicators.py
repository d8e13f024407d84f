"""Indicators on small bars, against loops written out and against the SQL of the oracle."""

from __future__ import annotations

import math

import pytest

from tickloom.operators import indicators as ta

SCHEMA = "symbol string, seq long, ts timestamp, open double, high double, low double, close double, volume double"


def bars(spark, closes: dict[str, list[float]], spread: float = 1.0):
    import datetime as dt

    rows = [
        (s, i + 1, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), c - spread / 2, c + spread, c - spread, c, 100.0 + i)
        for s, cs in closes.items()
        for i, c in enumerate(cs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def wave(n: int, phase: float = 0.0) -> list[float]:
    return [100 + 10 * math.sin(i / 5 + phase) + 0.1 * i for i in range(n)]


def values(df, key, symbol="A"):
    return [r[key] for r in df.filter(df.symbol == symbol).orderBy("seq").collect()]


def sma(x, n):
    return [sum(x[i - n + 1 : i + 1]) / n if i + 1 >= n else 0.0 for i in range(len(x))]


def wilder(x, n):
    out, y = [], 0.0
    for v in x:
        y = v / n + y * (1 - 1 / n)
        out.append(y)
    return out


@pytest.mark.parametrize("n", [1, 13, 14, 15, 60])
def test_sma(spark, n):
    x = wave(n)
    assert values(ta.indicator(bars(spark, {"A": x}), "SimpleMovingAverage"), "Sma") == pytest.approx(sma(x, 14))


def test_rsi_and_isolation_of_symbols(spark):
    a, b = wave(50), wave(50, 2.0)
    df = ta.indicator(bars(spark, {"A": a, "B": b}).repartition(3), "RelativeStrengthIndex")
    for s, x in (("A", a), ("B", b)):
        d = [0.0] + [q - p for p, q in zip(x, x[1:], strict=False)]
        up, down = wilder([max(v, 0.0) for v in d], 14), wilder([max(-v, 0.0) for v in d], 14)
        want = [100.0 if v == 0 else 0.0 if u == 0 else 100 - 100 / (1 + u / v) for u, v in zip(up, down, strict=True)]
        assert values(df, df.columns[2], s) == pytest.approx(want)


def test_constant_prices(spark):
    df = ta.indicator(bars(spark, {"A": [5.0] * 30}, 0.0), "RelativeStrengthIndex")
    assert values(df, df.columns[2]) == [100.0] * 30
    bands = ta.indicator(bars(spark, {"A": [5.0] * 60}, 0.0), "BollingerBands")  # the warm-up of the mean is past
    assert values(bands, "UpperBand")[-1] == pytest.approx(values(bands, "LowerBand")[-1])


def test_chain(spark):
    x = wave(40)
    df = ta.Indicators(bars(spark, {"A": x})).then("SimpleMovingAverage", n=5).then("SimpleMovingAverage", n=3).frame()
    assert values(df, "Sma") == pytest.approx(sma(sma(x, 5), 3))
    with pytest.raises(ta.ChainError):
        ta.Indicators(bars(spark, {"A": x})).then("BollingerBands").then("SimpleMovingAverage")


def test_empty_bars(spark):
    df = bars(spark, {"A": [1.0]}).limit(0)
    for name in ("SimpleMovingAverage", "RelativeStrengthIndex"):
        assert ta.indicator(df, name).collect() == []


def test_every_indicator_makes_a_plan_and_sql():
    for name in ta.REGISTRY:
        assert "select symbol, seq" in ta.oracle(name)


def test_signals_are_of_five_kinds(spark):
    df = ta.indicator(bars(spark, {"A": wave(60)}), "SimpleMovingAverage")
    assert set(values(df, "trade_signal")) <= {"StrongBuy", "Buy", "None", "Sell", "StrongSell"}


@pytest.mark.parametrize("name", ["HullMovingAverage", "UltimateMovingAverage", "BollingerBands", "FunctionToCandles"])
def test_oracle_sql_agrees(spark, tmp_path, name):
    import duckdb

    data = bars(spark, {"A": wave(70), "B": wave(65, 1.0)})
    events = data.selectExpr("seq as event_id", "ts", "symbol as event_type", "close as value")
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select * from ({ta.oracle(name)}) order by symbol, seq").fetchall()
    got = ta.query(name)(spark, str(tmp_path)).orderBy("symbol", "seq").collect()
    assert len(got) == 135
    for g, w in zip(got, want, strict=True):
        assert list(g) == pytest.approx(list(w), abs=2e-4) if not any(isinstance(v, str) for v in g) else all(a == b if isinstance(a, str) else a == pytest.approx(b, abs=2e-4) for a, b in zip(g, w, strict=True))
