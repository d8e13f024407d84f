"""Indicators against loops that share no code with them: regressions, fractals, pivots, pairs, chains."""

from __future__ import annotations

import datetime as dt
import math
import random
from statistics import mean, median

import pytest

from tickloom.operators import indicators as ta
from tickloom.operators.registry import AVERAGES
from tickloom.sources import bars as sources

from .test_indicators import SCHEMA, bars, sma, values, wave, wilder


def walk(n, seed=1):
    rnd, x = random.Random(seed), 100.0
    out = []
    for _ in range(n):
        x = round(x + rnd.uniform(-2, 2), 2)
        out.append(x)
    return out


def candles(spark, n, seed=3, step=dt.timedelta(hours=1), symbol="A"):
    rnd = random.Random(seed)
    rows = []
    for i, c in enumerate(walk(n, seed)):
        o = round(c + rnd.uniform(-1, 1), 2)
        rows.append((symbol, i + 1, dt.datetime(2024, 1, 1) + i * step, o, max(o, c) + rnd.random(), min(o, c) - rnd.random(), c, 50.0 + rnd.randrange(100)))
    return rows, spark.createDataFrame(rows, SCHEMA)


def rsi(x, n):
    d = [0.0] + [b - a for a, b in zip(x, x[1:], strict=False)]
    up, down = wilder([max(v, 0.0) for v in d], n), wilder([max(-v, 0.0) for v in d], n)
    return [100.0 if v == 0 else 0.0 if u == 0 else 100 - 100 / (1 + u / v) for u, v in zip(up, down, strict=True)]


def roc(x, n):
    return [(x[i] - x[i - n]) / x[i - n] * 100 if i >= n and x[i - n] else 0.0 for i in range(len(x))]


def test_linear_regression_is_the_least_squares_line(spark):
    import numpy as np

    x = walk(40)
    df = ta.indicator(bars(spark, {"A": x}), "LinearRegression", n=10)
    for i in range(9, 40):
        b, a = np.polyfit(np.arange(i - 9, i + 1), x[i - 9 : i + 1], 1)
        want = {"LinearRegression": a + b * i, "PredictedTomorrow": a + b * (i + 1), "Slope": b, "Intercept": a}
        for k, v in want.items():
            assert values(df, k)[i] == pytest.approx(v, abs=1e-6)
        if i > 12:
            break


def test_trimean_takes_nearest_ranks(spark):
    x = walk(30)
    df = ta.indicator(bars(spark, {"A": x}), "Trimean", n=7)
    for k, share in (("Q1", 0.25), ("Median", 0.5), ("Q3", 0.75)):
        want = []
        for i in range(30):
            w = sorted(x[max(0, i - 6) : i + 1])
            want.append(w[max(math.ceil(share * len(w)) - 1, 0)])
        assert values(df, k) == pytest.approx(want)


def test_median_over_a_frame(spark):
    x = walk(25)
    m = [median(x[max(0, i - 4) : i + 1]) for i in range(25)]
    w = 2 * math.pi / 12
    a = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    want, y = [], 0.0
    for v in m:
        y = a * v + (1 - a) * y
        want.append(y)
    assert values(ta.indicator(bars(spark, {"A": x}), "EhlersRecursiveMedianFilter"), "Ermf") == pytest.approx(want)


def test_connors_rank_reads_the_rsi(spark):
    x = walk(60)
    r = rsi(x, 3)
    c = roc(r, 20)
    want = [100 * sum(v <= c[i] for v in c[max(0, i - 19) : i + 1][:19]) / 20 for i in range(60)]
    df = ta.indicator(bars(spark, {"A": x}), "ConnorsRelativeStrengthIndex", n3=20)
    assert values(df, "Rsi") == pytest.approx(r)
    assert values(df, "PctRank") == pytest.approx(want)


def test_rainbow(spark):
    x = walk(40)
    r, layers = x, []
    for _ in range(10):
        r = sma(r, 2)
        layers.append(r)
    want = []
    for i in range(40):
        w = x[max(0, i - 9) : i + 1]
        width = max(w) - min(w)
        want.append(100 * (x[i] - mean(v[i] for v in layers)) / width if width else 0.0)
    assert values(ta.indicator(bars(spark, {"A": x}), "RainbowOscillator"), "Ro") == pytest.approx(want)


def test_kendall_counts_pairs(spark):
    x, n = walk(30), 6
    line = values(ta.indicator(bars(spark, {"A": x}), "LinearRegression", n=n), "LinearRegression")
    sign = lambda v: (v > 1e-12) - (v < -1e-12)
    at = lambda v, i: v[i] if i >= 0 else 0.0
    want = [sum(sign(at(line, i - j) - at(line, i - k)) * sign(at(x, i - j) - at(x, i - k)) for j in range(n) for k in range(j)) / (n * (n - 1) / 2) for i in range(30)]
    assert values(ta.indicator(bars(spark, {"A": x}), "KendallRankCorrelationCoefficient", n=n), "Krcc") == pytest.approx(want)


def test_fractals_stand_out_two_bars_back(spark):
    rows, df = candles(spark, 60)
    high = [r[4] for r in rows]
    got = values(ta.indicator(df, "WilliamsFractals"), "UpFractal")
    for i in range(8, 60):
        w = high[i - 4 : i + 1]
        assert got[i] == float(w[2] == max(w))  # no ties among random prices


def test_adaptive_laguerre_filter(spark):
    x = walk(50)
    diffs, mids, want = [], [], []
    l, f, alpha = [x[0]] * 4, x[0], 2 / 15
    for v in x:
        diffs.append(abs(v - f))
        w = diffs[-14:]
        mids.append((diffs[-1] - min(w)) / (max(w) - min(w)) if max(w) > min(w) else 0.0)
        alpha = median(mids[-5:]) if mids[-1] else alpha
        new = [alpha * v + (1 - alpha) * l[0]]
        for k in (1, 2, 3):
            new.append(-(1 - alpha) * new[k - 1] + l[k - 1] + (1 - alpha) * l[k])
        l = new
        f = (l[0] + 2 * l[1] + 2 * l[2] + l[3]) / 6
        want.append(f)
    assert values(ta.indicator(bars(spark, {"A": x}), "EhlersAdaptiveLaguerreFilter"), "Ealf") == pytest.approx(want)


def test_pivots_read_the_day_before(spark):
    rows, df = candles(spark, 24 * 4, step=dt.timedelta(hours=1))
    days = [rows[i : i + 24] for i in range(0, 96, 24)]
    daily = [(d[0][3], max(r[4] for r in d), min(r[5] for r in d), d[-1][6]) for d in days]
    want = [0.0] + [(h + l + c + o) / 4 for o, h, l, c in daily[:-1]]
    out = ta.indicator(df, "StandardPivotPoints")
    assert values(out, "Pivot") == pytest.approx(want)
    assert values(out, "S2")[1] == pytest.approx(want[1] - (daily[0][1] - daily[0][2]))


def test_periods_of_one_minute_of_the_hour_are_one(spark):
    rows, df = candles(spark, 6, step=dt.timedelta(minutes=30))
    got = sources.regroup(df, "minute").orderBy("seq").collect()
    assert [(r.open, r.close, r.volume) for r in got] == [(rows[k][3], rows[k + 4][6], sum(rows[i][7] for i in (k, k + 2, k + 4))) for k in (0, 1)]
    with pytest.raises(ValueError):
        sources.regroup(df, "decade")


def test_two_series(spark):
    (rows, df), (other, market) = candles(spark, 40, 5), candles(spark, 41, 6, symbol="M")
    out = ta.indicator(df, "RSMKIndicator", market=market, n=10, smooth=3)
    ratio = [a[6] / b[6] for a, b in zip(rows, other, strict=False)]
    d = [v - (ratio[i - 10] if i >= 10 else 0.0) for i, v in enumerate(ratio)]
    want, e = [], 0.0
    for i, v in enumerate(d):
        e = mean(d[: i + 1]) if i < 3 else v * 0.5 + e * 0.5
        want.append(e * 100)
    assert values(out, "Rsmk") == pytest.approx(want)
    with pytest.raises(ValueError):
        ta.indicator(df, "RSMKIndicator")


def test_bars_of_one_time_have_a_fixed_order(spark):
    rows = [("A", dt.datetime(2024, 1, 1), float(i), float(i), float(i), float(i), 1.0) for i in (3, 1, 2)]
    rows.append(("A", dt.datetime(2023, 1, 1), None, 1.0, 1.0, 1.0, 1.0))
    df = sources.to_bars(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double"))
    assert [(r.seq, r.close) for r in df.orderBy("seq").collect()] == [(1, 1.0), (2, 2.0), (3, 3.0)]


@pytest.mark.parametrize("ma", ["LinearRegression", "Trimean", "LinearRegressionLine", "SimplifiedWeightedMovingAverage", "MultiDepthZeroLagExponentialMovingAverage"])
def test_averages_can_be_exchanged(spark, ma):
    x = wave(60)
    assert ma in AVERAGES
    out = values(ta.indicator(bars(spark, {"A": x}), "BollingerBands", ma=ma, n=10), "MiddleBand")
    alone = ta.indicator(bars(spark, {"A": x}), ma, n=10)
    assert out == pytest.approx(values(alone, alone.columns[2]))
