"""Well-known indicators against loops over plain lists, and what holds for every one of them."""

from __future__ import annotations

import math

import pytest

from tickloom.operators import indicators as ta

from .test_indicators import SCHEMA, sma, values, wilder
from .test_more_indicators import roc, rsi
from .test_nested_inputs import N, at, check, data, dev, ema, ratio, stoch, wma  # noqa: F401


def over(x, n, f):
    return [f(x[max(0, i - n + 1) : i + 1]) for i in range(len(x))]


def moves(x):
    return [0.0] + [b - a for a, b in zip(x, x[1:], strict=False)]


def true_range(h, l, c):
    return [max(h[i] - l[i], abs(h[i] - at(c, i - 1)), abs(l[i] - at(c, i - 1))) for i in range(len(h))]


def cut(x, low, high):
    return [min(max(v, low), high) for v in x]


def pct(a, b):
    return [100 * p / q if q else 0.0 for p, q in zip(a, b, strict=True)]


def sub(a, b):
    return [p - q for p, q in zip(a, b, strict=True)]


def running(x):
    out = []
    for v in x:
        out.append((out[-1] if out else 0.0) + v)
    return out


def multiplier(d):
    return [(c - l - (h - c)) / (h - l) * v if h != l else 0.0 for h, l, c, v in zip(d["h"], d["l"], d["c"], d["v"], strict=True)]


def test_commodity_channel(data):  # noqa: F811
    p = [(a + b + c) / 3 for a, b, c in zip(data["h"], data["l"], data["c"], strict=True)]
    m = sma(p, 8)
    d = sma([abs(a - b) for a, b in zip(p, m, strict=True)], 8)
    check(data, "CommodityChannelIndex", {"Cci": [(a - b) / (0.015 * k) if k else 0.0 for a, b, k in zip(p, m, d, strict=True)]}, n=8)


def test_williams_and_stochastics(data):  # noqa: F811
    n, h, l, c = 9, data["h"], data["l"], data["c"]
    top, bottom = over(h, n, max), over(l, n, min)
    got = ta.indicator(data["df"], "WilliamsR", n=n)
    assert values(got, got.columns[2]) == pytest.approx([-100 * (t - x) / (t - b) for t, b, x in zip(top, bottom, c, strict=True)])
    k = stoch(c, h, l, n)
    d = sma(k, 3)
    check(data, "StochasticOscillator", {"FastK": k, "FastD": d, "SlowD": sma(d, 4)}, n=n, s1=3, s2=4)


def test_money_flows(data):  # noqa: F811
    n, v = 7, data["v"]
    p = [(a + b + c) / 3 for a, b, c in zip(data["h"], data["l"], data["c"], strict=True)]
    up = [p[i] * v[i] if i and p[i] > p[i - 1] else 0.0 for i in range(N)]
    down = [p[i] * v[i] if i and p[i] < p[i - 1] else 0.0 for i in range(N)]
    u, d = over(up, n, sum), over(down, n, sum)
    check(data, "MoneyFlowIndex", {"Mfi": [100.0 if b == 0 else 0.0 if a == 0 else 100 - 100 / (1 + a / b) for a, b in zip(u, d, strict=True)]}, n=n)
    m = multiplier(data)
    check(data, "ChaikinMoneyFlow", {"Cmf": ratio(over(m, n, sum), over(v, n, sum))}, n=n)
    check(data, "AccumulationDistributionLine", {"Adl": running(m), "AdlSignal": ema(running(m), n)}, n=n)


def test_aroon(data):  # noqa: F811
    n, x, out = 8, data["c"], []
    for i in range(N):
        w = x[max(0, i - n + 1) : i + 1]
        since = [w[::-1].index(f(w)) for f in (max, min)]
        out.append(100 * (n - since[0]) / n - 100 * (n - since[1]) / n)
    check(data, "AroonOscillator", {"Aroon": out}, n=n)


def test_ultimate(data):  # noqa: F811
    h, l, c = data["h"], data["l"], data["c"]
    low, high = [min(l[i], at(c, i - 1)) for i in range(N)], [max(h[i], at(c, i - 1)) for i in range(N)]
    b, r = sub(c, low), sub(high, low)
    a = [ratio(over(b, n, sum), over(r, n, sum)) for n in (3, 6, 12)]
    check(data, "UltimateOscillator", {"Uo": cut([100 * (4 * p + 2 * q + k) / 7 for p, q, k in zip(*a, strict=True)], 0, 100)}, n1=3, n2=6, n3=12)


def test_trix_and_strength(data):  # noqa: F811
    e = ema(ema(ema(data["c"], 5), 5), 5)
    check(data, "Trix", {"Trix": [(e[i] - at(e, i - 1)) / abs(at(e, i - 1)) * 100 if i else 0.0 for i in range(N)]}, n=5)
    m = moves(data["c"])
    t = cut(pct(ema(ema(m, 7), 4), ema(ema([abs(v) for v in m], 7), 4)), -100, 100)
    check(data, "TrueStrengthIndex", {"Tsi": t, "Signal": ema(t, 3)}, n1=7, n2=4, signal=3)


def test_vortex_and_choppiness(data):  # noqa: F811
    n, h, l, c = 6, data["h"], data["l"], data["c"]
    tr = true_range(h, l, c)
    r = over(tr, n, sum)
    plus, minus = ([abs(a[i] - at(b, i - 1)) for i in range(N)] for a, b in ((h, l), (l, h)))
    check(data, "VortexIndicator", {"ViPlus": ratio(over(plus, n, sum), r), "ViMinus": ratio(over(minus, n, sum), r)}, n=n)
    width = sub(over(h, n, max), over(l, n, min))
    check(data, "ChoppinessIndex", {"Ci": [100 * math.log10(a / b) / math.log10(n) for a, b in zip(r, width, strict=True)]}, n=n)


def test_channels(data):  # noqa: F811
    n, h, l, c = 6, data["h"], data["l"], data["c"]
    check(data, "DonchianChannels", {"UpperChannel": over(h, n, max), "LowerChannel": over(l, n, min)}, n=n)
    e = ema(c, 8)
    a = ema(true_range(h, l, e), 5)  # its true range goes by the last value of the average
    check(data, "KeltnerChannels", {"UpperBand": [p + 2 * q for p, q in zip(e, a, strict=True)], "MiddleBand": e}, n1=8, n2=5)
    m, d = sma(c, n), dev(sma(c, n), n)  # the deviation of the average, which the average leaves behind
    check(data, "BollingerBands", {"UpperBand": [p + 2 * q for p, q in zip(m, d, strict=True)], "LowerBand": [p - 2 * q for p, q in zip(m, d, strict=True)]}, n=n)
    a = wilder(true_range(h, l, c), n)
    check(data, "ChandelierExit", {"ExitLong": [p - 3 * q for p, q in zip(over(h, n, max), a, strict=True)], "ExitShort": [p + 3 * q for p, q in zip(over(l, n, min), a, strict=True)]}, n=n)


def test_super_trend(data):  # noqa: F811
    n, c = 6, data["c"]
    a = [3 * v for v in wilder(true_range(data["h"], data["l"], c), n)]
    long, short, way, out = [], [], [], []
    for i in range(N):
        pl, ps, pw = at(long, i - 1), at(short, i - 1), way[-1] if way else 1
        x, last = c[i], at(c, i - 1)
        if not i:
            pl, ps = x, x
        long.append(max(x - a[i], pl) if last > pl else x - a[i])
        short.append(min(x + a[i], ps) if last < ps else x + a[i])
        way.append(1 if pw == -1 and x > ps else -1 if pw == 1 and x < pl else pw)
        out.append(long[i] if way[i] > 0 else short[i])
    check(data, "SuperTrend", {"Trend": out}, n=n)


def test_momentum_of_prices(data):  # noqa: F811
    c, n = data["c"], 8
    m = moves(c)
    up, down = over([max(v, 0.0) for v in m], n, sum), over([max(-v, 0.0) for v in m], n, sum)
    o = cut([100 * (a - b) / (a + b) if a + b else 0.0 for a, b in zip(up, down, strict=True)], -100, 100)
    check(data, "ChandeMomentumOscillator", {"Cmo": o, "Signal": ema(o, 3)}, n=n)
    check(data, "DetrendedPriceOscillator", {"Dpo": [at(c, i - 5) - v for i, v in enumerate(sma(c, n))]}, n=n)
    check(data, "RateOfChange", {"Roc": roc(c, n)}, n=n)
    p = pct(sub(ema(c, 4), ema(c, 9)), ema(c, 9))
    check(data, "PercentagePriceOscillator", {"Ppo": p, "Signal": ema(p, 5), "Histogram": sub(p, ema(p, 5))}, fast=4, slow=9, signal=5)
    d = sub(ema(c, 4), ema(c, 9))
    check(data, "MovingAverageConvergenceDivergence", {"Macd": d, "Signal": ema(d, 5), "Histogram": sub(d, ema(d, 5))}, fast=4, slow=9, signal=5)
    a = roc(c, 4)  # the second rate is one of the first
    check(data, "CoppockCurve", {"Cc": wma([x + y for x, y in zip(a, roc(a, 6), strict=True)], 5)}, n=5, fast=4, slow=6)


def test_know_sure_thing(data):  # noqa: F811
    x, total = data["c"], [0.0] * N
    for w, (r, n) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), 1):
        x = roc(x, r)
        total = [t + w * v for t, v in zip(total, sma(x, n), strict=True)]
    check(data, "KnowSureThing", {"Kst": total, "Signal": sma(total, 9)})


def test_mass_and_ease(data):  # noqa: F811
    r = sub(data["h"], data["l"])
    e = ema(r, 5)
    m = over(ratio(e, ema(e, 5)), 7, sum)
    check(data, "MassIndex", {"Mi": m, "Signal": ema(m, 4)}, n1=5, n2=5, n3=7, signal=4)
    half = [v / 2 for v in r]
    move = [half[i] - at(half, i - 1) for i in range(N)]
    box = [v / k if k else 0.0 for v, k in zip(data["v"], r, strict=True)]
    check(data, "EaseOfMovement", {"Eom": [1e6 * (move[i] - at(move, i - 1)) / box[i] if box[i] else 0.0 for i in range(N)]})


def test_powers(data):  # noqa: F811
    o, h, l, c, v = (data[k] for k in "ohlcv")
    b = ratio(sub(c, o), sub(h, l))
    check(data, "BalanceOfPower", {"Bop": b, "BopSignal": ema(b, 6)}, n=6)
    e = ema(c, 6)
    check(data, "ElderRayIndex", {"BullPower": sub(h, e), "BearPower": sub(l, e)}, n=6)
    check(data, "ForceIndex", {"Fi": ema([a * b for a, b in zip(moves(c), v, strict=True)], 6)}, n=6)
    m = [(a + b) / 2 for a, b in zip(h, l, strict=True)]
    check(data, "AwesomeOscillator", {"Ao": sub(sma(m, 3), sma(m, 8))}, fast=3, slow=8)


def test_volume_lines(data):  # noqa: F811
    c, v = data["c"], data["v"]
    t = running([v[i] * (c[i] - c[i - 1]) / c[i - 1] if i else 0.0 for i in range(N)])
    check(data, "PriceVolumeTrend", {"Pvt": t, "Signal": ema(t, 6)}, n=6)
    p = [1000 + s for s in running([(c[i] - c[i - 1]) / abs(c[i - 1]) * 100 if i and v[i] > v[i - 1] else 0.0 for i in range(N)])]
    got = ta.indicator(data["df"], "PositiveVolumeIndex", n=6)
    assert values(got, got.columns[2]) == pytest.approx(p)
    o = running([v[i] if c[i] > at(c, i - 1) else -v[i] if c[i] < at(c, i - 1) else 0.0 for i in range(N)])
    check(data, "OnBalanceVolume", {"Obv": o, "ObvSignal": ema(o, 6)}, n=6)


def test_directional_movement(data):  # noqa: F811
    n, h, l = 6, data["h"], data["l"]
    up, down = [h[i] - at(h, i - 1) for i in range(N)], [at(l, i - 1) - l[i] for i in range(N)]
    plus = wilder([max(a, 0.0) if a > b else 0.0 for a, b in zip(up, down, strict=True)], n)
    minus = wilder([max(b, 0.0) if a < b else 0.0 for a, b in zip(up, down, strict=True)], n)
    tr = wilder(true_range(h, l, data["c"]), n)
    p, m = cut(pct(plus, tr), 0, 100), cut(pct(minus, tr), 0, 100)
    d = [100 * abs(a - b) / (a + b) if a + b else 0.0 for a, b in zip(p, m, strict=True)]
    check(data, "AverageDirectionalIndex", {"DiPlus": p, "DiMinus": m, "Adx": wilder(d, n)}, n=n)


def test_averages(data):  # noqa: F811
    c, n = data["c"], 7
    e = ema(c, n)
    ee, eee = ema(e, n), ema(ema(e, n), n)
    check(data, "TripleExponentialMovingAverage", {"Tema": [3 * a - 3 * b + d for a, b, d in zip(e, ee, eee, strict=True)]}, n=n)
    check(data, "WellesWilderMovingAverage", {"Wwma": wilder(c, n)}, n=n)
    check(data, "WeightedMovingAverage", {"Wma": wma(c, n)}, n=n)
    check(data, "ExponentialMovingAverage", {"Ema": e}, n=n)
    check(data, "TriangularMovingAverage", {"Tma": sma(sma(c, n), n)}, n=n)
    v = data["v"]
    check(data, "VolumeWeightedMovingAverage", {"Vwma": ratio(sma([a * b for a, b in zip(c, v, strict=True)], n), sma(v, n))}, n=n)
    k, out = [], []
    for i in range(N):
        path = sum(abs(c[j] - c[j - 1]) for j in range(max(1, i - n + 1), i + 1))
        er = abs(c[i] - c[i - n]) / path if i >= n and path else 0.0
        a = (er * (2 / 3 - 2 / 31) + 2 / 31) ** 2
        k.append(er)
        out.append(a * c[i] + (1 - a) * at(out, i - 1))
    check(data, "KaufmanAdaptiveMovingAverage", {"Kama": out, "Er": k}, n=n)
    check(data, "RelativeStrengthIndex", {"Rsi": rsi(c, n)}, n=n)


def extremes(spark):
    """Series that rise, fall, stand still, jump, and are very short or of small prices."""
    series = {
        "rise": [1 + 0.5 * i for i in range(70)], "fall": [80.0 - i for i in range(70)], "flat": [5.0] * 70, "steps": [10.0 + 5 * (i // 9 % 3) for i in range(70)],
        "one": [3.0], "two": [3.0, 4.0], "tiny": [1e-7 * (2 + math.sin(i)) for i in range(70)], "wave": [100 + 30 * math.sin(i / 3) for i in range(70)],
    }
    rows = [(s, i + 1, None, x, x * 1.001, x * 0.999, x, float(100 + i % 5)) for s, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", ["DemarkReversalPoints", "SequentiallyFilteredMovingAverage", "TopsAndBottomsFinder", "PeakValleyEstimation", "MassThrustIndicator", "EfficientAutoLine"])
def test_rows_that_stand_still_on_the_tables_move_on_other_series(spark, name):
    short = {"SequentiallyFilteredMovingAverage": {"n": 6}, "TopsAndBottomsFinder": {"n": 5}, "PeakValleyEstimation": {"n": 12, "smooth": 4}}
    out = ta.indicator(extremes(spark), name, **short.get(name, {}))
    key = next(c for c in out.columns if c not in ("symbol", "seq", "trade_signal"))
    assert out.select(key).distinct().count() > 1


@pytest.mark.parametrize("name", ["RelativeStrengthIndex", "StochasticOscillator", "BollingerBands", "AverageDirectionalIndex", "SuperTrend", "CommodityChannelIndex", "KaufmanAdaptiveMovingAverage", "LinearRegression", "EhlersSpectrumDerivedFilterBank", "GuppyCountBackLine"])
def test_extremes_give_finite_values_and_all_rows(spark, name):
    bars = extremes(spark)
    out = ta.indicator(bars, name)
    assert out.count() == bars.count()
    for r in out.collect():
        for c, v in r.asDict().items():
            assert v is not None, (r.symbol, c)
            assert not isinstance(v, float) or math.isfinite(v), (r.symbol, c)

