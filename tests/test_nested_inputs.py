"""Indicators that hand a series of their own to another one, against loops over plain lists."""

from __future__ import annotations

import math

import pytest

from tickloom.operators import indicators as ta

from .test_indicators import sma, values, wilder
from .test_more_indicators import candles, rsi

SMA = "SimpleMovingAverage"
N = 90


def line(x, n):
    """End and slope of the regression on the row number, sums over the rows there are, n rows counted."""
    ends, slopes = [], []
    for i in range(len(x)):
        at = range(max(0, i - n + 1), i + 1)
        sx, sy = sum(at), sum(x[j] for j in at)
        sxy, sxx = sum(j * x[j] for j in at), sum(j * j for j in at)
        bottom = n * sxx - sx * sx
        b = (n * sxy - sx * sy) / bottom if bottom else 0.0
        slopes.append(b)
        ends.append((sy - b * sx) / n + b * i)
    return ends, slopes


def dev(x, n, ma=sma):
    return [math.sqrt(v) for v in ma([(a - m) ** 2 for a, m in zip(x, ma(x, n), strict=True)], n)]


def ema(x, n):
    out = []
    for i, v in enumerate(x):
        out.append(sum(x[: i + 1]) / (i + 1) if i < n else v * 2 / (n + 1) + out[-1] * (1 - 2 / (n + 1)))
    return out


def wma(x, n):
    return [sum((n - k) * x[i - k] for k in range(min(n, i + 1))) / (n * (n + 1) / 2) for i in range(len(x))]


def at(x, i):
    return x[i] if i >= 0 else 0.0


def ratio(a, b):
    return [p / q if q else 0.0 for p, q in zip(a, b, strict=True)]


def stoch(x, high, low, n):
    out = []
    for i, v in enumerate(x):
        h, l = max(high[max(0, i - n + 1) : i + 1]), min(low[max(0, i - n + 1) : i + 1])
        out.append(min(max((v - l) / (h - l) * 100, 0.0), 100.0) if h != l else 0.0)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows, df = candles(spark, N)
    return {k: [r[i] for r in rows] for i, k in ((3, "o"), (4, "h"), (5, "l"), (6, "c"), (7, "v"))} | {"df": df}


def check(data, name, want: dict, **params):
    got = ta.indicator(data["df"], name, **params)
    for key, series in want.items():
        assert values(got, key) == pytest.approx(series, abs=1e-6), key


def test_fast_z_score(data):
    m = sma(data["c"], 10)
    a, b = line(m, 10)[0], line(m, 5)[0]
    gap = ratio([q - p for p, q in zip(a, b, strict=True)], dev(m, 10))
    check(data, "FastZScore", {"Fzs": [g / 2 for g in gap]}, n=10)
    want = [(math.exp(min(5 * g, 100)) - 1) / (math.exp(min(5 * g, 100)) + 1) for g in gap]
    check(data, "InverseFisherFastZScore", {"Iffzs": want}, n=10)


def test_turbo_stochastics(data):
    k = stoch(data["c"], data["h"], data["l"], 8)
    d = sma(k, 8)
    check(data, "TurboStochasticsFast", {"Tsf": line(k, 7)[0], "Signal": line(d, 7)[0]}, n1=8, n2=5, turbo=2)
    check(data, "TurboStochasticsSlow", {"Tsf": line(d, 7)[0], "Signal": line(sma(d, 8), 7)[0]}, n1=8, n2=5, turbo=2)


def test_projection_bands(data):
    n, h, l = 6, data["h"], data["l"]
    up, down = line(h, n)[1], line(l, n)[1]
    u = [max([h[i]] + [at(h, i - j + 1) + at(up, i - j) * j for j in range(1, n + 1)]) for i in range(N)]
    d = [min([l[i]] + [at(l, i - j + 1) + at(down, i - j) * j for j in range(1, n + 1)]) for i in range(N)]
    check(data, "ProjectionBands", {"UpperBand": u, "LowerBand": d}, n=n)


def test_hirashima_sugita(data):
    n, x = 7, data["c"]
    e = ema(x, n)
    first = [a - b for a, b in zip(x, e, strict=True)]
    w, s1 = wma([abs(v) for v in first], n), line(first, n)[0]
    s2 = line([a - (b + c) for a, b, c in zip(x, e, s1, strict=True)], n)[0]
    basis = [e[i] + s1[i] + s2[i] - at(s2, i - 1) for i in range(N)]
    check(data, "HirashimaSugitaRS", {"MiddleBand": basis, "UpperBand2": [b + 2 * v for b, v in zip(basis, w, strict=True)]}, n=n)


def test_finite_volume_elements(data):
    n, c, v = 8, data["c"], data["v"]
    median = [(a + b) / 2 for a, b in zip(data["h"], data["l"], strict=True)]
    typical = [(a + b + m) / 3 for a, b, m in zip(data["h"], data["l"], median, strict=True)]
    out, m = [], sma(v, n)
    for i in range(N):
        flow = c[i] - median[i] + typical[i] - at(typical, i - 1)
        signed = v[i] if flow > 0.3 * c[i] / 100 else -v[i] if flow < -0.3 * c[i] / 100 else 0.0
        out.append((out[-1] if out else 0.0) + (signed / m[i] / n * 100 if m[i] else 0.0))
    check(data, "FiniteVolumeElements", {"Fve": out}, n=n)


def relative_volume(data, n):
    return ratio([a - b for a, b in zip(data["v"], sma(data["v"], n), strict=True)], dev(data["v"], n))


def test_relative_volume(data):
    check(data, "RelativeVolumeIndicator", {"Rvi": relative_volume(data, 12)}, n=12)


def test_freedom_of_movement(data):
    n, c = 12, data["c"]
    v = relative_volume(data, n)
    a = [abs((c[i] - c[i - 1]) / c[i - 1]) if i else 0.0 for i in range(N)]

    def scaled(x, i):
        w = x[max(0, i - n + 1) : i + 1]
        return (1 + (x[i] - min(w)) * 9) / (max(w) - min(w)) if max(w) != min(w) else 0.0

    q = [scaled(v, i) / scaled(a, i) if scaled(a, i) else 0.0 for i in range(N)]
    mean = [sum(q[max(0, i - n + 1) : i + 1]) / min(n, i + 1) for i in range(N)]
    check(data, "FreedomOfMovement", {"Fom": ratio([x - m for x, m in zip(q, mean, strict=True)], dev(q, n))}, n=n)


def test_trend_analysis(data):
    y = dev(sma(data["c"], 9), 4)
    check(data, "TrendAnalysisIndicator", {"Tai": y, "Signal": sma(y, 9)}, n1=9, n2=4)


def test_ratios_of_returns(data):
    n, c = 10, data["c"]
    bench = 1.02 ** (n / 360) - 1
    r = [c[i] / c[i - n] - 1 - bench if i >= n else 0.0 for i in range(N)]
    check(data, "SharpeRatio", {"Sr": ratio(sma(r, n), dev(r, n))}, n=n)
    r = [100 * (c[i] / c[i - n]) - 1 - bench * 100 if i >= n else 0.0 for i in range(N)]
    fall = []
    for i in range(N):
        top = max(r[max(0, i - n + 1) : i + 1])
        fall.append(((r[i] - top) / top * 100 if top else 0.0) ** 2)
    ulcer = [math.sqrt(sum(fall[max(0, i - n + 1) : i + 1]) / min(n, i + 1)) for i in range(N)]
    check(data, "MartinRatio", {"Mr": ratio(sma(r, n), ulcer)}, n=n)


def test_firefly(data):
    n, k = 8, 3
    v = [(h + l + 2 * c) / 4 for h, l, c in zip(data["h"], data["l"], data["c"], strict=True)]
    m, d = sma(v, n), dev(v, n)
    z = [(a - b) * 100 / (q or 1) for a, b, q in zip(v, m, d, strict=True)]
    w = [(y + 100) / 2 - 4 for y in sma(sma(sma(z, k), k), n)]
    check(data, "FireflyOscillator", {"Fo": w}, ma=SMA, n=n, smooth=k)


def test_kase_peak(data):
    n, h, l, c = 6, data["h"], data["l"], data["c"]
    tr = [max(h[i] - l[i], abs(h[i] - at(c, i - 1)), abs(l[i] - at(c, i - 1))) for i in range(N)]
    a = wilder(tr, n)
    pk = wma([((h[i] - at(l, i - n)) / a[i] - (at(h, i - n) - l[i]) / a[i]) * math.sqrt(n) for i in range(N)], 3)
    m, d = sma(pk, n), dev(pk, n)
    want = []
    for i in range(N):
        up, down = max(m[i] + 1.33 * d[i], 2.08), min(m[i] - 1.33 * d[i], -1.92)
        want.append(up if at(pk, i - 1) >= 0 and pk[i] > 0 else down if at(pk, i - 1) <= 0 and pk[i] < 0 else 0.0)
    check(data, "KasePeakOscillatorV1", {"Kpo": want, "Pk": pk}, n=n, smooth=3)


def test_kase_stops(data):
    n, h, l, c = 7, data["h"], data["l"], data["c"]
    p = [(a + b + x) / 3 for a, b, x in zip(h, l, c, strict=True)]
    r = [max(h[i] - at(l, i - 2), abs(h[i] - at(c, i - 2)), abs(l[i] - at(c, i - 2))) for i in range(N)]
    f, g, a, d = sma(p, 4), sma(p, 9), sma(r, n), dev(r, n)
    want = [p[i] + a[i] + 2.2 * d[i] if f[i] < g[i] else p[i] - a[i] - 2.2 * d[i] for i in range(N)]
    check(data, "KaseDevStopV1", {"Dev2": want}, fast=4, slow=9, n=n)
    f, g = sma(c, 4), sma(c, 9)
    r = [max(h[i], at(h, i - 1), at(c, i - 2)) - min(l[i], at(l, i - 1), at(c, i - 2)) for i in range(N)]
    a, d = sma(r, n), dev(r, n)
    want = [(h[i] - 1 if f[i] > g[i] else l[i] + 1) * (a[i] + 3.6 * d[i]) for i in range(N)]
    check(data, "KaseDevStopV2", {"Dev4": want}, fast=4, slow=9, n=n)


def test_volume_disparity(data):
    n, c, v = 9, data["c"], data["v"]
    obv, nvi = [], []
    for i in range(N):
        obv.append((obv[-1] if obv else 0.0) + (v[i] if c[i] > at(c, i - 1) else -v[i] if c[i] < at(c, i - 1) else 0.0))
        step = (c[i] - at(c, i - 1)) / abs(c[i - 1]) * 100 if i and v[i] < v[i - 1] else 0.0
        nvi.append((nvi[-1] if nvi else 1000.0) + step)
    m = sma(c, n)
    d = dev(m, n)
    for name, key, o in (("OnBalanceVolumeDisparityIndicator", "Obvdi", obv), ("NegativeVolumeDisparityIndicator", "Nvdi", nvi)):
        om, od, want = sma(o, n), dev(o, n), []
        for i in range(N):
            low, bottom = m[i] - 2 * d[i], 4 * od[i]
            a = (c[i] - low) / (c[i] + 2 * d[i] - low) if c[i] + 2 * d[i] - low else 0.0
            b = (o[i] - (om[i] - 2 * od[i])) / bottom if bottom else 0.0
            want.append((1 + a) / (1 + b) if 1 + b else 0.0)
        check(data, name, {key: want}, n=n)


def high_pass(x, n, mult):
    w = min(max(2 * math.pi / (mult * n * math.sqrt(2)), 0.01), 0.99)
    a = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    out = []
    for i in range(len(x)):
        out.append((1 - a / 2) ** 2 * (x[i] - 2 * at(x, i - 1) + at(x, i - 2)) + 2 * (1 - a) * at(out, i - 1) - (1 - a) ** 2 * at(out, i - 2))
    return out


def test_decycler_oscillator(data):
    c = data["c"]
    one = [a - b for a, b in zip(c, high_pass(c, 20, 1), strict=True)]
    two = [a - b for a, b in zip(one, high_pass(one, 30, 1), strict=True)]
    fast = [120 * a / b for a, b in zip(high_pass(one, 20, 0.5), c, strict=True)]
    slow = [100 * a / b for a, b in zip(high_pass(two, 30, 0.5), c, strict=True)]
    check(data, "EhlersDecyclerOscillatorV1", {"FastEdo": fast, "SlowEdo": slow}, fast=20, slow=30)


def test_efficient_trend_step_channel(data):
    c, n = data["c"], 10
    twice = [2 * v for v in c]
    f, s = dev(twice, 5), dev(twice, 15)
    a, up = [], []
    for i in range(N):
        moved = sum(abs(c[j] - c[j - 1]) for j in range(max(1, i - n + 1), i + 1))
        er = abs(c[i] - c[i - n]) / moved if i >= n and moved else 0.0
        d = er * f[i] + (1 - er) * s[i]
        last = a[-1] if a else c[i]
        a.append(c[i] if c[i] > last + d or c[i] < last - d else last)
        up.append(a[-1] + d)
    check(data, "EfficientTrendStepChannel", {"MiddleBand": a, "UpperBand": up}, n=n, fast=5, slow=15)


def test_relative_volatility_of_highs_and_lows(data):
    def one(x):
        d = dev(x, 6, wilder)
        up = wilder([d[i] if x[i] > at(x, i - 1) else 0.0 for i in range(N)], 8)
        down = wilder([d[i] if x[i] < at(x, i - 1) else 0.0 for i in range(N)], 8)
        return [100.0 if q == 0 else 0.0 if p == 0 else 100 - 100 / (1 + p / q) for p, q in zip(up, down, strict=True)]

    want = [(a + b) / 2 for a, b in zip(one(data["h"]), one(data["l"]), strict=True)]
    check(data, "RelativeVolatilityIndexV2", {"Rvi": want}, n=6, smooth=8)


def test_relative_spread_strength(data):
    spread = [a - b for a, b in zip(ema(data["c"], 4), ema(data["c"], 9), strict=True)]
    check(data, "RelativeSpreadStrength", {"Rss": ema(rsi(spread, 7), 5)}, fast=4, slow=9, n=7)


def test_stationary_extrapolated_levels_oscillator(data):
    n, c = 8, data["c"]
    y = [a - b for a, b in zip(c, sma(c, n), strict=True)]
    ext = [(2 * at(y, i - n) - at(y, i - 2 * n)) / 2 for i in range(N)]
    high, low = ([f(ext[max(0, i - 1) : i + 1]) for i in range(N)] for f in (max, min))
    check(data, "StationaryExtrapolatedLevelsOscillator", {"Selo": stoch(ext, high, low, 2 * n)}, n=n)


def test_function_to_candles(data):
    want = {k: rsi(data[k[0].lower()], 9) for k in ("Close", "Open", "High", "Low")}
    check(data, "FunctionToCandles", want, n=9)


def test_quasi_white_noise(data):
    got = ta.indicator(data["df"], "QuasiWhiteNoise", n=5, noise=8)
    d = dev(values(got, "WhiteNoise"), 8, wilder)
    assert values(got, "WhiteNoiseStdDev") == pytest.approx(d)


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1e6])
@pytest.mark.parametrize("name", ["1LCLeastSquaresMovingAverage", "LinearRegressionLine", "OptimalWeightedMovingAverage", "LinearRegression", "WeightedMovingAverage", "EhlersCorrelationTrendIndicator"])
def test_prices_of_any_size(spark, data, name, scale):
    scaled = data["df"].selectExpr("symbol", "seq", "ts", *(f"{c} * {scale!r}D as {c}" for c in ("open", "high", "low", "close")), "volume")
    key = ta.indicator(data["df"], name).columns[2]
    want = values(ta.indicator(data["df"], name), key)
    by = 1.0 if name.startswith("Ehlers") else scale
    got = [v / by for v in values(ta.indicator(scaled, name), key)]
    assert got == pytest.approx(want, rel=1e-6, abs=1e-6)


def test_digits_are_kept_in_a_long_series(spark, data):
    from pyspark.sql import functions as F

    from tickloom.operators.registry import Context

    s = Context()
    bars = data["df"].filter("seq > 20")
    want = values(ta.indicator(bars, "LinearRegression"), "LinearRegression")[20:]
    line_, weighted = s.linreg(s.x, 14), s.wma(s.x, 14)
    far = bars.withColumn("rn", F.col("seq") - 20 + F.lit(1e9))
    sql = [[(n.name, n.expr.sql) for n in nodes if n.name != "rn"] for _, nodes in s.stages([line_, weighted])]
    for nodes in sql:
        if nodes:
            far = far.selectExpr("*", *(f"{e} as {n}" for n, e in nodes))
    got = far.selectExpr("symbol", "seq", f"{line_.sql} as line", f"{weighted.sql} as weighted")
    assert values(got, "line")[20:] == pytest.approx(want, abs=1e-6)
    assert values(got, "weighted")[20:] == pytest.approx(values(ta.indicator(bars, "WeightedMovingAverage"), "Wma")[20:], abs=1e-6)
