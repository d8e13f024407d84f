"""Indicators with searches and array state against loops over plain lists."""

from __future__ import annotations

import math
from statistics import median

import pytest

from tickloom.operators import indicators as ta
from tickloom.operators.registry import AVERAGES

from .test_indicators import bars, values
from .test_more_indicators import candles, rsi, walk
from .test_nested_inputs import N, at, check, data, ema, wma  # noqa: F401

PI = math.pi


def unit(x):
    return min(max(x, 0.01), 0.99)


def bank(x, low, high, n1, n2):
    """(dominant cycle, smoothed high-pass)."""
    w = unit(2 * PI / n1)
    a1 = (1 - math.sin(w)) / math.cos(w)
    hp, y, q1, re, im, dc, out = [], [], [], [], [], [], []
    for i, v in enumerate(x):
        hp.append(v if i < 7 else 0.5 * (1 + a1) * (v - at(x, i - 1)) + a1 * at(hp, i - 1))
        y.append(v - at(x, i - 1) if i < 7 else sum(k * at(hp, i - j) for j, k in enumerate((1, 2, 3, 3, 2, 1))) / 12)
        num = den = top = 0.0
        delta = max(0.5 - 0.015 * i, 0.15)
        for j in range(low, high + 1):
            beta, g = math.cos(unit(2 * PI / j)), 1 / math.cos(unit(4 * PI * delta / j))
            a = g - math.sqrt(g * g - 1)
            q = j / PI * 2 * (y[i] - at(y, i - 1))
            r = 0.5 * (1 - a) * (y[i] - at(y, i - j)) + beta * (1 + a) * at(re, i - j) - a * at(re, i - 2 * j)
            m = 0.5 * (1 - a) * (q - at(q1, i - j)) + beta * (1 + a) * at(im, i - j) - a * at(im, i - 2 * j)
            p = r * r + m * m
            top = max(top, p)
            db = min(-n2 * math.log(0.01 / (1 - 0.99 * p / top)) / math.log(n2), high) if top and p / top > 0 else 0.0
            num, den = num + (j * (high - db) if db <= 3 else 0), den + (high - db if db <= 3 else 0)
        q1.append(q)
        re.append(r)
        im.append(m)
        dc.append(num / den if den else 0.0)
        out.append(median(dc[-n2:]))
    return out, y


def test_filter_bank_and_what_follows_it(data):  # noqa: F811
    args = {"low": 6, "high": 14, "n1": 20, "n2": 5}
    c, y = bank(data["c"], **args)
    check(data, "EhlersSpectrumDerivedFilterBank", {"Esdfb": c}, **args)
    v, w = [], []
    for i in range(N):
        turn = lambda t: unit(t / c[i]) if c[i] else 0.99  # noqa: E731, B023
        g = 1 / math.cos(turn(4 * PI * max(0.5 - 0.015 * i, 0.15)))
        a, b = g - math.sqrt(g * g - 1), math.cos(turn(2 * PI))
        v.append(0.5 * (1 - a) * (y[i] - at(y, i - 1)) + b * (1 + a) * at(v, i - 1) - a * at(v, i - 2))
        w.append(c[i] / PI * 2 * (v[i] - at(v, i - 1)))
    check(data, "EhlersDominantCycleTunedBypassFilter", {"V1": v, "V2": w}, **args)
    pull = [q * (unit(2 * PI / k) if k else 0.99) ** 2 for q, k in zip(data["v"], c, strict=True)]
    check(data, "EhlersRestoringPullIndicator", {"Rpi": pull, "Signal": ema(pull, 6)}, **args)


def test_mesa_predict(data):  # noqa: F811
    x, n1, n2, n3, lower, upper = data["c"], 3, 4, 6, 7, 15

    def poles(n):
        a = math.exp(-unit(math.sqrt(2) * PI / n))
        return 2 * a * math.cos(unit(math.sqrt(2) * PI / n)), -a * a

    (b2, b3), (f2, f3) = poles(upper), poles(lower)
    hp, ssf, pre = [], [], []
    for i in range(N):
        hp.append(0.0 if i < 4 else (1 + b2 - b3) / 4 * (x[i] - 2 * x[i - 1] + x[i - 2]) + b2 * hp[i - 1] + b3 * hp[i - 2])
        ssf.append(hp[i] if i < 3 else (1 - f2 - f3) * (hp[i] + hp[i - 1]) / 2 + f2 * ssf[i - 1] + f3 * ssf[i - 2])
        one, two, coef, olds = [0.0] * 500, [0.0] * 500, [0.0] * 500, [0.0] * 500
        one[1], two[upper - 1] = ssf[i], at(ssf, i - upper + 1)
        for j in range(2, upper):
            one[j] = two[j - 1] = at(ssf, i - j + 1)
        for j in range(1, n2 + 1):
            if j > 1:
                olds[1:j] = coef[1:j]
                for k in range(1, upper):
                    one[k] = one[k] - olds[j - 1] * two[k]
                    two[k] = two[k + 1] - olds[j - 1] * one[k + 1]
            top = sum(one[k] * two[k] for k in range(1, upper - j + 1))
            den = sum(one[k] ** 2 + two[k] ** 2 for k in range(1, upper - j + 1))
            coef[j] = 2 * top / den if den else 0.0
            for k in range(1, j):
                coef[k] = olds[k] - coef[j] * olds[j - k]
        shifted = [0.0] * 500
        for j in range(1, n2 + 1):
            shifted[1] = coef[j]
            for k in range(lower, 1, -1):
                shifted[k] = shifted[k - 1]
        hann = [1 - math.cos(unit(2 * PI * k / (lower + 1))) for k in range(1, lower + 1)]
        h = sum(a * b for a, b in zip(hann, shifted[1:], strict=False)) / sum(hann)
        xx = [0.0] + [at(ssf, i - upper + j) for j in range(1, upper + 1)]
        for _ in range(n3):
            xx.append(sum(h * xx[-k] for k in range(1, n2 + 1)))
        pre.append(xx[upper + n1])
    want = [(pre[i] + at(pre, i - 1)) / 2 for i in range(N)]
    check(data, "EhlersMesaPredictIndicatorV1", {"Ssf": ssf, "PrePredict": pre, "Predict": want}, n1=n1, n2=n2, n3=n3, lower=lower, upper=upper)


@pytest.mark.parametrize("n", [4, 6, 14])
def test_anticipate(spark, data, n):  # noqa: F811
    f, want = values(ta.indicator(data["df"], "EhlersImpulseResponse", n=n), "Eir"), []
    for i in range(N):
        most, start = -1.0, 0
        for j in range(n):
            x = [at(f, i - k) for k in range(n)]
            y = [-math.sin(unit(2 * PI * (j + k) / n)) for k in range(n)]
            vx, vy = n * sum(a * a for a in x) - sum(x) ** 2, n * sum(b * b for b in y) - sum(y) ** 2
            ok = vx > 0 and vy > 1e-9
            corr = (n * sum(a * b for a, b in zip(x, y, strict=True)) - sum(x) * sum(y)) / math.sqrt(vx * vy) if ok else 0.0
            start = n - j if corr > most else 0
            most = max(most, corr)
        want.append(math.sin(unit(2 * PI * start / n)))
    check(data, "EhlersAnticipateIndicator", {"Predict": want}, n=n)


def test_convolution(data):  # noqa: F811
    n1, n2, n3 = 20, 10, 12
    w = math.sqrt(2) * PI / n1
    a = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    x, hp, f, conv, slope = data["c"], [], [], [], []
    e = math.exp(-math.sqrt(2) * PI / n2)
    b, c = 2 * e * math.cos(math.sqrt(2) * PI / n2), -e * e
    for i in range(N):
        hp.append((1 - a / 2) ** 2 * (x[i] - 2 * at(x, i - 1) + at(x, i - 2)) + 2 * (1 - a) * at(hp, i - 1) - (1 - a) ** 2 * at(hp, i - 2))
        f.append((1 - b - c) * (hp[i] + at(hp, i - 1)) / 2 + b * at(f, i - 1) + c * at(f, i - 2))
        p, q, n = [at(f, i - j) for j in range(n3)], [at(f, i - j - 1) for j in range(n3)], i + 1
        v = (n * sum(k * k for k in p) - sum(p) ** 2) * (n * sum(k * k for k in q) - sum(q) ** 2)
        corr = (n * sum(k * l for k, l in zip(p, q, strict=True)) - sum(p) * sum(q)) / math.sqrt(v) if v > 0 else 0.0
        conv.append((1 + math.exp(3 * corr) - 1) / (math.exp(3 * corr) + 1) / 2)
        slope.append(-1.0 if at(f, i - math.ceil(0.5 * n)) < f[i] else 1.0)
    check(data, "EhlersConvolutionIndicator", {"Eci": conv, "Slope": slope}, n1=n1, n2=n2, n3=n3)


@pytest.mark.parametrize("flat", [False, True])
def test_count_back_line(spark, flat):
    n = 5
    if flat:  # ties at the edges of the window, and equal bars
        x = [float(v) for v in (3, 3, 2, 2, 3, 4, 4, 2, 2, 2, 5, 3, 2, 2, 3, 4, 4, 4, 1, 1, 2, 2, 3)]
        df = bars(spark, {"A": x})
        rows = [(v + 1, v - 1, v) for v in x]
    else:
        given, df = candles(spark, 70, 8)
        rows = [(r[4], r[5], r[6]) for r in given]
    h, l = [r[0] for r in rows], [r[1] for r in rows]
    want = []
    for i, (_, _, line) in enumerate(rows):
        top, bottom = max(h[max(0, i - n + 1) : i + 1]), min(l[max(0, i - n + 1) : i + 1])
        ups = downs = 0
        for j in range(n + 1):
            low, high = at(l, i - j), at(h, i - j)
            if low == bottom:
                for k in range(j + 1, j + n + 1):
                    downs += at(h, i - k) > high
                    if downs == 2:
                        line = at(h, i - k)
                        break
            if high == top:
                for k in range(j + 1, j + n + 1):
                    ups += at(l, i - k) > low
                    if ups == 2:
                        line = at(l, i - k)
                        break
        want.append(line)
    assert values(ta.indicator(df, "GuppyCountBackLine", n=n), "Cbl") == pytest.approx(want)


def test_mobility(data):  # noqa: F811
    n1, n2, h, l, x = 4, 6, data["h"], data["l"], data["c"]
    mo = []
    for i in range(N):
        top, bottom = max(h[max(0, i - n2 + 1) : i + 1]), min(l[max(0, i - n2 + 1) : i + 1])
        then, width = at(x, i - n2), (top - bottom) / n1
        most = here = 0.0
        for j in range(1, n1 + 1):
            up = bottom + j * width
            down = up - width
            peak, base = at(h, i - j), at(l, i - j)
            for k in range(2, n2):
                peak, base = max(peak, at(h, i - j - k)), min(base, at(l, i - j - k))
            part = (peak - base) / n1
            d, u, mass = base + (j - 1) * part, base + j * part, 0.0
            for k in range(1, n2 + 1):
                high, low = at(h, i - j - k), at(l, i - j - k)
                if high <= u:
                    mass += 1
                if high <= u or low >= u:
                    if high <= d:
                        mass -= 1
                    if not (high <= down or low >= d):
                        mass -= (d - low) / (high - low) if high != low else 0.0
                else:
                    mass += (u - low) / (high - low) if high != low else 0.0
            mass /= n2
            most = mass if j == 1 else max(most, mass)
            here = mass if j == 1 or down < then <= up else here
        y = 100 * (1 - here / most) if most else 0.0
        mo.append(y if then < bottom + 0.5 * width else -y)
    want = wma(mo, 3)
    check(data, "MobilityOscillator", {"Mo": want, "Signal": wma(want, 3)}, n1=n1, n2=n2, signal=3)


@pytest.mark.parametrize("n", [7, 24])
def test_market_meanness(data, n):  # noqa: F811
    x = data["c"]

    def net(v, i):
        w = [at(v, i - j) for j in range(n)]
        sign = lambda a: (a > 0) - (a < 0)
        return -sum(sign(w[j] - w[k]) for j in range(n) for k in range(j)) / (0.5 * n * (n - 1))

    y = []
    for i in range(N):
        m = median(x[max(0, i - n + 1) : i + 1])
        pairs = [(at(x, i - j + 1), at(x, i - j)) for j in range(1, n)]
        y.append(100 * sum((a > m and a > b) or (a < m and a < b) for a, b in pairs) / (n - 1))
    check(data, "MarketMeannessIndex", {"Mmi": y, "MmiSmoothed": [net(y, i) for i in range(N)]}, n=n)


def test_a_long_noise_elimination_counts_pairs(data):  # noqa: F811
    x = data["c"]
    want = [-sum((at(x, i - j) > at(x, i - k)) - (at(x, i - j) < at(x, i - k)) for j in range(30) for k in range(j)) / 435 for i in range(N)]
    check(data, "EhlersNoiseEliminationTechnology", {"Enet": want}, n=30)


def test_values_of_other_rows_and_array_state_in_segments(data):  # noqa: F811
    for name, params in (("EhlersConvolutionIndicator", {"n1": 20, "n2": 10, "n3": 12}), ("EhlersMesaPredictIndicatorV1", {"n1": 2, "lower": 6, "upper": 12})):
        a, b = (ta.indicator(data["df"], name, segment_rows=k, **params).orderBy("seq").collect() for k in (None, 20))
        for p, q in zip(a, b, strict=True):
            for c in p.asDict():
                assert q[c] == (pytest.approx(p[c], abs=1e-8) if isinstance(p[c], float) else p[c])


def test_other_outputs_of_averages(spark):
    x = walk(60)
    df = bars(spark, {"A": x})
    er = [abs(x[i] - x[i - 10]) / sum(abs(x[j] - x[j - 1]) for j in range(i - 9, i + 1)) if i >= 10 else 0.0 for i in range(60)]
    assert values(ta.indicator(df, "KaufmanAdaptiveMovingAverage"), "Er")[10:] == pytest.approx(er[10:])
    assert ta.indicator(df, "EhlersMotherOfAdaptiveMovingAverages").columns[2:-1] == ["Fama", "Mama", "I1", "Q1", "SmoothPeriod", "Smooth", "Real", "Imag"]
    assert set(ta.indicator(df, "VariableLengthMovingAverage").columns) >= {"Length", "Vlma"}
    assert set(ta.indicator(df, "PoweredKaufmanAdaptiveMovingAverage").columns) >= {"Per", "Pkama"}
    assert set(ta.indicator(df, "AdaptiveAutonomousRecursiveMovingAverage").columns) >= {"D", "Aarma"}
    beta = (1 - math.cos(2 * PI / 14)) / (2**0.5 - 1)
    a, want = -beta + math.sqrt(beta**2 + 2 * beta), []
    for i in range(60):
        want.append(a * a * x[i] + 2 * (1 - a) * at(want, i - 1) - (1 - a) ** 2 * at(want, i - 2))
    assert values(ta.indicator(df, "EhlersGaussianFilter"), "Egf2") == pytest.approx(want)
    fama = values(ta.indicator(df, "EhlersMotherOfAdaptiveMovingAverages"), "Fama")
    bands = ta.indicator(df, "BollingerBands", ma="FollowingAdaptiveMovingAverage", n=14)
    assert values(bands, "MiddleBand") == pytest.approx(fama)


@pytest.mark.parametrize("kind", sorted(AVERAGES))
def test_every_average_can_be_asked_for_by_name(kind):
    from tickloom.operators.registry import Context

    s = Context()
    if kind in ("DynamicallyAdjustableMovingAverage", "EhlersAdaptiveLaguerreFilter", "EhlersDeviationScaledSuperSmoother", "EhlersRecursiveMedianFilter", "EhlersVariableIndexDynamicAverage"):
        with pytest.raises(ValueError, match="has no values without"):
            s.ma(kind, s.x, 20)
        out = s.ma(kind, s.x, 20, 5, 20)
    else:
        out = s.ma(kind, s.x, 20)
    assert s.stages([s.let(out)])


def test_lengths_that_averages_are_given(spark):
    from tickloom.operators.registry import Context

    x = walk(60)
    df = bars(spark, {"A": x})

    def of(kind, n, *more):
        s = Context()
        return values(s.frame(df, {"y": s.ma(kind, s.x, n, *more)}), "y")

    assert of("VariableLengthMovingAverage", 20) == pytest.approx(values(ta.indicator(df, "VariableLengthMovingAverage", n=20, short=0), "Vlma"))
    assert of("AdaptiveMovingAverage", 9) == pytest.approx(values(ta.indicator(df, "AdaptiveMovingAverage", n=9, fast=0, slow=9), "Ama"))
    assert of("EhlersDeviationScaledMovingAverage", 9) == pytest.approx(values(ta.indicator(df, "EhlersDeviationScaledMovingAverage", n=18, fast=9), "Edsma"))
    assert of("MiddleHighLowMovingAverage", 9, 4, 12) == pytest.approx(values(ta.indicator(df, "MiddleHighLowMovingAverage", n=12, short=4), "Mhlma"))
    assert of("EhlersFilter", 9) == [0.0] * 60



def test_recursive_relative_strength(data):  # noqa: F811
    n, x = 5, data["c"]
    change = [x[i] - x[i - n] if i >= n else 0.0 for i in range(N)]
    src = [sum(change[i - n + 1 : i + 1]) / n if i + 1 >= n else 0.0 for i in range(N)]
    r, b, avg, up = rsi(src, n), [], [], []
    for i in range(N):
        avg.append((r[i] + (b[i - n] if i >= n else src[i])) / 2)
        move = round(avg[i] - at(avg, i - n), 9)
        up.append(100.0 if move >= 0 else 0.0)
        b.append(sum(up[i - n : i]) / n if i >= n else up[i])
    check(data, "RecursiveRelativeStrengthIndex", {"Rrsi": b}, n=n)


def test_adaptive_band_pass(data):  # noqa: F811
    n1, n2, n3 = 16, 6, 3
    cycle = ta.Indicators(data["df"]).then("EhlersAutoCorrelationPeriodogram", n1=n1, n2=n2, n3=n3)
    d = values(cycle.frame(), "Eacp")
    x = values(ta.Indicators(data["df"]).then("EhlersAutoCorrelationPeriodogram", n1=n1, n2=n2, n3=n3).then("EhlersRoofingFilterV2", upper=n1, lower=n2).frame(), "Erf")
    bp, out, peak = [], [], 0.0
    for i in range(N):
        size = min(max(d[i], n3), n1)
        g = 1 / math.cos(2 * PI * 0.3 / 0.9 * size)
        a, b = unit(g - math.sqrt(g * g - 1)), math.cos(2 * PI / 0.9 * size)
        bp.append(0.5 * (1 - a) * (x[i] - at(x, i - 2)) + b * (1 + a) * at(bp, i - 1) - a * at(bp, i - 2) if i > 2 else 0.0)
        peak = max(0.991 * peak, abs(bp[i]))
        out.append(bp[i] / peak if peak else 0.0)
    check(data, "EhlersAdaptiveBandPassFilter", {"Eabpf": out, "Signal": [0.9 * at(out, i - 1) for i in range(N)]}, n1=n1, n2=n2, n3=n3)
