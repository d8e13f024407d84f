"""Indicators that read many of their own last values against loops that share no code with them."""

from __future__ import annotations

import math
from statistics import mean, median

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import indicators as ta

from .test_indicators import bars, sma, values
from .test_more_indicators import walk


def last(x, i, n):
    return x[max(0, i - n + 1) : i + 1]


def corr(a, b):
    if len(a) < 2 or np.std(a) < 1e-4 or np.std(b) < 1e-4:
        return 0.0
    return abs(float(np.corrcoef(a, b)[0, 1]))


def means(x, n):
    return [mean(last(x, i, n)) for i in range(len(x))]


def spread(x, n):
    gaps = [(v - m) ** 2 for v, m in zip(x, sma(x, n), strict=True)]
    return [math.sqrt(v) for v in sma(gaps, n)]


def check(spark, name, x, want, key, **params):
    got = values(ta.indicator(bars(spark, {"A": x}), name, **params), key)
    assert got == pytest.approx(want, abs=1e-5)


def test_corrected_moving_average(spark):
    x, n, out = walk(60), 5, []
    m = sma(x, n)
    dev = spread(m, n)  # of the average
    for i in range(60):
        before = out[-1] if out else m[i]
        a, b = dev[i] ** 2, (before - m[i]) ** 2
        ratio = 1.0 if a == 0 or b == 0 else b / (a + b)
        err, old = 1.0, 1.0
        k = 1.0
        for _ in range(5001):
            if err > 1e-5:
                k = ratio * old * (2 - old)
                err, old = old - k, k
        out.append(before + k * (m[i] - before))
    check(spark, "CorrectedMovingAverage", x, out, "Cma", n=n)


def test_percentage_trend(spark):
    x, n, pct, out = walk(50, 4), 6, 0.01, []
    at = lambda i: x[i] if i >= 0 else 0.0
    for i in range(50):
        stop, age = x[i], 0
        for j in range(1, n + 1):
            a, b = at(i - j + 1), at(i - j)
            if (a <= stop < b) or (a >= stop > b):
                age = 0
            seen = [b] + [at(i - p) for p in range(age + 1)]
            age += 1
            stop = max(seen) * (1 - pct) if b > stop else min(seen) * (1 + pct)
        out.append(stop)
    check(spark, "PercentageTrend", x, out, "Pti", n=n, pct=pct)


def test_optimal_weighted_moving_average(spark):
    x, n, out, before = walk(40), 4, [], []
    for i in range(40):
        before.append(out[-1] if out else 0.0)
        r = corr(last(x, i, n), last(before, i, n))
        w = [(n - j) ** r for j in range(n)]
        out.append(sum(w[j] * (x[i - j] if i >= j else 0.0) for j in range(n)) / sum(w))
    check(spark, "OptimalWeightedMovingAverage", x, out, "Owma", n=n)


def test_fisher_least_squares(spark):
    x, n, out, gaps = walk(40), 5, [], []
    m, dev = sma(x, n), spread(x, n)
    place = [float(i) for i in range(40)]
    pm, pd_ = sma(place, n), spread(place, n)
    for i in range(40):
        gaps.append(x[i] - (out[-1] if out else x[i]))
        size = mean(abs(g) for g in last(gaps, i, n))
        r = math.tanh(mean(last(gaps, i, n)) / size) if size else 0.0
        out.append(m[i] + ((i - pm[i]) / pd_[i] * r if pd_[i] else 0.0) * dev[i])
    check(spark, "FisherLeastSquaresMovingAverage", x, out, "Flsma", n=n)


def test_median_average_adaptive_filter(spark):
    x, n, limit, out, v = walk(50, 2), 9, 0.01, [], 0.0
    at = lambda i: x[i] if i >= 0 else 0.0
    u = [(at(i) + 2 * at(i - 1) + 2 * at(i - 2) + at(i - 3)) / 6 for i in range(50)]
    for i in range(50):
        k, gap, y = n, 0.2, 0.0
        while gap > limit and k > 0:
            y = 2 / (k + 1) * u[i] + (1 - 2 / (k + 1)) * v
            m = median(last(u, i, k))
            gap = abs(m - y) / m if m else gap
            k -= 2
        v, a = y, 2 / (max(k, 3) + 1)
        out.append(a * u[i] + (1 - a) * (out[-1] if out else 0.0))
    check(spark, "EhlersMedianAverageAdaptiveFilter", x, out, "Maaf", n=n, threshold=limit)


def test_auto_line_with_drift(spark):
    x, n, out = walk(60, 7), 6, []
    dev = spread(x, n)
    for i in range(60):
        before = out[-1] if out else float(round(x[i]))
        prior = out[i - n - 1] if i >= n + 1 else float(round(x[i]))
        out.append(x[i] if abs(x[i] - before) > dev[i] else before + (before - prior) / (2 * n))
    check(spark, "AutoLineWithDrift", x, out, "Alwd", n=n)


def test_recursive_stochastic_and_grand_trend(spark):
    x, n, k, m = walk(60, 5), 7, [], []
    for i in range(60):
        w = last(x, i, n)
        m.append(0.1 * ((x[i] - min(w)) / (max(w) - min(w)) * 100 if max(w) > min(w) else 0.0) + 0.9 * (k[-1] if k else 0.0))
        w = last(m, i, n)
        k.append((m[i] - min(w)) / (max(w) - min(w)) * 100 if max(w) > min(w) else 0.0)
    check(spark, "RecursiveStochastic", x, k, "Rsto", n=n)
    t, g = [], []
    for i in range(60):
        g.append(0.9 * (t[i - n] if i >= n else x[i]))
        t.append(g[i] + 0.1 * x[i] + g[i] - (g[i - n] if i >= n else x[i]))
    check(spark, "GrandTrendForecasting", x, means(t, n), "Gtf", n=n, forecast=9)
    ahead = [2 * t[i] - (t[i - 9] if i >= 9 else 0.0) for i in range(60)]
    gap = [abs(x[i] - (ahead[i - 9] if i >= 9 else 0.0)) for i in range(60)]
    check(spark, "GrandTrendForecasting", x, [a + 2 * d for a, d in zip(ahead, means(gap, 9), strict=True)], "UpperBand", n=n, forecast=9)


def test_primes(spark):
    x, out, up, down, y = walk(60, 9), [], 0, 0, 0.0
    for v in x:
        ok = lambda j, v=v: all(j % k for k in range(2, round(math.sqrt(v)) + 1))
        up = next((j for j in range(round(v), round(v + v / 20) + 1) if ok(j)), up)
        down = next((j for j in range(round(v), round(v - v / 20) - 1, -1) if ok(j)), down)
        p = up - v if up - v < v - down else down - v
        y = p or y
        out.append(y)
    check(spark, "PrimeNumberOscillator", x, out, "Pno")


def test_spearman(spark):
    x, n, out = [float(round(v)) for v in walk(40, 11)], 6, []
    for i in range(40):
        w = pd.Series(last(x, i, n))
        a, b = w.rank(), w.sort_values(ignore_index=True).rank()
        out.append(100 * float(np.corrcoef(a, b)[0, 1]) if a.nunique() > 1 else 0.0)
    check(spark, "SpearmanIndicator", x, out, "Si", n=n)


def test_jma_rsx(spark):
    x, n, out = walk(40, 13), 8, []
    k, s, before = 3 / (n + 2), [0.0] * 12, 0.0
    for i, v in enumerate(x):
        move, before = 100 * (v - before), v
        ends = []
        for base, e in ((0, move), (6, abs(move))):
            for j in range(base, base + 6, 2):
                s[j] += k * (e - s[j])
                s[j + 1] += k * (s[j] - s[j + 1])
                e = 1.5 * s[j] - 0.5 * s[j + 1]
            ends.append(e)
        out.append(min(max((ends[0] / ends[1] + 1) * 50, 0), 100) if i >= 5 and ends[1] > 0 else 50.0)
    check(spark, "JmaRsxClone", x, out, "Rsx", n=n)
