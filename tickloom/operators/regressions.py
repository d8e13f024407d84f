"""Regressions and averages with a memory of their own errors, and what builds on them."""

from __future__ import annotations

import math

from tickloom.functions.expr import E, abs_, ceil, clamp, div, lit, log, mn, mx, power, sq, sqrt, where

from .averages import _hold
from .channels import so_far
from .composites import nearest
from .cycles import _median
from .momentum import turned
from .registry import AVERAGES, EMA, SMA, average, indicator
from .volatility import vol

KAMA = "KaufmanAdaptiveMovingAverage"


def fitted(s, y, x, n, ma, dev_y=None):
    """The line through the averages of y and x at x; its slope is |correlation| times the ratio of two deviations."""
    my, mx_ = s.ma(ma, y, n), s.ma(ma, x, n)
    dev_y = s.sd(my, n, ma) if dev_y is None else dev_y
    slope = s.let(abs_(s.corr(y, x, n)) * div(dev_y, s.sd(x, n, ma)))
    return s.let(x * slope + my - slope * mx_)


@average("Arma")
def AutonomousRecursiveMovingAverage(s, x, n=14, mom=7, gamma=3.0):
    then = s.let(where(s.rn > n, s.lag(x, mom), 0.0))
    rows = s.let(mn(s.rn, n))

    def step(o, new):
        last = s.first(x, o["a0"])
        new["all"] = o["all"] + abs_(then - last)
        d = div(new["all"], s.i) * gamma
        new["c0"] = where(x > last + d, x + d, where(x < last - d, x - d, last))
        for j in range(n - 1, 0, -1):
            new[f"c{j}"] = o[f"c{j - 1}"]
        new["m0"] = sum((new[f"c{j}"] for j in range(1, n)), new["c0"]) / rows
        for j in range(n - 1, 0, -1):
            new[f"m{j}"] = o[f"m{j - 1}"]
        new["a0"] = sum((new[f"m{j}"] for j in range(1, n)), new["m0"]) / rows

    return s.machine({"all": 0.0, "a0": 0.0} | {f"{k}{j}": 0.0 for k in "cm" for j in range(n)}, step)["a0"]


@average("Als")
def AdaptiveLeastSquares(s, x, n=500, smooth=1.5):
    x, i = s.let(x), s.let(s.i)
    t = s.tr(x)
    alpha = s.let(where(s.max(t, n).ne(0), clamp(power(div(t, s.max(t, n)), smooth), 0.99, 0.01), 0.01))
    of = lambda e: s.smooth(s.let(e), alpha, seed=s.let(e))
    ax, ay = of(i), of(x)
    dx, dy, xx, yy, xy = of(abs_(i - ax)), of(abs_(x - ay)), of(i * i), of(x * x), of(i * x)
    k = s.let(sq(s.let(div(2, alpha) + 1)))
    r = s.let(div((xy - dx * dy) * k, sqrt((xx - sq(dx)) * k * ((yy - sq(dy)) * k))))
    a = s.let(r * div(dy, dx))
    return s.let(ax * a + ay - a * ax)


@average("Af")
def AutoFilter(s, x, n=500, ma=SMA):
    x = s.let(x)
    dev = s.sd(s.ma(ma, x, n), n, ma)
    return fitted(s, x, _hold(s, x, dev), n, ma, dev)


@average("LinReg")
def LinearRegressionLine(s, x, n=14, ma=SMA):
    return fitted(s, s.let(x), s.let(s.i), n, ma)


@average("Tslsma")
def TStepLeastSquaresMovingAverage(s, x, n=100, sc=0.5, ma=SMA):
    x = s.let(x)
    wide = s.let(2 - s.er(x, n))

    def step(o, new):
        last = s.first(x, o["b"])
        new["all"] = o["all"] + abs_(x - last)
        a = new["all"] / s.rn * wide
        new["b"] = where((x > last + a) | (x < last - a), x, last)

    b = s.machine({"all": 0.0, "b": 0.0}, step)["b"]
    return fitted(s, x, b, n, ma, s.sd(s.ma(KAMA, x, n), n, ma))


def _quadratic(s, x, n, ma, ahead):
    i = s.let(s.i)
    q = s.let(i * i)
    m, a1, a2 = s.ma(ma, x, n), s.ma(ma, i, n), s.ma(ma, q, n)
    both = s.let(s.ma(ma, i * q, n) - a1 * a2)
    c2, c1 = s.let(s.ma(ma, q * x, n) - a2 * m), s.let(s.ma(ma, i * x, n) - a1 * m)
    v1, v2 = s.sd(i, n, ma), s.sd(q, n, ma)
    norm = s.let(v2 * v1 - sq(both))
    a, b = s.let(div(c2 * v1 - c1 * both, norm)), s.let(div(c1 * v2 - c2 * both, norm))
    c = s.let(m - a * a2 - b * a1)
    return [s.let(a * sq(i + k) + b * (i + k) + c) for k in (0, ahead)]


@average("Qlma")
def QuadraticLeastSquaresMovingAverage(s, x, n=50, ma=SMA):
    return _quadratic(s, s.let(x), n, ma, 0)[0]


@indicator("Trend", name="QuadraticLeastSquaresMovingAverage")
def _quadratic_lines(s, ma=SMA, n=50, ahead=14):
    y, f = _quadratic(s, s.x, n, ma, ahead)
    return s.result({"Qlma": y, "Forecast": f}, s.compare(s.x - y))


@average("QuadReg")
def QuadraticRegression(s, x, n=500, ma=SMA):
    """The normal equations of degree two; sums are taken over the rows there are and divided by n."""
    x, i = s.let(x), s.let(s.i)
    q = s.let(i * i)
    sx, s1, s2 = s.sum(x, n), s.sum(i, n), s.sum(q, n)
    s11, s12 = s.let(s2 - sq(s1) / n), s.let(s.sum(s.let(i * q), n) - s1 * s2 / n)
    s22 = s.let(s.sum(s.let(q * q), n) - sq(s2) / n)
    y1, y2 = s.let(s.sum(s.let(x * i), n) - sx * s1 / n), s.let(s.sum(s.let(x * q), n) - sx * s2 / n)
    bottom = s.let(s22 * s11 - sq(s12))
    b, c = s.let(div(y1 * s22 - y2 * s12, bottom)), s.let(div(y2 * s11 - y1 * s12, bottom))
    return s.let(s.ma(ma, x, n) - b * s.ma(ma, i, n) - c * s.ma(ma, q, n) + b * i + c * q)


@average("Llsma")
def LightLeastSquaresMovingAverage(s, x, n=250, ma=SMA):
    i = s.let(s.i)
    a, b = s.ma(ma, x, n), s.ma(ma, x, max(2, math.ceil(n / 2)))
    dev = s.sd(b, n, ma)
    return s.let(a + div(i - s.ma(ma, i, n), s.sd(i, n, ma)) * div(b - a, dev) * dev)


def nearest_rank(s, x: E, n: int, shares: tuple[float, ...]) -> list[E]:
    """Values of the last n rows that the given shares of them do not exceed: the largest with fewer than so many below."""
    v = [s.lag(x, j) for j in range(n)]
    below = []
    for a in range(n):
        c = lit(0.0)
        for b in range(n):
            if a != b:
                c = c + where((s.rn > b) & (v[b] < v[a]), 1.0, 0.0)
        below.append(s.let(c))
    rows, out = mn(s.rn, n), []
    for share in shares:
        k = s.let(mx(ceil(rows * share), 1))
        out.append(s.let(mx(*(where((s.rn > a) & (below[a] < k), v[a], -1e300) for a in range(n)))))
    return out


def trimean(s, x, n):
    q1, m, q3 = nearest_rank(s, s.let(x), n, (0.25, 0.5, 0.75))
    return s.let((q1 + m * 2 + q3) / 4), q1, m, q3


@average("Trimean")
def Trimean(s, x, n=14):
    return trimean(s, x, n)[0]


@indicator("Trend", name="Trimean")
def _trimean_lines(s, n=14):
    y, a, b, c = trimean(s, s.x, n)
    return s.result({"Trimean": y, "Q1": a, "Median": b, "Q3": c}, s.compare(s.x - y))


@indicator("Trend")
def InterquartileRangeBands(s, n=14, mult=1.5):
    _, a, _, c = trimean(s, s.x, n)
    d = s.let((c - a) * mult)
    return s.band_result(c + d, (a + c) / 2, a - d, "compare")


@average("Orma")
def OvershootReductionMovingAverage(s, x, n=14, ma=SMA):
    """The line's reach shrinks with the last error, in relation to the largest average of them."""
    x, i, half = s.let(x), s.let(s.i), math.ceil(n / 2)
    m = s.ma(ma, x, n)
    reach = s.let(div(i - s.ma(ma, i, n), s.sd(i, n, ma)) * abs_(s.corr(i, x, n)) * s.sd(m, n, ma))
    before, rows = s.lag(x, 1), s.let(mn(s.rn, half))

    def step(o, new):
        last = where((s.rn > 1) & o["d"].ne(0), o["d"], before)
        new["b0"] = abs_(last - x)
        for j in range(half - 1, 0, -1):
            new[f"b{j}"] = o[f"b{j - 1}"]
        new["m0"] = sum((new[f"b{j}"] for j in range(1, half)), new["b0"]) / rows
        for j in range(n - 1, 0, -1):
            new[f"m{j}"] = o[f"m{j - 1}"]
        new["d"] = m + reach * div(new["b0"], mx(*(new[f"m{j}"] for j in range(n))))

    return s.machine({"d": 0.0} | {f"b{j}": 0.0 for j in range(half)} | {f"m{j}": 0.0 for j in range(n)}, step)["d"]


@average("Kalsma")
def KaufmanAdaptiveLeastSquaresMovingAverage(s, x, n=100, ma=KAMA):
    k = s.of("KaufmanAdaptiveCorrelationOscillator", x, ma=ma, n=n).outputs
    a = s.let(div(k["SrcSt"], k["IndexSt"]) * k["Kaco"])
    return s.let(a * s.i + s.ma(ma, x, n) - a * s.ma(ma, s.i, n))


@average("Vma")
def VolatilityMovingAverage(s, x, n=20, lb=10, smooth=3, ma=SMA):
    """Linear weights over fewer rows the farther x is from its mean."""
    x = s.let(x)
    m = s.ma(ma, x, lb)
    k = s.ma(ma, div((x - m) * 100, s.sd(m, lb, ma)), smooth)
    far = s.let(nearest(s.let(abs_(clamp(k, 100, -100)) / lb)))
    size = s.let(nearest(s.let(mx(n - far * (n / 10), 1))))
    top, bottom = lit(0.0), lit(0.0)
    for j in range(n):
        w = mx(size - j, 0)
        top, bottom = top + s.lag(x, j) * w, bottom + w
    return s.ma(ma, div(top, bottom), smooth)


@indicator("Trend")
def ReverseMovingAverageConvergenceDivergence(s, ma=EMA, fast=12, slow=26, signal=9, level=0.0):
    y = _reverse_macd(s, s.x, fast, slow, ma)
    sig = s.ma(ma, y, signal)
    return s.result({"Rmacd": y, "Signal": sig, "Histogram": s.let(y - sig)}, s.compare(s.x - y))


def _reverse_macd(s, x, fast, slow, ma):
    a, b = 2 / (1 + fast), 2 / (1 + slow)
    return s.let((s.lag(s.ma(ma, x, fast), 1) * a - s.lag(s.ma(ma, x, slow), 1) * b) / (a - b))


AVERAGES["ReverseMovingAverageConvergenceDivergence"] = lambda s, x, n, fast=0: _reverse_macd(s, x, fast, n, EMA)


def _linear_lines(s, x, n):
    b, a = s.slope(x, n)
    today = s.linreg(x, n)
    return today, s.let(today + b), b, a


@average("LinearRegression")
def LinearRegression(s, x, n=14):
    return s.linreg(x, n)


@indicator("Trend", name="LinearRegression")
def _regression_lines(s, n=14):
    today, tomorrow, slope, intercept = _linear_lines(s, s.x, n)
    return s.result({"LinearRegression": today, "PredictedTomorrow": tomorrow, "Slope": slope, "Intercept": intercept}, s.compare(s.x - tomorrow, reverse=True))


def _poles(s, x, n):
    """(one, two, three) pole averages, each with part of its own lag added back."""
    a1, a2, a3 = 2 / (n + 1), math.exp(-math.sqrt(2) * math.pi / n), math.exp(-math.pi / n)
    b2, b3, c = 2 * a2 * math.cos(math.sqrt(2) * math.pi / n), 2 * a3 * math.cos(math.sqrt(3) * math.pi / n), math.exp(-2 * math.pi / n)
    x = s.let(x)
    one = s.smooth(x, a1, seed=x)
    two = s.rec2(lambda y, z: s.first(x, y) * b2 - where(s.rn <= 2, x, z) * (a2 * a2) + x * (1 - b2 + a2 * a2))
    three = s.rec_n(
        lambda y: s.first(x, y[0]) * (b3 + c) - where(s.rn <= 2, x, y[1]) * (c + b3 * c) + where(s.rn <= 3, x, y[2]) * (c * c) + x * ((1 - b3 + c) * (1 - c)), 3
    )
    d1, d2, d3 = s.let(x - one), s.let(x - two), s.let(x - three)
    e1 = s.smooth(d1, a1)
    e2 = s.rec2(lambda y, z: y * b2 - z * (a2 * a2) + d2 * (1 - b2 + a2 * a2))
    e3 = s.rec_n(lambda y: y[1] * (b3 + c) - y[1] * (c + b3 * c) + y[2] * (c * c) + d3 * ((1 - b3 + c) * (1 - c)), 3)
    return s.let(one + e1), s.let(two + e2 / 2), s.let(three + e3 / 3)


@average("Md2Pole")
def MultiDepthZeroLagExponentialMovingAverage(s, x, n=50):
    return _poles(s, x, n)[1]


@indicator("Trend", name="MultiDepthZeroLagExponentialMovingAverage")
def _pole_lines(s, n=50):
    a, b, c = _poles(s, s.x, n)
    return s.result({"Md2Pole": b, "Md1Pole": a, "Md3Pole": c}, s.compare(s.x - b))


@average("Dama")
def DynamicallyAdjustableMovingAverage(s, x, fast=6, slow=200):
    """The mean of more rows the more the deviation varies."""
    a = s.sd(x, fast)
    size = s.let(nearest(s.let(clamp(div(s.sd(a, slow), a) + fast, slow, fast))))
    total = lit(0.0)
    for j in range(slow):
        total = total + (s.lag(x, j) if j < fast else where(size > j, s.lag(x, j), 0.0))
    return s.let(total / size)


def _cumulated(s, x, n):
    """(sum of all rows, weighted average of n rows from sums of sums)."""
    c = s.total(s.let(x))
    t = s.total(c)
    window = s.let(t - s.lag(t, n))
    return c, s.let((c * n - s.lag(window, 1)) / (n * (n + 1) / 2))


@average("Swma")
def SimplifiedWeightedMovingAverage(s, x, n=14):
    return _cumulated(s, x, n)[1]


@average("Slsma")
def SimplifiedLeastSquaresMovingAverage(s, x, n=14):
    c, w = _cumulated(s, x, n)
    return s.let(w * 3 - (c - s.lag(c, n)) * (2 / n))


@average("Epf")
def EdgePreservingFilter(s, x, n=200, smooth=50, ma=SMA):
    """The mean of all rows since the distance from the average last peaked."""
    x = s.let(x)
    o = s.let(x - s.ma(ma, x, n))
    p = s.linreg(s.let(abs_(o)), smooth)
    h = s.let(div(p, s.max(p, n)))
    peak = s.let(where(h.eq(1) & s.lag(h, 1).ne(1) & o.ne(0), 1.0, 0.0))

    def step(a, b):
        a = where(peak.ne(0), 1.0, s.first(1.0, a) + 1)
        return [a, where(peak.ne(0), x, s.first(x, b) + x)]

    a, b = s.scan(step, (0.0, 0.0))
    return s.let(div(b, a))


@average("Ealf")
def EhlersAdaptiveLaguerreFilter(s, x, n1=14, n2=5):
    """A Laguerre filter whose rate is the median of how the last errors rank; n2 rows are five."""
    x, rows = s.let(x), mn(s.rn, n1)

    def step(o, new):
        new["d0"] = abs_(x - s.first(x, o["f"]))
        for j in range(n1 - 1, 0, -1):
            new[f"d{j}"] = o[f"d{j - 1}"]
        # rows before the first hold the newest error, which moves no extreme
        held = [new["d0"], *(where(rows > j, new[f"d{j}"], new["d0"]) for j in range(1, n1))]
        new["low"], new["high"] = mn(*held), mx(*held)
        new["m0"] = div(new["d0"] - new["low"], new["high"] - new["low"])
        for j in range(4, 0, -1):
            new[f"m{j}"] = o[f"m{j - 1}"]
        new["a"] = where(new["m0"].ne(0), _median([new[f"m{j}"] for j in range(5)], s.rn), s.first(2 / (n1 + 1), o["a"]))
        back = 1 - new["a"]
        l = [s.first(x, o[f"l{k}"]) for k in range(4)]
        new["l0"] = new["a"] * x + back * l[0]
        for k in (1, 2, 3):
            new[f"l{k}"] = l[k - 1] + back * l[k] - back * new[f"l{k - 1}"]
        new["f"] = (new["l0"] + new["l1"] * 2 + new["l2"] * 2 + new["l3"]) / 6

    names = ["f", "low", "high", "a", *(f"d{j}" for j in range(n1)), *(f"m{j}" for j in range(5)), *(f"l{j}" for j in range(4))]
    return s.machine(dict.fromkeys(names, 0.0), step)["f"]


@indicator("Momentum")
def DynamicMomentumIndex(s, ma=SMA, n1=5, n2=10, n3=14, most=30, least=5):
    """RSI over fewer rows the more the price varies."""
    a = s.ma(ma, s.sd(s.x, n1, ma), n2)
    size = s.let(where(a.ne(0), clamp(ceil(div(n3, a)), most, least), float(least)))
    rows, d = s.let(mn(size, s.rn)), s.let(s.change(s.x))

    def mean(x):
        total = lit(0.0)
        for j in range(most):
            total = total + (s.lag(x, j) if j < least else where(size > j, s.lag(x, j), 0.0))
        return s.let(div(total, rows))

    up, down = mean(s.let(mx(d, 0))), mean(s.let(mx(-d, 0)))
    y = s.let(where(down.eq(0), 100.0, where(up.eq(0), 0.0, 100 - div(100, 1 + div(up, down)))))
    sig = mean(y)
    h = s.let(y - sig)
    return s.result({"Dmi": y, "Signal": sig, "Histogram": h}, s.crossing(h, y, 70, 30))


@indicator("Trend")
def LinearQuadraticConvergenceDivergenceOscillator(s, ma=SMA, n=50, signal=25):
    """The quadratic fit reads the linear one."""
    line = s.linreg(s.x, n)
    d = s.let(s.of("QuadraticRegression", line, n=n, ma=ma).value - line)
    y = s.let(d - s.ma(ma, d, signal) * 2)
    return s.result({"Lqcdo": y}, s.compare(y))


@indicator("Trend")
def AverageTrueRangeChannel(s, ma=SMA, n=14, mult=2.5):
    d, m = s.let(s.atr(n, ma) * mult), s.ma(ma, s.x, n)
    up, down = s.let(nearest(s.let(s.x + d))), s.let(nearest(s.let(s.x - d)))
    return s.result({"UpperBand": up, "MiddleBand": m, "LowerBand": down}, s.bands(s.x - m, up, down), None)


@indicator("Trend")
def PseudoPolynomialChannel(s, ma=SMA, n=14, morph=0.9):
    i, j = s.let(where(s.rn > n, s.i - n, 0.0)), s.let(where(s.rn > n * 2, s.i - n * 2, 0.0))
    reach = s.let(div(s.i - i, j - i))

    def step(y):
        a = where(s.rn > n, y[n - 1], s.x) * morph + s.x * (1 - morph)
        b = where(s.rn > n * 2, y[n * 2 - 1], s.x) * morph + s.x * (1 - morph)
        return where((j - i).ne(0), a + reach * (b - a), 0.0)

    m = s.ma(ma, s.rec_n(step, n * 2), n)
    e = so_far(s, abs_(s.x - m))
    return s.band_result(m + e, m, m - e)


@indicator("Momentum")
def AverageAbsoluteErrorNormalization(s, n=14):
    rows = s.let(mn(s.rn, n))

    def step(o, new):
        new["e0"] = s.x - s.first(s.x, o["y"])
        for j in range(n - 1, 0, -1):
            new[f"e{j}"] = o[f"e{j - 1}"]
        new["m"] = sum((abs_(new[f"e{j}"]) for j in range(1, n)), abs_(new["e0"])) / rows
        new["a"] = clamp(div(sum((new[f"e{j}"] for j in range(1, n)), new["e0"]) / rows, new["m"]), 1, -1)
        new["y"] = s.x + new["a"] * new["m"]

    return turned(s, "Aaen", s.machine({"y": 0.0, "m": 0.0, "a": 0.0} | {f"e{j}": 0.0 for j in range(n)}, step)["a"], 0.8, -0.8)


@indicator("Volatility")
def HistoricalVolatilityPercentile(s, ma=EMA, n=21, year=252):
    r = s.let(log(div(s.x, s.lag(s.x, 1))))
    hv = s.let(sqrt(s.sum(s.let(sq(r - s.avg(r, n))), n) / (n - 1)) * math.sqrt(year))
    count = lit(0.0)
    for j in range(1, year):
        count = count + where((s.rn > j) & (s.lag(hv, j) < hv), 1.0, 0.0)
    y = s.let(count * (100 / year))
    sig = s.ma(ma, y, n)
    return vol(s, "Hvp", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volume")
def BetterVolumeIndicator(s, n=8, lb=2):
    """Volume split into buying and selling; an extreme of one of them in the candle's direction is a climax."""
    h, l = s.range_of(s.x)
    width, r, v = s.let(s.max(h, lb) - s.min(l, lb)), s.tr(), s.volume
    body = s.let(s.x - s.open)
    buy = s.let(where(body > 0, div(r, r * 2 - body) * v, where(body < 0, div(r + body, r * 2 + body) * v, v * 0.5)))
    sell = s.let(v - buy)
    last, first = s.lag(s.x, 1), s.lag(s.open, 1)
    buys, sells = s.let(buy + s.lag(buy, 1)), s.let(sell + s.lag(sell, 1))
    top = lambda e: s.let(e).eq(s.max(s.let(e), n))
    bottom = lambda e: s.let(e).eq(s.min(s.let(e), n))
    up, down = body > 0, body < 0
    rising, turned_up, falling = up & (last > first), up & (last < first), down & (last < first)
    climax = (
        (up & (top(buy * r) | top((buy - sell) * r) | bottom(div(sell, r)) | bottom(div(sell - buy, r))))
        | (rising & (top(buys * width) | bottom(div(sells, width)) | bottom(div(sells - buys, width))))
        | (turned_up & top((buys - sells) * width))
    )
    panic = (
        (down & (top(sell * r) | top((sell - buy) * r) | bottom(div(buy, r)) | bottom(div(buy - sell, r))))
        | (falling & (bottom(sells * width) | bottom((sells - buys) * width) | bottom(div(buys, width))))
        | (turned_up & bottom(div(buys - sells, width)))
    )
    return s.result({"Bvi": buy}, s.when(climax, panic))
