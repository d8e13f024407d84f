"""Prices, bands of Bollinger, trend, Wilder's measures, and performance ratios."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, clamp, div, exp, lit, log, mn, mx, power, sign, sq, sqrt, where

from .momentum import against, pct, turned
from .registry import EMA, SMA, WILDER, WMA, indicator, length

PHI = (1 + math.sqrt(5)) / 2
TEMA = "TripleExponentialMovingAverage"


def _price(key, f):
    def run(s):
        y = s.let(f(s))
        return s.result({key: y}, s.compare(y - s.lag(y, 1)))

    return run


indicator("Trend", "TypicalPrice")(_price("Tp", lambda s: s.typical if s.x.sql == s.close.sql else (sum(s.range_of(s.x), lit(0.0)) + s.x) / 3))
indicator("Trend", "MedianPrice")(_price("MedianPrice", lambda s: sum(s.range_of(s.x), lit(0.0)) / 2))
indicator("Trend", "AveragePrice")(_price("AveragePrice", lambda s: (s.open + s.x) / 2))
indicator("Trend", "FullTypicalPrice")(_price("FullTp", lambda s: (sum(s.range_of(s.x), lit(0.0)) + s.x + s.open) / 4))


@indicator("Trend")
def WeightedClose(s):
    h, l = s.range_of(s.x)
    y = s.let((h + l + s.x * 2) / 4)
    return s.result({"WeightedClose": y}, s.compare(s.x - y))


@indicator("Trend")
def Midpoint(s, n=14):
    y = s.let((s.max(s.x, max(n, 2)) + s.min(s.x, max(n, 2))) / 2)
    return s.result({"HCLC2": y}, s.compare(s.x - y))


@indicator("Trend")
def Midprice(s, n=14):
    h, l = s.range_of(s.x)
    y = s.let((s.max(h, n) + s.min(l, n)) / 2)
    return s.result({"HHLL2": y}, s.compare(s.x - y))


# ---- Bollinger -----------------------------------------------------------------------------------


def bollinger(s, n, mult, ma=SMA, x=None):
    """(upper, middle, lower): the deviation is that of the middle line, which the input has become by then."""
    m = s.ma(ma, s.x if x is None else x, n)
    d = s.let(s.sd(m, n, ma) * mult)
    return s.let(m + d), m, s.let(m - d)


@indicator("Volatility")
def BollingerBands(s, ma=SMA, n=20, mult=2.0):
    return s.band_result(*bollinger(s, n, mult, ma))


@indicator("Volatility")
def NarrowSidewaysChannel(s, ma=SMA, n=14, mult=3.0):
    return s.band_result(*bollinger(s, n, mult, ma), signal=None)


@indicator("Volatility")
def AdaptivePriceZoneIndicator(s, ma=EMA, n=20, width=2.0):
    k = length(math.ceil(math.sqrt(n)))
    h, l = s.range_of(s.x)
    m, r = s.ma(ma, s.ma(ma, s.x, k), k), s.let(s.ma(ma, s.ma(ma, h - l, k), k) * width)
    return s.band_result(m + r, m, m - r)


@indicator("Volatility")
def AutoDispersionBands(s, ma=WMA, n=90, smooth=140):
    d = s.rms(s.change(s.x, n), n)
    u = s.ma(ma, s.ma(ma, s.max(s.let(s.x + d), n), n), smooth)
    l = s.ma(ma, s.ma(ma, s.min(s.let(s.x - d), n), n), smooth)
    return s.band_result(u, (u + l) / 2, l)


@indicator("Volatility")
def BollingerBandsFibonacciRatios(s, ma=SMA, n=20, ratio=2 * PHI + 1):
    m, r = s.ma(ma, s.x, n), s.let(s.atr(n, ma) * ratio)
    return s.band_result(m + r, m, m - r)


@indicator("Volatility")
def BollingerBandsAvgTrueRange(s, ma=SMA, atr=22, n=55, mult=2.0):
    u, _, l = bollinger(s, n, mult, ma)
    e = s.ma(ma, s.x, atr)
    y = s.let(div(s.atr(atr, ma, e), u - l))
    return s.result({"AtrDev": y}, s.volatile(s.x - e, y, 0.5))


@indicator("Volatility")
def BollingerBandsWithAtrPct(s, ma=SMA, n=14, bb=20, mult=2.0):
    h, l = s.range_of(s.x)
    last, m = s.lag(s.x, 1), s.ma(ma, s.x, bb)
    lh, hc, lc = s.let(h - l), s.let(abs_(h - last)), s.let(abs_(l - last))
    top = mx(lh, hc, lc)
    a = where(top.eq(hc), div(hc, last + hc / 2), where(top.eq(lc), div(lc, l + lc / 2), div(lh, l + lh / 2)))
    d = s.let(m * s.smooth(a * 100, 2 / (n + 1)) * (mult / 100))
    return s.band_result(m + d, m, m - d)


@indicator("Volatility")
def BollingerBandsPercentB(s, mult=2.0, ma=SMA, n=20):
    u, _, l = bollinger(s, n, mult, ma)
    return turned(s, "PctB", pct(s.x - l, u - l), 100, 0)


@indicator("Volatility")
def BollingerBandsWidth(s, mult=2.0, ma=SMA, n=20):
    u, m, l = bollinger(s, n, mult, ma)
    w = s.let(div(u - l, m))
    return s.result({"BbWidth": w}, s.volatile(s.x - m, w, s.lag(w, 1)))


@indicator("Volatility")
def VervoortModifiedBollingerBandIndicator(s, ma=TEMA, n1=18, n2=200, smooth=8, mult=1.6):
    p = s.let(s.full)
    last = s.lag(p, 1)
    ho = s.rec(lambda y: (last + y) / 2)
    c = s.let((p + ho + mx(s.high, ho) + mn(s.low, ho)) / 4)
    t = s.ma(ma, c, smooth)
    z = s.ma(ma, t * 2 - s.ma(ma, t, smooth), smooth)
    d = s.sd(z, n1, ma)
    b = s.let(div(z + d * 2 - s.wma(z, n1), d * 4) * 100)
    w = s.let(s.sd(b, n2, ma) * mult)
    u, l = s.let(w + 50), s.let(50 - w)
    m = s.let((u + l) / 2)
    return s.result({"UpperBand": u, "MiddleBand": m, "LowerBand": l}, s.bands(b - m, u, l, b), None)


# ---- Wilder --------------------------------------------------------------------------------------


@indicator("Volatility")
def AverageTrueRange(s, ma=WILDER, n=14):
    a, m = s.atr(n, ma), s.ma(ma, s.x, n)
    return s.result({"Atr": a}, s.volatile(s.x - m, a, s.ma(ma, a, n)))


@indicator("Trend")
def AverageDirectionalIndex(s, ma=WILDER, n=14):
    h, l = s.range_of(s.x)
    up, down = s.let(h - s.lag(h, 1)), s.let(s.lag(l, 1) - l)
    r = s.ma(ma, s.tr(), n)
    p = s.let(clamp(pct(s.ma(ma, where(up > down, mx(up, 0), 0.0), n), r), 100, 0))
    m = s.let(clamp(pct(s.ma(ma, where(up < down, mx(down, 0), 0.0), n), r), 100, 0))
    x = s.ma(ma, clamp(pct(abs_(p - m), p + m), 100, 0), n)
    return s.result({"DiPlus": p, "DiMinus": m, "Adx": x}, s.compare(p - m), "Adx")


@indicator("Trend")
def WellesWilderVolatilitySystem(s, ma=EMA, n1=63, n2=21, factor=3.0):
    e = s.ma(ma, s.x, n1)
    a = s.let(s.atr(n2, ma, e) * factor)
    m = max(n2, 2)
    y = s.let(where(s.x > e, s.max(s.x, m) - a, s.min(s.x, m) + a))
    return s.result({"Wwvs": y}, s.compare(s.x - y))


# ---- trend ---------------------------------------------------------------------------------------


@indicator("Trend")
def TrendTriggerFactor(s, n=15):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    a, b = h - s.lag(l, n), s.lag(h, n) - l
    return turned(s, "Ttf", div((a - b) * 200, a + b), 100, -100)


@indicator("Trend")
def TrendPersistenceRate(s, ma=EMA, n=20, smooth=5, mult=0.01, threshold=1.0):
    m = s.ma(ma, s.x, smooth)
    d = s.let((s.lag(m, 1) - s.lag(m, 2)) / mult)
    side = s.let(where(d > threshold, 1.0, where(d < -threshold, -1.0, 0.0)))
    y = s.let(abs_(s.sum(side, n)) * (100 / n))
    return s.result({"Tpr": y}, s.compare(y - s.ma(ma, y, smooth)))


@indicator("Trend")
def TrendStep(s, n=50):
    d = s.let(s.sd(s.x, n) * 2)
    y = s.rec(lambda y: where((s.rn <= n) | (s.x > y + d) | (s.x < y - d), s.x, y))
    return s.result({"Ts": y}, s.compare(s.x - y))


@indicator("Trend")
def TrendExhaustionIndicator(s, ma=SMA, n=10):
    h, _ = s.range_of(s.x)
    a = s.sum(s.let(where(s.x > s.lag(s.x, 1), 1.0, 0.0)))
    b = s.sum(s.let(where(h > s.lag(s.max(h, n), 1), 1.0, 0.0)))
    y = s.smooth(div(b, a), 2 / (n + 1))
    sig = s.ma(ma, y, n)
    return s.result({"Tei": y, "Signal": sig}, s.compare(y - sig))


@indicator("Trend")
def TrendImpulseFilter(s, ma=EMA, n1=100, n2=10):
    h, l = s.lag(s.max(s.x, n1), 1), s.lag(s.min(s.x, n1), 1)
    b = s.rec(lambda y: where((s.x > h) | (s.x < l), s.x, s.first(s.x, y)))
    y = s.ma(ma, b, n2)
    return s.result({"Tif": y}, s.compare(s.x - y))


@indicator("Trend")
def TrendAnalysisIndex(s, ma=SMA, n1=28, n2=5):
    m = s.ma(ma, s.x, n1)
    y = s.let(pct(s.max(m, n2) - s.min(m, n2), s.x))
    sig = s.ma(ma, y, n2)
    return s.result({"Tai": y, "Signal": sig}, s.volatile(s.x - m, y, sig))


@indicator("Trend")
def TrendAnalysisIndicator(s, ma=SMA, n1=21, n2=4):
    slow, fast = s.ma(ma, s.x, n1), s.ma(ma, s.x, n2)
    y = s.sd(slow, n2, ma)
    sig = s.ma(ma, y, n1)
    return s.result({"Tai": y, "Signal": sig}, s.volatile(fast - slow, y, sig))


@indicator("Trend")
def Trender(s, ma=EMA, n=14, mult=2.0):
    h, l = s.range_of(s.x)
    e = s.ma(ma, s.x, n)
    a = s.atr(n, ma, e)
    d = s.let(s.sd(a, n, ma) * mult)
    last = s.lag(s.x, 1)
    m = s.ma(ma, where(s.x > last, e + a / 2, where(s.x < last, e - a / 2, e)), n)
    pm, pe, ph, pl = s.lag(m, 1), s.lag(e, 1), s.lag(h, 2), s.lag(l, 2)
    down = s.rec(lambda y: where((m < e) & (pm > pe), ph, where(s.x < last, s.x + d, y)))
    up = s.rec(lambda y: where((m > e) & (pm < pe), pl, where(s.x > last, s.x - d, y)))
    y = s.rec(lambda y: where(m < e, down, where(m > e, up, y)))
    return s.result({"TrendUp": up, "TrendDn": down, "Trender": y}, s.compare(s.x - y), "Trender")


@indicator("Trend")
def TrendDirectionForceIndex(s, ma=EMA, n1=10, n2=30):
    k = length(math.ceil(n1 / 2))
    a = s.ma(ma, s.x * 1000, k)
    b = s.ma(ma, a, k)
    d = s.let((a - s.lag(a, 1) + b - s.lag(b, 1)) / 2)
    f = s.let(abs_(a - b) * d * d * d)
    y = s.let(div(f, s.max(s.let(abs_(f)), n2)))
    return s.result({"Tdfi": y}, s.compare(y))


@indicator("Trend")
def TrendIntensityIndex(s, ma=SMA, fast=30, slow=60):
    d = s.let(s.x - s.ma(ma, s.x, slow))
    a, b = s.sum(s.let(mx(d, 0)), fast), s.sum(s.let(mx(-d, 0)), fast)
    return turned(s, "Tii", pct(a, a + b), 80, 20)


@indicator("Trend")
def TrendForceHistogram(s, n=14):
    h, l = s.lag(s.max(s.x, n), 1), s.lag(s.min(s.x, n), 1)
    a, b = s.let(where(s.x > h, 1.0, 0.0)), s.let(where(s.x < l, 1.0, 0.0))
    na, nb = s.let(a - s.lag(a, 1)), s.let(b - s.lag(b, 1))
    c = s.rec(lambda y: where(a.eq(1), y + 1, where(nb.eq(1), 0.0, y)))
    d = s.rec(lambda y: where(b.eq(1), y + 1, where(na.eq(1), 0.0, y)))
    m = s.let((c + d) / 2)
    y = s.let(m - div(s.total(m), s.i))
    return s.result({"Tfh": y}, s.volatile(s.x - s.ema(s.x, n), y, 0))


@indicator("Trend")
def TrendDetectionIndex(s, n1=20, n2=40):
    m = s.let(s.change(s.x, n1))
    a = s.let(abs_(m))
    d = s.sum(m, n1)
    y = s.let(abs_(d) - s.sum(a, n2) + s.sum(a, n1))
    return s.result({"Tdi": y, "TdiDirection": d}, s.compare(d - y))


@indicator("Trend")
def TrendContinuationFactor(s, n=35):
    d = s.let(s.change(s.x))
    p, m = s.let(mx(d, 0)), s.let(mx(-d, 0))
    cp, cm = s.rec(lambda y: where(p.eq(0), 0.0, p + y)), s.rec(lambda y: where(m.eq(0), 0.0, m + y))
    a, b = s.sum(s.let(p - cm), n), s.sum(s.let(m - cp), n)
    return s.result({"TcfPlus": a, "TcfMinus": b}, s.compare(a - b), None)


@indicator("Trend")
def SuperTrend(s, ma=WILDER, n=22, mult=3.0):
    a = s.let(s.atr(n, ma) * mult)
    lo, hi, last = s.let(s.x - a), s.let(s.x + a), s.lag(s.x, 1)
    long = s.rec(lambda y: where(last > s.first(lo, y), mx(lo, s.first(lo, y)), lo))
    short = s.rec(lambda y: where(last < s.first(hi, y), mn(hi, s.first(hi, y)), hi))
    pl, ps = s.let(s.first(lo, s.lag(long, 1))), s.let(s.first(hi, s.lag(short, 1)))
    d = s.rec(lambda y: where(s.first(1.0, y).eq(-1) & (s.x > ps), 1.0, where(s.first(1.0, y).eq(1) & (s.x < pl), -1.0, s.first(1.0, y))))
    y = s.let(where(d > 0, long, short))
    return s.result({"Trend": y}, s.compare(s.x - y))


@indicator("Trend")
def SchaffTrendCycle(s, ma=EMA, fast=23, slow=50, cycle=10):
    return turned(s, "Stc", s.stoch(s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow), cycle), 75, 25)


@indicator("Trend")
def UberTrendIndicator(s, n=14):
    d = s.let(s.change(s.x))
    a, b = s.sum(s.let(mx(d, 0)), n), s.sum(s.let(mx(-d, 0)), n)
    av, bv = s.sum(s.let(where(d > 0, div(s.volume, a), 0.0)), n), s.sum(s.let(where(d < 0, div(s.volume, b), 0.0)), n)
    u = s.let(div(div(a, b), div(av, bv)))
    y = s.let(div(u - 1, u + 1))
    return s.result({"Uti": y}, s.compare(y - s.lag(y, 1)))


@indicator("Trend")
def WaveTrendOscillator(s, ma=EMA, n1=10, n2=21, smooth=4):
    p = s.let(s.full)
    e = s.ma(ma, p, n1)
    d = s.ma(ma, abs_(p - e), n1)
    t = s.ma(ma, div(p - e, d * 0.015), n2)
    return against(s, "Wto", t, s.ma(ma, t, smooth), 53, -53)


@indicator("Trend")
def OptimizedTrendTracker(s, ma="VariableIndexDynamicAverage", n=2, percent=1.4):
    m = s.ma(ma, s.x, n)
    lo, hi = s.let(m - m * (percent * 0.01)), s.let(m + m * (percent * 0.01))
    long = s.rec(lambda y: where(m > y, mx(lo, y), lo))
    pl, ps = s.lag(long, 1), s.lag(hi, 1)
    mt = s.let(where(m > ps, long, where(m < pl, hi, 0.0)))
    y = s.let(where(m > mt, mt * ((200 + percent) / 200), mt * ((200 - percent) / 200)))
    return s.result({"Ott": y}, s.compare(s.x - y))


@indicator("Trend")
def GannTrendOscillator(s, n=3):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    h1, h2, l1, l2 = s.lag(h, 1), s.lag(h, 2), s.lag(l, 1), s.lag(l, 2)
    up, down = (h2 > h1) & (h > h1), (l2 < l1) & (l < l1)
    y = s.let(s.last(where(up, 1.0, -1.0), up | down))
    return s.result({"Gto": y}, s.compare(y))


@indicator("Trend")
def CoralTrendIndicator(s, n=21, cd=0.4):
    k, x, e = 2 / ((n - 1) / 2 + 2), s.x, []
    for _ in range(6):
        x = s.smooth(x, k)
        e.append(x)
    y = s.let(e[5] * -(cd**3) + e[4] * (3 * (cd**2 + cd**3)) + e[3] * (-3 * (2 * cd**2 + cd + cd**3)) + e[2] * (3 * cd + 1 + cd**3 + 3 * cd**2))
    return s.result({"Cti": y}, s.compare(s.x - y))


@indicator("Volume")
def PriceVolumeTrend(s, ma=EMA, n=14):
    y = s.total(s.volume * div(s.change(s.x), s.lag(s.x, 1)))
    sig = s.ma(ma, y, n)
    return s.result({"Pvt": y, "Signal": sig}, s.compare(y - sig))


@indicator("Volume")
def ModifiedPriceVolumeTrend(s, ma=SMA, n=23):
    last, d = s.lag(s.x, 1), s.let(s.change(s.x))
    y = s.rec(lambda y: where(last.ne(0), y + div(s.volume * d / 50000, last), 0.0))
    sig = s.ma(ma, y, n)
    return s.result({"Mpvt": y, "Signal": sig}, s.compare(y - sig))


# ---- ratios --------------------------------------------------------------------------------------

YEAR = 360  # bars, of a day each


def _returns(s, n, bmk):
    b = (1 + bmk) ** (n / YEAR) - 1
    last = s.lag(s.x, n)
    return s.let(where(last.ne(0), div(s.x, last) - 1, 0.0)), b


@indicator("Momentum")
def TreynorRatio(s, n=30, beta=1.0, bmk=0.02):
    r, b = _returns(s, n, bmk)
    y = s.let((s.avg(r, n) - b) * (1 / beta if beta else 0))
    return s.result({"Tr": y}, s.compare(y - 2))


@indicator("Momentum")
def OmegaRatio(s, n=30, bmk=0.05):
    r, b = _returns(s, n, bmk)
    # rows before the first count as a return of 0, which falls short of the benchmark
    gap = mx(n - s.rn, 0) * b
    y = s.let(div(s.sum(s.let(mx(r - b, 0)), n), s.sum(s.let(mx(b - r, 0)), n) + gap))
    return s.result({"Or": y}, s.compare(y - 5))


@indicator("Momentum")
def UpsidePotentialRatio(s, n=30, bmk=0.05):
    r, b = _returns(s, n, bmk)
    down = s.let((s.sum(s.let(where(r < b, sq(r - b), 0.0)), n) + mx(n - s.rn, 0) * (b * b)) / n)
    y = s.let(div(s.sum(s.let(mx(r - b, 0)), n) / n, sqrt(down)))
    return s.result({"Upr": y}, s.compare(y - 5))


@indicator("Momentum")
def InformationRatio(s, ma=SMA, n=30, bmk=0.05):
    r, b = _returns(s, n, bmk)
    y = s.let(div(s.ma(ma, r, n) - b, s.sd(r, n, ma)))
    return s.result({"Ir": y}, s.compare(y - 5))


@indicator("Momentum")
def SharpeRatio(s, ma=SMA, n=30, bmk=0.02):
    r, b = _returns(s, n, bmk)
    r = s.let(where(s.lag(s.x, n).ne(0), r - b, 0.0))
    y = s.let(div(s.ma(ma, r, n), s.sd(r, n, ma)))
    return s.result({"Sr": y}, s.compare(y - 2))


@indicator("Momentum")
def SortinoRatio(s, ma=SMA, n=30, bmk=0.02):
    r, b = _returns(s, n, bmk)
    r = s.let(where(s.lag(s.x, n).ne(0), r - b, 0.0))
    m = s.ma(ma, r, n)
    y = s.let(div(m, sqrt(s.ma(ma, sq(mn(r - m, 0)), n))))
    return s.result({"Sr": y}, s.compare(y - 2))


@indicator("Momentum")
def CalmarRatio(s, n=30):
    h = s.max(s.x, n)
    dd = s.min(s.let(div(s.x - h, h)), n)
    r, _ = _returns(s, n, 0.0)
    y = s.let(div(where(r >= -1, power(mx(r + 1, 0), YEAR / (n * 15)) - 1, 0.0), abs_(dd)))
    return s.result({"Cr": y}, s.compare(y - 2))


@indicator("Momentum")
def MartinRatio(s, ma=SMA, n=30, bmk=0.02):
    _, b = _returns(s, n, bmk)
    last = s.lag(s.x, n)
    r = s.let(where(last.ne(0), div(s.x * 100, last) - 1 - b * 100, 0.0))
    m = s.ma(ma, r, n)
    y = s.let(div(m, s.of("UlcerIndex", r, n=n).value))
    return s.result({"Mr": y}, s.compare(y - 2))


@indicator("Volatility")
def VolatilityRatio(s, ma=EMA, n=14, level=0.5):
    h, l = s.range_of(s.x)
    ph, pl, prior = s.lag(s.max(h, n - 1), 1), s.lag(s.min(l, n - 1), 1), s.lag(s.x, n + 1)
    hi, lo = where(prior.ne(0), mx(ph, prior), ph), where(prior.ne(0), mn(pl, prior), pl)
    y = s.let(div(s.tr(), hi - lo))
    return s.result({"Vr": y}, s.volatile(s.x - s.ma(ma, s.x, n), y, level))


@indicator("Trend")
def ShinoharaIntensityRatio(s, n=14):
    h, l = s.range_of(s.x)
    h, l, o, c = s.sum(h, n), s.sum(l, n), s.sum(s.open, n), s.sum(s.let(s.lag(s.x, 1)), n)
    a, b = s.let(pct(h - o, o - l)), s.let(pct(h - c, c - l))
    return s.result({"ARatio": a, "BRatio": b}, s.compare(a - b), None)


__all__ = ["bollinger", "exp", "log", "sign"]
