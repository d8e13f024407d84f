"""Momentum: convergence of averages, price oscillators, RSI, stochastics, and Chande's and DeMark's measures."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, clamp, div, exp, lit, mn, mx, rsi_of, sq, sqrt, where

from .averages import laguerre
from .registry import EMA, SMA, WILDER, WMA, indicator, length

ZLEMA, TEMA, DEMA = "ZeroLagExponentialMovingAverage", "TripleExponentialMovingAverage", "DoubleExponentialMovingAverage"


def lines(s, key, m, ma, n, **more):
    """A line, the average of it that signals, and their difference."""
    m = s.let(m)
    sig = s.ma(ma, m, n)
    h = s.let(m - sig)
    return s.result({key: m, "Signal": sig, "Histogram": h} | more, s.compare(h))


def pct(a, b):
    """100 a / b."""
    return div(a * 100, b)


# ---- MACD and its percent forms ------------------------------------------------------------------


@indicator("Trend")
def MovingAverageConvergenceDivergence(s, ma=EMA, fast=12, slow=26, signal=9):
    return lines(s, "Macd", s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow), ma, signal)


@indicator("Momentum")
def PercentagePriceOscillator(s, ma=EMA, fast=12, slow=26, signal=9):
    b = s.ma(ma, s.x, slow)
    return lines(s, "Ppo", pct(s.ma(ma, s.x, fast) - b, b), ma, signal)


@indicator("Momentum")
def PercentageVolumeOscillator(s, ma=EMA, fast=12, slow=26, signal=9):
    b = s.ma(ma, s.volume, slow)
    return lines(s, "Pvo", pct(s.ma(ma, s.volume, fast) - b, b), ma, signal)


def _four(s, ma, percent):
    e = {n: s.ma(ma, s.x, n) for n in (5, 8, 10, 14, 16, 17)}
    pairs = ((e[17], e[14]), (e[17], e[8]), (e[10], e[16]), (e[5], e[10]))
    m = [s.let(pct(a - b, b) if percent else a - b) for a, b in pairs]
    sig = [s.ma(ma, x, 5) for x in m]
    return m, sig, [s.let(a - b) for a, b in zip(m, sig, strict=True)]


@indicator("Momentum", name="4MovingAverageConvergenceDivergence")
def FourMacd(s, ma=EMA, blue=4.3, yellow=1.4):
    m, sig, h = _four(s, ma, False)
    return s.result({"Macd1": m[3], "Signal1": sig[3], "Histogram1": h[3], "Macd2": m[1], "Signal2": sig[1], "Histogram2": h[1]}, s.compare(h[3] - h[1]), None)


@indicator("Momentum", name="4PercentagePriceOscillator")
def FourPpo(s, ma=EMA, blue=4.3, yellow=1.4):
    m, sig, h = _four(s, ma, True)
    return s.result({"Ppo1": m[3], "Signal1": sig[3], "Histogram1": h[3], "Ppo2": m[1], "Signal2": sig[1], "Histogram2": h[1]}, s.compare(h[3] - h[1]), None)


def _impulse(s, ma, n):
    p = s.let(s.typical)
    hi, lo, mi = s.ma(ma, s.high, n), s.ma(ma, s.low, n), s.ma(ZLEMA, p, n)
    return hi, lo, mi, s.let(where(mi > hi, mi - hi, where(mi < lo, mi - lo, 0.0)))


@indicator("Momentum")
def ImpulseMovingAverageConvergenceDivergence(s, ma=WILDER, n=34, signal=9):
    m = _impulse(s, ma, n)[3]
    sig = s.avg(m, signal)
    h = s.let(m - sig)
    return s.result({"Macd": m, "Signal": sig, "Histogram": h}, s.compare(h))


@indicator("Momentum")
def ImpulsePercentagePriceOscillator(s, ma=WILDER, n=34, signal=9):
    hi, lo, mi, m = _impulse(s, ma, n)
    p = s.let(where(mi > hi, pct(m, hi), where(mi < lo, pct(m, lo), 0.0)))
    sig = s.avg(p, signal)
    h = s.let(p - sig)
    return s.result({"Ppo": p, "Signal": sig, "Histogram": h}, s.compare(h))


def _leader(s, ma, fast, slow):
    out = []
    for n in (fast, slow):
        e = s.ma(ma, s.x, n)
        out.append(s.let(e + s.ma(ma, s.x - e, n)))
    return out


@indicator("Momentum")
def MovingAverageConvergenceDivergenceLeader(s, ma=EMA, fast=12, slow=26, signal=9):
    a, b = _leader(s, ma, fast, slow)
    m = s.let(a - b)
    return s.result({"Macd": m, "I1": a, "I2": b}, s.compare(m - s.ma(ma, m, signal)))


@indicator("Momentum")
def PercentagePriceOscillatorLeader(s, ma=EMA, fast=12, slow=26, signal=9):
    a, b = _leader(s, ma, fast, slow)
    return lines(s, "Ppo", pct(a - b, b), ma, signal)


@indicator("Trend")
def TFSMboIndicator(s, ma=SMA, fast=25, slow=200, signal=18):
    return lines(s, "TfsMob", s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow), ma, signal)


@indicator("Trend")
def TFSMboPercentagePriceOscillator(s, ma=SMA, fast=25, slow=200, signal=18):
    b = s.ma(ma, s.x, slow)
    return lines(s, "Ppo", pct(s.ma(ma, s.x, fast) - b, b), ma, signal)


@indicator("Trend")
def MacZIndicator(s, ma=SMA, fast=12, slow=25, signal=9, n=25, mult=1.0):
    w = s.wilder(s.x, n)
    sd = s.sd(s.x, n, ma)
    m = s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow)
    z = div(s.x - w, sd)
    return lines(s, "Macz", where(sd.ne(0), z * mult + div(m * mult, sd), z), ma, signal)


@indicator("Trend")
def MacZVwapIndicator(s, ma=SMA, fast=12, slow=25, signal=9, n1=20, n2=25, gamma=0.02):
    sd = s.sd(s.x, n2, ma)
    m = s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow)
    z = s.of("ZDistanceFromVwapIndicator", s.ma(ma, s.x, slow), n=n1).value
    t = s.let(z + div(m, sd))
    a, b, c, d = laguerre(s, t, 1 - gamma)
    return lines(s, "Macz", (a + b * 2 + c * 2 + d) / 6, ma, signal)


def _mirror(s, ma, n, signal, percent, key):
    o, c = s.ma(ma, s.open, n), s.ma(ma, s.x, n)
    up, down = s.let(pct(c - o, o) if percent else c - o), s.let(pct(o - c, c) if percent else o - c)
    a, b = s.ma(ma, up, signal), s.ma(ma, down, signal)
    h = s.let(up - a)
    return s.result({key: up, "Signal": a, "Histogram": h, f"Mirror{key}": down, "MirrorSignal": b, "MirrorHistogram": s.let(down - b)}, s.compare(h))


@indicator("Trend")
def MirroredMovingAverageConvergenceDivergence(s, ma=EMA, n=20, signal=9):
    return _mirror(s, ma, n, signal, False, "Macd")


@indicator("Trend")
def MirroredPercentagePriceOscillator(s, ma=EMA, n=20, signal=9):
    return _mirror(s, ma, n, signal, True, "Ppo")


def _dinapoli(s, lc, sc):
    return s.smooth(s.x, 2 / (1 + sc)), s.smooth(s.x, 2 / (1 + lc))


@indicator("Momentum")
def DiNapoliMovingAverageConvergenceDivergence(s, lc=17.5185, sc=8.3896, sp=9.0503):
    f, g = _dinapoli(s, lc, sc)
    m = s.let(f - g)
    sig = s.smooth(m, 2 / (1 + sp))
    h = s.let(m - sig)
    return s.result({"FastS": f, "SlowS": g, "Macd": m, "Signal": sig, "Histogram": h}, s.compare(h), "Macd")


@indicator("Momentum")
def DiNapoliPercentagePriceOscillator(s, lc=17.5185, sc=8.3896, sp=9.0503):
    f, g = _dinapoli(s, lc, sc)
    p = s.let(pct(f - g, g))
    sig = s.smooth(p, 2 / (1 + sp))
    h = s.let(p - sig)
    return s.result({"Ppo": p, "Signal": sig, "Histogram": h}, s.compare(h))


@indicator("Momentum")
def StochasticMovingAverageConvergenceDivergenceOscillator(s, ma=EMA, n=45, fast=12, slow=26, signal=9):
    high, low = s.range_of(s.x)
    h, l = s.max(high, n), s.min(low, n)
    f, g = (div(s.ma(ma, s.x, k) - l, h - l) for k in (fast, slow))
    return lines(s, "Macd", (f - g) * 10, ma, signal)


@indicator("Momentum")
def ErgodicMovingAverageConvergenceDivergence(s, ma=EMA, n1=32, n2=5, n3=5):
    return lines(s, "Macd", s.ma(ma, s.x, n1) - s.ma(ma, s.x, n2), ma, n3)


@indicator("Momentum")
def ErgodicPercentagePriceOscillator(s, ma=EMA, n1=32, n2=5, n3=5):
    b = s.ma(ma, s.x, n2)
    return lines(s, "Ppo", pct(s.ma(ma, s.x, n1) - b, b), ma, n3)


# ---- momentum ------------------------------------------------------------------------------------


def _one_row_pct(s):
    return s.let(div(s.change(s.x) * 100, s.lag(s.x, 1)))


@indicator("Momentum")
def PriceMomentumOscillator(s, ma=EMA, n1=35, n2=20, signal=10):
    p = s.smooth(s.smooth(_one_row_pct(s), 2 / n1) * 10, 2 / n2)
    sig = s.ma(ma, p, signal)
    return s.result({"Pmo": p, "Signal": sig}, s.compare(p - sig))


@indicator("Momentum")
def DecisionPointPriceMomentumOscillator(s, ma=EMA, n1=35, n2=20, signal=10):
    last = s.lag(s.x, 1)
    v = where(last.ne(0), div(s.x * 100, last), 100.0) - 100
    return lines(s, "Dppmo", s.smooth(s.smooth(v, 2 / n1) * 10, 2 / n2), ma, signal)


@indicator("Momentum")
def DynamicMomentumOscillator(s, ma=SMA, n1=10, n2=20):
    st = s.run("StochasticOscillator", n=n1, s1=n1, s2=n2, ma=ma).outputs
    k, d = st["FastD"], st["SlowD"]
    mid = clamp((s.min(k) + mx(s.max(k), 0)) / 2, 100, 0)
    o = s.let(clamp(mid - (d - k), 100, 0))
    return s.result({"Dmo": o}, s.crossing(o - s.lag(o, 1), o, 77, 23))


@indicator("Momentum")
def AnchoredMomentum(s, ma=EMA, smooth=7, signal=8, momentum=10):
    m = s.avg(s.x, length(2 * momentum + 1))
    a = s.let(where(m.ne(0), (div(s.ma(ma, s.x, smooth), m) - 1) * 100, 0.0))
    sig = s.avg(a, signal)
    return s.result({"Amom": a, "Signal": sig}, s.compare(a - sig))


@indicator("Momentum")
def TickLineMomentumOscillator(s, ma=EMA, n=10, smooth=5):
    p = s.lag(s.ma(ma, s.x, n), 1)
    ticks = s.sum(s.let(where(s.x > p, 1.0, where(s.x < p, -1.0, 0.0))))
    t = s.ma(ma, s.roc(ticks, smooth), smooth)
    return s.result({"Tlmo": t}, s.crossing(t - s.lag(t, 1), t, 5, -5))


@indicator("Momentum")
def MomentumOscillator(s, ma=WMA, n=14):
    m = s.let(pct(s.x, s.lag(s.x, n)))
    y = s.ma(ma, m, n)
    return s.result({"Mo": m, "Signal": y}, s.compare(y))


@indicator("Momentum")
def RelativeMomentumIndex(s, ma=WILDER, n1=14, n2=3):
    d = s.let(s.change(s.x, n2))
    r = s.let(rsi_of(s.ma(ma, mx(d, 0), n1), s.ma(ma, mx(-d, 0), n1)))
    sig = s.ma(ma, r, n1)
    h = s.let(r - sig)
    return s.result({"Rmi": r, "Signal": sig, "Histogram": h}, s.crossing(h, r, 70, 30))


@indicator("Momentum")
def SqueezeMomentumIndicator(s, ma=SMA, n=20):
    high, low = s.range_of(s.x)
    mid = (s.max(high, n) + s.min(low, n)) / 2
    y = s.linreg(s.x - (mid + s.ma(ma, s.x, n)) / 2, n)
    return s.result({"Smi": y}, s.compare(y))


# ---- RSI family ----------------------------------------------------------------------------------


@indicator("Momentum")
def RelativeStrengthIndex(s, ma=WILDER, n=14, signal=3):
    r = s.rsi(s.x, n, ma)
    sig = s.ma(ma, r, signal)
    h = s.let(r - sig)
    return s.result({"Rsi": r, "Signal": sig, "Histogram": h}, s.crossing(h, r, 70, 30))


def turned(s, key, r, over, under, **more):
    """A bounded line that signals by its own slope."""
    r = s.let(r)
    return s.result({key: r} | more, s.crossing(r - s.lag(r, 1), r, over, under))


def against(s, key, r, sig, over, under, **more):
    """A bounded line that signals against its average."""
    return s.result({key: r, "Signal": sig} | more, s.crossing(r - sig, r, over, under))


def streak(s, x):
    """Rows in a row that rose, or minus those that fell."""
    last = s.lag(x, 1)
    return s.rec(lambda y: where(x > last, where(y >= 0, y + 1, 1.0), where(x < last, where(y <= 0, y - 1, -1.0), 0.0)))


def connors(s, ma=WILDER, n1=2, n2=3, n3=100):
    r = s.rsi(s.x, n2, ma)
    c = s.roc(r, n3)
    count = lit(0.0)
    for j in range(1, n3):  # the row itself does not count once the window is full
        count = count + where((s.rn > j) & (s.lag(c, j) <= c), 1.0, 0.0)
    rank = s.let(clamp((count + where(s.rn < n3, 1.0, 0.0)) * (100 / n3), 100, 0))
    k = s.rsi(streak(s, s.x), n1, ma)
    return r, rank, k, s.let(clamp((r + rank + k) / 3, 100, 0))


@indicator("Momentum")
def ConnorsRelativeStrengthIndex(s, ma=WILDER, n1=2, n2=3, n3=100):
    r, rank, k, c = connors(s, ma, n1, n2, n3)
    return s.result({"Rsi": r, "PctRank": rank, "StreakRsi": k, "ConnorsRsi": c}, s.crossing(c - s.lag(c, 1), c, 70, 30), "ConnorsRsi")


@indicator("Momentum")
def StochasticConnorsRelativeStrengthIndex(s, ma=WILDER, n1=2, n2=3, n3=100, s1=3, s2=3):
    st = s.of("StochasticOscillator", connors(s, ma, n1, n2, n3)[3], ma=ma, n=n2, s1=s1, s2=s2).outputs
    return against(s, "SaRsi", st["FastD"], st["SlowD"], 70, 30)


@indicator("Momentum")
def AsymmetricalRelativeStrengthIndex(s, n=14):
    c = _one_row_pct(s)
    up = s.sum(s.let(where(c >= 0, 1.0, 0.0)), n)
    a, b = s.let(div(1, up)), s.let(div(1, n - up))
    return turned(s, "Arsi", rsi_of(s.smooth(mx(c, 0), a), s.smooth(mx(-c, 0), b)), 70, 30)


@indicator("Momentum")
def AdaptiveRelativeStrengthIndex(s, ma=WILDER, n=14):
    y = s.smooth(s.x, s.let(abs_(s.rsi(s.x, n, ma) / 100 - 0.5) * 2))
    return s.result({"Arsi": y}, s.compare(s.x - y))


@indicator("Momentum")
def ApirineSlowRelativeStrengthIndex(s, ma=WILDER, n=14, smooth=6):
    e = s.ma(ma, s.x, smooth)
    return turned(s, "Asrsi", rsi_of(s.ma(ma, mx(s.x - e, 0), n), s.ma(ma, mx(e - s.x, 0), n)), 70, 30)


@indicator("Momentum")
def BreakoutRelativeStrengthIndex(s, n=14, back=2):
    p = s.let(s.full * div(s.close - s.open, s.high - s.low) * s.sum(s.volume, back))
    last = s.lag(p, 1)
    up, down = s.sum(s.let(where(p > last, abs_(p), 0.0)), n), s.sum(s.let(where(p < last, abs_(p), 0.0)), n)
    return turned(s, "Brsi", rsi_of(up, down), 80, 20)


@indicator("Momentum")
def LiquidRelativeStrengthIndex(s, n=14):
    a, b = s.let(s.change(s.x)), s.let(s.change(s.volume))
    num, den = s.smooth(mx(a, 0) * mx(b, 0), 1 / n), s.smooth(abs_(a) * abs_(b), 1 / n)
    return turned(s, "Lrsi", clamp(pct(num, den), 100, 0), 80, 20)


@indicator("Momentum")
def FoldedRelativeStrengthIndex(s, ma=EMA, n=14):
    f = s.sum(s.let(abs_(s.rsi(s.x, n, ma) - 50) * 2), n)
    return against(s, "Frsi", f, s.ma(ma, f, n), 50, 10)


@indicator("Momentum")
def VolumeWeightedRelativeStrengthIndex(s, ma=WMA, n=10, smooth=3):
    v = s.let(s.change(s.x) * s.volume)
    up, down = s.ma(ma, mx(v, 0), n), s.ma(ma, mx(-v, 0), n)
    r = where(down.eq(0), 100.0, where(up.eq(0), 0.0, 100 - div(100, 1 + div(up, down))))
    y = s.ma(ma, r * 2 - 100, smooth)
    return s.result({"Vwrsi": y}, s.compare(y - s.lag(y, 1)))


@indicator("Momentum")
def RapidRelativeStrengthIndex(s, ma=EMA, n=14):
    d = s.let(s.change(s.x))
    r = s.let(rsi_of(s.sum(s.let(mx(d, 0)), n), s.sum(s.let(mx(-d, 0)), n)))
    y = s.ma(ma, r, n)
    return s.result({"Rrsi": r, "Signal": y}, s.crossing(y - s.lag(y, 1), y, 70, 30))


def _momenta(s, n1):
    m = max(n1, 2)
    return s.let(s.x - s.min(s.x, m)), s.let(s.max(s.x, m) - s.x)


def _limited_rsi(top, bottom):
    r = clamp(div(top, bottom), 1, 0)
    return where(bottom.eq(0), 100.0, where(top.eq(0), 0.0, clamp(100 - div(100, 1 + r), 100, 0)))


@indicator("Momentum")
def MomentaRelativeStrengthIndex(s, ma=EMA, n1=2, n2=14):
    up, down = _momenta(s, n1)
    r = s.let(_limited_rsi(s.ma(ma, up, n2), s.ma(ma, down, n2)))
    return against(s, "Mrsi", r, s.ma(ma, r, n2), 80, 20)


@indicator("Momentum")
def DoubleSmoothedRelativeStrengthIndex(s, ma=EMA, n1=2, n2=5, n3=25):
    up, down = (s.ma(ma, s.ma(ma, e, n2), n3) for e in _momenta(s, n1))
    r = s.let(_limited_rsi(up, down))
    return against(s, "Dsrsi", r, s.ma(ma, r, n3), 80, 20)


@indicator("Momentum")
def SelfAdjustingRelativeStrengthIndex(s, ma=SMA, n=14, smooth=21, mult=2.0):
    r = s.rsi(s.x, n, ma)
    d = s.let(s.sd(r, n, ma) * mult)
    sig = s.ma(ma, r, smooth)
    ob, os_ = s.let(d + 50), s.let(50 - d)
    return s.result({"SaRsi": r, "Signal": sig, "ObLevel": ob, "OsLevel": os_}, s.crossing(r - sig, r, ob, os_))


@indicator("Momentum")
def CCTStochRSI(s, ma=EMA, n1=5, n2=8, n3=13, n4=14, n5=21, s1=3, s2=8, signal=9):
    # each RSI but the first is one of the RSI before it, as each leaves its result for the next
    r, x = {}, s.x
    for n in (n1, n2, n3, n4, n5):
        r[n] = x = s.rsi(x, n, ma)

    def part(k, lo, hi, of=None):
        v = r[k]
        return s.let(pct(v - s.min(v, lo), s.max(v, hi) - s.min(v, of or lo)))

    t = [part(n5, n2, n3, n3), part(n5, n5, n5), part(n4, n4, n4), part(n5, n3, n2), part(n1, n1, n1), part(n3, n3, n3), part(n2, n2, n2)]
    sig = s.ma(ma, t[0], signal)
    out = {"Type1": t[0], "Type2": t[1], "Type3": t[2], "Type4": s.ma(ma, t[3], s2), "Type5": s.ma(ma, t[4], s1), "Type6": s.ma(ma, t[5], s1), "TypeCustom": s.ma(ma, t[6], s1), "Signal": sig}
    return s.result(out, s.crossing(t[0] - sig, t[0], 90, 10))


@indicator("Momentum")
def StochasticRelativeStrengthIndex(s, ma=WILDER, n=14, s1=3, s2=3):
    st = s.of("StochasticOscillator", s.rsi(s.x, n, ma), ma=ma, n=n, s1=s1, s2=s2).outputs
    return against(s, "StochRsi", st["FastD"], st["SlowD"], 80, 20)


# ---- stochastics ---------------------------------------------------------------------------------


@indicator("Momentum")
def StochasticOscillator(s, ma=SMA, n=14, s1=3, s2=3):
    k = s.stoch(s.x, n)
    d = s.ma(ma, k, s1)
    slow = s.ma(ma, d, s2)
    return s.result({"FastK": k, "FastD": d, "SlowD": slow}, s.crossing(d - slow, d, 80, 20))


@indicator("Momentum")
def StochasticFastOscillator(s, ma=EMA, n=14, s1=3, s2=2):
    st = s.run("StochasticOscillator", ma=ma, n=n, s1=s1, s2=s2).outputs
    return against(s, "Sfo", st["FastD"], st["SlowD"], 80, 20)


@indicator("Momentum")
def StochasticRegular(s, ma=SMA, n1=5, n2=3):
    st = s.run("StochasticOscillator", ma=ma, n=n1, s1=n2, s2=n2).outputs
    return against(s, "Sco", st["FastK"], st["FastD"], 70, 30)


def place(s, x, n, over=100.0):
    """Place of x in its own range of n rows."""
    x, m = s.let(x), max(n, 2)
    return s.let(clamp(div(x - s.min(x, m), s.max(x, m) - s.min(x, m)) * over, over, 0))


@indicator("Momentum")
def AdaptiveStochastic(s, n=50, fast=50, slow=200):
    y = s.linreg(s.x, abs(slow - fast))
    er = s.er(y, n)
    a = er * s.max(y, fast) + (1 - er) * s.max(y, slow)
    b = er * s.min(y, fast) + (1 - er) * s.min(y, slow)
    return turned(s, "Ast", clamp(div(y - b, a - b), 1, 0), 0.8, 0.2)


@indicator("Momentum")
def BilateralStochasticOscillator(s, ma=SMA, n=100, signal=20):
    m = s.ma(ma, s.x, n)
    h, l = s.max(m, n), s.min(m, n)
    r = s.ma(ma, h - l, n)
    bull, bear = s.let(div(m, r) - div(l, r)), s.let(abs_(div(m, r) - div(h, r)))
    o = s.let(mx(bull, bear))
    sig = s.ma(ma, o, signal)
    return s.result({"Bull": bull, "Bear": bear, "Bso": o, "Signal": sig}, s.when((bull > bear) | (bull > sig), (bear > bull) | (bull < sig)), "Bso")


@indicator("Momentum")
def NaturalStochasticIndicator(s, ma=EMA, n=20, smooth=10):
    high, low = s.range_of(s.x)
    h, l = s.max(high, n), s.min(low, n)
    f = s.let(div(s.x - l, h - l))
    y = s.fir(f, [1 / math.sqrt(j + 1) for j in range(n)])
    y = s.ma(ma, y * 200 - 100, smooth)
    return s.result({"Nst": y}, s.compare(y - s.lag(y, 1)))


@indicator("Momentum")
def FisherTransformStochasticOscillator(s, ma=WMA, n=2, stoch=30, smooth=5):
    x, total = s.x, lit(0.0)
    for w in (5, 4, 3, 2, 1, 1, 1, 1, 1, 1):
        x = s.ma(ma, x, n)
        total = total + x * w
    r = s.let(total / 20)
    h, l = s.max(r, stoch), s.min(r, stoch)
    f = clamp(div(s.sum(s.let(r - l), smooth), s.sum(s.let(h - l), smooth) + 0.0001) * 100, 100, 0)
    e = s.let(exp((f - 50) * 0.2))
    return turned(s, "Ftso", clamp((div(e - 1, e + 1) + 1) * 50, 100, 0), 70, 30)


@indicator("Momentum")
def PremierStochasticOscillator(s, ma=EMA, n=8, smooth=25):
    k = length(math.ceil(math.sqrt(smooth)))
    e = s.let(exp(s.ma(ma, s.ma(ma, (s.stoch(s.x, n) - 50) * 0.1, k), k)))
    return turned(s, "Pso", clamp(div(e - 1, e + 1), 1, -1), 0.9, -0.9)


@indicator("Momentum")
def TurboStochasticsFast(s, ma=SMA, n1=20, n2=10, turbo=2):
    k = s.stoch(s.x, n1)
    a, b = (s.linreg(x, n2 + min(turbo, n2)) for x in (k, s.ma(ma, k, n1)))
    return against(s, "Tsf", a, b, 70, 30)


@indicator("Momentum")
def TurboStochasticsSlow(s, ma=SMA, n1=20, n2=10, turbo=2):
    k = s.ma(ma, s.stoch(s.x, n1), n1)
    a, b = (s.linreg(x, n2 + min(turbo, n2)) for x in (k, s.ma(ma, k, n1)))
    return against(s, "Tsf", a, b, 70, 30)


@indicator("Momentum")
def DiNapoliPreferredStochasticOscillator(s, n1=8, n2=3, n3=3):
    r = s.smooth(s.stoch(s.x, n1), 1 / n2)
    return against(s, "Dpso", r, s.smooth(r, 1 / n3), 70, 30)


def _parts(s, n):
    high, low = s.range_of(s.x)
    h, l = s.max(high, n), s.min(low, n)
    return s.let(s.x - l), s.let(h - l)


@indicator("Momentum")
def DoubleSmoothedStochastic(s, ma=EMA, n1=2, n2=3, n3=15, n4=3):
    a, b = (s.ma(ma, s.ma(ma, e, n2), n3) for e in _parts(s, n1))
    d = s.let(clamp(pct(a, b), 100, 0))
    return against(s, "Dss", d, s.ma(ma, d, n4), 70, 30)


@indicator("Momentum")
def StochasticCustomOscillator(s, ma=SMA, n1=7, n2=3, n3=12):
    a, b = (s.ma(ma, e, n2) for e in _parts(s, n1))
    d = s.let(clamp(pct(a, b), 100, 0))
    return against(s, "Sco", d, s.ma(ma, d, n3), 70, 30)


@indicator("Momentum")
def DoubleStochasticOscillator(s, ma=SMA, n=14, smooth=3):
    d = s.ma(ma, place(s, s.stoch(s.x, n), n), smooth)
    return against(s, "Dso", d, s.ma(ma, d, smooth), 80, 20)


@indicator("Momentum")
def DMIStochastic(s, ma=SMA, n1=10, n2=10, n3=3, n4=3):
    d = s.run("AverageDirectionalIndex", ma=ma, n=n1).outputs
    y = s.ma(ma, s.ma(ma, place(s, d["DiMinus"] - d["DiPlus"], n2), n3), n4)
    return turned(s, "DmiStochastic", y, 90, 10)


@indicator("Momentum")
def StochasticMomentumIndex(s, ma=EMA, n1=2, n2=8, s1=5, s2=5):
    high, low = s.range_of(s.x)
    h, l = s.max(high, n1), s.min(low, n1)
    d, r = (s.ma(ma, s.ma(ma, e, n2), s1) for e in (s.let(s.x - (h + l) / 2), s.let(h - l)))
    y = s.let(clamp(pct(d, r / 2), 100, -100))
    sig = s.ma(ma, y, s2)
    return s.result({"Smi": y, "Signal": sig}, s.compare(y - sig))


@indicator("Momentum")
def SwamiStochastics(s, fast=12, slow=48):
    a, b = _parts(s, slow - fast)
    a, b = s.smooth(a, 0.5), s.smooth(b, 0.5)
    y = s.rec(lambda y: where(b.ne(0), clamp(div(a * 0.2, b) + y * 0.8, 1, 0), 0.0))
    return turned(s, "Ss", y, 0.8, 0.2)


# ---- Chande, DeMark ------------------------------------------------------------------------------


def _cmo(s, n, scale=100.0):
    d = s.let(s.change(s.x))
    up, down = s.sum(s.let(mx(d, 0)), n), s.sum(s.let(mx(-d, 0)), n)
    return s.let(clamp(div(up - down, up + down) * scale, scale, -scale))


@indicator("Momentum")
def ChandeMomentumOscillator(s, ma=EMA, n=14, signal=3):
    c = _cmo(s, n)
    return against(s, "Cmo", c, s.ma(ma, c, signal), 50, -50)


@indicator("Momentum")
def ChandeQuickStick(s, ma=SMA, n=14):
    y = s.ma(ma, s.x - s.open, n)
    return s.result({"Cqs": y}, s.compare(y))


@indicator("Momentum")
def ChandeMomentumOscillatorFilter(s, ma=WMA, n=9, limit=3.0):
    d = s.change(s.x)
    d = s.let(where(abs_(d) > limit, 0.0, d))
    c = s.let(clamp(pct(s.sum(d, n), s.sum(s.let(abs_(d)), n)), 100, -100))
    return against(s, "Cmof", c, s.ma(ma, c, n), 70, -70)


@indicator("Momentum")
def ChandeMomentumOscillatorAbsolute(s, n=9):
    c = clamp(div(abs_(s.change(s.x, n)) * 100, s.sum(s.let(abs_(s.change(s.x))), n)), 100, 0)
    return turned(s, "Cmoa", c, 70, 30)


def _three(s, n1, n2, n3):
    d = s.let(s.x - s.lag(s.x, 1))
    a = s.let(abs_(d))
    out = lit(0.0)
    for n in (n1, n2, n3):
        out = out + clamp(div(s.sum(d, n), s.sum(a, n)), 1, -1)
    return s.let(out * (100 / 3))


@indicator("Momentum")
def ChandeMomentumOscillatorAverage(s, n1=5, n2=10, n3=20):
    return turned(s, "Cmoa", _three(s, n1, n2, n3), 50, -50)


@indicator("Momentum")
def ChandeMomentumOscillatorAbsoluteAverage(s, n1=5, n2=10, n3=20):
    return turned(s, "Cmoaa", abs_(_three(s, n1, n2, n3)), 70, 30)


@indicator("Momentum")
def ChandeCompositeMomentumIndex(s, ma=DEMA, n1=5, n2=10, n3=20, smooth=3):
    dev, x = [], s.x
    for n in (n1, n2, n3):  # each deviation is one of the deviation before it
        x = s.sd(x, n, ma)
        dev.append(x)
    parts = [s.ma(ma, _cmo(s, n), smooth) for n in (n1, n2, n3)]
    top, all_ = lit(0.0), lit(0.0)
    for d, c in zip(dev, parts, strict=True):
        top, all_ = top + d * c, all_ + d
    m = s.let(clamp(div(top, all_), 100, -100))
    e, a = s.smooth(m, min(max(2 / (smooth + 1), 0.01), 0.99)), s.avg(m, n1)
    return s.result({"Ccmi": m, "Signal": a}, s.crossing(e - a, e, 70, -70))


@indicator("Momentum")
def ChandeMomentumOscillatorAverageDisparityIndex(s, ma=EMA, n1=200, n2=50, n3=20):
    y = lit(0.0)
    for n in (n1, n2, n3):
        y = y + pct(s.x - s.ma(ma, s.x, n), s.x)
    y = s.let(y / 3)
    return s.result({"Cmoadi": y}, s.compare(y))


@indicator("Momentum")
def ChandeKrollRSquaredIndex(s, ma=SMA, n=14, smooth=3):
    y = s.ma(ma, sq(s.corr(s.i, s.x, n)), smooth)
    return s.result({"Ckrsi": y}, s.compare(y - s.lag(y, 1)))


@indicator("Volatility")
def ChandeVolatilityIndexDynamicAverageIndicator(s, ma=EMA, n=20, alpha1=0.2, alpha2=0.04):
    d = s.sd(s.x, n, ma)
    r = s.let(div(d, s.ma(ma, d, n)))
    a, b = (s.smooth(s.x, s.let(r * k), seed=s.x) for k in (alpha1, alpha2))
    return s.result({"Cvida1": a, "Cvida2": b}, s.both(s.x - mx(a, b), s.x - mn(a, b)), None)


@indicator("Trend")
def ChandeTrendScore(s, start=11, end=20):
    y = lit(0.0)
    for j in range(start, end + 1):
        y = y + where(s.x >= s.lag(s.x, j), 1.0, -1.0)
    y = s.let(y)
    return s.result({"Cts": y}, s.compare(y))


@indicator("Momentum")
def ChandeForecastOscillator(s, n=14):
    y = s.let(pct(s.x - s.linreg(s.x, n), s.x))
    return s.result({"Cfo": y}, s.compare(y))


@indicator("Momentum")
def ChandeIntradayMomentumIndex(s, n=14):
    d = s.let(s.x - s.open)
    up, down = s.rec(lambda y: where(d > 0, y + d, 0.0)), s.rec(lambda y: where(d < 0, y - d, 0.0))
    a, b = s.sum(up, n), s.sum(down, n)
    return turned(s, "Cimi", clamp(pct(a, a + b), 100, 0), 70, 30)


@indicator("Momentum")
def DemarkRangeExpansionIndex(s, n=5):
    h, l = s.range_of(s.x)
    H, L, C = (lambda k: s.lag(h, k)), (lambda k: s.lag(l, k)), (lambda k: s.lag(s.x, k))  # noqa: N806
    a = where(((h >= L(5)) | (h >= L(6))) & ((l <= H(5)) | (l <= H(6))), 0.0, 1.0)
    b = where((H(2) >= C(8)) & ((L(2) <= C(7)) | (L(2) <= C(8))), 0.0, 1.0)
    m = s.let(h - H(2) + (l - L(2)))
    return turned(s, "Drei", pct(s.sum(s.let(a * b * m), n), s.sum(s.let(abs_(m)), n)), 100, -100)


@indicator("Momentum")
def DemarkPressureRatioV1(s, n=13):
    h, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    up, down = div(s.open - last, last), div(last - s.open, s.open)
    body = s.let((s.x - s.open) * s.volume)
    b = s.let(where(up > 0.15, (h - last + s.x - l) * s.volume, where(s.x > s.open, body, 0.0)))
    p = s.let(where(down > 0.15, (last - l + h - s.x) * s.volume, where(s.x < s.open, body, 0.0)))
    b, p = s.sum(b, n), s.sum(p, n)
    return turned(s, "Dpr", clamp(pct(b, b - p), 100, 0), 75, 25)


@indicator("Momentum")
def DemarkPressureRatioV2(s, n=10):
    h, l = s.range_of(s.x)
    r = s.let(div(s.x - s.open, h - l) * s.volume)
    b, p = s.sum(s.let(where(s.x > s.open, r, 0.0)), n), s.sum(s.let(where(s.x < s.open, r, 0.0)), n)
    d = b + abs_(p)
    return turned(s, "Dpr", where(d.ne(0), clamp(pct(b, d), 100, 0), 50.0), 75, 25)


def _run(s, key, count, back):
    up, down = lit(0.0), lit(0.0)
    for j in range(count):
        a, b = s.lag(s.x, j), s.lag(s.x, j + back)
        up, down = up + where(a > b, 1.0, 0.0), down + where(a < b, 1.0, 0.0)
    up, down = s.let(up), s.let(down)
    flag = s.let(where(down.eq(count), 1.0, where(up.eq(count), -1.0, 0.0)))
    return s.result({key: s.let(where(flag.ne(0), s.x, 0.0))}, s.when((flag > 0) | (up > down), (flag < 0) | (down > up)))


@indicator("Momentum")
def DemarkReversalPoints(s, n1=9, n2=4):
    return _run(s, "Drp", n1, n2)


@indicator("Momentum")
def DemarkSetupIndicator(s, n=4):
    return _run(s, "Dsi", n, n)


@indicator("Momentum")
def Demarker(s, ma=SMA, n=20):
    h, l = s.range_of(s.x)
    up, down = mx(h - s.lag(h, 1), 0), mx(s.lag(l, 1) - l, 0)
    a, b = s.ma(ma, up, n), s.ma(ma, down, n)
    return turned(s, "Dm", clamp(pct(a, a + b), 100, 0), 70, 30)


__all__ = ["against", "lines", "pct", "place", "sqrt", "turned"]
