"""Price channels and bands."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, div, lit, log, mn, mx, power, sin, sign, sq, sqrt, where

from .averages import _hold
from .momentum import pct
from .registry import EMA, SMA, WILDER, WMA, indicator, length
from .volatility import linear_tracker

CHANNEL = ("UpperChannel", "MiddleChannel", "LowerChannel")


def around(s, m, d, signal="bands"):
    m, d = s.let(m), s.let(lit(d))
    return s.band_result(m + d, m, m - d, signal)


def between(s, u, l, signal="compare", names=("UpperBand", "MiddleBand", "LowerBand")):
    u, l = s.let(u), s.let(l)
    return s.band_result(u, (u + l) / 2, l, signal, names)


def so_far(s, e):
    """Sum of all rows over the number of rows before this one; 0 on the first."""
    return s.let(div(s.total(s.let(e)), s.i))


@indicator("Trend")
def PriceChannel(s, ma=EMA, n=21, share=0.06):
    e = s.ma(ma, s.x, n)
    return between(s, e * (1 + share), e * (1 - share), names=CHANNEL)


@indicator("Trend")
def DonchianChannels(s, n=20):
    h, l = s.range_of(s.x)
    return between(s, s.max(h, n), s.min(l, n), names=CHANNEL)


@indicator("Volatility")
def StandardDeviationChannel(s, n=40, mult=2.0):
    d = s.sd(s.x, n)
    return around(s, s.linreg(d, n), d * mult)  # the regression reads what the deviation left


@indicator("Volatility")
def StollerAverageRangeChannels(s, ma=SMA, n=14, mult=2.0):
    m = s.ma(ma, s.x, n)
    return around(s, m, s.atr(n, ma, m) * mult)


@indicator("Trend")
def MovingAverageChannel(s, ma=SMA, n=20):
    h, l = s.range_of(s.x)
    return between(s, s.ma(ma, h, n), s.ma(ma, l, n))


@indicator("Trend")
def MovingAverageEnvelope(s, ma=SMA, n=20, mult=0.025):
    m = s.ma(ma, s.x, n)
    return around(s, m, m * mult, "compare")


@indicator("Trend")
def FractalChaosBands(s):
    h, l = s.range_of(s.x)
    h1, h2, h3, l1, l2, l3 = (s.lag(e, k) for e in (h, l) for k in (1, 2, 3))
    return between(s, s.last(h2, (h1 < h2) & (h3 < h2)), s.last(l2, (l1 > l2) & (l3 > l2)), "bands")


@indicator("Volatility")
def UltimateMovingAverageBands(s, ma=SMA, least=5, most=50, mult=2.0):
    u = s.run("UltimateMovingAverage", ma=ma, least=least, most=most).value
    return around(s, u, s.sd(u, least, ma) * mult)


@indicator("Trend")
def UniChannel(s, ma=SMA, n=10, up=0.02, down=0.02, type1=False):
    m = s.ma(ma, s.x, n)
    return s.band_result(m + up if type1 else m * (1 + up), m, m - down if type1 else m * (1 - down))


@indicator("Trend")
def WilsonRelativePriceChannel(s, ma=EMA, n=34, smooth=1, over=70.0, under=30.0, upper=55.0, lower=45.0):
    r = s.rsi(s.x, n, ma)
    u1, s1, u2, s2 = (s.let(s.x - s.x * s.ma(ma, r - k, smooth) / 100) for k in (over, under, upper, lower))
    return s.result({"S1": s1, "S2": s2, "U1": u1, "U2": u2}, s.both(s.x - mn(u1, u2), s.x - mx(s1, s2)), None)


@indicator("Trend")
def LinearChannels(s, n=14, mult=50.0):
    a, u, l = linear_tracker(s, n, mult)
    return s.result({"UpperBand": u, "LowerBand": l}, s.bands(s.x - a, u, l), None)


@indicator("Trend")
def GChannels(s, n=100):
    a, b = s.scan(lambda a, b: [mx(s.x, a) - (a - b) / n, mn(s.x, b) + (a - b) / n], (0.0, 0.0))
    return between(s, a, b)


@indicator("Trend")
def HighLowMovingAverage(s, ma=WMA, n=14):
    h, l = s.range_of(s.x)
    return between(s, s.ma(ma, s.max(h, n), n), s.ma(ma, s.min(l, n), n))


@indicator("Trend")
def HighLowBands(s, ma=SMA, n=14, shift=1.0):
    t = s.ma(ma, s.ma(ma, s.x, n), n)
    return around(s, t, t * (shift / 100))


@indicator("Trend")
def HurstCycleChannel(s, ma=WILDER, fast=10, slow=30, fast_mult=1.0, slow_mult=3.0):
    a, b = length(math.ceil(fast / 2)), length(math.ceil(slow / 2))
    ka, kb = length(math.ceil(a / 2)), length(math.ceil(b / 2))
    ra = s.atr(a, ma)
    rb = s.atr(b, ma, ra)  # reads what the first range left
    ma_, mb = s.ma(ma, s.x, a), s.ma(ma, s.x, b)
    pa, pb = where(s.rn > ka, s.lag(ma_, ka), s.x), where(s.rn > kb, s.lag(mb, kb), s.x)
    ct, cb, mt, mbo = s.let(pa + ra * fast_mult), s.let(pa - ra * fast_mult), s.let(pb + rb * slow_mult), s.let(pb - rb * slow_mult)
    cm, mm = s.let((ct + cb) / 2), s.let((mt + mbo) / 2)
    out = {"FastUpperBand": ct, "SlowUpperBand": mt, "FastMiddleBand": cm, "SlowMiddleBand": mm, "FastLowerBand": cb, "SlowLowerBand": mbo, "OMed": s.let(div(cm - mbo, mt - mbo)), "OShort": s.let(div(s.x - mbo, mt - mbo))}
    return s.result(out, s.both(s.x - ct, s.x - cb), None)


@indicator("Trend")
def HurstBands(s, n=10, inner=1.6, outer=2.6, extreme=4.2):
    p = s.lag(s.x, length(math.ceil(n / 2) + 1))
    m = s.avg(s.let(p), n)
    c = s.rec2(lambda y, z: where(p.eq(0), y * 2 - z, m))
    out = {f"Upper{k}Band": s.let(c * (1 + w / 100)) for k, w in (("Extreme", extreme), ("Outer", outer), ("Inner", inner))}
    out["MiddleBand"] = c
    out |= {f"Lower{k}Band": s.let(c * (1 - w / 100)) for k, w in (("Extreme", extreme), ("Outer", outer), ("Inner", inner))}
    return s.result(out, s.compare(s.x - c), None)


@indicator("Trend")
def HirashimaSugitaRS(s, ma=WMA, n=1000):
    e = s.ema(s.x, n)
    w = s.ma(ma, abs_(s.x - e), n)
    a = s.linreg(s.x - e, n)
    b = s.linreg(s.x - e - a, n)
    m = s.let(e + a + b - s.lag(b, 1))
    return s.result({"UpperBand1": s.let(m + w), "UpperBand2": s.let(m + w * 2), "MiddleBand": m, "LowerBand1": s.let(m - w), "LowerBand2": s.let(m - w * 2)}, s.compare(s.x - m), None)


@indicator("Trend")
def FlaggingBands(s, n=14):
    d = s.let(s.sd(s.x, n) / n)

    def step(o, new):
        a1, b1 = s.first(s.x, o["a"]), s.first(s.x, o["b"])
        a2, b2 = where(s.rn > 2, o["a2"], s.x), where(s.rn > 2, o["b2"], s.x)
        a3, b3 = where(s.rn > 3, o["a3"], s.x), where(s.rn > 3, o["b3"], s.x)
        new["a"] = where(s.x > a1, s.x, where(a2.eq(a3), a2 - d, a2))
        new["b"] = where(s.x < b1, s.x, where(b2.eq(b3), b2 + d, b2))
        new["side"] = where(s.x > a2, 1.0, where(s.x < b2, 0.0, o["side"]))
        new["a3"], new["b3"], new["a2"], new["b2"] = o["a2"], o["b2"], o["a"], o["b"]

    m = s.machine(dict.fromkeys(("a", "b", "side", "a2", "b2", "a3", "b3"), 0.0), step)
    a, b, side = m["a"], m["b"], m["side"]
    mid = (a + b) / 2
    t = s.let(where(side.eq(1), (a + mid) / 2, (b + mid) / 2))
    return s.result({"UpperBand": a, "MiddleBand": t, "LowerBand": b, "TrailingStop": s.let(side * b + (1 - side) * a)}, s.compare(s.x - t), None)


@indicator("Volatility")
def KirshenbaumBands(s, ma=EMA, n1=30, n2=20, factor=1.0):
    e = s.ma(ma, s.x, n1)
    r = s.rms(s.linreg(e, n2) - s.x, n2)
    u, l = s.let(e + r * factor), s.let(e - r * factor)
    return s.result({"UpperBand": u, "MiddleBand": e, "LowerBand": l}, s.both(s.x - u, s.x - l), None)


@indicator("Volatility")
def KaufmanAdaptiveBands(s, n=100, factor=3.0):
    k = s.let(power(s.er(s.x, n), factor))
    m, p = s.smooth(s.x, k), s.smooth(sq(s.x), k)
    return around(s, m, sqrt(p - sq(m)))


@indicator("Volatility")
def KeltnerChannels(s, ma=EMA, n1=20, n2=10, mult=2.0):
    e = s.ma(ma, s.x, n1)
    d = s.let(s.atr(n2, ma, e) * mult)
    return between(s, e + d, e - d)


@indicator("Volatility")
def VortexBands(s, ma="McNichollMovingAverage", n=20):
    b = s.ma(ma, s.x, n)
    d = s.let(s.ma(ma, s.x - b, n) * 2)
    u, l = s.let(b + d), s.let(b - d)
    return s.result({"UpperBand": u, "MiddleBand": b, "LowerBand": l}, s.when((u > l) & (u > b), (l > u) & (l > b)), None)


@indicator("Volume")
def VolumeAdaptiveBands(s, ma=SMA, n=100):
    a = s.let(mx(s.ma(ma, s.volume, n), 1))
    u, l = s.rec(lambda y: div(s.first(s.x, y) + s.x * a, a)), s.rec(lambda y: div(s.first(s.x, y) - s.x * a, -a))
    return between(s, s.ma(ma, u, n), s.ma(ma, l, n))


@indicator("Volatility")
def VariableMovingAverageBands(s, ma="VariableMovingAverage", n=6, mult=1.5):
    v = s.ma(ma, s.x, n)
    return around(s, v, s.atr(n, ma, v) * mult)


@indicator("Volatility")
def VervoortVolatilityBands(s, ma=EMA, n1=8, n2=13, mult=3.55, low=0.9):
    _, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    m = s.ma(ma, s.x, n1)
    e = s.ma(ma, m, n1)
    t = s.let(where(s.x >= last, s.x - s.lag(l, 1), last - l))
    d = s.ma(ma, s.avg(t, n2) * mult, n1)
    return s.band_result(e + d, s.avg(m, n1), e - d * low)


@indicator("Volatility")
def PriceHeadleyAccelerationBands(s, ma=SMA, n=20, factor=0.001):
    h, l = s.range_of(s.x)
    k = s.let(div((h - l) * (4000 * factor), h + l))
    return s.band_result(s.ma(ma, h * (k + 1), n), s.ma(ma, s.x, n), s.ma(ma, l * (1 - k), n))


@indicator("Trend")
def ProjectedSupportAndResistance(s, n=25):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    r = s.let(h - l)
    m = s.let((h + l) / 2)
    out = {"Support1": l - r * 0.25, "Support2": l - r * 0.5, "Resistance1": h + r * 0.25, "Resistance2": h + r * 0.5}
    return s.result({k: s.let(v) for k, v in out.items()} | {"MiddleBand": m}, s.compare(s.x - m), None)


@indicator("Trend")
def PeriodicChannel(s, n1=500, n2=2):
    def z(e):  # distance from the mean so far in mean distances so far
        d = s.let(e - so_far(s, e))
        return div(d, so_far(s, abs_(d)))

    side = sign(s.sum(s.let(abs_(s.corr(s.i, s.x, n2)))))
    w = s.let(sin(s.i * side / n1))
    c = so_far(s, s.x)
    d = so_far(s, abs_(s.x - c))
    k = s.let(c + (z(s.i) + z(w)) * d)
    o = so_far(s, abs_(s.x - k))
    out = {"K": k, "Os": o, "Ap": k + o, "Bp": k + o * 2, "Cp": k + o * 3, "Al": k - o, "Bl": k - o * 2, "Cl": k - o * 3}
    return s.result({key: s.let(v) for key, v in out.items()}, s.compare(s.x - k), None)


@indicator("Volatility")
def PriceLineChannel(s, ma=WILDER, n=100):
    r = s.atr(n, ma)

    def step(o, new):
        a, b = s.first(s.x, o["a"]), s.first(s.x, o["b"])
        new["sa"] = where(a - o["a2"] > 0, r, s.first(r / n, o["sa"]))
        new["sb"] = where(b - o["b2"] < 0, r, s.first(r / n, o["sb"]))
        new["a"], new["b"] = mx(s.x, a) - new["sa"] / n, mn(s.x, b) + new["sb"] / n
        new["a2"], new["b2"] = o["a"], o["b"]

    m = s.machine(dict.fromkeys(("sa", "sb", "a", "b", "a2", "b2"), 0.0), step)
    return between(s, m["a"], m["b"])


@indicator("Volatility")
def PriceCurveChannel(s, ma=WILDER, n=100):
    r = s.atr(n, ma)

    def step(o, new):
        a, b = s.first(s.x, o["a"]), s.first(s.x, o["b"])
        ca, cb = a > o["a2"], b < o["b2"]
        new["size"] = where((a - o["a2"] > 0) | (b - o["b2"] < 0), r, s.first(r / n, o["size"]))
        new["ka"], new["kb"] = where(ca, 0.0, o["ka"] + 1), where(cb, 0.0, o["kb"] + 1)
        new["a"] = mx(s.x, a) - new["size"] / n**2 * (new["ka"] + 1)
        new["b"] = mn(s.x, b) + new["size"] / n**2 * (new["kb"] + 1)
        new["a2"], new["b2"] = o["a"], o["b"]

    m = s.machine(dict.fromkeys(("size", "ka", "kb", "a", "b", "a2", "b2"), 0.0), step)
    return between(s, m["a"], m["b"])


@indicator("Volatility")
def ProjectionBands(s, n=14):
    h, l = s.range_of(s.x)
    b, c = s.slope(l, n)[0], s.slope(h, n)[0]
    u, d = h, l
    for j in range(1, n + 1):
        u, d = mx(u, s.lag(h, j - 1) + s.lag(c, j) * j), mn(d, s.lag(l, j - 1) + s.lag(b, j) * j)
    return between(s, u, d, "bands")


@indicator("Volatility")
def TrendTraderBands(s, ma=WMA, n=21, mult=3.0, width=20.0):
    a = s.let(s.lag(s.atr(n, ma), 1) * mult)
    hi, lo = s.let(s.lag(s.max(s.x, n), 1) - a), s.let(s.lag(s.min(s.x, n), 1) + a)
    up, down = (s.x > hi) & (s.x > lo), (s.x < lo) & (s.x < hi)
    e = s.ma(ma, s.last(where(up, hi, lo), up | down), n)
    return around(s, e, width)


@indicator("Volatility")
def TimeAndMoneyChannel(s, ma=SMA, n1=41, n2=82):
    k = length(math.ceil(n1 / 2))
    m = s.ma(ma, s.x, n1)
    b = s.lag(m, k)
    y = s.let(pct(s.x - b, b))
    v = s.let(s.ma(ma, sq(y), n2) - sq(s.ma(ma, y, n2)))
    o = s.let(sqrt(s.lag(v, k)))
    g = s.ma(ma, o, n1)
    out = {f"Ch{sgn}{j}": s.let(m * (1 + g * (0.01 * j * (1 if sgn == "Plus" else -1)))) for j in (1, 2, 3) for sgn in ("Plus", "Minus")}
    return s.result(out | {"Median": m}, s.compare(o - g), None)


@indicator("Trend")
def TironeLevels(s, n=20):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    r = h - l
    a = s.let((h + l + s.x) / 3)
    out = {"Tlh": h - r / 3, "Clh": l + r / 2, "Blh": l + r / 3, "Am": a, "Eh": a + r, "El": a - r, "Rh": a * 2 - l, "Rl": a * 2 - h}
    return s.result({k: s.let(v) for k, v in out.items()}, s.compare(s.x - a), None)


@indicator("Trend")
def TimeSeriesForecast(s, n=500):
    t = s.linreg(s.x, n)
    e = so_far(s, abs_(s.x - t))
    u, l = s.let(t + e), s.let(t - e)
    return s.result({"UpperBand": u, "MiddleBand": t, "LowerBand": l}, s.bands(s.x - t, u, l), "MiddleBand")


@indicator("Volatility")
def RangeBands(s, factor=1.0, ma=SMA, n=14):
    m = s.ma(ma, s.x, n)
    return around(s, m, (s.max(m, n) - s.min(m, n)) * factor)


@indicator("Trend")
def RangeIdentifier(s, n=34):
    h, l = s.range_of(s.x)

    def step(o, new):
        inside = (s.x < o["u"]) & (s.x > o["d"])
        new["u"], new["d"] = where(inside, o["u"], h), where(inside, o["d"], l)

    m = s.machine({"u": 0.0, "d": 0.0}, step)
    return between(s, m["u"], m["d"])


@indicator("Momentum")
def RateOfChangeBands(s, ma=EMA, n=12, smooth=3):
    r = s.roc(s.x, n)
    m, u = s.ma(ma, r, smooth), s.rms(r, n)
    return s.result({"UpperBand": u, "MiddleBand": m, "LowerBand": s.let(-u)}, s.bands(m - s.lag(m, 1), u, -u), None)


@indicator("Volatility")
def RootMovingAverageSquaredErrorBands(s, factor=1.0, ma=SMA, n=14):
    return around(s, s.ma(ma, s.x, n), s.sd(s.x, n, ma) * factor)


@indicator("Volatility")
def MovingAverageBands(s, ma=EMA, fast=10, slow=50, mult=1.0):
    f, m = s.ma(ma, s.x, fast), s.ma(ma, s.x, slow)
    d = s.let(s.rms(m - f, fast) * mult)
    u, l = s.let(m + d), s.let(m - d)
    return s.result({"UpperBand": u, "MiddleBand": f, "LowerBand": l}, s.bands(s.x - f, u, l), None)


@indicator("Trend")
def MovingAverageSupportResistance(s, ma=SMA, n=10, factor=2.0):
    m = s.ma(ma, s.x, n)
    return s.band_result(m * (1 + factor / 100), m, m / (1 + factor / 100), "compare")


@indicator("Trend")
def MotionToAttractionChannels(s, n=14):
    k = 1 / n

    def step(o, new):
        pa, pb = s.first(s.x, o["a"]), s.first(s.x, o["b"])
        new["a"] = where(s.x > s.first(s.x, o["am"]), s.x, pa)
        new["b"] = where(s.x < s.first(s.x, o["bm"]), s.x, pb)
        new["c"] = where((new["b"] - pb).ne(0), o["c"] + k, where((new["a"] - pa).ne(0), 0.0, o["c"]))
        new["d"] = where((new["a"] - pa).ne(0), o["d"] + k, where((new["b"] - pb).ne(0), 0.0, o["d"]))
        mid = (new["a"] + new["b"]) / 2
        new["am"], new["bm"] = new["c"] * mid + (1 - new["c"]) * new["a"], new["d"] * mid + (1 - new["d"]) * new["b"]

    m = s.machine(dict.fromkeys(("a", "b", "c", "d", "am", "bm"), 0.0), step)
    u, l = m["am"], m["bm"]
    return between(s, u, l)


@indicator("Volatility")
def MeanAbsoluteErrorBands(s, factor=1.0, ma=SMA, n=14):
    m = s.ma(ma, s.x, n)
    return around(s, m, so_far(s, abs_(s.x - m)) * factor)


@indicator("Volatility")
def MeanAbsoluteDeviationBands(s, factor=2.0, ma=SMA, n=20):
    m = s.ma(ma, s.x, n)
    return around(s, m, s.sd(m, n, ma) * factor)


@indicator("Trend")
def MovingAverageDisplacedEnvelope(s, ma=EMA, n1=9, n2=13, share=0.5):
    e = s.lag(s.ma(ma, s.x, n1), n2)
    return between(s, e * ((100 + share) / 100), e * ((100 - share) / 100), "bands")


@indicator("Trend")
def Dema2Lines(s, ma=EMA, fast=10, slow=40):
    a, b = (s.ma(ma, s.ma(ma, s.x, n), n) for n in (fast, slow))
    return s.result({"Dema1": a, "Dema2": b}, s.compare(a - b), None)


@indicator("Volatility")
def DynamicSupportAndResistance(s, ma=WILDER, n=25):
    h, l = s.range_of(s.x)
    a = s.let(s.atr(n, ma) * math.sqrt(n))
    lo, hi = s.let(s.max(h, n) - a), s.let(s.min(l, n) + a)
    m = s.let((lo + hi) / 2)
    return s.result({"Support": lo, "Resistance": hi, "MiddleBand": m}, s.compare(s.x - m), None)


@indicator("Trend")
def DailyAveragePriceDelta(s, ma=SMA, n=21):
    h, l = s.range_of(s.x)
    d = s.let(s.ma(ma, h, n) - s.ma(ma, l, n))
    u, b = s.let(h + d), s.let(l - d)
    return s.result({"UpperBand": u, "LowerBand": b}, s.when(h > s.lag(u, 1), l < s.lag(b, 1)), None)


@indicator("Volatility")
def DEnvelope(s, n=20, factor=2.0):
    a = 2 / (n + 1)

    def line(e):
        m = s.smooth(e, a)
        return s.let((m - s.smooth(m, a)) * ((2 - a) / (1 - a)))

    d = line(s.x)
    return around(s, d, line(abs_(s.x - d)) * factor)


@indicator("Trend")
def SmartEnvelope(s, n=14, factor=1.0):
    d = s.let(abs_(s.change(s.x)))

    def step(o, new):
        a, b = s.first(s.x, o["a"]), s.first(s.x, o["b"])
        new["a"] = mx(s.x, a) - mn(abs_(s.x - a), d) / n * o["sa"]
        new["b"] = mn(s.x, b) + mn(abs_(s.x - b), d) / n * o["sb"]
        new["sa"] = where(new["b"] < b, -factor, factor)
        new["sb"] = where(new["a"] > a, -factor, factor)

    m = s.machine(dict.fromkeys(("a", "b", "sa", "sb"), 0.0), step)
    return between(s, m["a"], m["b"])


@indicator("Trend")
def SupportResistance(s, ma=SMA, n=20):
    h, l = s.range_of(s.x)
    h, l, m, last = s.max(h, n), s.min(l, n), s.lag(s.ma(ma, s.x, n), 1), s.lag(s.x, 1)
    start = s.rn <= 1
    res, sup = s.let(s.last(h, ((last > m) & (s.x <= m)) | start)), s.let(s.last(l, ((last < m) & (s.x >= m)) | start))
    return s.result({"Support": sup, "Resistance": res}, s.both(s.x - res, s.x - sup), None)


def extrapolated(s, ma, n):
    """(deviation from the average, half of its line through n and 2n rows ago, carried on to now)."""
    y = s.let(s.x - s.ma(ma, s.x, n))
    a, b, xa, xb = s.lag(y, n), s.lag(y, 2 * n), s.lag(s.i, n), s.lag(s.i, 2 * n)
    return y, s.let(where((xb - xa).ne(0) & (b - a).ne(0), (a + div(s.i - xa, xb - xa) * (b - a)) / 2, 0.0))


@indicator("Trend")
def StationaryExtrapolatedLevels(s, ma=SMA, n=200):
    y, e = extrapolated(s, ma, n)
    u, l = s.max(s.max(e, n), n), s.min(s.min(e, n), n)
    return s.result({"UpperBand": u, "MiddleBand": y, "LowerBand": l}, s.compare(y - e), None)


@indicator("Trend")
def ScalpersChannel(s, ma=SMA, n1=15, n2=20):
    h, l = s.range_of(s.x)
    m = s.ma(ma, s.x, n2)
    y = s.let(m - log(s.atr(n2, ma, m) * math.pi))
    return s.result({"UpperBand": s.max(h, n1), "MiddleBand": y, "LowerBand": s.min(l, n1)}, s.compare(s.x - y), None)


@indicator("Volatility")
def SmoothedVolatilityBands(s, ma=EMA, n1=20, n2=21, deviation=2.4, adjust=0.9):
    a = s.let(s.atr(n1 * 2 - 1, ma) * deviation)
    m = s.ma(ma, s.x, n1)
    d = s.let(div(m * a, s.x))
    return s.band_result(m + d, s.ma(ma, s.x, n2), m - d * adjust)


@indicator("Trend")
def ExtendedRecursiveBands(s, n=100):
    k = 2 / (n + 1)
    a = s.rec(lambda y: mx(s.first(s.x, y), s.x) - abs_(s.x - s.first(s.x, y)) * k)
    b = s.rec(lambda y: mn(s.first(s.x, y), s.x) + abs_(s.x - s.first(s.x, y)) * k)
    return between(s, a, b)


@indicator("Trend")
def EfficientTrendStepChannel(s, n=100, fast=50, slow=200):
    er = s.er(s.x, n)
    d = s.let(er * s.sd(s.x * 2, fast) + (1 - er) * s.sd(s.x * 2, slow))
    return around(s, _hold(s, s.x, d), d)
