"""Volatility, trailing stops, and volume."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, clamp, div, lit, log, mn, mx, power, rsi_of, sign, sq, sqrt, where

from .averages import _aarma
from .momentum import against, lines, pct, turned
from .registry import EMA, SMA, WILDER, WMA, indicator, length

VWMA = "VolumeWeightedMovingAverage"


# ---- volatility ----------------------------------------------------------------------------------


@indicator("Volatility")
def StandardDeviationVolatility(s, ma=SMA, n=20):
    m = s.ma(ma, s.x, n)
    v = s.ma(ma, sq(s.x - m), n)
    d = s.let(sqrt(v))
    sig = s.ma(ma, d, n)
    return s.result({"StdDev": d, "Variance": v, "Signal": sig}, s.volatile(s.x - m, d, sig))


def _log_return(s):
    return s.let(log(div(s.x, s.lag(s.x, 1))))


def vol(s, key, y, level, base, **more):
    """A measure that lets the side of an average signal where it reaches a level."""
    y = s.let(y)
    return s.result({key: y} | more, s.volatile(s.x - base, y, s.lag(y, 1) if level is None else level))


@indicator("Volatility")
def HistoricalVolatility(s, ma=EMA, n=20):
    return vol(s, "Hv", s.sd(_log_return(s), n, ma) * (100 * math.sqrt(365)), None, s.ma(ma, s.x, n))


@indicator("Volatility")
def MovingAverageBandWidth(s, ma=EMA, fast=10, slow=50, mult=1.0):
    b = s.run("MovingAverageBands", ma=ma, fast=fast, slow=slow, mult=mult).outputs
    u, m, l = b["UpperBand"], b["MiddleBand"], b["LowerBand"]
    y = s.let(pct(u - l, m))
    return s.result({"Mabw": y}, s.bands(s.x - m, u, l))


@indicator("Volatility")
def MovingAverageAdaptiveFilter(s, n=10, filter=0.15, fast=0.667, slow=0.0645):
    a = s.smooth(s.x, s.let(sq(s.let(s.er(s.x, n) * (fast - slow) + slow))), seed=s.x)
    d = s.let(where(s.rn > 1, a - s.lag(a, 1), 0.0))
    return vol(s, "Maaf", s.sd(d, n) * filter, None, s.ema(s.x, n))


@indicator("Volatility")
def ReversalPoints(s, ma=EMA, n=100):
    k, last = length(math.ceil(n / 2)), s.lag(s.x, 1)
    a = s.ma(ma, abs_(s.x - last), k)
    return vol(s, "Rp", s.sum(s.let(div(a, s.ma(ma, a, k))), n), n + n / math.sqrt(n) / 2, s.ma(ma, s.x, k))


@indicator("Volatility")
def MayerMultiple(s, ma=SMA, n=200, threshold=2.4):
    m = s.ma(ma, s.x, n)
    return vol(s, "Mm", div(s.x, m), threshold, m)


@indicator("Volatility")
def MotionSmoothnessIndex(s, n=50):
    return vol(s, "Msi", div(s.sd(s.change(s.x), n), s.sd(s.x, n)), 0.5, s.ema(s.x, n))


@indicator("Volatility")
def ChoppinessIndex(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    r = s.max(h, n) - s.min(l, n)
    return vol(s, "Ci", where(r > 0, log(div(s.sum(s.tr(), n), r)) * (100 / math.log(n)), 0.0), 38.2, s.ma(ma, s.x, n))


@indicator("Volatility")
def UltimateVolatilityIndicator(s, ma=EMA, n=14):
    return vol(s, "Uvi", s.sum(s.let(abs_(s.x - s.open)), n) / n, 1, s.ma(ma, s.x, n))


@indicator("Volatility")
def QmaSmaDifference(s, n=14):
    q = s.rms(s.x, n)  # each average is taken of the one before it
    m = s.sma(q, n)
    return vol(s, "QmaSmaDiff", q - m, None, s.ema(m, n))


@indicator("Volatility")
def GarmanKlassVolatility(s, ma=WMA, n=14, signal=7):
    h, l = s.range_of(s.x)
    g = s.let(sq(log(div(h, l))) * 0.5 - sq(log(div(s.x, s.open))) * (2 * math.log(2) - 1))
    y = s.let(sqrt(s.i / n * s.sum(g, n)))
    sig = s.ma(ma, y, signal)
    return vol(s, "Gcv", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def GopalakrishnanRangeIndex(s, ma=WMA, n=5):
    h, l = s.range_of(s.x)
    y = s.let(log(s.max(h, n) - s.min(l, n)) * (1 / math.log(n)))
    sig = s.ma(ma, y, n)
    return s.result({"Gapo": y, "Signal": sig}, s.volatile(s.x - s.ma(ma, s.x, n), sig, s.lag(sig, 1)))


@indicator("Volatility")
def FastZScore(s, ma=SMA, n=200):
    k = length(math.ceil(n / 2))
    m = s.ma(ma, s.x, n)
    a, b = s.linreg(m, n), s.linreg(m, k)  # of the average, as the deviation is
    return vol(s, "Fzs", div(b - a, s.sd(m, n, ma)) / 2, 0, m)


@indicator("Volatility")
def VolatilitySwitchIndicator(s, ma=WMA, n=14):
    r = s.let(div(s.change(s.x), (s.x + s.lag(s.x, 1)) / 2))
    return vol(s, "Vsi", s.ma(ma, s.sd(r, n, ma), n), 0.5, s.ma(ma, s.x, n))


@indicator("Volatility")
def VerticalHorizontalFilter(s, ma=WMA, n=18, signal=6):
    y = s.let(div(abs_(s.max(s.x, n) - s.min(s.x, n)), s.sum(s.let(abs_(s.change(s.x))), n)))
    sig = s.ma(ma, y, signal)
    return vol(s, "Vhf", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def ClosedFormDistanceVolatility(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    a, b = s.sum(h, n), s.sum(l, n)
    y = where(a.ne(b), sqrt(1 - div(power(a, 0.25) * power(b, 0.25), sqrt((a + b) / 2))), 0.0)
    return vol(s, "Cfdv", y, None, s.ma(ma, s.x, n))


@indicator("Volatility")
def ProjectionOscillator(s, ma=WMA, n=14, smooth=4):
    b = s.run("ProjectionBands", n=n).outputs
    y = s.let(pct(s.x - b["LowerBand"], b["UpperBand"] - b["LowerBand"]))
    sig = s.ma(ma, y, smooth)
    return s.result({"Pbo": y, "Signal": sig}, s.volatile(s.x - s.ma(ma, s.x, n), sig, s.lag(sig, 1)))


@indicator("Volatility")
def ProjectionBandwidth(s, ma=WMA, n=14):
    b = s.run("ProjectionBands", n=n).outputs
    u, l = b["UpperBand"], b["LowerBand"]
    y = s.let(div((u - l) * 200, u + l))
    sig = s.ma(ma, y, n)
    return vol(s, "Pbw", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def DonchianChannelWidth(s, ma=SMA, n=20, smooth=22):
    h, l = s.range_of(s.x)
    y = s.let(s.max(h, n) - s.min(l, n))
    sig = s.ma(ma, y, smooth)
    return vol(s, "Dcw", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def StatisticalVolatility(s, ma=EMA, n=30, year=253):
    h, l = s.range_of(s.x)
    k = 0.6 * math.sqrt(year / n)
    y = s.let(clamp((log(div(s.max(s.x, n), s.min(s.x, n))) + log(div(s.max(h, n), s.min(l, n)))) * (k * 0.5), 2.99, 0))
    sig = s.ma(ma, y, n)
    return vol(s, "Sv", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def StandardDevation(s, ma=SMA, n=14):
    y = s.let(sqrt(s.ma(ma, sq(s.x), n) - sq(s.sum(s.x, n)) / n**2))
    sig = s.ma(ma, y, n)
    return vol(s, "Std", y, sig, s.ma(ma, s.x, n), Signal=sig)


@indicator("Volatility")
def VolatilityBasedMomentum(s, ma=WILDER, n1=22, n2=65):
    y = s.let(div(s.change(s.x, n1), s.atr(n2, ma)))
    sig = s.ma(ma, y, n1)
    return s.result({"Vbm": y, "Signal": sig}, s.compare(y - sig))


@indicator("Volatility")
def VolatilityQualityIndex(s, ma=SMA, fast=9, slow=200):
    h, l = s.range_of(s.x)
    d, b, r = s.let(s.x - s.lag(s.x, 1)), s.let(s.x - s.open), s.tr()
    ok = r.ne(0) & (h - l).ne(0)
    t = s.let(s.last((div(d, r) + div(b, h - l)) * 0.5, ok))
    y = s.sum(s.let(abs_(t) * (d + b) * 0.5))
    f, g = s.ma(ma, y, fast), s.ma(ma, y, slow)
    return s.result({"Vqi": y, "FastSignal": f, "SlowSignal": g}, s.compare(y - f))


@indicator("Volatility")
def SigmaSpikes(s, ma=EMA, n=20):
    last = s.lag(s.x, 1)
    r = s.let(where(last.ne(0), div(s.x, last) - 1, 0.0))
    y = s.let(div(r, s.lag(s.sd(r, n, ma), 1)))
    sig = s.ma(ma, y, n)
    return s.result({"Ss": y, "Signal": sig}, s.compare(sig))


@indicator("Volatility")
def SurfaceRoughnessEstimator(s, ma=EMA, n=100):
    y = s.let(1 - (abs_(s.corr(s.lag(s.x, 1), s.x, n)) + 1) / 2)
    return vol(s, "Sre", y, s.ma(ma, y, n), s.ma(ma, s.x, n))


# ---- trailing stops ------------------------------------------------------------------------------


def flip(s, up, down, upper, lower):
    """A stop at `lower` once `up` held, at `upper` once `down` held."""
    side = s.rec(lambda y: where(up, 1.0, where(down, 0.0, y)))
    return s.let(side * lower + (1 - side) * upper)


def stop(s, key, y):
    return s.result({key: y}, s.compare(s.x - y))


@indicator("Trend")
def AdaptiveTrailingStop(s, n=100, factor=3.0):
    p = s.let(power(s.er(s.x, n), factor))
    a = s.rec(lambda y: mx(s.x, s.first(s.x, y)) - abs_(s.x - s.first(s.x, y)) * p)
    b = s.rec(lambda y: mn(s.x, s.first(s.x, y)) + abs_(s.x - s.first(s.x, y)) * p)
    pa, pb = s.let(s.first(s.x, s.lag(a, 1))), s.let(s.first(s.x, s.lag(b, 1)))
    up = s.rec(lambda y: where((a > pa) | ((a < pa) & (b < pb)), a, y))
    down = s.rec(lambda y: where((b < pb) | ((b > pb) & (a > pa)), b, y))
    side = s.rec(lambda y: where(up > s.x, 1.0, where(down > s.x, 0.0, y)))
    return stop(s, "Ts", s.let(side * down + (1 - side) * up))


@indicator("Trend")
def AdaptiveAutonomousRecursiveTrailingStop(s, n=14, gamma=3.0):
    m, d = _aarma(s, s.x, n, gamma)
    u, l = s.let(m + d), s.let(m - d)
    return stop(s, "Ts", flip(s, s.x > s.lag(u, 1), s.x < s.lag(l, 1), u, l))


@indicator("Trend")
def ParabolicSAR(s, start=0.02, increment=0.02, maximum=0.2):
    h, l = s.range_of(s.x)
    h1, l1, h2, l2 = s.lag(h, 1), s.lag(l, 1), s.lag(h, 2), s.lag(l, 2)
    up = s.x > s.lag(s.x, 1)
    sar = s.let(where(up, l1 + (h - l1) * start, h1 + (l - h1) * start))
    turn_down, turn_up = up & (sar > l), where(up, 0.0, 1.0).eq(1) & (sar < h)
    sar2 = where(turn_down, h, where(turn_up, l, sar))
    ep = where(turn_down, l, where(turn_up, h, where(up, h, l)))
    rising = s.let(where(turn_down, 0.0, where(turn_up, 1.0, where(up, 1.0, 0.0))))
    low, high = where(s.rn > 2, l2, l1), where(s.rn > 2, h2, h1)
    out = s.let(where(rising.eq(1), mn(sar2, low), mx(sar2, high)))
    y = s.let(out + (ep - out) * start)
    return s.result({"Sar": y}, s.compare(h - y))


@indicator("Trend")
def ChandelierExit(s, ma=WILDER, n=22, mult=3.0):
    h, l = s.range_of(s.x)
    a = s.let(s.atr(n, ma) * mult)
    long, short = s.let(s.max(h, n) - a), s.let(s.min(l, n) + a)
    return s.result({"ExitLong": long, "ExitShort": short}, s.both(s.x - long, s.x - short), None)


@indicator("Trend")
def AverageTrueRangeTrailingStops(s, ma=EMA, n1=63, n2=21, factor=3.0):
    a, e = s.let(s.atr(n2, ma) * factor), s.ma(ma, s.x, n1)
    return stop(s, "Atrts", s.rec(lambda y: where(s.x > e, mx(s.x - a, s.first(s.x, y)), mn(s.x + a, s.first(s.x, y)))))


def linear_tracker(s, n, mult):
    """(tracker, upper, lower): a line of slope 1/n at most, and bounds that hold while it rests."""
    k = 1 / n

    def step(a, b):
        p, q = s.first(s.x, a), where(s.rn > 2, b, s.x)
        t = s.x + (p - q) * mult
        return where(t > p + k, p + k, where(t < p - k, p - k, p))

    a = s.rec2(step)
    gap = s.let(abs_(a - s.first(s.x, s.lag(a, 1))) * mult)
    return a, s.rec(lambda y: where(gap.eq(0), y, a + gap)), s.rec(lambda y: where(gap.eq(0), y, a - gap))


@indicator("Trend")
def LinearTrailingStop(s, n=14, mult=28.0):
    _, u, l = linear_tracker(s, n, mult)
    return stop(s, "Ts", flip(s, s.x > u, s.x > l, u, l))


@indicator("Trend")
def NickRypockTrailingReverse(s, n=2):
    k = n * 0.01

    def step(o, new):
        hp, lp = mx(s.x, o["hp"]), mn(s.x, o["lp"])
        up = o["trend"] >= 0
        drop, rise = s.x <= hp * (1 - k), s.x > lp * (1 + k)
        new["nrtr"] = where(up, where(drop, s.x * (1 + k), hp * (1 - k)), where(rise, s.x * (1 - k), lp * (1 + k)))
        new["trend"] = where(up, where(drop, -1.0, 0.0), where(rise, 1.0, 0.0))
        new["hp"] = where(up, hp, where(rise, s.x, 0.0))
        new["lp"] = where(up, where(drop, s.x, 0.0), lp)

    return stop(s, "Nrtr", s.machine(dict.fromkeys(("nrtr", "trend", "hp", "lp"), 0.0), step)["nrtr"])


@indicator("Trend")
def KaseDevStopV1(s, ma=SMA, fast=5, slow=21, n=20, devs=(0.0, 1.0, 2.2, 3.6)):
    p = s.let(s.typical)
    c, l = s.lag(s.close, 2), s.lag(s.low, 2)
    r = s.let(mx(s.high - l, abs_(s.high - c), abs_(s.low - c)))
    a, f, g = s.ma(ma, r, n), s.ma(ma, p, fast), s.ma(ma, p, slow)
    d = s.sd(r, n, ma)
    y = [s.let(where(f < g, p + a + d * k, p - a - d * k)) for k in devs]
    return s.result({"Dev1": y[1], "Dev2": y[2], "Dev3": y[3], "WarningLine": y[0]}, s.compare(f - g), None)


@indicator("Trend")
def KaseDevStopV2(s, ma=SMA, fast=10, slow=21, n=20, devs=(0.0, 1.0, 2.2, 3.6)):
    h, l = s.range_of(s.x)
    up = s.ma(ma, s.x, fast) > s.ma(ma, s.x, slow)
    c = s.lag(s.x, 2)
    r = s.let(mx(h, s.lag(h, 1), c) - mn(l, s.lag(l, 1), c))
    a = s.ma(ma, r, n)
    d = s.sd(r, n, ma)
    p = s.let(where(up, h, l))
    y = [s.let((p - where(up, 1.0, -1.0)) * (a + d * k)) for k in devs]
    return s.result({f"Dev{k + 1}": v for k, v in enumerate(y)}, s.compare(p - y[3]), None)


@indicator("Trend")
def PercentageTrailingStops(s, n=100, share=10.0):
    h, l = s.range_of(s.x)
    ph, pl = s.let(s.first(s.x, s.lag(s.max(h, n), 1))), s.let(s.first(s.x, s.lag(s.min(l, n), 1)))
    long = s.rec(lambda y: where(h > ph, h - h * share, s.first(s.x, y)))
    short = s.rec(lambda y: where(l < pl, l + l * share, s.first(s.x, y)))
    return s.result({"LongStop": long, "ShortStop": short}, s.when((s.lag(h, 1) < short) & (h > short), (s.lag(l, 1) > long) & (l < long)), None)


@indicator("Trend")
def MotionToAttractionTrailingStop(s, n=14):
    b = s.run("MotionToAttractionChannels", n=n).outputs
    u, l = b["UpperBand"], b["LowerBand"]
    return stop(s, "Ts", flip(s, s.x > s.first(s.x, s.lag(u, 1)), s.x < s.first(s.x, s.lag(l, 1)), u, l))


@indicator("Trend")
def ElderSafeZoneStops(s, ma=EMA, n1=63, n2=22, n3=3, factor=2.5):
    h, l = s.range_of(s.x)
    e, ph, pl = s.ma(ma, s.x, n1), s.lag(h, 1), s.lag(l, 1)
    down, up = s.let(mx(pl - l, 0)), s.let(mx(h - ph, 0))

    def mean(v):
        return div(s.sum(v, n2), s.sum(s.let(where(v > 0, 1.0, 0.0)), n2))

    a, b = s.max(s.let(pl - mean(down) * factor), n3), s.min(s.let(ph + mean(up) * factor), n3)
    y = s.let(where(s.x >= e, a, b))
    return s.result({"Eszs": y}, s.both(s.x - mx(e, y), s.x - mn(e, y)))


@indicator("Trend")
def HalfTrend(s, ma=SMA, n=2, atr=100):
    h, l = s.range_of(s.x)
    a = s.let(s.atr(atr, ma) / 2)
    hi, lo, hm, lm = s.max(h, n), s.min(l, n), s.ma(ma, h, n), s.ma(ma, l, n)
    # what came before is the bar's own high and low, on the first row the rolling ones
    ph, pl = s.lag(hi, 1), s.lag(lo, 1)
    ml, mh = s.let(s.first(lo, pl)), s.let(s.first(hi, ph))

    def step(o, new):
        top, bottom = mx(lo, ml), mn(hi, mh)
        falls = o["next"].eq(1) & (hm < top) & (s.x < where(pl.ne(0), pl, lo))
        rises = o["next"].ne(1) & (lm > bottom) & (s.x > where(ph.ne(0), ph, hi))
        new["trend"] = where(falls, 1.0, 0.0)
        new["next"] = where(rises, 1.0, 0.0)
        base_low = where(rises, lo, where(o["next"].eq(1), top, ml))
        base_high = where(falls, hi, where(o["next"].eq(1), mh, bottom))
        new["up"] = where(new["trend"].eq(0), where(o["trend"].ne(0), o["down"], mx(base_low, o["up"])), 0.0)
        new["down"] = where(new["trend"].eq(0), 0.0, where(o["trend"].ne(1), o["up"], mn(base_high, o["down"])))
        new["arrow_up"] = where(new["trend"].eq(0) & o["trend"].ne(0), new["up"] - a, 0.0)
        new["arrow_down"] = where(new["trend"].ne(0) & o["trend"].ne(1), new["down"] + a, 0.0)

    m = s.machine(dict.fromkeys(("trend", "next", "up", "down", "arrow_up", "arrow_down"), 0.0), step)
    y = s.let(where(m["trend"].eq(0), m["up"], m["down"]))
    was = s.lag(m["trend"], 1)
    return s.result({"Ht": y}, s.when(m["arrow_up"].ne(0) & m["trend"].eq(0) & was.eq(1), m["arrow_down"].ne(0) & m["trend"].eq(1) & was.eq(0)))


# ---- volume --------------------------------------------------------------------------------------


def signalled(s, key, y, ma, n, name="Signal"):
    y = s.let(y)
    sig = s.ma(ma, y, n)
    return s.result({key: y, name: sig}, s.compare(y - sig))


def own_slope(s, key, y):
    y = s.let(y)
    return s.result({key: y}, s.compare(y - s.lag(y, 1)))


def plain(s, key, y, **more):
    y = s.let(y)
    return s.result({key: y} | more, s.compare(y))


def signed_volume(s, x, k=1):
    return s.sum(s.let(s.volume * sign(s.let(x - s.lag(x, k)))))


def flow(s):
    h, l = s.range_of(s.x)
    return s.let(div(s.x - l - (h - s.x), h - l) * s.volume)


def percent_index(s, falling):
    last, v = s.lag(s.x, 1), s.lag(s.volume, 1)
    step = where(s.volume < v if falling else s.volume > v, div((s.x - last) * 100, abs_(last)), 0.0)
    return s.let(s.sum(s.let(step)) + 1000)


@indicator("Volume")
def ForceIndex(s, ma=EMA, n=14):
    return own_slope(s, "Fi", s.ma(ma, s.change(s.x) * s.volume, n))


def mfi(s, n):
    p = s.run("TypicalPrice").value
    f, last = s.let(p * s.volume), s.lag(p, 1)
    up, down = s.sum(s.let(where((s.rn > 1) & (p > last), f, 0.0)), n), s.sum(s.let(where((s.rn > 1) & (p < last), f, 0.0)), n)
    return s.let(rsi_of(up, down))


@indicator("Volume")
def MoneyFlowIndex(s, n=14):
    return turned(s, "Mfi", mfi(s, n), 80, 20)


@indicator("Volume")
def KlingerVolumeOscillator(s, ma=EMA, fast=34, slow=55, signal=13):
    h, l = s.range_of(s.x)
    d, m = s.let(h - l), s.let(s.change(s.x))
    t = s.rec(lambda y: where(m > 0, 1.0, where(m < 0, -1.0, y)))
    pt, pd = s.lag(t, 1), s.lag(d, 1)
    c = s.rec(lambda y: where(t.eq(pt), y + d, pd + d))
    f = s.let(s.volume * where(c.ne(0), abs_(div(d, c) * 2 - 1), -1.0) * t * 100)
    r = lines(s, "Kvo", s.ma(ma, f, fast) - s.ma(ma, f, slow), ma, signal)
    return s.result({"Kvo": r.outputs["Kvo"], "KvoSignal": r.outputs["Signal"], "KvoHistogram": r.outputs["Histogram"]}, r.signal)


@indicator("Volume")
def OnBalanceVolume(s, ma=EMA, n=20):
    return signalled(s, "Obv", signed_volume(s, s.x), ma, n, "ObvSignal")


@indicator("Volume")
def NegativeVolumeIndex(s, ma=EMA, n=255):
    return signalled(s, "Nvi", percent_index(s, True), ma, n, "NviSignal")


@indicator("Volume")
def PositiveVolumeIndex(s, ma=EMA, n=255):
    return signalled(s, "Pvi", percent_index(s, False), ma, n, "PviSignal")


@indicator("Volume")
def ChaikinMoneyFlow(s, n=20):
    return own_slope(s, "Cmf", div(s.sum(flow(s), n), s.sum(s.volume, n)))


@indicator("Volume")
def AccumulationDistributionLine(s, ma=EMA, n=14):
    return signalled(s, "Adl", s.sum(flow(s)), ma, n, "AdlSignal")


@indicator("Volume")
def AverageMoneyFlowOscillator(s, ma=WMA, n=5, smooth=3):
    c = s.ma(ma, s.change(s.x), n)
    r = s.let(log(abs_(s.ma(ma, s.volume, n) * c)) * sign(c))
    h, l = s.max(r, n), s.min(r, n)
    return plain(s, "Amfo", s.ma(ma, div((r - l) * 200, h - l) - 100, smooth))


@indicator("Volume")
def BuffAverage(s, fast=5, slow=20):
    p = s.let(s.x * s.volume)
    a, b = (s.let(div(s.sum(p, n), s.sum(s.volume, n))) for n in (fast, slow))
    return s.result({"FastBuff": a, "SlowBuff": b}, s.compare(a - b), None)


@indicator("Volume")
def UpsideDownsideVolume(s, n=50):
    last = s.lag(s.x, 1)
    up, down = s.sum(s.let(where(s.x > last, s.volume, 0.0)), n), s.sum(s.let(where(s.x < last, -s.volume, 0.0)), n)
    return plain(s, "Udv", div(up, down))


@indicator("Volume")
def EaseOfMovement(s, ma=SMA, n=14, divisor=1000000.0):
    h, l = s.range_of(s.x)
    r = s.let((h - l) * 0.5)
    m = s.let(r - s.lag(r, 1))
    y = s.let(div((m - s.lag(m, 1)) * divisor, div(s.volume, h - l)))
    a = s.ma(ma, y, n)
    return s.result({"Eom": y}, s.compare(y - s.ma(ma, a, n)))


@indicator("Volume")
def OnBalanceVolumeModified(s, ma=EMA, n1=7, n2=10):
    return signalled(s, "Obvm", s.ma(ma, signed_volume(s, s.x), n1), ma, n2)


@indicator("Volume")
def OnBalanceVolumeReflex(s, ma=SMA, n=4, signal=14):
    return signalled(s, "Obvr", signed_volume(s, s.x, n), ma, signal)


def _disparity(s, key, o, ma, n, signal, top, bottom):
    om = s.ma(ma, o, n)
    m = s.ma(ma, s.x, n)
    d = s.sd(m, n, ma)  # of the average; the second one of the volume's line
    od = s.sd(o, n, ma)
    a = div(s.x - (m - d * 2), s.x + d * 2 - (m - d * 2))
    b = s.let(div(o - (om - od * 2), od * 4))
    y = s.let(div(a + 1, b + 1))
    sig = s.ma(ma, y, signal)
    p = s.lag(y, 1)
    side = s.rec(lambda v: where(((p < bottom) & (y > bottom)) | (y > sig), 1.0, where(((p > top) & (y < top)) | (y < bottom), -1.0, v)))
    return s.result({key: y, "Signal": sig}, s.compare(side))


@indicator("Volume")
def OnBalanceVolumeDisparityIndicator(s, ma=SMA, n=33, signal=4, top=1.1, bottom=0.9):
    return _disparity(s, "Obvdi", signed_volume(s, s.x), ma, n, signal, top, bottom)


@indicator("Volume")
def NegativeVolumeDisparityIndicator(s, ma=SMA, n=33, signal=4, top=1.1, bottom=0.9):
    return _disparity(s, "Nvdi", percent_index(s, True), ma, n, signal, top, bottom)


@indicator("Volume")
def HawkeyeVolumeIndicator(s, n=200, divisor=3.6):
    p, r, c, v = s.lag(s.mid, 1), s.let(s.high - s.low), s.close, s.volume
    ph, pl = s.lag(s.high, 1), s.lag(s.low, 1)
    va, ra = s.avg(v, n), s.avg(r, n)
    u, d = p + (ph - pl) / divisor, p - (ph - pl) / divisor
    red = ((r > ra) & (c < d) & (v > va)) | (c < p)
    green = (c > p) | ((r > ra) & (c > u) & (v > va)) | ((s.high > ph) & (r < ra / 1.5) & (v < va)) | ((s.low < pl) & (r < ra / 1.5) & (v > va))
    return s.result({"Up": s.let(u), "Dn": s.let(d)}, s.when(green, red), None)


@indicator("Volume")
def HerrickPayoffIndex(s, point=100.0):
    p, last = s.let(s.mid), s.lag(s.mid, 1)
    g = s.let(mn(s.open, s.lag(s.open, 1)))
    half = div(abs_(s.close - s.lag(s.close, 1)) / 2, g)
    y = s.let(s.change(p) * point * s.volume * where(g.ne(0), where(p < last, 1 - half, half + 1), 1.0))
    return plain(s, "Hpi", y)


@indicator("Volume")
def FiniteVolumeElements(s, ma=SMA, n=22, factor=0.3):
    p = s.let((s.high + s.low + s.mid) / 3)  # a typical price with the median price as its close
    m = s.let(s.x - s.mid + p - s.lag(p, 1))
    v = where(m > s.x * (factor / 100), s.volume, where(m < s.x * (-factor / 100), -s.volume, 0.0))
    y = s.sum(s.let(div(v, s.ma(ma, s.volume, n)) * (100 / n)))
    a, b = s.lag(y, 1), s.lag(y, 2)
    return s.result({"Fve": y}, s.both(y - mx(a, b), y - mn(a, b)))


def _relative_volume(s, ma, n):
    m = s.ma(ma, s.volume, n)
    return s.let(div(s.volume - m, s.sd(s.volume, n, ma)))


def _sticky(s, key, y):
    last = s.lag(s.x, 1)
    d = s.rec(lambda v: where(y >= 2, last, s.first(s.x, v)))
    return s.result({key: y, "Dpl": d}, s.compare(s.x - d))


@indicator("Volume")
def RelativeVolumeIndicator(s, ma=SMA, n=60):
    return _sticky(s, "Rvi", _relative_volume(s, ma, n))


@indicator("Volume")
def FreedomOfMovement(s, ma=SMA, n=60):
    v, a = _relative_volume(s, ma, n), s.let(abs_(div(s.change(s.x), s.lag(s.x, 1))))

    def scaled(e):
        h, l = s.max(e, n), s.min(e, n)
        return div((e - l) * 9 + 1, h - l)

    b = s.let(div(scaled(v), scaled(a)))
    return _sticky(s, "Fom", s.let(div(b - s.avg(b, n), s.sd(b, n, ma))))


@indicator("Volume")
def VolumePriceConfirmationIndicator(s, ma=SMA, fast=5, slow=20, n=8):
    y = (s.ma(VWMA, s.x, slow) - s.ma(ma, s.x, slow)) * div(s.ma(VWMA, s.x, fast), s.ma(ma, s.x, fast)) * div(s.ma(ma, s.volume, fast), s.ma(ma, s.volume, slow))
    return signalled(s, "Vpci", y, ma, n)


@indicator("Volume")
def VolumePositiveNegativeIndicator(s, ma=EMA, n=30, smooth=3):
    m = s.ma(ma, s.volume, n)
    c = s.let(s.atr(n, ma, m) * 0.1)
    d = s.let(s.typical - s.lag(s.typical, 1))
    v = s.let(where(d > c, s.volume, where(d < -c, -s.volume, 0.0)))
    y = s.let(div(s.sum(v, n), where(m > 0, m, 1.0)) * (100 / n))
    sig = s.ma(ma, y, smooth)
    return s.result({"Vpni": y, "Signal": sig}, s.compare(sig))


@indicator("Volume")
def VolumeAccumulationOscillator(s, n=14):
    h, l = s.range_of(s.x)
    m = (h + l) / 2
    return plain(s, "Vao", s.avg(s.let(where(s.x.ne(m), s.volume * (s.x - m), s.volume)), n))


@indicator("Volume")
def VolumeAccumulationPercent(s, n=10):
    return plain(s, "Vapc", clamp(pct(s.sum(flow(s), n), s.sum(s.volume, n)), 100, 0))


@indicator("Volume")
def VolumeFlowIndicator(s, ma=SMA, n1=130, n2=30, signal=5, smooth=3, coef=0.2, vcoef=2.5):
    p = s.let(s.typical)
    last, d = s.lag(p, 1), s.let(s.change(p))
    a = s.ma(ma, s.volume, n1)
    r = s.let(where((p > 0) & (last > 0), log(p) - log(last), 0.0))
    cut = s.let(s.close * s.sd(r, n2, ma) * coef)
    v = s.let(mn(s.volume, s.lag(a, 1) * vcoef))
    f = s.let(where(d > cut, v, where(d < -cut, -v, v * sign(d))))
    y = s.ma(ma, div(s.sum(f, n1), a), smooth)
    return lines(s, "Vfi", y, EMA, signal)


@indicator("Volume")
def PriceVolumeOscillator(s, n1=50, n2=14):
    a, b = s.let(s.change(s.x, n1)), s.let(s.change(s.volume, n2))
    p, v = s.let(div(s.sum(a, n1), s.sum(s.let(abs_(a)), n1))), s.let(div(s.sum(b, n2), s.sum(s.let(abs_(b)), n2)))
    return s.result({"Po": p, "Vo": v}, s.when((p > 0) & (v > 0), (p < 0) & (v > 0)), None)


@indicator("Volume")
def PriceVolumeRank(s, ma=SMA, fast=5, slow=10):
    up, more = s.x > s.lag(s.x, 1), s.volume > s.lag(s.volume, 1)
    y = s.let(where(up, where(more, 1.0, 2.0), where(more, 4.0, 3.0)))
    a, b = s.ma(ma, y, fast), s.ma(ma, y, slow)
    return s.result({"Pvr": y, "SlowSignal": b, "FastSignal": a}, s.compare(a - b))


@indicator("Volume")
def TwiggsMoneyFlow(s, ma=EMA, n=21):
    h, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    h, l = mx(h, last), mn(l, last)
    y = s.ma(ma, div(s.x - l - (h - s.x), h - l) * s.volume, n)
    v = s.ma(ma, s.volume, n)
    return turned(s, "Tmf", where(v.ne(0), clamp(div(y, v), 1, -1), 0.0), 0.2, -0.2)


@indicator("Volume")
def TradeVolumeIndex(s, ma=SMA, n=14, tick=0.5):
    d = s.let(s.x - s.lag(s.x, 1))
    return signalled(s, "Tvi", s.sum(s.let(where(d > tick, s.volume, where(d < -tick, -s.volume, 0.0)))), ma, n)


@indicator("Volume")
def TFSVolumeOscillator(s, n=7):
    return plain(s, "Tfsvo", s.sum(s.let(s.volume * sign(s.let(s.x - s.open))), n) / n)


@indicator("Volume")
def MarketFacilitationIndex(s):
    h, l = s.range_of(s.x)
    y = s.let(div(h - l, s.volume))
    return s.result({"Mi": y}, s.when(y > s.lag(y, 1), s.volume > s.lag(s.volume, 1)))


@indicator("Volume")
def MultiVoteOnBalanceVolume(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    votes = lit(0.0)
    for e in (h, l, s.x):
        votes = votes + sign(s.let(e - s.lag(e, 1)))
    return signalled(s, "Mvo", s.sum(s.let(s.volume * votes / 1000000)), ma, n)


__all__ = ["against", "flip", "linear_tracker", "mfi", "own_slope", "plain", "signalled", "signed_volume", "vol"]
