"""Digital filters and cycle measures."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, atan, clamp, div, exp, lit, log, mn, mx, rsi_of, sign, sq, sqrt, where

from .averages import ROOT2, _unit, laguerre, mama
from .momentum import against, pct, place, turned
from .oscillators import cci, two
from .registry import EMA, SMA, WMA, average, indicator, length
from .volatility import own_slope, plain, signalled

PI = math.pi
HANN, SSF1, SSF2 = "EhlersHannMovingAverage", "Ehlers2PoleSuperSmootherFilterV1", "Ehlers2PoleSuperSmootherFilterV2"


def _alpha(w):
    """The pole of a first-order filter with critical angle w."""
    return (math.cos(w) + math.sin(w) - 1) / math.cos(w)


def _pair(n, limit=True, root=ROOT2):
    """(b, c) of a two-pole smoother of length n."""
    a = math.exp(-root * PI / n)
    w = root * PI / n
    return 2 * a * math.cos(min(w, 0.99) if limit else w), -a * a


def smoothed(s, x, b, c):
    """Two-pole smoothing of the mean of x and the x before it."""
    x = s.let(x)
    u = s.let((x + s.lag(x, 1)) / 2 * (1 - b - c))
    return s.rec2(lambda y, z: u + y * b + z * c)


def curve(s, x):
    return s.let(x - s.lag(x, 1) * 2 + s.lag(x, 2))


def high_pass(s, x, a):
    """Two-pole high-pass with pole 1 - a."""
    u = s.let(curve(s, s.let(x)) * (1 - a / 2) ** 2)
    return s.rec2(lambda y, z: u + y * (2 * (1 - a)) - z * (1 - a) ** 2)


def high_pass1(s, x, n, mult=1.0):
    return high_pass(s, x, _alpha(_unit(2 * PI / (mult * n * math.sqrt(2)))))


def roofing1(s, x, n1, n2, ma=SSF1):
    h = high_pass1(s, x, n1)
    return s.ma(ma, (h + s.lag(h, 1)) / 2, n2)


def _roof2(s, x, upper, lower):
    a = _alpha(min(ROOT2 * PI / upper, 0.99))
    u = s.let(curve(s, s.let(x)) * ((1 - a) / 2) ** 2)
    return smoothed(s, s.rec2(lambda y, z: u + y * (2 * (1 - a)) - z * (1 - a) ** 2), *_pair(lower))


@indicator("Cycle")
def EhlersRoofingFilterV2(s, upper=80, lower=40):
    return own_slope(s, "Erf", _roof2(s, s.x, upper, lower))


@indicator("Cycle")
def EhlersRoofingFilterV1(s, ma=SSF1, n1=48, n2=10):
    return plain(s, "Erf", roofing1(s, s.x, n1, n2, ma))


@indicator("Cycle")
def EhlersHighPassFilterV1(s, n=125, mult=1.0):
    return plain(s, "Hp", high_pass1(s, s.x, n, mult))


def high_pass2(s, x, n, ma):
    a = math.exp(-ROOT2 * PI / n)
    b, c = 2 * a * math.cos(ROOT2 * PI / n), -a * a
    u = s.let(curve(s, s.let(x)) * ((1 + b - c) / 4))
    return s.ma(ma, s.ma(ma, s.rec2(lambda y, z: where(s.rn <= 4, 0.0, u + y * b + z * c)), n), n)


@indicator("Cycle")
def EhlersHighPassFilterV2(s, ma=WMA, n=20):
    return own_slope(s, "Ehpf", high_pass2(s, s.x, n, ma))


@indicator("Cycle")
def EhlersDecyclerOscillatorV2(s, ma=WMA, fast=10, slow=20):
    a = high_pass2(s, s.x, fast, ma)
    return plain(s, "Edo", high_pass2(s, a, slow, ma) - a)


@indicator("Cycle")
def EhlersDecyclerOscillatorV1(s, fast=100, slow=125, fast_mult=1.2, slow_mult=1.0):
    d = s.let(s.x - high_pass1(s, s.x, fast))
    c = s.let(d - high_pass1(s, d, slow))  # the second decycler reads the first
    a, b = high_pass1(s, d, fast, 0.5), high_pass1(s, c, slow, 0.5)
    a, b = s.let(pct(a * fast_mult, s.x)), s.let(pct(b * slow_mult, s.x))
    return s.result({"FastEdo": a, "SlowEdo": b}, s.compare(b - a), None)


@indicator("Cycle")
def EhlersSimpleDecycler(s, n=125, up=0.5, down=0.5):
    d = s.let(s.x - high_pass1(s, s.x, n))
    return s.result({"UpperBand": s.let(d * (1 + up / 100)), "MiddleBand": d, "LowerBand": s.let(d * (1 - down / 100))}, s.compare(s.x - d), "MiddleBand")


@indicator("Cycle")
def EhlersDecycler(s, n=60):
    a = _alpha(min(2 * PI / n, 0.99))
    u = s.let((s.x + s.lag(s.x, 1)) * (a / 2))
    d = s.rec(lambda y: u + y * (1 - a))
    return s.result({"Ed": d}, s.compare(s.x - d))


def _high1(s, x, n):
    a = _alpha(min(2 * PI / n, 0.99))
    u = s.let(s.change(x) * (1 - a / 2))
    return s.rec(lambda y: u + y * (1 - a)), a


@indicator("Cycle")
def EhlersHpLpRoofingFilter(s, n1=48, n2=10):
    return own_slope(s, "Ehplprf", smoothed(s, _high1(s, s.x, n1)[0], *_pair(n2)))


@indicator("Cycle")
def EhlersZeroMeanRoofingFilter(s, n1=48, n2=10):
    h, a = _high1(s, s.x, n1)
    f = smoothed(s, h, *_pair(n2))
    u = s.let((f - s.lag(f, 1)) * (1 - a / 2))
    return own_slope(s, "Ezmrf", s.rec(lambda y: u + y * (1 - a)))


@indicator("Cycle")
def EhlersRoofingFilterIndicator(s, n1=80, n2=40):
    return own_slope(s, "Erfi", smoothed(s, high_pass(s, s.x, _alpha(min(ROOT2 * PI / n1, 0.99))), *_pair(n2)))


@indicator("Cycle")
def EhlersModifiedStochasticIndicator(s, ma=SSF1, n1=48, n2=10, n3=20):
    f = roofing1(s, s.x, n1, n2, ma)
    h, l = s.max(f, n3), s.min(f, n3)
    return turned(s, "Emsi", smoothed(s, pct(f - l, h - l), *_pair(n1)), 70, 30)


@indicator("Cycle")
def EhlersModifiedRelativeStrengthIndex(s, n1=48, n2=10, n3=10):
    b, c = _pair(n2)
    f = _roof2(s, s.x, n1, n2)
    d = s.let(f - s.lag(f, 1))
    up, den = s.sum(s.let(mx(d, 0)), n3), s.let(abs_(d))
    pu, pd = s.lag(up, 1), s.lag(den, 1)
    u = s.let((div(up, den) + div(pu, pd)) / 2 * (1 - b - c))
    m = s.rec2(lambda y, z: where(den.ne(0) & pd.ne(0), u + y * b + z * c, 0.0))
    return against(s, "Emrsi", m, smoothed(s, m, b, c), 0.7, 0.3)


@indicator("Cycle")
def EhlersRocketRelativeStrengthIndex(s, ma=SSF2, n1=10, n2=8, level=2.0, mult=1.0):
    m = s.let(s.change(s.x, n1 - 1))
    f = s.ma(ma, (m + s.lag(m, 1)) / 2, n2)
    d = s.let(f - s.lag(f, 1))
    up, down = s.sum(s.let(mx(d, 0)), n1), s.sum(s.let(mx(-d, 0)), n1)
    t = s.rec(lambda y: where((up + down).ne(0), clamp(div(up - down, up + down), 0.999, -0.999), y))
    return turned(s, "Errsi", log(div(t + 1, 1 - t)) * (0.5 * mult), level * mult, -level * mult)


def tap_corr(s, x, taps):
    """Correlation of the last rows, missing ones as 0, with fixed taps."""
    n = len(taps)
    sy, syy = sum(taps), sum(t * t for t in taps)
    sx, sxx = s.sum(x, n), s.sum(s.let(sq(x)), n)
    sxy = s.fir(x, taps, 1.0)
    vx, vy = s.let(sxx * n - sx * sx), n * syy - sy * sy
    return s.let(where(vx > sxx * (n * 1e-13), div(sxy * n - sx * sy, sqrt(vx) * math.sqrt(vy)), 0.0)) if vy > 0 else lit(0.0)


@indicator("Cycle")
def EhlersCorrelationTrendIndicator(s, n=20):
    return turned(s, "Ecti", tap_corr(s, s.x, [-float(j) for j in range(n)]), 0.5, -0.5)


def _cycle_corr(s, n):
    v = [_unit(2 * PI * j / n) if j else 0.01 for j in range(n)]
    return tap_corr(s, s.x, [math.cos(e) for e in v]), tap_corr(s, s.x, [-math.sin(e) for e in v])


@indicator("Cycle")
def EhlersCorrelationCycleIndicator(s, n=20):
    return two(s, "Real", "Imag", *_cycle_corr(s, n))


def _angle(s, n):
    re, im = _cycle_corr(s, n)
    a = s.let(where(im.ne(0), atan(div(re, im)) * (180 / PI) + 90, 90.0))
    a = s.let(where(im > 0, a - 180, a))
    return s.rec(lambda y: where((y - a < 270) & (a < y), y, a))


@indicator("Cycle")
def EhlersCorrelationAngleIndicator(s, n=20):
    return plain(s, "Cai", _angle(s, n))


@indicator("Cycle")
def EhlersMarketStateIndicator(s, n=20):
    a = _angle(s, n)
    near = abs_(a - s.lag(a, 1)) < 9
    return plain(s, "Emsi", where(near & (a < 0), -1.0, where(near & (a >= 0), 1.0, 0.0)))


@indicator("Cycle")
def EhlersRelativeVigorIndex(s, ma=SMA, n=10, signal=4):
    h, l = s.range_of(s.x)
    return signalled(s, "Ervi", s.ma(ma, div(s.x - s.open, h - l), n), ma, signal)


def gravity(s, x, n):
    x = s.let(x)
    den = s.sum(x, n)
    return s.let(where(den.ne(0), div(-s.fir(x, [float(j + 1) for j in range(n)], 1.0), den) + (n + 1) / 2, 0.0))


@indicator("Cycle")
def EhlersCenterofGravityOscillator(s, n=10):
    return plain(s, "Ecog", gravity(s, s.x, n))


def four(s, v):
    return s.let((v * 4 + s.lag(v, 1) * 3 + s.lag(v, 2) * 2 + s.lag(v, 3)) / 10)


@indicator("Cycle")
def EhlersStochasticCenterOfGravityOscillator(s, n=8):
    v = s.let((four(s, place(s, gravity(s, s.x, n), n, 1.0)) - 0.5) * 2)
    t = s.let(clamp((s.lag(v, 1) + 0.02) * 0.96, 1, 0))
    return turned(s, "Escog", t, 0.8, 0.2)


def soft(s, x):
    return s.let((x + s.lag(x, 1) * 2 + s.lag(x, 2) * 2 + s.lag(x, 3)) / 6)


def cyber(s, x, alpha, seeded=True):
    """(cycle, start): a two-pole high-pass of the softened input, and the plain curvature of the first rows."""
    x = s.let(x)
    start = s.let(curve(s, x) / 4)
    u = s.let(curve(s, soft(s, x)) * (1 - alpha / 2) ** 2)
    k, q = 2 * (1 - alpha), (1 - alpha) ** 2
    return s.rec2(lambda y, z: where(s.rn <= 7, start, u + y * k - z * q) if seeded else u + y * k - z * q), start


@indicator("Cycle")
def EhlersCyberCycle(s, alpha=0.07):
    return own_slope(s, "Ecc", cyber(s, s.x, alpha)[0])


@indicator("Cycle")
def EhlersSimpleCycleIndicator(s, alpha=0.07):
    c, start = cyber(s, s.x, alpha, False)
    return own_slope(s, "Esci", where(s.rn <= 7, start, c))


@indicator("Cycle")
def EhlersStochasticCyberCycle(s, n=14, alpha=0.7):
    v = s.let(clamp((four(s, place(s, cyber(s, s.x, alpha)[0], n, 1.0)) - 0.5) * 2, 1, -1))
    return against(s, "Escc", v, s.let(clamp((s.lag(v, 1) + 0.02) * 0.96, 1, -1)), 0.5, -0.5)


def adaptive_cycle(s, n=5, alpha=0.07):
    """(adaptive cycle, period): the period follows the median of phase changes over n rows."""
    c, start = cyber(s, s.x, alpha)
    raw, i = s.let(c * 0.0962 + s.lag(c, 2) * 0.5769 - s.lag(c, 4) * 0.5769 - s.lag(c, 6) * 0.0962), s.lag(c, 3)
    med = ["dp", *(f"d{k}" for k in range(1, n))]

    def step(o, new):
        new["q"] = raw * (o["ip"] * 0.08 + 0.5)
        ok = new["q"].ne(0) & o["q"].ne(0)
        top = div(i, new["q"]) - div(o["i"], o["q"])
        new["dp"] = clamp(where(ok, div(top, 1 + div(i * o["i"], new["q"] * o["q"])), 0.0), 1.1, 0.1)
        new["i"] = i
        for k in range(n - 1, 1, -1):
            new[f"d{k}"] = o[f"d{k - 1}"]
        new["d1"] = o["dp"]
        # the median of five by smallest and largest: with fewer rows the missing ones are left out
        new["m"] = _median([new[k] for k in med], s.rn)
        new["ip"] = where(new["m"].ne(0), div(6.28318, new["m"]) + 0.5, 15.0) * 0.33 + o["ip"] * 0.67
        new["p"] = new["ip"] * 0.15 + o["p"] * 0.85

    m = s.machine(dict.fromkeys(("q", "i", *med, "m", "ip", "p"), 0.0), step)
    a = s.let(div(2, m["p"] + 1))
    k = curve(s, soft(s, s.x))
    ac = s.rec2(lambda y, z: where(s.rn <= 7, start, sq(1 - a * 0.5) * k + (1 - a) * 2 * y - sq(1 - a) * z))
    return ac, m["p"]


def _median(v, rn):
    """Median of the first min(rn, 5) of five expressions."""
    a, b, c, d, e = v

    def three(x, y, z):
        return mx(mn(x, y), mn(mx(x, y), z))

    # of five: the middle one of e, the larger minimum and the smaller maximum of the two pairs
    five = three(e, mx(mn(a, b), mn(c, d)), mn(mx(a, b), mx(c, d)))
    four_ = (a + b + c + d - mx(a, b, c, d) - mn(a, b, c, d)) / 2
    return where(rn <= 1, a, where(rn <= 2, (a + b) / 2, where(rn <= 3, three(a, b, c), where(rn <= 4, four_, five))))


@indicator("Cycle")
def EhlersAdaptiveCyberCycle(s, n=5, alpha=0.07):
    ac, p = adaptive_cycle(s, n, alpha)
    return s.result({"Eacc": ac, "Period": p}, s.compare(ac - s.lag(ac, 1)))


@indicator("Momentum")
def DominantCycleTunedRelativeStrengthIndex(s, n=5):
    p = adaptive_cycle(s, n)[1]
    k, last = s.let(where(p.ne(0), div(1, p), 0.07)), s.lag(s.x, 1)
    up, down = s.let(where(s.x > last, s.x - last, 0.0)), s.let(where(s.x < last, last - s.x, 0.0))
    a, b = s.smooth(up, k, seed=up), s.smooth(down, k, seed=down)
    return turned(s, "DctRsi", rsi_of(a, b), 70, 30)


def _flex(s, n, slope):
    a = math.exp(-ROOT2 * PI / 0.5 * n)  # the length multiplies here, so the smoother hardly smooths
    b, c = 2 * a * math.cos(ROOT2 * PI / 0.5 * n), -a * a
    f = smoothed(s, s.x, b, c)
    tilt = (s.lag(f, n) - f) * ((n + 1) / 2) if slope else lit(0.0)
    back = lit(0.0)
    for j in range(1, n + 1):
        back = back + s.lag(f, j)
    d = s.let((f * n + tilt - back) / n)
    m = s.smooth(sq(d), 0.04)
    return where(m > 0, div(d, sqrt(m)), 0.0)


@indicator("Cycle")
def EhlersReflexIndicator(s, n=20):
    return own_slope(s, "Eri", _flex(s, n, True))


@indicator("Cycle")
def EhlersTrendflexIndicator(s, n=20):
    return plain(s, "Eti", _flex(s, n, False))


def band_pass(s, x, n, bw=None, delta=None, rows=0):
    """Two-pole band-pass around period n."""
    l = math.cos(_unit(2 * PI / n))
    g = math.cos(_unit((bw * 2 if delta is None else 4 * delta) * PI / n))
    a = 1 / g - math.sqrt(1 / g**2 - 1)
    x = s.let(x)
    u = s.let((x - s.lag(x, 2) if rows else s.change(x, 2)) * (0.5 * (1 - a)))
    return s.rec2(lambda y, z: where(s.rn <= rows, 0.0, u + y * (l * (1 + a)) - z * a) if rows else u + y * (l * (1 + a)) - z * a)


@indicator("Cycle")
def EhlersBandPassFilterV2(s, n=20, bw=0.3):
    return own_slope(s, "Ebpf", band_pass(s, s.x, n, bw, rows=3))


@indicator("Cycle")
def EhlersCycleBandPassFilter(s, n=20, delta=0.1):
    return own_slope(s, "Ecbpf", band_pass(s, s.x, n, delta=delta))


@indicator("Cycle")
def EhlersImpulseResponse(s, ma=HANN, n=20, bw=1.0):
    return own_slope(s, "Eir", s.ma(ma, band_pass(s, s.x, n, bw, rows=3), length(math.ceil(n / 1.4))))


def _band1(s, n, bw):
    def pole(k):
        return _alpha(_unit(k * bw * 2 * PI / n))

    a2, a3 = pole(0.25), pole(1.5)
    g = 1 / math.cos(_unit(2 * PI * bw / n))
    a1, beta = g - math.sqrt(g * g - 1), math.cos(_unit(2 * PI / n))
    u = s.let(s.change(s.x) * (1 + a2 / 2))
    h = s.rec(lambda y: u + y * (1 - a2))
    v = s.let((h - s.lag(h, 2)) * (0.5 * (1 - a1)))
    b = s.rec2(lambda y, z: where(s.rn > 3, v + y * (beta * (1 + a1)) - z * a1, 0.0))
    peak = s.rec(lambda y: mx(y * 0.991, abs_(b)))
    sig = s.let(div(b, peak))
    w = s.let((sig - s.lag(sig, 1)) * (1 + a3 / 2))
    return b, sig, s.rec(lambda y: w + y * (1 - a3))


@indicator("Cycle")
def EhlersBandPassFilterV1(s, n=20, bw=0.3):
    b, sig, trigger = _band1(s, n, bw)
    return s.result({"Ebpf": sig, "Signal": trigger}, s.compare(sig - trigger))


@indicator("Cycle")
def EhlersZeroCrossingsDominantCycle(s, n=20, bw=0.7):
    _, real, trigger = _band1(s, n, bw)
    last = s.lag(real, 1)
    cross = ((real > 0) & (last <= 0)) | ((real < 0) & (last >= 0))

    def step(o, new):
        count = o["count"] + 1
        new["dc"] = where(cross, clamp(count * 2, o["dc"] * 1.25, o["dc"] * 0.8), mx(o["dc"], 6))
        new["count"] = where(cross, 0.0, count)

    return s.result({"Ezcdc": s.machine({"dc": 0.0, "count": 0.0}, step)["dc"]}, s.compare(real - trigger))


def _extraction(s, ma, n, delta):
    g = 1 / math.cos(4 * PI * delta / n)
    beta, a = max(math.cos(2 * PI / n), 0.99), max(g - math.sqrt(g * g - 1), 0.99)
    u = s.let(s.change(s.x, 2) * (0.5 * (1 - a)))
    b = s.rec2(lambda y, z: u + y * (beta * (1 + a)) - z * a)
    return s.ma(ma, b, 2 * n), b


@indicator("Cycle")
def EhlersTrendExtraction(s, ma=SMA, n=20, delta=0.1):
    t, b = _extraction(s, ma, n, delta)
    return s.result({"Trend": t, "Bp": b}, s.compare(t))


@indicator("Cycle")
def EhlersEmpiricalModeDecomposition(s, ma=SMA, n1=20, n2=50, delta=0.5, fraction=0.1):
    t, b = _extraction(s, ma, n1, delta)
    b1, b2 = s.lag(b, 1), s.lag(b, 2)
    peak = s.rec(lambda y: where((b1 > b) & (b1 > b2), b1, y))
    valley = s.rec(lambda y: where((b1 < b) & (b1 < b2), b1, y))
    p, v = s.let(s.ma(ma, peak, n2) * fraction), s.let(s.ma(ma, valley, n2) * fraction)
    return s.result({"Trend": t, "Peak": p, "Valley": v}, s.both(t - mx(p, v), t - mn(p, v)), None)


@indicator("Cycle")
def EhlersEarlyOnsetTrendIndicator(s, n1=30, n2=100, k=0.85):
    f = s.ma("EhlersSuperSmootherFilter", high_pass1(s, s.x, n2), n1)
    peak = s.rec(lambda y: mx(abs_(f), y * 0.991))
    r = s.let(div(f, peak))
    return plain(s, "Eoti", div(r + k, r * k + 1))


@indicator("Cycle")
def EhlersUniversalOscillator(s, ma=EMA, n=20, signal=9):
    a = math.exp(-_unit(1.414 * PI / n))
    w = s.let(s.change(s.x, 2) / 2)
    f = smoothed(s, w, 2 * a * math.cos(1.414 * PI / n), -a * a)
    peak = s.rec(lambda y: where(abs_(f) > y, abs_(f), y * 0.991))
    e = s.rec(lambda y: where(peak.ne(0), div(f, peak), y))
    return signalled(s, "Euo", e, ma, signal)


@indicator("Cycle")
def EhlersDetrendedLeadingIndicator(s, n=14):
    h, l = s.range_of(s.x)
    p = s.let((mx(s.lag(h, 1), h) + mn(s.lag(l, 1), l)) / 2)
    a = 2 / (n + 1)
    d = s.let(s.smooth(p, a, seed=p) - s.smooth(p, a / 2, seed=p))
    y = s.let(d - s.smooth(d, a))
    return s.result({"Dsp": d, "Deli": y}, s.compare(y), "Deli")


@indicator("Cycle")
def DetrendedSyntheticPrice(s, n=14):
    r = s.run("EhlersDetrendedLeadingIndicator", n=n).outputs["Dsp"]
    return plain(s, "Dsp", r)


@indicator("Cycle")
def EhlersFMDemodulatorIndicator(s, ma=SSF2, fast=10, slow=30):
    return plain(s, "Efmd", s.ma(ma, clamp((s.x - s.open) * fast, 1, -1), slow))


@indicator("Cycle")
def EhlersStochastic(s, ma=SSF1, n1=48, n2=20, n3=10):
    v = place(s, roofing1(s, s.x, n1, n3, ma), n2, 1.0)
    return turned(s, "Es", s.ma(ma, (v + s.lag(v, 1)) / 2, n2), 0.8, 0.2)


@indicator("Cycle")
def EhlersTripleDelayLineDetrender(s, ma="EhlersModifiedOptimumEllipticFilter", n=14):
    a = s.rec_n(lambda y: s.x + y[5] * 0.088, 6)
    u = s.let(a - s.lag(a, 6))
    b = s.rec_n(lambda y: u + y[5] * 1.2 - y[11] * 0.7, 12)
    d = s.lag(s.lag(b, 6), 6) - s.lag(b, 6) * 2 + b
    t = s.ma(ma, d, n)
    sig = s.ma(ma, t, n)
    return s.result({"Etdld": t, "Signal": sig}, s.compare(t - sig))


@indicator("Cycle")
def EhlersAMDetector(s, ma=SMA, n1=4, n2=8):
    m = s.ma(ma, s.x, n1)
    v = s.ma(ma, s.max(s.let(abs_(s.x - s.open)), n1), n2)
    sig = s.ma(ma, v, n2)
    return s.result({"Eamd": v, "Signal": sig}, s.volatile(s.x - m, v, sig))


@indicator("Cycle")
def EhlersEvenBetterSineWaveIndicator(s, n1=40, n2=10):
    w = _unit(2 * PI / n1)
    a = (1 - math.sin(w)) / math.cos(w)
    u = s.let(s.change(s.x) * (0.5 * (1 + a)))
    h = s.rec(lambda y: u + y * a)
    e = math.exp(-_unit(1.414 * PI / n2))
    f = smoothed(s, h, 2 * e * math.cos(_unit(1.414 * PI / n2)), -e * e)
    f1, f2 = s.lag(f, 1), s.lag(f, 2)
    p = s.let((sq(f) + sq(f1) + sq(f2)) / 3)
    return plain(s, "Ebsi", where(p > 0, div((f + f1 + f2) / 3, sqrt(p)), 0.0))


@indicator("Cycle")
def EhlersFisherTransform(s, n=10):
    m = max(n, 2)
    h, l = s.max(s.x, m), s.min(s.x, m)
    r = s.let(div(s.x - l, h - l))
    v = s.rec(lambda y: clamp((r - 0.5) * 0.66 + y * 0.67, 0.999, -0.999))
    u = s.let(log(div(v + 1, 1 - v)) * 0.5)
    return own_slope(s, "Eft", s.rec(lambda y: u + y * 0.5))


def inverse_fisher(s, v):
    e = s.let(exp(v * 2))
    return clamp(div(e - 1, e + 1), 1, -1)


@indicator("Cycle")
def EhlersInverseFisherTransform(s, ma=WMA, n1=5, n2=9):
    return turned(s, "Eift", inverse_fisher(s, s.ma(ma, (s.rsi(s.x, n1, ma) - 50) * 0.1, n2)), 0.5, -0.5)


@indicator("Cycle")
def EhlersRelativeStrengthIndexInverseFisherTransform(s, ma=WMA, n=14, signal=9):
    return turned(s, "Eiftrsi", inverse_fisher(s, s.ma(ma, (s.rsi(s.x, n, ma) - 50) * 0.1, signal)), 0.5, -0.5)


@indicator("Cycle")
def EhlersCommodityChannelIndexInverseFisherTransform(s, ma=WMA, n=20, signal=9, constant=0.015):
    return turned(s, "Eiftcci", inverse_fisher(s, s.ma(ma, (cci(s, n, ma, constant) - 50) * 0.1, signal)), 0.5, -0.5)


@indicator("Cycle")
def EhlersInstantaneousTrendlineV2(s, alpha=0.07):
    a2 = alpha * alpha
    p1, p2 = s.lag(s.x, 1), s.lag(s.x, 2)
    start = s.let((s.x + p1 * 2 + p2) / 4)
    u = s.let(s.x * (alpha - a2 / 4) + p1 * (0.5 * a2) - p2 * (alpha - 0.75 * a2))
    t = s.rec2(lambda y, z: where(s.rn <= 7, start, u + y * (2 * (1 - alpha)) - z * (1 - alpha) ** 2))
    g = s.let(t * 2 - s.lag(t, 2))
    return s.result({"Eit": t, "Signal": g}, s.compare(g - t))


@indicator("Momentum")
def EhlersLaguerreRelativeStrengthIndex(s, gamma=0.5):
    a, b, c, d = laguerre(s, s.x, 1 - gamma)
    up = mx(a - b, 0) + mx(b - c, 0) + mx(c - d, 0)
    down = mx(b - a, 0) + mx(c - b, 0) + mx(d - c, 0)
    return turned(s, "Elrsi", clamp(div(up, up + down), 1, 0), 0.8, 0.2)


def reverse_ema(s, x, alpha):
    c = 1 - alpha
    e = s.smooth(x, alpha)
    y = s.let(e * c + s.lag(e, 1))
    for k in range(1, 8):
        y = s.let(y * c ** (2**k) + s.lag(y, 1))
    return s.let(e - y * alpha)


@indicator("Trend")
def EhlersReverseExponentialMovingAverageIndicatorV1(s, alpha=0.1):
    return plain(s, "Erema", reverse_ema(s, s.x, alpha))


@indicator("Trend")
def EhlersReverseExponentialMovingAverageIndicatorV2(s, trend=0.05, cycle=0.3):
    t = reverse_ema(s, s.x, trend)
    return two(s, "EremaCycle", "EremaTrend", reverse_ema(s, t, cycle), t)


@indicator("Trend")
def EhlersMovingAverageDifferenceIndicator(s, ma=WMA, fast=8, slow=23):
    b = s.ma(ma, s.x, slow)
    return own_slope(s, "Emad", pct(s.ma(ma, s.x, fast) - b, b))


@indicator("Cycle")
def EhlersFisherizedDeviationScaledOscillator(s, ma="EhlersDeviationScaledMovingAverage", fast=20, slow=40):
    f = s.ma(ma, s.x, fast, fast, slow)
    v = s.let(log(div(f / 2 + 1, 1 - f / 2)) * 0.5)
    return turned(s, "Efdso", s.rec(lambda y: where(abs_(f) < 2, v, y)), 2, -2)


@indicator("Cycle")
def EhlersHilbertTransformIndicator(s, n=7, im=0.635, qm=0.338):
    v = s.let(s.change(s.x, n))
    v2, v4 = s.lag(v, 2), s.lag(v, 4)
    i = s.rec_n(lambda y: (v4 - v2 * im) * 1.25 + y[2] * im, 3)
    q = s.rec_n(lambda y: v2 - v * qm + y[1] * qm, 2)
    return s.result({"Quad": q, "Inphase": i}, s.compare(q + i), None)


@indicator("Cycle")
def EhlersVossPredictiveFilter(s, n=20, predict=3.0, bw=0.25):
    k = length(math.ceil(3 * predict))
    f1, g = math.cos(2 * PI / n), math.cos(bw * 2 * PI / n)
    a = 1 / g - math.sqrt(1 / g**2 - 1)
    u = s.let((s.x - s.lag(s.x, 2)) * (0.5 * (1 - a)))
    f = s.rec2(lambda y, z: where(s.rn <= 6, 0.0, u + y * (f1 * (1 + a)) - z * a))

    def step(y):
        out = f * ((3 + k) / 2)
        for j in range(k):
            out = out - y[k - j - 1] * ((j + 1) / k)
        return out

    v = s.rec_n(step, k)
    return two(s, "Voss", "Filt", v, f)


@indicator("Cycle")
def EhlersSimpleDerivIndicator(s, ma=EMA, n=2, signal=8):
    d = s.let(s.change(s.x, n))
    z = s.let(d + s.lag(d, 1) + s.lag(d, 2) + s.lag(d, 3))
    sig = s.ma(ma, z, signal)
    return s.result({"Esdi": z, "Signal": sig}, s.compare(sig))


@indicator("Cycle")
def EhlersSimpleClipIndicator(s, ma=EMA, n1=2, n2=10, n3=50, signal=22):
    d = s.let(s.change(s.x, n1))
    r = s.let(sqrt(s.sum(s.let(sq(d)), n3) / n3))
    c = s.let(where(r.ne(0), clamp(div(d * 2, r), 1, -1), 0.0))
    z = s.let(c + s.lag(c, 1) + s.lag(c, 2) + s.lag(c, 3))
    sig = s.ma(ma, z, signal)
    return s.result({"Esci": z, "Signal": sig}, s.compare(sig))


@indicator("Cycle")
def EhlersSuperPassbandFilter(s, fast=40, slow=60, n1=5, n2=50):
    a, b = _unit(n1 / fast), _unit(n1 / slow)
    u = s.let(s.x * (a - b) + s.lag(s.x, 1) * (b * (1 - a) - a * (1 - b)))
    f = s.rec2(lambda y, z: u + y * (2 - a - b) - z * ((1 - a) * (1 - b)))
    r = s.rms(f, n2)
    return s.result({"Espf": f, "UpperBand": r, "LowerBand": s.let(-r)}, s.both(f - r, f + r))


@indicator("Cycle")
def EhlersUniversalTradingFilter(s, ma=HANN, n1=16, n2=50, mult=2.0):
    f = s.ma(ma, s.x - s.lag(s.x, math.ceil(mult * n1)), n1)
    r = s.rms(f, n2)
    return s.result({"Eutf": f, "UpperBand": r, "LowerBand": s.let(-r)}, s.compare(f - s.lag(f, 1)))


@indicator("Cycle")
def EhlersImpulseReaction(s, n1=2, n2=20, q=0.9):
    b, c = 2 * q * math.cos(2 * PI / n2), -q * q
    u = s.let((s.x - s.lag(s.x, n1)) * ((1 + c) / 2))
    return own_slope(s, "Eir", pct(s.rec2(lambda y, z: u + y * b + z * c), s.x))


def median(s, x, n):
    return s.over("median({})", s.let(x), n)


def _rmf(s, x, n1, n2):
    return s.smooth(median(s, x, n1), _alpha(_unit(2 * PI / n2)))


@average("Ermf")
def EhlersRecursiveMedianFilter(s, x, n=5, long=12):
    return _rmf(s, x, n, long)


@indicator("Cycle")
def EhlersRecursiveMedianOscillator(s, n1=5, n2=12, n3=30):
    return plain(s, "Ermo", high_pass(s, _rmf(s, s.x, n1, n2), _alpha(_unit(2 * PI / math.sqrt(2) / n3))))


@average("Hf")
def HampelFilter(s, x, n=14, scale=3.0):
    x = s.let(x)
    m = median(s, x, n)
    d = s.let(abs_(x - m))
    return s.smooth(where(d <= median(s, d, n) * scale, x, m), 2 / (n + 1))


@indicator("Cycle")
def EhlersSpearmanRankIndicator(s, n=20):
    # ranks among the last n rows, missing ones as 0, newest first; of equal values the newer ranks first
    v = [s.lag(s.x, j) for j in range(n)]
    total = lit(0.0)
    for j in range(n):
        r = lit(1.0)
        for k in range(n):
            if k != j:
                r = r + where(v[k] < v[j] if k > j else v[k] <= v[j], 1.0, 0.0)
        total = s.let(total + sq(s.let(r) - (j + 1.0)))
    return plain(s, "Esri", (total * (6 / (n * (n * n - 1))) - 0.5) * 2)


@indicator("Cycle")
def EhlersNoiseEliminationTechnology(s, n=14):
    return plain(s, "Enet", _net(s, s.x, n))


def _net(s, x, n):
    """Pairs of the last n rows that rise less those that fall, over all pairs; missing rows count as 0."""
    if n > 20:  # what comes with the newest row less what goes with the oldest, summed up: whole numbers, so exact
        v, comes, goes = [s.lag(x, j) for j in range(n)], lit(0.0), lit(0.0)
        for k in range(1, n):
            comes, goes = comes - sign(v[k] - v[0]), goes - sign(v[n - 1] - v[n - 1 - k])
        return s.sum(s.let(comes - s.lag(s.let(goes), 1))) / (0.5 * n * (n - 1))
    v, out = [s.lag(x, j) for j in range(n)], lit(0.0)
    for j in range(1, n):
        part = lit(0.0)
        for k in range(j):
            part = part - sign(v[j] - v[k])
        out = s.let(out + part)
    return out / (0.5 * n * (n - 1))


@indicator("Cycle")
def EhlersTruncatedBandPassFilter(s, n1=20, n2=10, bw=0.1):
    l, g = math.cos(_unit(2 * PI / n1)), math.cos(bw * 2 * PI / n1)
    a = 1 / g - math.sqrt(1 / g**2 - 1)
    t1, t2 = lit(0.0), lit(0.0)
    for j in range(n2, 0, -1):
        t1, t2 = s.let((s.lag(s.x, j - 1) - s.lag(s.x, j + 1)) * (0.5 * (1 - a)) + t1 * (l * (1 + a)) - t2 * a), t1
    return plain(s, "Etbpf", t1)


def _window(s, key, f, n):
    return s.result({key: f, "Roc": s.let((f - s.lag(f, 1)) * (n // 2 * PI))}, s.compare(f - s.lag(f, 1)))


@indicator("Cycle")
def EhlersHannWindowIndicator(s, ma=HANN, n=20):
    return _window(s, "Ehwi", s.ma(ma, s.x - s.open, n), n)


@indicator("Cycle")
def EhlersHammingWindowIndicator(s, ma="EhlersHammingMovingAverage", n=20):
    return _window(s, "Ehwi", s.ma(ma, s.x - s.open, n), n)


@indicator("Cycle")
def EhlersTriangleWindowIndicator(s, ma="EhlersTriangleMovingAverage", n=20):
    return _window(s, "Etwi", s.ma(ma, s.x - s.open, n), n)


@indicator("Cycle")
def EhlersSimpleWindowIndicator(s, ma=SMA, n=20):
    return _window(s, "Etwi", s.ma(ma, s.ma(ma, s.ma(ma, s.x - s.open, n), n), n), n)


@indicator("Cycle")
def EhlersHurstCoefficient(s, n1=30, n2=20):
    h = math.ceil(n1 / 2)
    n3, n_1 = (s.max(s.x, n1) - s.min(s.x, n1)) / n1, (s.max(s.x, h) - s.min(s.x, h)) / h
    base = s.let(where(s.rn > h, s.lag(s.x, h), s.x))
    hi, lo = base, base
    for j in range(h, n1):
        hi, lo = mx(hi, s.lag(s.x, j)), mn(lo, s.lag(s.x, j))
    n_2 = s.let((hi - lo) / h)
    d0 = s.let((log(n_1 + n_2) - log(n3)) / math.log(2))
    d = s.rec(lambda y: (d0 + y) * 0.5)
    return own_slope(s, "Ehc", smoothed(s, 2 - d, *_pair(n2)))


@indicator("Cycle")
def EhlersSignalToNoiseRatioV2(s, n=6):
    m = mama(s, s.x)
    h, l = s.range_of(s.x)
    r = s.smooth(h - l, 0.1)
    e = s.let(sq(m["I1"]) + sq(m["Q1"]))
    t = s.let(where((r > 0) & (e > 0), log(div(e, sq(r))) * (10 / math.log(10)) + n, 0.0))
    y = s.smooth(t, 0.25)
    return s.result({"Esnr": y}, s.volatile(s.x - m["Mama"], y, float(n)))


@indicator("Cycle")
def EhlersPhaseCalculation(s, ma=EMA, n=15):
    re = s.fir(s.x, [math.cos(2 * PI * j / n) for j in range(n)], 1.0)
    im = s.fir(s.x, [math.sin(2 * PI * j / n) for j in range(n)], 1.0)
    p = s.let(where(abs_(re) > 0.001, atan(div(im, re)) * (180 / PI), sign(im) * 90))
    p = s.let(where(re < 0, p + 180, p) + 90)
    p = s.let(where(p < 0, p + 360, p))
    p = s.let(where(p > 360, p - 360, p))
    e = s.ma(ma, p, n)
    return s.result({"Phase": p, "Signal": e}, s.compare(p - e, True))


@indicator("Cycle")
def EhlersSnakeUniversalTradingFilter(s, ma=HANN, n1=23, n2=50, bw=1.4):
    l, g = math.cos(_unit(PI * n1)), math.cos(_unit(bw * PI * n1))
    a = 1 / g - math.sqrt(1 / g**2 - 1)
    u = s.let((s.x - s.lag(s.x, 2)) * (0.5 * (1 - a)))
    f = s.ma(ma, s.rec2(lambda y, z: where(s.rn <= 3, 0.0, u + y * (l * (1 + a)) - z * a)), n1)
    r = s.rms(f, n2)
    return s.result({"UpperBand": r, "Erf": f, "LowerBand": s.let(-r)}, s.compare(f - s.lag(f, 1)), "Erf")
