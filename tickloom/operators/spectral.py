"""Dominant cycles, and what follows them: filters over as many rows as a cycle has."""

from __future__ import annotations

import math

from tickloom.functions.expr import E, abs_, atan, ceil, clamp, cos, div, exp, floor, lit, log, mn, mx, sign, sin, sq, sqrt, where

from .averages import laguerre, mama
from .cycles import HANN, PI, _pair, _unit, adaptive_cycle
from .momentum import against
from .registry import EMA, Context, indicator
from .volatility import own_slope, vol


def over(s: Context, x: E, size: E, most: int, least: int = 0, f=lambda e: e) -> E:
    """Sum of f of the last `size` rows, a column of `most` at most; f gets each of them."""
    x, size, total = s.let(x), s.let(size), lit(0.0)
    for j in range(most):
        e = f(s.lag(x, j))
        total = total + (e if j < least else where(size > j, e, 0.0))
    return s.let(total)


def roofing(s: Context, x: E, n1: int, n2: int) -> E:
    return s.let(s.of("EhlersRoofingFilterV2", x, upper=n1, lower=n2).value)


def halved(s: Context, x: E, b: float, c: float) -> E:
    """Two-pole smoothing of the mean of a value and the one before it."""
    u = s.let((x + s.lag(s.let(x), 1)) / 2 * (1 - b - c))
    return s.rec2(lambda y, z: u + y * b + z * c)


@indicator("Cycle")
def EhlersAdaptiveCenterOfGravityOscillator(s, n=5):
    size = s.let(ceil(adaptive_cycle(s, n)[1] / 2))
    top, bottom = lit(0.0), lit(0.0)
    for j in range(33):
        e = where(size > j, s.lag(s.x, j), 0.0)
        top, bottom = top + e * (1 + j), bottom + e
    bottom = s.let(bottom)
    return own_slope(s, "Eacog", where(bottom.ne(0), floor((size + 1) / 2) - div(top, bottom), 0.0))


@indicator("Cycle")
def EhlersSmoothedAdaptiveMomentum(s, ma=EMA, n1=5, n2=8):
    a = math.exp(-PI / n2)
    b, c = 2 * a * math.cos(1.738 * PI / n2), a * a
    k2, k3, k4 = b + c, -(c + b * c), c * c
    size = s.let(ceil(abs_(adaptive_cycle(s, n1)[1] - 1)))
    move = lit(0.0)
    for k in range(1, 66):
        move = move + where(size.eq(k), s.change(s.x, k), 0.0)
    move = s.let(move)
    f = s.rec_n(lambda y: move * (1 - k2 - k3 - k4) + y[0] * k2 + y[1] * k3 + y[2] * k4, 3)
    sig = s.ma(ma, f, n2)
    return s.result({"Esam": f, "Signal": sig}, s.compare(f - sig))


#: Weights of the five values before a predicted one.
AHEAD = (-8.45, 8.145, -4.045, 0.825)


@indicator("Cycle")
def EhlersMesaPredictIndicatorV2(s, ma=HANN, n1=5, n2=135, n3=12, n4=4):
    """Values ahead by fixed weights, and along the line of the last two."""

    def coefficients(n):
        a = math.exp(min(max(-1.414 * PI / n, -0.99), -0.01))
        return 2 * a * math.cos(_unit(1.414 * PI / n)), -a * a

    b, c = coefficients(n2)
    u = s.let((s.x - s.lag(s.x, 1) * 2 + s.lag(s.x, 2)) * ((1 + b - c) / 4))
    hp = s.rec2(lambda y, z: where(s.rn <= 4, 0.0, u + y * b + z * c))
    b3, c3 = coefficients(n3)
    v = s.let((hp + s.lag(hp, 1)) / 2 * (1 - b3 - c3))
    ssf = s.rec2(lambda y, z: where(s.rn <= 3, hp, v + y * b3 + z * c3))
    f = s.ma(ma, ssf, n3)
    known = [s.lag(f, j) for j in range(n1)]
    ahead = list(known)  # the newest first
    for _ in range(n4):
        ahead.insert(0, s.let(sum((ahead[j] * w for j, w in enumerate(AHEAD[1:], 1)), ahead[0] * AHEAD[0])))
    line = s.let(known[0] + (known[0] - known[1]) * n4)
    return s.result({"Ssf": f, "Predict": ahead[0], "Extrap": line}, s.compare(ahead[0] - s.lag(ahead[0], 1)), "Predict")


def autocorrelation(s: Context, n1: int, n2: int) -> E:
    """Correlation of the roofing filter with its past, from 0 to 1."""
    x = roofing(s, s.x, n1, n2)
    y = s.let(s.lag(x, n1))
    sx, sy, sxx, syy, sxy = (s.sum(s.let(e), n1) for e in (x, y, x * x, y * y, x * y))
    rows = s.let(mn(s.rn, n1))
    v = s.let((rows * sxx - sx * sx) * (rows * syy - sy * sy))
    return s.let(where(v > 0, (div(rows * sxy - sx * sy, sqrt(v)) + 1) * 0.5, 0.0))


@indicator("Cycle")
def EhlersAutoCorrelationIndicator(s, n1=48, n2=10):
    return own_slope(s, "Eaci", autocorrelation(s, n1, n2))


@indicator("Cycle")
def EhlersAutoCorrelationReversals(s, ma=EMA, n1=48, n2=10, n3=3):
    c, m = autocorrelation(s, n1, n2), s.ma(ma, s.x, n2)
    last = s.lag(c, 1)
    k = s.let(where(((last > 0.5) & (c < 0.5)) | ((last < 0.5) & (c > 0.5)), 1.0, 0.0))
    # of the crossings between neighbours, those of lags n3 - 1 and on
    count = s.sum(k, n1) - (s.sum(k, n3 - 1) if n3 > 1 else 0.0)
    y = s.let(where(count > n1 / 2, 1.0, 0.0))
    return s.result({"Eacr": y}, s.when((s.x < m) & y.eq(1), (s.x > m) & y.eq(1)))


def _spectrum(s: Context, x: E, n1: int, n2: int, first: int, running: bool) -> E:
    """The period where the smoothed power of x, in periods from n2 to n1, has its centre of weight.

    Powers are taken in relation to the largest of all periods, or of the shorter ones if `running`.
    """
    lags = [s.lag(x, k) for k in range(first, n1 + 1)]
    powers = []
    for j in range(n2, n1 + 1):
        a, b = lit(0.0), lit(0.0)
        for k, e in enumerate(lags, first):
            a, b = a + e * math.cos(2 * PI * k / j), b + e * math.sin(2 * PI * k / j)
        p = s.let(sq(s.let(sq(s.let(a)) + sq(s.let(b)))))
        powers.append(s.rec(lambda y, p=p: p * 0.2 + y * 0.8))
    top = s.let(mx(0, *powers))
    num, den = lit(0.0), lit(0.0)
    for i, (j, r) in enumerate(zip(range(n2, n1 + 1), powers, strict=True)):
        if running:
            top = r if i == 0 else s.let(mx(top, r))
        p = s.let(div(r, top))
        num, den = num + where(p >= 0.5, p * j, 0.0), den + where(p >= 0.5, p, 0.0)
    return s.let(div(num, s.let(den)))


def periodogram(s: Context, n1: int, n2: int, n3: int) -> tuple[E, E]:
    """(dominant cycle, autocorrelation)."""
    c = autocorrelation(s, n1, n2)
    return _spectrum(s, c, n1, n2, n3, False), c


@indicator("Cycle")
def EhlersAutoCorrelationPeriodogram(s, n1=48, n2=10, n3=3):
    d, c = periodogram(s, n1, n2, n3)
    return s.result({"Eacp": d}, s.compare(c - s.lag(c, 1)))


@indicator("Cycle")
def EhlersDiscreteFourierTransformSpectralEstimate(s, n1=48, n2=10):
    x = roofing(s, s.x, n1, n2)
    return s.result({"Edftse": _spectrum(s, x, n1, n2, 0, True)}, s.compare(x - s.lag(x, 1)))


def _tuned(s, n1, n2, n3):
    """(cycle within its limits, roofing filter of the cycle): the filter reads the cycle."""
    d = periodogram(s, n1, n2, n3)[0]
    return s.let(clamp(d, n1, n2)), roofing(s, d, n1, n2)


@indicator("Cycle")
def EhlersAdaptiveRelativeStrengthIndexV2(s, ma=EMA, n1=48, n2=10, n3=3):
    d, x = _tuned(s, n1, n2, n3)
    move, size = s.let(x - s.lag(x, 1)), s.let(ceil(d / 2))
    up, down = (over(s, move, size, math.ceil(n1 / 2), math.ceil(n2 / 2), f) for f in (lambda e: mx(e, 0), lambda e: mx(-e, 0)))
    total = s.let(up + down)
    share = s.let(div(up, total))
    b, c = _pair(n2)
    ok, u = total.ne(0) & s.lag(total, 1).ne(0), s.let((share + s.lag(share, 1)) / 2 * (1 - b - c))
    y = s.rec2(lambda y, z: where(ok, u + y * b + z * c, 0.0))
    return against(s, "Earsi", y, s.ma(ma, y, n2), 0.7, 0.3)


def fisher(s: Context, share: E) -> E:
    a = s.let(clamp((share - 0.5) * 3, 0.999, -0.999))
    return s.let(log(div(1 + a, 1 - a)) * 0.5)


@indicator("Cycle")
def EhlersAdaptiveRsiFisherTransformV2(s, ma=EMA, n1=48, n2=10, n3=3):
    y = fisher(s, s.run("EhlersAdaptiveRelativeStrengthIndexV2", ma=ma, n1=n1, n2=n2, n3=n3).value / 100)
    return s.result({"Earsift": y}, s.crossing(y - s.lag(y, 1), y, 2, -2))


@indicator("Cycle")
def EhlersAdaptiveStochasticIndicatorV2(s, ma=EMA, n1=48, n2=10, n3=3):
    d, x = _tuned(s, n1, n2, n3)
    size = s.let(ceil(d))
    held = [where(size > j, s.lag(x, j), 0.0) for j in range(n1)]
    top, bottom = s.let(mx(0, *held)), s.let(mn(0, *held))
    y = halved(s, s.let(div(x - bottom, top - bottom)), *_pair(n2))
    return against(s, "Easi", y, s.ma(ma, y, n2), 0.7, 0.3)


@indicator("Cycle")
def EhlersAdaptiveStochasticInverseFisherTransform(s, ma=EMA, n1=48, n2=10, n3=3):
    v = s.run("EhlersAdaptiveStochasticIndicatorV2", ma=ma, n1=n1, n2=n2, n3=n3).value
    e = s.let(exp((v - 0.5) * 12))
    y = s.let(div(e - 1, e + 1))
    t = s.let(s.lag(y, 1) * 0.9)
    return s.result({"Easift": y, "Signal": t}, s.compare(y - t))


@indicator("Cycle")
def EhlersAdaptiveCommodityChannelIndexV2(s, ma=EMA, n1=48, n2=10, n3=3):
    d, x = _tuned(s, n1, n2, n3)
    size = s.let(ceil(d))
    rows = s.let(mn(size, s.rn))
    gap = s.let(x - div(over(s, x, size, n1, n2), rows))
    y = halved(s, s.let(div(gap, sqrt(div(over(s, sq(gap), size, n1, n2), rows)) * 0.015)), *_pair(n2))
    return against(s, "Eacci", y, s.ma(ma, y, n2), 100, -100)


# ---- phases --------------------------------------------------------------------------------------


def _degrees(s, x, y, ratio):
    """The angle of (x, y) from 0 to 360, given that of its first quadrant."""
    p = s.let(ratio)
    return s.let(where((x < 0) & (y > 0), 180 - p, where((x < 0) & (y < 0), 180 + p, where((x > 0) & (y < 0), 360 - p, p))))


def _turn(s, phase, most, least):
    last = s.lag(phase, 1)
    return s.let(clamp(where((last < 90) & (phase > 270), 360 + last - phase, last - phase), most, least))


def _rows_of_turn(s, turn, most):
    """The first number of rows back, up to `most`, over which the turns sum to more than a circle; 0 without one."""
    below = lit(0.0)
    for j in range(most + 1):
        below = below + where(s.sum(turn, j + 1) <= 360, 1.0, 0.0)
    below = s.let(below)
    return s.let(where(below > most, 0.0, below))


def _phase_period(s, ip, qu, n):
    a, b = s.let(ip + s.lag(ip, 1)), s.let(qu + s.lag(qu, 1))
    p = _degrees(s, ip, qu, where(a.ne(0), atan(abs_(div(b, a))) * (180 / PI), 0.0))
    return s.smooth(_rows_of_turn(s, _turn(s, p, 60, 1), n), 0.25)


@indicator("Cycle")
def EhlersInstantaneousPhaseIndicator(s, n1=7, n2=50):
    h = s.run("EhlersHilbertTransformIndicator", n=n1).outputs
    ip, qu = h["Inphase"], h["Quad"]
    return s.result({"Eipi": _phase_period(s, ip, qu, n2)}, s.compare(qu + ip))


@indicator("Cycle")
def EhlersSquelchIndicator(s, n1=6, n2=20, n3=40):
    v = s.let(s.change(s.x, n1))
    ip = s.smooth(s.lag(v, 3), 0.33)
    qu = s.smooth((v - s.lag(v, n1)) * 0.75 + (s.lag(v, 2) - s.lag(v, 4)) * 0.25, 0.2)
    return s.result({"Esi": s.let(where(_phase_period(s, ip, qu, n3) < n2, 0.0, 1.0))}, s.compare(qu + ip))


def gained(s: Context, x: E) -> E:
    """x over its own slowly falling peak."""
    x = s.let(x)
    return s.let(div(x, s.rec(lambda y: mx(y * 0.991, abs_(x)))))


#: Weights of every second value in the Hilbert filter, the newest first.
CLASSIC = (0.091, 0.111, 0.143, 0.2, 0.333, 1.0)


@indicator("Cycle")
def EhlersClassicHilbertTransformer(s, n1=48, n2=10):
    r = gained(s, roofing(s, s.x, n1, n2))
    y = lit(0.0)
    for k, w in enumerate(CLASSIC):
        y = y + (s.lag(r, 2 * k) - s.lag(r, 22 - 2 * k)) * w
    return s.result({"Real": r, "Imag": s.let(y / 1.865)}, s.compare(r - s.lag(r, 1)), None)


def _hilbert(s, n1, n2):
    r = gained(s, roofing(s, s.x, n1, n2))
    return r, gained(s, r - s.lag(r, 1))


@indicator("Cycle")
def EhlersHilbertTransformer(s, n1=48, n2=20):
    r, i = _hilbert(s, n1, n2)
    return s.result({"Real": r, "Imag": i}, s.compare(r - s.lag(r, 1)), None)


@indicator("Cycle")
def EhlersHilbertTransformerIndicator(s, n1=48, n2=20, n3=10):
    r, q = _hilbert(s, n1, n2)
    i = halved(s, q, *_pair(n3, False))
    return s.result({"Real": r, "Imag": i}, s.compare(i - q), None)


def _dominant(s, key, period, r, n):
    return s.result({key: halved(s, s.let(period), *_pair(n, False))}, s.compare(r - s.lag(r, 1)))


@indicator("Cycle")
def EhlersDualDifferentiatorDominantCycle(s, n1=48, n2=20, n3=8):
    r, i = _hilbert(s, n1, n2)
    a, b = s.let(r - s.lag(r, 1)), s.let(i - s.lag(i, 1))
    return _dominant(s, "Edddc", clamp(div((r * r + i * i) * (2 * PI), i * a - r * b), n1, n3), r, n2)


@indicator("Cycle")
def EhlersPhaseAccumulationDominantCycle(s, n1=48, n2=20, n3=10, n4=40):
    r, i = _hilbert(s, n1, n2)
    p = _degrees(s, r, i, where(r.ne(0), atan(abs_(div(i, r))) * (180 / PI), 0.0))
    n = _rows_of_turn(s, _turn(s, p, n1, n3), n4 - 1)
    return _dominant(s, "Epadc", s.rec(lambda y: where(n.ne(0), n, y)), r, n2)


@indicator("Cycle")
def EhlersHomodyneDominantCycle(s, n1=48, n2=20, n3=10):
    r, i = _hilbert(s, n1, n2)
    a, b = s.lag(r, 1), s.lag(i, 1)
    re, im = s.let(r * a + i * b), s.let(a * i - r * b)
    return _dominant(s, "Ehdc", clamp(where(re.ne(0), div(2 * PI, abs_(div(im, re))), 0.0), n1, n3), r, n2)


# ---- signal and noise ----------------------------------------------------------------------------


def decibels(x: E) -> E:
    return log(x) * (10 / math.log(10))


@indicator("Cycle")
def EhlersSignalToNoiseRatioV1(s, ma=EMA, n=7):
    h, l = s.range_of(s.x)
    t = s.run("EhlersHilbertTransformIndicator", n=n).outputs
    v = s.smooth(sq(t["Inphase"]) + sq(t["Quad"]), 0.2)
    r = s.smooth(h - l, 0.2)
    u = s.let((decibels(div(v, r * r)) + 1.9) * 0.25)
    y = s.rec(lambda y: where(r.ne(0), u + y * 0.75, 0.0))
    return vol(s, "Esnr", y, 1.9, s.ma(ma, s.x, n))


def _enhanced(s, n):
    h, l = s.range_of(s.x)
    m = mama(s, s.x)
    x, p = m["Smooth"], m["SmoothPeriod"]
    q = s.let((x - s.lag(x, 2)) * 0.5 * (p * 0.1759 + 0.4607))
    size = s.let(ceil(p / 2))
    i = s.let(div(over(s, q, size, 25) * 1.57, size))
    noise = s.smooth(sq(s.let(h - l)) * 0.25, 0.1)
    return x, s.smooth(decibels(div(i * i + q * q, noise)), 0.33), i, q, p


@indicator("Cycle")
def EhlersEnhancedSignalToNoiseRatio(s, n=6):
    x, y, i, q, p = _enhanced(s, n)
    return vol(s, "Esnr", y, float(n), x, I3=i, Q3=q, SmoothPeriod=p)


@indicator("Cycle")
def EhlersHilbertOscillator(s, n=7):
    _, _, i, q, p = _enhanced(s, n)
    size = s.let(ceil(p / 4))
    y = s.let(div(over(s, q, size, 13) * 1.25, size))
    return s.result({"I3": i, "IQ": y}, s.compare(y - i), None)


@indicator("Cycle")
def EhlersAlternateSignalToNoiseRatio(s, n=6):
    h, l = s.range_of(s.x)
    m = mama(s, s.x)
    r = s.smooth(h - l, 0.1)
    y = s.smooth(decibels(div(m["Real"] + m["Imag"], r * r)) + n, 0.25)
    return vol(s, "Esnr", y, float(n), m["Mama"])


@indicator("Cycle")
def EhlersCycleAmplitude(s, n=20, delta=0.1):
    """No power is summed: the range of lags, from n to n - 1, is empty."""
    return own_slope(s, "Eca", s.x * 0.0)


# ---- rows of a cycle -----------------------------------------------------------------------------


def _sine(s, x, size, most, extra):
    """Sine and lead sine of the phase of the cycle of `size` rows."""
    re, im = lit(0.0), lit(0.0)
    for j in range(most):
        a = clamp(div(2 * PI * j, size), 0.99, 0.01)
        re, im = re + where(size > j, sin(a) * s.lag(x, j), 0.0), im + where(size > j, cos(a) * s.lag(x, j), 0.0)
    re, im = s.let(re), s.let(im)
    p = where(abs_(im) > 0.001, atan(div(re, im)) * (180 / PI), sign(re) * 90) + 90 + extra + where(im < 0, 180.0, 0.0)
    p = s.let(p)
    p = s.let(where(p > 315, p - 360, p))
    a, b = s.let(sin(p * (PI / 180))), s.let(sin((p + 45) * (PI / 180)))
    return s.result({"Sine": a, "LeadSine": b}, s.compare(a - b))


@indicator("Cycle")
def EhlersSineWaveIndicatorV1(s):
    m = mama(s, s.x)
    p = m["SmoothPeriod"]
    return _sine(s, m["Smooth"], s.let(ceil(p + 0.5)), 51, div(360, p))


@indicator("Cycle")
def EhlersSineWaveIndicatorV2(s, n=5, alpha=0.07):
    """The cycle reads the adaptive one."""
    c, p = adaptive_cycle(s, n, alpha)
    return _sine(s, s.of("EhlersCyberCycle", c).value, s.let(ceil(p)), 64, 0.0)


@indicator("Trend")
def EhlersInstantaneousTrendlineV1(s):
    size = s.let(ceil(mama(s, s.x)["SmoothPeriod"] + 0.5))
    return _trendline(s, s.let(div(over(s, s.x, size, 51), size)))


def _trendline(s, t):
    y = s.let((t * 4 + s.lag(t, 1) * 3 + s.lag(t, 2) * 2 + s.lag(t, 3)) / 10)
    return s.result({"Eit": t, "Signal": y}, s.compare(s.x - y))


@indicator("Momentum")
def EhlersLaguerreRelativeStrengthIndexWithSelfAdjustingAlpha(s, n=13):
    h, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    top, bottom = s.let(mx(h, last)), s.let(mn(l, last))
    x = s.let(((s.open + last) / 2 + top + bottom + s.x) / 4)
    total = s.sum(s.let(div(top - bottom, s.max(h, n) - s.min(l, n))), n)
    alpha = s.let(where(total > 0, clamp(log(total) / math.log(n), 0.99, 0.01), 0.01))
    v = laguerre(s, x, alpha, False)
    up, down = lit(0.0), lit(0.0)
    for a, b in zip(v, v[1:], strict=False):
        up, down = up + mx(a - b, 0), down + mx(b - a, 0)
    up, down = s.let(up), s.let(down)
    y = s.let(clamp(div(up, up + down), 1, 0))
    return s.result({"Elrsiwsa": y}, s.crossing(y - s.lag(y, 1), y, 0.8, 0.2))


def paced(s: Context, x: E, size: E) -> E:
    """EMA with a length of its own in each row."""
    x, k = s.let(x), s.let(clamp(div(2, size + 1), 0.99, 0.01))
    return s.rec(lambda y: x * k + (1 - k) * y)


def _followed(s, key, x, size, over_, under):
    x = s.let(x)
    m = paced(s, x, size)
    return s.result({key: x, "Signal": m}, s.crossing(m - s.lag(m, 1), m, over_, under))


@indicator("Momentum")
def EhlersAdaptiveRelativeStrengthIndexV1(s, part=0.5):
    p = mama(s, s.x)["SmoothPeriod"]
    move, size, most = s.let(s.x - s.lag(s.x, 1)), s.let(ceil(p * part)), math.ceil(50 * part)
    up, down = (over(s, move, size, most, 0, f) for f in (lambda e: mx(e, 0), lambda e: mx(-e, 0)))
    return _followed(s, "Earsi", div(up * 100, up + down), ceil(p), 70, 30)


@indicator("Momentum")
def EhlersAdaptiveRsiFisherTransformV1(s):
    return own_slope(s, "Earsift", fisher(s, s.run("EhlersAdaptiveRelativeStrengthIndexV1").value / 100))


@indicator("Momentum")
def EhlersAdaptiveStochasticIndicatorV1(s, part=0.5):
    h, l = s.range_of(s.x)
    size, most = s.let(ceil(mama(s, s.x)["SmoothPeriod"] * part)), math.ceil(50 * part)
    top = s.let(mx(h, *(where(size > j, s.lag(h, j), h) for j in range(1, most))))
    bottom = s.let(mn(l, *(where(size > j, s.lag(l, j), l) for j in range(1, most))))
    return _followed(s, "Easi", div((s.x - bottom) * 100, top - bottom), size, 70, 30)


@indicator("Momentum")
def EhlersAdaptiveCommodityChannelIndexV1(s, part=1.0, constant=0.015):
    """The cycle reads the typical price, as the rest does."""
    x = s.run("TypicalPrice").value
    p = mama(s, x)["SmoothPeriod"]
    size, most = s.let(ceil(p * part)), math.ceil(50 * part)
    mean = s.let(div(over(s, x, size, most), size))
    spread = s.let(div(over(s, x, size, most, 0, lambda e: abs_(e - mean)), size))
    return _followed(s, "Eacci", div(x - mean, spread * constant), ceil(p), 100, -100)
