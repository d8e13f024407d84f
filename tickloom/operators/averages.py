"""Moving averages and smoothing filters."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, atan, clamp, cos, div, exp, floor, lit, log, mn, mx, power, rsi_of, sign, sq, sqrt, where

from .registry import AVERAGES, EMA, SMA, WMA, average, half_even, indicator, length, parts

PI, ROOT2 = math.pi, math.sqrt(2)


def _unit(x: float) -> float:
    return min(max(x, 0.01), 0.99)


@average("Sma")
def SimpleMovingAverage(s, x, n=14):
    return s.let(where(s.rn >= n, s.avg(x, n), 0.0))


@average("Wma")
def WeightedMovingAverage(s, x, n=14):
    # weights n..1 through the row number: rows that do not exist weigh nothing, the divisor stays whole; once there
    # are n rows, from centred values, which keep their digits in a long series
    x = s.let(x)
    first = (s.sum(s.let(x * s.rn), n) - (s.rn - n) * s.sum(x, n)) / (n * (n + 1) / 2)
    return s.let(where(s.rn >= n, s.avg(x, n) + s.covar(x, s.rn, n) * (2 / (n + 1)), first))


@average("Ema")
def ExponentialMovingAverage(s, x, n=14):
    k = _unit(2 / (n + 1))
    return s.scan(lambda y, t: [where(s.rn <= n, (t + x) / s.rn, x * k + y * (1 - k)), t + x], (0.0, 0.0))[0]


@average("Wwma")
def WellesWilderMovingAverage(s, x, n=14):
    return s.smooth(x, 1 / n)


@average("Wws")
def WellesWilderSummation(s, x, n=14):
    return s.rec(lambda y: y * (1 - 1 / n) + x)


@average("Tma")
def TriangularMovingAverage(s, x, n=20, ma=SMA):
    return s.ma(ma, s.ma(ma, x, n), n)


@average("Hma")
def HullMovingAverage(s, x, n=20, ma=WMA):
    return s.ma(ma, s.ma(ma, x, length(half_even(n / 2))) * 2 - s.ma(ma, x, n), length(half_even(math.sqrt(n))))


@average("Kama")
def KaufmanAdaptiveMovingAverage(s, x, n=10, fast=2, slow=30):
    f, g = 2 / (fast + 1), 2 / (slow + 1)
    return s.smooth(x, s.let(sq(s.er(x, n) * (f - g) + g)))


@parts("KaufmanAdaptiveMovingAverage", "Kama")
def _kama_parts(s, x, n, fast, slow):
    return {"Er": s.er(x, n), "Kama": KaufmanAdaptiveMovingAverage(s, x, n, fast, slow)}


@average("Alma")
def ArnaudLegouxMovingAverage(s, x, n=9, offset=0.85, sigma=6):
    m, w = offset * (n - 1), n / sigma
    return s.fir(x, [math.exp(-((n - 1 - j - m) ** 2) / (2 * w * w)) for j in range(n)])


@average("Epma")
def EndPointMovingAverage(s, x, n=11, offset=4):
    return s.fir(x, [n - j - offset for j in range(n)])


@average("Lsma")
def LeastSquaresMovingAverage(s, x, n=25):
    # each part reads what the one before it left: the second average is taken of the first
    w = s.wma(x, n)
    return s.let(w * 3 - s.sma(w, n) * 2)


@average("Lma")
def LeoMovingAverage(s, x, n=14):
    w = s.wma(x, n)
    return s.let(w * 2 - s.sma(w, n))


def _chain(s, x, n, ma, depth):
    out = []
    for _ in range(depth):
        x = s.ma(ma, x, n)
        out.append(x)
    return out


@average("T3")
def TillsonT3MovingAverage(s, x, n=5, ma=EMA, v=0.7):
    e = _chain(s, x, n, ma, 6)
    c = (-(v**3), 3 * v**2 + 3 * v**3, -6 * v**2 - 3 * v - 3 * v**3, 1 + 3 * v + v**3 + 3 * v**2)
    return s.let(e[5] * c[0] + e[4] * c[1] + e[3] * c[2] + e[2] * c[3])


def _binomial(s, x, n, ma, weights):
    out = lit(0.0)
    for e, w in zip(_chain(s, x, n, ma, len(weights)), weights, strict=True):
        out = out + e * w
    return s.let(out)


@average("Tema")
def TripleExponentialMovingAverage(s, x, n=14, ma=EMA):
    return _binomial(s, x, n, ma, (3, -3, 1))


@average("Dema")
def DoubleExponentialMovingAverage(s, x, n=14, ma=EMA):
    return _binomial(s, x, n, ma, (2, -1))


@average("Qema")
def QuadrupleExponentialMovingAverage(s, x, n=20, ma=EMA):
    return _binomial(s, x, n, ma, (5, -10, 10, -5, 1))


@average("Pema")
def PentupleExponentialMovingAverage(s, x, n=20, ma=EMA):
    return _binomial(s, x, n, ma, (8, -28, 56, -70, 56, -28, 8, -1))


@average("Gdema")
def GeneralizedDoubleExponentialMovingAverage(s, x, n=5, ma=EMA, factor=0.7):
    return _binomial(s, x, n, ma, (1 + factor, -factor))


@average("Zema")
def ZeroLagExponentialMovingAverage(s, x, n=14, ma=EMA):
    return _binomial(s, x, n, ma, (2, -1))


@average("Ztema")
def ZeroLagTripleExponentialMovingAverage(s, x, n=14, ma="TripleExponentialMovingAverage"):
    return _binomial(s, x, n, ma, (2, -1))


@average("Mnma")
def McNichollMovingAverage(s, x, n=20, ma=EMA):
    a = 2 / (n + 1)
    return _binomial(s, x, n, ma, ((2 - a) / (1 - a), -1 / (1 - a)))


@average("Vwap")
def VolumeWeightedAveragePrice(s, x, n=0):
    # the price is the typical price whatever the input; no session starts anew
    p = s.let(s.typical if x.sql == s.close.sql else x)
    return s.let(div(s.total(p * s.volume), s.total(s.volume)))


@average("Vwma")
def VolumeWeightedMovingAverage(s, x, n=14, ma=SMA):
    return s.let(div(s.avg(s.let(x * s.volume), n), s.ma(ma, s.volume, n)))


@average("Ahma")
def AhrensMovingAverage(s, x, n=9):
    return s.rec_n(lambda y: y[0] + (x - (y[0] + where(s.rn > n, y[n - 1], x)) / 2) / n, n)


def _edge(s, x, n):
    """How far x is from the middle of the range of n rows, 0 to 1."""
    high, low = s.range_of(x)
    h, l = s.max(high, n), s.min(low, n)
    return s.let(clamp(div(abs_(x * 2 - l - h), h - l), 1, 0))


@average("Ama")
def AdaptiveMovingAverage(s, x, n=14, fast=2, slow=14):
    f, g = 2 / (fast + 1), 2 / (slow + 1)
    return s.smooth(x, s.let(sq(_edge(s, x, n + 1) * (f - g) + g)))


@average("Aema")
def AdaptiveExponentialMovingAverage(s, x, n=10, ma=SMA):
    start, rate = s.ma(ma, x, n), s.let((_edge(s, x, n) + 1) * (2 / (n + 1)))
    return s.rec(lambda y: where(s.rn <= n + 1, start, y + rate * (x - y)))


@average("Aarma")
def AdaptiveAutonomousRecursiveMovingAverage(s, x, n=14, gamma=3.0):
    return _aarma(s, x, n, gamma)[0]


@parts("AdaptiveAutonomousRecursiveMovingAverage", "Aarma")
def _aarma_parts(s, x, n, gamma):
    y, d = _aarma(s, x, n, gamma)
    return {"D": d, "Aarma": y}


def _aarma(s, x, n, gamma):
    er = s.er(x, n)

    def step(m2, m1, total, _):
        p2, p1 = s.first(x, m2), s.first(x, m1)
        t = total + abs_(x - p2)
        d = where(s.rn > 1, div(t, s.rn - 1) * gamma, 0.0)
        c = where(x > p2 + d, x + d, where(x < p2 - d, x - d, p2))
        one = er * c + (1 - er) * p1
        return [er * one + (1 - er) * p2, one, t, d]

    out = s.scan(step, (0.0, 0.0, 0.0, 0.0))
    return out[0], out[3]


@average("Ema")
def AlphaDecreasingExponentialMovingAverage(s, x, n=0):
    return s.smooth(x, s.let(div(2, s.rn)))


@average("Pkama")
def PoweredKaufmanAdaptiveMovingAverage(s, x, n=100, factor=3.0):
    return s.smooth(x, s.let(power(s.er(x, n), factor)), seed=x)


@parts("PoweredKaufmanAdaptiveMovingAverage", "Pkama")
def _pkama_parts(s, x, n, factor):
    return {"Per": power(s.er(x, n), factor), "Pkama": PoweredKaufmanAdaptiveMovingAverage(s, x, n, factor)}


def _hold(s, x, dev):
    """The last value until x leaves it by more than dev."""
    return s.rec(lambda y: where(x > s.first(x, y) + dev, x, where(x < s.first(x, y) - dev, x, s.first(x, y))))


@average("Al")
def AutoLine(s, x, n=500):
    return _hold(s, x, s.sd(x, n))


@average("1lsma", name="1LCLeastSquaresMovingAverage")
def OneLCLeastSquares(s, x, n=14, ma=SMA):
    m = s.ma(ma, x, n)
    return s.let(m + abs_(s.corr(s.i, x, n)) * s.sd(m, n, ma) * 1.7)


@average("3hma", name="3HMA")
def ThreeHull(s, x, n=50, ma=WMA):
    p = length(math.ceil(n / 2))
    a, b, c = (s.ma(ma, x, k) for k in (length(math.ceil(p / 3)), length(math.ceil(p / 2)), p))
    return s.ma(ma, a * 3 - b - c, p)


@average("Jma")
def JsaMovingAverage(s, x, n=14):
    return s.let((x + s.ago(x, n)) / 2)


@average("Jma")
def JurikMovingAverage(s, x, n=7, phase=50.0, pow_=2.0):
    ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100 + 1.5
    b = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    a = b**pow_

    def step(j, e0, e1, e2):
        n0 = x * (1 - a) + e0 * a
        n1 = (x - n0) * (1 - b) + e1 * b
        n2 = (n0 + n1 * ratio - j) * (1 - a) ** 2 + e2 * a**2
        return [n2 + j, n0, n1, n2]

    return s.scan(step, (0.0,) * 4)[0]


@average("Bama")
def BryantAdaptiveMovingAverage(s, x, n=14, most=100, trend=-1.0):
    er = s.er(x, n)
    v = s.let(sq(er - (er * 2 - 1) / 2 * (1 - trend) + 0.5))
    return s.smooth(x, s.let(2 / (mn(div(n + 1 - v, v), most) + 1)))


@average("Wvwma")
def WindowedVolumeWeightedMovingAverage(s, x, n=100):
    w = s.let((1 - abs_(s.i - n / 2) * (2 / n)) * s.volume)
    return s.let(div(s.sum(s.let(x * w), n), s.sum(w, n)))


@average("Qma")
def QuickMovingAverage(s, x, n=14):
    p = length(math.ceil(n / 3))
    return s.fir(x, [j / p if j <= p else (n + 1 - j) / (n + 1 - p) for j in range(1, n + 2)])


@average("Qma")
def QuadraticMovingAverage(s, x, n=14):
    return s.rms(x, n)


@average("Lwma")
def LinearWeightedMovingAverage(s, x, n=14):
    return s.wma(x, n)


def _powers(p):
    return lambda s, x, n: s.fir(x, [(n - j) ** p for j in range(n)])


@average("Pwma")
def ParabolicWeightedMovingAverage(s, x, n=14):
    return _powers(2)(s, x, n)


@average("Cwma")
def CubedWeightedMovingAverage(s, x, n=14):
    return _powers(3)(s, x, n)


@average("Srwma")
def SquareRootWeightedMovingAverage(s, x, n=14):
    return _powers(0.5)(s, x, n)


@average("Swma")
def SineWeightedMovingAverage(s, x, n=14):
    return s.fir(x, [math.sin((j + 1) * PI / (n + 1)) for j in range(n)])


@average("Fwma")
def FibonacciWeightedMovingAverage(s, x, n=14):
    phi = (1 + math.sqrt(5)) / 2
    return s.fir(x, [(phi ** (n - j) - (-1) ** j / phi ** (n - j)) / math.sqrt(5) for j in range(n)])


@average("Fswma")
def FareySequenceWeightedMovingAverage(s, x, n=5):
    # terms of the Farey sequence of order n after its first two, newest row first from the last term back
    a, b, c, d, terms = 0, 1, 1, n, []
    while c <= n:
        k = (n + b) // d
        a, b, c, d = c, d, k * c - a, k * d - b
        terms.insert(0, round(a / b, 3) if b else 0.0)
    return s.fir(x, terms)


@average("Hwma")
def HendersonWeightedMovingAverage(s, x, n=7):
    m = length((n - 1) // 2)
    q = m + 2
    low = 8 * q * (q * q - 1) * (4 * q * q - 1) * (4 * q * q - 9) * (4 * q * q - 25)

    def w(k):
        return 315 * ((m + 1) ** 2 - k * k) * (q * q - k * k) * ((m + 3) ** 2 - k * k) * (3 * q * q - 11 * k * k - 16) / low

    return s.fir(x, [w(j - m) for j in range(n)])


@average("S21ma")
def Spencer21PointMovingAverage(s, x, n=21):
    half = [-1, -3, -5, -5, -2, 6, 18, 33, 47, 57]  # fixed values of Spencer's filter
    return s.fir(x, [*half, 60, *half[::-1]])


@average("S15ma")
def Spencer15PointMovingAverage(s, x, n=15):
    half = [-3, -6, -5, 3, 21, 46, 67]  # fixed values of Spencer's filter
    return s.fir(x, [*half, 74, *half[::-1]])


@average("Swma")
def SymmetricallyWeightedMovingAverage(s, x, n=14):
    top = n // 2 if n // 2 == half_even(n / 2) else n // 2 + 1
    start = n // 2 if n // 2 == half_even(n / 2) else half_even(n / 2)
    w = [0.0] * n
    for j in range(n):
        w[j] = ((j + 1) * n if j < top else 0) + ((n - j) * n if j >= start else 0)
    return s.fir(x, w)


@average("Dswwf")
def DampedSineWaveWeightedFilter(s, x, n=50):
    return s.fir(x, [math.sin(_unit(2 * PI * j / n)) / j for j in range(1, n + 1)])


@average("Sma")
def ShapeshiftingMovingAverage(s, x, n=50):
    return s.fir(x, [1 - 2 * (j / (n - 1)) / ((j / (n - 1)) ** 4 + 1) for j in range(n)])


@average("Rsrma")
def RightSidedRickerMovingAverage(s, x, n=50, width=60.0):
    w, total, out = width / 100 * n, 0.0, []
    for j in range(n):
        total += (1 - (j / w) ** 2) * math.exp(-(j * j) / (2 * w * w))
        out.append(total)
    return s.fir(x, out, total)


@average("Plsma")
def PolynomialLeastSquaresMovingAverage(s, x, n=100):
    def f(u):
        return u * u + sum(math.sin(u * k * PI) / k for k in (1, 2, 3))

    return s.fir(x, [f(j / n) - f((j - 1) / n) for j in range(1, n + 1)], 1.0)


@average("Efirf")
def EhlersFiniteImpulseResponseFilter(s, x, n=7):
    return s.fir(x, [1, 3.5, 4.5, 3, 0.5, -0.5, -1.5])


@average("Ehma")
def EhlersHannMovingAverage(s, x, n=20):
    return s.fir(x, [1 - math.cos(2 * PI * j / (n + 1)) for j in range(1, n + 1)])


@average("Ehma")
def EhlersHammingMovingAverage(s, x, n=20, pedestal=3.0):
    return s.fir(x, [math.sin(pedestal + (PI - 2 * pedestal) * j / (n - 1)) for j in range(n)])


@average("Etma")
def EhlersTriangleMovingAverage(s, x, n=20):
    return s.fir(x, [j if j < n / 2 else n + 1 - j if j > n / 2 else n / 2 for j in range(1, n + 1)])


@average("Smma", name="SharpModifiedMovingAverage")
def SharpModified(s, x, n=14, ma=SMA):
    tilt = s.fir(x, [(n - (1 + 2 * j)) / 2 for j in range(n)], 1.0)
    return s.let(s.ma(ma, x, n) + tilt * (6 / ((n + 1) * n)))


@average("Rma")
def RepulsionMovingAverage(s, x, n=100, ma=SMA):
    return s.let(s.ma(ma, x, 3 * n) + s.ma(ma, x, 2 * n) - s.ma(ma, x, n))


@average("Ssma")
def SlowSmoothedMovingAverage(s, x, n=15, ma=WMA):
    b = length(math.ceil(n / 3))
    return s.ma(ma, s.ma(ma, s.ma(ma, x, length(math.ceil((n - b) / 2))), b), length((n - b) // 2))


@average("He")
def HullEstimate(s, x, n=50):
    k = length(math.ceil(n / 2))
    return s.let(s.wma(x, k) * 3 - s.ema(x, k) * 2)


@average("Mav3")
def MovingAverageV3(s, x, n=14, short=3, ma=EMA):
    r = n / short
    a = r * (n - 1) / (n - r) if n != r else 0
    return s.let(s.ma(ma, x, n) * (1 + a) - s.ma(ma, x, short) * a)


@average("Mhlma")
def MiddleHighLowMovingAverage(s, x, n=14, short=10, ma=EMA):
    return s.ma(ma, (s.max(s.let(x), max(short, 2)) + s.min(s.let(x), max(short, 2))) / 2, n)


@average("Ie2")
def TillsonIE2(s, x, n=15, ma=SMA):
    m = s.ma(ma, x, n)
    r = s.linreg(m, n)
    return s.let((r - s.lag(r, 1) + m + r) / 2)


@average("Vidya")
def VariableIndexDynamicAverage(s, x, n=14, ma=EMA):
    d = s.let(s.change(x))
    up, down = s.sum(s.let(where(d > 0, d, 0.0)), n), s.sum(s.let(where(d < 0, -d, 0.0)), n)
    return s.smooth(x, s.let(abs_(div(up - down, up + down)) * (2 / (n + 1))))


@average("Nma")
def NaturalMovingAverage(s, x, n=40):
    ln = s.let(log(x) * 1000)
    num, den = lit(0.0), lit(0.0)
    for j in range(n):
        oi = abs_(s.lag(ln, j) - s.lag(ln, j + 1))
        num, den = num + oi * (math.sqrt(j + 1) - math.sqrt(j)), den + oi
    r = s.let(div(num, den))
    return s.let(x * r + s.ago(x, 1) * (1 - r))


@average("Swma")
def SelfWeightedMovingAverage(s, x, n=14):
    x = s.let(x)
    return s.weighted(x, lambda j: s.lag(x, n + j), n)


@average("Ef")
def EhlersFilter(s, x, n=15, k=5):
    x = s.let(x)
    return s.weighted(x, lambda j: abs_(s.lag(x, j) - s.lag(x, j + k)), n)


@average("Edcf")
def EhlersDistanceCoefficientFilter(s, x, n=14):
    x = s.let(x)

    def w(j):
        out = lit(0.0)
        for k in range(1, n):
            out = out + sq(s.lag(x, j) - s.lag(x, j + k))
        return s.let(out)

    return s.weighted(x, w, n)


def _distances(s, x, n):
    x = s.let(x)
    out = []
    for j in range(n):
        d = lit(0.0)
        for k in range(n):
            if k != j:
                d = d + abs_(s.lag(x, j) - s.lag(x, k))
        out.append(s.let(d))
    return out


@average("Idwma")
def InverseDistanceWeightedMovingAverage(s, x, n=14):
    d = _distances(s, x, n)
    return s.weighted(x, lambda j: d[j], n)


@average("Dwma")
def DistanceWeightedMovingAverage(s, x, n=14):
    d = _distances(s, x, n)
    return s.weighted(x, lambda j: div(1, d[j]), n)


@average("Hema")
def HoltExponentialMovingAverage(s, x, n=20, trend=20):
    a, g = 2 / (n + 1), 2 / (trend + 1)

    def step(h, b):
        pb = s.first(x, b)
        new = (h + pb) * (1 - a) + x * a
        return [new, pb * (1 - g) + (new - h) * g]

    return s.scan(step, (0.0, 0.0))[0]


@average("Hcf")
def HybridConvolutionFilter(s, x, n=14):
    x = s.let(x)

    def shape(u):
        return 0.5 * (1 - math.cos(_unit(u)))

    parts = [(shape(j / n * PI), shape(j / n * PI) - shape((j - 1) / n)) for j in range(1, n + 1)]
    own = sum(g * d for g, d in parts)
    rest = lit(0.0)
    for j, (g, d) in enumerate(parts):
        rest = rest + s.lag(x, j) * ((1 - g) * d)
    rest = s.let(rest)
    return s.rec(lambda y: s.first(x, y) * own + rest)


@average("Fama")
def EhlersFractalAdaptiveMovingAverage(s, x, n=20):
    h = length(math.ceil(n / 2))
    high, low = s.range_of(x)
    n3 = s.let((s.max(high, n) - s.min(low, n)) / n)
    n1 = s.let((s.max(high, h) - s.min(low, h)) / h)  # the third range comes out as this one too
    dim = where((n1 > 0) & (n3 > 0), (log(n1 * 2) - log(n3)) / math.log(2), 0.0)
    return s.smooth(x, s.let(clamp(exp((dim - 1) * -4.6), 1, 0.01)), seed=x)


@average("Ks")
def KalmanSmoother(s, x, n=200):
    g, v = math.sqrt(n / 10000 * 2), n / 10000

    def step(k, velocity):
        p = s.first(x, k)
        new = velocity + (x - p) * v
        return [p + (x - p) * g + new, new]

    return s.scan(step, (0.0, 0.0))[0]


@average("Vama")
def VolumeAdjustedMovingAverage(s, x, n=14, ma=SMA, factor=0.67):
    r = s.let(div(s.volume, s.ma(ma, s.volume, n) * factor))
    return s.let(div(s.sum(s.let(x * r), n), s.sum(r, n)))


@average("Vwma")
def VolatilityWaveMovingAverage(s, x, n=20, ma=WMA, kf=2.5):
    q = length(math.ceil(math.sqrt(n)))
    pct = s.let(div(s.sd(x, n, ma), x) * 100)
    p = s.let(where(pct >= 0, clamp(sqrt(pct) * kf, 4, 1), 1.0))
    y = s.weighted(x, lambda j: power(float(n - j), p), n)
    a = s.ma(ma, y, q)
    return s.let(a * 2 - s.ma(ma, a, q))


@average("Vama")
def VariableAdaptiveMovingAverage(s, x, n=14, ma=SMA):
    high, low = s.range_of(x)
    c, o, h, l = (s.ma(ma, e, n) for e in (x, s.open, high, low))
    return s.smooth(x, s.let(where((h - l).ne(0), clamp(div(abs_(c - o), h - l), 0.99, 0.01), 0.0)), seed=x)


@average("Vma")
def VariableMovingAverage(s, x, n=6):
    k, d = 1 / n, s.let(s.change(x))
    p, m = s.smooth(mx(d, 0), k), s.smooth(mx(-d, 0), k)
    pi, mi = s.smooth(div(p, p + m), k), s.smooth(div(m, p + m), k)
    i = s.smooth(div(abs_(pi - mi), pi + mi), k)
    h, l = s.max(i, n), s.min(i, n)
    v = s.let(div(i - l, h - l))
    return s.rec(lambda y: v * y * (1 - k) + v * x * k)


@average("Vhma")
def VerticalHorizontalMovingAverage(s, x, n=50):
    x = s.let(x)
    m = max(n, 2)
    v = div(s.max(x, m) - s.min(x, m), s.sum(s.let(abs_(x - s.lag(x, n))), n))
    return s.smooth(x, s.let(sq(s.let(v))))


@average("Crma")
def CompoundRatioMovingAverage(s, x, n=20, ma=WMA):
    # the weight depends on the row and not on the place in the window, so it cancels
    x = s.let(x)
    return s.ma(ma, s.sum(x, n) / n, max(half_even(math.sqrt(n)), 1))


@average("Pkf")
def ParametricKalmanFilter(s, x, n=50):
    # gains from the change of the input against the distance from the estimate n rows ago
    x, last = s.let(x), s.ago(x, 1)
    move = s.let(abs_(s.change(x)))

    def step(*y):
        est, err = y[0], y[n]
        prior = where(s.rn > n, y[n - 1], last)
        mea = abs_(prior - x)
        pe = s.first(move, err)
        kg = div(pe, pe + mea)
        pest = s.first(last, est)
        return [pest + kg * (x - pest), *y[: n - 1], (1 - kg) * move]

    return s.scan(step, (0.0,) * (n + 1))[0]


@average("Rochla")
def RatioOCHLAverager(s, x, n=0):
    high, low = s.range_of(x)
    return s.smooth(x, s.let(mn(div(abs_(x - s.open), high - low), 1)), seed=x)


@average("Rema")
def RegularizedExponentialMovingAverage(s, x, n=14, lam=0.5):
    a = 2 / (n + 1)
    return s.rec2(lambda y, z: (y + (x - y) * a + (y * 2 - z) * lam) / (lam + 1))


@average("Raf")
def RetentionAccelerationFilter(s, x, n=50):
    high, low = s.range_of(x)
    h1, l1, h2, l2 = s.max(high, n), s.min(low, n), s.max(high, 2 * n), s.min(low, 2 * n)
    ar, br = s.let((h1 - l1) * 2), s.let((h2 - l2) * 2)
    k1, k2 = s.let(div(1 - ar, ar)), s.let(div(1 - br, br))
    a = s.let(div(k2, k1))
    r1 = s.let(where(a.ne(0) & (h1 >= 0), sqrt(h1) / 4 * div(a - 1, a) * div(k2, k2 + 1), 0.0))
    r2 = s.let(where(h2 >= 0, sqrt(h2) / 4 * (a - 1) * div(k1, k1 + 1), 0.0))
    f = s.let(mn(div(r2, r1), 1))
    return s.smooth(x, s.let(where(f >= 0, power(mx(f, 0), math.sqrt(n)), 0.0) / n), seed=x)


@average("Rersi")
def ReverseEngineeringRelativeStrengthIndex(s, x, n=14, level=50.0):
    k = 2 / (2 * n)
    last, d = s.ago(x, 1), s.let(s.change(x))
    up = s.rec(lambda y: where(x > last, d * k, 0.0) + s.first(1, y) * (1 - k))
    down = s.rec(lambda y: where(x > last, 0.0, -d * k) + s.first(1, y) * (1 - k))
    v = s.let((down * (level / (100 - level)) - up) * (n - 1))
    return s.let(where(v >= 0, x + v, x + v * ((100 - level) / level)))


@average("Rmta")
def RecursiveMovingTrendAverage(s, x, n=14):
    a = 2 / (n + 1)

    def step(r, b):
        pb = s.first(x, b)
        bot = pb * (1 - a) + x
        return [s.first(x, r) * (1 - a) + (x + bot - pb) * a, bot]

    return s.scan(step, (0.0, 0.0))[0]


@average("Maaq")
def MovingAverageAdaptiveQ(s, x, n=10, fast=0.667, slow=0.0645):
    return s.smooth(x, s.let(sq(s.er(x, n) * fast + slow)), seed=x)


@average("Mdi")
def McGinleyDynamicIndicator(s, x, n=14, k=0.6):
    def step(y):
        p = s.first(x, y)
        r = div(x, p)
        bottom = sq(sq(r)) * (k * n)
        return where(bottom.ne(0), p + div(x - p, mx(bottom, 1)), x)

    return s.rec(step)


@average("Des")
def DoubleExponentialSmoothing(s, x, n=0, alpha=0.01, gamma=0.9):
    return s.rec2(lambda y, z: x * alpha + (y + (y - z) * (gamma * (2 - gamma))) * (1 - alpha))


@average("Mf")
def ModularFilter(s, x, n=200, beta=0.8):
    a = 2 / (n + 1)
    up = s.rec(lambda y: mx(x, x * a + s.first(x, y) * (1 - a)))
    down = s.rec(lambda y: mn(x, x * a + s.first(x, y) * (1 - a)))
    side = s.rec(lambda y: where(x.eq(up), 1.0, where(x.eq(down), 0.0, y)))
    return s.let(side * (up * beta + down * (1 - beta)) + (1 - side) * (down * beta + up * (1 - beta)))


@average("Svama")
def Svama(s, x, n=14):
    return s.smooth(x, s.let(div(s.volume, s.max(s.volume))), seed=x)


@average("Sltsf")
def SettingLessTrendStepFiltering(s, x, n=0):
    def step(b, a, total):
        pb = s.first(x, b)
        d = abs_(x - pb)
        sc = div(d, d + a)
        f = sc * x + (1 - sc) * pb
        t = total + abs_(f - pb)
        band = div(t, s.rn) * (1 + sc)
        return [where(f > pb + band, f, where(f < pb - band, f, pb)), band, t]

    return s.scan(step, (0.0, 0.0, 0.0))[0]


@average("Evwma")
def ElasticVolumeWeightedMovingAverageV1(s, x, n=40, ma=SMA, mult=20.0):
    v = s.let(s.ma(ma, s.volume, n) * mult)
    return s.rec(lambda y: where(v > 0, div((v - s.volume) * s.first(x, y) + s.volume * x, v), 0.0))


@average("Evwma")
def ElasticVolumeWeightedMovingAverageV2(s, x, n=14):
    v = s.sum(s.volume, n)
    return s.rec(lambda y: div((v - s.volume) * y + s.volume * x, v))


@average("Eqma")
def EquityMovingAverage(s, x, n=14, ma=SMA):
    side = s.let(sign(x - s.ma(ma, x, n)))
    d = s.let(s.change(x))
    best, got = s.sum(s.let(d * side)), s.sum(s.let(d * s.lag(side, 1)), n)
    return s.smooth(x, s.let(where(best.ne(0), clamp(div(got, best), 0.99, 0.01), 0.99)), seed=x)


@average("Sfma")
def SequentiallyFilteredMovingAverage(s, x, n=50, ma=SMA):
    m = s.ma(ma, x, n)
    run = s.sum(s.let(sign(m - s.lag(m, 1))), n)
    return s.rec(lambda y: where(abs_(run).eq(n), m, s.first(m, y)))


@average("LinearRegression", name="LinearRegressionValue")
def _linear(s, x, n=14):
    return s.linreg(x, n)


def _two_pole(n, cosine=ROOT2):
    a = math.exp(-_unit(ROOT2 * PI / n))
    b = 2 * a * math.cos(_unit(cosine * PI / n))
    return b, -a * a


@average("E2ssf")
def Ehlers2PoleSuperSmootherFilterV2(s, x, n=10):
    b, c = _two_pole(n)
    u = s.let((x + s.ago(x, 1)) / 2 * (1 - b - c))
    return s.rec2(lambda y, z: u + y * b + z * c)


@average("Essf")
def EhlersSuperSmootherFilter(s, x, n=10):
    return Ehlers2PoleSuperSmootherFilterV2(s, x, n)


@average("Essf")
def Ehlers2PoleSuperSmootherFilterV1(s, x, n=15):
    b, c = _two_pole(n)
    return s.rec2(lambda y, z: where(s.rn <= 3, x, x * (1 - b - c) + y * b + z * c))


@average("E2bf")
def Ehlers2PoleButterworthFilterV1(s, x, n=10):
    b, c = _two_pole(n, ROOT2 * 1.25)
    return s.rec2(lambda y, z: x * (1 - b - c) + y * b + z * c)


@average("E2bf")
def Ehlers2PoleButterworthFilterV2(s, x, n=15):
    b, c = _two_pole(n)
    u = s.let((x + s.ago(x, 1) * 2 + s.ago(x, 3)) * ((1 - b - c) / 4))
    return s.rec2(lambda y, z: where(s.rn <= 3, x, u + y * b + z * c))


def _three_pole(a, b):
    c = a * a
    return b + c, -(c + b * c), c * c


@average("E3ssf")
def Ehlers3PoleSuperSmootherFilter(s, x, n=20):
    arg = _unit(PI / n)
    a = math.exp(-arg)
    p, q, r = _three_pole(a, 2 * a * math.cos(1.738 * arg))
    return s.rec_n(lambda y: where(s.rn <= 4, x, x * (1 - p - q - r) + y[0] * p + y[1] * q + y[2] * r), 3)


@average("E3bf")
def Ehlers3PoleButterworthFilterV1(s, x, n=10):
    a = math.exp(-_unit(PI / n))
    p, q, r = _three_pole(a, 2 * a * math.cos(_unit(1.738 * PI / n)))
    return s.rec_n(lambda y: x * (1 - p - q - r) + y[0] * p + y[1] * q + y[2] * r, 3)


@average("E3bf")
def Ehlers3PoleButterworthFilterV2(s, x, n=15):
    a = math.exp(-_unit(PI / n))
    b = 2 * a * math.cos(_unit(1.738 * PI / n))
    p, q, r = _three_pole(a, b)
    u = s.let((x + (s.ago(x, 1) + s.ago(x, 2)) * 3 + s.ago(x, 3)) * ((1 - b + a * a) * (1 - a * a) / 8))
    return s.rec_n(lambda y: where(s.rn <= 4, x, u + y[0] * p + y[1] * q + y[2] * r), 3)


def _gauss(s, x, n, poles):
    beta = (1 - math.cos(_unit(2 * PI / n))) / (2 ** (1 / poles) - 1)
    a = -beta + math.sqrt(beta * beta + 2 * beta)

    def step(y):
        out = x * a**poles
        for k in range(1, poles + 1):
            out = out + y[k - 1] * (-((-1) ** k) * math.comb(poles, k) * (1 - a) ** k)
        return out

    return s.rec_n(step, poles)


@average("Egf4")
def EhlersGaussianFilter(s, x, n=14):
    return _gauss(s, x, n, 4)


@parts("EhlersGaussianFilter", "Egf4")
def _gauss_parts(s, x, n):
    return {f"Egf{k}": _gauss(s, x, n, k) for k in (1, 2, 3, 4)}


@average("Eaef")
def EhlersAverageErrorFilter(s, x, n=27):
    b, c = _two_pole(n)
    g = 1 - b - c
    last = s.ago(x, 1)

    def step(f, f2, e, e2):
        new = where(s.rn <= 3, x, (x + last) * (0.5 * g) + f * b + f2 * c)
        return [new, f, where(s.rn <= 3, 0.0, (x - new) * g + e * b + e2 * c), e]

    out = s.scan(step, (0.0,) * 4)
    return s.let(out[0] + out[2])


def laguerre(s, x, a, seeded=True):
    """Four Laguerre stages with damping 1 - a."""
    d = 1 - lit(a)

    def step(l0, l1, l2, l3):
        p0, p1, p2, p3 = (s.first(x, v) if seeded else v for v in (l0, l1, l2, l3))
        n0 = x * a + p0 * d
        n1 = p0 - n0 * d + p1 * d
        n2 = p1 - n1 * d + p2 * d
        return [n0, n1, n2, p2 - n2 * d + p3 * d]

    return s.scan(step, (0.0,) * 4)


@average("Elf")
def EhlersLaguerreFilter(s, x, n=0, alpha=0.2):
    a, b, c, d = laguerre(s, x, alpha)
    return s.let((a + b * 2 + c * 2 + d) / 6)


@average("Eli")
def EhlersLeadingIndicator(s, x, n=0, alpha1=0.25, alpha2=0.33):
    u = s.let(x * 2 + s.ago(x, 1) * (alpha1 - 2))
    return s.smooth(s.rec(lambda y: u + y * (1 - alpha1)), alpha2)


@average("Emoef", name="EhlersOptimumEllipticFilter")
def OptimumElliptic(s, x, n=0):
    u = s.let((x + s.ago(x, 2)) * 0.13785 + s.ago(x, 1) * 0.0007)
    return s.rec2(lambda y, z: u + y * 1.2103 - z * 0.4867)


@average("Emoef")
def EhlersModifiedOptimumEllipticFilter(s, x, n=0):
    x = s.let(x)
    p1 = s.let(where(s.rn > 1, s.lag(x, 1), x))
    p2 = s.let(where(s.rn > 2, s.lag(x, 2), p1))
    p3 = s.let(where(s.rn > 3, s.lag(x, 3), p2))
    u = s.let((x * 2 - p1) * 0.13785 + (p1 * 2 - p2) * 0.0007 + (p2 * 2 - p3) * 0.13785)

    def step(y, z):
        m1 = s.first(x, y)
        return u + m1 * 1.2103 - where(s.rn > 2, z, m1) * 0.4867

    return s.rec2(step)


@average("Eiirf")
def EhlersInfiniteImpulseResponseFilter(s, x, n=14):
    a = 2 / (n + 1)
    return s.smooth(x + s.change(x, length(math.ceil(1 / a - 1))), a)


@average("Edsma")
def EhlersDeviationScaledMovingAverage(s, x, n=40, fast=20, ma="Ehlers2PoleSuperSmootherFilterV2"):
    z = s.let(s.change(x, 2))
    f = s.ma(ma, (z + s.lag(z, 1)) / 2, fast)
    dev = s.sd(f, n)
    scaled = s.rec(lambda y: where(dev.ne(0), div(f, dev), y))
    return s.smooth(x, s.let(clamp(abs_(scaled) * (5 / n), 0.99, 0.01)))


@average("Edsss")
def EhlersDeviationScaledSuperSmoother(s, x, n=12, long=50, ma="EhlersHannMovingAverage"):
    f = s.ma(ma, x - s.ago(x, n), math.ceil(n / 1.4))
    r = s.let(div(f, s.rms(f, long)))
    w = s.let(abs_(r) * (ROOT2 * PI / n))
    a = s.let(exp(-w))
    b, c = s.let(a * cos(w) * 2), s.let(-(a * a))
    u = s.let((x + s.ago(x, 1)) / 2 * (1 - b - c))
    return s.rec2(lambda y, z: u + b * y + c * z)


@average("Ezlema")
def EhlersZeroLagExponentialMovingAverage(s, x, n=14, ma=EMA):
    return s.ma(ma, x + s.change(x, length((n - 1) // 2)), n)


@average("Evidya")
def EhlersVariableIndexDynamicAverage(s, x, n=30, fast=9, ma=WMA):
    a, b = s.rms(x - s.ma(ma, x, fast), fast), s.rms(x - s.ma(ma, x, n), n)
    return s.smooth(x, s.let(where(b.ne(0), clamp(div(a * 0.2, b), 0.99, 0.01), 0.0)))


@average("Ekama")
def EhlersKaufmanAdaptiveMovingAverage(s, x, n=20):
    x = s.let(x)
    path = s.sum(s.let(abs_(x - s.lag(x, 1))), n)
    ef = mn(div(abs_(x - s.lag(x, n - 1)), path), 1)
    return s.smooth(x, s.let(sq(s.let(ef * 0.6667 + 0.0645))))


@average("Eapps")
def EhlersAllPassPhaseShifter(s, x, n=20, q=0.5):
    w = 2 * math.cos(2 * PI / n)
    u = s.let((x - s.ago(x, 1) * (w / q) + s.ago(x, 2) * (1 / q) ** 2) * q**2)
    return s.rec2(lambda y, z: u + y * (w * q) - z * q**2)


#: Fixed values of the Chebyshev filters: gain, input tap, two poles, second-stage tap and its poles.
CHEBYSHEV = {
    "Eclpf-2": (0.080778, 1.907, 0.293, 0.063, 0.513, 0.451, 0.481),
    "Eclpf-1": (0.021394, 1.777, 0.731, 0.166, 0.977, 1.008, 0.561),
    "Eclpf0": (0.0095822, 1.572, 1.026, 0.282, 0.356, 1.329, 0.644),
    "Eclpf1": (0.00461, 1.192, 1.281, 0.426, -0.384, 1.565, 0.729),
    "Eclpf2": (0.0026947, 0.681, 1.46, 0.543, -0.966, 1.703, 0.793),
    "Eclpf3": (0.0017362, 0.012, 1.606, 0.65, -1.408, 1.801, 0.848),
    "Eclpf4": (0.0013738, -0.669, 1.716, 0.74, -1.685, 1.866, 0.89),
    "Eclpf5": (0.0010794, -1.226, 1.8, 0.811, -1.842, 1.91, 0.922),
    "Eclpf6": (0.001705, -1.659, 1.873, 0.878, -1.957, 1.946, 0.951),
}


def _chebyshev(s, x, key):
    g, t, p, q, t2, p2, q2 = CHEBYSHEV[key]
    u = s.let((x + s.ago(x, 1) * t + s.ago(x, 2)) * g)
    v = s.rec2(lambda y, z: u + y * p - z * q)
    w = s.let(v + s.lag(v, 1) * t2 + s.lag(v, 2))
    return s.rec2(lambda y, z: w + y * p2 - z * q2)


@indicator()
def EhlersChebyshevLowPassFilter(s):
    out = {key.replace("-", "Minus"): _chebyshev(s, s.x, key) for key in CHEBYSHEV}
    return s.result(out, s.compare(s.x - out["EclpfMinus2"]))


#: As an average it is the line at the lowest setting, whatever the length.
AVERAGES["EhlersChebyshevLowPassFilter"] = lambda s, x, n=0: _chebyshev(s, x, "Eclpf-2")


@average("Ebema")
def EhlersBetterExponentialMovingAverage(s, x, n=20):
    v = math.cos(2 * PI / n) + math.sin(2 * PI / n)
    a = _unit((v - 1) / v) if v else 0.01
    e = s.smooth(x, a)
    return s.let((x + s.ago(x, 1)) / 2 * a + s.lag(e, 1) * (1 - a))


@average("Wrma")
def WellRoundedMovingAverage(s, x, n=14):
    a, k = 2 / (n + 1), _unit(2 / (n + 1))

    def step(y, ye, sy, se, u, v):
        nu, nv = u + sy * a, v + se * a
        ny = (nu + nv) * 0.99 + y * 0.01
        ne = ny * k + ye * (1 - k)
        return [ny, ne, x - ny, x - ne, nu, nv]

    return s.scan(step, (0.0,) * 6)[0]


@average("Afp")
def AtrFilteredExponentialMovingAverage(s, x, n=45, ma=SMA, atr=20, dev=10, back=20, least=5.0):
    v = s.ma(ma, where(x.ne(0), div(s.tr(x), x), s.tr(x)), atr)
    spread = s.let(s.ma(ma, sq(v), dev) - sq(s.sum(v, dev)) / dev**2)
    sd = s.let(sqrt(spread))
    f = mn(div(s.min(sd, back), sd), least)
    return s.smooth(x, s.let(f * (2 / (n + 1))))


@average("Daf")
def DynamicallyAdjustableFilter(s, x, n=14):
    # the spread of the compensated input is taken over the last n rows of the filter's own state
    def step(*y):
        out, k, src, dev = y[0], y[1], list(y[2 : 2 + n - 1]), list(y[1 + n :])
        p = s.first(x, out)
        now = x * 2 - p
        new = p + k * (now - p)
        count = mn(s.rn, n)
        total = now
        for v in src:
            total = total + v
        d = sq(now - div(total, count))
        spread = d
        for v in dev:
            spread = spread + v
        gap = abs_(now - new)
        return [new, where((now - new).ne(0), div(gap, gap + sqrt(div(spread, count)) * n), 0.0), now, *src[:-1], d, *dev[:-1]]

    return s.scan(step, (0.0,) * (2 * n))[0]


@average("Gfe")
def GeneralFilterEstimator(s, x, n=100, beta=5.25, gamma=1.0, zeta=1.0):
    p = math.ceil(n / beta)

    def step(*y):
        b, d = y[:p], y[p:]
        a = x - where(s.rn > p, b[p - 1], x)
        nb = s.first(x, b[0]) + a * (gamma / p)
        c = nb - where(s.rn > p, d[p - 1], nb)
        nd = s.first(x, d[0]) + (a * zeta + c * (1 - zeta)) * (gamma / p)
        return [nb, *b[: p - 1], nd, *d[: p - 1]]

    return s.scan(step, (0.0,) * (2 * p))[p]


@average("IIRLse")
def IIRLeastSquaresEstimate(s, x, n=100):
    a, k = 4 / (n + 2), _unit(2 / (length(math.ceil(n / 2)) + 1))

    def step(y, e):
        # the stored average is the one before, so it never leaves its start
        p = s.first(x, y)
        return [x * a + p - (p * k + e * (1 - k)) * a, e]

    return s.scan(step, (0.0, 0.0))[0]


@average("Frf")
def FallingRisingFilter(s, x, n=14):
    a = 2 / (n + 1)
    last = s.ago(x, 1)
    beta = s.let(where((x > s.max(s.let(last), n)) | (x < s.min(s.let(last), n)), 1.0, a))
    return s.scan(lambda y, e: [y + e * a + beta * e, x - (y + e * a + beta * e)], (0.0, 0.0))[0]


@average("Zllma")
def ZeroLowLagMovingAverage(s, x, n=50, lag=1.4):
    h = length(math.ceil(n / 2))

    def step(*y):
        b, a = y[:h], y[h:]
        na = x * lag + where(s.rn > h, b[h - 1], x) * (1 - lag) + a[0]
        return [(na - a[n - 1]) / n, *b[: h - 1], na, *a[: n - 1]]

    return s.scan(step, (0.0,) * (h + n))[0]


@average("Pclma")
def ParametricCorrectiveLinearMovingAverage(s, x, n=50, alpha=1.0, per=35.0):
    back = s.ago(x, n)

    def ramp(share):
        p = s.rn - share / 100 * n
        w = s.let(where(p >= 0, p, p * alpha))
        return s.let(div(s.sum(s.let(back * w), n), s.sum(w, n)))

    return ramp(per)


@average("LinExt")
def LinearExtrapolation(s, x, n=500):
    a, b = s.ago(x, n), s.ago(x, 2 * n)
    xa, xb = s.ago(s.i, n), s.ago(s.i, 2 * n)
    return s.let(where((xb - xa).ne(0) & (b - a).ne(0), a + div(s.i - xa, xb - xa) * (b - a), a))


def _variable_length(s, x, most, least, ma):
    """(average, its length): the length grows while x is near its mean and shrinks while it is far."""
    m = s.ma(ma, x, most)
    dev = s.sd(m, most, ma)
    near, far = s.let(dev * 0.25), s.let(dev * 1.75)

    def step(y, size):
        p = s.first(most, size)
        new = clamp(where((x >= m - near) & (x <= m + near), p + 1, where((x < m - far) | (x > m + far), p - 1, p)), most, least)
        k = 2 / (new + 1)
        return [x * k + (1 - k) * s.first(x, y), new]

    return s.scan(step, (0.0, 0.0))


@average("Vlma")
def VariableLengthMovingAverage(s, x, n=50, short=5, ma=SMA):
    return _variable_length(s, x, n, short, ma)[0]


@parts("VariableLengthMovingAverage", "Vlma")
def _vlma_parts(s, x, n, short, ma):
    y, size = _variable_length(s, x, n, short, ma)
    return {"Length": size, "Vlma": y}


@average("Uma")
def UltimateMovingAverage(s, x, most=50, least=5, acc=1.0, ma=SMA):
    """Weights fall from the newest row on by a power that money flow sets, over a variable length."""
    y, size = _variable_length(s, s.let(x), most, least, ma)
    size = s.let(floor(clamp(size, most, least)))
    price = s.of("TypicalPrice", y).value
    last, flow = s.lag(price, 1), s.let(price * s.volume)
    up, down = (s.let(where((s.rn > 1) & test, flow, 0.0)) for test in (price > last, price < last))
    gained, lost, num, den = lit(0.0), lit(0.0), lit(0.0), lit(0.0)
    for j in range(most):
        on = size > j
        gained, lost = gained + where(on, s.lag(up, j), 0.0), lost + where(on, s.lag(down, j), 0.0)
    strength = s.let(acc + abs_(rsi_of(s.let(gained), s.let(lost)) * 2 - 100) / 25)
    for j in range(most):
        w = s.let(where(size > j, power(size - j, strength), 0.0))
        num, den = num + s.lag(s.let(x), j) * w, den + w
    return s.let(div(num, den))


#: Fixed values of the Hilbert filter.
HILBERT = (0.0962, 0.5769)


def hilbert(now, two, four, six):
    a, b = HILBERT
    return now * a + two * b - four * b - six * a


def mama(s, x, fast=0.5, slow=0.05):
    """MAMA, FAMA and the quadrature parts they come from, by name."""
    x = s.let(x)
    smooth = s.let((x * 4 + s.lag(x, 1) * 3 + s.lag(x, 2) * 2 + s.lag(x, 3)) / 10)
    raw = s.let(hilbert(smooth, s.lag(smooth, 2), s.lag(smooth, 4), s.lag(smooth, 6)))
    kept = {f"{k}{j}": 0.0 for k in "dqi" for j in range(1, 7)}
    init = dict.fromkeys(("d", "q", "i", "i2", "q2", "re", "im", "period", "sp", "phase", "alpha", "mama", "fama"), 0.0)

    def step(o, n):
        gain = o["period"] * 0.075 + 0.54
        n["d"] = raw * gain
        n["q"] = hilbert(n["d"], o["d1"], o["d3"], o["d5"]) * gain
        n["i"] = o["d2"]
        n["i2"] = (n["i"] - hilbert(n["q"], o["q1"], o["q3"], o["q5"]) * gain) * 0.2 + o["i2"] * 0.8
        n["q2"] = (n["q"] + hilbert(n["i"], o["i1"], o["i3"], o["i5"]) * gain) * 0.2 + o["q2"] * 0.8
        n["re"] = (n["i2"] * o["i2"] + n["q2"] * o["q2"]) * 0.2 + o["re"] * 0.8
        n["im"] = (n["i2"] * o["q2"] - n["q2"] * o["i2"]) * 0.2 + o["im"] * 0.8
        angle = where(n["re"].ne(0), atan(div(n["im"], n["re"])), 0.0)
        raw_period = div(2 * PI, angle)
        limited = where(o["period"].ne(0), clamp(raw_period, o["period"] * 1.5, o["period"] * 0.67), raw_period)
        n["period"] = clamp(limited, 50, 6) * 0.2 + o["period"] * 0.8
        n["sp"] = n["period"] * 0.33 + o["sp"] * 0.67
        n["phase"] = where(n["i"].ne(0), atan(div(n["q"], n["i"])) * (180 / PI), 0.0)
        n["alpha"] = mx(div(fast, mx(o["phase"] - n["phase"], 1)), slow)
        n["mama"] = n["alpha"] * x + (1 - n["alpha"]) * o["mama"]
        n["fama"] = n["alpha"] * 0.5 * n["mama"] + (1 - n["alpha"] * 0.5) * o["fama"]
        for k in "dqi":
            for j in range(6, 1, -1):
                n[f"{k}{j}"] = o[f"{k}{j - 1}"]
            n[f"{k}1"] = o[k]

    # d1 is the value of two rows ago once the row is done, since d itself is the one before
    out = s.machine(init | kept, step)
    return {"Fama": out["fama"], "Mama": out["mama"], "I1": out["i"], "Q1": out["q"], "SmoothPeriod": out["sp"], "Smooth": smooth, "Real": out["re"], "Imag": out["im"], "Period": out["period"]}


@average("Mama")
def EhlersMotherOfAdaptiveMovingAverages(s, x, n=0, fast=0.5, slow=0.05):
    return mama(s, x, fast, slow)["Mama"]


@parts("EhlersMotherOfAdaptiveMovingAverages", "Mama")
def _mama_parts(s, x, n, fast, slow):
    out = mama(s, x, fast, slow)
    return {k: out[k] for k in ("Fama", "Mama", "I1", "Q1", "SmoothPeriod", "Smooth", "Real", "Imag")}


#: An average without an indicator of its own: the slower line of the pair.
AVERAGES["FollowingAdaptiveMovingAverage"] = lambda s, x, n=0: mama(s, x, 0.5, 0.05)["Fama"]
