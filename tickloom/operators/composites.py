"""Oscillators that put other indicators, candles or volume together."""

from __future__ import annotations

import math

from tickloom.functions.expr import E, abs_, acos, atan, clamp, cos, div, floor, lit, log, mn, mx, sign, sin, sq, sqrt, where

from .momentum import against, pct, turned
from .oscillators import two
from .registry import EMA, SMA, WILDER, WMA, Context, indicator
from .volatility import own_slope, plain, signalled

TEMA, ZLTEMA = "TripleExponentialMovingAverage", "ZeroLagTripleExponentialMovingAverage"


def yes(s: Context, test: E) -> E:
    """1 where the test holds, 0 elsewhere."""
    return s.let(where(test, 1.0, 0.0))


def first_of(default, *cases) -> E:
    """The value of the first case (test, value) that holds."""
    out = lit(default)
    for test, value in reversed(cases):
        out = where(test, value, out)
    return out


def chained(s: Context, x: E, ma: str, n: int, times: int) -> list[E]:
    """x averaged once, twice and so on."""
    out = []
    for _ in range(times):
        x = s.ma(ma, x, n)
        out.append(x)
    return out


def nearest(x: E) -> E:
    """Rounding to the nearest whole number, halves to the even one."""
    up = floor(x + 0.5)
    return where((up - x).eq(0.5) & (up / 2).ne(floor(up / 2)), up - 1, up)


def side(x: E, y: E) -> E:
    return where(x > y, 1.0, where(x < y, -1.0, 0.0))


@indicator("Cycle")
def ZeroLagSmoothedCycle(s, n=100):
    half, y = max(2, math.ceil(n / 2)), s.x
    for _ in range(2):
        y = s.let(y - s.linreg(y, n))
        y = s.let(y * 2 - s.linreg(y, n))
    y = s.let(y - s.linreg(y, n))
    lco = s.let(y * 2 - s.linreg(y, n))
    f = s.let(s.avg(s.avg(lco, half), half) * -2)
    return s.result({"Lco": lco, "Filter": f}, s.compare(lco - f), "Filter")


def _power(s, key, y, ma, n):
    y = s.let(y)
    sig = s.ma(ma, y, n)
    return s.result({key: y, "Signal": sig}, s.compare(y - sig, reverse=True))


@indicator("Momentum")
def BearPowerIndicator(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    c, o, p = s.x, s.open, s.lag(s.x, 1)
    y = first_of(
        h - l, (c < o, h - l), (p > o, mx(c - o, h - l)), (c > o, mx(o - l, h - c)), (h - c > c - l, h - l), (h - c < c - l, o - l), (p < o, mx(o - l, h - c))
    )
    return _power(s, "BearPower", y, ma, n)


@indicator("Momentum")
def BullPowerIndicator(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    c, o, p = s.x, s.open, s.lag(s.x, 1)
    y = first_of(
        h - l, (c < o, mx(h - o, c - l)), (p < o, mx(h - p, c - l)), (c > o, mx(o - p, h - l)), (p > o, h - l), (h - c > c - l, h - o), (h - c < c - l, mx(o - c, h - l))
    )
    return _power(s, "BullPower", y, ma, n)


@indicator("Momentum")
def UltimateTraderOscillator(s, ma=WMA, n=10, lb=5, smooth=4, span=2):
    h, l = s.range_of(s.x)
    top, bottom = s.max(h, span), s.min(l, span)
    width, move = s.let(top - bottom), s.let(s.x - s.lag(s.x, 1))
    of_range, of_volume = (s.of("StochasticOscillator", e, ma=ma, n=lb).value for e in (s.tr(), s.volume))
    r = s.let(h - l)
    scores = [
        pct(s.x - s.open, r),
        where(r.eq(0), 0.0, div((s.x - l) * 200, r) - 100),
        where(move.eq(0) | width.eq(0), 0.0, div((s.x - bottom) * 200, width) - 100),
        pct(move, width), sign(move) * of_range, sign(move) * of_volume,
    ]
    bull = bear = lit(0.0)
    for k in map(s.let, scores):
        bull, bear = bull + mx(k, 0), bear - mn(k, 0)
    d = s.let((100 - div(100, 1 + s.let(div(bull, s.let(bear))))) * 2 - 100)
    y = s.ma(ma, s.ma(ma, d, lb), smooth)
    return signalled(s, "Uto", y, ma, smooth)


def _fractal(s, x, up):
    """Whether the value two bars ago stands out, with up to three equal ones before it."""
    p = [s.lag(x, k) for k in range(9)]
    p[8] = where(s.rn > 10, s.lag(x, 8), 0.0)
    top = p[2]
    below = (lambda e: e < top) if up else (lambda e: e > top)
    upto = (lambda e: e <= top) if up else (lambda e: e >= top)
    later = below(p[1]) & below(p[0])
    return yes(
        s,
        (below(p[4]) & below(p[3]) & later)
        | (below(p[5]) & below(p[4]) & p[3].eq(top) & below(p[1]))
        | (below(p[6]) & below(p[5]) & p[4].eq(top) & upto(p[3]) & later)
        | (below(p[7]) & below(p[6]) & p[5].eq(top) & p[4].eq(top) & upto(p[3]) & later)
        | (below(p[8]) & below(p[7]) & p[6].eq(top) & upto(p[5]) & p[4].eq(top) & upto(p[3]) & later),
    )


@indicator("SupportAndResistance")
def WilliamsFractals(s, n=2):
    h, l = s.range_of(s.x)
    shift = n - 2
    return two(s, "UpFractal", "DnFractal", _fractal(s, s.ago(h, shift), True), _fractal(s, s.ago(l, shift), False))


@indicator("Volatility")
def WaddahAttarExplosion(s, fast=20, slow=40, sensitivity=150.0):
    m = [s.of("MovingAverageConvergenceDivergence", s.lag(s.x, k), fast=fast, slow=slow).value for k in range(4)]
    bands = s.of("BollingerBands", m[0], n=fast).outputs
    t1, t2, e = s.let((m[0] - m[1]) * sensitivity), s.let((m[2] - m[3]) * sensitivity), s.let(bands["UpperBand"] - bands["LowerBand"])
    up, down = s.let(mx(t1, 0)), s.let(mx(-t1, 0))
    buy = (up > s.lag(up, 1)) & (up > e) & (e > s.lag(e, 1)) & (up > fast) & (e > fast)
    return s.result({"T1": t1, "T2": t2, "E1": e, "TrendUp": up, "TrendDn": down}, s.when(buy, up < e), None)


@indicator("Momentum")
def KasePeakOscillatorV2(s, ma=SMA, fast=8, slow=65, n1=9, n2=30, n3=50, smooth=3, dev=2.0, sensitivity=40.0):
    h, l = s.range_of(s.x)
    typical = s.ma(ma, s.sd(log(div(s.x, s.lag(s.x, 1))), n1, ma), n2)
    up, down = [lit(0.0)], [lit(0.0)]
    for j in range(fast, slow):
        up.append(log(div(h, s.lag(l, j))) / math.sqrt(j))
        down.append(log(div(s.lag(h, j), l)) / math.sqrt(j))
    x1, x2 = (s.avg(s.let(div(mx(*e), typical)), smooth) for e in (up, down))
    return plain(s, "Kpo", (x1 - x2) * sensitivity)


@indicator("Trend")
def KaufmanBinaryWave(s, n=20, fast=0.6022, slow=0.0645, filter=10.0):
    a = s.smooth(s.x, s.let(sq(s.let(s.er(s.x, n) * fast + slow))), seed=s.x)
    last = s.first(s.x, s.lag(a, 1))
    band = s.let(s.sd(s.let(a - last), n) * (filter / 100))
    low, high = s.last(a, a < last), s.last(a, a > last)
    return plain(s, "Kbw", where(a - low > band, 1.0, where(high - a > band, -1.0, 0.0)))


@indicator("Trend")
def KendallRankCorrelationCoefficient(s, n=20):
    """Pairs of rows that price and its regression line order alike, less those they do not, over all pairs."""
    line, total = s.linreg(s.x, n), lit(0.0)
    for d in range(1, n):
        total = total + s.sum(s.let(sign(line - s.lag(line, d)) * sign(s.x - s.lag(s.x, d))), n - d)
    return own_slope(s, "Krcc", total / (n * (n - 1) / 2))


@indicator("Momentum")
def ValueChartIndicator(s, ma=SMA, n=5):
    span = max(2, math.ceil(n / 5))
    base, height = s.ma(ma, s.mid, n), s.let(s.max(s.high, span) - s.min(s.low, span))
    unit = s.let((height + s.lag(height, 1) + s.lag(height, 2) + s.lag(height, 3) + s.lag(height, 4)) / 5 * 0.2)
    c, o, h, l = (s.let(div(e - base, unit)) for e in (s.close, s.open, s.high, s.low))
    return s.result({"vClose": c, "vOpen": o, "vHigh": h, "vLow": l}, s.crossing(c - s.ma(ma, c, n), c, 4, -4), None)


@indicator("Momentum")
def VervoortSmoothedOscillator(s, n1=18, n2=30, n3=2, smooth=3, mult=2.0):
    r = chained(s, s.close, SMA, n3, 10)
    rainbow = s.let((r[0] * 5 + r[1] * 4 + r[2] * 3 + r[3] * 2 + r[4] + r[5] + r[6] + r[7] + r[8] + r[9]) / 20)
    e = s.ema(rainbow, smooth)
    t = s.ma(TEMA, s.let(e * 2 - s.ema(e, smooth)), smooth)
    dev = s.sd(t, n1)
    b = s.let(div(t + dev * mult - s.wma(t, n1), dev * (200 * mult)))
    mean = s.let((rainbow + s.typical) / 2)
    lowest, highest = s.min(s.low, n2), s.max(s.high, n2)
    k = s.avg(s.let(clamp(div((mean - lowest) * 100, highest - s.min(mean, n2)), 100, 0)), smooth)
    grows, b_grows = k > s.lag(k, 1), b > s.lag(b, 1)
    return s.result({"Vso": b, "Sk": k}, s.when(grows & b_grows, (k < s.lag(k, 1)) & (b < s.lag(b, 1))))


def _heiken_ashi(s):
    """(open, close) of smoothed candles of the full typical price."""
    x = s.let(s.full)
    o = s.rec(lambda y: (s.lag(x, 1) + y) / 2)
    return o, s.let((x + o + mx(s.high, o) + mn(s.low, o)) / 4)


def _turns(s, key, up, down):
    """1 from where an uptrend takes over, -1 from where a downtrend does."""
    rise, fall = down.eq(0) & s.lag(down, 1).ne(0) & up.ne(0), up.eq(0) & s.lag(up, 1).ne(0) & down.ne(0)
    return plain(s, key, s.rec(lambda y: where(rise, 1.0, where(fall, -1.0, y))))


def _doubled(s, x, ma, n):
    a = s.ma(ma, x, n)
    return s.let(a * 2 - s.ma(ma, a, n))


@indicator("Trend")
def VervoortHeikenAshiLongTermCandlestickOscillator(s, ma=TEMA, n=55, factor=1.1):
    o, c = _heiken_ashi(s)
    price, mid = _doubled(s, c, ma, n), _doubled(s, s.mid, ma, n)
    was, last = s.lag(c, 1) - s.lag(o, 1), s.lag(s.close, 1)
    short = abs_(s.close - s.open) < (s.high - s.low) * factor
    bull, bear = s.close >= s.open, s.close < s.open
    stay = yes(s, ((c >= o) & (was >= 0)) | (s.close >= c) | (s.high > s.lag(s.high, 1)) | (s.low > s.lag(s.low, 1)) | (mid >= price))
    all_up = yes(s, stay.ne(0) | (s.lag(stay, 1).ne(0) & (bull | (s.close >= last))))
    up = yes(s, all_up.ne(0) | (s.lag(all_up, 1).ne(0) & short & (s.high >= s.lag(s.low, 1))))
    fall = yes(s, ((c < o) & (was < 0)) | (mid < price))
    all_down = yes(s, fall.ne(0) | (s.lag(fall, 1).ne(0) & (bear | (s.close < last))))
    down = yes(s, (all_down.ne(0) | s.lag(all_down, 1).ne(0)) & short & (s.low <= s.lag(s.high, 1)))
    return _turns(s, "Vhaltco", up, down)


@indicator("Trend")
def VervoortHeikenAshiCandlestickOscillator(s, ma=ZLTEMA, n=34):
    o, c = _heiken_ashi(s)
    gap = s.let(_doubled(s, s.mid, ma, n) - _doubled(s, c, ma, n))
    was, last = s.lag(c, 1) - s.lag(o, 1), s.lag(s.close, 1)
    short = abs_(s.close - s.open) < (s.high - s.low) * 0.35

    def trend(stay, candle, small):
        stay = yes(s, stay)
        whole = yes(s, (stay.ne(0) | s.lag(stay, 1).ne(0)) & candle)
        return yes(s, whole.ne(0) | (s.lag(whole, 1).ne(0) & short & small))

    down = trend(((c < o) & (was < 0)) | (gap < 0), (s.close < s.open) | (s.close < last), s.low <= s.lag(s.high, 1))
    up = trend(((c >= o) & (was >= 0)) | (gap >= 0), (s.close >= s.open) | (s.close >= last), s.high >= s.lag(s.low, 1))
    return _turns(s, "Vhaco", up, down)


@indicator("Trend")
def ChopZone(s, ma=EMA, n1=30, n2=34):
    low, e = s.min(s.low, n1), s.ma(ma, s.close, n2)
    span = s.let(div(25, s.max(s.high, n1) - low) * low)
    p = s.let(s.typical)
    y = s.let(div(s.lag(e, 1) - e, p) * span)
    angle = s.let(nearest(s.let(acos(div(1, sqrt(1 + sq(y)))) * (180 / math.pi))))
    return plain(s, "Cz", where(y > 0, -angle, angle))


def _grade(s, v, level):
    """1 to 3 by how a positive value stands to the one before it and to a level, and -1 to -3 likewise."""
    v, p, level = s.let(v), s.lag(s.let(v), 1), s.let(level)
    mixed = ((v < p) & (v > level)) | ((v > p) & (v < level))
    up = first_of(0.0, ((v < p) & (v < level), 1.0), (mixed, 2.0), ((v > p) & (v > level), 3.0))
    down = first_of(0.0, ((v > p) & (v > level), -1.0), (mixed, -2.0), ((v < p) & (v < level), -3.0))
    return where(v > 0, up, where(v < 0, down, 0.0))


@indicator("Momentum")
def ConfluenceIndicator(s, ma=SMA, n=10):
    st = math.ceil(n * 2 - 1.5)
    it = math.ceil(st * 2 - 1.5)
    lt = math.ceil(it * 2 - 1.5)
    ho, so, io = math.ceil(n / 2 - 0.5), math.ceil(st / 2 - 0.5), math.ceil(it / 2 - 0.5)
    lengths = (n, st, it, lt)
    long = [s.ma(ma, s.close, k) for k in lengths]
    short = [s.ma(ma, s.close, max(2, k - 1)) for k in lengths]
    full = s.ma(ma, s.full, lt - 1)
    level = s.let(long[1] - s.lag(long[0], ho) + long[2] - s.lag(long[1], so) + long[3] - s.lag(long[2], io))
    ahead = []
    for k, a, b in zip(lengths, long, short, strict=True):
        base = full if k == lt else b
        ahead.append(s.let((base * (k - 1) + (a * 2 - s.lag(a, 1)) * k - b * (k - 1)) / k))
    move = s.let(ahead[1] - s.lag(ahead[0], ho) + ahead[2] - s.lag(ahead[1], so) + ahead[3] - s.lag(ahead[2], io))
    wave = lambda v: sin(v * (2 * math.pi / 360)) + cos(v * (2 * math.pi / 360))
    total, other = s.let(wave(ahead[0]) + wave(ahead[1]) + wave(ahead[2])), s.let(wave(long[0]) + wave(long[1]) + wave(long[2]))
    before, average = s.lag(total, so), s.lag(long[0], so)
    against_it = ((total > before) & (long[0] < average)) | ((total < before) & (long[0] > average))
    err = s.let((total - other) * where(against_it, -1.0, 1.0))
    gap = s.let(ahead[0] - ahead[3])
    sum_ = s.let(_grade(s, err, s.avg(err, so)) + _grade(s, move, level) + _grade(s, gap, s.avg(gap, n)))
    alike = ((sum_ > 0) & (gap > 0)) | ((sum_ < 0) & (gap < 0))
    return own_slope(s, "Ci", where(alike, sum_, where(((sum_ > 0) & (gap < 0)) | ((sum_ < 0) & (gap > 0)), sum_ / 10, 0.0)))


@indicator("Momentum")
def ConstanceBrownCompositeIndex(s, ma=SMA, fast=13, slow=33, n1=14, n2=9, smooth=3):
    r = s.rsi(s.x, n1)
    y = s.let(s.lag(r, n2) + s.ma(ma, s.rsi(r, smooth), smooth))
    f, g = s.ma(ma, y, fast), s.ma(ma, y, slow)
    return s.result({"Cbci": y, "FastSignal": f, "SlowSignal": g}, s.both(y - mx(f, g), y - mn(f, g)))


@indicator("Momentum")
def CommoditySelectionIndex(s, ma=WILDER, n=14, point=50.0, margin=3000.0, commission=10.0):
    a = s.atr(n, ma)
    y = s.let(a * s.of("AverageDirectionalIndex", a, ma=ma, n=n).value * (100 * (point / math.sqrt(margin) / (150 + commission))))
    sig = s.avg(y, n)
    return s.result({"Csi": y, "Signal": sig}, s.compare(y - sig, reverse=True))


@indicator("Momentum")
def PivotDetectorOscillator(s, ma=SMA, n1=200, n2=14):
    r, m = s.rsi(s.x, n2, ma), s.ma(ma, s.x, n1)
    return own_slope(s, "Pdo", where(s.x > m, (r - 35) * 2, (r - 20) * 2))


@indicator("Momentum")
def PercentChangeOscillator(s, ma=WMA, n=14):
    base = s.let(s.lag(s.x, 1) - 1)
    return signalled(s, "Pcco", s.rec(lambda y: where(base.ne(0), y + div(s.x, base), 0.0)), ma, n)


@indicator("Momentum")
def PringSpecialK(s, ma=SMA, n1=10, n2=15, n3=20, n4=30, n5=40, n6=50, n7=65, n8=75, n9=100, n10=130, n11=195, n12=265, n13=390, n14=530, smooth=10):
    """Each rate of change reads the one before it."""
    r, y = s.x, lit(0.0)
    spans = ((n1, n1), (n2, n1), (n3, n1), (n4, n2), (n5, n6), (n7, n7), (n8, n8), (n9, n9), (n11, n10), (n12, n10), (n13, n10), (n14, n11))
    for k, (n, m) in enumerate(spans):
        r = s.roc(r, n)
        y = y + s.ma(ma, r, m) * (k % 4 + 1)
    return signalled(s, "PringSpecialK", y, ma, smooth)


@indicator("Trend")
def PolarizedFractalEfficiency(s, ma=EMA, n=9, smooth=5):
    path = s.sum(s.let(sqrt(sq(s.change(s.x)) + 1)), n)
    e = s.let(div(sqrt(sq(s.change(s.x, n)) + 100) * 100, path))
    return plain(s, "Pfe", s.ma(ma, where((s.rn > n) & (s.x > s.lag(s.x, n)), e, -e), smooth))


@indicator("Momentum")
def PriceCycleOscillator(s, ma=SMA, n=22):
    return own_slope(s, "Pco", pct(s.ma(ma, s.close - s.low, n), s.atr(n, ma)))


@indicator("Momentum")
def PhaseChangeIndex(s, ma=SMA, n=35, smooth=3):
    start, move, up, down = s.lag(s.x, n), s.change(s.x, n), lit(0.0), lit(0.0)
    for j in range(n):
        gap = s.let(s.lag(s.x, n - j) - start - move * ((n - j) / (n - 1)))
        up, down = up + mx(gap, 0), down - mn(gap, 0)
    up, down = s.let(up), s.let(down)
    y = s.let(clamp(pct(up, up + down), 100, 0))
    z = s.ma(ma, y, smooth)
    return s.result({"Pci": y, "Signal": z}, s.crossing(z - s.lag(z, 1), z, 80, 20))


@indicator("Trend")
def PeakValleyEstimation(s, ma=SMA, n=500, smooth=100):
    o = s.let(s.x - s.ma(ma, s.x, n))
    p = s.linreg(s.let(abs_(o)), smooth)
    h = s.let(div(p, s.max(p, max(n, 2))))
    last = s.lag(h, 1)
    first = h.eq(1) & last.ne(1)
    a = s.let(where(first, -sign(o), 0.0))
    b = s.let(where((h < 0.8) & (o < 0), 1.0, where(first & (o > 0), -1.0, 0.0)))
    c = s.let(where(last.eq(1) & (h < last) & (o < 0), 1.0, where(first & (o > 0), -1.0, 0.0)))
    return s.result({"Sign1": a, "Sign2": b, "Sign3": c}, s.when(a > 0, a < 0))


@indicator("Momentum")
def TurboTrigger(s, ma=SMA, n=100, smooth=2):
    high, low = s.range_of(s.x)
    c, o, h, l = (s.ma(ma, e, smooth) for e in (s.x, s.open, high, low))
    y = s.ma(ma, (c + o) / 2, n)
    a = s.ma(ma, h - y, n)
    osc = s.ma(ma, a - s.ma(ma, y - l, n), n)
    return s.result({"BullLine": a, "Trigger": osc}, s.compare(osc - a), None)


@indicator("Momentum")
def TotalPowerIndicator(s, ma=EMA, n1=45, n2=10):
    e = s.run("ElderRayIndex", ma=ma, n=n2).outputs
    up, down = s.sum(yes(s, e["BullPower"] > 0), n1), s.sum(yes(s, e["BearPower"] < 0), n1)
    a, b = s.let(up * (100 / n1)), s.let(down * (100 / n1))
    return s.result({"TotalPower": s.let(abs_(up - down) * (100 / n1)), "BullCount": a, "BearCount": b}, s.compare(a - b))


@indicator("Momentum")
def TurboScaler(s, ma=SMA, n=50, alpha=0.5):
    m = s.ma(ma, s.x, n)
    x, y = s.let(s.x * alpha + m * (1 - alpha)), s.let(m * alpha + s.ma(ma, m, n) * (1 - alpha))
    a, b = (s.let(div(v - s.min(e, n), s.max(e, n) - s.min(e, n))) for v, e in ((s.x, x), (m, y)))
    p, q = s.ma(ma, a, n), s.ma(ma, b, n)
    return s.result({"Ts": a, "Trigger": b}, _lagged_compare(s, a - b, p - q))


def _lagged_compare(s, now, before):
    """compare() of a slope with another one of the row before."""
    now, last = s.let(now), s.lag(s.let(before), 1)
    return where((now > 0) & (now > last), "StrongBuy", where((now < 0) & (now < last), "StrongSell", where(now > 0, "Buy", where(now < 0, "Sell", "None"))))


@indicator("Momentum")
def TechnicalRank(s, n1=200, n2=125, n3=50, n4=20, n5=12, n6=26, n7=9, n8=3, n9=14):
    long, mid = s.sma(s.x, n1), s.sma(s.x, n3)
    far = s.roc(mid, n2)
    near = s.roc(far, n4)
    r = s.rsi(near, n9)
    hist = s.of("PercentagePriceOscillator", r, fast=n5, slow=n6, signal=n7).outputs["Histogram"]
    parts = pct(s.x - long, long) * 0.3 + far * 30 + pct(s.x - mid, mid) * 0.15 + near * 15 + s.change(hist, n8) * (5 / n8) + r * 0.05
    return own_slope(s, "Tr", clamp(parts, 100, 0))


@indicator("Momentum")
def TrigonometricOscillator(s, n=200):
    y = s.linreg(s.x, n)
    up = s.let(y - s.lag(y, 1))
    u = s.let(where(up > 0, math.pi, where(up < 0, -3 * math.pi, 0.0)))
    return turned(s, "To", atan(s.linreg(u, n)), 1, -1)


@indicator("Momentum")
def TradingMadeMoreSimplerOscillator(s, ma=WMA, n1=14, n2=8, n3=12, smooth=3, threshold=50.0, limit=0.0):
    r = s.rsi(s.x, n1, ma)
    first = s.of("StochasticOscillator", r, ma=ma, n=n2, s1=smooth, s2=smooth)
    second = s.of("StochasticOscillator", first.value, ma=ma, n=n1, s1=smooth, s2=smooth).outputs["FastD"]
    a, b, c = (s.let(e - threshold) for e in (r, first.outputs["FastD"], second))
    up, down = (a > limit) & (b > limit) & (c > limit), (a < limit) & (b < limit) & (c < limit)
    return plain(s, "Tmmso", where(up, c, 0.0) - where(down, c, 0.0))


@indicator("Trend")
def TradersDynamicIndex(s, ma=SMA, n1=13, n2=34, n3=2, n4=7):
    r = s.rsi(s.x, n1, ma)
    m, d = s.ma(ma, r, n2), s.let(s.sd(r, n2, ma) * 1.6185)
    up, down, a, b = s.let(m + d), s.let(m - d), s.ma(ma, r, n3), s.ma(ma, r, n4)
    return s.result({"UpperBand": up, "MiddleBand": s.let((up + down) / 2), "LowerBand": down, "Tdi": a, "Signal": b}, s.bands(a - b, up, down, a), "Tdi")


@indicator("Trend")
def TopsAndBottomsFinder(s, ma=EMA, n=50):
    e = s.ma(ma, s.x, n)
    last = s.lag(e, 1)
    up, down = (s.let(div(e, e + s.sd(s.let(where(test, e, 0.0)), n, ma))) for test in (e > last, e < last))
    o = s.let(where(s.lag(up, 1).eq(1) & up.ne(1), 1.0, where(s.lag(down, 1).eq(1) & down.ne(1), -1.0, 0.0)))
    return s.result({"Tabf": o}, s.when(o > 0, o < 0))


@indicator("Momentum")
def TraderPressureIndex(s, ma=WMA, n1=7, n2=2, smooth=3):
    h, l = s.range_of(s.x)
    width, up, down = s.let(s.max(h, n2) - s.min(l, n2)), s.let(h - s.lag(h, 1)), s.let(l - s.lag(l, 1))
    bulls = s.ma(ma, where(width.ne(0), mn(div(mx(up, 0) + mx(down, 0), width), 1) * 100, 0.0), n1)
    bears = s.ma(ma, where(width.ne(0), mx(div(mn(up, 0) + mn(down, 0), width), -1) * -100, 0.0), n1)
    return plain(s, "Tpx", s.ma(ma, bulls - bears, smooth), Bulls=bulls, Bears=bears)


@indicator("Trend")
def TTMScalperIndicator(s):
    h, l = s.range_of(s.x)
    a, b, c = (s.lag(s.x, k) for k in (1, 2, 3))
    sell, buy = (a < s.x) & ((b < a) | (c < a)), (a > s.x) & ((b > a) | (c > a))

    def step(o, n):
        n["on"] = where(sell, 1.0, where(buy, 0.0, o["on"]))
        n["sbs"] = where(sell & o["on"].eq(0), h, where(buy & o["on"].eq(1), l, o["sbs"]))
        n["side"] = where(sell & o["on"].eq(0), 1.0, where(buy & o["on"].eq(1), -1.0, o["side"]))

    out = s.machine(dict.fromkeys(("on", "sbs", "side"), 0.0), step)
    return s.result({"Sbs": out["sbs"]}, s.compare(out["side"]))


@indicator("Momentum")
def TheRangeIndicator(s, ma=EMA, n=10, smooth=3):
    t, d = s.tr(), s.let(s.change(s.x))
    v = s.let(where(d > 0, div(t, d), t))
    low = s.min(v, n)
    return turned(s, "Tri", s.ma(ma, clamp(div((v - low) * 100, s.max(v, n) - low, (v - low) * 100), 100, 0), n), 80, 20)


@indicator("Trend")
def TimePriceIndicator(s, n=50):
    h, l = s.range_of(s.x)
    top, bottom = s.lag(s.max(h, n), 1), s.lag(s.min(l, n), 1)

    def since(test):  # rows since the last one; one more than all of them where there is none
        at = s.let(s.max(s.let(where(test, s.rn, 0.0))))
        return s.let(mn(s.rn - at, n) / n - 0.5)

    upper, lower = since(h > top), since(l < bottom)
    return s.result({"UpperBand": upper, "LowerBand": lower}, s.compare(upper - lower), None)


def _rainbow(s, ma, n1, n2):
    r = chained(s, s.x, ma, n1, 10)
    mean = r[0]
    for e in r[1:]:
        mean = mean + e
    width = s.let(s.max(s.x, n2) - s.min(s.x, n2))
    return r, width, s.let(pct(s.x - mean / 10, width))


@indicator("Momentum")
def RahulMohindarOscillator(s, n1=2, n2=10, n3=30, n4=81):
    _, _, a = _rainbow(s, SMA, n1, n2)
    b = s.ema(a, n3)
    return plain(s, "Rmo", s.ema(a, n4), SwingTrade1=a, SwingTrade2=b, SwingTrade3=s.ema(b, n3))


@indicator("Momentum")
def RainbowOscillator(s, ma=SMA, n1=2, n2=10):
    r, width, y = _rainbow(s, ma, n1, n2)
    band = s.let(pct(mx(*r) - mn(*r), width))
    return plain(s, "Ro", y, UpperBand=band, LowerBand=s.let(-band))


@indicator("Trend")
def RandomWalkIndex(s, ma=WILDER, n=14):
    h, l = s.range_of(s.x)
    unit = s.let(s.atr(n, ma) * math.sqrt(n))
    return two(s, "RwiHigh", "RwiLow", div(h - s.lag(l, n), unit), div(s.lag(h, n) - l, unit))


@indicator("Momentum")
def RecursiveDifferenciator(s, ma=EMA, n=14, alpha=0.6):
    a = s.let(s.rsi(s.ma(ma, s.x, n), n) / 100)
    # the change looks n values of the result back, so the recursion holds that many
    b = s.rec_n(lambda y: a * alpha + (1 - alpha) * s.first(a, y[0] - y[n]), n + 1)
    change = s.let(b - s.lag(b, n))
    return s.result({"Rd": b}, s.compare(change - s.first(a, s.lag(change, 1))))


@indicator("Trend")
def RelativeDifferenceOfSquaresOscillator(s, n=20):
    last = s.lag(s.x, 1)
    up, down, same = (s.sum(yes(s, test), n) for test in (s.x > last, s.x < last, s.x.eq(last)))
    return plain(s, "Rdos", div(sq(up) - sq(down), sq(up + same + down)))


@indicator("Momentum")
def RelativeVigorIndex(s, ma=SMA, n=14):
    h, l = s.range_of(s.x)
    body, tall = s.let(s.x - s.open), s.let(h - s.open)
    top = s.ma(ma, (body + s.lag(body, 1) * 2 + s.lag(body, 2) * 2 + s.lag(body, 3)) / 6, n)
    bottom = s.ma(ma, (h - l + s.lag(tall, 1) * 2 + s.lag(tall, 2) * 2 + s.lag(tall, 3)) / 6, n)
    y = s.let(div(top, bottom))
    sig = s.let((y + s.lag(y, 1) * 2 + s.lag(y, 2) * 2 + s.lag(y, 3)) / 6)
    return s.result({"Rvi": y, "Signal": sig}, s.compare(y - sig))


@indicator("Momentum")
def Repulse(s, ma=EMA, n=5):
    h, l = s.range_of(s.x)
    o, top, bottom = s.lag(s.open, 1), s.max(h, n), s.min(l, n)
    bull, bear = pct(s.x * 3 - bottom * 2 - o, s.x), pct(o + top * 2 - s.x * 3, s.x)
    return signalled(s, "Repulse", s.ma(ma, bull, n * 5) - s.ma(ma, bear, n * 5), ma, n)


@indicator("Trend")
def RetrospectiveCandlestickChart(s, n=100):
    h, l = s.range_of(s.x)
    move = s.let(abs_(s.x - s.lag(s.x, 1)))
    low = s.min(move, n)
    w = s.let(div(move - low, s.max(move, n) - low))
    c = s.smooth(s.x, w, seed=s.x)
    last = s.lag(c, 1)
    k = c
    for e in (h, l, s.open):
        k = k + w * e + (1 - w) * s.first(e, last)
    return own_slope(s, "Rcc", k / 4)


@indicator("Trend")
def RobustWeightingOscillator(s, ma=SMA, n=200):
    """The deviations read the average of the row numbers, and the row numbers."""
    i = s.let(s.i)
    index = s.ma(ma, i, n)
    a = s.let(abs_(s.corr(i, s.x, n)) * div(s.sd(index, n, ma), s.sd(i, n, ma)))
    b = s.let(s.ma(ma, s.x, n) - a * index)
    return own_slope(s, "Rwo", s.ma(ma, s.x - a - b * s.x, n))


@indicator("Volume")
def RSINGIndicator(s, ma=WMA, n=20):
    h, l = s.range_of(s.x)
    y = s.let(div(s.volume, s.ma(ma, s.volume, n)) * div(h - l, s.sd(s.let(h - l), n, ma)) * s.change(s.x, n))
    sig = s.ma(ma, y, n)
    return s.result({"Rsing": y, "Signal": sig}, s.compare(sig - s.lag(sig, 1)))


def _thrust(s, n):
    """(sum of rises, of volumes over them, sum of falls, of volumes over them)."""
    d, last = s.change(s.x), s.lag(s.x, 1)
    up, down = s.sum(s.let(mx(d, 0)), n), s.sum(s.let(mx(-d, 0)), n)
    return up, s.sum(s.let(where(s.x > last, div(s.volume, up), 0.0)), n), down, s.sum(s.let(where(s.x < last, div(s.volume, down), 0.0)), n)


@indicator("Volume")
def MassThrustOscillator(s, ma=EMA, n=14):
    a, b, c, d = _thrust(s, n)
    y = s.let(pct(a * b - c * d, a * b + c * d))
    return against(s, "Mto", y, s.ma(ma, y, n), 50, -50)


@indicator("Volume")
def MassThrustIndicator(s, ma=EMA, n=14):
    a, b, c, d = _thrust(s, n)
    y = s.let((a * b - c * d) / 1000000)
    sig = s.ma(ma, y, n)
    return s.result({"Mti": y, "Signal": sig}, s.compare(sig))


@indicator("Momentum")
def MidpointOscillator(s, ma=EMA, n=26, signal=9):
    h, l = s.range_of(s.x)
    top, bottom = s.max(h, n), s.min(l, n)
    y = s.let(clamp(pct(s.x * 2 - top - bottom, top - bottom), 100, -100))
    return against(s, "Mo", y, s.ma(ma, y, signal), 70, -70)


@indicator("Trend")
def ModifiedGannHiloActivator(s, ma=SMA, n=50, mult=1.0):
    h, l = s.range_of(s.x)
    top, bottom = mx(s.x, s.open), mn(s.x, s.open)
    e = s.ma(ma, top + (s.max(h, n) - top) * mult, n)
    f = s.ma(ma, bottom - (bottom - s.min(l, n)) * mult, n)
    g = s.rec(lambda y: where(s.x > e, 1.0, where(s.x > f, 0.0, y)))
    y = s.let(g * f + (1 - g) * e)
    return s.result({"Ghla": y}, s.compare(s.x - y))


@indicator("Momentum")
def MarketDirectionIndicator(s, fast=13, slow=55):
    last = s.lag(s.x, 1)
    c = s.let((s.sum(s.x, slow - 1) * fast - s.sum(s.x, fast - 1) * slow) / (slow - fast))
    return plain(s, "Mdi", div((s.lag(c, 1) - c) * 200, s.x + last))


@indicator("Volume")
def DemandOscillator(s, ma=EMA, n1=10, n2=2, n3=20):
    h, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    k = s.let(div(s.x * 3, s.ma(ma, s.max(h, n2) - s.min(l, n2), n1)))
    weighed = s.let(div(s.volume, s.let(pct(s.change(s.x), abs_(last)) * k)))
    y = s.ma(ma, where(s.x > last, s.volume - weighed, weighed - s.volume), n3)
    sig = s.ma(ma, y, n1)
    return s.result({"Do": y, "Signal": sig}, s.compare(sig - s.lag(sig, 1)))


@indicator("Momentum")
def DoubleSmoothedMomenta(s, ma=EMA, n1=2, n2=5, n3=25):
    low = s.min(s.x, n1)
    top, bottom = (s.ma(ma, s.ma(ma, e, n2), n3) for e in (s.x - low, s.max(s.x, n1) - low))
    return signalled(s, "Dsm", clamp(pct(top, bottom), 100, 0), ma, n3)


@indicator("Volatility")
def DampingIndex(s, ma=SMA, n=5, threshold=1.5):
    h, l = s.range_of(s.x)
    r = s.ma(ma, h - l, n)
    y = s.let(div(s.lag(r, 1), s.lag(r, 6)))
    return s.result({"Di": y}, s.volatile(s.x - s.ma(ma, s.x, n), y, threshold))


@indicator("Trend")
def DirectionalTrendIndex(s, ma=EMA, n1=14, n2=10, n3=5):
    h, l = s.range_of(s.x)
    d = s.let(mx(h - s.lag(h, 1), 0) + mn(l - s.lag(l, 1), 0))
    a, b = (s.ma(ma, s.ma(ma, s.ma(ma, e, n1), n2), n3) for e in (d, abs_(d)))
    return turned(s, "Dti", clamp(pct(a, b), 100, -100), 25, -25)


@indicator("Momentum")
def DTOscillator(s, ma=WILDER, n1=13, n2=8, n3=5, n4=3):
    w = s.ma(ma, s.x, n1)
    low = s.min(w, n2)
    k = s.avg(s.let(clamp(pct(w - low, s.max(w, n2) - low), 100, 0)), n3)
    d = s.avg(k, n4)
    return s.result({"Dto": k, "Signal": d}, s.crossing(d - s.lag(d, 1), d, 70, 30))


@indicator("Momentum")
def SmoothedDeltaRatioOscillator(s, ma=SMA, n=100):
    a = s.ma(ma, abs_(s.change(s.x, n)), n)
    return turned(s, "Sdro", clamp(div(s.change(s.ma(ma, s.x, n), n), a), 1, 0), 0.8, 0.2)


@indicator("Momentum")
def StrengthOfMovement(s, ma=WMA, n1=10, n2=3, smooth=3):
    k = n2 - 1
    b = s.ma(ma, div(s.change(s.x, k) / k, s.lag(s.x, k)), n1)
    return plain(s, "Som", s.ma(ma, s.of("StochasticOscillator", b, ma=ma, n=n1).value * 2 - 100, smooth))


@indicator("Momentum")
def SentimentZoneOscillator(s, ma=TEMA, fast=14, slow=30, factor=0.95):
    y = s.let(s.ma(ma, where(s.x > s.lag(s.x, 1), 1.0, -1.0), fast) * (100 / fast))
    top, bottom = s.max(y, max(slow, 2)), s.min(y, max(slow, 2))
    width = s.let((top - bottom) * factor)
    return s.result({"Szo": y}, s.crossing(y - s.lag(y, 1), y, bottom + width, top - width, reverse=True))


@indicator("Cycle")
def SimpleCycle(s, n=50):
    k, a, x = min(max(2 / (n + 1), 0.01), 0.99), 1 / n, s.let(s.x)
    then = s.lag(x, n)

    def step(o, new):
        new["e"] = o["c0"] * k + o["e"] * (1 - k)
        old = where(s.rn > n, then + o[f"c{n}"], 0.0)
        new["c0"] = (x + o["c0"] - old) * a + (o["c0"] - new["e"]) * (1 - a)
        for j in range(n, 0, -1):
            new[f"c{j}"] = o[f"c{j - 1}"]

    return own_slope(s, "Sc", s.machine({"e": 0.0} | {f"c{j}": 0.0 for j in range(n + 1)}, step)["c0"])


@indicator("Momentum")
def StiffnessIndicator(s, ma=SMA, n1=100, n2=60, smooth=3, threshold=90.0):
    m = s.ma(ma, s.x, n1)
    y = s.ema(s.sum(yes(s, s.x > m - s.sd(m, n1, ma) * 0.2), n2) * (100 / n2), smooth)
    return s.result({"Si": y}, s.compare(y - threshold))


@indicator("Trend")
def SuperTrendFilter(s, n=200, factor=0.9):
    a = 2 / (n * n + 1)

    def step(o, new):
        last = s.first(s.x, o["tsl"])
        d = abs_(s.x - last)
        new["t"] = d * a + s.first(d, o["t"]) * (1 - a)
        new["src"] = last * factor + s.x * (1 - factor)
        up, down = last - new["t"], last + new["t"]
        new["up"] = where(o["src"] > o["up"], mx(up, o["up"]), up)
        new["down"] = where(o["src"] < o["down"], mn(down, o["down"]), down)
        new["trend"] = where(new["src"] > o["down"], 1.0, where(new["src"] < o["up"], -1.0, s.first(1.0, o["trend"])))
        new["tsl"] = where(new["trend"].eq(1), new["down"], new["up"])

    y = s.machine(dict.fromkeys(("t", "src", "up", "down", "trend", "tsl"), 0.0), step)["tsl"]
    return s.result({"Stf": y}, s.compare(y - s.first(s.x, s.lag(y, 1))))


@indicator("Trend")
def SimpleLines(s, n=10, mult=10.0):
    k = 1 / n

    def step(a, b):
        last = s.first(s.x, a)
        x = s.x + (last - where(s.rn <= 2, s.x, b)) * mult
        last = s.first(x, a)
        return where(x > last + k, last + k, where(x < last - k, last - k, last))

    y = s.rec2(step)
    return s.result({"Sl": y}, s.compare(y - s.first(s.x, s.lag(y, 1))))


@indicator("Volume")
def EnhancedWilliamsR(s, ma=SMA, n=14, signal=5):
    factor, half = 0.25 if n < 10 else n / 32 - 0.0625, max(2, math.ceil(n / 2))
    span, v_span = s.max(s.x, n) - s.min(s.x, n), s.max(s.volume, n) - s.min(s.volume, n)
    w = s.let(div((s.x - s.ma(ma, s.x, half)) * 2, span))
    v = s.let(div((s.volume - s.ma(ma, s.volume, half)) * 2, v_span))
    k, last = s.let(div(s.change(s.x) * 2, span) + factor), s.lag(s.x, 1)
    strong = (v > 0) & (((w > 0) & (s.x > last)) | ((w < 0) & (s.x < last))) & k.ne(0)
    y = s.let(where(strong, div(w * k * v * 50 + k, k), (w * (v + 1) + 2) * 25))
    return against(s, "Ewr", y, s.ma(ma, y, signal), 100, -100)


@indicator("SupportAndResistance")
def EarningSupportResistanceLevels(s):
    p = s.let(s.mid)
    a, b = s.let((s.lag(s.low, 2) + s.high) / 2), s.let((s.lag(p, 2) + p + s.lag(s.close, 1)) / 3)
    return s.result({"Esr": a}, s.both(p - mx(a, b), p - mn(a, b)))


@indicator("Volatility")
def ElderMarketThermometer(s, ma=EMA, n=22):
    h, l = s.range_of(s.x)
    up, down = s.let(h - s.lag(h, 1)), s.let(s.lag(l, 1) - l)
    y = s.let(where((up < 0) & (down < 0), 0.0, where(up > down, abs_(up), abs_(down))))
    sig = s.ma(ma, y, n)
    return s.result({"Emt": y, "Signal": sig}, s.volatile(s.x - s.ma(ma, s.x, n), y, sig))


@indicator("Momentum")
def ErgodicCommoditySelectionIndex(s, ma=WILDER, n=32, smooth=5, point=1.0):
    a, t = s.let(s.run("AverageDirectionalIndex", ma=ma, n=n).value), s.tr()
    k = 100 * (point / math.sqrt(n) / (150 + smooth))
    y = s.let(where(s.x > 0, div(where(t + n > 0, (a + s.lag(a, 1)) * 0.5 * t * (k / n), 0.0), s.x), 0.0))
    sig = s.ma(ma, y, smooth)
    return s.result({"Ecsi": y, "Signal": sig}, s.compare(sig - s.lag(sig, 1)))


@indicator("Trend")
def EfficientAutoLine(s, n=19, fast=0.0001, slow=0.005):
    e = s.er(s.x, n)
    dev = s.let(e * fast + (1 - e) * slow)
    y = s.rec(lambda a: where(s.rn <= 9, s.x, where((s.x > a + dev) | (s.x < a - dev), s.x, a)))
    return s.result({"Eal": y}, s.compare(s.x - y))


@indicator("Trend")
def TechnicalRatings(
    s, ma=EMA, ao1=55, ao2=34, rsi=14, st1=14, st2=3, st3=3, uo1=7, uo2=14, uo3=28, ichi1=9, ichi2=26, ichi3=52, vwma=20, cci=20, adx=14,
    mom=10, macd1=12, macd2=26, macd3=9, power=13, williams=14, n1=10, n2=20, n3=30, n4=50, n5=100, n6=200, hull=9,
):
    """Votes of nine averages and eleven oscillators; most of them read the one before them."""
    r = s.rsi(s.x, rsi)
    ao = s.of("AwesomeOscillator", r, fast=ao1, slow=ao2).value
    m = s.of("MovingAverageConvergenceDivergence", ao, fast=macd1, slow=macd2, signal=macd3)
    uo = s.of("UltimateOscillator", m.value, n1=uo1, n2=uo2, n3=uo3).value
    cloud = s.of("IchimokuCloud", uo, tenkan=ichi1, kijun=ichi2, senkou=ichi3).outputs
    d = s.run("AverageDirectionalIndex", ma=WILDER, n=adx)
    c = s.of("CommodityChannelIndex", d.value, n=cci).value
    elder = s.of("ElderRayIndex", c, n=power).outputs
    h = s.ma("HullMovingAverage", s.x, hull)
    w = s.of("WilliamsR", h, n=williams).value
    v = s.of("VolumeWeightedMovingAverage", w, n=vwma).value
    a = s.of("StochasticOscillator", v, n=st1, s1=st2, s2=st3).outputs
    averages = [s.ma(ma, s.x, n) for n in (n1, n2, n3, n4, n5, n6)]
    mo = s.of("MomentumOscillator", averages[-1], n=mom).value
    b = s.of("StochasticOscillator", r, n=st1, s1=st2, s2=st3).outputs
    last = lambda e: s.lag(s.let(e), 1)

    votes = [side(s.x, e) for e in (*averages, h, v)]
    con, base, one, other = cloud["TenkanSen"], cloud["KijunSen"], cloud["SenkouSpanA"], cloud["SenkouSpanB"]
    up = (one > other) & (s.x > one) & (s.x < base) & (last(s.x) < con) & (s.x > con)
    down = (other > one) & (s.x < other) & (s.x > base) & (last(s.x) > con) & (s.x < con)
    votes.append(where(up, 1.0, where(down, -1.0, 0.0)))
    trend, fall = s.x > averages[3], s.x < averages[3]

    def stochastic(k):
        x, y = k["FastK"], k["FastD"]
        return (x < 20) & (y < 20) & (x > y) & (last(x) < last(y)), (x > 80) & (y > 80) & (x < y) & (last(x) > last(y))

    (low_a, high_a), (low_b, high_b) = stochastic(a), stochastic(b)
    p, q = d.outputs["DiPlus"], d.outputs["DiMinus"]
    a1, a2 = s.lag(ao, 1), s.lag(ao, 2)
    bull, bear = elder["BullPower"], elder["BearPower"]
    cases = [
        ((r < 30) & (last(r) < r), (r > 70) & (last(r) > r)),
        (low_a, high_a),
        ((c < -100) & (c > last(c)), (c > 100) & (c < last(c))),
        ((d.value > 20) & (last(p) < last(q)) & (p > q), (d.value > 20) & (last(p) > last(q)) & (p < q)),
        ((ao > 0) & ((a1 < 0) | ((a1 > 0) & (ao > a1) & (a2 > a1))), (ao < 0) & ((a1 > 0) | ((a1 < 0) & (ao < a1) & (a2 < a1)))),
        (mo > last(mo), mo < last(mo)),
        (m.value > m.outputs["Signal"], m.value < m.outputs["Signal"]),
        (fall & low_b, trend & high_b),
        ((w < -80) & (w > last(w)), (w > -20) & (w < last(w))),
        (trend & (bear < 0) & (bear > last(bear)), fall & (bull > 0) & (bull < last(bull))),
        (uo > 70, uo < 30),
    ]
    total = lambda es: s.let(sum(es[1:], es[0]) / len(es))
    mr, rating = total(votes), total([s.let(where(x, 1.0, where(y, -1.0, 0.0))) for x, y in cases])
    t = s.let((mr + rating) / 2)
    return s.result({"Tr": t, "Or": rating, "Mr": mr}, s.when(t > 0.1, t < -0.1))
