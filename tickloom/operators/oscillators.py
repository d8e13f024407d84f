"""Oscillators."""

from __future__ import annotations

import math

from tickloom.functions.expr import abs_, clamp, div, exp, lit, log, mn, mx, rsi_of, sign, sin, sq, sqrt, where

from .channels import so_far
from .momentum import against, connors, lines, pct, turned
from .registry import EMA, SMA, WILDER, WMA, indicator, length
from .trend import bollinger
from .volatility import flow, mfi, own_slope, plain, signalled

KAMA, TEMA, ZLEMA = "KaufmanAdaptiveMovingAverage", "TripleExponentialMovingAverage", "ZeroLagExponentialMovingAverage"


def two(s, a, b, va, vb):
    """Two lines without a main one, compared with each other."""
    va, vb = s.let(va), s.let(vb)
    return s.result({a: va, b: vb}, s.compare(va - vb), None)


def share(up, down, scale=1.0):
    return div(up * scale, up + down)


def ups(s, x, k=1):
    """(1 where x rose, 1 where it fell)."""
    last = s.lag(s.let(x), k)
    return s.let(where(x > last, 1.0, 0.0)), s.let(where(x < last, 1.0, 0.0))


def cci(s, n, ma=SMA, constant=0.015):
    p = s.run("TypicalPrice").value
    m = s.ma(ma, p, n)
    return s.let(div(p - m, s.ma(ma, abs_(p - m), n) * constant))


@indicator("Momentum")
def CommodityChannelIndex(s, ma=SMA, n=20, constant=0.015):
    return turned(s, "Cci", cci(s, n, ma, constant), 100, -100)


def awesome(s, ma, fast, slow):
    return s.let(s.ma(ma, s.mid, fast) - s.ma(ma, s.mid, slow))


@indicator("Momentum")
def AwesomeOscillator(s, ma=SMA, fast=5, slow=34):
    return plain(s, "Ao", awesome(s, ma, fast, slow))


@indicator("Momentum")
def AcceleratorOscillator(s, ma=SMA, fast=5, slow=34, smooth=5):
    a = awesome(s, ma, fast, slow)
    return plain(s, "Ac", a - s.ma(ma, a, smooth))


@indicator("Volatility")
def UlcerIndex(s, n=14):
    h = s.max(s.x, max(n, 2))
    y = s.rms(pct(s.x - h, h), n)
    return s.result({"Ui": y}, s.compare(y - s.lag(y, 1), True))


@indicator("Momentum")
def BalanceOfPower(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    return signalled(s, "Bop", div(s.x - s.open, h - l), ma, n, "BopSignal")


@indicator("Momentum")
def RateOfChange(s, n=12):
    return own_slope(s, "Roc", s.roc(s.x, n))


@indicator("Volume")
def ChaikinOscillator(s, ma=EMA, fast=3, slow=10):
    a = s.sum(flow(s))
    return plain(s, "ChaikinOsc", s.ma(ma, a, fast) - s.ma(ma, a, slow))


@indicator("Trend")
def IchimokuCloud(s, tenkan=9, kijun=26, senkou=52):
    h, l = s.range_of(s.x)
    t, k, b = (s.let((s.max(h, n) + s.min(l, n)) / 2) for n in (tenkan, kijun, senkou))
    return s.result({"TenkanSen": t, "KijunSen": k, "SenkouSpanA": s.let((t + k) / 2), "SenkouSpanB": b}, s.compare(t - k), None)


def alligator(s, ma):
    return [s.let(s.lag(s.ma(ma, s.x, n), k)) for n, k in ((5, 3), (8, 5), (13, 8))]


@indicator("Trend")
def AlligatorIndex(s, ma=WILDER):
    lips, teeth, jaws = alligator(s, ma)
    return s.result({"Lips": lips, "Teeth": teeth, "Jaws": jaws}, s.both(lips - mx(jaws, teeth), lips - mn(jaws, teeth)), None)


@indicator("Trend")
def GatorOscillator(s, ma=WILDER):
    lips, teeth, jaws = alligator(s, ma)
    return two(s, "Top", "Bottom", abs_(jaws - teeth), -abs_(teeth - lips))


@indicator("Momentum")
def UltimateOscillator(s, n1=7, n2=14, n3=28):
    h, l = s.range_of(s.x)
    last = s.lag(s.x, 1)
    low, high = mn(l, last), mx(h, last)
    b, r = s.let(s.x - low), s.let(high - low)
    a = [div(s.sum(b, n), s.sum(r, n)) for n in (n1, n2, n3)]
    return turned(s, "Uo", clamp((a[0] * 4 + a[1] * 2 + a[2]) * (100 / 7), 100, 0), 70, 30)


@indicator("Trend")
def VortexIndicator(s, n=14):
    h, l = s.range_of(s.x)
    r = s.sum(s.tr(), n)
    return two(s, "ViPlus", "ViMinus", div(s.sum(s.let(abs_(h - s.lag(l, 1))), n), r), div(s.sum(s.let(abs_(l - s.lag(h, 1))), n), r))


@indicator("Momentum")
def Trix(s, ma=EMA, n=15, signal=9):
    e = s.ma(ma, s.ma(ma, s.ma(ma, s.x, n), n), n)
    p = s.lag(e, 1)
    t = s.let(pct(e - p, abs_(p)))
    return s.result({"Trix": t}, s.compare(t - s.ma(ma, t, signal)))


@indicator("Momentum")
def WilliamsR(s, n=14):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    return turned(s, "Williams%R", div((h - s.x) * -100, h - l, -100.0), -20, -80)


def double_smoothed(s, ma, n1, n2, n3=None):
    """Smoothed change over smoothed absolute change, -100 to 100."""
    d = s.let(s.change(s.x))
    out = []
    for e in (d, s.let(abs_(d))):
        for n in (n1, n2, n3):
            e = s.ma(ma, e, n) if n else e
        out.append(e)
    return s.let(clamp(pct(*out), 100, -100))


@indicator("Momentum")
def TrueStrengthIndex(s, ma=EMA, n1=25, n2=13, signal=7):
    t = double_smoothed(s, ma, n1, n2)
    return against(s, "Tsi", t, s.ma(ma, t, signal), 25, -25)


@indicator("Momentum")
def SMIErgodicIndicator(s, ma=EMA, fast=5, slow=20, signal=5):
    t = double_smoothed(s, ma, fast, slow)
    return against(s, "Smi", t, s.ma(ma, t, signal), 10, -10)


@indicator("Momentum")
def ErgodicTrueStrengthIndexV1(s, ma=EMA, n1=4, n2=8, n3=6, signal=3):
    return signalled(s, "Etsi", double_smoothed(s, ma, n1, n2, n3), ma, signal)


@indicator("Momentum")
def ErgodicTrueStrengthIndexV2(s, ma=EMA, n1=21, n2=9, n3=9, n4=17, n5=6, n6=2, signal=2):
    a, b = double_smoothed(s, ma, n1, n2, n3), double_smoothed(s, ma, n4, n5, n6)
    sig = s.ma(ma, b, signal)
    return s.result({"Etsi1": a, "Etsi2": b, "Signal": sig}, s.compare(b - sig), "Etsi2")


@indicator("Momentum")
def ElderRayIndex(s, ma=EMA, n=13):
    h, l = s.range_of(s.x)
    e = s.ma(ma, s.x, n)
    return two(s, "BullPower", "BearPower", h - e, l - e)


@indicator("Trend")
def AbsolutePriceOscillator(s, ma=EMA, fast=10, slow=20):
    return plain(s, "Apo", s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow))


@indicator("Trend")
def AroonOscillator(s, n=25):
    h, l = s.max(s.x, n), s.min(s.x, n)
    up, down = lit(0.0), lit(0.0)
    for j in range(n - 1, -1, -1):  # rows since the extreme: the latest of equal ones counts
        up, down = where((s.rn > j) & s.lag(s.x, j).eq(h), float(j), up), where((s.rn > j) & s.lag(s.x, j).eq(l), float(j), down)
    return plain(s, "Aroon", (down - up) * (100 / n))


@indicator("Trend")
def AbsoluteStrengthIndex(s, n=10, ma_n=21, signal=34):
    last = s.lag(s.x, 1)
    a = s.sum(s.let(where((s.x > last) & last.ne(0), div(s.x, last) - 1, 0.0)))
    m = s.sum(s.let(where(s.x.eq(last), 1 / n, 0.0)))
    d = s.sum(s.let(where(s.x < last, div(last, s.x) - 1, 0.0)))
    half = s.let((d + m) / 2)
    i = s.let(where(half.ne(0), 1 - div(1, 1 + div((a + m) / 2, half)), 1.0))
    o = s.let(i - s.smooth(i, 2 / (ma_n + 1)))
    k = 2 / (signal + 1)
    t = s.smooth(o, k)
    return plain(s, "Asi", o - (t - s.smooth(t, k)) * ((2 - k) / (1 - k)))


@indicator("Trend")
def AccumulativeSwingIndex(s, ma=SMA, n=14):
    h, l = s.range_of(s.x)
    pc, po, ph, pl = s.lag(s.x, 1), s.lag(s.open, 1), s.lag(h, 1), s.lag(l, 1)
    a, b, t, g = s.let(h - pc), s.let(l - pc), s.let(h - l), s.let((pc - po) * 0.25)
    k = mx(abs_(ph - s.x), abs_(pl - s.x))
    r = s.let(where(a > mx(b, t), a - b * 0.5 + g, where(b > mx(a, t), b - a * 0.5 + g, where(t > mx(a, b), t + g, 0.0))))
    y = s.sum(s.let(div((pc - s.x + g * 2 + (s.x - s.open) * 0.25) * 50, r) * div(k, t)))
    return s.result({"Asi": y, "Signal": s.ma(ma, y, n)}, s.compare(y))


@indicator("Momentum")
def AdaptiveErgodicCandlestickOscillator(s, ma=EMA, smooth=5, stoch=14, signal=9):
    h, l = s.range_of(s.x)
    k, start = s.let(abs_(s.stoch(s.x, stoch) - 50) / 50 * (2 / (smooth + 1))), s.rn <= (stoch + smooth) * 2

    def track(e):
        e = s.let(e)
        return s.rec(lambda y: where(start, e, y + k * (e - y)))

    return signalled(s, "Eco", pct(track(track(s.x - s.open)), track(track(h - l))), ma, signal)


@indicator("Trend")
def AbsoluteStrengthMTFIndicator(s, ma=SMA, n=50, smooth=25):
    d = s.let(s.ma(ma, s.x, n) - s.ma(ma, s.lag(s.x, 1), n))
    return two(s, "Bulls", "Bears", s.ma(ma, mx(d, 0), smooth), s.ma(ma, mx(-d, 0), smooth))


@indicator("Trend")
def JapaneseCorrelationCoefficient(s, ma=SMA, n=50):
    k = length(math.ceil(n / 2))
    h, l = s.range_of(s.x)
    c = s.ma(ma, s.x, k)
    return own_slope(s, "Jo", div(c - s.lag(c, n), s.max(s.ma(ma, h, k), k) - s.min(s.ma(ma, l, k), k)))


@indicator("Trend")
def JrcFractalDimension(s, ma=SMA, n1=20, n2=5, smooth=5):
    w1, w2 = length((n2 - 1) * n1), length(n2 * n1)
    h, l = s.range_of(s.x)
    a, b = s.lag(s.x, n1), s.lag(s.x, w2)
    big = mx(b, s.max(h, w2)) - mn(b, s.min(l, w2))
    small = s.let(mx(a, s.max(h, n1)) - mn(a, s.min(l, n1)))
    # the running sum begins with the first range counted twice
    back = s.lag(small, w1)
    total = s.rec(lambda y: s.first(small, y) + small - back)
    y = s.ma(ma, 2 - log(div(big, total / w1)) / math.log(n2), smooth)
    sig = s.ma(ma, y, smooth)
    return s.result({"Jrcfd": y, "Signal": sig}, s.compare(y - sig, True))


def breadth(s, n, scale=1.0):
    u, d = ups(s, s.x)
    return share(s.sum(u, n), s.sum(d, n), scale)


@indicator("Momentum")
def ZweigMarketBreadthIndicator(s, ma=EMA, n=10):
    return turned(s, "Zmbti", s.ma(ma, breadth(s, n), n), 0.615, 0.4)


@indicator("Volume")
def ZDistanceFromVwapIndicator(s, n=20):
    vwap = "VolumeWeightedAveragePrice"
    v = s.ma(vwap, s.x, n)
    return turned(s, "Zscore", div(s.x - v, s.sd(v, n, vwap)), 2, -2)


def zscore(s, n, ma=SMA):
    m = s.ma(ma, s.x, n)
    return s.let(div(s.x - m, s.sd(m, n, ma)))


@indicator("Volatility")
def ZScore(s, ma=SMA, n=14):
    return plain(s, "Zscore", zscore(s, n, ma))


@indicator("Momentum")
def InverseFisherZScore(s, ma=SMA, n=100):
    e = s.let(exp(zscore(s, n, ma) * 2))
    return turned(s, "Ifzs", clamp((div(e - 1, e + 1) + 1) * 50, 100, 0), 80, 20)


@indicator("Momentum")
def InverseFisherFastZScore(s, ma=SMA, n=50):
    k = length(math.ceil(n / 2))
    m = s.ma(ma, s.x, n)
    a, b, d = s.linreg(m, n), s.linreg(m, k), s.sd(m, n, ma)
    e = s.let(exp(div(b - a, d) * 5))
    return own_slope(s, "Iffzs", div(e - 1, e + 1))


@indicator("Momentum")
def BayesianOscillator(s, ma=SMA, n=20, mult=2.5, threshold=15.0):
    u, m, _ = bollinger(s, n, mult, ma)

    def sides(level):
        a, b = s.avg(s.let(where(s.x > level, 1.0, 0.0)), n), s.avg(s.let(where(s.x < level, 1.0, 0.0)), n)
        return s.let(div(a, a + b)), s.let(div(b, a + b))

    def joint(p, q):
        return s.let(where(p.ne(0) & q.ne(0), 1 + (1 - p) * (1 - q), 0.0))

    (au, ad), (bu, bd) = sides(u), sides(m)
    down, up = joint(au, bu), joint(ad, bd)
    p = joint(down, up)
    pp, pu, pd = s.lag(p, 1), s.lag(up, 1), s.lag(down, 1)
    t = threshold / 100
    return s.result({"SigmaProbsDown": down, "SigmaProbsUp": up, "ProbPrime": p}, s.when(((p > t) & pp.eq(0)) | ((up < 1) & pu.eq(1)), (p.eq(0) & (pp > t)) | ((down < 1) & pd.eq(1))), None)


@indicator("Momentum")
def BelkhayateTiming(s):
    h, l = s.range_of(s.x)
    m, r = s.let((h + l) / 2), s.let(h - l)
    # missing rows count as 0, so sums of five are divided by five
    return turned(s, "Belkhayate", div(s.x - s.sum(m, 5) / 5, s.sum(r, 5) / 25), 4, -4)


@indicator("Trend")
def UhlMaCrossoverSystem(s, ma=SMA, n=100):
    m = s.ma(ma, s.x, n)
    v = s.lag(s.sd(m, n, ma), n)

    def track(e):
        def step(y):
            p = s.first(s.x, y)
            g = sq(e - p)
            k = where((v < g) & g.ne(0), 1 - div(v, g), 0.0)
            return k * e + (1 - k) * p

        return s.rec(step)

    return two(s, "Cts", "Cma", track(s.x), track(m))


def mcclellan(s, ma, fast, slow, mult=1000.0):
    u, d = ups(s, s.x)
    a, b = s.sum(u, fast), s.sum(d, fast)
    return a, b, s.let(div((a - b) * mult, a + b))


@indicator("Momentum")
def McClellanOscillator(s, ma=EMA, fast=19, slow=39, signal=9, mult=1000.0):
    a, b, r = mcclellan(s, ma, fast, slow, mult)
    m = lines(s, "Mo", s.ma(ma, r, fast) - s.ma(ma, r, slow), ma, signal)
    return s.result({"AdvSum": a, "DecSum": b} | m.outputs, m.signal, "Mo")


@indicator("Momentum")
def WoodieCommodityChannelIndex(s, ma=SMA, fast=6, slow=14):
    b = s.of("CommodityChannelIndex", s.x, ma=ma, n=slow).value
    a = s.of("CommodityChannelIndex", b, ma=ma, n=fast).value
    h = s.let(a - b)
    return s.result({"FastCci": a, "SlowCci": b, "Histogram": h}, s.compare(h), None)


@indicator("Volume")
def WilliamsAccumulationDistribution(s):
    return plain(s, "Wad", _wad(s))


def _wad(s):
    h, l = s.range_of(s.x)
    last, ph, pl = s.lag(s.x, 1), s.lag(h, 1), s.lag(l, 1)
    return s.rec(lambda y: where(s.x > last, y + s.x - pl, where(s.x < last, y + s.x - ph, 0.0)))


@indicator("Volume")
def SmoothedWilliamsAccumulationDistribution(s, ma=SMA, n=14):
    return signalled(s, "Swad", _wad(s), ma, n)


@indicator("Momentum")
def WamiOscillator(s, ma=EMA, n1=13, n2=4):
    return plain(s, "Wami", s.ma(ma, s.ma(ma, s.wma(s.change(s.x), n2), n1), n1))


@indicator("Momentum")
def QuantitativeQualitativeEstimation(s, ma=EMA, n=14, smooth=5, fast=2.618, slow=4.236):
    r = s.ma(ma, s.rsi(s.x, n, ma), smooth)
    w = 2 * n - 1
    a = s.ma(ma, s.ma(ma, abs_(r - s.lag(r, 1)), w), w)
    f, g = s.let(a * fast), s.let(a * slow)
    return s.result({"FastAtrRsi": f, "SlowAtrRsi": g}, s.both(a - mx(f, g), a - mn(f, g)), None)


@indicator("Trend")
def LBRPaintBars(s, ma=SMA, n=9, back=16, mult=2.5):
    h, l = s.range_of(s.x)
    a = s.let(s.atr(n, ma) * mult)
    u, d = s.let(s.max(h, back) - a), s.let(s.min(l, back) + a)
    return s.result({"UpperBand": u, "MiddleBand": s.let((u + d) / 2), "LowerBand": d}, s.both(s.x - mx(d, u), s.x - mn(d, u)), None)


@indicator("Momentum")
def LogisticCorrelation(s, n=100, k=10.0):
    return own_slope(s, "LogCorr", div(1, exp(abs_(s.corr(s.i, s.x, n)) * -k) + 1))


@indicator("Momentum", name="LindaRaschke3_10Oscillator")
def LindaRaschke(s, ma=SMA, fast=3, slow=10, smooth=16):
    a, b = s.ma(ma, s.x, fast), s.ma(ma, s.x, slow)
    m, p = s.let(a - b), s.let(pct(a - b, b))
    ms, ps = s.ma(ma, m, smooth), s.ma(ma, p, smooth)
    h = s.let(m - ms)
    return s.result({"LindaMacd": m, "LindaMacdSignal": ms, "LindaMacdHistogram": h, "LindaPpo": p, "LindaPpoSignal": ps, "LindaPpoHistogram": s.let(p - ps)}, s.compare(h))


def relative_volatility(s, ma, n, smooth, x=None):
    x = s.x if x is None else x
    d, last = s.sd(x, n, ma), s.lag(x, 1)
    return s.let(rsi_of(s.ma(ma, where(x > last, d, 0.0), smooth), s.ma(ma, where(x < last, d, 0.0), smooth)))


@indicator("Volatility")
def RelativeVolatilityIndexV1(s, ma=WILDER, n=10, smooth=14):
    return turned(s, "Rvi", relative_volatility(s, ma, n, smooth), 70, 30)


def relative_volatility2(s, ma, n, smooth):
    """The mean of the index of the highs and of that of the lows."""
    h, l = s.range_of(s.x)
    return s.let((relative_volatility(s, ma, n, smooth, s.let(h)) + relative_volatility(s, ma, n, smooth, s.let(l))) / 2)


@indicator("Volatility")
def RelativeVolatilityIndexV2(s, ma=WILDER, n=10, smooth=14):
    return turned(s, "Rvi", relative_volatility2(s, ma, n, smooth), 70, 30)


@indicator("Volatility")
def InertiaIndicator(s, n=20):
    return own_slope(s, "Inertia", s.linreg(relative_volatility2(s, WILDER, 10, 14), n))


@indicator("Momentum")
def InternalBarStrengthIndicator(s, n=14, smooth=3):
    h, l = s.range_of(s.x)
    y = s.avg(s.let(pct(s.x - l, h - l)), n)
    return against(s, "Ibs", y, s.smooth(y, 2 / (smooth + 1)), 70, 30)


@indicator("Momentum")
def InsyncIndex(s, ma=SMA, sma=10, divisor=10000.0):
    def level(e, over, under):
        return where(e > over, 5.0, where(e < under, -5.0, 0.0))

    def side(e):
        m = s.avg(s.let(e), sma)
        return where(e - m < 0, where(m < 0, -5.0, 0.0), where(m > 0, 5.0, 0.0))

    def side_up(e):
        m = s.avg(s.let(e), sma)
        return where(e - m > 0, where(m > 0, 5.0, 0.0), where(m < 0, -5.0, 0.0))

    # each part reads the one before it
    rsi = s.rsi(s.x, 14)
    c = s.of("CommodityChannelIndex", rsi, n=14).value
    money = s.of("MoneyFlowIndex", c, n=20).value
    macd = s.of("MovingAverageConvergenceDivergence", money).value
    bb = s.of("BollingerBandsPercentB", macd).value
    dpo = s.of("DetrendedPriceOscillator", bb, n=18).value
    roc = s.roc(dpo, 10)
    k = s.of("StochasticOscillator", roc, n=14, s1=1, s2=3)
    st = k.outputs
    emv = s.of("EaseOfMovement", k.value, n=14, divisor=divisor).value
    y = 50 + level(c, 100, -100) + where(bb < 0.05, -5.0, where(bb > 0.95, 5.0, 0.0)) + level(rsi, 70, 30)
    y = y + level(st["FastD"], 80, 20) + level(st["SlowD"], 80, 20) + level(money, 80, 20) + side(emv) + side(roc) + side(macd)
    y = y + s.lag(s.let(side_up(dpo)), sma) + s.lag(s.let(side(dpo)), sma)
    return turned(s, "Iidx", y, 95, 5)


@indicator("Momentum")
def DetrendedPriceOscillator(s, ma=SMA, n=20):
    return plain(s, "Dpo", s.lag(s.x, length(math.ceil(n / 2 + 1))) - s.ma(ma, s.x, n))


def ln(s):
    return s.let(log(s.x) * 1000)


@indicator("Momentum")
def OceanIndicator(s, ma=EMA, n=14):
    y = s.let((ln(s) - s.lag(ln(s), n)) * (100 / math.sqrt(n)))
    e = s.ma(ma, y, n)
    return s.result({"Oi": y, "Signal": e}, s.compare(e - s.lag(e, 1)))


@indicator("Momentum")
def OscarIndicator(s, n=8):
    r = s.stoch(s.x, n)
    return turned(s, "Oscar", s.rec(lambda y: y / 6 + r / 3), 80, 20)


@indicator("Trend")
def OCHistogram(s, ma=EMA, n=10):
    return plain(s, "OcHistogram", s.ma(ma, s.x, n) - s.ma(ma, s.open, n))


@indicator("Trend")
def OscOscillator(s, ma=SMA, fast=7, slow=14):
    return own_slope(s, "OscOscillator", s.ma(ma, s.x, slow) - s.ma(ma, s.x, fast))


def combined(s, a, b):
    """The signed root of two lines' product, halved where they agree."""
    v = s.let(where(sign(a).ne(sign(b)), a * b, (abs_(a) * b + abs_(b) * a) / 2))
    return s.let(sign(v) * sqrt(abs_(v)))


def _ndx(s, ma, n, smooth):
    v = ln(s)
    total, out, weight = lit(0.0), lit(0.0), 0.0
    for j in range(n):
        total = s.let(total + abs_(s.lag(v, j + 1) - s.lag(v, j)))
        out, weight = out + div(v - s.lag(v, j), total) * (1 / math.sqrt(j + 1)), weight + 1 / math.sqrt(j + 1)
    return s.ma(ma, s.let(out * (100 / weight)), smooth)


def _mirror(s, ma, n):
    v, out = ln(s), lit(0.0)
    for j in range(1, n + 1):
        out = out + (v - s.lag(v, j)) * (100 / math.sqrt(j))
    return s.ma(ma, s.let(out / n), n)


def _river(s, ma, n):
    v, out = ln(s), lit(0.0)
    for j in range(n):
        out = out + (s.lag(v, j + 1) - s.lag(v, j)) * (math.sqrt(j) - math.sqrt(j + 1))
    return s.ma(ma, s.let(out), n)


@indicator("Momentum")
def NaturalDirectionalIndex(s, ma=EMA, n=40, smooth=20):
    return own_slope(s, "Ndx", _ndx(s, ma, n, smooth))


@indicator("Momentum")
def NaturalDirectionalCombo(s, ma=EMA, n=40, smooth=20):
    a = _ndx(s, ma, n, smooth)
    return own_slope(s, "Nxc", combined(s, a, s.of("NaturalStochasticIndicator", a, ma=ma, n=n, smooth=smooth).value))


@indicator("Momentum")
def NaturalMarketMirror(s, ma=EMA, n=40):
    return own_slope(s, "Nmm", _mirror(s, ma, n))


@indicator("Momentum")
def NaturalMarketRiver(s, ma=EMA, n=40):
    return own_slope(s, "Nmr", _river(s, ma, n))


@indicator("Momentum")
def NaturalMarketCombo(s, ma=WMA, n=40, smooth=20):
    a = _river(s, ma, n)
    b = s.of("NaturalMarketMirror", a, ma=ma, n=n).value
    return own_slope(s, "Nmc", s.ma(ma, combined(s, b, a), smooth))


@indicator("Momentum")
def NaturalMarketSlope(s, n=40):
    r = s.linreg(ln(s), n)
    return own_slope(s, "Nms", (r - s.lag(r, 1)) * math.log(n))


@indicator("Cycle")
def NarrowBandpassFilter(s, n=50):
    def w(j):
        u = j / (n - 1)
        return math.sin(2 * math.pi * j / n) * (0.42 - 0.5 * math.cos(2 * math.pi * u) + 0.08 * math.cos(4 * math.pi * u))

    return own_slope(s, "Nbpf", s.fir(s.x, [w(j) for j in range(n)], 1.0))


@indicator("Momentum")
def NthOrderDifferencingOscillator(s, n=14, order=2):
    out, w = lit(0.0), 1.0
    for j in range(order + 1):
        w *= (order - j) / (j + 1)
        out = out + s.lag(s.x, n * (j + 1)) * (w * (1 if (j + 1) % 2 else -1))
    return plain(s, "Nodo", s.x - out)


@indicator("Momentum")
def NormalizedRelativeVigorIndex(s, ma="SymmetricallyWeightedMovingAverage", n=10):
    h, l = s.range_of(s.x)
    return signalled(s, "Nrvi", pct(s.sum(s.ma(ma, s.x - s.open, n), n), s.sum(s.ma(ma, h - l, n), n)), ma, n)


@indicator("Trend")
def GannSwingOscillator(s, n=5):
    r = s.run("GannTrendOscillator", n=n)
    return s.result({"Gso": r.value}, r.signal)


@indicator("Trend")
def GannHiLoActivator(s, ma=SMA, n=3):
    h, l = s.range_of(s.x)
    h, l = s.ma(ma, h, n), s.ma(ma, l, n)
    up, down = s.x > s.lag(h, 1), s.x < s.lag(l, 1)
    y = s.let(s.last(where(up, l, h), up | down))
    return s.result({"Ghla": y}, s.compare(s.x - y))


def _trail(s, a):
    def step(y):
        p = s.first(s.x, y)
        return where(s.x > p, p - a, where(s.x < p, p + a, p))

    return s.rec(step)


@indicator("Trend")
def GroverLlorensCycleOscillator(s, ma=WILDER, n=100, smooth=20, mult=10.0):
    t = _trail(s, s.let(s.atr(n, ma) * mult))
    return turned(s, "Glco", s.rsi(s.ma(ma, s.x - t, smooth), smooth, ma), 80, 20)


@indicator("Trend")
def GroverLlorensActivator(s, ma=WILDER, n=100, mult=5.0):
    a, last = s.let(s.atr(n, ma) * mult), s.lag(s.x, 1)

    def step(o, new):
        p = s.first(s.x, o["ts"])
        p = where(p.eq(0), last, p)
        new["diff"] = s.x - p
        new["ts"] = where(new["diff"] > 0, p - a, where(new["diff"] < 0, p + a, p))

    m = s.machine({"diff": 0.0, "ts": 0.0}, step)
    return s.result({"Gla": m["ts"]}, s.compare(m["diff"]))


FAST = (3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23)  # fixed lengths of the short-term group
SLOW = (25, 28, 31, 34, 37, 40, 43, 46, 49, 52, 55, 58, 61, 64, 67, 70)  # and of the long-term group


@indicator("Trend")
def GuppyMultipleMovingAverage(s, ma=EMA, smooth=1, signal=13):
    f, g = lit(0.0), lit(0.0)
    for n in FAST:
        f = f + s.ma(ma, s.x, n)
    for n in SLOW:
        g = g + s.ma(ma, s.x, n)
    f, g = s.let(f / len(FAST)), s.let(g / len(SLOW))
    r = s.let(pct(f - g, g))
    y, sig = s.avg(r, smooth), s.ma(ma, r, signal)
    return s.result({"SuperGmmaFast": f, "SuperGmmaSlow": g, "SuperGmmaOsc": y, "SuperGmmaSignal": sig}, s.compare(y - sig), "SuperGmmaOsc")


@indicator("Trend")
def GuppyDistanceIndicator(s, ma=EMA):
    f, g = [s.ma(ma, s.x, n) for n in (3, 5, 8, 10, 12, 15)], [s.ma(ma, s.x, n) for n in (30, 35, 40, 45, 11, 60)]

    def gaps(e):
        out, up, down = lit(0.0), lit(1.0).eq(1), lit(1.0).eq(1)
        for a, b in zip(e, e[1:], strict=False):
            out, up, down = out + abs_(a - b), up & (a > b), down & (a < b)
        return s.let(out), up, down

    (a, au, ad), (b, bu, bd) = gaps(f), gaps(g)
    return s.result({"FastDistance": a, "SlowDistance": b}, s.when(bu | au, bd | ad), None)


@indicator("Momentum")
def GOscillator(s, n=14):
    return turned(s, "GOsc", s.sum(s.let(where(s.x > s.lag(s.x, 1), 100 / n, 0.0)), n), 80, 20)


@indicator("Momentum")
def GainLossMovingAverage(s, ma=WILDER, n=14, signal=7):
    y = s.ma(ma, div(s.change(s.x) * 200, s.x + s.lag(s.x, 1)), n)
    sig = s.ma(ma, y, signal)
    return s.result({"Glma": y, "Signal": sig}, s.compare(sig - s.lag(sig, 1)))


@indicator("Trend")
def HighLowIndex(s, ma=EMA, n=10):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    a, b = s.sum(s.let(where(h > s.lag(h, 1), 1.0, 0.0)), n), s.sum(s.let(where(l < s.lag(l, 1), 1.0, 0.0)), n)
    return turned(s, "Zmbti", s.ma(ma, clamp(share(a, b, 100.0), 100, 0), n), 70, 30)


@indicator("Momentum")
def ForecastOscillator(s, ma=SMA, n=3):
    y = s.let(pct(s.change(s.x), s.x))
    sig = s.ma(ma, y, n)
    return s.result({"Fo": y, "Signal": sig}, s.compare(sig))


def kurtosis(s, n, ratio=0.03):
    m = s.let(s.change(s.x, n))
    return s.smooth(m - s.lag(m, 1), ratio)


@indicator("Momentum")
def FastandSlowKurtosisOscillator(s, ma=WMA, n=3, ratio=0.03):
    return signalled(s, "Fsk", kurtosis(s, n, ratio), ma, n)


@indicator("Momentum")
def FastandSlowRelativeStrengthIndexOscillator(s, ma=WMA, n1=3, n2=6, n3=9, n4=6):
    r = s.rsi(s.x, n3, ma)
    k = s.of("FastandSlowKurtosisOscillator", r, ma=ma, n=n1).value
    return signalled(s, "Fsrsi", s.ma(ma, k, n2) * 10000 + r, ma, n4)


@indicator("Momentum")
def FastandSlowStochasticOscillator(s, ma=WMA, n1=3, n2=6, n3=9, n4=9):
    v = s.ma(ma, kurtosis(s, n1), n2)
    k = s.ma(ma, s.stoch(v, n3), n3)
    return signalled(s, "Fsst", v * 500 + k, ma, n4)


@indicator("Momentum")
def FastSlowDegreeOscillator(s, ma=EMA, n=100, fast=3, slow=2, signal=14):
    last = s.lag(s.x, 1)

    def part(k):
        def poly(u):
            return sq(u) + s.sum(s.let(div(sin(u * s.rn * math.pi), s.rn)), k)

        return s.sum(s.let(last * (poly(s.rn / n) - poly(s.i / n))), n)

    return lines(s, "Fsdo", part(fast) - part(slow), ma, signal)


@indicator("Trend")
def FractalChaosOscillator(s):
    b = s.run("FractalChaosBands").outputs
    u, l = b["UpperBand"], b["LowerBand"]
    return plain(s, "Fco", where(u.ne(s.lag(u, 1)), 1.0, where(l.ne(s.lag(l, 1)), -1.0, 0.0)))


@indicator("Momentum")
def FireflyOscillator(s, ma=ZLEMA, n=10, smooth=3):
    h, l = s.range_of(s.x)
    v = s.let((h + l + s.x * 2) / 4)
    m = s.ma(ma, v, n)
    d = s.sd(v, n, ma)
    z = where(d.eq(0), (v - m) * 100, pct(v - m, d))
    w = s.let((s.ma(ma, s.ma(ma, s.ma(ma, z, smooth), smooth), n) + 100) / 2 - 4)
    return s.result({"Fo": w, "Signal": s.max(w, smooth)}, s.crossing(w - s.lag(w, 1), w, 80, 20))


@indicator("Trend")
def FibonacciRetrace(s, ma=WMA, n1=15, n2=50, factor=0.382):
    h, l = s.range_of(s.x)
    h, l, w = s.max(h, n2), s.min(l, n2), s.ma(ma, s.x, n1)
    u, d = s.let(h - (h - l) * factor), s.let(l + (h - l) * factor)
    return s.result({"UpperBand": u, "LowerBand": d}, s.both(w - u, w - d), None)


@indicator("Momentum")
def FXSniperIndicator(s, ma=SMA, n=14, t3=5, b=0.6180339887498949):
    k, e, x = 2 / (1 + 0.5 * (t3 - 1) + 1), [], cci(s, n, ma)
    for _ in range(6):
        x = s.smooth(x, k)
        e.append(x)
    return plain(s, "FXSniper", e[5] * -(b**3) + e[4] * (3 * (b**2 + b**3)) + e[3] * (-3 * (2 * b**2 + b + b**3)) + e[2] * (1 + 3 * b + b**3 + 3 * b**2))


@indicator("Volatility")
def FearAndGreedIndicator(s, ma=WMA, fast=10, slow=30, smooth=2):
    r, last = s.tr(), s.lag(s.x, 1)
    up, down = s.let(where(s.x > last, r, 0.0)), s.let(where(s.x < last, r, 0.0))
    y = s.let(s.ma(ma, up, fast) - s.ma(ma, down, fast) - (s.ma(ma, up, slow) - s.ma(ma, down, slow)))
    sig = s.ma(ma, y, smooth)
    return s.result({"Fgi": y, "Signal": sig}, s.compare(sig))


@indicator("Momentum")
def FunctionToCandles(s, ma=WILDER, n=14):
    h, l = s.range_of(s.x)
    r = [s.rsi(x, n, ma) for x in (s.x, s.open, h, l)]
    t = s.let((r[0] + r[1] + r[2] + r[3]) / 4)
    return s.result({"Close": r[0], "Open": r[1], "High": r[2], "Low": r[3]}, s.compare(t - s.lag(t, 1)), None)


@indicator("Momentum")
def KarobeinOscillator(s, ma=EMA, n=50):
    e = s.ma(ma, s.x, n)
    p = s.lag(e, 1)
    r = s.let(div(e, p))
    a, b = s.ma(ma, where(e < p, r, 0.0), n), s.ma(ma, where(e > p, r, 0.0), n)
    ok = p.ne(0) & e.ne(0)
    c = s.let(where(ok, clamp(div(r, r + b), 1, 0), 0.0))
    return turned(s, "Ko", where(ok, clamp(div(r, r + c * a) * 2 - 1, 1, 0), 0.0), 0.8, 0.2)


def kase_peak(s, n, smooth):
    h, l = s.range_of(s.x)
    a = s.atr(n)
    d = div(h - s.lag(l, n), a) - div(s.lag(h, n) - l, a)
    p = s.wma(d * math.sqrt(n), smooth)
    m = s.sma(p, n)
    return p, m, s.let(s.sd(p, n) * 1.33)


@indicator("Momentum")
def KasePeakOscillatorV1(s, n=30, smooth=3):
    p, m, d = kase_peak(s, n, smooth)
    q = s.lag(p, 1)
    y = s.let(where((q >= 0) & (p > 0), mx(m + d, 2.08), where((q <= 0) & (p < 0), mn(m - d, -1.92), 0.0)))
    return s.result({"Kpo": y, "Pk": p}, s.compare(y))


@indicator("Momentum")
def KaseConvergenceDivergence(s, ma=SMA, n1=30, n2=3, n3=8):
    p = kase_peak(s, n1, n2)[0]
    return plain(s, "Kcd", p - s.ma(ma, p, n3))


@indicator("Momentum")
def KaseSerialDependencyIndex(s, n=14):
    h, l = s.range_of(s.x)
    d = s.sd(div(s.x, s.lag(s.x, 1)), n)
    return two(s, "KsdiUp", "KsdiDn", div(log(div(h, s.lag(l, n))), d), div(log(div(l, s.lag(h, n))), d))


@indicator("Momentum")
def KurtosisIndicator(s, n1=3, n2=1, fast=3, slow=65):
    d = s.let(s.change(s.x, n1))
    f = s.ema(s.change(d, n2), slow)
    sig = s.wma(f, fast)
    return s.result({"Fk": f, "Signal": sig}, s.compare(sig))


@indicator("Trend")
def KaufmanAdaptiveCorrelationOscillator(s, ma=KAMA, n=14):
    m, i = s.ma(ma, s.x, n), s.ma(ma, s.i, n)
    a, b = s.let(sqrt(s.ma(ma, sq(s.i), n) - sq(i))), s.let(sqrt(s.ma(ma, sq(s.x), n) - sq(m)))
    r = s.let(div(s.ma(ma, s.i * s.x, n) - i * m, a * b))
    return s.result({"IndexSt": a, "SrcSt": b, "Kaco": r}, s.crossing(r - s.lag(r, 1), r, 0.5, -0.5), "Kaco")


@indicator("Momentum")
def KnowSureThing(s, ma=SMA, signal=9):
    out, x = lit(0.0), s.x
    for w, (r, n) in enumerate(((10, 10), (15, 10), (20, 10), (30, 15)), 1):
        x = s.roc(x, r)  # each rate is one of the rate before it
        out = out + s.ma(ma, x, n) * w
    return signalled(s, "Kst", out, ma, signal)


@indicator("Momentum")
def KaseIndicator(s, ma=SMA, n=10):
    h, l = s.range_of(s.x)
    v = s.ma(ma, s.volume, n)
    a, r = s.atr(n, ma, v), s.let(v * math.sqrt(n))
    ph, pl = s.lag(h, 1), s.lag(l, 1)
    up, down = (a > 0) & r.ne(0) & l.ne(0), (a > 0) & r.ne(0) & pl.ne(0)
    return two(s, "KaseUp", "KaseDn", s.last(div(div(ph, l), r), up), s.last(div(div(h, pl), r), down))


@indicator("Momentum")
def KwanIndicator(s, ma=WILDER, n=9, smooth=2):
    h, l = s.range_of(s.x)
    h, l = s.max(h, n), s.min(l, n)
    m = pct(s.x, s.lag(s.x, n))
    v = s.let(div(pct(s.x - l, h - l) * s.rsi(s.x, n, ma), m))
    return own_slope(s, "Ki", s.total(s.lag(v, smooth)) / smooth)


@indicator("Momentum")
def VostroIndicator(s, ma=WMA, n1=5, n2=100, level=8.0):
    h, l = s.range_of(s.x)
    w, m, r = s.ma(ma, s.x, n2), s.sum(s.x, n1) * 0.2, s.sum(s.let(h - l), n1) * 0.04
    a, b = s.let(div(h - m, r)), s.let(div(l - m, r))
    y = where((a > level) & (h > w), 90.0, where((b < -level) & (l < w), -90.0, 0.0))
    twice = ((a > level) & (s.lag(a, 1) > level)) | ((b < -level) & (s.lag(b, 1) < -level))
    return turned(s, "Vi", where(twice, 0.0, y), 80, -80)


@indicator("Trend")
def VixTradingSystem(s, ma=SMA, n=50, most=11.0, least=-11.0):
    m = s.ma(ma, s.x, n)
    c = s.rec(lambda y: where((s.x > m) & (y >= 0), y + 1, where((s.x <= m) & (y <= 0), y - 1, y)))
    return s.result({"Vix": c}, s.both(c - most - 1, c - least + 1, True))


@indicator("Momentum")
def VaradiOscillator(s, ma=SMA, n=14):
    h, l = s.range_of(s.x)
    a = s.ma(ma, div(s.x * 2, h + l), n)
    count = lit(0.0)
    for j in range(n):
        count = count + where((s.rn > j) & (s.lag(a, j + 1) <= a), 1.0, 0.0)
    return turned(s, "Vo", clamp(count * (100 / n), 100, 0), 80, 20)


@indicator("Trend")
def VanillaABCDPattern(s):
    a, b, c = (s.lag(s.x, k) for k in (1, 2, 3))
    up, down = (c > b) & (a > b) & (s.x < b), (c < b) & (a < b) & (s.x > b)
    o = s.let(s.last(where(up, 1.0, 0.0), up | down))
    return s.result({"Vabcd": s.let(o - s.lag(o, 1))}, s.compare(o - s.lag(o, 1)))


@indicator("Momentum")
def ChartmillValueIndicator(s, ma=SMA, n=5):
    a, f = s.let(s.atr(n, ma, s.mid) * math.sqrt(n)), s.ma(ma, s.mid, n)
    c, o, h, l = (s.let(where(a.ne(0), clamp(div(e - f, a), 1, -1), 0.0)) for e in (s.close, s.open, s.high, s.low))
    return s.result({"Cmvc": c, "Cmvo": o, "Cmvh": h, "Cmvl": l}, s.crossing(c - s.lag(c, 1), c, 0.5, -0.5), None)


@indicator("Momentum")
def QuasiWhiteNoise(s, ma=WILDER, n=20, noise=500, divisor=40.0):
    c = connors(s, ma, noise, noise, n)[3]
    w = s.let((c - 50) / divisor)
    m = s.ma(ma, w, noise)
    d = s.sd(w, noise, ma)
    return s.result({"WhiteNoise": w, "WhiteNoiseMa": m, "WhiteNoiseStdDev": d, "WhiteNoiseVariance": s.let(sq(d))}, s.crossing(c - s.lag(c, 1), c, 70, 30))


@indicator("Momentum")
def UltimateMomentumIndicator(s, ma=SMA, n1=13, n2=19, n3=21, n4=39, n5=50, mult=1.5):
    """%B reads the oscillator, and each flow what stands before it."""
    a, b, r = mcclellan(s, ma, n2, n4)
    mo = s.let(s.ma(ma, r, n2) - s.ma(ma, r, n4))
    bb = s.of("BollingerBandsPercentB", mo, mult=mult, ma=ma, n=n5).value
    f1 = s.of("MoneyFlowIndex", bb, n=n2).value
    f2 = s.of("MoneyFlowIndex", f1, n=n3).value
    u = s.let(bb * 200 + pct(a, b) + mo * 2 + s.of("MoneyFlowIndex", f2, n=n4).value * 1.5 + f2 * 3 + f1 * 3)
    y = s.ma(ma, s.rsi(u, n1, ma), n1)
    return s.result({"Utm": y}, s.compare(y - s.lag(y, 1)))


# ---- the rest of the alphabet --------------------------------------------------------------------


@indicator("Trend")
def ConditionalAccumulator(s, ma=EMA, n=14, step=1.0):
    h, l = s.range_of(s.x)
    return signalled(s, "Ca", s.sum(s.let(where(l >= s.lag(h, 1), step, where(h <= s.lag(l, 1), -step, 0.0)))), ma, n)


@indicator("Trend")
def ContractHighLow(s):
    h, l = s.range_of(s.x)
    a, b = s.max(h), s.min(l)
    return s.result({"Ch": a, "Cl": b}, s.when(a > s.lag(a, 1), b < s.lag(b, 1)), None)


@indicator("Trend")
def CenterOfLinearity(s, n=14):
    return plain(s, "Col", s.sum(s.let(s.rn * (s.lag(s.x, n) - s.lag(s.x, 1))), n))


@indicator("Volatility")
def ChaikinVolatility(s, ma=EMA, n1=10, n2=12):
    h, l = s.range_of(s.x)
    e = s.ma(ma, h - l, n1)
    p = s.lag(e, n2)
    y = s.let(pct(e - p, p))
    return s.result({"Cv": y}, s.compare(y, True))


@indicator("Momentum")
def CoppockCurve(s, ma=WMA, n=10, fast=11, slow=14):
    a = s.roc(s.x, fast)
    return plain(s, "Cc", s.ma(ma, a + s.roc(a, slow), n))


@indicator("Momentum")
def PriceZoneOscillator(s, ma=EMA, n=20):
    return turned(s, "Pzo", pct(s.ma(ma, sign(s.let(s.x - s.lag(s.x, 1))) * s.x, n), s.ma(ma, s.x, n)), 40, -40)


@indicator("Momentum")
def PerformanceIndex(s, n=14):
    last = s.lag(s.x, n)
    return plain(s, "Kpi", pct(s.change(s.x, n), last))


@indicator("Trend")
def PrettyGoodOscillator(s, ma=SMA, n=14):
    m = s.ma(ma, s.x, n)
    return plain(s, "Pgo", div(s.x - m, s.atr(n, ma, m)))


@indicator("Momentum")
def PsychologicalLine(s, n=20):
    return own_slope(s, "Pl", s.sum(s.let(where(s.x > s.lag(s.x, 1), 1.0, 0.0)), n) * (100 / n))


@indicator("Trend")
def TFSTetherLineIndicator(s, n=50):
    h, l = s.range_of(s.x)
    y = s.let((s.max(h, n) + s.min(l, n)) / 2)
    return s.result({"Tether": y}, s.compare(s.x - y))


@indicator("Trend")
def RangeActionVerificationIndex(s, ma=SMA, fast=7, slow=65):
    b = s.ma(ma, s.x, slow)
    return own_slope(s, "Ravi", pct(s.ma(ma, s.x, fast) - b, b))


@indicator("Momentum")
def RegressionOscillator(s, n=63):
    return plain(s, "Rosc", (div(s.x, s.linreg(s.x, n)) - 1) * 100)


@indicator("Momentum")
def RexOscillator(s, ma=EMA, n=14):
    h, l = s.range_of(s.x)
    y = s.ma(ma, s.x * 3 - l - s.open - h, n)
    return signalled(s, "Ro", y, ma, n)


@indicator("Momentum")
def RunningEquity(s, ma=SMA, n=100):
    d = sign(s.let(s.x - s.ma(ma, s.x, n)))
    return plain(s, "Req", s.sum(s.let(s.change(s.x) * s.lag(s.let(d), 1)), n))


@indicator("Momentum")
def MorphedSineWave(s, n=14, power=100.0):
    return own_slope(s, "Msw", s.x + sin(s.i * (2 * math.pi / n)) / power)


@indicator("Momentum")
def MoveTracker(s):
    m = s.let(s.change(s.x))
    return s.result({"Mt": m, "Signal": s.let(m - s.lag(m, 1))}, s.compare(s.lag(m, 1)))


@indicator("Momentum")
def MultiLevelIndicator(s, n=14, factor=10000.0):
    return turned(s, "Mli", (s.x - s.open - (s.x - s.lag(s.open, n))) * factor, 5, -5)


@indicator("Momentum")
def DeltaMovingAverage(s, ma=SMA, n1=10, n2=5):
    return lines(s, "Delta", s.x - s.lag(s.open, n2), ma, n1)


@indicator("Momentum")
def DidiIndex(s, ma=SMA, n1=3, n2=8, n3=20):
    a, b, c = (s.ma(ma, s.x, n) for n in (n1, n2, n3))
    u, l = s.let(div(a, b)), s.let(div(c, b))
    return s.result({"Curta": u, "Media": b, "Longa": l}, s.compare(u - l), None)


@indicator("Momentum")
def DisparityIndex(s, ma=SMA, n=14):
    m = s.ma(ma, s.x, n)
    return plain(s, "Di", pct(s.x - m, m))


@indicator("Momentum")
def DerivativeOscillator(s, ma=EMA, n1=14, n2=9, n3=5, n4=3):
    y = s.ma(ma, s.ma(ma, s.rsi(s.x, n1, ma), n3), n4)
    return plain(s, "Do", y - s.sma(y, n2))


@indicator("Momentum")
def DecisionPointBreadthSwenlinTradingOscillator(s, ma=EMA, n=5):
    u, d = ups(s, s.x)
    return signalled(s, "Dpbsto", s.ma(ma, s.ma(ma, div((u - d) * 1000, u + d), n), n), ma, n)


@indicator("Momentum")
def SellGravitationIndex(s, ma=EMA, n=20):
    h, l = s.range_of(s.x)
    return signalled(s, "Sgi", s.ma(ma, div(s.x - s.open, h - l), n), ma, n)


@indicator("Momentum")
def SupportAndResistanceOscillator(s):
    h, l = s.range_of(s.x)
    return turned(s, "Sro", div(h - s.open + (s.x - l), s.tr() * 2), 0.7, 0.3)


@indicator("Momentum")
def StationaryExtrapolatedLevelsOscillator(s, ma=SMA, n=200):
    y = s.let(s.x - s.ma(ma, s.x, n))
    return turned(s, "Selo", s.stoch(s.let((s.lag(y, n) * 2 - s.lag(y, n * 2)) / 2), n * 2), 80, 20)


@indicator("Momentum")
def SmoothedRateOfChange(s, ma=EMA, n=21, smooth=13):
    e = s.ma(ma, s.x, smooth)
    p = s.lag(e, n)
    return plain(s, "Sroc", where(p.ne(0), pct(e - p, p), 100.0))


@indicator("Momentum")
def EnhancedIndex(s, ma=SMA, n=14, signal=8):
    h, l = s.range_of(s.x)
    return signalled(s, "Ei", div((s.x - s.ma(ma, s.x, n)) * 2, s.max(h, n) - s.min(l, n)), ma, signal)


@indicator("Momentum")
def ElliottWaveOscillator(s, ma=SMA, fast=5, slow=34):
    return lines(s, "Ewo", s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow), ma, fast)


@indicator("Momentum")
def ErgodicCandlestickOscillator(s, ma=EMA, n1=32, n2=12):
    h, l = s.range_of(s.x)
    a, b = (s.ma(ma, s.ma(ma, e, n1), n2) for e in (s.let(s.x - s.open), s.let(h - l)))
    return signalled(s, "Eco", pct(a, b), ma, n2)


@indicator("Momentum")
def EmaWaveIndicator(s, n1=5, n2=25, n3=50, smooth=4):
    a, b, c = (s.avg(s.let(s.x - s.ema(s.x, n)), smooth) for n in (n1, n2, n3))
    return s.result({"Wa": a, "Wb": b, "Wc": c}, s.when((a > 0) & (b > 0) & (c > 0), (a < 0) & (b < 0) & (c < 0)), None)


@indicator("Momentum")
def ErgodicMeanDeviationIndicator(s, ma=EMA, n1=32, n2=5, n3=5, signal=5):
    return signalled(s, "Emdi", s.ma(ma, s.ma(ma, s.x - s.ma(ma, s.x, n1), n2), n3), ma, signal)


@indicator("Trend")
def EfficientPrice(s, n=50):
    return own_slope(s, "Ep", s.total(s.change(s.x, n) * s.er(s.x, n)))


@indicator("Momentum")
def ReallySimpleIndicator(s, ma=EMA, n=21, smooth=10):
    _, l = s.range_of(s.x)
    return signalled(s, "Rsi", pct(l - s.ma(ma, s.x, n), s.x), ma, smooth)


@indicator("Momentum")
def RelativeSpreadStrength(s, ma=EMA, fast=10, slow=40, n=14, smooth=5):
    return turned(s, "Rss", s.ma(ma, s.rsi(s.ma(ma, s.x, fast) - s.ma(ma, s.x, slow), n), smooth), 80, 20)


@indicator("Volatility")
def MassIndex(s, ma=EMA, n1=21, n2=21, n3=25, signal=9):
    h, l = s.range_of(s.x)
    e = s.ma(ma, h - l, n1)
    return signalled(s, "Mi", s.sum(s.let(div(e, s.ma(ma, e, n2))), n3), ma, signal)


__all__ = ["share", "so_far", "two"]
