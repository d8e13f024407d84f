"""A symbol against a market: two series side by side."""

from __future__ import annotations

from tickloom.functions.expr import abs_, clamp, col, div, where

from .composites import yes
from .momentum import turned
from .registry import EMA, SMA, indicator
from .volatility import plain

HIGH, LOW, CLOSE = col("market_high"), col("market_low"), col("market_close")


@indicator("Momentum", input="pair")
def ComparePriceMomentumOscillator(s, ma=EMA, n1=20, n2=35, signal=10):
    own, other = (s.of("PriceMomentumOscillator", x, ma=ma, n1=n1, n2=n2, signal=signal).value for x in (s.x, CLOSE))
    return plain(s, "Cpmo", own - other)


@indicator("Momentum", input="pair")
def KaufmanStressIndicator(s, n=60):
    h, l = s.range_of(s.x)
    places = []
    for x, high, low in ((s.x, h, l), (CLOSE, HIGH, LOW)):
        bottom = s.min(low, n)
        places.append(s.let(div(x - bottom, s.max(high, n) - bottom, 50.0)))
    d = s.let(places[0] - places[1])
    low = s.min(d, n)
    return turned(s, "Ksi", clamp(div((d - low) * 100, s.max(d, n) - low, 50.0), 100, 0), 90, 10)


@indicator("Momentum", input="pair")
def RelativeStrength3DIndicator(s, ma=EMA, n1=4, n2=7, n3=10, n4=15, n5=30):
    """How fully four averages of the ratio are stacked, and how often they were."""
    ratio = s.rec(lambda y: where(CLOSE.ne(0), div(s.x, CLOSE) * 100, y))
    fast = s.ma(ma, ratio, n3)
    mid, slow = s.ma(ma, fast, n2), s.ma(ma, fast, n4)
    last = s.ma(ma, slow, n5)
    stacked, turning = slow >= last, mid >= slow
    score = s.let(where(turning, where(fast >= mid, where(stacked, 10.0, 9.0), where(stacked, 9.0, 5.0)), 0.0))
    share = s.let(s.sum(yes(s, score >= 5), n4) * (100 / n4))
    y = s.let(where((score >= 5) | (score > s.ma(ma, score, n1)), share, 0.0))
    was = s.lag(y, 1)
    # the slope before looks at the value of the row before twice
    return s.result({"Rs3d": y}, where((y - was > 0), "StrongBuy", where((y - was < 0), "StrongSell", "None")))


@indicator("Momentum", input="pair")
def RSMKIndicator(s, ma=EMA, n=90, smooth=3):
    ratio = s.let(div(s.x, CLOSE))
    return plain(s, "Rsmk", s.ma(ma, ratio - s.lag(ratio, n), smooth) * 100)


@indicator("Momentum", input="pair")
def SectorRotationModel(s, ma=EMA, n1=25, n2=75):
    """The longer rate of change reads the shorter one."""
    means = []
    for x in (s.x, CLOSE):
        r = s.roc(x, n1)
        means.append((r + s.roc(r, n2)) / 2)
    y = s.let((means[0] - means[1]) * 100)
    sig = s.ma(ma, y, n1)
    return s.result({"Srm": y, "Signal": sig}, s.compare(sig - s.lag(sig, 1)))


@indicator("Volatility", input="pair")
def RelativeNormalizedVolatility(s, ma=SMA, n=14):
    m = s.ma(ma, s.x, n)
    a = s.ma(ma, abs_(div(s.change(s.x), s.sd(m, n, ma))), n)
    b = s.ma(ma, abs_(div(CLOSE - s.lag(CLOSE, 1), s.sd(CLOSE, n, ma))), n)
    y = s.let(div(a, b))
    return s.result({"Rnv": y}, s.volatile(s.x - m, y, 1.0))
