"""Pivot points, from the bar of the period before."""

from __future__ import annotations

from tickloom.functions.expr import div, where

from .registry import SMA, indicator

#: Shares of the range at which the levels lie.
FIBONACCI = (0.382, 0.618033988749894848, 1.0)
CAMARILLA = (0.0916, 0.183, 0.275, 0.55)


def before(s):
    """(open, high, low, close) of the bar before; 0 before the first."""
    h, l = s.range_of(s.x)
    return tuple(s.lag(e, 1) for e in (s.open, h, l, s.x))


def _levels(s, pivot, supports, resistances, pairs, compared=True):
    """Levels and their midpoints; `pairs` names two levels each."""
    out = {"Pivot": s.let(pivot)} | {f"S{k}": s.let(e) for k, e in enumerate(supports, 1)} | {f"R{k}": s.let(e) for k, e in enumerate(resistances, 1)}
    levels = out | {"P": out["Pivot"]}
    out |= {f"M{k}": s.let((levels[a] + levels[b]) / 2) for k, (a, b) in enumerate((p.split() for p in pairs), 1)}
    return s.result(out, s.compare(s.x - out["Pivot"]) if compared else s.both(s.x - out["R1"], s.x - out["S1"]))


SIX = ("S3 S2", "S2 S1", "S1 P", "R1 P", "R2 R1", "R3 R2")


@indicator("SupportAndResistance", input="periods")
def StandardPivotPoints(s):
    o, h, l, c = before(s)
    p = s.let((h + l + c + o) / 4)
    s1, r1 = p * 2 - h, p * 2 - l
    return _levels(s, p, (s1, p - (h - l), p - (r1 - s1)), (r1, p + (h - l), p + (r1 - s1)), SIX)


@indicator("SupportAndResistance", input="periods")
def WoodiePivotPoints(s):
    _, h, l, c = before(s)
    p = s.let((h + l + c * 2) / 4)
    s3, r3 = l - (h - p) * 2, h + (p - l) * 2
    return _levels(s, p, (p * 2 - h, p - (h - l), s3, s3 - (h - l)), (p * 2 - l, p + (h - l), r3, r3 + (h - l)), ("S1 S2", "P S1", "R1 P", "R1 R2"))


@indicator("SupportAndResistance", input="periods")
def FloorPivotPoints(s):
    """Of the period itself, from the second one on."""
    h, l, c = (s.let(where(s.rn > 1, e, 0.0)) for e in (*s.range_of(s.x), s.x))
    p = s.let((h + l + c) / 3)
    s1, r1, width = p * 2 - h, p * 2 - l, h - l
    out = _levels(s, p, (s1, p - width, s1 - width), (r1, p + width, r1 + width), SIX)
    return s.result(out.outputs, s.both(s.x - out.outputs["R1"], s.x - out.outputs["S1"]))


@indicator("SupportAndResistance", input="periods")
def FibonacciPivotPoints(s):
    _, h, l, c = before(s)
    p = s.let((h + l + c) / 3)
    return _levels(s, p, [p - (h - l) * k for k in FIBONACCI], [p + (h - l) * k for k in FIBONACCI], SIX)


@indicator("SupportAndResistance", input="periods")
def CamarillaPivotPoints(s):
    """Levels around the close before; on the first bar around its own."""
    _, h0, l0, c0 = before(s)
    high, low = s.range_of(s.x)
    h, l, c = (s.let(s.first(now, then)) for now, then in ((high, h0), (low, l0), (s.x, c0)))
    r5 = s.let(div(h, l) * c)
    supports = [*(c - (h - l) * k for k in CAMARILLA), c * 2 - r5]
    pairs = ("S3 S2", "S2 S1", "R2 R1", "R3 R2", "R3 R4", "S4 S3")
    out = _levels(s, (h0 + l0 + c0) / 3, supports, [*(c + (h - l) * k for k in CAMARILLA), r5], pairs).outputs
    r1, s1 = out["R1"], out["S1"]
    bull, bear, was, fell = s.let(c - r1), s.let(c - s1), s.let(c0 - s.lag(r1, 1)), s.let(c0 - s.lag(s1, 1))
    signal = where((bull > 0) & (bull > was), "StrongBuy", where((bear < 0) & (bear < fell), "StrongSell", where(bull > 0, "Buy", where(bear < 0, "Sell", "None"))))
    return s.result(out, signal)


@indicator("SupportAndResistance", input="periods")
def PivotPointAverage(s, ma=SMA, n=3):
    _, h, l, c = before(s)
    pivots = [s.let(e) for e in ((h + l + c) / 3, (h + l + c + s.open) / 4, (h + l + s.open) / 3)]
    out = {}
    for k, p in enumerate(pivots, 1):
        out |= {f"Pivot{k}": p, f"Signal{k}": s.ma(ma, p, n)}
    return s.result(out, s.compare(out["Pivot1"] - out["Signal1"]))


@indicator("SupportAndResistance", input="periods")
def DemarkPivotPoints(s):
    o, h, l, c = before(s)
    x = s.let(where(c < o, h + l * 2 + c, where(c > o, h * 2 + l + c, h + l + c * 2)))
    return _levels(s, x / 4, (x / 2 - h,), (x / 2 - l,), ())


@indicator("SupportAndResistance", input="periods")
def DynamicPivotPoints(s):
    _, h, l, c = before(s)
    p = s.let((h + l + c) / 3)
    return _levels(s, p, (p * 2 - h,), (p * 2 - l,), (), compared=False)
