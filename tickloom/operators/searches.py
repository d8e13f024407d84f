"""Indicators that search a window: for the densest price, the best lag, a second turning point, a spectrum's peak."""

from __future__ import annotations

import math

from tickloom.functions.expr import E, cos, div, exp, floor, lit, mn, mx, sin, sq, sqrt, where


from .cycles import HANN, _net, median
from .recursions import _bank, _damping, _delta
from .registry import EMA, WMA, indicator
from .volatility import plain

PI, ROOT2 = math.pi, math.sqrt(2)


def _unit(x: float) -> float:
    return min(max(x, 0.01), 0.99)


def _angle(turn: float, cycle: E) -> E:
    """turn / cycle within 0.01 and 0.99; a cycle of 0 counts as the shortest."""
    return where(cycle.eq(0), 0.99, mn(mx(div(turn, cycle), 0.01), 0.99))


@indicator("Momentum")
def EhlersDominantCycleTunedBypassFilter(s, low=8, high=50, n1=40, n2=10):
    """A band-pass filter at the dominant cycle, and its quadrature."""
    c, y = _bank(s, low, high, n1, n2)
    a = s.let(_damping(where(c.eq(0), 0.99, mn(mx(div(_delta(s) * (4 * PI), c), 0.01), 0.99))))
    u, b = s.let((1 - a) * 0.5 * (y - s.lag(y, 1))), s.let(cos(_angle(2 * PI, c)) * (a + 1))
    v = s.rec2(lambda p, q: u + b * p - a * q)
    w = s.let(c * (2 / PI) * (v - s.lag(v, 1)))
    return s.result({"V1": v, "V2": w}, s.when((w > v) & (w >= 0), (w < v) | (w < 0)), None)


@indicator("Volume")
def EhlersRestoringPullIndicator(s, ma=EMA, low=8, high=50, n1=40, n2=10):
    c, _ = _bank(s, low, high, n1, n2)
    y = s.let(s.volume * sq(_angle(2 * PI, c)))
    sig = s.ma(ma, y, low)
    return s.result({"Rpi": y, "Signal": sig}, s.compare(y - sig, reverse=True))


def _poles(n: int) -> tuple[float, float]:
    a = math.exp(-_unit(ROOT2 * PI / n))
    return 2 * a * math.cos(_unit(ROOT2 * PI / n)), -a * a


def _burg(s, x: E, ahead: int, order: int, lower: int, upper: int) -> E:
    """kernels.burg_ahead() in SQL, over lists."""

    def named(sql: str, *of: E) -> E:
        return s._name("p", E(sql, "", frozenset().union(*(e.names for e in of))))

    lags = [s.let(s.lag(x, j)) for j in range(upper)]
    b1, b2 = (named(f"[{', '.join(v.sql for v in lags[k : upper - 1 + k])}]", *lags) for k in (0, 1))
    coef: list[E] = []
    for j in range(1, order + 1):
        if j > 1:
            c = coef[-1]
            b1, b2 = (
                named(f"list_transform(range(1, {upper}), lambda k: {b1.sql}[k] - {c.sql} * {b2.sql}[k])", b1, b2, c),
                named(f"list_transform(range(1, {upper}), lambda k: coalesce({b2.sql}[k + 1] - {c.sql} * {b1.sql}[k + 1], 0e0))", b1, b2, c),
            )
        m = upper - j
        top, power = (named(f"list_sum(list_transform(range(1, {m + 1}), lambda k: {e}))", b1, b2) for e in (f"{b1.sql}[k] * {b2.sql}[k]", f"{b1.sql}[k] * {b1.sql}[k] + {b2.sql}[k] * {b2.sql}[k]"))
        c = s.let(div(top * 2, power))
        coef = [s.let(a - c * b) for a, b in zip(coef, reversed(coef), strict=True)] + [c]
    hann = [1 - math.cos(_unit(2 * PI * k / (lower + 1))) for k in range(1, lower + 1)]
    h = lit(0.0)
    for w, c in zip(hann, [coef[-1], *reversed(coef)], strict=False):
        h = h + c * (w / sum(hann))
    h, line = s.let(h), lags[:order][::-1]
    for _ in range(ahead):
        total = lit(0.0)
        for v in line[-order:]:
            total = total + v
        line.append(s.let(h * total))
    return line[-1]


@indicator("Momentum")
def EhlersMesaPredictIndicatorV1(s, n1=5, n2=4, n3=10, lower=12, upper=54):
    """A high-pass filter, smoothed and carried on by linear prediction."""
    if not 1 <= n1 <= n3:
        raise ValueError("the value to be predicted lies within the rows that are carried on")
    b, c = _poles(upper)
    u = s.let((s.x - s.lag(s.x, 1) * 2 + s.lag(s.x, 2)) * ((1 + b - c) / 4))
    hp = s.rec2(lambda p, q: where(s.rn <= 4, 0.0, u + p * b + q * c))
    b1, c1 = _poles(lower)
    v = s.let((hp + s.lag(hp, 1)) * ((1 - b1 - c1) / 2))
    f = s.rec2(lambda p, q: where(s.rn <= 3, hp, v + p * b1 + q * c1))
    args = (n1, n2, lower, upper)
    y = _burg(s, f, *args) if s.written_out else s.kept("_burg_ahead", f, *map(lit, args))
    p = s.let((y + s.lag(y, 1)) / 2)
    return s.result({"Ssf": f, "Predict": p, "PrePredict": y}, s.compare(f - p), "Predict")


@indicator("Volatility")
def EhlersAnticipateIndicator(s, ma=HANN, n=14, bw=1.0):
    """The lag at which a sine goes best with the impulse response; only a best last lag counts, as each lag that is no
    better than the ones before it sets the start back."""
    f = s.of("EhlersImpulseResponse", s.x, ma=ma, n=n, bw=bw).value
    x = [s.lag(f, k) for k in range(n)]
    sx = sxx = lit(0.0)
    for v in x:
        sx, sxx = sx + v, sxx + sq(v)
    vx, sx = s.let(sxx * n - sq(sx)), s.let(sx)
    best, start = lit(-1.0), lit(0.0)
    for j in range(n):
        y = [-math.sin(_unit(2 * PI * (j + k) / n)) for k in range(n)]
        vy = n * math.fsum(t * t for t in y) - math.fsum(y) ** 2
        corr = lit(0.0)
        if vy > 1e-9:  # else the sine is flat here, and nothing goes with it
            sxy = lit(0.0)
            for v, t in zip(x, y, strict=True):
                sxy = sxy + v * t
            corr = s.let(where(vx > 0, div(sxy * n - sx * math.fsum(y), sqrt(vx) * math.sqrt(vy)), 0.0))
        start = s.let(where(corr > best, float(n - j), 0.0))
        best = s.let(mx(best, corr))
    y = s.let(sin(mn(mx(start * (2 * PI / n), 0.01), 0.99)))
    return plain(s, "Predict", y)


@indicator("Momentum")
def EhlersConvolutionIndicator(s, n1=80, n2=40, n3=48):
    """How the roofing filter goes with itself a row ago, and whether it stands above its value half the series ago."""
    w = ROOT2 * PI / n1
    a = (math.cos(w) + math.sin(w) - 1) / math.cos(w)
    u = s.let((s.x - s.lag(s.x, 1) * 2 + s.lag(s.x, 2)) * (1 - a / 2) ** 2)
    hp = s.rec2(lambda p, q: u + p * (2 * (1 - a)) - q * (1 - a) ** 2)
    e = math.exp(-ROOT2 * PI / n2)
    b, c = 2 * e * math.cos(ROOT2 * PI / n2), -e * e
    v = s.let((hp + s.lag(hp, 1)) * ((1 - b - c) / 2))
    f = s.rec2(lambda p, q: v + p * b + q * c)
    g = s.let(s.lag(f, 1))
    sx, sy, sxx, syy, sxy = (s.sum(s.let(x), n3) for x in (f, g, sq(f), sq(g), f * g))
    vx, vy = s.let(s.rn * sxx - sx * sx), s.let(s.rn * syy - sy * sy)
    corr = where(vx * vy > 0, div(s.rn * sxy - sx * sy, sqrt(vx * vy)), 0.0)
    k = s.let(exp(s.let(corr) * 3))
    half = s.at_row(f, s.rn - floor((s.rn + 1) / 2))  # of ceil(n / 2) rows before the n-th
    return s.result({"Eci": s.let(div(k, k + 1) / 2), "Slope": s.let(where(half < f, -1.0, 1.0))}, s.compare(f - g))


@indicator("Trend")
def GuppyCountBackLine(s, n=21):
    h, l = s.range_of(s.x)
    h, l = s.let(h), s.let(l)
    top, bottom = s.max(h, n), s.min(l, n)
    highs, lows = s.array(h, 2 * n + 1), s.array(l, 2 * n + 1)
    names = highs.names | lows.names | s.x.names | top.names | bottom.names
    if not s.written_out:
        y = s._name("s", E("", f"_count_back({highs.py}, {lows.py}, {s.x.py}, {top.py}, {bottom.py}, {n})", names))
        return plain_slope(s, "Cbl", y)

    def past(e: E) -> E:
        return s._name("p", E(f"list_resize(list_reverse({e.sql}), {2 * n + 2}, 0e0)", "", e.names))

    highs, lows = past(highs), past(lows)
    line, counts = s.x, [lit(0.0), lit(0.0)]
    for j in range(n + 1):
        for side, (own, other, edge) in enumerate(((lows, highs, bottom), (highs, lows, top))):
            count = counts[side]
            found = s._name("p", E(f"list_filter(range({j + 2}, {j + n + 2}), lambda k: {other.sql}[k] > {other.sql}[{j + 1}])", "", other.names))
            many = E(f"cast(len({found.sql}) as double)", "", found.names)
            at = [E(f"coalesce({other.sql}[{found.sql}[{k}]], 0e0)", "", other.names | found.names) for k in (1, 2)]
            following = E(f"{other.sql}[{j + 2}]", "", other.names)
            here = E(f"({own.sql}[{j + 1}] = {edge.sql})", "", own.names | edge.names)
            again = count.eq(2) & (following <= E(f"{other.sql}[{j + 1}]", "", other.names))
            hit = (count.eq(0) & (many >= 2)) | (count.eq(1) & (many >= 1)) | again
            line = s.let(where(here & hit, where(count.eq(0), at[1], where(count.eq(1), at[0], following)), line))
            counts[side] = s.let(where(here, where(hit, 2.0, count + many), count))
    return plain_slope(s, "Cbl", line)


def plain_slope(s, key: str, y: E):
    y = s.let(y)
    return s.result({key: y}, s.compare(s.x - y))


@indicator("Momentum")
def MobilityOscillator(s, ma=WMA, n1=10, n2=14, signal=7):
    """How thinly the price of n2 rows ago is traded, by a histogram of the bars before each of n1 rows."""
    high, low = s.range_of(s.x)
    top, bottom, then = s.max(high, n2), s.min(low, n2), s.lag(s.x, n2)
    width = s.let((top - bottom) / n1)
    h, l = ([s.let(s.lag(e, j)) for j in range(n1 + n2 + 1)] for e in (high, low))
    most = here = lit(0.0)
    for j in range(1, n1 + 1):
        up = s.let(bottom + width * j)
        down = s.let(up - width)
        peak, base = (f(*(e[k] for k in (j, *range(j + 2, j + n2)))) for f, e in ((mx, h), (mn, l)))
        base = s.let(base)
        part = s.let((s.let(peak) - base) / n1)
        u, d = s.let(base + part * j), s.let(base + part * (j - 1))
        mass = lit(0.0)
        for k in range(j + 1, j + n2 + 1):
            r = h[k] - l[k]
            beyond = where((h[k] <= down) | (l[k] >= d), 0.0, div(d - l[k], r))
            mass = mass + where(h[k] <= u, 1.0, 0.0) + where((h[k] <= u) | (l[k] >= u), where(h[k] <= d, -1.0, 0.0) - beyond, div(u - l[k], r))
        mass = s.let(mass / n2)
        most = mass if j == 1 else s.let(mx(mass, most))
        here = mass if j == 1 else s.let(where((then > down) & (then <= up), mass, here))
    y = s.let(where(most.ne(0), (1 - div(here, most)) * 100, 0.0))
    m = s.ma(ma, where(then < bottom + width * 0.5, y, -y), signal)
    sig = s.ma(ma, m, signal)
    return s.result({"Mo": m, "Signal": sig}, s.compare(m - sig))


@indicator("Volatility")
def MarketMeannessIndex(s, n=100):
    """Share of the moves that go back towards the median, and its noise-elimination average."""
    m, x = median(s, s.x, n), [s.lag(s.x, j) for j in range(n)]
    count = lit(0.0)
    for a, b in zip(x, x[1:], strict=False):
        count = count + where(((a > m) & (a > b)) | ((a < m) & (a < b)), 1.0, 0.0)
    y = s.let(count * (100 / (n - 1)) if n > 1 else lit(0.0))
    f, base = s.let(_net(s, y, n)), s.let(_net(s, s.x, n))
    p, q = s.lag(f, 1), s.lag(f, 2)
    turns = (s.x < base) & (((f > p) & (p < q)) | ((f < p) & (p > q)))
    return s.result({"Mmi": y, "MmiSmoothed": f}, s.when(turns, turns))


