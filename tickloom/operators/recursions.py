"""Recursions that read many of their own last values, banks of filters, and what builds on them."""

from __future__ import annotations

import math

from tickloom.functions.expr import E, abs_, clamp, cos, div, exp, gain, lit, log, mn, mx, power, settled, sq, sqrt, undivided, where

from .composites import nearest
from .cycles import PI, _alpha, _unit, median
from .registry import SMA, Context, average, indicator
from .spectral import gained, periodogram, roofing


def total(terms: list[E]) -> E:
    """A sum whose text is nested no deeper than it must be."""
    if len(terms) < 2:
        return terms[0] if terms else lit(0.0)
    h = len(terms) // 2
    return total(terms[:h]) + total(terms[h:])


def row(name: str, n: int) -> dict[str, float]:
    """Places for the last n values of a scan's column, the newest first."""
    return {f"{name}{j}": 0.0 for j in range(n)}


#: A variance below this share of the mean square is what rounding leaves of equal values in a difference of sums.
SMALL = 1e-13


def push(old, new, name: str, n: int, value: E) -> list[E]:
    """Puts a value in front of the last ones; gives all n, missing ones as 0."""
    new[f"{name}0"] = value
    for j in range(n - 1, 0, -1):
        new[f"{name}{j}"] = old[f"{name}{j - 1}"]
    return [new[f"{name}{j}"] for j in range(n)]


def likeness(new, name: str, rows: E, xs: list[E], sums: tuple[E, E], ys: list[E]) -> E:
    """|correlation| of a window of values with a scan's own last ones; 0 where it is not defined."""
    sx, sxx = sums
    new[f"{name}_s"] = total(ys) / rows
    new[f"{name}_v"] = total([sq(y - new[f"{name}_s"]) for y in ys]) / rows - (len(ys) / rows - 1) * sq(new[f"{name}_s"])
    new[f"{name}_c"] = total([x * y for x, y in zip(xs, ys, strict=True)]) / rows - sx / rows * new[f"{name}_s"]
    v = sxx / rows - sq(sx / rows)
    ok = (v > sxx / rows * SMALL) & (new[f"{name}_v"] > sq(new[f"{name}_s"]) * SMALL)
    new[name] = where(ok, mn(abs_(div(new[f"{name}_c"], sqrt(v * new[f"{name}_v"]))), 1), 0.0)
    return new[name]


def compared(name: str) -> dict[str, float]:
    return {f"{name}{part}": 0.0 for part in ("_s", "_v", "_c", "")}


def _window(s: Context, x: E, n: int):
    return [s.lag(x, j) for j in range(n)], (s.sum(x, n), s.sum(s.let(sq(x)), n)), s.let(mn(s.rn, n))


@average("Owma")
def OptimalWeightedMovingAverage(s, x, n=14):
    """Weights are powers of the distance from the window's end, by how far x goes with the average before it."""
    x = s.let(x)
    xs, sums, rows = _window(s, x, n)

    def step(o, new):
        r = likeness(new, "r", rows, xs, sums, [o[f"y{j}"] for j in range(n)])
        w = [power(n - j, r) for j in range(n)]
        push(o, new, "y", n, div(total([a * b for a, b in zip(xs, w, strict=True)]), total(w)))

    return s.machine(row("y", n) | compared("r"), step)["y0"]


@average("Flsma")
def FisherLeastSquaresMovingAverage(s, x, n=100, ma=SMA):
    x, i = s.let(x), s.let(s.i)
    place = s.let(div(i - s.ma(ma, i, n), s.sd(i, n, ma)))
    m, dev = s.ma(ma, x, n), s.sd(x, n, ma)

    def step(o, new):
        d = push(o, new, "d", n, x - s.first(x, o["b"]))
        new["e"] = exp(div(total(d), total([abs_(e) for e in d])) * 2)
        new["b"] = m + place * div(new["e"] - 1, new["e"] + 1) * dev

    return s.machine(row("d", n) | {"e": 0.0, "b": 0.0}, step)["b"]


@average("Cma")
def CorrectedMovingAverage(s, x, n=35, ma=SMA):
    """Steps towards the average by a gain that is itself the limit of an iteration."""
    m = s.ma(ma, x, n)
    v = s.let(sq(s.sd(m, n, ma)))  # of the average

    def step(o, new):
        new["d"] = m - s.first(m, o["y"])
        gap = sq(new["d"])
        new["y"] = s.first(m, o["y"]) + gain(where(v.eq(0) | gap.eq(0), 1.0, div(gap, v + gap))) * new["d"]

    return s.machine({"d": 0.0, "y": 0.0}, step)["y"]


@average("R2ar")
def R2AdaptiveRegression(s, x, n=100, ma=SMA):
    """The regression line, a line through the output's own last values, and the output, by their fit."""
    x = s.let(x)
    line = s.linreg(x, n)
    fit = s.let(sq(s.corr(line, x, n)))
    dev, m = s.sd(line, n, ma), s.ma(ma, x, n)
    xs, sums, rows = _window(s, x, n)

    def step(o, new):
        last = push(o, new, "x", n, s.first(x, o["out"]))
        r = likeness(new, "r", rows, xs, sums, last)
        spread = push(o, new, "p", n, sq(last[0] - new["r_s"]))
        new["a"] = div(dev * r, sqrt(total(spread) / rows))
        own = push(o, new, "y", n, new["a"] * (last[0] - new["r_s"]) + m)
        q = sq(likeness(new, "q", rows, xs, sums, own))
        new["out"] = fit * line + q * own[0] + (1 - fit - q) * last[0]

    return s.machine(row("x", n) | row("p", n) | row("y", n) | compared("r") | compared("q") | {"a": 0.0, "out": 0.0}, step)["out"]


@average("Maaf")
def EhlersMedianAverageAdaptiveFilter(s, x, n=39, threshold=0.002):
    """The length shrinks until the median of that many rows is near their average."""
    x = s.let(x)
    u = s.let((x + s.lag(x, 1) * 2 + s.lag(x, 2) * 2 + s.lag(x, 3)) / 6)
    tries = [(k, 2 / (k + 1), median(s, u, k)) for k in range(n, 0, -2)]

    def step(o, new):
        value, size = None, None
        for k, a, m in reversed(tries):
            y = u * a + o["v"] * (1 - a)
            near = m.ne(0) & (div(abs_(m - y), m) <= threshold)
            value = y if value is None else where(near, y, value)
            size = lit(k - 2.0) if size is None else where(near, k - 2.0, size)
        new["v"], new["a"] = value, div(2, mx(size, 3) + 1)
        new["y"] = u * new["a"] + (1 - new["a"]) * o["y"]

    return s.machine({"v": 0.0, "a": 0.0, "y": 0.0}, step)["y"]


@average("Alwd")
def AutoLineWithDrift(s, x, n=500):
    """The last value until x leaves it by its deviation; until then it drifts by its own slope over n rows."""
    x = s.let(x)
    dev, start = s.sd(x, n), s.let(nearest(x))

    def step(o, new):
        new["l"] = s.first(start, o["y0"])
        drift = new["l"] + (new["l"] - where(s.rn > n + 1, o[f"y{n}"], start)) * (1 / (2 * n))
        push(o, new, "y", n + 1, where((x > new["l"] + dev) | (x < new["l"] - dev), x, drift))

    return s.machine(row("y", n + 1) | {"l": 0.0}, step)["y0"]


@indicator("Momentum")
def RecursiveStochastic(s, n=200, alpha=0.1):
    k0 = s.let(div(s.x - s.min(s.x, n), s.max(s.x, n) - s.min(s.x, n)) * 100)

    def step(o, new):
        m = push(o, new, "m", n, k0 * alpha + o["k"] * (1 - alpha))
        held = [where(s.rn > j, e, m[0]) for j, e in enumerate(m)]
        new["top"], new["bottom"] = mx(*held), mn(*held)
        new["k"] = clamp(div(m[0] - new["bottom"], new["top"] - new["bottom"]) * 100, 100, 0)

    k = s.machine(row("m", n) | {"top": 0.0, "bottom": 0.0, "k": 0.0}, step)["k"]
    return s.result({"Rsto": k}, s.crossing(k - s.lag(k, 1), k, 80, 20))


@indicator("Trend")
def GrandTrendForecasting(s, n=100, forecast=200, mult=2.0):
    """A trend that reads itself n rows back, carried on by its own change over the forecast's rows."""
    x = s.x

    def step(o, new):
        new["t"] = where(s.rn > n, o[f"t{n - 1}"], x)
        new["g"] = new["t"] * 0.9
        y = new["g"] + x * 0.1 + new["g"] - where(s.rn > n, o[f"g{n - 1}"], x)
        push(o, new, "g", n, new["g"])
        push(o, new, "t", n, y)

    t = s.machine({"t": 0.0, "g": 0.0} | row("t", n) | row("g", n), step)["t0"]
    trend, ahead = s.avg(t, n), s.let(t * 2 - s.lag(t, forecast))
    dev = s.avg(s.let(abs_(x - s.lag(ahead, forecast))), forecast) * mult
    signal = s.both(x - mx(ahead, t, trend), x - mn(ahead, t, trend))
    return s.result({"Gtf": trend, "UpperBand": s.let(ahead + dev), "MiddleBand": ahead, "LowerBand": s.let(ahead - dev)}, signal)


@indicator("Momentum")
def JmaRsxClone(s, n=14):
    """Ratio of thrice smoothed changes to thrice smoothed absolute changes, from the sixth row on."""
    k = 3 / (n + 2)
    move = s.let((s.x - s.lag(s.x, 1)) * 100)

    def thrice(e):
        for _ in range(3):
            a = s.smooth(e, k)
            e = s.let(a * 1.5 - s.smooth(a, k) * 0.5)
        return e

    up, all_ = thrice(move), thrice(s.let(abs_(move)))
    y = s.let(where((s.rn >= 6) & (all_ > 0), clamp((div(up, all_) + 1) * 50, 100, 0), 50.0))
    return s.result({"Rsx": y}, s.crossing(y - s.lag(y, 1), y, 70, 30))


# ---- banks of filters ----------------------------------------------------------------------------


def _cleaned(s: Context, n: int, rows: int, first) -> tuple[E, E]:
    """(high-pass, its smoothed values); the first rows give their input and `first`."""
    x, a = s.x, _pole(n)
    u = s.let((x - s.lag(x, 1)) * (0.5 * (1 + a)))
    hp = s.rec(lambda y: where(s.rn <= rows, x, u + y * a))
    return hp, s.let(where(s.rn <= rows, first, s.fir(hp, [1, 2, 3, 3, 2, 1])))


def _pole(n: int) -> float:
    w = _unit(2 * PI / n)
    return (1 - math.sin(w)) / math.cos(w)


def _delta(s: Context) -> E:
    return s.let(mx(s.i * -0.015 + 0.5, 0.15))


def _damping(angle: E) -> E:
    g = div(1, cos(angle))
    return g - sqrt(g * g - 1)


def _bank(s: Context, low: int, high: int, n1: int, n2: int) -> tuple[E, E]:
    """(dominant cycle, smoothed high-pass): powers of filters of all periods, which share the memory of the longest."""
    _, y = _cleaned(s, n1, 7, s.x - s.lag(s.x, 1))
    if not s.written_out:  # one column that keeps the filters' memory as arrays, for the 780 of the SQL form
        return median(s, s.kept("_filter_bank", y, s.i, lit(low), lit(high), lit(n2)), n2), y
    delta = _delta(s)
    move = s.let((y - s.lag(y, 1)) * (2 / PI))
    damp = {j: s.let(_damping(clamp(delta * (4 * PI / j), 0.99, 0.01))) for j in range(low, high + 1)}

    def part(j, now, then, near, far):
        return (now - then) * (1 - damp[j]) * 0.5 + near * (damp[j] + 1) * math.cos(_unit(2 * PI / j)) - far * damp[j]

    q = s.let(move * high)

    def memory(e):
        then = s.let(s.lag(e, high))

        def step(o, new):
            push(o, new, "y", 2 * high, part(high, e, then, o[f"y{high - 1}"], o[f"y{2 * high - 1}"]))

        return s.machine(row("y", 2 * high), step)["y0"]

    re, im = memory(y), memory(q)
    top, num, den = lit(0.0), lit(0.0), lit(0.0)
    for j in range(low, high + 1):
        a = part(j, y, s.lag(y, j), s.lag(re, j), s.lag(re, 2 * j))
        b = part(j, s.let(move * j), s.lag(q, j), s.lag(im, j), s.lag(im, 2 * j))
        p = s.let(sq(s.let(a)) + sq(s.let(b)))
        top = s.let(mx(top, p))
        share = s.let(div(p, top))
        db = s.let(where(share > 0, mn(log(div(0.01, 1 - share * 0.99)) * (-n2 / math.log(n2)), high), 0.0))
        num, den = num + where(db <= 3, (high - db) * j, 0.0), den + where(db <= 3, high - db, 0.0)
    return median(s, s.let(div(num, s.let(den))), n2), y


@indicator("Cycle")
def EhlersSpectrumDerivedFilterBank(s, low=8, high=50, n1=40, n2=10):
    d, y = _bank(s, low, high, n1, n2)
    return s.result({"Esdfb": d}, s.compare(y))


@indicator("Cycle")
def EhlersCombFilterSpectralEstimate(s, n1=48, n2=10, bw=0.3):
    """Powers are sums of the positive values of the longest period's filter."""
    x = roofing(s, s.x, n1, n2)
    g = 1 / math.cos(2 * PI * bw / n1)
    a = _unit(g - math.sqrt(g * g - 1))
    u = s.let((x - s.lag(x, 2)) * (0.5 * (1 - a)))
    f = s.rec2(lambda p, q: u + p * (math.cos(2 * PI / n1) * (1 + a)) - q * a)
    power_ = s.let(sq(s.let(mx(s.lag(f, 1), 0))))
    top, num, den = lit(0.0), lit(0.0), lit(0.0)
    for j in range(n2, n1 + 1):
        p = s.let(s.sum(power_, j) / (j * j))
        top = s.let(mx(top, p))
        share = s.let(div(p, top))
        num, den = num + where(share >= 0.5, share * j, 0.0), den + where(share >= 0.5, share, 0.0)
    return s.result({"Ecfse": s.let(div(num, s.let(den)))}, s.compare(x - s.lag(x, 1)))


@indicator("Cycle")
def EhlersDiscreteFourierTransform(s, low=8, high=50, n=40):
    """Powers of earlier rows stand for those of the periods; each sums the waves of all periods."""
    hp, y = _cleaned(s, n, 6, s.x)
    re, im = (s.fir(y, [sum(f(_unit(2 * PI * k / j)) for j in range(low, high + 1)) for k in range(high)], 1.0) for f in (math.cos, math.sin))
    p = s.let(re * re + im * im)
    top, num, den = lit(0.0), lit(0.0), lit(0.0)
    for j in range(low, high + 1):
        e = s.lag(p, j)
        top = s.let(mx(top, e))
        db = s.let(where(e > 0, mn(log(div(0.01, 1 - div(e, top) * 0.99)) * (-10 / math.log(10)), 20), 0.0))
        num, den = num + where(db < 3, (3 - db) * j, 0.0), den + where(db < 3, 3 - db, 0.0)
    return s.result({"Edft": s.let(div(num, s.let(den)))}, s.compare(hp))


@indicator("Cycle")
def EhlersFourierSeriesAnalysis(s, n=20, bw=0.1):
    """The wave of length n and its next two harmonics, each by its power."""
    move = s.let(s.x - s.lag(s.x, 2))
    waves, powers = [], []
    for h in (1, 2, 3):
        g = math.cos(bw * 2 * PI * h / n)
        a = 1 / g - math.sqrt(1 / (g * g) - 1)
        c = math.cos(2 * PI * h / n) * (1 + a)
        f = s.rec2(lambda p, q, a=a, c=c: where(s.rn <= 4, 0.0, move * (0.5 * (1 - a)) + p * c - q * a))
        q = s.let(where(s.rn <= 5, 0.0, (f - s.lag(f, 1)) * (n // 2 * PI)))
        waves.append(f)
        powers.append(s.sum(s.let(f * f + q * q), n))
    first, second, third = powers
    y = s.let(where(first.ne(0), waves[0] + sqrt(div(second, first)) * waves[1] + sqrt(div(third, first)) * waves[2], 0.0))
    return s.result({"Wave": y, "Roc": s.let((y - s.lag(y, 2)) * (n / PI * 4))}, s.compare(y), None)


@indicator("Trend")
def EhlersSwissArmyKnifeIndicator(s, n=20, delta=0.1):
    """Nine filters from one transfer function; the first n + 1 rows give their input, or 0 for high-passes."""
    w = _unit(2 * PI / n)
    one = _alpha(w)
    beta = 2.415 * (1 - math.cos(w))
    two = math.sqrt(beta * beta + 2 * beta) - beta
    g = 1 / math.cos(_unit(4 * PI * delta / n))
    band = g - math.sqrt(g * g - 1)
    x0, x1, x2, old = s.x, s.lag(s.x, 1), s.lag(s.x, 2), s.lag(s.x, n)

    def knife(c0, b, a1, a2=0.0, c1=0.0, seed=x0):
        u = s.let((x0 * b[0] + x1 * b[1] + x2 * b[2]) * c0 - old * c1)
        return s.rec2(lambda p, q: where(s.rn <= n + 1, seed, u + p * a1 + q * a2))

    poles = (2 * (1 - two), -((1 - two) ** 2))
    ring = (math.cos(w) * (1 + band), -band)
    out = {
        "EmaFilter": knife(1, (one, 0, 0), 1 - one),
        "SmaFilter": knife(1, (1 / n, 0, 0), 1.0, c1=1 / n),
        "GaussFilter": knife(two**2, (1, 0, 0), *poles),
        "ButterFilter": knife(two**2 / 4, (1, 2, 1), *poles),
        "SmoothFilter": s.let((x0 + x1 * 2 + x2) / 4),
        "HpFilter": knife(1 - one / 2, (1, -1, 0), 1 - one, seed=0.0),
        "PhpFilter": knife((1 - two / 2) ** 2, (1, -2, 1), *poles, seed=0.0),
        "BpFilter": knife((1 - band) / 2, (1, 0, -1), *ring),
        "BsFilter": knife((1 + band) / 2, (1, -2 * math.cos(w), 1), *ring),
    }
    y = out["SmaFilter"]
    return s.result(out, s.compare(y - s.lag(y, 1)), "SmaFilter")


@indicator("Momentum")
def EhlersAdaptiveBandPassFilter(s, n1=48, n2=10, n3=3, bw=0.3):
    """A band-pass of the dominant cycle over the roofing filter of that cycle."""
    d = periodogram(s, n1, n2, n3)[0]
    x, size = roofing(s, d, n1, n2), s.let(clamp(d, n1, n3))
    b = s.let(cos(size * (2 * PI / 0.9)))
    a = s.let(clamp(_damping(size * (2 * PI * bw / 0.9)), 0.99, 0.01))
    u = s.let((x - s.lag(x, 2)) * (1 - a) * 0.5)
    y = gained(s, s.rec2(lambda p, q: where(s.rn > 3, u + p * b * (a + 1) - q * a, 0.0)))
    t = s.let(s.lag(y, 1) * 0.9)
    return s.result({"Eabpf": y, "Signal": t}, s.crossing(y - t, y, math.sqrt(0.5), -math.sqrt(0.5)))


# ---- searches ------------------------------------------------------------------------------------


@indicator("Momentum")
def RecursiveRelativeStrengthIndex(s, n=14, ma=SMA):
    """Compares a mean with itself n rows ago; once n rows are past, the share of the last n that did not fall."""
    src = s.ma(ma, s.change(s.x, n), n)
    r = s.of("RelativeStrengthIndex", src, n=n).value

    def step(o, new):
        mean = (r + where(s.rn > n, o[f"b{n - 1}"], src)) / 2
        new["up"] = where(settled(mean - o[f"a{n - 1}"]) >= 0, 100.0, 0.0)
        push(o, new, "b", n, where(s.rn > n, total([o[f"u{j}"] for j in range(n)]) / n, new["up"]))
        push(o, new, "a", n, mean)
        push(o, new, "u", n, new["up"])

    y = s.machine({"up": 0.0} | row("b", n) | row("a", n) | row("u", n), step)["b0"]
    return s.result({"Rrsi": y}, s.crossing(y - s.lag(y, 1), y, 0.8, 0.2))


@indicator("Momentum")
def DrunkardWalk(s, n1=80, n2=14):
    """How far the price went from its last extreme, in ranges of the rows since."""
    h, l = s.range_of(s.x)
    top, bottom, t = s.max(h, n1), s.min(l, n1), s.tr()

    def walk(x, extreme, way):
        rows = lit(0.0)
        for j in range(n1 - 1, -1, -1):  # the latest of equal extremes counts
            rows = where((s.rn > j) & s.lag(x, j).eq(extreme), float(j), rows)
        rows = s.let(rows)
        k = s.let(div(1, rows))
        size = s.rec(lambda y: t * k + (1 - k) * y)
        return s.let(where(rows > 0, div(way, sqrt(rows) * where(size > 0, size, 1.0)), 0.0))

    up, down = walk(l, bottom, h - bottom), walk(h, top, top - l)
    return s.result({"UpWalk": up, "DnWalk": down}, s.compare(up - down), None)


@indicator("Momentum")
def PrimeNumberOscillator(s, n=5):
    """The nearer of the next prime above and below, within n percent, less the input; divisors are tried up to the
    rounded root. Without a prime the last one stays."""
    x = s.let(s.x)
    near, root = s.let(nearest(x)), s.let(nearest(sqrt(x)))
    above, below = s.let(nearest(x + x * n / 100)), s.let(nearest(x - x * n / 100))

    def step(o, new):
        for name, end in (("u", above), ("d", below)):
            new[f"{name}f"] = undivided(near, end, root)
            new[name] = where(new[f"{name}f"] > 0, new[f"{name}f"], o[name])
        new["p"] = where(new["u"] - x < x - new["d"], new["u"] - x, new["d"] - x)
        new["y"] = where(new["p"].eq(0), o["y"], new["p"])

    y = s.machine(dict.fromkeys(("uf", "u", "df", "d", "p", "y"), 0.0), step)["y"]
    return s.result({"Pno": y}, s.compare(y))


@indicator("Volatility")
def PrimeNumberBands(s, n=5):
    """Each oscillator reads the high or the low as its input."""
    up = s.max(s.of("PrimeNumberOscillator", s.high, n=n).value, n)
    down = s.min(s.of("PrimeNumberOscillator", s.low, n=n).value, n)
    return s.result({"UpperBand": up, "LowerBand": down}, s.both(s.x - s.lag(up, 1), s.x - s.lag(down, 1)), None)


@indicator("Momentum")
def SpearmanIndicator(s, ma=SMA, n=10, signal=3):
    """Rank correlation of the last n rows with the same in order; equal values share their mean rank."""
    x, rows = s.let(s.x), s.let(mn(s.rn, n))
    v, there = [s.lag(x, j) for j in range(n)], [s.rn > j for j in range(n)]
    less = [s.let(total([where(there[i] & (v[i] < v[j]), 1.0, 0.0) for i in range(n)])) for j in range(n)]
    same = [s.let(total([where(there[i] & v[i].eq(v[j]), 1.0, 0.0) for i in range(n)])) for j in range(n)]
    rank = [s.let(where(there[j], less[j] + (same[j] + 1) / 2, 0.0)) for j in range(n)]

    def ordered(place):  # the rank that stands at a place of the sorted rows
        return total([where(there[i] & (less[i] <= place) & (place < less[i] + same[i]), div(rank[i], same[i]), 0.0) for i in range(n)])

    mean2 = sq((rows + 1) / 2) * rows
    both = total([rank[j] * ordered(rows - 1.0 - j) for j in range(n)])
    y = s.let(div(s.let(both) - mean2, s.let(total([sq(r) for r in rank])) - mean2) * 100)
    m = s.ma(ma, y, signal)
    return s.result({"Si": y, "Signal": m}, s.compare(y - m))


@indicator("Trend")
def PercentageTrend(s, n=20, pct=0.15):
    """A stop that is carried back over n rows: it turns where the price crosses it, and stands a share from the
    extreme of as many rows, the newest, as have passed since."""
    x = s.let(s.x)
    high = [s.let(where(s.rn > p, s.max(x, p + 1), mx(s.max(x, p + 1), 0))) for p in range(n)]
    low = [s.let(where(s.rn > p, s.min(x, p + 1), mn(s.min(x, p + 1), 0))) for p in range(n)]

    def step(_, new):
        stop, age = x, lit(0.0)
        for j in range(1, n + 1):
            a, b = s.lag(x, j - 1), s.lag(x, j)
            new[f"p{j}"] = where(((a <= stop) & (b > stop)) | ((a >= stop) & (b < stop)), 0.0, age)
            top, bottom = high[0], low[0]
            for p in range(1, j):
                top, bottom = where(new[f"p{j}"].eq(p), high[p], top), where(new[f"p{j}"].eq(p), low[p], bottom)
            new[f"t{j}"] = where(b > stop, mx(b, top) * (1 - pct), mn(b, bottom) * (1 + pct))
            stop, age = new[f"t{j}"], new[f"p{j}"] + 1

    y = s.machine({f"{k}{j}": 0.0 for j in range(1, n + 1) for k in "pt"}, step)[f"t{n}"]
    return s.result({"Pti": y}, s.compare(s.x - y))
