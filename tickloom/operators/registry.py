"""The catalogue of indicators, and the context that they are written in."""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable
from dataclasses import dataclass

from tickloom.functions.expr import E, abs_, clamp, div, lit, mn, mx, rsi_of, settled, sq, sqrt, where
from tickloom.plans.series import Series


class ChainError(ValueError):
    """An indicator without a single output was chained."""


@dataclass
class Result:
    outputs: dict[str, E]
    signal: E | None
    main: str | None  # what the next indicator of a chain reads

    @property
    def value(self) -> E:
        if self.main is None:
            raise ChainError("the indicator has no single output to chain from")
        return self.outputs[self.main]


@dataclass(frozen=True)
class Spec:
    name: str
    run: Callable[..., Result]
    category: str
    params: dict[str, object]
    average: bool
    input: str = "bars"  # or "periods": bars of a coarser period; "pair": bars with those of a market beside them


REGISTRY: dict[str, Spec] = {}
#: Moving averages by name: f(context, values, length) -> column.
AVERAGES: dict[str, Callable[..., E]] = {}

SMA, EMA, WMA, WILDER = "SimpleMovingAverage", "ExponentialMovingAverage", "WeightedMovingAverage", "WellesWilderMovingAverage"
#: Inputs by name: a column of the bars, or None for a price that the indicator of that name makes.
INPUTS = {"Close": "close", "AdjustedClose": "close", "Open": "open", "High": "high", "Low": "low", "Volume": "volume"} | dict.fromkeys(
    ("TypicalPrice", "FullTypicalPrice", "MedianPrice", "WeightedClose", "AveragePrice", "Midpoint", "Midprice")
)
#: A variance below this share of the squared mean is what rounding leaves of equal values.
TINY = 1e-20
#: Other names of averages.
ALIASES = {
    "WildersSmoothingMethod": WILDER, "WildersSummationMethod": "WellesWilderSummation", "_1LCLeastSquaresMovingAverage": "1LCLeastSquaresMovingAverage",
    "_3HMA": "3HMA", "EhlersMesaAdaptiveMovingAverage": "EhlersMotherOfAdaptiveMovingAverages", "EndPointWeightedMovingAverage": "EndPointMovingAverage",
}


def _or(given: int | None, other: int) -> int:
    return other if given is None else given


#: How averages with two lengths take theirs from (n, fast, slow), and the length that has to be above 0, if any.
TWO_LENGTHS: dict[str, Callable[[int, int | None, int | None], tuple[dict[str, int], str]]] = {
    "AdaptiveMovingAverage": lambda n, f, s: ({"n": n, "fast": _or(f, 0), "slow": _or(s, n)}, ""),
    "DynamicallyAdjustableMovingAverage": lambda n, f, s: ({"fast": _or(f, 0), "slow": _or(s, n)}, "fast"),
    "EhlersAdaptiveLaguerreFilter": lambda n, f, s: ({"n1": _or(s, n), "n2": _or(f, 0)}, "n2"),
    "EhlersDeviationScaledMovingAverage": lambda n, f, s: ({"n": _or(s, 2 * n), "fast": _or(f, n)}, ""),
    "EhlersDeviationScaledSuperSmoother": lambda n, f, s: ({"n": _or(f, n), "long": _or(s, 0)}, "long"),
    "EhlersFilter": lambda n, f, s: ({"n": _or(s, n), "k": _or(f, 0)}, ""),
    "EhlersRecursiveMedianFilter": lambda n, f, s: ({"n": _or(f, 0), "long": _or(s, n)}, "n"),
    "EhlersVariableIndexDynamicAverage": lambda n, f, s: ({"n": _or(s, n), "fast": _or(f, 0)}, "fast"),
    "MiddleHighLowMovingAverage": lambda n, f, s: ({"n": _or(s, n), "short": _or(f, 0)}, ""),
    "ReverseMovingAverageConvergenceDivergence": lambda n, f, s: ({"n": _or(s, n), "fast": _or(f, 0)}, ""),
    "UltimateMovingAverage": lambda n, f, s: ({"most": _or(s, n), "least": _or(f, 0)}, ""),
    "VariableLengthMovingAverage": lambda n, f, s: ({"n": _or(s, n), "short": _or(f, 0)}, ""),
}


def indicator(category: str = "Trend", name: str | None = None, input: str = "bars"):
    """Registers f(s, **params) -> Result under its CamelCase name."""

    def add(f):
        n = name or f.__name__
        params = {k: p.default for k, p in list(inspect.signature(f).parameters.items())[1:]}
        REGISTRY[n] = Spec(n, f, category, params, False, input)
        return f

    return add


def average(key: str, name: str | None = None, **defaults):
    """Registers f(s, x, n, ...) -> column as a moving average and as the indicator of that name."""

    def add(f):
        n = name or f.__name__
        AVERAGES[n] = f
        params = {k: p.default for k, p in list(inspect.signature(f).parameters.items())[2:]}

        def run(s, **given):
            y = f(s, s.x, **(params | given))
            return s.result({key: y}, s.compare(s.x - y))

        REGISTRY[n] = Spec(n, run, "Trend", params, True)
        return f

    return add


def parts(name: str, main: str):
    """Gives the indicator of an average its other outputs too: f(s, x, **params) -> columns by key, `main` among them."""

    def add(f):
        spec = REGISTRY[name]

        def run(s, **given):
            out = {k: s.let(e) for k, e in f(s, s.x, **(spec.params | given)).items()}
            return s.result(out, s.compare(s.x - out[main]), main)

        REGISTRY[name] = Spec(name, run, spec.category, spec.params, True)
        return f

    return add


class Context(Series):
    """A plan under construction: prices, the input `x`, and the building blocks of indicators."""

    def result(self, outputs: dict[str, E], signal: E | None = None, main: str | None = "") -> Result:
        return Result(outputs, signal, next(iter(outputs)) if main == "" else main)

    def run(self, name: str, **params) -> Result:
        return REGISTRY[name].run(self, **params)

    def of(self, name: str, x: E, **params) -> Result:
        """An indicator with another input than the context's."""
        keep, self.x = self.x, self.let(x)
        try:
            return REGISTRY[name].run(self, **params)
        finally:
            self.x = keep

    # ---- inputs --------------------------------------------------------------------------------

    def select(self, name: str) -> None:
        """Makes a price the input, by one of the names in INPUTS."""
        if name not in INPUTS:
            raise ValueError(f"no input {name}; there are {', '.join(INPUTS)}")
        column = INPUTS[name]
        self.x = self.close
        self.x = getattr(self, column) if column else self.let(self.run(name).value)

    @property
    def typical(self):
        return (self.high + self.low + self.close) / 3

    @property
    def mid(self):
        return (self.high + self.low) / 2

    @property
    def full(self):
        return (self.open + self.high + self.low + self.close) / 4

    def range_of(self, x: E) -> tuple[E, E]:
        """(high, low) that go with an input: the bar's, unless the input's sum lies outside theirs over the
        whole history; then the higher and lower of the input's last two values. Looks ahead by its nature."""
        x = self.let(x)
        if x.sql == self.close.sql:
            return self.high, self.low
        if x.sql == self.volume.sql:
            return self.max(x, 2), self.min(x, 2)
        total = self.whole("sum({})", x)
        inside = (total >= self.whole("sum({})", self.low)) & (total <= self.whole("sum({})", self.high))
        return self.let(where(inside, self.high, self.max(x, 2))), self.let(where(inside, self.low, self.min(x, 2)))

    # ---- lags, windows -------------------------------------------------------------------------

    def ago(self, x: E, k: int) -> E:
        return self.lag(self.let(x), k)

    def change(self, x: E, k: int = 1) -> E:
        """x - x[k rows ago], 0 while there is none."""
        x = self.let(x)
        return where(self.rn > k, x - self.lag(x, k), 0.0)

    def first(self, now, then: E) -> E:
        """`now` on the first row, `then` later: how a recursion is seeded with its input."""
        return where(self.rn <= 1, now, then)

    def fir(self, x: E, weights: list[float], total: float | None = None) -> E:
        """Weighted sum over the last rows, weights[0] for this one, over the sum of all weights."""
        x = self.let(x)
        out = lit(0.0)
        for j, w in enumerate(weights):
            if w:
                out = out + self.lag(x, j) * w
        total = sum(weights) if total is None else total
        return self.let(out * (1.0 / total) if total else lit(0.0))

    def weighted(self, x: E, weight: Callable[[int], E], n: int, zero: float = 0.0) -> E:
        """Average of the last n rows with a weight that is itself a column."""
        x = self.let(x)
        num, den = lit(0.0), lit(0.0)
        for j in range(n):
            w = lit(weight(j))
            num, den = num + self.lag(x, j) * w, den + w
        return self.let(div(num, den, zero))

    def rms(self, x: E, n: int) -> E:
        return self.let(sqrt(self.avg(self.let(sq(self.let(x))), n)))

    def corr(self, x: E, y: E, n: int) -> E:
        """Pearson correlation of the last n rows, whatever their scale; 0 where one of them does not vary."""
        x, y = self.let(x), self.let(y)
        vx, vy, c = self.covar(x, x, n), self.covar(y, y, n), self.covar(x, y, n)
        ok = (vx > sq(self.avg(x, n)) * TINY) & (vy > sq(self.avg(y, n)) * TINY)
        return self.let(where(ok, clamp(div(c, sqrt(vx) * sqrt(vy)), 1, -1), 0.0))

    def slope(self, x: E, n: int) -> tuple[E, E]:
        """(slope, intercept) of the regression of the last n rows on their number; both divide by n.

        Once there are n rows the slope is taken from centred values, so that it keeps its digits in a long series.
        """
        x, i = self.let(x), self.let(self.i)
        sx, sy, sxy, sxx = self.sum(i, n), self.sum(x, n), self.sum(self.let(x * i), n), self.sum(self.let(i * i), n)
        first = div(sxy * n - sx * sy, sxx * n - sx * sx)
        b = self.let(where(self.rn >= n, self.covar(x, i, n) * (12 / (n * n - 1)), first) if n > 1 else lit(0.0))
        return b, self.let((sy - b * sx) / n)

    def linreg(self, x: E, n: int) -> E:
        """The end of the regression line."""
        b, a = self.slope(x, n)
        return self.let(where(self.rn >= n, self.avg(self.let(x), n) + b * ((n - 1) / 2), a + b * self.i))

    # ---- recursions ----------------------------------------------------------------------------

    def rec(self, step: Callable[[E], E], init: float = 0.0) -> E:
        return self.scan(lambda y: [step(y)], (init,))[0]

    def rec2(self, step: Callable[[E, E], E]) -> E:
        """A recursion on its last two values."""
        return self.scan(lambda a, b: [step(a, b), a], (0.0, 0.0))[0]

    def rec_n(self, step: Callable[[list[E]], E], n: int) -> E:
        """A recursion on its last n values, the newest first."""
        return self.scan(lambda *y: [step(list(y)), *y[:-1]], (0.0,) * n)[0]

    def smooth(self, x, k, seed=None) -> E:
        """y + k (x - y), from 0 or from `seed` on the first row."""
        x, k = self.let(lit(x)), lit(k)
        if seed is None:
            return self.rec(lambda y: x * k + (1 - k) * y)
        return self.rec(lambda y: x * k + (1 - k) * self.first(seed, y))

    def total(self, x: E) -> E:
        """Sum of all rows so far."""
        return self.rec(lambda y: y + x) if self.scanned(x) else self.sum(self.let(x))

    # ---- averages, spreads ---------------------------------------------------------------------

    def ma(self, kind: str, x: E, n: int, fast: int | None = None, slow: int | None = None) -> E:
        """An average by name. Of those with two lengths, `fast` counts as 0 where it is not given, and `slow` as n."""
        kind = ALIASES.get(kind, kind)
        if kind not in TWO_LENGTHS:
            return AVERAGES[kind](self, self.let(x), n)
        params, needs = TWO_LENGTHS[kind](n, fast, slow)
        if needs in params and not params[needs]:
            raise ValueError(f"{kind} has no values without the length `{needs}`: give ma() fast and slow")
        return AVERAGES[kind](self, self.let(x), **params)

    def sma(self, x, n):
        return self.ma(SMA, x, n)

    def ema(self, x, n):
        return self.ma(EMA, x, n)

    def wma(self, x, n):
        return self.ma(WMA, x, n)

    def wilder(self, x, n):
        return self.ma(WILDER, x, n)

    def sd(self, x: E, n: int, kind: str = SMA) -> E:
        """Root of the average squared distance of each row from its own average."""
        x = self.let(x)
        return self.let(sqrt(self.ma(kind, self.let(sq(x - self.ma(kind, x, n))), n)))

    def tr(self, x: E | None = None) -> E:
        """True range; the value before the first row is 0."""
        x = self.x if x is None else self.let(x)
        high, low = self.range_of(x)
        last = self.lag(x, 1)
        return self.let(mx(high - low, abs_(high - last), abs_(low - last)))

    def atr(self, n: int, kind: str = WILDER, x: E | None = None) -> E:
        return self.ma(kind, self.tr(x), n)

    def rsi(self, x: E, n: int, kind: str = WILDER) -> E:
        d = self.let(self.change(x))
        up, down = self.ma(kind, where(d > 0, d, 0.0), n), self.ma(kind, where(d < 0, -d, 0.0), n)
        return self.let(rsi_of(up, down))

    def stoch(self, x: E, n: int, high: E | None = None, low: E | None = None) -> E:
        """Place of x in the range of the last n rows, 0 to 100."""
        if high is None:
            high, low = self.range_of(x)
        h, l = self.max(self.let(high), n), self.min(self.let(low), n)
        return self.let(clamp(div(self.let(x) - l, h - l) * 100, 100, 0))

    def roc(self, x: E, n: int) -> E:
        x = self.let(x)
        last = self.lag(x, n)
        return self.let(where(self.rn > n, div(x - last, last) * 100, 0.0))

    def er(self, x: E, n: int) -> E:
        """Kaufman's efficiency: net over total movement."""
        x = self.let(x)
        return self.let(div(abs_(self.change(x, n)), self.sum(self.let(abs_(self.change(x))), n)))

    # ---- signals -------------------------------------------------------------------------------

    def _was(self, e: E) -> E:
        return self.lag(self.let(e), 1)

    def compare(self, slope: E, reverse: bool = False) -> E:
        """Buy or sell by the sign of a slope, strong where it grows too."""
        s = self.let(settled(-slope if reverse else slope))
        p = self._was(s)
        return where((s > 0) & (s > p), "StrongBuy", where((s < 0) & (s < p), "StrongSell", where(s > 0, "Buy", where(s < 0, "Sell", "None"))))

    def crossing(self, slope: E, value: E, over: float | E, under: float | E, reverse: bool = False) -> E:
        """compare(), and crossings of an overbought and an oversold level."""
        s, v = self.let(settled(-slope if reverse else slope)), self.let(settled(value))
        p, w, over, under = self._was(s), self._was(v), lit(over), lit(under)
        up, down = ((w > under) & (v < under), (w < over) & (v > over)) if reverse else ((w < under) & (v > under), (w > over) & (v < over))
        return where((s > 0) & (s > p), "StrongBuy", where((s < 0) & (s < p), "StrongSell", where((s > 0) | up, "Buy", where((s < 0) | down, "Sell", "None"))))

    def both(self, bull: E, bear: E, reverse: bool = False) -> E:
        """A slope that buys and another that sells."""
        u, d = self.let(settled(-bull if reverse else bull)), self.let(settled(-bear if reverse else bear))
        pu, pd = self._was(u), self._was(d)
        return where((u > 0) & (u > pu), "StrongBuy", where((d < 0) & (d < pd), "StrongSell", where(u > 0, "Buy", where(d < 0, "Sell", "None"))))

    def when(self, buy: E, sell: E) -> E:
        return where(buy, "Buy", where(sell, "Sell", "None"))

    def bands(self, slope: E, upper: E, lower: E, value: E | None = None) -> E:
        """compare(), and a return from beyond a band."""
        s, v, u, l = (self.let(settled(e)) for e in (slope, self.x if value is None else value, upper, lower))
        p, pv, pu, pl = map(self._was, (s, v, u, l))
        return where((s > 0) & (s > p), "StrongBuy", where((s < 0) & (s < p), "StrongSell", where((s > 0) | ((pv < pl) & (v > l)), "Buy", where((s < 0) | ((pv > pu) & (v < u)), "Sell", "None"))))

    def volatile(self, slope: E, value: E, least: E | float) -> E:
        """compare() where volatility reaches a level, nothing elsewhere."""
        return where(settled(lit(value) - lit(least)) >= 0, self.compare(slope), "None")

    def band_result(self, upper: E, middle: E, lower: E, signal: str | None = "bands", names=("UpperBand", "MiddleBand", "LowerBand")) -> Result:
        u, m, l = map(self.let, (upper, middle, lower))
        sig = self.bands(self.x - m, u, l) if signal == "bands" else self.compare(self.x - m) if signal == "compare" else None
        return Result(dict(zip(names, (u, m, l), strict=True)), sig, None)


def half_even(x: float) -> int:
    return round(x)


def length(x: float) -> int:
    """Derived lengths stay within 2 and 530."""
    return int(min(max(int(x), 2), 530))


__all__ = ["ALIASES", "AVERAGES", "EMA", "REGISTRY", "SMA", "WILDER", "WMA", "ChainError", "Context", "Result", "Spec", "average", "half_even", "indicator", "length", "math", "mn", "parts"]
