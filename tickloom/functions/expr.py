"""Scalar expressions over the columns of a bar.

An expression is written once and has two texts: SQL, which Spark runs, and Python, which a scan runs row by
row where a value depends on the one before it. Missing history is 0, and so is a quotient by 0.
"""

from __future__ import annotations

import math

from . import kernels


class E:
    """An expression; `names` are the columns it reads."""

    __slots__ = ("names", "py", "sql")

    def __init__(self, sql: str, py: str | None = None, names: frozenset[str] = frozenset()):
        self.sql, self.py, self.names = sql, sql if py is None else py, names

    def _op(self, other, sign: str, back: bool = False) -> E:
        a, b = (lit(other), self) if back else (self, lit(other))
        return E(f"({a.sql} {sign} {b.sql})", f"({a.py} {sign} {b.py})", a.names | b.names)

    def __add__(self, o):
        return self._op(o, "+")

    def __radd__(self, o):
        return self._op(o, "+", True)

    def __sub__(self, o):
        return self._op(o, "-")

    def __rsub__(self, o):
        return self._op(o, "-", True)

    def __mul__(self, o):
        return self._op(o, "*")

    def __rmul__(self, o):
        return self._op(o, "*", True)

    def __neg__(self):
        return lit(0.0) - self

    def __truediv__(self, o):
        return div(self, o) if isinstance(o, E) else self * (1.0 / o)

    def __rtruediv__(self, o):
        return div(o, self)

    def __lt__(self, o):
        return self._op(o, "<")

    def __le__(self, o):
        return self._op(o, "<=")

    def __gt__(self, o):
        return self._op(o, ">")

    def __ge__(self, o):
        return self._op(o, ">=")

    def eq(self, o):
        b = lit(o)
        return E(f"({self.sql} = {b.sql})", f"({self.py} == {b.py})", self.names | b.names)

    def ne(self, o):
        b = lit(o)
        return E(f"({self.sql} <> {b.sql})", f"({self.py} != {b.py})", self.names | b.names)

    def __and__(self, o):
        return self._op(o, "and")

    def __or__(self, o):
        return self._op(o, "or")


def lit(x) -> E:
    if isinstance(x, E):
        return x
    if isinstance(x, str):
        return E(f"'{x}'")
    text = repr(float(x))
    return E(text if "e" in text else text + "e0", text)


def col(name: str) -> E:
    return E(name, name, frozenset([name]))


def where(test: E, a, b) -> E:
    a, b = lit(a), lit(b)
    return E(f"case when {test.sql} then {a.sql} else {b.sql} end", f"({a.py} if {test.py} else {b.py})", test.names | a.names | b.names)


def div(a, b, zero=0.0) -> E:
    """a / b, or `zero` where b is 0."""
    a, b, z = lit(a), lit(b), lit(zero)
    return E(f"case when {b.sql} <> 0 then {a.sql} / {b.sql} else {z.sql} end", f"_div({a.py}, {b.py}, {z.py})", a.names | b.names | z.names)


def _call(sql: str, py: str):
    def f(*args) -> E:
        args = [lit(a) for a in args]
        names = frozenset().union(*(a.names for a in args))
        return E(sql.format(*(a.sql for a in args), all=", ".join(a.sql for a in args)), py.format(*(a.py for a in args), all=", ".join(a.py for a in args)), names)

    return f


abs_ = _call("abs({0})", "abs({0})")
mx = _call("greatest({all})", "max({all})")
mn = _call("least({all})", "min({all})")
#: sqrt and log of what they are not defined for are 0; exp stops at exp(100).
sqrt = _call("sqrt(greatest({0}, 0e0))", "_sqrt({0})")
log = _call("case when {0} > 0 then ln({0}) else 0e0 end", "_log({0})")
exp = _call("exp(least({0}, 100e0))", "_exp({0})")
power = _call("power({0}, {1})", "_pow({0}, {1})")
sin = _call("sin({0})", "_sin({0})")
cos = _call("cos({0})", "_cos({0})")
tan = _call("tan({0})", "_tan({0})")
atan = _call("atan({0})", "_atan({0})")
asin = _call("asin({0})", "_asin({0})")
acos = _call("acos({0})", "_acos({0})")
floor = _call("cast(floor({0}) as double)", "float(_floor({0}))")
ceil = _call("cast(ceil({0}) as double)", "float(_ceil({0}))")
sign = _call("case when {0} > 0 then 1e0 when {0} < 0 then -1e0 else 0e0 end", "_sign({0})")


#: The limit of k = v k (2 - k) from 1, up to a step of 1e-5; only scans can run it.
gain = _call("gain({0})", "_gain({0})")
#: The first whole number from {0} to {1} without a divisor from 2 to {2}, 0 if there is none; only scans can run it.
undivided = _call(
    "coalesce(list_filter(range(cast({0} as bigint), cast({1} + sign({1} - {0} + 0.5e0) as bigint), cast(sign({1} - {0} + 0.5e0) as bigint)), lambda j: len(list_filter(range(2, cast({2} as bigint) + 1), lambda k: j % k = 0)) = 0)[1], 0) + 0e0",
    "_undivided({0}, {1}, {2})",
)

#: A slope that is 0 but for the last bits counts as 0, whatever the order of its sums.
settled = _call("round({0}, 9)", "round({0}, 9)")


def clamp(x, high, low) -> E:
    return mn(mx(x, low), high)


def sq(x: E) -> E:
    return x * x


def rsi_of(up, down) -> E:
    """100 - 100 / (1 + up / down); 100 without losses, 0 without gains."""
    up, down = lit(up), lit(down)
    return where(down.eq(0), 100.0, where(up.eq(0), 0.0, clamp(100 - div(100, 1 + div(up, down)), 100, 0)))


def _pow(a, b):
    try:
        out = math.pow(a, b)
    except (ValueError, OverflowError):
        return math.nan
    return out


def _gain(v):
    k, step = 1.0, 1.0
    while step > 1e-5:
        after = v * k * (2 - k)
        k, step = after, k - after
    return k


def _undivided(a, b, root):
    way = 1 if b >= a else -1
    return next((float(j) for j in range(int(a), int(b) + way, way) if all(j % k for k in range(2, int(root) + 1))), 0.0)


#: What the Python text of an expression may call.
PYTHON = {
    "_div": lambda a, b, z: a / b if b != 0 else z,
    "_sqrt": lambda x: math.sqrt(x) if x > 0 else 0.0,
    "_log": lambda x: math.log(x) if x > 0 else 0.0,
    "_exp": lambda x: math.exp(min(x, 100.0)),
    "_pow": _pow,
    "_sin": math.sin,
    "_cos": math.cos,
    "_tan": math.tan,
    "_atan": math.atan,
    "_asin": math.asin,
    "_acos": math.acos,
    "_floor": math.floor,
    "_ceil": math.ceil,
    "_sign": lambda x: 1.0 if x > 0 else -1.0 if x < 0 else 0.0,
    "_gain": _gain,
    "_undivided": _undivided,
    "_filter_bank": kernels.filter_bank,
    "_roll_sum": kernels.roll_sum,
    "_roll_avg": kernels.roll_avg,
    "_roll_max": kernels.roll_max,
    "_roll_min": kernels.roll_min,
    "_roll_lag": kernels.roll_lag,
    "_roll_last": kernels.roll_last,
    "_burg_ahead": kernels.burg_ahead,
    "_count_back": kernels.count_back,
    "math": math,
}
