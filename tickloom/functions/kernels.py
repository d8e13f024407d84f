"""Steps of scans that keep arrays: called with the state of the row before, and the values of this row."""

from __future__ import annotations

import math
from collections import deque
from functools import cache

import numpy as np


@cache
def _periods(low: int, high: int):
    j = np.arange(low, high + 1)
    return j, np.cos(np.clip(2 * math.pi / j, 0.01, 0.99))


def filter_bank(state, y: float, i: float, low: float, high: float, n2: float):
    """The dominant cycle of a bank of band-pass filters of all periods from low to high.

    All of them read the past values of the longest one's filter, as the last period of a row is what it leaves.
    state: the last 2 * high values, the newest first, of y, of its quadrature, and of the filters of both.
    """
    low, high = int(low), int(high)
    j, beta = _periods(low, high)
    if state is None:
        state = [np.zeros(2 * high) for _ in range(4)]
    ys, qs, re, im = state
    move = 2 / math.pi * (y - ys[0])
    gamma = 1 / np.cos(np.clip(4 * math.pi * max(0.5 - 0.015 * i, 0.15) / j, 0.01, 0.99))
    alpha = gamma - np.sqrt(gamma * gamma - 1)
    real = 0.5 * (1 - alpha) * (y - ys[j - 1]) + beta * (1 + alpha) * re[j - 1] - alpha * re[2 * j - 1]
    imag = 0.5 * (1 - alpha) * (j * move - qs[j - 1]) + beta * (1 + alpha) * im[j - 1] - alpha * im[2 * j - 1]
    power = real * real + imag * imag
    top = np.maximum.accumulate(power)
    share = np.divide(power, top, out=np.zeros(len(j)), where=top != 0)
    db = np.where(share > 0, np.minimum(-n2 / math.log(n2) * np.log(0.01 / (1 - 0.99 * np.where(share > 0, share, 0.5))), high), 0.0)
    weight = np.where(db <= 3, high - db, 0.0)
    total = weight.sum()
    kept = [np.concatenate(([v], old[:-1])) for v, old in zip((y, high * move, real[-1], imag[-1]), state, strict=True)]
    return float((weight * j).sum() / total) if total else 0.0, kept


def burg_ahead(state, x: float, ahead: float, order: float, lower: float, upper: float):
    """The value `ahead` rows on of a linear prediction whose coefficients Burg's method fits to the last `upper` rows.

    The coefficients are smoothed by a Hann window of `lower` places, which leaves one weight for all of them.
    state: the last `upper` values, the newest first.
    """
    order, lower, upper = int(order), int(lower), int(upper)
    v = np.zeros(upper) if state is None else state
    v = np.concatenate(([x], v[:-1]))
    b1, b2 = v[:-1], v[1:]
    coef = []
    for j in range(1, order + 1):
        if j > 1:
            b1, b2 = b1 - last * b2, np.append((b2 - last * b1)[1:], 0.0)
        m = upper - j
        power = b1[:m] @ b1[:m] + b2[:m] @ b2[:m]
        c = 2 * (b1[:m] @ b2[:m]) / power if power else 0.0
        coef = [a - c * b for a, b in zip(coef, reversed(coef), strict=True)] + [c]
        last = c
    places = ([coef[-1], *reversed(coef)] + [0.0] * lower)[:lower]
    hann = [1 - math.cos(min(max(2 * math.pi * k / (lower + 1), 0.01), 0.99)) for k in range(1, lower + 1)]
    h = sum(a * b for a, b in zip(hann, places, strict=True)) / sum(hann)
    line = list(v[:order][::-1])
    for _ in range(int(ahead)):
        line.append(h * sum(line[-order:]))
    return float(line[-1]), v


def count_back(highs: list[float], lows: list[float], x: float, top: float, bottom: float, n: float):
    """The count-back line: from each row at the window's low, the second higher high before it; from each at its high,
    the second higher low. The counts go on from row to row, the last line found stays. Arrays end with the newest row.
    """
    n = int(n)
    h, l = ([*reversed(a), *[0.0] * (2 * n + 2)] for a in (highs, lows))
    line, up, down = x, 0, 0
    for j in range(n + 1):
        if l[j] == bottom:
            for k in range(j + 1, j + n + 1):
                down += h[k] > h[j]
                if down == 2:
                    line = h[k]
                    break
        if h[j] == top:
            for k in range(j + 1, j + n + 1):
                up += l[k] > l[j]
                if up == 2:
                    line = l[k]
                    break
    return line


# ---- windows -------------------------------------------------------------------------------------
# As SQL has them: a null is no value, and without a value the result is null. n rows, or all so far.


def roll_sum(state, x, n=None):
    """state: the last n values, their sum, what it lacks, and how many are no null."""
    if state is None:
        state = [deque(), 0.0, 0.0, 0]
    values, total, rest, count = state
    gone = None
    if n is not None:
        values.append(x)
        if len(values) > n:
            gone = values.popleft()
    for v in (x, None if gone is None else -gone):
        if v is not None:  # compensated, so that what a large value took is there again once it is gone
            new = total + v
            rest += (total - new) + v if abs(total) >= abs(v) else (v - new) + total
            total = new
    count += (x is not None) - (gone is not None)
    if total - total != 0 and n is not None:  # an infinite value, which can't be taken off again
        total, rest = float(sum(v for v in values if v is not None)), 0.0
    state[1:] = total, rest, count
    return (total + rest if count else None), state


def roll_avg(state, x, n=None):
    total, state = roll_sum(state, x, n)
    return (None if total is None else total / state[3]), state


def _roll_best(state, x, n):
    """state: the number of rows, and the values that are best from their row on, by row."""
    if state is None:
        state = [0, deque()]
    state[0] += 1
    best = state[1]
    if x is not None:
        while best and best[-1][1] <= x:
            best.pop()
        best.append((state[0], x))
    if n is not None and best and best[0][0] <= state[0] - n:
        best.popleft()
    return (best[0][1] if best else None), state


def roll_max(state, x, n=None):
    return _roll_best(state, x, n)


def roll_min(state, x, n=None):
    y, state = _roll_best(state, None if x is None else -x, n)
    return (None if y is None else -y), state


def roll_lag(state, x, k):
    if state is None:
        state = deque([None] * (k + 1), k + 1)
    state.append(x)
    return state[0], state


def roll_last(state, x):
    return (state if x is None else x), (state if x is None else x)
