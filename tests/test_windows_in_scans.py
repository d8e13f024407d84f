"""Windows that a scan keeps, against slices; plans deal the rows once."""

from __future__ import annotations

import random

import pytest

from tickloom.functions import kernels
from tickloom.operators import indicators as ta
from tickloom.operators.registry import REGISTRY, Context


@pytest.mark.parametrize("n", [1, 2, 7, None])
@pytest.mark.parametrize("name", ["sum", "avg", "max", "min"])
def test_rolling_windows(name, n):
    rnd = random.Random(n or 0)
    x = [rnd.choice((None, rnd.uniform(-1, 1), 1e12, 1e-6, 3.0)) for _ in range(400)]
    state = None
    for i in range(len(x)):
        w = [v for v in x[0 if n is None else max(0, i - n + 1) : i + 1] if v is not None]
        want = None if not w else {"sum": sum(sorted(w, key=abs)), "avg": sum(sorted(w, key=abs)) / len(w), "max": max(w), "min": min(w)}[name]
        got, state = getattr(kernels, f"roll_{name}")(state, x[i], *([] if n is None else [n]))
        assert got is None if want is None else got == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_a_large_value_leaves_no_trace():
    state = None
    for v in [1e16, 1.0, 2.0, 3.0, 4.0]:
        got, state = kernels.roll_sum(state, v, 3)
    assert got == 9.0
    state = None
    for v in [float("inf"), 1.0, 2.0, 3.0]:
        got, state = kernels.roll_sum(state, v, 3)
    assert got == 6.0


def test_lag_and_last():
    state, out = None, []
    for v in range(5):
        got, state = kernels.roll_lag(state, v, 2)
        out.append(got)
    assert out == [None, None, 0, 1, 2]
    state, out = None, []
    for v in (None, 3, None, 5):
        got, state = kernels.roll_last(state, v)
        out.append(got)
    assert out == [None, 3, 3, 5]


def test_most_plans_have_one_scan_and_no_window_behind_it():
    late = []
    for name, spec in REGISTRY.items():
        if spec.input == "bars":
            s = Context()
            kinds = [k for k, _ in s.stages(list(ta.columns(spec.run(s)).values()), fold=True)]
            if "s" in kinds and "w" in kinds[kinds.index("s") :]:
                late.append(name)
    assert len(late) < 40, late


def test_one_exchange(spark):
    bars = spark.range(1, 50).selectExpr("if(id > 0, 'A', 'B') as symbol", "id as seq", "timestamp_seconds(id) as ts", *(f"id * 1.5D as {c}" for c in ("open", "high", "low", "close")), "1e0 as volume")
    for name in ("TrueStrengthIndex", "Trix", "MovingAverageConvergenceDivergence", "SmoothedRateOfChange"):
        plan = ta.indicator(bars, name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1, name
        assert plan.count("MapInArrow") <= 2
