"""Prices by name, markets with gaps, and the average of the golden file."""

from __future__ import annotations

import pytest

from tickloom.operators import indicators as ta
from tickloom.operators.registry import INPUTS

from .test_indicators import sma, values
from .test_more_indicators import candles
from .test_nested_inputs import N, data, stoch  # noqa: F401

PRICES = {
    "Close": lambda r: r[6], "AdjustedClose": lambda r: r[6], "Open": lambda r: r[3], "High": lambda r: r[4], "Low": lambda r: r[5], "Volume": lambda r: r[7],
    "TypicalPrice": lambda r: (r[4] + r[5] + r[6]) / 3, "FullTypicalPrice": lambda r: sum(r[3:7]) / 4, "MedianPrice": lambda r: (r[4] + r[5]) / 2,
    "WeightedClose": lambda r: (r[4] + r[5] + 2 * r[6]) / 4, "AveragePrice": lambda r: (r[3] + r[6]) / 2,
}


@pytest.mark.parametrize("name", sorted(INPUTS))
def test_average_of_an_input_by_name(spark, name):
    rows, df = candles(spark, 60)
    if name in PRICES:
        x = [PRICES[name](r) for r in rows]
    else:
        high, low = ([r[6] for r in rows],) * 2 if name == "Midpoint" else ([r[4] for r in rows], [r[5] for r in rows])
        x = [(max(high[max(0, i - 13) : i + 1]) + min(low[max(0, i - 13) : i + 1])) / 2 for i in range(60)]
    assert values(ta.indicator(df, "SimpleMovingAverage", n=5, input=name), "Sma") == pytest.approx(sma(x, 5))


def test_the_range_of_volume_is_that_of_its_last_two_values(spark, data):  # noqa: F811
    v = data["v"]
    high, low = ([f(v[max(0, i - 1) : i + 1]) for i in range(N)] for f in (max, min))
    got = values(ta.indicator(data["df"], "StochasticOscillator", n=6, input="Volume"), "FastK")
    assert got == pytest.approx(stoch(v, high, low, 6))


def test_unknown_input(spark):
    _, df = candles(spark, 5)
    with pytest.raises(ValueError, match="no input"):
        ta.indicator(df, "SimpleMovingAverage", input="Price")


def test_a_gap_in_the_market(spark):
    (_, df), (_, market) = candles(spark, 40, 5), candles(spark, 40, 6, symbol="M")
    gap = market.filter("seq != 17")
    with pytest.raises(Exception, match="the market has no bar of"):
        ta.indicator(df, "RSMKIndicator", market=gap, n=10, smooth=3).collect()
    assert ta.indicator(df, "RSMKIndicator", market=gap, missing="drop", n=10, smooth=3).count() == 39
    assert ta.indicator(df, "RSMKIndicator", market=market, n=10, smooth=3).count() == 40
