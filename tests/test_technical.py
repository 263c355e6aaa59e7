"""The technical score's parts on series whose parts are known, and the weights."""

from datetime import date, timedelta

import pytest

from tidemark.operators import technical

BARS = "ticker string, date date, open double, high double, low double, close double, volume double, regime string"


def last(spark, closes, volume=lambda i: 100.0, **how):
    rows = [("A", date(2020, 1, 1) + timedelta(days=i), c, c * 1.01, c * 0.99, c, volume(i), "bull") for i, c in enumerate(closes)]
    return technical.technical_score(spark.createDataFrame(rows, BARS), **how).orderBy("date").collect()[-1]


def test_weights_sum_to_one():
    assert all(sum(w) == pytest.approx(1) and len(w) == len(technical.PARTS) for w in technical.WEIGHTS.values())


def test_parts_of_a_steady_rise(spark):
    x = last(spark, [100 * 1.01**i for i in range(200)], regime="regime")
    # every mean in order, overbought beyond a strong trend's bound, the slope growing, the top of the range, all directions up
    assert (x.part_ma, x.part_rsi, x.part_macd, x.part_stochastic, x.part_adx, x.part_obv) == (100.0, 35.0, 100.0, 35.0, 85.0, 75.0)
    assert (x.part_volume, x.part_wave) == (50.0, 100.0)
    parts = [x[f"part_{p}"] for p in technical.PARTS]
    assert x.score == pytest.approx(sum(a * b for a, b in zip(parts, technical.WEIGHTS["neutral"])))
    assert x.score_regime == pytest.approx(sum(a * b for a, b in zip(parts, technical.WEIGHTS["bull"])))


def test_parts_of_a_steady_fall(spark):
    x = last(spark, [100 * 0.99**i for i in range(200)], lambda i: 100.0 if i < 199 else 500.0)
    assert (x.part_ma, x.part_rsi, x.part_adx, x.part_obv, x.part_volume, x.part_wave) == (0.0, 70.0, 15.0, 25.0, 25.0, 10.0)


def test_nothing_is_known_of_the_first_bar(spark):
    x = last(spark, [100.0])
    assert (x.part_ma, x.part_rsi, x.part_macd, x.part_bands, x.part_volume, x.part_wave, x.part_stochastic, x.part_adx, x.part_obv) == (0.0, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 50.0, 25.0)


def test_suggested_weights(spark):
    rows = [(t, date(2020, 1, 1) + timedelta(days=i), c, c * 1.02, c * 0.97, c, 100.0 + i % 7, "x") for t, n in (("A", 160), ("short", 35)) for i in range(n) for c in [100 + 10 * ((i * 37) % 11 - 5) / 5 + i % 3]]
    got = technical.part_ics(spark.createDataFrame(rows, BARS)).collect()
    for t in ("A", "short"):
        mine = [x for x in got if x.ticker == t]
        assert len(mine) == 9 and sum(x.weight for x in mine) == pytest.approx(1)
        assert all(x.weight > 0.02 for x in mine)
    assert all(x.ic == 0 and x.weight == pytest.approx(1 / 9) for x in got if x.ticker == "short")
