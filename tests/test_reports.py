"""Report operators on small tables, with nulls, ties, repeats and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reports as rep

BARS = "ticker string, date date, close double, volume double"


def bars(spark, closes, ticker="A"):
    return spark.createDataFrame([(ticker, dt.date(2024, 1, 1) + dt.timedelta(days=i), c, 10.0) for i, c in enumerate(closes)], BARS)


def test_outcomes_count_closes_strictly_after(spark):
    b = bars(spark, [10.0, 11.0, None, 12.0, 13.0])
    s = spark.createDataFrame([("A", dt.date(2024, 1, 1), 10.0), ("A", dt.date(2024, 1, 2), 0.0), ("A", dt.date(2024, 1, 4), 12.0), ("B", dt.date(2024, 1, 1), 5.0)], "ticker string, entry_date date, entry_price double")
    got = {(x.ticker, x.entry_date.day): (x.outcome_price, x.return_pct and round(x.return_pct, 6)) for x in rep.signal_outcomes(s, b, 2).collect()}
    assert got == {("A", 1): (12.0, 20.0), ("A", 2): (13.0, None), ("A", 4): (None, None), ("B", 1): (None, None)}


def test_curves_turn_and_end(spark):
    r = spark.createDataFrame([(1, 1, 10.0), (1, 5, -150.0), (2, 1, -100.0), (2, 5, 0.0), (3, 1, 50.0)], "date int, quintile int, ret double")
    got = {(x.leg, x.date): round(x.cum, 6) for x in rep.quintile_curves(r).collect()}
    assert got == {("Q1", 1): 10.0, ("Q1", 2): -100.0, ("Q1", 3): -100.0, ("Q5", 1): -150.0, ("Q5", 2): -150.0, ("long_short", 1): -160.0, ("long_short", 2): -220.0}


def test_usable_and_labels_on_short_and_empty_panels(spark):
    b = bars(spark, [1.0] * 29).unionByName(bars(spark, [1.0] * 30, "B"))
    assert {x.ticker: x.usable for x in rep.usable(b).collect()} == {"A": False, "B": True}
    assert rep.usable(b.limit(0)).count() == 0 and rep.rotation(b.limit(0)).count() == 0 and rep.momentum_table(b.limit(0)).count() == 0
    assert [x.label for x in rep.labels(bars(spark, [1.0, 2.0, 1.0]), 1).orderBy("date").collect()] == [1.0, 0.0, None]


def test_publishable_needs_growth(spark):
    stats = spark.createDataFrame([(1, 105), (2, 104), (3, 0), (4, 1)], "horizon int, n int")
    log = spark.createDataFrame([(1, 100), (2, 100)], "horizon int, n int")
    assert {x.horizon for x in rep.publishable(stats, log).collect()} == {1, 4}


def test_candidates_keep_ties_in_order_and_one_to_sell(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "ticker string, s double").withColumn("date", F.lit(1))
    assert sorted((x.side, x.ticker) for x in rep.candidates(r, "s", ["date"], 1).collect()) == [("buy", "a"), ("sell", "b")]


def test_paired_differences_without_spread(spark):
    rows = [("up", 1.0, 2.0), ("up", 2.0, 3.0), ("same", 1.0, 1.0), ("same", 2.0, 2.0), ("one", 1.0, 9.0), ("mixed", 1.0, 2.0), ("mixed", 1.0, 0.0), ("gap", None, 1.0), ("gap", 1.0, 2.0)]
    got = {x.k: x for x in rep.paired_difference(spark.createDataFrame(rows, "k string, a double, b double"), "a", "b", ["k"]).collect()}
    assert {k: (x.t, x.verdict) for k, x in got.items()} == {"up": (999.0, "better"), "same": (0.0, "noise"), "one": (None, "too few"), "mixed": (0.0, "noise"), "gap": (None, "too few")}
    assert got["up"].wins_pct == 100.0 and got["mixed"].wins_pct == 50.0


def test_slippage_takes_a_measured_percentile_and_adds_round_trips(spark):
    from tidemark.operators import ledger

    rows = [("entry", "buy", 100.0, 100 + x / 100) for x in (2.0, 4.0)] + [("stop_exit", "sell", 100.0, 100 - x / 100) for x in (6.0, 8.0)] + [("entry", "buy", 100.0, None)]
    rows += [("many", "buy", 100.0, 100 + x / 100) for x in (5.0, 1.0, 2.0, 2.0, 3.0, 4.0, 6.0, 7.0, 8.0, 9.0, 10.0)]
    got = ledger.slippage(spark.createDataFrame(rows, "leg string, side string, ref double, fill double"), ["leg"])
    s = {x.leg: x for x in got.collect()}
    assert (s["entry"].n, s["entry"].median_bp, s["entry"].p90_bp) == (2, pytest.approx(3.0), pytest.approx(2.0))
    assert s["many"].p90_bp == pytest.approx(8.0)  # the ninth of eleven
    trips = {x.exit_leg: x for x in ledger.round_trips(got).collect()}
    assert (trips["stop_exit"].bp, trips["stop_exit"].r) == (pytest.approx(10.0), pytest.approx(1 / 3))
    assert ledger.round_trips(got.where("leg != 'entry'")).count() == 0
