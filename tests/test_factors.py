"""Factor snapshots, weights out of sample and correlations against plain loops."""

import random
from datetime import date, timedelta
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F

from tidemark.functions.formulas import correlation
from tidemark.operators import factors

DAY = date(2020, 1, 1)
RATIOS = "ticker string, date date, pe double, fcf_yield double, roe double, margin double, accrual_q double"


def market(spark, names=7, n=300, young=80):
    rng, rows = random.Random(9), []
    for k in range(names):
        p = 100.0
        for i in range(n):
            p *= 1 + rng.gauss(0, 0.02)
            if k or i >= n - young:  # the first name came late
                rows.append((f"T{k}", DAY + timedelta(days=i), p))
    return spark.createDataFrame(rows, "ticker string, date date, close double"), rows


def test_snapshots(spark):
    bars, rows = market(spark)
    day = DAY + timedelta(days=299)
    ratios = spark.createDataFrame([(f"T{k}", day, float(k), None if k < 5 else 1.0, None, 2.0 * k, 50.0) for k in range(6)], RATIOS)
    days = spark.createDataFrame([(day,), (DAY + timedelta(days=40),)], "date date")
    got = {x.ticker: x for x in factors.snapshots(bars, ratios, days).collect()}
    assert set(got) == {f"T{k}" for k in range(7)}  # the early day has too short histories
    closes = {t: [c for u, _, c in rows if u == t] for t in got}
    m = {t: (c[-1] / c[-64] - 1) * 100 for t, c in closes.items()}
    for t in got:
        assert got[t].mom_3m == pytest.approx((m[t] - mean(m.values())) / (stdev(m.values()) + 1e-9))
    old = {t: (c[-21] / c[-252] - 1) * 100 for t, c in closes.items() if len(c) > 252}
    assert got["T0"].mom_12_1 is None and got["T0"].low_vol_252 is None
    assert got["T3"].mom_12_1 == pytest.approx((old["T3"] - mean(old.values())) / (stdev(old.values()) + 1e-9))
    pe = [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    assert got["T1"].value == pytest.approx(-(1 - mean(pe)) / (stdev(pe) + 1e-9) * 4 / 7)  # two cash yields are too few to count
    assert got["T6"].value == 0 and got["T6"].quality == 0  # unknown counts as the mean


def test_weights_come_from_training_dates_alone(spark):
    at = lambda i: DAY + timedelta(days=i)
    rows = [(at(i), f, at(i + 21), ic) for i in range(0, 100, 10) for f, ic in (("good", 0.2 if i < 70 else 0.05), ("bad", -0.1))]
    got = {x.factor: x for x in factors.out_of_sample(spark.createDataFrame(rows, "date date, factor string, until date, ic double"), F.lit(at(69))).collect()}
    assert (got["good"].n_train, got["good"].n_test) == (5, 3)  # those that reach over the end count for neither
    assert got["good"].weight == pytest.approx(0.2 / 0.205) and got["bad"].weight == pytest.approx(0.005 / 0.205)
    assert got["good"].train_composite == pytest.approx((0.2 * 0.2 - 0.005 * 0.1) / 0.205)
    assert got["good"].overfit and got["bad"].overfit


def test_correlation_of_a_constant_is_null(spark):
    rows = [("c", 1.0, float(i)) for i in range(5)] + [("r", float(i), 2.0 * i + (i % 2)) for i in range(6)] + [("r", None, 9e9), ("r", 9e9, None), ("one", 1.0, 1.0)]
    got = {x.g: x.r for x in spark.createDataFrame(rows, "g string, x double, y double").groupBy("g").agg(correlation("x", "y").alias("r")).collect()}
    xs, ys = range(6), [2.0 * i + (i % 2) for i in range(6)]
    cov = sum((a - mean(xs)) * (b - mean(ys)) for a, b in zip(xs, ys)) / 5
    assert got["c"] is None and got["one"] is None and got["r"] == pytest.approx(cov / stdev(xs) / stdev(ys))
