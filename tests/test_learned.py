"""The learned signal's averages, folds and areas against their definitions."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import learned

DAY = date(2020, 1, 1)


def bars(spark, n, tickers="AB", seed=1):
    rng, rows = random.Random(seed), []
    for t in tickers:
        p = 100.0
        for i in range(n):
            p *= 1 + rng.gauss(0, 0.02)
            rows.append((t, DAY + timedelta(days=i), p, p * 1.01, p * 0.99, p, float(rng.randint(1, 9))))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double"), rows


def test_adjusted_averages(spark):
    df, rows = bars(spark, 300)
    got = {(x.ticker, x.date): x.e for x in learned.adjusted_ewm(df, "close", 12, "e").collect()}
    a = 1 - 2 / 13
    for t in "AB":
        v = [r[5] for r in rows if r[0] == t]
        for i in (0, 1, 5, 40, 299):
            w = [a**k for k in range(i + 1)]
            assert got[t, DAY + timedelta(days=i)] == pytest.approx(sum(x * y for x, y in zip(w, v[: i + 1][::-1])) / sum(w))


def test_no_training_day_is_near_a_test_day(spark):
    df, _ = bars(spark, 200, "ABC")
    f = learned.purged_folds(df, folds=4, horizon=7, embargo=0.05).select("fold", "role", "pos").distinct().collect()
    for fold in range(4):
        days = {r: {x.pos for x in f if x.fold == fold and x.role == r} for r in ("test", "train", "purged")}
        assert sum(map(len, days.values())) == 200 and len(days["test"]) == 50
        last = max(days["test"])
        assert all(min(abs(t - d) for t in days["test"]) > 7 for d in days["train"] if d < last)
        assert all(d >= last + 1 + 7 + 10 for d in days["train"] if d > last)


def test_areas_equal_counting_pairs(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([0.1, 0.2, 0.5, rng.random()]), float(rng.random() < 0.4)) for g in (1, 2) for _ in range(120)] + [(3, 0.5, 1.0), (4, None, 1.0), (4, 0.1, None)]
    got = {x.g: x for x in learned.area_under_curve(spark.createDataFrame(rows, "g int, score double, label double"), ["g"]).collect()}
    for g in (1, 2):
        pos, neg = ([s for h, s, y in rows if h == g and y == k] for k in (1.0, 0.0))
        assert got[g].auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert got[3].auc is None and 4 not in got


def test_the_signal_is_scored_out_of_fold(spark):
    df, _ = bars(spark, 260)
    scored = learned.validated(df, horizon=5, folds=3, trees=3, least=10)
    assert scored.groupBy("ticker", "date").count().where("count > 1").isEmpty()
    aucs = learned.area_under_curve(scored, ["fold"])
    assert all(0.2 < x.auc < 0.8 for x in aucs.collect())  # a random walk has nothing to learn
    assert learned.spread(aucs).first().n_folds == 3
    with pytest.raises(ValueError):
        learned.validated(df, folds=10, least=30)


def test_features_wait_for_their_windows(spark):
    df, _ = bars(spark, 70, "A")
    x = learned.features(df).agg(*[F.count(c).alias(c) for c in learned.FEATURES]).first()
    assert (x.ma_align, x.rsi, x.macd_hist, x.bb_pos, x.vol_ratio, x.mom_20, x.mom_5, x.hl_pos, x.atr_ratio) == (70, 56, 70, 51, 51, 50, 65, 51, 57)
