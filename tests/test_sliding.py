"""Trailing percentiles and order plans against plain loops."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import allocation, sliding

DAY = date(2020, 1, 1)


@pytest.mark.parametrize(("days", "least"), [(250, 20), (7, 2), (1, 1)])
def test_percentiles_match_all_pairs(spark, days, least):
    rng = random.Random(days)
    rows = [(i, DAY + timedelta(days=rng.randrange(900)), rng.choice([float(rng.randrange(40)), rng.gauss(0, 5)])) for i in range(500)]
    rows += [(1000 + i, DAY + timedelta(days=400), 3.0) for i in range(40)]  # one day, one value
    rows += [(2000, None, 1.0), (2001, DAY, None), (2002, DAY + timedelta(days=300), float("nan")), (2003, date(1969, 12, 30), 1.0), (2004, date(1970, 1, 2), 2.0)]
    got = {x.i: x for x in sliding.trailing_percentile(spark.createDataFrame(rows, "i int, d date, v double"), "d", "v", days, least).collect()}
    known = [r for r in rows if r[1] and r[2] is not None and r[2] == r[2]]
    assert len(got) == len(rows)
    for i, d, v in rows:
        pool = [w for _, e, w in known if d and v is not None and v == v and d - timedelta(days=days) <= e < d]
        assert got[i].pool == len(pool), i
        want = sum(w < v for w in pool) / len(pool) if len(pool) >= least else None
        assert got[i].percentile == (None if want is None else pytest.approx(want)), i


PRICES, TARGETS = {"A": 120.0, "B": 98.0, "C": 87.0}, {"A": 0.6, "B": 0.3, "C": 0.1}


def orders(spark, held, cash, prices=None, **how):
    accounts = spark.createDataFrame([(1, cash, {k: float(v) for k, v in held.items()})], "account long, cash double, held map<string,double>")
    px = spark.createDataFrame(list((prices or PRICES).items()), "asset string, price double")
    out = allocation.plan_orders(accounts, px, TARGETS, **how).orderBy("place").collect()
    return [(x.asset, x.qty) for x in out]


def test_orders_never_sell_nor_exceed_the_cash(spark):
    assert "B" not in dict(orders(spark, {"B": 100}, 714.0))
    for cash in (0.0, 87.0, 500.0, 12345.67):
        got = orders(spark, {"A": 3, "C": 1}, cash)
        assert all(q > 0 and q == int(q) for _, q in got)
        assert sum(q * PRICES[a] for a, q in got) <= cash * 0.97


def test_largest_gap_comes_first(spark):
    got = orders(spark, {}, 714.0)
    assert got[0] == ("A", 3.0)
    assert "C" not in dict(got)  # a unit costs more than its target
    held = {"A": 42, "B": 15, "C": 8}
    assert orders(spark, held, 714.0, PRICES | {"A": 60.0})[0] == ("A", 11.0)
    assert dict(orders(spark, {}, 714.0, whole=False, buffer_bp=0.0)) == pytest.approx({t: 714 * w / PRICES[t] for t, w in TARGETS.items()})


def test_orders_need_prices_and_whole_targets(spark):
    with pytest.raises(ValueError):
        allocation.plan_orders(None, None, {"A": 0.5})
    with pytest.raises(Exception, match="no price for C"):
        orders(spark, {}, 714.0, {"A": 1.0, "B": 1.0})
