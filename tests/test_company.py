"""Fundamentals as filed: a walk over all filings for each bar, and the cases that must stay unmeasured."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import company

FACTS = "ticker string, end date, filed date, revenue double, net_income double, operating_income double, operating_cash_flow double, capex double"
ENDS = [date(2023 + (i // 4), (i % 4) * 3 + 3, 28) for i in range(12)]


def year(ends=ENDS[-4:], late=None, **own):
    cols = {"revenue": [1000.0] * 4, "net_income": [80.0] * 4, "operating_income": [100.0] * 4, "operating_cash_flow": [120.0] * 4, "capex": [20.0] * 4} | own
    return [("A", e, e + timedelta(days=late or 30), *[cols[k][i] for k in company.ITEMS]) for i, e in enumerate(ends)]


def measured(spark, facts, day=date(2026, 6, 1), shares=(("A", date(2024, 8, 1), 100),)):
    bars = spark.createDataFrame([("A", day, 50.0)], "ticker string, date date, close double")
    out = company.ratios(bars, spark.createDataFrame(facts, FACTS), spark.createDataFrame(list(shares), "ticker string, filed date, shares long"), spark.createDataFrame([("A", date(2024, 8, 1), 2000.0)], "ticker string, filed date, equity double"))
    return out.first()


def test_four_quarters_are_measured(spark):
    x = measured(spark, year())
    assert (x.margin, x.roe, x.pe, x.fcf_yield) == pytest.approx((10.0, 16.0, 50 / 3.2, 8.0))


def test_ragged_quarters_make_no_ratio(spark):
    x = measured(spark, year(operating_income=[None, float("nan"), 100.0, 100.0]))
    assert x.margin is None
    assert x.roe == pytest.approx(16.0)


def test_short_history_is_unmeasured(spark):
    x = measured(spark, year()[1:])
    assert (x.pe, x.margin, x.fcf_yield) == (None, None, None)


def test_nothing_filed_later_is_seen(spark):
    old, new = year(), year([date(2026, 3, 28)] * 1, late=120, revenue=[9e9])
    assert measured(spark, old + new, date(2026, 7, 25)) == measured(spark, old, date(2026, 7, 25))
    assert measured(spark, old + new, date(2026, 7, 26)).margin < 1e-4


def test_shares_filed_later_stand_in_for_none(spark):
    assert measured(spark, year(), shares=[("A", date(2027, 1, 1), 200)]).pe == pytest.approx(50 / 1.6)
    assert measured(spark, year(), shares=[("B", date(2024, 1, 1), 200)]).pe is None


def test_price_to_earnings_is_capped(spark):
    assert measured(spark, year(net_income=[0.1] * 4)).pe == 200.0


def walk(facts, day, strict):
    seen = [f for f in facts if (f[2] < day if strict else f[2] <= day)]
    return sorted(seen, key=lambda f: f[1], reverse=True)[:8]


@pytest.mark.parametrize("strict", [False, True])
def test_known_quarters_match_a_walk_over_filings(spark, strict):
    rng = random.Random(8)
    facts = []
    for t in "ABC":
        for i in range(30):
            end = date(2018, 1, 1) + timedelta(days=91 * i)
            facts.append((t, end, end + timedelta(days=rng.choice([20, 40, 41, 300])), float(i), 1.0, None, 2.0, 3.0))
    bars = [(t, date(2018, 1, 1) + timedelta(days=rng.randrange(3200)), float(i)) for t in "ABCD" for i in range(60)]
    none = spark.createDataFrame([], "ticker string, filed date, shares long"), spark.createDataFrame([], "ticker string, filed date, equity double")
    got = company.known_on(spark.createDataFrame(bars, "ticker string, date date, close double"), spark.createDataFrame(facts, FACTS), *none, strict=strict).collect()
    assert len(got) == len(bars)
    for x in got:
        want = walk([f for f in facts if f[0] == x.ticker], x.date, strict)
        assert [(q.end, q.revenue) for q in x.quarters or []] == [(f[1], f[3]) for f in want]


def test_year_figures_need_two_whole_years(spark):
    def figures(ends):
        facts = [("A", e, e + timedelta(days=30), 100.0 + i, 10.0 + i, None, 20.0, 5.0) for i, e in enumerate(ends)]
        bars = spark.createDataFrame([("A", date(2026, 6, 1), 50.0)], "ticker string, date date, close double")
        rest = spark.createDataFrame([("A", date(2024, 8, 1), 100)], "ticker string, filed date, shares long"), spark.createDataFrame([("A", date(2024, 8, 1), -5.0)], "ticker string, filed date, equity double")
        return company.year_figures(bars, spark.createDataFrame(facts, FACTS), *rest).collect()

    (x,) = figures(ENDS[-8:])
    assert (x.revenue, x.revenue_yoy, x.income_yoy, x.fcf, x.equity) == pytest.approx((422.0, 422 / 406 - 1, 62 / 46 - 1, 60.0, None))
    assert figures(ENDS[-7:]) == []
    assert figures(ENDS[-9:-5] + ENDS[-4:]) == []  # a quarter is missing between the years


def test_drawdown_of_an_array(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([([10.0, 12.0, 6.0, 15.0, 9.0],), ([],), ([-1.0, 5.0],)], "c array<double>").select(company.window_drawdown(F.col("c")).alias("d"))
    assert [x.d for x in got.collect()] == [-50.0, 0.0, 0.0]
