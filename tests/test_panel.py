"""Panel operators against pandas and brute force on small frames, nulls, ties and short histories included."""

import datetime as dt
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import formulas
from tidemark.operators import cross_section as xs
from tidemark.operators import edgar, inference, joins, ledger, simulate, text
from tidemark.operators import indicators as ind
from tidemark.plans import catalog
from tidemark.sources import tables

D0 = dt.date(2020, 1, 1)
BAR = "ticker string, date date, open double, high double, low double, close double, volume double"


def walk(n, ticker="A", seed=1):
    r, c, out = random.Random(seed), 100.0, []
    for i in range(n):
        o, c = c, c * (1 + r.uniform(-0.04, 0.04))
        out.append((ticker, D0 + dt.timedelta(i), o, max(o, c) * 1.01, min(o, c) * 0.99, c, r.uniform(1, 9)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(300) + walk(40, "B", 2) + walk(1, "C", 3), BAR).cache()


def column(frame, name, ticker="A"):
    return [r[name] for r in frame.where(F.col("ticker") == ticker).orderBy("date").collect()]


def test_rsi_macd_and_adx_follow_pandas(bars):
    close = pd.Series(column(bars, "close"))
    d = close.diff()
    up, down = d.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-d).clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean()
    got = column(simulate.rsi(bars), "rsi")
    assert got[0] is None or math.isnan(got[0])
    assert got[-1] == pytest.approx((100 - 100 / (1 + up / down)).iloc[-1])
    m = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    assert column(simulate.macd(bars), "histogram")[-1] == pytest.approx((m - m.ewm(span=9, adjust=False).mean()).iloc[-1])
    assert 0 <= column(simulate.adx(bars), "adx")[-1] <= 100


def test_recurrence_carries_over_blocks_and_nulls(spark):
    draw = random.Random(4)
    known = [None if i in (0, 1, 700) or draw.random() < 0.1 else (float("nan") if i == 50 else draw.gauss(0, 5)) for i in range(1500)]
    known[329:333] = [None] * 4
    frame = spark.createDataFrame([("A", i, v) for i, v in enumerate(known)] + [("B", 0, None), ("B", 1, None)], "ticker string, date int, v double")
    for alpha in (0.5, 1 / 14, 0.99, 1.0):
        want = pd.Series(known, dtype="float64").ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        got = column(simulate.ewm(frame, "v", alpha, "y"), "y")
        assert got[:2] == [None, None] and got[2:] == pytest.approx(list(want[2:]), rel=1e-9, abs=1e-12)
        assert column(simulate.ewm(frame, "v", alpha, "y"), "y", "B") == [None, None]


def test_windows_need_their_rows(bars):
    close = pd.Series(column(bars, "close"))
    got = column(ind.bollinger(bars), "upper")
    assert got[18] is None and got[19] == pytest.approx(close[:20].mean() + 2 * close[:20].std())
    assert column(ind.momentum(bars), "momentum", "B") == [0.0] * 40
    assert column(ind.momentum(bars), "momentum")[-1] == pytest.approx((close.iloc[-21] / close.iloc[-252] - 1) * 100)
    assert column(ind.vol_target(bars), "multiplier", "C") == [1.0]
    assert min(column(ind.drawdown(bars), "drawdown")) == pytest.approx(((close / close.cummax() - 1) * 100).min())


def test_swings_and_gaps(bars):
    highs = column(bars, "high")
    want = [5 <= i < 295 and highs[i] > max(highs[i - 5 : i]) and highs[i] > max(highs[i + 1 : i + 6]) for i in range(300)]
    assert column(ind.swings(bars), "swing_high") == want
    assert ind.fair_value_gaps(bars).where("ticker = 'C'").count() == 0


def test_first_touch_is_the_first_of_its_kind(spark):
    bars = [("A", i, h, lo) for i, (h, lo) in enumerate([(10.0, 9.0), (10.2, 9.8), (10.5, 9.9), (12.5, 9.0), (13.0, 12.0)])]
    b = spark.createDataFrame(bars, "ticker string, pos int, high double, low double")
    plans = [("w", "A", 0, "long", 9.7, 10.0, 8.0, 12.0, 2.0), ("same", "A", 0, "long", 9.7, 10.0, 9.1, 12.0, 2.0), ("none", "A", 0, "long", 1.0, 2.0, 0.5, 3.0, 2.0), ("s", "A", 0, "short", 10.0, 10.3, 11.0, 9.85, 1.5), ("late", "A", 4, "long", 9.0, 10.0, 8.0, 12.0, 2.0)]
    p = spark.createDataFrame(plans, "plan_id string, ticker string, start_pos int, direction string, entry_low double, entry_high double, stop double, target double, rr double")
    got = {r.plan_id: (r.outcome, r.r, r.fill_pos, r.exit_pos) for r in simulate.first_touch(p, b).collect()}
    assert got == {"w": ("win", 2.0, 1, 3), "same": ("loss", -1.0, 1, 3), "none": ("nofill", 0.0, None, None), "s": ("win", 1.5, 1, 1), "late": ("nofill", 0.0, None, None)}


def test_cooldown_walks_in_order(spark):
    t = spark.createDataFrame([("A", f"p{i}", i) for i in (0, 3, 10, 12, 25)], "ticker string, plan_id string, start_pos int")
    assert sorted(r.plan_id for r in simulate.cooled_down(t, 10).collect()) == ["p0", "p10", "p25"]


def test_cooldown_waits_for_the_landing(spark):
    r, plans = random.Random(8), []
    b = [(t, i, x[3], x[4]) for t, seed in (("A", 4), ("B", 5)) for i, x in enumerate(walk(400, t, seed))]
    closes = {(t, i): (h + lo) / 2 for t, i, h, lo in b}
    for (t, i), c in closes.items():
        if r.random() < 0.6:
            plans.append((f"{t}{i}", t, i, "long", c * 0.9, c * r.choice([0.7, 0.97, 1.01]), c * r.choice([0.5, 0.96]), c * r.choice([1.05, 3.0]), 2.0))
    p = spark.createDataFrame(plans, "plan_id string, ticker string, start_pos int, direction string, entry_low double, entry_high double, stop double, target double, rr double")
    trades = simulate.first_touch(p, spark.createDataFrame(b, "ticker string, pos int, high double, low double"))
    low, high, want, landings = {x[:2]: x[3] for x in b}, {x[:2]: x[2] for x in b}, set(), set()
    for ticker in ("A", "B"):
        own, i = {x[2]: x for x in plans if x[1] == ticker}, 0
        while i < 400:
            if i not in own:
                i += 1
                continue
            name, _, _, _, _, entry, stop, target, _ = own[i]
            want.add(name)
            fill = next((j for j in range(i + 1, min(i + 21, 400)) if low[ticker, j] <= entry), None)
            out = None if fill is None else next((k for k in range(fill, min(fill + 40, 400)) if low[ticker, k] <= stop or high[ticker, k] >= target), None)
            landings.add("exit" if out is not None else "timeout" if fill is not None else "nofill")
            i = max(i + 1, (out if out is not None else fill + 40 if fill is not None else i + 20) + 3)
    assert landings == {"exit", "timeout", "nofill"}
    assert {x.plan_id for x in simulate.cooled_down(trades).collect()} == want


def test_asof_strict_stale_and_ties(spark):
    day = lambda n: D0 + dt.timedelta(n)
    left = spark.createDataFrame([("A", day(0)), ("A", day(5)), ("A", day(90)), ("B", day(5)), (None, day(5))], "k string, d date")
    right = spark.createDataFrame([("A", day(5), 1, 7.0), ("A", day(5), 2, 8.0), ("A", day(4), 9, None)], "k string, f date, o int, v double")
    run = lambda **kw: {(r.k, r.d): r.v for r in joins.asof(left, right, "k", "d", "f", ["v"], tie=["o"], **kw).collect()}
    assert run() == {("A", day(0)): None, ("A", day(5)): 8.0, ("A", day(90)): 8.0, ("B", day(5)): None, (None, day(5)): None}
    assert run(strict=True)[("A", day(5))] is None and run(max_stale_days=10)[("A", day(90))] is None


def test_nearest_prefers_the_earlier_of_equals(spark):
    day = lambda n: D0 + dt.timedelta(n)
    left = spark.createDataFrame([("A", day(10)), ("A", day(50))], "k string, d date")
    right = spark.createDataFrame([("A", day(7), 1.0), ("A", day(13), 2.0), ("A", day(61), 3.0)], "k string, r date, v double")
    assert {r.d: r.v for r in joins.nearest(left, right, "k", "d", "r", "v", 10).collect()} == {day(10): 1.0, day(50): None}


def test_ranks_and_ic(spark):
    rows = [("d", n, s, f) for n, s, f in [("a", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 3.0, 3.0), ("e", 4.0, 5.0), ("f", 5.0, 4.0), ("g", None, 1.0)]]
    f = spark.createDataFrame(rows, "date string, ticker string, s double, r double")
    p = pd.DataFrame(rows, columns=["d", "t", "s", "r"]).dropna()
    got = xs.spearman_ic(f, "s", "r", ["date"]).first()
    assert got.n == 5 and got.ic == pytest.approx(p.s.rank().corr(p.r.rank()))
    flat = xs.winsorised_score(f.withColumn("s", F.lit(2.0)), "s", ["date"], "z")
    assert {r.z for r in flat.collect()} == {50.0}
    assert sorted(r.quintile for r in xs.quintiles(f, "s", ["date"]).collect()) == [1, 2, 3, 4, 5, 5]


def test_newey_west_without_lags_is_the_plain_error(spark):
    v = [0.1, -0.2, 0.3, 0.05, 0.2]
    s = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "slug string, date int, ic double")
    assert xs.newey_west(s, "ic", "date", ["slug"], 0).first().se == pytest.approx(pd.Series(v).sem())
    alternating = spark.createDataFrame([("a", i, (-1.0) ** i) for i in range(40)], "slug string, date int, ic double")
    assert xs.newey_west(alternating, "ic", "date", ["slug"], 1).first().se >= 0


def test_derived_fourth_quarter(spark):
    d = dt.date
    rows = [("A", "t", "USD", d(2020, 1, 1), d(2020, 3, 31), 1.0, d(2020, 5, 1), "q"), ("A", "t", "USD", d(2020, 4, 1), d(2020, 6, 30), 2.0, d(2020, 8, 1), "q"), ("A", "t", "USD", d(2020, 7, 1), d(2020, 9, 30), 3.0, d(2020, 11, 1), "q"), ("A", "t", "USD", d(2020, 1, 1), d(2020, 12, 31), 10.0, d(2021, 2, 1), "k"), ("B", "t", "USD", d(2020, 1, 1), d(2020, 12, 31), 10.0, d(2021, 2, 1), "k")]
    f = spark.createDataFrame(rows, "ticker string, tag string, unit string, start date, end date, val double, filed date, form string")
    got = {(r.ticker, r.end): r.val for r in edgar.with_derived_q4(f).collect()}
    assert got[("A", d(2020, 12, 31))] == 4.0 and len(got) == 4
    late = f.unionByName(spark.createDataFrame([("A", "t", "USD", d(2020, 10, 1), d(2020, 12, 31), 5.0, d(2021, 1, 15), "q")], f.schema))
    assert {(r.ticker, r.end): r.val for r in edgar.with_derived_q4(late).collect()}[("A", d(2020, 12, 31))] == 5.0


def test_ladders_and_formulas(spark):
    v = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (5.0,), (14.9,), (100.0,)], "v double")
    assert [r[0] for r in v.select(formulas.ladder("per", F.col("v"))).collect()] == [50, 50, 50, 85, 85, 20]
    a = spark.createDataFrame([(1.0, 2.0), (None, 2.0), (-1.0, 2.0), (9.0, 1.0), (1.0, -1.0)], "f double, n double")
    assert [r[0] for r in a.select(formulas.accrual_quality(F.col("f"), F.col("n"))).collect()] == [25.0, 50.0, 0.0, 100.0, 50.0]
    s = spark.createDataFrame([("+1,234.5%",), ("x",)], "t string")
    assert [r[0] for r in s.select(formulas.parse_percent(F.col("t"))).collect()] == [1234.5, None]


def test_bootstrap_is_repeatable_and_centred(spark):
    r = random.Random(4)
    v = [r.gauss(0.5, 1) for _ in range(200)]
    s = spark.createDataFrame(list(enumerate(v)), "d int, v double")
    a, b = (inference.block_bootstrap(s, "v", "d", 300, 10).orderBy("rep").collect() for _ in range(2))
    assert a == b and sum(x["mean"] for x in a) / 300 == pytest.approx(sum(v) / 200, abs=0.05)
    assert inference.block_bootstrap(s.where("d < 0"), "v", "d").count() == 0
    flips = inference.sign_flip_test(s, "v", "d", 200).first()
    assert flips.p < 0.05 and flips.n == 200


def test_permutation_keeps_each_keys_values(spark):
    f = spark.createDataFrame([(m, i, float(i * m)) for m in (1, 2) for i in range(20)], "m int, i int, v double")
    g = inference.permuted_within(f, "v", ["m"], "i", 9)
    for m in (1, 2):
        assert sorted(r.v for r in g.where(F.col("m") == m).collect()) == [float(i * m) for i in range(20)]


def test_ledger_rules(spark):
    t = spark.createDataFrame([("a", "X", "buy", 3, 300.0, 0.0), ("a", "X", "sell", 1, 120.0, 20.0)], "account string, symbol string, side string, qty int, amount double, pnl double")
    acc = spark.createDataFrame([("a", 820.0, 1000.0, 0.0, 0.0, 0.0, 20.0), ("b", -5.0, 0.0, 0.0, 0.0, 0.0, 9.0)], "account string, cash double, initial double, deposited double, fees double, dividends double, realized double")
    pend = spark.createDataFrame([("a", "X", "buy", 1, 900.0, "limit_entry", D0), ("a", "X", "buy", 1, 0.0, "market", D0), ("a", "Y", "sell", 4, 0.0, "market", D0), ("a", "Z", "hold", 1, 1.0, "market", D0)], "account string, symbol string, side string, qty int, notional double, kind string, placed date")
    assert {(r.account, r.rule) for r in ledger.cash_check(acc, t, pend).collect()} == {("a", "over_reserved"), ("b", "negative_cash"), ("b", "over_reserved"), ("b", "cash_mismatch"), ("b", "realized_mismatch")}
    pos = spark.createDataFrame([("a", "X", 2, 100.0), ("a", "Y", 1, 5.0)], "account string, symbol string, qty int, avg_price double")
    assert {(r.symbol, r.rule) for r in ledger.position_check(t, pos).collect()} == {("Y", "share_mismatch")}
    rules = {(r.symbol, r.rule) for r in ledger.pending_check(pend, pos, "2020-01-20").collect()}
    assert rules == {("X", "double_reservation"), ("X", "no_reservation"), ("X", "stale"), ("Y", "oversell"), ("Y", "stale"), ("Z", "unknown_side")}


def test_text(spark):
    n = spark.createDataFrame([("a", "Alpha beta\n# Head\nbeta", "t beta"), ("b", "beta", "x"), ("c", None, None)], "path string, text string, title string")
    got = [(r.path, r.score) for r in text.search(n, "beta alpha beta", 5).collect()]
    assert got == [("a", 213), ("b", 101)]
    assert n.where("path = 'a'").select(text.title_of(F.col("text"))).first()[0] == "Head"
    s = spark.createDataFrame([("ab\ncd\nefghijk",)], "t string").select(text.split_for_limit(F.col("t"), 5)).first()[0]
    assert "".join(s) == "ab\ncd\nefghijk" and max(map(len, s)) <= 6


def test_panel_merge_and_listing_windows(spark, bars):
    old = bars.where("ticker = 'A'").select("ticker", "date", "close")
    new = old.limit(3).withColumn("close", F.lit(None).cast("double"))
    assert tables.merge_panels(old, new).where("close IS NULL").count() == 0
    d = dt.date
    spans = spark.createDataFrame([("T", 1, d(2010, 1, 1), d(2012, 1, 1)), ("T", 2, d(2012, 1, 11), d(2015, 1, 1))], "ticker string, cik int, first_seen date, last_seen date")
    w = {r.cik: (r.window_start, r.window_end) for r in joins.listing_windows(spans).collect()}
    assert w == {1: (None, d(2012, 1, 6)), 2: (d(2012, 1, 7), None)}


def test_every_query_runs_on_the_smallest_tables(spark, sf):
    assert catalog.FLAGSHIP in catalog.queries()
    for name, q in catalog.queries().items():
        assert q(spark, sf).schema.fields, name
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_unknown_values_score_the_middle(spark):
    rows = [("A", 1, 1.0), ("B", 1, 2.0), ("C", 1, 9.0), ("D", 1, None)]
    got = {r["ticker"]: r["s"] for r in xs.winsorised_score(spark.createDataFrame(rows, "ticker string, date int, v double"), "v", ["date"], "s").collect()}
    assert got["D"] == 50.0 and 20.0 <= got["A"] < got["B"] < got["C"] <= 80.0


def test_rounding_is_the_same_for_sums_in_any_order(spark):
    frame = spark.createDataFrame([(2.0625 - 1e-13,), (2.0625 + 1e-13,)], "x double")
    assert [r[0] for r in frame.select(formulas.rnd("x", 3)).collect()] == [2.063, 2.063]
