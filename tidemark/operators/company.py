"""Fundamentals as they were known on a day: the latest quarters filed by then ride along as one bounded array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas as fx
from .joins import asof

ITEMS = ("revenue", "net_income", "operating_income", "operating_cash_flow", "capex")
QUARTERS = 8
#: Days from the first to the last of four quarter ends, between ends a year apart, and the leave for both.
SPAN_DAYS, YEAR_DAYS, LEAVE_DAYS = 273, 365, 45


def filed_states(facts: DataFrame, most: int = QUARTERS) -> DataFrame:
    """ticker, filed, quarters: after each day of filing the latest quarters by end among all filed so far, newest first.

    An old quarter filed late takes its place by its end. A company's filings, four a year, are all that a frame holds."""
    w = Window.partitionBy("ticker").orderBy("filed").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    quarters = F.slice(F.sort_array(F.collect_list(F.struct("end", *ITEMS)).over(w), asc=False), 1, most)
    return facts.where("filed IS NOT NULL").withColumn("quarters", quarters).groupBy("ticker", "filed").agg(F.first("quarters").alias("quarters"))


def trailing(item: str, quarters: Column, first: int = 1) -> Column:
    """Sum of four quarters from the first-th newest on; null if one of them is missing or has no value."""
    four = F.transform(F.slice(quarters, first, 4), lambda q: q[item])
    whole = (F.size(four) == 4) & F.forall(four, lambda x: fx.known(x).isNotNull())
    return F.when(whole, F.aggregate(four, F.lit(0.0), lambda s, x: s + x))


def _latest(frame: DataFrame, series: DataFrame, value: str, strict: bool) -> DataFrame:
    return asof(frame, series.where(f"{value} IS NOT NULL"), "ticker", "date", "filed", [value], strict=strict, tie=[value]).drop("filed_seen")


def known_on(bars: DataFrame, facts: DataFrame, shares: DataFrame, equity: DataFrame, strict: bool) -> DataFrame:
    """bars (ticker, date, ...) with quarters, shares and equity as filed by the date (strict: before it).

    facts: ticker, end, filed and ITEMS, one row a quarter; shares and equity: ticker, filed and the value."""
    out = asof(bars, filed_states(facts), "ticker", "date", "filed", ["quarters"], strict=strict).drop("filed_seen")
    return _latest(_latest(out, shares, "shares", strict), equity, "equity", strict)


def ratios(bars: DataFrame, facts: DataFrame, shares: DataFrame, equity: DataFrame) -> DataFrame:
    """pe (at most 200), margin, roe, fcf_yield in percent and accrual_q of each bar from what was filed by its date; null if unmeasured.

    Before the first count of shares the last one ever filed stands in."""
    last = shares.where("shares IS NOT NULL").groupBy("ticker").agg(F.max_by("shares", "filed").alias("_any"))
    k = known_on(bars, facts, shares, equity, strict=False).join(last, "ticker", "left").withColumn("shares", F.coalesce("shares", "_any"))
    q = F.col("quarters")
    k = k.withColumns({f"_{x}": trailing(x, q) for x in ITEMS})
    shared = (F.col("shares") > 0) & (F.col("close") > 0)
    eps = F.col("_net_income") / F.col("shares")
    fcf = F.col("_operating_cash_flow") - F.col("_capex")
    return k.select(
        "ticker", "date", "close",
        F.when(shared & (eps > 0), F.least(F.col("close") / eps, F.lit(200.0))).alias("pe"),
        F.when(F.col("_revenue") > 0, F.col("_operating_income") / F.col("_revenue") * 100).alias("margin"),
        F.when(F.col("equity") > 0, F.col("_net_income") / F.col("equity") * 100).alias("roe"),
        F.when(shared, fcf / (F.col("close") * F.col("shares")) * 100).alias("fcf_yield"),
        F.when((F.col("_net_income") > 0) & fcf.isNotNull(), fx.accrual_quality(fcf, F.col("_net_income"))).alias("accrual_q"),
    )


def year_figures(bars: DataFrame, facts: DataFrame, shares: DataFrame, equity: DataFrame) -> DataFrame:
    """bars with net_income, revenue, fcf, equity, shares, revenue_yoy and income_yoy as filed before the date; rows that can't be told go.

    A quarter counts if it has revenue and income. Eight of them are needed, whose ends lie as two full years in a row do."""
    k = known_on(bars, facts.where("revenue IS NOT NULL AND net_income IS NOT NULL"), shares, equity, strict=True)
    q = F.col("quarters")
    near = lambda a, b, days: F.abs(F.datediff(F.get(q, F.lit(a))["end"], F.get(q, F.lit(b))["end"]) - days) <= LEAVE_DAYS
    k = k.where((F.size(q) >= 8) & near(0, 3, SPAN_DAYS) & near(4, 7, SPAN_DAYS) & near(0, 4, YEAR_DAYS) & (F.col("shares") > 0))
    now, before = {x: trailing(x, q) for x in ITEMS}, {x: trailing(x, q, 5) for x in ITEMS}
    k = k.where((now["revenue"] > 0) & (before["revenue"] > 0))
    return k.withColumns({
        "net_income": now["net_income"], "revenue": now["revenue"], "fcf": now["operating_cash_flow"] - now["capex"], "equity": F.when(F.col("equity") > 0, F.col("equity")),
        "revenue_yoy": now["revenue"] / before["revenue"] - 1, "income_yoy": F.when(before["net_income"] > 0, now["net_income"] / before["net_income"] - 1),
    }).drop("quarters")


def window_drawdown(closes: Column) -> Column:
    """Greatest fall in percent from a peak of an array of closes in time order; 0 without one that is positive."""
    good = F.filter(closes, lambda x: x > 0)
    start = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("low"))
    step = lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), F.least(s["low"], (x - F.greatest(s["top"], x)) / F.greatest(s["top"], x) * 100).alias("low"))
    return F.aggregate(good, start, step, lambda s: s["low"])


#: The parts' weights, of which safety and another score are left out, and the shares within two of them.
WEIGHTS = {"valuation": 0.20, "profitability": 0.20, "growth": 0.13, "cash": 0.12, "drawdown": 0.08, "range": 0.07}
PER_SHARE, PBR_SHARE, ROE_SHARE, MARGIN_SHARE = 0.35, 0.25, 0.40, 0.30


def composite(figures: DataFrame, bars: DataFrame, days: int = 400, year: int = 252, least: int = 30) -> DataFrame:
    """score from 0 to 100 of rows of year_figures: six ladders weighed. bars: ticker, date, high, low, close for the price parts.

    Prices are those of the trailing days; a ticker with fewer than least bars in them has no score."""
    span = Window.partitionBy("ticker").orderBy(F.unix_date("date")).rangeBetween(-days + 1, 0)
    some = Window.partitionBy("ticker").orderBy("date").rowsBetween(-(year - 1), 0)
    inside = F.unix_date("date") - days
    # The range of the last bars is cut at the trailing days, which a thinly traded name's bars may exceed.
    recent = F.filter(F.collect_list(F.struct(F.unix_date("date").alias("d"), "high", "low")).over(some), lambda x: x["d"] > inside)
    priced = bars.withColumns({"_closes": F.collect_list("close").over(span), "_recent": recent}).where(F.size("_closes") >= least)
    priced = priced.select("ticker", "date", "_closes", F.array_max(F.col("_recent.high")).alias("_top"), F.array_min(F.col("_recent.low")).alias("_bottom"))
    k = figures.join(priced, ["ticker", "date"]).withColumn("_mcap", F.col("close") * F.col("shares")).where("_mcap > 0")
    c = F.col
    pct = F.when((c("_top") > c("_bottom")) & (c("_top") != 0), (c("close") - c("_bottom")) / (c("_top") - c("_bottom")) * 100)
    growth = fx.ladder("growth", c("revenue_yoy"))
    parts = {
        "valuation": (fx.ladder("per", F.when(c("net_income") > 0, c("_mcap") / c("net_income"))) * PER_SHARE + fx.ladder("pbr", c("_mcap") / c("equity")) * PBR_SHARE) / (PER_SHARE + PBR_SHARE),
        "profitability": (fx.ladder("roe_pct", c("net_income") / c("equity") * 100) * ROE_SHARE + fx.ladder("margin_pct", c("net_income") / c("revenue") * 100) * MARGIN_SHARE) / (ROE_SHARE + MARGIN_SHARE),
        "growth": F.when(c("income_yoy").isNull(), growth.cast("double")).otherwise(growth * 0.5 + fx.ladder("growth", c("income_yoy")) * 0.5),
        "cash": fx.ladder("fcf_yield_pct", c("fcf") / c("_mcap") * 100),
        "drawdown": fx.ladder("drawdown_pct", window_drawdown(c("_closes"))),
        "range": fx.ladder("range_52w_pct", pct),
    }
    return k.withColumns(parts).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), sum((c(x) * w for x, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())))).drop("_closes", "_top", "_bottom", "_mcap")
