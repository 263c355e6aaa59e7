"""Queries of scalar scores and ladders over yearly statements, bars and their indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..operators import edgar, simulate
from ..operators import indicators as ind
from ..sources import tables as src
from .catalog import register, rounded
from .company import ladder_sql
from .panel import _RSI
from .sql import BARS, STATEMENTS, O, full

YEARS = f"{BARS}, {STATEMENTS}"
_RR = _RSI.rsplit("SELECT ticker, date", 1)[0] + ", rr AS (SELECT ticker, date, 100 - 100 / (1 + g / CASE WHEN s = 0 THEN 1e-10 ELSE s END) AS rsi FROM e)"


def _years(spark, sf):
    """Statements with the year's last close, low and high, where the name was traded."""
    last = src.bars_daily(spark, sf).groupBy("ticker", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("close"), F.min("low").alias("low"), F.max("high").alias("high"))
    return src.company_statements(spark, sf).join(last, ["ticker", "year"])


#: Each ladder's measure in SQL; the same in columns below.
_MEASURES = {
    "per": "mcap / nullif(net_income, 0)", "per_relative": "per / avg(CASE WHEN per > 0 THEN per END) OVER (PARTITION BY year)", "pbr": "mcap / nullif(equity, 0)", "roe_pct": "net_income / nullif(equity, 0) * 100",
    "growth": "revenue / nullif(before, 0) - 1", "debt_equity": "debt / nullif(equity, 0)", "peg": "per / nullif((revenue / nullif(before, 0) - 1) * 100, 0)", "ev_ebitda": "(mcap + debt) / nullif(operating_income, 0)",
    "roa_pct": "net_income / nullif(assets, 0) * 100", "margin_pct": "net_income / nullif(revenue, 0) * 100", "range_52w_pct": "(close - low) / nullif(high - low, 0) * 100", "fcf_yield_pct": "(cash_flow - capex) / nullif(mcap, 0) * 100",
    "interest_cover": "operating_income / nullif(interest, 0)", "drawdown_pct": "(close - high) / nullif(high, 0) * 100",
}


@register(f"""{YEARS}, y0 AS (SELECT st.*, close, low, high, close * shares * 1000 AS mcap, lag(revenue) OVER (PARTITION BY st.ticker ORDER BY st.year) AS before FROM st JOIN yc ON yc.ticker = st.ticker AND yc.year = st.year),
y1 AS (SELECT *, mcap / nullif(net_income, 0) AS per FROM y0), y2 AS (SELECT ticker, year, {', '.join(f'{q} AS m_{k}' for k, q in _MEASURES.items())} FROM y1) SELECT ticker, year, {', '.join(f"{ladder_sql(k, f'm_{k}')} AS {k}" for k in _MEASURES)} FROM y2""")
def f9_ladders(spark, sf):
    """All fourteen ladders over the statements of each year."""
    c, per = F.col, F.try_divide
    y = _years(spark, sf).withColumn("mcap", c("close") * c("shares") * 1000).withColumn("before", F.lag("revenue").over(Window.partitionBy("ticker").orderBy("year")))
    y = y.withColumn("per", per(c("mcap"), c("net_income")))
    mean = y.where("per > 0").groupBy("year").agg(F.avg("per").alias("_mean"))
    y = y.join(mean, "year", "left")
    growth = per(c("revenue"), c("before")) - 1
    measures = {
        "per": c("per"), "per_relative": per(c("per"), c("_mean")), "pbr": per(c("mcap"), c("equity")), "roe_pct": per(c("net_income"), c("equity")) * 100, "growth": growth, "debt_equity": per(c("debt"), c("equity")),
        "peg": per(c("per"), growth * 100), "ev_ebitda": per(c("mcap") + c("debt"), c("operating_income")), "roa_pct": per(c("net_income"), c("assets")) * 100, "margin_pct": per(c("net_income"), c("revenue")) * 100,
        "range_52w_pct": per(c("close") - c("low"), c("high") - c("low")) * 100, "fcf_yield_pct": per(c("cash_flow") - c("capex"), c("mcap")) * 100, "interest_cover": per(c("operating_income"), c("interest")), "drawdown_pct": per(c("close") - c("high"), c("high")) * 100,
    }
    return y.select("ticker", "year", *[fm.ladder(k, x).alias(k) for k, x in measures.items()])


@register(f"""{YEARS}, y AS (SELECT st.*, close, low, cash_flow - capex AS fcf, close * shares * 1000 / nullif(net_income, 0) AS per FROM st JOIN yc ON yc.ticker = st.ticker AND yc.year = st.year)
SELECT ticker, year, round(CASE WHEN fcf IS NULL OR net_income IS NULL OR net_income <= 0 THEN 50.0 WHEN fcf <= 0 THEN 0.0 ELSE least(100.0, greatest(0.0, fcf / net_income * 50)) END, 6) AS accrual, round(CASE WHEN per > 0 THEN 100.0 / per ELSE 0.0 END, 6) AS yield,
CASE WHEN abs(close - low) / close * 100 > 2.34 THEN 'A' WHEN abs(close - low) / close * 100 > 1.75 THEN 'B' WHEN abs(close - low) / close * 100 > 1.34 THEN 'C' ELSE 'D' END AS grade FROM y""")
def f3_quality_formulas(spark, sf):
    y = _years(spark, sf)
    per = F.try_divide(F.col("close") * F.col("shares") * 1000, F.col("net_income"))
    return rounded(y.select("ticker", "year", fm.accrual_quality(F.col("cash_flow") - F.col("capex"), F.col("net_income")).alias("accrual"), fm.earnings_yield(per).alias("yield"), fm.cost_grade(F.col("close"), F.col("low")).alias("grade")))


_ITEMS = ("net_income", "cash_flow", "assets", "debt", "current_assets", "current_liabilities", "shares", "revenue")


@register(f"""{YEARS}, p AS (SELECT a.ticker, a.year, {', '.join(f'a.{c}, z.{c} AS {c}_prior' for c in _ITEMS)} FROM st a JOIN st z ON z.ticker = a.ticker AND z.year = a.year - 1)
SELECT ticker, year, CAST((net_income > 0)::INT + (cash_flow > 0)::INT + (net_income / nullif(assets, 0) > net_income_prior / nullif(assets_prior, 0))::INT + (cash_flow > net_income)::INT + (debt / nullif(assets, 0) <= debt_prior / nullif(assets_prior, 0))::INT
 + (current_assets / nullif(current_liabilities, 0) > current_assets_prior / nullif(current_liabilities_prior, 0))::INT + (shares <= shares_prior)::INT + (revenue / nullif(assets, 0) > revenue_prior / nullif(assets_prior, 0))::INT AS INT) AS f_score FROM p""")
def f12_piotroski(spark, sf):
    """Two fiscal years in a row of statements; null where an item is unknown."""
    s = src.company_statements(spark, sf).select("ticker", "year", *_ITEMS)
    before = s.select("ticker", (F.col("year") + 1).alias("year"), *[F.col(c).alias(f"{c}_prior") for c in _ITEMS])
    return edgar.piotroski(s.join(before, ["ticker", "year"])).select("ticker", "year", F.col("f_score").cast("int").alias("f_score"))


@register(f"""{YEARS}, y AS (SELECT st.*, close, close * shares * 1000 AS mcap FROM st JOIN yc ON yc.ticker = st.ticker AND yc.year = st.year), v AS (SELECT ticker, year, CASE WHEN net_income > 0 AND mcap > 0 THEN 100 * net_income / mcap ELSE 0.0 END AS ep, CASE WHEN equity > 0 AND mcap > 0 THEN 100 * equity / mcap ELSE 0.0 END AS bp,
 coalesce((cash_flow - capex) / nullif(mcap, 0) * 100, 0) AS fy, coalesce(net_income / nullif(equity, 0) * 100, 0) AS roe, coalesce(net_income / nullif(revenue, 0) * 100, 0) AS margin, CASE WHEN cash_flow - capex IS NULL OR net_income IS NULL OR net_income <= 0 THEN 50.0 WHEN cash_flow - capex <= 0 THEN 0.0 ELSE least(100.0, (cash_flow - capex) / net_income * 50) END AS acc FROM y)
SELECT ticker, year, round(ep * 0.4 + bp * 0.3 + fy * 0.3, 5) AS value_raw, round(roe * 0.45 + margin * 0.35 + acc * 0.2, 5) AS quality_raw FROM v""")
def f4_raw_scores(spark, sf):
    y, c, per = _years(spark, sf), F.col, F.try_divide
    mcap, fcf = c("close") * c("shares") * 1000, c("cash_flow") - c("capex")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    value = fm.value_raw(fm.earnings_yield(per(mcap, c("net_income"))), fm.book_yield(per(mcap, c("equity"))), zero(per(fcf, mcap) * 100))
    quality = fm.quality_raw(zero(per(c("net_income"), c("equity")) * 100), zero(per(c("net_income"), c("revenue")) * 100), fm.accrual_quality(fcf, c("net_income")))
    return rounded(y.select("ticker", "year", value.alias("value_raw"), quality.alias("quality_raw")), 5)


# -- over bars -----------------------------------------------------------------


@register(f"""{_RR}, m AS (SELECT ticker, date, (close / lag(close, 20) OVER ({O}) - 1) * 100 AS mom FROM b), c AS (SELECT m.ticker, m.date, CASE WHEN mom IS NOT NULL THEN rsi * 0.7 + greatest(0.0, least(100.0, mom + 50)) * 0.3 END AS score FROM m JOIN rr ON rr.ticker = m.ticker AND rr.date = m.date)
SELECT ticker, date, round(score, 5) AS chart_score, CASE WHEN score >= 65 THEN 'buy' WHEN score <= 40 THEN 'sell' ELSE 'neutral' END AS verdict FROM c""")
def p9_verdicts(spark, sf):
    """Chart scores of relative strength and momentum, and their verdicts."""
    b = simulate.rsi(src.bars_daily(spark, sf)).withColumn("mom", (F.col("close") / F.lag("close", 20).over(ind.by_time()) - 1) * 100)
    score = F.when(F.col("mom").isNotNull(), fm.chart_score(F.col("rsi"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("mom") + 50))))
    return rounded(b.select("ticker", "date", score.alias("chart_score"), fm.verdict(score).alias("verdict")), 5)


@register(f"{_RR} SELECT ticker, date, CASE WHEN rsi <= 65 THEN 0 ELSE round(0.3 + 0.7 * least((rsi - 65) / 35, 1.0::DOUBLE), 6) END AS weight FROM rr WHERE rsi IS NOT NULL")
def f17_strength(spark, sf):
    b = simulate.rsi(src.bars_daily(spark, sf)).where("rsi IS NOT NULL")
    return rounded(b.select("ticker", "date", fm.strength_weight(F.col("rsi"), 65.0).alias("weight")))


@register(f"""{BARS}, r AS (SELECT ticker, year(date) AS year, close / lag(close) OVER ({O}) - 1 AS r FROM b), g AS (SELECT ticker, year, count(*) FILTER (r > 0) / count(r) AS w, avg(r) FILTER (r > 0) AS win, avg(r) FILTER (r < 0) AS loss FROM r GROUP BY 1, 2)
SELECT ticker, year, CASE WHEN w <= 0 OR loss = 0 THEN 0 ELSE round(least(0.25::DOUBLE, greatest(0.0::DOUBLE, (w * (win / abs(loss)) - (1 - w)) / (win / abs(loss))) * 0.5), 6) END AS kelly FROM g WHERE win IS NOT NULL AND loss IS NOT NULL""")
def f16_kelly(spark, sf):
    """Half-Kelly shares from a year's daily rises and falls."""
    b = src.bars_daily(spark, sf).withColumn("r", ind.change())
    up, down = F.col("r") > 0, F.col("r") < 0
    g = b.groupBy("ticker", F.year("date").alias("year")).agg((F.count_if(up) / F.count("r")).alias("w"), F.avg(F.when(up, F.col("r"))).alias("win"), F.avg(F.when(down, F.col("r"))).alias("loss")).where("win IS NOT NULL AND loss IS NOT NULL")
    return rounded(g.select("ticker", "year", fm.kelly(F.col("w"), F.col("win"), F.col("loss")).alias("kelly")))


_PLAN = f"p AS (SELECT ticker, date, close, close > open AS long, {full(5, 'min(low)')} AS lo, {full(5, 'max(high)')} AS hi, {full(20, 'max(high)')} AS top, {full(20, 'min(low)')} AS bottom FROM b)"


def _stops(spark, sf):
    """Of each bar its side, the stop at the extreme of five bars and the target at that of twenty."""
    f, t = ind.trailing(5), ind.trailing(20)
    b = src.bars_daily(spark, sf).withColumns({"lo": ind.full(5, F.min("low"), f), "hi": ind.full(5, F.max("high"), f), "top": ind.full(20, F.max("high"), t), "bottom": ind.full(20, F.min("low"), t)})
    long = F.col("close") > F.col("open")
    return b.select("ticker", "date", "close", F.when(long, "long").otherwise("short").alias("side"), F.when(long, F.col("lo")).otherwise(F.col("hi")).alias("stop"), F.when(long, F.col("top")).otherwise(F.col("bottom")).alias("target"))


@register(f"{BARS}, {_PLAN} SELECT ticker, date, round(CASE WHEN long AND close - lo > 0 THEN (top - close) / (close - lo) WHEN NOT long AND hi - close > 0 THEN (close - bottom) / (hi - close) END, 5) AS rr FROM p")
def f20_reward_risk(spark, sf):
    return rounded(_stops(spark, sf).select("ticker", "date", fm.reward_risk(F.col("side"), F.col("close"), F.col("stop"), F.col("target")).alias("rr")), 5)


@register(f"{BARS}, {_PLAN}, r AS (SELECT ticker, date, abs(close - CASE WHEN long THEN lo ELSE hi END) / close * 100 AS r FROM p) SELECT ticker, date, CASE WHEN r > 0 THEN round(least(0.00155::DOUBLE, 0.15 * r / 100), 8) ELSE 0 END AS fraction FROM r")
def f18_risk_fraction(spark, sf):
    s = _stops(spark, sf)
    return rounded(s.select("ticker", "date", fm.risk_fraction(F.abs(F.col("close") - F.col("stop")) / F.col("close") * 100).alias("fraction")), 8)


@register(f"{BARS}, g AS (SELECT ticker, arg_max(close, date) / arg_min(close, date) AS grown, (max(date) - min(date)) / 365.25::DOUBLE AS years FROM b GROUP BY ticker) SELECT ticker, CASE WHEN grown > 0 AND years > 0 THEN round(power(grown, 1 / years) - 1, 6) END AS cagr FROM g")
def f22_cagr(spark, sf):
    g = src.bars_daily(spark, sf).groupBy("ticker").agg((F.max_by("close", "date") / F.min_by("close", "date")).alias("grown"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"))
    return rounded(g.select("ticker", fm.cagr(F.col("grown"), F.col("years")).alias("cagr")))


@register(f"{BARS} SELECT ticker, date, round((close / lag(close) OVER ({O}) - 1) * 100, 1) AS x FROM b")
def g6_percent(spark, sf):
    """Daily changes written out as text and read back."""
    change = fm.rnd(ind.change() * 100, 1)
    shown = F.concat(F.when(F.col("c") >= 0, "+").otherwise(""), F.format_number("c", 1), F.lit("%"))
    return rounded(src.bars_daily(spark, sf).select("ticker", "date", change.alias("c")).select("ticker", "date", fm.parse_percent(shown).alias("x")), 1)
