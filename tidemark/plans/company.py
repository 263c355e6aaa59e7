"""Queries over company facts as they were filed: ratios, year figures and the point-in-time score of every bar."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import company
from ..sources import tables as src
from .catalog import register, rounded
from .fundamentals import _LADDERS
from .sql import BARS, COMPANY

KNOWN = f"{BARS}, {COMPANY}"


def _parts(spark, sf):
    years = src.company_years(spark, sf)
    return src.company_facts(spark, sf), years.select("ticker", "filed", "shares"), years.select("ticker", "filed", "equity")


def _quarters(op: str, core: str = "") -> str:
    """Of each bar the quarters filed by then, numbered from the newest end, and the last shares and equity."""
    return f"""kn AS (SELECT b.ticker, b.date, b.close, cf.*EXCLUDE (ticker), row_number() OVER (PARTITION BY b.ticker, b.date ORDER BY cf."end" DESC) AS no
  FROM b JOIN cf ON cf.ticker = b.ticker AND cf.filed {op} b.date {core}),
sy AS (SELECT b.ticker, b.date, arg_max(shares, cy.filed) AS shares, arg_max(equity, cy.filed) AS equity FROM b JOIN cy ON cy.ticker = b.ticker AND cy.filed {op} b.date GROUP BY 1, 2)"""


def _ttm(item: str, low: int = 1) -> str:
    four = f"no BETWEEN {low} AND {low + 3}"
    # in the quarters' order, newest first: sums of doubles depend on it
    return f"CASE WHEN count({item}) FILTER ({four}) = 4 THEN list_reduce(list_prepend(0.0::DOUBLE, list({item} ORDER BY no) FILTER ({four})), lambda s, x: s + x) END"


#: The ratios of each bar as they were known, not rounded yet.
RATIOS = f"""{KNOWN}, {_quarters('<=')}, t AS (SELECT ticker, date, {', '.join(f'{_ttm(x)} AS {x}' for x in company.ITEMS)} FROM kn GROUP BY 1, 2),
la AS (SELECT ticker, arg_max(shares, filed) AS sh FROM cy GROUP BY 1),
j AS (SELECT b.ticker, b.date, b.close, t.*EXCLUDE (ticker, date), coalesce(sy.shares, sh) AS shares, equity, operating_cash_flow - capex AS fcf
  FROM b LEFT JOIN t ON t.ticker = b.ticker AND t.date = b.date LEFT JOIN sy ON sy.ticker = b.ticker AND sy.date = b.date LEFT JOIN la ON la.ticker = b.ticker),
rt AS (SELECT ticker, date, close, CASE WHEN close > 0 AND shares > 0 AND net_income > 0 THEN least(close / (net_income / shares), 200.0) END AS pe,
  CASE WHEN revenue > 0 THEN operating_income / revenue * 100 END AS margin, CASE WHEN equity > 0 THEN net_income / equity * 100 END AS roe, CASE WHEN close > 0 AND shares > 0 THEN fcf / (close * shares) * 100 END AS fcf_yield,
  CASE WHEN net_income > 0 AND fcf IS NOT NULL THEN CASE WHEN fcf <= 0 THEN 0.0 ELSE least(100.0, fcf / net_income * 50) END END AS accrual_q FROM j)"""


@register(f"""{RATIOS} SELECT ticker, date, close, {', '.join(f'round({x}, 6) AS {x}' for x in ('pe', 'margin', 'roe', 'fcf_yield', 'accrual_q'))} FROM rt""")
def j1_pit_ratios(spark, sf):
    return rounded(company.ratios(src.bars_daily(spark, sf).select("ticker", "date", "close"), *_parts(spark, sf)))


_FIGURES = f"""{_quarters('<', 'AND revenue IS NOT NULL AND net_income IS NOT NULL')},
e AS (SELECT ticker, date, first(close) AS close, max(no) AS n, {', '.join(f'max(CASE WHEN no = {i} THEN "end" END) AS e{i}' for i in (1, 4, 5, 8))}, {_ttm('net_income')} AS net_income, {_ttm('revenue')} AS revenue,
  {_ttm('operating_cash_flow')} - {_ttm('capex')} AS fcf, {_ttm('revenue', 5)} AS revenue0, {_ttm('net_income', 5)} AS net_income0 FROM kn GROUP BY 1, 2),
fig AS (SELECT e.ticker, e.date, close, net_income, revenue, fcf, CASE WHEN equity > 0 THEN equity END AS equity, shares, revenue / revenue0 - 1 AS revenue_yoy, CASE WHEN net_income0 > 0 THEN net_income / net_income0 - 1 END AS income_yoy
  FROM e JOIN sy ON sy.ticker = e.ticker AND sy.date = e.date WHERE n >= 8 AND abs(e1 - e4 - 273) <= 45 AND abs(e5 - e8 - 273) <= 45 AND abs(e1 - e5 - 365) <= 45 AND shares > 0 AND revenue > 0 AND revenue0 > 0)"""


@register(f"""{KNOWN}, {_FIGURES} SELECT ticker, date, close, round(net_income, 2) AS net_income, round(revenue, 2) AS revenue, round(fcf, 2) AS fcf, round(equity, 2) AS equity, shares, round(revenue_yoy, 6) AS revenue_yoy, round(income_yoy, 6) AS income_yoy FROM fig""")
def j2_pit_figures(spark, sf):
    out = company.year_figures(src.bars_daily(spark, sf).select("ticker", "date", "close"), *_parts(spark, sf))
    return rounded(out, net_income=2, revenue=2, fcf=2, equity=2, close=6)


#: The ladders in SQL, by their definition: where a value is missing the score is 50.
LADDERS = _LADDERS | {
    "roe_pct": "CASE WHEN v < 0 THEN 10 WHEN v < 5 THEN 30 WHEN v < 10 THEN 50 WHEN v < 20 THEN 75 WHEN v < 30 THEN 90 ELSE 85 END",
    "growth": "CASE WHEN v < -0.1 THEN 10 WHEN v < 0 THEN 30 WHEN v < 0.05 THEN 50 WHEN v < 0.15 THEN 70 WHEN v < 0.3 THEN 85 ELSE 95 END",
    "margin_pct": "CASE WHEN v < 0 THEN 10 WHEN v < 5 THEN 40 WHEN v < 10 THEN 60 WHEN v < 20 THEN 80 ELSE 90 END",
    "drawdown_pct": "CASE WHEN v > -10 THEN 90 WHEN v > -20 THEN 75 WHEN v > -30 THEN 55 WHEN v > -40 THEN 35 WHEN v > -50 THEN 20 ELSE 10 END",
    "per_relative": "CASE WHEN v <= 0 THEN 50 WHEN v < 0.5 THEN 90 WHEN v < 0.7 THEN 80 WHEN v < 0.9 THEN 70 WHEN v < 1.1 THEN 60 WHEN v < 1.3 THEN 45 WHEN v < 1.5 THEN 30 ELSE 15 END",
    "debt_equity": "CASE WHEN v < 0 THEN 30 WHEN v < 0.3 THEN 90 WHEN v < 0.7 THEN 75 WHEN v < 1.5 THEN 55 WHEN v < 3 THEN 35 ELSE 15 END",
    "peg": "CASE WHEN v <= 0 THEN 50 WHEN v < 0.5 THEN 95 WHEN v < 1 THEN 85 WHEN v < 1.5 THEN 70 WHEN v < 2 THEN 55 WHEN v < 3 THEN 35 ELSE 15 END",
    "ev_ebitda": "CASE WHEN v <= 0 THEN 50 WHEN v < 6 THEN 90 WHEN v < 10 THEN 80 WHEN v < 15 THEN 65 WHEN v < 20 THEN 50 WHEN v < 30 THEN 30 ELSE 15 END",
    "roa_pct": "CASE WHEN v < 0 THEN 10 WHEN v < 2 THEN 30 WHEN v < 5 THEN 50 WHEN v < 10 THEN 70 WHEN v < 15 THEN 85 ELSE 95 END",
}


def ladder_sql(measure: str, value: str) -> str:
    return f"(SELECT CASE WHEN v IS NULL THEN 50 ELSE {LADDERS[measure]} END FROM (SELECT ({value}) AS v))"


@register(f"""{KNOWN}, {_FIGURES},
pr AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM b),
wi AS (SELECT a.ticker, a.date, c.i = a.i AS is_last, a.i - c.i < 252 AS in_year, c.high, c.low, c.close, max(CASE WHEN c.close > 0 THEN c.close END) OVER (PARTITION BY a.ticker, a.date ORDER BY c.i) AS top
  FROM (SELECT pr.ticker, pr.date, pr.i FROM pr JOIN fig ON fig.ticker = pr.ticker AND fig.date = pr.date) a JOIN pr c ON c.ticker = a.ticker AND c.date <= a.date AND c.date > a.date - 400),
wa AS (SELECT ticker, date, coalesce(min(CASE WHEN close > 0 THEN (close - top) / top * 100 END), 0) AS mdd, max(CASE WHEN in_year THEN high END) AS top, min(CASE WHEN in_year THEN low END) AS bottom FROM wi GROUP BY 1, 2 HAVING count(*) >= 30),
f AS (SELECT fig.*, mdd, top, bottom, close * shares AS mcap FROM fig JOIN wa ON wa.ticker = fig.ticker AND wa.date = fig.date WHERE close * shares > 0),
p AS (SELECT ticker, date, ({ladder_sql('per', 'CASE WHEN net_income > 0 THEN mcap / net_income END')} * 0.35 + {ladder_sql('pbr', 'mcap / equity')} * 0.25) / 0.6 AS valuation,
  ({ladder_sql('roe_pct', 'net_income / equity * 100')} * 0.4 + {ladder_sql('margin_pct', 'net_income / revenue * 100')} * 0.3) / 0.7 AS profitability,
  CASE WHEN income_yoy IS NULL THEN {ladder_sql('growth', 'revenue_yoy')} ELSE {ladder_sql('growth', 'revenue_yoy')} * 0.5 + {ladder_sql('growth', 'income_yoy')} * 0.5 END AS growth,
  {ladder_sql('fcf_yield_pct', 'fcf / mcap * 100')} AS cash, {ladder_sql('drawdown_pct', 'mdd')} AS drawdown,
  {ladder_sql('range_52w_pct', 'CASE WHEN top > bottom AND top != 0 THEN (close - bottom) / (top - bottom) * 100 END')} AS range FROM f)
SELECT ticker, date, round(growth::DOUBLE, 6) AS growth, cash, drawdown, "range", round((valuation * 0.2 + profitability * 0.2 + growth * 0.13 + cash * 0.12 + drawdown * 0.08 + "range" * 0.07) / 0.8, 6) AS score FROM p""")
def f11_pit_score(spark, sf):
    bars = src.bars_daily(spark, sf)
    figures = company.year_figures(bars.select("ticker", "date", "close"), *_parts(spark, sf))
    return rounded(company.composite(figures, bars.select("ticker", "date", "high", "low", "close")).select("ticker", "date", "growth", "cash", "drawdown", "range", "score"))
