"""Queries over quarterly facts: point-in-time joins, trailing sums, surprises, ladders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edgar, joins
from ..sources import tables as src
from .catalog import register, rounded
from .sql import FACTS, TRADES

BARS_AND_FACTS = FACTS.replace("WITH who", f"WITH {TRADES}, b AS (SELECT ticker, date, round(sum(x) / sum(q), 6) AS close FROM li GROUP BY 1, 2), who", 1)


@register(f'{FACTS} SELECT ticker, "end", filed, revenue, net_income, equity, shares FROM f')
def facts_quarterly(spark, sf):
    return src.facts_quarterly(spark, sf)


@register(f"""{FACTS} SELECT ticker, "end", round(CASE WHEN count(revenue) OVER w = 4 THEN sum(revenue) OVER w END, 2) AS revenue_ttm FROM f WINDOW w AS (PARTITION BY ticker ORDER BY "end" ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def a1_trailing_sum(spark, sf):
    return rounded(edgar.trailing_sum(src.facts_quarterly(spark, sf), "revenue").select("ticker", "end", "revenue_ttm"), 2)


@register(f"""{FACTS}, d AS (SELECT ticker, "end", CASE WHEN "end" - lag("end", 4) OVER w BETWEEN 320 AND 410 THEN net_income - lag(net_income, 4) OVER w END AS d FROM f WINDOW w AS (PARTITION BY ticker ORDER BY "end")),
s AS (SELECT *, CASE WHEN count(d) OVER p = 8 THEN stddev_samp(d) OVER p END AS sd FROM d WINDOW p AS (PARTITION BY ticker ORDER BY "end" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)) SELECT ticker, "end", round(CASE WHEN sd > 0 THEN d / sd END, 5) AS sue FROM s""")
def w34_surprise(spark, sf):
    return rounded(edgar.standardised_surprise(src.facts_quarterly(spark, sf)).select("ticker", "end", "sue"), 5)


def _late(spark, sf):
    """Facts of which every fifth quarter is filed 200 days late, so that old ends come after new ones."""
    f = src.facts_quarterly(spark, sf)
    return f.withColumn("filed", F.when((F.year("end") * 4 + F.quarter("end")) % 5 == 0, F.date_add("filed", 200)).otherwise(F.col("filed"))).withColumn("val", F.col("revenue"))


@register(f"""{FACTS}, l AS (SELECT ticker, "end", CASE WHEN (year("end") * 4 + quarter("end")) % 5 = 0 THEN CAST(filed + 200 AS DATE) ELSE filed END AS filed, revenue AS val FROM f),
m AS (SELECT *, max("end") OVER (PARTITION BY ticker ORDER BY filed, "end", val ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l) SELECT ticker, "end", filed, val FROM m WHERE m IS NULL OR "end" > m""")
def x7_monotone_ends(spark, sf):
    return edgar.monotone_ends(_late(spark, sf).select("ticker", "end", "filed", "val"))


_SEEN = """SELECT b.ticker, b.date, f."end", f.revenue FROM b LEFT JOIN LATERAL (SELECT "end", revenue FROM f WHERE f.ticker = b.ticker AND f.filed {op} b.date ORDER BY filed DESC, "end" DESC LIMIT 1) f ON true"""


def _asof_sql(op: str, stale: str = "") -> str:
    return f"""{BARS_AND_FACTS}, j AS (SELECT b.ticker, b.date, b.close, max({{'filed': f.filed, 'e': f."end", 'r': f.revenue}}) AS m FROM b LEFT JOIN f ON f.ticker = b.ticker AND f.filed {op} b.date GROUP BY 1, 2, 3)
SELECT ticker, date, close, CASE WHEN {stale or 'true'} THEN m.e END AS "end", CASE WHEN {stale or 'true'} THEN m.r END AS revenue FROM j"""


def _asof(spark, sf, **how):
    bars = src.bars_daily(spark, sf).select("ticker", "date", "close")
    return joins.asof(bars, src.facts_quarterly(spark, sf), "ticker", "date", "filed", ["end", "revenue"], tie=["end"], **how).drop("filed_seen")


@register(_asof_sql("<="))
def j1_asof(spark, sf):
    return _asof(spark, sf)


@register(_asof_sql("<"))
def j2_asof_strict(spark, sf):
    return _asof(spark, sf, strict=True)


@register(_asof_sql("<=", "date - m.filed <= 30"))
def j3_asof_stale(spark, sf):
    return _asof(spark, sf, max_stale_days=30)


@register(f"""{BARS_AND_FACTS}, j AS (SELECT f.ticker, f."end", min({{'g': abs(b.date - f."end"), 'd': b.date, 'c': b.close}}) AS m FROM f LEFT JOIN b ON b.ticker = f.ticker AND abs(b.date - f."end") <= 10 GROUP BY 1, 2)
SELECT ticker, "end", m.d AS date, m.c AS close FROM j""")
def j4_nearest(spark, sf):
    bars = src.bars_daily(spark, sf).select("ticker", "date", "close")
    f = src.facts_quarterly(spark, sf).select("ticker", "end")
    return joins.nearest(f, bars, "ticker", "end", "date", "close", 10).select("ticker", "end", "date", "close")


@register(f"""{FACTS} SELECT ticker, arg_min("end", filed) AS "end", min(filed) AS filed FROM f WHERE net_income > 0 GROUP BY ticker""")
def u7_earliest_filed(spark, sf):
    f = src.facts_quarterly(spark, sf).where("net_income > 0").select("ticker", "end", "filed")
    return joins.earliest(f, ["ticker"], "filed")


_LADDERS = {
    "per": "CASE WHEN v <= 0 THEN 50 WHEN v < 5 THEN 70 WHEN v < 15 THEN 85 WHEN v < 25 THEN 65 WHEN v < 40 THEN 40 ELSE 20 END",
    "pbr": "CASE WHEN v <= 0 THEN 50 WHEN v < 1 THEN 85 WHEN v < 2 THEN 75 WHEN v < 4 THEN 55 WHEN v < 8 THEN 35 ELSE 20 END",
    "interest_cover": "CASE WHEN v > 15 THEN 95 WHEN v > 8 THEN 80 WHEN v > 4 THEN 65 WHEN v > 2 THEN 45 WHEN v > 1 THEN 25 ELSE 10 END",
    "range_52w_pct": "CASE WHEN v < 20 THEN 40 WHEN v < 35 THEN 60 WHEN v < 50 THEN 70 WHEN v < 65 THEN 80 WHEN v < 80 THEN 75 WHEN v < 90 THEN 60 ELSE 45 END",
    "fcf_yield_pct": "CASE WHEN v > 10 THEN 90 WHEN v > 6 THEN 80 WHEN v > 3 THEN 65 WHEN v > 1 THEN 50 WHEN v > 0 THEN 35 ELSE 15 END",
}


@register(f"""{FACTS} SELECT ticker, "end", filed, round(revenue, 2) AS val FROM f WHERE month("end") != 12
UNION ALL SELECT ticker, max("end"), max(filed), round(sum(revenue) - sum(CASE WHEN month("end") != 12 THEN revenue END), 2) FROM f GROUP BY ticker, year("end") HAVING count(*) = 4""")
def x3_derived_q4(spark, sf):
    """Quarters whose fourth is hidden behind an annual fact, derived again."""
    q = src.facts_quarterly(spark, sf).select("ticker", F.add_months(F.date_add("end", 1), -3).alias("start"), "end", F.col("revenue").alias("val"), "filed", F.lit("10-Q").alias("form"))
    year = q.groupBy("ticker", F.year("end").alias("y")).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("val").alias("val"), F.max("filed").alias("filed"), F.count("*").alias("n")).where("n = 4").select("ticker", "start", "end", "val", "filed", F.lit("10-K").alias("form"))
    return rounded(edgar.with_derived_q4(q.where(F.month("end") != 12).unionByName(year)).select("ticker", "end", "filed", "val"), 2)
