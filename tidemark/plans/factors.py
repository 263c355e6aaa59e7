"""Queries of factor snapshots at month ends, their coefficients out of sample, and of two definitions of a factor."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..operators import company, factors
from ..operators import cross_section as xs
from ..operators import indicators as ind
from ..operators import reports as rep
from ..sources import tables as src
from .catalog import register, rounded
from .company import RATIOS, _parts
from .panel import _score_sql
from .sql import O, rows

DAY = "OVER (PARTITION BY date)"


def _z(x: str, sign: str = "") -> str:
    return f"{sign}(({x} - avg({x}) {DAY}) / (stddev_samp({x}) {DAY} + 1e-9))"


def _plain(x: str, sign: str = "") -> str:
    return f"CASE WHEN count({x}) {DAY} < 3 THEN 0.0 ELSE coalesce({_z(x, sign)}, 0.0) END"


_SNAPS = f"""{RATIOS}, me AS (SELECT max(date) AS date FROM b GROUP BY date_trunc('month', date)),
fr AS (SELECT *, row_number() OVER ({O}) AS k, close / lag(close) OVER ({O}) - 1 AS r, coalesce((close / lag(close, 63) OVER ({O}) - 1) * 100, 0.0) AS m3, coalesce((close / lag(close, 21) OVER ({O}) - 1) * 100, 0.0) AS m1, coalesce((lag(close, 20) OVER ({O}) / lag(close, 251) OVER ({O}) - 1) * 100, 0.0) AS m12,
  (lead(close, 21) OVER ({O}) / close - 1) * 100 AS fwd, lead(date, 21) OVER ({O}) AS until FROM b),
fv AS (SELECT *, stddev_samp(r) OVER {rows(21)} * sqrt(252) * 100 AS v1, stddev_samp(r) OVER {rows(252)} * sqrt(252) * 100 AS v12 FROM fr),
fa AS (SELECT fv.*, CASE WHEN k >= 253 THEN m12 END AS p12, CASE WHEN k >= 253 THEN v12 END AS pv, pe, fcf_yield, roe, margin, accrual_q FROM fv JOIN me USING (date) LEFT JOIN rt ON rt.ticker = fv.ticker AND rt.date = fv.date WHERE k >= 65),
fs AS (SELECT ticker, date, fwd, until, {_z('m3')} AS mom_3m, {_z('m1')} AS mom_1m, {_z('v1', '-')} AS low_vol, {_plain('pe', '-')} * 0.4 / 0.7 + {_plain('fcf_yield')} * 0.3 / 0.7 AS value,
  {_plain('roe')} * 0.45 + {_plain('margin')} * 0.35 + {_plain('accrual_q')} * 0.2 AS quality, CASE WHEN count(p12) {DAY} >= 3 THEN {_z('p12')} END AS mom_12_1, CASE WHEN count(pv) {DAY} >= 3 THEN {_z('pv', '-')} END AS low_vol_252
  FROM (SELECT *, count(*) {DAY} AS names FROM fa) WHERE names >= 5)"""
_ALL = (*factors.FACTORS, *factors.PRODUCTION)
# z values are compared by rank, so that what differs in the last bits only must count as a tie in both engines
_RANKS = f"""{_SNAPS}, fl AS ({' UNION ALL '.join(f"SELECT ticker, date, '{f}' AS factor, round({f}, 8) AS z, fwd, until FROM fs WHERE fwd IS NOT NULL" for f in _ALL)}),
rk AS (SELECT date, factor, rank() OVER w1 + (count(*) OVER (PARTITION BY date, factor, z) - 1) / 2.0 AS a, rank() OVER w2 + (count(*) OVER (PARTITION BY date, factor, fwd) - 1) / 2.0 AS f FROM fl WHERE z IS NOT NULL WINDOW w1 AS (PARTITION BY date, factor ORDER BY z), w2 AS (PARTITION BY date, factor ORDER BY fwd)),
ic AS (SELECT date, factor, count(*) AS n, corr(a, f) AS ic FROM rk GROUP BY 1, 2 HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(f) > 0),
ed AS (SELECT date, max(until) AS until FROM fl GROUP BY 1)"""


def _snapshots(spark, sf):
    bars = src.bars_daily(spark, sf)
    known = company.ratios(bars.select("ticker", "date", "close"), *_parts(spark, sf))
    return factors.snapshots(bars, known, factors.month_ends(bars)), bars


def _ics(spark, sf):
    s, bars = _snapshots(spark, sf)
    return factors.factor_ics(rounded(s, 8), factors.forwards(bars), _ALL)


@register(f"{_SNAPS} SELECT ticker, date, {', '.join(f'round({f}, 5) AS {f}' for f in _ALL)} FROM fs")
def c5_factor_snapshots(spark, sf):
    return rounded(_snapshots(spark, sf)[0].select("ticker", "date", *_ALL), 5)


@register(f"""{_RANKS}, sp AS (SELECT CAST(max(date) - CAST(floor((max(date) - min(date)) * 0.25) AS INTEGER) AS DATE) AS cut FROM b),
g AS (SELECT factor, coalesce(avg(ic) FILTER (until <= cut), 0) AS train_ic, coalesce(avg(ic) FILTER (date > cut), 0) AS test_ic, count(ic) FILTER (until <= cut) AS n_train, count(ic) FILTER (date > cut) AS n_test FROM ic JOIN ed USING (date), sp WHERE factor IN {factors.FACTORS} GROUP BY factor),
w AS (SELECT *, greatest(train_ic, 0.005) / sum(greatest(train_ic, 0.005)) OVER () AS weight FROM g), c AS (SELECT *, sum(weight * train_ic) OVER () AS tr, sum(weight * test_ic) OVER () AS te FROM w)
SELECT factor, round(train_ic, 6) AS train_ic, round(test_ic, 6) AS test_ic, n_train, n_test, round(weight, 6) AS weight, round(tr, 6) AS train_composite, round(te, 6) AS test_composite, tr > 0.01 AND te < tr * 0.5 AS overfit FROM c""")
def c9_out_of_sample(spark, sf):
    """The last quarter of the days tests weights that the days before it gave."""
    ics = _ics(spark, sf).where(F.col("factor").isin(*factors.FACTORS))
    ends = src.bars_daily(spark, sf).agg(F.max("date").alias("b"), F.min("date").alias("a")).select(F.date_sub("b", F.floor(F.datediff("b", "a") * 0.25).cast("int")).alias("cut"))
    return rounded(factors.out_of_sample(ics.crossJoin(F.broadcast(ends)), F.col("cut")))  # one row


@register(f"""{_RANKS}, pr AS (SELECT 'momentum' AS factor, date, max(ic) FILTER (factor = 'mom_3m') AS a, max(ic) FILTER (factor = 'mom_12_1') AS b FROM ic GROUP BY date UNION ALL SELECT 'low_vol', date, max(ic) FILTER (factor = 'low_vol'), max(ic) FILTER (factor = 'low_vol_252') FROM ic GROUP BY date),
d AS (SELECT *, b - a AS d FROM pr WHERE a IS NOT NULL AND b IS NOT NULL), g AS (SELECT factor, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS diff, stddev_samp(d) / sqrt(count(*)) AS se, count(*) FILTER (d > 0) / count(*) * 100 AS wins FROM d GROUP BY factor)
SELECT factor, n, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b, round(diff, 6) AS diff, round(se, 6) AS se, round(wins, 6) AS wins_pct, round(diff / se, 4) AS t, CASE WHEN n < 2 THEN 'too few' WHEN diff / se >= 2 THEN 'better' WHEN diff / se <= -2 THEN 'worse' ELSE 'noise' END AS verdict FROM g""")
def c8_definitions(spark, sf):
    """Whether the production definitions of momentum and low volatility tell more than the short ones, by pairs of dates."""
    wide = _ics(spark, sf).groupBy("date").agg(*[F.max(F.when(F.col("factor") == f, F.col("ic"))).alias(f) for f in ("mom_3m", "mom_12_1", "low_vol", "low_vol_252")])
    pairs = wide.select("date", F.inline(F.array(F.struct(F.lit("momentum").alias("factor"), F.col("mom_3m").alias("a"), F.col("mom_12_1").alias("b")), F.struct(F.lit("low_vol").alias("factor"), F.col("low_vol").alias("a"), F.col("low_vol_252").alias("b")))))
    out = rep.paired_difference(pairs, "a", "b", ["factor"])
    return rounded(out.select("factor", "n", "mean_a", "mean_b", "diff", "se", "wins_pct", "t", "verdict"), t=4)


SCANNED = ("momentum", "value", "quality", "low_vol")


def _scan_sql() -> str:
    chain, source = "", "sz"
    for f in SCANNED:
        chain += f", {_score_sql(source, 'k', f'{f}_raw', f'a_{f}')}, {_score_sql(f'a_{f}', 'k, sector', f'{f}_raw', f'g_{f}')}"
        source = f"g_{f}"
    own = ", ".join(f"CASE WHEN count(*) OVER (PARTITION BY sector) >= 3 THEN score_g_{f} ELSE score_a_{f} END AS {f}" for f in SCANNED)
    weighed = " + ".join(f"{f} * {xs.WEIGHTS[f]!r}" for f in SCANNED)
    return f"""{RATIOS}, sx AS (SELECT ticker, sector, date, volume, coalesce((lag(close, 20) OVER ({O}) / lag(close, 251) OVER ({O}) - 1) * 100, 0.0) AS mom, close / lag(close) OVER ({O}) - 1 AS r, max(date) OVER () AS today FROM b),
sy2 AS (SELECT *, stddev_samp(r) OVER {rows(252)} * sqrt(252) * 100 AS vol, avg(CASE WHEN date >= today - 30 THEN volume END) OVER (PARTITION BY ticker) AS loud, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM sx),
sz AS (SELECT sy2.ticker, sector, 1 AS k, round(mom, 6) AS momentum_raw, round(greatest(0.0, 100 - coalesce(vol, 100.0)), 6) AS low_vol_raw, round(CASE WHEN pe > 0 THEN 100.0 / pe ELSE 0.0 END * 0.4 / 0.7 + coalesce(fcf_yield, 0.0) * 0.3 / 0.7, 6) AS value_raw,
  round(coalesce(roe, 0.0) * 0.45 + coalesce(margin, 0.0) * 0.35 + coalesce(accrual_q, 50.0) * 0.2, 6) AS quality_raw FROM sy2 LEFT JOIN rt ON rt.ticker = sy2.ticker AND rt.date = sy2.date WHERE rn = 1 AND coalesce(loud >= 10, true)){chain},
sc AS (SELECT ticker, sector, {own} FROM {source}), cp AS (SELECT *, {weighed} AS composite FROM sc)
SELECT ticker, sector, {', '.join(f'round({f}, 4) AS {f}' for f in SCANNED)}, round(composite, 4) AS composite, (row_number() OVER (ORDER BY round(composite, 6) DESC, ticker))::INTEGER AS rank FROM cp"""


@register(_scan_sql())
def c17_full_scan(spark, sf):
    """The scan of the last bars: momentum, value and quality as filed and low volatility, scored within sectors of three names or more, among names that are traded enough."""
    bars = src.bars_daily(spark, sf)
    known = company.ratios(bars.select("ticker", "date", "close"), *_parts(spark, sf)).drop("close")
    b = ind.volatility(ind.momentum(bars))
    last = b.groupBy("ticker", "sector").agg(F.max(F.struct("date", "momentum", "vol")).alias("l")).select("ticker", "sector", F.lit(1).alias("k"), "l.*")
    keeps = rep.liquid(bars, 30, 10.0).where("keeps").select("ticker")
    own = last.join(keeps, "ticker", "left_semi").join(known, ["ticker", "date"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    raw = own.select(
        "ticker", "sector", "k", fm.rnd("momentum", 6).alias("momentum_raw"), fm.rnd(F.greatest(F.lit(0.0), 100 - F.coalesce("vol", F.lit(100.0))), 6).alias("low_vol_raw"),
        fm.rnd(fm.earnings_yield(F.col("pe")) * factors.EARNINGS + zero(F.col("fcf_yield")) * factors.CASH, 6).alias("value_raw"),
        fm.rnd(fm.quality_raw(zero(F.col("roe")), zero(F.col("margin")), F.coalesce("accrual_q", F.lit(50.0))), 6).alias("quality_raw"),
    )
    for f in SCANNED:
        raw = xs.sector_score(raw, f"{f}_raw", ["k"], "sector", f)
    c = raw.withColumn("composite", fm.rnd(sum((F.col(f) * xs.WEIGHTS[f] for f in SCANNED), F.lit(0.0)), 6))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("composite").desc(), "ticker")))  # a row a name
    return rounded(ranked.select("ticker", "sector", *SCANNED, "composite", "rank"), 4)
