"""Queries of regressions, closed-form tests, rates and trailing percentiles, and of monthly orders."""

from __future__ import annotations

from statistics import NormalDist


from pyspark.sql import functions as F

from ..functions import special
from ..functions.formulas import rnd
from ..operators import allocation, edgar, joins, regression, simulate, sliding
from ..operators import indicators as ind
from ..sources import tables as src
from .catalog import register, rounded
from .panel import _MOM, _RSI, _panel
from .sql import BARS, COMPANY, FACTS, O, full

# -- special functions in SQL: folds whose state is one number -----------------


def _fold(start: str, items: str, step: str) -> str:
    return f"list_reduce(list_prepend({start}::DOUBLE, list_transform({items}, lambda i: i::DOUBLE)), lambda v, i: {step})"


def _beta_fraction(x: str, a: str, b: str) -> str:
    m = "floor(i / 2)"
    part = f"(CASE WHEN i % 2 = 0 THEN {m} * ({b} - {m}) * {x} / (({a} + 2 * {m} - 1) * ({a} + 2 * {m})) ELSE -({a} + {m}) * ({a} + {b} + {m}) * {x} / (({a} + 2 * {m}) * ({a} + 2 * {m} + 1)) END)"
    return f"(1 / (1 + {_fold('0.0', 'range(300, 0, -1)', f'{part} / (1 + v)')}))"


def student_p_sql(t: str, n: str) -> str:
    x, a, b = f"(({n}) / (({n}) + ({t}) * ({t})))", f"(({n}) / 2.0::DOUBLE)", "0.5::DOUBLE"
    front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
    return f"CASE WHEN {x} >= 1 THEN 1.0 WHEN {x} < ({a} + 1) / ({a} + {b} + 2) THEN {front} * {_beta_fraction(x, a, b)} / {a} ELSE 1 - {front} * {_beta_fraction(f'(1 - {x})', b, a)} / {b} END"


def normal_cdf_sql(z: str) -> str:
    """The series' nested form; for values within 6 of 0."""
    return f"0.5 + exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * ({z}) * {_fold('1.0', 'range(200, 0, -1)', f'1 + ({z}) * ({z}) / (2 * i + 1) * v')}"


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    return "(" + " + ".join(f"{'-' if j % 2 else ''}({x}) * {_det([row[:j] + row[j + 1 :] for row in m[1:]])}" for j, x in enumerate(m[0])) + ")"


def _cramer(m: list[list[str]], rhs: list[str]) -> list[str]:
    return [_det([[r if k == j else x for k, x in enumerate(row)] for row, r in zip(m, rhs, strict=True)]) for j in range(len(rhs))]


# -- regressions ---------------------------------------------------------------

FACTORS = ("mkt", "sec", "liq")
_RETURNS = f"""r0 AS (SELECT ticker, sector, date, volume, close / lag(close) OVER ({O}) - 1 AS ret FROM b),
r1 AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS mkt, avg(ret) OVER (PARTITION BY date, sector) - avg(ret) OVER (PARTITION BY date) AS sec,
  coalesce(avg(CASE WHEN volume >= 50 THEN ret END) OVER (PARTITION BY date), 0) - avg(ret) OVER (PARTITION BY date) AS liq FROM r0 WHERE ret IS NOT NULL)"""
_M = [[f"covar_pop({x}, {y})" for y in FACTORS] for x in FACTORS]
_NAMES = [[f"c{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
_STYLE = f"""{BARS}, {_RETURNS},
g AS (SELECT ticker, count(*) AS n, avg(ret) AS my, covar_pop(ret, ret) AS yy, {', '.join(f'avg({x}) AS m{i}' for i, x in enumerate(FACTORS))}, {', '.join(f'{_M[i][j]} AS c{i}{j}' for i in range(3) for j in range(i, 3))}, {', '.join(f'covar_pop({x}, ret) AS y{i}' for i, x in enumerate(FACTORS))} FROM r1 GROUP BY ticker),
d AS (SELECT *, CASE WHEN n >= 30 AND {_det(_NAMES)} > 1e-12 * c00 * c11 * c22 THEN {_det(_NAMES)} END AS det FROM g),
s AS (SELECT *, {', '.join(f'{x} / det AS b{i}' for i, x in enumerate(_cramer(_NAMES, ['y0', 'y1', 'y2'])))}, {', '.join(f'{x} / det AS z{i}' for i, x in enumerate(_cramer(_NAMES, ['m0', 'm1', 'm2'])))} FROM d),
t AS (SELECT *, my - b0 * m0 - b1 * m1 - b2 * m2 AS alpha, yy - b0 * y0 - b1 * y1 - b2 * y2 AS rest, 1 + z0 * m0 + z1 * m1 + z2 * m2 AS lever FROM s),
u AS (SELECT *, alpha / sqrt(greatest(rest, 0) / (n - 4) * lever) AS ta, (n - 4)::DOUBLE AS free FROM t),
st AS (SELECT ticker, n, alpha, b0, b1, b2, 1 - rest / yy AS r2, ta, CASE WHEN ta IS NOT NULL THEN {student_p_sql('ta', 'free')} END AS p FROM u)"""


def _returns(spark, sf):
    b = src.bars_daily(spark, sf).withColumn("ret", F.col("close") / F.lag("close").over(ind.by_time()) - 1).where("ret IS NOT NULL")
    # a day's mean as an aggregate that joins back: a market has few days, so that no day's rows meet in one task
    day = b.groupBy("date").agg(F.avg("ret").alias("mkt"), F.avg(F.when(F.col("volume") >= 50, F.col("ret"))).alias("_busy"))
    sector = b.groupBy("date", "sector").agg(F.avg("ret").alias("_sector"))
    out = b.join(day, "date").join(sector, ["date", "sector"])
    return out.select("ticker", "sector", "date", "ret", "mkt", (F.col("_sector") - F.col("mkt")).alias("sec"), (F.coalesce("_busy", F.lit(0.0)) - F.col("mkt")).alias("liq"))


@register(f"""{_STYLE} SELECT ticker, n, round(alpha, 6) AS alpha, round(b0, 5) AS b_mkt, round(b1, 5) AS b_sec, round(b2, 5) AS b_liq, round(r2, 6) AS r2, round(ta, 5) AS t_alpha, round(p, 6) AS p_alpha, round(alpha * 252 * 100, 3) AS alpha_year_pct, p < 0.05 AS significant FROM st""")
def a23_style_regression(spark, sf):
    out = regression.style(_returns(spark, sf), ["ticker"], list(FACTORS))
    return rounded(out, b_mkt=5, b_sec=5, b_liq=5, t_alpha=5, alpha_year_pct=3)


@register(f"""{BARS}, {_RETURNS} SELECT ticker, round(regr_slope(ret, mkt), 5) AS b_mkt, round(regr_intercept(ret, mkt), 6) AS alpha, round(regr_r2(ret, mkt), 6) AS r2 FROM r1 GROUP BY ticker HAVING count(*) >= 30""")
def a23_market_model(spark, sf):
    out = regression.style(_returns(spark, sf), ["ticker"], ["mkt"]).where("n >= 30")
    return rounded(out.select("ticker", "b_mkt", "alpha", "r2"), b_mkt=5)


@register(f"""{_STYLE}, bt AS (SELECT ticker, date, covar_samp(ret, mkt) OVER w / var_samp(mkt) OVER w AS beta, count(*) OVER w AS k FROM r1 WINDOW w AS ({O} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
lb AS (SELECT ticker, arg_max(beta, date) AS beta FROM bt WHERE k >= 60 AND beta IS NOT NULL GROUP BY ticker),
ls AS (SELECT sector, sum(v) AS v FROM (SELECT ticker, sector, arg_max(close * volume, date) AS v FROM b GROUP BY 1, 2) GROUP BY 1), hh AS (SELECT sum((v / tv) * (v / tv)) AS hhi, max(v / tv) * 100 AS top FROM (SELECT v, sum(v) OVER () AS tv FROM ls))
SELECT st.ticker, round(alpha * 252 * 100, 3) AS alpha_year_pct, round(p, 6) AS p_alpha, round(r2, 6) AS r2, round(beta, 5) AS latest_beta, round(hhi, 6) AS hhi, round(top, 4) AS top_sector_pct, CASE WHEN hhi > 0.25 THEN 'high' WHEN hhi > 0.15 THEN 'medium' ELSE 'spread' END AS concentration
FROM st LEFT JOIN lb USING (ticker), hh""")
def y1_alpha_check(spark, sf):
    """Style regression, latest market beta and the concentration of the last values by sector."""
    r = _returns(spark, sf)
    beta = ind.rolling_beta(r.select("ticker", "date", F.col("ret").alias("r"), F.col("mkt").alias("m"))).where("beta IS NOT NULL").groupBy("ticker").agg(F.max_by("beta", "date").alias("latest_beta"))
    sector = src.bars_daily(spark, sf).groupBy("ticker", "sector").agg(F.max_by(F.col("close") * F.col("volume"), "date").alias("v")).groupBy("sector").agg(F.sum("v").alias("v"))
    total = sector.agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"), F.max("v").alias("m"))
    hhi = F.col("q") / (F.col("t") * F.col("t"))
    one = total.select(hhi.alias("hhi"), (F.col("m") / F.col("t") * 100).alias("top_sector_pct"), F.when(hhi > 0.25, "high").when(hhi > 0.15, "medium").otherwise("spread").alias("concentration"))
    out = regression.style(r, ["ticker"], list(FACTORS)).join(beta, "ticker", "left").crossJoin(F.broadcast(one))  # one row
    return rounded(out.select("ticker", "alpha_year_pct", "p_alpha", "r2", "latest_beta", "hhi", "top_sector_pct", "concentration"), alpha_year_pct=3, latest_beta=5, top_sector_pct=4)


_RANGE = f"""rg AS (SELECT ticker, date, CASE WHEN hi != lo THEN (close - lo) / (hi - lo) END AS place, CASE WHEN v != 0 THEN volume / v END AS loud FROM (SELECT *, {full(20, 'min(low)')} AS lo, {full(20, 'max(high)')} AS hi, {full(10, 'avg(volume)', 20)} AS v FROM b))"""


@register(f"""{BARS}, {_MOM}, {_RANGE}, c AS (SELECT m.ticker, m.date, place AS s, mom AS a, loud AS c, fwd FROM m JOIN rg ON rg.ticker = m.ticker AND rg.date = m.date WHERE place IS NOT NULL AND mom IS NOT NULL AND loud IS NOT NULL AND fwd IS NOT NULL),
z AS (SELECT ticker, date, fwd, {', '.join(f'({x} - avg({x}) OVER d) / (stddev_pop({x}) OVER d + 1e-9) AS {x}' for x in 'sac')} FROM c WINDOW d AS (PARTITION BY date)),
g AS (SELECT date, count(*) AS n, avg(s) AS ms, avg(a) AS ma, avg(c) AS mc, covar_pop(a, a) AS aa, covar_pop(a, c) AS ac, covar_pop(c, c) AS cc, covar_pop(a, s) AS sa, covar_pop(c, s) AS sc FROM z GROUP BY date HAVING count(*) >= 15),
k AS (SELECT date, n, ms - ba * ma - bc * mc AS al, ba, bc FROM (SELECT *, (sa * cc - sc * ac) / det AS ba, (aa * sc - ac * sa) / det AS bc FROM (SELECT *, aa * cc - ac * ac AS det FROM g) WHERE det > 1e-12 * aa * cc)),
e AS (SELECT z.date, n, s - al - ba * a - bc * c AS e, fwd FROM z JOIN k USING (date)),
r AS (SELECT date, n, rank() OVER (PARTITION BY date ORDER BY e) + (count(*) OVER (PARTITION BY date, e) - 1) / 2.0 AS x, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS y FROM e)
SELECT date, n, round(corr(x, y), 6) AS ic FROM r GROUP BY date, n""")
def a24_residual_ic(spark, sf):
    r = ind.range_and_volume(src.bars_daily(spark, sf)).select("ticker", "date", F.col("range_position").alias("place"), F.col("volume_ratio").alias("loud"))
    return rounded(regression.residual_ic(_panel(spark, sf).join(r, ["ticker", "date"]), ["date"], "place", ["mom", "loud"], "fwd"))


@register(_RSI.rsplit("SELECT ticker, date", 1)[0] + f""", rr AS (SELECT ticker, date, 100 - 100 / (1 + g / CASE WHEN s = 0 THEN 1e-10 ELSE s END) AS rsi FROM e), {_RANGE},
sc AS (SELECT rr.ticker, rr.date, round(place * 100, 1) AS chart, round(least(loud * 50, 100.0), 1) AS quant, round(rsi, 1) AS ict FROM rr JOIN rg ON rg.ticker = rr.ticker AND rg.date = rr.date),
vd AS (SELECT *, round(chart * 0.5 + quant * 0.3 + ict * 0.2, 1) AS verdict FROM sc WHERE chart IS NOT NULL AND quant IS NOT NULL AND ict IS NOT NULL),
nm AS (SELECT date, count(*) AS n, avg((chart - ict) * (chart - ict)) AS aa, avg((chart - ict) * (quant - ict)) AS ab, avg((quant - ict) * (quant - ict)) AS bb, avg((chart - ict) * (verdict - ict)) AS av, avg((quant - ict) * (verdict - ict)) AS bv FROM vd GROUP BY date),
wt AS (SELECT date, n, (av * bb - bv * ab) / det AS wc, (aa * bv - ab * av) / det AS wq FROM (SELECT *, CASE WHEN n >= 20 AND aa * bb - ab * ab > 1e-12 * aa * bb THEN aa * bb - ab * ab END AS det FROM nm)),
rs AS (SELECT vd.date, max(abs(chart * wc + quant * wq + ict * (1 - wc - wq) - verdict)) AS off FROM vd JOIN wt USING (date) GROUP BY 1)
SELECT date, n, round(CASE WHEN ok THEN wc END, 5) AS w_chart, round(CASE WHEN ok THEN wq END, 5) AS w_quant, round(CASE WHEN ok THEN 1 - wc - wq END, 5) AS w_ict FROM (SELECT wt.*, off <= 0.2 AND 1 - wc - wq BETWEEN 0 AND 1 AS ok FROM wt JOIN rs USING (date))""")
def a25_recovered_weights(spark, sf):
    """Blend weights found again from verdicts of one decimal."""
    r = ind.range_and_volume(simulate.rsi(src.bars_daily(spark, sf)))
    s = r.select("ticker", "date", rnd(F.col("range_position") * 100, 1).alias("chart"), rnd(F.least(F.col("volume_ratio") * 50, F.lit(100.0)), 1).alias("quant"), rnd("rsi", 1).alias("ict"))
    s = s.where("chart IS NOT NULL AND quant IS NOT NULL AND ict IS NOT NULL").withColumn("verdict", rnd(F.col("chart") * 0.5 + F.col("quant") * 0.3 + F.col("ict") * 0.2, 1))
    return rounded(regression.recovered_weights(s, ["date"], ["chart", "quant", "ict"], "verdict", 0.2), 5)


# -- closed forms --------------------------------------------------------------

TRIALS = 50
_BEST = (1 - 0.5772156649) * NormalDist().inv_cdf(1 - 1 / TRIALS) + 0.5772156649 * NormalDist().inv_cdf(1 - 1 / (TRIALS * 2.718281828459045))


@register(f"""{BARS}, r AS (SELECT ticker, ln(close / lag(close) OVER ({O})) AS r FROM b), m AS (SELECT ticker, r, avg(r) OVER (PARTITION BY ticker) AS mu FROM r WHERE r IS NOT NULL),
s AS (SELECT ticker, count(*) AS n, first(mu) / stddev_samp(r) AS sharpe, avg((r - mu) ** 3) / var_pop(r) ** 1.5 AS skew, avg((r - mu) ** 4) / var_pop(r) ** 2 AS kurtosis FROM m GROUP BY ticker HAVING count(*) > 2),
z AS (SELECT *, (sharpe - {_BEST!r}::DOUBLE / sqrt(n)) / sqrt(greatest((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1), 1e-12)) AS z FROM s)
SELECT ticker, n, round(sharpe, 6) AS sharpe, round({normal_cdf_sql('z')}, 6) AS dsr FROM z""")
def f24_deflated_sharpe(spark, sf):
    b = src.bars_daily(spark, sf).withColumn("_r", F.log(F.col("close") / F.lag("close").over(ind.by_time())))
    s = b.groupBy("ticker").agg(F.count("_r").alias("n"), (F.avg("_r") / F.stddev_samp("_r")).alias("sharpe"), F.skewness("_r").alias("skew"), (F.kurtosis("_r") + 3).alias("kurtosis")).where("n > 2")
    return rounded(s.select("ticker", "n", "sharpe", special.deflated_sharpe(F.col("sharpe"), F.lit(TRIALS), F.col("n"), F.col("skew"), F.col("kurtosis")).alias("dsr")))


@register(f"""{BARS}, x AS (SELECT ticker, close > lag(close) OVER ({O}) AS up, volume > lag(volume) OVER ({O}) AS loud FROM b),
t AS (SELECT ticker, count(*) FILTER (up AND loud) AS a, count(*) FILTER (up AND NOT loud) AS b, count(*) FILTER (NOT up AND loud) AS c, count(*) FILTER (NOT up AND NOT loud) AS d FROM x GROUP BY ticker),
k AS (SELECT *, unnest(range(greatest(0, a + c - c - d), least(a + b, a + c) + 1)) AS x FROM t),
p AS (SELECT ticker, a, b, c, d, x, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp FROM k),
s AS (SELECT ticker, max(CASE WHEN x = a THEN lp END) AS seen FROM p GROUP BY ticker)
SELECT p.ticker, a, b, c, d, round(least(1.0, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)), 6) AS p FROM p JOIN s USING (ticker) GROUP BY ALL""")
def i7_fisher(spark, sf):
    """Whether rises come with more volume: a two-sided exact test for each ticker."""
    w = ind.by_time()
    x = src.bars_daily(spark, sf).select("ticker", (F.col("close") > F.lag("close").over(w)).alias("up"), (F.col("volume") > F.lag("volume").over(w)).alias("loud"))
    n = lambda up, loud: F.count_if((F.col("up") == up) & (F.col("loud") == loud))
    t = x.groupBy("ticker").agg(n(True, True).alias("a"), n(True, False).alias("b"), n(False, True).alias("c"), n(False, False).alias("d"))
    return rounded(t.withColumn("p", special.fisher_exact(*[F.col(k) for k in "abcd"])))


_WORTH = "equity * pow(1 / (1 + v + i), n) - monthly * CASE WHEN abs(v + i) < 1e-12 THEN n ELSE (1 - pow(1 / (1 + v + i), n)) / (1 - 1 / (1 + v + i)) END"


@register(f"""WITH o AS (SELECT o_custkey, count(DISTINCT date_trunc('month', o_orderdate))::DOUBLE AS n, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*), 2) AS monthly FROM orders GROUP BY 1),
a AS (SELECT o_custkey, n, monthly, n * monthly * (1 + c_acctbal / 20000) AS equity FROM o JOIN customer ON o_custkey = c_custkey)
SELECT o_custkey AS account, n::BIGINT AS n, monthly, round((pow(1 + {_fold('-0.99', 'list_transform(range(1, 201), lambda k: 1.99::DOUBLE / pow(2, k))', f'CASE WHEN {_WORTH} > 0 THEN v + i ELSE v END')}, 12) - 1) * 100, 4) AS irr_pct FROM a""")
def f23_account_rates(spark, sf):
    """Yearly rate of customers who put in their mean order in each month that they ordered in."""
    o = src.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct(F.trunc("o_orderdate", "month")).alias("n"), rnd(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 2).alias("monthly"))
    a = o.join(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey").withColumn("equity", F.col("n") * F.col("monthly") * (1 + F.col("c_acctbal") / 20000))
    return rounded(a.select(F.col("o_custkey").alias("account"), "n", "monthly", special.internal_rate(F.col("monthly"), F.col("n"), F.col("equity")).alias("irr_pct")), 4)


# -- trailing percentiles ------------------------------------------------------

_RANKED = """SELECT e.ticker, e."end", e.filed, count(p.v) AS pool, round(CASE WHEN count(p.v) >= 20 AND e.v IS NOT NULL THEN count(*) FILTER (p.v < e.v) / count(p.v) END, 6) AS percentile
FROM ev e LEFT JOIN ev p ON p.filed < e.filed AND p.filed >= e.filed - 250 AND p.v IS NOT NULL AND e.v IS NOT NULL GROUP BY e.ticker, e."end", e.filed, e.v"""


@register(f"""{FACTS}, d AS (SELECT ticker, "end", filed, CASE WHEN "end" - lag("end", 4) OVER w BETWEEN 320 AND 410 THEN net_income - lag(net_income, 4) OVER w END AS d FROM f WINDOW w AS (PARTITION BY ticker ORDER BY "end")),
s AS (SELECT *, CASE WHEN count(d) OVER p = 8 THEN stddev_samp(d) OVER p END AS sd FROM d WINDOW p AS (PARTITION BY ticker ORDER BY "end" ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
ev AS (SELECT ticker, "end", filed, round(CASE WHEN sd > 0 THEN d / sd END, 6) AS v FROM s) {_RANKED}""")
def w35_surprise_percentile(spark, sf):
    e = edgar.standardised_surprise(src.facts_quarterly(spark, sf)).select("ticker", "end", "filed", rnd("sue", 6).alias("v"))
    return rounded(sliding.trailing_percentile(e, "filed", "v").select("ticker", "end", "filed", "pool", "percentile"))


@register(f"""{BARS}, {COMPANY}, cal AS (SELECT DISTINCT date FROM b), en AS (SELECT cf.ticker, cf."end", cf.filed, (SELECT min(date) FROM cal WHERE cal.date > cf.filed) AS day FROM cf),
ys AS (SELECT en.ticker, en."end", arg_max(shares, cy.filed) AS shares, arg_max(equity, cy.filed) AS equity FROM en JOIN cy ON cy.ticker = en.ticker AND cy.filed <= en.filed GROUP BY 1, 2),
ev AS (SELECT en.ticker, en."end", en.filed, round(CASE WHEN equity > 0 AND close * shares > 0 THEN equity / (close * shares) END, 6) AS v FROM en JOIN b ON b.ticker = en.ticker AND b.date = en.day LEFT JOIN ys ON ys.ticker = en.ticker AND ys."end" = en."end")
{_RANKED.replace('AS percentile', 'AS percentile, e.v AS book_to_market')}""")
def c14_book_to_market(spark, sf):
    """Equity as filed by the market value on the first trading day after the filing, and its percentile among those filed before."""
    bars, (facts, years) = src.bars_daily(spark, sf), (src.company_facts(spark, sf), src.company_years(spark, sf))
    entry = joins.next_day_trades(facts.select("ticker", "end", "filed"), bars, "filed", 0)
    closes = bars.join(F.broadcast(joins.calendar(bars)), "date").select("ticker", F.col("pos").alias("entry_pos"), "close")
    e = joins.asof(entry.join(closes, ["ticker", "entry_pos"]), years.withColumnRenamed("filed", "known"), "ticker", "filed", "known", ["shares", "equity"])
    cap = F.col("close") * F.col("shares")
    e = e.withColumn("book_to_market", rnd(F.when((F.col("equity") > 0) & (cap > 0), F.col("equity") / cap), 6))
    return rounded(sliding.trailing_percentile(e, "filed", "book_to_market").select("ticker", "end", "filed", "pool", "percentile", "book_to_market"))


# -- orders --------------------------------------------------------------------

#: Five assets, named after the orders' priorities, and how an account wants to be spread over them.
TARGETS = {"1-URGENT": 0.40, "2-HIGH": 0.25, "3-MEDIUM": 0.15, "4-NOT SPECIFIED": 0.12, "5-LOW": 0.08}


def _orders_sql() -> str:
    values = ", ".join(f"('{t}', {w!r}::DOUBLE, {i})" for i, (t, w) in enumerate(TARGETS.items()))
    steps = "k0 AS (SELECT account, cash AS left0 FROM a)"
    for i in range(1, 6):
        qty = f"greatest(0, floor(least(gap, left{i - 1}) / price))"
        steps += f", q{i} AS (SELECT k.account, asset, {qty} AS qty, price, left{i - 1} - {qty} * price AS left{i}, {i} AS no FROM k{i - 1} k JOIN g ON g.account = k.account AND g.no = {i}), k{i} AS (SELECT account, left{i} FROM q{i})"
    every = " UNION ALL ".join(f"SELECT account, asset, qty, price, no FROM q{i}" for i in range(1, 6))
    return f"""WITH w AS (SELECT * FROM (VALUES {values}) AS w(asset, share, i)), px AS (SELECT o_orderpriority AS asset, round(sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) / 1000, 2) AS price FROM orders GROUP BY 1),
a AS (SELECT c_custkey AS account, greatest(c_acctbal, 0) * (1 - 300 / 10000.0::DOUBLE) AS cash FROM customer), h AS (SELECT o_custkey AS account, o_orderpriority AS asset, count(*)::DOUBLE AS held FROM orders GROUP BY 1, 2),
v AS (SELECT a.account, cash, w.asset, share, i, price, coalesce(held, 0) * price AS value FROM a CROSS JOIN w JOIN px USING (asset) LEFT JOIN h ON h.account = a.account AND h.asset = w.asset),
g AS (SELECT account, asset, price, gap, row_number() OVER (PARTITION BY account ORDER BY gap DESC, i) AS no FROM (SELECT *, (sum(value) OVER (PARTITION BY account) + cash) * share - value AS gap FROM v)),
{steps}, al AS ({every}) SELECT account, asset, qty, price AS est_price, (row_number() OVER (PARTITION BY account ORDER BY no))::INTEGER AS place FROM al WHERE qty > 0"""


@register(_orders_sql())
def t9_plan_orders(spark, sf):
    """Customers as accounts: their balance is the cash, their orders by priority what they hold."""
    o = src.table(spark, sf, "orders")
    prices = o.groupBy(F.col("o_orderpriority").alias("asset")).agg(rnd(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000, 2).alias("price"))
    held = o.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").cast("double").alias("q")).groupBy(F.col("o_custkey").alias("account")).agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "q"))).alias("held"))
    cash = src.table(spark, sf, "customer").select(F.col("c_custkey").alias("account"), F.greatest("c_acctbal", F.lit(0.0)).alias("cash"))
    accounts = cash.join(held, "account", "left").withColumn("held", F.coalesce("held", F.create_map().cast("map<string,double>")))
    return allocation.plan_orders(accounts, prices, TARGETS)
