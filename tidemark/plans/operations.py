"""Queries of company facts by tag, scorecards, weights, curves, sizes and log upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..functions.formulas import rnd
from ..operators import cross_section as xs
from ..operators import edgar, joins, ledger, text
from ..sources import tables as src
from .catalog import register, rounded
from .panel import _MOM, _panel
from .sql import BARS

# -- facts by tag --------------------------------------------------------------

TAGS = {"1": "Revenues", "2": "SalesRevenueNet", "3": "Revenues", "4": "SalesRevenueNet", "5": "OtherIncome"}
CHAIN = ["Revenues", "SalesRevenueNet"]
_TAG = "CASE left(o_orderpriority, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAGS.items()) + " END"
_FACTS = f"""WITH oo AS (SELECT n_name AS ticker, n_nationkey, {_TAG} AS tag, CASE WHEN o_orderstatus = 'P' THEN 'shares' ELSE 'USD' END AS unit, CAST(o_orderdate AS DATE) AS od, o_totalprice::DECIMAL(18, 2) AS x
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
qf AS (SELECT ticker, tag, unit, CAST(date_trunc('quarter', od) AS DATE) AS start, CAST(date_trunc('quarter', od) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", sum(x)::DOUBLE AS val, any_value(n_nationkey) AS nk, '10-Q' AS form FROM oo GROUP BY 1, 2, 3, 4, 5),
yf AS (SELECT ticker, tag, unit, CAST(date_trunc('year', od) AS DATE) AS start, CAST(date_trunc('year', od) + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) AS "end", sum(x)::DOUBLE AS val, any_value(n_nationkey) AS nk, '10-K' AS form FROM oo GROUP BY 1, 2, 3, 4, 5),
fa AS (SELECT ticker, tag, unit, start, "end", val, CAST("end" + CAST(30 + nk AS INTEGER) AS DATE) AS filed, form FROM (SELECT * FROM qf UNION ALL SELECT * FROM yf)),
ff AS (SELECT * FROM fa UNION ALL SELECT ticker, tag, unit, start, "end", val * 2, CAST(filed + 90 AS DATE), form || '/A' FROM fa)"""


def _facts(spark, sf):
    """Quarterly and annual facts by tag and unit, each filed once and again, doubled, 90 days later."""
    who = src.table(spark, sf, "customer").join(F.broadcast(src.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("ticker"), "n_nationkey")
    o = src.table(spark, sf, "orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("ticker", "n_nationkey", F.expr(_TAG).alias("tag"), F.when(F.col("o_orderstatus") == "P", "shares").otherwise("USD").alias("unit"), F.to_date("o_orderdate").alias("od"), F.col("o_totalprice").cast("decimal(18,2)").alias("x"))

    def period(unit: str, months: int, form: str):
        start = F.to_date(F.date_trunc(unit, "od"))
        g = o.groupBy("ticker", "tag", "unit", start.alias("start")).agg(F.sum("x").cast("double").alias("val"), F.max("n_nationkey").alias("nk"))
        end = F.date_sub(F.add_months("start", months), 1)
        return g.select("ticker", "tag", "unit", "start", end.alias("end"), "val", F.date_add(end, F.col("nk") + 30).alias("filed"), F.lit(form).alias("form"))

    fa = period("quarter", 3, "10-Q").unionByName(period("year", 12, "10-K"))
    again = fa.withColumns({"val": F.col("val") * 2, "filed": F.date_add("filed", 90), "form": F.concat("form", F.lit("/A"))})
    return fa.unionByName(again)


@register(f"""{_FACTS} SELECT ticker, tag, "end", form, round(val, 2) AS val, CAST(list_position({CHAIN}, tag) AS BIGINT) AS chain FROM ff WHERE unit = 'USD' AND tag IN ('Revenues', 'SalesRevenueNet')""")
def x1_tag_chain(spark, sf):
    return rounded(edgar.tag_chain(_facts(spark, sf), CHAIN).select("ticker", "tag", "end", "form", "val", F.col("chain").cast("long").alias("chain")), 2)


@register(f"""{_FACTS}, k AS (SELECT ticker, CASE WHEN "end" - start BETWEEN 80 AND 100 THEN 'quarter' WHEN "end" - start BETWEEN 350 AND 380 THEN 'annual' ELSE 'other' END AS kind, val FROM ff UNION ALL SELECT ticker, 'instant', val FROM ff WHERE form = '10-K') SELECT ticker, kind, count(*) AS n, round(sum(val::DECIMAL(18, 2))::DOUBLE, 2) AS total FROM k GROUP BY 1, 2""")
def x2_durations(spark, sf):
    f = _facts(spark, sf)
    instants = f.where("form = '10-K'").withColumn("start", F.lit(None).cast("date"))
    k = edgar.kind_of_duration(f.unionByName(instants))
    return rounded(k.groupBy("ticker", "kind").agg(F.count("*").alias("n"), F.sum(F.col("val").cast("decimal(18,2)")).cast("double").alias("total")), 2)


@register(f"""{_FACTS}, c AS (SELECT *, list_position({CHAIN}, tag) AS chain FROM ff WHERE unit = 'USD' AND tag IN ('Revenues', 'SalesRevenueNet') AND form LIKE '10-Q%'), r AS (SELECT *, row_number() OVER (PARTITION BY ticker, "end" ORDER BY filed, chain, val) AS rn FROM c)
SELECT ticker, "end", filed, round(val, 2) AS val, tag FROM r WHERE rn = 1""")
def x4_first_filed(spark, sf):
    f = edgar.tag_chain(_facts(spark, sf), CHAIN).where("form LIKE '10-Q%'").select("ticker", "end", "filed", "val", "tag", "chain")
    return rounded(edgar.first_filed(f, ["ticker", "end"]).select("ticker", "end", "filed", "val", "tag"), 2)


@register(f"""{_FACTS}, c AS (SELECT DISTINCT ticker, tag AS candidate, "end" FROM ff WHERE unit = 'USD' AND NOT (tag = 'Revenues' AND "end" > DATE '1999-12-31' AND length(ticker) % 2 = 0)), g AS (SELECT ticker, candidate, max("end") AS last, count(*) FILTER ("end" >= DATE '2019-01-01') AS recent, count(*) AS n FROM c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY (mx - last <= 400) DESC, recent DESC, n DESC, candidate) AS rn FROM (SELECT *, max(last) OVER (PARTITION BY ticker) AS mx FROM g)) SELECT c.ticker, c.candidate, c."end" FROM c JOIN r ON r.ticker = c.ticker AND r.candidate = c.candidate AND r.rn = 1""")
def x5_best_metric(spark, sf):
    """Tags as candidates, of which some names gave up the first one years ago."""
    c = _facts(spark, sf).where("unit = 'USD' AND NOT (tag = 'Revenues' AND end > DATE '1999-12-31' AND length(ticker) % 2 = 0)").select("ticker", F.col("tag").alias("candidate"), "end").distinct()
    return edgar.best_metric(c).select("ticker", "candidate", "end")


@register(f"""{_FACTS}, q AS (SELECT ticker, start, "end", filed, sum(val) AS val FROM fa WHERE form = '10-Q' GROUP BY 1, 2, 3, 4) SELECT ticker, "end", filed, round(val, 2) AS val FROM q""")
def w51_year_to_date(spark, sf):
    """Year-to-date facts, taken apart again: their differences are the quarters."""
    q = _facts(spark, sf).where("form = '10-Q'").groupBy("ticker", "end", "filed").agg(F.sum("val").alias("q"))
    year = F.to_date(F.date_trunc("year", "end"))
    ytd = q.withColumn("start", year).withColumn("val", F.sum("q").over(Window.partitionBy("ticker", "start").orderBy("end")))
    return rounded(edgar.year_to_date_quarters(ytd.select("ticker", "start", "end", "filed", "val")), 2)


# -- scorecards and weights ----------------------------------------------------


@register(f"""{BARS}, {_MOM}, f AS (SELECT date, 'mom' AS slug, mom AS s, fwd FROM m UNION ALL SELECT date, 'px', close, fwd FROM m), v AS (SELECT * FROM f WHERE s IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT date, slug, rank() OVER (PARTITION BY date, slug ORDER BY s) + (count(*) OVER (PARTITION BY date, slug, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, slug ORDER BY fwd) + (count(*) OVER (PARTITION BY date, slug, fwd) - 1) / 2.0 AS b FROM v),
i AS (SELECT date, slug, round(corr(a, b), 9) AS ic FROM r GROUP BY date, slug HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0), d AS (SELECT slug, date, ic, ic - avg(ic) OVER (PARTITION BY slug) AS d FROM i),
p AS (SELECT slug, ic, d * d AS g0, {', '.join(f'd * lag(d, {k}) OVER w AS g{k}' for k in range(1, 6))} FROM d WINDOW w AS (PARTITION BY slug ORDER BY date)),
s AS (SELECT slug, count(*) AS n, avg(ic) AS mean, stddev_samp(ic) / sqrt(count(*)) AS plain, count(*) FILTER (ic > 0) / count(*) AS hit, (sum(g0) + 2 * ({' + '.join(f'{6 - k} / 6.0 * coalesce(sum(g{k}), 0)' for k in range(1, 6))})) / (count(*) - 1) AS t FROM p GROUP BY slug HAVING count(*) > 10),
e AS (SELECT *, CASE WHEN t <= 0 THEN 0.0 ELSE sqrt(t / n) END AS se FROM s) SELECT slug, n, round(mean, 6) AS mean, round(se, 6) AS se, round(mean / se, 5) AS t, round(least(n, n * (plain / se) * (plain / se)), 4) AS effective_n, round(hit, 6) AS hit FROM e""")
def a10_scorecard(spark, sf):
    p = _panel(spark, sf)
    f = p.select("date", "ticker", "fwd", F.inline(F.array(F.struct(F.lit("mom").alias("slug"), F.col("mom").alias("s")), F.struct(F.lit("px").alias("slug"), F.col("close").alias("s")))))
    ics = xs.spearman_ic(f, "s", "fwd", ["date", "slug"]).withColumn("ic", rnd("ic", 9))
    return rounded(xs.analyst_scorecard(ics, "slug", 5), t=5, effective_n=4)


@register("""WITH b AS (SELECT o_orderstatus AS regime, o_orderpriority AS factor, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY o_orderstatus) AS weight FROM orders GROUP BY 1, 2),
i AS (SELECT o_orderpriority AS factor, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) / 1000000 - 0.15 AS ic FROM orders WHERE o_orderpriority < '5' GROUP BY 1), w AS (SELECT regime, b.factor, CASE WHEN ic IS NOT NULL THEN weight * greatest(ic, 0.005) ELSE 0 END AS w FROM b LEFT JOIN i ON i.factor = b.factor)
SELECT regime, factor, round(w / sum(w) OVER (PARTITION BY regime), 6) AS weight FROM w""")
def c10_regime_weights(spark, sf):
    o = src.table(spark, sf, "orders")
    n = o.groupBy(F.col("o_orderstatus").alias("regime"), F.col("o_orderpriority").alias("factor")).agg(F.count("*").alias("n"))
    base = n.withColumn("weight", F.col("n") / F.sum("n").over(Window.partitionBy("regime"))).drop("n")
    ics = o.where("o_orderpriority < '5'").groupBy(F.col("o_orderpriority").alias("factor")).agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000000 - 0.15).alias("ic"))
    return rounded(xs.regime_weights(base, ics))


@register("""WITH r AS (SELECT event_type AS account, CAST(ts AS DATE) AS date, avg(value - 50) / 500 AS ret FROM events WHERE value IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY account ORDER BY date)) AS c FROM r WHERE ret > -1),
d AS (SELECT *, c / greatest(1.0, max(c) OVER (PARTITION BY account ORDER BY date)) - 1 AS d FROM c) SELECT account, count(*) AS n, round(exp(sum(ln(1 + ret))) - 1, 6) AS total, round(avg(ret) / stddev_samp(ret) * sqrt(252), 5) AS sharpe, round(min(d), 6) AS max_drawdown FROM d GROUP BY account""")
def a27_performance(spark, sf):
    e = src.table(spark, sf, "events").where("value IS NOT NULL").groupBy(F.col("event_type").alias("account"), F.to_date("ts").alias("date")).agg((F.avg(F.col("value") - 50) / 500).alias("ret"))
    return rounded(ledger.performance(e), sharpe=5)


@register(f"""{BARS}, c AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, arg_max(close, date) AS close FROM b GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY close DESC, ticker) AS rn FROM c), s AS (SELECT month, list(ticker ORDER BY ticker) AS names FROM k WHERE rn <= 8 GROUP BY month),
p AS (SELECT month, names, lag(names) OVER (ORDER BY month) AS before FROM s) SELECT month, len(list_filter(names, lambda x: NOT list_contains(before, x))) + len(list_filter(before, lambda x: NOT list_contains(names, x))) AS changed FROM p WHERE before IS NOT NULL""")
def u4_turnover(spark, sf):
    """Names that enter or leave the eight dearest of a month's end."""
    b = src.bars_daily(spark, sf)
    c = b.groupBy("ticker", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("close"))
    s = xs.top_k(c, "close", ["month"], 8).groupBy("month").agg(F.sort_array(F.collect_list("ticker")).alias("names"))  # eight names a month
    p = s.join(s.select(F.add_months("month", 1).alias("month"), F.col("names").alias("before")), "month")
    return p.select("month", joins.turnover(F.col("before"), F.col("names")).cast("long").alias("changed"))


# -- scores, sizes, logs -------------------------------------------------------

GOOD, BAD = ["en", "or", "al"], ["to", "is", "no"]


@register(f"""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations), s AS (SELECT conv_id, {' + '.join(f"(contains(lower(text), '{w}'))::INT" for w in GOOD)} - {' - '.join(f"(contains(lower(text), '{w}'))::INT" for w in BAD)} AS s FROM t WHERE rn <= 8)
SELECT conv_id, round(greatest(0.0, least(100.0, 50 + 12 * avg(s))), 6) AS sentiment FROM s GROUP BY conv_id""")
def f32_keyword_sentiment(spark, sf):
    t = src.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("pos"), "text")
    return rounded(text.keyword_sentiment(t, "conv_id", F.col("text"), GOOD, BAD))


@register("""WITH g AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE / count(*) / 1000 AS entry, min(o_totalprice) / 1000 AS stop FROM orders GROUP BY 1), a AS (SELECT g.*, c_acctbal * 100 AS equity FROM g JOIN customer ON c_custkey = o_custkey)
SELECT o_custkey AS account, CASE WHEN entry > 0 AND entry > stop THEN greatest(0, floor(least(equity * 0.00155 / ((entry - stop) * 1.0), equity * 0.15 / (entry * 1.0)))) ELSE 0 END::BIGINT AS qty FROM a""")
def f19_position_size(spark, sf):
    g = src.table(spark, sf, "orders").groupBy("o_custkey").agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*") / 1000).alias("entry"), (F.min("o_totalprice") / 1000).alias("stop"))
    a = g.join(src.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 100).alias("equity")), "o_custkey")
    return a.select(F.col("o_custkey").alias("account"), fm.position_size(F.col("equity"), F.col("entry"), F.col("stop"), F.lit(1.0)).alias("qty"))


@register("""WITH c AS (SELECT c_custkey AS id, ' ' || lower(left(c_mktsegment, 1 + c_custkey % 6)) || CASE c_custkey % 4 WHEN 0 THEN '-b' WHEN 1 THEN '' WHEN 2 THEN '.x' ELSE '-bb' END AS raw FROM customer) SELECT id, CASE WHEN regexp_full_match(upper(trim(raw)), '[A-Z]{1,5}(-[A-Z])?') THEN replace(upper(trim(raw)), '-', '.') END AS symbol FROM c""")
def p7_symbols(spark, sf):
    k = F.col("c_custkey")
    raw = F.concat(F.lit(" "), F.lower(F.left("c_mktsegment", (1 + k % 6).cast("int"))), F.when(k % 4 == 0, "-b").when(k % 4 == 1, "").when(k % 4 == 2, ".x").otherwise("-bb"))
    return src.table(spark, sf, "customer").select(k.alias("id"), src.common_stock_symbol(raw).alias("symbol"))


@register("""WITH l AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, 'log' AS origin FROM orders WHERE o_orderkey % 3 != 0 GROUP BY 1), w AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, 'new' AS origin FROM orders WHERE o_orderkey % 3 != 1 GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, origin DESC) AS rn FROM (SELECT * FROM l UNION ALL SELECT * FROM w)) SELECT date, n, origin FROM b WHERE rn = 1""")
def k1_upsert_days(spark, sf):
    o = src.table(spark, sf, "orders")
    day = lambda cond, name: o.where(cond).groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count("*").alias("n")).withColumn("origin", F.lit(name))
    return ledger.upsert_days(day("o_orderkey % 3 != 0", "log"), day("o_orderkey % 3 != 1", "new"))


@register(f"{BARS}, w AS (SELECT n_name AS ticker FROM nation UNION SELECT r_name FROM region), h AS (SELECT DISTINCT ticker FROM b) SELECT count(*) AS n_wanted, count(h.ticker) AS n_covered, round(count(h.ticker) / count(*), 6) AS share FROM w LEFT JOIN h ON h.ticker = w.ticker")
def y3_coverage(spark, sf):
    wanted = src.table(spark, sf, "nation").select(F.col("n_name").alias("ticker")).union(src.table(spark, sf, "region").select("r_name"))
    return rounded(src.coverage(src.bars_daily(spark, sf), wanted))
