"""Queries over data checks, listings, outcomes, report figures and single formulas."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import formulas as fm
from ..operators import joins
from ..operators import reports as rep
from ..sources import tables as src
from .catalog import register, rounded
from .sql import BARS, FACTS, O


@register(f"""{BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM b), u AS (SELECT ticker, count(*) AS n, avg(volume) FILTER (WHERE k <= 20) AS mean_volume FROM k GROUP BY ticker)
SELECT ticker, n, round(mean_volume, 6) AS mean_volume, n >= 30 AND mean_volume >= 100 AS usable FROM u""")
def p1_usable_frames(spark, sf):
    return rounded(rep.usable(src.bars_daily(spark, sf), min_volume=100.0))


@register(f"""{BARS}, s AS (SELECT *, DATE '1996-07-01' AS day FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, date < day ORDER BY abs(date - day)) AS k FROM s),
m AS (SELECT ticker, day, avg(close) FILTER (WHERE date < day AND k <= 5) / avg(close) FILTER (WHERE date >= day AND k <= 5) AS implied, count(*) FILTER (WHERE date < day AND k <= 5) AS nb, count(*) FILTER (WHERE date >= day AND k <= 5) AS na FROM k GROUP BY 1, 2)
SELECT ticker, day, 2.0::DOUBLE AS ratio, CASE WHEN nb = 5 AND na = 5 THEN round(implied, 6) END AS implied, CASE WHEN nb = 5 AND na = 5 THEN abs(implied - 1) < 0.15 END AS adjusted FROM m""")
def p4_split_adjustment(spark, sf):
    bars = src.bars_daily(spark, sf)
    splits = bars.select("ticker").distinct().select("ticker", F.lit("1996-07-01").cast("date").alias("day"), F.lit(2.0).alias("ratio"))
    return rounded(rep.split_adjustment(bars, splits))


_RETURNS = f"r AS (SELECT ticker, date, close / lag(close) OVER ({O}) - 1 AS ret FROM b), x AS (SELECT *, avg(ret) OVER (PARTITION BY date) AS market FROM r WHERE ret IS NOT NULL)"


def _returns(spark, sf):
    bars = src.bars_daily(spark, sf)
    r = bars.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).where("ret IS NOT NULL")
    return r.select("ticker", "date", "ret").join(r.groupBy("date").agg(F.avg("ret").alias("market")), "date")


@register(f"""{BARS}, {_RETURNS}, q AS (SELECT ticker, count(*) AS n, covar_samp(ret, market) / (var_pop(market) + 1e-12) AS beta, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1, avg(ret) AS m, stddev_samp(ret) AS sd FROM x GROUP BY ticker HAVING count(*) >= 60),
t AS (SELECT x.ticker, avg(ret) * 100 AS cvar95 FROM x JOIN q ON q.ticker = x.ticker WHERE ret <= q5 GROUP BY x.ticker)
SELECT ticker, n, round(beta, 5) AS beta, round(q5 * 100, 5) AS var95, round(q1 * 100, 5) AS var99, round(cvar95, 5) AS cvar95, round(sd * sqrt(252) * 100, 5) AS vol, round((m - 0.045 / 252) / sd * sqrt(252), 5) AS sharpe FROM q JOIN t USING (ticker)""")
def a26_risk_metrics(spark, sf):
    return rounded(rep.risk_metrics(_returns(spark, sf)), 5)


@register(f"""{BARS}, k AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM b),
g AS (SELECT ticker, count(*) AS n, max(close) FILTER (WHERE k = 1) AS last, max(close) FILTER (WHERE k = 21) AS c21, max(close) FILTER (WHERE k = 63) AS c63, max(close) FILTER (WHERE k = 126) AS c126, avg(close) FILTER (WHERE k <= 50) AS mean FROM k GROUP BY ticker HAVING count(*) >= 21),
r AS (SELECT *, (last / c21 - 1) * 100 AS r21, (last / c63 - 1) * 100 AS r63, (last / c126 - 1) * 100 AS r126 FROM g)
SELECT ticker, round(last, 5) AS last, round(r21, 5) AS r21, round(r63, 5) AS r63, round(r126, 5) AS r126, n >= 50 AND last > mean AS above_mean,
round((coalesce(r21 * 0.5::DOUBLE, 0) + coalesce(r63 * 0.3::DOUBLE, 0) + coalesce(r126 * 0.2::DOUBLE, 0)) / (CASE WHEN r21 IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN r63 IS NULL THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN r126 IS NULL THEN 0 ELSE 0.2::DOUBLE END), 5) AS momentum FROM r""")
def w31_rotation(spark, sf):
    return rounded(rep.rotation(src.bars_daily(spark, sf)), 5)


@register(f"""{BARS}, s AS (SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS entry_date, arg_min(close, date) AS entry_price FROM b GROUP BY 1, 2), n AS (SELECT *, row_number() OVER ({O}) AS n FROM b),
e AS (SELECT s.ticker, entry_date, entry_price, (SELECT count(*) FROM n WHERE n.ticker = s.ticker AND n.date <= s.entry_date) + 21 AS n FROM s)
SELECT e.ticker, entry_date, round(entry_price, 5) AS entry_price, n.date AS outcome_date, round(n.close, 5) AS outcome_price, round((n.close / entry_price - 1) * 100, 5) AS return_pct FROM e LEFT JOIN n ON n.ticker = e.ticker AND n.n = e.n""")
def j12_signal_outcomes(spark, sf):
    bars = src.bars_daily(spark, sf)
    signals = bars.groupBy("ticker", F.to_date(F.date_trunc("month", "date")).alias("entry_date")).agg(F.min_by("close", "date").alias("entry_price"))
    return rounded(rep.signal_outcomes(signals, bars), 5)


_SNAPS = "sn AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS snapshot, 'T' || CAST(o_custkey % 40 AS VARCHAR) AS ticker, o_custkey % 80 AS cik FROM orders)"
_SPANS = f"WITH {_SNAPS}, sp AS (SELECT ticker, cik, min(snapshot) AS first_seen, max(snapshot) AS last_seen, count(*) AS snapshots, CAST(cik AS VARCHAR) || ':' || ticker AS listing_id FROM sn GROUP BY 1, 2)"


def _spans(spark, sf):
    o = src.table(spark, sf, "orders")
    snaps = o.select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("snapshot"), F.concat(F.lit("T"), (F.col("o_custkey") % 40).cast("string")).alias("ticker"), (F.col("o_custkey") % 80).alias("cik")).distinct()
    return rep.listing_spans(snaps)


@register(f"{_SPANS} SELECT * FROM sp")
def a2_listing_spans(spark, sf):
    return _spans(spark, sf)


@register(f"{_SPANS} SELECT (SELECT count(*) FROM sp) AS listings, (SELECT count(DISTINCT ticker) FROM sp) AS tickers, (SELECT count(*) FROM (SELECT ticker FROM sp GROUP BY ticker HAVING count(*) > 1)) AS recycled")
def a2_listing_report(spark, sf):
    by = _spans(spark, sf).groupBy("ticker").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("listings"), F.count("*").alias("tickers"), F.count_if(F.col("n") > 1).alias("recycled"))


@register(f"""{_SPANS}, w AS (SELECT *, lead(first_seen) OVER y AS nx, lag(last_seen) OVER y AS pv FROM sp WINDOW y AS (PARTITION BY ticker ORDER BY first_seen, cik))
SELECT ticker, cik, first_seen, last_seen, snapshots, listing_id, CAST(last_seen + CAST(floor((nx - last_seen) / 2.0) AS INT) AS DATE) AS window_end, CAST(pv + CAST(floor((first_seen - pv) / 2.0) AS INT) + 1 AS DATE) AS window_start FROM w""")
def j7_listing_windows(spark, sf):
    return joins.listing_windows(_spans(spark, sf))


@register("""WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS year, o_custkey AS asset FROM orders), l AS (SELECT o_custkey AS asset, CAST(max(o_orderdate) AS DATE) AS last_bar FROM orders GROUP BY 1), e AS (SELECT max(last_bar) AS e FROM l)
SELECT year, count(*) FILTER (WHERE last_bar <= make_date(year + 1, 12, 31)) AS delisted FROM m JOIN l USING (asset), e WHERE make_date(year + 1, 12, 31) <= e GROUP BY year""")
def a3_delistings(spark, sf):
    o = src.table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("asset"), F.to_date("o_orderdate").alias("d"))
    return rep.delistings_by_year(o, o.groupBy("asset").agg(F.max("d").alias("last_bar")))


@register("""WITH p AS (SELECT event_type AS kind, CAST(ts AS DATE) AS date, avg(value) FILTER (WHERE user_id % 2 = 0) AS a, avg(value) FILTER (WHERE user_id % 2 = 1) AS b FROM events GROUP BY 1, 2), d AS (SELECT *, b - a AS d FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
g AS (SELECT kind, count(*) AS n, avg(a) AS mean_a, avg(b) AS mean_b, avg(d) AS diff, stddev_samp(d) / sqrt(count(*)) AS se, stddev_samp(a) / sqrt(count(*)) AS se_a, stddev_samp(b) / sqrt(count(*)) AS se_b, count(*) FILTER (d > 0) / count(*) * 100 AS wins FROM d GROUP BY kind)
SELECT kind, n, round(mean_a, 5) AS mean_a, round(mean_b, 5) AS mean_b, round(diff, 5) AS diff, round(se, 5) AS se, round(se_a, 5) AS se_a, round(se_b, 5) AS se_b, round(wins, 5) AS wins_pct, round(t, 5) AS t, CASE WHEN n < 2 THEN 'too few' WHEN t >= 2 THEN 'better' WHEN t <= -2 THEN 'worse' ELSE 'noise' END AS verdict FROM (SELECT *, CASE WHEN se > 0 THEN diff / se WHEN n >= 2 THEN sign(diff) * 999 END AS t FROM g)""")
def a7_paired_difference(spark, sf):
    e = src.table(spark, sf, "events")
    half = lambda k: F.avg(F.when(F.col("user_id") % 2 == k, F.col("value")))
    return rounded(rep.paired_difference(e.groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("date")).agg(half(0).alias("a"), half(1).alias("b")), "a", "b", ["kind"]), 5)


@register(f"""{BARS}, c AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY date ORDER BY close DESC, ticker) AS rank, count(*) OVER (PARTITION BY date) AS n FROM b)
SELECT ticker, date, CAST(rank AS INT) AS rank, 'buy' AS side FROM c WHERE rank <= 3 UNION ALL SELECT ticker, date, CAST(rank AS INT), 'sell' FROM c WHERE rank > n - greatest(n // 3, 1)""")
def t3_candidates(spark, sf):
    return rep.candidates(src.bars_daily(spark, sf).select("ticker", "date", "close"), "close", ["date"], 3).select("ticker", "date", "rank", "side")


@register("""WITH s AS (SELECT user_id % 20 AS horizon, event_type, count(*) AS n FROM events GROUP BY 1, 2), l AS (SELECT user_id % 20 AS horizon, count(*) AS n FROM events WHERE event_id % 5 = 0 AND user_id % 20 != 3 GROUP BY 1), a AS (SELECT horizon, max(n) AS n FROM s GROUP BY 1)
SELECT a.horizon, a.n, l.n AS last_n FROM a LEFT JOIN l USING (horizon) WHERE l.n IS NULL OR a.n >= l.n * 1.05::DOUBLE""")
def f29_publishable(spark, sf):
    e = src.table(spark, sf, "events").withColumn("horizon", F.col("user_id") % 20)
    log = e.where("event_id % 5 = 0 AND horizon != 3").groupBy("horizon").agg(F.count("*").alias("n"))
    return rep.publishable(e.groupBy("horizon", "event_type").agg(F.count("*").alias("n")), log)


@register("""SELECT event_type AS slug, min(CAST(ts AS DATE)) AS first_seen, max(CAST(ts AS DATE)) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT user_id) AS tickers FROM events WHERE value IS NOT NULL GROUP BY 1""")
def a37_first_seen(spark, sf):
    e = src.table(spark, sf, "events").select(F.col("event_type").alias("slug"), F.to_date("ts").alias("date"), F.col("user_id").alias("ticker"), F.col("value").alias("score"))
    return rep.coverage_by_analyst(e)


@register("""WITH m AS (SELECT o_orderpriority AS series, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice::DECIMAL(18, 2))::DOUBLE AS value FROM orders GROUP BY 1, 2), y AS (SELECT *, lag(value, 12) OVER (PARTITION BY series ORDER BY month) AS old FROM m)
SELECT series, month, round((value - old) / abs(old) * 100, 6) AS yoy FROM y""")
def w50_year_on_year(spark, sf):
    m = src.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("value"))
    return rounded(rep.year_on_year(m, ["series"], "month", "value").select("series", "month", "yoy"))


@register(f"""{FACTS}, g AS (SELECT ticker, "end", net_income / shares AS eps, greatest(-5.0::DOUBLE, least(30.0::DOUBLE, coalesce((revenue / lag(revenue) OVER (PARTITION BY ticker ORDER BY "end") - 1) * 100, 7.0::DOUBLE))) AS g FROM f)
SELECT ticker, "end", CASE WHEN eps > 0 THEN round(eps * (8.5 + g * 2) * (4.4 / 4.5), 4) END AS intrinsic, CASE WHEN eps > 0 THEN round(eps * (8.5 + g) * (4.4 / 4.5), 4) END AS conservative FROM g""")
def f14_graham(spark, sf):
    f = src.facts_quarterly(spark, sf)
    growth = (F.col("revenue") / F.lag("revenue").over(Window.partitionBy("ticker").orderBy("end")) - 1) * 100
    own = f.select("ticker", "end", (F.col("net_income") / F.col("shares")).alias("eps"), growth.alias("g"))
    value = lambda low: rep.graham(F.col("eps"), F.col("g"), F.lit(4.5), low)
    return rounded(own.select("ticker", "end", value(False).alias("intrinsic"), value(True).alias("conservative")), 4)


@register("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = 5")
def u3_having_all(spark, sf):
    return rep.having_all(src.table(spark, sf, "events"), ["user_id"], "event_type", 5)


@register("WITH l AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT CAST(ts AS DATE) AS date, event_id, event_type = (SELECT min(event_type) FROM events) AS live FROM events WHERE event_type = (SELECT min(event_type) FROM events) OR CAST(ts AS DATE) NOT IN (SELECT date FROM l)")
def j13_live_over_backfill(spark, sf):
    e = src.table(spark, sf, "events")
    first = e.agg(F.min("event_type").alias("_first"))  # one row
    own = e.join(F.broadcast(first)).select(F.to_date("ts").alias("date"), "event_id", (F.col("event_type") == F.col("_first")).alias("live"))
    return joins.live_over_backfill(own.where("live"), own.where("NOT live"))


@register("""WITH n AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT ticker, median(n) <= 1 AS daily FROM n GROUP BY 1""")
def p12_daily_frames(spark, sf):
    return rep.daily_frames(src.table(spark, sf, "events").withColumnRenamed("event_type", "ticker"))


@register(f"{BARS}, e AS (SELECT max(date) AS e FROM b), g AS (SELECT ticker, avg(volume) FILTER (WHERE date >= e - 30) AS mean_volume FROM b, e GROUP BY 1) SELECT ticker, round(mean_volume, 6) AS mean_volume, coalesce(mean_volume >= 100, true) AS keeps FROM g")
def y52_liquid(spark, sf):
    return rounded(rep.liquid(src.bars_daily(spark, sf), 30, 100.0))


@register(f"""{BARS}, r AS (SELECT date, ticker, close, (lead(close, 5) OVER ({O}) / close - 1) AS f FROM b), q AS (SELECT date, ntile(5) OVER (PARTITION BY date ORDER BY close, ticker) AS quintile, f FROM r WHERE f IS NOT NULL),
m AS (SELECT date, quintile, avg(f) / 20 AS ret FROM q GROUP BY 1, 2), l AS (SELECT date, 'long_short' AS leg, max(ret) FILTER (WHERE quintile = 5) - max(ret) FILTER (WHERE quintile = 1) AS ret FROM m GROUP BY 1),
e AS (SELECT date, 'Q' || CAST(quintile AS VARCHAR) AS leg, 1 + ret / 100 AS x FROM m UNION ALL SELECT date, leg, 1 + ret / 100 FROM l WHERE ret IS NOT NULL)
SELECT date, leg, CASE WHEN count(*) FILTER (x = 0) OVER w > 0 THEN 0 WHEN count(*) FILTER (x < 0) OVER w % 2 = 1 THEN -1 ELSE 1 END AS sign, round(sum(CASE WHEN x != 0 THEN ln(abs(x)) END) OVER w, 6) AS log_grown FROM e WINDOW w AS (PARTITION BY leg ORDER BY date)""")
def c7_quintile_curves(spark, sf):
    """All dates; the table's returns are so large that only the curve's logarithm and sign stay within doubles."""
    own = Window.partitionBy("ticker").orderBy("date")
    r = src.bars_daily(spark, sf).withColumn("f", F.lead("close", 5).over(own) / F.col("close") - 1).where("f IS NOT NULL")
    q = r.withColumn("quintile", F.ntile(5).over(Window.partitionBy("date").orderBy("close", "ticker")))
    return rounded(rep.quintile_curves(q.groupBy("date", "quintile").agg((F.avg("f") / 20).alias("ret"))).select("date", "leg", "sign", "log_grown"))


_OUTCOMES = "CASE o_orderkey % 5 WHEN 0 THEN 'nofill' WHEN 1 THEN 'cash_short' WHEN 2 THEN 'censored' ELSE 'filled' END"


@register(f"""WITH o AS (SELECT o_orderpriority AS line, {_OUTCOMES} AS outcome FROM orders), g AS (SELECT line, count(*) FILTER (WHERE outcome != 'censored') AS n, count(*) FILTER (WHERE outcome = 'nofill') AS nofill, count(*) FILTER (WHERE outcome = 'cash_short') AS cash_short, count(*) FILTER (WHERE outcome = 'censored') AS censored FROM o GROUP BY 1)
SELECT *, round(nofill / n * 100, 6) AS rate FROM g""")
def a17_discard_rate(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("line"), F.expr(_OUTCOMES).alias("outcome"))
    return rounded(rep.discard_rate(o, ["line"]))


@register("WITH t AS (SELECT event_type AS line, (value - 50) / 10 AS r, 0.001 * (1 + user_id % 5) AS c FROM events WHERE value IS NOT NULL) SELECT line, round(avg(r - c * 6), 6) AS net, round(avg(r) / avg(c), 4) AS breakeven_bp FROM t GROUP BY 1")
def a19_net_expectancy(spark, sf):
    e = src.table(spark, sf, "events").where("value IS NOT NULL")
    t = e.select(F.col("event_type").alias("line"), ((F.col("value") - 50) / 10).alias("r"), (F.lit(0.001) * (1 + F.col("user_id") % 5)).alias("r_cost_per_bp"))
    return rounded(rep.net_expectancy(t, ["line"], 6.0), breakeven_bp=4)


@register(f"{BARS}, l AS (SELECT ticker, date, (lead(close, 20) OVER ({O}) / close - 1) * 100 AS f FROM b) SELECT ticker, date, CASE WHEN f IS NOT NULL THEN (f > 1)::INT::DOUBLE END AS label FROM l")
def i10_labels(spark, sf):
    return rep.labels(src.bars_daily(spark, sf), 20, 1.0).select("ticker", "date", "label")


@register(f"""{BARS}, m AS (SELECT date, sum(close) AS close FROM b GROUP BY date), k AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY ticker) AS n FROM b), mk AS (SELECT close, row_number() OVER (ORDER BY date DESC) AS k FROM m),
s AS (SELECT ticker, span, least(span, least(max(n), 126) - 1) AS back FROM k, (VALUES (21), (63), (126)) v(span) GROUP BY ticker, span),
r AS (SELECT s.ticker, span, (a.close / z.close - 1) * 100 AS ret, (SELECT max(close) FILTER (WHERE k = 1) / max(close) FILTER (WHERE k = span) - 1 FROM mk) * 100 AS market_ret FROM s JOIN k a ON a.ticker = s.ticker AND a.k = 1 JOIN k z ON z.ticker = s.ticker AND z.k = back)
SELECT ticker, span, round(ret, 5) AS ret, round(market_ret, 5) AS market_ret, round(ret - market_ret, 5) AS strength FROM r""")
def w32_relative_strength(spark, sf):
    bars = src.bars_daily(spark, sf)
    return rounded(rep.relative_strength(bars, bars.groupBy("date").agg(F.sum("close").alias("close"))), 5)


def _band(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} > 30 THEN 90 WHEN {c} > 15 THEN 75 WHEN {c} > 5 THEN 65 WHEN {c} > 0 THEN 55 WHEN {c} > -10 THEN 40 WHEN {c} > -20 THEN 25 ELSE 10 END"


@register(f"""{BARS}, k AS (SELECT ticker, close, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM b), g AS (SELECT ticker, {', '.join(f'(max(close) FILTER (WHERE k = 1) / max(close) FILTER (WHERE k = {n}) - 1) * 100 AS m{n}' for n in (21, 63, 126, 252))} FROM k GROUP BY ticker)
SELECT ticker, {', '.join(f'round(m{n}, 5) AS m{n}' for n in (21, 63, 126, 252))}, round(coalesce(list_avg(list_filter([{_band('m63')}, {_band('m126')}, {_band('m252')}], lambda x: x IS NOT NULL)), 50), 5) AS score FROM g""")
def w29_momentum_table(spark, sf):
    return rounded(rep.momentum_table(src.bars_daily(spark, sf)), 5)


@register(f"""{BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM b), g AS (SELECT ticker, count(*) AS n, max(close) FILTER (WHERE k = 1) AS a, max(close) FILTER (WHERE k = 2) AS z, string_agg(CAST(CAST(round(close * 100, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY date) FILTER (WHERE k <= 22) AS cents FROM k GROUP BY ticker)
SELECT ticker, round(a, 5) AS last, round((a - z) / z * 100, 5) AS change_pct, cents FROM g WHERE n > 1""")
def y40_board(spark, sf):
    cents = F.array_join(F.transform("closes", lambda x: fm.rnd(x * 100, 0).cast("long").cast("string")), ",")
    return rounded(rep.board(src.bars_daily(spark, sf)).withColumn("cents", cents).drop("closes"), 5)


@register(f"{BARS}, u AS (SELECT n_name AS ticker FROM nation UNION ALL SELECT n_name FROM nation WHERE n_nationkey % 4 = 0 UNION ALL SELECT r_name || '_X' FROM region), g AS (SELECT ticker, count(*) > 1 AS duplicate, ticker NOT IN (SELECT ticker FROM b) AS dead FROM u GROUP BY 1) SELECT * FROM g WHERE duplicate OR dead")
def y12_audit(spark, sf):
    n = src.table(spark, sf, "nation")
    names = n.select(F.col("n_name").alias("ticker")).union(n.where("n_nationkey % 4 = 0").select("n_name")).union(src.table(spark, sf, "region").select(F.concat("r_name", F.lit("_X"))))
    return rep.audit(names, src.bars_daily(spark, sf))


@register("WITH k AS (SELECT CAST(ts AS DATE) AS date, user_id % 10 AS ticker, count(DISTINCT CASE WHEN value IS NOT NULL THEN event_type END) AS k FROM events GROUP BY 1, 2) SELECT date, count(*) AS tickers, count(*) FILTER (WHERE k < 3) AS dropped FROM k GROUP BY 1")
def a35_day_gaps(spark, sf):
    e = src.table(spark, sf, "events").select(F.to_date("ts").alias("date"), (F.col("user_id") % 10).alias("ticker"), F.col("event_type").alias("slug"), F.col("value").alias("score"))
    return rep.day_gaps(e, 3)
