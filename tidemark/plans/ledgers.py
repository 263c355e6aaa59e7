"""Queries over accounts, orders, notes and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.formulas import rnd

from ..operators import cross_section as xs
from ..operators import joins, ledger, text
from ..sources import tables as src
from .catalog import register, rounded
from .sql import BARS

_SIDES = "t AS (SELECT o_custkey AS account, o_orderpriority AS symbol, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, 1 + o_orderkey % 7 AS qty FROM orders)"


def _trades(spark, sf):
    return src.table(spark, sf, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), (1 + F.col("o_orderkey") % 7).alias("qty"))


@register(f"WITH {_SIDES} SELECT account, symbol, sum(CASE side WHEN 'buy' THEN qty WHEN 'sell' THEN -qty ELSE 0 END)::BIGINT AS net FROM t GROUP BY 1, 2")
def a28_net_shares(spark, sf):
    return ledger.net_shares(_trades(spark, sf))


@register(f"""WITH {_SIDES}, n AS (SELECT account, symbol, sum(CASE side WHEN 'buy' THEN qty ELSE -qty END) AS net FROM t GROUP BY 1, 2), p AS (SELECT account, symbol, net + CASE WHEN account % 10 = 0 THEN 1 ELSE 0 END AS held, CASE WHEN account % 25 = 0 THEN 0.0 ELSE 10.0 END AS px FROM n WHERE account % 11 != 0),
j AS (SELECT coalesce(n.account, p.account) AS account, coalesce(n.symbol, p.symbol) AS symbol, net, held, px FROM n FULL JOIN p ON n.account = p.account AND n.symbol = p.symbol)
SELECT account, symbol, 'share_mismatch' AS rule FROM j WHERE coalesce(net, 0) != coalesce(held, 0) UNION ALL SELECT account, symbol, 'under_one_share' FROM j WHERE held < 1 UNION ALL SELECT account, symbol, 'no_price' FROM j WHERE held IS NOT NULL AND px <= 0""")
def a28_position_check(spark, sf):
    t = _trades(spark, sf)
    p = ledger.net_shares(t).where("account % 11 != 0").select("account", "symbol", (F.col("net") + F.when(F.col("account") % 10 == 0, 1).otherwise(0)).alias("qty"), F.when(F.col("account") % 25 == 0, 0.0).otherwise(10.0).alias("avg_price"))
    return ledger.position_check(t, p)


@register("""WITH s AS (SELECT c_mktsegment AS account, n_name AS sector, sum(abs(c_acctbal)) AS w FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), w AS (SELECT account, sector, round(w / sum(w) OVER (PARTITION BY account), 8) AS w FROM s)
SELECT account, round(sum(w * w), 6) AS hhi, arg_max(sector, w) AS top_sector, round(max(w), 6) AS top_weight FROM w GROUP BY account""")
def a22_concentration(spark, sf):
    c = src.table(spark, sf, "customer").join(F.broadcast(src.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.groupBy(F.col("c_mktsegment").alias("account"), F.col("n_name").alias("sector")).agg(F.sum(F.abs("c_acctbal")).alias("w"))
    w = s.select("account", "sector", rnd(F.col("w") / F.sum("w").over(Window.partitionBy("account")), 8).alias("weight"))
    return rounded(ledger.concentration(w))


_SIGNALS = """s AS (SELECT event_type AS kind, event_id % 100 * 1.0 AS score, CASE WHEN event_id % 9 != 0 THEN round(value - 50, 4) END AS return_pct FROM events)"""


def _signals(spark, sf):
    e = src.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("kind"), (F.col("event_id") % 100).cast("double").alias("score"), F.when(F.col("event_id") % 9 != 0, rnd(F.col("value") - 50, 4)).alias("return_pct"))


@register(f"""WITH {_SIGNALS} SELECT kind, count(*) AS n, round(count(*) FILTER (WHERE return_pct > 0) / count(*), 6) AS hit_rate, round(avg(return_pct), 6) AS expectancy, round(avg(return_pct) FILTER (WHERE return_pct > 0), 6) AS avg_win, round(avg(return_pct) FILTER (WHERE return_pct <= 0), 6) AS avg_loss,
round(CASE WHEN coalesce(sum(return_pct) FILTER (WHERE return_pct <= 0), 0) = 0 THEN 'inf'::DOUBLE ELSE coalesce(sum(return_pct) FILTER (WHERE return_pct > 0), 0) / -sum(return_pct) FILTER (WHERE return_pct <= 0) END, 6) AS profit_factor, round(avg(return_pct) / stddev_samp(return_pct) * sqrt(count(*)), 5) AS t FROM s WHERE return_pct IS NOT NULL GROUP BY kind""")
def a12_signal_summary(spark, sf):
    return rounded(ledger.signal_summary(_signals(spark, sf), ["kind"]), t=5)


@register(f"""WITH {_SIGNALS}, d(low, high) AS (VALUES (0.0::DOUBLE, 60.0::DOUBLE), (60.0, 70.0), (70.0, 80.0), (80.0, 101.0)) SELECT low, high, count(return_pct) AS n, round(avg(return_pct), 6) AS mean, round(avg(CASE WHEN return_pct > 0 THEN 1.0 WHEN return_pct <= 0 THEN 0.0 END), 6) AS hit_rate
FROM d LEFT JOIN s ON score >= low AND score < high AND return_pct IS NOT NULL GROUP BY 1, 2""")
def a13_score_buckets(spark, sf):
    return rounded(ledger.score_buckets(_signals(spark, sf)))


_LEGS = """WITH f AS (SELECT CASE user_id % 3 WHEN 0 THEN 'entry' WHEN 1 THEN 'stop_exit' ELSE 'market_exit' END AS leg, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, 100.0 AS ref, 100 + value / 1000 AS fill FROM events),
b AS (SELECT leg, CASE WHEN side = 'buy' THEN fill / ref - 1 ELSE 1 - fill / ref END * 1e4 AS bp FROM f WHERE fill IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY leg ORDER BY bp) AS k, count(*) OVER (PARTITION BY leg) AS n FROM b)"""


def _legs(spark, sf):
    e = src.table(spark, sf, "events")
    leg = F.when(F.col("user_id") % 3 == 0, "entry").when(F.col("user_id") % 3 == 1, "stop_exit").otherwise("market_exit")
    f = e.select(leg.alias("leg"), F.when(F.col("event_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.lit(100.0).alias("ref"), (100 + F.col("value") / 1000).alias("fill"))
    return ledger.slippage(f, ["leg"])


@register(f"""{_LEGS} SELECT leg, count(*) AS n, round(median(bp), 5) AS median_bp, round(avg(bp), 5) AS mean_bp, round(max(bp) FILTER (k = greatest(1, floor(n * 0.9))), 5) AS p90_bp, round(max(bp), 5) AS max_bp FROM o GROUP BY leg""")
def a18_slippage(spark, sf):
    return rounded(_legs(spark, sf), 5)


@register(f"""{_LEGS}, m AS (SELECT leg, median(bp) AS m FROM o GROUP BY leg) SELECT m.leg AS exit_leg, round(m.m + e.m, 5) AS bp, round((m.m + e.m) / 1e4 / 0.003, 5) AS r FROM m JOIN m e ON e.leg = 'entry' WHERE m.leg != 'entry'""")
def a18_round_trips(spark, sf):
    return rounded(ledger.round_trips(_legs(spark, sf)), 5)


@register("""WITH v AS (SELECT CAST(ts AS DATE) AS date, event_id % 101 * 1.0 AS score, value - 50 AS ret FROM events WHERE value IS NOT NULL), d AS (SELECT date, count(*) FILTER (WHERE (score >= 65 AND ret > 0) OR (score <= 40 AND ret < 0)) AS h, count(*) FILTER (WHERE score >= 65 OR score <= 40) AS n,
 count(*) FILTER (WHERE score >= 65) AS b, count(*) FILTER (WHERE score <= 40) AS s, count(*) FILTER (WHERE score > 40 AND score < 65) AS z FROM v GROUP BY date),
t AS (SELECT sum(h) AS hits, sum(n) AS n, sum(b) AS buy_n, sum(s) AS sell_n, sum(z) AS neutral_n, count(*) FILTER (WHERE n > 0) AS dn FROM d), q AS (SELECT sum(power(h - t.hits / t.n * d.n, 2)) AS ss FROM d, t WHERE d.n > 0)
SELECT hits::BIGINT AS hits, n::BIGINT AS n, buy_n::BIGINT AS buy_n, sell_n::BIGINT AS sell_n, neutral_n::BIGINT AS neutral_n, round(hits / n * 100, 1) AS hit_rate, round(1.96 * sqrt(ss / (n * n) * dn / (dn - 1)) * 100, 1) AS ci95 FROM t, q""")
def a11_hit_rate(spark, sf):
    e = src.table(spark, sf, "events").where("value IS NOT NULL")
    return xs.hit_rate(e.select(F.to_date("ts").alias("date"), (F.col("event_id") % 101).cast("double").alias("score"), (F.col("value") - 50).alias("ret")))


@register("""WITH r AS (SELECT event_type AS slug, CAST(ts AS DATE) AS date, user_id, event_id % 101 * 1.0 AS score, 1.0 + user_id % 3 AS weight FROM events), g AS (SELECT date, sum(score * weight) / sum(weight) AS score, count(*) FILTER (WHERE score >= 65) AS buys, count(*) FILTER (WHERE score <= 40) AS sells, count(*) AS n FROM r GROUP BY date)
SELECT date, round(score, 6) AS score, buys, sells, n, CASE WHEN buys >= 0.6 * n THEN 'buy' WHEN sells >= 0.6 * n THEN 'sell' ELSE 'neutral' END AS majority, round(greatest(buys, sells, n - buys - sells) / n, 6) AS agreement FROM g""")
def a38_consolidate(spark, sf):
    e = src.table(spark, sf, "events")
    return rounded(xs.consolidate(e.select(F.to_date("ts").alias("date"), (F.col("event_id") % 101).cast("double").alias("score"), (1.0 + F.col("user_id") % 3).alias("weight")), ["date"]))


@register("""WITH s AS (SELECT CAST(ts AS DATE) AS date, user_id % 50 AS ticker, event_type AS slug, avg(value) AS score FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT date, ticker, avg(score) AS score, count(DISTINCT slug) AS k FROM s WHERE slug IN (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2) GROUP BY 1, 2)
SELECT date, CAST(ticker AS VARCHAR) AS ticker, round(score, 6) AS score FROM c WHERE k = 2""")
def a39_combine_required(spark, sf):
    e = src.table(spark, sf, "events").where("value IS NOT NULL")
    slugs = [r[0] for r in src.table(spark, sf, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]  # the feature: two kinds by name
    s = e.groupBy(F.to_date("ts").alias("date"), (F.col("user_id") % 50).cast("string").alias("ticker"), F.col("event_type").alias("slug")).agg(F.avg("value").alias("score"))
    return rounded(xs.combine_required(s, slugs))


@register("""WITH i AS (SELECT c_name AS symbol, c_custkey % 10 * 1.0 AS qty FROM customer WHERE c_custkey % 5 != 0), h AS (SELECT c_name AS symbol, c_custkey % 10 + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END * 1.0 AS qty FROM customer WHERE c_custkey % 7 != 0)
SELECT coalesce(i.symbol, h.symbol) AS symbol, i.qty::DOUBLE AS intended, h.qty::DOUBLE AS held, CASE WHEN h.qty IS NULL THEN 'missing' WHEN i.qty IS NULL THEN 'extra' WHEN abs(i.qty - h.qty) <= 0.001 THEN 'matched' ELSE 'mismatch' END AS status FROM i FULL JOIN h ON i.symbol = h.symbol""")
def j14_reconcile(spark, sf):
    c = src.table(spark, sf, "customer")
    q = (F.col("c_custkey") % 10).cast("double")
    i = c.where("c_custkey % 5 != 0").select(F.col("c_name").alias("symbol"), q.alias("qty"))
    h = c.where("c_custkey % 7 != 0").select(F.col("c_name").alias("symbol"), (q + F.when(F.col("c_custkey") % 4 == 0, 1).otherwise(0)).alias("qty"))
    return joins.reconcile(i, h)


@register(f"""{BARS}, l AS (SELECT ticker, arg_max(close, date) AS price FROM b GROUP BY ticker), p AS (SELECT c_custkey AS account, n_name AS ticker, 1 + c_custkey % 9 AS qty FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT account, ticker, qty, price, round(qty * price * 1300.0, 4) AS value FROM p LEFT JOIN l USING (ticker)""")
def j19_valued(spark, sf):
    p = src.table(spark, sf, "customer").join(F.broadcast(src.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("account"), F.col("n_name").alias("ticker"), (1 + F.col("c_custkey") % 9).alias("qty"))
    return rounded(joins.valued(p, src.bars_daily(spark, sf), 1300.0), value=4)


@register("""WITH l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) SELECT user_id, event_id FROM l WHERE rn <= 5""")
def k5_latest_rows(spark, sf):
    return ledger.latest_rows(src.table(spark, sf, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 5).select("user_id", "event_id")


@register("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderkey % 3 != 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def k6_insert_absent(spark, sf):
    o = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return ledger.insert_absent(o.where("id % 3 != 0"), o.where("id % 2 = 0").withColumn("price", F.lit(-1.0)), "id")


@register("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), k AS (SELECT *, min(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS f FROM c WHERE rn <= 4) SELECT conv_id, turn, role, text FROM k WHERE turn >= f""")
def t10_history(spark, sf):
    return text.history(src.table(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn", "role", "text")


@register("SELECT doc_id, CASE WHEN regexp_extract(text, '(?m)^# (.*)$', 1) != '' THEN regexp_extract(text, '(?m)^# (.*)$', 1) ELSE string_split(text, chr(10))[1] END AS title FROM documents")
def g2_titles(spark, sf):
    return src.table(spark, sf, "documents").select("doc_id", text.title_of(F.col("text")).alias("title"))


_SEARCH = "apache license the"


def _search_sql() -> str:
    terms = _SEARCH.split()
    n = [f"((length(x) - length(replace(x, '{t}', ''))) // {len(t)})" for t in terms]
    return f"""WITH d AS (SELECT doc_id, lower(text) AS x, lower(string_split(text, chr(10))[1]) AS y FROM documents),
m AS (SELECT doc_id, {' + '.join(f"CAST({c} > 0 OR contains(y, '{t}') AS INT)" for c, t in zip(n, terms, strict=True))} AS matched, {' + '.join(f"CAST(contains(y, '{t}') AS INT)" for t in terms)} AS titled, {' + '.join(n)} AS occ FROM d)
SELECT doc_id, matched, CAST(matched * 100 + titled * 10 + least(occ, 20) AS INT) AS score FROM m WHERE matched > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@register(_search_sql())
def g1_search(spark, sf):
    notes = src.table(spark, sf, "documents").select("doc_id", "text", F.split("text", "\n", 2)[0].alias("title"))
    return text.search(notes, _SEARCH, 20, key="doc_id").select("doc_id", "matched", F.col("score").cast("int").alias("score"))


@register("""WITH e AS (SELECT user_id AS account, CAST(ts AS DATE) AS date, sum(value) + 1000 AS equity FROM events WHERE value IS NOT NULL GROUP BY 1, 2), p AS (SELECT account, date, CASE WHEN lag(equity) OVER w > 0 THEN equity / lag(equity) OVER w - 1 END AS ret FROM e WINDOW w AS (PARTITION BY account ORDER BY date)) SELECT account, date, round(ret, 8) AS ret FROM p""")
def w40_equity_returns(spark, sf):
    e = src.table(spark, sf, "events").where("value IS NOT NULL").groupBy(F.col("user_id").alias("account"), F.to_date("ts").alias("date")).agg((F.sum("value") + 1000).alias("equity")).withColumn("deposited", F.lit(0.0))
    return rounded(ledger.equity_returns(e).select("account", "date", "ret"), 8)
