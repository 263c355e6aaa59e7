"""Queries over bars: indicators, price structure, cross-sections, portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.formulas import rnd

from ..operators import cross_section as xs
from ..operators import indicators as ind
from ..operators import joins, simulate
from ..sources import tables as src
from .catalog import register, rounded
from .sql import BARS, MINUTES, WEEKLY, O, full, rows

KEYS = ("ticker", "date")


@register(f"{BARS} SELECT * FROM b")
def bars_daily(spark, sf):
    return src.bars_daily(spark, sf)


@register(f"{WEEKLY} SELECT * FROM b")
def bars_weekly(spark, sf):
    return src.bars_weekly(spark, sf)


@register(f"{MINUTES} SELECT * FROM b")
def s7_bars_15m(spark, sf):
    return src.bars_15m(spark, sf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register(f"{BARS} SELECT ticker, date, round(coalesce((lag(close, 20) OVER ({O}) / lag(close, 251) OVER ({O}) - 1) * 100, 0.0), 6) AS momentum FROM b")
def w1_momentum(spark, sf):
    return rounded(ind.momentum(src.bars_daily(spark, sf)).select(*KEYS, "momentum"))


@register(f"{BARS}, r AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS r FROM b) SELECT ticker, date, round(stddev_samp(r) OVER {rows(252)} * sqrt(252) * 100, 6) AS vol FROM r")
def w2_volatility(spark, sf):
    return rounded(ind.volatility(src.bars_daily(spark, sf)).select(*KEYS, "vol"))


@register(f"""{BARS}, m AS (SELECT ticker, date, {full(20, 'avg(close)')} AS mid, {full(20, 'stddev_samp(close)')} AS sd FROM b)
SELECT ticker, date, round(mid, 3) AS mid, round(mid + 2 * sd, 3) AS upper, round(mid - 2 * sd, 3) AS lower FROM m""")
def w5_bollinger(spark, sf):
    return rounded(ind.bollinger(src.bars_daily(spark, sf)).select(*KEYS, "mid", "upper", "lower"), 3)


@register(f"""{BARS}, m AS (SELECT *, {full(20, 'avg(close)')} AS mid, {full(20, 'stddev_pop(close)')} AS sd FROM b),
f AS (SELECT *, CASE WHEN sd > 0 THEN (close - (mid - 2 * sd)) / (4 * sd) END AS pct_b, CASE WHEN mid != 0 THEN 4 * sd / mid END AS bandwidth FROM m),
g AS (SELECT *, count(bandwidth) OVER {rows(120)} AS n, quantile_cont(bandwidth, 0.1) OVER {rows(120)} AS q, sum(CAST(pct_b > 1 AS INT)) OVER {rows(2)} AS up, sum(CAST(pct_b < 0 AS INT)) OVER {rows(2)} AS down FROM f)
SELECT ticker, date, round(pct_b, 5) AS pct_b, round(bandwidth, 5) AS bandwidth, coalesce(n >= 20 AND bandwidth <= q + 1e-12, false) AS squeeze, coalesce(up = 2, false) AS walk_up, coalesce(down = 2, false) AS walk_down FROM g""")
def w6_bollinger_features(spark, sf):
    return rounded(ind.bollinger_features(src.bars_daily(spark, sf)).select(*KEYS, "pct_b", "bandwidth", "squeeze", "walk_up", "walk_down"), 5)


@register(f"""{BARS}, k AS (SELECT *, {full(14, 'min(low)')} AS lo, {full(14, 'max(high)')} AS hi FROM b), r AS (SELECT *, CASE WHEN hi != lo THEN (close - lo) / (hi - lo) * 100 END AS raw FROM k),
s AS (SELECT *, CASE WHEN count(raw) OVER {rows(3)} >= 3 THEN avg(raw) OVER {rows(3)} END AS sk FROM r)
SELECT ticker, date, round(sk, 5) AS slow_k, round(CASE WHEN count(sk) OVER {rows(3)} >= 3 THEN avg(sk) OVER {rows(3)} END, 5) AS slow_d FROM s""")
def w7_stochastic(spark, sf):
    return rounded(ind.stochastic(src.bars_daily(spark, sf)).select(*KEYS, "slow_k", "slow_d"), 5)


@register(f"{BARS}, s AS (SELECT *, coalesce(sign(close - lag(close) OVER ({O})), 0) * volume AS v FROM b) SELECT ticker, date, round(sum(v) OVER ({O} ROWS UNBOUNDED PRECEDING), 4) AS obv FROM s")
def w9_obv(spark, sf):
    return rounded(ind.obv(src.bars_daily(spark, sf)).select(*KEYS, "obv"), 4)


@register(f"""{BARS}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({O})), abs(low - lag(close) OVER ({O}))) AS tr FROM b),
m AS (SELECT *, {full(14, 'avg(tr)')} AS m FROM t) SELECT ticker, date, round(CASE WHEN m > 0 THEN m ELSE close * 0.005 END, 5) AS atr FROM m""")
def w10_atr(spark, sf):
    return rounded(ind.atr(src.bars_daily(spark, sf)).select(*KEYS, "atr"), 5)


@register(f"""{BARS}, m AS (SELECT *, {full(20, 'min(low)')} AS lo, {full(20, 'max(high)')} AS hi, {full(10, 'avg(volume)', 20)} AS v FROM b)
SELECT ticker, date, round(CASE WHEN hi != lo THEN (close - lo) / (hi - lo) END, 6) AS range_position, round(CASE WHEN v != 0 THEN volume / v END, 6) AS volume_ratio FROM m""")
def w11_range_volume(spark, sf):
    return rounded(ind.range_and_volume(src.bars_daily(spark, sf)).select(*KEYS, "range_position", "volume_ratio"))


_SWING = f"""s AS (SELECT *, row_number() OVER ({O}) - 1 AS pos, count(*) OVER p = 5 AND count(*) OVER n = 5 AND high > max(high) OVER p AND high > max(high) OVER n AS sh,
  count(*) OVER p = 5 AND count(*) OVER n = 5 AND low < min(low) OVER p AND low < min(low) OVER n AS sl
  FROM b WINDOW p AS ({O} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), n AS ({O} ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"""


@register(f"{BARS}, {_SWING} SELECT ticker, date, coalesce(sh, false) AS swing_high, coalesce(sl, false) AS swing_low FROM s")
def w13_swings(spark, sf):
    return ind.swings(src.bars_daily(spark, sf)).select(*KEYS, "swing_high", "swing_low")


_TAIL = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM b) WHERE rn <= {n})"


@register(f"""{BARS}, {_TAIL.format(n=100)}, g AS (SELECT *, lag(high, 2) OVER ({O}) AS h2, lag(low, 2) OVER ({O}) AS l2, lag(date) OVER ({O}) AS md,
  last_value(close) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now, min(low) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS la,
  max(high) OVER ({O} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ha FROM t),
u AS (SELECT ticker, md AS date, 'bull' AS kind, low AS top, h2 AS bottom, la <= h2 AS filled, now FROM g WHERE h2 < low
  UNION ALL SELECT ticker, md, 'bear', l2, high, ha >= l2, now FROM g WHERE l2 > high AND NOT (h2 < low))
SELECT ticker, date, kind, top, bottom, filled, round((top - bottom) / now * 100, 2) AS gap_pct FROM u WHERE (top - bottom) / now * 100 >= 0.05""")
def w14_fair_value_gaps(spark, sf):
    return ind.fair_value_gaps(src.bars_daily(spark, sf))


@register(f"""{BARS}, {_TAIL.format(n=100)}, g AS (SELECT *, (lead(close) OVER ({O}) / close - 1) * 100 AS move, min(low) OVER f AS la, max(high) OVER f AS ha, lag(date) OVER ({O}) AS bd
  FROM t WINDOW f AS ({O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
SELECT ticker, date, CASE WHEN close < open THEN 'bull' ELSE 'bear' END AS kind, high AS top, low AS bottom, CASE WHEN close < open THEN la <= low ELSE ha >= high END AS mitigated
FROM g WHERE bd IS NOT NULL AND ((close < open AND move >= 1) OR (close > open AND move <= -1))""")
def w15_order_blocks(spark, sf):
    return ind.order_blocks(src.bars_daily(spark, sf))


@register(f"""{BARS}, {_SWING}, w AS (SELECT ticker, pos, 'H' AS side, high AS price FROM s WHERE sh UNION ALL SELECT ticker, pos, 'L', low FROM s WHERE sl),
p AS (SELECT ticker, pos AS at, side AS now, lag(side) OVER q AS was, lag(price) OVER q AS price, row_number() OVER q AS pair FROM w WINDOW q AS (PARTITION BY ticker ORDER BY pos, side)),
h AS (SELECT p.ticker, pair, was, now, p.price, min(s.pos) AS pos FROM p JOIN s ON p.ticker = s.ticker AND s.pos > p.at AND ((was = 'H' AND s.close > p.price) OR (was = 'L' AND s.close < p.price)) GROUP BY ALL)
SELECT h.ticker, (CASE WHEN was != now THEN 'BOS' ELSE 'CHoCH' END) || (CASE WHEN was = 'H' THEN '_bull' ELSE '_bear' END) AS label, h.price, s.date, h.pos FROM h JOIN s ON s.ticker = h.ticker AND s.pos = h.pos""")
def w16_structure_breaks(spark, sf):
    return ind.structure_breaks(src.bars_daily(spark, sf))


@register(f"""{BARS}, {_TAIL.format(n=60)}, g AS (SELECT ticker, max(high) AS high, min(low) AS low, arg_max(close, date) AS current FROM t GROUP BY ticker)
SELECT ticker, high, low, current, round((high + low) / 2, 6) AS mid, CASE WHEN current > (high + low) / 2 THEN 'premium' ELSE 'discount' END AS zone, round(CASE WHEN high > low THEN (current - low) / (high - low) * 100 ELSE 50.0 END, 1) AS position_pct FROM g""")
def w17_premium_discount(spark, sf):
    return rounded(ind.premium_discount(src.bars_daily(spark, sf)), position_pct=1)


@register(f"""{BARS}, w AS (SELECT *, CASE WHEN count(*) OVER p = 3 THEN max(high) OVER p END AS h, CASE WHEN count(*) OVER p = 3 THEN min(low) OVER p END AS l FROM b WINDOW p AS ({O} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT ticker, date, CASE WHEN low < l AND close > l THEN 'bull' WHEN high > h AND close < h THEN 'bear' END AS sweep FROM w""")
def w18_sweep(spark, sf):
    return ind.sweep_setup(src.bars_daily(spark, sf)).select(*KEYS, "sweep")


@register(f"""{BARS}, m AS (SELECT *, round({full(20, 'avg(close)')}, 5) AS f, round({full(50, 'avg(close)')}, 5) AS s FROM b), d AS (SELECT *, f - s AS d FROM m WHERE f IS NOT NULL AND s IS NOT NULL), p AS (SELECT *, lag(d) OVER ({O}) AS pd FROM d)
SELECT ticker, date, coalesce(pd <= 0 AND d > 0, false) AS golden, coalesce(pd >= 0 AND d < 0, false) AS dead FROM p""")
def w21_crosses(spark, sf):
    b = src.bars_daily(spark, sf)
    m = b.withColumns({"f": rnd(ind.full(20, F.avg("close"), ind.trailing(20)), 5), "s": rnd(ind.full(50, F.avg("close"), ind.trailing(50)), 5)}).where("f IS NOT NULL AND s IS NOT NULL")
    return ind.crosses(m, "f", "s").select(*KEYS, "golden", "dead")


@register(f"{BARS} SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, round(sum(volume), 4) AS volume FROM b GROUP BY 1, 2")
def w30_monthly_bars(spark, sf):
    return rounded(ind.resample(src.bars_daily(spark, sf), "month"))


@register(f"""{BARS}, r AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS r FROM b), s AS (SELECT *, CASE WHEN count(r) OVER {rows(20)} >= 20 THEN stddev_samp(r) OVER {rows(20)} END * sqrt(252) AS sd FROM r)
SELECT ticker, date, round(CASE WHEN sd > 0 THEN greatest(0.2, least(1.5, 0.15 / sd)) ELSE 1.0 END, 6) AS multiplier FROM s""")
def w36_vol_target(spark, sf):
    return rounded(ind.vol_target(src.bars_daily(spark, sf)).select(*KEYS, "multiplier"))


@register(f"""{BARS}, r AS (SELECT *, close / lag(close) OVER ({O}) - 1 AS r FROM b), q AS (SELECT *, avg(r) OVER (PARTITION BY date) AS m FROM r WHERE r IS NOT NULL)
SELECT ticker, date, round(CASE WHEN count(*) OVER {rows(60)} >= 60 AND var_samp(m) OVER {rows(60)} > 0 THEN covar_samp(r, m) OVER {rows(60)} / var_samp(m) OVER {rows(60)} END, 5) AS beta FROM q""")
def w37_rolling_beta(spark, sf):
    r = src.bars_daily(spark, sf).withColumn("r", ind.change()).where("r IS NOT NULL")
    r = r.withColumn("m", F.avg("r").over(Window.partitionBy("date")))
    return rounded(ind.rolling_beta(r).select(*KEYS, "beta"), 5)


@register(f"{BARS}, d AS (SELECT ticker, (close - max(close) OVER ({O} ROWS UNBOUNDED PRECEDING)) / max(close) OVER ({O} ROWS UNBOUNDED PRECEDING) * 100 AS d FROM b WHERE close > 0) SELECT ticker, round(min(d), 6) AS max_drawdown FROM d GROUP BY ticker")
def w39_max_drawdown(spark, sf):
    return rounded(ind.drawdown(src.bars_daily(spark, sf)).groupBy("ticker").agg(F.min("drawdown").alias("max_drawdown")))


@register(f"""{BARS}, m AS (SELECT *, {full(200, 'avg(close)')} AS m FROM b) SELECT ticker, date, CASE WHEN close > m * 1.03 THEN 'bull' WHEN close < m * 0.97 THEN 'bear' ELSE 'neutral' END AS regime FROM m""")
def w41_regime(spark, sf):
    return ind.regime(src.bars_daily(spark, sf)).select(*KEYS, "regime")


@register(f"""{BARS}, m AS (SELECT *, close > {full(200, 'avg(close)')} AS a FROM b) SELECT ticker, date, coalesce(lag(a) OVER ({O}), false) AS invested FROM m""")
def w42_timing_overlay(spark, sf):
    return ind.timing_overlay(src.bars_daily(spark, sf)).select(*KEYS, "invested")


@register(f"{BARS} SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS first_day FROM b GROUP BY 1")
def w44_month_starts(spark, sf):
    return ind.month_starts(src.bars_daily(spark, sf))


@register(f"""{BARS}, m AS (SELECT *, round({full(50, 'avg(close)')}, 5) AS ma FROM b) SELECT ticker, date, ma, coalesce(ma >= lag(ma, 20) OVER ({O}), true) AS trend_ok FROM m""")
def w47_short_trend(spark, sf):
    b = src.bars_daily(spark, sf).withColumn("ma", rnd(ind.full(50, F.avg("close"), ind.trailing(50)), 5))
    return b.withColumn("trend_ok", F.coalesce(F.col("ma") >= F.lag("ma", 20).over(ind.by_time()), F.lit(True))).select(*KEYS, "ma", "trend_ok")


@register(f"""{BARS}, j AS (SELECT *, abs(ln(close / lag(close) OVER ({O}))) AS m FROM b), l AS (SELECT *, max(CASE WHEN m >= ln(1.5) THEN date END) OVER (PARTITION BY ticker) AS last FROM j) SELECT ticker, date, close FROM l WHERE last IS NULL OR date >= last""")
def w48_after_last_jump(spark, sf):
    return ind.after_last_jump(src.bars_daily(spark, sf), 1.5).select(*KEYS, "close")


@register(f"{BARS}, t AS (SELECT *, max(close) OVER ({O} ROWS UNBOUNDED PRECEDING) AS peak FROM b) SELECT ticker, date, peak, close <= peak * 0.9 AS stopped FROM t")
def b20_trailing_stop(spark, sf):
    return simulate.trailing_stop(src.bars_daily(spark, sf)).select(*KEYS, "peak", "stopped")


RECURSIVE = BARS.replace("WITH ", "WITH RECURSIVE ", 1)
_RSI = f"""{RECURSIVE}, d AS MATERIALIZED (SELECT ticker, date, row_number() OVER ({O}) - 1 AS k, close - lag(close) OVER ({O}) AS d FROM b),
e AS (SELECT ticker, date, k, NULL::DOUBLE AS g, NULL::DOUBLE AS s FROM d WHERE k = 0
UNION ALL SELECT d.ticker, d.date, d.k, coalesce(e.g * (1 - 1.0::DOUBLE / 14) + greatest(d.d, 0) / 14, greatest(d.d, 0)), coalesce(e.s * (1 - 1.0::DOUBLE / 14) + greatest(-d.d, 0) / 14, greatest(-d.d, 0)) FROM e JOIN d ON d.ticker = e.ticker AND d.k = e.k + 1)
SELECT ticker, date, round(100 - 100 / (1 + g / CASE WHEN s = 0 THEN 1e-10 ELSE s END), 5) AS rsi FROM e"""

_MACD = f"""{RECURSIVE}, d AS MATERIALIZED (SELECT ticker, date, row_number() OVER ({O}) AS k, close FROM b),
e AS (SELECT ticker, date, k, close AS f, close AS s, 0.0::DOUBLE AS g FROM d WHERE k = 1
UNION ALL SELECT ticker, date, k, f, s, g + 0.2::DOUBLE * (f - s - g) FROM (SELECT d.ticker, d.date, d.k, e.f + 2.0::DOUBLE / 13 * (d.close - e.f) AS f, e.s + 2.0::DOUBLE / 27 * (d.close - e.s) AS s, e.g FROM e JOIN d ON d.ticker = e.ticker AND d.k = e.k + 1))
SELECT ticker, date, round(f - s, 5) AS macd, round(g, 5) AS signal, round(f - s - g, 5) AS histogram FROM e"""

_ADX = f"""{RECURSIVE}, c AS (SELECT *, row_number() OVER ({O}) AS k, lag(close) OVER ({O}) AS q, high - lag(high) OVER ({O}) AS up, lag(low) OVER ({O}) - low AS down FROM b),
d AS MATERIALIZED (SELECT ticker, date, k, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS m, greatest(high - low, abs(high - q), abs(low - q)) AS t FROM c),
e AS (SELECT ticker, date, k, p, m, t, NULL::DOUBLE AS x FROM d WHERE k = 1
UNION ALL SELECT ticker, date, k, p, m, t, CASE WHEN p + m > 0 AND t > 0 THEN coalesce(x + (100 * abs(p - m) / (p + m) - x) / 14, 100 * abs(p - m) / (p + m)) ELSE x END
FROM (SELECT d.ticker, d.date, d.k, e.p + (d.p - e.p) / 14 AS p, e.m + (d.m - e.m) / 14 AS m, e.t + (d.t - e.t) / 14 AS t, e.x FROM e JOIN d ON d.ticker = e.ticker AND d.k = e.k + 1))
SELECT ticker, date, round(CASE WHEN t > 0 THEN 100 * p / t END, 5) AS plus_di, round(CASE WHEN t > 0 THEN 100 * m / t END, 5) AS minus_di, round(x, 5) AS adx FROM e"""


@register(_RSI)
def w3_rsi(spark, sf):
    return rounded(simulate.rsi(src.bars_daily(spark, sf)).select(*KEYS, "rsi"), 5)


@register(_MACD)
def w4_macd(spark, sf):
    return rounded(simulate.macd(src.bars_daily(spark, sf)).select(*KEYS, "macd", "signal", "histogram"), 5)


@register(_ADX)
def w8_adx(spark, sf):
    return rounded(simulate.adx(src.bars_daily(spark, sf)).select(*KEYS, "plus_di", "minus_di", "adx"), 5)


@register(f"""{MINUTES}, e AS (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS l FROM b)
SELECT ticker, ts, close, CAST(l AS DATE) AS session FROM e WHERE hour(l) * 60 + minute(l) >= 570 AND hour(l) * 60 + minute(l) < 960""")
def p6_regular_hours(spark, sf):
    from ..streaming.bars import regular_hours

    return regular_hours(src.bars_15m(spark, sf)).select("ticker", F.col("ts").cast("timestamp_ntz").alias("ts"), "close", "session")


@register(f"""{BARS}, c AS (SELECT ticker, date, close, lag(close) OVER ({O}) AS p FROM b) SELECT ticker, date, round((close / p - 1) * 100, 6) AS change_pct FROM c WHERE abs((close / p - 1) * 100) > 30""")
def p3_jumps(spark, sf):
    from ..operators.ledger import jumps

    return rounded(jumps(src.bars_daily(spark, sf)).select(*KEYS, "change_pct"))


@register(f"""{BARS} SELECT ticker, count(*) AS n, count(*) FILTER (WHERE high < greatest(open, close) - abs(close) * 1e-9) AS high_below, count(*) FILTER (WHERE low > least(open, close) + abs(close) * 1e-9) AS low_above,
count(*) FILTER (WHERE high < low - abs(close) * 1e-9) AS inverted, count(*) FILTER (WHERE least(open, high, low, close) <= 0) AS not_positive FROM b GROUP BY ticker""")
def p2_ohlc_sanity(spark, sf):
    from ..operators.ledger import ohlc_violations

    return ohlc_violations(src.bars_daily(spark, sf))


@register(f"{BARS}, t AS (SELECT DISTINCT ticker FROM b) SELECT ticker, (CAST('0x' || right(sha1(ticker), 8) AS BIGINT) % 64) AS bucket FROM t")
def s26_ticker_bucket(spark, sf):
    return src.bars_daily(spark, sf).select("ticker").distinct().withColumn("bucket", src.bucket_of(F.col("ticker")))


@register(f"""{BARS}, o AS (SELECT ticker, date, close FROM b WHERE date < DATE '1996-01-01'), n AS (SELECT ticker, date, round(close * 1.01, 6) AS close FROM b WHERE date >= DATE '1995-06-01' AND date < DATE '1997-01-01')
SELECT ticker, date, coalesce(n.close, o.close) AS close FROM o FULL JOIN n USING (ticker, date)""")
def s4_merge_panels(spark, sf):
    b = src.bars_daily(spark, sf).select(*KEYS, "close")
    new = b.where("date >= '1995-06-01' AND date < '1997-01-01'").withColumn("close", rnd(F.col("close") * 1.01, 6))
    return src.merge_panels(b.where("date < '1996-01-01'"), new)


@register(f"""{BARS}, f AS (SELECT ticker, min(date) AS first FROM b WHERE date >= DATE '1994-01-01' AND sector != 'ASIA' GROUP BY ticker) SELECT n_name AS ticker, first FROM nation LEFT JOIN f ON ticker = n_name WHERE first IS NULL OR first - DATE '1994-01-01' > 5""")
def s3_missing_tickers(spark, sf):
    wanted = src.table(spark, sf, "nation").select(F.col("n_name").alias("ticker"))
    return src.missing_tickers(src.bars_daily(spark, sf).where("date >= '1994-01-01' AND sector != 'ASIA'"), wanted, "1994-01-01")


# -- cross-sections -----------------------------------------------------------

_MOM = f"m AS (SELECT ticker, sector, date, close, (close / lag(close, 20) OVER ({O}) - 1) * 100 AS mom, (lead(close, 20) OVER ({O}) / close - 1) * 100 AS fwd FROM b)"


def _panel(spark, sf):
    w = ind.by_time()
    b = src.bars_daily(spark, sf)
    return b.select("ticker", "sector", "date", "close", ((F.col("close") / F.lag("close", 20).over(w) - 1) * 100).alias("mom"), ((F.lead("close", 20).over(w) / F.col("close") - 1) * 100).alias("fwd"))


def _score_sql(source: str, by: str, value: str, out: str) -> str:
    return f"""{out}_q AS (SELECT {by.replace(', ', ', ')}, quantile_cont({value}, 0.01) AS lo, quantile_cont({value}, 0.99) AS hi FROM {source} GROUP BY {by}),
{out}_c AS (SELECT s.*, CASE WHEN {value} IS NOT NULL THEN greatest(lo, least(hi, {value})) END AS c FROM {source} s JOIN {out}_q q USING ({by})),
{out}_z AS (SELECT *, avg(c) OVER (PARTITION BY {by}) AS mu, stddev_samp(c) OVER (PARTITION BY {by}) AS sd FROM {out}_c),
{out} AS (SELECT * EXCLUDE (c, mu, sd), CASE WHEN sd IS NULL OR sd < 1e-9 THEN 50.0 WHEN c IS NULL THEN 50.0 ELSE greatest(20.0, least(80.0, (c - mu) / sd * 15 + 50)) END AS score_{out} FROM {out}_z)"""


@register(f"{BARS}, {_MOM}, {_score_sql('m', 'date', 'mom', 'a')} SELECT ticker, date, round(score_a, 5) AS score FROM a")
def c1_winsorised_score(spark, sf):
    return rounded(xs.winsorised_score(_panel(spark, sf), "mom", ["date"], "score").select(*KEYS, "score"), 5)


@register(f"""{BARS}, {_MOM}, {_score_sql('m', 'date', 'mom', 'a')}, {_score_sql('m', 'date, sector', 'mom', 'g')}
SELECT ticker, date, round(CASE WHEN count(*) OVER (PARTITION BY a.date, a.sector) >= 3 THEN score_g ELSE score_a END, 5) AS score FROM a JOIN g USING (ticker, date)""")
def c2_sector_score(spark, sf):
    return rounded(xs.sector_score(_panel(spark, sf), "mom", ["date"], "sector", "score").select(*KEYS, "score"), 5)


@register(f"""{BARS}, {_MOM} SELECT ticker, date, round(CASE WHEN count(mom) OVER d < 3 THEN 0.0 ELSE coalesce((mom - avg(mom) OVER d) / (stddev_samp(mom) OVER d + 1e-9), 0.0) END, 5) AS z FROM m WINDOW d AS (PARTITION BY date)""")
def c3_plain_z(spark, sf):
    return rounded(_panel(spark, sf).withColumn("z", xs.plain_z("mom", ["date"])).select(*KEYS, "z"), 5)


@register(f"""{BARS}, {_MOM} SELECT ticker, date, round(CASE WHEN max(mom) OVER d - min(mom) OVER d < 1e-9 THEN 50.0 ELSE 20 + (mom - min(mom) OVER d) / (max(mom) OVER d - min(mom) OVER d) * 60 END, 5) AS score FROM m WHERE mom IS NOT NULL WINDOW d AS (PARTITION BY date)""")
def c4_min_max(spark, sf):
    p = _panel(spark, sf).where("mom IS NOT NULL")
    return rounded(p.withColumn("score", xs.min_max("mom", ["date"])).select(*KEYS, "score"), 5)


_IC = f"""v AS (SELECT * FROM m WHERE mom IS NOT NULL AND fwd IS NOT NULL), r AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY mom) + (count(*) OVER (PARTITION BY date, mom) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0 AS f FROM v),
ic AS (SELECT date, count(*) AS n, corr(a, f) AS ic FROM r GROUP BY date HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(f) > 0)"""


@register(f"{BARS}, {_MOM}, {_IC} SELECT date, n, round(ic, 6) AS ic FROM ic")
def c6_spearman_ic(spark, sf):
    return rounded(xs.spearman_ic(_panel(spark, sf), "mom", "fwd", ["date"]))


@register(f"""{BARS}, {_MOM}, {_IC} SELECT year(date) AS year, count(*) AS n, round(avg(ic), 6) AS mean_ic, round(stddev_samp(ic), 6) AS std_ic, round(count(*) FILTER (WHERE ic > 1e-9) / count(*), 6) AS positive, round(avg(ic) / stddev_samp(ic), 5) AS icir, round(avg(ic) / stddev_samp(ic) * sqrt(count(*)), 4) AS t FROM ic GROUP BY 1""")
def a5_ic_summary(spark, sf):
    ics = xs.spearman_ic(_panel(spark, sf), "mom", "fwd", ["date"]).withColumn("year", F.year("date")).withColumn("ic", rnd("ic", 9))
    return rounded(xs.ic_summary(ics, ["year"]), icir=5, t=4)


@register(f"""{BARS}, {_MOM}, {_IC}, d AS (SELECT year(date) AS year, date, ic, ic - avg(ic) OVER (PARTITION BY year(date)) AS d FROM ic),
p AS (SELECT year, ic, d * d AS g0, d * lag(d, 1) OVER w AS g1, d * lag(d, 2) OVER w AS g2, d * lag(d, 3) OVER w AS g3, d * lag(d, 4) OVER w AS g4, d * lag(d, 5) OVER w AS g5 FROM d WINDOW w AS (PARTITION BY year ORDER BY date)),
s AS (SELECT year, count(*) AS n, avg(ic) AS mean, (sum(g0) + 2 * (5 / 6.0 * coalesce(sum(g1), 0) + 4 / 6.0 * coalesce(sum(g2), 0) + 3 / 6.0 * coalesce(sum(g3), 0) + 2 / 6.0 * coalesce(sum(g4), 0) + 1 / 6.0 * coalesce(sum(g5), 0))) / (count(*) - 1) AS t FROM p GROUP BY year HAVING count(*) >= 2)
SELECT year, n, round(mean, 6) AS mean, round(CASE WHEN t <= 0 THEN 0.0 ELSE sqrt(t / n) END, 6) AS se FROM s""")
def a9_newey_west(spark, sf):
    ics = xs.spearman_ic(_panel(spark, sf), "mom", "fwd", ["date"]).withColumn("year", F.year("date"))
    return rounded(xs.newey_west(ics, "ic", "date", ["year"], 5))


@register(f"""{BARS}, {_MOM}, v AS (SELECT * FROM m WHERE mom IS NOT NULL), q AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mom, 6) DESC, ticker) AS rn, count(*) OVER (PARTITION BY date) AS n FROM v)
SELECT ticker, date, CAST(least(floor((rn - 1) / greatest(1, floor(n / 5))), 4) + 1 AS INT) AS quintile FROM q""")
def t8_quintiles(spark, sf):
    p = _panel(spark, sf).where("mom IS NOT NULL").withColumn("mom", rnd("mom", 6))
    return xs.quintiles(p, "mom", ["date"]).select(*KEYS, "quintile")


@register(f"""{BARS}, {_MOM}, q AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mom, 6) DESC, ticker) AS place FROM m WHERE mom IS NOT NULL) SELECT ticker, date, place FROM q WHERE place <= 3""")
def t4_top_k(spark, sf):
    p = _panel(spark, sf).where("mom IS NOT NULL").withColumn("mom", rnd("mom", 6))
    return xs.top_k(p, "mom", ["date"], 3).select(*KEYS, "place")


@register(f"""{BARS}, u AS (SELECT date, ticker, close * volume AS mktcap FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(mktcap, 4) DESC, ticker) AS rank FROM u) SELECT date, ticker, rank FROM r WHERE rank > 5 AND rank <= 15""")
def t2_universe(spark, sf):
    caps = src.bars_daily(spark, sf).select("date", "ticker", rnd(F.col("close") * F.col("volume"), 4).alias("mktcap"))
    return xs.universe(caps, 5, 10).select("date", "ticker", "rank")


_SCAN = f"""x AS (SELECT ticker, sector, date, coalesce((lag(close, 20) OVER ({O}) / lag(close, 251) OVER ({O}) - 1) * 100, 0.0) AS momentum_raw, close / lag(close) OVER ({O}) - 1 AS r, close, volume FROM b),
y AS (SELECT *, stddev_samp(r) OVER {rows(252)} * sqrt(252) * 100 AS vol, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM x),
z AS (SELECT ticker, sector, 1 AS k, round(momentum_raw, 2) AS momentum_raw, round(greatest(0.0, 100 - coalesce(vol, 100.0)), 2) AS low_vol_raw, round(volume / close, 6) AS value_raw FROM y WHERE rn = 1)"""


@register(f"""{BARS}, {_SCAN}, {_score_sql('z', 'k', 'momentum_raw', 'a')}, {_score_sql('a', 'k', 'low_vol_raw', 'v')}, {_score_sql('v', 'k', 'value_raw', 'w')}
SELECT ticker, sector, round(score_a, 4) AS momentum, round(score_v, 4) AS low_vol, round(score_w, 4) AS value, round((score_a * 0.5 + score_v * 0.3 + score_w * 0.2), 4) AS composite, row_number() OVER (ORDER BY round(score_a * 0.5 + score_v * 0.3 + score_w * 0.2, 6) DESC, ticker) AS rank FROM w""")
def c17_factor_scan(spark, sf):
    """Scores, composite and rank of the names by their last bars."""
    b = ind.volatility(ind.momentum(src.bars_daily(spark, sf)))
    last = b.groupBy("ticker", "sector").agg(F.max_by(F.struct("momentum", "vol", "close", "volume"), "date").alias("l")).select("ticker", "sector", F.lit(1).alias("k"), rnd("l.momentum", 2).alias("momentum_raw"), rnd(F.greatest(F.lit(0.0), 100 - F.coalesce("l.vol", F.lit(100.0))), 2).alias("low_vol_raw"), rnd(F.col("l.volume") / F.col("l.close"), 6).alias("value_raw"))
    for c in ("momentum", "low_vol", "value"):
        last = xs.winsorised_score(last, f"{c}_raw", ["k"], c)
    c = last.withColumn("composite", rnd(F.col("momentum") * 0.5 + F.col("low_vol") * 0.3 + F.col("value") * 0.2, 6))
    ranked = c.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.col("composite").desc(), "ticker")))
    return rounded(ranked.select("ticker", "sector", "momentum", "low_vol", "value", "composite", "rank"), 4)


@register(f"""{BARS}, {_MOM}, f AS (SELECT date, 'mom' AS slug, ticker, mom AS s, fwd FROM m UNION ALL SELECT date, 'rev', ticker, -mom, fwd FROM m UNION ALL SELECT date, 'px', ticker, close, fwd FROM m), v AS (SELECT * FROM f WHERE s IS NOT NULL AND fwd IS NOT NULL),
r AS (SELECT date, slug, rank() OVER (PARTITION BY date, slug ORDER BY s) + (count(*) OVER (PARTITION BY date, slug, s) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date, slug ORDER BY fwd) + (count(*) OVER (PARTITION BY date, slug, fwd) - 1) / 2.0 AS b FROM v),
i AS (SELECT date, slug, corr(a, b) AS ic FROM r GROUP BY date, slug HAVING count(*) >= 5 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0), p AS (SELECT slug AS factor, CAST(date_trunc('month', date) AS DATE) AS period, round(avg(ic), 8) AS ic FROM i GROUP BY 1, 2),
w AS (SELECT *, avg(ic) OVER q AS mu, count(ic) OVER q AS k FROM p WINDOW q AS (PARTITION BY factor ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, greatest(mu, 0.005) AS f FROM w WHERE k >= 12), h AS (SELECT *, f / sum(f) OVER (PARTITION BY period) AS wt FROM g)
SELECT period, round(sum(wt * ic), 6) AS oos_ic, round(sum(wt), 6) AS weights, count(*) AS n_factors FROM h GROUP BY period""")
def c13_walk_forward(spark, sf):
    p = _panel(spark, sf)
    f = p.select("date", "ticker", "fwd", F.explode(F.map_from_arrays(F.array(F.lit("mom"), F.lit("rev"), F.lit("px")), F.array("mom", -F.col("mom"), "close"))).alias("slug", "s"))
    ics = xs.spearman_ic(f, "s", "fwd", ["date", "slug"])
    month = ics.groupBy(F.col("slug").alias("factor"), F.trunc("date", "month").alias("period")).agg(rnd(F.avg("ic"), 8).alias("ic"))
    return rounded(xs.walk_forward(month))


# -- joins and portfolios -----------------------------------------------------


@register(f"{BARS} SELECT ticker, date, round((lead(close, 20) OVER ({O}) / close - 1) * 100, 6) AS forward FROM b QUALIFY lead(close, 20) OVER ({O}) IS NOT NULL")
def j10_forward_returns(spark, sf):
    return rounded(joins.forward_returns(src.bars_daily(spark, sf), 20).select(*KEYS, "forward"))


_PLANS = f"""n AS (SELECT *, row_number() OVER ({O}) - 1 AS pos FROM b), pl AS (SELECT ticker || ':' || pos AS plan_id, ticker, pos AS start_pos, round(close * 0.99, 6) AS entry_low, round(close * 1.01, 6) AS entry_high, round(close * 0.97, 6) AS stop, round(close * 1.06, 6) AS target, 2.0 AS rr FROM n),
fl AS (SELECT p.plan_id, min(n.pos) AS fill_pos FROM pl p JOIN n ON n.ticker = p.ticker AND n.pos > p.start_pos AND n.pos <= p.start_pos + 20 AND n.low <= p.entry_high GROUP BY 1),
ex AS (SELECT p.plan_id, f.fill_pos, min(CASE WHEN n.low <= p.stop THEN n.pos END) AS sp, min(CASE WHEN n.high >= p.target THEN n.pos END) AS hp FROM pl p JOIN fl f USING (plan_id) JOIN n ON n.ticker = p.ticker AND n.pos >= f.fill_pos AND n.pos < f.fill_pos + 40 GROUP BY 1, 2),
tr AS (SELECT p.*, e.fill_pos, CASE WHEN e.fill_pos IS NULL THEN 'nofill' WHEN sp IS NOT NULL AND (hp IS NULL OR sp <= hp) THEN 'loss' WHEN hp IS NOT NULL THEN 'win' ELSE 'timeout' END AS outcome, CASE WHEN sp IS NOT NULL AND (hp IS NULL OR sp <= hp) THEN sp WHEN hp IS NOT NULL THEN hp END AS exit_pos FROM pl p LEFT JOIN ex e USING (plan_id))"""


def _plans(spark, sf):
    n = simulate.numbered(src.bars_daily(spark, sf))
    c = F.col("close")
    plans = n.select(F.concat_ws(":", "ticker", F.col("pos").cast("string")).alias("plan_id"), "ticker", F.col("pos").alias("start_pos"), F.lit("long").alias("direction"), rnd(c * 0.99, 6).alias("entry_low"), rnd(c * 1.01, 6).alias("entry_high"), rnd(c * 0.97, 6).alias("stop"), rnd(c * 1.06, 6).alias("target"), F.lit(2.0).alias("rr"))
    return simulate.first_touch(plans, n)


@register(f"{BARS}, {_PLANS} SELECT plan_id, outcome, fill_pos, exit_pos, CAST(CASE outcome WHEN 'loss' THEN -1.0 WHEN 'win' THEN rr ELSE 0.0 END AS DOUBLE) AS r FROM tr")
def b7_first_touch(spark, sf):
    return _plans(spark, sf).select("plan_id", "outcome", "fill_pos", "exit_pos", "r")


@register(f"""{BARS}, {_PLANS}, t AS (SELECT *, CASE outcome WHEN 'loss' THEN -1.0 WHEN 'win' THEN rr ELSE 0.0 END AS r FROM tr)
SELECT ticker, count(*) AS setups, count(*) FILTER (WHERE outcome != 'nofill') AS filled, count(*) FILTER (WHERE outcome = 'win') AS wins, count(*) FILTER (WHERE outcome = 'loss') AS losses, count(*) FILTER (WHERE outcome = 'timeout') AS timeouts,
round(avg(r) FILTER (WHERE outcome != 'nofill'), 6) AS expectancy, avg(r) FILTER (WHERE outcome = 'win') AS avg_win_r, round(CASE WHEN count(*) FILTER (WHERE outcome IN ('win', 'loss')) > 0 THEN count(*) FILTER (WHERE outcome = 'win') / count(*) FILTER (WHERE outcome IN ('win', 'loss')) END, 6) AS win_rate FROM t GROUP BY ticker""")
def a15_trade_stats(spark, sf):
    return rounded(simulate.trade_stats(_plans(spark, sf), ["ticker"]))


_WALK = BARS.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _PLANS + """, o AS MATERIALIZED (SELECT plan_id, ticker, start_pos, outcome, CAST(CASE outcome WHEN 'loss' THEN -1.0 WHEN 'win' THEN rr ELSE 0.0 END AS DOUBLE) AS r,
greatest(start_pos + 1, coalesce(exit_pos, fill_pos + 40, start_pos + 20) + 3) AS free FROM tr),
k AS (SELECT * FROM o WHERE start_pos = 0 UNION ALL SELECT o.* FROM k JOIN o ON o.ticker = k.ticker AND o.start_pos = k.free) SELECT plan_id, ticker, start_pos, outcome, r FROM k"""


@register(_WALK)
def b9_cooldown(spark, sf):
    return simulate.cooled_down(_plans(spark, sf)).select("plan_id", "ticker", "start_pos", "outcome", "r")


_CURVE = f"""cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM b)), cb AS (SELECT ticker, pos, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM b JOIN cal USING (date)),
ev AS (SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS day FROM b), en AS (SELECT ticker, day, (SELECT min(pos) FROM cal WHERE cal.date > ev.day) AS entry_pos FROM ev),
td AS (SELECT ticker, day, entry_pos, entry_pos + 10 AS exit_pos FROM en WHERE entry_pos IS NOT NULL AND entry_pos + 10 <= (SELECT max(pos) FROM cal))"""


def _events(spark, sf):
    b = src.bars_daily(spark, sf)
    ev = b.select("ticker", F.trunc("date", "month").alias("day")).distinct()
    return joins.next_day_trades(ev, b, "day", 10), b


@register(f"{BARS}, {_CURVE} SELECT ticker, day, entry_pos, exit_pos FROM td")
def j6_next_day_trades(spark, sf):
    return _events(spark, sf)[0]


@register(f"""{BARS}, {_CURVE}, h AS (SELECT ticker, entry_pos, unnest(range(entry_pos + 1, exit_pos + 1)) AS pos FROM td), d AS (SELECT h.pos, count(*) AS held, avg(coalesce(r, 0.0) - CASE WHEN h.pos = entry_pos + 1 THEN 0.0012 ELSE 0.0 END) AS ret FROM h LEFT JOIN cb USING (ticker, pos) GROUP BY h.pos)
SELECT date, coalesce(held, 0) AS held, round(CASE WHEN held >= 1 THEN ret ELSE 0.0 END, 8) AS ret FROM cal LEFT JOIN d USING (pos)""")
def a31_calendar_curve(spark, sf):
    t, b = _events(spark, sf)
    return rounded(simulate.calendar_curve(t, b), 8)


@register(f"""{BARS}, {_CURVE}, h AS (SELECT ticker, entry_pos, unnest(range(entry_pos + 1, exit_pos + 1)) AS pos FROM td), d AS (SELECT h.pos, count(*) AS held, avg(coalesce(r, 0.0) - CASE WHEN h.pos = entry_pos + 1 THEN 0.0012 ELSE 0.0 END) AS ret FROM h LEFT JOIN cb USING (ticker, pos) GROUP BY h.pos)
SELECT year(date) AS year, round(sum(ln(1 + CASE WHEN held >= 1 THEN ret ELSE 0.0 END)), 6) AS log_ret, round(avg(CASE WHEN coalesce(held, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS exposure FROM cal LEFT JOIN d USING (pos) GROUP BY 1""")
def a34_yearly_returns(spark, sf):
    t, b = _events(spark, sf)
    y = simulate.yearly_returns(simulate.calendar_curve(t, b))
    return rounded(y.select("year", F.log1p("ret").alias("log_ret"), "exposure"))  # these bars jump so much that only logarithms have a scale


@register(f"""{BARS}, {_MOM}, k AS (SELECT *, CASE WHEN mom >= 5 THEN 1 WHEN mom <= -5 THEN 0 END AS mark FROM m) SELECT ticker, date, coalesce(last_value(mark IGNORE NULLS) OVER ({O} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM k""")
def b1_threshold_positions(spark, sf):
    return simulate.threshold_positions(_panel(spark, sf), "mom", 5, -5).select(*KEYS, "held")


@register()
def i1_block_bootstrap(spark, sf):
    from ..operators.inference import block_bootstrap

    t, b = _events(spark, sf)
    return rounded(block_bootstrap(simulate.calendar_curve(t, b), "ret", "date"), 9)


@register()
def i8_monte_carlo(spark, sf):
    """Paths of each ticker from its last close, with the drift and deviation of its daily logarithmic returns."""
    from ..operators.inference import monte_carlo

    b = src.bars_daily(spark, sf)
    b = b.withColumn("_r", F.log(F.col("close") / F.lag("close").over(ind.by_time())))
    starts = b.groupBy("ticker").agg(F.max_by("close", "date").alias("start"), (F.avg("_r") + F.var_samp("_r") / 2).alias("mu"), F.stddev_samp("_r").alias("sigma"))
    return rounded(monte_carlo(starts))
