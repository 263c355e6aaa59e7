"""Queries over price structure as seen at each bar: channels, divergences, boxes and levels."""

from __future__ import annotations

from ..operators import simulate, structure
from ..sources import tables as src
from .catalog import register, rounded
from .panel import KEYS, _RSI
from .sql import BARS, O, full, rows


#: The table's closes are means of unrelated trades and swing by half; at the default of 1.5 percent no box would ever hold.
BOX_PCT = 60.0


def _swings(k: int, high: str = "high", low: str = "low", source: str = "b") -> str:
    """Rows numbered, with the swings that k rows on both sides make."""
    return f"""sw AS (SELECT *, row_number() OVER ({O}) AS pos, coalesce(count(*) OVER p = {k} AND count(*) OVER n = {k} AND {high} > max({high}) OVER p AND {high} > max({high}) OVER n, false) AS sh,
  coalesce(count(*) OVER p = {k} AND count(*) OVER n = {k} AND {low} < min({low}) OVER p AND {low} < min({low}) OVER n, false) AS sl
  FROM {source} WINDOW p AS ({O} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING), n AS ({O} ROWS BETWEEN 1 FOLLOWING AND {k} FOLLOWING))"""


def _seen(flag: str, value: str, lookback: int, k: int) -> str:
    return f"coalesce(list({value}) FILTER ({flag}) OVER ({O} ROWS BETWEEN {lookback - 1 - k} PRECEDING AND {k} PRECEDING), [])"


def _slope(a: str) -> str:
    x, y = f"list_transform({a}, lambda e: (e.pos - pos)::DOUBLE)", f"list_transform({a}, lambda e: e.v)"
    xx, xy = f"list_transform({a}, lambda e: ((e.pos - pos) * (e.pos - pos))::DOUBLE)", f"list_transform({a}, lambda e: (e.pos - pos) * e.v)"
    return f"CASE WHEN len({a}) >= 2 THEN (len({a}) * list_sum({xy}) - list_sum({x}) * list_sum({y})) / (len({a}) * list_sum({xx}) - list_sum({x}) * list_sum({x})) END"


@register(f"""{BARS}, {_swings(5)}, h AS (SELECT ticker, date, pos, close, {_seen('sh', "{'pos': pos, 'v': high}", 80, 5)} AS h, {_seen('sl', "{'pos': pos, 'v': low}", 80, 5)} AS l, count(*) OVER {rows(80)} AS n, avg(close) OVER {rows(80)} AS m FROM sw),
s AS (SELECT *, CASE WHEN n >= 40 THEN (({_slope('h')}) + ({_slope('l')})) / 2 END AS slope FROM h),
u AS (SELECT *, CASE WHEN slope IS NOT NULL THEN list_max(list_transform(h, lambda e: e.v + slope * (pos - e.pos))) END AS upper, CASE WHEN slope IS NOT NULL THEN list_min(list_transform(l, lambda e: e.v + slope * (pos - e.pos))) END AS lower, slope / (m + 1e-9) * 100 AS drift FROM s),
z AS (SELECT *, upper - lower AS w, CASE WHEN upper > lower THEN (close - lower) / (upper - lower) * 100 WHEN upper IS NOT NULL THEN 50.0 END AS place FROM u)
SELECT ticker, date, round(slope, 5) AS slope, round(upper, 4) AS upper, round(lower, 4) AS lower, CASE WHEN drift > 0.05 THEN 'bullish' WHEN drift < -0.05 THEN 'bearish' WHEN drift IS NOT NULL THEN 'sideways' END AS direction,
  round(CASE WHEN lower > 0 THEN w / lower * 100 WHEN w IS NOT NULL THEN 0.0 END, 4) AS width_pct, round(place, 4) AS position_pct, CASE WHEN place > 66 THEN 'upper' WHEN place < 33 THEN 'lower' WHEN place IS NOT NULL THEN 'middle' END AS zone FROM z""")
def w19_channel(spark, sf):
    return rounded(structure.channel(src.bars_daily(spark, sf)).select(*KEYS, "slope", "upper", "lower", "direction", "width_pct", "position_pct", "zone"), 4, slope=5)


@register(_RSI.rsplit("SELECT ticker, date", 1)[0] + f""", rr AS (SELECT ticker, date, 100 - 100 / (1 + g / CASE WHEN s = 0 THEN 1e-10 ELSE s END) AS rsi FROM e),
ps AS (SELECT b.ticker, b.date, b.close, rsi, row_number() OVER (PARTITION BY b.ticker ORDER BY b.date) AS nth FROM b LEFT JOIN rr ON rr.ticker = b.ticker AND rr.date = b.date),
kn AS (SELECT * FROM ps WHERE rsi IS NOT NULL), {_swings(5, 'close', 'close', 'kn')},
f AS (SELECT *, lag(nth, 5) OVER ({O}) AS since FROM sw),
g AS (SELECT ticker, date, nth, {_seen('sh', "{'s': since, 'p': close, 'o': rsi}", 60, 5)} AS h, {_seen('sl', "{'s': since, 'p': close, 'o': rsi}", 60, 5)} AS l, list(nth) OVER {rows(13)} AS near FROM f),
k AS (SELECT ticker, date, list_filter(h, lambda e: e.s > nth - 60)[-2:] AS h, list_filter(l, lambda e: e.s > nth - 60)[-2:] AS l, len(list_filter(near, lambda x: x > nth - 60)) >= 13 AS ok FROM g)
SELECT ticker, date, ok AND len(l) = 2 AND l[2].p < l[1].p AND l[2].o > l[1].o AS regular_bull, ok AND len(l) = 2 AND l[2].p > l[1].p AND l[2].o < l[1].o AS hidden_bull,
  ok AND len(h) = 2 AND h[2].p > h[1].p AND h[2].o < h[1].o AS regular_bear, ok AND len(h) = 2 AND h[2].p < h[1].p AND h[2].o > h[1].o AS hidden_bear FROM k""")
def w20_divergence(spark, sf):
    return structure.divergence(simulate.rsi(src.bars_daily(spark, sf))).select(*KEYS, "regular_bull", "hidden_bull", "regular_bear", "hidden_bear")


@register(f"""{BARS}, {_swings(3)}, h AS (SELECT *, {_seen('sh', 'high', 60, 3)} AS h, {_seen('sl', 'low', 60, 3)} AS l, count(*) OVER {rows(60)} AS n, {full(10, 'avg(volume)', 20)} AS v FROM sw),
m AS (SELECT *, CASE WHEN n >= 9 AND len(h) >= 2 AND len(l) >= 2 THEN list_aggregate(h, 'median') END AS top, CASE WHEN n >= 9 AND len(h) >= 2 AND len(l) >= 2 THEN list_aggregate(l, 'median') END AS bottom FROM h),
x AS (SELECT *, coalesce(top > bottom, false) AS box, coalesce(top > bottom AND len(list_filter(h[-2:], lambda e: abs(e - top) / top * 100 <= {BOX_PCT})) = 2 AND len(list_filter(l[-2:], lambda e: abs(e - bottom) / bottom * 100 <= {BOX_PCT})) = 2, false) AS in_box, v != 0 AND volume / v >= 1 AS loud FROM m),
y AS (SELECT *, in_box AND close > top AS up, in_box AND close < bottom AS down, coalesce(box AND loud, false) AS vol FROM x)
SELECT ticker, date, round(CASE WHEN box THEN top END, 5) AS box_high, round(CASE WHEN box THEN bottom END, 5) AS box_low, in_box, up AS breakout_up, down AS breakout_down, vol AS vol_confirmed, (up OR down) AND NOT vol AS fakeout,
  round(CASE WHEN up THEN top + (top - bottom) * 1.618 WHEN down THEN bottom - (top - bottom) * 1.618 END, 4) AS target, round(CASE WHEN up THEN top WHEN down THEN bottom END, 5) AS stop FROM y""")
def w22_box_breakout(spark, sf):
    out = structure.box_breakout(src.bars_daily(spark, sf), tolerance_pct=BOX_PCT)
    return rounded(out.select(*KEYS, "box_high", "box_low", "in_box", "breakout_up", "breakout_down", "vol_confirmed", "fakeout", "target", "stop"), 5, target=4)


@register()
def w28_levels(spark, sf):
    """Prominence and the clustering fold have no short SQL: tests hold them against their definition."""
    return rounded(structure.levels(src.bars_daily(spark, sf)), 4)
