"""Queries over trade plans: plans of every bar, fills as they could be placed, entry rules on the same setups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulate
from ..operators import trade_plans as tp
from ..sources import tables as src
from ..sources.work import cut
from .catalog import register, rounded
from .sql import BARS, O

_W = f"{O} ROWS BETWEEN"
_DRAWN = f"""p0 AS (SELECT *, row_number() OVER ({O}) - 1 AS pos, lag(high, 2) OVER ({O}) AS h2, lag(low, 2) OVER ({O}) AS l2, (lead(close) OVER ({O}) / close - 1) * 100 AS mv,
  greatest(high - low, abs(high - lag(close) OVER ({O})), abs(low - lag(close) OVER ({O}))) AS tr, max(high) OVER ({_W} 59 PRECEDING AND CURRENT ROW) AS hh, min(low) OVER ({_W} 59 PRECEDING AND CURRENT ROW) AS ll,
  max(high) OVER ({_W} 3 PRECEDING AND 1 PRECEDING) AS ph, min(low) OVER ({_W} 3 PRECEDING AND 1 PRECEDING) AS pl, CASE WHEN count(*) OVER ({_W} 49 PRECEDING AND CURRENT ROW) >= 50 THEN avg(close) OVER ({_W} 49 PRECEDING AND CURRENT ROW) END AS ma,
  count(*) OVER ({_W} 5 PRECEDING AND 1 PRECEDING) = 5 AND count(*) OVER ({_W} 1 FOLLOWING AND 5 FOLLOWING) = 5 AS whole, max(high) OVER ({_W} 5 PRECEDING AND 1 PRECEDING) AS hb, max(high) OVER ({_W} 1 FOLLOWING AND 5 FOLLOWING) AS ha,
  min(low) OVER ({_W} 5 PRECEDING AND 1 PRECEDING) AS lb, min(low) OVER ({_W} 1 FOLLOWING AND 5 FOLLOWING) AS la FROM b),
p1 AS MATERIALIZED (SELECT *, (hh + ll) / 2 AS mid, lag(ma, 20) OVER ({O}) AS mp, whole AND high > hb AND high > ha AS sh, whole AND low < lb AND low < la AS sl,
  CASE WHEN count(*) OVER ({_W} 13 PRECEDING AND CURRENT ROW) >= 14 AND avg(tr) OVER ({_W} 13 PRECEDING AND CURRENT ROW) > 0 THEN avg(tr) OVER ({_W} 13 PRECEDING AND CURRENT ROW) ELSE close * 0.005::DOUBLE END AS atr FROM p0),
z0 AS (SELECT ticker, pos, 'gap' AS sort, CASE WHEN h2 < low THEN 'bull' ELSE 'bear' END AS kind, CASE WHEN h2 < low THEN low ELSE l2 END AS top, CASE WHEN h2 < low THEN h2 ELSE high END AS bottom FROM p1 WHERE h2 < low OR l2 > high
  UNION ALL SELECT ticker, pos, 'block', CASE WHEN close < open THEN 'bull' ELSE 'bear' END, high, low FROM p1 WHERE pos > 0 AND ((close < open AND mv >= 1) OR (close > open AND mv <= -1))),
z AS MATERIALIZED (SELECT z0.*, d.fin FROM z0 LEFT JOIN (SELECT z0.ticker, z0.pos, z0.sort, min(x.pos) AS fin FROM z0 JOIN p1 x ON x.ticker = z0.ticker AND x.pos > z0.pos AND x.pos < z0.pos + 80
  AND CASE WHEN z0.kind = 'bull' THEN x.low <= z0.bottom ELSE x.high >= z0.top END GROUP BY ALL) d USING (ticker, pos, sort)),
zs AS (SELECT p.ticker, p.pos, coalesce(bool_or(z.sort = 'gap' AND z.kind = 'bull' AND z.pos >= p.pos - 57 AND p.close BETWEEN z.bottom AND z.top), false) AS gu, coalesce(bool_or(z.sort = 'gap' AND z.kind = 'bear' AND z.pos >= p.pos - 57 AND p.close BETWEEN z.bottom AND z.top), false) AS gd,
  coalesce(bool_or(z.sort = 'block' AND z.kind = 'bull' AND z.pos >= p.pos - 58 AND p.close BETWEEN z.bottom * 0.98::DOUBLE AND z.top * 1.02::DOUBLE), false) AS bu, coalesce(bool_or(z.sort = 'block' AND z.kind = 'bear' AND z.pos >= p.pos - 58 AND p.close BETWEEN z.bottom * 0.98::DOUBLE AND z.top * 1.02::DOUBLE), false) AS bd,
  max({{'e': z.top, 'a': -z.pos, 'o': z.bottom}}) FILTER (WHERE z.sort = 'block' AND z.kind = 'bull' AND z.top <= p.close * 1.03::DOUBLE) AS ub, max({{'e': z.top, 'a': -z.pos, 'o': z.bottom}}) FILTER (WHERE z.sort = 'gap' AND z.kind = 'bull' AND z.top <= p.close * 1.03::DOUBLE) AS ug,
  min({{'e': z.bottom, 'a': z.pos, 'o': z.top}}) FILTER (WHERE z.sort = 'block' AND z.kind = 'bear' AND z.bottom >= p.close * 0.97::DOUBLE) AS db, min({{'e': z.bottom, 'a': z.pos, 'o': z.top}}) FILTER (WHERE z.sort = 'gap' AND z.kind = 'bear' AND z.bottom >= p.close * 0.97::DOUBLE) AS dg
  FROM p1 p JOIN z ON z.ticker = p.ticker AND (z.fin IS NULL OR z.fin > p.pos) AND CASE WHEN z.sort = 'gap' THEN z.pos BETWEEN p.pos - 77 AND p.pos AND (z.top - z.bottom) / p.close * 100 >= 0.03 ELSE z.pos BETWEEN p.pos - 78 AND p.pos - 1 END GROUP BY ALL),
s0 AS (SELECT ticker, pos, 'H' AS side, high AS price FROM p1 WHERE sh UNION ALL SELECT ticker, pos, 'L', low FROM p1 WHERE sl),
s1 AS (SELECT *, lag(pos) OVER w AS since, lag(side) OVER w AS was, lag(price) OVER w AS level FROM s0 WINDOW w AS (PARTITION BY ticker ORDER BY pos, side)),
s2 AS MATERIALIZED (SELECT s.ticker, s.pos, s.side, s.since, s.was = 'H' AS bull, min(x.pos) AS at FROM s1 s JOIN p1 x ON x.ticker = s.ticker AND x.pos > s.pos AND x.pos < s.pos + 80 AND CASE WHEN s.was = 'H' THEN x.close > s.level ELSE x.close < s.level END WHERE s.was IS NOT NULL GROUP BY ALL),
bk AS (SELECT p.ticker, p.pos, max({{'at': s.at, 'pos': s.pos, 'side': s.side, 'bull': s.bull}}) AS k FROM p1 p JOIN s2 s ON s.ticker = p.ticker AND s.since >= p.pos - 74 AND s.pos <= p.pos - 5 AND s.at <= p.pos GROUP BY ALL),
tg AS (SELECT p.ticker, p.pos, min(s.price) FILTER (WHERE s.side = 'H' AND s.price > p.close) AS top, max(s.price) FILTER (WHERE s.side = 'L' AND s.price < p.close) AS dip FROM p1 p JOIN s0 s ON s.ticker = p.ticker AND s.pos BETWEEN p.pos - 74 AND p.pos - 5 GROUP BY ALL),
q0 AS (SELECT p.*, z.ub, z.ug, z.db, z.dg, t.top, t.dip, [CASE WHEN low < pl AND close > (ph + pl) / 2 AND close < ph THEN 20 WHEN high > ph AND close > pl AND close < (ph + pl) / 2 THEN -20 ELSE 0 END, CASE WHEN gu THEN 15 ELSE 0 END, CASE WHEN gd THEN -15 ELSE 0 END,
  CASE WHEN bu THEN 10 ELSE 0 END, CASE WHEN bd THEN -10 ELSE 0 END, CASE WHEN k IS NULL THEN 0 WHEN k.bull THEN 10 ELSE -10 END, CASE WHEN close <= mid AND round(CASE WHEN hh > ll THEN (close - ll) / (hh - ll) * 100 ELSE 50.0::DOUBLE END, 1) < 30 THEN 5
  WHEN close > mid AND round(CASE WHEN hh > ll THEN (close - ll) / (hh - ll) * 100 ELSE 50.0::DOUBLE END, 1) > 80 THEN -8 ELSE 0 END] AS parts FROM p1 p LEFT JOIN zs z USING (ticker, pos) LEFT JOIN bk USING (ticker, pos) LEFT JOIN tg t USING (ticker, pos)),
q1 AS (SELECT *, CAST(greatest(-30, least(30, list_sum(parts))) AS INTEGER) AS bias, CAST(len([x FOR x IN parts IF x != 0]) AS INTEGER) AS signals FROM q0 WHERE pos >= 59),
q2 AS (SELECT *, bias >= 10 AS long, greatest(abs(bias), 0) AS agrees, CASE WHEN bias >= 10 THEN coalesce(ub.o, ug.o, ll) ELSE coalesce(db.e, dg.e, greatest(mid, close)) END AS el, CASE WHEN bias >= 10 THEN coalesce(ub.e, ug.e, least(mid, close)) ELSE coalesce(db.o, dg.o, hh) END AS eh FROM q1 WHERE abs(bias) >= 10),
q3 AS (SELECT *, (el + eh) / 2 AS ref, CASE WHEN long THEN coalesce(top, hh) ELSE coalesce(dip, ll) END AS t0 FROM q2),
q4 AS (SELECT *, CASE WHEN long THEN CASE WHEN t0 <= ref THEN hh ELSE t0 END ELSE CASE WHEN t0 >= ref THEN ll ELSE t0 END END AS t1, CASE WHEN long THEN el - 0.25::DOUBLE * atr ELSE eh + 0.25::DOUBLE * atr END AS st FROM q3),
q5 AS (SELECT *, CASE WHEN long THEN CASE WHEN hh > t1 THEN hh ELSE t1 + (t1 - ref) END ELSE CASE WHEN ll < t1 THEN ll ELSE t1 - (ref - t1) END END AS t2, CASE WHEN NOT long AND agrees < 12 THEN 'weak short' WHEN NOT long AND NOT coalesce(close < ma AND ma <= mp, false) THEN 'trend' END AS veto FROM q4),
q6 AS (SELECT *, least(el, eh) AS lo, greatest(el, eh) AS hi, CASE WHEN long THEN ref - st ELSE st - ref END AS risk, CASE WHEN long THEN t1 - ref ELSE ref - t1 END AS g1, CASE WHEN long THEN t2 - ref ELSE ref - t2 END AS g2, CASE WHEN ref > 0 THEN abs(ref - st) / ref * 100 ELSE 0.0::DOUBLE END AS rp FROM q5),
q7 AS (SELECT *, CASE WHEN long THEN st < lo ELSE st > hi END AND g1 > 0 AND g2 > 0 AS ok, CASE WHEN risk > 0 AND g1 > 0 THEN g1 / risk END AS r1, CASE WHEN risk > 0 AND g2 > 0 THEN g2 / risk END AS r2, CASE WHEN rp > 2.34 THEN 'A' WHEN rp > 1.75 THEN 'B' WHEN rp > 1.34 THEN 'C' ELSE 'D' END AS cg FROM q6),
q8 AS (SELECT *, veto IS NULL AND ok AND coalesce(r1 >= 2, false) AS valid FROM q7),
pl AS MATERIALIZED (SELECT ticker || ':' || pos AS plan_id, ticker, date, pos AS start_pos, CASE WHEN long THEN 'long' ELSE 'short' END AS direction, bias, signals, CASE WHEN agrees >= 25 THEN 'high' WHEN agrees >= 12 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN long THEN CASE WHEN ub IS NOT NULL THEN 'block' WHEN ug IS NOT NULL THEN 'gap' ELSE 'discount' END ELSE CASE WHEN db IS NOT NULL THEN 'block' WHEN dg IS NOT NULL THEN 'gap' ELSE 'premium' END END AS zone,
  round(lo, 2) AS entry_low, round(hi, 2) AS entry_high, round(ref, 2) AS entry_ref, round(st, 2) AS stop, round(t1, 2) AS target, round(t2, 2) AS target2, round(r1, 2) AS rr, round(r2, 2) AS rr2, round(rp, 2) AS risk_pct, cg AS cost_grade, valid,
  valid AND long AND cg IN ('A', 'B') AS actionable, coalesce(veto, CASE WHEN NOT ok THEN 'order' WHEN NOT valid THEN 'reward' WHEN NOT long THEN 'short' WHEN cg NOT IN ('A', 'B') THEN 'grade' END) AS reason FROM q8)"""
_COLUMNS = ("plan_id", "ticker", "date", "start_pos", "direction", "bias", "signals", "confidence", "zone", "entry_low", "entry_high", "entry_ref", "stop", "target", "target2", "rr", "rr2", "risk_pct", "cost_grade", "valid", "actionable", "reason")


def _plans(spark, sf):
    return tp.build_plans(src.bars_daily(spark, sf))


@register(f"{BARS}, {_DRAWN} SELECT * FROM pl")
def b6_trade_plans(spark, sf):
    """The plan of each bar that has a direction, with why it isn't one to act on."""
    return _plans(spark, sf).select(*_COLUMNS)


@register(f"""{BARS}, {_DRAWN}, v AS (SELECT * FROM pl WHERE valid), fl AS (SELECT v.plan_id, min(x.pos) AS fp FROM v JOIN p1 x ON x.ticker = v.ticker AND x.pos > v.start_pos AND x.pos <= v.start_pos + 20 AND CASE WHEN direction = 'long' THEN x.low <= v.entry_high ELSE x.high >= v.entry_low END GROUP BY 1),
ex AS (SELECT v.plan_id, fp, min(CASE WHEN CASE WHEN direction = 'long' THEN x.low <= stop ELSE x.high >= stop END THEN x.pos END) AS sp, min(CASE WHEN CASE WHEN direction = 'long' THEN x.high >= target ELSE x.low <= target END THEN x.pos END) AS hp FROM v JOIN fl USING (plan_id) JOIN p1 x ON x.ticker = v.ticker AND x.pos >= fp AND x.pos < fp + 40 GROUP BY 1, 2),
oc AS (SELECT v.*, fp AS fill_pos, CASE WHEN fp IS NULL THEN 'nofill' WHEN sp IS NOT NULL AND (hp IS NULL OR sp <= hp) THEN 'loss' WHEN hp IS NOT NULL THEN 'win' ELSE 'timeout' END AS outcome, CASE WHEN sp IS NOT NULL AND (hp IS NULL OR sp <= hp) THEN sp ELSE hp END AS exit_pos FROM v LEFT JOIN ex USING (plan_id)),
fx AS (SELECT oc.*, CASE WHEN fill_pos IS NULL THEN NULL WHEN direction = 'long' THEN least(f.open, entry_high) ELSE greatest(f.open, entry_low) END AS fill_price, e.open AS eo FROM oc LEFT JOIN p1 f ON f.ticker = oc.ticker AND f.pos = oc.fill_pos LEFT JOIN p1 e ON e.ticker = oc.ticker AND e.pos = oc.exit_pos),
ep AS (SELECT *, CASE outcome WHEN 'loss' THEN CASE WHEN direction = 'long' THEN least(eo, stop) ELSE greatest(eo, stop) END WHEN 'win' THEN CASE WHEN direction = 'long' THEN greatest(eo, target) ELSE least(eo, target) END ELSE fill_price END AS exit_price FROM fx)
SELECT plan_id, direction, outcome, fill_pos, exit_pos, fill_price, exit_price, round(CASE WHEN outcome IN ('win', 'loss') THEN CASE WHEN direction = 'long' THEN exit_price - fill_price ELSE fill_price - exit_price END / abs(entry_ref - stop) ELSE 0.0::DOUBLE END, 5) AS r FROM ep""")
def b8_placeable_fills(spark, sf):
    """Outcomes of all valid plans at prices that could be had: the zone's near edge or a better open, exits at the line or the open."""
    n = simulate.numbered(src.bars_daily(spark, sf))
    # The plans are read twice, and a filter on them would otherwise be pushed into what draws them.
    t = simulate.first_touch(cut(_plans(spark, sf)).where("valid"), n)
    t = t.withColumn("limit", F.when(F.col("direction") == "long", F.col("entry_high")).otherwise(F.col("entry_low")))
    return rounded(tp.placeable(t, n, "limit").select("plan_id", "direction", "outcome", "fill_pos", "exit_pos", "fill_price", "exit_price", "r"), r=5)


@register()
def b10_entry_rules(spark, sf):
    """Every setup of the walk under each of eight ways to enter."""
    return rounded(tp.entry_rules(_plans(spark, sf), simulate.numbered(src.bars_daily(spark, sf))))


@register()
def a20_rule_table(spark, sf):
    """Entry rules after costs by direction and what the entry zone is made of."""
    return rounded(tp.rule_table(tp.entry_rules(_plans(spark, sf), simulate.numbered(src.bars_daily(spark, sf))), ["rule", "direction", "zone"]), 5)
