"""Queries of the learned signal: its features, its folds and how well it tells rises out of fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learned
from ..sources import tables as src
from .catalog import register, rounded
from .panel import KEYS, RECURSIVE
from .sql import BARS, O, full, rows

_A, _B, _C = 11 / 13, 25 / 27, 0.8
_FEATURES = f"""{RECURSIVE}, d AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER ({O}) AS k FROM b),
e AS (SELECT ticker, date, k, close AS n1, 1.0::DOUBLE AS w1, close AS n2, 1.0::DOUBLE AS w2, 0.0::DOUBLE AS n3, 1.0::DOUBLE AS w3, 0.0::DOUBLE AS m FROM d WHERE k = 1
UNION ALL SELECT ticker, date, k, n1, w1, n2, w2, n3 * {_C!r}::DOUBLE + n1 / w1 - n2 / w2, w3 * {_C!r}::DOUBLE + 1, n1 / w1 - n2 / w2 FROM (SELECT d.ticker, d.date, d.k, e.n1 * {_A!r}::DOUBLE + d.close AS n1, e.w1 * {_A!r}::DOUBLE + 1 AS w1, e.n2 * {_B!r}::DOUBLE + d.close AS n2, e.w2 * {_B!r}::DOUBLE + 1 AS w2, e.n3, e.w3 FROM e JOIN d ON d.ticker = e.ticker AND d.k = e.k + 1)),
x AS (SELECT *, close - lag(close) OVER ({O}) AS d, greatest(high - low, abs(high - lag(close) OVER ({O})), abs(low - lag(close) OVER ({O}))) AS tr, {full(5, 'avg(close)')} AS m5, {full(20, 'avg(close)')} AS m20, {full(60, 'avg(close)')} AS m60,
  {full(20, 'stddev_samp(close)')} AS sd, {full(20, 'avg(volume)')} AS mv, {full(20, 'min(low)')} AS lo, {full(20, 'max(high)')} AS hi, lag(close, 20) OVER ({O}) AS c20, lag(close, 5) OVER ({O}) AS c5 FROM b),
y AS (SELECT *, CASE WHEN count(d) OVER {rows(14)} >= 14 THEN avg(greatest(d, 0)) OVER {rows(14)} END AS g, CASE WHEN count(d) OVER {rows(14)} >= 14 THEN avg(greatest(-d, 0)) OVER {rows(14)} END AS l, {full(14, 'avg(tr)')} AS atr FROM x)
SELECT y.ticker, y.date, round((coalesce((close > m5)::INT, 0) + coalesce((m5 > m20)::INT, 0) + coalesce((m20 > m60)::INT, 0)) / 3.0::DOUBLE, 5) AS ma_align, round(g / (g + l + 1e-9) * 100, 5) AS rsi, round(e.m - e.n3 / e.w3, 4) AS macd_hist,
  round(CASE WHEN sd IS NOT NULL THEN greatest(-1.0, least(1.0, (close - m20) / (2 * sd + 1e-9))) END, 5) AS bb_pos, round(CASE WHEN mv != 0 THEN greatest(0.0, least(5.0, volume / mv)) END, 5) AS vol_ratio, round((close / c20 - 1) * 100, 5) AS mom_20, round((close / c5 - 1) * 100, 5) AS mom_5,
  round(CASE WHEN hi IS NOT NULL THEN greatest(0.0, least(1.0, (close - lo) / (hi - lo + 1e-9))) END, 5) AS hl_pos, round(CASE WHEN atr IS NOT NULL THEN greatest(0.0, least(0.1, atr / close)) * 100 END, 5) AS atr_ratio
FROM y JOIN e ON e.ticker = y.ticker AND e.date = y.date"""


@register(_FEATURES)
def w46_features(spark, sf):
    return rounded(learned.features(src.bars_daily(spark, sf)).select(*KEYS, *learned.FEATURES), 5, macd_hist=4)


@register(f"""{BARS}, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM b)),
f AS (SELECT fold, fold * n // 5 AS a, (fold + 1) * n // 5 AS z, CAST(floor(n * 0.02) AS BIGINT) AS gap FROM (SELECT max(n) AS n FROM cal), (SELECT unnest(range(5)) AS fold)),
r AS (SELECT fold, CASE WHEN pos >= a AND pos < z THEN 'test' WHEN pos >= a - 20 AND pos < z + 20 + gap THEN 'purged' ELSE 'train' END AS role, pos FROM b JOIN cal USING (date), f)
SELECT fold::INTEGER AS fold, role, count(*) AS n, min(pos) AS first_day, max(pos) AS last_day FROM r GROUP BY 1, 2""")
def i9_purged_folds(spark, sf):
    f = learned.purged_folds(src.bars_daily(spark, sf))
    return f.groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_day"), F.max("pos").cast("long").alias("last_day"))


@register()
def i11_learned_signal(spark, sf):
    """Area under the curve of each fold, out of fold. Boosted trees have no SQL; tests hold folds and areas against their definitions."""
    scored = learned.validated(src.bars_daily(spark, sf), trees=6)
    return rounded(learned.area_under_curve(scored, ["fold"]))
