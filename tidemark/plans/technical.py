"""Queries of the technical score: every bar, the last one, by regime, and what its parts have been worth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import indicators as ind
from ..operators import technical
from ..sources import tables as src
from .catalog import register, rounded
from .panel import KEYS, RECURSIVE
from .sql import O, full, rows


def _ago(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({O})"


_STATE = f"""{RECURSIVE}, c AS MATERIALIZED (SELECT ticker, date, close, row_number() OVER ({O}) AS k, close - lag(close) OVER ({O}) AS d, high - lag(high) OVER ({O}) AS up, lag(low) OVER ({O}) - low AS dn, greatest(high - low, abs(high - lag(close) OVER ({O})), abs(low - lag(close) OVER ({O}))) AS tr FROM b),
e AS (SELECT ticker, date, k, NULL::DOUBLE AS g, NULL::DOUBLE AS s, close AS f, close AS w, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS p, 0.0::DOUBLE AS m, tr AS t, 0.0::DOUBLE AS x FROM c WHERE k = 1
UNION ALL SELECT ticker, date, k, g, s, f, w, sig + 0.2::DOUBLE * (f - w - sig), p, m, t, x + (100 * abs(100 * p / (t + 1e-9) - 100 * m / (t + 1e-9)) / (100 * p / (t + 1e-9) + 100 * m / (t + 1e-9) + 1e-9) - x) / 14
FROM (SELECT c.ticker, c.date, c.k, coalesce(e.g * (13 / 14.0::DOUBLE) + greatest(d, 0) / 14, greatest(d, 0)) AS g, coalesce(e.s * (13 / 14.0::DOUBLE) + greatest(-d, 0) / 14, greatest(-d, 0)) AS s, e.f + 2.0::DOUBLE / 13 * (close - e.f) AS f, e.w + 2.0::DOUBLE / 27 * (close - e.w) AS w, e.sig,
  e.p + (CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END - e.p) / 14 AS p, e.m + (CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END - e.m) / 14 AS m, e.t + (tr - e.t) / 14 AS t, e.x FROM e JOIN c ON c.ticker = e.ticker AND c.k = e.k + 1)),
o0 AS (SELECT *, coalesce(sign(close - lag(close) OVER ({O})), 0) * volume AS v FROM b), o1 AS (SELECT *, sum(v) OVER ({O} ROWS UNBOUNDED PRECEDING) AS ob FROM o0),
i0 AS (SELECT b.*, 100 - 100 / (1 + g / CASE WHEN s = 0 THEN 1e-10 ELSE s END) AS r, e.f - e.w AS ml, sig, e.f - e.w - sig AS hist, coalesce(p / (t + 1e-9) > m / (t + 1e-9), false) AS up, x AS trend, ob FROM b JOIN e ON e.ticker = b.ticker AND e.date = b.date JOIN o1 ON o1.ticker = b.ticker AND o1.date = b.date),
i1 AS (SELECT *, {', '.join(f'{full(n, "avg(close)")} AS m{n}' for n in (20, 60, 120))}, greatest(4 * {full(20, 'stddev_samp(close)')}, CASE WHEN count(*) OVER {rows(20)} >= 20 THEN 1e-9 END) AS wide, {full(20, 'stddev_samp(close)')} AS sd, {full(20, 'avg(volume)')} AS mv, {full(20, 'max(high)')} AS top, {full(20, 'min(low)')} AS bottom, {full(14, 'min(low)')} AS lo14, {full(14, 'max(high)')} AS hi14, {full(20, 'avg(ob)')} AS obm FROM i0),
i2 AS (SELECT *, (close - lo14) / (hi14 - lo14 + 1e-9) * 100 AS fast, wide / greatest(close, 1e-9) AS nw FROM i1),
i3 AS (SELECT *, CASE WHEN count(fast) OVER {rows(3)} >= 3 THEN avg(fast) OVER {rows(3)} END AS sk, CASE WHEN count(nw) OVER {rows(20)} >= 20 THEN avg(nw) OVER {rows(20)} END AS nwm FROM i2),
i4 AS (SELECT *, CASE WHEN count(sk) OVER {rows(3)} >= 3 THEN avg(sk) OVER {rows(3)} END AS sd3, (close - (m20 - 2 * sd)) / wide AS pos, volume / CASE WHEN mv IS NOT NULL THEN greatest(mv, 1e-9) END AS loud, {_ago('close', 4)} AS c4, {_ago('close', 5)} AS c5, {_ago('close', 19)} AS c19, {_ago('close', 59)} AS c59,
  {_ago('r', 9)} AS r9, {_ago('r', 19)} AS r19, {_ago('hist', 1)} AS h1, {_ago('hist', 19)} AS h19, {_ago('ob', 4)} AS ob4, {_ago('ob', 19)} AS ob19, {_ago('top', 20)} AS top20, {_ago('bottom', 20)} AS bottom20, {', '.join(f'{_ago(f"(m20 - m60)", n)} AS x{n}' for n in (1, 2, 4))} FROM i3),
i5 AS (SELECT *, {_ago('sk', 1)} AS sk1, {_ago('sd3', 1)} AS sd1, m20 - m60 AS x0, (close - c19) / (c19 + 1e-9) * 150 + (close - c59) / (c59 + 1e-9) * 80 AS run FROM i4)"""


def _points(*rules: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for c, v in rules)


def _away(x: str) -> tuple[str, str]:
    return f"close < c19 AND {x} > {x}19", f"close > c19 AND {x} < {x}19"


def _parts(plain: bool) -> str:
    os_, ob = ("30", "70") if plain else ("CASE WHEN NOT up AND trend > 30 THEN 35 ELSE 30 END", "CASE WHEN up AND trend > 30 THEN 65 ELSE 70 END")
    extra = (lambda *rules: "0") if plain else _points
    gc, dc = "x0 > 0 AND x4 <= 0 AND trend > 20", "x0 < 0 AND x4 >= 0 AND trend > 20"
    gp, dp = "coalesce(x1 > 0 AND x2 > 0, false)", "coalesce(x1 < 0 AND x2 < 0, false)"
    hist, rr, obv = [w.replace("hist19", "h19") for w in _away("hist")], _away("r"), _away("ob")
    change = f"close / {'c5' if plain else 'c4'} - 1"
    made = {
        "ma": f"{_points(('close > m20', 20), ('close > m60', 20), ('close > m120', 20), ('m20 > m60', 20), ('m60 > m120', 20))} + {extra((f'{gc} AND {gp}', 15), (f'{dc} AND {dp}', -15), (f'{gc} AND NOT {gp}', 5), (f'{dc} AND NOT {dp}', -5))}",
        "rsi": f"CASE WHEN r > {ob} THEN 35 WHEN r > 60 AND r <= {ob} THEN 65 WHEN r >= {os_} AND r < {os_} + 10 THEN 60 WHEN r < {os_} THEN 70 ELSE 50 END + {extra((f'r - r9 > 5 AND r > {os_} AND r < {ob}', 20), ('r - r9 < -5', -10), (rr[0], 15), (rr[1], -15))}",
        "macd": f"50 + {_points(('ml > sig', 20), ('hist > 0', 15), ('hist > h1', 15), ('hist <= h1', -10))} + {extra((hist[0], 12), (hist[1], -12))}",
        "bands": f"CASE WHEN pos < 0.2 THEN 30 WHEN pos < 0.4 THEN 45 WHEN pos <= 0.8 THEN 70 WHEN pos <= 0.95 THEN 85 WHEN pos > 0.95 THEN 45 ELSE 50 END + {extra(('nw < nwm * 0.7 AND up', 10))}",
        "volume": f"CASE WHEN {change} > 0 AND loud > 1.2 THEN 80 WHEN {change} > 0 AND loud < 0.8 THEN 55 WHEN {change} < 0 AND loud > 1.2 THEN 25 WHEN {change} < 0 AND loud < 0.8 THEN 45 ELSE 50 END",
        "wave": f"CASE WHEN run IS NULL THEN 50 ELSE 50 + {_points(('top > top20', 15), ('bottom > bottom20', 15))} + greatest(-40.0, least(40.0, run)) END",
        "stochastic": f"CASE WHEN sk > 80 THEN 35 WHEN sk > 60 THEN 65 WHEN sk > 40 THEN 55 WHEN sk > 20 THEN 60 WHEN sk <= 20 THEN 70 ELSE 50 END + {extra(('sk1 < sd1 AND sk >= sd3', 20), ('sk1 > sd1 AND sk < sd3', -20))}",
        "adx": "CASE WHEN trend > 40 THEN CASE WHEN up THEN 85 ELSE 15 END WHEN trend > 25 THEN CASE WHEN up THEN 72 ELSE 28 END WHEN trend > 20 THEN CASE WHEN up THEN 58 ELSE 42 END ELSE 50 END",
        "obv": f"CASE WHEN coalesce(ob > obm, false) AND coalesce(ob > ob4, false) THEN 75 WHEN ob > obm THEN 55 WHEN ob > ob4 THEN 40 ELSE 25 END + {_points((obv[0], 20), (obv[1], -20))}",
    }
    return ", ".join(f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, ({q})::DOUBLE)) AS part_{k}" for k, q in made.items())


def _weighed(regime: str) -> str:
    return " + ".join(f"part_{x} * {w!r}" for x, w in zip(technical.PARTS, technical.WEIGHTS[regime], strict=True))


_SCORED = f"{_STATE}, pt AS (SELECT ticker, date, close, CASE WHEN count(*) OVER {rows(200)} >= 200 THEN avg(close) OVER {rows(200)} END AS m200, {_parts(False)} FROM i5)"
_REGIME = "CASE WHEN close > m200 * 1.03 THEN 'bull' WHEN close < m200 * 0.97 THEN 'bear' ELSE 'neutral' END"
_LISTED = ", ".join(f"round(part_{x}, 4) AS part_{x}" for x in technical.PARTS)


@register(f"{_SCORED} SELECT ticker, date, {_LISTED}, round({_weighed('neutral')}, 4) AS score FROM pt")
def w23_technical_scores(spark, sf):
    return rounded(technical.technical_score(src.bars_daily(spark, sf)).select(*KEYS, *[f"part_{x}" for x in technical.PARTS], "score"), 4)


@register(f"""{_SCORED}, rg AS (SELECT *, {_REGIME} AS regime, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM pt)
SELECT ticker, date, regime, {_LISTED}, round({_weighed('neutral')}, 4) AS score, round(CASE regime WHEN 'bull' THEN {_weighed('bull')} WHEN 'bear' THEN {_weighed('bear')} ELSE {_weighed('neutral')} END, 4) AS score_regime FROM rg WHERE rn = 1""")
def w24_last_scores(spark, sf):
    """Of each ticker the last bar's parts, score and the score by its regime."""
    s = technical.technical_score(ind.regime(src.bars_daily(spark, sf)), "regime")
    names = ["date", "regime", *[f"part_{x}" for x in technical.PARTS], "score", "score_regime"]
    return rounded(s.groupBy("ticker").agg(F.max(F.struct(*names)).alias("l")).select("ticker", "l.*"), 4)


_ICS = ", ".join(f"corr(part_{x}, CASE WHEN k > 20 THEN fwd END) AS c_{x}" for x in technical.PARTS)


@register(f"""{_STATE}, pl AS (SELECT ticker, date, {_parts(True)}, (lead(close, 20) OVER ({O}) / close - 1) * 100 AS fwd, row_number() OVER ({O}) AS k FROM i5),
g AS (SELECT ticker, count(CASE WHEN k > 20 THEN fwd END) AS n, {_ICS} FROM pl GROUP BY ticker),
l AS ({' UNION ALL '.join(f"SELECT ticker, '{x}' AS part, coalesce(CASE WHEN n > 20 AND NOT isnan(c_{x}) THEN c_{x} END, 0.0) AS ic FROM g" for x in technical.PARTS)}),
s AS (SELECT *, greatest(greatest(abs(ic), 0.001) / sum(greatest(abs(ic), 0.001)) OVER (PARTITION BY ticker), 0.03) AS s FROM l) SELECT ticker, part, round(ic, 5) AS ic, round(s / sum(s) OVER (PARTITION BY ticker), 5) AS weight FROM s""")
def w33_part_ics(spark, sf):
    return rounded(technical.part_ics(src.bars_daily(spark, sf)), 5)
