"""Scalar formulas and banding ladders as column expressions; null and NaN both count as missing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Where rounding turns up. Means of decimals often lie on a half up to the last bits of a sum, which differ from run to run
#: with the order of its parts; a point a little off the halves rounds all of these alike.
HALF = 0.5 - 1.3e-5


def rnd(x: Column | str, digits: int) -> Column:
    """x rounded to digits, halves and what is within 1.3e-5 below them up, in plain double arithmetic; null and the infinite stay."""
    x = F.col(x) if isinstance(x, str) else x
    n = 10.0**digits
    return F.when(F.abs(x) < 1e15 / n, F.floor(x * n + (1 - HALF)) / n).otherwise(x)


def known(x: Column) -> Column:
    """x with NaN as null."""
    return F.when(~F.isnan(x), x)


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's correlation of the pairs that have both values; null where a side doesn't move, which corr() raises at."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(a) * F.stddev_pop(b))


def earnings_yield(per: Column) -> Column:
    return F.when(known(per) > 0, 100.0 / per).otherwise(0.0)


book_yield = earnings_yield


def accrual_quality(fcf: Column, net_income: Column) -> Column:
    """50 where it can't be told, 0 for a profit without cash, else the cash share of income times 50 within 0 to 100."""
    told = known(fcf).isNotNull() & (known(net_income) > 0)
    return F.when(~F.coalesce(told, F.lit(False)), 50.0).when(fcf <= 0, 0.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), fcf / net_income * 50.0)))


def value_raw(ep: Column, bp: Column, fcf_yield: Column) -> Column:
    return ep * 0.4 + bp * 0.3 + fcf_yield * 0.3


def quality_raw(roe: Column, margin: Column, accrual: Column) -> Column:
    return roe * 0.45 + margin * 0.35 + accrual * 0.20


def risk_fraction(risk_pct: Column, per_trade: float = 0.00155, most: float = 0.15) -> Column:
    """Share of capital at risk: the budget a trade or, for a narrow stop, the position's cap times the stop's percent."""
    return F.when(risk_pct > 0, F.least(F.lit(per_trade), most * risk_pct / 100)).otherwise(0.0)


def chart_score(technical: Column, momentum: Column) -> Column:
    return technical * 0.7 + momentum * 0.3


#: For each measure the scores below ascending bounds, and from the last bound on.
BELOW: dict[str, list[tuple[float, int]]] = {
    "per": [(5, 70), (15, 85), (25, 65), (40, 40), (float("inf"), 20)],
    "per_relative": [(0.5, 90), (0.7, 80), (0.9, 70), (1.1, 60), (1.3, 45), (1.5, 30), (float("inf"), 15)],
    "pbr": [(1, 85), (2, 75), (4, 55), (8, 35), (float("inf"), 20)],
    "roe_pct": [(0, 10), (5, 30), (10, 50), (20, 75), (30, 90), (float("inf"), 85)],
    "growth": [(-0.1, 10), (0, 30), (0.05, 50), (0.15, 70), (0.30, 85), (float("inf"), 95)],
    "debt_equity": [(0, 30), (0.3, 90), (0.7, 75), (1.5, 55), (3.0, 35), (float("inf"), 15)],
    "peg": [(0.5, 95), (1.0, 85), (1.5, 70), (2.0, 55), (3.0, 35), (float("inf"), 15)],
    "ev_ebitda": [(6, 90), (10, 80), (15, 65), (20, 50), (30, 30), (float("inf"), 15)],
    "roa_pct": [(0, 10), (2, 30), (5, 50), (10, 70), (15, 85), (float("inf"), 95)],
    "margin_pct": [(0, 10), (5, 40), (10, 60), (20, 80), (float("inf"), 90)],
    "range_52w_pct": [(20, 40), (35, 60), (50, 70), (65, 80), (80, 75), (90, 60), (float("inf"), 45)],
}
#: The scores above descending bounds, and at or below the last one.
ABOVE: dict[str, list[tuple[float, int]]] = {
    "fcf_yield_pct": [(10, 90), (6, 80), (3, 65), (1, 50), (0, 35), (float("-inf"), 15)],
    "interest_cover": [(15, 95), (8, 80), (4, 65), (2, 45), (1, 25), (float("-inf"), 10)],
    "drawdown_pct": [(-10, 90), (-20, 75), (-30, 55), (-40, 35), (-50, 20), (float("-inf"), 10)],
}
#: Measures that mean nothing at or below zero.
POSITIVE = {"per", "per_relative", "pbr", "peg", "ev_ebitda"}


def ladder(measure: str, x: Column) -> Column:
    """Score of a measure; 50 where it is missing or means nothing."""
    x = known(x)
    out = F.when(x.isNull() | (x <= 0 if measure in POSITIVE else F.lit(False)), 50)
    for bound, score in BELOW.get(measure) or ABOVE[measure]:
        at_end = bound in (float("inf"), float("-inf"))
        out = out.otherwise(score) if at_end else out.when(x < bound if measure in BELOW else x > bound, score)
    return out


def cost_grade(entry: Column, stop: Column) -> Column:
    """A to D by how far off the stop is, in percent of the entry."""
    risk = F.when(entry > 0, F.abs(entry - stop) / entry * 100).otherwise(0.0)
    return F.when(risk > 2.34, "A").when(risk > 1.75, "B").when(risk > 1.34, "C").otherwise("D")


def kelly(win_rate: Column, avg_win: Column, avg_loss: Column, cap: float = 0.25) -> Column:
    """Half the Kelly fraction, from 0 to the cap."""
    b = avg_win / F.abs(avg_loss)
    f = F.greatest(F.lit(0.0), (win_rate * b - (1 - win_rate)) / b) * 0.5
    return F.when((F.abs(avg_loss) == 0) | (win_rate <= 0), 0.0).otherwise(F.least(f, F.lit(cap)))


def strength_weight(signal: Column, threshold: float, top: float = 100.0) -> Column:
    span = max(top - threshold, 1e-9)
    return F.when(signal <= threshold, 0.0).otherwise(0.3 + 0.7 * F.least((signal - threshold) / span, F.lit(1.0)))


def reward_risk(direction: Column, entry: Column, stop: Column, target: Column) -> Column:
    """Reward by risk; null without a risk."""
    long = F.try_divide(target - entry, entry - stop)
    short = F.try_divide(entry - target, stop - entry)
    risk = F.when(direction == "long", entry - stop).otherwise(stop - entry)
    return F.when(risk > 0, F.when(direction == "long", long).otherwise(short))


def position_size(equity: Column, entry: Column, stop: Column, fx: Column, risk: float = 0.00155, most: float = 0.15) -> Column:
    """Whole shares within a risk budget and a share of equity."""
    by_risk = F.try_divide(equity * risk, (entry - stop) * fx)
    by_size = F.try_divide(equity * most, entry * fx)
    return F.when((entry > 0) & (entry > stop), F.greatest(F.lit(0), F.floor(F.least(by_risk, by_size)))).otherwise(0).cast("long")


def cagr(growth: Column, years: Column) -> Column:
    return F.when((growth > 0) & (years > 0), F.pow(growth, 1 / years) - 1)


def analyst_score(mean: Column) -> Column:
    """1 to 5 (best to worst) as 100 to 0; null outside."""
    return F.when(mean.between(1, 5), F.round((5 - mean) / 4 * 100, 1))


def short_ratio_score(ratio: Column) -> Column:
    return F.when(ratio >= 0, F.round(F.greatest(F.lit(0.0), 100 - F.least(ratio * 10, F.lit(100.0))), 1))


def verdict(score: Column) -> Column:
    return F.when(score >= 65, "buy").when(score <= 40, "sell").otherwise("neutral")


def parse_percent(text: Column) -> Column:
    """'+1,234.5%' as 1234.5; null for anything else."""
    return F.regexp_replace(text, "[%,+ ]", "").try_cast("double")
