"""Special functions as column expressions: series and continued fractions as folds of a fixed number of steps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

STEPS = 300
#: Lanczos' coefficients of log gamma for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Acklam's rational approximation of the normal quantile; numerators and denominators of the middle and the tail.
MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_FROM = 0.02425


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_gamma(x: Column) -> Column:
    """Of positive x, to about 15 digits."""
    shifted = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        shifted = shifted + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(shifted)


def _beta_fraction(x: Column, a: Column, b: Column, steps: int) -> Column:
    """The continued fraction of the incomplete beta function, from its end to its start."""

    def part(i):
        m = F.floor(i / 2)
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(i % 2 == 0, even).otherwise(odd)

    return 1 / (1 + F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), F.lit(0.0), lambda v, i: part(i) / (1 + v)))


def beta_inc(x: Column, a: Column, b: Column, steps: int = STEPS) -> Column:
    """Regularised incomplete beta function for x within 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    direct = front * _beta_fraction(x, a, b, steps) / a
    mirrored = 1 - front * _beta_fraction(1 - x, b, a, steps) / b
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x < (a + 1) / (a + b + 2), direct).otherwise(mirrored)


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p of Student's t."""
    n = freedom.cast("double")
    return _let(F.struct(t.alias("t"), n.alias("n")), lambda s: beta_inc(s["n"] / (s["n"] + s["t"] * s["t"]), s["n"] / 2, F.lit(0.5)))


def normal_cdf(z: Column, steps: int = STEPS) -> Column:
    """Standard normal distribution function: a series up to 3, beyond it a continued fraction; relative error below 1e-12."""

    def body(x):
        term = F.struct(x.alias("t"), x.alias("s"))
        add = lambda s, k: _let(s["t"] * x * x / (2 * k + 1), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
        density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        series = 0.5 + density * F.aggregate(F.sequence(F.lit(1), F.lit(steps)), term, add, lambda s: s["s"])
        tail = density / (F.abs(x) + F.aggregate(F.sequence(F.lit(200), F.lit(1), F.lit(-1)), F.lit(0.0), lambda v, k: k / (F.abs(x) + v)))
        return F.when(F.abs(x) <= 3, series).when(x > 0, 1 - tail).otherwise(tail)

    return _let(z, body)


def _ratio(x: Column, numerator, denominator) -> Column:
    def poly(cs):
        p = F.lit(cs[0])
        for c in cs[1:]:
            p = p * x + c
        return p

    return poly(numerator) / poly(denominator)


def normal_quantile(p: Column) -> Column:
    """z with normal_cdf(z) = p, by a rational approximation and two of Newton's steps; null outside 0 to 1."""
    tail = lambda q: _let(F.sqrt(-2 * F.log(q)), lambda r: _ratio(r, *TAIL))
    middle = _let(p - 0.5, lambda q: q * _ratio(q * q, *MIDDLE))
    start = F.when((p <= 0) | (p >= 1), F.lit(None).cast("double")).when(p < TAIL_FROM, tail(p)).when(p > 1 - TAIL_FROM, -tail(1 - p)).otherwise(middle)
    newton = lambda z: z - (normal_cdf(z) - p) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
    return _let(_let(start, newton), newton)


def deflated_sharpe(sharpe: Column, trials: Column, n: Column, skew: Column, kurtosis: Column, benchmark: float = 0.0) -> Column:
    """Probability that a Sharpe ratio per period is above the best one of as many trials without skill over n periods."""
    gamma = 0.5772156649
    many = F.greatest(trials, F.lit(1)).cast("double")
    best = ((1 - gamma) * normal_quantile(1 - 1 / many) + gamma * normal_quantile(1 - 1 / (many * math.e))) / F.sqrt(n)
    best = F.when(many > 1, best).otherwise(0.0) + benchmark
    spread = F.sqrt(F.greatest((1 - skew * sharpe + (kurtosis - 1) / 4 * sharpe * sharpe) / (n - 1), F.lit(1e-12)))
    return F.when(n > 1, normal_cdf((sharpe - best) / spread))


def internal_rate(monthly: Column, n: Column, equity: Column, steps: int = 200) -> Column:
    """Yearly rate in percent at which n monthly deposits, the first one now, grow to the equity after n months; by halvings from -0.99 to 1 a month."""

    def worth(r):
        v = 1 / (1 + r)
        deposits = F.when(F.abs(r) < 1e-12, n.cast("double")).otherwise((1 - F.pow(v, n)) / (1 - v))
        return equity * F.pow(v, n) - monthly * deposits

    def halve(s, _):
        return _let((s["lo"] + s["hi"]) / 2, lambda mid: _let(worth(mid) > 0, lambda up: F.struct(F.when(up, mid).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(mid).alias("hi"))))

    start = F.struct(F.lit(-0.99).alias("lo"), F.lit(1.0).alias("hi"))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: s["lo"])
    return F.when(n > 0, (F.pow(1 + low, F.lit(12)) - 1) * 100)


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2x2 table: the sum over all tables of its margins that are no likelier. As many steps as the least margin has."""
    lf = lambda k: log_gamma(k.cast("double") + 1)

    def body(s):
        r1, r2, c1 = s["a"] + s["b"], s["c"] + s["d"], s["a"] + s["c"]
        fixed = lf(r1) + lf(r2) + lf(c1) + lf(s["b"] + s["d"]) - lf(r1 + r2)
        logp = lambda x: fixed - lf(x) - lf(r1 - x) - lf(c1 - x) - lf(r2 - c1 + x)
        least = F.greatest(F.lit(0).cast("long"), c1 - r2)
        return _let(logp(s["a"]), lambda seen: F.least(F.lit(1.0), F.aggregate(F.sequence(least, F.least(r1, c1)), F.lit(0.0), lambda t, x: t + F.when(logp(x) <= seen + 1e-7, F.exp(logp(x))).otherwise(0.0))))

    return _let(F.struct(*[x.cast("long").alias(n) for x, n in ((a, "a"), (b, "b"), (c, "c"), (d, "d"))]), body)
