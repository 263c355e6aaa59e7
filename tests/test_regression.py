"""Regressions by group and special functions against numpy, Python's own functions and published values."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import special
from tidemark.operators import regression


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_three_factors_match_a_solve(spark):
    rng = random.Random(1)
    rows = []
    for g in range(4):
        for i in range(80):
            a, b = rng.gauss(0, 1), rng.gauss(0, 2)
            c = rng.gauss(0, 1) + 0.5 * a
            rows.append((f"g{g}", 0.3 * g + 2 * a - b + 0.1 * c + rng.gauss(0, 0.5), a, b, c))
    rows += [("g0", None, 1.0, 1.0, 1.0), ("g0", 1.0, float("nan"), 1.0, 1.0)]
    rows += [("same", float(i), float(i), 2.0 * i, 1.0 * (i % 3)) for i in range(50)]  # collinear
    rows += [("few", rng.random(), rng.random(), rng.random(), rng.random()) for _ in range(29)]
    got = {x.g: x for x in regression.style(spark.createDataFrame(rows, "g string, ret double, a double, b double, c double"), ["g"], ["a", "b", "c"]).collect()}
    for g in range(4):
        m = np.array([r[1:] for r in rows if r[0] == f"g{g}" and r[1] is not None and not math.isnan(r[2])])
        x = np.column_stack([np.ones(len(m)), m[:, 1:]])
        beta = np.linalg.solve(x.T @ x, x.T @ m[:, 0])
        rest = m[:, 0] - x @ beta
        se = math.sqrt(rest @ rest / (len(m) - 4) * np.linalg.inv(x.T @ x)[0, 0])
        y = got[f"g{g}"]
        assert y.n == len(m)
        assert (y.alpha, y.b_a, y.b_b, y.b_c) == pytest.approx(beta)
        assert (y.r2, y.t_alpha) == pytest.approx((1 - rest @ rest / ((m[:, 0] - m[:, 0].mean()) ** 2).sum(), beta[0] / se))
        assert y.significant == (y.p_alpha < 0.05)
    for g in ("same", "few"):
        assert (got[g].alpha, got[g].b_a, got[g].t_alpha, got[g].p_alpha) == (None,) * 4


def test_residual_rank_correlation(spark):
    rng = random.Random(2)
    rows = [(d, rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(9))) for d in range(3) for _ in range(14 + d)]
    got = {x.d: x for x in regression.residual_ic(spark.createDataFrame(rows, "d int, s double, a double, b double, fwd double"), ["d"], "s", ["a", "b"], "fwd").collect()}
    assert set(got) == {1, 2}  # fifteen names at least

    def ranks(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for d in (1, 2):
        m = np.array([r[1:] for r in rows if r[0] == d])
        z = (m[:, :3] - m[:, :3].mean(0)) / (m[:, :3].std(0) + 1e-9)
        x = np.column_stack([np.ones(len(z)), z[:, 1:]])
        rest = z[:, 0] - x @ np.linalg.lstsq(x, z[:, 0], rcond=None)[0]
        assert got[d].ic == pytest.approx(np.corrcoef(ranks(rest), ranks(m[:, 3]))[0, 1])


def test_weights_are_recovered(spark):
    rng = random.Random(3)
    def day(d, w, n=30, noise=0.0):
        return [(d, c, q, i, w[0] * c + w[1] * q + w[2] * i + rng.uniform(-noise, noise)) for c, q, i in ([rng.uniform(20, 80) for _ in range(3)] for _ in range(n))]
    rows = day("good", (0.5, 0.3, 0.2)) + day("rounded", (0.4, 0.4, 0.2), noise=0.05) + day("noisy", (0.5, 0.3, 0.2), noise=5) + day("short", (0.5, 0.3, 0.2), n=19) + day("outside", (0.9, 0.6, -0.5))
    got = {x.d: x for x in regression.recovered_weights(spark.createDataFrame(rows, "d string, chart double, quant double, ict double, verdict double"), ["d"], ["chart", "quant", "ict"], "verdict", 0.2).collect()}
    assert (got["good"].w_chart, got["good"].w_quant, got["good"].w_ict) == pytest.approx((0.5, 0.3, 0.2))
    assert got["rounded"].w_ict == pytest.approx(0.2, abs=0.01)
    assert [got[d].w_ict for d in ("noisy", "short", "outside")] == [None, None, None]


def test_log_gamma_and_normal(spark):
    xs = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 12345.5]
    zs = [-9.0, -7.01, -6.9, -3.3, -1.0, -1e-3, 0.0, 0.7, 2.5, 6.99, 7.5]
    ps = [1e-9, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.98, 1 - 1e-6]
    df = spark.createDataFrame([(x,) for x in xs + zs + ps], "x double")
    for x, y in df.where(F.col("x") > 0).select("x", special.log_gamma(F.col("x"))).collect():
        assert y == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)
    for x, y in df.select("x", special.normal_cdf(F.col("x"))).collect():
        assert y == pytest.approx(0.5 * math.erfc(-x / math.sqrt(2)), rel=1e-9, abs=1e-15)
    for x, y in df.where("x > 0 AND x < 1").select("x", special.normal_quantile(F.col("x"))).collect():
        assert y == pytest.approx(NormalDist().inv_cdf(x), abs=1e-8)
    assert value(spark, special.normal_quantile(F.lit(1.0))) is None


def test_student_p(spark):
    # closed forms for 1, 2 and 4 degrees of freedom, and the normal for many
    cases = [(1, t, 1 - 2 / math.pi * math.atan(t)) for t in (0.1, 1.0, 12.706)] + [(2, t, 1 - t / math.sqrt(2 + t * t)) for t in (0.5, 4.303)]
    cases += [(4, t, 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))) for t in (0.0, 2.776, 30.0)]
    for n, t, p in cases:
        for sign in (1, -1):
            assert value(spark, special.student_p(F.lit(sign * t), F.lit(n))) == pytest.approx(p, abs=1e-10)
    assert value(spark, special.student_p(F.lit(1.96), F.lit(10**6))) == pytest.approx(math.erfc(1.96 / math.sqrt(2)), abs=1e-6)


def test_fisher(spark):
    def exact(a, b, c, d):
        r, s, n = a + b, a + c, a + b + c + d
        p = {x: math.comb(r, x) * math.comb(n - r, s - x) / math.comb(n, s) for x in range(max(0, s - n + r), min(r, s) + 1)}
        return sum(v for v in p.values() if v <= p[a] * (1 + 1e-7))

    for t in [(8, 2, 1, 5), (0, 3, 4, 0), (10, 10, 10, 10), (1, 0, 0, 0), (0, 0, 0, 0), (120, 80, 95, 110)]:
        assert value(spark, special.fisher_exact(*map(F.lit, t))) == pytest.approx(exact(*t), abs=1e-9)


def test_internal_rate(spark):
    for monthly, n, rate in ((100.0, 24, 0.01), (714.0, 60, -0.004), (50.0, 1, 0.02)):
        equity = sum(monthly * (1 + rate) ** (n - i) for i in range(n))
        assert value(spark, special.internal_rate(F.lit(monthly), F.lit(n), F.lit(equity))) == pytest.approx(((1 + rate) ** 12 - 1) * 100, abs=1e-7)
    assert value(spark, special.internal_rate(F.lit(10.0), F.lit(12), F.lit(120.0))) == pytest.approx(0, abs=1e-7)


def test_deflated_sharpe(spark):
    nd = NormalDist()
    for sr, trials, n, skew, kurt in ((0.1, 20, 500, 0.0, 3.0), (0.02, 1, 100, -1.0, 8.0), (0.3, 1000, 2500, 0.5, 4.0)):
        best = ((1 - 0.5772156649) * nd.inv_cdf(1 - 1 / trials) + 0.5772156649 * nd.inv_cdf(1 - 1 / (trials * math.e))) / math.sqrt(n) if trials > 1 else 0.0
        want = nd.cdf((sr - best) / math.sqrt(max((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1), 1e-12)))
        got = value(spark, special.deflated_sharpe(F.lit(sr), F.lit(trials), F.lit(n), F.lit(skew), F.lit(kurt)))
        assert got == pytest.approx(want, abs=1e-8)
