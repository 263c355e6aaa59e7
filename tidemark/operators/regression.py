"""Least squares by group: one partial aggregate of products, then a small solve in expressions; no group is collected."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import correlation
from ..functions.special import student_p

SINGULAR = 1e-12  # of the product of the diagonal


def _det(m: list[list[Column]]) -> Column:
    if not m:
        return F.lit(1.0)
    out = F.lit(0.0)
    for j, x in enumerate(m[0]):
        minor = [row[:j] + row[j + 1 :] for row in m[1:]]
        out = out + (x if j % 2 == 0 else -x) * _det(minor)
    return out


def _solved(m: list[list[Column]], rhs: list[Column], det: Column) -> list[Column]:
    """Cramer's rule; for matrices of a few rows."""
    return [_det([[r if k == j else x for k, x in enumerate(row)] for row, r in zip(m, rhs, strict=True)]) / det for j in range(len(rhs))]


def fit(frame: DataFrame, by: list[str], y: str, xs: list[str], intercept: bool = True, least: int = 2) -> DataFrame:
    """by, n, b_<x> for each of xs, and with an intercept alpha, r2, t_alpha and p_alpha.

    Rows with a missing value don't count. Null with fewer than least rows or a singular matrix. At most four xs."""
    if not 1 <= len(xs) <= 4:
        raise ValueError("one to four regressors")
    clean = frame.select(*by, *[F.col(c).cast("double").alias(c) for c in (y, *xs)])
    clean = clean.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (y, *xs)))
    product = (lambda a, b: F.covar_pop(a, b)) if intercept else (lambda a, b: F.avg(F.col(a) * F.col(b)))
    pairs = list(combinations_with_replacement(range(len(xs)), 2))
    g = clean.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(y).alias("_y"), F.covar_pop(y, y).alias("_yy"), *[F.avg(x).alias(f"_m{i}") for i, x in enumerate(xs)],
        *[product(xs[i], xs[j]).alias(f"_x{i}{j}") for i, j in pairs], *[product(x, y).alias(f"_xy{i}") for i, x in enumerate(xs)],
    )
    m = [[F.col(f"_x{min(i, j)}{max(i, j)}") for j in range(len(xs))] for i in range(len(xs))]
    diagonal = F.lit(SINGULAR)
    for i in range(len(xs)):
        diagonal = diagonal * m[i][i]
    g = g.withColumn("_det", _det(m)).withColumn("_det", F.when((F.col("n") >= max(least, len(xs) + intercept)) & (F.col("_det") > diagonal), F.col("_det")))
    det = F.col("_det")
    g = g.withColumns({f"b_{x}": b for x, b in zip(xs, _solved(m, [F.col(f"_xy{i}") for i in range(len(xs))], det), strict=True)})
    if intercept:
        means = [F.col(f"_m{i}") for i in range(len(xs))]
        explained = sum((F.col(f"b_{x}") * F.col(f"_xy{i}") for i, x in enumerate(xs)), F.lit(0.0))
        g = g.withColumns({"alpha": F.col("_y") - sum((F.col(f"b_{x}") * means[i] for i, x in enumerate(xs)), F.lit(0.0)), "_rest": F.col("_yy") - explained, "_lever": 1 + sum((z * means[i] for i, z in enumerate(_solved(m, means, det))), F.lit(0.0))})
        # the squares left, by their degrees of freedom, times the intercept's share of the inverse
        free = F.col("n") - len(xs) - 1
        se = F.when(free > 0, F.sqrt(F.greatest(F.col("_rest"), F.lit(0.0)) / free * F.col("_lever")))
        g = g.withColumns({"r2": F.when(F.col("_yy") > 0, 1 - F.col("_rest") / F.col("_yy")).when(det.isNotNull(), 0.0), "t_alpha": F.when(det.isNotNull(), F.when(se > 0, F.col("alpha") / se).otherwise(0.0))})
        g = g.withColumn("p_alpha", F.when(free > 0, student_p(F.col("t_alpha"), free)).when(det.isNotNull(), 1.0))
    return g.drop(*[c for c in g.columns if c.startswith("_") and c not in by])


def style(returns: DataFrame, by: list[str], factors: list[str], year: int = 252, least: int = 30) -> DataFrame:
    """Regression of ret on factor returns: fit's columns, the yearly alpha in percent and whether it is significant."""
    f = fit(returns, by, "ret", factors, least=least)
    return f.withColumns({"alpha_year_pct": F.col("alpha") * year * 100, "significant": F.col("p_alpha") < 0.05})


def zscore(x: str, by: list[str]) -> Column:
    w = Window.partitionBy(*by)
    return (F.col(x) - F.avg(x).over(w)) / (F.stddev_pop(x).over(w) + 1e-9)


def average_rank(x: Column | str, by: list[str]) -> Column:
    """1-based ranks, ties at their mean."""
    x = F.col(x) if isinstance(x, str) else x
    same = F.count(F.lit(1)).over(Window.partitionBy(*by, x))
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (same - 1) / 2


def residual_ic(frame: DataFrame, by: list[str], signal: str, controls: list[str], forward: str, least: int = 15) -> DataFrame:
    """by, n, ic: rank correlation with forward of what the controls leave of a signal, all three as z values of their group."""
    names = [signal, *controls]
    clean = frame.where(" AND ".join(f"`{c}` IS NOT NULL AND NOT isnan(`{c}`)" for c in (*names, forward)))
    z = clean.select(*by, forward, *[zscore(c, by).alias(c) for c in names])
    b = fit(z, by, signal, controls, least=least).select(*by, "n", "alpha", *[f"b_{c}" for c in controls]).where("alpha IS NOT NULL")
    left = z.join(b, by).withColumn("_left", F.col(signal) - F.col("alpha") - sum((F.col(f"b_{c}") * F.col(c) for c in controls), F.lit(0.0)))
    ranked = left.select(*by, "n", average_rank("_left", by).alias("_a"), average_rank(forward, by).alias("_b"))
    return ranked.groupBy(*by).agg(F.first("n").alias("n"), correlation("_a", "_b").alias("ic"))


def recovered_weights(scores: DataFrame, by: list[str], parts: list[str], blend: str, most: float, least: int = 20) -> DataFrame:
    """by, n, w_<part>: the weights, of sum 1, by which three parts were blended; null if a row is off by more than most or the last weight isn't within 0 to 1."""
    a, b, c = parts
    clean = scores.where(" AND ".join(f"`{x}` IS NOT NULL" for x in (*parts, blend)))
    d = clean.select(*by, *parts, blend, (F.col(a) - F.col(c)).alias("_da"), (F.col(b) - F.col(c)).alias("_db"), (F.col(blend) - F.col(c)).alias("_dv"))
    f = fit(d.withColumnsRenamed({"_da": "da", "_db": "db", "_dv": "dv"}), by, "dv", ["da", "db"], intercept=False, least=least)
    f = f.select(*by, "n", F.col("b_da").alias(f"w_{a}"), F.col("b_db").alias(f"w_{b}"), (1 - F.col("b_da") - F.col("b_db")).alias(f"w_{c}"))
    off = clean.join(f, by).groupBy(*by).agg(F.max(F.abs(sum((F.col(x) * F.col(f"w_{x}") for x in parts), F.lit(0.0)) - F.col(blend))).alias("_off"))
    good = (F.col("_off") <= most) & F.col(f"w_{c}").between(0, 1)
    return f.join(off, by).select(*by, "n", *[F.when(good, F.col(f"w_{x}")).alias(f"w_{x}") for x in parts])
