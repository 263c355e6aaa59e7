"""Factor snapshots across the names of a date, their information coefficients out of sample, and definitions held against one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cross_section import plain_z, spearman_ic
from .indicators import by_time, momentum, volatility

FACTORS = ("mom_3m", "mom_1m", "low_vol", "value", "quality")
PRODUCTION = ("mom_12_1", "low_vol_252")
#: Bars of history that a name needs, and that the production definitions need; shares of value and quality.
LEAST_BARS, LEAST_PRODUCTION = 65, 253
EARNINGS, CASH = 0.4 / 0.7, 0.3 / 0.7
ROE, MARGIN, ACCRUAL = 0.45, 0.35, 0.20


def month_ends(bars: DataFrame) -> DataFrame:
    """The last trading day of each month: a row a month."""
    return bars.groupBy(F.trunc("date", "month").alias("_m")).agg(F.max("date").alias("date")).select("date")


def snapshots(bars: DataFrame, ratios: DataFrame, days: DataFrame, least: int = 5) -> DataFrame:
    """ticker, date and the z values of FACTORS and PRODUCTION on the given days (few rows), among names with enough bars; days of fewer than least names go.

    bars: ticker, date, close; ratios: ticker, date, pe, fcf_yield, roe, margin, accrual_q as known on the date. An unknown ratio
    counts as the mean; a name too young for a production definition has none, so that it isn't taken for a neutral one."""
    own = bars.select("ticker", "date", "close").withColumn("_k", F.row_number().over(by_time()))
    for name, lookback, skip in (("mom_3m", 64, 0), ("mom_1m", 22, 0), ("mom_12_1", 252, 21)):
        own = momentum(own, lookback, skip).withColumnRenamed("momentum", f"_{name}")
    for name, window in (("low_vol", 21), ("low_vol_252", 252)):
        own = volatility(own, window).withColumnRenamed("vol", f"_{name}")
    old = F.col("_k") >= LEAST_PRODUCTION
    at = own.join(F.broadcast(days), "date").where(F.col("_k") >= LEAST_BARS).withColumns({f"_{x}": F.when(old, F.col(f"_{x}")) for x in PRODUCTION})
    at = at.join(ratios.select("ticker", "date", "pe", "fcf_yield", "roe", "margin", "accrual_q"), ["ticker", "date"], "left")
    day = Window.partitionBy("date")
    at = at.withColumn("_names", F.count(F.lit(1)).over(day)).where(F.col("_names") >= least)
    z = lambda c, sign=1.0: sign * (F.col(c) - F.avg(c).over(day)) / (F.stddev_samp(c).over(day) + 1e-9)
    few = lambda c, x: F.when(F.count(c).over(day) >= 3, x)
    p = lambda c, sign=1.0: plain_z(c, ["date"], sign)
    return at.select(
        "ticker", "date", z("_mom_3m").alias("mom_3m"), z("_mom_1m").alias("mom_1m"), z("_low_vol", -1.0).alias("low_vol"), (p("pe", -1.0) * EARNINGS + p("fcf_yield") * CASH).alias("value"),
        (p("roe") * ROE + p("margin") * MARGIN + p("accrual_q") * ACCRUAL).alias("quality"), few("_mom_12_1", z("_mom_12_1")).alias("mom_12_1"), few("_low_vol_252", z("_low_vol_252", -1.0)).alias("low_vol_252"),
    )


def forwards(bars: DataFrame, horizon: int = 21) -> DataFrame:
    """ticker, date, fwd in percent and until, the day of the bar that it ends on."""
    w = by_time()
    return bars.select("ticker", "date", ((F.lead("close", horizon).over(w) / F.col("close") - 1) * 100).alias("fwd"), F.lead("date", horizon).over(w).alias("until")).where("fwd IS NOT NULL")


def factor_ics(snapshots: DataFrame, forwards: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """date, factor, until, n and ic: rank correlations of each factor with what came after."""
    rows = snapshots.select("ticker", "date", F.inline(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("z")) for f in factors])))
    both = rows.join(forwards, ["ticker", "date"])
    ends = both.groupBy("date").agg(F.max("until").alias("until"))
    return spearman_ic(both, "z", "fwd", ["date", "factor"]).join(ends, "date")


def out_of_sample(ics: DataFrame, train_until: Column, floor: float = 0.005) -> DataFrame:
    """factor, train_ic, test_ic, n_train, n_test, weight, and on each row train_composite, test_composite and overfit.

    Dates whose returns end by train_until train; those after it test; those between see both and count for neither. Weights are the
    training means, floored and made to sum to 1; overfit: the composite is over 0.01 in training and less than half of it in the test."""
    part = F.when(F.col("until") <= train_until, "train").when(F.col("date") > train_until, "test")
    mean, n = (lambda k: F.coalesce(F.avg(F.when(part == k, F.col("ic"))), F.lit(0.0))), (lambda k: F.count(F.when(part == k, F.col("ic"))))
    g = ics.groupBy("factor").agg(mean("train").alias("train_ic"), mean("test").alias("test_ic"), n("train").alias("n_train"), n("test").alias("n_test"))
    every = Window.partitionBy(F.lit(0))  # a row a factor
    g = g.withColumn("_w", F.greatest("train_ic", F.lit(floor))).withColumn("weight", F.col("_w") / F.sum("_w").over(every)).drop("_w")
    g = g.withColumns({f"{k}_composite": F.sum(F.col("weight") * F.col(f"{k}_ic")).over(every) for k in ("train", "test")})
    return g.withColumn("overfit", (F.col("train_composite") > 0.01) & (F.col("test_composite") < F.col("train_composite") * 0.5))
