"""Resampling, permutation and closed-form tests; replicates are the parallel dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def block_bootstrap(series: DataFrame, value: str, order: str, reps: int = 2000, block: int = 20, seed: int = 7) -> DataFrame:
    """rep and mean: circular block bootstrap of a series. Starts are hashes of (seed, rep, block), so a lost task redraws the same ones.

    Each replicate needs block sums only: they come from one window over the doubled series, and a replicate joins its starts."""
    spark = series.sparkSession
    s = series.where(F.col(value).isNotNull()).select(F.col(order).alias("_o"), F.col(value).cast("double").alias("v"))
    s = s.withColumn("i", F.row_number().over(Window.orderBy("_o")) - 1)
    n = s.count()
    if not n:
        return spark.createDataFrame([], "rep long, mean double")
    blocks = math.ceil(n / block)
    last = n - (blocks - 1) * block  # the last block is cut to the series' length
    ring = s.unionByName(s.withColumn("i", F.col("i") + n))
    w = Window.orderBy("i")
    sums = ring.select("i", F.sum("v").over(w.rowsBetween(0, block - 1)).alias("full"), F.sum("v").over(w.rowsBetween(0, last - 1)).alias("part")).where(F.col("i") < n)
    draws = spark.range(reps).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    draws = draws.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "rep", "b"), F.lit(n)).cast("int"))
    got = draws.join(sums, "i").withColumn("s", F.when(F.col("b") == blocks - 1, F.col("part")).otherwise(F.col("full")))
    return got.groupBy("rep").agg((F.sum("s") / n).alias("mean"))


def interval(replicates: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return replicates.agg(F.percentile("mean", F.lit(low)).alias("low"), F.percentile("mean", F.lit(high)).alias("high"), F.stddev_samp("mean").alias("se"))


def sign_flip_test(trades: DataFrame, pnl: str, key: str, reps: int = 2000, seed: int = 7) -> DataFrame:
    """observed mean and p: share of replicates with hashed signs whose mean is at least as large.

    Trades meet replicates in blocks: each trade row adds to an array of partial sums, which are aggregated before the shuffle."""
    signs = F.transform(F.sequence(F.lit(0), F.lit(reps - 1)), lambda r: F.when(F.pmod(F.xxhash64(F.lit(seed), r, F.col(key)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    exploded = trades.where(F.col(pnl).isNotNull()).select(pnl, F.posexplode(signs).alias("rep", "sign"))
    rep = exploded.groupBy("rep").agg(F.avg(F.col("sign") * F.col(pnl)).alias("m"))
    seen = trades.agg(F.avg(pnl).alias("observed"), F.count(pnl).alias("n"))
    return rep.join(F.broadcast(seen)).agg(F.first("observed").alias("observed"), F.first("n").alias("n"), F.avg((F.col("m") >= F.col("observed")).cast("double")).alias("p"))


def permuted_within(frame: DataFrame, column: str, by: list[str], key: str, seed: int) -> DataFrame:
    """frame with a column permuted among the rows of a key: places in one hashed order take the values of another."""
    w = Window.partitionBy(*by)
    a = frame.withColumn("_i", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), key), key)))
    b = frame.select(*by, F.col(column).alias("_v"), F.row_number().over(w.orderBy(key)).alias("_i"))
    return a.join(b, [*by, "_i"]).withColumn(column, F.col("_v")).drop("_i", "_v")


def purged_folds(frame: DataFrame, order: str, folds: int = 5, horizon: int = 20, embargo: float = 0.02) -> DataFrame:
    """(fold, pos, role): each row's part in each fold; rows whose label reaches into the test part, or that follow it too closely, are purged."""
    n = frame.count()
    s = frame.withColumn("pos", F.row_number().over(Window.orderBy(order)) - 1)
    size = max(1, n // folds)
    gap = int(n * embargo)
    f = s.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    a, b = F.col("fold") * size, F.when(F.col("fold") == folds - 1, n).otherwise((F.col("fold") + 1) * size)
    role = F.when((F.col("pos") >= a) & (F.col("pos") < b), "test").when((F.col("pos") < a) & (F.col("pos") + horizon >= a), "purged").when((F.col("pos") >= b) & (F.col("pos") < b + gap), "purged").otherwise("train")
    return f.withColumn("role", role)


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function: error below 1.5e-7, from a rational approximation of erf."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erf = 1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-x * x)
    return 0.5 * (1 + F.signum(z) * erf)


def decay_z(returns: DataFrame, mean: float, sd: float, window: int = 60) -> DataFrame:
    """Rolling mean against a baseline, as a z value and its lower normal tail."""
    w = Window.orderBy("date").rowsBetween(-(window - 1), 0)
    z = (F.avg("ret").over(w) - mean) / (sd / math.sqrt(window))
    f = returns.withColumn("z", F.when(F.count("ret").over(w) >= window, z))
    return f.withColumn("p", normal_cdf(F.col("z")))


def monte_carlo(starts: DataFrame, days: int = 60, sims: int = 500, seed: int = 7) -> DataFrame:
    """ticker, day and percentiles of geometric Brownian paths of each row (ticker, start, mu, sigma); draws are hashed by
    (seed, ticker, path, day), so a lost task redraws the same ones."""
    grid = starts.withColumn("sim", F.explode(F.sequence(F.lit(1), F.lit(sims)))).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "ticker", "sim", "day"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1))
    path = F.sum(F.col("mu") - F.col("sigma") * F.col("sigma") / 2 + F.col("sigma") * z).over(Window.partitionBy("ticker", "sim").orderBy("day"))
    p = grid.withColumn("price", F.col("start") * F.exp(path))
    return p.groupBy("ticker", "day").agg(*[F.percentile("price", F.lit(q)).alias(f"p{int(q * 100)}") for q in (0.05, 0.25, 0.5, 0.75, 0.95)])
