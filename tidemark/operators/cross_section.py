"""Scores across the names of a date: z-scores, ranks, quintiles, information coefficients and the weights they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import correlation

#: Production factor weights.
WEIGHTS = {"momentum": 0.30, "value": 0.25, "quality": 0.25, "low_vol": 0.20}
MEAN, SIGMA, LOW, HIGH = 50.0, 15.0, 20.0, 80.0


def winsorised_score(frame: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """Score 20 to 80 of a column among the rows with the same keys: clipped at its 1st and 99th percentile, then standardised."""
    w = Window.partitionBy(*by)
    f = frame.withColumns({"_lo": F.percentile(column, F.lit(0.01)).over(w), "_hi": F.percentile(column, F.lit(0.99)).over(w)})
    f = f.withColumn("_c", F.when(F.col(column).isNotNull(), F.greatest("_lo", F.least("_hi", F.col(column)))))
    mean, sd = F.avg("_c").over(w), F.stddev_samp("_c").over(w)
    z = (F.col("_c") - mean) / sd * SIGMA + MEAN
    # greatest() and least() skip nulls, so an unknown value is told apart first: it scores the middle
    score = F.when(sd.isNull() | (sd < 1e-9) | z.isNull(), MEAN).otherwise(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), z)))
    return f.withColumn(out, score).drop("_lo", "_hi", "_c")


def sector_score(frame: DataFrame, column: str, by: list[str], sector: str, out: str, least: int = 3) -> DataFrame:
    """winsorised_score within the sector; sectors of fewer than `least` rows take the score among all."""
    f = winsorised_score(winsorised_score(frame, column, by, "_all"), column, [*by, sector], "_own")
    members = F.count(F.lit(1)).over(Window.partitionBy(*by, sector))
    return f.withColumn(out, F.when(members >= least, F.col("_own")).otherwise(F.col("_all"))).drop("_all", "_own")


def plain_z(column: str, by: list[str], sign: float = 1.0) -> Column:
    """Guarded z-score: 0 for nulls and where fewer than three values are known."""
    w = Window.partitionBy(*by)
    z = (F.col(column) - F.avg(column).over(w)) / (F.stddev_samp(column).over(w) + 1e-9)
    return F.when(F.count(column).over(w) < 3, 0.0).otherwise(F.coalesce(z, F.lit(0.0))) * sign


def min_max(column: str, by: list[str], low: float = LOW, high: float = HIGH) -> Column:
    """Linear map of the range among the rows with the same keys to low..high; the middle where there is no range."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(column).over(w), F.max(column).over(w)
    return F.when(hi - lo < 1e-9, (low + high) / 2).otherwise(low + (F.col(column) - lo) / (hi - lo) * (high - low))


def composite(frame: DataFrame, weights: dict[str, float], by: list[str], tie: str = "ticker", normalise: bool = True) -> DataFrame:
    """Weighted sum of score columns and its rank, 1 for the best; ties by name."""
    total = sum(weights.values()) or 1.0
    c = sum((F.col(k) * (v / total if normalise else v) for k, v in weights.items()), F.lit(0.0))
    f = frame.withColumn("composite", c)
    return f.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("composite").desc(), tie)))


def average_rank(column: str, by: list[str]) -> Column:
    """Rank with ties at their mean, as rank correlation needs it."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, column)) - 1) / 2.0


def spearman_ic(frame: DataFrame, score: str, forward: str, by: list[str], least: int = 5) -> DataFrame:
    """by, n and ic: rank correlation per key; keys of fewer than `least` pairs or a constant side go."""
    f = frame.where(F.col(score).isNotNull() & F.col(forward).isNotNull())
    ranked = f.withColumns({"_a": average_rank(score, by), "_b": average_rank(forward, by)})
    out = ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_a", "_b").alias("ic"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"))
    return out.where((F.col("n") >= least) & (F.col("_sa") > 0) & (F.col("_sb") > 0)).drop("_sa", "_sb")


def ic_summary(ics: DataFrame, by: list[str], population: bool = False) -> DataFrame:
    """Mean, deviation, ratio, t and share of positive ICs."""
    sd = F.stddev_pop("ic") if population else F.stddev_samp("ic")
    f = ics.groupBy(*by).agg(F.count("ic").alias("n"), F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), (F.count_if(F.col("ic") > 0) / F.count("ic")).alias("positive"))
    return f.withColumns({"icir": F.try_divide(F.col("mean_ic"), F.col("std_ic")), "t": F.try_divide(F.col("mean_ic"), F.col("std_ic")) * F.sqrt("n")})


def quintiles(frame: DataFrame, score: str, by: list[str], tie: str = "ticker") -> DataFrame:
    """quintile 1 (best) to 5: fifths of floor(n / 5) names, the rest in the fifth."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    rn = F.row_number().over(w.orderBy(F.col(score).desc(), tie))
    return frame.withColumn("quintile", (F.least(F.floor((rn - 1) / F.greatest(F.lit(1), F.floor(n / 5))), F.lit(4)) + 1).cast("int"))


def top_k(frame: DataFrame, score: str, by: list[str], k: int, tie: str = "ticker") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.col(score).desc_nulls_last(), tie)
    return frame.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def universe(caps: DataFrame, exclude: int = 1000, size: int = 2000) -> DataFrame:
    """Ranks by market cap per date, without the first `exclude` and beyond `size` more."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col("mktcap").desc(), "ticker"))
    return caps.withColumn("rank", rank).where((F.col("rank") > exclude) & (F.col("rank") <= exclude + size))


def newey_west(series: DataFrame, value: str, order: str, by: list[str], lag: int) -> DataFrame:
    """n, mean and the standard error of the mean with Bartlett weights up to a lag; 0 where the variance turns negative."""
    w = Window.partitionBy(*by)
    d = series.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.avg(value).over(w))
    at = w.orderBy(order)
    sums = [F.sum(F.col("_d") * F.col("_d")).alias("_g0"), F.count("*").alias("n"), F.avg(value).alias("mean"), *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_g{k}") for k in range(1, lag + 1)]]
    d = d.withColumns({f"_p{k}": F.col("_d") * F.lag("_d", k).over(at) for k in range(1, lag + 1)}) if lag else d
    g = d.groupBy(*by).agg(*sums)
    total = sum((F.lit(2.0 * (1 - k / (lag + 1.0))) * F.col(f"_g{k}") / (F.col("n") - 1) for k in range(1, lag + 1)), F.col("_g0") / (F.col("n") - 1))
    return g.where("n >= 2").withColumn("se", F.when(total <= 0, 0.0).otherwise(F.sqrt(total / F.col("n")))).select(*by, "n", "mean", "se")


def analyst_scorecard(ics: DataFrame, by: str, lag: int) -> DataFrame:
    """Mean IC, robust error, t, effective n and hit share per analyst; withheld when there are at most 2 * lag dates."""
    nw = newey_west(ics, "ic", "date", [by], lag)
    plain = ics.groupBy(by).agg((F.stddev_samp("ic") / F.sqrt(F.count("ic"))).alias("plain"), (F.count_if(F.col("ic") > 0) / F.count("ic")).alias("hit"))
    eff = F.least(F.col("n").cast("double"), F.col("n") * F.pow(F.try_divide(F.col("plain"), F.col("se")), 2))
    return nw.join(plain, by).where(F.col("n") > 2 * lag).select(by, "n", "mean", "se", F.try_divide(F.col("mean"), F.col("se")).alias("t"), eff.alias("effective_n"), "hit")


def walk_forward(ics: DataFrame, min_periods: int = 12, floor: float = 0.005) -> DataFrame:
    """Of each period the weighted IC, with weights from the earlier periods' mean ICs, floored and normalised."""
    past = Window.partitionBy("factor").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    w = ics.withColumns({"_m": F.avg("ic").over(past), "_n": F.count("ic").over(past)}).where(F.col("_n") >= min_periods)
    w = w.withColumn("_f", F.greatest(F.col("_m"), F.lit(floor)))
    w = w.withColumn("weight", F.col("_f") / F.sum("_f").over(Window.partitionBy("period")))
    return w.groupBy("period").agg(F.sum(F.col("weight") * F.col("ic")).alias("oos_ic"), F.sum("weight").alias("weights"), F.count("*").alias("n_factors"))


def regime_weights(base: DataFrame, ics: DataFrame, floor: float = 0.005) -> DataFrame:
    """(regime, factor, weight): base weights times floored ICs, normalised in the regime; factors without an IC get 0."""
    both = base.join(ics, "factor", "left").withColumn("_w", F.when(F.col("ic").isNotNull(), F.col("weight") * F.greatest(F.col("ic"), F.lit(floor))).otherwise(0.0))
    total = F.sum("_w").over(Window.partitionBy("regime"))
    return both.select("regime", "factor", F.when(total > 0, F.col("_w") / total).otherwise(0.0).alias("weight"))


def consolidate(reports: DataFrame, by: list[str], buy: float = 65, sell: float = 40) -> DataFrame:
    """Weighted mean, votes and agreement of the analysts' scores (columns score and weight) per key."""
    verdict = F.when(F.col("score") >= buy, "buy").when(F.col("score") <= sell, "sell").otherwise("neutral")
    f = reports.where("score IS NOT NULL").withColumn("_v", verdict)
    g = f.groupBy(*by).agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("score"), F.count_if(F.col("_v") == "buy").alias("buys"), F.count_if(F.col("_v") == "sell").alias("sells"), F.count("*").alias("n"))
    majority = F.when(F.col("buys") >= 0.6 * F.col("n"), "buy").when(F.col("sells") >= 0.6 * F.col("n"), "sell").otherwise("neutral")
    most = F.greatest("buys", "sells", F.col("n") - F.col("buys") - F.col("sells"))
    return g.withColumns({"majority": majority, "agreement": most / F.col("n")})


def combine_required(scores: DataFrame, slugs: list[str]) -> DataFrame:
    """Mean of the required slugs per date and ticker; rows that lack one go."""
    s = scores.where(F.col("slug").isin(slugs) & F.col("score").isNotNull()).groupBy("date", "ticker").agg(F.avg("score").alias("score"), F.count_distinct("slug").alias("_n"))
    return s.where(F.col("_n") == len(slugs)).drop("_n")


def hit_rate(verdicts: DataFrame) -> DataFrame:
    """Hits of buy and sell verdicts (columns date, score, ret), with a 95 % range clustered by date."""
    v = verdicts.where("score IS NOT NULL AND ret IS NOT NULL").withColumn("_v", F.when(F.col("score") >= 65, 1).when(F.col("score") <= 40, -1).otherwise(0))
    day = v.groupBy("date").agg(F.count_if(F.col("_v") * F.col("ret") > 0).alias("h"), F.count_if(F.col("_v") != 0).alias("n"), F.count_if(F.col("_v") == 1).alias("b"), F.count_if(F.col("_v") == -1).alias("s"), F.count_if(F.col("_v") == 0).alias("z"))
    own = F.col("n") > 0
    t = day.agg(F.sum("h").alias("hits"), F.sum("n").alias("n"), F.sum("b").alias("buy_n"), F.sum("s").alias("sell_n"), F.sum("z").alias("neutral_n"), F.count_if(own).alias("_d"), F.sum(F.when(own, F.col("h") * F.col("h"))).alias("_hh"), F.sum(F.when(own, F.col("h") * F.col("n"))).alias("_hn"), F.sum(F.when(own, F.col("n") * F.col("n"))).alias("_nn"))
    p = F.try_divide(F.col("hits"), F.col("n"))
    ss = F.col("_hh") - 2 * p * F.col("_hn") + p * p * F.col("_nn")
    ci = F.when((F.col("_d") >= 2) & (F.col("n") > 0), F.round(F.lit(1.96) * F.sqrt(F.greatest(ss, F.lit(0.0)) / (F.col("n") * F.col("n")) * F.col("_d") / (F.col("_d") - 1)) * 100, 1))
    return t.withColumns({"hit_rate": F.round(p * 100, 1), "ci95": ci}).drop("_d", "_hh", "_hn", "_nn")
