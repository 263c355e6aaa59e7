"""A learned direction signal: features of bars, folds by trading day with purging and an embargo, boosted trees, and areas under the curve."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time, full, trailing, true_range
from .simulate import ewm

FEATURES = ("ma_align", "rsi", "macd_hist", "bb_pos", "vol_ratio", "mom_20", "mom_5", "hl_pos", "atr_ratio")
TINY = 1e-9  # fixed value, in the features' denominators


def adjusted_ewm(bars: DataFrame, column: str, span: int, out: str) -> DataFrame:
    """Average of all values so far with weights that fall by 1 - alpha a step and sum to 1; of a column without nulls."""
    alpha = 2 / (span + 1)
    k = F.row_number().over(by_time()) - 1
    b = ewm(bars, column, alpha, "_avg")
    start = F.first(column).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    # the recurrence gives the first value the weight a**k instead of alpha a**k
    a = F.pow(F.lit(1 - alpha), k)
    return b.withColumn(out, (F.col("_avg") - a * start * (1 - alpha)) / (1 - a * (1 - alpha))).drop("_avg")


def _clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def features(bars: DataFrame) -> DataFrame:
    """bars with the nine features; null until their windows are full."""
    mean = lambda n, x="close": full(n, F.avg(x), trailing(n))
    c = F.col
    b = adjusted_ewm(adjusted_ewm(bars, "close", 12, "_f"), "close", 26, "_s").withColumn("_m", c("_f") - c("_s"))
    b = adjusted_ewm(b, "_m", 9, "_g")
    d = c("close") - F.lag("close").over(by_time())
    b = b.withColumns({"_up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "_down": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), "_tr": F.coalesce(true_range(), c("high") - c("low"))})
    w14, w20 = trailing(14), trailing(20)
    gain, loss = (F.when(F.count(x).over(w14) >= 14, F.avg(x).over(w14)) for x in ("_up", "_down"))
    low, high = full(20, F.min("low"), w20), full(20, F.max("high"), w20)
    past = lambda n: (c("close") / F.lag("close", n).over(by_time()) - 1) * 100
    more = lambda x, y: F.coalesce((x > y).cast("int"), F.lit(0))
    # a comparison with a mean that is not there yet is false, not missing
    b = b.withColumns({
        "ma_align": (more(c("close"), mean(5)) + more(mean(5), mean(20)) + more(mean(20), mean(60))) / 3.0, "rsi": gain / (gain + loss + TINY) * 100, "macd_hist": c("_m") - c("_g"),
        "bb_pos": _clip((c("close") - mean(20)) / (2 * full(20, F.stddev_samp("close"), w20) + TINY), -1.0, 1.0), "vol_ratio": _clip(F.try_divide(c("volume"), mean(20, "volume")), 0.0, 5.0),
        "mom_20": past(20), "mom_5": past(5), "hl_pos": _clip((c("close") - low) / (high - low + TINY), 0.0, 1.0), "atr_ratio": _clip(mean(14, "_tr") / c("close"), 0.0, 0.1) * 100,
    })
    return b.drop("_f", "_s", "_m", "_g", "_up", "_down", "_tr")


def labels(bars: DataFrame, horizon: int = 20, threshold_pct: float = 0.0) -> DataFrame:
    """label: 1.0 if the close horizon bars on is up by more than the threshold, else 0.0; null where there is none."""
    ahead = (F.lead("close", horizon).over(by_time()) / F.col("close") - 1) * 100
    return bars.withColumn("label", F.when(ahead.isNotNull(), (ahead > threshold_pct).cast("double")))


def purged_folds(frame: DataFrame, day: str = "date", folds: int = 5, horizon: int = 20, embargo: float = 0.02) -> DataFrame:
    """frame with pos (number of its day) and, a row for each fold, fold and role: test, train or purged.

    Folds are runs of days. Days whose label reaches into the test days or that the test days' labels reach, and the embargo
    after these, are purged. Only the days, one row each, are numbered in one task; the rows meet them by a broadcast."""
    days = frame.select(day).where(F.col(day).isNotNull()).distinct()
    numbered = days.withColumn("pos", F.row_number().over(Window.orderBy(day)) - 1)
    n = numbered.count()
    bound = [i * n // folds for i in range(folds + 1)]
    gap = int(n * embargo)
    fold = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(bound[i]).alias("a"), F.lit(bound[i + 1]).alias("b")) for i in range(folds)]))
    f = frame.join(F.broadcast(numbered), day).withColumn("_f", fold)
    p, a, b = F.col("pos"), F.col("_f.a"), F.col("_f.b")
    role = F.when((p >= a) & (p < b), "test").when((p >= a - horizon) & (p < b + horizon + gap), "purged").otherwise("train")
    return f.withColumns({"fold": F.col("_f.fold"), "role": role}).drop("_f")


def area_under_curve(scored: DataFrame, by: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """by, n_pos, n_neg and auc: the share of pairs of a positive and a negative row in which the positive one scores higher, ties half.

    Rows of one score are counted before the shuffle, and sums run over distinct scores. Null without one of the two kinds."""
    c = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count_if(F.col(label) > 0.5).alias("_p"), F.count_if(F.col(label) <= 0.5).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("_won", F.col("_p") * (F.coalesce(below, F.lit(0)) + F.col("_n") / 2))
    g = c.groupBy(*by).agg(F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"), F.sum("_won").alias("_won"))
    return g.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_won"), F.col("n_pos") * F.col("n_neg")).alias("auc"))


def validated(bars: DataFrame, horizon: int = 20, folds: int = 5, embargo: float = 0.02, trees: int = 100, depth: int = 3, step: float = 0.1, least: int = 30, seed: int = 42) -> DataFrame:
    """ticker, date, fold, label and score: each row scored by boosted trees that saw no row within its label's reach.

    Folds without both labels in training or test have no rows. Raises with fewer than least days a fold."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    data = labels(features(bars), horizon).dropna(subset=[*FEATURES, "label"]).select("ticker", "date", *FEATURES, "label")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(data).select("ticker", "date", "features", "label")
    rows = purged_folds(rows, "date", folds, horizon, embargo).persist()
    if rows.agg(F.count_distinct("date")).first()[0] < folds * least:
        raise ValueError("too few days for so many folds")
    both = {(x.fold, x.role) for x in rows.groupBy("fold", "role").agg(F.count_distinct("label").alias("kinds")).collect() if x.kinds > 1}  # a few rows
    out = None
    for i in range(folds):
        if {(i, "train"), (i, "test")} <= both:
            mine = rows.where(F.col("fold") == i)
            model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, cacheNodeIds=False).fit(mine.where("role = 'train'"))
            scored = model.transform(mine.where("role = 'test'")).select("ticker", "date", "fold", "label", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
            out = scored if out is None else out.unionByName(scored)
    if out is None:
        raise ValueError("no fold has both labels in training and test")
    return out


def spread(aucs: DataFrame) -> DataFrame:
    """One row: mean and deviation (of the population) of the folds' areas, and their number."""
    return aucs.agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("std_auc"), F.count("auc").alias("n_folds"))
