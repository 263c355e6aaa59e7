"""Rolling indicators over a long table of bars: windows by ticker in date order, so one shuffle and one sort serve all of them.

A rolling value is null until its window is full, unless a function says otherwise. Null closes are not bars: filter first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import rnd

YEAR = 252


def by_time():
    return Window.partitionBy("ticker").orderBy("date")


def trailing(n: int):
    return by_time().rowsBetween(-(n - 1), 0)


def full(n: int, value: Column, over) -> Column:
    """value over a trailing window of n rows, null while it has fewer."""
    return F.when(F.count(F.lit(1)).over(over) >= n, value.over(over))


def change(x: Column | str = "close", n: int = 1) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x / F.lag(x, n).over(by_time()) - 1


def momentum(bars: DataFrame, lookback: int = 252, skip: int = 21) -> DataFrame:
    """Return in percent from the lookback-th last bar to the skip-th last one; 0 with a shorter history."""
    end = F.lag("close", max(skip, 1) - 1).over(by_time())
    return bars.withColumn("momentum", F.coalesce((end / F.lag("close", lookback - 1).over(by_time()) - 1) * 100, F.lit(0.0)))


def volatility(bars: DataFrame, window: int = 252) -> DataFrame:
    """Annualised deviation in percent of the last returns; from two on, a part of the window will do."""
    return bars.withColumn("_r", change()).withColumn("vol", F.stddev_samp("_r").over(trailing(window)) * math.sqrt(YEAR) * 100).drop("_r")


def bollinger(bars: DataFrame, window: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and bands of k sample deviations."""
    w = trailing(window)
    mid, sd = full(window, F.avg("close"), w), full(window, F.stddev_samp("close"), w)
    return bars.withColumns({"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd})


def bollinger_features(bars: DataFrame, window: int = 20, k: float = 2.0, squeeze: int = 120, walk: int = 2) -> DataFrame:
    """Position in the bands of k population deviations, their width, squeezes, band walks and touches."""
    w = trailing(window)
    mid, sd = full(window, F.avg("close"), w), full(window, F.stddev_pop("close"), w)
    b = bars.withColumns({"mid": mid, "upper": mid + k * sd, "lower": mid - k * sd})
    b = b.withColumns({"pct_b": F.try_divide(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower")), "bandwidth": F.try_divide(F.col("upper") - F.col("lower"), F.col("mid"))})
    s, r = trailing(squeeze), trailing(walk)
    tight = (F.count("bandwidth").over(s) >= window) & (F.col("bandwidth") <= F.percentile("bandwidth", F.lit(0.1)).over(s))
    up, down = F.sum((F.col("pct_b") > 1).cast("int")).over(r) == walk, F.sum((F.col("pct_b") < 0).cast("int")).over(r) == walk
    no = F.lit(False)
    return b.withColumns({"squeeze": F.coalesce(tight, no), "walk_up": F.coalesce(up, no), "walk_down": F.coalesce(down, no), "touch_upper": F.coalesce(F.col("pct_b") >= 1, no), "touch_lower": F.coalesce(F.col("pct_b") <= 0, no)})


def stochastic(bars: DataFrame, k: int = 14, d: int = 3) -> DataFrame:
    """Slow stochastic: the raw position in the range, twice averaged."""
    w, s = trailing(k), trailing(d)
    low, high = full(k, F.min("low"), w), full(k, F.max("high"), w)
    raw = bars.withColumn("_k", F.try_divide(F.col("close") - low, high - low) * 100)
    slow = raw.withColumn("slow_k", F.when(F.count("_k").over(s) >= d, F.avg("_k").over(s)))
    return slow.withColumn("slow_d", F.when(F.count("slow_k").over(s) >= d, F.avg("slow_k").over(s))).drop("_k")


def obv(bars: DataFrame) -> DataFrame:
    """Running sum of the volume, signed by the close's change."""
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close").over(by_time())), F.lit(0.0))
    return bars.withColumn("_v", sign * F.col("volume")).withColumn("obv", F.sum("_v").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_v")


def true_range() -> Column:
    prev = F.lag("close").over(by_time())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(bars: DataFrame, window: int = 14) -> DataFrame:
    """Mean true range; half a percent of the close where it is missing or not positive."""
    b = bars.withColumn("_tr", true_range())
    mean = full(window, F.avg("_tr"), trailing(window))
    return b.withColumn("atr", F.when(mean > 0, mean).otherwise(F.col("close") * 0.005)).drop("_tr")


def range_and_volume(bars: DataFrame, window: int = 20) -> DataFrame:
    """Place of the close in the window's range, and the volume by its mean over at least half the window."""
    w = trailing(window)
    low, high = full(window, F.min("low"), w), full(window, F.max("high"), w)
    mean = full(max(2, window // 2), F.avg("volume"), w)
    return bars.withColumns({"range_position": F.try_divide(F.col("close") - low, high - low), "volume_ratio": F.try_divide(F.col("volume"), mean)})


def swings(bars: DataFrame, k: int = 5) -> DataFrame:
    """Bars that top (swing_high) or undercut (swing_low) the k bars on either side, strictly."""
    before, after = by_time().rowsBetween(-k, -1), by_time().rowsBetween(1, k)
    whole = (F.count(F.lit(1)).over(before) == k) & (F.count(F.lit(1)).over(after) == k)
    high = whole & (F.col("high") > F.max("high").over(before)) & (F.col("high") > F.max("high").over(after))
    low = whole & (F.col("low") < F.min("low").over(before)) & (F.col("low") < F.min("low").over(after))
    return bars.withColumns({"swing_high": F.coalesce(high, F.lit(False)), "swing_low": F.coalesce(low, F.lit(False))})


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each ticker."""
    return bars.withColumn("_rn", F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))).where(F.col("_rn") <= n).drop("_rn")


def fair_value_gaps(bars: DataFrame, lookback: int = 100, min_gap_pct: float = 0.05) -> DataFrame:
    """Gaps between a bar and the one before last among the last bars, with whether a later bar filled them. date: the bar between."""
    w, rest = by_time(), by_time().rowsBetween(0, Window.unboundedFollowing)
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = tail(bars, lookback).withColumns({"h2": F.lag("high", 2).over(w), "l2": F.lag("low", 2).over(w), "mid_date": F.lag("date").over(w), "now": F.last("close").over(whole), "low_ahead": F.min("low").over(rest), "high_ahead": F.max("high").over(rest)})
    bull = F.struct(F.lit("bull").alias("kind"), F.col("low").alias("top"), F.col("h2").alias("bottom"), (F.col("low_ahead") <= F.col("h2")).alias("filled"))
    bear = F.struct(F.lit("bear").alias("kind"), F.col("l2").alias("top"), F.col("high").alias("bottom"), (F.col("high_ahead") >= F.col("l2")).alias("filled"))
    g = b.withColumn("g", F.when(F.col("h2") < F.col("low"), bull).when(F.col("l2") > F.col("high"), bear)).where("g IS NOT NULL")
    pct = (F.col("g.top") - F.col("g.bottom")) / F.col("now") * 100
    return g.where(pct >= min_gap_pct).select("ticker", F.col("mid_date").alias("date"), "g.*", rnd(pct, 2).alias("gap_pct"))


def order_blocks(bars: DataFrame, lookback: int = 100, min_move_pct: float = 1.0) -> DataFrame:
    """Last opposite candle before a move of min_move_pct, and whether a later bar came back to it."""
    w, rest = by_time(), by_time().rowsBetween(1, Window.unboundedFollowing)
    b = tail(bars, lookback).withColumns({"move": (F.lead("close").over(w) / F.col("close") - 1) * 100, "low_ahead": F.min("low").over(rest), "high_ahead": F.max("high").over(rest), "_before": F.lag("date").over(w)})
    kind = F.when((F.col("close") < F.col("open")) & (F.col("move") >= min_move_pct), "bull").when((F.col("close") > F.col("open")) & (F.col("move") <= -min_move_pct), "bear")
    met = F.when(F.col("kind") == "bull", F.col("low_ahead") <= F.col("low")).otherwise(F.col("high_ahead") >= F.col("high"))
    return b.where("_before IS NOT NULL").withColumn("kind", kind).where("kind IS NOT NULL").select("ticker", "date", "kind", F.col("high").alias("top"), F.col("low").alias("bottom"), met.alias("mitigated"))


def structure_breaks(bars: DataFrame, k: int = 5) -> DataFrame:
    """For each two swings in a row the first close past the earlier one after the later one, with its label."""
    pos = F.row_number().over(by_time()) - 1
    b = swings(bars.withColumn("pos", pos), k)
    s = b.select("ticker", F.inline(F.array_compact(F.array(F.when(F.col("swing_high"), F.struct("pos", F.lit("H").alias("side"), F.col("high").alias("price"))), F.when(F.col("swing_low"), F.struct("pos", F.lit("L").alias("side"), F.col("low").alias("price")))))))
    w = Window.partitionBy("ticker").orderBy("pos", "side")
    pairs = s.select("ticker", F.col("pos").alias("at"), F.col("side").alias("now"), F.lag("side").over(w).alias("was"), F.lag("price").over(w).alias("price"), F.row_number().over(w).alias("pair")).where("was IS NOT NULL")
    beyond = ((F.col("was") == "H") & (F.col("close") > F.col("price"))) | ((F.col("was") == "L") & (F.col("close") < F.col("price")))
    hits = pairs.join(b.select("ticker", "pos", "date", "close"), "ticker").where((F.col("pos") > F.col("at")) & beyond)
    first = hits.groupBy("ticker", "pair", "was", "now", "price").agg(F.min(F.struct("pos", "date")).alias("f"))
    label = F.concat(F.when(F.col("was") != F.col("now"), "BOS").otherwise("CHoCH"), F.when(F.col("was") == "H", "_bull").otherwise("_bear"))
    return first.select("ticker", label.alias("label"), "price", F.col("f.date").alias("date"), F.col("f.pos").alias("pos"))


def premium_discount(bars: DataFrame, lookback: int = 60) -> DataFrame:
    """Where the last close stands in the range of the last bars."""
    t = tail(bars, lookback).groupBy("ticker").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("current"))
    mid = (F.col("high") + F.col("low")) / 2
    pos = F.when(F.col("high") > F.col("low"), (F.col("current") - F.col("low")) / (F.col("high") - F.col("low")) * 100).otherwise(50.0)
    return t.withColumns({"mid": mid, "zone": F.when(F.col("current") > mid, "premium").otherwise("discount"), "position_pct": rnd(pos, 1)})


def crosses(frame: DataFrame, fast: str, slow: str, zone_low: float | None = None, zone_high: float | None = None) -> DataFrame:
    """golden and dead crosses of two lines, and whether they lie in a zone."""
    diff = F.col(fast) - F.col(slow)
    prev = F.lag(diff).over(by_time())
    gold, dead = F.coalesce((prev <= 0) & (diff > 0), F.lit(False)), F.coalesce((prev >= 0) & (diff < 0), F.lit(False))
    low = gold & (F.col(fast) <= zone_low) if zone_low is not None else F.lit(False)
    high = dead & (F.col(fast) >= zone_high) if zone_high is not None else F.lit(False)
    return frame.where(diff.isNotNull()).withColumns({"golden": gold, "dead": dead, "golden_in_zone": low, "dead_in_zone": high})


def vol_target(bars: DataFrame, target: float = 0.15, lookback: int = 20, low: float = 0.2, high: float = 1.5) -> DataFrame:
    """Exposure multiplier that aims at a yearly volatility; 1 where it can't be told."""
    b = bars.withColumn("_r", change())
    sd = F.when(F.count("_r").over(trailing(lookback)) >= lookback, F.stddev_samp("_r").over(trailing(lookback))) * math.sqrt(YEAR)
    return b.withColumn("multiplier", F.when(sd > 0, F.greatest(F.lit(low), F.least(F.lit(high), target / sd))).otherwise(1.0)).drop("_r")


def rolling_beta(returns: DataFrame, window: int = 60) -> DataFrame:
    """Beta of r on m (columns of returns by ticker and date) over full windows."""
    w = trailing(window)
    return returns.withColumn("beta", F.when(F.count(F.lit(1)).over(w) >= window, F.try_divide(F.covar_samp("r", "m").over(w), F.var_samp("m").over(w))))


def drawdown(bars: DataFrame) -> DataFrame:
    """Percent below the highest positive close so far; the least is the maximum drawdown."""
    b = bars.where("close > 0")
    top = F.max("close").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return b.withColumn("drawdown", (F.col("close") - top) / top * 100)


def regime(bars: DataFrame, window: int = 200, band: float = 0.03) -> DataFrame:
    """bull or bear beyond a band around the long mean, neutral within it or without one."""
    mean = full(window, F.avg("close"), trailing(window))
    return bars.withColumn("regime", F.when(F.col("close") > mean * (1 + band), "bull").when(F.col("close") < mean * (1 - band), "bear").otherwise("neutral"))


def short_trend(bars: DataFrame, mean: int = 50, slope: int = 20) -> DataFrame:
    """trend_ok: the mean rises over slope bars, or can't be told."""
    b = bars.withColumn("ma", full(mean, F.avg("close"), trailing(mean)))
    return b.withColumn("trend_ok", F.coalesce(F.col("ma") >= F.lag("ma", slope).over(by_time()), F.lit(True)))


def after_last_jump(bars: DataFrame, factor: float = 10.0) -> DataFrame:
    """Bars from the last day on which the close moved by the factor or more; all where none did."""
    move = F.abs(F.log(F.try_divide(F.col("close"), F.lag("close").over(by_time()))))
    b = bars.withColumn("_jump", F.when(move >= math.log(factor), F.col("date")))
    last = F.max("_jump").over(Window.partitionBy("ticker"))
    return b.withColumn("_last", last).where(F.col("_last").isNull() | (F.col("date") >= F.col("_last"))).drop("_jump", "_last")


def month_starts(bars: DataFrame) -> DataFrame:
    """First trading day of each month."""
    return bars.groupBy(F.trunc("date", "month").alias("month")).agg(F.min("date").alias("first_day"))


def resample(bars: DataFrame, unit: str = "week") -> DataFrame:
    """Bars of a coarser unit: first open, last close, extremes and the volume's sum."""
    return bars.groupBy("ticker", F.to_date(F.date_trunc(unit, "date")).alias("date")).agg(F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"))


def timing_overlay(bars: DataFrame, window: int = 200) -> DataFrame:
    """invested: yesterday's close stood above its long mean; unknown days are out of the market."""
    mean = full(window, F.avg("close"), trailing(window))
    b = bars.withColumn("_above", F.col("close") > mean)
    return b.withColumn("invested", F.coalesce(F.lag("_above").over(by_time()), F.lit(False))).drop("_above")


def sweep_setup(bars: DataFrame, period: int = 3) -> DataFrame:
    """Last bars that took out the extreme of the bars before and closed back inside."""
    w = by_time().rowsBetween(-period, -1)
    b = bars.withColumns({"_h": F.when(F.count(F.lit(1)).over(w) == period, F.max("high").over(w)), "_l": F.when(F.count(F.lit(1)).over(w) == period, F.min("low").over(w))})
    kind = F.when((F.col("low") < F.col("_l")) & (F.col("close") > F.col("_l")), "bull").when((F.col("high") > F.col("_h")) & (F.col("close") < F.col("_h")), "bear")
    return b.withColumn("sweep", kind).drop("_h", "_l")
