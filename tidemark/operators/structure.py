"""Price structure as it could be seen at each bar: a swing counts only once the bars on its right are known.

The swings that a bar can see are the events of one trailing window, a few by their spacing, and ride along as a short array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import by_time, range_and_volume, swings, tail, trailing

#: A channel's daily drift in percent beyond which it has a direction, and the thirds of its width.
DRIFT, UPPER_THIRD, LOWER_THIRD = 0.05, 66, 33


def seen(event: Column, value: Column, lookback: int, k: int) -> Column:
    """(pos, v) of the events whose k bars on both sides lie in the last lookback bars, oldest first; pos is the bars that have gone since, below 0."""
    frame = by_time().rowsBetween(-(lookback - 1 - k), -k)
    events = F.collect_list(F.when(event, F.struct("_pos", value.alias("v")))).over(frame)
    return F.transform(events, lambda e: F.struct((e["_pos"] - F.col("_pos")).alias("pos"), e["v"].alias("v")))


def numbered(bars: DataFrame) -> DataFrame:
    return bars.withColumn("_pos", F.row_number().over(by_time()))


def _sum(a: Column, f) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, e: s + f(e))


def slope(events: Column) -> Column:
    """Least-squares slope of v on pos; null with fewer than two events."""
    n, x, y = F.size(events), _sum(events, lambda e: e["pos"]), _sum(events, lambda e: e["v"])
    xx, xy = _sum(events, lambda e: e["pos"] * e["pos"]), _sum(events, lambda e: e["pos"] * e["v"])
    return F.when(n >= 2, (n * xy - x * y) / (n * xx - x * x))


def channel(bars: DataFrame, lookback: int = 80, k: int = 5) -> DataFrame:
    """bars with the parallel channel around the swings of the last bars: slope, direction, upper and lower at the bar, width_pct, position_pct, zone.

    Null where fewer than two swing highs and two swing lows are known, or less than half the bars."""
    b = swings(numbered(bars), k)
    b = b.withColumns({"_h": seen(F.col("swing_high"), F.col("high"), lookback, k), "_l": seen(F.col("swing_low"), F.col("low"), lookback, k), "_n": F.count(F.lit(1)).over(trailing(lookback)), "_m": F.avg("close").over(trailing(lookback))})
    drift = (slope(F.col("_h")) + slope(F.col("_l"))) / 2
    b = b.withColumn("slope", F.when(F.col("_n") >= max(lookback // 2, 3 * k), drift))
    at_bar = lambda e: e["v"] - F.col("slope") * e["pos"]
    b = b.withColumns({"upper": F.when(F.col("slope").isNotNull(), F.array_max(F.transform("_h", at_bar))), "lower": F.when(F.col("slope").isNotNull(), F.array_min(F.transform("_l", at_bar)))})
    width = F.col("upper") - F.col("lower")
    place = F.when(width > 0, (F.col("close") - F.col("lower")) / width * 100).when(width.isNotNull(), 50.0)
    drift_pct = F.col("slope") / (F.col("_m") + 1e-9) * 100
    b = b.withColumns({
        "direction": F.when(drift_pct > DRIFT, "bullish").when(drift_pct < -DRIFT, "bearish").when(drift_pct.isNotNull(), "sideways"),
        "width_pct": F.when(F.col("lower") > 0, width / F.col("lower") * 100).when(width.isNotNull(), 0.0), "position_pct": place,
        "zone": F.when(place > UPPER_THIRD, "upper").when(place < LOWER_THIRD, "lower").when(place.isNotNull(), "middle"),
    })
    return b.drop("_pos", "_h", "_l", "_n", "_m", "swing_high", "swing_low")


def divergence(frame: DataFrame, price: str = "close", oscillator: str = "rsi", lookback: int = 60, k: int = 5) -> DataFrame:
    """frame with regular_bull, regular_bear, hidden_bull, hidden_bear of the last two price swings against an oscillator.

    Swings are those of the bars of the last lookback ones whose price and oscillator are both known."""
    no = F.lit(False)
    known = F.col(price).isNotNull() & F.col(oscillator).isNotNull() & ~F.isnan(price) & ~F.isnan(oscillator)
    # The window counts bars that have a price; bars without an oscillator then leave it.
    b = frame.withColumn("_pos", F.count(F.when(F.col(price).isNotNull() & ~F.isnan(price), 1)).over(by_time().rowsBetween(Window.unboundedPreceding, 0))).where(known)
    before, after = by_time().rowsBetween(-k, -1), by_time().rowsBetween(1, k)
    p = F.col(price)
    whole = (F.count(F.lit(1)).over(before) == k) & (F.count(F.lit(1)).over(after) == k)
    b = b.withColumns({"_top": whole & (p > F.max(p).over(before)) & (p > F.max(p).over(after)), "_dip": whole & (p < F.min(p).over(before)) & (p < F.min(p).over(after)), "_from": F.lag("_pos", k).over(by_time())})
    span = by_time().rowsBetween(-(lookback - 1), -k)
    last_two = lambda event: F.slice(F.reverse(F.filter(F.collect_list(F.when(F.col(event), F.struct("_from", p.alias("p"), F.col(oscillator).alias("o")))).over(span), lambda e: e["_from"] > F.col("_pos") - lookback)), 1, 2)
    inside = F.size(F.filter(F.collect_list("_pos").over(by_time().rowsBetween(-(2 * k + 2), 0)), lambda x: x > F.col("_pos") - lookback))
    b = b.withColumns({"_t": last_two("_top"), "_d": last_two("_dip"), "_enough": inside >= 2 * k + 3})
    pair = lambda a, f: F.coalesce(F.col("_enough") & (F.size(a) == 2) & f(F.get(a, F.lit(1)), F.get(a, F.lit(0))), no)
    d, t = F.col("_d"), F.col("_t")
    return b.withColumns({
        "regular_bull": pair(d, lambda x, y: (y["p"] < x["p"]) & (y["o"] > x["o"])), "hidden_bull": pair(d, lambda x, y: (y["p"] > x["p"]) & (y["o"] < x["o"])),
        "regular_bear": pair(t, lambda x, y: (y["p"] > x["p"]) & (y["o"] < x["o"])), "hidden_bear": pair(t, lambda x, y: (y["p"] < x["p"]) & (y["o"] > x["o"])),
    }).drop("_pos", "_top", "_dip", "_from", "_t", "_d", "_enough")


def median(values: Column) -> Column:
    """Of an array of doubles; null if it is empty."""
    a, n = F.array_sort(values), F.size(values)
    at = lambda i: F.get(a, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2)


def box_breakout(bars: DataFrame, lookback: int = 60, k: int = 3, tolerance_pct: float = 1.5, touches: int = 2, volume_window: int = 20, volume_times: float = 1.0, extension: float = 1.618) -> DataFrame:
    """bars with box_high, box_low, in_box, breakout_up, breakout_down, vol_confirmed, fakeout, target and stop.

    The box lies between the medians of the swing highs and lows seen; it holds if the last touches of both are near their median."""
    no = F.lit(False)
    b = swings(numbered(range_and_volume(bars, volume_window)), k)
    b = b.withColumns({"_h": seen(F.col("swing_high"), F.col("high"), lookback, k)["v"], "_l": seen(F.col("swing_low"), F.col("low"), lookback, k)["v"], "_n": F.count(F.lit(1)).over(trailing(lookback))})
    usable = (F.col("_n") >= 2 * k + 3) & (F.size("_h") >= touches) & (F.size("_l") >= touches)
    b = b.withColumns({"_top": F.when(usable, median(F.col("_h"))), "_bottom": F.when(usable, median(F.col("_l")))}).withColumn("_box", F.coalesce(F.col("_top") > F.col("_bottom"), no))
    near = lambda a, level: F.forall(F.slice(F.reverse(a), 1, touches), lambda v: F.abs(v - level) / level * 100 <= tolerance_pct)
    top, bottom = F.when(F.col("_box"), F.col("_top")), F.when(F.col("_box"), F.col("_bottom"))
    b = b.withColumns({"box_high": top, "box_low": bottom, "in_box": F.coalesce(F.col("_box") & near(F.col("_h"), F.col("_top")) & near(F.col("_l"), F.col("_bottom")), no)})
    b = b.withColumns({"breakout_up": F.coalesce(F.col("in_box") & (F.col("close") > F.col("box_high")), no), "breakout_down": F.coalesce(F.col("in_box") & (F.col("close") < F.col("box_low")), no), "vol_confirmed": F.coalesce(F.col("_box") & (F.col("volume_ratio") >= volume_times), no)})
    height = F.col("box_high") - F.col("box_low")
    b = b.withColumns({
        "fakeout": (F.col("breakout_up") | F.col("breakout_down")) & ~F.col("vol_confirmed"),
        "target": F.when(F.col("breakout_up"), F.col("box_high") + height * extension).when(F.col("breakout_down"), F.col("box_low") - height * extension),
        "stop": F.when(F.col("breakout_up"), F.col("box_high")).when(F.col("breakout_down"), F.col("box_low")),
    })
    return b.drop("_pos", "_h", "_l", "_n", "_top", "_bottom", "_box", "swing_high", "swing_low", "range_position", "volume_ratio")


def _peaks(values: Column, distance: int, prominence: Column, most: int) -> Column:
    """(pos, v) of the last peaks of an array of doubles that stand out, in order of place.

    A peak is a run of equal values between lower ones, placed at its middle. Of peaks nearer than distance the higher one stays, of
    equal ones the later. One stands out if on both sides, before anything higher than it, the values fall by prominence."""
    value = lambda i: F.get(values, i)
    n = F.size(values)
    # Runs of equal values: a run begins where the value changes.
    starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (value(i) != value(i - 1)))
    runs = F.transform(starts, lambda s, j: F.struct(s.alias("a"), (F.coalesce(F.get(starts, j + 1), n) - 1).alias("b"), value(s).alias("v")))
    peaks = F.filter(runs, lambda r: (r["a"] > 0) & (r["b"] < n - 1) & (value(r["a"] - 1) < r["v"]) & (value(r["b"] + 1) < r["v"]))
    peaks = F.transform(peaks, lambda r: F.struct(r["v"].alias("v"), F.floor((r["a"] + r["b"]) / 2).cast("int").alias("pos")))
    by_height = F.sort_array(peaks, asc=False)
    apart = lambda kept, x: ~F.exists(kept, lambda e: F.abs(e["pos"] - x["pos"]) < distance)
    none = F.filter(peaks, lambda e: F.lit(False))
    kept = F.aggregate(by_height, none, lambda s, x: F.when(apart(s, x), F.array_append(s, x)).otherwise(s))
    # Walking away from a peak: 0 still looking, 1 fell far enough first, 2 met something higher first.
    step = lambda x: lambda s, v: F.when(s != 0, s).when(v > x["v"], 2).when(v <= x["v"] - prominence, 1).otherwise(0)
    falls = lambda side, x: F.aggregate(side, F.lit(0), step(x)) == 1
    left = lambda x: F.reverse(F.slice(values, 1, x["pos"]))
    right = lambda x: F.slice(values, x["pos"] + 2, n)
    out = F.filter(kept, lambda x: falls(left(x), x) & falls(right(x), x))
    in_place = F.sort_array(F.transform(out, lambda x: F.struct(x["pos"].alias("pos"), x["v"].alias("v"))))
    return F.reverse(F.slice(F.reverse(in_place), 1, most))


def levels(bars: DataFrame, lookback: int = 252, distance: int = 5, prominence: float = 0.008, most: int = 25, near: float = 0.015, top: int = 8) -> DataFrame:
    """ticker, level, kind (support or resistance), touches, dist_pct, above, rank: price levels around the last close of each ticker.

    Peaks of the highs and troughs of the lows among the last lookback bars, which bound a ticker's arrays, are joined from
    below: one within near of the level so far moves it to the middle of both."""
    recent = tail(bars, lookback).groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("date", "high", "low", "close"))).alias("_b"))
    now = F.element_at("_b", -1)["close"]
    b = recent.withColumns({"_now": now, "_prom": now * prominence, "_high": F.col("_b.high"), "_dip": F.transform("_b", lambda x: -x["low"])}).drop("_b")
    b = b.withColumns({"_up": _peaks(F.col("_high"), distance, F.col("_prom"), most), "_down": _peaks(F.col("_dip"), distance, F.col("_prom"), most)})
    points = F.concat(F.transform("_up", lambda x: F.struct(x["v"].alias("level"), F.lit(0).alias("side"), x["pos"].alias("pos"))), F.transform("_down", lambda x: F.struct((-x["v"]).alias("level"), F.lit(1).alias("side"), x["pos"].alias("pos"))))
    b = b.withColumn("_points", F.array_sort(points))
    none = F.array().cast("array<struct<level:double,side:int,touches:int>>")
    met = lambda last, x: F.abs(x["level"] - last["level"]) / last["level"] < near
    joined = lambda last, x: F.struct(((last["level"] + x["level"]) / 2).alias("level"), last["side"].alias("side"), (last["touches"] + 1).alias("touches"))
    alone = lambda x: F.struct(x["level"].alias("level"), x["side"].alias("side"), F.lit(1).alias("touches"))
    last = lambda s: F.get(s, F.size(s) - 1)
    step = lambda s, x: F.when((F.size(s) > 0) & met(last(s), x), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(joined(last(s), x)))).otherwise(F.concat(s, F.array(alone(x))))
    got = b.select("ticker", "_now", F.explode(F.aggregate("_points", none, step)).alias("c"))  # a fold over at most 2 * most levels
    got = got.select("ticker", "c.level", F.when(F.col("c.side") == 0, "resistance").otherwise("support").alias("kind"), F.col("c.touches").alias("touches"), ((F.col("c.level") - F.col("_now")) / F.col("_now") * 100).alias("dist_pct"), (F.col("c.level") > F.col("_now")).alias("above"))
    w = Window.partitionBy("ticker").orderBy(F.abs("dist_pct"), "level")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
