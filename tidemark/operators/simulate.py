"""First-touch outcomes, held positions, calendar portfolios and per-ticker recurrences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


CHUNK = 64  # ids that a step of the cooldown walk may copy


def numbered(bars: DataFrame, order: str = "date") -> DataFrame:
    return bars.withColumn("pos", F.row_number().over(Window.partitionBy("ticker").orderBy(order)) - 1)


def first_touch(plans: DataFrame, bars: DataFrame, fill_window: int = 20, hold_window: int = 40) -> DataFrame:
    """outcome, r, fill_pos and exit_pos of plans (plan_id, ticker, start_pos, direction, entry_low, entry_high, stop, target, rr)
    over bars (ticker, pos, high, low): the first bar that fills, then stop or target, whichever comes first; both on one bar is a loss.

    A plan meets the bars of its ticker within its two windows only: bars are dealt out by ticker and block of positions, and
    the first of each kind is a partial aggregate."""
    width = fill_window + hold_window
    block = lambda p: F.floor(p / width)
    probe = plans.withColumn("_b", F.explode(F.array(block(F.col("start_pos") + 1), block(F.col("start_pos") + 1) + 1)))
    b = bars.select("ticker", "pos", "high", "low", block(F.col("pos")).alias("_b"))
    near = probe.join(b, ["ticker", "_b"]).where((F.col("pos") > F.col("start_pos")) & (F.col("pos") < F.col("start_pos") + fill_window + hold_window))
    long = F.col("direction") == "long"
    fills = F.when(F.col("pos") <= F.col("start_pos") + fill_window, F.when(long, F.col("low") <= F.col("entry_high")).otherwise(F.col("high") >= F.col("entry_low")))
    stops = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    hits = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    # positions of each kind, at most width of them a plan, so that those after the fill can be told apart
    g = near.groupBy("plan_id").agg(F.min(F.when(fills, F.col("pos"))).alias("fill_pos"), F.array_sort(F.collect_list(F.when(stops, F.col("pos")))).alias("_s"), F.array_sort(F.collect_list(F.when(hits, F.col("pos")))).alias("_h"))
    inside = lambda a: F.get(F.filter(a, lambda p: (p >= F.col("fill_pos")) & (p < F.col("fill_pos") + hold_window)), F.lit(0))
    o = plans.join(g, "plan_id", "left").withColumns({"_sp": inside(F.col("_s")), "_hp": inside(F.col("_h"))})
    lost = F.col("_sp").isNotNull() & (F.col("_hp").isNull() | (F.col("_sp") <= F.col("_hp")))
    outcome = F.when(F.col("fill_pos").isNull(), "nofill").when(lost, "loss").when(F.col("_hp").isNotNull(), "win").otherwise("timeout")
    o = o.withColumn("outcome", outcome)
    r = F.when(F.col("outcome") == "loss", -1.0).when(F.col("outcome") == "win", F.col("rr")).otherwise(0.0)
    return o.withColumns({"r": r, "exit_pos": F.when(F.col("outcome") == "loss", F.col("_sp")).when(F.col("outcome") == "win", F.col("_hp"))}).drop("_s", "_h", "_sp", "_hp")


def trade_stats(trades: DataFrame, by: list[str]) -> DataFrame:
    """Setups, fills, outcomes, win share and expectancy in R."""
    filled = F.col("outcome") != "nofill"
    n = lambda x: F.count_if(F.col("outcome") == x)
    g = trades.groupBy(*by).agg(F.count("*").alias("setups"), F.count_if(filled).alias("filled"), n("win").alias("wins"), n("loss").alias("losses"), n("timeout").alias("timeouts"), F.avg(F.when(filled, F.col("r"))).alias("expectancy"), F.avg(F.when(F.col("outcome") == "win", F.col("r"))).alias("avg_win_r"))
    return g.withColumn("win_rate", F.try_divide(F.col("wins"), F.col("wins") + F.col("losses")))


def cooled_down(trades: DataFrame, cooldown: int = 3, fill_window: int = 20, hold_window: int = 40) -> DataFrame:
    """Per ticker the trades that a walk in order of start_pos takes, where the next setup is looked for cooldown bars after the
    last trade has landed: at its exit, for a timeout at fill_pos + hold_window, without a fill at start_pos + fill_window. Trades
    without columns fill_pos and exit_pos, which no bars were met for, land where they start. A fold over a ticker's plans."""
    start = F.col("start_pos").cast("long")
    lands = F.coalesce(F.col("exit_pos"), F.col("fill_pos") + hold_window, start + fill_window).cast("long") if {"fill_pos", "exit_pos"} <= set(trades.columns) else start
    one = trades.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct(start.alias("start_pos"), "plan_id", F.greatest(start + 1, lands + cooldown).alias("free")))).alias("p"))
    ids = f"array<{trades.schema['plan_id'].dataType.simpleString()}>"
    none = F.struct(F.lit(-(1 << 30)).cast("long").alias("free"), F.array().cast(ids).alias("ids"), F.array().cast(f"array<{ids}>").alias("full"))
    # A step copies the ids taken since the last full chunk only, so that a long walk doesn't copy all of them again and again.
    fresh = lambda s, x: F.struct(x["free"].alias("free"), F.array(x["plan_id"]).alias("ids"), F.array_append(s["full"], s["ids"]).alias("full"))
    add = lambda s, x: F.struct(x["free"].alias("free"), F.array_append(s["ids"], x["plan_id"]).alias("ids"), s["full"].alias("full"))
    step = lambda s, x: F.when(x["start_pos"] < s["free"], s).when(F.size(s["ids"]) >= CHUNK, fresh(s, x)).otherwise(add(s, x))
    walked = F.aggregate("p", none, step, lambda s: F.array_append(s["full"], s["ids"]))
    taken = one.select(F.explode(walked).alias("ids")).select(F.explode("ids").alias("plan_id"))
    return trades.join(taken, "plan_id", "left_semi")


def calendar_curve(trades: DataFrame, bars: DataFrame, cost_bps: float = 6.0, min_held: int = 1) -> DataFrame:
    """date, held, ret: mean return of the positions open on a day, held from the day after entry through exit, round-trip
    cost on the first held day; 0 on days of fewer than min_held. trades: ticker, entry_pos, exit_pos."""
    from .joins import calendar

    cal = calendar(bars)
    w = Window.partitionBy("ticker").orderBy("date")
    ret = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1).join(F.broadcast(cal), "date").select("ticker", "pos", "_r")
    held = trades.where("exit_pos > entry_pos").select("ticker", "entry_pos", F.explode(F.sequence(F.col("entry_pos") + 1, F.col("exit_pos"))).alias("pos"))
    cost = F.when(F.col("pos") == F.col("entry_pos") + 1, cost_bps * 2 / 1e4).otherwise(0.0)
    day = held.join(ret, ["ticker", "pos"], "left").groupBy("pos").agg(F.count("*").alias("held"), F.avg(F.coalesce("_r", F.lit(0.0)) - cost).alias("ret"))
    out = cal.join(day, "pos", "left")
    return out.select("date", F.coalesce("held", F.lit(0).cast("long")).alias("held"), F.when(F.col("held") >= min_held, F.col("ret")).otherwise(0.0).alias("ret"))


def yearly_returns(curve: DataFrame, ret: str = "ret") -> DataFrame:
    return curve.groupBy(F.year("date").alias("year")).agg((F.exp(F.sum(F.log1p(ret))) - 1).alias("ret"), F.avg((F.col("held") > 0).cast("double")).alias("exposure"))


def threshold_positions(frame: DataFrame, signal: str, buy: float, sell: float) -> DataFrame:
    """held: 1 from the bar after a signal at or above buy until the bar after one at or below sell."""
    w = Window.partitionBy("ticker").orderBy("date")
    mark = F.when(F.col(signal) >= buy, 1).when(F.col(signal) <= sell, 0)
    state = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return frame.withColumn("held", F.coalesce(state, F.lit(0)))


def ewm(bars: DataFrame, column: str, alpha: float, out: str, order: str = "date") -> DataFrame:
    """First-order recurrence y = (1 - alpha) y + alpha x per ticker, from the first value; nulls and NaN keep the last value.

    With a = 1 - alpha, y is a**k times the running sum of alpha x / a**k within a block of known values; a block is as long as
    a**k takes to fall to 1e-100, so that the end of the block before is the only carry that a double can show."""
    a = 1 - alpha
    w = Window.partitionBy("ticker").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    if a <= 0:
        return bars.withColumn(out, F.last(x, ignorenulls=True).over(w))
    size = max(1, int(math.log(1e100) / -math.log(a)))
    k = F.count(x).over(w) - 1  # of the last known value
    b = bars.withColumn("_k", k).withColumns({"_b": F.floor(F.col("_k") / size), "_i": F.pmod("_k", F.lit(size))})
    within = Window.partitionBy("ticker", "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    term = F.when(F.col("_k") == 0, x).otherwise(x * alpha) / F.pow(F.lit(a), "_i")
    b = b.withColumn("_y", F.pow(F.lit(a), "_i") * F.sum(term).over(within))
    # a row without a value after a block's end finds that end itself, at a weight of 1e-100
    carry = F.last(F.when(F.col("_i") == size - 1, F.col("_y")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    y = F.col("_y") + F.coalesce(carry, F.lit(0.0)) * F.pow(F.lit(a), F.col("_i") + 1)
    return b.withColumn(out, F.when(F.col("_k") >= 0, y)).drop("_k", "_b", "_i", "_y")


def rsi(bars: DataFrame, period: int = 14, order: str = "date") -> DataFrame:
    """Relative strength with Wilder's averages; a loss of 0 counts as 1e-10."""
    w = Window.partitionBy("ticker").orderBy(order)
    d = F.col("close") - F.lag("close").over(w)
    known = d.isNotNull()  # the averages start at the first change; greatest() would read a missing one as 0
    b = bars.withColumns({"_g": F.when(known, F.greatest(d, F.lit(0.0))), "_l": F.when(known, F.greatest(-d, F.lit(0.0)))})
    b = ewm(ewm(b, "_g", 1 / period, "_ag", order), "_l", 1 / period, "_al", order)
    rs = F.col("_ag") / F.when(F.col("_al") == 0, 1e-10).otherwise(F.col("_al"))
    return b.withColumn("rsi", 100 - 100 / (1 + rs)).drop("_g", "_l", "_ag", "_al")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    b = ewm(ewm(bars, "close", 2 / (fast + 1), "_f"), "close", 2 / (slow + 1), "_s")
    b = b.withColumn("macd", F.col("_f") - F.col("_s")).drop("_f", "_s")
    return ewm(b, "macd", 2 / (signal + 1), "signal").withColumn("histogram", F.col("macd") - F.col("signal"))


def adx(bars: DataFrame, period: int = 14, epsilon: float | None = None) -> DataFrame:
    """Directional indicators and their index with Wilder's averages; null where a divisor is 0, or with epsilon added to divisors."""
    over = F.try_divide if epsilon is None else lambda a, b: a / (b + epsilon)
    w = Window.partitionBy("ticker").orderBy("date")
    up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    prev = F.lag("close").over(w)
    b = bars.withColumns({"_p": F.when((up > down) & (up > 0), up).otherwise(0.0), "_m": F.when((down > up) & (down > 0), down).otherwise(0.0), "_t": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))})
    for c in ("_p", "_m", "_t"):
        b = ewm(b, c, 1 / period, f"{c}a")
    b = b.withColumns({"plus_di": 100 * over(F.col("_pa"), F.col("_ta")), "minus_di": 100 * over(F.col("_ma"), F.col("_ta"))})
    b = b.withColumn("_dx", 100 * over(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di")))
    return ewm(b, "_dx", 1 / period, "adx").drop("_p", "_m", "_t", "_pa", "_ma", "_ta", "_dx")


def trailing_stop(bars: DataFrame, pct: float = 10.0) -> DataFrame:
    """stopped: the close is pct or more below its peak so far."""
    top = F.max("close").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return bars.withColumns({"peak": top, "stopped": F.col("close") <= top * (1 - pct / 100)})
