"""As-of, nearest, interval and calendar joins as unions with windows or equi-joins: no join here compares all pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], strict: bool = False, max_stale_days: int | None = None, tie: list[str] | None = None) -> DataFrame:
    """left with the values of the latest right row of its key at or before (strict: before) its time, else null.

    One union, one shuffle by key, one sort; of right rows at one time the greatest by tie counts. Values older than
    max_stale_days are null."""
    names = left.columns
    # a struct keeps nulls in the value apart from a missing row
    hit = F.struct(F.col(right_time).alias("_t"), *[F.col(v).alias(v) for v in values])
    order = F.struct(*[F.col(t) for t in tie or []]) if tie else F.lit(None).cast("struct<a:int>")
    r = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_k"), F.col(right_time).cast("timestamp").alias("_at"), F.lit(1 if strict else 0).alias("_side"), order.alias("_tie"), F.lit(None).cast(left.select(F.struct(*names).alias("s")).schema["s"].dataType).alias("_left"), hit.alias("_hit"))
    lft = left.select(F.col(key).alias("_k"), F.col(left_time).cast("timestamp").alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.struct(*names).alias("_left"), F.lit(None).cast(r.schema["_hit"].dataType).alias("_hit"))
    w = Window.partitionBy("_k").orderBy("_at", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(lft).withColumn("_seen", F.last("_hit", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    fresh = F.lit(True) if max_stale_days is None else F.datediff(F.col("_at"), F.col("_seen._t")) <= max_stale_days
    return both.select("_left.*", *[F.when(fresh, F.col("_seen")[v]).alias(v) for v in values], F.when(fresh, F.col("_seen._t")).alias(f"{right_time}_seen"))


def nearest(left: DataFrame, right: DataFrame, key: str, left_day: str, right_day: str, value: str, tolerance_days: int = 10) -> DataFrame:
    """left with the value of the right row nearest in days within a tolerance; of equal distances the earlier one.

    Rows meet by day bucket, three buckets wide, so the join is an equi-join."""
    width = max(1, tolerance_days)
    bucket = lambda c: F.floor(F.unix_date(F.col(c)) / width)
    probe = left.select(F.col(key).alias("_k"), F.col(left_day).alias("_d")).distinct().withColumn("_b", F.explode(F.array(*[bucket("_d") + i for i in (-1, 0, 1)])))
    side = right.where(F.col(right_day).isNotNull()).select(F.col(key).alias("_k"), F.col(right_day).alias("_rd"), F.col(value).alias("_v"), bucket(right_day).alias("_b"))
    near = probe.join(side, ["_k", "_b"]).withColumn("_gap", F.abs(F.datediff("_d", "_rd"))).where(F.col("_gap") <= tolerance_days)
    best = near.groupBy("_k", "_d").agg(F.min(F.struct("_gap", "_rd", "_v")).alias("_best"))
    return left.join(best, (F.col(key) == F.col("_k")) & (F.col(left_day) == F.col("_d")), "left").select(*left.columns, F.col("_best._v").alias(value), F.col("_best._rd").alias(right_day))


def calendar(bars: DataFrame) -> DataFrame:
    """date and pos of all trading days, from 0. The days of a market are few: one row a day, aggregated before they meet."""
    days = bars.select("date").distinct()
    return days.withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def next_day_trades(events: DataFrame, bars: DataFrame, day: str, hold: int) -> DataFrame:
    """Entry on the first trading day after the event's day, exit hold days later; events past either edge go.

    The calendar has a row a trading day, so it is small whatever the number of bars and events; the next day is an as-of join on it."""
    cal = calendar(bars)
    days = events.select(day).distinct()
    w = Window.orderBy("_at", "_side").rowsBetween(0, Window.unboundedFollowing)
    both = cal.select(F.col("date").alias("_at"), F.lit(0).alias("_side"), F.col("pos")).unionByName(days.select(F.col(day).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("int").alias("pos")))
    entry = both.withColumn("entry_pos", F.first("pos", ignorenulls=True).over(w)).where("_side = 1").select(F.col("_at").alias(day), "entry_pos")
    last = cal.agg(F.max("pos").alias("_last"))
    with_entry = events.join(F.broadcast(entry), day).withColumn("exit_pos", F.col("entry_pos") + hold)
    return with_entry.join(F.broadcast(last)).where("exit_pos <= _last AND entry_pos IS NOT NULL").drop("_last")


def priced(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Trades with entry and exit closes and the gross return; a missing exit takes the last close before it, marked delisted."""
    cal = calendar(bars)
    closes = bars.join(F.broadcast(cal), "date").select("ticker", "pos", "close")
    entry = trades.join(closes.select("ticker", F.col("pos").alias("entry_pos"), F.col("close").alias("entry_close")), ["ticker", "entry_pos"])
    exits = asof(entry.withColumn("_x", F.timestamp_seconds(F.col("exit_pos") * 86400)), closes.withColumn("_p", F.timestamp_seconds(F.col("pos") * 86400)), "ticker", "_x", "_p", ["close", "pos"])
    out = exits.withColumnRenamed("close", "exit_close").withColumn("delisted", F.col("pos") < F.col("exit_pos")).drop("_x", "_p_seen", "pos")
    return out.where("exit_close IS NOT NULL").withColumn("gross", F.col("exit_close") / F.col("entry_close") - 1)


def listing_windows(spans: DataFrame) -> DataFrame:
    """Ownership windows of re-used tickers: cut halfway between one owner's last and the next one's first sighting."""
    w = Window.partitionBy("ticker").orderBy("first_seen", "cik")
    half = lambda a, b: F.date_add(a, F.floor(F.datediff(b, a) / 2).cast("int"))
    lead, lag = F.lead("first_seen").over(w), F.lag("last_seen").over(w)
    return spans.withColumns({"window_end": F.when(lead.isNotNull(), half(F.col("last_seen"), lead)), "window_start": F.when(lag.isNotNull(), F.date_add(half(lag, F.col("first_seen")), 1))})


def slice_to_windows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Bars with the cik that owned their ticker on the day; a ticker has few owners, so the equi-join on it stays narrow."""
    w = windows.select("ticker", "cik", "window_start", "window_end")
    inside = (F.col("window_start").isNull() | (F.col("date") >= F.col("window_start"))) & (F.col("window_end").isNull() | (F.col("date") <= F.col("window_end")))
    return bars.join(w, "ticker").where(inside).drop("window_start", "window_end")


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """Percent return from a bar to the horizon-th one after it; absent where there is none."""
    w = Window.partitionBy("ticker").orderBy("date")
    return bars.withColumn("forward", (F.lead("close", horizon).over(w) / F.col("close") - 1) * 100).where("forward IS NOT NULL")


def live_over_backfill(live: DataFrame, backfill: DataFrame, key: str = "date") -> DataFrame:
    """All live rows, and the backfill of keys that live doesn't have."""
    return live.unionByName(backfill.join(live.select(key).distinct(), key, "left_anti"))


def reconcile(intended: DataFrame, held: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """symbol, intended and held shares and whether they are matched, mismatched, missing or extra."""
    both = intended.select("symbol", F.col("qty").alias("intended")).join(held.select("symbol", F.col("qty").alias("held")), "symbol", "full_outer")
    status = F.when(F.col("held").isNull(), "missing").when(F.col("intended").isNull(), "extra").when(F.abs(F.col("intended") - F.col("held")) <= tolerance, "matched").otherwise("mismatch")
    return both.withColumn("status", status)


def valued(positions: DataFrame, prices: DataFrame, fx: float = 1.0) -> DataFrame:
    """Positions with their value at the last price; unpriced ones have a null value and don't count in sums."""
    last = prices.groupBy("ticker").agg(F.max_by("close", "date").alias("price"))
    return positions.join(last, "ticker", "left").withColumn("value", F.col("qty") * F.col("price") * F.lit(fx))


def earliest(frame: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of each key the row with the least by; of equals the least of the whole row."""
    others = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.min(F.struct(F.col(by).alias("_by"), *others)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others])


def turnover(before: Column, after: Column) -> Column:
    """Names that two sets don't share."""
    return F.size(F.array_except(before, after)) + F.size(F.array_except(after, before))
