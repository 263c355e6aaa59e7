"""Order statistics over sliding ranges of days, by dyadic blocks of days: no window holds more than a block's events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """(level, at): the dyadic blocks [at * 2^level, (at + 1) * 2^level) that make up the days from low to before high; two a level at most."""
    none = F.array().cast("array<struct<level:int,at:int>>")
    block = lambda k, at: F.array(F.struct(k.alias("level"), at.cast("int").alias("at")))

    def climb(s, k):
        lo, hi = s["lo"], s["hi"]
        left = (lo < hi) & (F.pmod(lo, F.lit(2)) == 1)
        lo2 = F.when(left, lo + 1).otherwise(lo)
        right = (lo2 < hi) & (F.pmod(hi, F.lit(2)) == 1)
        hi2 = F.when(right, hi - 1).otherwise(hi)
        taken = F.concat(s["out"], F.when(left, block(k, lo)).otherwise(none), F.when(right, block(k, hi2)).otherwise(none))
        return F.struct(F.floor(lo2 / 2).cast("int").alias("lo"), F.floor(hi2 / 2).cast("int").alias("hi"), taken.alias("out"))

    start = F.struct(low.cast("int").alias("lo"), high.cast("int").alias("hi"), none.alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, climb, lambda s: s["out"])


def trailing_percentile(events: DataFrame, day: str, value: str, days: int = 250, least: int = 20) -> DataFrame:
    """events with pool and percentile: how many events the days before have (the day itself not among them), and the share of
    these whose value is smaller; null for pools of fewer than least events or without a value of its own.

    What an event is told hangs on its day and value alone. It stands in one block of each level and asks at most two blocks a
    level, so rows grow by a factor that hangs on days alone; within a block, events and questions are counted in order of
    value. Events without a day or value are in no pool."""
    levels = days.bit_length() + 1
    e = events.withColumns({"_d": F.unix_date(F.col(day)), "_v": F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))})
    known = e.where("_d IS NOT NULL AND _v IS NOT NULL").groupBy("_d", "_v").agg(F.count("*").alias("_in"))
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    members = known.select(level.alias("level"), "_d", "_v", "_in").select("level", F.call_function("shiftright", "_d", "level").alias("at"), "_v", "_in", F.lit(None).cast("int").alias("_d"))
    asks = known.select("_d", "_v", F.inline(_blocks(F.col("_d") - days, F.col("_d"), levels))).select("level", "at", "_v", F.lit(0).cast("long").alias("_in"), "_d")
    block = Window.partitionBy("level", "at")
    # Questions come before the members of their value, so that only smaller ones are counted.
    counted = members.unionByName(asks).withColumns({"_less": F.sum("_in").over(block.orderBy("_v", "_in").rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_in").over(block)})
    got = counted.where("_in = 0").groupBy("_d", "_v").agg(F.sum("_less").alias("_less"), F.sum("_all").alias("pool"))
    out = e.join(got, ["_d", "_v"], "left").withColumn("pool", F.coalesce("pool", F.lit(0)))
    return out.withColumn("percentile", F.when(F.col("pool") >= least, F.col("_less") / F.col("pool"))).drop("_d", "_v", "_less")
