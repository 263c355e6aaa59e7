"""Streams of ticks and bars: watermarked bars, gap sessions, idempotent daily records and keyed order state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of tick files of one folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def streamed_bars(ticks: DataFrame, minutes: int = 15, late: str = "30 minutes") -> DataFrame:
    """Bars from ticks (ticker, ts, event_id, value); final once the watermark has passed. ts must be a timestamp with zone."""
    key = F.struct("ts", "event_id", "value")
    g = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", f"{minutes} minutes").alias("w"))
    b = g.agg(F.min(key).alias("f"), F.max("value").alias("high"), F.min("value").alias("low"), F.max(key).alias("l"), F.count("*").alias("volume"))
    return b.select("ticker", F.col("w.start").alias("ts"), F.col("f.value").alias("open"), "high", "low", F.col("l.value").alias("close"), "volume")


def gap_sessions(ticks: DataFrame, gap: str = "30 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of a key's ticks without a gap."""
    g = ticks.withWatermark("ts", late).groupBy("ticker", F.session_window("ts", gap).alias("s"))
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("ticker", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


def once_a_day(records: DataFrame, late: str = "2 days") -> DataFrame:
    """The first record of a ticker's session date; repeats within the watermark are dropped."""
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(["ticker", "session"])


def regular_hours(bars: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """UTC bars within 09:30 to 16:00 of the zone, with their session date."""
    local = F.from_utc_timestamp("ts", zone)
    minute = F.hour(local) * 60 + F.minute(local)
    return bars.withColumns({"session": F.to_date(local), "_m": minute}).where("_m >= 570 AND _m < 960").drop("_m")


def order_states(orders: DataFrame, fill_bars: int = 20) -> DataFrame:
    """Keyed state of limit orders over a stream of (ticker, ts, kind, price, low): an order fills at the first bar whose low
    reaches its price and expires after fill_bars bars; one row for each order that ends."""
    schema = "ticker string, price double, ended timestamp, outcome string, bars int"

    def step(key, frames, state):
        import pandas as pd

        open_ = [list(x) for x in state.get[0]] if state.exists else []
        done = []
        for f in frames:
            for r in f.sort_values(["ts", "kind"], kind="stable").itertuples():
                if r.kind == "order":
                    open_.append([float(r.price), 0])
                    continue
                rest = []
                for price, n in open_:
                    if r.low <= price:
                        done.append((key[0], price, r.ts, "filled", int(n) + 1))
                    elif n + 1 >= fill_bars:
                        done.append((key[0], price, r.ts, "expired", int(n) + 1))
                    else:
                        rest.append([price, n + 1])
                open_ = rest
        state.update((open_,))
        yield pd.DataFrame(done, columns=["ticker", "price", "ended", "outcome", "bars"])

    return orders.groupBy("ticker").applyInPandasWithState(step, schema, "open array<array<double>>", "append", "NoTimeout")
