"""Queries of outcomes that come in bit by bit, over events as a stream."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..sources import tables as src
from ..sources.work import work_folder
from ..streaming.outcomes import Outcomes, resolved_signals
from .catalog import register, rounded
from .sql import BARS, MINUTES, O

PARTS = 4  # runs, each of which finds some more bars


@register(f"""{MINUTES}, p AS (SELECT *, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) ORDER BY ts) AS first, lead(close, 26) OVER w AS a, lead(close, 78) OVER w AS b FROM b WINDOW w AS (PARTITION BY ticker ORDER BY ts))
SELECT ticker, ts AS asof, 26 AS horizon, round((a / close - 1) * 100, 6) AS ret FROM p WHERE first = 1 AND close > 0 AND a IS NOT NULL UNION ALL SELECT ticker, ts, 78, round((b / close - 1) * 100, 6) FROM p WHERE first = 1 AND close > 0 AND b IS NOT NULL""")
def z2_incremental_outcomes(spark, sf):
    """Each day's first bar is a record; bars arrive in four runs over one stream, and every outcome is written once."""
    home = work_folder(spark)
    bars = src.bars_15m(spark, sf).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "close")
    records = bars.groupBy("ticker", F.to_date("ts").alias("day")).agg(F.min("ts").alias("asof")).select("ticker", "asof")
    ends = bars.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select((F.unix_timestamp("b") - F.unix_timestamp("a") + 1).alias("n"), F.unix_timestamp("a").alias("a"))
    part = F.floor((F.unix_timestamp("ts") - F.col("a")) * PARTS / F.col("n"))
    dealt = bars.crossJoin(F.broadcast(ends)).withColumn("part", part).drop("n", "a")  # one row
    store = Outcomes(spark, home, records)
    for k in range(PARTS):
        dealt.where(F.col("part") == k).drop("part").write.mode("append").parquet(f"{home}/source")
        store.take(spark.readStream.schema("ticker string, ts timestamp, close double").option("maxFileAge", "36500d").parquet(f"{home}/source"))
    return rounded(store.done().withColumn("asof", F.col("asof").cast("timestamp_ntz")))


@register(f"""{BARS}, n AS (SELECT *, row_number() OVER ({O}) AS pos FROM b), s AS (SELECT ticker AS symbol, CAST(date_trunc('quarter', date) AS DATE) AS entry_date, arg_min(open, date) AS entry_price FROM b GROUP BY 1, 2),
g AS (SELECT s.*, CASE WHEN month(entry_date) = 4 THEN 1.5::DOUBLE END AS known, (SELECT count(*) FROM n WHERE n.ticker = s.symbol AND n.date <= s.entry_date) + 21 AS at FROM s)
SELECT symbol, entry_date, round(entry_price, 6) AS entry_price, round(CASE WHEN known IS NOT NULL THEN known WHEN entry_price > 0 THEN (n.close / entry_price - 1) * 100 END, 6) AS return_pct, CASE WHEN known IS NULL AND entry_price > 0 THEN n.date END AS outcome_date
FROM g LEFT JOIN n ON n.ticker = g.symbol AND n.pos = g.at""")
def z2_signal_outcomes(spark, sf):
    """A signal a quarter and ticker; those of the second quarters have been resolved before and stay as they are."""
    b = src.bars_daily(spark, sf)
    day = F.to_date(F.date_trunc("quarter", "date"))
    s = b.groupBy(F.col("ticker").alias("symbol"), day.alias("entry_date")).agg(F.min_by("open", "date").alias("entry_price"))
    s = s.withColumns({"return_pct": F.when(F.month("entry_date") == 4, 1.5), "outcome_date": F.lit(None).cast("date")})
    return rounded(resolved_signals(s, b))
